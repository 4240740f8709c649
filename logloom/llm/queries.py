"""Queries of the corpus operators and their SQL, by name."""

from __future__ import annotations

from . import oracles
from .decontamination import op4_broadcast_ngrams
from .language import op8_cross_parsing
from .lines import op9_perfect_hash_lines
from .mixing import op3_flow_mix
from .secrets import op2_randomness_battery
from .sharding import op6_interleaved_shards
from .simhash import op1_tiled_simhash
from .substrings import op5_backward_extension
from .warc import op7_two_level_index
from .weighted import op10_weighted_sampling

QUERIES = {
    "op1_tiled_simhash": op1_tiled_simhash,
    "op10_weighted_sampling": op10_weighted_sampling,
    "op2_randomness_battery": op2_randomness_battery,
    "op3_flow_mix": op3_flow_mix,
    "op4_broadcast_ngrams": op4_broadcast_ngrams,
    "op5_backward_extension": op5_backward_extension,
    "op6_interleaved_shards": op6_interleaved_shards,
    "op7_two_level_index": op7_two_level_index,
    "op8_cross_parsing": op8_cross_parsing,
    "op9_perfect_hash_lines": op9_perfect_hash_lines,
}

#: Fingerprints by XXH64, test statistics, parses and random draws can't be put in DuckDB's
#: SQL: operators 1, 2, 8 and 10 are tested against brute force and held-out rows.
ORACLE_SQL: dict[str, str] = {
    "op3_flow_mix": oracles.OP3,
    "op4_broadcast_ngrams": oracles.OP4,
    "op5_backward_extension": oracles.OP5,
    "op6_interleaved_shards": oracles.OP6,
    "op7_two_level_index": oracles.OP7,
    "op9_perfect_hash_lines": oracles.OP9,
}
