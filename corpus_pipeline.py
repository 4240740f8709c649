"""Corpus preparation: stages over `documents`, each written and read again.

Every stage takes (spark, docs, sf_dir) and works on all rows of its predecessor. All
but the last return the columns of `documents`; the last says which shard and slot
each row of the mix goes to. Columns beyond those of `documents` are dropped; an empty
table gives no rows in any stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.llm.common import table, written
from logloom.llm.decontamination import decontaminate
from logloom.llm.language import UNDETERMINED, identify, train
from logloom.llm.mixing import mix_sources
from logloom.llm.sharding import interleave
from logloom.llm.simhash import keep_first

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in a language; null texts and texts without a letter go.

    The model learns from rows with a language that are not held out; if there are none,
    no text has a language and all rows go. Texts that tie between languages stay, like
    rows that repeat an id or a text, and rows without id, language or source.
    """
    return identify(docs, train(docs)).filter(F.col("lang_pred") != UNDETERMINED).select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the smallest doc_id of each group of near duplicates.

    Texts link at a fingerprint similarity of 0.8 or more: a fifth or less of 256 bits
    differ. Fingerprints are over distinct shingles of five words. Null, empty and blank texts are one group. Of rows that repeat the id kept the one with
    the smallest hash of its text stays; rows without an id all stay (see keep_first).
    """
    return keep_first(docs, shingle=5, words=4, radius=51).select(*COLUMNS)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without any window of a benchmark item.

    Null texts have no words and stay. What becomes of a row depends on its text alone,
    so rows that repeat an id or a text are judged alike; items without words hit none.
    """
    return decontaminate(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many copies of a row as the mix takes; a row cut by the edge of its quota is whole if half of it or more fits, else absent.

    Null texts and texts without words have size 0 and are not taken. Null sources are
    one source, the last in order. Rows that repeat an id are rows of their own; rows
    equal in id and size lie together in the seeded order, the one on the edge being
    any of them.
    """
    out = mix_sources(docs, keep=("text", "lang", "n_chars"))
    copies = F.floor(F.col("taken") / F.greatest(F.col("size"), F.lit(1)) + 0.5).cast("int")
    out = out.withColumn("_copies", copies).filter("_copies > 0")
    return out.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(*COLUMNS)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every row; copies of a row have places of their own.

    The text stays behind: doc_id (with text_crc32 where ids repeat) finds it again, and
    (shard, slot) tells copies apart. Null ids, sources and texts are placed like others.
    """
    out = interleave(docs, 16, keep=("lang", "n_chars"))
    return out.select("doc_id", "source", "lang", "n_chars", "size", "text_crc32", "shard", "slot")


STAGES = [
    ("language_id", language_stage),
    ("simhash_near_dedup", near_duplicate_stage),
    ("benchmark_decontamination", decontamination_stage),
    ("source_mixing", mixing_stage),
    ("sharding", sharding_stage),
]

#: Language, fingerprints and the seeded mix can't be put in SQL; tests/llm/test_pipeline.py compares each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
