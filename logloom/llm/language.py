"""Language identification by cross-parsing entropy.

A suffix automaton per language, built from a bounded sample of labelled text, gives
the longest match at any place of a text. A text is parsed greedily into such
matches; the language that needs the fewest phrases per character wins.

Texts are parsed in segments of SEGMENT characters, many at once with numpy: one
table step moves every segment on by one character in every language.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship
from .common import table

UNDETERMINED = "und"
SEGMENT = 1024
#: Bounds of the training sample: rows and characters of each language, longest piece of a row.
ROWS_PER_LANGUAGE = 128
CHARS_PER_LANGUAGE = 32_768
LONGEST_ROW = 20_000
MAX_LANGUAGES = 64
#: States times symbols of an automaton up to which its transitions are a dense table.
DENSE = 1 << 23
#: Characters parsed at once in a task.
BATCH_CHARS = 4_000_000


def suffix_automaton(codes: list[int]) -> list[dict[int, int]]:
    """Transitions {symbol: state} of each state of the automaton of all substrings; state 0 is the root."""
    go, link, length = [{}], [-1], [0]
    last = 0
    for c in codes:
        new = len(go)
        go.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p != -1 and c not in go[p]:
            go[p][c] = new
            p = link[p]
        if p != -1:
            q = go[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                copy = len(go)
                go.append(dict(go[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p != -1 and go[p].get(c) == q:
                    go[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return go


class Moves:
    """Transitions of one automaton, its states counted from 1; 0 is the dead state.

    Symbols are dealt an alphabet of the automaton's own. Small automata are a dense
    table; those of large alphabets keep the root's row and a sorted array of
    state * symbol keys for all others.
    """

    def __init__(self, codes: list[int], symbols: int) -> None:
        go = suffix_automaton(codes)
        own = sorted({c for moves in go for c in moves} - {0})
        self.own = np.zeros(symbols, np.int32)
        self.own[own] = np.arange(1, len(own) + 1)
        self.width = len(own) + 1
        at = {c: i + 1 for i, c in enumerate(own)}
        keys = np.array([(s + 1) * self.width + at[c] for s, m in enumerate(go) for c in m if c], np.int64)
        to = np.array([x + 1 for m in go for c, x in m.items() if c], np.int32)
        self.root = np.zeros(self.width, np.int32)
        first = keys < 2 * self.width
        self.root[keys[first] - self.width] = to[first]
        self.table = self.keys = None
        size = (len(go) + 1) * self.width
        if size <= DENSE:
            self.table = np.zeros(size, np.int32)
            self.table[keys] = to
        else:
            order = np.argsort(keys)
            self.keys, self.to = keys[order], to[order]

    def step(self, state: np.ndarray, own: np.ndarray) -> np.ndarray:
        key = state.astype(np.int64) * self.width + own
        if self.table is not None:
            return self.table[key]
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.to[at], 0)


def _letters(text: str) -> np.ndarray:
    """Code points of the lower-cased text, all that are not letters as one space."""
    low = text.lower()
    return np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32)


class Model:
    """An automaton for each language; symbol 0 is never matched, 1 is a non-letter.

    Every letter of the samples has a symbol of its own; letters that no sample has
    share symbol 0.
    """

    def __init__(self, samples: tuple[tuple[str, str], ...]) -> None:
        self.languages = [lang for lang, _ in samples]
        seen = sorted({c for _, text in samples for c in text.lower() if c.isalpha()})
        self.code = np.ones(0x110000, np.int32)
        for c in range(0x110000):
            if not 0xD800 <= c < 0xE000 and chr(c).isalpha():
                self.code[c] = 0
        for i, c in enumerate(seen):
            self.code[ord(c)] = i + 2
        self.symbols = len(seen) + 2
        self.moves = [Moves(self.encode(text).tolist(), self.symbols) for _, text in samples]

    def encode(self, text: str) -> np.ndarray:
        return self.code[_letters(text)]

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """Phrases [language, text] of the greedy parse."""
        out = np.zeros((len(self.moves), len(texts)), np.int64)
        if not texts or not self.moves:
            return out
        sizes = np.array([len(x) for x in texts])
        owner = np.repeat(np.arange(len(texts)), -(-sizes // SEGMENT))
        if not len(owner):
            return out
        first = np.concatenate([[0], np.cumsum(-(-sizes // SEGMENT))[:-1]])
        inside = (np.arange(len(owner)) - first[owner]) * SEGMENT
        begin = (np.cumsum(sizes) - sizes)[owner] + inside
        length = np.minimum(sizes[owner] - inside, SEGMENT)
        order = np.argsort(-length, kind="stable")
        owner, begin, length = owner[order], begin[order], length[order]
        codes = np.concatenate(texts)
        active = np.searchsorted(-length, -np.arange(int(length[0])), side="left")
        for lang, moves in enumerate(self.moves):
            own = moves.own[codes]
            state = np.zeros(len(owner), np.int32)  # dead: the first character opens a phrase
            count = np.zeros(len(owner), np.int32)
            for t in range(int(length[0])):
                k = active[t]
                c = own[begin[:k] + t]
                to = moves.step(state[:k], c)
                lost = to == 0
                count[:k] += lost
                state[:k] = np.where(lost, moves.root[c], to)
            out[lang] = np.bincount(owner, weights=count, minlength=len(texts))
        return out

    def predict(self, texts: list) -> tuple[list[str], list[float]]:
        """Language and score of each text; ties go to the first language in order.

        The score is one less the winner's share of the runner-up's phrases. Null, or
        no letter: ``und`` with score 0.
        """
        named, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
        todo = [i for i, x in enumerate(texts) if x and any(map(str.isalpha, x))]
        if not self.languages:
            return named, scores
        at = 0
        while at < len(todo):
            batch, chars = [], 0
            while at < len(todo) and (not batch or chars + len(texts[todo[at]]) <= BATCH_CHARS):
                batch.append(todo[at])
                chars += len(texts[todo[at]])
                at += 1
            counts = self.phrases([self.encode(texts[i]) for i in batch])
            best = counts.argmin(axis=0)
            for n, i in enumerate(batch):
                named[i] = self.languages[best[n]]
                if len(self.languages) > 1:
                    low, high = np.partition(counts[:, n], 1)[:2]
                    scores[i] = float(1 - low / high)
                else:
                    scores[i] = float(1 - min(1.0, counts[0, n] / len(texts[i])))
        return named, scores


@lru_cache(maxsize=2)
def _model(samples: tuple[tuple[str, str], ...]) -> Model:
    return Model(samples)


def even_shares(texts: list[str], chars: int) -> list[str]:
    """The texts, the longest ones cut to one common length so that all have at most ``chars`` characters."""
    left, share = chars, 0
    for k, n in enumerate(sorted(map(len, texts))):
        share = left // (len(texts) - k)
        if n > share:
            break
        left, share = left - n, n
    return [t[:share] for t in texts]


def sample(
    labelled: DataFrame,
    id_col: str,
    text_col: str,
    lang_col: str,
    rows: int = ROWS_PER_LANGUAGE,
    chars: int = CHARS_PER_LANGUAGE,
    longest: int = LONGEST_ROW,
) -> tuple[tuple[str, str], ...]:
    """(language, text) of up to ``rows`` rows and ``chars`` characters a language, rows in a hashed order.

    Every sampled row serves: where they have more than ``chars`` characters together
    the longest are cut to one common length. At most ``longest`` characters of a row
    are fetched, so what reaches the driver is bounded by MAX_LANGUAGES * rows *
    longest. More rows or characters sharpen close languages and lengthen the time
    that a task takes to build its automata. More languages than MAX_LANGUAGES are an
    error. Rows without text or language are passed over.
    """
    fit = labelled.filter(F.col(lang_col).isNotNull() & (F.char_length(text_col) > 0))
    order = F.xxhash64(F.col(id_col).cast("string"))
    ids = (
        fit.select(F.col(lang_col).alias("_lang"), F.col(id_col).alias("_id"), order.alias("_o"))
        .withColumn("_n", F.row_number().over(Window.partitionBy("_lang").orderBy("_o", "_id")))
        .filter(F.col("_n") <= rows)
    )
    found = ids.select("_lang", "_id", "_n").take(MAX_LANGUAGES * rows + 1)
    if len({r["_lang"] for r in found}) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    keys = {(r["_lang"], r["_id"]): r["_n"] for r in found}
    wanted = [r["_id"] for r in found]
    # an id that repeats serves once, with its least text
    texts_of = fit.filter(F.col(id_col).isin(wanted)).groupBy(lang_col, id_col).agg(F.min(F.substring(text_col, 1, longest)))
    got = texts_of.collect() if wanted else []
    texts: dict[str, list] = {}
    for lang, key, text in sorted(got, key=lambda r: keys.get((r[0], r[1]), 0)):
        if (lang, key) in keys:
            texts.setdefault(lang, []).append(text)
    return tuple((lang, "\n".join(even_shares(texts[lang], chars))) for lang in sorted(texts))


def identify(docs: DataFrame, samples: tuple[tuple[str, str], ...], text_col: str = "text") -> DataFrame:
    """All columns of docs with ``lang_pred`` and ``score`` (replaced if they exist).

    Whole texts of any length are parsed. Null texts and texts without a letter are
    ``und`` with score 0, and so is every text if there are no samples.
    """
    base = docs.drop("lang_pred", "score")
    schema = T.StructType(
        [*base.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    )

    def run(batches):
        model = _model(samples)
        for b in batches:
            named, scores = model.predict(b.column(b.schema.get_field_index(text_col)).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(named, pa.string()), pa.array(scores, pa.float64())],
                names=[*b.schema.names, "lang_pred", "score"],
            )

    ship(docs.sparkSession)
    return base.mapInArrow(run, schema)


def held_out(id_col: Column) -> Column:
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **bounds):
    """Samples of the rows that are not held out; ``bounds`` as in sample()."""
    return sample(docs.filter(~held_out(F.col(id_col))), id_col, text_col, lang_col, **bounds)


def op8_cross_parsing(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = identify(docs.select("doc_id", "text"), train(docs))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
