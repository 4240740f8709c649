"""Documents with the awkward cases that every operator must take."""

import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, size int, id int, fp string, spans int, taken int, score int, component int, h int, label int"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(n))


def rows():
    rng = random.Random(11)
    passage = words(rng, 60)
    texts = [words(rng, rng.randint(1, 150)) for _ in range(40)]
    texts += [texts[0], texts[0], texts[1] + " tail", None, "", None, "", " \t\n", "\n\n\n", "a", "A", "one two three", "ONE two  three"]
    texts += [f"{words(rng, 20)} {passage} {words(rng, 20)}" for _ in range(4)]
    texts += [words(rng, 15_000), "x" * 3000, "ab" * 900, "日本語 " * 120, "é" * 150 + "𝒳" * 120, "123 456 !!", "nul \x00 inside\r\nline\x0bx"]
    line = "A common line of the footer."
    texts += [f"{words(rng, 3)}\n  {line}\t\n{words(rng, 4)}\n{line.upper()}" for _ in range(5)] + [f"{line}\n{line}"]
    out = [(3 * i, t) for i, t in enumerate(texts)]
    out += [out[2], out[2], (5, texts[3]), (5, texts[4]), (None, texts[5]), (None, None)]
    langs, sources = ["en", "de", None], ["a", "b", None, "b", "b"]
    return [(i, t, langs[k % 3], sources[k % 5], len(t or ""), 1, 2, "f", 3, 4, 5, 6, 7, 8) for k, (i, t) in enumerate(out)]


@pytest.fixture(scope="session")
def raw():
    return rows()


@pytest.fixture(scope="session")
def docs(spark, raw):
    return spark.createDataFrame(raw, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(docs):
    return docs.limit(0)
