import random

import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, stems="alpha beta gamma delta eps zeta eta theta iota kappa".split()):
    return " ".join(rng.choice(stems) + rng.choice(stems)[:3] for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """Small cases: nulls, empty and long texts, copies, near copies, shared passages, repeats inside a text."""
    rng = random.Random(3)
    base = [words(rng, rng.randint(5, 200)) for _ in range(25)]
    passage = words(rng, 120)
    out = [None, "", "  \n\t ", "123 456 ...", "one", *base, base[0], base[1].upper(), base[2].replace("alpha", "omega", 1)]
    out += [f"{words(rng, 30)} {passage} {words(rng, 30)}" for _ in range(4)]
    out += [passage, "ab " * 400, "x" * 3000, words(rng, 60) + " " + passage + "\n" + passage, "naïve Ärger ÉTÉ İ ß " * 30, "Ärger " + words(rng, 90), words(rng, 9000)]
    return out


@pytest.fixture(scope="session")
def docs(spark, texts):
    rows = [(i * 7 % 101, t, "en" if i % 3 else "de", "s", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def odd(spark, texts):
    """Null ids and whole rows twice, with columns whose names the operators use inside."""
    rows = [(None, texts[5], None, None, None), (1, texts[5], "en", "s", 1), (1, texts[5], "en", "s", 1), (2, texts[-1], "en", "s", 1), (None, None, None, None, None)]
    extra = {c: F.lit(7) for c in ("rid", "key", "salt", "_salt", "norm", "words", "label", "spans", "fp", "n", "line")}
    return spark.createDataFrame(rows, SCHEMA).withColumns(extra)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
