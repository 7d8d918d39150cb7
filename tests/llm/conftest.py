import random

import pytest

WORDS = [a + b + c for a in ("ka", "lo", "mi", "nu", "re", "so") for b in ("ta", "vi", "po", "du") for c in ("", "n", "s", "r")]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text, lang, source, n_chars): prose, exact and near copies, empty, null, short and long texts."""
    rng = random.Random(5)
    rows, texts = [], []
    for i in range(90):
        t = "\n".join(prose(rng, rng.randint(8, 40)) for _ in range(rng.randint(1, 5)))
        texts.append(t)
    texts[10] = texts[3]
    w = texts[4].split(" ")
    w[len(w) // 2] = "changed"
    texts[11] = " ".join(w)
    texts[12] = texts[5] + " tail"
    texts[20], texts[21], texts[22], texts[23] = "", None, "one", "  \n\n "
    texts[24] = prose(rng, 30_000)
    texts[25] = "ümlaut ▁ 執 🎉\ttab\r\nend \x00 zero " + texts[6]
    texts[26] = 'api_key = "Zx81kQpL29vTr7"\npassword: hunter22\nhex deadbeefdeadbeefdeadbeef01'
    for i, t in enumerate(texts):
        rows.append((i, t, "en", None if i % 17 == 0 else f"s{i % 4}", len(t) if t is not None else None))
    return rows


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, repeated rows, and columns whose names clash with inner ones."""
    rows = [(None, "a b c d e f g h", None, None, None), (1, None, "x", "s", 1), (2, "a b c d e f g h", None, "s", 3), (2, "a b c d e f g h", None, "s", 3), (None, None, None, None, None), (3, "", "x", None, 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    for c in ("id", "component", "size", "g", "n", "shard", "start", "score", "key", "bucket", "units", "fp", "s", "block", "drops", "pos"):
        df = df.withColumn(c, df["lang"])
    return df
