import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

WORDS = "the of and harbour signal copper window river market yellow engine theory distant morning letter stone garden paper bridge winter".split()


def prose(r, n):
    return " ".join(r.choice(WORDS) + str(r.randrange(400)) for _ in range(n))


def make_rows():
    """Clean texts, exact and near copies, shared passages, odd texts, repeated rows and nulls."""
    r = random.Random(11)
    rows, texts = [], []
    passage = prose(r, 70)
    for i in range(60):
        texts.append(prose(r, r.choice((3, 30, 90, 200))))
    for i in range(0, 20, 2):
        texts.append(texts[i].upper() if i % 4 else texts[i])
    for i in range(10):
        words = texts[2 * i + 1].split()
        words[len(words) // 2] = "changed"
        texts.append(" ".join(words))
    for i in range(8):
        texts.append(prose(r, 20) + " " + passage + "\n" + prose(r, 15))
    texts += ["", None, "\n\t ", "x", "one two", "a " * 300, "ab\tcd " * 120, "é" * 50, "\x1c\x85 z", prose(r, 9000)]
    for i, t in enumerate(texts):
        rows.append((i, t, r.choice(("en", "de", None)), r.choice(("s1", "s2", "s1", None)), None if t is None else len(t)))
    rows += [(5, texts[5], "en", "s1", 1), (None, texts[7], None, None, None), (None, None, None, None, None)]
    return rows


@pytest.fixture(scope="session")
def rows():
    return make_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def distinct_docs(spark, rows):
    """The rows with one row for each id."""
    seen, out = set(), []
    for row in rows:
        if row[0] is not None and row[0] not in seen:
            seen.add(row[0])
            out.append(row)
    return spark.createDataFrame(out, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(spark, docs):
    """Extra columns under names that operators use inside."""
    from pyspark.sql import functions as F

    names = "row row_id shard fp xx size kept slot _id _xx _k _need _size _u _pref held id k m u z p low last closes copy copies certain target need q blob spans rules part piece chunk h at n".split()
    return docs.withColumns({n: F.lit("clash") for n in names} | {"a.b": F.lit("dotted"), "odd name`": F.col("doc_id")})
