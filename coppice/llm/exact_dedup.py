"""Exact duplicates by composable polynomial fingerprints.

A text is read as bytes, split into chunks, and each chunk hashed on its own:
``F(x) = x as a base-256 number mod p``, for four 31-bit primes.  Chunk hashes combine
by length-shifted arithmetic, ``F(xy) = F(x) * 256^|y| + F(y)``, so a huge document is
hashed by chunk rows and put together by one aggregation.  Rows with equal
fingerprint and length are candidates; every candidate's text is then compared with
the text of its group's surviving row, chunk by chunk.  A row that differs after all
(a fingerprint collision) leaves the group and is grouped again by the SHA-256 of its text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coppice.llm.common import LOWER, UPPER, checked_broadcast, cut, cut_of, keep_rows, small_batches

# fixed values: primes under 2^31 for which 256 has a long period
PRIMES = (2147483629, 2147483587, 2147483563, 2147483549)
PRODUCT = PRIMES[0] * PRIMES[1] * PRIMES[2] * PRIMES[3]
#: Characters of a chunk; longer texts are hashed and compared in several rows.
CHUNK = 1 << 20
#: Members of a group that are compared beside one copy of the group's surviving text.
MEMBERS_EACH = 256

_LANES = [f"{x}{i}" for x in "hw" for i in range(4)]
_HASHED = "row_id long, doc_id long, xx long, big_sha string, chunk_no int, size long, sha string, " + ", ".join(
    f"{x} long" for x in _LANES
)


def chunk_hash(data: bytes) -> tuple[int, ...]:
    """The four lanes of ``data`` and of the shift by its length."""
    value, shift = int.from_bytes(data, "big") % PRODUCT, pow(256, len(data), PRODUCT)
    return tuple(value % p for p in PRIMES) + tuple(shift % p for p in PRIMES)


def combine(left: tuple[int, ...], right: tuple[int, ...]) -> tuple[int, ...]:
    """Lanes of the concatenation, from the lanes of its two parts."""
    value = tuple((a * w + b) % p for a, b, w, p in zip(left[:4], right[:4], right[4:], PRIMES))
    return value + tuple(a * b % p for a, b, p in zip(left[4:], right[4:], PRIMES))


def _hash_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sizes, shas, lanes = [], [], [[] for _ in _LANES]
        for text, big in zip(b.column("chunk"), b.column("big_sha").to_pylist()):
            data = text.as_buffer().to_pybytes().lower()  # bytes.lower touches A-Z only
            sizes.append(len(data))
            shas.append(big or hashlib.sha256(data).hexdigest())
            for column, x in zip(lanes, chunk_hash(data)):
                column.append(x)
        kept = [b.column(x) for x in ("row_id", "doc_id", "xx", "big_sha", "chunk_no")]
        arrays = [*kept, pa.array(sizes, pa.int64()), pa.array(shas, pa.string()), *(pa.array(x, pa.int64()) for x in lanes)]
        names = ["row_id", "doc_id", "xx", "big_sha", "chunk_no", "size", "sha", *_LANES]
        yield pa.RecordBatch.from_arrays(arrays, names=names)


def _chunks(text, chunk: int):
    """The text's chunks as an array, cut in one pass; a text of one chunk is passed on as it is."""
    many = F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % chunk), F.lit(0))
    return F.when(F.length(text) <= chunk, F.array(text)).otherwise(many)


def _hashed_chunks(rows: DataFrame, chunk: int) -> DataFrame:
    """Chunk hashes of all rows; a long text's chunks are dealt over the tasks before they are hashed."""
    columns = ["row_id", "doc_id", "xx"]
    long = F.length("t") > chunk
    short = rows.where(~long).select(*columns, F.lit(None).cast("string").alias("big_sha"), F.lit(0).alias("chunk_no"), F.col("t").alias("chunk"))
    whole = F.sha2(F.translate("t", UPPER, LOWER), 256).alias("big_sha")
    parts = rows.where(long).select(*columns, whole, F.posexplode(_chunks(F.col("t"), chunk)).alias("chunk_no", "chunk"))
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = parts.repartition(n, F.xxhash64("row_id", "chunk_no"))
    return short.union(dealt).mapInArrow(_hash_chunks, _HASHED)


def fingerprints(docs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """``(row_id, doc_id, xx, fp, sha)`` for every row: fingerprint with length, and SHA-256 of the normalised text."""
    small_batches(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("xx"), text.alias("t"))
    hashed = _hashed_chunks(rows, chunk)
    part = F.struct("chunk_no", "size", "sha", *_LANES)
    parts = hashed.groupBy("row_id", "doc_id", "xx").agg(F.sort_array(F.collect_list(part)).alias("p"))

    def lane(i: int):
        p = F.lit(PRIMES[i])
        return F.aggregate("p", F.lit(0).cast("long"), lambda acc, x: (acc * x[f"w{i}"] + x[f"h{i}"]) % p)

    size = F.aggregate("p", F.lit(0).cast("long"), lambda acc, x: acc + x["size"])
    fp = F.concat_ws("-", *(F.lower(F.hex(lane(i))) for i in range(4)), size)
    return parts.select("row_id", "doc_id", "xx", fp.alias("fp"), F.col("p")[0]["sha"].alias("sha"))


def _unlike(docs: DataFrame, members: DataFrame, chunk: int) -> DataFrame:
    """Members whose text differs from their group's surviving text: ``(doc_id, xx, fp)``."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    texts = docs.select(F.col("doc_id").cast("long").alias("d"), F.xxhash64(text).alias("x"), text.alias("t"))
    held = texts.join(members, F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("x") == F.col("xx"))).select(
        "doc_id", "xx", "fp", "survives", "salts", F.translate("t", UPPER, LOWER).alias("t")
    )
    keys = ["fp", "salt", "chunk_no"]
    left = held.where(~F.col("survives")).select(
        "doc_id", "xx", "fp", F.pmod(F.xxhash64("doc_id"), "salts").alias("salt"), F.posexplode(_chunks(F.col("t"), chunk)).alias("chunk_no", "mine")
    )
    right = (
        held.where("survives")
        .select("fp", "t", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"))
        .select("fp", "salt", F.posexplode(_chunks(F.col("t"), chunk)).alias("chunk_no", "theirs"))
    )
    return left.join(right, keys, "left").where(~F.col("mine").eqNullSafe(F.col("theirs"))).select("doc_id", "xx", "fp").distinct()


def exact_duplicates(docs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256, xx``.

    Texts are equal when identical after lower-casing A-Z; null counts as empty.  The
    row with the largest doc_id of a group stays.  Of repeated rows with one doc_id a
    single one stays, the others refer to it; a null doc_id counts as smallest, and
    ``keep_id`` is null where all ids of the group are.  An empty table gives no rows;
    other columns are ignored.  ``xx`` identifies the row's raw text for joins.
    """
    rows = cut(fingerprints(docs, chunk), "fingerprints")
    order = F.struct(F.coalesce(F.col("doc_id"), F.lit(-(1 << 63))).alias("o"), F.col("row_id").alias("r"))
    groups = cut(rows.groupBy("fp").agg(F.max(order).alias("top"), F.count(F.lit(1)).alias("n")).where("n > 1"), "groups")
    members = rows.join(checked_broadcast(groups), "fp").select(
        "doc_id",
        "xx",
        "fp",
        (F.col("row_id") == F.col("top.r")).alias("survives"),
        F.ceil(F.col("n") / F.lit(MEMBERS_EACH)).cast("long").alias("salts"),
    )
    # repeated rows need one comparison; the surviving one wins over its own repeats
    members = members.groupBy("doc_id", "xx", "fp").agg(F.max("survives").alias("survives"), F.max("salts").alias("salts"))
    unlike = _unlike(docs, members, chunk)
    rows = rows.join(
        unlike.select(F.col("doc_id").alias("d"), F.col("xx").alias("x"), F.col("fp").alias("f"), F.lit(True).alias("alone")),
        F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("xx") == F.col("x")) & (F.col("fp") == F.col("f")),
        "left",
    ).select("row_id", "doc_id", "xx", "fp", "sha", F.when(F.col("alone"), F.col("sha")).otherwise("").alias("class"))
    rows = cut(rows, "classes")
    found = rows.groupBy("fp", "class").agg(F.max(order).alias("top"), F.max("doc_id").alias("keep"), F.count(F.lit(1)).alias("n"))
    # a row alone in its group needs no partner; the groups that are left are few
    found = checked_broadcast(cut(found.where("n > 1"), "kept"))
    return rows.join(found, ["fp", "class"], "left").select(
        "doc_id",
        F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("keep")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("row_id") == F.col("top.r"), F.lit(True)).alias("kept"),
        F.col("sha").alias("text_sha256"),
        "xx",
    )


def survivors(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, as they are, that stay: one of each group of equal texts.

    Nulls, empty and long texts, ties and repeated rows are as in ``exact_duplicates``;
    an empty table stays empty, and columns of any name pass through unchanged.
    """
    verdict = cut_of(lambda: exact_duplicates(docs).select("doc_id", "xx", "kept"), "verdict")
    return keep_rows(docs, verdict)
