"""What the text operators share: words, checked broadcasts, Arrow batch sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from coppice.plans.fixpoint import cut, cut_of, planned_bytes

#: A side with at most so many rows is broadcast when a row holds a few numbers (16 MB or so).
BROADCAST_ROWS = 500_000
#: The same side takes up no more than so many bytes as a table.
BROADCAST_BYTES = 32 << 20
#: Texts reach Python in batches of at most so many rows, about 4 MB of ordinary prose.
BATCH_ROWS = 1_000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches that carry whole texts, by rows and by bytes.

    Operators return lazy tables, so the bound stays set in the session.  A smaller bound
    that the caller has set is kept.
    """
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", 16 << 20)):
        key = f"spark.sql.execution.arrow.{key}"
        now = str(spark.conf.get(key)).lower().removesuffix("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def column_or_null(df: DataFrame, name: str, kind: str) -> Column:
    """``df[name]`` as ``kind``, or a null of that kind where the table has no such column."""
    return F.col(name).cast(kind) if name in df.columns else F.lit(None).cast(kind)


def without(df: DataFrame, dropped: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``df`` whose ``keys`` are not in ``dropped``, a cut table.

    Where ``checked_broadcast`` finds the list small, texts stay where they are; a longer
    one is joined by a shuffle.
    """
    small, is_small = _checked(dropped)
    return df.join(small if is_small else dropped.hint("merge"), keys, "left_anti")


#: Stands for a null doc_id where rows are joined by it.
NO_ID = -(1 << 63)


def held_rows(docs: DataFrame, **columns: Column) -> DataFrame:
    """Each whole row as the one column ``held``, beside ``columns`` computed from it.

    Whatever the table's columns are called, they do not meet the names used inside an
    operator; ``released`` gives them back.
    """
    return docs.select(F.struct("*").alias("held"), *(c.alias(name) for name, c in columns.items()))


def released(rows: DataFrame) -> DataFrame:
    return rows.select("held.*")


def id_of(docs: DataFrame) -> Column:
    return F.coalesce(docs["doc_id"].cast("long"), F.lit(NO_ID))


def text_hash(docs: DataFrame) -> Column:
    return F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit("")))


def keep_rows(docs: DataFrame, verdict: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``verdict`` (``doc_id, xx, kept``; a cut table) keeps, as they are.

    Rows that are to go are few and leave by ``without``.  Where a row is repeated and
    only one of it is kept, one is picked by a shuffle, which runs in that case alone.
    """
    v = verdict.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), "xx", "kept").groupBy("id", "xx")
    v = cut(v.agg(F.count_if("kept").alias("stay"), F.count(F.lit(1)).alias("n")).where("stay < n"), "verdict")
    out = held_rows(docs, id=id_of(docs), xx=text_hash(docs))
    out = without(out, cut(v.where("stay = 0").select("id", "xx"), "gone"), ["id", "xx"])
    if v.where("stay > 0").limit(1).count():
        out = out.dropDuplicates(["id", "xx"])
    return released(out)


def shard_count(docs: DataFrame, least: int, bytes_each: int) -> int:
    """Shards so that each holds about ``bytes_each`` of stored text, but no fewer than ``least``.

    The planner knows the size of files; where it does not know a table's, the text is measured.
    """
    size = planned_bytes(docs.select("doc_id", "text"))
    if size >= 1 << 60:
        size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    return max(least, -(-size // bytes_each))


def _checked(df: DataFrame) -> tuple[DataFrame, bool]:
    small = planned_bytes(df) <= BROADCAST_BYTES and df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return (F.broadcast(df) if small else df), small


def checked_broadcast(df: DataFrame) -> DataFrame:
    """``df`` to be broadcast if its files and a count show that it is small, else as it is; give a cut table."""
    return _checked(df)[0]


__all__ = [
    "BATCH_ROWS",
    "BROADCAST_ROWS",
    "LOWER",
    "NO_ID",
    "UPPER",
    "checked_broadcast",
    "column_or_null",
    "cut",
    "cut_of",
    "held_rows",
    "id_of",
    "keep_rows",
    "planned_bytes",
    "released",
    "shard_count",
    "small_batches",
    "text_hash",
    "without",
]
