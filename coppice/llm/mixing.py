"""Mixing sources to target weights by Pareto order sampling.

Each source gets a target in words: shares of a total by weight, no more than a cap,
with the excess reshared by weight (water-filling).  Within a source a document is wanted
``e`` times, in proportion to its measure (by default the number of binary digits of its
word count, so that long documents come more often than short ones), at most ``cap``
times, so that the words wanted add up to the target.  The whole part of ``e`` are certain
copies.  Its fraction is the inclusion probability ``p`` of one more copy: documents are
ranked by random odds divided by inclusion odds, ``(u / (1 - u)) / (p / (1 - p))``, and
taken in that order as long as they fit into what the certain copies leave of the target,
so the sample is of fixed size in words; one more document closes the gap that is left,
if any comes nearer to it than none.

No source is ever sorted as a whole.  Ranks are cut into buckets, the buckets' sums tell
in which one the target falls, that bucket is cut again while it holds many documents,
and only the last one's documents are put in order.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coppice.llm.common import NO_ID, checked_broadcast, column_or_null, cut, held_rows, id_of, released, text_hash

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2
SEED = 42
#: Measures are whole numbers up to this.
MEASURES = 4096
#: Buckets into which the ranks of a source are cut at once, and how often at most.
BUCKETS, LEVELS = 128, 6
#: A bucket of no more documents is put in order.
SORTED = 20_000
#: Sources that one task numbers, about.
STRETCH = 50_000

_ROW = ("id", "xx", "k", "m", "size", "u")


def word_count(text: Column) -> Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+``; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def random_unit(key: Column, seed: int) -> Column:
    """A number in (0, 1) that depends on ``key`` and ``seed`` alone."""
    digits = F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(key.cast("string"), F.lit("null")))), 1, 12)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(float(1 << 48))


def _running(df: DataFrame, order: list[Column], names: tuple[str, ...], parts: int) -> DataFrame:
    """``df`` with ``{name}_before`` for each name: its sum over the rows that come earlier in ``order``.

    Rows are dealt into stretches of the order, summed within each, and led on by the
    stretches' totals, a row for each.
    """
    d = cut(df.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), "stretches")
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = d.groupBy("part").agg(*(F.sum(n).alias(n) for n in names))
    totals = totals.select("part", *(F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"{n}_first") for n in names))
    within = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = ((F.coalesce(F.sum(n).over(within), F.lit(0)) + F.col(f"{n}_first")).alias(f"{n}_before") for n in names)
    return d.join(F.broadcast(totals), "part").select(*df.columns, *before)


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, cap: int) -> DataFrame:
    """One row per source: ``source, source_size, target``.

    Sources are numbered by name and filled up by cap over weight in stretches of about
    ``STRETCH`` rows, so that there may be as many of them as there are hosts.
    """
    s = cut(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    n, total = s.agg(F.count(F.lit(1)), F.coalesce(F.sum("source_size"), F.lit(0))).first()
    parts, total = max(1, -(-n // STRETCH)), share * total
    s = _running(s.withColumn("one", F.lit(1).cast("long")), [F.col("source").asc_nulls_last()], ("one",), parts)
    turn = F.pmod(F.col("one_before"), F.lit(len(weights)))
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (turn + 1).cast("int"))
    s = s.select("source", "source_size", weight.alias("w"), (cap * F.col("source_size")).cast("double").alias("cap"))
    s = cut(s.withColumn("ratio", F.col("cap") / F.col("w")), "weights")
    all_w = s.agg(F.coalesce(F.sum("w"), F.lit(0.0))).first()[0]
    filled = _running(s, [F.col("ratio"), F.col("source").asc_nulls_last()], ("cap", "w"), parts)
    level = (F.lit(total) - F.col("cap_before")) / (F.lit(all_w) - F.col("w_before"))
    filled = filled.withColumn("level", level)
    # the first source, in this order, that the level does not fill
    first = filled.where(F.col("level") * F.col("w") <= F.col("cap")).agg(F.min(F.struct("ratio", F.col("source").isNull().alias("last"), "source", "level"))["level"]).first()[0]
    # if there is none, all are at their caps
    return s.select("source", "source_size", (F.col("cap") if first is None else F.least("cap", F.col("w") * F.lit(first))).alias("target"))


def _source_key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))


def _of_row(docs: DataFrame, seed: int, measure: Column | None) -> dict[str, Column]:
    """What ranks a row, all taken from the row alone."""
    size = word_count(docs["text"].cast("string"))
    m = F.length(F.bin(size)) if measure is None else F.coalesce(F.round(measure.cast("double")), F.lit(1.0))
    return {
        "id": id_of(docs),
        "xx": text_hash(docs),
        "k": _source_key(column_or_null(docs, "source", "string")),
        "m": F.greatest(F.lit(1), F.least(F.lit(MEASURES), m)).cast("long"),
        "size": size,
        "u": random_unit(docs["doc_id"], seed),
    }


def _wanted(classes: DataFrame, cap: int) -> DataFrame:
    """``k, m, certain, p, need``: copies of a document of measure m, and the words of its source that are left to the sample.

    ``classes`` holds ``k, m, words, target``, one row per source and measure.  The largest
    measures reach the cap first; the level is that of the smallest number of them for
    which the next stays below it.
    """
    by_m = Window.partitionBy("k").orderBy(F.col("m").desc())
    above, rest = by_m.rowsBetween(Window.unboundedPreceding, -1), by_m.rowsBetween(0, Window.unboundedFollowing)
    capped = F.coalesce(F.sum("words").over(above), F.lit(0)).cast("double")
    open_ = F.sum(F.col("words") * F.col("m")).over(rest).cast("double")
    c = classes.withColumn("level", F.when(open_ > 0, (F.col("target") - float(cap) * capped) / open_))
    fits = F.when(F.col("level") * F.col("m") <= float(cap), F.struct((-F.col("m")).alias("place"), "level"))
    level = F.min(fits).over(Window.partitionBy("k"))["level"]
    # without a level that fits all are at the cap
    e = F.greatest(F.lit(0.0), F.least(F.lit(float(cap)), F.coalesce(level * F.col("m"), F.lit(float(cap)))))
    c = c.withColumn("e", F.when(F.col("target") > 0, e).otherwise(F.lit(0.0)))
    c = c.withColumn("certain", F.floor("e").cast("long")).withColumn("p", F.col("e") - F.floor("e"))
    sure = F.sum(F.col("certain") * F.col("words")).over(Window.partitionBy("k"))
    return c.select("k", "m", "certain", "p", (F.col("target") - sure).alias("need"))


def _placed(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Rows with their class's columns and their rank ``z`` in (0, 1), which sorts as the ratio of odds does; none where there is no chance."""
    j = rows.join(classes, ["k", "m"])
    ours, theirs = F.col("u") * (1 - F.col("p")), F.col("p") * (1 - F.col("u"))
    return j.withColumn("z", F.when((F.col("p") > 0) & (F.col("size") > 0), ours / (ours + theirs)))


def _bucket(z: Column, level: int) -> Column:
    """Bucket of a rank at a level: powers of two of ``z``, so that buckets nest."""
    return F.least(F.floor(z * float(BUCKETS ** (level + 1))), F.lit(BUCKETS ** (level + 1) - 1)).cast("long")


_PLACE = ("z", "id", "xx")


def _edges(ranked: DataFrame, needs: DataFrame) -> DataFrame:
    """``k, low, high, before``: for each source the stretch of ranks in which its need falls, and the words below it."""
    edge = needs.select("k", "need", F.lit(0.0).alias("low"), F.lit(1.0).alias("high"), F.lit(0).cast("long").alias("before"), F.lit(SORTED + 1).cast("long").alias("n"))
    done = []
    for level in range(LEVELS):
        inside = ranked.join(checked_broadcast(edge), "k").where("z >= low and (z < high or high = 1)")
        sums = inside.groupBy("k", _bucket(F.col("z"), level).alias("b"), "need", "before").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("docs"))
        # at most as many rows for a source as there are buckets
        upto = Window.partitionBy("k").orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
        sums = sums.withColumn("upto", F.col("before") + F.sum("words").over(upto))
        over = F.when(F.col("upto") > F.col("need"), F.struct("b", (F.col("upto") - F.col("words")).alias("before"), "docs"))
        found = sums.groupBy("k", "need").agg(F.min(over).alias("e"), F.max("upto").alias("all_words"))
        width = float(BUCKETS ** -(level + 1))
        found = cut(
            found.select(
                "k",
                "need",
                # where everything fits, nothing is left to put in order
                F.coalesce(F.col("e.b") * width, F.lit(2.0)).alias("low"),
                F.coalesce(F.when(F.col("e.b") == BUCKETS ** (level + 1) - 1, F.lit(1.0)).otherwise((F.col("e.b") + 1) * width), F.lit(2.0)).alias("high"),
                F.coalesce("e.before", "all_words").alias("before"),
                F.coalesce("e.docs", F.lit(0)).alias("n"),
            ),
            "edge",
        )
        settled = found if level + 1 == LEVELS else found.where(F.col("n") <= SORTED)
        done.append(settled)
        edge = cut(found.where(F.col("n") > SORTED), "open")
        if edge.isEmpty():
            break
    return reduce(DataFrame.union, done).select("k", "low", "high", "before")


def _plan(docs: DataFrame, weights: tuple[int, ...], share: float, cap: int, seed: int, measure: Column | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows without their texts, sources with their targets, and the table by source and measure that decides over each document."""
    rows = docs.select(column_or_null(docs, "source", "string").alias("source"), *(c.alias(n) for n, c in _of_row(docs, seed, measure).items()))
    rows = cut(rows, "sizes")
    sources = source_targets(rows.select("source", "size"), weights, share, cap)
    sources = cut(sources.select(_source_key(F.col("source")).alias("k"), "source_size", "target"), "targets")
    classes = rows.groupBy("k", "m").agg(F.sum("size").alias("words")).join(checked_broadcast(sources), "k")
    classes = cut(_wanted(classes, cap), "classes")
    ranked = _placed(rows.drop("source"), checked_broadcast(classes.drop("need"))).where("z is not null")
    needs = cut(classes.select("k", "need").distinct(), "needs")
    edge = cut(_edges(ranked, needs).join(needs, "k"), "edges")

    # the last stretch is put in order
    place, order = F.struct(*_PLACE), Window.partitionBy("k").orderBy(*_PLACE).rowsBetween(Window.unboundedPreceding, 0)
    inside = ranked.join(checked_broadcast(edge), "k").where("z >= low and (z < high or high = 1)")
    inside = inside.withColumn("so_far", F.col("before") + F.sum("size").over(order))
    last = inside.where("so_far <= need").groupBy("k").agg(F.max(place).alias("last"), F.max("so_far").alias("so_far"))
    ends = edge.join(last, "k", "left").select("k", "low", "last", (F.col("need") - F.coalesce("so_far", "before")).alias("gap"))
    ends = cut(ends, "ends")

    # the document that closes the gap, if one comes nearer than none
    near = F.struct(F.abs(F.col("gap") - F.col("size")).alias("off"), place.alias("place"))
    others = ranked.join(checked_broadcast(ends), "k").where(~_sampled() & (F.col("size") < 2 * F.col("gap")))
    closing = others.groupBy("k").agg(F.min(near)["place"].alias("closes"))
    ends = cut(ends.join(closing, "k", "left").select("k", "low", "last", "closes"), "plan")
    return rows, sources, cut(classes.join(checked_broadcast(ends), "k", "left").drop("need"), "plan")


def _sampled() -> Column:
    inside = (F.col("z") < F.col("low")) | (F.struct(*_PLACE) <= F.col("last"))
    return F.coalesce(inside, F.lit(False))


def _copies() -> Column:
    extra = F.col("z").isNotNull() & (_sampled() | F.coalesce(F.struct(*_PLACE) == F.col("closes"), F.lit(False)))
    return F.when(F.col("size") > 0, F.col("certain") + extra.cast("long")).otherwise(F.lit(0)).cast("long")


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    share: float = SHARE,
    cap: int = CAP,
    seed: int = SEED,
    measure: Column | None = None,
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, source, size, source_size, target, measure, wanted, copies, taken``.

    ``measure`` says how much a document is wanted against others of its source; it is
    rounded to a whole number from 1 to ``MEASURES``, and a null one is 1.  ``wanted`` is
    the expected number of copies.  A null source is a source of its own, after all
    others.  A null or empty text has size 0 and takes nothing; sources without words
    have target 0.  Texts of any length count whole.  Equal ranks go by doc_id, a null one
    first, then by a hash of the text; repeated rows are taken alike, which can pass the
    target by as many.  An empty table gives no rows; other columns are ignored.
    """
    rows, sources, plan = _plan(docs, weights, share, cap, seed, measure)
    j = _placed(rows, checked_broadcast(plan)).join(checked_broadcast(sources), "k").withColumn("copies", _copies())
    doc_id = F.when(F.col("id") != NO_ID, F.col("id")).alias("doc_id")
    wanted = (F.col("certain") + F.col("p")).alias("wanted")
    return j.select(doc_id, "source", "size", "source_size", "target", F.col("m").alias("measure"), wanted, "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP, seed: int = SEED, measure: Column | None = None
) -> DataFrame:
    """The rows of ``docs``, as they are, each as often as the mix takes it.

    A row's copies follow from the row and its line of the plan, so texts neither move
    nor are joined by key.  Nulls, empty and long texts, ties, repeated rows and an empty
    table are as in ``mix``; columns of any name pass through unchanged.
    """
    _, _, plan = _plan(docs, weights, share, cap, seed, measure)
    j = _placed(held_rows(docs, **_of_row(docs, seed, measure)), checked_broadcast(plan)).withColumn("copies", _copies())
    return released(j.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))))
