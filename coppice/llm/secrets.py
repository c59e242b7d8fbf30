"""Secret scans over an incremental ledger of blobs.

Every row is a version of a path.  Its text is a blob, named by its SHA-256, and the
ledger holds what each rule, at its version, found in each blob.  It is a table in the
store to which scans only ever add.  A scan takes the distinct blobs, leaves out the
pairs of blob and rule version that the ledger holds, reads the text of one row for each
blob that is left, and adds what it finds.  Findings are then joined back to all paths
that hold the blob.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coppice.llm.common import checked_broadcast, cut, small_batches, without
from coppice.plans.fixpoint import scope


@dataclass(frozen=True)
class Rule:
    """A pattern, the test a match must pass, and texts of which one must be there (lower case) for a match."""

    name: str
    version: int
    pattern: str
    passes: Callable[[re.Match], bool] | None = None
    needs: tuple[str, ...] = ()

    @property
    def key(self) -> str:
        return f"{self.name}@{self.version}"


def _long_value(m: re.Match) -> bool:
    return len(m[2]) >= 8


def _long_access(m: re.Match) -> bool:
    return m.end() - m.start() >= 16


def _long_hex(m: re.Match) -> bool:
    return m.end() - m.start() >= 32


# fixed values: the three base kinds
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE = (
    Rule("assign", 1, ASSIGN, _long_value, ("passw", "secret", "token", "api")),
    Rule("access", 1, r"AKIA[A-Z0-9]+", _long_access, ("akia",)),
    Rule("hex", 1, r"[0-9a-f]+", _long_hex),
)
#: What the ledger's rules find beyond the base kinds: published token forms.
MORE = (
    Rule("pem", 1, r"-----BEGIN (?:[A-Z]+ ){0,3}PRIVATE KEY-----", None, ("private key-----",)),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", None, ("eyj",)),
    Rule("github", 1, r"gh[pousr]_[A-Za-z0-9]{36,}", None, ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    Rule("bearer", 1, r"(?i:bearer)\x20+[A-Za-z0-9._~+/-]{20,}=*", None, ("bearer",)),
    Rule("url", 1, r"[a-z][a-z0-9+.-]*://[^\s:/@]{1,256}:[^\s:/@]{3,256}@", None, ("://",)),
)
RULES = BASE + MORE

_HEX = bytes(49 if 48 <= c <= 57 or 97 <= c <= 102 else 48 for c in range(256))
_SPAN = "array<struct<rule:string,start:int,end:int>>"
LEDGER = f"blob string, rules array<string>, spans {_SPAN}"


def find(text: str, rules: tuple[Rule, ...]) -> list[tuple[str, int, int]]:
    """``(rule, start, end)`` in code points, leftmost non-overlapping for each rule."""
    found, low = [], text.lower()
    for rule in rules:
        if rule.needs and not any(x in low for x in rule.needs):
            continue
        if rule.name == "hex" and b"1" * 32 not in text.encode("utf-8", "replace").translate(_HEX):
            continue  # no run of 32, seen without the regular expression
        for m in re.finditer(rule.pattern, text, re.ASCII):
            if rule.passes is None or rule.passes(m):
                found.append((rule.name, m.start(), m.end()))
    order = {rule.name: i for i, rule in enumerate(rules)}
    return sorted(found, key=lambda x: (x[1], order[x[0]], x[2]))


def _scan_batches(rules: tuple[Rule, ...]):
    by_key = {rule.key: rule for rule in rules}
    kind = pa.list_(pa.struct([("rule", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            todo = b.column("rules").to_pylist()
            spans = [
                [{"rule": r, "start": s, "end": e} for r, s, e in find(text.as_py() or "", tuple(by_key[k] for k in keys))]
                for text, keys in zip(b.column("text"), todo)
            ]
            arrays = [b.column("blob"), pa.array(todo, pa.list_(pa.string())), pa.array(spans, kind)]
            yield pa.RecordBatch.from_arrays(arrays, names=["blob", "rules", "spans"])

    return run


def versions(docs: DataFrame) -> DataFrame:
    """``(doc_id, blob)`` of every row; a null text is the empty blob."""
    blob = F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), blob.alias("blob"))


def _unseen(readers: DataFrame, ledger: DataFrame, keys: list[str]) -> tuple[list[str], DataFrame]:
    """The rules that most blobs still lack, and ``(blob, missing)`` of the blobs that lack others; a cut table."""
    wanted = F.array(*(F.lit(k) for k in keys))
    entries = ledger.where(F.arrays_overlap("rules", wanted)).join(readers.select("blob"), "blob", "left_semi")
    seen = entries.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("seen"))
    missing = F.coalesce(F.array_except(wanted, "seen"), wanted)
    state = cut(readers.select("blob").join(seen, "blob", "left").select("blob", missing.alias("missing")), "missing")
    # as many groups as there are sets of rules that were run together
    most = state.groupBy("missing").count().orderBy(F.col("count").desc(), "missing").first()
    common = list(most["missing"]) if most else []
    return common, cut(state.where(F.col("missing") != F.array(*(F.lit(k) for k in common)).cast("array<string>")), "others")


def scan(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, paths: DataFrame | None = None) -> DataFrame:
    """Ledger rows (``LEDGER``) for the pairs of blob and rule version that ``ledger`` lacks.

    ``paths`` is ``versions(docs)``, cut, where the caller has it.  The text of a blob
    is read from its row of smallest doc_id, in place.  Most blobs lack the same rules;
    copies and blobs that lack other rules, or none, are told by joins of their names,
    broadcast if these are few.
    """
    small_batches(docs.sparkSession)
    paths = cut(versions(docs), "versions") if paths is None else paths
    keys = [r.key for r in rules]
    readers = cut(paths.groupBy("blob").agg(F.min("doc_id").alias("reader"), F.count(F.lit(1)).alias("rows")), "readers")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
        F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256).alias("blob"),
    )
    repeated = checked_broadcast(cut(readers.where("rows > 1"), "repeated"))
    copies = paths.join(repeated, "blob").where(~F.col("doc_id").eqNullSafe(F.col("reader")))
    rows = without(rows, cut(copies.select("doc_id", "blob").distinct(), "copies"), ["doc_id", "blob"])
    if ledger is None:
        rows = rows.withColumn("rules", F.array(*(F.lit(k) for k in keys)))
    else:
        common, others = _unseen(readers, ledger, keys)
        others = checked_broadcast(others.withColumnRenamed("missing", "rules"))
        if common:
            most = F.array(*(F.lit(k) for k in common))
            rows = rows.join(others, "blob", "left").withColumn("rules", F.coalesce("rules", most)).where(F.size("rules") > 0)
        else:
            rows = rows.join(others, "blob")
    found = rows.select("blob", "text", "rules").mapInArrow(_scan_batches(rules), LEDGER)
    # a blob is read twice only where a row is repeated with its doc_id
    return found.groupBy("blob", "rules").agg(F.any_value("spans").alias("spans"))


class Ledger:
    """The ledger as a table in the store: scans add rows to it, nothing is ever changed."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def read(self) -> DataFrame:
        """All entries; none where nothing was scanned yet."""
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(self.path)
        if where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
            return self.spark.read.schema(LEDGER).parquet(self.path)
        return self.spark.createDataFrame([], LEDGER)

    def add(self, docs: DataFrame, rules: tuple[Rule, ...] = RULES, paths: DataFrame | None = None) -> int:
        """Scan what is unseen, and append it as one commit; the number of new pairs of blob and rule version.

        A scan that fails on the way adds nothing and can be run again.
        """
        with scope():
            new = cut(scan(docs, self.read(), rules, paths), "scanned")
            pairs = new.agg(F.coalesce(F.sum(F.size("rules")), F.lit(0))).first()[0]
            if pairs:
                new.write.mode("append").parquet(self.path)
        return pairs

    def findings(self, docs: DataFrame, rules: tuple[Rule, ...] = RULES, paths: DataFrame | None = None) -> DataFrame:
        """``findings`` from what the ledger holds."""
        return joined(cut(versions(docs), "versions") if paths is None else paths, self.read(), rules)


def joined(paths: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``doc_id, blob, spans`` of every path, with what these rules, at these versions, found in its blob."""
    version = F.create_map(*(x for r in rules for x in (F.lit(r.name), F.lit(r.key))))
    order = F.create_map(*(x for i, r in enumerate(rules) for x in (F.lit(r.name), F.lit(i))))
    # what an older version of a rule found does not count
    current = F.filter("spans", lambda x: F.coalesce(F.array_contains(F.col("rules"), version[x["rule"]]), F.lit(False)))
    held = ledger.where(F.arrays_overlap("rules", F.array(*(F.lit(r.key) for r in rules)))).select("blob", F.explode(current).alias("s"))
    by_place = F.struct("s.start", order[F.col("s.rule")].alias("o"), F.col("s.end").alias("end"), F.col("s.rule").alias("rule"))
    found = held.groupBy("blob").agg(F.array_sort(F.collect_set(by_place)).alias("spans"))
    found = cut(found.select("blob", F.transform("spans", lambda x: F.struct(x["rule"], x["start"], x["end"])).cast(_SPAN).alias("spans")), "found")
    return paths.join(checked_broadcast(found), "blob", "left").select("doc_id", "blob", F.coalesce("spans", F.array().cast(_SPAN)).alias("spans"))


def findings(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> tuple[DataFrame, DataFrame]:
    """All paths with what was found in their blobs, and the ledger with the new entries.

    The first table has one row per row of ``docs``: ``doc_id, blob, spans``; ``spans``
    is sorted by start, then by the order of ``rules``, and empty where nothing was
    found.  Null and empty texts share the empty blob, texts of any length are scanned
    whole, repeated rows and copies share a scan, null ids are kept as they are, an empty
    table gives no rows, and other columns are ignored.
    """
    paths = cut(versions(docs), "versions")
    new = cut(scan(docs, ledger, rules, paths), "ledger")
    whole = new if ledger is None else ledger.select(*new.columns).unionByName(new)
    return joined(paths, whole, rules), whole


def digest(spans, names: tuple[str, ...]):
    """``kind:start:end`` of the spans of these kinds, comma-joined in their order."""
    some = F.filter(spans, lambda x: x["rule"].isin(*names))
    return F.array_join(F.transform(some, lambda x: F.concat_ws(":", x["rule"], x["start"], x["end"])), ",")


def count_of(spans, name: str):
    return F.size(F.filter(spans, lambda x: x["rule"] == name)).cast("long")
