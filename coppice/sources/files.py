"""Reading and writing graph files, result files and solver logs.

Graphs are read line by line, so a large file is split among tasks; where a line's number
counts (METIS), lines are put in order by their place in the file.  Logs are read whole.
"""

from __future__ import annotations

import csv
import io
import tarfile
import zipfile
from collections.abc import Iterator
from typing import IO

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from coppice.operators import analytics as A
from coppice.plans.fixpoint import cut

# fixed values: extensions of graph files; files without one count too
GRAPH_GLOB = "{*.txt,*.gr,*.edges,*.edgelist,*.el,*.graph,*.gz,[!.]*}"
#: Characters of an archive's member that are held and sent on at once.
MEMBER_CHARS = 8 << 20


def _lines(spark: SparkSession, path: str) -> DataFrame:
    text = spark.read.option("recursiveFileLookup", "true").text(path)
    return text.select(F.col("_metadata.file_path").alias("path"), F.trim("value").alias("line"))


def _parsed(lines: DataFrame) -> DataFrame:
    """``path, src, dst``: the first two integers of data lines, from a 0 base.

    A DIMACS or PACE problem line (``p dfvs``, ``.gr``) means base 1, a format line
    (``# format: edge_list``) base 0; without either, ids shift if the least is exactly 1.
    """
    number = r"^(\d+)[\s,]+(\d+)(?:[\s,]+\S+)*$"
    data = lines.where(F.col("line").rlike(number))
    pairs = data.select("path", F.regexp_extract("line", number, 1).cast("long").alias("src"), F.regexp_extract("line", number, 2).cast("long").alias("dst"))
    said = lines.where(F.col("line").rlike(r"^(p\s|#\s*format)")).groupBy("path").agg(
        F.bool_or(F.col("line").rlike(r"^#\s*format\s*:\s*edge_list")).alias("zero"),
        F.bool_or(F.col("line").rlike(r"^p\s+(dfvs|fvs|sp|col)\s")).alias("one"),
    )
    least = pairs.groupBy("path").agg(F.min(F.least("src", "dst")).alias("least"))
    base = least.join(said, "path", "left").select(
        "path",
        F.when(F.coalesce("zero", F.lit(False)), 0).when(F.coalesce("one", F.lit(False)) | F.col("path").endswith(".gr"), 1).otherwise((F.col("least") == 1).cast("int")).alias("base"),
    )
    return pairs.join(base, "path").select("path", (F.col("src") - F.col("base")).alias("src"), (F.col("dst") - F.col("base")).alias("dst"))


def read_edge_lists(spark: SparkSession, path: str) -> DataFrame:
    """``path, src, dst`` from edge lists, DIMACS or PACE files, gzipped or not; a third column is ignored."""
    return _parsed(_lines(spark, path))


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """``path, n, m, directed`` as the files say; ``n`` is raised to the largest id."""
    lines = _lines(spark, path)
    p = r"^p\s+\S+\s+(\d+)\s+(\d+)"
    head = lines.groupBy("path").agg(
        F.max(F.when(F.col("line").rlike(p), F.regexp_extract("line", p, 1).cast("long"))).alias("n"),
        F.max(F.when(F.col("line").rlike(p), F.regexp_extract("line", p, 2).cast("long"))).alias("m"),
        F.max(F.when(F.col("line").rlike(r"^#\s*directed\s*:"), F.col("line").rlike(r":\s*1$"))).alias("directed"),
    )
    ids = _parsed(lines).groupBy("path").agg((F.max(F.greatest("src", "dst")) + 1).alias("ids"), F.count(F.lit(1)).alias("edges"))
    return head.join(ids, "path", "left").select("path", F.greatest("n", "ids").alias("n"), F.coalesce("m", "edges").alias("m"), "directed")


def _numbered(spark: SparkSession, path: str) -> DataFrame:
    """``path, line, at``: lines with what puts those of one file in order, however the file is split among tasks."""
    text = spark.read.option("recursiveFileLookup", "true").text(path)
    at = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    return text.select(F.col("_metadata.file_path").alias("path"), F.trim("value").alias("line"), at.alias("at"))


def _adjacency(lines: DataFrame) -> DataFrame:
    """``path, src, dst``: line i after the header lists vertex i's successors, from 1.

    Comment lines do not count, blank lines do: they are vertices without successors.
    """
    kept = lines.where(~F.col("line").rlike(r"^[%#]"))
    rows = kept.withColumn("v", F.row_number().over(Window.partitionBy("path").orderBy("at")) - 1).where("v > 0")
    near = rows.select("path", (F.col("v") - 1).cast("long").alias("src"), F.explode(F.filter(F.split("line", r"\s+"), lambda x: x != "")).alias("dst"))
    return near.select("path", "src", (F.col("dst").cast("long") - 1).alias("dst"))


def read_metis(spark: SparkSession, path: str) -> DataFrame:
    """``path, src, dst`` from adjacency files; see ``_adjacency``."""
    return _adjacency(_numbered(spark, path))


def read_graphs(spark: SparkSession, path: str) -> DataFrame:
    """``path, src, dst`` from files of any of the formats, told by the first line that is no comment.

    Three numbers, two of them positive and the last 0 or 1, head an adjacency file; all
    else, and all that says ``# format: edge_list``, is an edge list.
    """
    lines = _numbered(spark, path)
    data = lines.where((F.col("line") != "") & ~F.col("line").rlike(r"^([#%]|c(\s|$))"))
    first = data.groupBy("path").agg(F.min(F.struct("at", "line"))["line"].alias("first"))
    said = lines.where(F.col("line").rlike(r"^#\s*format\s*:\s*edge_list")).select("path").distinct()
    adjacency = first.where(F.col("first").rlike(r"^[1-9]\d*\s+[1-9]\d*\s+[01]$")).select("path").join(said, "path", "left_anti")
    adjacency = cut(adjacency, "adjacency")
    one = _adjacency(lines.join(adjacency, "path", "left_semi"))
    return one.unionByName(_parsed(lines.drop("at").join(adjacency, "path", "left_anti")))


def _members(data: bytes) -> Iterator[tuple[str, IO[bytes]]]:
    if zipfile.is_zipfile(io.BytesIO(data)):
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            for i in z.infolist():
                if not i.is_dir():
                    yield i.filename, z.open(i)
    else:
        with tarfile.open(fileobj=io.BytesIO(data)) as t:
            yield from ((m.name, t.extractfile(m)) for m in t if m.isfile())


def _line_blocks(member: IO[bytes]) -> Iterator[list[str]]:
    """A member's lines in blocks of about ``MEMBER_CHARS``, so that its size does not matter; one line is held whole."""
    lines, held = [], 0
    with io.TextIOWrapper(member, "utf-8", "replace") as text:
        for long in text:
            lines += [x.strip() for x in long.splitlines()]
            held += len(long)
            if held >= MEMBER_CHARS:
                yield lines
                lines, held = [], 0
    if lines:
        yield lines


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """``path, src, dst`` from zip and tar archives of edge lists; a path is ``archive!member``.

    Members are unpacked as streams, whatever their size.  The archive itself is a row:
    Spark raises an error where its packed bytes are over ``spark.sql.sources.binaryFile.maxLength``.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"]):
                for name, member in _members(content):
                    for lines in _line_blocks(member):
                        yield pd.DataFrame({"path": f"{path}!{name}", "line": lines})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return _parsed(files.mapInPandas(run, "path string, line string"))


def find_graph_files(spark: SparkSession, path: str) -> DataFrame:
    """``path, file, size`` of graph files at any depth."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", GRAPH_GLOB).load(path)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("size"))


def bucket_columns(df: DataFrame) -> DataFrame:
    """``family, track, category, file`` from paths ``.../family/track/category/file``."""
    parts = F.split("path", "/")
    return df.withColumns({name: F.element_at(parts, -4 + i) for i, name in enumerate(("family", "track", "category", "file"))})


def write_edge_lists(edges: DataFrame, path: str, directed: bool, n: DataFrame | None = None) -> None:
    """One text file for each ``graph_id``: format lines, ``p edge N M``, then sorted pairs from 0."""
    e = edges.select("graph_id", "src", "dst").distinct()
    sizes = e.groupBy("graph_id").agg((F.max(F.greatest("src", "dst")) + 1).alias("ids"), F.count(F.lit(1)).alias("m"))
    if n is not None:
        sizes = sizes.join(n, "graph_id", "left").withColumn("ids", F.greatest("ids", "n"))
    head = F.concat(F.lit(f"# format: edge_list_v1\n# directed: {int(directed)}\np edge "), F.col("ids"), F.lit(" "), F.col("m"))
    first = sizes.select("graph_id", F.lit(-1).cast("long").alias("src"), F.lit(-1).cast("long").alias("dst"), head.alias("value"))
    body = e.select("graph_id", "src", "dst", F.concat_ws(" ", "src", "dst").alias("value"))
    rows = first.unionByName(body).repartition("graph_id").sortWithinPartitions("graph_id", "src", "dst")
    rows.select("graph_id", "value").write.mode("overwrite").partitionBy("graph_id").text(path)


# ---------------------------------------------------------------- results

# fixed values: column names that mean the same, in order of preference
ALIASES = {
    "instance": ("instance", "file", "Instance", "FILE"),
    "fvs_size": ("fvs_size", "FVS_size", "fvs-size"),
    "n": ("nodes_n", "n", "nodes", "vertices", "num_vertices", "node_count"),
    "runtime": ("time_seconds", "runtime", "time", "time_s", "time_ms", "ms"),
    "status": ("status", "validity", "valid", "is_valid"),
    "exit_code": ("exit_code", "exitcode", "code"),
}


def read_result_files(spark: SparkSession, path: str) -> DataFrame:
    """Typed rows of CSV files of any width: ``instance, solver, fvs_size, n, runtime_s, valid, status, at``.

    Each file is read by its own header; the solver is the file's name; ``at`` is the
    row's place.  A runtime in a column named for milliseconds is one.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, text in zip(pdf["path"], pdf["value"]):
                reader = csv.DictReader(io.StringIO(text))
                fields = reader.fieldnames or []
                found = {k: next((a for a in names if a in fields), None) for k, names in ALIASES.items()}
                rows = [
                    {"path": path, "at": i, **{k: (row.get(a) if a else None) for k, a in found.items()}, "unit": found["runtime"]}
                    for i, row in enumerate(reader)
                ]
                if rows and found["instance"]:
                    yield pd.DataFrame(rows)[["path", "at", *ALIASES, "unit"]]

    text = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.csv").text(path, wholetext=True)
    schema = "path string, at long, " + ", ".join(f"{k} string" for k in ALIASES) + ", unit string"
    raw = text.select(F.col("_metadata.file_path").alias("path"), "value").mapInPandas(run, schema)
    seconds = A.parse_runtime(F.col("runtime"))
    return raw.select(
        F.element_at(F.split(F.col("instance"), "/"), -1).alias("instance"),
        F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.csv$", "").alias("solver"),
        A.parse_size(F.col("fvs_size")).alias("fvs_size"),
        A.parse_count(F.col("n")).alias("n"),
        F.when(F.col("unit").isin("time_ms", "ms"), seconds / 1000).otherwise(seconds).alias("runtime_s"),
        F.coalesce(A.parse_validity(F.col("status")), F.when(F.col("exit_code").isNotNull(), F.trim("exit_code") == "0")).alias("valid"),
        F.upper(F.trim("status")).alias("status"),
        "at",
    )


RESULT_SCHEMA = (
    "graph_id long, algo string, params string, fvs_size int, runtime_s double, valid boolean, status string, kernel_n int, executed_at timestamp"
)


def write_results_sorted(results: DataFrame, path: str) -> None:
    """One CSV in order of the instances' natural keys, written anew."""
    key = A.natural_key(F.col("instance"))
    results.orderBy(key).coalesce(1).write.mode("overwrite").option("header", "true").csv(path)


def parse_solver_log(spark: SparkSession, path: str) -> DataFrame:
    """``path, file, n, m, fvs_size, runtime_s, valid``: a record starts at each ``File:`` line.

    Lines are numbered, ``File:`` lines counted up to each line, and the values of a
    record gathered by that count; of several results the last one stands.
    """
    text = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    lines = text.select("path", F.posexplode(F.split("value", r"\r?\n")).alias("at", "line"))
    name = r"(?i)\bFile\s*:\s*(\S+)"
    graph = r"(?i)\bGraph\s*:\s*(\d+)\s+vertices\s*,\s*(\d+)\s+directed\s+edges"
    result = r"(?i)\bDFVS\s+size\s*=\s*(\d+)\s*\|\s*Time\s*=\s*([0-9.]+)\s*ms\s*\|\s*(.*)$"
    starts = F.col("line").rlike(name)
    record = F.sum(starts.cast("int")).over(Window.partitionBy("path").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    lines = lines.withColumn("record", record).where("record > 0")
    kept = F.col("line").rlike(result) & ~starts
    words = F.regexp_extract("line", result, 3)
    # "INVALID" holds "VALID": it is looked for first
    valid = F.when(words.rlike("(?i)INVALID|✗"), False).when(words.rlike("(?i)VALID|✓"), True)
    last = F.max(
        F.when(
            kept,
            F.struct(
                "at",
                F.regexp_extract("line", result, 1).cast("long").alias("fvs_size"),
                F.round(F.regexp_extract("line", result, 2).try_cast("double") / 1000, 6).alias("runtime_s"),
                valid.alias("valid"),
            ),
        )
    )
    of_graph = F.col("line").rlike(graph) & ~starts
    out = lines.groupBy("path", "record").agg(
        F.max(F.when(starts, F.regexp_extract("line", name, 1))).alias("file"),
        F.max(F.when(of_graph, F.regexp_extract("line", graph, 1).cast("long"))).alias("n"),
        F.max(F.when(of_graph, F.regexp_extract("line", graph, 2).cast("long"))).alias("m"),
        last.alias("r"),
    )
    return out.where("r is not null").select("path", "file", "n", "m", "r.fvs_size", "r.runtime_s", "r.valid")


def purge(samples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Samples that can be used, and those that cannot (null, NaN or infinite features, odd labels)."""
    from coppice.operators.scoring import valid_samples

    good = valid_samples(samples)
    return good, samples.exceptAll(good)
