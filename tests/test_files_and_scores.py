"""Readers, writers and the score fixture."""

import gzip
import io
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from coppice.operators import analytics as A
from coppice.sources import files


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def put(folder, name, text):
    (folder / name).write_text(text)
    return str(folder)


@pytest.mark.parametrize(
    "name, text, pairs",
    [
        ("a.txt", "# format: edge_list_v1\n# directed: 1\np edge 4 2\n1 2\n2 3\n", [(1, 2), (2, 3)]),
        ("a.gr", "c hello\np dfvs 3 2\n1 2\n2 3\n", [(0, 1), (1, 2)]),
        ("a.edges", "1 2 0.5\n2 3 7\n", [(0, 1), (1, 2)]),
        ("a.el", "0 2\n2 3\n", [(0, 2), (2, 3)]),
        ("a.csv", "0,2\n2,3\n", [(0, 2), (2, 3)]),
    ],
)
def test_edge_lists(spark, tmp_path, name, text, pairs):
    got = files.read_edge_lists(spark, put(tmp_path, name, text))
    assert rows(got.select("src", "dst")) == pairs


def test_gzip_and_archives(spark, tmp_path):
    (tmp_path / "a").mkdir()
    with gzip.open(tmp_path / "a" / "x.txt.gz", "wt") as f:
        f.write("0 1\n1 2\n")
    assert rows(files.read_edge_lists(spark, str(tmp_path / "a")).select("src", "dst")) == [(0, 1), (1, 2)]
    (tmp_path / "b").mkdir()
    with zipfile.ZipFile(tmp_path / "b" / "x.zip", "w") as z:
        z.writestr("in/e.txt", "0 1\n")
    with tarfile.open(tmp_path / "b" / "y.tar.gz", "w:gz") as t:
        data = b"1 2\n2 1\n"
        info = tarfile.TarInfo("e.txt")
        info.size = len(data)
        t.addfile(info, io.BytesIO(data))
    assert rows(files.read_archives(spark, str(tmp_path / "b")).select("src", "dst")) == [(0, 1), (0, 1), (1, 0)]


@pytest.mark.parametrize("kind", ["zip", "tar"])
def test_archive_members_of_over_a_gigabyte(spark, tmp_path, kind):
    blank, blanks = b" " * ((1 << 20) - 1) + b"\n", (1 << 10) + 1

    class Text(io.RawIOBase):
        """An edge, more than 1 GiB of blank lines, an edge."""

        def __init__(self):
            self.parts = iter([b"0 1\n", *[blank] * blanks, b"1 2"])
            self.left = b""

        def read(self, n):
            while len(self.left) < n and (part := next(self.parts, None)):
                self.left += part
            out, self.left = self.left[:n], self.left[n:]
            return out

    if kind == "zip":
        with zipfile.ZipFile(tmp_path / "x.zip", "w", zipfile.ZIP_DEFLATED, compresslevel=1) as z, z.open("e.txt", "w", force_zip64=True) as f:
            f.writelines(iter(lambda t=Text(): t.read(1 << 20), b""))
    else:
        with tarfile.open(tmp_path / "x.tar.gz", "w:gz", compresslevel=1) as t:
            info = tarfile.TarInfo("e.txt")
            info.size = 4 + len(blank) * blanks + 3
            t.addfile(info, Text())
    assert rows(files.read_archives(spark, str(tmp_path)).select("src", "dst")) == [(0, 1), (1, 2)]


def test_metis_counts_blank_lines(spark, tmp_path):
    put(tmp_path, "g.graph", "% comment\n4 3 0\n2 3\n\n% between\n4\n\n")
    assert rows(files.read_metis(spark, str(tmp_path)).select("src", "dst")) == [(0, 1), (0, 2), (2, 3)]


def test_headers(spark, tmp_path):
    put(tmp_path, "g.txt", "# format: edge_list_v1\n# directed: 1\np edge 9 2\n0 1\n1 2\n")
    assert rows(files.read_headers(spark, str(tmp_path)).select("n", "m", "directed")) == [(9, 2, True)]


def test_round_trip(spark, tmp_path):
    e = spark.createDataFrame([(5, 0, 1), (5, 3, 2), (6, 1, 0)], "graph_id long, src long, dst long")
    files.write_edge_lists(e, str(tmp_path / "out"), directed=True)
    back = files.read_edge_lists(spark, str(tmp_path / "out"))
    got = back.select(F.regexp_extract("path", r"graph_id=(\d+)", 1).cast("long"), "src", "dst")
    assert rows(got) == rows(e)
    assert rows(files.bucket_columns(spark.createDataFrame([("x/und/exact/grid/f.txt",)], "path string")).drop("path")) == [("und", "exact", "grid", "f.txt")]


def test_result_files_of_any_width(spark, tmp_path):
    put(tmp_path, "A.csv", "file,n,m,FVS_size,runtime,validity\ng/i1.gr,10,20,4,1.5,True\ni2,10,20,TIMEOUT,TIMEOUT,TIMEOUT\n")
    put(tmp_path, "B.csv", "instance,nodes_n,time_ms,fvs_size,exit_code\ni1,N/A,250,5.0,0\ni2,8,40,1,3\n")
    got = files.read_result_files(spark, str(tmp_path)).select("instance", "solver", "fvs_size", "n", "runtime_s", "valid")
    assert set(map(tuple, got.collect())) == {
        ("i1.gr", "A", 4, 10, 1.5, True),
        ("i2", "A", None, 10, None, None),
        ("i1", "B", 5, None, 0.25, True),
        ("i2", "B", 1, 8, 0.04, False),
    }


def test_solver_log(spark, tmp_path):
    log = """run
      File: h_001.gr
      Graph: 10 vertices, 20 directed edges
      DFVS size = 4 | Time = 1500 ms | ✓ VALID
      File: h_002.gr
      File: h_003.gr
      Graph: 5 vertices, 6 directed edges
      DFVS size = 2 | Time = 20.5 ms | ✗ INVALID
    """
    got = files.parse_solver_log(spark, put(tmp_path, "score.txt", log))
    assert rows(got.drop("path")) == [("h_001.gr", 10, 20, 4, 1.5, True), ("h_003.gr", 5, 6, 2, 0.0205, False)]


def test_score_fixture(spark):
    data = [
        ("i1", "A", 4, 10, True), ("i1", "B", 5, 10, True), ("i2", "A", 0, 8, True), ("i2", "B", 1, 8, True),
        ("i3", "A", None, 9, None), ("i3", "B", 3, 9, True), ("i4", "A", 2, 7, False), ("i4", "B", 2, 7, True),
    ]
    r = spark.createDataFrame(data, "instance string, solver string, fvs_size long, n long, valid boolean")
    s = A.scores(A.penalised(r))
    assert rows(A.solver_summary(s, r)) == [("A", 76.1905, 3), ("B", 70.0, 4)]


def test_pareto_fixture(spark):
    p = spark.createDataFrame([(1, 5.0), (1, 3.0), (2, 4.0), (3, 2.0), (4, 2.0), (5, 1.0)], "k long, runtime_s double")
    p = p.withColumn("solver", F.lit("a")).withColumn("success", F.lit(True))
    assert rows(A.pareto_front(p).select("k", "runtime_s")) == [(1, 3.0), (3, 2.0), (5, 1.0)]


def test_stream_closes_windows(spark, tmp_path):
    from coppice.streaming import degrees

    data = [("2024-01-01 10:00:00", "a", 1.0), ("2024-01-01 11:00:00", "a", 2.0), ("2024-01-03 10:00:00", "b", 4.0)]
    events = spark.createDataFrame(data, "ts string, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    events.write.parquet(str(tmp_path / "in"))
    stream = degrees.windowed_counts(degrees.event_stream(spark, str(tmp_path / "in"), events.schema))
    degrees.append_results(stream, str(tmp_path / "out"), str(tmp_path / "log")).awaitTermination(60)
    assert rows(spark.read.parquet(str(tmp_path / "out")).select("event_type", "n", "value")) == [("a", 2, 3.0)]


def test_formats_are_told_by_the_first_line(spark, tmp_path):
    from coppice.sources import files

    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "metis.txt").write_text("% comment\n4 3 0\n2 3\n\n4\n1\n")
    (tmp_path / "a" / "pace.gr").write_text("c comment\np dfvs 3 2\n1 2\n2 3\n")
    (tmp_path / "plain.txt").write_text("# c\n0 1\n1 2 7\n")
    (tmp_path / "weights.txt").write_text("# format: edge_list\n5 7 1\n7 0 1\n")
    got = sorted((r["path"].rsplit("/", 1)[1], r["src"], r["dst"]) for r in files.read_graphs(spark, str(tmp_path)).collect())
    want = [("metis.txt", 0, 1), ("metis.txt", 0, 2), ("metis.txt", 2, 3), ("metis.txt", 3, 0), ("pace.gr", 0, 1), ("pace.gr", 1, 2)]
    assert got == want + [("plain.txt", 0, 1), ("plain.txt", 1, 2), ("weights.txt", 5, 7), ("weights.txt", 7, 0)]


def test_adjacency_files_split_among_tasks_stay_in_order(spark, tmp_path):
    from coppice.sources import files

    n = 4000
    (tmp_path / "m.graph").write_text(f"{n} {n} 0\n" + "".join(f"{(i + 1) % n + 1}\n" for i in range(n)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        df = files.read_metis(spark, str(tmp_path))
        assert sorted((r["src"], r["dst"]) for r in df.collect()) == sorted((i, (i + 1) % n) for i in range(n))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_buckets_filled_in_parts_are_the_same(spark):
    from coppice.operators import generate

    for family, track, category in generate.RANGES:
        if track == "exact":
            whole = generate.fill_bucket(spark, family, track, category, 4).collect()
            there = spark.createDataFrame([(0,), (2,)], "idx long")
            part = generate.fill_bucket(spark, family, track, category, 4, there).collect()
            assert sorted(map(tuple, part), key=repr) == sorted((tuple(r) for r in whole if r["idx"] in (1, 3)), key=repr)
            low, high = generate.RANGES[family, track, category][1]
            assert {r["idx"] for r in whole} == {0, 1, 2, 3} and all(r["src"] != r["dst"] and 0 <= r["src"] < r["n"] for r in whole if r["src"] is not None)
    kind, n, edges = generate.build("directed", "heuristic", "dags", 0, 1)
    assert 100 <= n <= 5000 and len(edges) == n - 1
    kind, n, edges = generate.build("undirected", "exact", "grids_trees", 1, 1)
    assert kind == "tree" and len(edges) == n - 1


def test_random_graphs_have_the_chance(spark):
    from coppice.operators import generate

    for directed, pairs in ((True, 400 * 399), (False, 400 * 399 // 2)):
        n = generate.erdos_renyi(spark, 400, 0.1, directed, seed=3).count()
        assert abs(n - 0.1 * pairs) < 5 * (0.09 * pairs) ** 0.5


def test_slices_and_caps(spark):
    from coppice.operators import edges as E
    from coppice.operators import generate

    e = spark.createDataFrame([(0, i, i + 1) for i in range(30)] + [(0, 100, 101)], "graph_id long, src long, dst long")
    part = generate.sliced(e, 10)
    assert part.count() == 9 and E.vertices(part).agg({"v": "max"}).first()[0] == 9
    assert E.vertices(generate.capped(e, E.vertices(e), 5)).count() <= 5
    assert generate.capped(e, E.vertices(e), 50).count() == e.count()


def test_problems_of_samples_are_told(spark):
    from coppice.operators import scoring

    rows = [(1, 0, [1.0, 2.0], 0), (1, 1, [0.0, 1.0], 1), (2, 0, [1.0], 0), (3, 0, [float("nan"), 1.0], 1), (4, 0, [1.0, 1.0], 2), (5, 0, [1.0, 1.0], 1), (5, 0, [1.0, 1.0], 1), (6, 0, None, None)]
    samples = spark.createDataFrame(rows, "graph_id long, v long, f array<double>, y int")
    e = spark.createDataFrame([(1, 0, 1), (2, 0, 0), (4, 0, 7), (9, 1, 2)], "graph_id long, src long, dst long")
    got = sorted(tuple(r) for r in scoring.sample_problems(samples, e, 2).collect())
    assert got == [(2, "shape"), (3, "finite"), (4, "ids"), (4, "label"), (5, "repeat"), (6, "label"), (6, "shape")]


def test_all_buckets_are_filled_once(spark, tmp_path):
    from coppice.operators import generate

    path = str(tmp_path / "graphs")
    assert generate.fill_all(spark, path, {"undirected": 5}, exact_ratio=1.0) == 5
    assert generate.fill_all(spark, path, {"undirected": 5}, exact_ratio=1.0) == 0
    assert generate.fill_all(spark, path, {"undirected": 10}, exact_ratio=1.0) == 5
    t = spark.read.parquet(path)
    assert t.select("family", "track", "category", "idx").distinct().count() == 10
    assert {r[0] for r in t.select("category").distinct().collect()} == set(generate.CATEGORIES["undirected"])
    for family, names in generate.CATEGORIES.items():
        assert set(names) == {c for f, _, c in generate.RANGES if f == family}
