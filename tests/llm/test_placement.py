"""Sharding, mixing, packing and the pipeline."""

import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from coppice.llm import mixing, packing, sharding

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
TABLES = "/root/testdata/sf0.001"


def n_words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


# ---------------------------------------------------------------- sharding


def check_shards(df, rows, leaves):
    got = sharding.shard(df, leaves=leaves).collect()
    assert len(got) == len(rows)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert set(slots) <= set(range(leaves))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    data = {i: (t or "").encode() for i, t, *_ in rows if i is not None}
    where = defaultdict(set)
    for r in got:
        if r.doc_id is not None:
            assert r.size == len(data[r.doc_id]) + 1 and r.text_crc32 == zlib.crc32(data[r.doc_id])
            where[data[r.doc_id]].add(r.shard)
    assert all(len(s) == 1 for s in where.values())
    return got


def test_shards_hold_groups_and_slots(docs, rows):
    check_shards(docs, rows, 8)


@pytest.mark.parametrize("leaves", [1, 3, 8])
def test_shards_are_near_equal(spark, leaves):
    rows = [(i, "x" * (i * 37 % 91 + 10) + str(i)) for i in range(800)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sizes = defaultdict(int)
    for r in check_shards(df, rows, leaves):
        sizes[r.shard] += r.size
    assert len(sizes) == leaves
    assert max(sizes.values()) - min(sizes.values()) < 0.05 * sum(sizes.values()) / leaves


def test_shards_by_target_bytes(spark):
    df = spark.range(600).select(F.col("id").alias("doc_id"), F.format_string("text number %d of all", F.col("id")).alias("text"))
    total = df.select(F.sum(F.octet_length("text") + 1)).first()[0]
    assert sharding.shard(df, target_bytes=total // 4).select("shard").distinct().count() == 4


def brute_tree(points, leaves, first=0):
    """Shards of points ``(w, keys, name)`` by sorting whole nodes."""
    if leaves == 1 or not points:
        return {name: first for *_, name in points}
    w = np.array([p[0] for p in points])
    x = np.array([p[1] for p in points], float) / 2**52
    mean = (w[:, None] * x).sum(0) / w.sum()
    dim = int(((w[:, None] * x * x).sum(0) / w.sum() - mean**2).argmax())
    points = sorted(points, key=lambda p: p[1][dim])
    half = leaves // 2
    wanted = w.sum() * half / leaves
    below, left = 0.0, 0
    while below + points[left][0] < wanted:
        below += points[left][0]
        left += 1
    left += below + points[left][0] - wanted < wanted - below
    return brute_tree(points[:left], half, first) | brute_tree(points[left:], leaves - half, first + half)


@pytest.mark.parametrize("leaves", [2, 7, 40])
def test_splits_as_by_brute_force(docs, leaves, monkeypatch):
    """Searched to the last bit, every split is the weighted median of the widest dimension."""
    monkeypatch.setattr(sharding, "FINE", 0.0)
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("crc"), F.xxhash64(text).alias("h"), "lang", "source")
    points = sharding._points(rows).cache()
    want = brute_tree([(r.w, tuple(r[d] for d in sharding.DIMENSIONS), r.h) for r in points.collect()], leaves)
    assert {r.h: r["shard"] for r in sharding._shards_of(points, leaves).collect()} == want


def test_ranks_tell_long_and_foreign_names_apart(spark):
    names = ["prefix-the-same-a", "prefix-the-same-b", "Ωmega", "日本", "日本語", None, ""]
    groups = spark.createDataFrame([("en" if i % 2 else None, n) for i, n in enumerate(names)], "lang string, source string")
    groups = groups.select(sharding._named(F.col("lang")).alias("lang"), sharding._named(F.col("source")).alias("source"))
    got = sorted((r["at"], r["dim"], r["value"]) for r in sharding._ranks(groups).collect())
    assert [v for _, d, v in got if d == "source"] == ["n", "s", "sprefix-the-same-a", "sprefix-the-same-b", "sΩmega", "s日本", "s日本語"]
    assert [a for a, *_ in got] == list(range(1, 10))


def test_sharding_of_long_texts(spark):
    rows = [(i, "x" * (1_500_000 + i)) for i in range(4)]
    got = {r.size: r["shard"] for r in sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), leaves=4).collect()}
    assert sorted(got) == [1_500_001 + i for i in range(4)] and sorted(got.values()) == [0, 1, 2, 3]


def test_sharding_edge_cases(empty, clashing, docs, spark):
    assert sharding.shard(empty, leaves=8).count() == 0
    columns = ["doc_id", "size", "shard"]
    assert sorted(map(repr, sharding.shard(clashing, leaves=8).select(columns).collect())) == sorted(map(repr, sharding.shard(docs, leaves=8).select(columns).collect()))
    same = spark.createDataFrame([(i, "same") for i in range(50)], "doc_id long, text string")
    assert sharding.shard(same, leaves=8).select("shard").distinct().count() == 1


# ---------------------------------------------------------------- mixing


def fill(sizes, weights, total):
    """Targets by the words of the contract: reshare what is above twice a source's size until none is."""
    target, fixed = {}, set()
    while True:
        free = [s for s in sizes if s not in fixed]
        left = total - sum(2 * sizes[s] for s in fixed)
        target = {s: 2.0 * sizes[s] for s in fixed} | {s: left * weights[s] / sum(weights[x] for x in free) for s in free}
        over = [s for s in free if target[s] > 2 * sizes[s]]
        if not over:
            return target
        fixed |= set(over)


def test_mix_meets_its_targets(docs, rows):
    got = mixing.mix(docs).collect()
    sizes, longest = defaultdict(int), defaultdict(int)
    for _, t, _, s, _ in rows:
        sizes[s] += n_words(t)
        longest[s] = max(longest[s], n_words(t))
    order = sorted(sizes, key=lambda s: (s is None, s))
    target = fill(sizes, {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}, 1.5 * sum(sizes.values()))
    taken = defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(target[r.source])
        assert r.taken in (0, r.size, 2 * r.size)
        taken[r.source] += r.taken
    for s in sizes:
        assert abs(taken[s] - target[s]) <= longest[s]
    assert sorted(map(repr, mixing.mix(docs).collect())) == sorted(map(repr, got))


def test_mix_is_near_its_targets_on_many_documents(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 97).cast("int")).alias("text"), F.concat(F.lit("s"), F.col("id") % 5).alias("source"))
    off = mixing.mix(df).groupBy("source").agg((F.sum("taken") - F.first("target")).alias("off")).collect()
    assert all(abs(r.off) <= 2 for r in off)


def brute_wanted(sizes, measures, target, cap=2.0):
    """Copies wanted of each document, by bisection of the level."""
    low, high = 0.0, cap
    for _ in range(200):
        at = (low + high) / 2
        low, high = (at, high) if sum(s * min(cap, at * m) for s, m in zip(sizes, measures)) < target else (low, at)
    return [min(cap, high * m) for m in measures]


def test_copies_wanted_follow_the_measure(docs):
    by_source = defaultdict(list)
    for r in mixing.mix(docs).collect():
        by_source[r.source].append(r)
    for rows in by_source.values():
        assert [r.measure for r in rows] == [max(1, r.size.bit_length()) for r in rows]
        want = brute_wanted([r.size for r in rows], [r.measure for r in rows], rows[0].target)
        assert [r.wanted for r in rows] == pytest.approx(want, abs=1e-6)
        assert all(int(r.wanted) <= r.copies <= int(r.wanted) + (r.wanted % 1 > 0) for r in rows if r.size)


def test_inclusion_follows_the_odds_of_each_document(spark):
    """Over many seeds a document is taken about as often as it is wanted, the measures of one source far apart."""
    df = spark.range(60).select(
        F.col("id").alias("doc_id"), F.lit("one two three four").alias("text"), F.lit("a").alias("source"), F.element_at(F.array(F.lit(1), F.lit(3), F.lit(9)), (F.col("id") % 3 + 1).cast("int")).alias("w")
    )
    df = df.unionByName(spark.range(100, 400).select(F.col("id").alias("doc_id"), F.lit("x y z").alias("text"), F.lit("b").alias("source"), F.lit(1).alias("w"))).cache()
    n, hits, wanted = 10, defaultdict(float), {}
    for seed in range(n):
        for r in mixing.mix(df, weights=(1, 12), share=0.9, seed=seed, measure=F.col("w")).where("source = 'a'").collect():
            hits[r.measure] += r.copies / (20 * n)
            wanted[r.measure] = r.wanted
    assert sorted(wanted) == [1, 3, 9] and wanted[9] == pytest.approx(9 * wanted[1]) and 0.2 < wanted[9] % 1 < 0.9
    for m in wanted:
        assert hits[m] == pytest.approx(wanted[m], abs=0.1)


def test_preferred_documents_come_first(spark):
    df = spark.range(400).select(F.col("id").alias("doc_id"), F.lit("a b c d e").alias("text"), F.lit("s").alias("source"), F.when(F.col("id") < 100, 50.0).otherwise(1.0).alias("w"))
    got = mixing.mix(df, measure=F.col("w"))
    share = {r.liked: r.c for r in got.groupBy((F.col("doc_id") < 100).alias("liked")).agg(F.avg("copies").alias("c")).collect()}
    assert share[True] == 2 and share[False] == pytest.approx(4 / 3, abs=0.01)


def test_buckets_are_cut_again_while_they_are_large(spark, docs, monkeypatch):
    whole = sorted(map(repr, mixing.mix(docs).collect()))
    monkeypatch.setattr(mixing, "SORTED", 1)
    monkeypatch.setattr(mixing, "BUCKETS", 2)
    assert sorted(map(repr, mixing.mix(docs).collect())) == whole


def test_targets_of_many_sources(spark, monkeypatch):
    """Numbered and filled in several stretches, targets are those of the contract's words."""
    monkeypatch.setattr(mixing, "STRETCH", 7)
    sizes = {f"host{i * 7919 % 60:02d}.example": (i * i * 31) % 997 for i in range(59)} | {None: 50, "\u65e5\u672c": 40, "": 3}
    df = spark.createDataFrame(list(sizes.items()), "source string, size long")
    for share in (0.1, 0.9, 1.5, 1.99, 2.5):
        got = {r.source: r.target for r in mixing.source_targets(df, (5, 2, 1), share, 2).collect()}
        order = sorted(sizes, key=lambda x: (x is None, x))
        want = fill(sizes, {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}, share * sum(sizes.values())) if share < 2 else {s: 2 * n for s, n in sizes.items()}
        assert got == pytest.approx(want)


def test_mixed_rows_are_the_mix(distinct_docs):
    want = {r.doc_id: r.copies for r in mixing.mix(distinct_docs).collect() if r.copies}
    assert {r["doc_id"]: r["count"] for r in mixing.mixed(distinct_docs).groupBy("doc_id").count().collect()} == want


def test_mix_edge_cases(empty, clashing, docs, spark):
    assert mixing.mix(empty).count() == mixing.mixed(empty).count() == 0
    assert sorted(map(repr, mixing.mix(clashing).collect())) == sorted(map(repr, mixing.mix(docs).collect()))
    wordless = spark.createDataFrame([(1, "", "a"), (2, None, None)], "doc_id long, text string, source string")
    assert [r.taken for r in mixing.mix(wordless).collect()] == [0, 0]
    long = spark.createDataFrame([(1, "word " * 700_000, "a"), (2, "b c", "a")], "doc_id long, text string, source string")
    assert {r.doc_id: r.size for r in mixing.mix(long).collect()} == {1: 700_000, 2: 2}


# ---------------------------------------------------------------- packing


def check_packing(got, expected):
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(expected)
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 2048
    return bins


def brute_pieces(rows):
    tokenizer = Tokenizer.from_file(TOKENIZER)
    out = []
    for i, t in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        for k, s in enumerate(range(0, len(ids), 2048)):
            part = np.array(ids[s : s + 2048], "<u4")
            out.append((-1 if i is None else i, k, s, len(part), zlib.crc32(part.tobytes())))
    return out


@pytest.mark.parametrize("partition", [50_000, 20])
def test_pieces_and_places(docs, rows, partition):
    got = packing.pack(docs, TOKENIZER, partition=partition).collect()
    expected = brute_pieces([r[:2] for r in rows])
    bins = check_packing(got, expected)
    bound = packing.lower_bound(np.array([x[3] for x in expected]), 2048)
    assert len(bins) <= bound + (1 if partition > 1000 else 4)


WORD_IDS = packing.WordIds(TOKENIZER, limit=50)
WHOLE = Tokenizer.from_file(TOKENIZER)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("abzAZ éÉßñ'.,!<|>\n\t\x1c\x85 µªº½ÿŸ×÷ıİſΣς́e9"), st.characters(exclude_categories=["Cs"])), max_size=40))
def test_word_ids_are_the_tokenizers(text):
    assert WORD_IDS.of(text) == np.array(WHOLE.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_special_strings():
    for text in ("a <|endoftext|> b", "x<|startoftext|>y", "it's we've 'tis don't."):
        assert WORD_IDS.of(text) == np.array(WHOLE.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def least_bins(lengths, size):
    best = len(lengths)

    def place(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(lengths):
            best = len(bins)
            return
        for j in range(len(bins)):
            if bins[j] + lengths[i] <= size:
                place(i + 1, [b + lengths[i] if k == j else b for k, b in enumerate(bins)])
        place(i + 1, [*bins, lengths[i]])

    place(0, [])
    return best


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=8))
def test_bound_and_packing_hold_the_optimum_between_them(lengths):
    lengths = sorted(lengths, reverse=True)
    where, offsets, bins = packing.best_fit_decreasing(lengths, 20)
    best = least_bins(lengths, 20)
    assert packing.lower_bound(np.array(lengths), 20) <= best <= bins
    fill_ = defaultdict(int)
    for n, b, at in zip(lengths, where, offsets):
        assert fill_[b] == at
        fill_[b] += n
    assert max(fill_.values()) <= 20 and len(fill_) == bins


def test_packing_edge_cases(empty, clashing, docs):
    assert packing.pack(empty, TOKENIZER).count() == 0
    columns = ["doc_id", "piece", "length", "ids_crc32"]
    assert sorted(map(repr, packing.pack(clashing, TOKENIZER).select(columns).collect())) == sorted(map(repr, packing.pack(docs, TOKENIZER).select(columns).collect()))


# ---------------------------------------------------------------- pipeline


def test_pipeline_stages(spark, docs):
    """Each stage against what it must do to its own input."""
    import corpus_pipeline
    from test_dedup import FOLD, brute_components, brute_simhash

    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_duplicates", "near_duplicates", "mix_sources", "pack_sequences"]
    given_, stages = docs, dict(corpus_pipeline.STAGES)

    def apply(name, df):
        return stages[name](spark, df, TABLES).cache()

    known = apply("language_id", given_)
    assert known.columns == docs.columns
    from coppice.llm import langid

    said = sorted(repr((r.doc_id, r.rejected)) for r in langid.identify(given_).collect())
    assert known.count() == sum("False" in x for x in said)

    one = apply("exact_duplicates", known)
    texts = defaultdict(list)
    for r in known.collect():
        texts[r.text.translate(FOLD)].append(-1 if r.doc_id is None else r.doc_id)
    assert sorted(r.doc_id for r in one.collect()) == sorted(max(ids) for ids in texts.values())

    near = apply("near_duplicates", one)
    parts = brute_components([(r.doc_id, brute_simhash(r.text)) for r in one.collect()])
    assert sorted(r.doc_id for r in near.collect()) == sorted({c for *_, c in parts})

    mix = apply("mix_sources", near)
    want = {r.doc_id: r.copies for r in mixing.mix(near).collect() if r.copies}
    assert {r["doc_id"]: r["count"] for r in mix.groupBy("doc_id").count().collect()} == want

    packed = apply("pack_sequences", mix).collect()
    check_packing(packed, brute_pieces([(r.doc_id, r.text) for r in mix.collect()]))


def test_pipeline_on_empty_and_clashing_tables(spark, empty, clashing, docs):
    import corpus_pipeline

    given_, odd, none = docs, clashing, empty
    for name, stage in corpus_pipeline.STAGES[:-1]:
        given_, odd, none = (stage(spark, x, TABLES).cache() for x in (given_, odd, none))
        assert none.count() == 0 and none.columns == empty.columns, name
        assert odd.columns == clashing.columns, name
        assert sorted(map(repr, odd.select(docs.columns).collect())) == sorted(map(repr, given_.collect())), name
        extra = [c for c in clashing.columns if c not in docs.columns and c != "odd name`"]
        assert {r[0] for c in extra for r in odd.select(f"`{c}`").distinct().collect()} == {"clash", "dotted"}, name
    name, pack = corpus_pipeline.STAGES[-1]
    assert pack(spark, none, TABLES).count() == 0
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(repr, pack(spark, odd, TABLES).select(columns).collect())) == sorted(map(repr, pack(spark, given_, TABLES).select(columns).collect()))


def test_queries_agree_with_sql_and_contract(spark):
    import os

    if not os.path.isdir(TABLES):
        pytest.skip("the test tables are not here")
    import duckdb

    from coppice.llm import queries

    c = duckdb.connect()
    for t in ("documents", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{TABLES}/{t}.parquet'")
    for name, sql in queries.ORACLES.items():
        df = queries.QUERIES[name](spark, TABLES)
        columns = sorted(df.columns)
        cursor = c.execute(sql)
        at = [[d[0] for d in cursor.description].index(x) for x in columns]
        assert sorted(repr(tuple(r[x] for x in columns)) for r in df.collect()) == sorted(repr(tuple(r[i] for i in at)) for r in cursor.fetchall()), name
    assert [n.split("_")[0] for n in sorted(queries.QUERIES, key=lambda n: int(n[2:].split("_")[0]))] == [f"op{i}" for i in range(1, 11)]
