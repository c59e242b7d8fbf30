"""Substring, exact and SimHash deduplication against brute force."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from coppice.llm import exact_dedup, simhash, substrings

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# ---------------------------------------------------------------- substrings


def brute_removal(rows, window):
    first = {}
    for i, t in rows:
        w = words(t)
        for a in range(len(w) - window + 1):
            key = tuple(w[a : a + window])
            if i is not None:
                first[key] = min(first.get(key, i), i)
    out = []
    for i, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for a in range(len(w) - window + 1):
            if i is not None and first[tuple(w[a : a + window])] < i:
                gone[a : a + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def removal(df, **kw):
    return sorted((tuple(r)[:4] for r in substrings.repeated_passages(df, **kw).collect()), key=repr)


def test_passages_go_as_by_brute_force(docs, rows):
    assert removal(docs) == brute_removal([r[:2] for r in rows], 50)


@pytest.mark.parametrize("seed", [1, 2])
def test_passages_of_few_words(spark, seed):
    """A tiny vocabulary: windows repeat everywhere, also within documents."""
    r = random.Random(seed)
    rows = [(i, " ".join(r.choice("ab") for _ in range(r.randrange(40)))) for i in range(40)]
    rows += [(100 + i, rows[i][1] + " a b") for i in range(10)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert removal(df, window=8, phrase=4) == brute_removal(rows, 8)


def test_passages_edge_cases(empty, clashing, docs):
    assert removal(empty) == []
    assert removal(clashing) == removal(docs)


def test_automaton_over_numbers_finds_the_same(monkeypatch):
    r = random.Random(3)
    base = [str(r.randrange(9)).encode() for _ in range(200)]
    doc = [b"x"] * 5 + base[20:90] + [b"y"] + base[100:115]
    passages = [(base, 1)]
    strings = substrings.Automaton(passages, 10).covered(doc, 2)
    monkeypatch.setattr(substrings.Automaton, "CHARACTERS", 1)
    numbers = substrings.Automaton(passages, 10)
    assert not numbers.strings
    assert (numbers.covered(doc, 2) == strings).all() and strings.sum() >= 70
    assert not numbers.covered(doc, 1).any()


# ---------------------------------------------------------------- exact


def brute_groups(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[(t or "").translate(FOLD)].append(i)
    out = []
    for t, ids in groups.items():
        known = [i for i in ids if i is not None]
        out += [(i, max(known) if known else None, len(ids), hashlib.sha256(t.encode()).hexdigest()) for i in ids]
    return sorted(out, key=repr)


@pytest.mark.parametrize("chunk", [1 << 20, 100])
def test_equal_texts_as_by_brute_force(docs, rows, chunk):
    got = exact_dedup.exact_duplicates(docs, chunk).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=repr) == brute_groups([r[:2] for r in rows])
    kept = [r for r in got if r.kept]
    assert all(r.doc_id == r.keep_id for r in kept)
    assert len(kept) == len({r.text_sha256 for r in got})


def test_colliding_fingerprints_are_told_apart(docs, rows, monkeypatch):
    """With a useless fingerprint the comparison still finds the same groups."""
    from pyspark.sql import functions as F

    real = exact_dedup.fingerprints
    monkeypatch.setattr(exact_dedup, "fingerprints", lambda d, c: real(d, c).withColumn("fp", F.lit("same")))
    got = exact_dedup.exact_duplicates(docs).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=repr) == brute_groups([r[:2] for r in rows])


def test_exact_edge_cases(empty, clashing, docs):
    assert exact_dedup.exact_duplicates(empty).count() == 0
    columns = ["doc_id", "keep_id", "group_size", "text_sha256"]
    assert sorted(map(repr, exact_dedup.exact_duplicates(clashing).select(columns).collect())) == sorted(map(repr, exact_dedup.exact_duplicates(docs).select(columns).collect()))


@given(st.binary(max_size=60), st.binary(max_size=60))
def test_fingerprints_compose(a, b):
    assert exact_dedup.combine(exact_dedup.chunk_hash(a), exact_dedup.chunk_hash(b)) == exact_dedup.chunk_hash(a + b)


def test_survivors_are_one_row_for_each_text(docs, rows):
    got = exact_dedup.survivors(docs).collect()
    assert len(got) == len({(r[1] or "").translate(FOLD) for r in rows})
    assert got[0].__fields__ == docs.columns


@pytest.mark.parametrize("stage", [exact_dedup.survivors, simhash.representatives])
def test_kept_rows_pass_unchanged(stage, docs, clashing, empty):
    want = stage(docs).collect()
    odd = stage(clashing)
    assert odd.columns == clashing.columns
    assert sorted(map(repr, odd.select(docs.columns).collect())) == sorted(map(repr, want))
    assert {r[0] for r in odd.select("_id").collect()} == {r[0] for r in odd.select("_xx").collect()} == {"clash"}
    assert {r[0] for r in odd.select("`a.b`").collect()} == {"dotted"}
    assert stage(empty).count() == 0


def test_long_texts_are_whole(spark):
    """Texts of several chunks that differ in their last character only."""
    long = "Long tëxt, word by word. " * 120_000
    rows = [(1, long), (2, long.lower()), (3, long + "x"), (4, long[:-1]), (5, "short")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = exact_dedup.exact_duplicates(df).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=repr) == brute_groups(rows)
    assert sorted(r.doc_id for r in simhash.representatives(df).collect()) == sorted({c for *_, c in brute_components([(i, brute_simhash(t)) for i, t in rows])})
    assert removal(df.where("doc_id < 4")) == brute_removal(rows[:3], 50)


# ---------------------------------------------------------------- SimHash


def brute_simhash(text):
    w = words((text or "").translate(FOLD))
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(pairs):
    ids, fps = zip(*pairs)
    f = np.array(fps, np.uint64)
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(f ^ f[i]) <= 3):
            root[find(int(j))] = find(i)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d, fp, least.get(find(i))) for i, (d, fp) in enumerate(pairs)), key=repr)


def test_simhash_as_by_brute_force(docs, rows):
    got = [(r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in simhash.near_duplicates(docs).collect()]
    assert sorted(got, key=repr) == brute_components([(r[0], brute_simhash(r[1])) for r in rows])


def test_simhash_edge_cases(empty, clashing, docs):
    assert simhash.near_duplicates(empty).count() == 0
    assert sorted(map(repr, simhash.near_duplicates(clashing).collect())) == sorted(map(repr, simhash.near_duplicates(docs).collect()))


@settings(max_examples=300, deadline=None)
@given(st.integers(0, 2**64 - 1), st.lists(st.integers(0, 63), max_size=3))
def test_linked_fingerprints_meet_under_a_key(x, flips):
    own, near = simhash.codeword_keys()
    y = x
    for b in flips:
        y ^= 1 << b

    def keys(fp):
        s = [fp >> 16 * i & 0xFFFF for i in range(4)]
        mine = {(a, s[a], int(own[s[(a + 1) % 4]])) for a in range(4)}
        return mine, {(a, s[a], int(c)) for a in range(4) for c in near[s[(a + 1) % 4]] if c >= 0}

    assert keys(x)[0] & keys(y)[1] and keys(y)[0] & keys(x)[1]


def test_long_runs_are_spanned():
    r = np.random.default_rng(5)
    fp = np.unique(r.integers(0, 1 << 14, 900).astype(np.uint64))
    a, b = simhash.spanning_links(fp)
    assert (np.bitwise_count(a ^ b) <= 3).all()
    got = brute_components([(int(x), int(x)) for x in fp])
    parts = {c for *_, c in got}
    assert len(a) == len(fp) - len(parts)


def test_runs_over_batches_are_whole():
    import pyarrow as pa

    key = np.repeat(np.arange(6), [1, 40, 2, 1, 3, 50])
    fp = np.arange(len(key)).astype(np.int64)
    own = np.ones(len(key), bool)

    limit = None

    def links(size):
        batches = [pa.RecordBatch.from_arrays([pa.array(x[i : i + size]) for x in (key, fp, own)], names=["key", "fp", "own"]) for i in range(0, len(key), size)]
        found = [tuple(x.values()) for b in simhash._link_batches(limit)(iter(batches)) for x in b.to_pylist()]
        assert len([x for x in found if x[0] is None]) == len({x for x in found if x[0] is None})
        return sorted({x for x in found if x[0] is None}, key=repr), sorted({x for x in found if x[0] is not None})

    for limit in (None, 39):
        assert links(7) == links(1000) == links(41)
        assert len(links(7)[0]) == (90 if limit else 0)


@pytest.mark.parametrize("seed", [4, 5])
def test_hot_keys_are_dealt_out_without_losing_a_link(spark, seed):
    """Most fingerprints share a segment and its neighbour, so whole runs are put off twice."""
    r = np.random.default_rng(seed)
    low = r.integers(0, 1 << 12, 700).astype(np.uint64) << np.uint64(40 if seed == 4 else 2)
    fp = np.unique(np.concatenate([low, low ^ (np.uint64(1) << r.integers(0, 64, 700).astype(np.uint64)), r.integers(0, 1 << 63, 50).astype(np.uint64)]))
    df = spark.createDataFrame([(int(x),) for x in fp.view(np.int64)], "fp long").repartition(3)
    links = simhash.fingerprint_links(df, limit=30).collect()
    root = {int(x): int(x) for x in fp.view(np.int64)}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        assert ((a ^ b) & (1 << 64) - 1).bit_count() <= 3
        root[find(a)] = find(b)
    want = brute_components([(int(x), int(x)) for x in fp])
    groups = defaultdict(set)
    for x, _, c in want:
        groups[c].add(find(int(np.uint64(x).view(np.int64))))
    assert all(len(g) == 1 for g in groups.values()) and len({min(g) for g in groups.values()}) == len(groups)


def test_representatives_are_one_for_each_component(docs, rows):
    got = simhash.representatives(docs).collect()
    want = {c for *_, c in brute_components([(r[0], brute_simhash(r[1])) for r in rows])}
    assert sorted(r.doc_id for r in got) == sorted(want)


def test_representatives_without_an_id_of_their_own(spark):
    """Unrelated rows with null ids or one reused id are components each; repeats and near copies of them are not."""
    r = random.Random(29)
    texts = [" ".join(f"w{r.randrange(10**6)}" for _ in range(60)) for _ in range(9)]
    rows = [(None, t) for t in texts[:4]] + [(7, t) for t in texts[4:7]] + [(1, texts[7]), (2, texts[8])]
    rows += [(None, texts[0]), (None, texts[1].upper()), (7, texts[4]), (None, texts[7]), (3, texts[5])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [(x.doc_id, x.text.lower()) for x in simhash.representatives(df).collect()]
    want = [(None, t) for t in texts[:4]] + [(7, texts[4]), (3, texts[5]), (7, texts[6]), (1, texts[7]), (2, texts[8])]
    assert sorted(got, key=repr) == sorted(want, key=repr)
