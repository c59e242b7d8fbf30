"""SimHash near-duplicates with Golay-code fuzzy keys.

A fingerprint of 64 bits is cut into four segments of 16.  If two fingerprints differ
in at most three bits, some segment ``a`` holds no error while the next one, ``b``,
holds at most one: at most one segment can hold two or more errors, and it follows at
most one of the error-free ones.  A key is segment ``a`` as it is, with the index of
the Golay codeword to which segment ``b`` decodes.  The (23, 12) code is perfect, so
every word decodes to one codeword; a word one error away decodes to one of a few
others, and a fingerprint carries those keys as well.  Any two linked fingerprints thus
meet under a key that is the own key of one of them, and every meeting is verified.

Fingerprints are made distinct first.  Within a key the verified links are thinned to a
spanning forest, which keeps every component and never writes all pairs of a group.  A
key that holds more than ``RUN`` fingerprints is dealt out again: the two segments that
are not in the key differ in at most three bits, so of four stretches of them one is
equal, and its bits lengthen the key.  After two such turns 30 bits are fixed beside
the codeword, and what can still share a key is bounded by the other bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from coppice.llm.common import checked_broadcast, cut, cut_of, keep_rows, small_batches
from coppice.operators.structure import connected

MAX_BITS = 3
#: Fixed value: generator polynomial of the (23, 12, 7) Golay code.
GENERATOR = 0b110001110101
#: Runs of a key up to this long are compared pair by pair, longer ones by a spanning search.
SHORT_RUN = 32
#: Comparisons held in memory at once by the spanning search.
BLOCK = 1 << 21
#: Fingerprints of one key that a task compares; a longer run is dealt out by longer keys.
RUN = 1 << 14
#: Times that long runs are dealt out, by stretches of 8 bits and then of 6.
TURNS = 2

_BYTES = np.uint64(0x0101010101010101)


def _remainder(words: np.ndarray) -> np.ndarray:
    """Remainder of 23-bit words by the generator polynomial."""
    r = words.astype(np.uint32).copy()
    for bit in range(22, 10, -1):
        r ^= np.where((r >> bit) & 1 == 1, np.uint32(GENERATOR << (bit - 11)), np.uint32(0))
    return r


def _error_patterns() -> np.ndarray:
    """By remainder, the one error pattern of at most three bits that causes it."""
    table = np.zeros(2048, np.uint32)
    one = [1 << i for i in range(23)]
    errors = [0, *one]
    errors += [a | b for i, a in enumerate(one) for b in one[:i]]
    errors += [a | b | c for i, a in enumerate(one) for j, b in enumerate(one[:i]) for c in one[:j]]
    e = np.array(errors, np.uint32)
    table[_remainder(e)] = e
    return table


def codeword_keys() -> tuple[np.ndarray, np.ndarray]:
    """For each 16-bit segment its own codeword index, and those of all its neighbours (repeats as -1)."""
    errors = _error_patterns()
    words = np.arange(1 << 16, dtype=np.uint32)
    own = ((words ^ errors[_remainder(words)]) >> 11).astype(np.int64)
    near = np.stack([own, *(own[words ^ np.uint32(1 << i)] for i in range(16))], axis=1)
    near[:, 1:] = np.sort(near[:, 1:], axis=1)
    repeated = np.zeros(near.shape, bool)
    repeated[:, 2:] = near[:, 2:] == near[:, 1:-1]
    repeated[:, 1:] |= near[:, 1:] == near[:, :1]
    return own, np.where(repeated, -1, near)


def simhash(texts: list[bytes]) -> np.ndarray:
    """Fingerprints of UTF-8 texts; a text without words has zero."""
    digest, hashes, sizes = xxhash.xxh64_intdigest, [], []
    for text in texts:
        w = text.lower().split()
        if len(w) >= 3:
            h = [digest(b"%b %b %b" % x, 42) for x in zip(w, w[1:], w[2:])]
        else:
            h = [digest(b" ".join(w), 42)] if w else []
        hashes.append(np.array(h, np.uint64))
        sizes.append(len(h))
    n = np.array(sizes, np.int64)
    out = np.zeros(len(texts), np.uint64)
    if not n.sum():
        return out
    h = np.concatenate(hashes)
    full = np.flatnonzero(n)
    ends = np.cumsum(n)
    # pieces of at most 255 hashes: a byte holds each count
    pieces = -(-n[full] // 255)
    first = np.cumsum(pieces) - pieces
    at = np.repeat(ends[full] - n[full] - first * 255, pieces) + np.arange(pieces.sum()) * 255
    for shift in range(8):
        lanes = np.add.reduceat((h >> np.uint64(shift)) & _BYTES, at)
        counts = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), first, axis=0)
        bits = 2 * counts > n[full][:, None]
        for byte in range(8):
            out[full] |= bits[:, byte].astype(np.uint64) << np.uint64(8 * byte + shift)
    return out


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [x.as_buffer().to_pybytes() if x.is_valid else b"" for x in b.column("text")]
        fp = pa.array(simhash(texts).view(np.int64), pa.int64())
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("xx"), fp], names=["doc_id", "xx", "fp"])


def fingerprint_table(docs: DataFrame) -> DataFrame:
    """``(doc_id, xx, fp)`` of every row; ``xx`` identifies its raw text."""
    small_batches(docs.sparkSession)
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("xx"), text.alias("text"))
    return rows.mapInArrow(_fingerprint_batches, "doc_id long, xx long, fp long")


def _key_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    _, near = codeword_keys()
    for b in batches:
        fp = b.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
        segments = [((fp >> np.uint64(16 * s)) & np.uint64(0xFFFF)).astype(np.int64) for s in range(4)]
        for a in range(4):
            codes = near[segments[(a + 1) % 4]]
            row, column = np.nonzero(codes >= 0)
            key = (a << 28) | (segments[a][row] << 12) | codes[row, column]
            arrays = [pa.array(key), pa.array(fp[row].view(np.int64)), pa.array(column == 0)]
            yield pa.RecordBatch.from_arrays(arrays, names=["key", "fp", "own"])


def spanning_links(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the graph that links fingerprints within ``MAX_BITS``, by breadth-first search."""
    rest, sources, targets = fp, [], []
    frontier = fp[:0]
    while len(rest):
        if not len(frontier):
            frontier, rest = rest[:1], rest[1:]
        step = max(1, BLOCK // max(1, len(rest)))
        reached, parent = np.zeros(len(rest), bool), np.zeros(len(rest), fp.dtype)
        for i in range(0, len(frontier), step):
            open_ = np.flatnonzero(~reached)
            if not len(open_):
                break
            block = frontier[i : i + step]
            near = np.bitwise_count(rest[open_][:, None] ^ block[None, :]) <= MAX_BITS
            hit = near.any(axis=1)
            parent[open_[hit]] = block[near[hit].argmax(axis=1)]
            reached[open_[hit]] = True
        sources.append(parent[reached])
        targets.append(rest[reached])
        frontier, rest = rest[reached], rest[~reached]
    empty = fp[:0]
    return np.concatenate([empty, *sources]), np.concatenate([empty, *targets])


def _links_of_runs(key: np.ndarray, fp: np.ndarray, own: np.ndarray) -> pa.RecordBatch | None:
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    lengths = np.diff(np.r_[starts, len(key)])
    sources, targets = [], []
    long = lengths > SHORT_RUN
    for s, n in zip(starts[long], lengths[long]):
        a, b = spanning_links(fp[s : s + n])
        sources.append(a)
        targets.append(b)
    keep = np.repeat(~long & (lengths > 1), lengths)
    key, fp, own = key[keep], fp[keep], own[keep]
    for d in range(1, SHORT_RUN):
        same = key[d:] == key[:-d]
        if not same.any():
            break
        i = np.flatnonzero(same & (own[d:] | own[:-d]))
        i = i[np.bitwise_count(fp[i] ^ fp[i + d]) <= MAX_BITS]
        sources.append(fp[i])
        targets.append(fp[i + d])
    if not sources:
        return None
    a, b = np.concatenate(sources).view(np.int64), np.concatenate(targets).view(np.int64)
    pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
    return _found(pairs[:, 0], pairs[:, 1])


_FOUND = "src long, dst long, key long, fp long"


def _found(src=None, dst=None, key=None, fp=None) -> pa.RecordBatch:
    n = len(src if src is not None else key)
    columns = [pa.nulls(n, pa.int64()) if x is None else pa.array(x, pa.int64()) for x in (src, dst, key, fp)]
    return pa.RecordBatch.from_arrays(columns, names=["src", "dst", "key", "fp"])


def _link_batches(limit: int | None = None):
    """Links within each run of a key, or the run itself as ``key, fp`` where it is longer than ``limit``.

    Rows come sorted by key and runs may span batches; of an open run no more than ``limit`` rows and a batch are held.
    """

    def whole_runs(key: np.ndarray, fp: np.ndarray, own: np.ndarray) -> Iterator[pa.RecordBatch]:
        if limit is not None and len(key) > limit:
            lengths = np.diff(np.r_[np.flatnonzero(np.r_[True, key[1:] != key[:-1]]), len(key)])
            long = np.repeat(lengths > limit, lengths)
            if long.any():
                yield _found(key=key[long], fp=fp[long].view(np.int64))
                key, fp, own = key[~long], fp[~long], own[~long]
        if len(key) and (links := _links_of_runs(key, fp, own)):
            yield links

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        over = None  # the key whose rows are passed on as they come
        for b in batches:
            if not b.num_rows:
                continue
            part = [b.column(0).to_numpy(), b.column(1).to_numpy().view(np.uint64), b.column(2).to_numpy(zero_copy_only=False)]
            if over is not None:
                same = int(np.searchsorted(part[0], over, "right"))
                if same:
                    yield _found(key=part[0][:same], fp=part[1][:same].view(np.int64))
                part = [x[same:] for x in part]
                if not len(part[0]):
                    continue
                over = None
            if held and held[-1][0][-1] == part[0][0] == part[0][-1]:
                held.append([x.copy() for x in part])  # the run goes on through this whole batch
            else:
                last = int(np.searchsorted(part[0], part[0][-1]))
                done = [np.concatenate(x) for x in zip(*held, [x[:last] for x in part])]
                held = [[x[last:].copy() for x in part]]
                yield from whole_runs(*done)
            if limit is not None and sum(len(x[0]) for x in held) > limit:
                key, fp, _ = (np.concatenate(x) for x in zip(*held))
                yield _found(key=key, fp=fp.view(np.int64))
                over, held = int(key[0]), []
        if held:
            yield from whole_runs(*(np.concatenate(x) for x in zip(*held)))

    return run


def _longer_keys(turn: int):
    """Each fingerprint of a run that was put off, once for every stretch of its open bits, with that stretch's bits in the key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key, fp = b.column("key").to_numpy(), b.column("fp").to_numpy().view(np.uint64)
            first = key >> 10 * turn
            # the 32 bits of the two segments that the first key does not name
            at = (16 * (((first >> 28) + 2) % 4)).astype(np.uint64)
            rest = ((fp >> at) | (fp << ((64 - at) % np.uint64(64)))).astype(np.uint64) & np.uint64(0xFFFFFFFF)
            rest, width = rest.astype(np.int64), 8
            if turn:
                # one stretch of eight bits is in the key already
                gone = 8 * (key >> 8 & 3)
                low = (1 << gone) - 1
                rest, width = (rest & low) | (rest >> (gone + 8) << gone), 6
            for part in range(4):
                value = rest >> width * part & ((1 << width) - 1)
                longer = key << (width + 2) | part << width | value
                yield pa.RecordBatch.from_arrays([pa.array(longer), pa.array(fp.view(np.int64)), pa.array(np.ones(len(fp), bool))], names=["key", "fp", "own"])

    return run


def _links_under(keys: DataFrame, limit: int | None) -> DataFrame:
    n = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return keys.repartition(n, "key").sortWithinPartitions("key").mapInArrow(_link_batches(limit), _FOUND)


def fingerprint_links(fps: DataFrame, limit: int = RUN) -> DataFrame:
    """Links ``(src, dst)`` that span every component of the distinct fingerprints ``fp``; from cut tables."""
    keyed, out = fps.select("fp").mapInArrow(_key_batches, "key long, fp long, own boolean"), None
    for turn in range(TURNS + 1):
        found = cut(_links_under(keyed, limit if turn < TURNS else None), "links")
        links = found.where("src is not null").select("src", "dst")
        out = links if out is None else out.union(links)
        long = found.where("fp is not null").select("key", "fp")
        if turn == TURNS or long.isEmpty():
            break
        keyed = long.mapInArrow(_longer_keys(turn), "key long, fp long, own boolean")
    return out


def _labelled(docs: DataFrame) -> DataFrame:
    """``near_duplicates`` with ``root``, the smallest fingerprint of the component: unlike ``component_id`` never null or shared."""
    rows = cut(fingerprint_table(docs), "simhash")
    fps = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "distinct")
    links = cut_of(lambda: fingerprint_links(fps).distinct(), "links").withColumn("graph_id", F.lit(0).cast("long"))
    # few links are joined up in one worker, more of them by contraction over tables
    labels = cut_of(lambda: connected(links), "labels").select(F.col("v").alias("fp"), "component")
    # a fingerprint of one row without a link is a component of its own and needs no partner
    classes = fps.join(labels, "fp", "left").where("n > 1 or component is not null").withColumn("component", F.coalesce("component", "fp"))
    classes = cut(classes, "classes")
    least = classes.groupBy("component").agg(F.min("least").alias("component_id"))
    named = cut(classes.join(least, "component").select("fp", "component_id", F.col("component").alias("named")), "named")
    component = F.when(F.col("named").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id"))
    found = rows.join(checked_broadcast(named), "fp", "left")
    return found.select("doc_id", "xx", "fp", component.alias("component_id"), F.coalesce("named", "fp").alias("root"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, xx, fp, component_id``.

    Words and shingles as in ``simhash``; A-Z are lower-cased.  Texts of fewer than
    three words are one shingle; texts without words, empty and null ones have
    fingerprint zero and link like any other.  ``component_id`` is the smallest doc_id
    reachable; null ids are passed over and it is null where a component has no other.
    Repeated rows share a fingerprint and so a component.  An empty table gives no
    rows; other columns are ignored.
    """
    return _labelled(docs).drop("root")


def representatives(docs: DataFrame) -> DataFrame:
    """Of each component one row of ``docs``, as it is: the one with the smallest doc_id; null ids come last.

    Components are told apart by fingerprints, as rows of several may share an id or have
    none; ties of id go to the smaller text hash, and of repeated rows one stays.  Null,
    empty and wordless texts are one component; texts of any length are read whole; an
    empty table stays empty, and columns of any name pass through unchanged.
    """
    found = _labelled(docs).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    # of rows with one doc_id in one component a single one stays
    found = cut(found.select("doc_id", "xx", "root", "kept"), "found")
    one = found.where("kept").groupBy("root").agg(F.min("xx").alias("one"), F.count(F.lit(1)).alias("n")).where("n > 1")
    one = cut(one.select("root", "one"), "repeated")
    if one.limit(1).count():
        found = found.join(one, "root", "left")
        repeat = F.row_number().over(Window.partitionBy("root", "doc_id", "xx").orderBy("xx"))
        found = found.withColumn("kept", F.col("kept") & (F.col("one").isNull() | ((F.col("xx") == F.col("one")) & (repeat == 1))))
        found = cut(found, "found")
    return keep_rows(docs, found)
