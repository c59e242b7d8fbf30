"""Substring duplicates with sharded Aho-Corasick automata.

A window is ``WINDOW`` consecutive words.  Words covered by a window whose words also
start in a document of smaller id are removed.  Documents are dealt into shards of
bounded text, and each step works on a shard at a time:

1. *Anchors.*  Every window names its minimizer, the phrase of ``PHRASE`` words in it with
   the smallest hash, so equal windows name equal phrases.  Windows that share one make
   a segment.  A phrase found in one document only cannot lie in a repeated window.
2. *Confirmation.*  Where all segments of a repeated phrase are alike, they are repeated as
   a whole.  Where they differ, their windows are compared one by one, by 128-bit hashes
   kept once per shard.  Either way each repeated window gets its owner, the document of
   smallest id that holds it.
3. *Automata.*  A shard gets back the places of its confirmed windows.  Runs with one owner
   are passages; a passage is cut into blocks of half a window, one of which lies in
   every window, and the blocks are compiled into the shard's automaton over word
   numbers.  All documents of the shard stream through it.  Each hit is extended word by
   word along its passage, and stretches of a window or more are removed from documents
   with larger ids than the owner's.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from coppice.llm.common import checked_broadcast, cut, shard_count, small_batches

WINDOW, PHRASE = 50, 16
#: Stored bytes of documents in a shard; their text, words and automaton are in one task's memory.
SHARD_BYTES = 4 << 20
#: Word hashes that a worker remembers.
CACHED_WORDS = 300_000

_LANES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


class _WordHash(dict):
    def __missing__(self, word: bytes) -> bytes:
        if len(self) > CACHED_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_128_digest(word)
        return h


_hash_of = _WordHash()


def _word_hashes(words: list[bytes]) -> np.ndarray:
    """128 bits of each word, as two numbers in a row."""
    return np.frombuffer(b"".join(map(_hash_of.__getitem__, words)), np.uint64).reshape(-1, 2)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


class _Ranges:
    """Hashes of any range of words, from prefix sums modulo 2^64, in two lanes, each over its own half of the words' hashes."""

    def __init__(self, h: np.ndarray):
        self.lanes = []
        for base, h in zip(_LANES, h.T):
            power = np.full(len(h) + 1, base, np.uint64)
            power[0] = 1
            power = np.multiply.accumulate(power)
            inverse = np.full(len(h) + 1, pow(base, -1, 1 << 64), np.uint64)
            inverse[0] = 1
            inverse = np.multiply.accumulate(inverse)
            prefix = np.zeros(len(h) + 1, np.uint64)
            np.cumsum(_mix(h + np.uint64(base)) * power[:-1], out=prefix[1:])
            self.lanes.append((prefix, inverse))

    def of(self, start: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
        return [_mix((prefix[end] - prefix[start]) * inverse[start]) for prefix, inverse in self.lanes]


def _smallest(g: np.ndarray, width: int) -> np.ndarray:
    """Place of the leftmost smallest value in each stretch of ``width``, by doubling."""
    value, place, have = g, np.arange(len(g)), 1
    while have < width:
        step = min(have, width - have)
        left = value[: len(value) - step] <= value[step:]
        value = np.where(left, value[: len(value) - step], value[step:])
        place = np.where(left, place[: len(place) - step], place[step:])
        have += step
    return place


def segments(h: np.ndarray, first: np.ndarray, last: np.ndarray, window: int, phrase: int):
    """Maximal runs of windows with one minimizer: ``(document, start, windows, phrase hash, lane 1, lane 2)``.

    ``h`` holds the words of several documents in a row, ``first`` and ``last`` each
    one's half-open range; a document shorter than a window has none.
    """
    long = np.flatnonzero(last - first >= window)
    empty = np.zeros(0, np.int64)
    if not len(long):
        return (empty,) * 6
    ranges = _Ranges(h)
    at = np.arange(len(h) - phrase + 1)
    g = ranges.of(at, at + phrase)[0]
    place = _smallest(g, window - phrase + 1)
    n = last[long] - first[long] - window + 1
    document = np.repeat(long, n)
    start = np.repeat(first[long] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
    anchor = place[start]
    new = np.r_[True, (anchor[1:] != anchor[:-1]) | (document[1:] != document[:-1])]
    begin = np.flatnonzero(new)
    count = np.diff(np.r_[begin, len(new)])
    s = start[begin]
    return (document[begin], s - first[document[begin]], count, g[anchor[begin]], *ranges.of(s, s + count + window - 1))


def _concatenated(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    parts = [_word_hashes(t.split()) for t in texts]
    n = np.array([len(p) for p in parts], np.int64)
    last = np.cumsum(n)
    return (np.concatenate(parts) if parts else np.zeros((0, 2), np.uint64)), last - n, last


_ANCHORS = "shard int, phrase long, lane1 long, lane2 long, row long, doc_id long, at int, windows int, top long"
#: Segments held before those alike are merged and passed on.
_HELD = 1 << 19


def _once(frame: pd.DataFrame, keys: list[str]) -> pd.DataFrame:
    """Of rows alike within a shard the one of smallest doc_id, with the largest id beside it."""
    frame = frame.sort_values([*keys, "doc_id", "row", "at"], kind="stable")
    new = (frame[keys] != frame[keys].shift()).any(axis=1).to_numpy()
    begin = np.flatnonzero(new)
    kept = frame.iloc[begin].copy()
    kept["top"] = np.maximum.reduceat(frame["top"].to_numpy(), begin) if len(begin) else kept["top"]
    return kept


def _anchor_batches(window: int, phrase: int):
    keys = ["shard", "phrase", "lane1", "lane2"]
    names = [x.split()[0] for x in _ANCHORS.split(", ")]
    kinds = pa.schema([(n, pa.int32() if k == "int" else pa.int64()) for n, k in (x.split() for x in _ANCHORS.split(", "))])

    def told(held: list[pd.DataFrame]) -> pa.RecordBatch:
        frame = _once(pd.concat(held, ignore_index=True), keys)[names]
        return pa.RecordBatch.from_pandas(frame, schema=kinds, preserve_index=False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            texts = [x.as_buffer().to_pybytes() if x.is_valid else b"" for x in b.column("text")]
            document, at, count, anchor, lane1, lane2 = segments(*_concatenated(texts), window, phrase)
            if not len(document):
                continue
            ids = b.column("doc_id").to_numpy(zero_copy_only=False)[document]
            held.append(
                pd.DataFrame(
                    {
                        "shard": b.column("shard").to_numpy()[document],
                        "phrase": anchor.view(np.int64),
                        "lane1": lane1.view(np.int64),
                        "lane2": lane2.view(np.int64),
                        "row": b.column("row").to_numpy()[document],
                        "doc_id": ids,
                        "at": at.astype(np.int32),
                        "windows": count.astype(np.int32),
                        "top": ids,
                    }
                )
            )
            n += len(document)
            if n > _HELD:
                yield told(held)
                held, n = [], 0
        if held:
            yield told(held)

    return run


_WINDOWS = "shard int, lane1 long, lane2 long, row long, doc_id long, at int, top long"


def _window_hashes(window: int):
    def run(docs: pa.Table, wanted: pa.Table) -> pa.Table:
        kinds = pa.schema([(n, pa.int32() if k == "int" else pa.int64()) for n, k in (x.split() for x in _WINDOWS.split(", "))])
        if not wanted.num_rows or not docs.num_rows:
            return kinds.empty_table()
        want = wanted.select(["row", "doc_id", "at", "windows", "top"]).to_pandas().sort_values(["row", "at"])
        # rows repeated with one doc_id share a name and a text
        texts = dict(zip(docs.column("row").to_pylist(), docs.column("text")))
        out = []
        for row, part in want.groupby("row", sort=False):
            ranges = _Ranges(_word_hashes(texts[row].as_buffer().to_pybytes().split()))
            n = part["windows"].to_numpy()
            start = np.repeat(part["at"].to_numpy() - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
            lane1, lane2 = ranges.of(start, start + window)
            out.append(
                pd.DataFrame(
                    {
                        "lane1": lane1.view(np.int64),
                        "lane2": lane2.view(np.int64),
                        "row": row,
                        "doc_id": np.repeat(part["doc_id"].to_numpy(), n),
                        "at": start.astype(np.int32),
                        "top": np.repeat(part["top"].to_numpy(), n),
                    }
                )
            )
        frame = _once(pd.concat(out, ignore_index=True), ["lane1", "lane2"])
        frame["shard"] = docs.column("shard")[0].as_py()
        return pa.Table.from_pandas(frame[[x.name for x in kinds]], schema=kinds, preserve_index=False)

    return run


class Automaton:
    """Blocks of a shard's passages over word numbers; finds what a document shares with them.

    A word of the passages is one character, all other words are a character of their
    own, and the automaton reads documents as strings of these.  Should a shard have more
    words than there are characters, the same automaton is built over tuples of numbers.
    """

    #: Code points that numbers can use, without the surrogates.
    CHARACTERS = 0x110000 - 0x800

    def __init__(self, passages: list[tuple[list[bytes], int]], window: int):
        import ahocorasick

        self.window, self.block = window, window // 2
        number: dict[bytes, int] = {}
        listed = [[number.setdefault(w, len(number) + 1) for w in words] for words, _ in passages]
        self.strings = len(number) < self.CHARACTERS
        self.other = "\0" if self.strings else 0
        self.symbol = {w: chr(i + 0x800 * (i >= 0xD800)) for w, i in number.items()} if self.strings else number
        self.passages: list[tuple] = []
        places: dict = {}
        for p, (words, owner) in enumerate(passages):
            key, ids = self._symbols(words)
            self.passages.append((key, ids, owner))
            for at in range(0, len(ids) - self.block + 1, self.block):
                places.setdefault(key[at : at + self.block], []).append((p, at))
        kind = ahocorasick.KEY_STRING if self.strings else ahocorasick.KEY_SEQUENCE
        self.known = re.compile("[^\0]{%d,}" % self.block)
        self.found = ahocorasick.Automaton(ahocorasick.STORE_ANY, kind)
        for key, held in places.items():
            self.found.add_word(key, held)
        if places:
            self.found.make_automaton()

    def _symbols(self, words: list[bytes]):
        """The words as the automaton reads them, and as an array."""
        get, other = self.symbol.get, self.other
        if self.strings:
            key = "".join([get(w, other) for w in words])
            return key, np.frombuffer(key.encode("utf-32-le"), np.uint32)
        key = tuple([get(w, other) for w in words])
        return key, np.array(key, np.int64)

    def _hits(self, key):
        """Blocks found, with the place of their last word.

        A block has only words of the passages, so the automaton reads the runs of such
        words that are long enough for one, and none of what lies between.
        """
        if not self.strings:
            yield from self.found.iter(key)
            return
        for m in self.known.finditer(key):
            yield from self.found.iter(key, m.start(), m.end())

    def covered(self, words: list[bytes], doc_id: int) -> np.ndarray:
        """Which words lie in a stretch of a window or more that an owner of smaller id has too."""
        out = np.zeros(len(words), bool)
        key, ids = self._symbols(words)
        done: dict[tuple[int, int], int] = {}  # passage and diagonal: where the last stretch ended
        for end, held in self._hits(key):
            start = end - self.block + 1
            for p, at in held:
                theirs, passage, owner = self.passages[p]
                if owner >= doc_id or done.get((p, start - at), -1) > start:
                    continue
                # mostly all of it is alike, which one comparison of slices tells
                back, after = min(start, at), at + self.block
                left = back
                if key[start - back : start] != theirs[at - back : at]:
                    left = int((ids[start - back : start][::-1] == passage[at - back : at][::-1]).argmin())
                right = min(len(ids) - end - 1, len(passage) - after)
                if key[end + 1 : end + 1 + right] != theirs[after : after + right]:
                    right = int((ids[end + 1 : end + 1 + right] == passage[after : after + right]).argmin())
                done[p, start - at] = end + 1 + right
                if left + self.block + right >= self.window:
                    out[start - left : end + 1 + right] = True
        return out


_RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, removed array<struct<start:int,end:int>>"


def _passages(texts: dict[int, list[bytes]], wanted: pa.Table, window: int) -> list[tuple[list[bytes], int]]:
    """Runs of windows that follow each other and have one owner, every window in one run only.

    Copies in a shard name the same windows; all but the first of each are left out, so
    a group of copies weighs no more than one of them.
    """
    want = wanted.select(["row", "at", "windows", "owner"]).to_pandas().sort_values(["owner", "row", "at"])
    n = want["windows"].to_numpy()
    row, owner = np.repeat(want["row"].to_numpy(), n), np.repeat(want["owner"].to_numpy(), n)
    at = np.repeat(want["at"].to_numpy() - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
    lanes = [np.zeros(len(at), np.uint64), np.zeros(len(at), np.uint64)]
    edges = np.flatnonzero(np.r_[True, row[1:] != row[:-1], True])
    for a, b in zip(edges, edges[1:]):
        for lane, h in zip(lanes, _Ranges(_word_hashes(texts[row[a]])).of(at[a:b], at[a:b] + window)):
            lane[a:b] = h
    order = np.lexsort((np.arange(len(at)), *lanes))
    first = np.zeros(len(at), bool)
    first[order[np.r_[True, (lanes[0][order][1:] != lanes[0][order][:-1]) | (lanes[1][order][1:] != lanes[1][order][:-1])]]] = True
    row, owner, at = row[first], owner[first], at[first]
    new = np.r_[True, (row[1:] != row[:-1]) | (owner[1:] != owner[:-1]) | (at[1:] != at[:-1] + 1), True]
    edges = np.flatnonzero(new)
    return [(texts[row[a]][at[a] : at[b - 1] + window], owner[a]) for a, b in zip(edges, edges[1:])]


def _remove(window: int):
    kinds = pa.schema(
        [
            ("doc_id", pa.int64()),
            ("n_words", pa.int64()),
            ("n_removed", pa.int64()),
            ("kept_sha256", pa.string()),
            ("removed", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
        ]
    )

    def run(docs: pa.Table, wanted: pa.Table) -> pa.Table:
        rows = docs.column("row").to_pylist()
        ids = docs.column("doc_id").to_pylist()
        texts = {r: (x.as_buffer().to_pybytes().split() if x.is_valid else []) for r, x in zip(rows, docs.column("text"))}
        automaton = Automaton(_passages(texts, wanted, window), window) if wanted.num_rows and rows else None
        out: list[list] = [[] for _ in range(5)]
        for row, doc in zip(rows, ids):
            words, spans = texts[row], []
            kept, removed = words, 0
            if automaton and doc is not None and len(words) >= window:
                covered = automaton.covered(words, doc)
                if removed := int(covered.sum()):
                    edges = np.flatnonzero(np.diff(np.r_[False, covered, False]))
                    spans = [{"start": int(s), "end": int(e)} for s, e in zip(edges[::2], edges[1::2])]
                    kept = [words[i] for i in np.flatnonzero(~covered)]
            for column, x in zip(out, (doc, len(words), removed, hashlib.sha256(b" ".join(kept)).hexdigest(), spans)):
                column.append(x)
        return pa.Table.from_arrays([pa.array(x, f.type) for x, f in zip(out, kinds)], schema=kinds)

    return run


def _confirmed(rows: DataFrame, parts: int, window: int, phrase: int) -> tuple[DataFrame, DataFrame]:
    """The texts dealt into their shards, and the confirmed windows of each shard: ``shard, row, at, windows, owner``."""
    anchors = cut(rows.where("doc_id is not null").mapInArrow(_anchor_batches(window, phrase), _ANCHORS), "anchors")
    known = anchors.groupBy("phrase").agg(
        F.min("doc_id").alias("owner"),
        F.max("top").alias("last"),
        ((F.min("lane1") == F.max("lane1")) & (F.min("lane2") == F.max("lane2"))).alias("alike"),
    )
    known = cut(known.where("owner < last").select("phrase", "owner", "alike"), "phrases")
    repeated = anchors.join(checked_broadcast(known), "phrase").where("not alike or owner < top")
    repeated = cut(repeated.select("shard", "row", "doc_id", "at", "windows", "top", "owner", "alike"), "repeated")
    whole = repeated.where("alike").select("shard", "row", "at", "windows", "owner")
    unlike = repeated.where("not alike").select("shard", "row", "doc_id", "at", "windows", "top")
    # the texts move once: the two steps that need them in shards read this one exchange
    rows = rows.repartition(parts, "shard")
    hashes = rows.groupBy("shard").cogroup(unlike.groupBy("shard")).applyInArrow(_window_hashes(window), _WINDOWS)
    # a window has one row for each shard that holds it, so no key outgrows the number of shards
    alike = Window.partitionBy("lane1", "lane2")
    single = hashes.withColumn("owner", F.min("doc_id").over(alike)).where("owner < top")
    single = single.select("shard", "row", "at", F.lit(1).alias("windows"), "owner")
    return rows, whole.union(single)


def repeated_passages(docs: DataFrame, window: int = WINDOW, phrase: int = PHRASE, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_words, n_removed, kept_sha256, removed``.

    ``removed`` lists the word ranges taken out; ``kept_sha256`` is of the words kept,
    joined by one space.  Windows are judged on the input.  A passage that repeats
    within one document alone stays, and so do all rows repeated with one doc_id as
    against each other.  A null or empty text has no words; texts of any length are read
    whole, each in one task; a row with a null doc_id owns nothing and keeps everything.  An empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards = shard_count(docs, 4 * parts, shard_bytes)
    # a row is named by what it holds, so that every reading of the table gives it the same name
    rows = docs.select(
        F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string")).alias("row"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
    )
    # rows without an id take no part in the search and are spread, whatever they hold
    spread = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id()).otherwise(F.col("row"))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64(spread), F.lit(shards)).cast("int"))
    rows, wanted = _confirmed(rows, parts, window, phrase)
    return rows.groupBy("shard").cogroup(wanted.groupBy("shard")).applyInArrow(_remove(window), _RESULT)
