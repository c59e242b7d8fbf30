"""Packing documents into token sequences by bound-certified best-fit decreasing.

Documents become token ids once; only those longer than a sequence are cut.  Pieces are
dealt by hash into partitions of a bounded number of pieces, and each partition is
packed best-fit decreasing.  Dual feasible functions give a lower bound on the
sequences that a partition needs: where the packing meets the bound it is certified
optimal and stays.  The partitions with a gap give up the pieces of their sequences
with room left; those meet in new, fewer partitions and are packed again.
"""

from __future__ import annotations

import functools
import json
import string
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coppice.llm.common import cut, small_batches

SEQUENCE = 2048
#: Pieces of a partition; its rows are held in one task.
PARTITION_PIECES = 50_000
#: Times that partitions with a gap exchange documents.
ROUNDS = 3
#: Sequences with at least this share of room are given up by a partition with a gap.
LOOSE = 0.005
#: Words whose ids a worker remembers.
CACHED_WORDS = 400_000

_PIECE = "row_id long, doc_id long, piece int, start long, length long, ids_crc32 long"
_PLACED = _PIECE + ", part long, bin long, offset long, bins long, bound long, loose boolean"


def _byte_alphabet() -> str:
    """The byte-level alphabet: printable bytes stand for themselves, the rest for code points from 256."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return "".join(chr(b if b in plain else next(rest)) for b in range(256))


def _packed_ids(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class WordIds(dict):
    """Ids of white-space-free words as little-endian 32-bit bytes, remembered by word.

    The tokenizer drops white space and never joins tokens over it, so a text's ids are
    its words' ids one after the other.  Words of letters up to U+00FF go straight to
    the BPE model, after lower-casing; closing ASCII punctuation is a token run of its
    own and is looked up apart.  Every other word takes the tokenizer's whole path.
    """

    def __init__(self, path: str, limit: int = CACHED_WORDS):
        from tokenizers import Tokenizer

        super().__init__()
        self.whole = Tokenizer.from_file(path)
        plan = json.loads(self.whole.to_str())
        kinds = [x["type"] for x in (plan["normalizer"] or {}).get("normalizers", [])]
        # the short way holds for a tokenizer of this form only
        self.short = kinds == ["NFC", "Replace", "Lowercase"] and "</w>" == plan["model"].get("end_of_word_suffix")
        self.model = self.whole.model
        self.alphabet = _byte_alphabet()
        self.limit = limit

    def __missing__(self, word: str) -> bytes:
        if len(self) > self.limit:
            self.clear()
        ids = self[word] = self._ids(word)
        return ids

    def _ids(self, word: str) -> bytes:
        if not word:
            return b""
        if self.short:
            core = word if word.isalpha() else word.rstrip(string.punctuation)
            if core.isascii():
                plain = core.isalpha()
                letters = core
            elif plain := core.isalpha() and max(core) <= "\xff":
                letters = core.encode().decode("latin-1").translate(self.alphabet)
            if plain:
                if core is not word and core != word:
                    if "'" not in word:
                        return self[core] + self[word[len(core) :]]
                elif not core.islower() and (lower := core.lower()) != core:
                    return self[lower]
                else:
                    return _packed_ids([x.id for x in self.model.tokenize(letters)])
        return _packed_ids(self.whole.encode(word, add_special_tokens=False).ids)

    def of(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


@functools.cache
def _words_of(tokenizer: str) -> WordIds:
    """One store of words for all tasks of a worker."""
    return WordIds(tokenizer)


def _piece_batches(tokenizer: str, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _words_of(tokenizer)
        for b in batches:
            rows: list[list] = [[] for _ in range(6)]
            for row, doc, text in zip(b.column("row_id").to_pylist(), b.column("doc_id").to_pylist(), b.column("text")):
                ids = words.of(text.as_py() or "") + b"\0\0\0\0"
                n = len(ids) // 4
                for k, start in enumerate(range(0, n, size)):
                    part = ids[4 * start : 4 * (start + size)]
                    for column, x in zip(rows, (row, doc, k, start, len(part) // 4, zlib.crc32(part))):
                        column.append(x)
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, kind) for x, kind in zip(rows, kinds)], names=["row_id", "doc_id", "piece", "start", "length", "ids_crc32"]
            )

    return run


def pieces(docs: DataFrame, tokenizer: str, size: int = SEQUENCE) -> DataFrame:
    """Pieces of every row: ``row_id, doc_id, piece, start, length, ids_crc32``."""
    small_batches(docs.sparkSession)
    rows = docs.select(
        F.monotonically_increasing_id().alias("row_id"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")
    )
    return rows.mapInArrow(_piece_batches(tokenizer, size), _PIECE)


def lower_bound(lengths: np.ndarray, size: int) -> int:
    """The best of three families of dual feasible functions (Fekete and Schepers, 2001), in integers."""
    x, count = np.unique(np.asarray(lengths, np.int64), return_counts=True)
    if not len(x):
        return 0
    best = -(-int((x * count).sum()) // size)
    for k in range(1, 21):
        value = np.where((k + 1) * x % size == 0, k * x, (k + 1) * x // size * size)
        best = max(best, -(-int((value * count).sum()) // (k * size)))
    for e in x[2 * x <= size]:
        value = np.where(x > size - e, size, np.where(x < e, 0, x))
        best = max(best, -(-int((value * count).sum()) // size))
        f = size // e
        value = np.where(2 * x > size, 2 * (f - (size - x) // e), np.where(2 * x == size, f, 2 * (x // e)))
        best = max(best, -(-int((value * count).sum()) // (2 * f)))
    return best


def best_fit_decreasing(lengths: list[int], size: int) -> tuple[list[int], list[int], int]:
    """Bin and offset of each length, which come in decreasing order, and the number of bins."""
    open_: list[list[int]] = [[] for _ in range(size + 1)]
    mask, bins, where, offsets = 0, 0, [], []
    for n in lengths:
        fits = mask >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = open_[room].pop()
            if not open_[room]:
                mask ^= 1 << room
        else:
            room, b = size, bins
            bins += 1
        where.append(b)
        offsets.append(size - room)
        if room > n:
            open_[room - n].append(b)
            mask |= 1 << (room - n)
    return where, offsets, bins


def _pack_partition(size: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "row_id", "piece"], ascending=[False, True, True], ignore_index=True)
        where, offsets, bins = best_fit_decreasing(pdf["length"].tolist(), size)
        bound = lower_bound(pdf["length"].to_numpy(), size)
        b = np.array(where, np.int64)
        room = size - np.bincount(b, weights=pdf["length"].to_numpy(), minlength=bins)
        loose = (room >= LOOSE * size)[b] & (bins > bound)
        return pdf.assign(bin=b, offset=np.array(offsets, np.int64), bins=bins, bound=bound, loose=loose)

    return run


def _packed(items: DataFrame, n: int, round_: int, size: int, partition: int) -> DataFrame:
    parts = max(1, -(-n // partition))
    part = F.pmod(F.xxhash64("row_id", "piece", F.lit(round_)), F.lit(parts)) + F.lit(round_ << 32)
    return items.select(*_names(_PIECE), part.alias("part")).groupBy("part").applyInPandas(_pack_partition(size), _PLACED)


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def pack(docs: DataFrame, tokenizer: str, size: int = SEQUENCE, partition: int = PARTITION_PIECES, rounds: int = ROUNDS) -> DataFrame:
    """Place every piece of every row: ``_PIECE`` columns, ``sequence_id, offset, bins, bound``.

    ``bins`` and ``bound`` certify the partition in which a piece was placed last: it
    used ``bins`` sequences and cannot do with fewer than ``bound``.  After ``rounds``
    exchanges, or once one saves nothing, what is left stays as it is packed, valid but
    with a gap that ``bins`` and ``bound`` show.  A null or empty text is the closing id 0
    alone; texts of any length are read whole.  Repeated rows are packed each for itself (the
    hidden ``row_id`` tells them apart), ties of length go by row and piece, an empty
    table gives no rows, and other columns are ignored.
    """
    items = cut(pieces(docs, tokenizer, size), "pieces")
    done, n, before = [], items.count(), 0
    for round_ in range(rounds + 1):
        placed = cut(_packed(items, n, round_, size, partition), "packed")
        if round_:
            # an exchange is taken only if it saves sequences
            if placed.select("part", "bin").distinct().count() >= before:
                done.append(items)
                break
        loose = placed.where("loose")
        alone = n <= partition  # one partition has nobody to exchange with
        n = 0 if round_ == rounds or alone else loose.count()
        if not n:
            done.append(placed)
            break
        before = loose.select("part", "bin").distinct().count()
        done.append(placed.where(~F.col("loose")))
        items = loose
    out = done[0]
    for more in done[1:]:
        out = out.union(more)
    return out.select(*_names(_PIECE), (F.col("part") * F.lit(1 << 24) + F.col("bin")).alias("sequence_id"), "offset", "bins", "bound")
