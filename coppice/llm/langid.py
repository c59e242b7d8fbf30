"""Language identification by nearest centroids.

A text is a normalised TF-IDF vector of hashed character n-grams.  Each language has
several centroids, found by spherical k-means on a bounded sample of labelled rows; a
text gets the language of the centroid with the largest cosine.  It is rejected where it
has no letter, or where that cosine is far below what the language's own sample shows.
Document frequencies are counted over all labelled rows.
"""

from __future__ import annotations

import functools
import sys
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coppice.llm.common import small_batches

#: Hashed n-gram features, and the lengths of the n-grams.
FEATURES = 4096
NGRAMS = (1, 2, 3)
#: Labelled rows per language to which centroids are fitted, at most; all others only count for IDF.
SAMPLE = 400
CENTROIDS = 4
TURNS = 10
#: A text is rejected below this share of the smallest cosine in its language's sample.
REJECT = 0.5
UNKNOWN = "und"

_MIX = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))
#: Code points hashed at once, and texts whose vectors are held at once.
_BLOCK, _TEXTS = 1 << 20, 128


@dataclass
class Model:
    """What ``fit`` learns; its size depends on languages and features alone."""

    languages: list[str] = field(default_factory=list)
    idf: np.ndarray = field(default_factory=lambda: np.ones(FEATURES, np.float32))
    centroids: np.ndarray = field(default_factory=lambda: np.zeros((0, FEATURES), np.float32))
    of: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    least: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))


@functools.cache
def _letters() -> np.ndarray:
    """Whether a code point is a letter, as ``str.isalpha`` has it; numerals and symbols are none."""
    return np.array([chr(i).isalpha() for i in range(sys.maxunicode + 1)], bool)


def has_letter(text: str | None) -> bool:
    return bool(text) and (text.isalpha() or any(map(str.isalpha, text)))


def letter_runs(text: str) -> np.ndarray:
    """Code points of the lower-cased text, with one space for each run of anything but letters, and at both ends."""
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[codes]
    codes = np.where(letter, codes, np.uint32(32))
    return codes[np.r_[True, letter[1:] | letter[:-1]]]


def ngram_counts(texts: list[str]) -> np.ndarray:
    """``(texts, FEATURES)`` counts of hashed n-grams of the texts' letters, whole."""
    out = np.zeros((len(texts), FEATURES), np.float32)
    for i, text in enumerate(texts):
        codes = letter_runs(text)
        for start in range(0, len(codes), _BLOCK):
            part = codes[start : start + _BLOCK + max(NGRAMS) - 1]
            h = np.zeros(len(part), np.uint32)
            for n in NGRAMS:
                if len(part) < n:
                    break
                h = h[: len(part) - n + 1] * _MIX[0] + part[n - 1 :] * _MIX[1]
                last = min(len(h), _BLOCK)
                mixed = (h[:last] ^ (h[:last] >> np.uint32(15))) * _MIX[2]
                out[i] += np.bincount(mixed >> np.uint32(20), minlength=FEATURES)
    return out


def vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts) * idf
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norm, out=x, where=norm > 0)


def _slices(batches: Iterator[pa.RecordBatch], lettered: bool = False) -> Iterator[pa.RecordBatch]:
    """Few rows at a time; with ``lettered`` only those whose text has a letter."""
    for b in batches:
        for i in range(0, b.num_rows, _TEXTS):
            part = b.slice(i, _TEXTS)
            yield part.filter(pa.array([has_letter(t) for t in part.column("text").to_pylist()], pa.bool_())) if lettered else part


def _document_frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    df, rows = np.zeros(FEATURES, np.int64), Counter()
    for b in _slices(batches, lettered=True):
        df += (ngram_counts(b.column("text").to_pylist()) > 0).sum(axis=0)
        rows.update(b.column("lang").to_pylist())
    languages = pa.array([None] * FEATURES + list(rows), pa.string())
    features = pa.array(list(range(FEATURES)) + [None] * len(rows), pa.int64())
    counts = pa.array(df.tolist() + list(rows.values()), pa.int64())
    yield pa.RecordBatch.from_arrays([languages, features, counts], names=["lang", "feature", "n"])


def _sample_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in _slices(batches, lettered=True):
        rows = [x.astype("<f4").tobytes() for x in ngram_counts(b.column("text").to_pylist())]
        yield pa.RecordBatch.from_arrays([b.column("lang"), b.column("hash"), b.column("doc_id"), pa.array(rows, pa.binary())], names=["lang", "hash", "doc_id", "counts"])


def spherical_kmeans(x: np.ndarray, k: int, turns: int = TURNS) -> np.ndarray:
    """Unit centroids; the first is the mean's nearest row, each next the row farthest from all so far."""
    chosen = [int((x @ x.mean(axis=0)).argmax())]
    while len(chosen) < min(k, len(x)):
        chosen.append(int((x @ x[chosen].T).max(axis=1).argmin()))
    c = x[chosen]
    for _ in range(turns):
        near = (x @ c.T).argmax(axis=1)
        sums = np.stack([x[near == i].sum(axis=0) if (near == i).any() else c[i] for i in range(len(c))])
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.divide(sums, norm, out=np.zeros_like(sums), where=norm > 0)
    return c


def fit(labelled: DataFrame, sample: int = SAMPLE, centroids: int = CENTROIDS) -> Model:
    """Learn from ``(doc_id, text, lang)``; rows with a null text or language, or without a letter, are passed over.

    Per language the ``sample`` rows of smallest hash of doc_id are brought to the
    driver as n-gram counts; ``sample`` is the bound on labelled rows.
    """
    small_batches(labelled.sparkSession)
    rows = labelled.where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    counted = rows.select("text", "lang").mapInArrow(_document_frequencies, "lang string, feature long, n long")
    counted = counted.groupBy("lang", "feature").agg(F.sum("n").alias("n")).collect()  # a row for each feature and language
    df = {r["feature"]: r["n"] for r in counted if r["lang"] is None}
    size = {r["lang"]: r["n"] for r in counted if r["lang"] is not None}
    if not size:
        return Model()
    # twice as many rows as wanted pass the hash; the window below then sees no more than these
    near = F.create_map(*(F.lit(x) for lang, n in size.items() for x in (lang, min(1.0, (2.0 * sample + 50) / n))))[F.col("lang")]
    hashed = F.xxhash64(F.lit("langid"), "doc_id")
    unit = hashed.cast("double") / float(1 << 64) + 0.5
    few = rows.select("lang", hashed.alias("hash"), "doc_id", "text").where(unit <= near)
    few = few.mapInArrow(_sample_counts, "lang string, hash long, doc_id long, counts binary")
    place = F.row_number().over(Window.partitionBy("lang").orderBy("hash", "doc_id", "counts"))
    got = few.withColumn("place", place).where(F.col("place") <= sample).orderBy("lang", "place").select("lang", "counts").collect()
    total = sum(size.values())
    idf = np.array([np.log((1 + total) / (1 + df.get(i, 0))) + 1 for i in range(FEATURES)], np.float32)
    languages = sorted({r["lang"] for r in got})
    found, of, least = [], [], []
    for i, language in enumerate(languages):
        counts = np.stack([np.frombuffer(r["counts"], "<f4") for r in got if r["lang"] == language])
        x = vectors(counts, idf)
        c = spherical_kmeans(x, centroids)
        found.append(c)
        of += [i] * len(c)
        least.append(float((x @ c.T).max(axis=1).min()))
    return Model(languages, idf, np.concatenate(found).astype(np.float32), np.array(of), np.array(least, np.float32))


def predict(texts: list[str | None], model: Model) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, score and whether it is rejected, for each text."""
    known = np.array([has_letter(t) for t in texts], bool) & bool(model.languages)
    names, score, rejected = [UNKNOWN] * len(texts), np.zeros(len(texts)), ~known
    some = np.flatnonzero(known)
    if len(some):
        cosine = vectors(ngram_counts([texts[i] for i in some]), model.idf) @ model.centroids.T
        score[some] = np.clip(cosine.max(axis=1), 0, 1)
        language = model.of[cosine.argmax(axis=1)]
        rejected[some] = score[some] < REJECT * model.least[language]
        for i, n in zip(some, language):
            names[i] = model.languages[n]
    return names, score, rejected


def _predict_batches(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            names, score, rejected = predict(b.column("text").to_pylist(), model)
            arrays = [b.column("doc_id"), b.column("held_out"), pa.array(names), pa.array(score), pa.array(rejected)]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "held_out", "lang_pred", "score", "rejected"])

    return run


def _accept_batches(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            _, _, rejected = predict([t if t is None else str(t) for t in b.column("text").to_pylist()], model)
            yield b.filter(pa.array(~rejected))

    return run


def held_out(doc_id: Column) -> Column:
    """Rows that nothing is learned from: CRC-32 of the id as text leaves 2 by 4; a null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(True))


def fit_documents(docs: DataFrame) -> Model:
    """A model learned from the rows that are not held out."""
    columns = (("doc_id", "long"), ("text", "string"), ("lang", "string"))
    return fit(docs.select(*(F.col(c).cast(kind).alias(c) for c, kind in columns)).where(~held_out(F.col("doc_id"))))


def accepted(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """The rows of ``docs``, as they are, whose language is not rejected.

    Null and empty texts and those without a letter go; texts are read whole whatever
    their length; of repeated rows and ties all stay or all go; an empty table stays
    empty, and columns of any name pass through unchanged.
    """
    small_batches(docs.sparkSession)
    model, names = model or fit_documents(docs), docs.columns
    # plain names on the way through Python, which takes no dots and quotes
    plain = docs.toDF(*("text" if c == "text" else f"column_{i}" for i, c in enumerate(names)))
    return plain.mapInArrow(_accept_batches(model), plain.schema).toDF(*names)


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, held_out, lang_pred, score, rejected``.

    Without a model one is fitted to the rows that are not held out.  Null and empty
    texts and those without a letter (``str.isalpha``) are ``und`` with score 0, and
    rejected; so is everything where there was nothing to learn from.  Texts of any
    length are read whole.  Ties go to the language first in
    order, repeated rows get equal predictions, an empty table gives no rows, and other
    columns are ignored.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    model = model or fit_documents(docs)
    schema = "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean"
    return rows.mapInArrow(_predict_batches(model), schema)


__all__ = ["Model", "accepted", "fit", "fit_documents", "held_out", "identify", "predict", "ngram_counts", "spherical_kmeans", "vectors"]
