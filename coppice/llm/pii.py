"""Personal data: fixed patterns, and a linear-chain conditional random field beside them.

The base kinds are found by their patterns and stay as they are.  The field reads words
by their shape (letters, digits and marks, not the letters themselves; only ``at`` and
``dot`` have shapes of their own where they could spell an address), together with the
shapes of both neighbours, and is trained on a small labelled table by gradient ascent on
the likelihood.  Words with neither a digit nor ``@``, outside spelled addresses and not
lone marks between two digits, are outside by definition, so the chain falls into short
runs between such words; their best labels are found by Viterbi in numpy, many runs of
one length at a time.  A labelled run becomes a span if it overlaps no base span and its
digits or address form hold up.
"""

from __future__ import annotations

import functools
import random
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coppice.llm.common import small_batches

KINDS = ("email", "ip", "card", "phone")
OUTSIDE, LABELS = 0, 1 + len(KINDS)
#: Labelled rows that training reads at most.
LABELLED_ROWS = 5_000
TURNS, STEP, RIDGE = 200, 0.5, 1e-3
#: Sums of weights that a worker remembers.
REMEMBERED = 1 << 16

# fixed values: the base patterns; runs are matched possessively, from their first character
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Every address ends a run of local characters at an ``@``; all starts within a run share its fate."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(kind, start, end)`` by kind, then start."""
    found = [(0, s, e) for s, e in _emails(text)]
    found += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            found.append((2, m.start(), m.end()))
    if "+" in text:
        found += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return found


# ---------------------------------------------------------------- shapes and features

_SHAPE = bytes(
    ord("X") if 65 <= c <= 90 else ord("x") if 97 <= c <= 122 else ord("d") if 48 <= c <= 57 else ord("u") if c >= 128 else c for c in range(256)
)
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
#: What could spell an address: ``at``, a name, and ``dot`` or a full stop before a last part.
_SPELLED = re.compile(rb"(?i)(?<=[^a-z0-9])at[^a-z0-9\x80-\xff]{1,3}[a-z0-9-]+(?:[\s()\[\]{}<>_-]{1,3}dot[\s()\[\]{}<>_-]{1,3}|[(\[{<]?\.[)\]}>]?)[a-z]{2,}")
_AT, _DOT = re.compile(rb"(?i)(?<![a-z0-9])at(?![a-z0-9])"), re.compile(rb"(?i)(?<![a-z0-9])dot(?![a-z0-9])")
_MARKS = re.compile(rb"[()\[\]{}<>./_:-]{1,3}")
_RUNS = re.compile(rb"(.)\1+", re.DOTALL)


def _spelled(data: bytes) -> Iterator[re.Match]:
    """Matches of ``_SPELLED`` that do not overlap; ``at`` is looked for first, which is quick."""
    low, end = data.lower(), 0
    at = low.find(b"at")
    while at >= 0:
        if at >= end and not low[at - 1 : at].isalnum() and not low[at + 2 : at + 3].isalnum() and at and (m := _SPELLED.match(data, at)):
            yield m
            end = m.end()
        at = low.find(b"at", at + 2)


def shape_of(text: str) -> bytes:
    """A letter class for each byte of the UTF-8 text; ``at`` and ``dot`` of spelled addresses become two marks of their own."""
    data = text.encode("utf-8", "replace")
    out = data.translate(_SHAPE)
    for m in _spelled(data):
        part = _AT.sub(b"\x01\x01", data[m.start() : m.end()], 1)
        part = _DOT.sub(b"\x02\x02\x02", part).translate(_SHAPE)
        out = out[: m.start()] + part + out[m.end() :]
    return out


def words_of(shape: bytes) -> tuple[list[re.Match], list[bytes], list[tuple[int, int]]]:
    """Words, their shapes, and the runs of words that the field labels, as half-open ranges."""
    found = list(_WORD.finditer(shape))
    shapes = [m[0] for m in found]
    last = len(shapes) - 1
    digits = {i for i, s in enumerate(shapes) if b"d" in s or b"@" in s}
    open_ = set(digits)
    if b"\x01" in shape or b"\x02" in shape:
        # the names before and after a mark, and those between the marks
        for i, s in enumerate(shapes):
            if b"\x01" in s or b"\x02" in s:
                open_ |= {i, max(i - 1, 0), min(i + 1, last)}
    for i in digits:
        # a lone mark between two digits; it may stand at an @ as well
        for j in (i + 1, i - 1):
            if 0 < j < last and j not in open_ and _MARKS.fullmatch(shapes[j]) and (b"d" in shapes[j - 1] or b"@" in shapes[j - 1] or b"@" in shapes[j + 1]):
                open_.add(j)
        if b"@" in shapes[i] and len(shapes[i]) <= 3:  # a lone @ has its names beside it
            open_ |= {max(i - 1, 0), min(i + 1, last)}
    for i in sorted(open_):
        # a name between a lone mark and a last part: ``mail . org``
        if shapes[i] in _LONE and i - 1 in open_ and i + 1 < last:
            open_.add(i + 1)
    runs: list[list[int]] = []
    for i in sorted(open_):
        if runs and runs[-1][1] == i:
            runs[-1][1] = i + 1
        else:
            runs.append([i, i + 1])
    return found, shapes, [tuple(x) for x in runs]


_LONE = frozenset((b".", b"(.)", b"[.]", b"{.}"))


@functools.lru_cache(1 << 16)
def own_features(shape: bytes) -> tuple[bytes, ...]:
    """Features of a word by its own shape; long shapes count by their collapsed form alone."""
    short = _RUNS.sub(rb"\1", shape)[:32]
    digits = min(shape.count(b"d"), 20)
    whole = (b"f=" + shape,) if len(shape) <= 24 else ()
    return (*whole, b"c=" + short, b"n=%d" % digits, b"s=" + shape[:1], b"e=" + shape[-1:], b"@=%d" % (b"@" in shape), b"at=%d" % (b"\x01" in shape), b"dot=%d" % (b"\x02" in shape), b".=%d" % min(shape.count(b"."), 5), b"-=%d" % min(shape.count(b"-"), 5))


@functools.lru_cache(1 << 16)
def near_features(shape: bytes, side: bytes) -> tuple[bytes, ...]:
    """Features of a word by a neighbour's shape; an empty shape is the text's end."""
    return (side + b"c=" + _RUNS.sub(rb"\1", shape)[:8], side + b"n=%d" % min(shape.count(b"d"), 8))


def features(shapes: list[bytes], i: int) -> tuple[bytes, ...]:
    left = shapes[i - 1] if i else b""
    right = shapes[i + 1] if i + 1 < len(shapes) else b""
    return own_features(shapes[i]) + near_features(left, b"<") + near_features(right, b">")


# ---------------------------------------------------------------- the labelled table


# fixed values: ways of spelling an address out
SPELLED = (
    "{a} at {b} dot com", "{a}.{n} (at) {b} (dot) org", "{a}[at]{b}[dot]net", "{a}_{n} AT {b} DOT com", "{a} @ {b}.com",
    "{a} (at) {b}.de", "{a} at {b}.org", "{a} <at> {b} <dot> io", "{a} @ {b} . com", "{a} {{at}} {b} {{dot}} co {{dot}} uk",
)


def example_rows(n: int = 900, seed: int = 7) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """A small labelled table: ``(text, [(kind, start, end)])``, written by a seeded generator."""
    r = random.Random(seed)
    words = "please call the office about order and invoice from our team at noon or send it to".split()

    def digits(k: int) -> str:
        return "".join(r.choice("0123456789") for _ in range(k))

    def card() -> str:
        body = r.choice("3456") + digits(14)
        check = next(c for c in "0123456789" if luhn(body + c))
        d, sep = body + check, r.choice(("", " ", "-", ".", "/", "_", "  ", " - ", " . "))
        return sep.join(d[i : i + 4] for i in range(0, 16, 4))

    def phone() -> str:
        a, b, c = digits(3), digits(3), digits(4)
        form = r.choice(("+1 ({}) {}-{}", "({}) {}-{}", "{}-{}-{}", "+44 {} {} {}", "001 {} {} {}", "{}.{}.{}", "+1-{}-{}-{}", "1 {} {} {}", "{}/{}/{}", "{} {} {}", "00 44 {} {} {}", "tel:{}-{}-{}", "({}){}-{}", "+ {} {} {}", "0{} / {} {}"))
        return form.format(a, b, c)

    def name() -> str:
        return "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(3, 9)))

    def email() -> str:
        form = r.choice(("{a}.{n}@{b}.com", "{a}@{b}.example.org", "<{a}_{n}@{b}.net>", "{a}{n}@{b}.co.uk", "{a}(@){b}.com", "{a}[@]{b}.org", "{a}@{b}[.]com", *SPELLED))
        return form.format(a=name(), b=name(), n=digits(2))

    def ip() -> str:
        sep = r.choice((".", ".", "[.]", "(.)", " . ", "-dot-", "{.}", " [.] "))
        return sep.join(str(r.randint(0, 255)) for _ in range(4)) + r.choice(("", "", ":8080", "/24"))

    def other() -> str:
        return r.choice(
            (
                f"20{digits(2)}-0{digits(1)}-1{digits(1)}",
                f"1{digits(1)}:{digits(2)}",
                f"v{digits(1)}.{digits(1)}.{digits(2)}",
                f"${digits(2)}.{digits(2)}",
                f"#{digits(r.randint(3, 12))}",
                digits(r.randint(1, 12)),
                f"@{name()}",
                f"{name()}{digits(2)}",
                f"{digits(2)}%",
                f"{digits(3)},{digits(3)}",
                f"{digits(6)}-{digits(4)}",
                f"20{digits(2)}-0{digits(1)}-1{digits(1)} 1{digits(1)}:{digits(2)}:{digits(2)}",
                f"0{digits(1)}.1{digits(1)}.20{digits(2)} {digits(2)}:{digits(2)}",
                f"978-{digits(1)}-{digits(2)}-{digits(6)}-{digits(1)}",
                f"{digits(2)}.{digits(4)}, {digits(2)}.{digits(4)}",
                f"{digits(1)},{digits(3)},{digits(3)}.{digits(2)}",
                f"{digits(4)} {digits(4)} {digits(4)} {digits(2)}",
                f"{digits(2)} x {digits(2)} x {digits(2)}",
                f"section {digits(1)}.{digits(1)}.{digits(1)}",
                f"at {name()}.{name().title()} {name()}",
                f"at {name()}. {name().title()}",
                f"looked at {name()} dot {digits(1)} and",
                f"@ {digits(1)} {name()}",
            )
        )

    rows = []
    for i in range(n):
        parts: list[tuple[str, str | None]] = [(r.choice(words), None) for _ in range(r.randint(0, 5))]
        for _ in range(r.randint(1, 2)):
            kind = r.choice((*KINDS, None, None))
            made = {"email": email, "ip": ip, "card": card, "phone": phone, None: other}[kind]()
            parts += [(made + r.choice(("", "", "", ",", ".")), kind), *((r.choice(words), None) for _ in range(r.randint(0 if kind is None else 1, 4)))]
        text, spans = "", []
        for piece, kind in parts:
            text += " " if text else ""
            if kind:
                spans.append((kind, len(text), len(text) + len(piece)))
            text += piece
        rows.append((text, spans))
    return rows


def example_table(spark: SparkSession, n: int = 900, seed: int = 7) -> DataFrame:
    schema = "text string, spans array<struct<kind:string,start:int,end:int>>"
    return spark.createDataFrame(example_rows(n, seed), schema)


# ---------------------------------------------------------------- the field


@dataclass
class Field:
    """Weights by feature and label, and from label to label."""

    weights: dict[bytes, np.ndarray]
    moves: np.ndarray

    def __post_init__(self):
        self.known: dict[tuple[bytes, ...], np.ndarray] = {}

    def _weight(self, names: tuple[bytes, ...]) -> np.ndarray:
        """Sum of the features' weights; shapes come again and again, so sums are remembered."""
        total = self.known.get(names)
        if total is None:
            if len(self.known) > REMEMBERED:
                self.known.clear()
            total = self.known[names] = sum((w for f in names if (w := self.weights.get(f)) is not None), np.zeros(LABELS))
        return total

    def emission(self, shapes: list[bytes], i: int) -> np.ndarray:
        left = shapes[i - 1] if i else b""
        right = shapes[i + 1] if i + 1 < len(shapes) else b""
        return self._weight(own_features(shapes[i])) + self._weight(near_features(left, b"<")) + self._weight(near_features(right, b">"))


def _logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)


def fit(labelled: DataFrame, limit: int = LABELLED_ROWS) -> Field:
    """Train on rows ``(text, spans)`` by full-batch AdaGrad; rows beyond ``limit`` are not read."""
    got = labelled.orderBy("text").limit(limit).collect()
    return fit_rows([(r["text"] or "", [tuple(s) for s in r["spans"] or []]) for r in got])


def fit_rows(rows: list[tuple[str, list[tuple[str, int, int]]]], turns: int = TURNS) -> Field:
    index: dict[bytes, int] = {}
    by_length: dict[int, list[tuple[list[list[int]], list[int]]]] = defaultdict(list)
    for text, spans in rows:
        found, shapes, runs_ = words_of(shape_of(text))
        labels = [OUTSIDE] * len(shapes)
        for kind, s, e in spans:
            if kind in KINDS:
                s, e = len(text[:s].encode()), len(text[:e].encode())
                for i, m in enumerate(found):
                    if m.start() < e and m.end() > s:
                        labels[i] = 1 + KINDS.index(kind)
        for a, b in runs_:
            ids = [[index.setdefault(f, len(index)) for f in features(shapes, i)] for i in range(a, b)]
            by_length[b - a].append((ids, labels[a:b]))
    w, moves = np.zeros((len(index), LABELS)), np.zeros((LABELS, LABELS))
    w_sum, m_sum = np.full_like(w, 1e-8), np.full_like(moves, 1e-8)
    groups = []
    for n, runs in by_length.items():
        x = np.zeros((len(runs), n, len(index)), np.float32)
        for r, (ids, _) in enumerate(runs):
            for t, fs in enumerate(ids):
                x[r, t, fs] = 1
        groups.append((x, np.array([labels for _, labels in runs])))
    count = sum(len(y) for _, y in groups)
    for _ in range(turns if count else 0):
        gw, gm = -RIDGE * w, -RIDGE * moves
        for x, y in groups:
            b, n = y.shape
            e = x @ w
            forward, backward = np.zeros((n, b, LABELS)), np.zeros((n, b, LABELS))
            forward[0] = moves[OUTSIDE] + e[:, 0]
            for t in range(1, n):
                forward[t] = _logsumexp(forward[t - 1][:, :, None] + moves, 1) + e[:, t]
            backward[-1] = moves[:, OUTSIDE]
            for t in range(n - 2, -1, -1):
                backward[t] = _logsumexp(moves + (e[:, t + 1] + backward[t + 1])[:, None, :], 2)
            z = _logsumexp(forward[-1] + moves[:, OUTSIDE], 1)
            expected = np.exp(forward + backward - z[:, None])
            actual = np.eye(LABELS)[y].transpose(1, 0, 2)
            gw += np.tensordot(x, (actual - expected).transpose(1, 0, 2), ([0, 1], [0, 1])) / count
            gm[OUTSIDE] += (actual[0] - expected[0]).sum(axis=0) / count
            gm[:, OUTSIDE] += (actual[-1] - expected[-1]).sum(axis=0) / count
            for t in range(1, n):
                pair = np.exp(forward[t - 1][:, :, None] + moves + (e[:, t] + backward[t])[:, None, :] - z[:, None, None])
                gm += (actual[t - 1].T @ actual[t] - pair.sum(axis=0)) / count
        w_sum += gw * gw
        m_sum += gm * gm
        w += STEP * gw / np.sqrt(w_sum)
        moves += STEP * gm / np.sqrt(m_sum)
    return Field({f: w[i].copy() for f, i in index.items()}, moves)


def viterbi(e: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Best labels of runs of one length; ``e`` is (runs, words, labels), both ends lie beside an outside word."""
    b, n, _ = e.shape
    score, back = moves[OUTSIDE] + e[:, 0], np.zeros((n, b, LABELS), np.int64)
    for t in range(1, n):
        options = score[:, :, None] + moves
        back[t] = options.argmax(axis=1)
        score = options.max(axis=1) + e[:, t]
    out = np.zeros((b, n), np.int64)
    out[:, -1] = (score + moves[:, OUTSIDE]).argmax(axis=1)
    for t in range(n - 1, 0, -1):
        out[:, t - 1] = back[t][np.arange(b), out[:, t]]
    return out


# ---------------------------------------------------------------- decoding texts

_TRIM = re.compile(r"[^A-Za-z0-9]*(.*[A-Za-z0-9])", re.DOTALL)
_TRIM_DIGITS = re.compile(r"[^0-9+(]*(.*[0-9])", re.DOTALL)
_ADDRESS = re.compile(r"(?i)[A-Z0-9._%+-]+(?:\W{0,2}@\W{0,2}|\W{1,2}at\W{1,2})([A-Z0-9-]+(?:\W{1,3}[A-Z0-9-]+)+)")
_DOTS = re.compile(r"(?i)\.|\bdot\b")


def _holds_up(kind: int, text: str) -> bool:
    d = _digits(text)
    if kind == 0:
        m = _ADDRESS.fullmatch(text)
        return m is not None and _DOTS.search(m[1]) is not None and text[-1].isalpha()
    if kind == 1:
        parts = re.findall(r"[0-9]+", text)
        return len(parts) >= 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts[:4])
    if kind == 2:
        return 13 <= len(d) <= 19 and luhn(d)
    return 9 <= len(d) <= 15 and len(re.findall(r"[0-9]+", text)) >= 2


def spans_of(texts: list[str], field: Field) -> list[tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]]:
    """For each text its base spans and all its spans, both by kind, then start."""
    waiting: dict[int, list] = defaultdict(list)
    base = [base_spans(t) for t in texts]
    extra: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for d, text in enumerate(texts):
        shape = shape_of(text)
        if b"d" not in shape and b"@" not in shape and b"\x01" not in shape:
            continue
        found, shapes, runs_ = words_of(shape)
        for a, b in runs_:
            waiting[b - a].append((d, found[a:b], np.stack([field.emission(shapes, i) for i in range(a, b)])))
    for runs in waiting.values():
        best = viterbi(np.stack([e for *_, e in runs]), field.moves)
        for (d, found, _), labels in zip(runs, best):
            cuts = np.flatnonzero(np.r_[True, labels[1:] != labels[:-1], True])
            for s, e in zip(cuts, cuts[1:]):
                if labels[s] != OUTSIDE:
                    extra[d].append((int(labels[s]) - 1, found[s].start(), found[e - 1].end()))
    out = []
    for text, own, more in zip(texts, base, extra):
        whole = own
        if more:
            data = text.encode("utf-8", "replace")
            for kind, s, e in more:
                s, e = len(data[:s].decode()), len(data[:e].decode())
                m = (_TRIM_DIGITS if kind else _TRIM).match(text[s:e])
                if not m:
                    continue
                s, e = s + m.start(1), s + m.end(1)
                if not any(s < y and x < e for _, x, y in own) and _holds_up(kind, text[s:e]):
                    whole = [*whole, (kind, s, e)]
        out.append((own, sorted(whole)))
    return out


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def _scan_batches(field: Field):
    def told(spans):
        return [{"kind": KINDS[k], "start": s, "end": e} for k, s, e in spans]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = spans_of([x or "" for x in b.column("text").to_pylist()], field)
            arrays = [b.column("doc_id"), pa.array([told(x) for x, _ in found], _SPANS), pa.array([told(x) for _, x in found], _SPANS)]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "base", "spans"])

    return run


def personal_data(docs: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, base, spans``, arrays of (kind, start, end) in code points.

    ``labelled`` is the table the field is trained on; without one it is ``example_table``.
    Null and empty texts have no spans, texts of any length are read whole, repeated rows get equal ones, null ids are kept,
    an empty table gives no rows, and other columns are ignored.  Within one kind base
    spans do not overlap; a span that the field adds overlaps no base span.
    """
    small_batches(docs.sparkSession)
    field = fit(example_table(docs.sparkSession) if labelled is None else labelled)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    spans = "array<struct<kind:string,start:int,end:int>>"
    return rows.mapInArrow(_scan_batches(field), f"doc_id long, base {spans}, spans {spans}")


def digest(spans):
    """``kind:start:end`` of the spans in their order, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def count_of(spans, kind: str):
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")
