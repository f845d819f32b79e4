"""Document fingerprints from prefix polynomial hashes.

For a text with code points c, ``H[i]`` is the sum of ``(c[j] + 1) * base**j`` over j < i, modulo a prime. Any span's
hash follows from two entries, so equal spans are told in constant time, and the longest common extension of two
positions is found by binary search. A fingerprint keeps the hash of the whole text, of its prefixes and suffixes at a
ladder of lengths, and of the smallest spans of 24 characters; two fingerprints are compared by binary search in the
ladders (common start and end) and by the share of spans in common.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import partitions, table

P = (1 << 31) - 1  # a Mersenne prime: products of two residues fit 64 bits, and reducing is a shift and an addition
BASES = (1_103_515_245 % P, 1_566_083_941)
RUNGS = 32
SPAN = 24
SKETCH = 64
DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ_abcdefghijklmnopqrstuvwxyz-"


def fold(x: np.ndarray) -> np.ndarray:
    """``x`` modulo ``P``, for values under 2**62."""
    x = (x & P) + (x >> 31)
    x = (x & P) + (x >> 31)
    return np.where(x >= P, x - P, x)


@lru_cache(maxsize=8)
def _powers(base: int, bits: int) -> np.ndarray:
    out = np.ones(1 << bits, np.int64)
    step = base
    for b in range(bits):
        n = 1 << b
        out[n : 2 * n] = fold(out[:n] * step)
        step = step * step % P
    return out


def powers(base: int, n: int) -> np.ndarray:
    return _powers(base, max(12, int(n).bit_length()))[: n + 1]


class Prefixes:
    """Modular prefix arrays of one text under two bases."""

    def __init__(self, text: str):
        self.n = len(text)
        c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64) + 1
        self.h = []
        for b in BASES:
            h = np.zeros(self.n + 1, np.int64)
            np.cumsum(fold(c * powers(b, self.n)[: self.n]), out=h[1:])
            self.h.append(fold(h))

    def span(self, start: int, end: int) -> int:
        """Hash of [start, end), free of its position."""
        out = 0
        for b, h in zip(BASES, self.h, strict=True):
            inverse = pow(b, -start, P)
            out = out << 31 | (int(h[end]) - int(h[start])) * inverse % P
        return out

    def spans(self, width: int) -> np.ndarray:
        """Hashes of all spans of so many characters under the first base."""
        if self.n < width:
            return np.zeros(0, np.int64)
        h, inverse = self.h[0], powers(pow(BASES[0], -1, P), self.n)
        return fold(fold(h[width:] - h[:-width] + P) * inverse[: self.n - width + 1])


def spans_equal(a: Prefixes, i: int, b: Prefixes, j: int, length: int) -> bool:
    return a.span(i, i + length) == b.span(j, j + length)


def longest_common_extension(a: Prefixes, i: int, b: Prefixes, j: int) -> int:
    """The most characters that ``a`` from ``i`` and ``b`` from ``j`` have in common, by binary search."""
    low, high = 0, min(a.n - i, b.n - j)
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if spans_equal(a, i, b, j, mid) else (low, mid - 1)
    return low


def _text(values: np.ndarray) -> str:
    """30-bit numbers as five digits each."""
    v = np.asarray(values, np.int64)
    d = np.stack([(v >> s) & 63 for s in (24, 18, 12, 6, 0)], 1).ravel()
    return _ALPHABET[d].tobytes().decode("ascii")


_ALPHABET = np.frombuffer(DIGITS.encode(), np.uint8)


def _mixed(h: np.ndarray) -> np.ndarray:
    """31-bit hashes spread to 30 bits."""
    x = h.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(34)).astype(np.int64)


def fingerprint(text: str) -> str:
    """``length.whole.step.prefixes.suffixes.spans``; equal texts have equal fingerprints."""
    p = Prefixes(text)
    step = 1
    while p.n // step > RUNGS:
        step *= 2
    rungs = np.arange(1, p.n // step + 1) * step
    h0, h1 = p.h
    heads = _mixed(h0[rungs] ^ h1[rungs] << 16)
    # A suffix's hash, counted from its own start.
    at = p.n - rungs
    back = [powers(pow(b, -1, P), p.n)[at] for b in BASES]
    t0, t1 = (fold(fold(h[p.n] - h[at] + P) * inv) for h, inv in zip(p.h, back, strict=True))
    tails = _mixed(t0 ^ t1 << 16)
    s = _mixed(p.spans(SPAN))
    low = np.unique(np.partition(s, 4 * SKETCH)[: 4 * SKETCH]) if len(s) > 4 * SKETCH else np.unique(s)
    if len(low) < SKETCH and len(s) > 4 * SKETCH:
        low = np.unique(s)
    return f"{p.n}.{p.span(0, p.n):x}.{step}.{_text(heads)}.{_text(tails)}.{_text(low[:SKETCH])}"


def _five(s: str) -> list[str]:
    return [s[i : i + 5] for i in range(0, len(s), 5)]


def _rung(a: list[str], sa: int, b: list[str], sb: int) -> int:
    """The longest rung that both ladders have in common: equal up to it, so binary search."""
    step = max(sa, sb)
    ka, kb = step // sa, step // sb
    low, high = 0, min(len(a) // ka, len(b) // kb)
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[mid * ka - 1] == b[mid * kb - 1] else (low, mid - 1)
    return low * step


def likeness(a: str, b: str) -> float:
    """0 to 1 from two fingerprints alone; 1 for equal ones."""
    if a == b:
        return 1.0
    (na, _, sa, ha, ta, ka), (nb, _, sb, hb, tb, kb) = a.split("."), b.split(".")
    most, least = max(int(na), int(nb)), min(int(na), int(nb))
    if least == 0:
        return 0.0
    ends = min(least, _rung(_five(ha), int(sa), _five(hb), int(sb)) + _rung(_five(ta), int(sa), _five(tb), int(sb))) / most
    x, y = set(_five(ka)), set(_five(kb))
    lowest = sorted(x | y)[:SKETCH]
    shared = sum(v in x and v in y for v in lowest) / len(lowest) if lowest else 0.0
    return max(ends, shared)


def _order(id_col: str, text_col: str):
    """Ascending ``_o`` is descending id, nulls last; rows of one id follow by the hash of their text."""
    return F.coalesce(-F.col(f"`{id_col}`").cast("long"), F.lit((1 << 63) - 1)).alias("_o"), F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).alias("_t")


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, int]:
    """Rows (doc_id, text, _b, _look, _o, _t) dealt to ranges of the order, each range followed by the next one's head.

    The ranges come from approximate quantiles of the ids (as many as a few times the shuffle partitions, whatever the
    input); an id that spans several is split by the hash of its texts. One row per range comes to the driver.
    """
    spark = docs.sparkSession
    n = 8 * partitions(spark)
    o, t = _order(id_col, text_col)
    keys = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), o, t)
    cuts = keys.agg(F.percentile_approx("_o", [k / n for k in range(1, n)], 20 * n)).first()[0] or []
    values = np.array(cuts, np.int64)

    def ranges(order: np.ndarray, tie: np.ndarray) -> np.ndarray:
        low, high = np.searchsorted(values, order, "left"), np.searchsorted(values, order, "right")
        share = (tie.astype(np.float64) / 2.0**64 + 0.5).clip(0, 1 - 1e-12)
        return np.where(high > low, low + 1 + np.floor(share * (high - low)).astype(np.int64), low)

    @F.pandas_udf("int")
    def range_of(order: pd.Series, tie: pd.Series) -> pd.Series:
        return pd.Series(ranges(order.to_numpy(), tie.to_numpy()).astype(np.int32))

    heads = keys.select("_o", "_t", range_of("_o", "_t").alias("_b")).groupBy("_b").agg(F.min(F.struct("_o", "_t")).alias("h")).orderBy("_b").collect()
    # Each head also goes to the range before it; the first one to the last range.
    before = {(r["h"]["_o"], r["h"]["_t"]): heads[i - 1]["_b"] for i, r in enumerate(heads)}

    @F.pandas_udf("array<int>")
    def places(order: pd.Series, tie: pd.Series) -> pd.Series:
        own = ranges(order.to_numpy(), tie.to_numpy())
        look = (before.get(k) for k in zip(order.tolist(), tie.tolist(), strict=True))
        return pd.Series([[int(b)] if x is None else [int(b), x] for b, x in zip(own, look, strict=True)])

    dealt = keys.select("doc_id", "text", "_o", "_t", F.posexplode(places("_o", "_t")).alias("_look", "_b"))
    return dealt.repartition(n // 4, "_b").sortWithinPartitions("_b", "_look", "_o", "_t"), n


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text: the last third replaced by the start of the next document.

    Integer ids, descending; null ids come last, equal ids by the hash of their texts. Null texts are empty. The last
    document's next is the first one; a table of one row is its own next. Repeated rows follow each other.
    """
    rows, _ = with_next(docs, id_col, text_col)
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        out: list[tuple] = []
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        types = [None, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

        def emit() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], id_arrow if k == 0 else types[k]) for k in range(7)], names)

        for b in parts:
            id_arrow = b.column(0).type
            for doc_id, text, look, at in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                text = text or ""
                own = None
                if held is not None and held[2] == at:
                    doc, old, _, mark = held
                    m = len(old) // 3
                    edited = old[: len(old) - m] + text[:m]
                    own, mark2 = fingerprint(text), fingerprint(edited)
                    out.append((doc, len(old), hashlib.sha256(edited.encode()).hexdigest(), mark, mark2, likeness(mark, mark2), likeness(mark, own)))
                held = None if look else (doc_id, text, at, own or fingerprint(text))
                if len(out) >= 2000:
                    yield emit()
                    out.clear()
        if out:
            yield emit()

    schema = f"doc_id {id_type}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return rows.select("doc_id", "text", "_look", "_b").mapInArrow(run, schema)


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(table(spark, sf_dir, "documents"))
