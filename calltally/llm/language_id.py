"""Language ID by a bidirectional gated recurrent network over bytes.

The network reads a window of bytes from both ends, one byte a step, and labels every byte from what both directions
know there; a document's probabilities are the means over its letters' bytes. It is trained by backpropagation through
time in numpy on a bounded sample of labelled rows; texts are then labelled whole, window after window, many side by side.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import flat, table

#: Rows that the network learns from: so many of each language, so many in all, so many characters of each.
PER_LANGUAGE, SAMPLE, PIECE_CHARS = 600, 2400, 112
#: Buckets of a language's rows, from each of which so many may come; a language's last task reads no more than their sum.
BUCKETS = 32
#: Bytes of a training window, bytes of a window that is labelled, and windows side by side.
TRAIN_BYTES, WINDOW, SIDE_BY_SIDE = 96, 256, 2048
UNITS, EPOCHS, BATCH, RATE, SEED = 8, 8, 64, 0.02, 11
UNKNOWN = "und"

#: Bytes as the network sees them: A-Z like a-z.
LOWER = np.arange(256)
LOWER[65:91] += 32
#: Bytes that count for the document: ASCII letters and those of other characters.
LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = LETTER[128:] = True


class Network:
    """Weights of both directions: ``x`` a row of input weights a byte, ``u`` and ``c`` recurrent ones; ``w`` and ``b`` the labels'.

    A step: z = sig(xz + h uz), r = sig(xr + h ur), n = tanh(xn + r (h un + c)), h = n + z (h - n).
    """

    def __init__(self, labels: list[str], units: int = UNITS, seed: int = SEED):
        r = np.random.default_rng(seed)
        self.labels, self.units = labels, units
        draw = lambda *shape, scale: r.normal(0, scale, shape).astype(np.float32)
        self.p = {}
        for d in "fb":
            self.p[f"x{d}"] = draw(256, 3 * units, scale=0.3)
            self.p[f"u{d}"] = draw(units, 3 * units, scale=units**-0.5)
            self.p[f"c{d}"] = np.zeros(units, np.float32)
            self.p[f"w{d}"] = draw(units, len(labels), scale=units**-0.5)
        self.p["b"] = np.zeros(len(labels), np.float32)

    def _run(self, data: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """States after each of the rows of ``data`` (steps x windows); direction b starts at the last row. ``keep`` gets each step's parts."""
        n, (x, u, c) = self.units, (self.p[k + d] for k in "xuc")
        h = np.zeros((data.shape[1], n), np.float32)
        out = np.empty((*data.shape, n), np.float32)
        for t in range(len(data)) if d == "f" else range(len(data) - 1, -1, -1):
            g, m = x[data[t]], h @ u
            a = np.tanh((g[:, : 2 * n] + m[:, : 2 * n]) * np.float32(0.5)) * np.float32(0.5) + np.float32(0.5)
            m = m[:, 2 * n :] + c
            new = np.tanh(g[:, 2 * n :] + a[:, n:] * m)
            if keep is not None:
                keep.append((t, h, a, m, new))
            h = new + a[:, :n] * (h - new)
            out[t] = h
        return out

    def _states(self, data: np.ndarray, d: str, lengths: np.ndarray | None = None) -> np.ndarray:
        """What ``_run`` gives, with each gate in arrays of its own that every step uses again.

        ``lengths`` descend: a window's steps beyond its own are left out, so that what stands beside it doesn't matter.

        sig(v) = 1 / (1 + exp(-v)) and tanh(v) = 1 - 2 / (1 + exp(2 v)), the signs and the 2 in the weights.
        """
        n = self.units
        x, u, c = (self.p[k + d] for k in "xuc")
        cuts = [slice(i * n, (i + 1) * n) for i in range(3)]
        scale = [np.float32(v) for v in (-1, -1, 2)]
        (xz, xr, xn), (uz, ur, un) = ([np.ascontiguousarray(v[:, k]) * f for k, f in zip(cuts, scale, strict=True)] for v in (x, u))
        width, c = data.shape[1], c * scale[2]
        h, z, r, new, m = (np.zeros((width, n), np.float32) for _ in range(5))
        wide, out = (h, z, r, new, m), np.zeros((*data.shape, n), np.float32)
        live = np.full(len(data), width) if lengths is None else np.searchsorted(-lengths, -np.arange(len(data)))
        with np.errstate(over="ignore"):  # exp of much is inf, its share 0, as it should be
            for t in range(len(data)) if d == "f" else range(len(data) - 1, -1, -1):
                own = data[t, : live[t]]
                h, z, r, new, m = (v[: live[t]] for v in wide)
                for gate, own_u, own_x in ((z, uz, xz), (r, ur, xr)):
                    np.matmul(h, own_u, out=gate)
                    np.take(own_x, own, axis=0, out=m, mode="clip")
                    gate += m
                    np.exp(gate, out=gate)
                    gate += 1
                np.matmul(h, un, out=new)
                new += c
                new /= r
                np.take(xn, own, axis=0, out=m, mode="clip")
                new += m
                np.exp(new, out=new)
                new += 1
                np.divide(-2, new, out=new)
                new += 1
                h -= new
                h /= z
                h += new
                out[t, : live[t]] = h
        return out

    def probabilities(self, data: np.ndarray, lengths: np.ndarray | None = None) -> np.ndarray:
        """Label probabilities of every byte of ``data`` (steps x windows): labels x steps x windows."""
        p = self.p["wf"].T @ self._states(data, "f", lengths).reshape(-1, self.units).T
        p += self.p["wb"].T @ self._states(data, "b", lengths).reshape(-1, self.units).T
        p += self.p["b"][:, None]
        p -= p.max(0)
        np.exp(p, out=p)
        p /= p.sum(0)
        return p.reshape(-1, *data.shape)

    def gradients(self, data: np.ndarray, weight: np.ndarray, label: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy over the bytes by ``weight`` (steps x windows), and its gradients, backwards through time."""
        n, kept, states, grads = self.units, {"f": [], "b": []}, {}, {}
        for d in "fb":
            states[d] = self._run(data, d, kept[d])
        p = states["f"] @ self.p["wf"] + states["b"] @ self.p["wb"] + self.p["b"]
        p = np.exp(p - p.max(-1, keepdims=True))
        p /= p.sum(-1, keepdims=True)
        share = (weight / max(1.0, float(weight.sum()))).astype(np.float32)
        side = np.arange(data.shape[1])
        loss = float(-(np.log(p[:, side, label] + 1e-9) * share).sum())
        p[:, side, label] -= 1
        p *= share[..., None]
        grads["b"] = p.sum((0, 1))
        for d in "fb":
            u, gx, gu, gc = self.p[f"u{d}"], np.zeros_like(self.p[f"x{d}"]), np.zeros_like(self.p[f"u{d}"]), np.zeros(n, np.float32)
            grads[f"w{d}"] = np.tensordot(states[d], p, ((0, 1), (0, 1)))
            above, gh = p @ self.p[f"w{d}"].T, np.zeros((data.shape[1], n), np.float32)
            pre = np.empty((*data.shape, 3 * n), np.float32)
            for t, h, a, m, new in reversed(kept[d]):
                gh = gh + above[t]
                z, r = a[:, :n], a[:, n:]
                gn = gh * (1 - z) * (1 - new * new)
                gm = gn * r
                gates = np.concatenate([gh * (h - new) * z * (1 - z), gn * m * r * (1 - r)], 1)
                rec = np.concatenate([gates, gm], 1)
                gu += h.T @ rec
                gc += gm.sum(0)
                pre[t, :, : 2 * n], pre[t, :, 2 * n :] = gates, gn
                gh = gh * z + rec @ u.T
            flat_bytes, flat_pre = data.ravel(), pre.reshape(-1, 3 * n)
            for k in range(3 * n):
                gx[:, k] = np.bincount(flat_bytes, flat_pre[:, k], 256)
            grads[f"x{d}"], grads[f"u{d}"], grads[f"c{d}"] = gx, gu, gc
        return loss, grads


def train(texts: list[bytes], labels: list[str], units: int = UNITS, epochs: int = EPOCHS, seed: int = SEED) -> Network:
    """A network fitted by Adam to pieces of text; classes are the different labels, in order. The same rows give the same network."""
    names = sorted(set(labels))
    net, r = Network(names, units, seed), np.random.default_rng(seed)
    data = np.zeros((TRAIN_BYTES, len(texts)), np.uint8)
    for i, t in enumerate(texts):
        cut = np.frombuffer(t[:TRAIN_BYTES], np.uint8)
        data[: len(cut), i] = cut
    weight, label, data = LETTER[data].astype(np.float32), np.array([names.index(x) for x in labels]), LOWER[data]
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    step, steps = 0, epochs * -(-len(texts) // BATCH)
    for _ in range(epochs):
        order = r.permutation(len(texts))
        for i in range(0, len(order), BATCH):
            own = order[i : i + BATCH]
            _, grads = net.gradients(data[:, own], weight[:, own], label[own])
            size = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
            step += 1
            rate = RATE * (1 - step / (steps + 1)) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for k, g in grads.items():
                g = g * min(1.0, 1.0 / max(size, 1e-9))
                m, v = moments[k]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                net.p[k] -= (rate * m / (np.sqrt(v) + 1e-8)).astype(np.float32)
    return net


def label_texts(net: Network, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Label probabilities of each text: the means over its letters' bytes. ``data`` has all texts' bytes, ``starts`` where each begins.

    Each text is cut into windows of ``WINDOW`` bytes, the last one shorter; every byte is labelled in one of them.
    """
    sizes = np.diff(starts)
    each = -(-sizes // WINDOW)
    doc = np.repeat(np.arange(len(sizes)), each)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(each) - each, each)
    first = starts[doc] + nth * WINDOW
    length = np.minimum(WINDOW, starts[doc + 1] - first)
    order = np.argsort(-length, kind="stable")  # windows of like lengths side by side
    out, letters = np.zeros((len(sizes), len(net.labels))), np.zeros(len(sizes))
    for i in range(0, len(order), SIDE_BY_SIDE):
        own = order[i : i + SIDE_BY_SIDE]
        steps = int(length[own[0]])
        at = first[own] + np.arange(steps)[:, None]
        inside = np.arange(steps)[:, None] < length[own]
        block = np.where(inside, data[np.minimum(at, len(data) - 1)], 0)
        counts = LETTER[block] & inside
        p = net.probabilities(LOWER[block], length[own])
        p *= counts
        np.add.at(out, doc[own], p.sum(1).T.astype(float))
        np.add.at(letters, doc[own], counts.sum(0))
    return out / np.maximum(letters, 1)[:, None]


def held_out_of(id_col: Column, parts: int = 5) -> Column:
    """Whether a row is kept from training: the CRC-32 of its id as text divides by ``parts``. A null id counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), F.lit(parts)) == 0


def sample(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE, most: int = SAMPLE) -> list[tuple[str, bytes]]:
    """(language, piece) of at most ``most`` labelled rows that aren't held out, languages in turn, at most ``per_language`` each.

    Rows come in the order of a hash of their id and piece; a row's piece starts at a place drawn from that hash.
    """
    text = F.col(f"`{text_col}`")
    rows = docs.where(F.col(f"`{lang_col}`").isNotNull() & text.rlike(r"\p{L}") & ~held_out_of(F.col(f"`{id_col}`")))
    start = F.pmod(F.xxhash64(F.col(f"`{id_col}`"), F.length(text)), F.greatest(F.lit(1), F.length(text) - PIECE_CHARS)) + 1
    pieces = rows.select(F.col(f"`{lang_col}`").alias("lang"), F.substring(text, start.cast("int"), F.lit(PIECE_CHARS)).alias("piece"), F.xxhash64(F.col(f"`{id_col}`"), F.lit(SEED)).alias("h"))
    # First within buckets of a language, which many tasks share, then among what they leave.
    first = lambda rows, *by: rows.withColumn("turn", F.row_number().over(Window.partitionBy("lang", *by).orderBy("h", "piece"))).where(F.col("turn") <= per_language)
    turn = first(first(pieces.withColumn("bucket", F.pmod("h", F.lit(BUCKETS))), "bucket"))
    return [(r["lang"], r["piece"].encode()) for r in turn.orderBy("turn", "lang").limit(most).collect()]


def identify(docs: DataFrame, net: Network | None, text_col: str = "text") -> DataFrame:
    """``row`` (the caller's columns), ``lang_pred`` and ``score``, the probability of that language.

    A text that is null or has no letter is ``und`` with score 0, as is every text without a network (nothing to learn
    from). Only the text is read. Very long texts are many windows; they are labelled whole.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            data, starts = flat(b.column(b.num_columns - 2))
            known = b.column(b.num_columns - 1).to_numpy(zero_copy_only=False)
            if net is None or not b.num_rows:
                pred, score = [UNKNOWN] * b.num_rows, np.zeros(b.num_rows)
            else:
                p = label_texts(net, data, starts)
                best = p.argmax(1)
                pred = [net.labels[i] if k else UNKNOWN for i, k in zip(best.tolist(), known.tolist(), strict=True)]
                score = np.where(known, np.clip(p[np.arange(len(p)), best], 0, 1), 0)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], pa.array(pred, pa.string()), pa.array(score)], [*names, "lang_pred", "score"])

    text = F.col(f"`{text_col}`")
    known = F.coalesce(text.rlike(r"\p{L}"), F.lit(False))
    source = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names, strict=True)], text.alias("_text"), known.alias("_known"))
    types = ", ".join(f"{n} {docs.schema[i].dataType.simpleString()}" for i, n in enumerate(names))
    out = source.mapInArrow(run, f"{types}, lang_pred string, score double")
    return out.select(F.struct(*[F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True)]).alias("row"), "lang_pred", "score")


def fit(docs: DataFrame, **columns: str) -> Network | None:
    """A network trained on ``sample``; None without a labelled row."""
    rows = sample(docs, **columns)
    return train([t for _, t in rows], [x for x, _ in rows]) if rows else None


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = identify(docs.select("doc_id", "text"), fit(docs))
    return out.select("row.doc_id", held_out_of(F.col("row.doc_id")).alias("held_out"), "lang_pred", "score")
