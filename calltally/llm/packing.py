"""Vector bin packing of token sequences under limits on tokens, segments and loss-bearing tokens.

Of every stretch of as many tokens as a sequence takes, or of a document's last shorter one, the first are context and
bear no loss: a quarter of them, at most ``MAX_LEAD`` tokens. Bins are filled one after another: of the pieces that fit
whole, the one with the largest weighted dot product of its demand and the bin's room goes in. Where none fits whole,
the piece with the longest prefix within the room is cut. What is left in bins that can't be filled goes out in
sequences of power-of-two lengths, which need no padding.

Rows are encoded and packed in one pass over a table, in lots of bounded size. There is no shuffle and no group, so a
row that is there a million times is dealt with as it comes. A lot's packing depends on its rows and their order: tables
and checkpoints give the same again when a task is run again.
"""

from __future__ import annotations

import base64
import heapq
import json
import os
import zlib
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

MAX_TOKENS = 2048
MAX_SEGMENTS = 64
MAX_LOSS_TOKENS = 1792
#: The context at the start of a stretch: one token in so many, and no more than so many.
LEAD_SHARE, MAX_LEAD = 4, 256
END_ID = 1
VOCABULARY = "byte_bpe_50k.tiktoken"  # the ranks of byte_bpe_50k.json, whose ids they equal
#: The pattern of that vocabulary with possessive repeats: the same matches, found faster.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
#: Tokens that are packed at once (or one document, if longer).
LOT_TOKENS = 1 << 21


@lru_cache(maxsize=2)
def encoder(vocabulary: str, pattern: str = PATTERN) -> Callable[[str], np.ndarray]:
    """``text -> ids``; strings of the added tokens that the vocabulary's JSON names become their ids, as in that tokenizer."""
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(vocabulary), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    added = {}
    if os.path.exists(named := os.path.splitext(public_tokenizers.path(vocabulary))[0] + ".json"):
        with open(named, encoding="utf-8") as f:
            added = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
    encoding, allowed = tiktoken.Encoding(vocabulary, pat_str=pattern, mergeable_ranks=ranks, special_tokens=added), set(added)
    return lambda text: encoding.encode_to_numpy(text, allowed_special=allowed, disallowed_special=())


def _encoded(texts: Iterable[str | None], vocabulary: str, end_id: int) -> Iterator[np.ndarray]:
    encode = encoder(vocabulary)
    for text in texts:
        yield np.append(encode(text or ""), end_id).astype("<u4")


def tokenize(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, end_id: int = END_ID) -> DataFrame:
    """``doc_id`` and ``ids``: little-endian 32-bit ids of the text, then ``end_id``. A null text is an empty one."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            ids = [x.tobytes() for x in _encoded((t.as_py() for t in b.column(1)), vocabulary, end_id)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.large_binary()).cast(pa.binary())], ["doc_id", "ids"])

    source = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, ids binary")


def powers(length: int, limit: int) -> list[int]:
    """Lengths that sum to ``length``: ``limit`` as often as it fits, then powers of two, largest first."""
    out = [limit] * (length // limit)
    rest = length % limit
    return out + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


class _Pool:
    """What is left of the items, by (tokens, loss-bearing tokens): one entry for all items alike, lowest item first.

    Items of few tokens differ in few ways and there are few of many tokens, so a lot has some thousand entries at most.
    """

    def __init__(self, tokens: np.ndarray, loss: np.ndarray, items: np.ndarray):
        self.items: dict[tuple[int, int], list[int]] = {}
        for i, key in zip(items.tolist(), zip(tokens.tolist(), loss.tolist(), strict=True), strict=True):
            self.items.setdefault(key, []).append(i)  # in order, so each list is a heap
        keys = np.array(sorted(self.items), np.int64).reshape(-1, 2)
        self.tokens, self.loss = keys[:, 0].copy(), keys[:, 1].copy()
        self.n, self.sums = len(items), np.array([tokens.sum(), len(items), loss.sum()], float)

    def _place(self, tokens: int, loss: int) -> int:
        a, b = np.searchsorted(self.tokens, [tokens, tokens + 1])
        return int(a + np.searchsorted(self.loss[a:b], loss))

    def take(self, at: int) -> int:
        key = (int(self.tokens[at]), int(self.loss[at]))
        item = heapq.heappop(self.items[key])
        if not self.items[key]:
            del self.items[key]
            self.tokens, self.loss = np.delete(self.tokens, at), np.delete(self.loss, at)
        self.n -= 1
        self.sums -= (key[0], 1, key[1])
        return item

    def put(self, item: int, tokens: int, loss: int) -> None:
        own = self.items.setdefault((tokens, loss), [])
        if not own:
            at = self._place(tokens, loss)
            self.tokens, self.loss = np.insert(self.tokens, at, tokens), np.insert(self.loss, at, loss)
        heapq.heappush(own, item)
        self.n += 1
        self.sums += (tokens, 1, loss)


def fill(sizes: list[int], no_loss: list[int], max_tokens: int, max_segments: int, max_loss: int) -> list[list[tuple[int, int, int]]]:
    """Sequences of pieces (item, start, length); item ``i`` has ``sizes[i]`` tokens, the first ``no_loss[i]`` without loss.

    Equal dot products: the piece of more tokens, then of more loss-bearing ones, then the first item. An item is in a
    bin once at most. Weights are the mean demands of what is left over the limits, so the scarcer a resource the more
    it counts.
    """
    sequences: list[list[tuple[int, int, int]]] = []
    n = np.asarray(sizes, np.int64)
    lead = np.minimum(np.asarray(no_loss, np.int64), n)
    start = np.zeros(len(n), np.int64)
    for i in np.flatnonzero(n >= max_tokens).tolist():  # whole sequences of one document
        while n[i] - start[i] >= max_tokens and max(0, lead[i] - start[i]) + max_loss >= max_tokens:
            sequences.append([(i, int(start[i]), max_tokens)])
            start[i] += max_tokens
    items = np.flatnonzero(start < n)
    pool = _Pool((n - start)[items], (n - np.maximum(start, lead))[items], items)
    scale = np.array([max_tokens, max_segments, max_loss], float)
    while pool.n:
        room, pieces, later = [max_tokens, max_segments, max_loss], [], []
        weight = pool.sums / pool.n / scale**3
        while room[0] > 0 and room[1] > 0 and pool.n:
            t, loss = pool.tokens, pool.loss
            value = np.where((t <= room[0]) & (loss <= room[2]), t * (weight[0] * room[0]) + loss * (weight[2] * room[2]), -1.0)
            at = len(value) - 1 - int(np.argmax(value[::-1]))
            take = int(t[at])
            if value[at] < 0:  # none fits whole
                longest = np.minimum(np.minimum(t, room[0]), t - loss + room[2])
                at = len(longest) - 1 - int(np.argmax(longest[::-1]))
                take = int(longest[at])
                if take == 0:
                    break
            left, bearing = int(t[at]), int(loss[at])
            i = pool.take(at)
            pieces.append((i, int(start[i]), take))
            start[i] += take
            left -= take
            if left:
                later.append((i, left, min(left, bearing)))
            room = [room[0] - take, room[1] - 1, room[2] - (bearing - min(left, bearing))]
        for x in later:
            pool.put(*x)
        sequences.append(pieces)
    return sequences


def unpadded(pieces: list[tuple[int, int, int]], max_tokens: int) -> list[list[tuple[int, int, int]]]:
    """A bin that isn't full, as sequences of power-of-two lengths."""
    total = sum(p[2] for p in pieces)
    if total == max_tokens or total & (total - 1) == 0:
        return [pieces]
    out, rest = [], list(reversed(pieces))
    for length in powers(total, max_tokens):
        now = []
        while length:
            i, start, size = rest.pop()
            if size > length:
                rest.append((i, start + length, size - length))
                size = length
            now.append((i, start, size))
            length -= size
        out.append(now)
    return out


Lot = tuple[pa.Array, list[np.ndarray], list[int | None]]  # ids of rows, their tokens, their prompts' tokens


def _lots(parts: Iterator[tuple[pa.Array, Iterable[tuple[np.ndarray, int | None]]]]) -> Iterator[Lot]:
    who, ids, lead, size = [], [], [], 0
    for doc_ids, rows in parts:
        first = 0
        for i, (tokens, prompt) in enumerate(rows):
            ids.append(tokens)
            lead.append(prompt)
            size += len(tokens)
            if size >= LOT_TOKENS:
                yield pa.concat_arrays([*who, doc_ids.slice(first, i + 1 - first)]), ids, lead
                who, ids, lead, size, first = [], [], [], 0, i + 1
        who.append(doc_ids.slice(first))
    if ids:
        yield pa.concat_arrays(who), ids, lead


def stretches(n_tokens: int, prompt: int | None, max_tokens: int) -> list[tuple[int, int, int]]:
    """(start, length, tokens without loss) of what is packed of a row: with a prompt the row as a whole."""
    if prompt is not None:
        return [(0, n_tokens, prompt)]
    cuts = [*range(0, n_tokens, max_tokens), n_tokens]
    return [(a, b - a, min(MAX_LEAD, (b - a) // LEAD_SHARE)) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _pack_lots(lots: Iterator[Lot], max_tokens: int, max_segments: int, max_loss: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    sequence = TaskContext.get().partitionId() << 32
    for doc_ids, ids, lead in lots:
        items = [(d, *x) for d, (tokens, prompt) in enumerate(zip(ids, lead, strict=True)) for x in stretches(len(tokens), prompt, max_tokens)]
        bins = fill([n for _, _, n, _ in items], [quiet for *_, quiet in items], max_tokens, max_segments, max_loss)
        who, cols, blobs = [], [], []
        for pieces in (q for b in bins for q in unpadded(b, max_tokens)):
            offset = 0
            for i, start, size in pieces:
                d, first, _, quiet = items[i]
                own = ids[d][first + start : first + start + size]
                who.append(d)
                cols.append((first + start, size, zlib.crc32(own), len(ids[d]), sequence, offset, max(0, min(size, quiet - start))))
                blobs.append(own.tobytes() if with_ids else None)
                offset += size
            sequence += 1
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "no_loss"]
        columns = [doc_ids.take(pa.array(who, pa.int64())), *map(pa.array, np.array(cols, np.int64).reshape(-1, 7).T.copy())]
        yield pa.RecordBatch.from_arrays(columns + ([pa.array(blobs, pa.binary())] if with_ids else []), names + ["ids"] * with_ids)


def _schema(id_type: str, with_ids: bool) -> str:
    return f"doc_id {id_type}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, no_loss long" + ", ids binary" * with_ids


def pack(tokens: DataFrame, max_tokens: int = MAX_TOKENS, max_segments: int = MAX_SEGMENTS, max_loss: int = MAX_LOSS_TOKENS, lead_col: str | None = None, with_ids: bool = False) -> DataFrame:
    """Pieces of the ``ids`` of ``tokens`` (see ``tokenize``): each id lies in exactly one piece.

    ``lead_col``: the tokens at a row's start that bear no loss (a prompt; null: none); without it, those that begin
    each stretch (see above). Rows without ids give no piece. ``sequence_id`` numbers the sequences
    (partition in the upper 32 bits), ``offset`` is the piece's place in its sequence, gapless from 0, ``no_loss`` the
    tokens at the piece's start that bear no loss. Rows equal in id and ids are packed one by one.
    """
    lead = F.coalesce(F.col(lead_col), F.lit(0)).cast("long") if lead_col else F.lit(-1).cast("long")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, int | None]]:
            for blob, no_loss in zip(b.column(1), b.column(2).to_pylist(), strict=True):
                ids = np.frombuffer(blob.as_py() or b"", "<u4")
                yield ids, None if no_loss < 0 else no_loss

        return _pack_lots(_lots((b.column(0), rows(b)) for b in parts), max_tokens, max_segments, max_loss, with_ids)

    return tokens.select("doc_id", "ids", lead).mapInArrow(run, _schema(tokens.schema["doc_id"].dataType.simpleString(), with_ids))


def pack_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, end_id: int = END_ID,
    max_tokens: int = MAX_TOKENS, max_segments: int = MAX_SEGMENTS, max_loss: int = MAX_LOSS_TOKENS, with_ids: bool = False,
) -> DataFrame:
    """Tokenise and pack whole texts in one pass; a null text is an empty one, which is ``end_id`` alone."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, None]]:
            for ids in _encoded((t.as_py() for t in b.column(1)), vocabulary, end_id):
                yield ids, None

        return _pack_lots(_lots((b.column(0), rows(b)) for b in parts), max_tokens, max_segments, max_loss, with_ids)

    source = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return source.mapInArrow(run, _schema(source.schema["doc_id"].dataType.simpleString(), with_ids))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
