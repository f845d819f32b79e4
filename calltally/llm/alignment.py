"""Cross-tokenizer alignment: groups of tokens of two tokenizers that end at the same byte, and which ids go together.

Both tokenizers see a space and the text, and both break at every single space between two characters that aren't white
space: byte-level BPE because its pattern starts a new word there, the piece model because none of its pieces has a
space after another character (checked; else texts stay whole). Such stretches are *segments*; each ends a group, so a
chunk of documents encodes and aligns each different segment once and adds up by document.

A segment's two lists of token ends are intersected by galloping: every end of the shorter list searches the longer one
by exponential steps from the segment's first, then by halving. The common ends cut the tokens into groups; differences
of their ranks are the groups' ranges. A group of many tokens links different ids by their counts, so links of a text
without common ends cost as many steps as it has different id pairs.

The corpus count of an id pair (documents that hold it linked) is summed from one row per chunk and pair, and comes
back to the chunks by a join; the texts are read and encoded once.

Rows: each row counts as a document, repeated ones too, a null id is an id like any other. Texts that are null, empty
or whose pieces don't give back the text (it holds U+2581, say) have no tokens: zeros and an empty digest. A chunk holds
``CHUNK_BYTES`` of texts, or one longer text, whole. Only the id and the text are read, so other columns can't clash. An
empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, table

BYTE_VOCABULARY = "byte_bpe_50k.tiktoken"  # the ranks of byte_bpe_50k.json; added tokens are plain text here
PIECE_MODEL = "piece_bpe_32k.model"
#: Bytes of texts that are aligned at once.
CHUNK_BYTES = 8 << 20
#: Segments that are encoded in a row.
ROW_WORDS = 200
#: A group with more links than this is linked by its different ids and their counts.
MANY_LINKS = 256
#: A single space between characters that aren't white space.
SAFE = re.compile(r"(?<=\S) (?=\S)")


class Pair:
    """The two tokenizers: ids of segments, and each id's bytes."""

    def __init__(self, byte_vocabulary: str, piece_model: str):
        import public_tokenizers
        import sentencepiece
        import tiktoken

        with open(public_tokenizers.path(byte_vocabulary), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        from .packing import PATTERN

        self.a = tiktoken.Encoding(byte_vocabulary, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(piece_model))
        self.a_len = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            self.a_len[i] = len(token)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.b_len = np.array([len(x) for x in self.b_bytes], np.int64)
        ids = range(max(len(self.a_len), len(pieces)))
        with_sign = [np.array([b"%d%s" % (i, sign) for i in ids], object) for sign in (b",", b"|", b";")]
        self.names = with_sign[0], np.array([len(x) for x in with_sign[0]], np.int64), *with_sign[1:]
        self.splits = not any(re.search("[^▁]▁", p) for p in pieces)

    def segments(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Different segments (each stands after a space), whether each has to be encoded alone, all segments' numbers in order, and where each text starts in them."""
        if not self.splits:
            coded = texts.dictionary_encode()
            return coded.dictionary.to_pylist(), np.ones(len(coded.dictionary), bool), coded.indices.to_numpy(), np.arange(len(texts) + 1)
        lists = pc.split_pattern(texts, " ")
        coded, starts = lists.flatten().dictionary_encode(), lists.offsets.to_numpy()
        codes, words, starts = coded.indices.to_numpy(), coded.dictionary.to_pylist(), starts - starts[0]
        odd = _odd(coded.dictionary)
        if odd.any():  # spaces in a row or beside other white space: these texts are cut with care
            known = {w: i for i, w in enumerate(words)}
            parts = []
            for i, odd_text in enumerate(np.logical_or.reduceat(odd[codes], starts[:-1])):
                if odd_text:
                    parts.append(np.array([known.setdefault(s, len(known)) for s in SAFE.split(texts[i].as_py())], np.int64))
                else:
                    parts.append(codes[starts[i] : starts[i + 1]])
            starts = np.append(0, np.cumsum([len(p) for p in parts]))
            used, codes = np.unique(np.concatenate(parts), return_inverse=True)
            words = list(known)
            words = [words[i] for i in used.tolist()]
            odd = _odd(pa.array(words, pa.large_string()))
        return words, odd, codes, starts

    def encode(self, segments: list[str], alone: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids and starts of both tokenizers for each segment, and whether its pieces give its bytes back; those that don't are empty.

        Segments that may stand in a row are encoded in rows, which break where they meet; the others one by one.
        """
        row, rest = np.flatnonzero(~alone), np.flatnonzero(alone)
        words = [segments[i] for i in row.tolist()]
        rows = [" ".join(words[i : i + ROW_WORDS]) for i in range(0, len(words), ROW_WORDS)]
        text, b = " ".join(rows), [i for ids in self.b.encode(rows, num_threads=1) for i in ids] if rows else []
        if b"".join(map(self.b_bytes.__getitem__, b)) != (b" " + text.encode()) * bool(len(row)):
            row, rest, text, b = row[:0], np.arange(len(segments)), "", []
        lists = [segments[i] for i in rest.tolist()]
        rest_b = self.b.encode(lists, num_threads=1) if lists else []
        joined = [b"".join(map(self.b_bytes.__getitem__, ids)) for ids in rest_b]
        fits = np.fromiter((j == b" " + s.encode() for j, s in zip(joined, lists, strict=True)), bool, len(lists))
        rest_a = [self.a.encode_ordinary(" " + s) if ok else [] for s, ok in zip(lists, fits, strict=True)]
        rest_b = [ids if ok else [] for ids, ok in zip(rest_b, fits, strict=True)]
        good = np.ones(len(segments), bool)
        good[rest] = fits
        if not len(row):
            return *_csr(rest_a), *_csr(rest_b), good
        a = self.a.encode_to_numpy(" " + text).astype(np.int64)
        ends = np.cumsum(np.fromiter((len(w.encode()) + 1 for w in words), np.int64, len(row)))
        place = np.argsort(np.concatenate([row, rest]), kind="stable")
        out = []
        for ids, length, more in ((a, self.a_len, rest_a), (np.array(b, np.int64), self.b_len, rest_b)):
            more_ids, more_starts = _csr(more)
            starts = np.append(np.append(0, np.searchsorted(np.cumsum(length[ids]), ends) + 1), len(ids) + more_starts[1:])
            each = np.diff(starts)[place]
            out += [np.append(ids, more_ids)[_ranges(starts[:-1][place], each)], np.append(0, np.cumsum(each))]
        return *out, good


def _odd(segments: pa.Array) -> np.ndarray:
    """Which segments may not stand beside others: empty ones, with white space at an end, or that pieces wouldn't give back."""
    changed = pc.not_equal(pc.utf8_trim_whitespace(segments), segments)
    return pc.or_(pc.or_(changed, pc.equal(segments, "")), pc.match_substring(segments, "▁")).to_numpy(zero_copy_only=False)


@lru_cache(maxsize=2)
def pair_of(byte_vocabulary: str, piece_model: str) -> Pair:
    return Pair(byte_vocabulary, piece_model)


def _csr(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    starts = np.append(0, np.cumsum(np.fromiter(map(len, lists), np.int64, len(lists))))
    return np.fromiter((x for ids in lists for x in ids), np.int64, int(starts[-1])), starts


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of every range, one after another."""
    ends = np.cumsum(lengths)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - ends + lengths, lengths)


def gallop(keys: np.ndarray, first: np.ndarray, last: np.ndarray, values: np.ndarray) -> np.ndarray:
    """For each key the first index in ``first .. last`` whose value is no less (``last`` is known to be one).

    ``values`` ascend within each range. Steps double from the range's start until a value is no less; then the last
    step is halved. All keys go side by side, those that have found theirs drop out.
    """
    low, high, step = first.copy(), first.copy(), np.ones(len(keys), np.int64)
    going = np.flatnonzero(values[high] < keys)
    while len(going):
        low[going] = high[going] + 1
        high[going] = np.minimum(first[going] + step[going], last[going])
        step[going] *= 2
        going = going[values[high[going]] < keys[going]]
    going = np.flatnonzero(low < high)
    while len(going):
        mid = (low[going] + high[going]) // 2
        less = values[mid] < keys[going]
        low[going[less]], high[going[~less]] = mid[less] + 1, mid[~less]
        going = going[low[going] < high[going]]
    return low


def common_ends(a_ends: np.ndarray, a_starts: np.ndarray, b_ends: np.ndarray, b_starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices in both lists of the ends they share, segment by segment; the shorter list of a segment drives."""
    n_a, n_b = np.diff(a_starts), np.diff(b_starts)
    found = []
    for drives, short, short_starts, long, long_starts in ((n_a <= n_b, a_ends, a_starts, b_ends, b_starts), (n_a > n_b, b_ends, b_starts, a_ends, a_starts)):
        seg = np.flatnonzero(drives & (n_a > 0))
        each = np.diff(short_starts)[seg]
        at = _ranges(short_starts[seg], each)
        to = gallop(short[at], np.repeat(long_starts[seg], each), np.repeat(long_starts[seg + 1] - 1, each), long)
        same = long[to] == short[at]
        found.append((at[same], to[same]))
    ia, ib = np.concatenate([found[0][0], found[1][1]]), np.concatenate([found[0][1], found[1][0]])
    order = np.argsort(ia, kind="stable")
    return ia[order], ib[order]


class Aligned:
    """Segments with their groups; ``seg_pair``: for each segment and different id pair in it, the number of links."""

    def __init__(self, tokenizers: Pair, segments: list[str], alone: np.ndarray):
        self.a, self.a_starts, self.b, self.b_starts, self.good = tokenizers.encode(segments, alone)
        a_ends, b_ends = np.cumsum(tokenizers.a_len[self.a]), np.cumsum(tokenizers.b_len[self.b])
        self.ia, self.ib = common_ends(a_ends, self.a_starts, b_ends, self.b_starts)
        self.ends = a_ends[self.ia]
        self.a_first, self.b_first = np.append(0, self.ia[:-1] + 1), np.append(0, self.ib[:-1] + 1)
        self.n_a, self.n_b = self.ia + 1 - self.a_first, self.ib + 1 - self.b_first
        self.group_starts = np.searchsorted(self.ia, self.a_starts)  # a segment's first group
        self.n_groups = np.diff(self.group_starts)
        links = np.append(0, np.cumsum(self.n_a * self.n_b))
        self.n_links = links[self.group_starts[1:]] - links[self.group_starts[:-1]]

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Different pairs (a id << 32 | b id), and for each segment and pair in it: segment, pair's number, links."""
        of_group = np.repeat(np.arange(len(self.n_groups)), self.n_groups)
        few = np.flatnonzero(self.n_a * self.n_b <= MANY_LINKS)
        at_a = _ranges(self.a_first[few], self.n_a[few])
        group = np.repeat(few, self.n_a[few])
        at_b = _ranges(self.b_first[group], self.n_b[group])
        keys, segs = [np.repeat(self.a[at_a], self.n_b[group]) << 32 | self.b[at_b]], [np.repeat(of_group[group], self.n_b[group])]
        links = [np.ones(len(keys[0]), np.int64)]
        for g in np.flatnonzero(self.n_a * self.n_b > MANY_LINKS).tolist():
            a, n = np.unique(self.a[self.a_first[g] : self.ia[g] + 1], return_counts=True)
            b, m = np.unique(self.b[self.b_first[g] : self.ib[g] + 1], return_counts=True)
            keys.append((a[:, None] << 32 | b[None, :]).ravel())
            links.append((n[:, None] * m[None, :]).ravel())
            segs.append(np.full(len(keys[-1]), of_group[g]))
        pairs, number = np.unique(np.concatenate(keys), return_inverse=True)
        both, inverse = np.unique(np.concatenate(segs) * max(1, len(pairs)) + number, return_inverse=True)
        total = np.zeros(len(both), np.int64)
        np.add.at(total, inverse, np.concatenate(links))
        return pairs, both // max(1, len(pairs)), both % max(1, len(pairs)), total

    def written(self, names: tuple[np.ndarray, ...]) -> list[bytes]:
        """Each segment's groups as ``a1,a2|b1;a3|b2,b3``, and a last ``;``. ``names``: of each id in decimal."""
        at = np.cumsum(self.n_a + self.n_b)  # tokens in the order they are written
        out, size = np.empty(len(self.a) + len(self.b), object), np.zeros(len(self.a) + len(self.b), np.int64)
        bar = at - self.n_b - 1
        a_at = _ranges(bar - self.n_a + 1, self.n_a)
        b_at = _ranges(bar + 1, self.n_b)
        for ids, places in ((self.a, a_at), (self.b, b_at)):
            out[places], size[places] = names[0][ids], names[1][ids]
        out[bar], out[at - 1] = names[2][self.a[self.ia]], names[3][self.b[self.ib]]
        text, ends = b"".join(out.tolist()), np.append(0, np.cumsum(size))
        tokens = np.append(0, at)[self.group_starts]
        cuts = ends[tokens].tolist()
        return [text[i:j] for i, j in zip(cuts, cuts[1:])]


def _lots(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows with ``most`` bytes together, or one row."""
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if sizes:
        yield start, len(sizes)


def _texts(column: pa.Array) -> pa.Array:
    return column.cast(pa.large_string()).fill_null("")


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    total = np.append(0, np.cumsum(values))
    return total[starts[1:]] - total[starts[:-1]]


def _chunk(tokenizers: Pair, texts: pa.Array) -> dict:
    """One chunk: figures of each document, the chunk's pairs and how many documents hold each, and each document's links."""
    words, alone, codes, starts = tokenizers.segments(texts)
    al = Aligned(tokenizers, words, alone)
    n_docs, n_words = len(texts), max(1, len(words))
    sound = pc.greater(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False) & np.logical_and.reduceat(al.good[codes], starts[:-1])
    here = sound.astype(np.int64)
    written = al.written(tokenizers.names)
    digests = [hashlib.sha256(b"".join([written[c] for c in codes[starts[i] : starts[i + 1]].tolist()])[:-1]).hexdigest() if sound[i] else "" for i in range(n_docs)]
    figures = {k: _sums(x[codes], starts) * here for k, x in (("n_a", np.diff(al.a_starts)), ("n_b", np.diff(al.b_starts)), ("n_groups", al.n_groups), ("n_links", al.n_links))}

    pairs, seg, number, links = al.pairs()
    seg_starts = np.searchsorted(seg, np.arange(len(words) + 1))
    of_doc = np.repeat(np.arange(n_docs), np.diff(starts))
    mine = sound[of_doc]
    uses, times = np.unique(of_doc[mine] * n_words + codes[mine], return_counts=True)
    word = uses % n_words
    each = np.diff(seg_starts)[word]
    at = _ranges(seg_starts[word], each)
    held, inverse = np.unique(np.repeat(uses // n_words, each) * max(1, len(pairs)) + number[at], return_inverse=True)
    total = np.zeros(len(held), np.int64)
    np.add.at(total, inverse, np.repeat(times, each) * links[at])
    doc, pair = held // max(1, len(pairs)), held % max(1, len(pairs))
    in_docs = np.bincount(pair, minlength=len(pairs))
    keep = np.flatnonzero(in_docs)  # pairs of unsound documents only aren't linked anywhere
    renumbered = np.cumsum(in_docs > 0) - 1
    per_doc = np.bincount(doc, minlength=n_docs).astype("<u4")
    return figures | {"sha": digests, "pairs": pairs[keep], "in_docs": in_docs[keep], "held": _packed(per_doc, renumbered[pair].astype("<u4"), total)}


def _packed(per_doc: np.ndarray, pair: np.ndarray, links: np.ndarray) -> bytes:
    """Differences of each document's ascending pair numbers and their links, compressed."""
    step = np.diff(pair.astype(np.int64), prepend=0)
    first = np.append(0, np.cumsum(per_doc, dtype=np.int64))[:-1][per_doc > 0]
    step[first] = pair[first]
    raw = b"".join(np.array([len(x)], "<u4").tobytes() + x for x in (pa.compress(v, "zstd", asbytes=True) for v in (per_doc.tobytes(), step.astype("<u4").tobytes(), links.astype("<u8").tobytes())))
    return np.array([len(per_doc), len(pair)], "<u4").tobytes() + raw


def _unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of each document, pair numbers, links."""
    n_docs, n = np.frombuffer(data, "<u4", 2).tolist()
    out, at = [], 8
    for size, kind in ((n_docs, "<u4"), (n, "<u4"), (n, "<u8")):
        length = int(np.frombuffer(data, "<u4", 1, at)[0])
        out.append(np.frombuffer(pa.decompress(data[at + 4 : at + 4 + length], size * int(kind[2]), "zstd", asbytes=True), kind).astype(np.int64))
        at += 4 + length
    starts = np.append(0, np.cumsum(out[0]))
    total = np.cumsum(out[1])
    per_doc = np.diff(starts)
    base = np.where(starts[:-1] > 0, total[starts[:-1] - 1], 0) if n else np.zeros(n_docs, np.int64)
    return starts, total - np.repeat(base, per_doc), out[2]


FIGURES = ("n_a", "n_b", "n_groups", "n_links")


def align_documents(docs: DataFrame, byte_vocabulary: str = BYTE_VOCABULARY, piece_model: str = PIECE_MODEL, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row per document: tokens of both, groups, links, best links, the counts' sum over links and the groups' digest.

    Columns: ``doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256``. See ``token_groups`` for the groups.
    """
    id_type = docs.schema[id_col].dataType.simpleString()

    def chunks(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizers = pair_of(byte_vocabulary, piece_model)
        for b in parts:
            texts = _texts(b.column(1))
            for i, j in _lots(pc.binary_length(texts).to_pylist(), chunk_bytes):
                c = _chunk(tokenizers, texts[i:j])
                one = lambda x, kind=None: pa.array([x], pa.list_(kind))
                ids = pa.ListArray.from_arrays(pa.array([0, j - i], pa.int32()), b.column(0).slice(i, j - i))
                columns = [ids, *[one(c[k], pa.int64()) for k in FIGURES], one(c["sha"], pa.string()), one(c["pairs"], pa.int64()), one(c["in_docs"], pa.int64()), pa.array([c["held"]], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["ids", *FIGURES, "sha", "pairs", "in_docs", "held"])

    def answer(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            for r in range(b.num_rows):
                ids, sha = b.column("ids")[r].values, b.column("sha")[r].values
                figures = [b.column(k)[r].values for k in FIGURES]
                starts, pair, links = _unpacked(b.column("held")[r].as_py())
                got = b.column("told")[r].values
                if got is None or not len(got):
                    best = total = np.zeros(len(ids), np.int64)
                else:
                    order = np.argsort(got.field("k").to_numpy())
                    n, top = got.field("n").to_numpy()[order], got.field("top").to_numpy()[order]
                    best, total = _sums(links * (n == top)[pair], starts), _sums(links * n[pair], starts)
                yield pa.RecordBatch.from_arrays([ids, *figures, pa.array(best), pa.array(total), sha], ["doc_id", *FIGURES, "n_best", "count_sum", "groups_sha256"])

    figures = ", ".join(f"{k} array<long>" for k in FIGURES)
    source = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    made = source.mapInArrow(chunks, f"ids array<{id_type}>, {figures}, sha array<string>, pairs array<long>, in_docs array<long>, held binary")
    made = checkpointed(made.withColumn("chunk", F.monotonically_increasing_id()))  # read twice: the texts are encoded once
    asked = made.select("chunk", F.posexplode(F.arrays_zip("pairs", "in_docs")).alias("k", "p")).select("chunk", "k", F.col("p.pairs").alias("pair"), F.col("p.in_docs").alias("n"))
    counts = checkpointed(asked.groupBy("pair").agg(F.sum("n").alias("n")))  # one row an id pair
    top = counts.groupBy(F.shiftright("pair", 32).alias("a")).agg(F.max("n").alias("top"))
    known = counts.withColumn("a", F.shiftright("pair", 32)).join(top, "a").select("pair", "n", "top")
    told = asked.select("chunk", "k", "pair").join(known, "pair").groupBy("chunk").agg(F.collect_list(F.struct("k", "n", "top")).alias("told"))
    joined = made.select("chunk", "ids", *FIGURES, "sha", "held").join(told, "chunk", "left")
    longs = ", ".join(f"{k} long" for k in (*FIGURES, "n_best", "count_sum"))
    return joined.mapInArrow(answer, f"doc_id {id_type}, {longs}, groups_sha256 string")


def token_groups(docs: DataFrame, byte_vocabulary: str = BYTE_VOCABULARY, piece_model: str = PIECE_MODEL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The groups themselves: ``doc_id``, ``start`` and ``stop`` (bytes in space + text), ``a`` and ``b`` (ids). No rows without tokens."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizers = pair_of(byte_vocabulary, piece_model)
        for b in parts:
            texts = _texts(b.column(1))
            sizes = pc.binary_length(texts).to_pylist()
            for i, j in _lots(sizes, CHUNK_BYTES):
                words, alone, codes, starts = tokenizers.segments(texts[i:j])
                al = Aligned(tokenizers, words, alone)
                for d in range(j - i):
                    mine = codes[starts[d] : starts[d + 1]]
                    if not sizes[i + d] or not al.good[mine].all():
                        continue
                    g = _ranges(al.group_starts[mine], al.n_groups[mine])
                    size = al.ends[g] - np.where(g > 0, al.ends[g - 1], 0)
                    stop = np.cumsum(size)
                    lists = [pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n[g])), pa.int32()), pa.array(ids[_ranges(first[g], n[g])], pa.int32())) for ids, first, n in ((al.a, al.a_first, al.n_a), (al.b, al.b_first, al.n_b))]
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(np.full(len(g), i + d))), pa.array(stop - size), pa.array(stop), *lists], ["doc_id", "start", "stop", "a", "b"])

    source = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return source.mapInArrow(run, f"doc_id {id_type}, start long, stop long, a array<int>, b array<int>")


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_documents(table(spark, sf_dir, "documents"))
