"""Line dedup: drop every line whose normalised form is found in too many documents.

Explode normalised lines, hash them, count documents per hash, drop lines over the threshold, reassemble by position.
A line's key is the line without white space at both ends, A-Z lower-cased; keys are told apart by 128-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, packed, row_keys, table, texts_of, unpacked

MIN_DOCS = 10
MIN_KEY_CHARS = 1


def _key_hash(line: bytes, min_chars: int) -> bytes | None:
    """16 bytes for a line's key, None for a key under ``min_chars`` code points."""
    key = line.strip().lower()  # bytes: ASCII white space and ASCII letters only
    if len(key) < min_chars or min_chars > 1 and len(key.decode("utf-8", "replace")) < min_chars:
        return None
    return hashlib.blake2b(key, digest_size=16).digest()


def frequent_lines(docs: DataFrame, min_docs: int, min_chars: int, text_col: str) -> DataFrame:
    """Column ``h``: the hashes of keys found in at least ``min_docs`` rows of ``docs``, each row counted once."""

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            seen: Counter = Counter()
            for text in texts_of(b.column(0)):
                hashes = {_key_hash(line, min_chars) for line in set(text.split(b"\n"))}
                hashes.discard(None)
                seen.update(hashes)
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["h", "n"])

    counted = docs.select(F.col(f"`{text_col}`").alias("text")).mapInArrow(count, "h binary, n long")
    return counted.groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= min_docs).select("h")


def dedup_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_KEY_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``row`` (the caller's columns), ``kept`` (the text left), ``n_lines`` and ``n_dropped``.

    Null and empty texts are one empty line, whose key has no code point and so stays. Each row counts as a document,
    repeated rows too. A document with all lines dropped keeps an empty text. Lines carry their position, so what
    stays keeps its order; the text itself is shuffled once, to meet the positions that go.
    """

    def explode(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            hashes, at, rows = [], [], []
            for i, text in enumerate(texts_of(b.column(2))):
                places: dict[bytes, list[int]] = {}
                for pos, line in enumerate(text.split(b"\n")):
                    if (h := _key_hash(line, min_chars)) is not None:
                        places.setdefault(h, []).append(pos)
                hashes += places.keys()
                at += places.values()
                rows += [i] * len(places)
            take = pa.array(rows, pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array(hashes, pa.binary()), pa.array(at, pa.list_(pa.int32()))], ["_k", "_k2", "h", "at"])

    # Written out: a join of two shuffles, so that Spark can split a line that very many documents hold, or broadcast few.
    bad = checkpointed(frequent_lines(docs, min_docs, min_chars, text_col))
    keyed = packed(docs).select("row", *row_keys(F.col("row")[id_col], F.col("row")[text_col]))
    lines = keyed.select("_k", "_k2", F.col("row")[text_col].alias("text")).mapInArrow(explode, "_k long, _k2 int, h binary, at array<int>")
    # Rows equal in id and text give equal places: collect_set keeps one of each, map side already.
    places = lines.join(bad, "h").groupBy("_k", "_k2").agg(F.flatten(F.collect_set("at")).alias("at"))
    split = F.split(F.coalesce(F.col("row")[text_col], F.lit("")), "\n", -1)
    joined = keyed.join(places, ["_k", "_k2"], "left").select("row", "at", split.alias("lines"))
    stays = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("at"))
    kept = F.when(F.col("at").isNull(), F.coalesce(F.col("row")[text_col], F.lit(""))).otherwise(
        F.array_join(F.transform(stays, lambda i: F.get(F.col("lines"), i)), "\n")
    )
    return joined.select("row", kept.alias("kept"), F.size("lines").cast("long").alias("n_lines"), F.coalesce(F.size("at"), F.lit(0)).cast("long").alias("n_dropped"))


def without_frequent_lines(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_KEY_CHARS, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with its own columns, the text cut (a null text stays null) and ``chars_col`` counted anew."""
    out = dedup_lines(docs, min_docs, min_chars, id_col, text_col)
    text = F.when(F.col("row")[text_col].isNotNull(), F.col("kept"))
    replaced = {text_col: text}
    if chars_col in docs.columns:
        replaced[chars_col] = F.when(F.col("n_dropped") > 0, F.length(text).cast("long")).otherwise(F.col("row")[chars_col]).cast(docs.schema[chars_col].dataType)
    return unpacked(out, docs.columns, replaced)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("row.doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
bad AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (k.key IN (SELECT key FROM bad))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (k.key NOT IN (SELECT key FROM bad)), '')) AS kept_sha256
FROM k GROUP BY doc_id
"""
