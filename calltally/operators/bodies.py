"""Request bodies of three provider shapes, as JSON text: what of them is billed, and tool results trimmed in place."""

from __future__ import annotations

import json
from collections.abc import Iterator
from json.decoder import JSONDecoder, scanstring

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import let, token_estimate
from .whatif import MAX_CHARS, trim_output

_decode = JSONDecoder().raw_decode
_SPACE = " \t\n\r"


def _skip(s: str, i: int) -> int:
    while s[i] in _SPACE:
        i += 1
    return i


def _members(s: str, i: int) -> dict[str, tuple[int, int]]:
    """Where the values of the object that opens at ``i`` start and stop; of equal keys the last, as parsers have it."""
    out, i = {}, _skip(s, i + 1)
    while s[i] != "}":
        key, i = scanstring(s, i + 1)
        start = _skip(s, _skip(s, i) + 1)
        stop = _decode(s, start)[1]
        out[key] = start, stop
        i = _skip(s, stop)
        i = _skip(s, i + 1) if s[i] == "," else i
    return out


def _items(s: str, i: int) -> Iterator[int]:
    """Where the items of the array that opens at ``i`` start."""
    i = _skip(s, i + 1)
    while s[i] != "]":
        yield i
        i = _skip(s, _decode(s, i)[1])
        i = _skip(s, i + 1) if s[i] == "," else i


def _objects(s: str, at: dict[str, tuple[int, int]], key: str) -> Iterator[dict[str, tuple[int, int]]]:
    """The objects in the array at ``key``, if it is one."""
    if key in at and s[at[key][0]] == "[":
        for i in _items(s, at[key][0]):
            if s[i] == "{":
                yield _members(s, i)


def _is(s: str, at: dict[str, tuple[int, int]], key: str, word: str) -> bool:
    return key in at and s[at[key][0]] == '"' and scanstring(s, at[key][0] + 1)[0] == word


def tool_result_spans(body: str | None, provider: str | None) -> list[tuple[int, int, str]]:
    """(start, stop, text) of the string literals that hold tool output; none where a body isn't an object."""
    out: list[tuple[int, int, str]] = []

    def take(span: tuple[int, int] | None) -> bool:
        if span and body[span[0]] == '"':
            out.append((*span, scanstring(body, span[0] + 1)[0]))
        return bool(span and body[span[0]] == '"')

    try:
        start = _skip(body, 0)
        if body[start] != "{" or _skip(body + "}", _decode(body, start)[1]) < len(body):
            return []
        top = _members(body, start)
        if provider == "google":
            for content in _objects(body, top, "contents"):
                for part in _objects(body, content, "parts"):
                    reply = part.get("functionResponse")
                    inner = _members(body, reply[0]).get("response") if reply and body[reply[0]] == "{" else None
                    if inner and body[inner[0]] == "{":
                        for span in _members(body, inner[0]).values():
                            take(span)
            return sorted(out)
        for message in _objects(body, top, "messages"):
            if _is(body, message, "role", "tool"):
                take(message.get("content"))
            for block in _objects(body, message, "content"):
                if _is(body, block, "type", "tool_result") and not take(block.get("content")):
                    for sub in _objects(body, block, "content"):
                        take(sub.get("text"))
        return sorted(out)
    except (ValueError, IndexError, TypeError, RecursionError):
        return []


def _texts(items) -> list[str]:
    return [x["text"] for x in items if isinstance(x, dict) and isinstance(x.get("text"), str)] if isinstance(items, list) else []


def _content(x) -> list[str]:
    return [x] if isinstance(x, str) else _texts(x)


def billed_texts(body: str | None, provider: str | None) -> list[str]:
    """Every text of a body that is billed as input: of all roles, tool results, and tool definitions as JSON."""
    try:
        top = json.loads(body)
    except (ValueError, TypeError, RecursionError):
        return []
    if not isinstance(top, dict):
        return []
    out = [text for _, _, text in tool_result_spans(body, provider)]
    listed = lambda key: [x for x in top.get(key) or [] if isinstance(x, dict)] if isinstance(top.get(key), list) else []
    if provider == "google":
        told = top.get("systemInstruction") or top.get("system_instruction")
        out += _texts(told.get("parts")) if isinstance(told, dict) else []
        for content in listed("contents"):
            out += _texts(content.get("parts"))
    else:
        out += _content(top.get("system"))
        for message in listed("messages"):
            if message.get("role", "user") in ("system", "user", "assistant"):
                out += _content(message.get("content"))
    for key in ("tools", "functions"):
        out += [json.dumps(x) for x in top.get(key) or [] if isinstance(x, dict | list | str)] if isinstance(top.get(key), list) else []
    return out


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType()), T.StructField("text", T.StringType())])))
def _spans(body: pd.Series, provider: pd.Series) -> pd.Series:
    return pd.Series([[{"start": i, "stop": j, "text": t} for i, j, t in tool_result_spans(b, p)] for b, p in zip(body, provider, strict=True)])


@F.pandas_udf(T.ArrayType(T.StringType()))
def _billed(body: pd.Series, provider: pd.Series) -> pd.Series:
    return pd.Series([billed_texts(b, p) for b, p in zip(body, provider, strict=True)])


def body_tokens(body: Column, provider: Column) -> Column:
    """Estimated billable tokens of a request body; 0 where it isn't a JSON object."""
    return F.aggregate(_billed(body, provider), F.lit(0).cast("long"), lambda n, t: n + token_estimate(t))


def _trimmed_spans(body: Column, provider: Column) -> Column:
    """Tool results whose text changes: ``start``, ``stop``, ``text`` and ``new``."""
    trimmed = lambda t: F.when(F.length(t) <= MAX_CHARS, trim_output(t)).otherwise(t)
    return F.filter(F.transform(_spans(body, provider), lambda x: F.struct(x["start"].alias("start"), x["stop"].alias("stop"), x["text"].alias("text"), trimmed(x["text"]).alias("new"))), lambda x: x["new"] != x["text"])


def trim_tool_results(body: Column, provider: Column) -> Column:
    """The body with its tool results trimmed as command output; all else stays byte for byte.

    Only the literals whose text changes are written anew. A null or broken body stays as it is.
    """
    literal = lambda t: F.substring(F.to_json(F.array(t)), F.lit(2), F.length(F.to_json(F.array(t))) - 2)

    def splice(own: Column) -> Column:
        before = lambda i: F.when(i == 0, 0).otherwise(F.get(own, F.greatest(i - 1, F.lit(0)))["stop"])
        pieces = F.transform(own, lambda x, i: F.concat(F.substring(body, before(i) + 1, x["start"] - before(i)), literal(x["new"])))
        last = F.get(own, F.size(own) - 1)["stop"]
        return F.when(F.size(own) > 0, F.concat(F.array_join(pieces, ""), F.substring(body, last + 1, F.length(body)))).otherwise(body)

    return let(_trimmed_spans(body, provider), splice)


def body_savings(rows: DataFrame, body: str = "body", provider: str = "provider") -> DataFrame:
    """``trimmed`` (the body with its tool results trimmed), ``tokens`` and ``trimmed_tokens``, ``shadow_savings`` (the strategy's saving, if any).

    A body's tokens are the sum over its texts, so trimming takes off what its tool results lose.
    """
    b, p = F.col(body), F.col(provider)
    less = F.aggregate(_trimmed_spans(b, p), F.lit(0).cast("long"), lambda n, x: n + token_estimate(x["text"]) - token_estimate(x["new"]))
    out = rows.withColumns({"trimmed": trim_tool_results(b, p), "tokens": body_tokens(b, p), "_less": less})
    out = out.withColumn("trimmed_tokens", F.col("tokens") - F.col("_less")).drop("_less")
    saved = F.greatest(F.col("tokens") - F.col("trimmed_tokens"), F.lit(0).cast("long"))
    return out.withColumn("shadow_savings", F.map_filter(F.create_map(F.lit("tool_result_trim"), saved), lambda k, v: v > 0))
