"""Telemetry exports and provider exchanges as tables of calls; nested JSON by variants and typed JSON, no Python.

OTLP exports are one JSON document a row (column ``payload``). A span or log record becomes a call if any attribute
name starts with ``gen_ai.``; vendor ``api_request`` records have bare token attributes and an e-mail that is never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import let, provider_of, token_estimate
from ..functions.privacy import pseudonym
from ..operators.attribution import attribute
from ..operators.pricing import price_calls
from ..schema import upgrade

#: Provider names in telemetry (fixed values).
PROVIDERS = {
    "anthropic": "anthropic", "openai": "openai", "az.ai.openai": "azure.openai", "azure.ai.openai": "azure.openai",
    "aws.bedrock": "aws.bedrock", "gcp.gemini": "google", "gcp.vertex_ai": "google", "google": "google",
}

#: Provider, tool and kind of application of vendor ``api_request`` records (fixed values).
VENDOR_PROVIDER, VENDOR_TOOL, VENDOR_CATEGORY = "anthropic", "claude-code", "cli"

_PAIRS = "struct<values:array<struct<key:string,value:struct<stringValue:string,intValue:string,doubleValue:double>>>>"
_VALUE = f"struct<stringValue:string,intValue:string,doubleValue:double,boolValue:boolean,arrayValue:struct<values:array<struct<stringValue:string,kvlistValue:{_PAIRS}>>>,kvlistValue:{_PAIRS}>"
_ATTRS = f"array<struct<key:string,value:{_VALUE}>>"
TRACES = f"struct<resourceSpans:array<struct<scopeSpans:array<struct<spans:array<struct<spanId:string,name:string,startTimeUnixNano:string,attributes:{_ATTRS}>>>>>>>"
LOGS = f"struct<resourceLogs:array<struct<scopeLogs:array<struct<logRecords:array<struct<timeUnixNano:string,body:{_VALUE},attributes:{_ATTRS}>>>>>>>"


def _pairs_map(pairs: Column) -> Column:
    entries = F.transform(F.array_distinct(pairs["values"]), lambda a: F.struct(a["key"].alias("key"), F.coalesce(a["value"]["stringValue"], a["value"]["intValue"], a["value"]["doubleValue"].cast("string")).alias("value")))
    return F.map_from_entries(entries)


def _plain(v: Column) -> Column:
    """An attribute's value as a string; lists, of strings or of key/value lists, as JSON."""
    items = v["arrayValue"]["values"]
    listed = F.when(F.exists(items, lambda x: x["kvlistValue"].isNotNull()), F.to_json(F.transform(items, lambda x: _pairs_map(x["kvlistValue"])))).when(items.isNotNull(), F.to_json(F.transform(items, lambda x: x["stringValue"])))
    return F.coalesce(v["stringValue"], v["intValue"], v["doubleValue"].cast("string"), v["boolValue"].cast("string"), listed)


def attribute_map(attributes: Column) -> Column:
    """Key/value list to a map of strings; of a repeated key the last value stays."""
    entries = F.filter(F.coalesce(attributes, F.array().cast(_ATTRS)), lambda a: a["key"].isNotNull())
    keys = lambda e: F.transform(e, lambda a: a["key"])
    last = lambda e, k: F.filter(e, lambda a, i: ~F.array_contains(F.slice(k, i + 2, F.greatest(F.size(k) - i - 1, F.lit(0))), a["key"]))
    unrepeated = let(entries, lambda e: let(keys(e), lambda k: F.when(F.size(F.array_distinct(k)) == F.size(k), e).otherwise(last(e, k))))
    return F.map_from_entries(F.transform(unrepeated, lambda a: F.struct(a["key"].alias("key"), _plain(a["value"]).alias("value"))))


def message_texts(value: Column, role: str = "user") -> Column:
    """Messages given as a JSON list of {role, content}: content a string, or parts whose texts are joined. Else empty."""
    listed = F.filter(F.try_variant_get(F.try_parse_json(value), "$", "array<variant>"), lambda m: F.schema_of_variant(m).startswith("OBJECT"))
    part = lambda p: F.coalesce(F.nullif(F.try_variant_get(p, "$.content", "string"), F.lit("")), F.try_variant_get(p, "$.text", "string"), F.when(F.schema_of_variant(p) == "STRING", F.try_variant_get(p, "$", "string")), F.lit(""))

    def content(m: Column) -> Column:
        whole = F.when(F.schema_of_variant(F.try_variant_get(m, "$.content", "variant")) == "STRING", F.try_variant_get(m, "$.content", "string"))
        return F.coalesce(whole, F.array_join(F.transform(F.try_variant_get(m, "$.content", "array<variant>"), part), ""), F.lit(""))

    found = F.transform(listed, lambda m: F.struct(F.coalesce(F.try_variant_get(m, "$.role", "string"), F.lit(role)).alias("role"), content(m).alias("content")))
    return F.coalesce(found, F.array().cast("array<struct<role:string,content:string>>"))


def _calls(rows: DataFrame) -> DataFrame:
    """Rows with ``attrs`` (map), ``id``, ``nanos`` and ``vendor`` (bare names instead of ``gen_ai`` ones), as calls."""
    a = lambda *names: F.coalesce(*[F.try_element_at("attrs", F.lit(n)) for n in names])
    vendor = F.col("vendor")

    def count(bare: str, *names: str) -> Column:
        return F.coalesce(F.when(vendor, a(bare)).otherwise(a(*names)).try_cast("bigint"), F.lit(0))

    known = F.create_map(*[F.lit(x) for kv in PROVIDERS.items() for x in kv])
    told = F.lower(F.coalesce(F.nullif(a("gen_ai.provider.name"), F.lit("")), a("gen_ai.system"), F.lit("")))
    return rows.select(
        "id", F.timestamp_micros((F.col("nanos").try_cast("bigint") / 1000).cast("bigint")).alias("ts"), F.when(vendor, VENDOR_PROVIDER).otherwise(F.coalesce(F.try_element_at(known, told), F.lit("unknown"))).alias("provider"),
        F.when(vendor, a("model")).otherwise(a("gen_ai.request.model", "gen_ai.response.model")).alias("request_model"),
        count("input_tokens", "gen_ai.usage.input_tokens", "gen_ai.usage.prompt_tokens").alias("input_tokens"), count("output_tokens", "gen_ai.usage.output_tokens", "gen_ai.usage.completion_tokens").alias("output_tokens"),
        count("cache_read_tokens", "gen_ai.usage.cache_read_input_tokens").alias("cache_read_tokens"), count("cache_creation_tokens", "gen_ai.usage.cache_creation_input_tokens").alias("cache_creation_tokens"),
        pseudonym(a("enduser.id", "user.id")).alias("actor_pseudonym"), message_texts(a("gen_ai.input.messages", "gen_ai.prompt")).alias("messages"),
        message_texts(a("gen_ai.output.messages"), "assistant").alias("output_messages"), F.coalesce(F.from_json(a("gen_ai.response.finish_reasons"), "array<string>"), F.array().cast("array<string>")).alias("finish_reasons"),
        F.when(vendor, VENDOR_TOOL).alias("tool"), F.when(vendor, VENDOR_CATEGORY).alias("app_category"),
    )


def _is_call(attrs: str = "attrs") -> Column:
    return F.exists(F.map_keys(attrs), lambda k: k.startswith("gen_ai."))


def _items(rows: DataFrame, items: Column, name: str) -> DataFrame:
    """One row for each item. What is exploded is worked out once, not anew by every condition and column that reads it.

    Spark puts a condition on the list before an inner explode, which would work the list out twice more; so it is an outer one.
    """
    return rows.select(F.explode_outer(items).alias(name)).where(F.col(name).isNotNull())


def calls_from_traces(exports: DataFrame) -> DataFrame:
    spans = _items(_items(exports, F.from_json("payload", TRACES)["resourceSpans"], "r"), F.col("r.scopeSpans"), "s")
    row = lambda x: F.struct(x["spanId"].alias("id"), x["startTimeUnixNano"].alias("nanos"), attribute_map(x["attributes"]).alias("attrs"), F.lit(False).alias("vendor"))
    return _calls(_items(spans, F.transform("s.spans", row), "x").select("x.*").where(_is_call()))


def _log_records(exports: DataFrame) -> DataFrame:
    logs = _items(_items(exports, F.from_json("payload", LOGS)["resourceLogs"], "r"), F.col("r.scopeLogs"), "s")

    def merged(attrs: Column, x: Column) -> Column:
        body = F.coalesce(_pairs_map(x["body"]["kvlistValue"]), F.create_map().cast("map<string,string>"))
        return F.map_concat(F.map_filter(body, lambda k, v: ~F.map_contains_key(attrs, k)), attrs)  # attributes win

    row = lambda x: F.struct(F.sha2(F.to_json(x), 256).alias("id"), x["timeUnixNano"].alias("nanos"), let(attribute_map(x["attributes"]), lambda a: merged(a, x)).alias("attrs"), x["body"]["stringValue"].alias("event"))
    return _items(logs, F.transform("s.logRecords", row), "x").select("x.*")


def calls_from_logs(exports: DataFrame) -> DataFrame:
    """``gen_ai`` records, and vendor ``api_request`` records; whatever e-mail they hold is not selected."""
    records = _log_records(exports)
    name = F.coalesce(F.try_element_at("attrs", F.lit("event.name")), F.col("event"), F.lit(""))
    counted = F.map_contains_key("attrs", "input_tokens") | F.map_contains_key("attrs", "output_tokens")
    vendor = ~_is_call() & F.rlike(name, F.lit(r"^(.*\.)?api_request$")) & counted
    return _calls(records.withColumn("vendor", vendor).where(_is_call() | F.col("vendor")))


def calls_from_exports(exports: DataFrame) -> DataFrame:
    """Traces and logs by the column ``signal``; other signals give nothing."""
    return calls_from_traces(exports.where("signal = 'traces'")).unionByName(calls_from_logs(exports.where("signal = 'logs'")))


# ---- provider exchanges ---------------------------------------------------------------------------------------------


def sse_data(raw: Column) -> Column:
    """Payloads of the ``data:`` lines of an event stream, without the end mark."""
    lines = F.transform(F.split(raw, "\r\n|\n|\r"), lambda x: F.trim(x))
    data = F.transform(F.filter(lines, lambda x: x.startswith("data:")), lambda x: F.trim(F.substring(x, 6, 1 << 30)))
    return F.filter(data, lambda x: (x != "[DONE]") & (x != ""))


# Exchanges are read as variants, in SQL text: ``req`` is the request, ``e`` the response's events (one, if not streamed).
_NO_MESSAGES = "cast(array() AS array<struct<role:string,content:string>>)"


def _get(v: str, path: str, kind: str = "string") -> str:
    return f"try_variant_get({v}, '$.{path}', '{kind}')"


def _count(v: str, path: str) -> str:
    return f"coalesce({_get(v, path, 'bigint')}, 0L)"


def _content(v: str, path: str, typed: bool) -> str:
    """A string, or the texts of a list's parts (``typed``: of those that say they are text), joined; else empty."""
    parts = _get(v, path, "array<variant>")
    parts = f"filter({parts}, p -> {_get('p', 'type')} = 'text')" if typed else parts
    return f"CASE WHEN schema_of_variant({_get(v, path, 'variant')}) = 'STRING' THEN {_get(v, path)} ELSE coalesce(array_join(transform({parts}, p -> coalesce({_get('p', 'text')}, '')), ''), '') END"


def _message(role: str, content: str) -> str:
    return f"named_struct('role', {role}, 'content', {content})"


def _listed(path: str, content: str, role: str | None = None) -> str:
    role = role or f"coalesce({_get('m', 'role')}, 'user')"
    return f"coalesce(transform({_get('req', path, 'array<variant>')}, m -> {_message(role, content)}), {_NO_MESSAGES})"


def _told(content: str, role: str = "system") -> str:
    return f"""filter(array({_message(f"'{role}'", content)}), s -> s.content <> '')"""


def _joined(items: str, text: str) -> str:
    return f"coalesce(array_join(transform({items}, x -> coalesce({text}, '')), ''), '')"


def _each(path: str, events: str = "e") -> str:
    """The elements of the list at ``path`` of all events."""
    return f"flatten(transform({events}, y -> coalesce({_get('y', path, 'array<variant>')}, cast(array() AS array<variant>))))"


def _of_type(*types: str) -> str:
    return f"filter(e, x -> {_get('x', 'type')} IN ({', '.join(repr(t) for t in types)}))"


def _final(items: str, value: str) -> str:
    """The last value that isn't null."""
    return f"try_element_at(filter(transform({items}, x -> {value}), z -> z IS NOT NULL), -1)"


_ONE = "get(e, 0)"
_DONE = _of_type("response.completed", "response.incomplete", "response.failed")
_SAID = lambda v, path: f"coalesce(array_join(transform(filter({_get(v, path, 'array<variant>')}, i -> {_get('i', 'type')} = 'message'), i -> {_content('i', 'content', False)}), ''), '')"
_FIRST = f"get({_get(_ONE, 'choices', 'array<variant>')}, 0)"


def _either(streamed: str, whole: str) -> str:
    return f"CASE WHEN streamed THEN {streamed} ELSE {whole} END"


#: What each provider shape gives: messages, the usage object, its counts (``u``), answer, reasons to finish, model.
_SHAPES = {
    "anthropic": {
        "messages": f"concat({_told(_content('req', 'system', False))}, {_listed('messages', _content('m', 'content', True))})",
        "opened": _either(_final(_of_type("message_start"), _get("x", "message.usage", "variant")), _get(_ONE, "usage", "variant")),
        "usage": _either(_final(_of_type("message_delta"), f"CASE WHEN {_get('x', 'usage.output_tokens')} IS NOT NULL THEN {_get('x', 'usage', 'variant')} END"), _get(_ONE, "usage", "variant")),
        "input": _count("opened", "input_tokens"), "output": _count("usage", "output_tokens"), "read": _count("opened", "cache_read_input_tokens"), "written": _count("opened", "cache_creation_input_tokens"),
        "answer": _either(_joined(f"filter({_of_type('content_block_delta')}, x -> coalesce({_get('x', 'delta.type')}, 'text_delta') = 'text_delta')", _get("x", "delta.text")), _content(_ONE, "content", True)),
        "finish_reasons": _either(f"transform({_of_type('message_delta')}, x -> {_get('x', 'delta.stop_reason')})", f"array({_get(_ONE, 'stop_reason')})"),
        "response_model": _either(_final(_of_type("message_start"), _get("x", "message.model")), _get(_ONE, "model")),
    },
    "openai": {
        "messages": _listed("messages", _content("m", "content", True)),
        "usage": _final("e", f"CASE WHEN {_get('x', 'usage')} <> '{{}}' THEN {_get('x', 'usage', 'variant')} END"),
        "input": f"greatest(0L, {_count('usage', 'prompt_tokens')} - {_count('usage', 'prompt_tokens_details.cached_tokens')})", "output": _count("usage", "completion_tokens"), "read": _count("usage", "prompt_tokens_details.cached_tokens"),
        "answer": _either(_joined(_each("choices"), _get("x", "delta.content")), _content(_FIRST, "message.content", True)),
        "finish_reasons": _either(f"transform({_each('choices')}, x -> {_get('x', 'finish_reason')})", f"array({_get(_FIRST, 'finish_reason')})"),
        "response_model": _final("e", _get("x", "model")),
    },
    "responses": {
        "messages": f"concat({_told('coalesce(' + _get('req', 'instructions') + ', ' + repr('') + ')')}, CASE WHEN schema_of_variant({_get('req', 'input', 'variant')}) = 'STRING' THEN array({_message(repr('user'), _get('req', 'input'))}) ELSE {_listed('input', _content('m', 'content', False))} END)",
        "usage": _either(_final(_DONE, _get("x", "response.usage", "variant")), _get(_ONE, "usage", "variant")),
        "input": f"greatest(0L, {_count('usage', 'input_tokens')} - {_count('usage', 'input_tokens_details.cached_tokens')})", "output": _count("usage", "output_tokens"), "read": _count("usage", "input_tokens_details.cached_tokens"),
        "answer": _either(f"CASE WHEN size({_of_type('response.output_text.delta')}) > 0 THEN {_joined(_of_type('response.output_text.delta'), _get('x', 'delta'))} ELSE coalesce(get(transform({_DONE}, x -> {_SAID('x', 'response.output')}), 0), '') END", _SAID(_ONE, "output")),
        "finish_reasons": _either(f"transform({_DONE}, x -> {_get('x', 'response.status')})", f"array({_get(_ONE, 'status')})"),
        "response_model": _either(_final(_DONE, _get("x", "response.model")), _get(_ONE, "model")),
    },
    "gemini": {
        "messages": f"""concat({_told("CASE WHEN " + _get('req', 'systemInstruction') + " IS NOT NULL THEN " + _content('req', 'systemInstruction.parts', False) + " ELSE " + _content('req', 'system_instruction.parts', False) + " END")}, {_listed('contents', _content('m', 'parts', False), f"CASE coalesce({_get('m', 'role')}, 'user') WHEN 'model' THEN 'assistant' ELSE coalesce({_get('m', 'role')}, 'user') END")})""",
        "usage": _final("e", f"CASE WHEN {_get('x', 'usageMetadata')} <> '{{}}' THEN {_get('x', 'usageMetadata', 'variant')} END"),
        "input": f"greatest(0L, {_count('usage', 'promptTokenCount')} - {_count('usage', 'cachedContentTokenCount')})", "output": _count("usage", "candidatesTokenCount"), "read": _count("usage", "cachedContentTokenCount"),
        "answer": _joined(_each("candidates"), _content("x", "content.parts", False)),
        "finish_reasons": f"transform({_each('candidates')}, x -> {_get('x', 'finishReason')})",
        "response_model": _final("e", _get("x", "modelVersion")),
    },
}
_EMPTY = {"opened": "cast(NULL AS variant)", "written": "0L"}


def normalise_exchanges(exchanges: DataFrame) -> DataFrame:
    """Requests and raw responses of four provider shapes as calls, in one pass over them.

    Columns in: provider, request_json, response_raw, streamed, response_api. Out besides: request and response model,
    counts, messages (system ones first, parts joined), answer, all reasons to finish and the last of them. The last
    usage of a stream wins, and cached tokens are split out of the input where the provider counts them in. A stream
    that ends before its counts gets estimates and the flag; a whole body without counts has none. JSON that can't be
    read counts as empty; other providers are read like OpenAI's, as its hosts are.
    """
    shape = F.expr("CASE WHEN coalesce(response_api, false) THEN 'responses' WHEN provider = 'anthropic' THEN 'anthropic' WHEN provider = 'google' THEN 'gemini' ELSE 'openai' END")
    items = F.when(F.col("_streamed"), sse_data(F.col("response_raw"))).otherwise(F.array("response_raw"))
    own = [c for c in exchanges.columns if c != "streamed"]
    rows = exchanges.withColumn("_streamed", F.coalesce("streamed", F.lit(False)))
    rows = rows.select(F.struct(*own, F.col("streamed")).alias("row"), F.col("_streamed").alias("streamed"), shape.alias("shape"), F.try_parse_json("request_json").alias("req"), F.filter(F.transform(items, F.try_parse_json), lambda x: x.isNotNull()).alias("e"))

    def pick(field: str) -> str:
        return "CASE shape " + " ".join(f"WHEN '{s}' THEN {of.get(field, _EMPTY.get(field))}" for s, of in _SHAPES.items()) + " END"

    rows = rows.selectExpr("*", *[f"{pick(c)} AS {c}" for c in ("messages", "opened", "usage", "answer", "response_model")], f"filter({pick('finish_reasons')}, x -> x <> '') AS finish_reasons")
    rows = rows.selectExpr("*", *[f"{pick(c)} AS {c}" for c in ("input", "output", "read", "written")])
    asked = F.array_join(F.filter(F.transform("messages", lambda m: m["content"]), lambda x: x != ""), "\n")
    bare = F.col("streamed") & (F.col("shape") == "openai") & F.col("usage").isNull()
    guess_out = bare | (F.col("streamed") & (F.col("output") == 0) & (F.col("answer") != ""))
    guess_in = bare | (F.col("streamed") & (F.col("input") == 0) & (F.col("read") == 0) & (F.size("messages") > 0))
    model = F.coalesce(F.nullif(F.expr(_get("req", "model")), F.lit("")), F.col("response_model"))
    return rows.select(
        *[F.col(f"row.{c}").alias(c) for c in exchanges.columns], model.alias("request_model"), F.coalesce("response_model", model).alias("response_model"),
        F.when(guess_in, token_estimate(asked)).otherwise(F.col("input")).alias("input_tokens"), F.when(guess_out, token_estimate(F.col("answer"))).otherwise(F.col("output")).alias("output_tokens"),
        F.col("read").alias("cache_read_tokens"), F.col("written").alias("cache_creation_tokens"), (guess_in | guess_out).alias("tokens_estimated"), "messages", "answer", "finish_reasons", F.try_element_at("finish_reasons", F.lit(-1)).alias("finish"),
    )


def vendor_usage(rows: DataFrame) -> DataFrame:
    """Vendor usage events with several field names; a row without an id gets one of vendor, user and time."""
    have = set(rows.columns)
    zero = F.lit(0).cast("long")

    def first(kind: str, *names: str) -> Column:
        values = [F.col(n).cast(kind) for n in names if n in have]
        return F.coalesce(*[F.nullif(v, F.lit("")) if kind == "string" else v for v in values], F.lit(None).cast(kind))

    user = F.coalesce(first("string", "userEmail", "user", "userId", "email"), F.lit("unknown"))
    ts = F.coalesce(first("double", "timestamp", "ts", "time"), F.lit(0.0))
    model = first("string", "model", "modelIntent", "modelName")
    count = lambda *names: F.coalesce(first("long", *names), zero)
    return rows.select(
        F.coalesce(first("string", "id", "eventId"), F.concat_ws(":", F.lit("cursor"), user, ts.cast("bigint").cast("string"))).alias("event_id"), F.timestamp_seconds(ts).alias("ts"), F.lit("tier3_vendor").alias("tier"),
        provider_of(model).alias("provider"), pseudonym(user).alias("actor_pseudonym"), model.alias("request_model"), count("inputTokens", "promptTokens", "input_tokens").alias("input_tokens"),
        count("outputTokens", "completionTokens", "output_tokens").alias("output_tokens"), count("cacheReadTokens", "cacheReadInputTokens", "cache_read_tokens").alias("cache_read_tokens"),
        zero.alias("cache_creation_tokens"), zero.alias("duplicate_history_tokens"), F.lit(False).alias("tokens_estimated"), F.lit("cursor-agent").alias("tool"), F.lit("ide").alias("app_category"),
        first("string", "repoName", "repo").alias("repo"), F.lit(None).cast("string").alias("git_branch"),
    )


def vendor_calls(rows: DataFrame, prices: DataFrame, objectives: DataFrame, prefixes: DataFrame, repos: DataFrame) -> DataFrame:
    """Vendor usage events as priced rows of the call table; their repository is all that tells the objective."""
    return upgrade(attribute(price_calls(vendor_usage(rows), prices), objectives, prefixes, repos))


def outcome_feed(rows: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Shipped changes: unknown fields dropped, objective from the ticket if missing, counts at least 0, nothing nameless."""
    flag = lambda c: F.lower(F.coalesce(F.col(c).cast("string"), F.lit("false"))).isin("true", "1", "yes")
    lines = lambda c: F.greatest(F.lit(0), F.coalesce(F.col(c).try_cast("bigint"), F.lit(0))).cast("long")
    r = rows.withColumn("_p", F.upper(F.element_at(F.split("ticket_id", "-"), 1))).join(F.broadcast(prefixes.withColumnRenamed("objective_id", "_o")), F.col("_p") == F.col("prefix"), "left")
    out = r.select("outcome_id", F.coalesce("objective_id", "_o").alias("objective_id"), "ticket_id", flag("merged").alias("merged"), flag("reverted").alias("reverted"), lines("lines_added").alias("lines_added"), lines("lines_removed").alias("lines_removed"))
    return out.where("outcome_id IS NOT NULL AND objective_id IS NOT NULL")


def submissions(rows: DataFrame) -> DataFrame:
    """(org, metric, value) from a map of texts; what is no number is dropped."""
    return rows.select("org", F.explode("metrics").alias("metric", "value")).withColumn("value", F.col("value").try_cast("double")).where("value IS NOT NULL AND NOT isnan(value)")
