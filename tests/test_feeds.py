"""Feeds in provider and telemetry shapes: the cases that the registered queries' rows don't have."""

import json

import pytest

from calltally.functions.columns import provider_of
from calltally.sources import dims, telemetry
from pyspark.sql import functions as F

EXCHANGE = "i int, provider string, request_json string, response_raw string, streamed boolean, response_api boolean"


def sse(*events, end="\n"):
    return "".join(f"data: {x if isinstance(x, str) else json.dumps(x)}{end}" for x in events)


def normalised(spark, *rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], EXCHANGE)
    return telemetry.normalise_exchanges(df).orderBy("i").collect()


def test_a_stream_cut_short_is_estimated_and_says_so(spark):
    ask = json.dumps({"model": "m", "messages": [{"role": "user", "content": "12345678"}]})
    start = {"type": "message_start", "message": {"usage": {"input_tokens": 9}}}
    said = {"type": "content_block_delta", "delta": {"type": "text_delta", "text": "abcd" * 3}}
    cut, none, whole, empty = normalised(
        spark,
        ("anthropic", ask, sse(start, said, '{"type": "message_del'), True, False),
        ("anthropic", ask, sse(said), True, False),
        ("anthropic", ask, json.dumps({"content": [{"type": "text", "text": "hi"}]}), False, False),
        ("openai", ask, "", True, False),
    )
    assert (cut.input_tokens, cut.output_tokens, cut.tokens_estimated) == (9, 3, True)
    assert (none.input_tokens, none.output_tokens, none.tokens_estimated) == (2, 3, True)
    assert (whole.input_tokens, whole.output_tokens, whole.tokens_estimated, whole.answer) == (0, 0, False, "hi")
    assert (empty.input_tokens, empty.output_tokens, empty.tokens_estimated, empty.answer) == (2, 0, True, "")


def test_the_api_decides_the_shape_before_the_provider(spark):
    final = {"type": "response.incomplete", "response": {"status": "incomplete", "usage": {"input_tokens": 5, "output_tokens": 2}, "output": [{"type": "message", "content": [{"text": "late"}]}]}}
    (r,) = normalised(spark, ("anthropic", json.dumps({"input": "q"}), sse(final, "[DONE]", end="\r\n\r\n"), True, True))
    assert (r.answer, r.finish_reasons, r.input_tokens, r.request_model) == ("late", ["incomplete"], 5, None)
    assert [(m.role, m.content) for m in r.messages] == [("user", "q")]


def test_nulls_and_foreign_json(spark):
    rows = normalised(spark, (None, None, None, None, None), ("google", "[1]", "3", False, False), ("openai", '{"messages": [{"role": null, "content": 5}, 7]}', '{"choices": []}', False, False), ("openai", '{"messages": "no list"}', "null", True, False))
    assert [(r.input_tokens, r.output_tokens, r.answer, r.finish) for r in rows] == [(0, 0, "", None)] * 4
    assert [len(r.messages) for r in rows] == [0, 0, 2, 0]
    assert telemetry.normalise_exchanges(spark.createDataFrame([], EXCHANGE + ", extra string, usage string, req int")).count() == 0


def test_columns_of_the_feed_stay_even_if_their_names_clash(spark):
    df = spark.createDataFrame([("openai", '{"model": "m"}', '{"usage": {"prompt_tokens": 3}}', False, False, "mine", "own")], "provider string, request_json string, response_raw string, streamed boolean, response_api boolean, usage string, e string")
    r = telemetry.normalise_exchanges(df).collect()[0]
    assert (r.usage, r.e, r.input_tokens) == ("mine", "own", 3)


def test_messages_come_as_lists_too(spark):
    pair = lambda k, v: {"key": k, "value": {"stringValue": v}}
    listed = {"arrayValue": {"values": [{"kvlistValue": {"values": [pair("role", "assistant"), pair("content", "hi")]}}]}}
    attributes = [pair("gen_ai.system", "OpenAI"), {"key": "gen_ai.input.messages", "value": listed}, {"key": "gen_ai.response.finish_reasons", "value": {"arrayValue": {"values": [{"stringValue": "stop"}, {"stringValue": "length"}]}}}, pair("gen_ai.output.messages", "not json")]
    payload = json.dumps({"resourceSpans": [{"scopeSpans": [{"spans": [{"spanId": "s", "startTimeUnixNano": "1", "attributes": attributes}]}]}]})
    r = telemetry.calls_from_traces(spark.createDataFrame([(payload,), (None,), ("[]",)], "payload string")).collect()
    assert len(r) == 1 and (r[0].provider, r[0].finish_reasons, r[0].output_messages) == ("openai", ["stop", "length"], [])
    assert [(m.role, m.content) for m in r[0].messages] == [("assistant", "hi")]


def test_vendor_rows_without_anything(spark):
    rows = spark.createDataFrame([(None, None, None)], "userEmail string, model string, promptTokens long")
    r = telemetry.vendor_calls(rows, dims.prices(spark), dims.objectives(spark), dims.prefixes(spark), dims.repos(spark)).collect()[0]
    assert (r.event_id, r.provider, r.input_tokens, r.cost_usd, r.cost_priced, r.is_orphan, r.tool) == ("cursor:unknown:0", "unknown", 0, 0.0, False, True, "cursor-agent")


@pytest.mark.parametrize(("model", "provider"), [("omni-2", "openai"), ("o3", "openai"), ("Claude-x", "anthropic"), (None, "unknown"), ("llama", "unknown")])
def test_provider_of_a_model(spark, model, provider):
    assert spark.range(1).select(provider_of(F.lit(model).cast("string")).alias("p")).collect()[0].p == provider


def test_a_payload_is_read_once_and_its_attributes_are_worked_out_once(spark):
    rows = spark.range(3).select(F.lit("logs").alias("signal"), F.concat(F.lit('{"resourceLogs": '), F.col("id").cast("string"), F.lit("}")).alias("payload"))
    plan = telemetry.calls_from_logs(rows).select("ts", "provider", "input_tokens")._jdf.queryExecution().optimizedPlan().toString()
    assert (plan.count("from_json("), plan.count("map_concat(")) == (1, 1)


def test_of_repeated_attributes_the_last_counts_and_of_body_and_attributes_the_latter(spark):
    pair = lambda k, v: {"key": k, "value": {"stringValue": v}}
    log = {"body": {"kvlistValue": {"values": [pair("gen_ai.request.model", "body"), pair("gen_ai.usage.output_tokens", "4")]}}, "attributes": [pair("gen_ai.request.model", "x"), pair("gen_ai.usage.input_tokens", "1"), pair("gen_ai.request.model", "y")]}
    payloads = [json.dumps({"resourceLogs": [{"scopeLogs": [{"logRecords": [log, None]}, None]}, None]}), "{}", None, "no json"]
    got = telemetry.calls_from_logs(spark.createDataFrame([(p,) for p in payloads], "payload string")).collect()
    assert [(r.request_model, r.input_tokens, r.output_tokens) for r in got] == [("y", 1, 4)]
