"""Queries over feeds in the shapes that they come in: exchanges, telemetry exports, vendor usage, dims and upgrades.

The test tables hold no such feeds, so each query first writes the given rows down in the shape that its reader takes;
the SQL twins work the expected rows out from the tables themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.privacy import SALT
from ..schema import backfill_tenant, upgrade
from ..sources import dims, telemetry
from ..sources.calls import facts
from .catalog import q, table
from .facts_sql import DIMS_SQL, hmac_sql


def _sse(*events) -> Column:
    """Events (null: left out) as an event stream with its other lines and its end mark."""
    lines = F.array_compact(F.array(*[F.to_json(e) for e in events]))
    return F.concat(F.array_join(F.transform(lines, lambda x: F.concat(F.lit("event: e\r\ndata: "), x, F.lit("\r\n\r\n"))), ""), F.lit("data: [DONE]\n"))


def exchanges(spark, sf_dir: str) -> DataFrame:
    """Every turn as an exchange of one of four shapes: the turn's text is asked and is answered, in two pieces if streamed.

    A third of the exchanges have no counts; an eleventh are answered by something that is no JSON.
    """
    t, n = F.coalesce("text", F.lit("")), F.col("conv_id") + F.col("turn")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", t.alias("t"), n.alias("n"), (F.pmod(F.floor(n / 4), F.lit(2)) == 0).alias("streamed"), (F.pmod(F.floor(n / 8), F.lit(3)) != 0).alias("counted"))
    size = F.length("t")
    tin, tout, cached = (size + 100).cast("long"), (size % 50 + 1).cast("long"), (F.col("turn") * 3).cast("long")
    half = F.floor(size / 2).cast("int")
    one, two = F.substring("t", F.lit(1), half), F.expr("substring(t, cast(floor(length(t) / 2) AS int) + 1)")
    s = lambda **k: F.struct(*[v.alias(c) if isinstance(v, Column) else F.lit(v).alias(c) for c, v in k.items()])
    counted = lambda v: F.when(F.col("counted"), v)
    part = lambda text, kind="text": s(type=kind, text=text)
    both = F.array(part(one), part(two))
    used = counted(s(input_tokens=tin, cache_read_input_tokens=cached, cache_creation_input_tokens=F.lit(7)))
    chat = counted(s(prompt_tokens=tin, completion_tokens=tout, prompt_tokens_details=s(cached_tokens=cached)))
    resp = counted(s(input_tokens=tin, output_tokens=tout, input_tokens_details=s(cached_tokens=cached)))
    meta = counted(s(promptTokenCount=tin, candidatesTokenCount=tout, cachedContentTokenCount=cached))
    partial = s(usageMetadata=s(promptTokenCount=F.lit(1)), candidates=F.array(s(content=s(parts=F.array(s(text=one))))))
    cand = lambda text: F.array(s(content=s(parts=F.array(s(text=text))), finishReason="STOP"))
    delta = lambda text: s(type="content_block_delta", delta=part(text, "text_delta"))
    shapes = [
        (
            s(model="claude-opus-4-8", system=F.array(part(F.lit("be ")), part(F.lit("brief"))), messages=F.array(s(role="user", content=F.array(part(one), s(type="image", text="no"), part(two))))),
            _sse(s(type="message_start", message=s(model="claude-x", usage=used)), delta(one), s(type="content_block_delta", delta=s(type="input_json_delta", partial_json="{")), delta(two), s(type="message_delta", delta=s(stop_reason="end_turn"), usage=counted(s(output_tokens=F.lit(1)))), s(type="message_delta", usage=counted(s(output_tokens=tout)))),
            s(model="claude-x", content=F.array(part(one), s(type="tool_use", text="no"), part(two)), stop_reason="end_turn", usage=counted(s(input_tokens=tin, output_tokens=tout, cache_read_input_tokens=cached, cache_creation_input_tokens=F.lit(7)))),
        ),
        (
            s(model="gpt-4o", messages=F.array(s(role="system", content="be brief"), s(role="user", content=F.col("t")))),
            _sse(s(model="gpt-x", choices=F.array(s(delta=s(content=one)))), s(choices=F.array(s(delta=s(content=two), finish_reason="stop"))), s(choices=F.array().cast("array<string>"), usage=chat)),
            s(model="gpt-x", choices=F.array(s(message=s(content=F.col("t")), finish_reason="stop"), s(message=s(content=F.lit("other")), finish_reason="stop")), usage=chat),
        ),
        (
            s(model="gpt-5", instructions="be brief", input=F.array(s(content=both))),
            _sse(s(type="response.output_text.delta", delta=one), s(type="response.function_call_arguments.delta", delta="{no}"), s(type="response.output_text.delta", delta=two), s(type="response.completed", response=s(model="gpt-x", status="completed", usage=resp))),
            s(model="gpt-x", status="completed", output=F.array(s(type="reasoning", content=F.array(part(F.lit("no")))), s(type="message", content=both)), usage=resp),
        ),
        (
            s(systemInstruction=s(parts=F.array(s(text="be brief"))), contents=F.array(s(role="model", parts=F.array(s(text=one), s(text=two))))),
            _sse(partial, s(modelVersion="gemini-x", candidates=cand(two), usageMetadata=meta)),
            s(modelVersion="gemini-x", candidates=cand(F.col("t")), usageMetadata=meta),
        ),
    ]
    kind = F.pmod("n", F.lit(4))
    of = lambda i: F.coalesce(*[F.when(kind == k, v) for k, v in enumerate(i)])
    answered = of([F.when(F.col("streamed"), stream).otherwise(F.to_json(whole)) for _, stream, whole in shapes])
    return rows.select(
        "conv_id", "turn", F.when(kind == 0, "anthropic").when(kind == 3, "google").otherwise("openai").alias("provider"), of([F.to_json(r) for r, _, _ in shapes]).alias("request_json"),
        F.when(F.pmod("n", F.lit(11)) == 0, "data: <html>oops").otherwise(answered).alias("response_raw"), "streamed", (kind == 2).alias("response_api"),
    )


_EST = "CASE WHEN length({0}) = 0 THEN 0 ELSE greatest(1, round_even(length({0}) / 4.0, 0)) END::BIGINT"


@q(f"""WITH r AS (SELECT conv_id, turn, coalesce(text, '') AS t, (conv_id + turn) % 4 AS k, (conv_id + turn) // 4 % 2 = 0 AS streamed, (conv_id + turn) // 8 % 3 <> 0 AND (conv_id + turn) % 11 <> 0 AS counted, (conv_id + turn) % 11 <> 0 AS good FROM conversations),
x AS (SELECT *, length(t) AS n, CASE WHEN good THEN t ELSE '' END AS answer, 'be brief' || CASE WHEN t = '' THEN '' ELSE chr(10) || t END AS asked,
  CASE WHEN NOT counted THEN CASE WHEN k = 3 AND streamed AND good THEN 1 ELSE 0 END WHEN k = 0 THEN n + 100 ELSE greatest(0, n + 100 - turn * 3) END AS tin, CASE WHEN counted THEN n % 50 + 1 ELSE 0 END AS tout, CASE WHEN counted THEN turn * 3 ELSE 0 END AS cached FROM r),
g AS (SELECT *, streamed AND (k = 1 AND NOT counted OR tin = 0 AND cached = 0) AS gin, streamed AND (k = 1 AND NOT counted OR tout = 0 AND answer <> '') AS gout FROM x)
SELECT conv_id, turn, CASE k WHEN 0 THEN 'claude-opus-4-8' WHEN 1 THEN 'gpt-4o' WHEN 2 THEN 'gpt-5' ELSE CASE WHEN good THEN 'gemini-x' END END AS request_model, CASE WHEN NOT good THEN CASE k WHEN 0 THEN 'claude-opus-4-8' WHEN 1 THEN 'gpt-4o' WHEN 2 THEN 'gpt-5' END ELSE CASE k WHEN 0 THEN 'claude-x' WHEN 3 THEN 'gemini-x' ELSE 'gpt-x' END END AS response_model,
 CASE WHEN gin THEN {_EST.format('asked')} ELSE tin END::BIGINT AS input_tokens, CASE WHEN gout THEN {_EST.format('answer')} ELSE tout END::BIGINT AS output_tokens, cached::BIGINT AS cache_read_tokens, CASE WHEN k = 0 AND counted THEN 7 ELSE 0 END::BIGINT AS cache_creation_tokens,
 gin OR gout AS tokens_estimated, 'system:be brief|' || CASE k WHEN 3 THEN 'assistant:' ELSE 'user:' END || md5(t) AS messages, md5(answer) AS answer_md5, CASE WHEN NOT good THEN '' ELSE CASE k WHEN 0 THEN 'end_turn' WHEN 1 THEN 'stop' WHEN 2 THEN 'completed' ELSE 'STOP' END END AS finish_reasons FROM g""", fact=False)
def normalised_exchanges(spark, sf_dir):
    """Four provider shapes, streamed and whole, with and without counts, as calls."""
    out = telemetry.normalise_exchanges(exchanges(spark, sf_dir))
    told = F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), F.when(m["role"] == "system", m["content"]).otherwise(F.md5(m["content"]))))
    counts = ["request_model", "response_model", "input_tokens", "output_tokens", "cache_read_tokens", "cache_creation_tokens", "tokens_estimated"]
    return out.select("conv_id", "turn", *counts, F.array_join(told, "|").alias("messages"), F.md5("answer").alias("answer_md5"), F.array_join("finish_reasons", "|").alias("finish_reasons"))


def exports(spark, sf_dir: str) -> DataFrame:
    """Events as telemetry exports: spans, log records with key/value bodies, vendor records; and what is none of them."""
    s = lambda **k: F.struct(*[v.alias(c) if isinstance(v, Column) else F.lit(v).alias(c) for c, v in k.items()])
    text = lambda k, v: s(key=k, value=s(stringValue=v, intValue=F.lit(None).cast("string")))
    whole = lambda k, v: s(key=k, value=s(stringValue=F.lit(None).cast("string"), intValue=v.cast("string")))
    e = table(spark, sf_dir, "events").withColumn("k", F.pmod("event_id", F.lit(4))).withColumn("c", F.floor(F.col("value") * 100).cast("long"))
    model, nanos = F.concat(F.lit("m"), "event_id"), F.concat((F.unix_micros(F.col("ts").cast("timestamp"))).cast("string"), F.lit("000"))
    asked = F.concat(F.lit('[{"role":"user","content":"'), "event_type", F.lit('"},{"content":[{"type":"text","content":"a"},{"text":"b"},"c"]},"stray"]'))
    gen = [text("gen_ai.request.model", model), whole("gen_ai.usage.input_tokens", F.col("c")), whole("gen_ai.usage.output_tokens", F.col("user_id")), whole("gen_ai.usage.cache_read_input_tokens", F.lit(3))]
    span = lambda i, attributes: s(spanId=i, startTimeUnixNano=nanos, attributes=attributes)
    spans = F.array(span(F.col("event_id").cast("string"), F.array(text("gen_ai.system", F.when(F.pmod("event_id", F.lit(8)) == 0, "GCP.Gemini").otherwise("someone")), *gen, text("user.id", F.concat(F.lit("u"), "user_id")), text("gen_ai.input.messages", asked))), span(F.lit("x"), F.array(text("http.url", F.lit("u")))))
    traces = s(resourceSpans=F.array(s(scopeSpans=F.array(s(spans=spans)))))
    log = lambda record: s(resourceLogs=F.array(s(scopeLogs=F.array(s(logRecords=F.array(record))))))
    merged = log(s(timeUnixNano=nanos, body=s(kvlistValue=s(values=F.array(text("gen_ai.request.model", F.lit("from the body")), gen[1]))), attributes=F.array(gen[0], gen[2], text("gen_ai.provider.name", F.lit("openai")))))
    vendor = log(s(timeUnixNano=nanos, body=s(stringValue="tool.api_request"), attributes=F.array(text("model", model), whole("input_tokens", F.col("c")), whole("cache_creation_tokens", F.lit(5)), text("user.id", F.concat(F.lit("u"), "user_id")), text("user.email", F.lit("never@read.example")))))
    other = log(s(timeUnixNano=nanos, body=s(stringValue="tool.user_prompt"), attributes=F.array(text("model", model), whole("input_tokens", F.col("c")))))
    return e.select(F.when(F.col("k") == 0, "traces").otherwise("logs").alias("signal"), F.when(F.col("k") == 0, F.to_json(traces)).when(F.col("k") == 1, F.to_json(merged)).when(F.col("k") == 2, F.to_json(vendor)).otherwise(F.to_json(other)).alias("payload"))


@q(f"""SELECT 'm' || event_id AS request_model, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, CASE event_id % 4 WHEN 0 THEN CASE WHEN event_id % 8 = 0 THEN 'google' ELSE 'unknown' END WHEN 1 THEN 'openai' ELSE 'anthropic' END AS provider, floor(value * 100)::BIGINT AS input_tokens, CASE WHEN event_id % 4 = 2 THEN 0 ELSE user_id END::BIGINT AS output_tokens,
 CASE WHEN event_id % 4 = 0 THEN 3 ELSE 0 END::BIGINT AS cache_read_tokens, CASE WHEN event_id % 4 = 2 THEN 5 ELSE 0 END::BIGINT AS cache_creation_tokens, CASE WHEN event_id % 4 <> 1 THEN 'px_' || substr({hmac_sql(f"'{SALT}:u' || user_id")}, 1, 20) END AS actor_pseudonym,
 CASE WHEN event_id % 4 = 0 THEN 'user:' || event_type || '|user:abc' ELSE '' END AS messages, CASE WHEN event_id % 4 = 2 THEN 'cli' END AS app_category FROM events WHERE event_id % 4 < 3""", fact=False)
def telemetry_calls(spark, sf_dir):
    """Calls out of trace and log exports; addresses of people aren't read, records of other kinds give nothing."""
    out = telemetry.calls_from_exports(exports(spark, sf_dir))
    told = F.array_join(F.transform("messages", lambda m: F.concat_ws(":", m["role"], m["content"])), "|")
    return out.select("request_model", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), "provider", "input_tokens", "output_tokens", "cache_read_tokens", "cache_creation_tokens", "actor_pseudonym", told.alias("messages"), "app_category")


@q(f"""WITH {DIMS_SQL}, u AS (SELECT *, CASE event_id % 3 WHEN 0 THEN 'claude-haiku-4' WHEN 1 THEN 'gpt-4o-mini' ELSE 'omni' END AS model, floor(value * 100)::BIGINT AS tin, CASE WHEN event_id % 5 = 0 THEN NULL ELSE user_id END::BIGINT AS tout, CASE WHEN event_id % 2 = 0 THEN 'BRAND#2' || user_id % 4 END AS repo FROM events)
SELECT CASE WHEN event_id % 7 = 0 THEN 'cursor:u' || user_id || ':' || event_id ELSE 'v' || event_id END AS event_id, CASE event_id % 3 WHEN 0 THEN 'anthropic' ELSE 'openai' END AS provider, 'px_' || substr({hmac_sql(f"'{SALT}:u' || user_id")}, 1, 20) AS actor_pseudonym, model AS request_model, tin AS input_tokens, coalesce(tout, 0) AS output_tokens,
 coalesce(round(tin / 1000000.0::DOUBLE * p_in + coalesce(tout, 0) / 1000000.0::DOUBLE * p_out + 1e-12, 6), 0.0) AS cost_usd, p_in IS NOT NULL AS cost_priced, objective.objective_id, CASE WHEN objective.objective_id IS NULL THEN 'none' ELSE 'repo_join' END AS attribution_method, objective.objective_id IS NULL AS is_orphan
 FROM u LEFT JOIN price ON price_key = model LEFT JOIN repo_map ON lower(repo) = repo_key LEFT JOIN objective USING (objective_id)""", fact=False)
def vendor_feed(spark, sf_dir):
    """Vendor usage events whose field names drifted, as priced and attributed calls."""
    e, odd = table(spark, sf_dir, "events"), F.pmod("event_id", F.lit(2)) == 1
    tin = F.floor(F.col("value") * 100).cast("long")
    rows = e.select(
        F.when(F.pmod("event_id", F.lit(7)) != 0, F.concat(F.lit("v"), "event_id")).alias("id"), F.col("event_id").cast("double").alias("timestamp"), F.when(odd, F.concat(F.lit("u"), "user_id")).otherwise("").alias("userEmail"), F.when(~odd, F.concat(F.lit("u"), "user_id")).alias("userId"),
        F.when(F.pmod("event_id", F.lit(3)) == 0, "claude-haiku-4").when(F.pmod("event_id", F.lit(3)) == 1, "gpt-4o-mini").alias("model"), F.lit("omni").alias("modelIntent"), F.when(odd, tin).alias("inputTokens"), F.when(~odd, tin).alias("promptTokens"),
        F.when(F.pmod("event_id", F.lit(5)) != 0, F.col("user_id")).alias("completionTokens"), F.when(~odd, F.concat(F.lit("BRAND#2"), F.pmod("user_id", F.lit(4)))).alias("repoName"),
    )
    out = telemetry.vendor_calls(rows, dims.prices(spark), dims.objectives(spark), dims.prefixes(spark), dims.repos(spark))
    return out.select("event_id", "provider", "actor_pseudonym", "request_model", "input_tokens", "output_tokens", "cost_usd", "cost_priced", "objective_id", "attribution_method", "is_orphan")


#: A knowledge graph as its file gives it: keys in any case, a threshold outside (0, 1].
GRAPH = {"objectives": [{"id": "a", "label": "Alpha", "monthly_budget_usd": 5.0}, {"id": "b"}], "repos": {"BRAND#11": "a", "Brand#12": "b"}, "ticket_prefixes": {"b2": "b"}, "semantic_threshold": 7}


@q("SELECT p_partkey, CASE p_brand WHEN 'Brand#11' THEN 'Alpha' WHEN 'Brand#12' THEN 'b' ELSE CASE WHEN p_partkey % 2 = 0 THEN 'b' END END AS objective_label, CASE WHEN p_partkey % 2 = 0 THEN 'ticket_join' WHEN p_brand IN ('Brand#11', 'Brand#12') THEN 'repo_join' ELSE 'none' END AS attribution_method, 0.55::DOUBLE AS threshold FROM (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'Brand#12' ELSE p_brand END AS p_brand FROM part)", fact=False)
def graph_attribution(spark, sf_dir):
    """Parts attributed by a loaded knowledge graph: ticket prefixes and repositories in any case."""
    from ..operators.attribution import attribute

    g = dims.knowledge_graph(spark, GRAPH)
    rows = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("repo"), F.when(F.pmod("p_partkey", F.lit(2)) == 0, F.concat(F.lit("fix/B2-"), "p_partkey")).alias("git_branch"))
    return attribute(rows, g["objectives"], g["prefixes"], g["repos"]).select("p_partkey", "objective_label", "attribution_method", F.lit(g["threshold"]).alias("threshold"))


@q("SELECT 'org' || s_suppkey AS org, metric, value FROM (SELECT s_suppkey, 'balance' AS metric, s_acctbal::DOUBLE AS value FROM supplier UNION ALL SELECT s_suppkey, 'nation', s_nationkey::DOUBLE FROM supplier WHERE s_nationkey % 2 = 0)", fact=False)
def exchange_submissions(spark, sf_dir):
    """Submitted maps of metrics as rows; what is no number is dropped."""
    texts = F.create_map(F.lit("balance"), F.col("s_acctbal").cast("string"), F.lit("note"), F.lit("n/a"), F.lit("missing"), F.lit("NaN"), F.lit("nation"), F.when(F.pmod("s_nationkey", F.lit(2)) == 0, F.col("s_nationkey").cast("string")).otherwise(""))
    return telemetry.submissions(table(spark, sf_dir, "supplier").select(F.concat(F.lit("org"), "s_suppkey").alias("org"), texts.alias("metrics")))


@q("SELECT event_id, CASE WHEN cost_usd > 1 THEN tenant_id ELSE 'acme' END AS tenant_id, CASE WHEN cost_usd > 1 THEN tenant_id END AS unchanged FROM facts")
def tenant_backfill(spark, sf_dir):
    """Rows without a tenant go to a named one; nothing changes for ``default``."""
    f = facts(spark, sf_dir).withColumn("tenant_id", F.when(F.col("cost_usd") > 1, F.col("tenant_id")))
    return backfill_tenant(backfill_tenant(f, "default").withColumn("unchanged", F.col("tenant_id")), "acme").select("event_id", "tenant_id", "unchanged")


@q("SELECT event_id, tenant_id, input_tokens, cost_usd, NULL::VARCHAR AS language, NULL::DOUBLE AS tm_similarity, 48 AS width FROM facts")
def schema_upgrade(spark, sf_dir):
    """Rows of an older layout with the call table's columns: missing ones null, unknown ones dropped, types cast."""
    old = facts(spark, sf_dir).select("event_id", "tenant_id", F.col("input_tokens").cast("string").alias("input_tokens"), F.col("cost_usd").cast("string").alias("cost_usd"), F.lit(1).alias("dropped_since"))
    new = upgrade(old)
    return new.select("event_id", "tenant_id", "input_tokens", "cost_usd", "language", "tm_similarity", F.lit(len(new.columns)).alias("width"))
