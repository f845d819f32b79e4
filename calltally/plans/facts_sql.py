"""The fact table in SQL, for checking the DataFrame version."""

from ..functions.privacy import KEY, SALT, pads
from ..sources import dims


def _values(rows) -> str:
    q = lambda v: "NULL" if v is None else (f"'{v}'" if isinstance(v, str) else str(v))
    return ", ".join("(" + ", ".join(q(v) for v in r) + ")" for r in rows)


INNER, OUTER = (p.hex() for p in pads(KEY))


def hmac_sql(message: str) -> str:
    return f"sha256(unhex('{OUTER}') || unhex(sha256(unhex('{INNER}') || encode({message}))))"


DIMS_SQL = f"""
price AS (SELECT k AS price_key, a::DOUBLE AS p_in, b::DOUBLE AS p_out, c::DOUBLE AS p_cr, d::DOUBLE AS p_cw FROM (VALUES {_values(dims.PRICES)}) v(k, a, b, c, d)),
objective(objective_id, objective_label, client, ord, budget) AS (VALUES {_values(dims.OBJECTIVES)}),
prefix(prefix, objective_id) AS (VALUES {_values(dims.PREFIXES)}),
repo_map(repo_key, objective_id) AS (VALUES {_values([(r.lower(), o) for r, o in dims.REPOS])}),
heads(head, head_work_type) AS (VALUES {_values(dims.BRANCH_HEADS)})"""

NORM_SQL = "regexp_replace(regexp_replace(regexp_replace(replace(replace(replace(string_split(lower(trim(m)), '/')[-1], 'anthropic.', ''), 'google.', ''), 'openai.', ''), '^us\\.', ''), '^eu\\.', ''), '^apac\\.', '')"

FACTS_SQL = f"""
WITH {DIMS_SQL},
line AS (
  SELECT * FROM lineitem
  QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_quantity DESC, l_extendedprice DESC, l_discount DESC, l_tax DESC, l_returnflag DESC, l_linestatus DESC) = 1),
log AS (
  SELECT concat(l_orderkey, '-', l_linenumber) AS event_id, l_shipdate AS ts, c_name AS actor_raw, n_name AS tenant_id, r_name AS org, r_name AS residency,
         CASE c_mktsegment WHEN 'MACHINERY' THEN 'anthropic' WHEN 'BUILDING' THEN 'openai' WHEN 'AUTOMOBILE' THEN 'google' WHEN 'HOUSEHOLD' THEN 'aws.bedrock' ELSE 'azure.openai' END AS provider,
         CASE string_split(p_type, ' ')[1] WHEN 'STANDARD' THEN 'anthropic/claude-opus-4-8' WHEN 'PROMO' THEN 'gpt-4o-mini-2024' WHEN 'SMALL' THEN 'us.anthropic.claude-haiku-4-5'
              WHEN 'LARGE' THEN 'gpt-5.5-preview' WHEN 'ECONOMY' THEN 'gemini-2.5-flash' ELSE 'mystery-model-9' END AS request_model,
         substr(o_orderpriority, 3) AS tool, lower(p_brand) AS repo,
         concat(CASE l_returnflag || l_linestatus WHEN 'AF' THEN 'feature/' WHEN 'AO' THEN 'fix/' WHEN 'NF' THEN 'refactor/' WHEN 'NO' THEN 'spike/' WHEN 'RF' THEN 'chore/' ELSE 'wip/' END,
                'B', regexp_extract(p_brand, '([0-9]+)$', 1), '-', l_orderkey) AS git_branch,
         floor(l_quantity * 100)::BIGINT AS input_tokens, floor(l_extendedprice / 100)::BIGINT AS output_tokens,
         floor(l_discount * 10000)::BIGINT AS cache_read_tokens, floor(l_tax * 10000)::BIGINT AS cache_creation_tokens,
         CASE WHEN l_linenumber >= 4 THEN floor(l_quantity * 70)::BIGINT ELSE 0 END AS duplicate_history_tokens,
         l_linenumber = 7 AS is_retry_loop,
         CASE WHEN l_linenumber = 2 THEN floor(l_quantity * 10)::BIGINT ELSE 0 END AS saved_input_tokens,
         l_linenumber = 3 AS served_from_cache
  FROM line JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
       JOIN region ON n_regionkey = r_regionkey JOIN part ON l_partkey = p_partkey),
model AS (
  SELECT m, arg_max(price_key, length(price_key)) AS price_key
  FROM (SELECT DISTINCT request_model AS m FROM log) JOIN price ON starts_with({NORM_SQL}, price_key) GROUP BY m),
priced AS (
  SELECT log.*, price.price_key IS NOT NULL AS cost_priced,
         coalesce(round(input_tokens / 1000000.0::DOUBLE * p_in + output_tokens / 1000000.0::DOUBLE * p_out + (cache_read_tokens / 1000000.0::DOUBLE * p_cr + cache_creation_tokens / 1000000.0::DOUBLE * p_cw) + 1e-12, 6), 0.0) AS cost_usd,
         coalesce(round(greatest(duplicate_history_tokens - cache_read_tokens, 0) * greatest(0.0::DOUBLE, p_in - p_cr) / 1000000 + 1e-12, 6), 0.0) AS cache_saving_usd,
         regexp_extract(git_branch, '\\b([A-Z][A-Z0-9]{{1,9}}-[0-9]+)\\b', 1) AS ticket_id,
         string_split(regexp_replace(lower(trim(git_branch)), '[/_-]', chr(1)), chr(1))[1] AS head
  FROM log LEFT JOIN model ON request_model = m LEFT JOIN price USING (price_key)),
facts AS (
  SELECT p.* EXCLUDE (head, actor_raw, price_key), 'px_' || substr({hmac_sql(f"'{SALT}:' || actor_raw")}, 1, 20) AS actor_pseudonym,
         o.objective_id, o.objective_label, o.objective_id IS NULL AS is_orphan,
         CASE WHEN a.objective_id IS NOT NULL THEN 'ticket_join' WHEN r.objective_id IS NOT NULL THEN 'repo_join' ELSE 'none' END AS attribution_method,
         CASE WHEN o.objective_id IS NOT NULL THEN 1.0 ELSE 0.0 END::DOUBLE AS attribution_confidence,
         coalesce(head_work_type, 'unknown') AS work_type, CASE WHEN head_work_type IS NULL THEN 'none' ELSE 'branch' END AS work_type_source
  FROM priced p LEFT JOIN prefix a ON upper(string_split(ticket_id, '-')[1]) = a.prefix
       LEFT JOIN repo_map r ON lower(repo) = r.repo_key LEFT JOIN objective o ON o.objective_id = coalesce(a.objective_id, r.objective_id)
       LEFT JOIN heads h ON p.head = h.head)
"""
FACTS_SQL = FACTS_SQL.replace("p.* EXCLUDE (head, actor_raw, price_key)", "p.* EXCLUDE (head, actor_raw)")
