"""What-if savings: content-rewriting strategies as column functions, measured on logged texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import let, stable_prompt, token_estimate

MAX_CHARS = 200_000  # longer texts are left as they are
HEAD, TAIL, MOST = 120, 40, 200


def trim_output(text: Column) -> Column:
    """Command output without terminal codes, runs of equal lines folded, the middle of a long one cut."""
    lines = F.split(F.regexp_replace(text, "\x1b\\[[0-9;?]*[A-Za-z]", ""), "\n")

    def fold(lines: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: (i == 0) | (F.get(lines, i) != F.get(lines, F.greatest(i - 1, F.lit(0)))))
        return let(starts, lambda at: F.transform(at, lambda s, k: let(F.coalesce(F.get(at, k + 1), F.size(lines)) - s, lambda n: F.when(n > 1, F.concat(F.get(lines, s), F.lit("    ... x"), n.cast("string"))).otherwise(F.get(lines, s)))))

    def cut(folded: Column) -> Column:
        m = F.size(folded)
        short = F.concat(F.slice(folded, 1, HEAD), F.array(F.concat(F.lit("... "), (m - HEAD - TAIL).cast("string"), F.lit(" lines cut ..."))), F.slice(folded, F.greatest(m - TAIL + 1, F.lit(1)), F.lit(TAIL)))
        return F.when(m > MOST, short).otherwise(folded)

    return F.array_join(let(let(lines, fold), cut), "\n")


def _compact(html: Column) -> Column:
    rows = F.regexp_extract_all(html, F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))
    cells = lambda r: F.transform(F.regexp_extract_all(r, F.lit(r"(?is)<t[dh][^>]*>(.*?)</t[dh]>"), F.lit(1)), lambda c: F.trim(F.regexp_replace(c, "<[^>]+>", "")))
    return F.array_join(F.transform(rows, lambda r: F.array_join(cells(r), " | ")), "\n")


def compact_tables(text: Column) -> Column:
    """HTML tables as rows of cells between bars; merged cells are left alone, and so is what wouldn't get shorter."""
    tables = F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?is)<table\b.*?</table>"), F.lit(0)))
    plain = F.filter(tables, lambda t: ~t.rlike(r"(?i)(?:row|col)span"))
    return F.aggregate(plain, text, lambda acc, t: let(_compact(t), lambda c: F.when(F.length(c) < F.length(t), F.replace(acc, t, c)).otherwise(acc)))


def minify_json(text: Column) -> Column:
    """Fenced JSON without its white space; what doesn't parse stays."""
    blocks = F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?s)```json\s*(.*?)\s*```"), F.lit(1)))
    return F.aggregate(blocks, text, lambda acc, b: let(F.to_json(F.try_parse_json(b)), lambda s: F.when(s.isNotNull() & (F.length(s) < F.length(b)), F.replace(acc, b, s)).otherwise(acc)))


#: name -> (lossless, on by default, rewrites content, function); callers may add their own.
STRATEGIES: dict[str, tuple[bool, bool, bool, Callable[[Column], Column]]] = {
    "prefix_stabilize": (True, True, False, stable_prompt),
    "command_trim": (False, False, True, trim_output),
    "compact_tables": (True, False, True, compact_tables),
    "compress_json": (True, False, True, minify_json),
}


def apply_strategy(name: str, text: Column) -> Column:
    return F.when(F.length(text) <= MAX_CHARS, STRATEGIES[name][3](text)).otherwise(text)


def slim_tools(tools: Column) -> Column:
    """Tool definitions without repeats of the same JSON."""
    return F.array_distinct(F.transform(tools, lambda t: F.coalesce(F.to_json(F.try_parse_json(t)), t)))


def breakpoint_eligible(provider: Column, system: Column, markers: Column, system_marked: Column) -> Column:
    return F.coalesce((provider == "anthropic") & (F.length(system) >= 2000) & (markers < 4) & ~system_marked, F.lit(False))


def shadow_savings(rows: DataFrame, text_col: str, enabled: tuple[str, ...] = ()) -> DataFrame:
    """``shadow_savings``: tokens that each content-rewriting strategy that is off would save, each on the original."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    pairs = []
    for name, (_, _, rewrites, _) in STRATEGIES.items():
        if rewrites and name not in enabled:
            saved = F.greatest(F.lit(0).cast("long"), token_estimate(text) - token_estimate(apply_strategy(name, text)))
            pairs += [F.lit(name), saved]
    return rows.withColumn("shadow_savings", F.map_filter(F.create_map(*pairs), lambda k, v: v > 0))


def marginal_savings(rows: DataFrame, text_col: str, chain: tuple[str, ...]) -> DataFrame:
    """``compression_detail``: what each strategy saves after the ones before it; the sum is the whole saving."""
    out = rows.withColumn("_t", F.coalesce(F.col(text_col), F.lit("")))
    pairs = []
    for name in chain:
        out = out.withColumn("_next", apply_strategy(name, F.col("_t"))).withColumn(f"_s_{name}", F.greatest(F.lit(0).cast("long"), token_estimate(F.col("_t")) - token_estimate(F.col("_next"))))
        out = out.withColumn("_t", F.col("_next")).drop("_next")
        pairs += [F.lit(name), F.col(f"_s_{name}")]
    detail = F.map_filter(F.create_map(*pairs), lambda k, v: v > 0)
    return out.withColumns({"compression_detail": detail, "compressed": F.col("_t")}).drop("_t", *[f"_s_{n}" for n in chain])


def price_proposals(proposed: DataFrame, prices: DataFrame) -> DataFrame:
    """Costs of calls that somebody thinks of making."""
    from .pricing import price_calls

    full = proposed
    for c in ("cache_read_tokens", "cache_creation_tokens", "duplicate_history_tokens"):
        if c not in full.columns:
            full = full.withColumn(c, F.lit(0).cast("long"))
    return price_calls(full, prices)
