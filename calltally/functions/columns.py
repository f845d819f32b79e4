"""Scalar functions as Column builders; ASCII classes throughout, so that other engines' regexes agree."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources.dims import MAINTENANCE, NET_NEW


def ratio(a: Column, b: Column, digits: int = 6) -> Column:
    """Guarded ratio: 0 over nothing."""
    return F.coalesce(F.round(F.try_divide(a.cast("double"), b.cast("double")), digits), F.lit(0.0))


def ticket_of(branch: Column) -> Column:
    return F.nullif(F.regexp_extract(F.coalesce(branch, F.lit("")), r"\b([A-Z][A-Z0-9]{1,9}-[0-9]+)\b", 1), F.lit(""))


def branch_head(branch: Column) -> Column:
    return F.substring_index(F.translate(F.lower(F.trim(branch)), "_-", "//"), "/", 1)


def is_net_new(work_type: Column) -> Column:
    return work_type.isin(*NET_NEW)


def investment(work_type: Column) -> Column:
    return F.when(work_type.isin(*NET_NEW), "net_new").when(work_type.isin(*MAINTENANCE), "maintenance").otherwise("unclassified")


def token_estimate(text: Column) -> Column:
    """Characters over four, half to even, at least one; 0 for an empty text."""
    n = F.length(F.coalesce(text, F.lit("")))
    return F.when(n == 0, 0).otherwise(F.greatest(F.lit(1), F.bround(n / 4.0, 0).cast("long"))).cast("long")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` worked out once, however often a lambda inside refers to it."""
    return F.get(F.transform(F.array(value), body), 0)


def entropy(text: Column) -> Column:
    """Shannon entropy of the characters, in bits."""

    def of(chars: Column) -> Column:
        counts = F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda x: x == c)) / F.size(chars).cast("double"))
        return F.round(F.aggregate(counts, F.lit(0.0), lambda a, p: a - p * F.log2(p)), 6)

    return F.coalesce(let(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)), of), F.lit(0.0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 for empty, of unequal length, or without length."""
    bad = a.isNull() | b.isNull() | (F.size(a) != F.size(b)) | (F.size(a) == 0)
    return F.when(bad, 0.0).otherwise(F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0)))


def valid_embedding(v: Column) -> Column:
    """2 to 4096 finite numbers, not all zero."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(F.size(v).between(2, 4096) & finite & (norm(v) > 0), F.lit(False))


def pair_key(a: Column, b: Column) -> Column:
    return F.concat_ws("|", F.array_sort(F.array(a, b)))


def cost_band(usd: Column) -> Column:
    return F.when(usd <= 0, "unknown").when(usd < 1, "under $1").when(usd < 5, "$1 to $5").when(usd < 20, "$5 to $20").otherwise("over $20")


def md5_embedding(text: Column, width: int = 16) -> Column:
    """Counts of the words' buckets (last hex digit of MD5), normalised."""
    buckets = F.transform(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)), lambda w: F.conv(F.right(F.md5(w), F.lit(1)), 16, 10).cast("int"))
    counts = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.size(F.filter(buckets, lambda b: b == i)).cast("double"))
    return F.when(F.size(buckets) > 0, F.transform(counts, lambda c: F.round(c / norm(counts), 6))).otherwise(counts)


#: Language hints, first match wins (fixed values).
LANGUAGE_HINTS = [
    ("python", ("python", " def ", "pytest", "pip ", ".py", "django", "flask", "asyncio")),
    ("go", (" golang", " go ", "goroutine", "gofmt", ".go", "func (")),
    ("rust", ("rust", "cargo", "borrow checker", ".rs", "impl ")),
    ("typescript", ("typescript", ".tsx", ".ts", "interface ", "tsconfig")),
    ("javascript", ("javascript", " node ", ".js", "react", "express")),
    ("java", (" java", "spring boot", ".java", "maven", "gradle")),
    ("csharp", ("c#", ".net", "csharp")),
    ("sql", (" sql", "select ", "postgres", "query plan")),
    ("ruby", ("ruby", "rails", ".rb")),
]


def language(text: Column) -> Column:
    low = F.lower(text)
    out = F.when(F.lit(False), "")
    for name, hints in LANGUAGE_HINTS:
        hit = F.lit(False)
        for h in hints:
            hit = hit | low.contains(h)
        out = out.when(hit, name)
    return out


def provider_of(model: Column) -> Column:
    """Provider from a model's name."""
    m = F.lower(F.coalesce(model, F.lit("")))
    return (
        F.when(m.contains("claude"), "anthropic")
        .when(m.contains("gemini"), "google")
        .when(m.contains("gpt") | m.startswith("o"), "openai")
        .otherwise("unknown")
    )


def csv_safe(c: Column) -> Column:
    """A cell that no spreadsheet takes for a formula."""
    return F.when(c.rlike(r"^[=+@\t\r\n-]"), F.concat(F.lit("'"), c)).otherwise(c)


def stable_prompt(text: Column) -> Column:
    """A leading date or run id moved behind the text, so that the prefix stays cacheable."""
    head = r"^\s*((?:[0-9]{4}-[0-9]{2}-[0-9]{2}|id:[A-Za-z0-9-]+)\s+)"
    lead = F.regexp_extract(text, head, 1)
    return F.when(lead != "", F.concat(F.regexp_replace(text, head, ""), F.lit("\n"), F.trim(lead))).otherwise(text)


def learning_terms(text: Column, stop: tuple[str, ...], most: int | None = None) -> Column:
    """Distinct words and adjacent pairs (repeats kept) of a text's words that aren't stop words; of the first ``most``, if given."""
    words = F.filter(F.regexp_extract_all(F.lower(text), F.lit("[a-z][a-z0-9_]{2,}"), F.lit(0)), lambda w: ~w.isin(*stop))
    words = words if most is None else F.slice(words, 1, most)

    def terms(w: Column) -> Column:
        pairs = F.when(F.size(w) > 1, F.zip_with(F.slice(w, F.lit(1), F.size(w) - 1), F.slice(w, F.lit(2), F.size(w) - 1), lambda a, b: F.concat_ws(" ", a, b))).otherwise(F.array().cast("array<string>"))
        return F.concat(F.array_distinct(w), pairs)

    return let(words, terms)
