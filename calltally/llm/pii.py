"""Personal data: fixed patterns, and contextual extraction bootstrapped from them (DataFrame functions only).

The entities that the fixed patterns find are seeds. The word before an identifier-like string, the word after it and
the label glued to it (``mail:``) are its lexical patterns; patterns and strings form a graph. A pattern's confidence is
the belief in the strings it goes with over all words that it goes with anywhere in the corpus, so that ``the`` is no
pattern. The belief in a string is 1 for a seed, else the confidence of its best pattern. Scores run to and fro until
they rise no more. Strings that are believed in count as seeds for further patterns, which so come in round by round. A
pattern needs several different seeds, as one document's habit is no evidence. Strings in high-confidence patterns are
identifiers, of the kind of most of the pattern's seeds.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD_CLASS, WS_CLASS, checkpointed, packed, row_keys, table, unpacked

KINDS = ("email", "ip", "card", "phone")
#: The fixed patterns. Possessive repeats and look-behinds change no match: they only keep long runs from being tried
#: again from each of their characters, and the regex engine from recursing.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to be tried.
GUARDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
PLACEHOLDERS = {k: f"[{k.upper()}]" for k in KINDS}

#: Words with a digit or an at sign: what may be an identifier.
TOKEN = rf"(?<!{WORD_CLASS}){WORD_CLASS}*[0-9@]{WORD_CLASS}*+"
#: A label glued to what follows it, in any script.
LABEL = r"\p{L}[\p{L}\p{M}_.-]*[=:]"
#: Different seeds that a pattern needs, confidence that a pattern and an identifier need; scoring ends once no
#: confidence rises by more than this.
MIN_SEEDS = 5
MIN_CONFIDENCE = 0.6
RISE = 0.02
#: Up to so many patterns (some 50 bytes each) are broadcast to the count of all words; beyond, all words are counted.
MAX_BROADCAST_PATTERNS = 200_000
#: Up to so many keys of repeated rows (some 20 bytes each) are broadcast; beyond, they are joined by a shuffle.
MAX_BROADCAST_REPEATS = 200_000


def _found(text: Column, pattern: str, guard: Column, kind: str) -> Column:
    """Matches as an array of (kind, gap before the match, match); for words also the gap after the last, with no match."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    gaps = gaps if kind == "token" else F.slice(gaps, F.lit(1), F.size(hits))
    pairs = F.zip_with(gaps, hits, lambda g, m: F.struct(F.lit(kind).alias("kind"), g.alias("gap"), m.alias("value")))
    return F.when(guard, pairs).otherwise(F.array().cast("array<struct<kind:string,gap:string,value:string>>"))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the check digit is right."""
    n = F.length(digits)
    from_last = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(digits, n - i, F.lit(1)).try_cast("int"))
    doubled = F.transform(from_last, lambda d, i: F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10 == 0


def _valid(kind: Column, value: Column) -> Column:
    digits = _digits(value)
    octet = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
    return (
        F.when(kind == "email", F.lit(True))
        .when(kind == "ip", value.rlike(rf"^{octet}(?:\.{octet}){{3}}$"))
        .when(kind == "card", F.when(F.length(digits).between(13, 19), _luhn(digits)).otherwise(False))
        .otherwise(F.length(digits).between(9, 15))
    )


def _matches(keyed: DataFrame, text: Column) -> DataFrame:
    """All matches with their places: (_k, _k2, kind, at, gap, value, before, after, start, end); rows of equal keys count once.

    Kind ``token`` has the identifier-like words, with the words before and after them. Code points, end exclusive. A
    text's matches are numbered by a window over that text alone.
    """
    arrays = [_found(text, PATTERNS[k], text.rlike(GUARDS[k]), k) for k in KINDS] + [_found(text, TOKEN, text.rlike("[0-9@]"), "token")]
    source = keyed.where(text.rlike("[0-9@]")).select("_k", "_k2", F.array(*arrays).alias("_all"))
    rows = source.select("_k", "_k2", F.explode("_all").alias("_one")).select("_k", "_k2", F.posexplode("_one").alias("at", "m"))
    # Of a gap its length, first and last word are all that is needed.
    token = F.col("m.kind") == "token"
    gap = F.translate("m.gap", "\t\n\x0b\x0c\r", "     ")
    rows = rows.select(
        "_k", "_k2", F.col("m.kind").alias("kind"), "at", F.length("m.gap").alias("gap"), F.col("m.value").alias("value"),
        F.when(token, F.substring_index(F.ltrim(gap), " ", 1)).alias("first"), F.when(token, F.substring_index(F.rtrim(gap), " ", -1)).alias("last"),
    ).distinct()
    w = Window.partitionBy("_k", "_k2", "kind").orderBy("at")
    word = lambda own, other: F.when(F.length(own) > 0, own).otherwise(other)
    rows = rows.withColumns(
        {
            "before": word(F.col("last"), F.lag("value").over(w)), "after": word(F.lead("first").over(w), F.lead("value").over(w)),
            "end": F.sum(F.col("gap") + F.length("value")).over(w.rowsBetween(Window.unboundedPreceding, 0)),
        }
    ).drop("first", "last")
    rows = rows.where("value IS NOT NULL").withColumn("start", F.col("end") - F.length("value"))
    return rows.where((F.col("kind") == "token") | _valid(F.col("kind"), F.col("value")))


def _instances(matches: DataFrame) -> DataFrame:
    """Identifier-like words: their patterns, core string and span, and the kind of the seed they start (null: no seed)."""
    w = Window.partitionBy("_k", "_k2").orderBy("start", "order")
    base = F.col("kind") != "token"
    m = matches.withColumn("order", F.when(base, 1).otherwise(0)).withColumns(
        {
            "covered": F.max(F.when(base, F.col("end"))).over(w.rowsBetween(Window.unboundedPreceding, -1)),
            "next_start": F.lead("start").over(w), "next_kind": F.lead("kind").over(w), "next_value": F.lead("value").over(w),
        }
    )
    t = m.where(~base & (F.coalesce("covered", F.lit(-1)) <= F.col("start")))
    starts_seed = F.coalesce((F.col("next_kind") != "token") & (F.col("next_start") < F.col("end")), F.lit(False))
    label = F.regexp_extract("value", rf"^[(\[\"']*({LABEL})", 1)
    glued = F.when(starts_seed, (F.length(label) > 0) & (F.col("next_start") - F.col("start") >= F.length(label))).otherwise(F.length(label) > 0)
    core = F.regexp_replace(F.regexp_replace("value", rf"^[(\[\"'<]*(?:{LABEL})?[(\[\"'<]*", ""), r"[.,;:!?)\]\"'>]+$", "")
    skipped = F.length(F.regexp_extract("value", rf"^[(\[\"'<]*(?:{LABEL})?[(\[\"'<]*", 0))
    # A seed of several words hasn't its own next word here, but it is one word long for most kinds.
    whole = ~starts_seed | (F.length("next_value") + F.col("next_start") <= F.col("end"))
    patterns = F.array_compact(
        F.array(
            F.when(glued, F.concat(F.lit("in "), F.lower(label))).when(F.length("before") > 0, F.concat(F.lit("after "), F.lower("before"))),
            F.when((F.length("after") > 0) & whole, F.concat(F.lit("before "), F.lower("after"))),
        )
    )
    t = t.select(
        "_k", "_k2", patterns.alias("patterns"),
        F.when(starts_seed, F.col("next_value")).otherwise(core).alias("core"),
        F.when(starts_seed, F.col("next_kind")).alias("seed"),
        (F.col("start") + skipped).alias("start"),
    ).where(F.size("patterns") > 0)
    like = F.col("seed").isNotNull() | (F.length("core") >= 6) & ((F.length(_digits(F.col("core"))) >= 3) | F.col("core").contains("@"))
    return t.where(like).withColumn("end", F.col("start") + F.length("core"))


def _totals(keyed: DataFrame, text: Column, patterns: DataFrame) -> DataFrame:
    """``pattern``, ``total``: how many words of the corpus each of the patterns goes with. Rows of equal keys count once."""
    key = F.when(F.col("pattern").startswith("in "), F.col("pattern")).otherwise(F.regexp_replace("pattern", "^[a-z]+ ", ""))
    patterns = checkpointed(patterns.select("pattern", key.alias("key")))
    few = patterns.limit(MAX_BROADCAST_PATTERNS + 1).count() <= MAX_BROADCAST_PATTERNS
    # Rows of equal keys are counted apart, by the rows of their key.
    repeats = checkpointed(keyed.groupBy("_k", "_k2").agg(F.count("*").alias("copies")).where("copies > 1"))
    n_repeats = repeats.limit(MAX_BROADCAST_REPEATS + 1).count()
    texts = keyed.select("_k", "_k2", F.split(F.trim(text, F.lit(" \t\n\x0b\x0c\r")), f"{WS_CLASS}+", -1).alias("_words"))
    if n_repeats:
        texts = texts.join(F.broadcast(repeats) if n_repeats <= MAX_BROADCAST_REPEATS else repeats, ["_k", "_k2"], "left")
    copies = F.coalesce("copies", F.lit(1)) if n_repeats else F.lit(1)
    words = texts.select(copies.cast("long").alias("copies"), (F.size("_words") - 1).alias("_last"), F.posexplode("_words").alias("_at", "_word"))
    label = F.when(F.col("_word").rlike(rf"^[(\[\"']*{LABEL}."), F.concat(F.lit("in "), F.lower(F.regexp_extract("_word", rf"^[(\[\"']*({LABEL})", 1))))
    keys = F.when(F.col("_word").rlike("[=:]"), F.array(F.lower("_word"), label)).otherwise(F.array(F.lower("_word")))
    words = words.select("copies", (F.col("_at") < F.col("_last")).alias("next"), (F.col("_at") > 0).alias("previous"), F.explode(keys).alias("key"))
    known = patterns.select("key").distinct()
    words = words.join(F.broadcast(known) if few else known, "key", "left_semi")
    counts = words.groupBy("key", "copies").agg(F.count_if("next").alias("a"), F.count_if("previous").alias("b"), F.count("*").alias("i"))
    counts = counts.groupBy("key").agg(*[F.sum(F.expr(f"{c} div copies")).alias(c) for c in ("a", "b", "i")])
    side = F.substring("pattern", 1, 1)
    total = F.when(side == "i", F.col("i")).when(F.col("pattern").startswith("after "), F.col("a")).otherwise(F.col("b"))
    return patterns.join(counts, "key").select("pattern", total.alias("total"))


def discovered(keyed: DataFrame, text: Column, matches: DataFrame) -> DataFrame:
    """Spans (_k, _k2, kind, start, end) that high-confidence patterns add to the fixed ones."""
    instances = checkpointed(_instances(matches))
    edges = instances.select(F.explode("patterns").alias("pattern"), "core", "seed").groupBy("pattern", "core").agg(F.count("*").alias("n"), F.max("seed").alias("seed"))
    edges = checkpointed(edges)
    strong = edges.groupBy("pattern").agg(F.count("*").alias("cores")).where(F.col("cores") >= MIN_SEEDS).select("pattern")
    totals = checkpointed(_totals(keyed, text, strong))
    edges = checkpointed(edges.join(totals, "pattern"))
    beliefs = checkpointed(edges.groupBy("core").agg(F.max("seed").alias("kind"), F.max("seed").isNotNull().alias("is_seed")).withColumn("belief", F.when(F.col("is_seed"), 1.0).otherwise(0.0)))
    scores = totals.select("pattern", F.lit(0.0).alias("confidence"), F.lit(None).cast("string").alias("kind"))
    while True:
        by_kind = edges.select("pattern", "core", "n", "total").join(beliefs, "core").groupBy("pattern", "total", "kind").agg(
            F.count_if(F.col("belief") >= MIN_CONFIDENCE).alias("seeds"), F.sum(F.col("n") * F.col("belief")).alias("mass")
        )
        new = by_kind.groupBy("pattern", "total").agg(F.max(F.struct("seeds", "kind")).alias("m"), F.sum("seeds").alias("seeds"), F.sum("mass").alias("mass"))
        confidence = F.when(F.col("seeds") >= MIN_SEEDS, F.least(F.lit(1.0), F.col("mass") / F.greatest("total", F.lit(1)))).otherwise(0.0)
        new = checkpointed(new.select("pattern", confidence.alias("confidence"), F.col("m.kind").alias("kind")))
        rise = new.join(scores.select("pattern", F.col("confidence").alias("old")), "pattern").agg(F.max(F.col("confidence") - F.col("old"))).first()[0]
        scores = new
        if rise is None or rise <= RISE:
            break
        best = edges.select("pattern", "core").join(scores.where("confidence > 0"), "pattern").groupBy("core").agg(F.max(F.struct("confidence", "kind")).alias("b"))
        told = beliefs.join(best, "core", "left")
        beliefs = checkpointed(
            told.select("core", F.when(F.col("is_seed"), F.col("kind")).otherwise(F.col("b.kind")).alias("kind"), "is_seed", F.when(F.col("is_seed"), 1.0).otherwise(F.coalesce("b.confidence", F.lit(0.0))).alias("belief"))
        )
    good = scores.where(F.col("confidence") >= MIN_CONFIDENCE)
    spans = instances.where("seed IS NULL").select("_k", "_k2", "start", "end", F.explode("patterns").alias("pattern")).join(good, "pattern")
    return spans.groupBy("_k", "_k2", "start", "end").agg(F.max(F.struct("confidence", "kind")).alias("b")).select("_k", "_k2", "b.kind", "start", "end")


def personal_spans(keyed: DataFrame, text: Column) -> DataFrame:
    """(_k, _k2, kind, start, end, base) of all personal data in the texts of ``keyed``."""
    matches = checkpointed(_matches(keyed, text))
    base = matches.where("kind <> 'token'").select("_k", "_k2", "kind", "start", "end", F.lit(True).alias("base"))
    more = discovered(keyed, text, matches).withColumn("base", F.lit(False))
    return checkpointed(base.unionByName(more))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, Column]:
    row = F.col("row")
    return packed(docs).select("row", *row_keys(row[id_col], row[text_col])), F.coalesce(row[text_col], F.lit(""))


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``row`` (the caller's columns) and ``spans``: array of (order of the kind, start, end, kind, base), sorted.

    Null and empty texts have none (an empty array). Rows equal in id and text have the same spans.
    """
    keyed, text = _keyed(docs, id_col, text_col)
    order = reduce(lambda c, k: c.when(F.col("kind") == k, KINDS.index(k)), KINDS[1:], F.when(F.col("kind") == KINDS[0], 0))
    found = personal_spans(keyed, text).withColumn("o", order)
    found = found.groupBy("_k", "_k2").agg(F.sort_array(F.collect_list(F.struct("o", "start", "end", "kind", "base"))).alias("spans"))
    return keyed.join(found, ["_k", "_k2"], "left").select("row", F.coalesce("spans", F.array().cast(found.schema["spans"].dataType)).alias("spans"))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with its own columns, every span replaced by its kind in brackets; spans that overlap become one."""
    keyed, text = _keyed(docs, id_col, text_col)
    w = Window.partitionBy("_k", "_k2").orderBy("start", F.desc("end"), "kind")
    spans = personal_spans(keyed, text).withColumn("reach", F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    spans = spans.withColumn("island", F.sum(F.when(F.col("start") < F.col("reach"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    islands = spans.groupBy("_k", "_k2", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min(F.struct("start", "kind")).alias("m"))
    cuts = islands.groupBy("_k", "_k2").agg(F.sort_array(F.collect_list(F.struct("start", "end", F.col("m.kind").alias("kind")))).alias("cuts"))
    c = F.col("cuts")
    holders = F.create_map(*[x for k in KINDS for x in (F.lit(k), F.lit(PLACEHOLDERS[k]))])
    before = lambda i: F.when(i > 0, F.get(c, i - 1)["end"]).otherwise(0)
    pieces = F.transform(c, lambda x, i: F.concat(F.substring(text, (before(i) + 1).cast("int"), (x["start"] - before(i)).cast("int")), holders[x["kind"]]))
    clean = F.concat(F.array_join(pieces, ""), F.substring(text, (F.element_at(c, -1)["end"] + 1).cast("int"), F.length(text)))
    new = F.when(c.isNotNull(), clean).otherwise(F.col("row")[text_col])
    joined = keyed.join(cuts, ["_k", "_k2"], "left").withColumn("_new", new)
    replaced = {text_col: F.col("_new")}
    if chars_col in docs.columns:
        replaced[chars_col] = F.when(c.isNotNull(), F.length("_new").cast("long")).otherwise(F.col("row")[chars_col]).cast(docs.schema[chars_col].dataType)
    return unpacked(joined, docs.columns, replaced)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find_personal_data(table(spark, sf_dir, "documents").select("doc_id", "text")).select("row.doc_id", "spans")
    base = F.filter("spans", lambda s: s["base"])
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda k: F.size(F.filter(base, lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return out.select("doc_id", *[count(k) for k in KINDS], F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
