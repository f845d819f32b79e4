"""Quality rules: fixed rules on text statistics, then robust multivariate outliers (DataFrame functions only).

Per language and source, the minimum covariance determinant is sought by concentration steps: a location and scatter
give every document a Mahalanobis distance, the closest share ``SUPPORT`` gives the next location and scatter. They
start from three robust scatters (coordinate by coordinate, of bounded scores, of directions); after ``STEPS`` steps the
start with the smallest determinant goes on until its determinant falls no more. Documents that then lie within the
usual quantile give the final estimates, and a document whose distance from those is beyond the cutoff is rejected.
Documents of small groups are judged by the estimates of their whole language, those of small languages by the whole
corpus's.

A step is one aggregate: sums and cross products by group and octave part of the distance, with partial sums on the
map side, so that a hot source costs no more than any other. The share is cut off within those few rows a group.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pyspark.sql.window import Window

from .common import WORD_CLASS, WS_CLASS, checkpointed, packed, row_keys, table

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SUPPORT = 0.75
STEPS = 2
#: A step that lowers the logarithm of a determinant by less than this is the last one.
TOLERANCE = 0.01
#: Distances are binned by this part of an octave.
PARTS = 8
#: Smallest group that gets estimates of its own; smaller ones are judged by their language's, small languages by the corpus's.
MIN_GROUP = 40
#: Source of a language's pool, language and source of the corpus's.
ALL = "\0all"
#: Deviations that a corpus of fewer than MIN_GROUP documents is shrunk to, the more the fewer they are.
PRIOR = (1.2, 0.15, 0.40, 0.50, 0.40)
#: Distances aren't scaled up further than this: where most documents are alike, all scatter is FLOOR's.
MAX_SCALE = 5.0
#: Median of a chi-squared variable with five degrees of freedom, to which the median distance is scaled.
CHI2_MEDIAN = 4.351
#: Its 0.975 quantile, within which documents give the final estimates.
CHI2_INNER = 12.833
#: Scaled squared distance beyond which a document goes: far outside the 0.9999 quantile (25.7), as clean text has long tails.
CUTOFF = 225.0
#: Deviations added to the scatter: smaller differences don't matter, none is singular. Small enough that each statistic
#: alone can cross CUTOFF: the last two reach log1p(10) and log1p(5), which is 256 and 265 unscaled.
FLOOR = (0.15, 0.05, 0.10, 0.15, 0.11)
#: Repeats that any text may have: one line, and the words of one such line and its first copy.
FREE_LINES = 1
FREE_WORDS = 20
#: Up to so many groups the estimates (some 250 bytes each) are broadcast; beyond, the join is salted.
MAX_BROADCAST_GROUPS = 100_000
SALTS = 16
DIM = 5


def text_statistics(docs: DataFrame, text_col: str, keep: list[Column]) -> DataFrame:
    """``keep`` and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines of each whole text; null: empty."""
    t = docs.select(*keep, F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    kept = [c for c in t.columns if c != "_text"]
    bare = F.trim(F.col("_text"), F.lit(" \t\n\x0b\x0c\r"))
    lines = F.filter(F.split("_text", "\n", -1), lambda x: x.rlike(WORD_CLASS))
    t = t.select(
        *kept,
        F.when(F.length(bare) > 0, F.split(bare, f"{WS_CLASS}+", -1)).otherwise(F.array().cast("array<string>")).alias("_words"),
        F.regexp_count("_text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        lines.alias("_lines"),
        F.size(F.split("_text", "\n", -1)).cast("long").alias("n_lines"),
    )
    words, n = F.col("_words"), F.size("_words")
    t = t.select(
        *kept,
        n.cast("long").alias("n_words"),
        F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
        "n_symbols",
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        "n_lines",
        F.when(
            n >= 4, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))
        ).alias("_h"),
    )
    repeats = F.size(F.array_distinct("_h")) < F.size("_h")
    pairs = F.array_sort(F.zip_with("_h", F.sequence(F.lit(0), F.size("_h") - 1), lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    t = t.withColumn("_s", F.when(repeats, pairs)).drop("_h")
    s = F.col("_s")
    same = lambda i, j: F.get(s, i)["h"] == F.get(s, j)["h"]
    last = F.size(s) - 1
    found = F.filter(F.sequence(F.lit(0), last), lambda i: F.coalesce(same(i, i + 1), F.lit(False)) | F.when(i > 0, same(i, i - 1)).otherwise(False))
    t = t.withColumn("_p", F.when(s.isNotNull(), F.array_sort(F.transform(found, lambda i: F.get(s, i)["i"])))).drop("_s")
    p = F.col("_p")
    gaps = F.aggregate(F.sequence(F.lit(0), F.size(p) - 1), F.lit(0), lambda a, i: a + F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - F.get(p, i), F.lit(3))))
    return t.withColumn("n_repeat_words", F.when(p.isNotNull(), gaps).otherwise(0).cast("long")).drop("_p")


def _vector(s: DataFrame) -> list[Column]:
    """The transformed statistics: logarithms, so that tails are short and a ratio counts like its inverse."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    return [
        F.log1p(n.cast("double")),
        F.log(F.greatest(F.col("word_chars"), F.lit(1)) / n),
        F.log1p(20 * F.col("n_symbols") / n),
        F.log1p(10 * F.greatest(F.col("n_dup_lines") - FREE_LINES, F.lit(0)) / F.greatest(F.col("n_lines"), F.lit(1))),
        F.log1p(10 * F.greatest(F.col("n_repeat_words") - FREE_WORDS, F.lit(0)) / n),
    ]


_M = [f"m{i}" for i in range(DIM)]
_L = [f"l{i}{j}" for i in range(DIM) for j in range(i + 1)]
_S = [f"s{i}" for i in range(DIM)] + [f"s{i}{j}" for i in range(DIM) for j in range(i + 1)]
_X = [f"x{i}" for i in range(DIM)]
#: SQL text, as one select may refer to its own columns: a hundred short expressions are then one step of the plan.
_SUMS = [f"sum(x{i}) AS s{i}" for i in range(DIM)] + [f"sum(x{i} * x{j}) AS s{i}{j}" for i in range(DIM) for j in range(i + 1)]
_SOLVED = [f"(x{i} - m{i}{''.join(f' - l{i}{j} * z{j}' for j in range(i))}) / l{i}{i} AS z{i}" for i in range(DIM)]  # forward substitution: L z = x - m
_D2 = " + ".join(f"z{i} * z{i}" for i in range(DIM))


def _joined(rows: DataFrame, estimates: DataFrame, few: bool, by: list[str], how: str) -> DataFrame:
    """``rows`` with their group's estimates: few groups are broadcast, more are joined with hot ones split by a salt."""
    if few:
        return rows.join(F.broadcast(estimates), by, how)
    salted = estimates.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", F.pmod(F.hash(*_X), F.lit(SALTS))).join(salted, [*by, "_salt"], how).drop("_salt")


def _distances(rows: DataFrame, estimates: DataFrame, few: bool, by: list[str], how: str = "inner") -> DataFrame:
    """``rows`` with ``d2``, the squared Mahalanobis distance under its group's estimates (left join: null without any)."""
    scale = [c for c in ("scale",) if c in estimates.columns]
    return _joined(rows, estimates, few, by, how).selectExpr(*rows.columns, *scale, *_SOLVED, f"{_D2} AS d2").select(*rows.columns, "d2", *scale)


def _factored(groups: DataFrame, entry: Callable[[int, int], str], by: list[str], means: list[str] = _M) -> DataFrame:
    """Location, the Cholesky factor of the scatter whose entries ``entry(i, j)`` gives in SQL, and its log determinant."""
    cells = []
    for i in range(DIM):
        for j in range(i + 1):
            v = entry(i, j) + "".join(f" - l{i}{k} * l{j}{k}" for k in range(j))
            cells.append(f"sqrt(greatest({v}, 1e-6D)) AS l{i}{i}" if i == j else f"({v}) / l{j}{j} AS l{i}{j}")
    log_det = " + ".join(f"2 * ln(l{i}{i})" for i in range(DIM))
    return groups.selectExpr(*by, *means, *cells, f"{log_det} AS log_det").select(*by, *_M, *_L, "log_det")


def _estimated(sums: DataFrame, least: float, by: list[str]) -> DataFrame:
    """Estimates from a group's sums, with FLOOR added to the scatter; few documents: shrunk to PRIOR."""
    own = f"least(1D, n / {float(least)}D)"

    def entry(i: int, j: int) -> str:
        v = f"(s{i}{j} / n - m{i} * m{j})"
        return f"{own} * greatest({v}, 0D) + (1 - {own}) * {PRIOR[i] ** 2}D + {FLOOR[i] ** 2}D" if i == j else f"{own} * {v}"

    return _factored(sums, entry, by, [f"s{i} / n AS m{i}" for i in range(DIM)])


def _binned(rows: DataFrame, estimates: DataFrame, few: bool, by: list[str]) -> DataFrame:
    """Counts, sums and cross products by group and bin of the distance: what a step, a median and a truncation need."""
    seen = _distances(rows, estimates, few, by).withColumn("_b", F.expr(f"cast(floor({PARTS} * log2(greatest(d2, 1e-9D))) AS int)"))
    bins = checkpointed(seen.groupBy(*by, "_b").agg(F.count("*").cast("double").alias("n"), *map(F.expr, _SUMS)))
    group = f"PARTITION BY {', '.join(by)}"
    before = f"coalesce(sum(n) OVER ({group} ORDER BY _b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0D) AS _before"
    return bins.selectExpr("*", before, f"sum(n) OVER ({group}) AS _total")


def _closest(bins: DataFrame, support: float, by: list[str]) -> DataFrame:
    """Sums over the closest share of each group; the bin in which it ends counts in part."""
    share = f"least(1D, greatest(0D, ({support}D * _total - _before) / n))"
    return bins.groupBy(*by).agg(*[F.expr(f"sum({share} * {c}) AS {c}") for c in ("n", *_S)])


def _scale(bins: DataFrame, by: list[str]) -> DataFrame:
    """``scale``, which brings the median distance of each group to CHI2_MEDIAN."""
    inside = (F.col("_total") / 2 - F.col("_before")) / F.col("n")
    median = F.max(F.when(inside.between(0, 1), F.pow(F.lit(2.0), (F.col("_b") + inside) / PARTS)))
    return bins.groupBy(*by).agg(F.least(F.lit(MAX_SCALE), CHI2_MEDIAN / F.greatest(F.coalesce(median, F.lit(0.0)), F.lit(1e-6))).alias("scale"))


def _pools(rows: DataFrame, min_group: int) -> tuple[DataFrame, bool]:
    """Per (_lang, _source): ``judged``, the pool whose estimates its documents face, and ``pools``, all that they count for.

    A pool is the group itself, its language or the corpus. Also whether there are few enough groups to broadcast.
    """
    groups = checkpointed(rows.groupBy("_lang", "_source").agg(F.count("*").alias("n")))
    few = groups.limit(MAX_BROADCAST_GROUPS + 1).count() <= MAX_BROADCAST_GROUPS
    pool = lambda lang, source: F.struct(lang.alias("_lang"), source.alias("_source"))
    small = F.col("n") < min_group
    langs = groups.groupBy("_lang").agg(F.sum("n").alias("n_lang"), F.max(small).alias("some"))
    whole = langs.agg(F.coalesce(F.max(F.col("n_lang") < min_group), F.lit(False)).alias("whole"))
    groups = groups.join(langs, "_lang").crossJoin(F.broadcast(whole))
    own, of_lang, of_all = pool(F.col("_lang"), F.col("_source")), pool(F.col("_lang"), F.lit(ALL)), pool(F.lit(ALL), F.lit(ALL))
    rare = F.col("n_lang") < min_group
    pools = F.array_compact(F.array(F.when(~small, own), F.when(F.col("some") & ~rare, of_lang), F.when(F.col("whole"), of_all)))
    judged = F.when(~small, own).when(~rare, of_lang).otherwise(of_all)
    return checkpointed(groups.select("_lang", "_source", judged.alias("judged"), pools.alias("pools"))), few


def _with_pool(rows: DataFrame, groups: DataFrame, few: bool, pool: Column, how: str) -> DataFrame:
    """``rows`` with _lang and _source of a pool in the place of their own."""
    joined = _joined(rows, groups, few, ["_lang", "_source"], how).select(*rows.drop("_lang", "_source").columns, pool.alias("_pool"))
    return joined.select("*", "_pool._lang", "_pool._source").drop("_pool")


def _starts(rows: DataFrame, few: bool) -> DataFrame:
    """Three estimates for every group (``_start``), all around the medians: scales alone, and with correlations.

    Correlations are those of the bounded scores tanh(z) and of the directions z / |z|, where z are the deviations from
    the median over the median absolute one: no outlier moves them far.
    """
    by = ["_lang", "_source"]
    medians = checkpointed(rows.groupBy(*by).agg(*[F.percentile_approx(f"x{i}", 0.5, 10_000).alias(f"m{i}") for i in range(DIM)]))
    off = [F.percentile_approx(F.abs(F.col(f"x{i}") - F.col(f"m{i}")), 0.5, 10_000) for i in range(DIM)]
    scales = [F.sqrt(F.pow(1.4826 * off[i], 2) + FLOOR[i] ** 2).alias(f"a{i}") for i in range(DIM)]
    scales = checkpointed(_joined(rows, medians, few, by, "inner").groupBy(*by).agg(*[F.first(m).alias(m) for m in _M], *scales))
    z = _joined(rows, scales, few, by, "inner").selectExpr(*by, *[f"(x{i} - m{i}) / a{i} AS z{i}" for i in range(DIM)], f"sqrt({_D2} + 1e-12D) AS size")
    z = z.selectExpr(*by, *[f"tanh(z{i}) AS t{i}" for i in range(DIM)], *[f"z{i} / size AS d{i}" for i in range(DIM)])
    sums = [F.expr(f"sum({k}{i} * {k}{j}) AS {k}{i}{j}") for k in "td" for i in range(DIM) for j in range(i + 1)]
    found = scales.join(z.groupBy(*by).agg(*sums), by)

    def entry(kind: str | None) -> Callable[[int, int], str]:
        def of(i: int, j: int) -> str:
            if i == j:
                return f"a{i} * a{i}"
            return f"0.95D * coalesce(try_divide({kind}{i}{j}, sqrt({kind}{i}{i} * {kind}{j}{j})), 0D) * a{i} * a{j}" if kind else "0D"

        return of

    parts = [_factored(found, entry(kind), by).withColumn("_start", F.lit(k)) for k, kind in enumerate((None, "t", "d"))]
    return checkpointed(parts[0].unionByName(parts[1]).unionByName(parts[2]))


def minimum_covariance(rows: DataFrame, few: bool, support: float = SUPPORT, steps: int = STEPS, min_group: int = MIN_GROUP) -> DataFrame:
    """Estimates per (_lang, _source) from the columns x0 to x4: location, factor of the scatter, ``scale`` of distances.

    Every step that is taken lowers a determinant that FLOOR bounds from below, so the steps end; groups leave as they
    converge.
    """
    by, least = ["_lang", "_source"], support * min_group
    tried, each = _starts(rows, few), [*by, "_start"]
    wide = rows.withColumn("_start", F.explode(F.array(*map(F.lit, range(3)))))
    for _ in range(steps):
        tried = checkpointed(_estimated(_closest(_binned(wide, tried, few, each), support, each), least, each))
    held = [*_M, *_L, "log_det"]
    going = checkpointed(tried.groupBy(*by).agg(F.min_by(F.struct(*held), F.struct("log_det", "_start")).alias("e")).select(*by, "e.*"))
    ended = []
    while True:
        new = _estimated(_closest(_binned(rows, going, few, by), support, by), least, by)
        pairs = checkpointed(going.select(*by, F.struct(*held).alias("old")).join(new.select(*by, F.struct(*held).alias("new")), by))
        falls = F.col("new.log_det") < F.col("old.log_det") - TOLERANCE
        ended.append(pairs.where(~falls).select(*by, "old.*"))
        going = pairs.where(falls).select(*by, "new.*")
        if going.isEmpty():
            break
    best = ended[0]
    for more in ended[1:]:
        best = best.unionByName(more)
    bins = _binned(rows, best, few, by)
    inner = bins.join(_scale(bins, by), by).where(F.pow(F.lit(2.0), F.col("_b") / PARTS) * F.col("scale") <= CHI2_INNER)
    final = checkpointed(_estimated(inner.groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("n", *_S)]), min_group, by))
    return checkpointed(final.join(_scale(_binned(rows, final, few, by), by), by))


def judge_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", cutoff: float = CUTOFF) -> DataFrame:
    """One row per document: doc_id, its key, the statistics, ``base_failed``, ``distance`` and ``kept``.

    Every document that passes the fixed rules has a distance; one that fails them has none where its group has no other.
    Null texts have no words and so fail. Null languages and sources form groups of their own. Repeated rows count as
    often as they are there. The estimates come from documents that pass the fixed rules.
    """
    row = F.col("row")
    keep = [
        row[id_col].alias("doc_id"), *row_keys(row[id_col], row[text_col]),
        F.coalesce(row[lang_col].cast("string"), F.lit("\0null")).alias("_lang"), F.coalesce(row[source_col].cast("string"), F.lit("\0null")).alias("_source"),
    ]
    needed = list(dict.fromkeys([id_col, text_col, lang_col, source_col]))
    stats = text_statistics(packed(docs.select(*[f"`{c}`" for c in needed])).withColumn("_t", row[text_col]), "_t", keep)
    stats = stats.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))
    stats = checkpointed(stats.select("*", *[x.alias(f"x{i}") for i, x in enumerate(_vector(stats))]))
    passed = stats.where(~F.col("base_failed")).select("_lang", "_source", *[f"x{i}" for i in range(DIM)])
    groups, few = _pools(passed, MIN_GROUP)
    estimates = minimum_covariance(_with_pool(passed, groups, few, F.explode("pools"), "inner"), few)
    out = _distances(_with_pool(stats, groups, few, F.col("judged"), "left"), estimates, few, ["_lang", "_source"], "left").withColumn("distance", F.sqrt(F.col("d2") * F.col("scale")))
    kept = ~F.col("base_failed") & (F.col("distance") <= float(cutoff) ** 0.5)
    return out.withColumn("kept", kept).select("doc_id", "_k", "_k2", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance", "kept")


def filter_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", cutoff: float = CUTOFF) -> DataFrame:
    """The documents that are kept, with their own columns."""
    gone = judge_quality(docs, id_col, text_col, lang_col, source_col, cutoff).where(~F.col("kept")).select("_k", "_k2")
    keyed = packed(docs).select("row", *row_keys(F.col("row")[id_col], F.col("row")[text_col]))
    return keyed.join(gone, ["_k", "_k2"], "left_anti").select("row.*")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_quality(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")
