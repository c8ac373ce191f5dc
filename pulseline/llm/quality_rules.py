"""Quality rules: robust multivariate outliers by minimum covariance determinant, in DataFrame functions only.

Every text gives counts; a few base rules reject on counts alone. The others are judged by STATISTICS, transformed
ratios of the counts. For each language and source a robust centre and covariance are found by concentration: each step keeps
the share COVER of the group's vectors with the least Mahalanobis distance and takes their mean and covariance, so up to
1 - COVER of a group may be junk without moving the estimate. Steps go from three starts (medians with median deviations, then the same with
the covariance of the vectors' directions, and of their hyperbolic tangents), each until no determinant moves or STEPS are done; the start
that ends in the least determinant gives the estimate. Its covariance is multiplied by CONSISTENT, which makes that of the inner COVER of
normal vectors the covariance of all. A floor on each variance (FLOOR squared) keeps near-constant statistics from
making trifles outliers. A vector is rejected if its squared distance is over CUTOFF.

A group of fewer than LEAST vectors takes the estimate of its language, and that of all texts where the language is
as small: a covariance of so few vectors means nothing. Medians and cut-offs are mergeable sketches and sums, so a source
with a third of all rows is aggregated before it is shuffled; the table of estimates has one row a group. Sketches are exact for groups of up to 1,000 vectors.

Edge cases: null and empty texts have zero counts and fail the base rules. Null languages and sources are groups of
their own. Rows are judged one by one, so ties and repeated rows are judged alike; extra columns are not read. A very long text
takes time in proportion to n log n of its words. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, forget, table

BLANK = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
STATISTICS = ("word_length", "symbols", "capitals", "dup_lines", "repeats")
FLOOR = {"word_length": 0.12, "symbols": 0.12, "capitals": 0.08, "dup_lines": 0.12, "repeats": 0.12}
COVER, STEPS, LEAST = 0.75, 20, 60
#: COVER over the share of chi-square with seven degrees below the COVER quantile of that with five.
CONSISTENT = 1.41
#: A step that moves no log-determinant by more than this is the last.
SETTLED = 1e-3
#: Most units whose estimates (some 200 bytes each) are broadcast; beyond, they are joined.
BROADCAST = 50_000
#: Squared distance: far beyond the 1e-6 quantile (36) of chi-square with five degrees, as clean texts have heavy tails.
CUTOFF = 60.0


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, also where body uses it inside a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def _repeated(words: Column) -> Column:
    """Words in five-word windows that occur twice or more in the text."""

    def of_places(p: Column) -> Column:
        # a repeated window adds the words that the repeated one before it doesn't cover
        added = F.transform(p, lambda x, i: F.when(i == 0, 5).otherwise(F.least(F.lit(5), x - F.get(p, i - 1))))
        return F.aggregate(added, F.lit(0), lambda n, x: n + x)

    def of_windows(w: Column) -> Column:
        # equal windows are neighbours once sorted, so a text of any length takes n log n steps
        order = F.array_sort(F.transform(w, lambda x, i: F.struct(x.alias("w"), i.alias("i"))))
        same = lambda s, x, k: F.get(s, k)["w"].eqNullSafe(x["w"])
        twice = let(order, lambda s: F.transform(F.filter(s, lambda x, k: same(s, x, k - 1) | same(s, x, k + 1)), lambda x: x["i"]))
        return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(let(F.array_sort(twice), of_places))

    hashes = lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - 5), lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(5))))
    windows = let(F.transform(words, lambda w: F.xxhash64(w)), hashes)
    return F.when(F.size(words) >= 5, let(windows, of_windows)).otherwise(F.lit(0))


def text_counts(docs: DataFrame) -> DataFrame:
    """Adds the counts of column text to docs (as long)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    out = docs.select(
        "*",
        F.array_remove(F.split(text, "[ \\t\\n\\x0B\\f\\r]+"), "").alias("_words"),
        F.filter(F.split(text, "\n"), lambda x: F.length(_without(x, BLANK)) > 0).alias("_lines"),
    )
    long = lambda c, name: c.cast("long").alias(name)
    solid = _without(text, BLANK)
    return out.select(
        *docs.columns,
        long(F.size("_words"), "n_words"),
        long(F.length(solid), "word_chars"),
        long(F.length(text) - F.length(_without(text, SYMBOLS)), "n_symbols"),
        long(F.size("_lines") - F.size(F.array_distinct("_lines")), "n_dup_lines"),
        long(_repeated(F.col("_words")), "n_repeat_words"),
        long(F.size("_lines"), "n_lines"),
        long(F.length(solid) - F.length(F.regexp_replace(solid, "\\p{Lu}+", "")), "n_capitals"),
    )


def _vector(counts: DataFrame) -> DataFrame:
    words, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    share = lambda a, b: F.asin(F.sqrt(F.least(F.lit(1.0), a / b)))  # noqa: E731  variance-stabilising for shares
    return counts.withColumns({
        "word_length": F.log(chars / words),
        "symbols": F.log1p(F.col("n_symbols") * 4 / words),
        "capitals": share(F.col("n_capitals"), chars),
        "dup_lines": share(F.col("n_dup_lines"), F.greatest(F.col("n_lines"), F.lit(1))),
        "repeats": share(F.col("n_repeat_words"), words),
    })


PAIRS = [(i, j) for i in range(len(STATISTICS)) for j in range(i + 1)]


def _centre(i: int) -> str:
    return f"m_{i}"


def _factor(i: int, j: int) -> str:
    return f"l_{i}_{j}"


def _cholesky(estimates: DataFrame) -> DataFrame:
    """Adds the lower Cholesky factor l_i_j of the covariance c_i_j, column by column."""
    for j in range(len(STATISTICS)):
        for i in range(j, len(STATISTICS)):
            rest = F.col(f"c_{i}_{j}")
            for k in range(j):
                rest -= F.col(_factor(i, k)) * F.col(_factor(j, k))
            floor = FLOOR[STATISTICS[j]] ** 2
            value = F.sqrt(F.greatest(rest, F.lit(floor))) if i == j else rest / F.col(_factor(j, j))
            estimates = estimates.withColumn(_factor(i, j), value)
    return estimates.select("unit", *(_centre(i) for i in range(len(STATISTICS))), *(f"c_{i}_{j}" for i, j in PAIRS), *(_factor(i, j) for i, j in PAIRS))


def _beside(rows: DataFrame, by_unit: DataFrame, few: bool) -> DataFrame:
    """rows with their unit's row of by_unit, not left dealt out by unit, so that what follows is aggregated before a shuffle."""
    return rows.join(F.broadcast(by_unit), "unit") if few else rows.join(by_unit, "unit").hint("rebalance")


def _distances(vectors: DataFrame, estimates: DataFrame, few: bool) -> DataFrame:
    """Adds d2, the squared Mahalanobis distance to the unit's estimate, by forward substitution."""
    out = _beside(vectors, estimates.select("unit", *(_centre(i) for i in range(len(STATISTICS))), *(_factor(i, j) for i, j in PAIRS)), few)
    for i, name in enumerate(STATISTICS):
        rest = F.col(name) - F.col(_centre(i))
        for k in range(i):
            rest -= F.col(_factor(i, k)) * F.col(f"z_{k}")
        out = out.withColumn(f"z_{i}", rest / F.col(_factor(i, i)))
    return out.withColumn("d2", sum((F.col(f"z_{i}") * F.col(f"z_{i}") for i in range(1, len(STATISTICS))), F.col("z_0") * F.col("z_0")))


def _moments(kept: DataFrame) -> DataFrame:
    """Means and covariances of each unit, as sums that are merged before the shuffle."""
    means = [F.avg(s).alias(_centre(i)) for i, s in enumerate(STATISTICS)]
    covs = [F.covar_pop(STATISTICS[i], STATISTICS[j]).alias(f"c_{i}_{j}") for i, j in PAIRS]
    return kept.groupBy("unit").agg(*means, *covs)


def _floor(i: int, j: int) -> Column:
    return F.lit(FLOOR[STATISTICS[i]] ** 2 if i == j else 0.0)


def _floored(estimates: DataFrame) -> DataFrame:
    """Variances with their floor."""
    return estimates.withColumns({f"c_{i}_{j}": F.col(f"c_{i}_{j}") + _floor(i, j) for i, j in PAIRS})


def _log_det() -> Column:
    return sum((F.log(F.col(_factor(i, i))) for i in range(1, len(STATISTICS))), F.log(F.col(_factor(0, 0)))) * 2


def _starts(vectors: DataFrame, few: bool) -> DataFrame:
    """Three rows a unit, whose names end in the start's number: centre and covariance to start from."""
    medians = vectors.groupBy("unit").agg(*(F.percentile_approx(s, 0.5, 1000).alias(_centre(i)) for i, s in enumerate(STATISTICS)))
    medians = cut(medians, "mcd-medians")
    spread = _beside(vectors, medians, few).groupBy("unit").agg(*(F.percentile_approx(F.abs(F.col(s) - F.col(_centre(i))), 0.5, 1000).alias(f"d_{i}") for i, s in enumerate(STATISTICS)))
    spread = spread.join(medians, "unit").withColumns({f"d_{i}": F.sqrt(F.pow(1.4826 * F.col(f"d_{i}"), 2) + F.lit(FLOOR[s] ** 2)) for i, s in enumerate(STATISTICS)})
    spread = cut(spread, "mcd-spread")
    scaled = _beside(vectors, spread, few).select("unit", *(((F.col(s) - F.col(_centre(i))) / F.col(f"d_{i}")).alias(f"u_{i}") for i, s in enumerate(STATISTICS)))
    length = F.sqrt(sum((F.col(f"u_{i}") * F.col(f"u_{i}") for i in range(1, len(STATISTICS))), F.col("u_0") * F.col("u_0")))
    scaled = scaled.withColumn("length", F.when(length > 0, length).otherwise(F.lit(1.0)))
    turned = [F.covar_pop(F.col(f"u_{i}") / F.col("length"), F.col(f"u_{j}") / F.col("length")).alias(f"s_{i}_{j}") for i, j in PAIRS]
    bent = [F.covar_pop(F.tanh(f"u_{i}"), F.tanh(f"u_{j}")).alias(f"t_{i}_{j}") for i, j in PAIRS]
    shapes = scaled.groupBy("unit").agg(*turned, *bent).join(spread, "unit")
    size = lambda i, j: F.col(f"d_{i}") * F.col(f"d_{j}")
    kinds = [
        lambda i, j: size(i, j) if i == j else F.lit(0.0),
        lambda i, j: F.col(f"s_{i}_{j}") * size(i, j) * len(STATISTICS),
        lambda i, j: F.col(f"t_{i}_{j}") * size(i, j),
    ]
    each = [F.struct(_at_start(F.lit(k)).alias("unit"), *(_centre(i) for i in range(len(STATISTICS))), *(kind(i, j).alias(f"c_{i}_{j}") for i, j in PAIRS)) for k, kind in enumerate(kinds)]
    return _floored(shapes.select(F.inline(F.array(*each))))


def _at_start(k: Column) -> Column:
    return F.concat("unit", F.lit("\x1e"), k)


def robust_estimates(vectors: DataFrame, few: bool, steps: int = STEPS) -> DataFrame:
    """One row a unit: centre and Cholesky factor of the minimum-covariance-determinant estimate of vectors(unit, ...)."""
    estimates = cut(_cholesky(_starts(vectors, few)), "mcd-start")
    dealt = cut(vectors.withColumn("k", F.explode(F.array(*map(F.lit, range(3))))).select(_at_start(F.col("k")).alias("unit"), *STATISTICS), "mcd-vectors")
    for _ in range(steps):
        far = _distances(dealt, estimates, few).select("unit", "d2", *STATISTICS)
        limits = far.groupBy("unit").agg(F.percentile_approx("d2", COVER, 1000).alias("limit"))
        new = cut(_cholesky(_floored(_moments(_beside(far, limits, few).filter("d2 <= limit")))), "mcd-step")
        both = new.select("unit", _log_det().alias("now")).join(estimates.select("unit", _log_det().alias("was")), "unit")
        moved = both.filter(F.abs(F.col("now") - F.col("was")) > SETTLED).limit(1).count()
        forget(estimates)
        estimates = new
        if not moved:
            break
    forget(dealt)
    best = estimates.select("unit", _log_det().alias("log_det")).groupBy(F.substring_index("unit", "\x1e", 1).alias("own")).agg(F.min_by("unit", F.struct("log_det", "unit")).alias("unit"))
    best = estimates.join(best, "unit").drop("unit").withColumnRenamed("own", "unit")
    whole = {f"c_{i}_{j}": (F.col(f"c_{i}_{j}") - _floor(i, j)) * CONSISTENT + _floor(i, j) for i, j in PAIRS}
    return cut(_cholesky(cut(best.withColumns(whole), "mcd-best")), "mcd-estimates")


def quality_rules(docs: DataFrame, cutoff: float = CUTOFF, least: int = LEAST, carry: bool = False) -> DataFrame:
    """(doc_id, counts..., base_failed, kept, distance) for each row of docs(doc_id, text, lang, source).

    With carry, column doc holds the whole row of docs, so that decisions needn't be joined back to texts.
    """
    whole = [F.struct("*").alias("doc")] if carry else []
    counts = text_counts(docs.select("doc_id", "text", "lang", "source", *whole)).drop("text")
    held = ["doc"] if carry else []
    failed = (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)
    rows = cut(_vector(counts.withColumn("base_failed", failed)), "quality-counts")
    name = lambda *cs: F.concat_ws("\x1f", *(F.coalesce(F.concat(F.lit("="), c), F.lit("null")) for c in cs))
    groups = rows.filter("not base_failed").groupBy("lang", "source").agg(F.count("*").alias("n"))
    groups = groups.select(F.col("lang").alias("g_lang"), F.col("source").alias("g_source"), "n")
    by_lang = groups.groupBy(F.col("g_lang").alias("l_lang")).agg(F.sum("n").alias("m"))
    units = groups.join(by_lang, F.col("g_lang").eqNullSafe(F.col("l_lang")))
    own, wide = name(F.lit("g"), F.col("g_lang"), F.col("g_source")), name(F.lit("l"), F.col("g_lang"))
    units = units.withColumn("unit", F.when(F.col("n") >= least, own).when(F.col("m") >= least, wide).otherwise(F.lit("all")))
    units = cut(units.select("g_lang", "g_source", "unit", wide.alias("wide")), "quality-units")
    # a vector takes part in its own unit, and in those of its language or of all if some group falls back on them
    used = units.select("unit").distinct()
    body = rows.filter("not base_failed").join(units, F.col("lang").eqNullSafe(F.col("g_lang")) & F.col("source").eqNullSafe(F.col("g_source")))
    all_units = F.array(name(F.lit("g"), F.col("lang"), F.col("source")), F.col("wide"), F.lit("all"))
    vectors = body.select(F.explode(all_units).alias("unit"), *STATISTICS).join(used, "unit", "left_semi")
    few = used.count() <= BROADCAST
    estimates = robust_estimates(cut(vectors, "quality-vectors"), few)
    judged = _distances(body.select(*held, "doc_id", "unit", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", *STATISTICS), estimates, few)
    judged = judged.withColumn("kept", F.col("d2") <= cutoff)
    columns = (*held, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    lost = rows.filter("base_failed").select(*columns, F.lit(False).alias("kept"), F.lit(None).cast("double").alias("distance"))
    return judged.select(*columns, "kept", F.col("d2").alias("distance")).union(lost)


def op3_mcd_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


QUERIES = {"op3_mcd_quality_rules": op3_mcd_quality_rules}
SQL: dict[str, str] = {}
