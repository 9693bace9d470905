"""Quality rules: fixed limits, then robust multivariate outliers. DataFrame functions only.

Each text's statistics become a vector of five: log mean word length and arcsine-transformed
shares of symbols, repeated words, repeated lines and capitals. For each (language, source), for
each language and for all rows, a minimum-covariance-determinant estimate is made: concentration
steps from several deterministic starts (medians and quartile widths; all rows; signs of the
rows about their medians; their hyperbolic tangents), in each of which the ``HALF`` of the rows
with the least Mahalanobis distances give the next mean and covariance. After ``TRIAL`` steps the
start with the least determinant goes on, until no group's determinant falls any more; the least
that was seen is kept. A text is rejected when its distance to its group's estimate exceeds a
chi-square quantile.

All estimates are mergeable aggregates (percentiles of values rounded to bins of a hundredth,
means and covariances), so a source with a third of all rows is summed in its map tasks first.
The Cholesky factor of a covariance, with the floors on its diagonal, is an expression over its
columns; determinants are those of that regularised covariance. Groups with fewer than ``LEAST``
rows use their language's estimate, then that of all rows, then none.

Edge cases: null text is empty; a null language or source is a group of its own; a very long text
is one row, and its windows are compared by sorting; rows tied at the limit of a concentration
step all take part; repeated rows count as often as they occur; with fewer than ``LEAST`` rows in
all only the fixed limits apply; an empty table gives no rows. Only doc_id, text, lang and source
are read, so other columns may have any names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from deltaloom.llm._common import broadcast_if_small, discard, materialise, narrow, table

HALF = 0.75
#: Steps of every start before the best goes on.
TRIAL = 2
#: A determinant falls if its logarithm falls by more.
FALL = 1e-3
LEAST = 60
#: Probability that a clean, normally distributed vector is rejected.
ALPHA = 1e-9
#: Least standard deviation of each coordinate: what one word more or less does to short texts.
FLOOR = (0.06, 0.08, 0.10, 0.10, 0.06)
DIMS = len(FLOOR)
SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
CAPITALS = "".join(chr(c) for c in range(65, 91))
GRAM = 5


def gamma_p(a: float, x: float) -> float:
    """The regularised lower incomplete gamma function (series)."""
    if x <= 0:
        return 0.0
    if x > a + 200:
        return 1.0
    term = total = 1 / a
    n = a
    while term > total * 1e-16:
        n += 1
        term *= x / n
        total += term
    return min(1.0, total * math.exp(-x + a * math.log(x) - math.lgamma(a)))


def chi_square_quantile(df: int, p: float) -> float:
    lo, hi = 0.0, 400.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if gamma_p(df / 2, mid / 2) < p else (lo, mid)
    return hi


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, the base statistics and those the vectors need."""
    words = F.col("_words")
    n = F.col("n_words")
    count_out = lambda chars: F.length("_text") - F.length(F.translate("_text", chars, ""))
    gram = F.when(
        n >= GRAM,
        F.transform(
            F.sequence(F.lit(0), n.cast("int") - GRAM),
            lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(GRAM)]),
        ),
    ).otherwise(F.expr("cast(array() as array<bigint>)"))
    placed = F.sort_array(
        F.transform("_grams", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    )
    twins = F.filter(
        F.transform(
            "_placed",
            lambda s, k: F.when(
                s["h"].eqNullSafe(F.get("_placed", k - 1)["h"])
                | s["h"].eqNullSafe(F.get("_placed", k + 1)["h"]),
                s["i"],
            ),
        ),
        lambda i: i.isNotNull(),
    )
    covered = F.aggregate(
        F.sort_array("_twins"),
        F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-GRAM).alias("at")),
        lambda acc, i: F.struct(
            (acc["n"] + F.least(F.lit(GRAM), i - acc["at"])).cast("bigint").alias("n"),
            i.alias("at"),
        ),
        lambda acc: acc["n"],
    )
    lines = F.filter(F.split("_text", "\n"), lambda s: s.rlike(r"[^\x20\x09-\x0D]"))
    none = F.expr("cast(array() as array<struct<h:bigint,i:int>>)")
    return (
        narrow(docs, "doc_id", "text", "lang", "source")
        .withColumn("_text", F.coalesce("text", F.lit("")))
        .withColumn("_words", F.filter(F.split("_text", SPACE), lambda w: w != ""))
        .withColumn("n_words", F.size("_words").cast("long"))
        .withColumn("_grams", gram)
        # only texts with a repeated window sort theirs
        .withColumn(
            "_placed",
            F.when(F.size(F.array_distinct("_grams")) < F.size("_grams"), placed).otherwise(none),
        )
        .withColumn("_twins", twins)
        .withColumn("_lines", lines)
        .select(
            "doc_id",
            "lang",
            "source",
            "n_words",
            F.length(F.translate("_text", "\x20\t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
            count_out(SYMBOLS).cast("long").alias("n_symbols"),
            (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
            covered.alias("n_repeat_words"),
            F.size("_lines").cast("long").alias("_n_lines"),
            count_out(CAPITALS).cast("long").alias("_n_capitals"),
        )
        .withColumn(
            "base_failed",
            (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")),
        )
    )


def vector() -> list[Column]:
    """The five coordinates; shares of short texts are drawn towards zero."""
    share = lambda part, whole, more: F.asin(
        F.sqrt(F.least(F.lit(1.0), F.col(part) / (F.col(whole) + more)))
    )
    return [
        F.log((F.col("word_chars") + 100.0) / (F.col("n_words") + 20.0)),
        share("n_symbols", "n_words", 20.0),
        share("n_repeat_words", "n_words", 20.0),
        share("n_dup_lines", "_n_lines", 4.0),
        share("_n_capitals", "word_chars", 100.0),
    ]


def squared_distance(xs: list[Column], means: list[Column], factor: dict) -> Column:
    """Mahalanobis distance by forward substitution in the Cholesky factor."""
    ys: list[Column] = []
    for i in range(DIMS):
        left = xs[i] - means[i]
        for j in range(i):
            left = left - factor[i, j] * ys[j]
        ys.append(left / factor[i, i])
    total = ys[0] * ys[0]
    for y in ys[1:]:
        total = total + y * y
    return total


def with_factor(moments: DataFrame, scale: float) -> DataFrame:
    """Adds the Cholesky factor L_ij of scale * covariance + floors to rows with c_ij."""
    out = moments
    for i in range(DIMS):
        for j in range(i + 1):
            left = F.coalesce(F.col(f"c_{i}{j}"), F.lit(0.0)) * scale
            if i == j:
                left = left + FLOOR[i] ** 2
            for k in range(j):
                left = left - F.col(f"l_{i}{k}") * F.col(f"l_{j}{k}")
            if i == j:
                left = F.sqrt(F.greatest(left, F.lit(FLOOR[i] ** 2 / 4)))
            else:
                left = left / F.col(f"l_{j}{j}")
            out = out.withColumn(f"l_{i}{j}", left)
    return out


KEY = ["_level", "_lang", "_source"]
STARTS = ("quartiles", "all", "signs", "tanh")
XS = [f"x_{i}" for i in range(DIMS)]
PAIRS = [(i, j) for i in range(DIMS) for j in range(i + 1)]


def _distance() -> Column:
    return squared_distance(
        [F.col(x) for x in XS],
        [F.col(f"m_{i}") for i in range(DIMS)],
        {(i, j): F.col(f"l_{i}{j}") for i, j in PAIRS},
    )


def _by_level(stats: DataFrame) -> DataFrame:
    """Each row once for its (language, source), once for its language and once for all."""
    lang, source = (F.coalesce(c, F.lit("\0")) for c in ("lang", "source"))
    levels = F.array(
        *[
            F.struct(
                F.lit(n).alias("_level"),
                (lang if n else F.lit("")).alias("_lang"),
                (source if n == 2 else F.lit("")).alias("_source"),
            )
            for n in (2, 1, 0)
        ]
    )
    return stats.select(*XS, F.explode(levels).alias("_g")).select(*XS, "_g.*")


def log_determinant() -> Column:
    return 2 * sum((F.log(f"l_{i}{i}") for i in range(1, DIMS)), F.log("l_00"))


def _moments(xs: list[Column]) -> list[Column]:
    return [
        *[F.avg(x).alias(f"m_{i}") for i, x in enumerate(xs)],
        *[F.covar_pop(xs[i], xs[j]).alias(f"c_{i}{j}") for i, j in PAIRS],
    ]


def starts(rows: DataFrame) -> DataFrame:
    """For each group and start: its key, n, start, m_i and c_ij."""
    quartiles = rows.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("n"),
        *[
            F.percentile(F.round(x, 2), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(f"q_{i}")
            for i, x in enumerate(XS)
        ],
    )
    mid = [F.col(f"q_{i}")[1] for i in range(DIMS)]
    wide = [F.greatest((F.col(f"q_{i}")[2] - F.col(f"q_{i}")[0]) / 1.349, F.lit(FLOOR[i])) for i in range(DIMS)]
    quartiles = materialise(
        quartiles.select(*KEY, "n", *[m.alias(f"m_{i}") for i, m in enumerate(mid)], *[w.alias(f"w_{i}") for i, w in enumerate(wide)]),
        "mcd-quartiles",
    )
    first = quartiles.select(
        *KEY, "n", F.lit(STARTS[0]).alias("start"), *[f"m_{i}" for i in range(DIMS)],
        *[(F.col(f"w_{i}") ** 2 if i == j else F.lit(0.0)).alias(f"c_{i}{j}") for i, j in PAIRS],
    )
    near = rows.join(broadcast_if_small(quartiles), KEY)
    z = [(F.col(XS[i]) - F.col(f"m_{i}")) / F.col(f"w_{i}") for i in range(DIMS)]
    size = F.sqrt(sum((c * c for c in z[1:]), z[0] * z[0]))
    signs = [F.when(size > 0, c / size).otherwise(0.0) for c in z]
    bounded = [F.tanh(c) for c in z]
    kept = near.select(*KEY, "n", *XS, *[f"m_{i}" for i in range(DIMS)], *[f"w_{i}" for i in range(DIMS)],
                       *[c.alias(f"s_{i}") for i, c in enumerate(signs)], *[c.alias(f"t_{i}") for i, c in enumerate(bounded)])
    widths = [f"w_{i}" for i in range(DIMS)]
    made = kept.groupBy(*KEY, "n", *[f"m_{i}" for i in range(DIMS)], *widths).agg(
        F.struct(*_moments([F.col(x) for x in XS])).alias("_all"),
        F.struct(*_moments([F.col(f"s_{i}") for i in range(DIMS)])).alias("_signs"),
        F.struct(*_moments([F.col(f"t_{i}") for i in range(DIMS)])).alias("_tanh"),
    )
    others = made.select(*KEY, "n", F.lit("all").alias("start"), "_all.*")
    for name in STARTS[2:]:  # about the medians, in the units of the quartile widths
        others = others.union(
            made.select(
                *KEY, "n", F.lit(name).alias("start"), *[f"m_{i}" for i in range(DIMS)],
                *[(F.col(f"_{name}.c_{i}{j}") * DIMS * F.col(f"w_{i}") * F.col(f"w_{j}")).alias(f"c_{i}{j}") for i, j in PAIRS],
            )
        )
    return first.union(others)


def _concentrated(rows: DataFrame, now: DataFrame, scale: float) -> DataFrame:
    """One concentration step of every estimate of ``now``: its group's nearest rows give the next."""
    # distances in bins of one hundredth of their logarithm: exact to the bin, mergeable
    far = rows.join(broadcast_if_small(now), KEY).withColumn("_bin", F.round(F.log1p(_distance()), 2))
    bins = far.groupBy(*KEY, "start", "_bin").agg(F.count(F.lit(1)).alias("c"))
    upto = F.sum("c").over(Window.partitionBy(*KEY, "start").orderBy("_bin"))
    whole = F.sum("c").over(Window.partitionBy(*KEY, "start"))
    # a few hundred bins a group: the least that holds HALF of the group's rows
    limit = (
        bins.withColumns({"_upto": upto, "_whole": whole})
        .filter(F.col("_upto") >= HALF * F.col("_whole"))
        .groupBy(*KEY, "start")
        .agg(F.min("_bin").alias("_limit"))
    )
    limit = materialise(limit, "mcd-limit")
    near = far.join(broadcast_if_small(limit), [*KEY, "start"]).filter(F.col("_bin") <= F.col("_limit"))
    moments = near.groupBy(*KEY, "n", "start").agg(*_moments([F.col(x) for x in XS]))
    made = materialise(with_factor(moments, scale).withColumn("det", log_determinant()), "mcd")
    discard(limit)
    return made


def _least(estimates: DataFrame, by: list[str]) -> DataFrame:
    """Of the estimates with the same ``by``, that with the least determinant (ties: the first start)."""
    rest = [c for c in estimates.columns if c not in by]
    row = F.struct("det", "start", *[c for c in rest if c not in ("det", "start")])
    return estimates.groupBy(*by).agg(F.min(row).alias("_r")).select(*by, "_r.*")


def estimates(stats: DataFrame) -> DataFrame:
    """One row for each group: its key, n, start, log determinant det, means m_i and factor l_ij."""
    rows = _by_level(stats)
    cut = chi_square_quantile(DIMS, HALF)
    scale = HALF / gamma_p(DIMS / 2 + 1, cut / 2)  # makes the estimate consistent
    now = materialise(with_factor(starts(rows), 1.0).withColumn("det", log_determinant()), "mcd")
    for _ in range(TRIAL):
        now = _concentrated(rows, now, scale)
    cols = [*KEY, "n", "start", "det", *[f"m_{i}" for i in range(DIMS)], *[f"l_{i}{j}" for i, j in PAIRS]]
    best = materialise(_least(now.select(*cols), [*KEY, "n"]), "mcd-best")
    going = best
    while True:
        new = _concentrated(rows, going, scale).select(*cols)
        both = new.join(best.select(*KEY, F.col("det").alias("_old")), KEY)
        # groups whose determinant fell take further steps; each keeps its least
        going = materialise(both.filter(F.col("det") < F.col("_old") - FALL).drop("_old"), "mcd-going")
        if not going.take(1):
            return best.select(*cols)
        best = materialise(_least(best.select(*cols).union(going.select(*cols)), [*KEY, "n"]).select(*cols), "mcd-best")


def assess(docs: DataFrame) -> DataFrame:
    """The base statistics of each document, base_failed, distance and kept."""
    stats = statistics(docs)
    for x, column in zip(XS, vector(), strict=True):
        stats = stats.withColumn(x, column)
    stats = materialise(stats, "statistics")
    found = estimates(stats).filter(F.col("n") >= LEAST)
    cols = [f"m_{i}" for i in range(DIMS)] + [f"l_{i}{j}" for i, j in PAIRS]
    out = stats.withColumns(
        {"_lang": F.coalesce("lang", F.lit("\0")), "_source": F.coalesce("source", F.lit("\0"))}
    )
    out = out.withColumn("_all", F.lit(""))
    for level, on in ((2, ["_lang", "_source"]), (1, ["_lang"]), (0, ["_all"])):
        part = found.filter(F.col("_level") == level).withColumn("_all", F.lit(""))
        part = part.select(*on, F.struct(*cols).alias(f"_p{level}"))
        out = out.join(broadcast_if_small(part), on, "left")
    out = out.withColumn("_p", F.coalesce("_p2", "_p1", "_p0")).select("*", *[f"_p.{c}" for c in cols])
    limit = chi_square_quantile(DIMS, 1 - ALPHA)
    return out.withColumn("distance", F.sqrt(_distance())).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        (~F.col("base_failed") & F.coalesce(F.col("distance") <= math.sqrt(limit), F.lit(True))).alias("kept"),
        "distance",
    )


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assess(table(spark, sf_dir, "documents"))
