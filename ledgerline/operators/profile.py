"""Feature profiling (A11-A20, A13-A15, L5) over the analysis frame.

Column-wise statistics are computed in one wide aggregate (one pass, map-side
partial aggregation) and reshaped to long form on the tiny result.  Per-value
work (outlier flags) runs on the long form ``(ticker, date, feature, value)``
joined to a per-feature bounds table whose size is the number of features.

Exact quantiles never funnel a whole column into one task: see
:func:`grouped_quantiles`.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.functions.numeric import as_long, rnd, rnd_sig

# Numeric columns of the analysis frame, in table order (ids, user ids and
# timestamps are never features).
FEATURE_COLS = ("revenue", "operating_income", "net_income", "operating_cashflow",
                "total_assets", "total_liabilities", "profit_margin", "operating_margin",
                "revenue_growth", "net_income_growth", "asset_efficiency", "debt_to_asset")


def analysis_frame(std: DataFrame, cat: DataFrame) -> DataFrame:
    """Standard ⟕ category(sector, category, risk_level) on (ticker, date).
    Both sides come from the ticker-bucketed table, so the join is
    co-partitioned (no exchange)."""
    c = cat.select("ticker", "date", F.col("sector").alias("_sector"), "category", "risk_level")
    s = std.drop("sector") if "sector" in std.columns else std
    return s.join(c, ["ticker", "date"], "left").withColumnRenamed("_sector", "sector")


def numeric_columns(df: DataFrame, exclude=("id", "user_id", "created_at", "load_seq")) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.NumericType) and f.name not in exclude]


def long_values(df: DataFrame, cols, keys=("ticker", "date")) -> DataFrame:
    """(keys..., feature, value) with NULL values dropped."""
    lf = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in cols]) \
        .unpivot(list(keys), list(cols), "feature", "value")
    return lf.filter(F.col("value").isNotNull())


def _wide_to_long(row_df: DataFrame, cols, stats) -> DataFrame:
    """One-row frame with ``{col}__{stat}`` columns -> (feature, stat...)."""
    structs = [F.struct(F.lit(c).alias("feature"),
                        *[F.col(f"{c}__{s}").alias(s) for s in stats]) for c in cols]
    return row_df.select(F.explode(F.array(*structs)).alias("x")).select("x.*")


def feature_variance(df: DataFrame, cols=FEATURE_COLS) -> DataFrame:
    """Mean, sample σ, min, max and CV = σ/|mean| (0 when mean is 0)."""
    aggs = []
    for c in cols:
        aggs += [F.avg(c).alias(f"{c}__mean"), F.stddev_samp(c).alias(f"{c}__std_dev"),
                 F.min(c).cast("double").alias(f"{c}__min"),
                 F.max(c).cast("double").alias(f"{c}__max")]
    lf = _wide_to_long(df.agg(*aggs), cols, ("mean", "std_dev", "min", "max"))
    cv = F.when(F.col("mean") == 0, F.lit(0.0)).otherwise(F.col("std_dev") / F.abs("mean"))
    return lf.select("feature", rnd_sig("mean").alias("mean"), rnd_sig("std_dev").alias("std_dev"),
                     "min", "max", rnd_sig(cv).alias("coefficient_of_variation"))


def feature_statistics(df: DataFrame, cols=FEATURE_COLS) -> DataFrame:
    """Describe + CV + bias-corrected skewness (G1) and excess kurtosis."""
    lf = long_values(df, cols)
    q = grouped_quantiles(lf, "feature", "value", [0.25, 0.5, 0.75])
    qw = q.groupBy("feature").pivot("p", [0.25, 0.5, 0.75]).agg(F.first("q"))
    qw = qw.toDF("feature", "p25", "p50", "p75")
    m = lf.groupBy("feature").agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"), F.min("value").alias("min"),
        F.max("value").alias("max"), F.skewness("value").alias("g1"),
        F.kurtosis("value").alias("g2"))
    n = F.col("n").cast("double")
    skew = F.when(n > 2, F.col("g1") * F.sqrt(n * (n - 1)) / (n - 2))
    kurt = F.when(n > 3, ((n + 1) * F.col("g2") + 6) * (n - 1) / ((n - 2) * (n - 3)))
    out = m.join(qw, "feature")
    return out.select(
        "feature", as_long("n").alias("count"), rnd_sig("mean").alias("mean"),
        rnd_sig("std").alias("std"), "min", rnd_sig("p25").alias("p25"),
        rnd_sig("p50").alias("p50"), rnd_sig("p75").alias("p75"), "max",
        rnd_sig(F.when(F.col("mean") == 0, F.lit(0.0)).otherwise(F.col("std") / F.abs("mean")))
        .alias("cv"),
        rnd_sig(skew, 8).alias("skewness"), rnd_sig(kurt, 8).alias("kurtosis"))


def second_moments(df: DataFrame, cols) -> DataFrame:
    """(i, j, n, si, sj, pii, pjj, pij) for every pair i < j of columns over the rows
    where both are there.

    Rows are grouped by which columns are NULL: within a group all pairs share their
    rows, so one set of sums and products per group (combined before its shuffle) holds
    every pair; groups that hold both columns of a pair are added up.
    """
    k = len(cols)
    x = df.select(*[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(cols)])
    there = F.concat(*[F.when(F.col(f"x{i}").isNull(), "0").otherwise("1") for i in range(k)])
    g = x.groupBy(there.alias("there")).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(f"x{i}").alias(f"s{i}") for i in range(k)],
        *[F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"p{i}_{j}") for i in range(k) for j in range(i, k)])
    pairs = [F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.col("n").alias("n"), F.col(f"s{i}").alias("si"),
                      F.col(f"s{j}").alias("sj"), F.col(f"p{i}_{i}").alias("pii"), F.col(f"p{j}_{j}").alias("pjj"),
                      F.col(f"p{i}_{j}").alias("pij")) for i in range(k) for j in range(i + 1, k)]
    return g.select(F.inline(F.array(*pairs))).filter(F.col("pij").isNotNull()).groupBy("i", "j").agg(
        *[F.sum(c).alias(c) for c in ("n", "si", "sj", "pii", "pjj", "pij")])


def correlation_matrix(df: DataFrame, cols=FEATURE_COLS) -> DataFrame:
    """Pairwise-complete Pearson correlation, long form (all ordered
    pairs).  Zero variance or no common row gives NULL instead of an error."""
    cols = list(cols)
    n = F.nullif(F.col("n").cast("double"), F.lit(0.0))

    def centred(p, a, b):  # rounding of a constant column counts as no variance
        c = F.col(p) - F.col(a) * F.col(b) / n
        return F.when(F.abs(c) > 1e-13 * F.abs(p), c)

    vi, vj = centred("pii", "si", "si"), centred("pjj", "sj", "sj")
    cov = F.col("pij") - F.col("si") * F.col("sj") / n
    corr = second_moments(df, cols).select("i", "j", (cov / (F.sqrt(vi) * F.sqrt(vj))).alias("r"))
    every = df.sparkSession.createDataFrame(
        [(a, b, i, j, min(i, j), max(i, j)) for i, a in enumerate(cols) for j, b in enumerate(cols)],
        "feature_1 string, feature_2 string, i int, j int, lo int, hi int")
    both = every.join(F.broadcast(corr.withColumnsRenamed({"i": "lo", "j": "hi"})), ["lo", "hi"], "left")
    return both.select("feature_1", "feature_2", "i", "j", rnd(
        F.when(F.col("i") == F.col("j"), 1.0).otherwise(F.col("r")), 6).alias("correlation"))


def high_corr_pairs(corr: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Upper-triangle pairs with |r| > threshold."""
    return corr.filter((F.col("i") < F.col("j")) & (F.abs("correlation") > threshold)) \
        .select("feature_1", "feature_2", "correlation")


def redundant_features(corr: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Pairs with |r| > threshold and the removal recommendation."""
    return high_corr_pairs(corr, threshold).withColumn("recommendation", F.format_string(
        "Consider removing %s (highly correlated with %s)", "feature_2", "feature_1"))


def corr_importance(corr: DataFrame, target: str = "net_income", k: int = 8) -> DataFrame:
    """Features ranked by |corr| with the target, top k (a top-k
    report: the limit is the feature)."""
    c = corr.filter((F.col("feature_1") == target) & (F.col("feature_2") != target)
                    & F.col("correlation").isNotNull())
    return c.select(F.col("feature_2").alias("feature"),
                    F.abs("correlation").alias("importance")) \
        .orderBy(F.col("importance").desc(), F.col("feature")).limit(k)


# --------------------------------------------------------------- quantiles

#: KLL sketches of this size are off by about 0.1 % of the rows; a bracket is SLACK wide on both sides.
SKETCH_K, SLACK = 4096, 0.004
#: Values that are sorted at once to find an order statistic in its bracket.
HELD = 1 << 20


def grouped_quantiles(lf: DataFrame, key: str, value: str, probs) -> DataFrame:
    """Exact linear-interpolated quantiles of ``value`` per ``key``
    (pandas / ``quantile_cont`` definition) -> (key, p, q).

    1. a KLL sketch per key (combined before its shuffle) brackets the two order
       statistics around (N - 1)·p;
    2. one pass counts the values below the bracket and at its ends, however often they
       repeat, and sorts what lies strictly inside: at most HELD values, for wider
       brackets are first sketched again within;
    3. an order statistic outside its bracket (the sketch's rare miss) widens it and is
       looked for again, so the result is exact.

    Keys are few (columns, not entities): the brackets and the result are a row for each
    key and probability, kept as a local relation, so consumers don't run this again.
    """
    spark = lf.sparkSession
    vals = lf.filter(F.col(value).isNotNull()).select(F.col(key).alias("k"), F.col(value).cast("double").alias("v"))
    found, todo = {}, [float(p) for p in probs]
    slack, kind = SLACK, lf.schema[key].dataType.simpleString()
    keys = None
    while todo:
        cut = sorted({min(1.0, max(0.0, p + d)) for p in todo for d in (-slack, slack)})
        part = vals if keys is None else vals.filter(F.col("k").isin(keys))
        rows = part.groupBy("k").agg(
            F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_double("v", F.lit(SKETCH_K)).alias("s")).select(
            "k", "n", F.kll_sketch_get_quantile_double("s", F.array(*[F.lit(c) for c in cut])).alias("q")).collect()
        brackets = []
        for r in rows:
            for p in todo:
                if (r["k"], p) not in found:
                    a, b = (r["q"][cut.index(min(1.0, max(0.0, p + d)))] for d in (-slack, slack))
                    brackets.append((r["k"], p, (r["n"] - 1) * p, a, b, int(2 * slack * r["n"])))
        while any(b[5] > HELD for b in brackets):
            brackets = _narrowed(spark, part, brackets, kind, slack)
        found.update(_order_statistics(spark, part, brackets, kind))
        missed = [b for b in brackets if (b[0], b[1]) not in found]
        todo, keys, slack = sorted({b[1] for b in missed}), sorted({b[0] for b in missed}), min(1.0, slack * 8)
    return spark.createDataFrame([(k, p, q) for (k, p), q in found.items()], f"{key} {kind}, p double, q double")


def _bracketed(spark, vals: DataFrame, brackets, kind: str) -> DataFrame:
    """Each value with the brackets of its key (few rows, broadcast)."""
    own = spark.createDataFrame([b[:5] for b in brackets], f"k {kind}, p double, pos double, a double, b double")
    return vals.join(F.broadcast(own), "k").filter(F.col("v") <= F.col("b"))


def _narrowed(spark, vals: DataFrame, brackets, kind: str, slack: float):
    """The brackets of many values, sketched again over the values strictly inside them."""
    wide = [b for b in brackets if b[5] > HELD]
    strictly = (F.col("v") > F.col("a")) & (F.col("v") < F.col("b"))
    rows = _bracketed(spark, vals, wide, kind).groupBy("k", "p", "pos", "a", "b").agg(
        F.count_if(F.col("v") <= F.col("a")).alias("below"), F.count_if(strictly).alias("n"),
        F.kll_sketch_agg_double(F.when(strictly, F.col("v")), F.lit(SKETCH_K)).alias("s"))
    steps = 512  # the sketch is asked at fixed ranks
    out = [b for b in brackets if b[5] <= HELD]
    grid = F.array(*[F.lit(i / steps) for i in range(steps + 1)])
    for r in rows.select("k", "p", "pos", "a", "b", "below", "n", F.when(
            F.col("n") > 0, F.kll_sketch_get_quantile_double("s", grid)).alias("q")).collect():
        a, b, first, last = r["a"], r["b"], math.floor(r["pos"]), math.ceil(r["pos"])
        if last < r["below"]:
            b = a
        elif r["n"]:  # an end stays where an order statistic lies on it
            low, high = ((t - r["below"]) / r["n"] + d for t, d in ((first, -slack), (last, slack)))
            a = a if first < r["below"] else r["q"][max(0, math.floor(low * steps))]
            b = b if last >= r["below"] + r["n"] else r["q"][min(steps, math.ceil(high * steps))]
        out.append((r["k"], r["p"], r["pos"], a, b, int((2 * slack + 2 / steps) * r["n"]) if b > a else 0))
    return out


def _order_statistics(spark, vals: DataFrame, brackets, kind: str) -> dict:
    """(key, p) -> quantile, for those whose order statistics lie in their brackets."""
    if not brackets:
        return {}
    v, a, b = F.col("v"), F.col("a"), F.col("b")
    g = _bracketed(spark, vals, brackets, kind).groupBy("k", "p", "pos", "a", "b").agg(
        F.count_if(v < a).alias("below"), F.count_if(v == a).alias("at_a"),
        F.count_if((v == b) & (b > a)).alias("at_b"),
        F.sort_array(F.collect_list(F.when((v > a) & (v < b), v))).alias("inside"))

    def at(t):
        t = t.cast("long") - F.col("below")
        return (F.when(t < 0, F.lit(None)).when(t < F.col("at_a"), a)
                .when(t < F.col("at_a") + F.size("inside"), F.get("inside", (t - F.col("at_a")).cast("int")))
                .when(t < F.col("at_a") + F.size("inside") + F.col("at_b"), b))

    rows = g.select("k", "p", "pos", at(F.floor("pos")).alias("lo"), at(F.ceil("pos")).alias("hi")).collect()
    return {(r["k"], r["p"]): r["lo"] + (r["hi"] - r["lo"]) * (r["pos"] - math.floor(r["pos"]))
            for r in rows if r["lo"] is not None and r["hi"] is not None}


# --------------------------------------------------------------- outliers


def _q_bounds(lf: DataFrame, lo_p: float, hi_p: float) -> DataFrame:
    q = grouped_quantiles(lf, "feature", "value", [lo_p, hi_p])
    return q.groupBy("feature").agg(
        F.max(F.when(F.col("p") == lo_p, F.col("q"))).alias("q_lo"),
        F.max(F.when(F.col("p") == hi_p, F.col("q"))).alias("q_hi"))


def iqr_bounds(df: DataFrame, cols=FEATURE_COLS, k: float = 1.5) -> DataFrame:
    lf = long_values(df, cols)
    b = _q_bounds(lf, 0.25, 0.75)
    iqr = F.col("q_hi") - F.col("q_lo")
    return b.select("feature", F.col("q_lo").alias("q1"), F.col("q_hi").alias("q3"),
                    iqr.alias("iqr"), (F.col("q_lo") - k * iqr).alias("lower_bound"),
                    (F.col("q_hi") + k * iqr).alias("upper_bound"))


def outlier_rows(df: DataFrame, cols=FEATURE_COLS, k: float = 1.5) -> DataFrame:
    """A16 rows: (ticker, date, feature, value) outside the IQR fences.  The
    bounds table has one row per feature (bounded), so it is broadcast."""
    lf = long_values(df, cols)
    b = iqr_bounds(df, cols, k)
    j = lf.join(F.broadcast(b), "feature")
    return j.filter((F.col("value") < F.col("lower_bound")) | (F.col("value") > F.col("upper_bound"))) \
        .select("ticker", "date", "feature", "value")


def outliers_iqr(df: DataFrame, cols=FEATURE_COLS, k: float = 1.5) -> DataFrame:
    """A16 summary: count, % of non-null values, bounds per feature."""
    lf = long_values(df, cols)
    b = iqr_bounds(df, cols, k)
    j = lf.join(F.broadcast(b), "feature")
    flag = (F.col("value") < F.col("lower_bound")) | (F.col("value") > F.col("upper_bound"))
    g = j.groupBy("feature", "q1", "q3", "iqr", "lower_bound", "upper_bound").agg(
        F.count_if(flag).alias("outlier_count"), F.count(F.lit(1)).alias("n"))
    return g.select("feature", *[rnd_sig(c).alias(c) for c in
                                 ("q1", "q3", "iqr", "lower_bound", "upper_bound")],
                    as_long("outlier_count").alias("outlier_count"),
                    rnd(F.col("outlier_count") / F.col("n") * 100, 6).alias("outlier_percentage"))


def outliers_zscore(df: DataFrame, cols=FEATURE_COLS, threshold: float = 3.0) -> DataFrame:
    """|x - mean| / population σ > threshold, count and % per feature."""
    lf = long_values(df, cols)
    st = lf.groupBy("feature").agg(F.avg("value").alias("mu"), F.stddev_pop("value").alias("sd"))
    j = lf.join(F.broadcast(st), "feature")
    z = F.abs(F.col("value") - F.col("mu")) / F.nullif(F.col("sd"), F.lit(0.0))
    g = j.groupBy("feature").agg(F.count_if(z > threshold).alias("outlier_count"),
                                 F.count(F.lit(1)).alias("n"))
    return g.select("feature", as_long("outlier_count").alias("outlier_count"),
                    rnd(F.col("outlier_count") / F.col("n") * 100, 6).alias("outlier_percentage"))


def extreme_values(df: DataFrame, cols=FEATURE_COLS, percentile: float = 95.0) -> DataFrame:
    """Values below the (100-p)th / above the p-th percentile."""
    lf = long_values(df, cols)
    lo_p, hi_p = (100 - percentile) / 100, percentile / 100
    b = _q_bounds(lf, lo_p, hi_p)
    j = lf.join(F.broadcast(b), "feature")
    g = j.groupBy("feature", "q_lo", "q_hi").agg(
        F.count_if(F.col("value") < F.col("q_lo")).alias("low"),
        F.count_if(F.col("value") > F.col("q_hi")).alias("high"))
    return g.select("feature", rnd_sig("q_lo").alias("lower_bound"),
                    rnd_sig("q_hi").alias("upper_bound"),
                    as_long("low").alias("extreme_low_count"),
                    as_long("high").alias("extreme_high_count"),
                    as_long(F.col("low") + F.col("high")).alias("extreme_values_total"))


def flag_anomalies(df: DataFrame) -> DataFrame:
    """Per column NULL / ±inf / zero counts and % of all rows.  Zero and
    inf counts only apply to numeric columns."""
    aggs = [F.count(F.lit(1)).alias("__rows")]
    names = []
    for f in df.schema.fields:
        c, names = F.col(f.name), names + [f.name]
        num = isinstance(f.dataType, T.NumericType)
        flt = isinstance(f.dataType, (T.DoubleType, T.FloatType))
        aggs += [F.count_if(c.isNull()).alias(f"{f.name}__nan_count"),
                 (F.count_if(F.abs(c) == F.lit(math.inf)) if flt else F.lit(0)).alias(f"{f.name}__inf_count"),
                 (F.count_if(c == 0) if num else F.lit(0)).alias(f"{f.name}__zero_count")]
    row = df.agg(*aggs)
    structs = [F.struct(F.lit(n).alias("column"),
                        F.col(f"{n}__nan_count").cast("bigint").alias("nan_count"),
                        F.col(f"{n}__inf_count").cast("bigint").alias("inf_count"),
                        F.col(f"{n}__zero_count").cast("bigint").alias("zero_count")) for n in names]
    lf = row.select("__rows", F.explode(F.array(*structs)).alias("x")).select("__rows", "x.*")
    tot = F.col("nan_count") + F.col("inf_count") + F.col("zero_count")
    return lf.select("column", "nan_count", "inf_count", "zero_count",
                     tot.alias("total_anomalies"),
                     rnd(F.when(F.col("__rows") > 0, tot / F.col("__rows") * 100)
                         .otherwise(F.lit(0.0)), 6).alias("anomaly_percentage"))


def outlier_recommendations(df: DataFrame, cols=FEATURE_COLS) -> DataFrame:
    """Severity rules over IQR outliers (>10% high, >5% medium, else low)
    and anomalies (NULLs medium, infinities high).  The issue / treatment
    texts and thresholds are fixed values of the reference behaviour."""
    o = outliers_iqr(df, cols).filter(F.col("outlier_count") > 0)
    pct = F.col("outlier_percentage")
    recs_o = o.select(
        F.col("feature").alias("column"),
        F.when(pct > 10, F.format_string("High outlier percentage (%.1f%%)", pct))
        .when(pct > 5, F.format_string("Moderate outlier percentage (%.1f%%)", pct))
        .otherwise(F.format_string("Low outlier count (%d)", "outlier_count")).alias("issue"),
        F.when(pct > 10, "Investigate data quality; consider separate analysis for outlier subset")
        .when(pct > 5, "Apply robust scaling or IOR transformation")
        .otherwise("Safe to use; consider Winsorization if needed").alias("treatment"),
        F.when(pct > 10, "high").when(pct > 5, "medium").otherwise("low").alias("severity"),
        F.lit(1).alias("source"))
    a = flag_anomalies(df)
    recs_n = a.filter(F.col("nan_count") > 0).select(
        "column", F.format_string("Missing values (%d)", "nan_count").alias("issue"),
        F.lit("Impute using median/mean or forward-fill for time-series").alias("treatment"),
        F.lit("medium").alias("severity"), F.lit(2).alias("source"))
    recs_i = a.filter(F.col("inf_count") > 0).select(
        "column", F.format_string("Infinite values (%d)", "inf_count").alias("issue"),
        F.lit("Replace with max/min finite values").alias("treatment"),
        F.lit("high").alias("severity"), F.lit(3).alias("source"))
    return recs_o.unionByName(recs_n).unionByName(recs_i)
