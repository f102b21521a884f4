"""Feature preprocessing.

Column statistics (means, medians, min/max, σ, quartiles) are *fitted* in
one aggregate — a bounded result of 2-3 numbers per column, like the summary
a scaler keeps — and applied to every row as literals (no join, no cross
join, no per-column re-scan).  Medians and quartiles use the distributed
exact quantile of ``operators.profile``.
"""

from __future__ import annotations

import math

from pyspark.ml.feature import OneHotEncoder, StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.operators.profile import grouped_quantiles, long_values
from ledgerline.session import shared_dir

INF = float("inf")

# Columns never scaled.
SCALE_EXCLUDE = ("ticker", "company", "fiscal_year", "category", "growth_category")


def numeric_cols(df: DataFrame, exclude=()) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.NumericType) and f.name not in exclude]


def string_cols(df: DataFrame, exclude=()) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.StringType) and f.name not in exclude]


def _stats(df: DataFrame, aggs: dict[str, Column]) -> dict:
    """Fit: one aggregate, one row of statistics (bounded by the column count)."""
    row = df.agg(*[v.alias(k) for k, v in aggs.items()]).first()
    return row.asDict() if row is not None else {k: None for k in aggs}


def _lit(v) -> Column:
    return F.lit(v)


def growth_raw(x: str) -> Column:
    """pandas pct_change semantics: a zero base gives ±inf (0/0 -> NULL)."""
    w = Window.partitionBy("ticker").orderBy("date")
    prev, cur = F.lag(x).over(w), F.col(x)
    return (F.when(prev == 0, F.when(cur > 0, F.lit(INF)).when(cur < 0, F.lit(-INF)))
            .otherwise((cur / prev - 1) * 100))


def fix_infinite(df: DataFrame, cols=None) -> DataFrame:
    """+inf -> column max of finite values, -inf -> min of finite values."""
    cols = cols or [c for c in numeric_cols(df)
                    if isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType))]
    fin = {c: F.when(F.abs(F.col(c)) != F.lit(INF), F.col(c)) for c in cols}
    s = _stats(df, {**{f"mx_{c}": F.max(fin[c]) for c in cols},
                    **{f"mn_{c}": F.min(fin[c]) for c in cols}})
    return df.withColumns({c: F.when(F.col(c) == F.lit(INF), _lit(s[f"mx_{c}"]))
                           .when(F.col(c) == F.lit(-INF), _lit(s[f"mn_{c}"])).otherwise(F.col(c))
                           for c in cols})


def _mode_fill(df: DataFrame, cats) -> DataFrame:
    if not cats:
        return df
    s = _stats(df, {f"mode_{c}": F.mode(c, True) for c in cats})
    return df.withColumns({c: F.coalesce(F.col(c), _lit(s[f"mode_{c}"]), F.lit("Unknown"))
                           for c in cats})


def impute_mean(df: DataFrame, keys=("ticker", "date")) -> DataFrame:
    """C29 mean: numeric NULLs -> column mean; categorical NULLs -> mode
    (smallest on ties) else 'Unknown'."""
    nums = numeric_cols(df)
    s = _stats(df, {f"mu_{c}": F.avg(c) for c in nums})
    d = df.withColumns({c: F.coalesce(F.col(c), _lit(s[f"mu_{c}"])) for c in nums})
    return _mode_fill(d, string_cols(df, keys))


def impute_median(df: DataFrame, keys=("ticker", "date")) -> DataFrame:
    """C29 median: numeric NULLs -> exact column median (distributed)."""
    nums = numeric_cols(df)
    q = grouped_quantiles(long_values(df, nums, keys), "feature", "value", [0.5])
    med = {r["feature"]: r["q"] for r in q.collect()}   # one row per column
    d = df.withColumns({c: F.coalesce(F.col(c), _lit(med.get(c))) for c in nums})
    return _mode_fill(d, string_cols(df, keys))


def impute_ffill(df: DataFrame) -> DataFrame:
    """Per ticker forward fill, then back fill (never across tickers)."""
    w = Window.partitionBy("ticker").orderBy("date")
    fwd = w.rowsBetween(Window.unboundedPreceding, 0)
    bwd = w.rowsBetween(0, Window.unboundedFollowing)
    cols = [c for c in df.columns if c not in ("ticker", "date")]
    return df.withColumns({c: F.coalesce(F.last(c, True).over(fwd), F.first(c, True).over(bwd))
                           for c in cols})


def impute_drop(df: DataFrame) -> DataFrame:
    """Drop rows with any NULL."""
    return df.dropna()


def drop_constant(df: DataFrame, threshold: float = 0.0) -> tuple[DataFrame, list[str]]:
    """Drop numeric columns whose sample variance <= threshold (one
    aggregate action: the column list is a schema decision)."""
    nums = numeric_cols(df)
    row = df.agg(*[F.var_samp(c).alias(c) for c in nums]).first()
    drop = [c for c in nums if row[c] is not None and not math.isnan(row[c]) and row[c] <= threshold]
    return df.drop(*drop), drop


def one_hot(df: DataFrame, cols) -> DataFrame:
    """One sparse indicator vector ``{col}_onehot`` per column, drop-first:
    every level but the alphabetically first has a slot, in descending order,
    however many levels there are.  The slots' names are the column's
    ``levels`` metadata.  NULL counts as the first level (all zeros)."""
    cols = list(cols)
    first = df.agg(*[F.min(c).alias(c) for c in cols]).first()
    d = df.fillna({c: first[c] for c in cols if first[c] is not None})
    # the encoder drops the last index, so levels are indexed from the last to the first
    index = StringIndexer(inputCols=cols, outputCols=[f"{c}_index" for c in cols],
                          stringOrderType="alphabetDesc").fit(d)
    encoder = OneHotEncoder(inputCols=[f"{c}_index" for c in cols], outputCols=[f"{c}_onehot" for c in cols])
    indexed = index.transform(d)
    out = encoder.fit(indexed).transform(indexed).drop(*cols, *[f"{c}_index" for c in cols])
    for c, labels in zip(cols, index.labelsArray):
        out = out.withMetadata(f"{c}_onehot", {"levels": list(labels[:-1])})
    return out


def one_hot_rows(df: DataFrame, keys, cols) -> DataFrame:
    """The vectors of :func:`one_hot` in long form: (keys, dummy, value)."""
    out = None
    for c in cols:
        levels = df.schema[f"{c}_onehot"].metadata["levels"]
        names = F.array(*[F.lit(f"{c}_{v}") for v in levels]).cast("array<string>")
        part = df.select(*keys, F.posexplode(vector_to_array(f"{c}_onehot")).alias("pos", "value")) \
            .select(*keys, names[F.col("pos")].alias("dummy"), F.col("value").cast("int").alias("value"))
        out = part if out is None else out.unionByName(part)
    return out


def scale(df: DataFrame, method: str = "standard", exclude=SCALE_EXCLUDE) -> DataFrame:
    """Standard (population σ), min-max or robust (median / IQR);
    a zero spread leaves the centred value (scale 1)."""
    nums = numeric_cols(df, exclude)
    if method == "standard":
        s = _stats(df, {**{f"c_{c}": F.avg(c) for c in nums},
                        **{f"s_{c}": F.stddev_pop(c) for c in nums}})
    elif method == "minmax":
        s = _stats(df, {**{f"c_{c}": F.min(c).cast("double") for c in nums},
                        **{f"s_{c}": (F.max(c) - F.min(c)).cast("double") for c in nums}})
    elif method == "robust":
        q = grouped_quantiles(long_values(df, nums), "feature", "value", [0.25, 0.5, 0.75])
        qs = {(r["feature"], r["p"]): r["q"] for r in q.collect()}   # 3 rows per column
        out = {}
        for c in nums:
            lo, med, hi = qs.get((c, 0.25)), qs.get((c, 0.5)), qs.get((c, 0.75))
            spread = None if lo is None or hi is None else hi - lo
            out[c] = (F.col(c) - _lit(med)) / _unit(_lit(spread))
        return df.withColumns(out)
    else:
        raise ValueError(method)
    return df.withColumns({c: (F.col(c) - _lit(s[f"c_{c}"])) / _unit(_lit(s[f"s_{c}"]))
                           for c in nums})


def _unit(spread: Column) -> Column:
    return F.when(spread.isNull() | (spread == 0), F.lit(1.0)).otherwise(spread.cast("double"))


def prepare_ml(df: DataFrame, method: str = "standard") -> tuple[DataFrame, DataFrame]:
    """Fix ±inf -> impute mean -> one-hot -> drop constants -> scale,
    with a step log (step, value)."""
    spark = df.sparkSession
    shared_dir(spark)
    nums = [c for c in numeric_cols(df) if isinstance(df.schema[c].dataType, T.DoubleType)]
    inf_n = df.agg(sum(F.count_if(F.abs(F.col(c)) == F.lit(INF)) for c in nums)).first()[0]
    # Each statistics step reads its input twice (scalar subquery + rows);
    # reliable checkpoints between steps keep the plan linear in the number
    # of steps and survive executor loss.
    d = fix_infinite(df, nums).checkpoint()
    na_n = d.agg(sum(F.count_if(F.col(c).isNull()) for c in d.columns)).first()[0]
    d = impute_mean(d).checkpoint()
    cats = [c for c in string_cols(d) if c not in ("ticker",)]
    d = one_hot(d, cats)
    d, dropped = drop_constant(d)
    d = scale(d.checkpoint(), method)
    log = spark.createDataFrame(
        [("Fix infinite values", int(inf_n or 0)), ("Handle missing values", int(na_n or 0)),
         ("Encode categorical features", len(cats)), ("Remove constant features", len(dropped)),
         ("Scale features", len(numeric_cols(d, SCALE_EXCLUDE)))], "step string, value long")
    return d, log
