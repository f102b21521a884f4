"""Learners and explanations.

* learners are pooled MLlib estimators on a ``features`` vector
  (``VectorAssembler``) of population-σ standardised columns;
* Shapley values: exact for the linear model (coef × (x − mean)); the forest's
  are exact too (:mod:`ledgerline.operators.attribution`); for other models,
  permutation sampling as prefix chains;
* cross-validation: every fold's linear fit comes from one pass over the rows
  (a Gram matrix per date, added up over the fold's training dates).
"""

from __future__ import annotations

import random
from functools import reduce
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions.numeric import rnd
from ledgerline.operators.forest import grow

# The forest settings of the reference.
RF_BENCH = {"numTrees": 200, "minInstancesPerNode": 2}
RF_CANDIDATE = {"numTrees": 300, "minInstancesPerNode": 2}
RF_IMPORTANCE = {"numTrees": 100, "maxDepth": 10}
SEED = 42
#: Rows up to which MLlib fits a forest in a minute or so.
FEW_ROWS = 1 << 18


def assemble(df: DataFrame, features, out: str = "features") -> DataFrame:
    """Feature vectors; rows with a NULL feature must have been dropped before."""
    return VectorAssembler(inputCols=list(features), outputCol=out, handleInvalid="error").transform(df)


def train_moments(split_df: DataFrame, features) -> dict[str, float]:
    """Mean and population σ of each feature on the training rows: one
    aggregate, 2 × features numbers to the driver (a bounded fit result,
    like a scaler's parameters)."""
    train = split_df.filter(F.col("split") == "train")
    row = train.agg(*[F.avg(c).alias(f"m_{c}") for c in features],
                    *[F.stddev_pop(c).alias(f"s_{c}") for c in features]).first()
    return row.asDict()


def standardized_split(split_df: DataFrame, features, moments=None) -> DataFrame:
    """Population-σ standardisation fitted on the training rows only."""
    mo = moments or train_moments(split_df, features)
    return split_df.withColumns({
        c: (F.col(c) - F.lit(mo[f"m_{c}"])) / F.lit(mo[f"s_{c}"] if mo[f"s_{c}"] else 1.0)
        for c in features})


def _pred_frame(model_name: str, pred: DataFrame) -> DataFrame:
    return pred.select(F.lit(model_name).alias("model"), "ticker", "date",
                       F.col("target").alias("actual"), F.col("prediction").alias("predicted"))


def linear_forecast(split_df: DataFrame, features) -> tuple[DataFrame, object]:
    """M4: standardised linear regression (normal equations)."""
    d = assemble(standardized_split(split_df, features), features)
    lr = LinearRegression(featuresCol="features", labelCol="target", solver="normal", regParam=0.0)
    m = lr.fit(d.filter(F.col("split") == "train"))
    return _pred_frame("LinearRegression", m.transform(d.filter(F.col("split") == "test"))), m


def rf_forecast(split_df: DataFrame, features, params=RF_BENCH, name="RandomForest", parts=None):
    """M5: random forest regressor (min 2 rows per leaf, fixed seed).  ``parts`` deals the
    training rows to the partitions of the fit (:func:`fewer_parts` where none is given)."""
    d = assemble(split_df, features)
    rows = d.filter(F.col("split") == "train").select("features", "target")
    m = fit_forest(rows, params, rows.count(), parts or fewer_parts)
    return _pred_frame(name, m.transform(d.filter(F.col("split") == "test"))), m


def forest(params) -> RandomForestRegressor:
    """The forest estimator; a level of all trees is grown in one pass where its
    statistics fit in ``maxMemoryInMB``, and rows remember their nodes."""
    return RandomForestRegressor(featuresCol="features", labelCol="target", seed=SEED, maxDepth=10,
                                 maxMemoryInMB=1024, cacheNodeIds=True, **params)


def fit_forest(rows: DataFrame, params, n: int, parts):
    """The forest fitted on all rows: by MLlib for tables of up to ``FEW_ROWS`` rows (``n``: the
    table's), beyond that grown from histograms, the same estimator at a fraction of the
    time a row (:mod:`ledgerline.operators.forest`)."""
    est = forest(params)
    return grow(est, rows) if n > FEW_ROWS else est.fit(parts(rows))


def fewer_parts(df: DataFrame) -> DataFrame:
    """The rows to fit a forest on, in no more partitions than the session has cores (eight
    at least).  For each level a partition writes statistics of all nodes of all trees
    (some 4 KB a node), however few its rows, so what is shuffled grows with partitions."""
    return df.coalesce(max(8, df.sparkSession.sparkContext.defaultParallelism))


def even_parts(df: DataFrame) -> DataFrame:
    """The rows to fit a forest on, dealt evenly to as many partitions as the session has
    cores (eight at least): every level waits for its longest task, and adaptive execution
    may leave few or uneven partitions."""
    return df.repartition(max(8, df.sparkSession.sparkContext.defaultParallelism))


def rf_importance(frame: DataFrame, target: str, features) -> DataFrame:
    """M2: random-forest importances (100 trees, depth 10), NULL -> 0, with
    cumulative importance and % (W12)."""
    feats = [c for c in features if c != target]
    d = frame.select(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c)
                       for c in feats + [target]])
    m = RandomForestRegressor(featuresCol="features", labelCol=target, seed=SEED, **RF_IMPORTANCE) \
        .fit(fewer_parts(assemble(d, feats)))
    imp = [float(x) for x in m.featureImportances.toArray()]
    spark = frame.sparkSession
    t = spark.createDataFrame(list(zip(feats, imp)), "feature string, importance double")
    return cumulative_importance(t)


def cumulative_importance(imp: DataFrame) -> DataFrame:
    """Running sum of importance in descending order and its % of the
    total.  One row per feature: the ordered window is over a feature list."""
    w = Window.orderBy(F.col("importance").desc(), F.col("feature")) \
        .rowsBetween(Window.unboundedPreceding, 0)
    total = imp.agg(F.sum("importance")).scalar()
    return imp.select("feature", rnd("importance", 8).alias("importance"),
                      rnd(F.sum("importance").over(w), 8).alias("cumulative_importance"),
                      rnd(F.sum("importance").over(w) / total * 100, 6)
                      .alias("cumulative_importance_pct"))


def topk(imp: DataFrame, k: int = 10, col: str = "importance") -> DataFrame:
    """L4: top-k features (a top-k report; ties by name)."""
    return imp.orderBy(F.col(col).desc(), F.col("feature")).limit(k)


def seeded_sample(df: DataFrame, n: int, key: str, seed: int = SEED) -> DataFrame:
    """Deterministic sample of at most n rows (digest order with a seed)."""
    return df.orderBy(F.md5(F.concat(F.col(key), F.lit(f"|{seed}"))), F.col(key)).limit(n)


# ------------------------------------------------------------------ Shapley


def shapley_linear(model, split_df: DataFrame, rows: DataFrame, features) -> DataFrame:
    """M15 (linear): φ_j = coef_j · (x_j − mean_train(x_j)) on standardised
    features; base = intercept + Σ coef·mean.  Σφ + base = prediction."""
    coef = [float(v) for v in model.coefficients.toArray()]
    mo = train_moments(split_df, features)
    fut = standardized_split(rows.withColumn("split", F.lit("future")), features, mo)
    # the background is the training mean, and a standardised feature has
    # training mean 0
    means = {c: 0.0 for c in features}
    base = F.lit(float(model.intercept))
    for c, w in zip(features, coef):
        base = base + F.lit(w * means[c])
    phis = [F.struct(F.lit(c).alias("feature"), F.col(c).alias("feature_value_scaled"),
                     (F.lit(w) * (F.col(c) - F.lit(means[c]))).alias("shap_value"))
            for c, w in zip(features, coef)]
    pred = F.lit(float(model.intercept))
    for c, w in zip(features, coef):
        pred = pred + F.lit(w) * F.col(c)
    return fut.select("ticker", pred.alias("predicted_growth_rate"), base.alias("base_value"),
                      F.inline(F.array(*phis)))


# ------------------------------------------------------------------ cross-validation


def gram_sums(features, target: str = "target") -> list:
    """Sums of all products of (1, features, target)."""
    z = [F.lit(1.0), *[F.col(c).cast("double") for c in (*features, target)]]
    return [F.sum(z[i] * z[j]).alias(f"g_{i}_{j}") for i in range(len(z)) for j in range(i, len(z))]


def least_squares(row, size: int) -> list[float]:
    """Intercept and coefficients from the sums of products, centred and scaled first;
    features that others determine exactly share their weight (least norm)."""
    g = np.zeros((size, size))
    for i in range(size):
        for j in range(i, size):
            g[i, j] = g[j, i] = row[f"g_{i}_{j}"]
    n, mean = g[0, 0], g[0, 1:] / g[0, 0]
    c = g[1:, 1:] - n * np.outer(mean, mean)
    scale = np.sqrt(np.maximum(np.diag(c)[:-1], 0.0))
    scale[scale == 0] = 1.0
    beta = np.linalg.lstsq(c[:-1, :-1] / np.outer(scale, scale), c[:-1, -1] / scale, rcond=1e-10)[0] / scale
    return [float(mean[-1] - beta @ mean[:-1]), *map(float, beta)]


def linear_value(coef, features) -> Column:
    """Intercept + coefficients times features, as one expression."""
    out = F.lit(coef[0])
    for b, c in zip(coef[1:], features):
        out = out + F.lit(b) * F.col(c)
    return out


def fold_linear_fits(rows: DataFrame, folds: DataFrame, features) -> DataFrame:
    """(fold, coefficients with the intercept first): least squares on each fold's
    training dates.  The rows are read once; folds add up their dates' matrices."""
    size = len(features) + 2
    train = folds.filter(F.col("role") == "train").select("fold", "date")
    by_date = rows.groupBy("date").agg(*gram_sums(features))  # a row per date of the calendar
    sums = by_date.join(train, "date").groupBy("fold").agg(
        *[F.sum(f"g_{i}_{j}").alias(f"g_{i}_{j}") for i in range(size) for j in range(i, size)])
    fits = [(r["fold"], least_squares(r, size)) for r in sums.collect()]  # one row per fold
    return rows.sparkSession.createDataFrame(fits, "fold long, coef array<double>")


def linear_fold_predictions(split_df: DataFrame, folds: DataFrame, features) -> DataFrame:
    """LinearRegression's predictions of every fold's test rows (a training date
    is tested in one fold at most)."""
    rows = split_df.filter(F.col("split") == "train")
    fits = fold_linear_fits(rows, folds, features)
    tested = rows.join(folds.filter(F.col("role") == "test").select("fold", "date"), "date")
    pred = F.col("coef")[0]
    for k, c in enumerate(features, 1):
        pred = pred + F.col("coef")[k] * F.col(c)
    return tested.join(F.broadcast(fits), "fold").select(
        "fold", "ticker", "date", F.col("target").alias("actual"), F.lit("LinearRegression").alias("model"),
        pred.alias("predicted"))


def forest_fold_predictions(split_df: DataFrame, folds: DataFrame, features, params=RF_BENCH) -> DataFrame:
    """RandomForest's predictions of every fold's test rows: one fit a fold on
    vectors that are assembled and written once."""
    rows = assemble(split_df.filter(F.col("split") == "train"), features).select("ticker", "date", "target", "features")
    rows = rows.checkpoint()
    n = rows.count()  # all folds are fitted alike

    def tested(fold):
        own = folds.filter(F.col("fold") == fold)
        train = rows.join(own.filter(F.col("role") == "train").select("date"), "date", "left_semi")
        fit = fit_forest(train.select("features", "target"), params, n, fewer_parts)
        return fit.transform(rows.join(own.filter(F.col("role") == "test").select("date"), "date", "left_semi")).select(
            F.lit(fold).alias("fold"), "ticker", "date", F.col("target").alias("actual"),
            F.lit("RandomForest").alias("model"), F.col("prediction").alias("predicted"))

    names = [r[0] for r in folds.select("fold").distinct().sort("fold").collect()]  # at most five
    with ThreadPool(len(names)) as pool:  # fits wait for small jobs most of the time
        parts = pool.map(inheritable_thread_target(rows.sparkSession)(tested), names)
    return reduce(DataFrame.unionByName, parts)


# ------------------------------------------------------------------ strategies


def top_features(rows: DataFrame, features, k: int = 5) -> list[str]:
    """The k features most correlated with the target on the training rows."""
    train = rows.filter(F.col("split") == "train")
    r = train.agg(*[F.abs(F.corr(F.col(c).cast("double"), F.col("target"))).alias(c) for c in features]).first()
    return sorted(features, key=lambda c: (-(r[c] or 0.0), c))[:k]


def strategy_predictions(split_df: DataFrame, features, k: int = 5) -> DataFrame:
    """Holdout predictions of the linear strategies, all as growth in percent: the growth
    target, the absolute target (the predicted level turned back into growth over the
    current one), and the growth target on the top-k features of the training part.
    Each fit is one pass over the training rows, which adds up products."""
    train = split_df.filter(F.col("split") == "train")
    test = split_df.filter(F.col("split") == "test")
    best = top_features(split_df, features, k)

    def fit(cols, target):
        return least_squares(train.agg(*gram_sums(cols, target)).first(), len(cols) + 2)

    level = linear_value(fit(features, "net_income_next"), features)
    values = {"LinearGrowth": linear_value(fit(features, "target"), features),
              "LinearAbsolute": (level - F.col("net_income")) / F.nullif("net_income", F.lit(0.0)) * 100,
              f"LinearTop{k}": linear_value(fit(best, "target"), best)}
    return test.select("ticker", "date", F.col("target").alias("actual"), F.inline(F.array(*[
        F.struct(F.lit(n).alias("model"), v.alias("predicted")) for n, v in values.items()])))


# ------------------------------------------------------------------ explanations


def shapley_sampled(model, train: DataFrame, rows: DataFrame, features, n_background: int = 25,
                    n_perm: int = 8) -> DataFrame:
    """M15 (model-agnostic): permutation-sampling Shapley values.  For each
    row, permutation and background row, the feature prefix of the
    permutation comes from the row and the rest from the background row; φ_j
    is the mean prediction difference when feature j joins the prefix.
    ``n_background`` training rows and ``n_perm`` permutations are the
    explainer's parameters; every row of ``rows`` is explained (its
    ``ticker`` is its key).  The job is an explode, ``model.transform`` and a
    sum that is combined before its shuffle."""
    d = len(features)
    rng = random.Random(SEED)
    perms = [rng.sample(range(d), d) for _ in range(n_perm)]
    ev = rows.select("ticker", *features)
    bg = seeded_sample(train.withColumn("_bk", F.concat_ws("|", "ticker", F.col("date").cast("string"))),
                       n_background, "_bk").select(*[F.col(c).alias(f"b_{c}") for c in features])
    bg_arr = bg.agg(F.collect_list(F.struct(*[f"b_{c}" for c in features])).alias("bg")).scalar()
    # Each permutation is a chain x_0 = background, x_k = x_(k-1) with the
    # k-th permuted feature taken from the row: one model evaluation per
    # step.  φ of the added feature is f(x_k) - f(x_(k-1)), so f(x_k) counts
    # for the feature just taken and against the next one.
    steps = []
    for perm in perms:
        for pos in range(d + 1):
            prefix = set(perm[:pos])
            taken = features[perm[pos - 1]] if pos > 0 else None
            coming = features[perm[pos]] if pos < d else None
            steps.append(F.struct(F.lit(taken).cast("string").alias("taken"),
                                  F.lit(coming).cast("string").alias("coming"),
                                  F.array(*[F.lit(i in prefix) for i in range(d)]).alias("mask")))
    x = ev.select("ticker", *features, bg_arr.alias("_bg"))
    x = x.select("*", F.size("_bg").alias("_n"), F.explode("_bg").alias("_bgrow")).drop("_bg")
    x = x.select("*", F.explode(F.array(*steps)).alias("s"))
    cols = [F.when(F.col("s.mask")[i], F.col(c)).otherwise(F.col(f"_bgrow.b_{c}")).alias(f"x_{c}")
            for i, c in enumerate(features)]
    x = x.select("ticker", "_n", "s.taken", "s.coming", *cols)
    pred = model.transform(VectorAssembler(inputCols=[f"x_{c}" for c in features],
                                           outputCol="features").transform(x))
    signed = pred.select("ticker", "_n", F.inline(F.array(
        F.struct(F.col("taken").alias("feature"), F.col("prediction").alias("part")),
        F.struct(F.col("coming").alias("feature"), (-F.col("prediction")).alias("part")))))
    return signed.filter(F.col("feature").isNotNull()).groupBy("ticker", "feature").agg(
        (F.sum("part") / (F.first("_n") * n_perm)).alias("shap_value"))


def shap_global(phi: DataFrame) -> DataFrame:
    """Mean |φ| per feature."""
    return phi.groupBy("feature").agg(F.avg(F.abs("shap_value")).alias("mean_abs_shap"))


def shap_local(phi: DataFrame, k: int = 8) -> DataFrame:
    """Top-k drivers per ticker by |φ| with a direction label."""
    w = Window.partitionBy("ticker").orderBy(F.abs("shap_value").desc(), F.col("feature"))
    t = phi.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return t.withColumn("direction", F.when(F.col("shap_value") >= 0, "increases_prediction")
                        .otherwise("decreases_prediction"))
