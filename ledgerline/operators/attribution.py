"""Exact Shapley values of a fitted forest.

A tree's prediction is a sum over its leaves: a leaf counts for a row if the row meets
the leaf's condition on every feature of its path, an interval per feature.  Where a
feature is left out, its condition holds with the share of training rows that go the
leaf's way at its splits.  So the expectation over any set of known features is a
product for each leaf, and the average over all orders is the integral

    phi_j = sum over leaves  v (o_j - z_j)  INT_0^1  PROD_{i != j} (z_i (1 - s) + o_i s) ds

(o_i: the condition on feature i holds; z_i: its share).  The integrand is a polynomial
of at most (features of the path - 1) degrees, so Gauss-Legendre points integrate it
exactly.  Nothing is sampled: no background rows and no permutations.

The leaves are one table, bounded by the model (trees x 2**depth), read from the nodes
that MLlib saves.  The leaves of a small subtree are a group: all that its sum depends on
is which of the group's intervals each feature lies in, so the integrals are worked out
once for every combination (`TABLE` at most) and looked up by rows.  Rows and groups are
dealt to tasks in blocks; a row's parts are added up by an aggregation.
"""

from __future__ import annotations

import sys
import uuid

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.session import delete_folder, shared_dir

# Task code travels by value, so Python workers need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Leaves x rows that a task holds at once.
CELLS = 1 << 14
#: Combinations of intervals in a group's table, groups and rows of a task, rows looked up at once.
TABLE, GROUPS, ROWS, CHUNK = 1 << 10, 1 << 12, 1 << 16, 1 << 11


class Leaves:
    """All leaves of a forest: path features, intervals (lo, hi], shares and values.
    `groups`: first leaf, leaf after the last one, and 1 if the group has a table."""

    def __init__(self, feature, lo, hi, share, value, n_features, groups):
        self.feature, self.lo, self.hi, self.share, self.value = feature, lo, hi, share, value
        self.n_features, self.groups = n_features, groups

    def part(self, a: int, b: int) -> Leaves:
        """The leaves a to b without their groups."""
        return Leaves(*(getattr(self, c)[a:b] for c in ("feature", "lo", "hi", "share", "value")), self.n_features, None)

    def base(self) -> float:
        """The forest's expectation with no feature known."""
        return float((self.value * self.share.prod(axis=1)).sum())

    def explain(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """phi (rows x features) and the prediction of every row of x."""
        depth = self.feature.shape[1]
        s, weight = np.polynomial.legendre.leggauss(max(1, (depth + 1) // 2))
        s, weight = (s + 1) / 2, weight / 2
        n, width = len(x), self.n_features + 1  # the last column takes the places without a condition
        phi, pred = np.zeros(n * width), np.zeros(n)
        step = max(1, CELLS // max(1, n))
        for a in range(0, len(self.value), step):
            f, z, v = self.feature[a:a + step], self.share[a:a + step], self.value[a:a + step]
            own = x[:, np.maximum(f, 0)]
            # a place without a condition has o = z = 1: a factor of 1 and no difference
            o = (f < 0) | ((own > self.lo[a:a + step]) & (own <= self.hi[a:a + step]))
            pred += (o.all(axis=2) * v).sum(axis=1)
            total = np.zeros(o.shape)
            for s_q, w_q in zip(s, weight, strict=True):
                factor = z * (1 - s_q) + o * s_q
                total += (w_q * factor.prod(axis=2))[..., None] / factor
            total *= (o - z) * v[None, :, None]
            place = np.where(f < 0, self.n_features, f) + width * np.arange(n)[:, None, None]
            phi += np.bincount(place.ravel(), total.ravel(), n * width)
        return phi.reshape(n, width)[:, :-1], pred

    def conditions(self) -> list[tuple]:
        """(feature, lo, hi, share) of each feature that the leaves have conditions on, an entry a leaf."""
        out = []
        for f in np.unique(self.feature[self.feature >= 0]):
            at = self.feature == f
            out.append((f, np.where(at, self.lo, -np.inf).max(1), np.where(at, self.hi, np.inf).min(1),
                        np.where(at, self.share, 1.0).prod(1)))
        return out

    def table(self, edges, missing, points) -> tuple[np.ndarray, list[tuple]]:
        """The sums over the leaves (phi of all features, prediction) for every combination of
        the features' intervals, and for each feature what its bins (of `edges`, then one for
        `missing` values) add to a combination's place."""
        s, weight = points[(int((self.feature >= 0).sum(1).max(initial=0)) + 1) // 2]
        m, q = len(self.value), len(s)
        places, met, shares, sizes = [], [], [], []
        for f, lo, hi, z in self.conditions():
            at = np.append(edges[f], np.inf)[:, None]
            o = (lo < at) & (at <= hi)
            if missing[f]:
                o = np.vstack([o, (lo == -np.inf) & (hi == np.inf)])
            kinds: dict = {}
            place = np.array([kinds.setdefault(row.tobytes(), len(kinds)) for row in o])
            first = np.zeros(len(kinds), int)
            first[place[::-1]] = np.arange(len(o))[::-1]
            places.append((f, place))
            met.append(o[first].astype(float))
            shares.append(z)
            sizes.append(len(kinds))
        whole = (self.value[:, None] * weight).reshape(m * q, 1)
        pred, factors = self.value[:, None], []
        for o, z in zip(met, shares, strict=True):
            factor = (z[:, None, None] * (1 - s)[:, None] + o.T[:, None, :] * s[:, None]).reshape(m * q, -1)
            factors.append(factor)
            whole = (whole[:, :, None] * factor[:, None, :]).reshape(m * q, -1)
            pred = (pred[:, :, None] * o.T[:, None, :]).reshape(m, -1)
        n = whole.shape[1]
        out = np.zeros((n, self.n_features + 1))
        out[:, -1] = pred.sum(0)
        step, strides = n, []
        for (f, _), o, z, factor, size in zip(places, met, shares, factors, sizes, strict=True):
            step //= size
            strides.append(step)
            change = np.repeat(o.T - z[:, None], q, axis=0) / factor
            out[:, f] = (whole.reshape(m * q, -1, size, step) * change[:, None, :, None]).sum(0).ravel()
        return out, [(f, p * k) for (f, p), k in zip(places, strides, strict=True)]

    def explain_block(self, x: np.ndarray, first: int, last: int) -> np.ndarray:
        """phi of all features and the prediction, from the groups `first` to `last` alone."""
        groups = self.groups[first:last]
        out = np.zeros((len(x), self.n_features + 1))
        if not len(groups):
            return out
        own = self.part(groups[0, 0], groups[-1, 1])
        missing = np.isnan(x).any(0)
        points = [((s + 1) / 2, w / 2) for s, w in map(np.polynomial.legendre.leggauss, range(1, own.feature.shape[1] // 2 + 2))]
        points = [points[0], *points]
        edges, bins = [], []
        for f in range(self.n_features):
            ends = np.concatenate([own.lo[own.feature == f], own.hi[own.feature == f]])
            edges.append(np.unique(ends[np.isfinite(ends)]))
            bins.append(np.where(np.isnan(x[:, f]), len(edges[f]) + 1, np.searchsorted(edges[f], x[:, f])))
        for a, b, tabled in groups:
            leaves = self.part(a, b)
            if not tabled:
                phi, pred = leaves.explain(x)
                out += np.column_stack([phi, pred])
                continue
            table, places = leaves.table(edges, missing, points)
            for c in range(0, len(x), CHUNK):
                at = np.zeros(len(x[c:c + CHUNK]), np.intp)
                for f, place in places:
                    at += place.take(bins[f][c:c + CHUNK])
                out[c:c + CHUNK] += table.take(at, axis=0)
        return out


def forest_leaves(spark: SparkSession, model, n_features: int) -> Leaves:
    """The leaves of an MLlib random forest regressor, from the nodes it saves."""
    path = f"{shared_dir(spark)}/ledgerline/forest-{uuid.uuid4().hex[:12]}"
    model.write().overwrite().save(path)
    nodes = spark.read.parquet(f"{path}/data").select(
        "treeID", "nodeData.id", "nodeData.prediction", "nodeData.leftChild", "nodeData.rightChild", "nodeData.rawCount",
        F.col("nodeData.split.featureIndex").alias("feature"),
        F.get("nodeData.split.leftCategoriesOrThreshold", F.lit(0)).alias("threshold"))
    trees: dict = {}
    for t, i, *node in nodes.toPandas().itertuples(index=False):  # bounded by the model
        trees.setdefault(t, {})[i] = node
    delete_folder(spark, path)
    paths, groups = [], []

    def fits(conditions, cuts):
        """Whether the combinations of all features' intervals fit into a table."""
        return np.prod([len(cuts.get(f, ())) + 1 + (f in conditions) for f in conditions.keys() | cuts.keys()],
                       dtype=float) <= TABLE

    def walk(tree, at, conditions):
        """Adds the node's leaves, and the groups that are settled; returns its first leaf and
        its cuts by feature if all its leaves may still share a group, else no cuts."""
        prediction, left, right, count, feature, threshold = tree[at]
        first = len(paths)
        if left < 0:
            paths.append((conditions, prediction / len(trees)))
            if fits(conditions, {}):
                return first, {}
            groups.append((first, first + 1, 0))
            return first, None
        below = []
        for child, low in ((left, False), (right, True)):
            lo, hi, share = conditions.get(feature, (-np.inf, np.inf, 1.0))
            lo, hi = (max(lo, threshold), hi) if low else (lo, min(hi, threshold))
            below.append(walk(tree, child, conditions | {feature: (lo, hi, share * tree[child][3] / count)}))
        (_, a), (middle, b) = below
        if a is not None and b is not None:
            cuts = {f: a.get(f, frozenset()) | b.get(f, frozenset()) for f in a.keys() | b.keys()}
            cuts[feature] = cuts.get(feature, frozenset()) | {threshold}
            if fits(conditions, cuts):
                return first, cuts
        groups.extend((p, e, 1) for p, e, c in ((first, middle, a), (middle, len(paths), b)) if c is not None)
        return first, None

    for tree in trees.values():
        first, cuts = walk(tree, 0, {})
        if cuts is not None:
            groups.append((first, len(paths), 1))
    depth = max(1, max(len(c) for c, _ in paths))
    feature = np.full((len(paths), depth), -1, np.int16)
    lo, hi, share = np.full(feature.shape, -np.inf), np.full(feature.shape, np.inf), np.ones(feature.shape)
    for k, (conditions, _) in enumerate(paths):
        for d, (f, (a, b, z)) in enumerate(conditions.items()):
            feature[k, d], lo[k, d], hi[k, d], share[k, d] = f, a, b, z
    return Leaves(feature, lo, hi, share, np.array([v for _, v in paths]), n_features, np.array(sorted(groups)))


def shapley_forest(model, rows: DataFrame, features) -> DataFrame:
    """ticker, predicted_growth_rate, base_value, feature, feature_value, shap_value of every row.

    The values of a row and `base_value` add up to its prediction.
    """
    spark = rows.sparkSession
    leaves = forest_leaves(spark, model, len(features))
    base = leaves.base()
    shared = spark.sparkContext.broadcast(vars(leaves))
    names, xs = list(features), [f"x{k}" for k in range(len(features))]
    parts = [f"p{k}" for k in range(len(names) + 1)]
    key = ["ticker", *xs, "n"]
    # equal rows are explained once
    slim = rows.select("ticker", *[F.col(c).cast("double").alias(x) for x, c in zip(xs, names, strict=True)]) \
        .groupBy("ticker", *xs).agg(F.count(F.lit(1)).alias("n"))
    blocks = -(-len(leaves.groups) // GROUPS)
    deals = max(1, -(-slim.count() // ROWS))

    def run(batches):
        import pyarrow as pa

        leaves = Leaves(**shared.value)

        def explained(held):
            part = pa.Table.from_batches(held).combine_chunks()
            x = np.stack([part.column(c).to_numpy() for c in xs], 1)
            block = part.column("block").to_numpy()
            out = np.empty((len(x), len(parts)))
            for b in np.unique(block):  # one, as rows are dealt
                out[block == b] = leaves.explain_block(x[block == b], b * GROUPS, (b + 1) * GROUPS)
            for c, values in zip(parts, out.T, strict=True):
                part = part.append_column(c, pa.array(np.ascontiguousarray(values)))
            return part.drop_columns("block").to_batches()

        held, n = [], 0
        for batch in batches:
            held, n = [*held, batch], n + batch.num_rows
            if n >= 2 * ROWS:
                yield from explained(held)
                held, n = [], 0
        if held:
            yield from explained(held)

    dealt = slim.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))) \
        .repartitionById(blocks * deals, (F.col("block") * deals + F.pmod(F.xxhash64(*key), F.lit(deals))).cast("int"))
    schema = "ticker string, " + "".join(f"{c} double, " for c in xs) + "n long, " + ", ".join(f"{c} double" for c in parts)
    added = dealt.mapInArrow(run, schema).groupBy(*key).agg(*[F.sum(c).alias(c) for c in parts])
    each = F.array(*[F.struct(F.lit(c).alias("feature"), F.coalesce(F.col(x), F.lit(float("nan"))).alias("feature_value"),
                              F.col(p).alias("shap_value")) for c, x, p in zip(names, xs, parts)])
    every = F.flatten(F.array_repeat(each, F.col("n").cast("int")))
    return added.select("ticker", F.col(parts[-1]).alias("predicted_growth_rate"), F.lit(base).alias("base_value"),
                        F.inline(every))
