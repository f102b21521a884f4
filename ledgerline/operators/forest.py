"""Random forests of many rows (M5), grown level by level from histograms.

MLlib's fit takes a row through all trees at once, and each tree updates another place in
hundreds of MB of statistics: half a microsecond for each row, tree and level, most of it
probably spent waiting for memory.  Here a task takes its rows through one tree after the
other, so the statistics it updates are those of one tree (1 MB at depth 10).

It is the same estimator: every row is read for every tree, with a Poisson(1) count for
its place in the bootstrap sample; 32 bins a feature, a third of the features drawn for
each node, the split of the largest gain in variance with the least rows on both sides,
the same depth.  The draws are others than MLlib's, as they are with other partitions.
Cut points are quantiles of all rows (rank error 1 in 10,000), or all midpoints of a
feature with few values, where MLlib takes them from a sample.

Rows are binned and written once, in chunks of at most `CHUNK` rows.  A level is one job:
each task sums up (weight, weight x target) by node, drawn feature and bin, Spark adds the
sums of a band of nodes and picks their splits, and the splits (a row a node, bounded by
the model) go to the driver, as MLlib's do.  Counts and nodes of rows are worked out again
in every level instead of being kept.  The result is an MLlib model.
"""

from __future__ import annotations

import json
import sys
import uuid

import numpy as np
from pyspark import TaskContext, cloudpickle
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.session import delete_folder, shared_dir

# Task code travels by value, so Python workers need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Bins a feature (MLlib's maxBins), nodes whose sums are added up together.
BINS, BAND = 32, 64
#: Rows of a chunk, and rows worked on at once.
CHUNK, BLOCK = 1 << 20, 1 << 16


#: Poisson(1) counts by a number of 16 bits.
COUNTS = np.searchsorted(np.cumsum(np.exp(-1.0) / np.cumprod([1.0, *range(1, 12)])),
                         (np.arange(1 << 16) + 0.5) / (1 << 16)).astype(np.uint8)


class Level:
    """A forest down to one level, and what is summed up for that level's nodes.

    Nodes are numbered as in a heap.  `feature`, `cut`: (trees x nodes above the level), rows
    whose bin is above the cut go right; `nodes`: per tree, the level's nodes that may be
    split; `drawn`: per tree, the features drawn for them."""

    def __init__(self, level, feature, cut, nodes, drawn, seed):
        self.level, self.feature, self.cut = level, feature, cut
        self.nodes, self.drawn, self.seed = nodes, drawn, seed

    def counts(self, tree: int, chunk: int, n: int) -> np.ndarray:
        """How often each row of a chunk stands in the tree's bootstrap sample."""
        rng = np.random.Generator(np.random.PCG64([self.seed, tree, chunk]))
        return COUNTS.take(rng.integers(0, 1 << 16, n, np.uint16))

    def sums(self, tree: int, chunks) -> np.ndarray:
        """For each of the tree's nodes: weight, weight x target by drawn feature and bin,
        then weight x target squared.  A chunk: (number, bins as rows x features, target)."""
        nodes, drawn = self.nodes[tree], self.drawn[tree]
        first, n, k = (1 << self.level) - 1, len(nodes), drawn.shape[1]
        slots = np.full(1 << self.level, n)  # rows of finished nodes fall into a slot of their own
        slots[nodes - first] = np.arange(n)
        own = np.vstack([drawn, np.zeros((1, k), drawn.dtype)]).T.astype(np.intp)
        feature, cut = self.feature[tree].astype(np.intp), self.cut[tree]
        places = (n + 1) * k * BINS
        weight, target, square = np.zeros(places), np.zeros(places), np.zeros(n + 1)
        for number, x, y in chunks:
            counts = self.counts(tree, number, len(y))
            for a in range(0, len(y), BLOCK):
                w = counts[a:a + BLOCK]
                taken = np.flatnonzero(w)
                w, t = w.take(taken).astype(float), y[a:a + BLOCK].take(taken)
                bins, base = x[a:a + BLOCK].ravel(), taken * x.shape[1]
                at = np.zeros(len(taken), np.intp)
                for _ in range(self.level):
                    right = bins.take(base + feature.take(at)) > cut.take(at)
                    at *= 2
                    at += 1
                    at += right
                at -= first
                slot = slots.take(at)
                place = np.empty((k, len(taken)), np.intp)
                start = slot * (k * BINS)
                for j in range(k):
                    np.add(start, bins.take(base + own[j].take(slot)), out=place[j])
                    start += BINS
                wt = w * t
                weight += np.bincount(place.ravel(), np.tile(w, k), places)
                target += np.bincount(place.ravel(), np.tile(wt, k), places)
                square += np.bincount(slot, wt * t, n + 1)
        return np.hstack([weight.reshape(n + 1, -1), target.reshape(n + 1, -1), square[:, None]])[:n]


def splits(sums: np.ndarray, k: int, least: int) -> tuple:
    """Each node's best split from its sums: (drawn feature's place or -1, cut, gain, weight,
    target, square, weight and target of the left side)."""
    n = len(sums)
    w, s = sums[:, :-1].reshape(n, 2, k, BINS).transpose(1, 0, 2, 3)
    whole, total, square = w[:, 0].sum(1), s[:, 0].sum(1), sums[:, -1]
    wl, sl = w.cumsum(2)[:, :, :-1], s.cumsum(2)[:, :, :-1]
    wr, sr = whole[:, None, None] - wl, total[:, None, None] - sl
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where((wl >= least) & (wr >= least), sl * sl / wl + sr * sr / wr, -np.inf).reshape(n, -1)
        best, at = gain.argmax(1), np.arange(n)
        gain = (gain[at, best] - total * total / whole) / whole
        found = gain > 1e-12 * square / whole  # less is rounding: all targets are equal
    j, cut = best // (BINS - 1), best % (BINS - 1)
    return np.where(found, j, -1), cut, np.where(found, gain, -1.0), whole, total, square, wl[at, j, cut], sl[at, j, cut]


def cut_points(flat: DataFrame, width: int) -> tuple[list[np.ndarray], int, float]:
    """Per feature the cut points in order (a row at one goes left), and the number of rows and
    their mean target."""
    x = [F.col("x")[j] for j in range(width)]
    at = F.array(*[F.lit(i / BINS) for i in range(1, BINS)])
    row = flat.agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("mean"),
                   F.count_if(F.expr("y is null or isnan(y) or abs(y) = double('inf')")).alias("bad"),
                   *[F.percentile_approx(c, at, 10_000).alias(f"q{j}") for j, c in enumerate(x)],
                   *[F.max(c).alias(f"m{j}") for j, c in enumerate(x)],
                   *[F.approx_count_distinct(c).alias(f"d{j}") for j, c in enumerate(x)]).first()
    if row["bad"]:
        raise ValueError(f"{row['bad']} targets are null or not finite")
    few = [j for j in range(width) if row[f"d{j}"] <= 2 * BINS]
    held = flat.agg(*[F.collect_set(x[j]).alias(f"v{j}") for j in few]).first() if few else {}
    cuts = []
    for j in range(width):
        values = np.unique(held[f"v{j}"]) if j in few else []
        if j in few and len(values) <= BINS:
            cuts.append((values[1:] + values[:-1]) / 2)
        else:
            q = np.unique(row[f"q{j}"])
            cuts.append(q[q < row[f"m{j}"]])
    return cuts, row["n"], row["mean"]


def chunks_of(flat: DataFrame, cuts, mean: float, parts: int) -> DataFrame:
    """(chunk, x, y): bins and centred targets of up to `CHUNK` rows as bytes, written once."""
    width, size = len(cuts), CHUNK

    def binned(batches):
        import pyarrow as pa

        number, held, n = TaskContext.get().partitionId() << 24, [], 0

        def written(table):
            values = table.column("x").combine_chunks().flatten().to_numpy().reshape(-1, width)
            x = np.stack([np.searchsorted(c, v) for c, v in zip(cuts, values.T, strict=True)], 1).astype(np.uint8)
            y = table.column("y").to_numpy() - mean
            return pa.RecordBatch.from_pydict({"chunk": pa.array([number], pa.int64()), "x": [x.tobytes()], "y": [y.tobytes()]})

        for batch in batches:
            held, n = [*held, batch], n + batch.num_rows
            while n >= size:
                table = pa.Table.from_batches(held)
                yield written(table[:size])
                held, n, number = table[size:].to_batches(), n - size, number + 1
        if n:
            yield written(pa.Table.from_batches(held))

    return flat.repartition(parts).mapInArrow(binned, "chunk long, x binary, y binary").checkpoint()


def grow(est, rows: DataFrame) -> RandomForestRegressionModel:
    """The MLlib model that `est` (a RandomForestRegressor) describes, grown on `rows`."""
    spark = rows.sparkSession
    shared_dir(spark)
    trees, depth, least = est.getNumTrees(), est.getMaxDepth(), est.getMinInstancesPerNode()
    flat = rows.select(vector_to_array(est.getFeaturesCol()).alias("x"), F.col(est.getLabelCol()).cast("double").alias("y"))
    flat = flat.checkpoint()  # read three times
    width = flat.select(F.size("x")).first()[0]
    cuts, n, mean = cut_points(flat, width)
    parts = max(8, spark.sparkContext.defaultParallelism, -(-n // CHUNK))
    chunks = chunks_of(flat, cuts, mean, parts)
    k, seed = -(-width // 3), est.getSeed() % (1 << 63)

    heap = (1 << depth + 1) - 1
    feature, cut = np.full((trees, heap), -1, np.int16), np.full((trees, heap), 255, np.uint8)
    gain, stats = np.full((trees, heap), -1.0), np.full((trees, heap, 3), np.nan)
    nodes = [np.zeros(1, int) for _ in range(trees)]
    for level in range(depth):
        rng = np.random.Generator(np.random.PCG64([seed, level]))
        drawn = [rng.random((len(at), width)).argsort(1)[:, :k].astype(np.int16) for at in nodes]
        above = (1 << level) - 1
        shared = spark.sparkContext.broadcast(vars(Level(
            level, np.maximum(feature[:, :max(1, above)], 0), cut[:, :max(1, above)], nodes, drawn, seed)))
        found = level_splits(chunks, shared, width, k, least)
        shared.unpersist()
        tree, node, best = (found[c].to_numpy() for c in ("tree", "node", "feature"))
        stats[tree, node] = np.stack([found[c].to_numpy() for c in ("weight", "target", "square")], 1)
        feature[tree, node], gain[tree, node] = best, found["gain"].to_numpy()
        tree, node, found = tree[best >= 0], node[best >= 0], found.filter(best >= 0)
        cut[tree, node] = found["cut"].to_numpy()
        left = np.stack([found["left_weight"].to_numpy(), found["left_target"].to_numpy()], 1)
        stats[tree, 2 * node + 1, :2], stats[tree, 2 * node + 2, :2] = left, stats[tree, node, :2] - left
        nodes = [np.sort(np.concatenate([2 * node[tree == t] + 1, 2 * node[tree == t] + 2])) for t in range(trees)]
        if not len(node):
            break
    return as_model(spark, est, width, cuts, mean, feature, cut, gain, stats)


def level_splits(chunks: DataFrame, shared, width: int, k: int, least: int):
    """(tree, node, feature, cut, gain, weight, target, square, left_weight, left_target) of all
    nodes of a level, as an Arrow table: one row a node."""

    def summed(batches):
        import pyarrow as pa

        held = [(r["chunk"], np.frombuffer(r["x"], np.uint8).reshape(-1, width), np.frombuffer(r["y"]))
                for batch in batches for r in batch.to_pylist()]
        level = Level(**shared.value)
        for t, nodes in enumerate(level.nodes if held else ()):
            if len(nodes):
                sums, ends = level.sums(t, held), range(0, len(nodes), BAND)
                yield pa.RecordBatch.from_pydict({
                    "tree": pa.array([t] * len(ends), pa.int32()), "band": pa.array(ends, pa.int32()),
                    "chunk": pa.array([held[0][0]] * len(ends), pa.int64()),
                    "sums": pa.array([sums[a:a + BAND].tobytes() for a in ends], pa.binary())})

    def best(key, table):
        import pyarrow as pa

        t, a = (v.as_py() for v in key)
        level = Level(**shared.value)
        nodes, drawn = level.nodes[t][a:a + BAND], level.drawn[t][a:a + BAND]
        sums = sum(np.frombuffer(v.as_buffer()) for v in table.sort_by("chunk")["sums"])
        place, cut, *more = splits(sums.reshape(len(nodes), -1), k, least)
        feature = np.where(place < 0, -1, drawn[np.arange(len(nodes)), place])
        ints = [np.full(len(nodes), t), nodes, feature, cut]
        return pa.Table.from_arrays([*[pa.array(v, pa.int32()) for v in ints], *map(pa.array, more)], names=names)

    names = ["tree", "node", "feature", "cut", "gain", "weight", "target", "square", "left_weight", "left_target"]
    schema = ", ".join(f"{c} {'int' if i < 4 else 'double'}" for i, c in enumerate(names))
    return chunks.mapInArrow(summed, "tree int, band int, chunk long, sums binary") \
        .groupBy("tree", "band").applyInArrow(best, schema).toArrow()


def as_model(spark, est, width, cuts, mean, feature, cut, gain, stats) -> RandomForestRegressionModel:
    """The grown trees as an MLlib model, by way of the files that MLlib saves."""
    import pyarrow as pa

    path = f"{shared_dir(spark)}/ledgerline/grown-{uuid.uuid4().hex[:12]}"
    est.write().overwrite().save(f"{path}/estimator")
    about = json.loads(spark.read.text(f"{path}/estimator/metadata").first()[0])
    trees = len(feature)

    def described(kind, **more):
        return json.dumps(about | {"class": f"org.apache.spark.ml.regression.{kind}"} | more)

    def only_tree(params):
        return {c: v for c, v in params.items()
                if c not in ("numTrees", "bootstrap", "featureSubsetStrategy", "subsamplingRate")}

    each = described("DecisionTreeRegressionModel", uid=f"dtr_{uuid.uuid4().hex[:12]}", paramMap=only_tree(about["paramMap"]),
                     defaultParamMap=only_tree(about["defaultParamMap"]))
    spark.createDataFrame([(described("RandomForestRegressionModel", numFeatures=width, numTrees=trees),)], "value string") \
        .coalesce(1).write.text(f"{path}/model/metadata")
    spark.createDataFrame([(t, each, 1.0) for t in range(trees)], "_1 int, _2 string, _3 double") \
        .coalesce(1).write.parquet(f"{path}/model/treesMetadata")

    # the heap's nodes that are there, numbered in its order without gaps
    split = feature >= 0
    there = np.zeros(feature.shape, bool)
    there[:, 0] = True
    inner = feature.shape[1] // 2
    there[:, 1::2] = there[:, 2::2] = split[:, :inner]
    number = there.cumsum(1) - 1
    tree, node = np.nonzero(there)
    split = split[tree, node]
    w, s, q = stats[tree, node].T
    prediction = s / w + mean
    impurity = np.where(np.isnan(q), -1.0, (q - s * s / w) / w)  # unknown for the last level's leaves
    below = np.where(split, 2 * node + 1, 0)
    f, c = feature[tree, node], cut[tree, node]
    threshold = np.array([cuts[a][b] for a, b in zip(f[split], c[split], strict=True)], float)
    ends = pa.array(np.concatenate([[0], split.cumsum()]), pa.int32())
    sums = np.stack([w, s + w * mean, q + 2 * mean * s + w * mean * mean], 1)
    data = pa.StructArray.from_arrays([
        pa.array(number[tree, node], pa.int32()), pa.array(prediction), pa.array(impurity),
        pa.ListArray.from_arrays(pa.array(np.arange(0, 3 * len(w) + 1, 3), pa.int32()), pa.array(sums.ravel())),
        pa.array(w.astype(np.int64)), pa.array(gain[tree, node]),
        pa.array(np.where(split, number[tree, below], -1), pa.int32()),
        pa.array(np.where(split, number[tree, below] + 1, -1), pa.int32()),
        pa.StructArray.from_arrays([pa.array(f, pa.int32()), pa.ListArray.from_arrays(ends, pa.array(threshold)),
                                    pa.array(np.full(len(w), -1), pa.int32())],
                                   ["featureIndex", "leftCategoriesOrThreshold", "numCategories"])],
        ["id", "prediction", "impurity", "impurityStats", "rawCount", "gain", "leftChild", "rightChild", "split"])
    spark.createDataFrame(pa.table({"treeID": pa.array(tree, pa.int32()), "nodeData": data})) \
        .write.parquet(f"{path}/model/data")
    model = RandomForestRegressionModel.load(f"{path}/model")
    delete_folder(spark, path)
    return model
