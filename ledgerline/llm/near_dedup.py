"""MinHash near-dedup with odd sketches and banded candidates.

A document's set holds the 64-bit hashes of its distinct word shingles.  Equal sets
become one class first (a group-by on a 64-bit hash of the set), so copies cost nothing
further.  Each class has `BANDS` x `ROWS` MinHash samples.  Samples are folded into
a parity bitmap of `BITS` bits (an odd sketch); the population count of two
sketches' XOR estimates a high similarity more precisely than matching samples of
the same size would.  Classes that share a band are candidates.

Within a band's bucket everything is compared with one member first, sketch before
set, and the true links are joined into components.  That member is the one whose
buckets are largest in all: among near copies, a text close to their common origin.
What then stays apart gets a second, finer odd sketch (`FINE` samples in `FINE_BITS`
bits), and members of *different* components of a bucket are compared inside a join
whose condition is both sketches' estimate, each pair in the first band it shares.
So a group of copies costs its size, not its square; only pairs that are about as
similar as asked become rows; and no pair that shares a band is left out.  Every link
is confirmed on the full sets.

At similarity 0.8 a pair misses all bands with probability (1 - 0.8**5)**40 = 1e-7.
A sketch passes a pair up to `SIGMAS` standard deviations from what 0.8 would give.

Defined results: null, empty or blank texts have an empty set and link with nothing;
fewer words than a shingle make one shingle; rows with a null doc_id link with
nothing and are kept; repeated rows are each returned; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import (Stages, ascii_lower, mix64, row_chunks, span_hashes, text_bytes,
                                   word_spans)
from ledgerline.llm.components import connected_components

BANDS, ROWS = 40, 5
BITS = 512
FINE, FINE_BITS = 4096, 8192
SIGMAS = 4.5


def shingle_sets(column, width: int):
    """Yield (row, sorted distinct shingle hashes) for every row of an Arrow string column."""
    buf, off = text_bytes(column)
    for i, j in row_chunks(off):
        part = ascii_lower(buf[off[i]:off[j]])
        at = off[i:j + 1] - off[i]
        starts, ends, rows = word_spans(part, at)
        words = span_hashes(part, starts, ends)
        edge = np.searchsorted(rows, np.arange(j - i + 1))
        grams = words.copy()
        for k in range(1, width):
            follow = np.zeros_like(words)
            follow[:-k] = words[k:]
            grams = mix64(grams * np.uint64(0x9E3779B97F4A7C15) + follow)
        for r in range(j - i):
            a, b = edge[r], edge[r + 1]
            if b - a >= width:
                own = np.sort(grams[a:b - width + 1])
                yield i + r, own[np.concatenate([[True], own[1:] != own[:-1]])]
            elif b > a:
                whole = words[a:a + 1]
                for k in range(a + 1, b):
                    whole = mix64(whole * np.uint64(0xC2B2AE3D27D4EB4F) + words[k:k + 1])
                yield i + r, mix64(whole + np.uint64(b - a))
            else:
                yield i + r, words[:0]


def odd_bound(samples: int, bits: int, similarity: float) -> int:
    """XOR bits that two sketches of that similarity stay below, by SIGMAS deviations.

    A differing sample toggles two of the bits; a bit is odd with probability p.
    """
    apart = samples * (1 - similarity)
    fade = math.exp(-4 * apart / bits)
    p = (1 - fade) / 2
    spread = math.sqrt(4 * fade * fade * samples * similarity * (1 - similarity) + bits * p * (1 - p))
    return math.ceil(bits * p + SIGMAS * spread)


def _samplers(count: int) -> tuple[np.ndarray, np.ndarray]:
    seed = mix64(np.arange(1, 2 * count + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))
    words = (seed >> np.uint64(32)).astype(np.uint32)
    return words[::2] | np.uint32(1), words[1::2]


def samples(sets: list, count: int | None = None) -> np.ndarray:
    """MinHash samples, one row for each non-empty set."""
    factor, flip = _samplers(count or BANDS * ROWS)
    out = np.empty((len(factor), len(sets)), np.uint32)
    flat = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    at = np.cumsum([0] + [len(s) for s in sets[:-1]])
    for k in range(len(factor)):
        out[k] = np.minimum.reduceat((flat ^ flip[k]) * factor[k], at)
    return out.T


def odd_sketches(minima: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Parity bitmaps of the samples, as bits / 64 signed longs a row."""
    n, k = minima.shape
    spot = mix64(minima.astype(np.uint64) + (np.arange(k, dtype=np.uint64) << np.uint64(32))) % np.uint64(bits)
    flat = (np.arange(n)[:, None] * bits + spot.astype(np.int64)).ravel()
    odd = (np.bincount(flat, minlength=n * bits) & 1).astype(np.uint8).reshape(n, bits)
    return np.packbits(odd, axis=1).view(np.int64)


_SKETCH = [f"s{i}" for i in range(BITS // 64)]


def _signatures(width: int):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            ids, whole_texts = batch.column("doc_id").to_numpy(zero_copy_only=False), batch.column("whole")
            null = np.array(batch.column("doc_id").is_null())
            held, size = [], 0

            def flush(held=held, ids=ids, null=null, whole_texts=whole_texts):
                rows = np.array([r for r, _ in held], np.int64)
                counts = np.array([len(s) for _, s in held], np.int64)
                full = np.flatnonzero(counts)
                bands, sketch = np.zeros((len(rows), BANDS), np.int64), np.zeros((len(rows), len(_SKETCH)), np.int64)
                whole = np.zeros(len(rows), np.uint64)
                if len(full):
                    sets = [held[f][1] for f in full]
                    minima = samples(sets)
                    sketch[full] = odd_sketches(minima)
                    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (len(full), BANDS))
                    for k in range(ROWS):
                        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + minima[:, k::ROWS])
                    bands[full] = key.view(np.int64)
                    whole[full] = _set_hash(sets)
                own = [pa.array(ids[rows].astype(np.int64) if not null.any() else
                                [None if null[r] else int(ids[r]) for r in rows], pa.int64()),
                       whole_texts.take(pa.array(rows)), pa.array(counts), pa.array(whole.view(np.int64)),
                       pa.ListArray.from_arrays(pa.array(np.arange(0, bands.size + 1, BANDS), pa.int32()),
                                                pa.array(bands.ravel()))]
                own += [pa.array(np.ascontiguousarray(sketch[:, c])) for c in range(len(_SKETCH))]
                held.clear()
                return pa.RecordBatch.from_arrays(own, ["doc_id", "whole", "n", "h1", "bands", *_SKETCH])

            for row, own in shingle_sets(batch.column("text"), width):
                held.append((row, own))
                size += len(own)
                if size > 1 << 17:
                    yield flush()
                    size = 0
            if held:
                yield flush()
    return run


def _set_hash(sets: list) -> np.ndarray:
    """One 64-bit hash for each non-empty set, the same for equal sets."""
    at = np.cumsum([0] + [len(s) for s in sets[:-1]])
    size = np.array([len(s) for s in sets], np.uint64)
    return mix64(np.add.reduceat(mix64(np.concatenate(sets)), at) + size)


def _sets(width: int):
    def run(batches):
        import pyarrow as pa

        def flush(held):
            ends = np.cumsum([0] + [len(s) for s in held]).astype(np.int32)
            return pa.RecordBatch.from_arrays(
                [pa.array(_set_hash(held).view(np.int64)),
                 pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(held).view(np.int64)))],
                ["h1", "items"])

        for batch in batches:
            held, size = [], 0
            for _, own in shingle_sets(batch.column("text"), width):
                if len(own):
                    held.append(own)
                    size += len(own)
                if size > 1 << 20:
                    yield flush(held)
                    held, size = [], 0
            if held:
                yield flush(held)
    return run


def _fine(width: int):
    """Set hashes and fine sketches of texts."""
    def run(batches):
        import pyarrow as pa

        def flush(held):
            sketch = odd_sketches(samples(held, FINE), FINE_BITS)
            ends = np.arange(0, sketch.size + 1, sketch.shape[1]).astype(np.int32)
            return pa.RecordBatch.from_arrays(
                [pa.array(_set_hash(held).view(np.int64)),
                 pa.ListArray.from_arrays(pa.array(ends), pa.array(sketch.ravel()))], ["h1", "fine"])

        for batch in batches:
            held = []
            for _, own in shingle_sets(batch.column("text"), width):
                if len(own):
                    held.append(own)
                if len(held) == 128:
                    yield flush(held)
                    held = []
            if held:
                yield flush(held)
    return run


class NearDedup:
    """One run over (doc_id, text): links of `percent` or more, and what they join."""

    def __init__(self, docs: DataFrame, width: int = 2, percent: int = 80):
        self.docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        self.keyed = self.docs.withColumn("whole", F.xxhash64("text"))
        self.width, self.percent = width, percent
        self.stages = Stages(docs.sparkSession, "near-dedup")

    def _texts(self, classes: DataFrame) -> DataFrame:
        """One text of every class in a (h1) table."""
        ids = self.classes.join(classes, "h1", "left_semi").select(F.col("rep").alias("doc_id")).distinct()
        self.reads += 1
        return self.docs.join(self.stages.keep(ids, f"ids-{self.reads}"), "doc_id", "left_semi")

    def _confirm(self, pairs: DataFrame, name: str) -> DataFrame:
        """Those of the class pairs (a, b, na, nb, ...) whose full sets are similar enough."""
        ends = pairs.select(F.col("a").alias("h1")).union(pairs.select("b")).distinct()
        # rows that repeat a text are one set
        sets = self.stages.keep(self._texts(ends).mapInArrow(
            _sets(self.width), "h1 long, items array<long>").dropDuplicates(["h1"]), f"{name}-sets")
        both = (pairs.join(sets.select(F.col("h1").alias("a"), F.col("items").alias("ia")), "a")
                .join(sets.select(F.col("h1").alias("b"), F.col("items").alias("ib")), "b")
                .withColumn("m", F.size(F.array_intersect("ia", "ib")).cast("long")))
        links = self.stages.keep(both.where(f"100 * m >= {self.percent} * (na + nb - m)")
                                 .select(*pairs.columns), name)
        self.stages.drop(f"{name}-sets")
        return links

    def _stars(self, met: DataFrame, heads: DataFrame) -> DataFrame:
        """Links of every bucket's members with its head, after their sketches."""
        stars = self.stages.keep(met.join(heads, "key").where("h1 <> head").select(
            F.col("h1").alias("a"), F.col("head").alias("b")).distinct(), "stars")
        side = {e: self.reps.select(F.col("h1").alias(e), F.col("n").alias(f"n{e}"),
                                    *[F.col(s).alias(f"{e}{s}") for s in _SKETCH]) for e in "ab"}
        odd = " + ".join(f"bit_count(a{s} ^ b{s})" for s in _SKETCH)
        likely = self.stages.keep(stars.join(side["a"], "a").join(side["b"], "b").where(
            f"100 * least(na, nb) >= {self.percent} * greatest(na, nb) and {odd} <= {self.bound}")
            .select("a", "b", "na", "nb"), "likely")
        links = self._confirm(likely, "links")
        self.stages.drop("stars", "likely", "heads")
        return links

    def run(self) -> DataFrame:
        """doc_id, the hash `whole` of the text, n_shingles, component_id, kept for every row."""
        keep, p = self.stages.keep, self.percent
        self.bound = odd_bound(BANDS * ROWS, BITS, p / 100)
        self.reads = 0
        sig = keep(self.keyed.mapInArrow(
            _signatures(self.width), "doc_id long, whole long, n long, h1 long, bands array<long>, "
            + ", ".join(f"{s} long" for s in _SKETCH)).withColumn("row", F.monotonically_increasing_id()), "signatures")
        # one row stands for each class, however often its text or its doc_id repeats
        self.classes = classes = keep(sig.where("n > 0 and doc_id is not null").groupBy("h1").agg(
            F.min(F.struct("doc_id", "row")).alias("x")).select("h1", "x.row", F.col("x.doc_id").alias("rep")), "classes")
        self.reps = reps = keep(sig.join(classes.select("row"), "row", "left_semi").drop("doc_id", "whole", "row"), "reps")
        keys = reps.select("h1", F.posexplode("bands").alias("band", "key"))
        sizes = keep(keys.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "sizes")
        met = keep(keys.join(sizes, "key").select("key", "band", "h1", "size"), "met")
        weights = keep(met.groupBy("h1").agg(F.sum("size").alias("weight")), "weights")
        heads = keep(met.join(weights, "h1").groupBy("key").agg(F.max(F.struct("weight", "h1")).alias("head"))
                     .select("key", F.col("head.h1").alias("head")), "heads")
        parts = connected_components(self._stars(met, heads), self.stages, "first-parts")
        # what stayed apart inside a bucket of three or more is compared member by member
        spot = keep(met.where("size > 2").join(parts.withColumnRenamed("node", "h1"), "h1", "left").select(
            "key", "band", "h1", F.coalesce("component", "h1").alias("part")), "spots")
        mixed = keep(spot.groupBy("key").agg(F.min("part").alias("x"), F.max("part").alias("y"))
                     .where("x <> y").select("key"), "mixed")
        apart = keep(spot.join(mixed, "key"), "apart")
        self.stages.drop("sizes", "met", "weights", "spots", "mixed")
        named = classes.join(parts.withColumnRenamed("node", "h1"), "h1", "left").select(
            "h1", "rep", F.coalesce("component", "h1").alias("part"))
        more = None if apart.isEmpty() else self._across(apart)
        if more is not None and not more.isEmpty():
            across = connected_components(self._confirm(more, "more-links").select(
                F.col("pa").alias("a"), F.col("pb").alias("b")), self.stages, "second-parts")
            named = keep(named, "named-first").join(across.withColumnRenamed("node", "part"), "part", "left").select(
                "h1", "rep", F.coalesce("component", "part").alias("part"))
        named = keep(named, "named")
        self.stages.drop("reps", "apart", "apart-classes", "fine", "rest", "across")
        first = keep(named.groupBy("part").agg(F.min("rep").alias("component")), "first-ids")
        of_class = keep(named.join(first, "part").select("h1", "component"), "class-components")
        out = sig.select("doc_id", "whole", F.col("n").alias("n_shingles"), "h1").join(of_class, "h1", "left")
        return out.select("doc_id", "whole", "n_shingles", F.expr(
            "if(n_shingles > 0 and doc_id is not null, component, doc_id)").alias("component_id")).withColumn(
            "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))

    def _across(self, apart: DataFrame) -> DataFrame:
        """Pairs of different components of a bucket that both sketches let pass."""
        p = self.percent
        who = self.stages.keep(apart.select("h1").distinct(), "apart-classes")
        fine = self.stages.keep(self._texts(who).mapInArrow(_fine(self.width), "h1 long, fine array<long>")
                                .join(who, "h1", "left_semi").dropDuplicates(["h1"]), "fine")
        rest = self.stages.keep(apart.join(self.reps.join(fine, "h1"), "h1"), "rest")
        odd = " + ".join(f"bit_count(x.{s} ^ y.{s})" for s in _SKETCH)
        pairs = rest.alias("x").join(rest.alias("y"), F.expr(f"""
            x.key = y.key and x.part <> y.part and x.h1 > y.h1
            and 100 * least(x.n, y.n) >= {p} * greatest(x.n, y.n) and {odd} <= {self.bound}
            and array_position(zip_with(x.bands, y.bands, (k, l) -> k = l), true) = x.band + 1
            and aggregate(zip_with(x.fine, y.fine, (k, l) -> bit_count(k ^ l)), 0, (k, l) -> k + l)
                <= {odd_bound(FINE, FINE_BITS, p / 100)}"""))
        return self.stages.keep(pairs.select(
            F.col("x.h1").alias("a"), F.col("y.h1").alias("b"), F.col("x.n").alias("na"), F.col("y.n").alias("nb"),
            F.col("x.part").alias("pa"), F.col("y.part").alias("pb")).distinct(), "across")


def near_dedup(docs: DataFrame, width: int = 2, percent: int = 80) -> DataFrame:
    return NearDedup(docs, width, percent).run().drop("whole")


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """`docs` without the rows whose document is in a group kept under a smaller id.

    Near copies share 0.8 of their five-word shingles.  Rows that repeat a kept doc_id stay; of a doc_id with several texts each text is
    judged alone.  Only the ids and text hashes to drop meet the texts.
    """
    run = NearDedup(docs, width=5)
    stages = Stages(docs.sparkSession, "near-dedup-stage")
    gone = stages.keep(run.run().where("not kept").select(
        F.col("doc_id").alias("__id"), F.col("whole").alias("__whole")).distinct(), "gone")
    run.stages.clear()
    own = (F.col("doc_id").cast("long") == F.col("__id")) & (F.xxhash64("text") == F.col("__whole"))
    return docs.join(gone, own, "left_anti").select(*docs.columns)


ORACLE = """
with recursive w as (select doc_id, list_filter(regexp_split_to_array(
     translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'),
     lambda x: x <> '') as words from documents),
 s as (select doc_id, case when len(words) > 1 then list_distinct(list_transform(range(1, len(words)),
     lambda i: words[i] || ' ' || words[i + 1])) else words end as grams from w),
 e as (select doc_id, unnest(grams) as g from s),
 c as (select a.doc_id as a, b.doc_id as b, count(*) as m from e a join e b on a.g = b.g and a.doc_id < b.doc_id group by all),
 l as (select a, b from c join s x on x.doc_id = a join s y on y.doc_id = b
     where 100 * m >= 80 * (len(x.grams) + len(y.grams) - m)),
 k as (select a, b from l union all select b, a from l),
 r as (select doc_id as a, doc_id as b from s union select r.a, k.b from r join k on r.b = k.a),
 f as (select a, min(b) as component_id from r group by a)
select doc_id, len(grams)::bigint as n_shingles, component_id, doc_id = component_id as kept from s join f on f.a = s.doc_id
"""
