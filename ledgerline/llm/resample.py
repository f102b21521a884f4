"""Target-distribution importance resampling with hashed n-gram features.

Features are the runs of one to two words; each falls into one of `BUCKETS` buckets by
its CRC.  Two histograms of bucket counts, of the raw corpus (S features, s in the
bucket) and of the target (T and t), give every bucket a gain, the floored scaled
logarithm of its smoothed likelihood ratio.  A document's weight is the floored mean
of its features' gains; Gumbel noise of its id turns weights into a draw without
replacement: the highest scores are drawn.

Both passes run on Arrow kernels: `ascii_lower`, `split_pattern_regex`, `list_flatten`
and `dictionary_encode` turn a chunk of texts into one run of dictionary indices; an
index and its neighbour, shifted by one, are a two-word feature.  Only the distinct
words and pairs of a chunk are spelled out for their CRC; gains are taken by index and
summed by segments.  A task's histogram has at most `BUCKETS` rows, so nothing but
those rows is shuffled to count, and the gains sent to tasks are `BUCKETS` integers
whatever the corpus.

Ranks need no window over all rows: the drawn rows lie above a score found from
counts per score (scores are integers; their number is bounded by the gains' range),
are dealt by range of (score, doc_id), numbered within their partition as they
stream, and get their partition's offset.

Defined results: a null text has no words; fewer than `MIN_WORDS` words take no part
in the draw; null text, no words: weight 0; a null doc_id counts as an empty one in
the noise and comes last among equal scores; repeated rows are rows of their own and
are told apart by weight, then text; an empty target gives every bucket t = 0; an
empty table gives no rows; texts are read whole, however long; other columns are not
read and may have any name.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import CRC_TABLE, Stages, crc_sql, ranked, row_chunks, text_bytes

BUCKETS = 10_000
MIN_WORDS = 20
PERCENT = 25
SEED = 7
#: Bytes of text that are encoded with one dictionary.
SPAN = 1 << 22
#: What is no word character after lowering, as in the words' pattern.
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def feature_buckets(texts, buckets: int = BUCKETS):
    """Words per row, the buckets of all features of the rows, and the row of each.

    `texts`: an Arrow string array.  One-word features come first, then the pairs.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    parts = pc.split_pattern_regex(pc.ascii_lower(texts.fill_null("")), BREAKS)
    words, rows = pc.list_flatten(parts), pc.list_parent_indices(parts)
    real = pc.not_equal(words, "")  # a text that begins or ends with a break has an empty part there
    words, rows = words.filter(real), rows.filter(real).to_numpy().astype(np.int64)
    counts = np.bincount(rows, minlength=len(texts))
    if not len(words):
        return counts, np.zeros(0, np.int64), rows
    coded = pc.dictionary_encode(words)
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    index = coded.indices.to_numpy().astype(np.int64)
    spelled = [w.encode() for w in coded.dictionary.to_pylist()]
    crcs = [zlib.crc32(w) for w in spelled]
    single = np.array(crcs, np.int64) % buckets
    near = rows[1:] == rows[:-1]  # a word and the next one of the same row
    pairs, back = np.unique((index[:-1] * len(spelled) + index[1:])[near], return_inverse=True)
    after = [b" " + w for w in spelled]
    double = np.fromiter((zlib.crc32(after[b], crcs[a]) for a, b in
                          zip((pairs // len(spelled)).tolist(), (pairs % len(spelled)).tolist(), strict=True)),
                         np.int64, len(pairs)) % buckets
    return (counts, np.concatenate([single[index], double[back]]),
            np.concatenate([rows, rows[1:][near]]))


def _spans(column):
    _, off = text_bytes(column)
    for i, j in row_chunks(off, SPAN):
        yield column.slice(i, j - i)


def _histogram(buckets: int):
    def run(batches):
        import pyarrow as pa

        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for texts in _spans(batch.column("text")):
                total += np.bincount(feature_buckets(texts, buckets)[1], minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(total[held])], ["bucket", "n"])
    return run


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features per bucket of all rows of (text): `buckets` numbers, whatever the corpus."""
    rows = (texts.select("text").mapInArrow(_histogram(buckets), "bucket int, n long")
            .groupBy("bucket").agg(F.sum("n").alias("n")).collect())
    out = np.zeros(buckets, np.int64)
    for r in rows:
        out[r.bucket] = r.n
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t + 1)(S + B) / ((s + 1)(T + B)))) for every bucket."""
    b = len(raw)
    ratio = ((target + 1.0) * (raw.sum() + float(b))) / ((raw + 1.0) * (target.sum() + float(b)))
    return np.floor(1000.0 * np.log(ratio)).astype(np.int64)


def _weigh(gain: np.ndarray):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            at = 0
            for texts in _spans(batch.column("text")):
                words, bucket, row = feature_buckets(texts, len(gain))
                n = np.bincount(row, minlength=len(texts))
                # sums of whole numbers far below 2**53: exact in doubles
                total = np.bincount(row, gain[bucket], len(texts)).astype(np.int64)
                own = batch.slice(at, len(texts))
                yield pa.RecordBatch.from_arrays(
                    [own.column("doc_id"), own.column("whole"), pa.array(words), pa.array(n),
                     pa.array(np.where(n > 0, total // np.maximum(n, 1), 0))],
                    ["doc_id", "whole", "n_words", "n_features", "weight"])
                at += len(texts)
    return run


def weigh(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, whole (text hash), n_words, n_features, weight of every row of (doc_id, text)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.xxhash64("text").alias("whole"), "text").mapInArrow(
        _weigh(gain), f"doc_id {kind}, whole long, n_words long, n_features long, weight long")


def noisy_score(doc_id, weight, seed: int = SEED):
    """weight + floor(-1000 ln(-ln((h + 0.5) / 2**32))), h from sha256 of `seed:doc_id`."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    return weight + F.floor(-1000.0 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS,
             buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every row of `docs`; `target`: (text)."""
    stages = Stages(docs.sparkSession, "resample")
    gain = gains(bucket_counts(docs, buckets), bucket_counts(target, buckets))
    scored = weigh(docs, gain).withColumn("score", noisy_score(F.col("doc_id"), F.col("weight"), seed))
    # the row number tells repeated rows apart once it is written
    scored = stages.keep(scored.withColumn("__row", F.monotonically_increasing_id()), "scored")
    fit = scored.where(f"n_words >= {min_words}")
    sizes = sorted(((s, n) for s, n in fit.groupBy("score").count().collect()), reverse=True)  # whole-number scores
    want, seen, edge = percent * sum(n for _, n in sizes) // 100, 0, None
    for score, n in sizes:
        if seen >= want:
            break
        seen, edge = seen + n, score
    top = fit.where(F.col("score") >= F.lit(edge)) if edge is not None else fit.limit(0)
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("weight"), F.asc("whole"), F.asc("__row")]
    drawn = ranked(top.select("doc_id", "score", "weight", "whole", "__row"), order, stages, "drawn")
    drawn = stages.keep(drawn.where(f"rank <= {want}").select("__row", "rank"), "ranks")
    stages.drop("drawn")
    return scored.join(drawn, "__row", "left").select("doc_id", "n_features", "weight", "score", "rank")


ORACLE = f"""
with {CRC_TABLE},
 src as (select 0 as side, row_number() over () as rid, doc_id, coalesce(text, '') as text from documents
   union all select 1, row_number() over (), item_id, coalesce(text, '') from benchmark),
 w as (select side, rid, doc_id, list_filter(regexp_split_to_array(
     translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
     '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') as words from src),
 f as (select side, rid, unnest(list_concat(words, list_transform(range(1, len(words)),
     lambda i: words[i] || ' ' || words[i + 1]))) as feature from w),
 b as (select feature, {crc_sql('feature')} % {BUCKETS} as bucket from (select distinct feature from f), crc_table),
 h as (select bucket, count(*) filter (side = 0) as s, count(*) filter (side = 1) as t
   from f join b using (feature) group by bucket),
 g as (select bucket, floor(1000 * ln(((t + 1)::double * ((select sum(s) from h) + {BUCKETS})::double)
     / ((s + 1)::double * ((select sum(t) from h) + {BUCKETS})::double)))::bigint as gain from h),
 d as (select rid, count(*) as n, floor(sum(gain)::double / count(*))::bigint as weight
   from f join b using (feature) join g using (bucket) where side = 0 group by rid),
 x as (select w.rid, w.doc_id, len(words) as n_words, coalesce(n, 0)::bigint as n_features, coalesce(weight, 0)::bigint as weight,
     ('0x' || substr(sha256('{SEED}:' || coalesce(w.doc_id::varchar, '')), 1, 8))::bigint as h
   from w left join d on w.rid = d.rid where w.side = 0),
 z as (select *, weight + floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296)))::bigint as score from x),
 r as (select rid, row_number() over (order by score desc, doc_id) as k, count(*) over () as n_fit
   from z where n_words >= {MIN_WORDS})
select doc_id, n_features, weight, score::bigint as score,
       case when k <= {PERCENT} * n_fit // 100 then k end::bigint as rank
from z left join r on z.rid = r.rid
"""
