"""Language identification with language-bitmask n-gram filters.

Letter trigrams (three code points of the lower-cased text whose middle one is a
letter; anything else counts as a word edge) are counted per language over all
labelled training rows.  A trigram enters the filter of every language in which
its share is at least `FLOOR` and at least `RATIO` of its largest share in any
language.  The filters are Bloom filters kept bit-sliced: one table of slots whose
entries are language bitmasks, so AND-ing a trigram's `HASHES` slots returns every
language that holds it.  A text's bits are counted per language, corrected for
that language's false-positive rate (fill ** HASHES), and the largest wins.

The table has `SLOTS` entries whatever the corpus, so it may be broadcast.

Defined results: null text or text without a letter gives `und` with score 0; a
text none of whose trigrams is known gives the first learned value with score 0;
ties go to the smaller value; no training rows at all give `und`; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import process_cache, row_chunks, text_bytes

SLOTS = 1 << 20
HASHES = 2
FLOOR = 2e-6
RATIO = 0.3
WORD = 62  # languages in one signed 64-bit mask

#: The share of a text's trigrams that its best language must hold in the pipeline.
MIN_SUPPORT = 0.2


def _letters() -> np.ndarray:
    store = process_cache("langid")
    if "letters" not in store:
        store["letters"] = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return store["letters"]


def trigrams(texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of all trigrams of the texts, n+1 offsets into them, and whether a text has a letter."""
    lowered = [t.lower() for t in texts]
    code = np.frombuffer("\n".join(["", *lowered, ""]).encode("utf-32-le", "replace"), np.uint32)
    letter = _letters()[code]
    c = np.where(letter, code, 0).astype(np.uint64)
    at = np.flatnonzero(letter[1:-1])
    keys = c[at] | (c[at + 1] << np.uint64(21)) | (c[at + 2] << np.uint64(42))
    edges = np.cumsum([0] + [len(t) + 1 for t in lowered])
    offsets = np.searchsorted(at, edges)
    return keys, offsets, np.diff(offsets) > 0


def slots(keys: np.ndarray, n_slots: int) -> list:
    shift = np.uint64(64 - (n_slots.bit_length() - 1))
    odd = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)
    mixed = keys ^ (keys >> np.uint64(29))
    return [((mixed * np.uint64(k)) >> shift).astype(np.int64) for k in odd[:HASHES]]


def _count(batches):
    """Trigram counts per language of a task's rows, one row per (language, trigram)."""
    import pyarrow as pa

    held: dict = {}

    def fold(lang):
        keys, n = np.concatenate([k for k, _ in held[lang]]), np.concatenate([n for _, n in held[lang]])
        keys, at = np.unique(keys, return_inverse=True)
        held[lang] = [(keys, np.bincount(at, n, len(keys)).astype(np.int64))]

    for batch in batches:
        texts, langs = batch.column("text"), np.array(batch.column("lang").to_pylist(), object)
        _, off = text_bytes(texts)
        for i, j in row_chunks(off):
            part = np.array([t or "" for t in texts.slice(i, j - i).to_pylist()], object)
            for lang in set(langs[i:j]):
                keys, _, _ = trigrams(list(part[langs[i:j] == lang]))
                held.setdefault(lang, []).append(np.unique(keys, return_counts=True))
                if len(held[lang]) > 32:
                    fold(lang)
    for lang in held:
        fold(lang)
        keys, n = held[lang][0]
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(n)],
            ["lang", "gram", "n"])


class LanguageFilter:
    """The fitted filters: learned values in order, and the slot table of bitmasks."""

    def __init__(self, langs: list, masks: np.ndarray):
        self.langs, self.masks = langs, masks
        fill = [((masks[i // WORD] >> (i % WORD)) & 1).mean() for i in range(len(langs))]
        self.fp = np.minimum(np.array(fill, float) ** HASHES, 0.999)


def fit(docs: DataFrame, n_slots: int = SLOTS) -> LanguageFilter:
    """Learn from all rows of (text, lang); null languages are left out."""
    spark = docs.sparkSession
    train = docs.where("lang is not null").select("text", "lang")
    counts = (train.mapInArrow(_count, "lang string, gram long, n long")
              .groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    from ledgerline.llm.common import Stages
    stages = Stages(spark, "langid")
    counts = stages.keep(counts, "counts")
    totals = {r[0]: r[1] for r in train.select("lang").distinct()
              .join(counts.groupBy("lang").agg(F.sum("n").alias("t")), "lang", "left").collect()}
    langs = sorted(totals)
    if not langs:
        return LanguageFilter([], np.zeros((1, n_slots), np.int64))
    order = spark.createDataFrame([(g, i, float(totals[g] or 1)) for i, g in enumerate(langs)],
                                  "lang string, i int, total double")
    shares = counts.join(F.broadcast(order), "lang").select("gram", "i", (F.col("n") / F.col("total")).alias("p"))
    best = shares.groupBy("gram").agg(F.max("p").alias("top"), F.collect_list(F.struct("i", "p")).alias("all"))
    chosen = (best.select("gram", "top", F.explode("all").alias("x"))
              .where(f"x.p >= {FLOOR} and x.p >= {RATIO} * top")
              .select("gram", F.col("x.i").alias("i")))
    odd_slots = chosen.mapInArrow(_slot_rows(n_slots), "word int, slot int, mask long")
    rows = odd_slots.groupBy("word", "slot").agg(F.bit_or("mask").alias("mask")).toPandas()  # SLOTS rows a word at most
    masks = np.zeros((-(-len(langs) // WORD), n_slots), np.int64)
    masks[rows["word"].to_numpy(), rows["slot"].to_numpy()] = rows["mask"].to_numpy()
    return LanguageFilter(langs, masks)


def _slot_rows(n_slots: int):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            keys = batch.column("gram").to_numpy().view(np.uint64)
            lang = batch.column("i").to_numpy().astype(np.int64)
            for s in slots(keys, n_slots):
                yield pa.RecordBatch.from_arrays(
                    [pa.array((lang // WORD).astype(np.int32)), pa.array(s.astype(np.int32)),
                     pa.array(np.int64(1) << (lang % WORD))], ["word", "slot", "mask"])
    return run


def label(texts, model: tuple) -> tuple[list, np.ndarray, np.ndarray]:
    """Language, score and support of every text of an Arrow column."""
    langs, masks, fp = model
    names, scores, supports = [], [np.zeros(0)], [np.zeros(0)]
    _, off = text_bytes(texts)
    for i, j in row_chunks(off):
        keys, at, has = trigrams([t or "" for t in texts.slice(i, j - i).to_pylist()])
        if not langs:
            names += ["und"] * (j - i)
            scores.append(np.zeros(j - i))
            supports.append(np.zeros(j - i))
            continue
        n = np.maximum(np.diff(at), 1)
        index = slots(keys, masks.shape[1])
        support = np.zeros((len(langs), j - i))
        for w in range(len(masks)):
            got = masks[w][index[0]]
            for s in index[1:]:
                got = got & masks[w][s]
            for b in range(min(WORD, len(langs) - w * WORD)):
                hits = np.concatenate([[0], np.cumsum((got >> b) & 1)])
                share, miss = (hits[at[1:]] - hits[at[:-1]]) / n, fp[w * WORD + b]
                support[w * WORD + b] = np.maximum(0, (share - miss) / (1 - miss))
        best, total = support.argmax(0), support.sum(0)
        top = support[best, np.arange(j - i)]
        names += [langs[b] if h else "und" for b, h in zip(best, has, strict=True)]
        scores.append(np.where(has, np.minimum(top / np.where(total > 0, total, 1), 1.0), 0.0))
        supports.append(np.where(has, np.minimum(top, 1.0), 0.0))
    return names, np.concatenate(scores), np.concatenate(supports)


def _predict(model):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            names, scores, supports = label(batch.column("text"), model.value)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(names, pa.string()), pa.array(scores), pa.array(supports)],
                ["doc_id", "lang_pred", "score", "support"])
    return run


def _accepted(docs: DataFrame, model: LanguageFilter):
    """Whether a text's language is found, as a column: only the text goes through Python."""
    shared = _shared(docs, model)

    def run(texts):
        import pyarrow as pa

        names, _, supports = label(texts, shared.value)
        return pa.array((np.array(names, object) != "und") & (supports >= MIN_SUPPORT), pa.bool_())

    return F.arrow_udf(run, "boolean", F.ArrowUDFType.SCALAR)(F.col("text"))


def _shared(docs: DataFrame, model: LanguageFilter):
    return docs.sparkSession.sparkContext.broadcast((model.langs, model.masks, model.fp))


def identify(docs: DataFrame, model: LanguageFilter) -> DataFrame:
    """doc_id, lang_pred, score, support for every row of (doc_id, text)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        _predict(_shared(docs, model)), f"doc_id {kind}, lang_pred string, score double, support double")


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def identify_documents(docs: DataFrame) -> DataFrame:
    """Learn from the rows that aren't held out, then label all of them."""
    model = fit(docs.where(~held_out(F.col("doc_id"))))
    return identify(docs, model)


def keep_identified(docs: DataFrame) -> DataFrame:
    """Rows of `docs` whose language is found: not `und`, and support of at least MIN_SUPPORT.

    A filter in place: every column passes through, repeated rows stay repeated.
    """
    model = fit(docs.where(~held_out(F.col("doc_id"))))
    return docs.where(_accepted(docs, model))
