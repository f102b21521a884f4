"""License scan with a positional rare-token index, with DataFrame functions only.

Templates are short sentences of licences, each with a key phrase that must stand
verbatim.  Their words make up a small fixed vocabulary.

1. Every text's distinct licence words give document frequencies over the whole
   corpus, so IDF ranks the vocabulary.
2. Each template is indexed under the `RARE` highest-IDF words of its key phrase, as
   postings (word, template, position).
3. A text is looked up only if it holds all rare words of some template.  Positions of
   its rare words minus the postings' positions are candidate starts; a start stays if
   all rare words agree on it.
4. The words at the start are compared with the template: the key phrase must stand
   there word for word, and `MIN_SHARE` of the template's words at their places.

The base phrases are templates that are all key phrase, so all their places are found.
Only (row key, position) rows are shuffled, and words of texts that hold a candidate.

Defined results: null text counts as empty, with 0 words and no labels; labels are
distinct, sorted and comma-joined, '' for none; score is the best share of a
template's words (0 for none); a template may begin before the text does, if its
key phrase doesn't; repeated rows are scanned each; an empty table gives
no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import Stages

# Label, template sentence, key phrase.
BASE = [
    ("mit", "under the mit license", "under the mit license"),
    ("apache-2", "apache license version 2", "apache license version 2"),
    ("cc-by-nc", "cc by nc", "cc by nc"),
]
TEMPLATES = [
    ("agpl", "gnu affero general public license", "affero general public license"),
    ("apache-2", "licensed under the apache license version 2 0", "apache license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted",
     "redistribution and use in source and binary forms"),
    ("cc-by", "licensed under cc by 4 0", "cc by 4 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa 4 0"),
    ("cc0", "cc0 1 0 universal", "cc0 1 0"),
    ("gpl-2", "licensed under the gnu general public license version 2", "gnu general public license version 2"),
    ("gpl-3", "licensed under the gnu general public license version 3", "gnu general public license version 3"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose",
     "use copy modify and or distribute this software"),
    ("lgpl", "gnu lesser general public license", "lesser general public license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy",
     "permission is hereby granted free of charge"),
    ("mit", "released under the mit license", "the mit license"),
    ("mpl-2", "mozilla public license version 2 0", "mozilla public license version 2"),
    ("proprietary", "all rights reserved", "all rights reserved"),
    ("unlicense", "free and unencumbered software released into the public domain",
     "released into the public domain"),
]
RARE = 2
MIN_SHARE = 0.6

#: Everything but digits, letters of the Latin alphabet and what lies beyond ASCII.
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def templates() -> list:
    """(number, label, is base, words, key offset, key words)."""
    out = []
    for k, (label, text, key) in enumerate([*BASE, *TEMPLATES]):
        words, part = text.split(), key.split()
        at = next(i for i in range(len(words)) if words[i:i + len(part)] == part)
        out.append((k, label, k < len(BASE), words, at, part))
    return out


def _words(docs: DataFrame) -> DataFrame:
    """Row key, doc_id and lower-cased words of every row."""
    # the Kelvin sign alone would turn into an ASCII letter; another letter beyond ASCII stands in for it
    text = F.lower(F.replace(F.coalesce("text", F.lit("")), F.lit("K"), F.lit("ĸ")))
    return docs.select(F.xxhash64("doc_id", "text").alias("k1"), F.xxhash64(F.lit(1), "doc_id", "text").alias("k2"),
                       "doc_id", F.filter(F.split(text, GAP), lambda w: w != "").alias("words"))


def _text_array(words) -> F.Column:
    return F.array(*[F.lit(w) for w in words])


def scan(docs: DataFrame, found_templates: list | None = None) -> DataFrame:
    """Per row: doc_id, n_words, and `hits`, the verified places (label, base, start, share)."""
    spark, known = docs.sparkSession, found_templates or templates()
    stages = Stages(spark, "license-scan")
    vocabulary = sorted({w for t in known for w in t[3]})
    rows = stages.keep(_words(docs).select(
        "k1", "k2", "doc_id", F.size("words").cast("long").alias("n_words"),
        F.array_intersect("words", _text_array(vocabulary)).alias("known")), "rows")
    counts = rows.select(F.explode("known").alias("word")).groupBy("word").count()
    frequency = {r[0]: r[1] for r in counts.collect()}  # one row per word of the templates
    rare = {t[0]: sorted(set(t[5]), key=lambda w: (frequency.get(w, 0), w))[:RARE] for t in known}
    # a template with a rare word that no text holds has no place at all
    live = [t for t in known if all(frequency.get(w) for w in rare[t[0]])]
    hits = "array<struct<label: string, base: boolean, start: int, share: double>>"
    if not live:
        return rows.select("doc_id", "n_words", F.expr(f"cast(array() as {hits})").alias("hits"))
    holds = F.lit(False)
    for t in live:
        own = F.lit(True)
        for w in rare[t[0]]:
            own = own & F.array_contains("known", w)
        holds = holds | own
    few = rows.where(holds).select("k1", "k2").distinct()
    few = stages.keep(few, "few")
    anchors = sorted({w for t in live for w in rare[t[0]]})
    # the texts' own filter, so that only texts with a template's rare words are kept whole
    overlap = _words(docs).where(F.arrays_overlap("words", _text_array(anchors)))
    texts = stages.keep(overlap.drop("doc_id").join(few, ["k1", "k2"], "left_semi"), "texts")
    postings = spark.createDataFrame(
        [(w, t[0], t[4] + i) for t in live for i, w in enumerate(t[5]) if w in rare[t[0]]], "word string, t int, at int")
    places = texts.select("k1", "k2", F.posexplode("words").alias("pos", "word")).where(F.col("word").isin(anchors))
    starts = (places.join(F.broadcast(postings), "word").select("k1", "k2", "t", (F.col("pos") - F.col("at")).alias("start"), "at")
              .groupBy("k1", "k2", "t", "start").agg(F.countDistinct("at").alias("n")))
    needed = spark.createDataFrame(
        [(t[0], sum(w in rare[t[0]] for w in t[5]), t[1], t[2], t[3], t[4], t[5]) for t in live],
        "t int, needed int, label string, base boolean, full array<string>, key_at int, key array<string>")
    agreed = starts.join(F.broadcast(needed), "t").where("n = needed").groupBy("k1", "k2").agg(
        F.collect_list(F.struct("label", "base", "start", "full", "key_at", "key")).alias("at"))
    checked = texts.join(agreed, ["k1", "k2"]).select("k1", "k2", F.expr(f"""
        filter(transform(filter(at, c -> c.start + c.key_at >= 0
            and slice(words, greatest(1, c.start + c.key_at + 1), size(c.key)) = c.key), c -> named_struct(
            'label', c.label, 'base', c.base, 'start', c.start,
            'share', size(filter(c.full, (w, i) -> get(words, c.start + i) <=> w)) / size(c.full))),
            h -> h.share >= {MIN_SHARE})""").cast(hits).alias("hits"))
    # repeated rows have equal hits; only rows with hits are grouped
    checked = stages.keep(checked.where("size(hits) > 0").groupBy("k1", "k2", "hits").agg(
        F.count(F.lit(1)).alias("times")).drop("times"), "checked")
    return rows.join(checked, ["k1", "k2"], "left").select(
        "doc_id", "n_words", F.coalesce("hits", F.expr(f"cast(array() as {hits})")).alias("hits"))


def license_labels(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for every row."""
    joined = "array_join(array_sort(array_distinct(transform({}, h -> h.label))), ',')"
    return scan(docs).withColumn("base", F.expr("filter(hits, h -> h.base)")).select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"),
        F.expr("array_min(transform(base, h -> h.start))").cast("long").alias("first_word"),
        F.expr("array_max(transform(base, h -> h.start))").cast("long").alias("last_word"),
        F.expr(joined.format("base")).alias("base_labels"), F.expr(joined.format("hits")).alias("labels"),
        F.expr("coalesce(array_max(transform(hits, h -> h.share)), 0.0D)").alias("score"))
