"""Language ID, line dedup, near-dedup and licence scan."""

from __future__ import annotations

import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from ledgerline.llm import langid, license_scan, line_dedup, near_dedup, queries
from tests.llm.helpers import (CLASHING, SMALL, documents, exact_languages, near_components, near_copies,
                               small_documents)

ENGLISH = "the house and the garden are where they were"
FRENCH = "où est la très belle maison près du château où nous étions"


def test_language_is_found_on_held_out_rows(spark):
    got = queries.op8_language(spark, SMALL).join(small_documents(spark).select("doc_id", "lang"), "doc_id")
    out = got.where("held_out and lang is not null").select((F.col("lang") == F.col("lang_pred")).alias("ok")).collect()
    assert len(out) > 20 and sum(r.ok for r in out) / len(out) >= 0.97
    assert got.where("score < 0 or score > 1").isEmpty()


def test_language_equals_exact_trigram_sets(spark):
    rows = [(r.doc_id, r.text, r.lang) for r in small_documents(spark).collect()]
    want = exact_languages(rows, lambda i: zlib.crc32(str(i).encode()) % 4 != 2)
    got = {r.doc_id: r for r in queries.op8_language(spark, SMALL).collect()}
    assert len(got) == len(rows)
    for (i, _, _), (label, support) in zip(rows, want, strict=True):
        if label != "und":
            assert got[i].support == pytest.approx(support[got[i].lang_pred], abs=0.02)  # the filters' false positives
            assert support[got[i].lang_pred] >= support[label] - 0.02
            assert 0 < got[i].score <= 1
        else:
            assert got[i].lang_pred == "und" and got[i].score == 0


def test_language_edge_cases(spark):
    rows = [(1, ENGLISH, "en", "a"), (2, FRENCH, "fr", "a"), (3, None, "en", None), (4, "", None, "a"),
            (5, "123 !!", "fr", "a"), (6, ENGLISH * 400, None, "a"), (1, ENGLISH, "en", "a"), (None, FRENCH, "fr", "b")]
    docs = documents(spark, rows, CLASHING)
    got = [(r.doc_id, r.lang_pred) for r in langid.identify_documents(docs).collect()]
    assert sorted(got, key=str) == sorted([(1, "en"), (1, "en"), (2, "fr"), (3, "und"), (4, "und"), (5, "und"),
                                           (6, "en"), (None, "fr")], key=str)
    kept = langid.keep_identified(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 1, 2, 6]


def test_language_without_training_rows(spark):
    docs = documents(spark, [(1, ENGLISH, None, "a")])
    assert [(r.lang_pred, r.score) for r in langid.identify_documents(docs).collect()] == [("und", 0.0)]
    assert langid.identify_documents(docs.limit(0)).count() == 0


def test_line_dedup_equals_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{SMALL}/documents.parquet')")
    want = {r[0]: r[1:] for r in con.execute(
        f"select doc_id, n_lines, n_removed, text from ({line_dedup.ORACLE})").fetchall()}
    got = {r.doc_id: (r.n_lines, r.n_removed, r.text) for r in queries.op3_line_dedup(spark, SMALL).collect()}
    assert got == want


def test_line_dedup_edge_cases(spark):
    rows = [(i, f"own words {i}\nbuy now \n\nmore words {i}", "en", f"s{i % 12}") for i in range(40)]
    rows += [(100 + i, "copied first\ncopied second\ncopied third", "en", f"s{i % 12}") for i in range(40)]
    rows += [(200, None, "en", "s0"), (201, "", "en", None), (202, "buy now", None, None), (202, "buy now", None, None),
             (None, "buy now\nx", "en", "s1")]
    docs = documents(spark, rows, CLASHING)
    out = line_dedup.dedup_lines_stage(docs)
    assert out.columns == docs.columns and out.count() == len(rows)
    text = {}
    for r in out.collect():
        text.setdefault(r.doc_id, []).append((r.text, r.n_chars))
    assert text[3] == [("own words 3\n\nmore words 3", 25)]  # seen on 12 sites, in other surroundings
    assert text[105] == [("copied first\ncopied second\ncopied third", 39)]  # a copied text, not boilerplate
    assert text[200] == [(None, None)] and text[201] == [("", 0)]
    assert text[202] == [("", 0), ("", 0)] and text[None] == [("x", 1)]
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0


def test_near_threshold_lines_are_counted_exactly(spark):
    rows = [(100 * k + i, f"line with {k} sites\nother {k} {i}", "en", f"s{i}") for k in (8, 9, 10, 11, 12) for i in range(k)]
    out = line_dedup.dedup_lines(documents(spark, rows))
    removed = {r.doc_id // 100 for r in out.where("__n_removed > 0").collect()}
    assert removed == {10, 11, 12}


def test_fixed_blocks_and_copies_do_not_save_a_line_of_the_stage(spark):
    menu = "Home\nProducts\nContact"
    rows = [(i, f"{menu}\nown words {i}\n\nAll rights\n\nmore words {i}", "en", f"s{i % 12}") for i in range(40)]
    rows += [(100 + i, f"one text\nAll rights\n{menu}", "en", f"s{i % 12}") for i in range(60)]  # copies
    rows += [(200 + i, f"copied {i // 40}\nof few texts", "en", f"s{i % 12}") for i in range(80)]
    text = {r.doc_id: r.text for r in line_dedup.dedup_lines_stage(documents(spark, rows)).collect()}
    assert text[7] == "own words 7\n\n\nmore words 7"
    assert text[130] == "one text" and text[250] == "copied 1\nof few texts"


def test_a_line_on_ten_sites_goes_from_the_query_in_few_texts_too(spark, tmp_path):
    rows = [(i, f"of two texts\ncopied {i % 2}\nown {i}" if i < 3 else f"of two texts\ncopied {i % 2}", "en", f"s{i}")
            for i in range(12)]
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_lines, r.n_removed, r.text) for r in queries.op3_line_dedup(spark, str(tmp_path)).collect()}
    assert got[0] == (3, 1, "copied 0\nown 0") and got[7] == (2, 1, "copied 1")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert got == {r[0]: r[1:] for r in con.execute(
        f"select doc_id, n_lines, n_removed, text from ({line_dedup.ORACLE})").fetchall()}


def test_near_dedup_equals_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in small_documents(spark).select("doc_id", "text").collect()]
    rows += [(10_000 + i, t) for i, t in enumerate(near_copies())]
    rows.sort()
    want, sets = near_components([t for _, t in rows])
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: r for r in near_dedup.near_dedup(docs).collect()}
    assert len(got) == len(rows)
    for k, (i, _) in enumerate(rows):
        assert got[i].n_shingles == len(sets[k])
        assert got[i].component_id == rows[want[k]][0], i
        assert got[i].kept == (rows[want[k]][0] == i)


def test_links_apart_from_every_head_are_found(spark, monkeypatch):
    """One band makes one bucket of many texts, so links must come from both rounds."""
    monkeypatch.setattr(near_dedup, "ROWS", 1)
    texts = near_copies(seed=9, groups=4, size=25)
    want, _ = near_components(texts)
    got = {r.doc_id: r.component_id for r in near_dedup.near_dedup(
        spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[i] for i in range(len(texts))] == want


def test_near_dedup_edge_cases(spark):
    rows = [(1, "one", None, None), (2, "ONE\t", None, None), (3, "", None, None), (4, None, None, None),
            (5, "  \n ", None, None), (6, "a b", None, None), (7, "A B", None, None), (7, "A B", None, None),
            (None, "a b", None, None), (8, "x y " * 40_000, None, None), (9, "x y " * 40_001, None, None)]
    docs = documents(spark, rows, CLASHING)
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in near_dedup.near_dedup(docs).collect())
    assert got == sorted([("1", 1, "1", True), ("2", 1, "1", False), ("3", 0, "3", True), ("4", 0, "4", True),
                          ("5", 0, "5", True), ("6", 1, "6", True), ("7", 1, "6", False), ("7", 1, "6", False),
                          ("None", 1, "None", True), ("8", 2, "8", True), ("9", 2, "8", False)])
    kept = near_dedup.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "3", "4", "5", "6", "8", "None"]
    assert near_dedup.near_dedup(docs.limit(0)).count() == 0


def test_each_text_of_a_repeated_doc_id_is_judged_alone(spark):
    rows = [(1, "a b c d e", None, None), (7, "a b c d e", None, None), (7, "quite another text", None, None),
            (8, "A B C D E", None, None), (8, None, None, None), (8, "", None, None)]
    kept = near_dedup.keep_one_of_each(documents(spark, rows, CLASHING))
    assert sorted((r.doc_id, str(r.text)) for r in kept.collect()) == [
        (1, "a b c d e"), (7, "quite another text"), (8, ""), (8, "None")]


def test_odd_bound_lets_the_similarity_pass():
    import numpy as np
    rng = np.random.default_rng(1)
    for _ in range(30):
        common = rng.integers(0, 1 << 62, 800, dtype=np.uint64)
        a, b = (np.concatenate([common, rng.integers(0, 1 << 62, 100, dtype=np.uint64)]) for _ in range(2))
        for count, bits in ((near_dedup.BANDS * near_dedup.ROWS, near_dedup.BITS), (near_dedup.FINE, near_dedup.FINE_BITS)):
            x, y = near_dedup.odd_sketches(near_dedup.samples([a, b], count), bits)
            assert np.bitwise_count((x ^ y).view(np.uint64)).sum() <= near_dedup.odd_bound(count, bits, 0.8)


def base_places(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places = [(k, label) for label, phrase, _ in license_scan.BASE for k in range(len(words))
              if words[k:k + len(phrase.split())] == phrase.split()]
    starts = [k for k, _ in places]
    return (len(words), len(places), min(starts, default=None), max(starts, default=None),
            ",".join(sorted({label for _, label in places})))


def check_licences(docs, rows):
    got = {}
    for r in license_scan.license_labels(docs).collect():
        got.setdefault(r.doc_id, []).append(r)
        assert 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
    for i, text in rows:
        for r in got[i]:
            assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base_places(text), i
    return got


def test_licences_equal_brute_force(spark):
    docs = small_documents(spark)
    check_licences(docs, [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


def test_licence_edge_cases(spark):
    rows = [(1, "Released UNDER the MIT-license; under the mit license!"), (2, None), (3, ""), (4, "K under  THE mité license"),
            (5, "apache license, version 2.0 " * 3000), (6, "CC-BY-NC cc_by_nc cc by ncx"), (7, "under the mit"),
            (8, "GNU General Public License, version 3"), (8, "GNU General Public License, version 3"), (None, "cc by nc")]
    docs = documents(spark, [(i, t, None, None) for i, t in rows], CLASHING)
    got = check_licences(docs, rows)
    assert len(got[8]) == 2 and got[8][0].labels == "gpl-3" and got[8][0].n_base == 0
    assert got[1][0].n_base == 2 and got[5][0].n_base == 3000
    assert license_scan.license_labels(docs.limit(0)).count() == 0
    nothing = documents(spark, [(1, "no such words", None, None)])
    assert [(r.labels, r.score) for r in license_scan.license_labels(nothing).collect()] == [("", 0.0)]


@pytest.mark.parametrize("text", ["", " ", "a", "É è", "x" * 3000])
def test_shingles_of_arrow_columns(text):
    import pyarrow as pa
    from tests.llm.helpers import shingles
    got = {row: len(s) for row, s in near_dedup.shingle_sets(pa.array([text, None, text]), 2)}
    assert got == {0: len(shingles(text)), 1: 0, 2: len(shingles(text))}


def test_repeated_rows_make_no_links_of_their_own(spark):
    texts = near_copies(groups=2, size=6)
    rows = [(i, t, "en", "a") for i, t in enumerate(texts)]

    def run(rows):
        one = near_dedup.NearDedup(documents(spark, rows))
        out = {(r.doc_id, r.component_id) for r in one.run().collect()}
        return out, spark.read.parquet(one.stages.path("links")).count()

    once, links = run(rows)
    many, more = run(rows * 50)
    assert many == once and more == links > 0


def test_a_doc_id_with_several_texts_keeps_its_texts_apart(spark):
    base = " ".join(f"w{i}" for i in range(200))
    rows = [(1, base, "en", "a"), (2, base + " end", "en", "a"), (2, "something else entirely here", "en", "a"),
            (2, base + " end", "en", "a")]
    kept = near_dedup.keep_one_of_each(documents(spark, rows))
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == [(1, base), (2, "something else entirely here")]
