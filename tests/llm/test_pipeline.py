"""The corpus pipeline against brute force, its guard, and tasks away from the repository."""

from __future__ import annotations

import os
import subprocess
import sys
import tempfile
import zlib

import numpy as np

import corpus_pipeline
from ledgerline.llm import langid, tokens
from tests.llm.helpers import (CLASHING, SMALL, documents, exact_languages, near_components, small_documents,
                               without_boilerplate)

REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def by_hand(rows):
    """The first three stages by their rules: rows of (doc_id, text, lang, source) -> {doc_id: text}."""
    def taught(i):
        return i is None or zlib.crc32(str(i).encode()) % 4 != 2

    found = exact_languages([r[:3] for r in rows], taught)
    kept = [r for r, (label, support) in zip(rows, found, strict=True)
            if label != "und" and support[label] >= langid.MIN_SUPPORT]
    texts = without_boilerplate([(i, t, s) for i, t, _, s in kept])
    kept = sorted(zip([r[0] for r in kept], texts, strict=True), key=lambda r: r[0])
    part, _ = near_components([t for _, t in kept], width=5)
    return {i: t for k, (i, t) in enumerate(kept) if part[k] == k}


def test_pipeline_equals_brute_force(spark):
    from tokenizers import Tokenizer
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in small_documents(spark).collect()]
    library = Tokenizer.from_file(tokens.vocabulary())
    want = {i: np.array(library.encode(t or "", add_special_tokens=False).ids + [2], np.uint32)
            for i, t in by_hand(rows).items()}
    got, seats = {}, {}
    for r in corpus_pipeline.run(spark, SMALL).collect():
        ids = want[r.doc_id][r.start:r.start + r.length]
        assert zlib.crc32(ids.tobytes()) == r.ids_crc32 and r.doc_tokens == len(want[r.doc_id])
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
        seats.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert got == {i: len(v) for i, v in want.items()}
    for own in seats.values():  # gapless, at most a window
        own.sort()
        assert [o for o, _ in own] == [0, *np.cumsum([n for _, n in own])[:-1]] and sum(n for _, n in own) <= 4096


def test_stages_with_nulls_repeats_ties_and_long_texts(spark):
    words = "the house and the garden are where they were and then some more of these"
    long = " ".join(f"{words} {i * 7919 % 10007}" for i in range(4000))
    rows = [(i, f"{words} number {i} of many in this shelf\nshared footer line", "en", f"s{i}") for i in range(12)]
    rows += [(50, None, "en", None), (51, "", None, "s1"), (52, "12345", "en", "s1"), (53, long, "en", "s1"), (54, long, "en", "s2")]
    rows += [(60, f"{words} said twice today by one of us all", "en", "s1")] * 3 + [(None, f"{words} nobody at all", "en", "s1")]
    docs = documents(spark, rows, CLASHING)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SMALL).checkpoint()
        assert len(docs.columns) == 5 + len(CLASHING), name
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.text) for r in docs.collect())
    ids = [i for i, _ in got]
    assert ids == [-1, *range(12), 53, 60, 60, 60]  # no text, no letter, one of two equal texts
    assert not any("shared footer" in t for _, t in got) and dict(got)[53] == long
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL)
    assert packed.where("doc_id = 53").agg({"length": "sum"}).first()[0] == packed.where("doc_id = 53").first().doc_tokens


def test_stages_keep_the_columns_and_run_on_an_empty_table(spark):
    docs = small_documents(spark).limit(0).withColumnRenamed("lang", "lang").selectExpr("*", "1 as n", "2 as key")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SMALL)
        assert out.columns == docs.columns and out.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).count() == 0


def test_entry_works_without_this_subpackage():
    script = f"""
import sys
sys.path.insert(0, {REPO!r})
class Block:
    def find_spec(self, name, path=None, target=None):
        if name == "corpus_pipeline" or name.startswith("ledgerline.llm"):
            raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, Block())
import __spark_entry__ as e
names = e.queries()
assert "pipeline" not in names and not any(n[2:3].isdigit() for n in names) and len(names) > 150
assert set(e.oracle_sql()) <= set(names)
"""
    r = subprocess.run([sys.executable, "-c", script], capture_output=True, text=True, timeout=300)
    assert r.returncode == 0, r.stderr[-2000:]


def test_tasks_run_without_the_repository_on_their_path():
    script = f"""
import sys
sys.path.insert(0, {REPO!r})
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false")
         .config("spark.sql.shuffle.partitions", "4").getOrCreate())
spark.sparkContext.setLogLevel("OFF")
import __spark_entry__ as e
q = e.queries()
print("ROWS", q["op8_language"](spark, {SMALL!r}).count(), q["op6_html_text"](spark, {SMALL!r}).count())
"""
    with tempfile.TemporaryDirectory() as d:
        env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
        r = subprocess.run([sys.executable, "-c", script], cwd=d, env=env, capture_output=True, text=True, timeout=600)
    assert "ROWS" in r.stdout, r.stderr[-2000:]
    assert all(int(n) > 0 for n in r.stdout.split("ROWS")[1].split()[:2])
