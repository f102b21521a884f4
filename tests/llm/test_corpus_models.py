"""Importance resampling, Kneser-Ney scoring and the conversation trie against brute force and their SQL."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest

from ledgerline.llm import kneser_ney, prefix_trie, queries, resample
from tests.llm.helpers import CLASHING, SMALL, documents, small_documents

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows):
    """Rows as sorted tuples of whole numbers, doubles, strings and None."""
    def value(x):
        return None if x is None or x != x else x if isinstance(x, str) else int(x)
    return sorted((tuple(value(x) for x in r) for r in rows), key=str)


def from_sql(sql, columns, **tables):
    con = duckdb.connect()
    for name, frame in tables.items():
        if isinstance(frame, str):
            con.execute(f"create view {name} as select * from read_parquet('{frame}')")
        else:
            con.register(name, frame)
    return plain(con.execute(f"select {', '.join(columns)} from ({sql})").fetchall())


# ---- op11 -----------------------------------------------------------------------------------------

def brute_resample(rows, target, percent=25, min_words=20, buckets=10_000):
    def words(text):
        return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER)) if w]

    def features(text):
        w = words(text)
        return [zlib.crc32(f.encode()) % buckets for f in w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]]

    raw, aim = Counter(), Counter()
    for _, t in rows:
        raw.update(features(t))
    for t in target:
        aim.update(features(t))
    s, t = sum(raw.values()), sum(aim.values())
    out, fit = [], []
    for k, (i, text) in enumerate(rows):
        f = features(text)
        gain = [math.floor(1000 * math.log(((aim[b] + 1.0) * (s + buckets)) / ((raw[b] + 1.0) * (t + buckets)))) for b in f]
        weight = sum(gain) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(f), weight, score, None])
        if len(words(text)) >= min_words:
            fit.append((-score, math.inf if i is None else i, weight, k))
    for rank, (*_, k) in enumerate(sorted(fit)[:percent * len(fit) // 100], 1):
        out[k][4] = rank
    return plain(out)


COLUMNS11 = ["doc_id", "n_features", "weight", "score", "rank"]


def test_resampling_equals_its_sql_and_brute_force(spark):
    got = plain(queries.op11_resample(spark, SMALL).select(*COLUMNS11).collect())
    assert got == from_sql(resample.ORACLE, COLUMNS11, documents=f"{SMALL}/documents.parquet",
                           benchmark=f"{SMALL}/benchmark.parquet")
    target = [r.text for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    assert got == brute_resample([(r.doc_id, r.text) for r in small_documents(spark).collect()], target)


def test_resampling_edge_cases(spark):
    long = " ".join(f"w{i % 97}é" for i in range(30_000))
    rows = [(i, f"Words and {i} more " + "common target text here " * (i % 7) + "pad " * 20, "en", "a") for i in range(60)]
    rows += [(70, None, None, None), (71, "", "en", "a"), (72, "...!", "en", "a"), (73, long, "en", "a"), (74, "ÀÉ x", "fr", "b"),
             (None, "null id " * 20, "en", "a"), (5, "another text of id five " * 9, "en", "a")]
    rows += [(80, "repeated row of many words " * 5, "en", "a")] * 40
    docs = documents(spark, rows, CLASHING + ("weight", "rank", "__row", "whole"))
    target = spark.createDataFrame([("common target text here",), (None,), ("",)], "text string")
    out = resample.resample(docs, target)
    assert out.columns == COLUMNS11
    assert plain(out.collect()) == brute_resample([r[:2] for r in rows], [r.text for r in target.collect()])
    assert resample.resample(docs.limit(0), target).count() == 0
    none = resample.resample(docs, target.limit(0))
    assert plain(none.collect()) == brute_resample([r[:2] for r in rows], [])


def test_short_documents_are_never_drawn(spark):
    docs = documents(spark, [(i, "few words only", "en", "a") for i in range(50)])
    out = resample.resample(docs, spark.createDataFrame([("few words only",)], "text string"))
    assert out.where("rank is not null").isEmpty() and out.count() == 50


# ---- op12 -----------------------------------------------------------------------------------------

class BruteKneserNey:
    def __init__(self, texts):
        self.c1, self.c2 = Counter(), Counter()
        for t in texts:
            w = self.tokens(t)
            self.c1.update(w)
            self.c2.update(zip(["<s>"] + w[:-1], w, strict=True))
        self.n, self.v = sum(self.c1.values()), len(self.c1)
        self.a = Counter(w for _, w in self.c2)
        self.d1, self.d2 = self.cut(self.a), self.cut(self.c2)
        self.all = sum(self.a.values())
        free = sum(self.d1[min(x, 3)] for x in self.a.values())
        self.unknown = free / self.all / (self.v + 1) if self.all else 1.0
        self.total, self.left = Counter(), defaultdict(float)
        for (v, _), x in self.c2.items():
            self.total[v] += x
            self.left[v] += self.d2[min(x, 3)]

    @staticmethod
    def tokens(text):
        return [w for w in re.split("[\x20\x09-\x0D]+", (text or "").translate(LOWER)) if w] + ["</s>"]

    @staticmethod
    def cut(counts):
        n = [sum(1 for x in counts.values() if x == k) for k in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
        d = [k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] else k / 2 for k in (1, 2, 3)]
        return [0] + [x if 0 < x <= k else k / 2 for k, x in enumerate(d, 1)]

    def p(self, v, w):
        q = (self.a[w] - self.d1[min(self.a[w], 3)]) / self.all + self.unknown if w in self.a else self.unknown
        if v not in self.total:
            return q
        x = self.c2[v, w]
        return (x - self.d2[min(x, 3)]) / self.total[v] + self.left[v] / self.total[v] * q

    def row(self, i, text, out):
        w = self.tokens(text)
        return (i, out, len(w), sum(self.c1[x] > 0 for x in w), self.n,
                sum(math.log10((self.c1[x] + 1) / (self.n + self.v + 1)) for x in w),
                sum(math.log10(self.p(v, x)) for v, x in zip(["<s>"] + w[:-1], w, strict=True)))


def out_of_training(i):
    return i is not None and zlib.crc32(str(i).encode()) % 7 == 2


def check_scores(rows, got):
    model = BruteKneserNey([t for i, t in rows if not out_of_training(i)])
    def order(r):
        return str(r[:4]), r[6]

    want = sorted((model.row(i, t, out_of_training(i)) for i, t in rows), key=order)
    have = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got), key=order)
    assert [r[:5] for r in have] == [r[:5] for r in want]
    for h, w in zip(have, want, strict=True):
        assert h[5:] == pytest.approx(w[5:], rel=1e-9, abs=1e-9)


def test_scores_equal_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in small_documents(spark).collect()]
    got = queries.op12_perplexity(spark, SMALL).collect()
    check_scores(rows, got)
    assert all(r.perplexity == pytest.approx(10 ** (-r.score / r.n_tokens)) for r in got)
    held = [r for r in got if r.held_out]  # the model tells the corpus' words better than plain counts do
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_scores_with_many_shards_small_spans_and_large_counts(spark, monkeypatch):
    for name, value in (("SHARD_BYTES", 1 << 14), ("SPAN", 1 << 15), ("MOST", 30), ("HELD", 2000)):
        monkeypatch.setattr(kneser_ney, name, value)
    rows = [(r.doc_id, r.text) for r in small_documents(spark).collect()]
    check_scores(rows, kneser_ney.score_documents(small_documents(spark)).collect())


def test_scoring_edge_cases(spark):
    long = " ".join(f"w{i * i % 311}" for i in range(60_000))
    rows = [(1, "a b a b", "en", "a"), (2, None, None, None), (3, "", "en", "a"), (4, " \t\n", "en", "a"), (5, "A  B\x0bc", "en", "a"),
            (6, long, "en", "a"), (7, "é É à", "fr", "b"), (None, "a b", "en", "a")] + [(8, "the same row", "en", "a")] * 30
    docs = documents(spark, rows, CLASHING + ("shard", "chunk", "kind"))
    check_scores([r[:2] for r in rows], kneser_ney.score_documents(docs).collect())
    assert kneser_ney.score_documents(docs.limit(0)).count() == 0
    out = [i for i in range(100) if out_of_training(i)][:3]
    alone = kneser_ney.score_documents(documents(spark, [(i, "never learnt", "en", "a") for i in out])).collect()
    assert [(r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in alone] == [(True, 3, 0, 0, 0, 0)] * 3


def test_probabilities_of_a_context_sum_to_one(spark, tmp_path):
    texts = [r.text for r in small_documents(spark).collect()]
    model = kneser_ney.fit(small_documents(spark))
    brute = BruteKneserNey(texts)
    import numpy as np
    for v in list(brute.c1)[:3]:
        h = kneser_ney.span_hashes(np.frombuffer(v.encode(), np.uint8), np.array([0]), np.array([len(v.encode())])).view(np.int64)
        at = model.words.find(h)
        w = np.arange(len(model.words))
        vs = np.full(len(w), at[0])
        keys = kneser_ney._key(vs, w)
        of, n = kneser_ney._shard(keys, model.shards), np.zeros(len(w), np.int64)
        for s in np.unique(of):
            n[of == s] = model.pair_counts(int(s), keys[of == s].view(np.int64))
        total = (10 ** model.logp(vs, w, n)).sum() + 10 ** model.logp(at, np.array([-1]), np.array([0]))[0]
        assert total == pytest.approx(1.0, abs=1e-9)


# ---- op13 -----------------------------------------------------------------------------------------

COLUMNS13 = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute_trie(convs):
    """`convs`: conv_id -> list of (role, text) in order."""
    full = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        full[c] = convs.get(c - int(math.fmod(c, 5)), [])[:h] + own[h:]
    nodes = defaultdict(list)
    for c, turns in full.items():
        for d in range(len(turns) + 1):
            nodes[tuple(turns[:d])].append(c)
    kids = Counter(n[:-1] for n in nodes if n)
    leaves, saved = Counter(), Counter()
    for n, members in nodes.items():
        for d in range(len(n) + 1):
            leaves[n[:d]] += not kids[n]
            saved[n[:d]] += (len(members) - 1) * len(n[-1][1].encode()) if n else 0
    out = []
    for n, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(members) if len(full[c]) == len(n))
        out.append((min(members), len(n), min(nodes[n[:-1]]) if n else None, len(members), kids[n], leaves[n], saved[n],
                    hashlib.sha256(ends.encode()).hexdigest()))
    return plain(out)


def test_trie_equals_its_sql_and_brute_force(spark):
    got = plain(queries.op13_prefix_trie(spark, SMALL).select(*COLUMNS13).collect())
    assert got == from_sql(prefix_trie.ORACLE, COLUMNS13, conversations=f"{SMALL}/conversations.parquet")
    convs = defaultdict(list)
    for r in spark.read.parquet(f"{SMALL}/conversations.parquet").orderBy("conv_id", "turn").collect():
        convs[r.conv_id].append((r.role or "", r.text or ""))
    assert got == brute_trie(convs)


def conversation_rows():
    rows = [(c, t, "user" if t % 2 else "bot", f"turn {t} of {c % 3}") for c in range(60) for t in range(c % 8)]
    rows += [(100 + c, t, "user", "same start" if t == 0 else f"é {t % 2}") for c in range(40) for t in range(3)]
    rows += [(205, t, "user", f"long {t % 5}") for t in range(150)]  # a conversation over many shards
    rows += [(206, t, "user", f"long {t % 5}") for t in range(149)]
    rows += [(300, None, None, "first"), (300, 1, None, None), (300, 2, "user", None), (301, 0, "user", "x"), (302, 0, "", "y"),
             (10**15, 0, "user", "z"), (-7, 0, "user", "minus"), (-5, 0, "user", "leads")]
    return rows


@pytest.mark.parametrize("limit, depth", [(2048, 16), (7, 2), (3, 1)])
def test_trie_with_small_shards(spark, limit, depth):
    rows = conversation_rows()
    schema = "conv_id long, turn long, role string, text string"
    df = spark.createDataFrame(rows + [(None, 0, "user", "nobody's")], schema)
    for c in ("p", "idx", "b", "n", "len", "pos"):
        df = df.selectExpr("*", f"'x' as {c}")
    convs = defaultdict(list)
    for c, t, role, text in sorted(rows, key=lambda r: (r[0], -1 if r[1] is None else r[1])):
        convs[c].append((role or "", text or ""))
    out = prefix_trie.prefix_trie(df, limit, depth)
    assert out.columns == COLUMNS13 and plain(out.collect()) == brute_trie(convs)
    assert prefix_trie.prefix_trie(df.limit(0), limit, depth).count() == 0


def test_trie_with_repeated_rows_and_tied_turns(spark):
    # ids divisible by five lead themselves, so they are whole
    rows = [(10, 0, "user", "a")] * 5 + [(20, 0, "user", "a"), (20, 0, "user", "b")] + [(35, 3, "user", "tie"), (35, 3, "bot", "tie")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    one = plain(prefix_trie.prefix_trie(df).collect())
    assert one == plain(prefix_trie.prefix_trie(df.orderBy("text", "role").repartition(3)).collect())  # whatever the rows' order
    assert max(r[1] for r in one) == 5 and next(r for r in one if r[1] == 0)[3] == 3
