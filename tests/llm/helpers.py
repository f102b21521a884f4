"""Brute-force versions and small inputs for the operator tests."""

from __future__ import annotations

import random

SMALL = "/root/testdata/sf0.001"
DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows, extra=()):
    """documents rows from (doc_id, text, lang, source); clashing extra columns on demand."""
    df = spark.createDataFrame([(i, t, g, s, None if t is None else len(t)) for i, t, g, s in rows], DOC_SCHEMA)
    for c in extra:
        df = df.selectExpr("*", f"'x' as {c}")
    return df


#: Names that operators use for themselves.
CLASHING = ("n", "h1", "key", "rep", "part", "component", "length", "start", "lines", "words", "ids", "gone")


def small_documents(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


def shingles(text, width=2):
    words = [w.lower() for w in (text or "").encode().split()]
    if len(words) >= width:
        return frozenset(tuple(words[i:i + width]) for i in range(len(words) - width + 1))
    return frozenset([tuple(words)]) if words else frozenset()


def components(n, links):
    root = list(range(n))

    def find(a):
        while root[a] != a:
            root[a] = root[root[a]]
            a = root[a]
        return a

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(a) for a in range(n)]


def near_components(texts, width=2, percent=80):
    sets = [shingles(t, width) for t in texts]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j]
             and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    return components(len(sets), links), sets


def near_copies(seed=5, groups=6, size=14):
    """Texts in groups of near copies of different strength, and unrelated texts."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(900)]
    out = []
    for g in range(groups):
        base = [rng.choice(vocabulary) for _ in range(120)]
        for _ in range(size):
            words = list(base)
            for _ in range(rng.randrange(0, 4 + 3 * g)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            out.append(" ".join(words))
    return out + [" ".join(rng.choice(vocabulary) for _ in range(60)) for _ in range(20)]


def exact_languages(rows, learn):
    """Label and support of every text by exact trigram sets: `rows` of (doc_id, text, lang),
    `learn`: which of them teach."""
    from collections import Counter

    from ledgerline.llm import langid

    def grams(text):
        s = "\n" + (text or "").lower() + "\n"
        edge = [c if c.isalpha() else "\0" for c in s]
        return ["".join(edge[i - 1:i + 2]) for i in range(1, len(s) - 1) if edge[i] != "\0"]

    counts = {}
    for i, text, lang in rows:
        if lang is not None and learn(i):
            counts.setdefault(lang, Counter()).update(grams(text))
    share = {g: {t: n / (sum(c.values()) or 1) for t, n in c.items()} for g, c in counts.items()}
    top = {}
    for c in share.values():
        for t, p in c.items():
            top[t] = max(top.get(t, 0), p)
    known = {g: {t for t, p in c.items() if p >= langid.FLOOR and p >= langid.RATIO * top[t]} for g, c in share.items()}
    out = []
    for _, text, _ in rows:
        own = grams(text)
        support = {g: sum(t in known[g] for t in own) / len(own) if own else 0.0 for g in sorted(known)}
        best = max(sorted(support), key=lambda g: support[g]) if support else None
        out.append((best if own and best else "und", support))
    return out


def without_boilerplate(docs, sites=10):
    """Line dedup by hand: `docs` of (doc_id, text, source) -> the texts."""
    where, whole = {}, {}
    for _, text, source in docs:
        for line in (text or "").split("\n") if text is not None else []:
            if line.strip(" "):
                where.setdefault(line.strip(" "), set()).update({source} - {None})
                whole.setdefault(line.strip(" "), set()).add(text)
    gone = {x for x in where if len(where[x]) >= sites and len(whole[x]) >= sites}
    return [None if t is None else "\n".join(x for x in t.split("\n") if x.strip(" ") not in gone) for _, t, _ in docs]
