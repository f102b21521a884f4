"""Scoring with an interpolated modified Kneser-Ney bigram model kept in sorted hash arrays.

Counting runs in Spark.  Words are hashed to 64 bits; a word's ordinal is its place in
the sorted array of all hashes.  Pairs of ordinals, added up per `SPAN` of text first,
are dealt to hash shards and sorted there; every shard streams its sorted pairs, equal
ones added up, into arrays in the shared folder.  The same pass gives each word's
continuation count (distinct words before it) and its followers seen once, twice and
more often; they make its unigram probability and the weight it leaves to unigrams:

    p(w) = max(a(w) - D(a(w)), 0) / A + g / (V + 1)              a: distinct words before w
    p(w | v) = max(c(vw) - D(c(vw)), 0) / c(v) + g(v) p(w)

with three discounts a level from the counts of counts, and g, g(v) what the discounts
freed.  A word never seen in training has p = g / (V + 1); a context never seen leaves
everything to unigrams.  Every text starts after a begin mark and is closed by an end.

Scoring: workers map the arrays into memory.  The vocabulary's arrays are mapped by
every task, the far larger pair arrays by the tasks of their shard only: a task looks
the words of a `SPAN` of documents up, sends the distinct pairs of known words to
their shards, with the documents they stand in, as one compressed row for each shard,
and gets the sums per document back.  So no worker holds the model, one hot pair or
word is one entry of a row, and what is shuffled is a few bytes a token.

The order is 2: the distinct triples are 70 % of all tokens on the test tables, and
their arrays with contexts would take more room than the corpus itself.

Defined results: null or empty text is its end alone; rows with a null doc_id learn
and are scored; repeated rows count each; without training rows every score is 0;
a level whose counts of counts leave a discount outside (0, k] takes k / 2; texts are
read whole, however long; an empty table gives no rows; other columns are not read and
may have any name.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import (Stages, ascii_lower, mix64, process_cache, row_chunks, small_batches, span_hashes,
                                   text_bytes, word_spans)

#: Bytes of text whose pairs are added up at once.
SPAN = 3 << 20
#: Bytes of text for each shard of the pair arrays, and the most shards (a shard is streamed, so it may be large).
SHARD_BYTES, MAX_SHARDS = 1 << 24, 1 << 14
END = np.uint64(0x0E17)
#: Larger pair counts stand in a list of their own, with 0 in the array.
MOST = (1 << 16) - 1
#: Pairs whose words' counts are added up before they are shuffled.
HELD = 1 << 19


# ---- arrays in the shared folder ------------------------------------------------------------------

def _place(uri: str):
    """(pyarrow file system, path): a mounted folder, or any store that pyarrow opens."""
    from pyarrow import fs

    if uri.startswith("file:"):
        uri = "/" + uri[5:].lstrip("/")
    return (fs.LocalFileSystem(), uri) if uri.startswith("/") else fs.FileSystem.from_uri(uri)


class ArrayFile:
    """An array written piece by piece under a name of its own and moved to its place when whole."""

    def __init__(self, uri: str):
        self.fs, self.path = _place(uri)
        self.fs.create_dir(self.path.rsplit("/", 1)[0], recursive=True)
        self.draft = f"{self.path}.{uuid.uuid4().hex[:12]}"
        self.out = self.fs.open_output_stream(self.draft)

    def add(self, a: np.ndarray) -> None:
        self.out.write(np.ascontiguousarray(a).data)

    def close(self) -> None:
        self.out.close()
        self.fs.move(self.draft, self.path)


def mapped(uri: str, dtype) -> np.ndarray:
    """The array of a file: mapped into memory where the store is a folder, else read."""
    store = process_cache("kneser-ney").setdefault("maps", {})
    if uri not in store:
        fs, path = _place(uri)
        if len(store) > 512:
            store.clear()
        if not fs.get_file_info(path).size:
            store[uri] = np.zeros(0, dtype)
        elif fs.type_name == "local":
            store[uri] = np.memmap(path, dtype, "r")
        else:
            store[uri] = np.frombuffer(fs.open_input_file(path).readall(), dtype)
    return store[uri]


class Parts:
    """Arrays cut by range into the files of several partitions, read by global place."""

    def __init__(self, root: str, sizes: list):
        self.root, self.parts = root, [p for p, _ in sizes]
        self.first = np.cumsum([0] + [n for _, n in sizes])

    def __len__(self) -> int:
        return int(self.first[-1])

    def file(self, k: int, name: str, dtype) -> np.ndarray:
        return mapped(f"{self.root}/{self.parts[k]}.{name}", dtype)

    def take(self, name: str, dtype, at: np.ndarray) -> np.ndarray:
        out = np.zeros(len(at), dtype)
        part = np.searchsorted(self.first, at, "right") - 1
        for k in np.unique(part):
            own = part == k
            out[own] = self.file(k, name, dtype)[at[own] - self.first[k]]
        return out


class Words(Parts):
    """The sorted hash array of all words."""

    def __init__(self, root: str, sizes: list, lows: list):
        super().__init__(root, sizes)
        self.lows = np.array(lows, np.int64)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Ordinals of hashes, -1 for words that aren't there."""
        out = np.full(len(hashes), -1, np.int64)
        if not len(self):
            return out
        part = np.searchsorted(self.lows, hashes, "right") - 1
        for k in np.unique(part[part >= 0]):
            own = np.flatnonzero(part == k)
            held = self.file(k, "word", np.int64)
            at = np.minimum(np.searchsorted(held, hashes[own]), len(held) - 1)
            hit = held[at] == hashes[own]
            out[own[hit]] = at[hit] + self.first[k]
        return out


# ---- tokens ---------------------------------------------------------------------------------------

def _tokens(column):
    """Word hashes of all tokens of the rows with an end after each, and their rows."""
    buf, off = text_bytes(column)
    words, rows = [], []
    for i, j in row_chunks(off):
        part = ascii_lower(buf[off[i]:off[j]])
        starts, ends, row = word_spans(part, off[i:j + 1] - off[i])
        n = np.bincount(row, minlength=j - i) + 1
        own = np.full(len(starts) + j - i, END, np.uint64)
        own[np.arange(len(starts)) + row] = span_hashes(part, starts, ends)
        words.append(own)
        rows.append(np.repeat(np.arange(i, j), n))
    return np.concatenate(words).view(np.int64), np.concatenate(rows)


def _spans(batches):
    """(batch slice, words, rows) for runs of about SPAN bytes and fewer than 2**16 rows."""
    for batch in batches:
        _, off = text_bytes(batch.column("text"))
        for i, j in row_chunks(off, SPAN):
            for s in range(i, j, MOST):
                own = batch.slice(s, min(j, s + MOST) - s)
                yield own, *_tokens(own.column("text"))


def _ordinals(words: Words, hashes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ordinals of every token and of the token before it; the begin mark's is the vocabulary's size."""
    known, back = np.unique(hashes, return_inverse=True)
    w = words.find(known)[back]
    v = np.empty_like(w)
    v[1:] = w[:-1]
    v[np.concatenate([[True], rows[1:] != rows[:-1]])] = len(words) or -1
    return v, w


def _key(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """A pair's 64-bit key, one of its own while there are fewer than 2**32 words."""
    v, w = v.astype(np.uint64), w.astype(np.uint64)
    return ((v << np.uint64(32)) | (v >> np.uint64(32))) ^ w


def _shard(keys: np.ndarray, shards: int) -> np.ndarray:
    return (mix64(keys) % np.uint64(shards)).astype(np.int32)


def _count_words(batches):
    import pyarrow as pa

    for _, words, _ in _spans(batches):
        found, n = np.unique(words, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n)], ["word", "n"])


def _count_pairs(words, shards: int):
    def run(batches):
        import pyarrow as pa

        for _, hashes, rows in _spans(batches):
            v, w = _ordinals(words, hashes, rows)
            keys, first, n = np.unique(_key(v, w), return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(_shard(keys, shards)), pa.array(v[first]), pa.array(w[first]), pa.array(n)],
                ["shard", "v", "w", "n"])
    return run


# ---- the model's arrays ---------------------------------------------------------------------------

def _store_words(root: str):
    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part, n, total, low, files = TaskContext.get().partitionId(), 0, 0, None, None
        for batch in batches:
            if batch.num_rows:
                word, count = (batch.column(c).to_numpy() for c in ("word", "n"))
                if files is None:
                    low, files = int(word[0]), [ArrayFile(f"{root}/{part}.{c}") for c in ("word", "count")]
                files[0].add(word)
                files[1].add(count)
                n, total = n + len(word), total + int(count.sum())
        if files:
            for f in files:
                f.close()
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (part, n, total, low)],
                                             ["part", "n", "total", "low"])
    return run


def _store_pairs(root: str):
    """Streams one shard's (shard, v, w, n, key) rows in key order into files; yields sums per word.

    Equal keys are neighbours and are added up on the way.

    kind 0: a word's `a` words before it, `total` as a context, followers seen 1, 2, 3+ times.
    kind 1: how many pairs (`a`) are seen `word` times, up to 4.
    """
    def run(batches):
        import pyarrow as pa

        files, large, held, size, open_ = None, [], [], 0, None

        def sums():
            v, w, n = (np.concatenate(x) for x in zip(*held, strict=True))
            found, at = np.unique(np.concatenate([v, w]), return_inverse=True)
            ctx, tok = at[:len(v)], at[len(v):]
            k = len(found)
            cols = [np.bincount(tok, minlength=k), np.bincount(ctx, n, k).astype(np.int64),
                    *(np.bincount(ctx[m], minlength=k) for m in (n == 1, n == 2, n > 2))]
            often = np.bincount(np.minimum(n, 5), minlength=6)[1:5]
            cols = [np.concatenate([c, often if i == 0 else np.zeros(4, np.int64)]) for i, c in enumerate(cols)]
            kind = np.concatenate([np.zeros(k, np.int32), np.ones(4, np.int32)])
            return pa.RecordBatch.from_arrays(
                [pa.array(kind), pa.array(np.concatenate([found, np.arange(1, 5)])), *map(pa.array, cols)],
                ["kind", "word", "a", "total", "n1", "n2", "n3"])

        def store(key, v, w, n):
            files[0].add(key)
            files[1].add(np.where(n > MOST, 0, n).astype(np.uint16))
            big = n > MOST
            if big.any():
                large.append(np.stack([key[big], n[big]], 1))
            held.append((v, w, n))
            return len(v)

        for batch in batches:
            if not batch.num_rows:
                continue
            if files is None:
                shard = batch.column("shard")[0].as_py()
                files = [ArrayFile(f"{root}/{shard}.{c}") for c in ("key", "count", "large")]
            cols = [batch.column(c).to_numpy() for c in ("key", "v", "w", "n")]
            if open_:
                cols = [np.concatenate(x) for x in zip(open_, cols, strict=True)]
            first = np.flatnonzero(np.diff(cols[0], prepend=cols[0][0] - 1))
            total = np.add.reduceat(cols[3], first)
            whole = [*(c[first] for c in cols[:3]), total]
            open_ = [c[-1:] for c in whole]  # the last key may go on
            size += store(*(c[:-1] for c in whole))
            if size >= HELD:
                yield sums()
                held, size = [], 0
        if files:
            store(*open_)
            if large:
                files[2].add(np.concatenate(large))
            for f in files:
                f.close()
            yield sums()
    return run


def _store_weights(root: str):
    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part, n, files = TaskContext.get().partitionId(), 0, None
        for batch in batches:
            if batch.num_rows:
                files = files or {c: ArrayFile(f"{root}/{part}.{c}") for c in ("total", "p", "gamma")}
                for c, f in files.items():
                    f.add(batch.column(c).to_numpy())
                n += batch.num_rows
        if files:
            for f in files.values():
                f.close()
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([n], pa.int64())], ["part", "n"])
    return run


def discounts(counts: list) -> list:
    """D1, D2, D3 from the numbers of n-grams seen 1, 2, 3 and 4 times."""
    n1, n2 = counts[:2]
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    out = []
    for k in (1, 2, 3):
        d = k - (k + 1) * y * counts[k] / counts[k - 1] if counts[k - 1] else k / 2
        out.append(d if 0 < d <= k else k / 2)
    return out


class Model:
    """Where the arrays are and the few numbers they need; small whatever the corpus."""

    def __init__(self, root, words, weights, shards, tokens, low, high, unknown):
        self.root, self.words, self.weights, self.shards, self.tokens = root, words, weights, shards, tokens
        self.low, self.high, self.unknown = low, high, unknown

    def pair_counts(self, shard: int, keys: np.ndarray) -> np.ndarray:
        """Training counts of keys, all of one shard."""
        at = f"{self.root}/pairs/{shard}"
        if not _place(at + ".key")[0].get_file_info(_place(at + ".key")[1]).is_file:
            return np.zeros(len(keys), np.int64)
        held, counts = mapped(at + ".key", np.int64), mapped(at + ".count", np.uint16)
        order = np.argsort(keys)  # neighbours in the array are read together
        place = np.minimum(np.searchsorted(held, keys[order]), len(held) - 1)
        n = np.where(held[place] == keys[order], counts[place].astype(np.int64), -1)
        if (n == 0).any():
            large = mapped(at + ".large", np.int64).reshape(-1, 2)
            n[n == 0] = large[np.searchsorted(large[:, 0], keys[order][n == 0]), 1]
        out = np.empty(len(keys), np.int64)
        out[order] = np.maximum(n, 0)
        return out

    def logp(self, v: np.ndarray, w: np.ndarray, n: np.ndarray) -> np.ndarray:
        """log10 p(w | v) of ordinals with pair counts n; -1 is an unknown word."""
        p = np.full(len(w), self.unknown)
        p[w >= 0] = self.weights.take("p", np.float64, w[w >= 0])
        seen = v >= 0
        gamma, alpha = np.ones(len(v)), np.zeros(len(v))
        gamma[seen] = self.weights.take("gamma", np.float64, v[seen])
        some = np.flatnonzero(n > 0)
        cut = np.array([0.0, *self.high])[np.minimum(n[some], 3)]
        alpha[some] = (n[some] - cut) / self.weights.take("total", np.int64, v[some])
        return np.log10(alpha + gamma * p)


def fit(docs: DataFrame, stages: Stages | None = None) -> Model:
    """Learn from every row of (text)."""
    spark = docs.sparkSession
    stages = stages or Stages(spark, "kneser-ney")
    docs = docs.select("text")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = min(MAX_SHARDS, max(1, math.ceil(size / SHARD_BYTES)))
    counts = docs.mapInArrow(_count_words, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    root = stages.path("words")
    kept = counts.repartitionByRange("word").sortWithinPartitions("word").mapInArrow(
        _store_words(root), "part long, n long, total long, low long")
    with small_batches(spark):
        kept = sorted(tuple(r) for r in kept.collect())  # one row per partition
    words = Words(root, [r[:2] for r in kept], [r[3] for r in kept])
    tokens, v_size = sum(r[2] for r in kept), len(words)
    pairs = docs.mapInArrow(_count_pairs(words, shards),
                            "shard int, v long, w long, n long")
    # each pair moves once, to its shard's partition, and is added up from the sorted stream
    pairs = (pairs.repartitionById(shards, "shard")
             .withColumn("key", F.expr("(shiftleft(v, 32) | shiftrightunsigned(v, 32)) ^ w")).sortWithinPartitions("key"))
    sums = stages.keep(pairs.mapInArrow(
        _store_pairs(stages.path("pairs")), "kind int, word long, a long, total long, n1 long, n2 long, n3 long"), "sums")
    stats = stages.keep(sums.groupBy("kind", "word").agg(*[F.sum(c).alias(c) for c in ("a", "total", "n1", "n2", "n3")]),
                        "stats")
    stages.drop("sums")
    often = {r.word: r.a for r in stats.where("kind = 1").collect()}
    own = stats.where("kind = 0")
    level = own.agg(*[F.sum(F.when(F.col("a") == k, 1).otherwise(0)) for k in (1, 2, 3, 4)],
                    F.sum("a"), F.sum(F.when(F.col("a") > 2, 1).otherwise(0))).first()
    low, high = discounts([x or 0 for x in level[:4]]), discounts([often.get(k, 0) for k in (1, 2, 3, 4)])
    all_a = level[4] or 1
    unknown = (low[0] * (level[0] or 0) + low[1] * (level[1] or 0) + low[2] * (level[5] or 0)) / all_a / (v_size + 1)
    if not v_size:
        unknown = 1.0
    cut = F.when(F.col("a") == 1, low[0]).when(F.col("a") == 2, low[1]).when(F.col("a") > 2, low[2]).otherwise(0.0)
    gamma = (high[0] * F.col("n1") + high[1] * F.col("n2") + high[2] * F.col("n3")) / F.col("total")
    weights = own.select("word", "total", ((F.col("a") - cut) / all_a + unknown).alias("p"),
                         F.when(F.col("total") > 0, gamma).otherwise(1.0).alias("gamma"))
    root = stages.path("weights")
    kept = sorted(tuple(r) for r in weights.repartitionByRange("word").sortWithinPartitions("word").mapInArrow(
        _store_weights(root), "part long, n long").collect())
    stages.drop("stats")
    return Model(stages.root, words, Parts(root, kept), shards, tokens, low, high, unknown)


# ---- scoring --------------------------------------------------------------------------------------

def _planes(a: np.ndarray) -> bytes:
    """An array's bytes by significance, which compress better than values one after another."""
    return a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes()


def _unplanes(raw: memoryview, dtype, n: int) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * size).reshape(size, n).T).view(dtype).ravel()


def _asked(model):
    """Rows (shard, chunk, kind, size, data): the pairs of a span for each shard (0), and its documents (1)."""
    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        m, seq = model, TaskContext.get().partitionId() << 32
        zstd = pa.Codec("zstd", compression_level=1)
        for batch, hashes, rows in _spans(batches):
            n_docs = batch.num_rows
            v, w = _ordinals(m.words, hashes, rows)
            count = np.zeros(len(w), np.int64)
            count[w >= 0] = m.words.take("count", np.int64, w[w >= 0])
            base = np.log10((count + 1) / (m.tokens + len(m.words) + 1))
            here = (v < 0) | (w < 0)  # such a pair was never seen
            local = np.bincount(rows[here], m.logp(v[here], w[here], np.zeros(here.sum(), np.int64)), n_docs).astype(float)
            shard, kind, sizes, data = [], [], [], []
            far = np.flatnonzero(~here)
            if len(far):
                keys, first, back, n = np.unique(_key(v[far], w[far]), return_index=True, return_inverse=True,
                                                 return_counts=True)
                of = _shard(keys, m.shards)
                order = np.argsort(of, kind="stable")
                turn = np.empty_like(order)
                turn[order] = np.arange(len(order))
                docs = rows[far][np.argsort(turn[back], kind="stable")].astype(np.uint16)
                pv, pw, n = v[far][first][order], w[far][first][order], n[order]
                edge = np.concatenate([[0], np.cumsum(n)])
                cuts = np.searchsorted(of[order], np.arange(m.shards + 1))
                for s in np.unique(of):
                    a, b = cuts[s], cuts[s + 1]
                    raw = b"".join([
                        _planes(np.diff(pv[a:b], prepend=0)), _planes(pw[a:b]), _planes(n[a:b].astype(np.uint32)),
                        _planes(docs[edge[a]:edge[b]])])
                    shard.append(int(s))
                    kind.append(0)
                    sizes.append([int(b - a), int(edge[b] - edge[a]), len(raw)])
                    data.append(zstd.compress(raw, asbytes=True))
            table = pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.bincount(rows, minlength=n_docs)),
                 pa.array(np.bincount(rows, count > 0, n_docs).astype(np.int64)),
                 pa.array(np.bincount(rows, base, n_docs).astype(float)), pa.array(local)],
                ["doc_id", "n_tokens", "n_known", "base_score", "score"])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema) as out:
                out.write_batch(table)
            shard.append(seq % m.shards)
            kind.append(1)
            sizes.append([n_docs, 0, 0])
            data.append(sink.getvalue().to_pybytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(shard, pa.int32()), pa.array([seq] * len(shard), pa.int64()), pa.array(kind, pa.int32()),
                 pa.array(sizes, pa.list_(pa.int64())), pa.array(data, pa.binary())],
                ["shard", "chunk", "kind", "sizes", "data"])
            seq += 1
    return run


def _answered(model):
    """Replaces the pairs of a row by the documents they stand in and their sums of log10 p."""
    def run(batches):
        import pyarrow as pa

        m = model
        zstd = pa.Codec("zstd", compression_level=1)
        for batch in batches:
            out = []
            for shard, kind, sizes, data in zip(*(batch.column(c).to_pylist() for c in (
                    "shard", "kind", "sizes", "data")), strict=True):
                if not kind:
                    pairs, places, total = sizes
                    raw = memoryview(zstd.decompress(data, total, asbytes=True))
                    v = np.cumsum(_unplanes(raw, np.int64, pairs))
                    w = _unplanes(raw[8 * pairs:], np.int64, pairs)
                    n = _unplanes(raw[16 * pairs:], np.uint32, pairs)
                    docs = _unplanes(raw[20 * pairs:], np.uint16, places)
                    own = m.logp(v, w, m.pair_counts(shard, _key(v, w).view(np.int64)))
                    found, at = np.unique(docs, return_inverse=True)
                    data = found.tobytes() + np.bincount(at, np.repeat(own, n), len(found)).tobytes()
                out.append(data)
            yield pa.RecordBatch.from_arrays(
                [batch.column("chunk"), batch.column("kind"), batch.column("shard"), pa.array(out, pa.binary())],
                ["chunk", "kind", "shard", "data"])
    return run


def _added(table):
    """One span's documents with the sums of all shards."""
    import pyarrow as pa

    docs, parts = None, []
    for kind, shard, data in zip(*(table.column(c).to_pylist() for c in ("kind", "shard", "data")), strict=True):
        if kind:
            docs = pa.ipc.open_stream(data).read_all()
        else:
            parts.append((shard, data))
    score = docs.column("score").to_numpy().copy()
    for _, data in sorted(parts):
        n = len(data) // 10
        score[np.frombuffer(data, np.uint16, n)] += np.frombuffer(data, np.float64, n, 2 * n)
    return docs.set_column(4, "score", pa.array(score))


def score(docs: DataFrame, model: Model, stages: Stages | None = None) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score of every row of (doc_id, text)."""
    stages = stages or Stages(docs.sparkSession, "kneser-ney")
    asked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        _asked(model), "shard int, chunk long, kind int, sizes array<long>, data binary")
    answered = asked.repartitionById(model.shards, "shard").mapInArrow(
        _answered(model), "chunk long, kind int, shard int, data binary")
    return stages.keep(answered.groupBy("chunk").applyInArrow(
        _added, "doc_id long, n_tokens long, n_known long, base_score double, score double"), "scores")


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 7 == 2, F.lit(False))


def score_documents(docs: DataFrame) -> DataFrame:
    """Learn from the rows that aren't held out, score all of them."""
    model = fit(docs.where(~held_out(F.col("doc_id"))))
    return score(docs, model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known",
        F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score",
        F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))
