"""Token ids in a compressed, checksummed file format.

A file is a Parquet file with one row per segment: whole documents in ascending
doc_id order.  A segment's bytes are

    magic "LLT2", u32 documents, u32 blocks, u32 ids a block, u32 bytes and u32 crc32 of the odds,
    odds, i64 doc_id x documents (after a null map), u32 length x documents,
    (u32 ids, u32 crc32 of the ids as little-endian u32, u32 bytes) x blocks, payloads

Every block of `BLOCK` ids is coded on its own: contexts and coder start afresh, so a
damaged block costs itself alone and any block can be decoded by itself with the odds.

The coder is a range coder with one 64-bit state a block (rANS).  Per block, an order-2 and an
order-1 context table learn which id came last after the same context, and whether it came
twice.  By both tables' sureness and whether they agree, the segment's odds say that
order 2 is right, that only order 1 is, or neither; a miss is coded by the segment's
order-0 counts of missed ids.  The odds are counted on a first walk and stored with the
segment.  All blocks of a segment advance together as numpy lanes.

Spark does the rest: range partitioning by doc_id, the committed write, the read, and
prefix sums over segments (per file, then over files) for the documents' starts.

Defined results: null text counts as empty, and an empty document is its end id
alone; an id of 65,536 or more is refused with an error; null doc_ids come first; repeated rows are stored each, ordered by a hash of
their text; an empty table writes and reads no rows; other columns are not read.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import Stages
from ledgerline.llm.tokens import encode_column, vocabulary, word_table

MAGIC = b"LLT2"
#: Ids lie below this: contexts and the odds hold 16 bits.
IDS = 1 << 16
BLOCK = 1024
SEGMENT_IDS = BLOCK * 4096
CONTEXTS = 256
#: Odds of a kind are out of 2**KIND_BITS, of a missed id out of 2**ID_BITS.
KIND_BITS, ID_BITS = 12, 18
BITS = KIND_BITS + ID_BITS
#: A state is at least this between two ids; it gives or takes 32 bits at a time.
LEAST = np.uint64(2 << BITS)
#: A class is 6 x sureness of order 2 + 2 x sureness of order 1 + agreement (sureness 0 to 2);
#: a kind is 4 x class + 0 (order 2 is right), 1 (only order 1 is) or 2 (neither).
CLASSES, SURE_TWO, SURE_ONE = 18, 6 << 16, 2 << 16


class Contexts:
    """The ids that came last after an order-2 and an order-1 context, of many blocks side by side."""

    def __init__(self, lanes: int):
        self.two = np.zeros(lanes * CONTEXTS, np.uint32)  # id | sureness << 16, as a class counts it
        self.one = np.zeros(lanes * CONTEXTS, np.uint32)
        # what indexes is 64 bits wide, so that numpy needn't widen it
        self.slot = np.arange(lanes, dtype=np.int64) * CONTEXTS
        self.last = np.zeros(lanes, np.int64)
        self.before = np.zeros(lanes, np.int64)

    def predict(self, n: int):
        """Both predictions and the class of the first n lanes."""
        mixed = self.last[:n] * 40503
        self.i1 = mixed >> 7
        mixed += self.before[:n] * 30011
        mixed >>= 6
        self.i2 = mixed
        for i in (self.i1, self.i2):
            i &= CONTEXTS - 1
            i += self.slot[:n]
        e2, e1 = self.two.take(self.i2, mode="clip"), self.one.take(self.i1, mode="clip")
        p2, p1 = e2.astype(np.uint16), e1.astype(np.uint16)
        e2 >>= 16
        e1 >>= 16
        e2 += e1
        e2 += p2 == p1
        return p2, p1, e2.astype(np.uint8)

    def update(self, n: int, x: np.ndarray, right2: np.ndarray, right1: np.ndarray):
        """Learn the ids x: a repeated one is surer."""
        for table, i, right, sure in ((self.two, self.i2, right2, SURE_TWO), (self.one, self.i1, right1, SURE_ONE)):
            entry = right.astype(np.uint32)
            entry += np.uint32(1)
            entry *= np.uint32(sure)
            entry += x
            table[i] = entry
        self.before[:n] = self.last[:n]
        self.last[:n] = x


def _shares(counts: np.ndarray, total: int) -> np.ndarray:
    """Whole shares of `total` near the counts, at least 1 where there is a count."""
    some = counts > 0
    shares = np.where(some, counts * (total - some.sum()) // counts.sum() + 1, 0)
    shares[shares.argmax()] += total - shares.sum()
    return shares


class Odds:
    """Shares of kinds by class and of missed ids, each with where it begins."""

    def __init__(self, kinds: np.ndarray, ids: np.ndarray):
        self.kinds, self.ids = kinds, ids
        begin = np.cumsum(kinds, axis=1) - kinds
        pad = np.zeros((CLASSES, 1), np.int64)
        self.share, self.begin = (np.hstack([x, pad]).reshape(-1).astype(np.uint64) for x in (kinds, begin))
        self.only1, self.miss = (np.ascontiguousarray(begin[:, k]).astype(np.uint32) << np.uint32(ID_BITS) for k in (1, 2))
        self.id_share = ids.astype(np.uint64)
        self.id_begin = (np.cumsum(ids) - ids).astype(np.uint64)

    @classmethod
    def counted(cls, kinds: np.ndarray, missed: np.ndarray) -> Odds:
        seen = np.bincount(kinds.reshape(-1), minlength=256)[:4 * CLASSES].reshape(CLASSES, 4)[:, :3] + 1
        ids = np.bincount(missed, minlength=IDS)
        if not len(missed):
            ids[0] = 1
        return cls(np.array([_shares(c, 1 << KIND_BITS) for c in seen]), _shares(ids, 1 << ID_BITS))

    @classmethod
    def even(cls) -> Odds:
        """Odds that know nothing."""
        return cls.counted(np.zeros(0, np.uint8), np.arange(IDS))

    def pack(self) -> bytes:
        at = np.flatnonzero(self.ids)
        return zlib.compress(b"".join([self.kinds.astype("<u2").tobytes(), np.diff(at, prepend=0).astype("<u2").tobytes(),
                                       self.ids[at].astype("<u4").tobytes()]), 1)

    @classmethod
    def unpack(cls, data: bytes) -> Odds:
        raw = zlib.decompress(data)
        rest = 6 * CLASSES
        n = (len(raw) - rest) // 6
        ids = np.zeros(IDS, np.int64)
        ids[np.cumsum(np.frombuffer(raw, "<u2", n, rest), dtype=np.int64)] = np.frombuffer(raw, "<u4", n, rest + 2 * n)
        return cls(np.frombuffer(raw, "<u2", 3 * CLASSES).reshape(CLASSES, 3).astype(np.int64), ids)


def _walk(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids as step x block, and each one's kind (255 past the end)."""
    if len(ids) and ids.max() >= IDS:
        raise ValueError(f"id {ids.max()} of a vocabulary of more than {IDS} ids: the format has 16 bits an id")
    lanes = -(-len(ids) // BLOCK)
    grid = np.zeros(lanes * BLOCK, np.uint16)
    grid[:len(ids)] = ids
    grid = np.ascontiguousarray(grid.reshape(lanes, BLOCK).T)
    tail = len(ids) - (lanes - 1) * BLOCK
    kinds = np.full((min(BLOCK, len(ids)), lanes), 255, np.uint8)
    contexts = Contexts(lanes)
    for t in range(len(kinds)):
        n = lanes if t < tail else lanes - 1
        x = grid[t, :n]
        p2, p1, kind = contexts.predict(n)
        right2, right1 = p2 == x, p1 == x
        kind <<= 2
        kind += (2 - right1.view(np.uint8)) * (~right2).view(np.uint8)
        kinds[t, :n] = kind
        contexts.update(n, x, right2, right1)
    return grid, kinds


def _code(grid: np.ndarray, kinds: np.ndarray, odds: Odds) -> list:
    """Payload bytes of every block: the last id is coded first, so that the first is read first."""
    steps, lanes = kinds.shape
    out = np.zeros((lanes, steps + 2), np.uint32)
    flat, fill = out.reshape(-1), np.arange(1, lanes + 1) * (steps + 2)
    state = np.full(lanes, LEAST)
    share_of, begin_of = odds.share << np.uint64(ID_BITS), odds.begin << np.uint64(ID_BITS)
    for t in reversed(range(steps)):
        n = lanes if kinds[t, -1] < 255 else lanes - 1
        kind, s = kinds[t, :n], state[:n]
        share, begin = share_of.take(kind), begin_of.take(kind)
        m = np.flatnonzero(kind & 2)
        x, within = grid[t].take(m), odds.share.take(kind.take(m))
        share[m] = within * odds.id_share.take(x)
        begin[m] += within * odds.id_begin.take(x)
        due = np.flatnonzero(s >> np.uint64(33) >= share)
        full, at = s[due], fill[due] - 1
        flat[at] = full & np.uint64(0xFFFFFFFF)
        fill[due] = at
        s[due] = full >> np.uint64(32)
        times = s // share
        begin += s
        begin -= times * share
        times <<= np.uint64(BITS)
        np.add(times, begin, out=s)
    for half in (state & np.uint64(0xFFFFFFFF), state >> np.uint64(32)):
        fill -= 1
        flat[fill] = half
    ends = np.arange(1, lanes + 1) * (steps + 2)
    return [flat[a:b].astype("<u4").tobytes() for a, b in zip(fill.tolist(), ends.tolist(), strict=True)]


def encode_blocks(ids: np.ndarray, odds: Odds | None = None) -> list:
    """Payload bytes of every block of `ids`; without odds, all are even."""
    return _code(*_walk(ids), odds or Odds.even()) if len(ids) else []


def encode_counted(ids: np.ndarray) -> tuple[Odds, list]:
    """The ids' own odds, and every block's payload bytes under them."""
    grid, kinds = _walk(ids)
    odds = Odds.counted(kinds, grid[:len(kinds)][(kinds & 3) == 2])
    return odds, _code(grid, kinds, odds)


def decode_blocks(payloads: list, sizes: list, odds: Odds | None = None) -> np.ndarray:
    """The ids of blocks that hold `sizes` ids each; all but the last are equally long."""
    lanes = len(payloads)
    if not lanes:
        return np.zeros(0, np.uint32)
    odds = odds or Odds.even()
    length = max(sizes)
    words = np.frombuffer(b"".join(payloads), "<u4").astype(np.uint64)
    at = np.cumsum([0, *(len(p) // 4 for p in payloads[:-1])])
    state = words.take(at, mode="clip") << np.uint64(32) | words.take(at + 1, mode="clip")
    at += 2
    ids_at = np.repeat(np.arange(IDS, dtype=np.uint16), odds.ids)
    share_of, begin_of = odds.share << np.uint64(ID_BITS), odds.begin << np.uint64(ID_BITS)
    contexts = Contexts(lanes)
    grid = np.zeros((length, lanes), np.uint16)
    for t in range(length):
        n = lanes if t < sizes[-1] else lanes - 1
        p2, p1, kind = contexts.predict(n)
        s = state[:n]
        slot = s & np.uint64((1 << BITS) - 1)
        low = slot.astype(np.uint32)
        wrong2 = low >= odds.only1.take(kind)
        miss = low >= odds.miss.take(kind)
        kind <<= 2
        kind += wrong2
        kind += miss
        share, begin = share_of.take(kind), begin_of.take(kind)
        x = np.where(wrong2, p1, p2)
        m = np.flatnonzero(miss)
        within = odds.share.take(kind.take(m))
        inner = low.take(m)
        inner -= begin.take(m).astype(np.uint32)
        x_m = ids_at.take(inner // within.astype(np.uint32), mode="clip")
        x[m] = x_m
        share[m] = within * odds.id_share.take(x_m)
        begin[m] += within * odds.id_begin.take(x_m)
        slot -= begin
        s >>= np.uint64(BITS)
        s *= share
        s += slot
        due = np.flatnonzero(s < LEAST)
        where = at[due]
        s[due] = s[due] << np.uint64(32) | words.take(where, mode="clip")
        at[due] = where + 1
        grid[t, :n] = x
        contexts.update(n, x, p2 == x, p1 == x)
    return grid.T.reshape(-1)[:(lanes - 1) * length + sizes[-1]].astype(np.uint32)


def pack_segment(doc_ids: list, lengths: np.ndarray, ids: np.ndarray) -> bytes:
    odds, blocks = encode_counted(ids)
    odds = odds.pack()
    raw = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
    sizes = [min(BLOCK, len(ids) - k * BLOCK) for k in range(len(blocks))]
    index = np.array([(n, zlib.crc32(raw[4 * k * BLOCK:4 * (k * BLOCK + n)]), len(b))
                      for k, (n, b) in enumerate(zip(sizes, blocks, strict=True))], "<u4")
    null = np.array([d is None for d in doc_ids], np.uint8)
    names = np.array([0 if d is None else d for d in doc_ids], "<i8")
    return b"".join([MAGIC, struct.pack("<IIIII", len(doc_ids), len(blocks), BLOCK, len(odds), zlib.crc32(odds)), odds,
                     null.tobytes(), names.tobytes(), lengths.astype("<u4").tobytes(), index.tobytes(), *blocks])


def unpack_segment(data: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    """doc_ids, lengths and ids; raises ValueError on a wrong magic or checksum."""
    if data[:4] != MAGIC:
        raise ValueError("not a token segment")
    docs, blocks, _, size, check = struct.unpack_from("<IIIII", data, 4)
    at = 24 + size
    if zlib.crc32(data[24:at]) != check:
        raise ValueError("the odds of a token segment are damaged")
    null = np.frombuffer(data, np.uint8, docs, at)
    names = np.frombuffer(data, "<i8", docs, at := at + docs)
    lengths = np.frombuffer(data, "<u4", docs, at := at + 8 * docs).astype(np.int64)
    index = np.frombuffer(data, "<u4", 3 * blocks, at := at + 4 * docs).reshape(blocks, 3).astype(np.int64)
    ends = at + 12 * blocks + np.cumsum(index[:, 2])
    ids = decode_blocks([data[e - n:e] for e, n in zip(ends, index[:, 2], strict=True)], index[:, 0].tolist(),
                        Odds.unpack(data[24:24 + size]))
    raw, place = memoryview(ids.astype("<u4")).cast("B"), 0
    for k, (n, crc, _) in enumerate(index):
        if zlib.crc32(raw[4 * place:4 * (place + n)]) != crc:
            raise ValueError(f"block {k} of a token segment is damaged")
        place += n
    return [None if z else int(d) for z, d in zip(null, names, strict=True)], lengths, ids


def _write(path: str, end_id: int, segment_ids: int):
    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part, seq = TaskContext.get().partitionId(), 0
        table = word_table(path)
        docs, sizes, runs, held = [], [], [], 0

        def flush():
            ids, lengths = np.concatenate(runs), np.concatenate(sizes)
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int64()), pa.array([seq], pa.int64()), pa.array([len(ids)], pa.int64()),
                 pa.array([pack_segment(docs, lengths, ids)], pa.binary())], ["part", "seq", "n_ids", "segment"])

        for batch in batches:
            names = batch.column("doc_id").to_pylist()
            for first, ids, at in encode_column(batch.column("text"), table, end_id):
                docs += names[first:first + len(at) - 1]
                sizes.append(np.diff(at))
                runs.append(ids)
                held += len(ids)
                if held >= segment_ids:
                    yield flush()
                    docs, sizes, runs, held, seq = [], [], [], 0, seq + 1
        if held:
            yield flush()
    return run


def _read(batches):
    import pyarrow as pa

    for batch in batches:
        for k in range(batch.num_rows):
            docs, lengths, ids = unpack_segment(batch.column("segment")[k].as_py())
            ends = np.cumsum(lengths)
            raw = memoryview(ids.astype("<u4")).cast("B")
            crc = [zlib.crc32(raw[4 * (e - n):4 * e]) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([batch.column(c)[k].as_py()] * len(docs), pa.int64()) for c in ("part", "seq")]
                + [pa.array(docs, pa.int64()), pa.array(ends - lengths, pa.int64()), pa.array(lengths, pa.int64()),
                   pa.array(crc, pa.int64())], ["part", "seq", "doc_id", "local", "n_tokens", "ids_crc32"])


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 1,
                 segment_ids: int = SEGMENT_IDS) -> None:
    """Write the ids of (doc_id, text) to files at `path`, in ascending doc_id order."""
    run = _write(tokenizer or vocabulary(), end_id, segment_ids)
    ordered = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
               .repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text")))
    (ordered.mapInArrow(run, "part long, seq long, n_ids long, segment binary")
     .write.option("compression", "uncompressed").parquet(path))


def read_tokens(spark, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every stored document, from the files."""
    segments = spark.read.parquet(path)
    parts = segments.groupBy("part").agg(F.sum("n_ids").alias("n"))
    # one row per file
    parts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("part_start"))
    starts = segments.select("part", "seq", "n_ids").join(parts, "part").select("part", "seq", (
        F.col("part_start") + F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_ids")
    ).alias("base"))
    read = segments.select("part", "seq", "segment").mapInArrow(
        _read, "part long, seq long, doc_id long, local long, n_tokens long, ids_crc32 long")
    return read.join(starts, ["part", "seq"]).select(
        "doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def store_tokens(docs: DataFrame) -> DataFrame:
    """Write the files into the shared folder and read them back."""
    stages = Stages(docs.sparkSession, "token-store")
    write_tokens(docs, stages.path("tokens"))
    return read_tokens(docs.sparkSession, stages.path("tokens"))
