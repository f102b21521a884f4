"""Helpers shared by the operators: written stages, per-process caches, word hashing."""

from __future__ import annotations

import contextlib
import sys
import types
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.session import shared_dir

#: Bytes of text that a task turns into numpy arrays at once.
CHUNK_BYTES = 1 << 18
#: Arrow batches of written stages.
BATCH = "8m"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Stages:
    """Written tables in the cluster's shared folder; each one cuts the lineage.

    A lost executor costs a re-read, never a recomputation of earlier stages.
    Every operator call has a folder of its own, so reruns never collide.
    """

    def __init__(self, spark: SparkSession, operator: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/ledgerline/llm/{operator}-{uuid.uuid4().hex[:12]}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        with small_batches(self.spark):
            df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Delete tables that no later plan reads, so disk holds only live stages."""
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names:
            p = jvm.org.apache.hadoop.fs.Path(self.path(name))
            p.getFileSystem(conf).delete(p, True)


    def clear(self) -> None:
        """Delete the operator's whole folder, once nothing reads it any more."""
        self.drop("")


@contextlib.contextmanager
def small_batches(spark: SparkSession):
    """Python workers get `BATCH` of rows at a time while this holds, however long the rows are."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, BATCH)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def process_cache(owner: str = "shared") -> dict:
    """A dict that lives as long as the Python worker, across its tasks, for one owner.

    An owner that asks for the first time ends the others' (all but the small "shared"
    one), so a worker never holds the tables of steps that are over.
    """
    name = "_ledgerline_worker_cache"
    if name not in sys.modules:
        sys.modules[name] = types.ModuleType(name)
        sys.modules[name].store = {}
    store = sys.modules[name].store
    if owner not in store:
        if owner != "shared":
            for other in [o for o in store if o != "shared"]:
                del store[other]
        store[owner] = {}
    return store[owner]


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of an Arrow string column end to end, and n+1 offsets; null is empty."""
    import pyarrow as pa

    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offs, data = column.buffers()
    off = np.frombuffer(offs, np.int64)[column.offset:column.offset + len(column) + 1]
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[off[0]:off[-1]], off - off[0]


def row_chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES):
    """(first row, last row + 1) runs of at most `limit` bytes, or one longer row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (multiply and xor-shift rounds)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def ascii_lower(buf: np.ndarray) -> np.ndarray:
    return buf + (((buf >= 65) & (buf <= 90)).astype(np.uint8) << 5)


_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    store = process_cache()
    have = store.get("powers")
    if have is None or len(have[0]) < n:
        size = max(n, CHUNK_BYTES + 1)
        out = []
        for base in (_BASE, _INVERSE):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        if size > 4 * CHUNK_BYTES:  # a very long row: not kept
            return out[0], out[1]
        have = store["powers"] = (out[0], out[1])
    return have


def byte_codes() -> np.ndarray:
    return mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit polynomial hashes of buf[start:end] for all spans at once."""
    up, down = _powers(len(buf) + 1)
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(byte_codes()[buf] * up[:len(buf)], out=total[1:])
    h = (total[ends] - total[starts]) * down[starts]
    return mix64(h + (ends - starts).astype(np.uint64))


def word_spans(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of every run of bytes outside space and \\t..\\r; rows don't touch."""
    solid = ~((buf == 32) | ((buf >= 9) & (buf <= 13)))
    before = np.zeros(len(buf), bool)
    before[1:] = solid[:-1]
    after = np.zeros(len(buf), bool)
    after[:-1] = solid[1:]
    edge = offsets[1:-1]
    edge = edge[(edge > 0) & (edge < len(buf))]
    before[edge] = False
    after[edge - 1] = False
    starts = np.flatnonzero(solid & ~before)
    ends = np.flatnonzero(solid & ~after) + 1
    rows = np.searchsorted(offsets, starts, "right") - 1
    return starts, ends, rows


def _number(batches):
    """Rows of a sorted partition with the partition's number and their place in it."""
    import pyarrow as pa
    from pyspark import TaskContext

    part, at = TaskContext.get().partitionId(), 0
    for batch in batches:
        n = batch.num_rows
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(np.full(n, part, np.int32)), pa.array(np.arange(at, at + n))],
            [*batch.schema.names, "__part", "__at"])
        at += n


def ranked(df: DataFrame, order: list, stages: Stages, name: str) -> DataFrame:
    """`df` (a written table) with `rank` from 1 in the order of `order`, which must tell rows apart."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    dealt = stages.keep(df.repartitionByRange(n, *order).sortWithinPartitions(*order)
                        .mapInArrow(_number, f"{kind}, __part int, __at long"), name)
    first, rows = 1, []
    for part, size in sorted(dealt.groupBy("__part").count().collect()):  # one row per partition
        rows.append((part, first))
        first += size
    offsets = df.sparkSession.createDataFrame(rows, "__part int, __first long")
    return (dealt.join(F.broadcast(offsets), "__part").withColumn("rank", F.col("__first") + F.col("__at"))
            .drop("__part", "__at", "__first"))


def crc_sql(value: str) -> str:
    """DuckDB: the CRC-32 of a text's bytes; `t` is the table of `crc_table`."""
    return (f"xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(0, octet_length(encode({value}))), "
            f"lambda i: ('0x' || substr(hex(encode({value})), 2 * i + 1, 2))::bigint)), "
            f"lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295)")


CRC_TABLE = """crc_table as (select list(v order by k) as t from (select k, list_reduce(list_prepend(k, range(0, 8)),
   lambda c, i: if(c & 1 = 1, xor(c >> 1, 3988292384), c >> 1)) as v from (select unnest(range(0, 256)) as k)))"""
