"""Prefix trie of conversations by vertical bitmaps.

Every conversation is rebuilt first: a shared head from the conversation that leads its
group, then its own tail.  The trie's nodes are the distinct runs of first turns.

A shard holds at most `LIMIT` conversations, neighbours in id order, and `DEPTH`
positions.  It is indexed vertically: for each (position, turn) a bitset of the
conversations that have that turn there, and for each length a bitset of those that
end there.  A depth-first walk intersects a node's bitset with the postings of its
members' next turns; every intersection is a child, its population count the child's
size, its lowest bit the smallest member, its intersection with the length's bitset
the list of those that end.  Shards send nodes, never turns, and nodes that several
shards found are added up by key: a sum of position-salted hashes of the turns on the
way, which deeper shards start from, so long conversations are cut into shards too.

Sums over subtrees take logarithmically many rounds: a node holds the sum of its
descendants to distance 2**k and a pointer to its ancestor at that distance.

Texts never move, only their hashes and lengths.  Positions inside a conversation are
numbered by range, so a conversation of any length is dealt over tasks; shards hold
neighbours in id order, so a node's end lists are disjoint runs of ids and SHA-256
reads them as a sorted stream, however long.

Defined results: rows with a null conv_id belong to no conversation; null turns come
first; equal turns are ordered by the hashes of role and text, and repeated rows are
turns of their own; null role or text is empty; texts count whole, however long; an
empty table gives no rows, not even a root; other columns are not read and may have any
name.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm.common import CRC_TABLE, Stages, crc_sql, ranked

#: Conversations and positions of one shard.
LIMIT = 2048
DEPTH = 16
#: A conversation's head comes from the leader of its GROUP ids, at most HEAD - 1 turns.
GROUP, HEAD = 5, 9
_WRAP = 1 << 64


def _place(batches):
    """Rows of a sorted partition with the partition's number and their place among its rows of a conversation."""
    import numpy as np
    import pyarrow as pa
    from pyspark import TaskContext

    part, last, held = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        ids = batch.column("conv_id").to_numpy()
        new = np.concatenate([[last is None or ids[0] != last], ids[1:] != ids[:-1]])
        at = np.arange(n) - np.maximum.accumulate(np.where(new, np.arange(n), 0))
        if not new[0]:
            first = int(np.argmax(new)) if new.any() else n
            at[:first] += held
        last, held = ids[-1], int(at[-1]) + 1
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(np.full(n, part, np.int32)), pa.array(at)], [*batch.schema.names, "part", "at"])


def numbered_turns(conversations: DataFrame, stages: Stages) -> DataFrame:
    """conv_id, pos (from 0), t1, t2 (hashes of role and text), bytes of every turn."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turns = stages.keep(conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.xxhash64(role, text).alias("t1"),
        F.xxhash64(F.lit(1), role, text).alias("t2"), F.octet_length(text).cast("long").alias("bytes"),
        F.monotonically_increasing_id().alias("row")), "turns")
    order = ["conv_id", F.asc_nulls_first("turn"), "t1", "t2", "row"]
    n = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_turns = turns.repartitionByRange(n, *order).sortWithinPartitions(*order)
    dealt = stages.keep(sorted_turns.select("conv_id", "t1", "t2", "bytes").mapInArrow(
        _place, "conv_id long, t1 long, t2 long, bytes long, part int, at long"), "dealt")
    stages.drop("turns")
    # only a partition's first and last conversation can go on in another one: two rows a partition
    edge = dealt.groupBy("part").agg(F.min("conv_id").alias("x"), F.max("conv_id").alias("y"))
    edge = edge.select(F.explode(F.array("x", "y")).alias("conv_id")).distinct()
    held = dealt.join(F.broadcast(edge), "conv_id").groupBy("conv_id", "part").count().collect()
    before: dict = {}
    rows = []
    for conv, part, size in sorted(held):
        rows.append((conv, part, before.get(conv, 0)))
        before[conv] = before.get(conv, 0) + size
    shift = turns.sparkSession.createDataFrame(rows, "conv_id long, part int, shift long")
    return dealt.join(F.broadcast(shift), ["conv_id", "part"], "left").select(
        "conv_id", (F.col("at") + F.coalesce("shift", F.lit(0))).alias("pos"), "t1", "t2", "bytes")


def rebuilt_turns(conversations: DataFrame, stages: Stages) -> DataFrame:
    """idx, conv_id, len and p, m1, m2, bytes of every turn of the rebuilt conversations.

    idx numbers the conversations in id order; one with no turns has one row whose p is
    null; m1 and m2 are hashes of (turn, p).
    """
    turns = stages.keep(numbered_turns(conversations, stages), "numbered")
    convs = stages.keep(turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("own")).select(
        "conv_id", "own", F.pmod(F.crc32(F.col("conv_id").cast("string")), F.lit(HEAD)).alias("h"),
        (F.col("conv_id") - F.col("conv_id") % GROUP).alias("lead")), "convs")
    leaders = convs.select(F.col("conv_id").alias("lead"), F.col("own").alias("lead_own"))
    convs = convs.join(leaders, "lead", "left").withColumn("head", F.least("h", F.coalesce("lead_own", F.lit(0))))
    convs = stages.keep(convs.select("conv_id", "lead", "h", "head", (
        F.col("head") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("len")), "lengths")
    convs = stages.keep(ranked(convs, ["conv_id"], stages, "ranked").withColumn("idx", F.col("rank") - 1), "indexed")
    tail = turns.join(convs, "conv_id").where("pos >= h").withColumn("p", F.col("head") + F.col("pos") - F.col("h"))
    heads = (turns.where(f"pos < {HEAD - 1}").withColumnRenamed("conv_id", "lead")
             .join(convs, "lead").where("pos < h").withColumn("p", F.col("pos")))
    own = ["idx", "conv_id", "len", "p", "t1", "t2", "bytes"]
    rows = tail.select(*own).union(heads.select(*own)).select(
        "idx", "conv_id", "len", "p", F.xxhash64("t1", "p").alias("m1"), F.xxhash64("t2", "p").alias("m2"), "bytes")
    none = convs.where("len = 0").selectExpr("idx", "conv_id", "len", "null as p", "0L as m1", "0L as m2", "0L as bytes")
    return stages.keep(rows.union(none), "rebuilt")


def _starts(rows: DataFrame, depth: int) -> DataFrame:
    """idx, b, s1, s2: the key (as decimal text, before wrapping) of every block's first node but the first block's."""
    def upto(df, group, at):
        w = Window.partitionBy(*group).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
        return [F.coalesce(F.sum(c).over(w), F.lit(0)).alias(f"b{c}") for c in ("d1", "d2")]

    def total(df, *group):
        return df.groupBy(*group).agg(*[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("d1", "d2")])

    blocks = total(rows.where(f"len > {depth}").select("idx", F.expr(f"p div {depth}").alias("b"),
                                                       F.col("m1").alias("d1"), F.col("m2").alias("d2")), "idx", "b")
    blocks = blocks.withColumn("far", F.expr("b div 4096"))  # windows of 4,096 blocks, then over their sums
    far = total(blocks, "idx", "far")
    far = far.select("idx", "far", *upto(far, ["idx"], "far")).withColumnsRenamed({"bd1": "f1", "bd2": "f2"})
    near = blocks.select("idx", "far", "b", *upto(blocks, ["idx", "far"], "b"))
    return near.join(far, ["idx", "far"]).where("b > 0").select(
        "idx", "b", (F.col("bd1") + F.col("f1")).cast("string").alias("s1"),
        (F.col("bd2") + F.col("f2")).cast("string").alias("s2"))


def _signed(k: int) -> int:
    return k - _WRAP if k >= _WRAP >> 1 else k


def _walk(depth: int):
    def run(key, table):
        import pyarrow as pa

        block, start = key[0].as_py(), [int(k.as_py()) % _WRAP for k in key[1:3]]
        cols = [table.column(c).to_pylist() for c in ("idx", "conv_id", "len", "p", "m1", "m2", "bytes")]
        members = sorted({(i, c, n) for i, c, n in zip(*cols[:3], strict=True)})
        bit = {m[0]: k for k, m in enumerate(members)}
        turns, postings, sizes, ended = {}, {}, {}, {}
        for i, p, m1, m2, size in zip(cols[0], *cols[3:], strict=True):
            if p is not None:
                turn = (p, m1, m2)
                turns[bit[i], p] = turn
                postings[turn] = postings.get(turn, 0) | 1 << bit[i]
                sizes[turn] = size
        for k, (_, _, n) in enumerate(members):
            ended[n] = ended.get(n, 0) | 1 << k
        out = [[] for _ in range(9)]

        def emit(bits, at, own, parent, size):
            ends, done = [], bits & ended.get(at, 0)
            while done:
                low = done & -done
                ends.append(members[low.bit_length() - 1][1])
                done ^= low
            first = members[(bits & -bits).bit_length() - 1][1]
            for column, value in zip(out, (_signed(own[0]), _signed(own[1]), *parent, at, bits.bit_count(), first,
                                           size, ends), strict=True):
                column.append(value)

        everyone, top = (1 << len(members)) - 1, block * depth
        if not block:
            emit(everyone, 0, start, (None, None), 0)
        stack = [(everyone, top, start)]
        while stack:
            bits, at, own = stack.pop()
            rest = bits & ~ended.get(at, 0) if at < top + depth else 0
            while rest:
                turn = turns[(rest & -rest).bit_length() - 1, at]
                child = rest & postings[turn]
                rest ^= child
                below = [(own[0] + turn[1]) % _WRAP, (own[1] + turn[2]) % _WRAP]
                emit(child, at + 1, below, (_signed(own[0]), _signed(own[1])), sizes[turn])
                stack.append((child, at + 1, below))
        long = pa.int64()
        return pa.table([pa.array(c, long) for c in out[:8]] + [pa.array(out[8], pa.list_(long))],
                        ["k1", "k2", "p1", "p2", "depth", "n", "conv", "bytes", "ends"])
    return run


def _digest(batches):
    """SHA-256 of every node's ids, from rows in (node, first id) order; a node may go on over batches."""
    import pyarrow as pa

    key, state = None, None

    def done():
        return [*key, state.hexdigest()]

    for batch in batches:
        out = []
        for k1, k2, ends in zip(*(batch.column(c).to_pylist() for c in ("k1", "k2", "ends")), strict=True):
            text = ",".join(map(str, ends))
            if key == (k1, k2):
                state.update(b"," + text.encode())
            else:
                if key:
                    out.append(done())
                key, state = (k1, k2), hashlib.sha256(text.encode())
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string()))],
            ["k1", "k2", "sha"])
    if key:
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in
                                          zip(done(), (pa.int64(), pa.int64(), pa.string()), strict=True)],
                                         ["k1", "k2", "sha"])


def _subtrees(nodes: DataFrame, stages: Stages) -> DataFrame:
    """k1, k2, n_leaves, saved_tokens summed over every node's subtree, by pointer doubling.

    Round k moves what a node holds of its descendants to distance 2**k to its ancestor
    at that distance; only nodes that deep take part.  What every round moved is added up
    at the end.
    """
    key = ["k1", "k2"]
    live = nodes.where("depth > 0").select(*key, "depth", F.col("p1").alias("a1"), F.col("p2").alias("a2"), "leaves", "saved")
    moved, reach, most = nodes.select(*key, "leaves", "saved"), 1, nodes.agg(F.max("depth")).first()[0] or 0
    while reach <= most:
        up = stages.keep(live.groupBy(F.col("a1").alias("k1"), F.col("a2").alias("k2")).agg(
            F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")), f"moved-{reach}")
        moved = moved.union(up)
        hop = live.select(F.col("k1").alias("a1"), F.col("k2").alias("a2"), F.col("a1").alias("b1"), F.col("a2").alias("b2"))
        more = up.select(*key, F.col("leaves").alias("more_leaves"), F.col("saved").alias("more_saved"))
        deep = live.where(f"depth >= {2 * reach}").join(more, key, "left").join(hop, ["a1", "a2"])
        live = stages.keep(deep.select(
            *key, "depth", F.col("b1").alias("a1"), F.col("b2").alias("a2"),
            (F.col("leaves") + F.coalesce("more_leaves", F.lit(0))).alias("leaves"),
            (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved")), f"live-{reach}")
        stages.drop(f"live-{reach // 2}")
        reach *= 2
    return moved.groupBy(*key).agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))


def prefix_trie(conversations: DataFrame, limit: int = LIMIT, depth: int = DEPTH) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    stages = Stages(conversations.sparkSession, "prefix-trie")
    rows = rebuilt_turns(conversations, stages).withColumn("b", F.coalesce(F.expr(f"p div {depth}"), F.lit(0)))
    zero = F.lit("0")
    first = rows.where("b = 0").withColumn("s1", zero).withColumn("s2", zero)
    deeper = rows.where("b > 0").join(_starts(rows.where("p is not null"), depth), ["idx", "b"])
    shards = first.union(deeper.select(*first.columns)).withColumn("deal", F.expr(f"idx div {limit}"))
    parts = stages.keep(shards.groupBy("b", "s1", "s2", "deal").applyInArrow(
        _walk(depth), "k1 long, k2 long, p1 long, p2 long, depth long, n long, conv long, bytes long, ends array<long>"),
        "parts")
    key = ["k1", "k2"]
    nodes = stages.keep(parts.groupBy(*key).agg(
        F.max("p1").alias("p1"), F.max("p2").alias("p2"), F.max("depth").alias("depth"), F.sum("n").alias("n_convs"),
        F.min("conv").alias("conv_id"), F.max("bytes").alias("bytes")), "nodes")
    ends = stages.keep(parts.where("size(ends) > 0").select(*key, F.col("ends")[0].alias("first"), "ends")
                       .repartition(*key).sortWithinPartitions(*key, "first").drop("first")
                       .mapInArrow(_digest, "k1 long, k2 long, sha string"), "ends")
    stages.drop("numbered", "convs", "lengths", "ranked", "dealt")
    kids = nodes.where("p1 is not null").groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(
        F.count(F.lit(1)).alias("n_children"))
    # the root is the parent of many: its smallest member is one number, so no join gathers them
    above = nodes.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    root = nodes.where("depth = 0").select("conv_id").first()
    named = (nodes.where("depth > 1").join(above, ["p1", "p2"]).select(*nodes.columns, "parent_conv_id")
             .union(nodes.where("depth < 2").withColumn("parent_conv_id", F.when(
                 F.col("depth") == 1, F.lit(root and root[0]).cast("long")))))
    nodes = stages.keep(named.join(kids, key, "left").select(
        *key, "p1", "p2", "depth", "conv_id", "parent_conv_id", "n_convs",
        F.coalesce("n_children", F.lit(0)).alias("n_children"),
        F.when(F.col("n_children").isNull(), 1).otherwise(0).cast("long").alias("leaves"),
        ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved")), "trie")
    return nodes.join(_subtrees(nodes, stages), key).join(ends, key, "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


ORACLE = f"""
with {CRC_TABLE},
 c as (select conv_id, list(sha256(coalesce(role, '') || chr(31) || coalesce(text, '')) order by turn nulls first) as turns,
     list(octet_length(encode(coalesce(text, ''))) order by turn nulls first) as sizes
   from conversations where conv_id is not null group by conv_id),
 k as (select c.*, conv_id - conv_id % {GROUP} as lead, ({crc_sql('conv_id::varchar')} % {HEAD})::int as h from c, crc_table),
 r as (select k.conv_id, list_concat(coalesce(l.turns[1:k.h], []), k.turns[k.h + 1:]) as turns,
     list_concat(coalesce(l.sizes[1:k.h], []), k.sizes[k.h + 1:]) as sizes from k left join c l on l.conv_id = k.lead),
 p as (select conv_id, turns, sizes, unnest(range(0, len(turns) + 1)) as depth from r),
 m as (select conv_id, depth, sha256(array_to_string(turns[1:depth], ',')) as node,
     case when depth > 0 then sha256(array_to_string(turns[1:depth - 1], ',')) end as parent,
     case when depth > 0 then sizes[depth] else 0 end as bytes, depth = len(turns) as last,
     list_transform(range(0, depth + 1), lambda d: sha256(array_to_string(turns[1:d], ','))) as path from p),
 n as (select node, depth, any_value(parent) as parent, any_value(path) as path, min(conv_id) as conv_id,
     count(*) as n_convs, any_value(bytes) * (count(*) - 1) as saved,
     sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (last), '')) as ends_sha256
   from m group by node, depth),
 kids as (select parent as node, count(*) as n_children from n group by parent),
 own as (select n.*, coalesce(n_children, 0) as n_children from n left join kids using (node)),
 sums as (select up as node, count(*) filter (n_children = 0) as n_leaves, sum(saved) as saved_tokens
   from (select unnest(path) as up, n_children, saved from own) group by up)
select o.conv_id, o.depth, u.conv_id as parent_conv_id, o.n_convs, o.n_children, n_leaves,
       saved_tokens::bigint as saved_tokens, o.ends_sha256
from own o join sums using (node) left join n u on u.node = o.parent
"""
