"""A trie of conversations' prefixes by ROLLUP over positional columns of turn ids.

A conversation becomes rows of WIDTH turns, one per block, with a column per position. ``GROUP BY block, prior node,
ROLLUP(t1, ..., tWIDTH)`` makes every prefix that ends in a block a group, and the grouping id tells its length; the
prior node is the one in which the block before ended. A turn's id is two 64-bit hashes of its position and of the
SHA-256 of role and text, and a node's id is the exclusive or of its turns' ids: so every block knows its prior node
without waiting for the blocks before, and all blocks of all conversations are rolled up at once.

What is summed over a node's subtree is not passed up level by level. Each node's share is booked on its smallest
member; a member's shares from some depth on lie all below its node of that depth, so a second ROLLUP sums them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shared import store
from .structure import in_chunks

#: Turns of a block.
WIDTH = 8
#: Conversations share the first turns of the one whose id is the greatest multiple of FAMILY so far, fewer than HEADS.
FAMILY, HEADS = 5, 9
#: Blocks of a conversation that one window holds; their sums are scanned before.
SCANNED = 1024
#: Ids are listed in pieces of so many.
PIECE = 4096

_POSITIONS = range(1, WIDTH + 1)


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, chunk, pos (from 1, by turn, null first), kind, bytes; stored. Rows are sorted in ranges that may part a
    conversation. A chunk's rows of a conversation are numbered in a window, and only what continues a conversation from
    the chunk before, at most one row per chunk, is broadcast."""
    filled = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")])
    sorted_rows = in_chunks(filled, ["conv_id", F.octet_length("text").cast("long").alias("bytes")])
    placed = store(sorted_rows.withColumns({"chunk": F.spark_partition_id(), "place": F.monotonically_increasing_id()}), "trie-turns")
    counts = placed.groupBy("conv_id", "chunk").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("conv_id", "chunk", before.alias("before")).where("before > 0")
    first = F.min("place").over(Window.partitionBy("conv_id", "chunk"))
    pos = F.col("place") - F.col("first") + 1 + F.coalesce("before", F.lit(0))
    return placed.withColumn("first", first).join(F.broadcast(offsets), ["conv_id", "chunk"], "left").select("conv_id", "chunk", pos.alias("pos"), F.col("__kind").alias("kind"), "bytes")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conversations: conv_id, length; turns: conv_id, pos, kind, bytes, length) after each conversation's first turns
    have given way to those of its family's head."""
    sizes = turns.groupBy("conv_id", "chunk").agg(F.count(F.lit(1)).alias("n"))
    heads = turns.where(F.col("pos") < HEADS).groupBy(F.col("conv_id").alias("head")).agg(F.sort_array(F.collect_list(F.struct("pos", "kind", "bytes"))).alias("turns"))
    shared = (F.crc32(F.col("conv_id").cast("string")) % HEADS).cast("int")
    convs = sizes.groupBy("conv_id").agg(F.sum("n").alias("n")).withColumns({"shared": shared, "head": F.col("conv_id") - F.col("conv_id") % FAMILY})
    convs = convs.join(heads, "head", "left").withColumn("turns", F.slice(F.coalesce("turns", F.array()), F.lit(1), F.col("shared")))
    convs = convs.withColumn("given", F.size("turns")).withColumn("length", F.col("given") + F.greatest(F.lit(0), F.col("n") - F.col("shared")))
    convs = store(convs.select("conv_id", "turns", "shared", "given", "length"), "trie-conversations")
    parts = sizes.select("conv_id", "chunk").join(convs.select("conv_id", "given", "length"), "conv_id")
    own = turns.where(F.col("pos") > shared).join(parts, ["conv_id", "chunk"])
    own = own.select("conv_id", (F.col("pos") - shared + F.col("given")).alias("pos"), "kind", "bytes", "length")
    given = convs.select("conv_id", F.explode("turns").alias("t"), "length").select("conv_id", "t.*", "length")
    return convs.select("conv_id", "length"), given.unionByName(own)


def scanned(blocks: DataFrame, aggregate, columns: dict[str, str], back: bool) -> DataFrame:
    """``blocks`` (conv_id, block, ...) with, for each of ``columns``, the aggregate of all earlier (later, if ``back``)
    blocks of its conversation under a new name. Two levels: sums of SCANNED blocks, then the blocks within, so that no
    window holds more than those, or a conversation's SCANNED-th part."""
    x = blocks.withColumn("__s", F.floor(F.col("block") / SCANNED))
    order = lambda c: F.col(c).desc() if back else F.col(c)
    earlier = lambda keys, c: Window.partitionBy(*keys).orderBy(order(c)).rowsBetween(Window.unboundedPreceding, -1)
    sums = x.groupBy("conv_id", "__s").agg(*[aggregate(c).alias(f"__{c}") for c in columns])
    sums = sums.select("conv_id", "__s", *[aggregate(f"__{c}").over(earlier(["conv_id"], "__s")).alias(f"__{c}") for c in columns])
    x = x.join(sums, ["conv_id", "__s"])
    both = {}
    for c, new in columns.items():
        before, within = (F.coalesce(v, F.lit(0)) for v in (F.col(f"__{c}"), aggregate(c).over(earlier(["conv_id", "__s"], "block"))))
        both[new] = before.bitwiseXOR(within) if aggregate is F.bit_xor else before + within
    return x.withColumns(both).drop("__s", *[f"__{c}" for c in columns])


def blocks_of(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """conv_id, block, length, p1, p2 (the prior node), x1, x2 (what the block adds to it), t1 ... tWIDTH; stored.
    Every conversation has a block 0, turnless ones an empty one."""
    spot = F.col("pos") - 1
    ids = {"block": F.floor(spot / WIDTH), "k": spot % WIDTH + 1, "h1": F.xxhash64("kind", "pos", F.lit(1)), "h2": F.xxhash64("kind", "pos", F.lit(2))}
    none = F.lit(None).cast("long")
    rows = turns.withColumns(ids).select("conv_id", "block", "length", "k", "h1", "h2", "bytes")
    rows = rows.unionByName(convs.select("conv_id", F.lit(0).cast("long").alias("block"), "length", *[none.alias(c) for c in ("k", "h1", "h2", "bytes")]))
    own = [F.max(F.when(F.col("k") == k, F.col(c))).alias(f"{c}_{k}") for k in _POSITIONS for c in ("h1", "h2", "bytes")]
    wide = rows.groupBy("conv_id", "block", "length").agg(*[F.coalesce(F.bit_xor(h), F.lit(0)).alias(x) for h, x in (("h1", "x1"), ("h2", "x2"))], *own)
    turn = lambda k: F.when(F.col(f"h1_{k}").isNotNull(), F.struct(*[F.col(f"{c}_{k}").alias(c) for c in ("h1", "h2", "bytes")])).alias(f"t{k}")
    wide = store(wide.select("conv_id", "block", "length", "x1", "x2", *map(turn, _POSITIONS)), "trie-wide")
    short = wide.where(F.col("length") <= WIDTH).withColumns({"p1": F.lit(0).cast("long"), "p2": F.lit(0).cast("long")})
    return store(short.unionByName(scanned(wide.where(F.col("length") > WIDTH), F.bit_xor, {"x1": "p1", "x2": "p2"}, back=False)), "trie-blocks")


def rolled_up(blocks: DataFrame, sums: dict[str, str]) -> DataFrame:
    """A row per prefix that ends in a block: block, k (its turns there), n1, n2 (its node), h1, h2, bytes (its last turn),
    depth, conv_id (the smallest member), n_convs, n_ends, and ``sums``. Prefixes of no turns of their block have k = 0:
    the root, and once more what blocks after the first begin with."""
    names = [f"t{k}" for k in _POSITIONS]
    node = lambda p, h: " ^ ".join([p, *[f"coalesce({t}.{h}, 0)" for t in names]])
    more = "".join(f", {x} AS {name}" for name, x in sums.items())
    out = blocks.sparkSession.sql(
        f"""SELECT block, {WIDTH} - bit_count(grouping_id()) AS k, {node('p1', 'h1')} AS n1, {node('p2', 'h2')} AS n2, array({', '.join(names)}) AS ts,
                   min(conv_id) AS conv_id, count(*) AS n_convs, count_if(length = {WIDTH} * block + {WIDTH} - bit_count(grouping_id())) AS n_ends{more}
            FROM {{blocks}} GROUP BY block, p1, p2, ROLLUP({', '.join(names)})""",
        blocks=blocks,
    )
    last = F.get("ts", F.col("k") - 1)  # null where the conversation ends before
    return out.where((F.col("k") == 0) | last.isNotNull()).select("*", last.alias("last"), (WIDTH * F.col("block") + F.col("k")).alias("depth")).select("*", "last.*").drop("ts", "last")


def booked(blocks: DataFrame, nodes: DataFrame) -> DataFrame:
    """``blocks`` with what is booked on each conversation as the smallest member of nodes: v1 ... vWIDTH (saved tokens of its
    nodes in the block), later (of its nodes in later blocks), first (the first depth of the block at which it is the
    smallest member, null if none) and leaf (1 if its last node has no child)."""
    k = F.col("k")
    real = nodes.where((k > 0) | (F.col("block") == 0))
    saved = (F.col("n_convs") - 1) * F.coalesce("bytes", F.lit(0))
    leaf = F.max((F.col("n_ends") == F.col("n_convs")).cast("long")).alias("ends")
    own = real.groupBy("conv_id", "block").agg(*[F.sum(F.when(k == i, saved)).alias(f"v{i}") for i in _POSITIONS], F.min("depth").alias("first"), leaf)
    x = blocks.join(own, ["conv_id", "block"], "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in [*[f"v{i}" for i in _POSITIONS], "ends"]})
    x = store(x.withColumn("own", sum((F.col(f"v{i}") for i in _POSITIONS), F.lit(0))), "trie-booked")
    short = x.where(F.col("length") <= WIDTH).withColumns({"later": F.lit(0).cast("long"), "ends_later": F.lit(0).cast("long")})
    long = scanned(x.where(F.col("length") > WIDTH), F.sum, {"own": "later", "ends": "ends_later"}, back=True)
    return short.unionByName(long).withColumn("leaf", F.col("ends") + F.col("ends_later"))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(n1, n2, piece, ids) sorted by node and piece to (n1, n2, ends_sha256), a piece at a time."""

    def rows():
        for batch in batches:
            yield from zip(*[c.to_pylist() for c in batch.columns], strict=True)

    out = []
    for node, pieces in groupby(rows(), key=lambda r: r[:2]):
        digest = hashlib.sha256()
        for k, piece in enumerate(pieces):
            digest.update(b"," * bool(k) + piece[3].encode())
        out.append((*node, digest.hexdigest()))
        if len(out) == 4096:
            yield _digest_batch(out)
            out = []
    if out:
        yield _digest_batch(out)


def _digest_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.string()), strict=True)], ["e1", "e2", "ends_sha256"])


def ends_of(blocks: DataFrame) -> DataFrame:
    """e1, e2, ends_sha256: for each node in which conversations end, the digest of their ids in ascending order. Ids are
    joined in pieces of at most PIECE, and a node's pieces pass through one task one after the other."""
    last = F.floor(F.greatest(F.lit(0), F.col("length") - 1) / WIDTH)
    final = blocks.where(F.col("block") == last).select("conv_id", F.col("p1").bitwiseXOR(F.col("x1")).alias("n1"), F.col("p2").bitwiseXOR(F.col("x2")).alias("n2"))
    ids = F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",")
    pieces = final.groupBy("n1", "n2", F.floor(F.col("conv_id") / PIECE).alias("piece")).agg(ids.alias("ids"))
    return pieces.repartition("n1", "n2").sortWithinPartitions("n1", "n2", "piece").mapInArrow(_digests, "e1 long, e2 long, ends_sha256 string")


def trie(conversations: DataFrame) -> DataFrame:
    """The nodes of all prefixes of the rebuilt conversations: conv_id (the smallest member), depth, parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens, ends_sha256, and the node's id n1, n2.

    ``conversations``: conv_id, turn, role, text; others, of whatever name, aren't read. Turns are ordered by turn, null
    first; equal turns by role, then text (by their first 64 characters, then a digest). Null role or text counts as
    empty; rows without conv_id belong to no conversation and are left out. A conversation whose turns all give way to
    fewer ones may be turnless and ends in the root. Repeated rows are turns of their own. An empty table gives no node.
    Texts are only hashed, so very long ones cost no more later on.
    """
    convs, turns = rebuilt(numbered_turns(conversations))
    blocks = blocks_of(convs, turns)
    first = store(rolled_up(blocks, {}), "trie-prefixes")
    known = booked(blocks, first)
    from_on = lambda k: " + ".join(["later", *[f"v{i}" for i in range(max(k, 1), WIDTH + 1)]])
    smallest = lambda k: f"CASE WHEN first <= {WIDTH} * block + {k} AND {WIDTH} * block + {k} <= length THEN 1 ELSE 0 END"
    pick = lambda of, upto: "CASE " + " ".join(f"WHEN bit_count(grouping_id()) = {WIDTH - k} THEN sum({of(k)})" for k in range(upto + 1)) + " ELSE 0 END"
    found = rolled_up(known, {"saved_tokens": pick(from_on, WIDTH), "n_children": pick(lambda k: smallest(k + 1), WIDTH - 1), "n_leaves": "sum(leaf)"})
    # a node at the end of a block has its children in the next one, where it is the prefix of no turns
    border = (F.col("depth") % WIDTH == 0) & (F.col("depth") > 0)
    kept = [c for c in found.columns if c not in ("block", "k", "n_ends", "n_children")]
    found = store(found, "trie-found")
    joined = found.where(border).groupBy("n1", "n2").agg(*[F.max(F.when(F.col("k") > 0, F.col(c))).alias(c) for c in kept if c not in ("n1", "n2")], F.sum(F.when(F.col("k") == 0, F.col("n_children")).otherwise(0)).alias("n_children"))
    nodes = store(found.where(~border).select(*kept, "n_children").unionByName(joined), "trie-nodes")
    parents = nodes.select(F.col("n1").alias("q1"), F.col("n2").alias("q2"), F.col("conv_id").alias("parent_conv_id"))
    children = nodes.withColumns({"q1": F.col("n1").bitwiseXOR(F.col("h1")), "q2": F.col("n2").bitwiseXOR(F.col("h2"))})
    out = children.join(parents, ["q1", "q2"], "left").join(ends_of(blocks), (F.col("n1") == F.col("e1")) & (F.col("n2") == F.col("e2")), "left")
    nothing = F.sha2(F.lit("").cast("binary"), 256)
    long = lambda c: F.col(c).cast("long").alias(c)
    return out.select("conv_id", long("depth"), "parent_conv_id", "n_convs", long("n_children"), long("n_leaves"), long("saved_tokens"), F.coalesce("ends_sha256", nothing).alias("ends_sha256"), "n1", "n2")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trie of all ``conversations``."""
    return trie(spark.read.parquet(f"{sf_dir}/conversations.parquet")).drop("n1", "n2")


SQL = r"""
WITH turns AS (
  SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)),
convs AS (
  SELECT conv_id, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
                                  lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 9 AS h
  FROM (SELECT DISTINCT conv_id FROM turns)),
rebuilt AS (
  SELECT c.conv_id, 0 AS part, t.pos, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.conv_id - c.conv_id % 5 AND t.pos <= h
  UNION ALL SELECT c.conv_id, 1, t.pos, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.pos > h),
placed AS (
  SELECT conv_id, row_number() OVER w AS depth, strlen(text) AS bytes, md5(string_agg(md5(role) || md5(text), ',') OVER w) AS node FROM rebuilt WINDOW w AS (PARTITION BY conv_id ORDER BY part, pos)),
paths AS (
  SELECT conv_id, depth, bytes, node FROM placed UNION ALL SELECT conv_id, 0, 0, '' FROM convs),
steps AS (
  SELECT *, lag(node) OVER w AS parent, row_number() OVER (PARTITION BY conv_id ORDER BY depth DESC) = 1 AS ends FROM paths WINDOW w AS (PARTITION BY conv_id ORDER BY depth)),
nodes AS (
  SELECT node, depth, min(conv_id) AS conv_id, count(*) AS n_convs, max(bytes) AS bytes, max(parent) AS parent,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM steps GROUP BY node, depth),
family AS (
  SELECT n.*, coalesce(k.n, 0) AS n_children FROM nodes n LEFT JOIN (SELECT parent, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY parent) k ON k.parent = n.node),
below AS (
  SELECT p.node, sum((v.n_convs - 1) * v.bytes) AS saved, count(*) FILTER (v.n_children = 0) AS leaves FROM family v JOIN paths p ON p.conv_id = v.conv_id AND p.depth <= v.depth GROUP BY p.node)
SELECT n.conv_id, n.depth::BIGINT AS depth, q.conv_id AS parent_conv_id, n.n_convs, n.n_children, b.leaves AS n_leaves, b.saved::BIGINT AS saved_tokens, n.ends_sha256
FROM family n JOIN below b ON b.node = n.node LEFT JOIN nodes q ON n.depth > 0 AND q.node = n.parent
"""
