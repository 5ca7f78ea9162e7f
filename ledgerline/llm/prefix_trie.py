"""Prefix trie of conversations by vertical bitmaps.

``turns(conv_id, place, k1, k2, chars)`` holds each conversation's turns from
place 1 and one closing row after the last (``k1`` null).  A node is a distinct
sequence of first turns; its key is (depth, exclusive or of the 128-bit hashes
of (place, role, text) up to that depth).

*Bands and shards.*  Places are cut into bands of ``BAND`` and the rows of a
band, in the order of conv_id, into shards of about ``SHARD_ROWS`` rows that
end between conversations; so neither a very long conversation nor a very
common first turn meets in one task.  A shard indexes its rows by (place, turn)
as bitsets of its conversations, starts from the bitset of each key that
enters the band and goes down depth first: the children of a node are the
intersections of its bitset with the postings of the next place, their
popcounts are the members, and the intersection with the closing rows of that
place is the end list.  A node's parts of several shards are then added up by
key.

*Subtree sums.*  The nodes whose smallest member is c are the lower end of c's
path, so (conv_id, depth) names a node.  Each conversation adds, at every depth
of its path, what its own nodes at that depth or below are worth: sums over all
subtrees take one pass over the turns, whatever the shape of the trie.

Defined cases: a null role or text is empty; ties in turn are ordered by role
and text; a repeated row is a turn of its own; rows without a conv_id belong to
no conversation; an empty table has no nodes; texts of any length count only
as hash and code points after the first step; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, salted_rank, workers_import, written
from .sqltext import crc32

BAND = 512  # places handled by one shard at a time
SHARD_ROWS = 16_384  # rows of a shard, unless one conversation's band is longer
TURNS_PER_BUCKET = 256
KEY = ["depth", "x1", "x2"]
NO_ENDS = hashlib.sha256(b"").hexdigest()


# --- rows ------------------------------------------------------------------

def places(conversations: DataFrame) -> DataFrame:
    """``conv_id, place, role, text`` by turn (null first), from place 1."""
    rows = conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"))
    bucket = F.coalesce(F.floor(F.col("turn") / TURNS_PER_BUCKET), F.lit(-(1 << 62)))
    ranked = salted_rank(rows, ["conv_id"], ["turn", "role", "text"], bucket, None)
    return ranked.select("conv_id", F.col("rank").alias("place"), "role", "text")


def closed(rows: DataFrame, sizes: DataFrame, band: int = BAND) -> DataFrame:
    """``conv_id, place, role, text`` and ``conv_id, size`` -> the turns with
    their closing rows and the key of the path down to each row."""
    turn = rows.select("conv_id", "place", F.xxhash64("place", "role", "text").alias("k1"),
                       F.xxhash64(F.lit("second"), "place", "role", "text").alias("k2"),
                       F.length("text").cast("long").alias("chars"))
    null = F.lit(None).cast("long")
    end = sizes.select("conv_id", (F.col("size") + 1).alias("place"), null.alias("k1"), null.alias("k2"), null.alias("chars"))
    all_rows = turn.unionByName(end).withColumn("band", F.floor((F.col("place") - 1) / band))
    totals = all_rows.groupBy("conv_id", "band").agg(F.bit_xor("k1").alias("k1"), F.bit_xor("k2").alias("k2"))
    before = Window.partitionBy("conv_id").orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
    carry = (totals.select("conv_id", F.lit(0).cast("long").alias("place"), F.bit_xor("k1").over(before).alias("k1"),
                           F.bit_xor("k2").over(before).alias("k2"), null.alias("chars"), "band")
             .filter("band > 0"))  # only conversations beyond one band have any
    down = Window.partitionBy("conv_id", "band").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    keyed = all_rows.unionByName(carry).select(
        "*", F.coalesce(F.bit_xor("k1").over(down), F.lit(0)).alias("x1"), F.coalesce(F.bit_xor("k2").over(down), F.lit(0)).alias("x2"))
    return written(keyed.filter("place > 0"), "trie-turns")


# --- shards ------------------------------------------------------------------

class _Shard:
    """Rows of one band of consecutive conversations."""

    def __init__(self, first: int):
        self.first = first  # depth at which paths enter
        self.ids: list[int] = []
        self.turn: list[dict] = []  # conversation -> place -> (k1, k2)
        self.rows = 0
        self.posting: dict[tuple, int] = {}  # (place, k1, k2) -> bitset
        self.chars: dict[tuple, int] = {}
        self.going: dict[int, int] = {}  # place -> conversations with a turn there
        self.ending: dict[int, int] = {}  # depth -> conversations that end there
        self.roots: dict[tuple, int] = {}  # key entering the band -> bitset

    def add(self, conv: int, place: int, k1, k2, chars, x1: int, x2: int) -> None:
        if not self.ids or self.ids[-1] != conv:
            self.ids.append(conv)
            self.turn.append({})
            key = (x1, x2) if k1 is None else (x1 ^ k1, x2 ^ k2)
            self.roots[key] = self.roots.get(key, 0) | 1 << len(self.ids) - 1
        bit = 1 << len(self.ids) - 1
        self.rows += 1
        if k1 is None:
            self.ending[place - 1] = self.ending.get(place - 1, 0) | bit
            return
        self.turn[-1][place] = (place, k1, k2)
        post = (place, k1, k2)
        self.posting[post] = self.posting.get(post, 0) | bit
        self.chars[post] = chars
        self.going[place] = self.going.get(place, 0) | bit

    def _members(self, bits: int) -> list[int]:
        out = []
        while bits:
            low = bits & -bits
            out.append(self.ids[low.bit_length() - 1])
            bits ^= low
        return out

    def nodes(self) -> Iterator[tuple]:
        """(depth, x1, x2, parent's x1, x2, chars, members, smallest, ends)."""
        stack = []
        for (x1, x2), bits in self.roots.items():
            if self.first == 0:
                stack.append((0, x1, x2, None, None, None, bits))
            else:  # counted by the band above; only what ends or goes on is new
                stack.append((self.first, x1, x2, None, None, None, -bits))
        while stack:
            depth, x1, x2, p1, p2, chars, bits = stack.pop()
            entered = bits < 0
            bits = abs(bits)
            ends = bits & self.ending.get(depth, 0)
            if not entered or ends:
                low = bits & -bits
                yield (depth, x1, x2, p1, p2, chars, 0 if entered else bits.bit_count(), self.ids[low.bit_length() - 1],
                       self._members(ends))
            rest = bits & self.going.get(depth + 1, 0)
            while rest:
                post = self.turn[(rest & -rest).bit_length() - 1][depth + 1]
                child = rest & self.posting[post]
                rest ^= child
                stack.append((depth + 1, x1 ^ post[1], x2 ^ post[2], x1, x2, self.chars[post], child))


_PARTS = pa.schema([(n, pa.int64()) for n in ("depth", "x1", "x2", "p1", "p2", "chars", "members", "smallest", "shard")]
                   + [("ends", pa.list_(pa.int64()))])


def _emit(shard: _Shard) -> Iterator[pa.RecordBatch]:
    head = shard.ids[0]
    buffer = []
    for depth, x1, x2, p1, p2, chars, n, smallest, ends in shard.nodes():
        buffer.append((depth, x1, x2, p1, p2, chars, n, smallest, head, ends))
        if len(buffer) == 4096:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*buffer), _PARTS)], schema=_PARTS)
            buffer = []
    if buffer:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*buffer), _PARTS)], schema=_PARTS)


def shard_parts(turns: DataFrame, shard_rows: int = SHARD_ROWS, band: int = BAND) -> DataFrame:
    """Parts of the trie's nodes, one row per node and shard that holds it;
    ``shard`` is the smallest conv_id of the shard, so end lists of a node are
    in order by it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, last = None, None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                at, conv = row[0], row[1]
                if shard is None or at != last or (shard.rows >= shard_rows and conv != shard.ids[-1]):
                    if shard is not None:
                        yield from _emit(shard)
                    shard, last = _Shard(at * band), at
                shard.add(*row[1:])
        if shard is not None:
            yield from _emit(shard)

    n = partitions(turns.sparkSession)
    ordered = (turns.select("band", "conv_id", "place", "k1", "k2", "chars", "x1", "x2")
               .repartitionByRange(n, "band", "conv_id").sortWithinPartitions("band", "conv_id", "place"))
    schema = ", ".join(f"{f.name} {'array<long>' if f.name == 'ends' else 'long'}" for f in _PARTS)
    return written(ordered.mapInArrow(run, schema), "trie-parts")


# --- nodes -------------------------------------------------------------------

def merged_nodes(parts: DataFrame) -> DataFrame:
    """One row per node: key, parent's key, ``conv_id`` (smallest member),
    ``members``, ``chars`` (of the last text)."""
    merged = parts.groupBy(*KEY).agg(
        F.max("p1").alias("p1"), F.max("p2").alias("p2"), F.max("chars").alias("chars"),
        F.sum("members").alias("members"), F.min("smallest").alias("conv_id"))
    return written(merged, "trie-nodes")


def with_children(nodes: DataFrame) -> DataFrame:
    """Adds ``n_children`` and ``parent_conv_id``.  A node below its own
    conversation's has the same conv_id above it; the others, one per
    conversation at most, look their parent up."""
    kids = (nodes.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("x1"), F.col("p2").alias("x2"))
            .agg(F.count(F.lit(1)).alias("n_children")))
    tops = nodes.groupBy("conv_id").agg(F.min("depth").alias("depth"))
    heads = nodes.join(tops, ["conv_id", "depth"]).filter("depth > 0").select(
        "conv_id", "depth", (F.col("depth") - 1).alias("up_depth"), "p1", "p2")
    above = nodes.select(F.col("depth").alias("up_depth"), F.col("x1").alias("p1"), F.col("x2").alias("p2"),
                         F.col("conv_id").alias("parent_conv_id"))
    found = heads.join(above, ["up_depth", "p1", "p2"]).select("conv_id", "depth", F.col("parent_conv_id").alias("up"))
    out = nodes.join(kids, KEY, "left").join(found, ["conv_id", "depth"], "left")
    return written(out.select(
        *KEY, "conv_id", "members", "chars", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
        F.when(F.col("depth") > 0, F.coalesce("up", "conv_id")).alias("parent_conv_id")), "trie-tree")


def subtree_sums(turns: DataFrame, tree: DataFrame, band: int = BAND) -> DataFrame:
    """Key, ``n_leaves`` and ``saved_tokens`` of every node, as explained
    above: suffix sums along each path, band by band, added up by key."""
    worth = tree.select(
        "conv_id", F.col("depth").alias("place"), F.floor((F.greatest("depth", F.lit(1)) - 1) / band).alias("band"),
        F.when(F.col("depth") > 0, (F.col("members") - 1) * F.col("chars")).otherwise(0).cast("long").alias("saved"),
        (F.col("n_children") == 0).cast("long").alias("leaf"))
    zero, null = F.lit(0).cast("long"), F.lit(None).cast("long")
    path = turns.filter("k1 IS NOT NULL").select(
        "conv_id", "band", "place", F.lit(1).alias("kind"), zero.alias("saved"), zero.alias("leaf"), "x1", "x2")
    own = worth.select("conv_id", "band", "place", F.lit(0).alias("kind"), "saved", "leaf", null.alias("x1"), null.alias("x2"))
    every = path.unionByName(own)
    totals = every.groupBy("conv_id", "band").agg(F.sum("saved").alias("saved"), F.sum("leaf").alias("leaf"))
    later = Window.partitionBy("conv_id").orderBy(F.col("band").desc()).rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(
        "conv_id", "band", F.lit((1 << 63) - 1).alias("place"), F.lit(0).alias("kind"), F.sum("saved").over(later).alias("saved"),
        F.sum("leaf").over(later).alias("leaf"), null.alias("x1"), null.alias("x2")).filter("saved > 0 OR leaf > 0")
    up = (Window.partitionBy("conv_id", "band").orderBy(F.col("place").desc(), "kind")
          .rowsBetween(Window.unboundedPreceding, 0))
    shares = every.unionByName(carry).select(
        "kind", F.col("place").alias("depth"), "x1", "x2", F.sum("saved").over(up).alias("saved"), F.sum("leaf").over(up).alias("leaf"))
    below = shares.filter("kind = 1 AND (saved > 0 OR leaf > 0)").drop("kind")
    root = worth.select(zero.alias("depth"), zero.alias("x1"), zero.alias("x2"), "saved", "leaf")
    return below.unionByName(root).groupBy(*KEY).agg(F.sum("leaf").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))


def end_digests(parts: DataFrame) -> DataFrame:
    """Key and ``ends_sha256`` of the nodes where conversations end.  The end
    lists of a node pass one after the other; nothing but the digest's state
    is kept."""
    out = pa.schema([(n, pa.int64()) for n in KEY] + [("ends_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, done = None, None, []
        for batch in batches:
            keys = zip(*(batch.column(n).to_pylist() for n in KEY))
            column = batch.column("ends")
            at, flat = column.offsets.to_numpy(), column.values.to_numpy()
            for i, k in enumerate(keys):
                text = ",".join(map(str, flat[at[i]: at[i + 1]].tolist())).encode()
                if k != key:
                    if state is not None:
                        done.append((*key, state.hexdigest()))
                    key, state = k, hashlib.sha256(text)
                else:
                    state.update(b"," + text)
            if len(done) > 4096:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), out)], schema=out)
                done = []
        if state is not None:
            done.append((*key, state.hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), out)], schema=out)

    lists = parts.filter(F.size("ends") > 0).select(*KEY, "shard", "ends")
    ordered = lists.repartition(partitions(parts.sparkSession), *KEY).sortWithinPartitions(*KEY, "shard")
    return ordered.mapInArrow(run, "depth long, x1 long, x2 long, ends_sha256 string")


def trie(turns: DataFrame, shard_rows: int = SHARD_ROWS, band: int = BAND) -> tuple[DataFrame, DataFrame]:
    """(nodes, parts) of the turns that :func:`closed` made with the same
    ``band``.  ``parts`` holds the end lists per node and shard."""
    workers_import(turns.sparkSession)
    parts = shard_parts(turns, shard_rows, band)
    tree = with_children(merged_nodes(parts))
    sums = subtree_sums(turns, tree, band)
    nodes = tree.join(sums, KEY).select(
        *KEY, "conv_id", "parent_conv_id", F.col("members").alias("n_convs"), "n_children", "n_leaves", "saved_tokens")
    return nodes, parts


# --- query ---------------------------------------------------------------

FAMILY = 100  # conversations that borrow from the same one
HEAD = 6  # heads are shorter than this


def spliced(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations with borrowed heads: (rows, sizes).  At most ``FAMILY``
    conversations borrow the same at most five turns."""
    sizes = written(rows.groupBy("conv_id").agg(F.max("place").alias("size")), "trie-sizes")
    c = F.col("conv_id")
    plan = sizes.select("conv_id", "size", (c - c % FAMILY).alias("base"), (F.crc32(c.cast("string")) % HEAD).alias("head"))
    of_base = sizes.select(F.col("conv_id").alias("base"), F.col("size").alias("base_size"))
    plan = plan.join(of_base, "base", "left").select(
        "conv_id", "size", "base", "head", F.least("head", F.coalesce("base_size", F.lit(0))).alias("borrowed"))
    plan = written(plan, "trie-plan")
    lent = rows.filter(F.col("place") < HEAD).withColumnRenamed("conv_id", "base")
    first = (plan.join(lent, "base").filter(F.col("place") <= F.col("borrowed")).select("conv_id", "place", "role", "text"))
    own = (rows.join(plan.select("conv_id", "head", "borrowed"), "conv_id").filter(F.col("place") > F.col("head"))
           .select("conv_id", (F.col("place") - F.col("head") + F.col("borrowed")).alias("place"), "role", "text"))
    left = plan.select("conv_id", (F.greatest(F.col("size") - F.col("head"), F.lit(0)) + F.col("borrowed")).alias("size"))
    return first.unionByName(own), left


def op13_prefix_trie(conversations: DataFrame) -> DataFrame:
    turns = closed(*spliced(written(places(conversations), "trie-rows")))
    nodes, parts = trie(turns)
    return nodes.join(end_digests(parts), KEY, "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"))


SQL = f"""
WITH RECURSIVE c AS (
  SELECT conv_id::BIGINT AS conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place
  FROM conversations WHERE conv_id IS NOT NULL),
s AS (SELECT conv_id, max(place) AS size FROM c GROUP BY conv_id),
p AS (SELECT a.conv_id, a.size, a.base, a.head, least(a.head, coalesce(b.size, 0)) AS borrowed
  FROM (SELECT conv_id, size, conv_id - conv_id % 100 AS base, {crc32("conv_id::VARCHAR")} % 6 AS head FROM s) a
  LEFT JOIN s b ON b.conv_id = a.base),
r AS (
  SELECT p.conv_id, c.place, c.role, c.text FROM p JOIN c ON c.conv_id = p.base AND c.place <= p.borrowed
  UNION ALL
  SELECT p.conv_id, c.place - p.head + p.borrowed, c.role, c.text FROM p JOIN c ON c.conv_id = p.conv_id AND c.place > p.head),
path AS (
  SELECT conv_id, 0::BIGINT AS depth, '' AS key, 0::BIGINT AS chars, NULL::VARCHAR AS up FROM p
  UNION ALL
  SELECT r.conv_id, r.place, md5(path.key || length(r.role) || ':' || r.role || r.text), length(r.text)::BIGINT, path.key
  FROM path JOIN r ON r.conv_id = path.conv_id AND r.place = path.depth + 1),
len AS (SELECT conv_id, max(depth) AS depth FROM path GROUP BY conv_id),
n AS (SELECT depth, key, any_value(up) AS up, any_value(chars) AS chars, min(conv_id) AS conv_id, count(*) AS n_convs
  FROM path GROUP BY depth, key),
k AS (SELECT depth - 1 AS depth, up AS key, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL),
t AS (SELECT n.*, coalesce(k.n_children, 0) AS n_children FROM n LEFT JOIN k ON k.depth = n.depth AND k.key = n.key),
under AS (
  SELECT path.depth, path.key, sum(CASE WHEN t.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves,
    sum(CASE WHEN t.depth > 0 THEN (t.n_convs - 1) * t.chars ELSE 0 END) AS saved_tokens
  FROM path JOIN t ON t.conv_id = path.conv_id AND t.depth >= path.depth GROUP BY ALL),
e AS (SELECT path.depth, path.key, string_agg(len.conv_id::VARCHAR, ',' ORDER BY len.conv_id) AS ends
  FROM path JOIN len ON len.conv_id = path.conv_id AND len.depth = path.depth GROUP BY ALL)
SELECT t.conv_id, t.depth, above.conv_id AS parent_conv_id, t.n_convs::BIGINT AS n_convs, t.n_children::BIGINT AS n_children,
  under.n_leaves::BIGINT AS n_leaves, under.saved_tokens::BIGINT AS saved_tokens, sha256(coalesce(e.ends, '')) AS ends_sha256
FROM t LEFT JOIN n above ON above.depth = t.depth - 1 AND above.key = t.up
JOIN under ON under.depth = t.depth AND under.key = t.key
LEFT JOIN e ON e.depth = t.depth AND e.key = t.key
"""
