r"""Prefix trie of conversations, rolled up in bands of depth.

A node is a distinct sequence of first turns (role, text) of the
conversations, from the textless root down; its members are the
conversations that start with it. ``trie`` gives a row per node: smallest
member, parent, number of members and children, and over its subtree the
leaves and the bytes that sharing saves. ``with_heads`` first gives the
conversations of a family a common beginning: the first turns of the family's
first conversation take the place of their own.

Keys: turns are read in order, conversation after conversation, in one pass
over sorted rows that holds one band of keys; a node's key is a 128-bit hash
chained from its parent's. Texts are hashed before they are shuffled.

Subtree totals: depth is cut into bands of ``BAND`` levels. A node adds its
own values to its ancestors within its band only (at most ``BAND`` rows a
node). The bands' roots, now with the totals of their bands, form a tree that
is ``BAND`` times less deep and is treated alike, until one band holds all.
Then the completed totals of band roots go down, to the ancestors in the band
above each (again at most ``BAND`` rows a root). So a trie of depth n takes
2 log n rounds, and no row grows with the depth.

Members that end at a node are listed in its digest: ids are put in blocks of
``ID_BLOCK`` neighbouring ids, each a row, and the blocks of a node are hashed
in order as they stream by, so that a node where a third of all conversations
end holds no list.

Defined results: turns are ordered by (turn, role, hash of the text), nulls
first; null roles and texts are empty; repeated rows are turns of their own;
rows without a conv_id belong to no conversation and are left out; negative
ids have the remainder's sign of SQL; further columns are not read; an empty
table has no nodes. A conversation's turns pass through one task as a stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, table

#: Levels of a band; neighbouring ids of a digest's block: 2 ** ID_BITS; bytes of a key.
BAND, ID_BITS, KEY = 8, 12, 16
#: Conversations of a family, and the modulus that says how many turns of its head one takes.
FAMILY, HEAD_MOD = 5, 9
ROOT = bytes(KEY)
FLUSH = 8192

_NODE = pa.schema([("key", pa.binary()), ("depth", pa.int64()), ("ups", pa.list_(pa.binary())), ("bytes", pa.int64()), ("conv_id", pa.int64()), ("is_end", pa.bool_())])
NODE_DDL = "key binary, depth long, ups array<binary>, bytes long, conv_id long, is_end boolean"


class Walk:
    """The path from the root to the turn just read: of each level of bands, the keys since its last boundary."""

    def __init__(self, band: int):
        self.band, self.key, self.depth, self.paths = band, ROOT, 0, [[ROOT]]

    def step(self, role: bytes, digest: bytes) -> tuple[bytes, int, list[bytes]]:
        """Key, depth and, for each level of bands on which the node lies, its ancestors back to the boundary before it."""
        self.key = hashlib.sha256(self.key + len(role).to_bytes(4, "big") + role + digest).digest()[:KEY]
        self.depth += 1
        ups, unit, level = [], 1, 0
        while self.depth % unit == 0:
            if level == len(self.paths):
                self.paths.append([ROOT])
            path = self.paths[level]
            ups.append(b"".join(path))
            if self.depth % (unit * self.band) == 0:
                self.paths[level] = [self.key]
            else:
                path.append(self.key)
            unit, level = unit * self.band, level + 1
        return self.key, self.depth, ups


def turn_rows(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, digest (of the text), bytes (of the text)."""
    words = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    text = words("text").cast("binary")
    return rows.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        words("role").cast("binary").alias("role"),
        F.unhex(F.sha2(text, 256)).alias("digest"),
        F.octet_length(text).cast("long").alias("bytes"),
    )


def members(turns: DataFrame, band: int = BAND) -> DataFrame:
    """turns: as turn_rows gives them, with family and head. A row for each conversation and node that it is a member of.

    family: the conversation whose first turns stand before the own turns; head: how many of them, in place of as many own ones.
    """

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        family = conv = path = None
        head: list[tuple] = []
        own = skip = longest = 0

        def visit(role, digest, size):
            out.append((*path.step(role, digest), size, conv, False))

        for batch in batches:
            columns = (batch.column(n).to_pylist() for n in ("family", "conv_id", "head", "longest", "role", "digest", "bytes"))
            for fam, c, n_head, most, role, digest, size in zip(*columns):
                if fam != family:
                    family, head = fam, []
                if c != conv:
                    if out:
                        out[-1] = (*out[-1][:-1], True)
                        if len(out) >= FLUSH:
                            yield _batch(out)
                            out = []
                    conv, path, own, skip, longest = c, Walk(band), 0, 0 if c == fam else n_head, most
                    out.append((ROOT, 0, [], 0, conv, False))
                    for turn in head[:skip]:
                        visit(*turn)
                if c == fam and own < longest:
                    head.append((role, digest, size))
                if own >= skip:
                    visit(role, digest, size)
                own += 1
                if len(out) >= FLUSH:  # all but the last: whether it is an end is not known yet
                    yield _batch(out[:-1])
                    out = out[-1:]
        if out:
            out[-1] = (*out[-1][:-1], True)
            yield _batch(out)

    base_last = (F.col("conv_id") != F.col("family")).alias("other")
    order = ["family", "other", "conv_id", F.asc_nulls_first("turn"), "role", "digest"]
    return turns.select("*", base_last).repartition("family").sortWithinPartitions(*order).mapInArrow(walk, NODE_DDL)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), _NODE)], schema=_NODE)


def with_heads(turns: DataFrame) -> DataFrame:
    """family: conv_id less its remainder by FAMILY. head: crc32 of the id as text, modulo HEAD_MOD. longest: the most that any takes."""
    c = F.col("conv_id")
    return turns.select("*", (c - c % FAMILY).alias("family"), (F.crc32(c.cast("string").cast("binary")) % HEAD_MOD).cast("int").alias("head"), F.lit(HEAD_MOD - 1).alias("longest"))


def without_heads(turns: DataFrame) -> DataFrame:
    """Every conversation as it is."""
    return turns.select("*", F.col("conv_id").alias("family"), F.lit(0).alias("head"), F.lit(0).alias("longest"))


def keys_of(joined: Column) -> Column:
    """The keys of a run of joined keys."""
    return F.transform(F.sequence(F.lit(1), F.octet_length(joined).cast("int"), F.lit(KEY)), lambda at: F.substring(joined, at, F.lit(KEY)))


def subtree_totals(nodes: DataFrame, values: list[str], band: int = BAND) -> DataFrame:
    """nodes: key, depth, ups and the values' columns. Returns key and, of each value, its sum over the node's subtree."""
    sums = [F.sum(v).alias(v) for v in values]
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    level, unit, own = 0, 1, nodes.select("key", "depth", "ups", *values)
    partial, roots = [], []
    while True:
        # to the ancestors within the band: none for a band's root
        in_band = F.when((F.col("depth") / unit).cast("long") % band != 0, keys_of(F.get("ups", F.lit(level)))).otherwise(F.array())
        rows = own.select(F.explode(F.concat(F.array("key"), in_band)).alias("key"), *values)
        partial.append(materialise(rows.groupBy("key").agg(*sums)))
        unit, level = unit * band, level + 1
        if deepest < unit:
            break
        roots.append(nodes.where(F.col("depth") % unit == 0).select("key", "depth", "ups"))
        own = materialise(roots[-1].join(partial[-1], "key"))
    total = partial.pop()
    while partial:
        level -= 1
        below = roots.pop().where("depth > 0").join(total, "key")
        given = below.select(F.explode(keys_of(F.get("ups", F.lit(level - 1)))).alias("key"), *values)
        total = materialise(partial.pop().unionByName(given).groupBy("key").agg(*sums))
    return total


def end_digests(ends: DataFrame) -> DataFrame:
    """ends: key, conv_id. Returns key and ends_sha256 of the ids, ascending, as text with commas between."""
    block = F.shiftright("conv_id", ID_BITS).alias("block")
    ids = F.array_sort(F.collect_list("conv_id"))
    blocks = ends.groupBy("key", block).agg(F.array_join(F.transform(ids, lambda i: i.cast("string")), ",").alias("ids"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            keys, digests = [], []
            for k, text in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist()):
                if k != key:
                    if key is not None:
                        keys.append(key)
                        digests.append(state.hexdigest())
                    key, state = k, hashlib.sha256(text.encode())
                else:
                    state.update(b"," + text.encode())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(digests, pa.string())], names=["key", "ends_sha256"])
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([state.hexdigest()])], names=["key", "ends_sha256"])

    return blocks.repartition("key").sortWithinPartitions("key", "block").select("key", "ids").mapInArrow(digest, "key binary, ends_sha256 string")


def trie(turns: DataFrame, band: int = BAND) -> DataFrame:
    """turns: with family and head. A row for each node."""
    visits = materialise(members(turns, band))
    # depth, ups and bytes follow from the key
    found = visits.groupBy("key", "depth", "ups", "bytes").agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"))
    nodes = materialise(found.withColumn("parent", F.substring(F.get("ups", F.lit(0)), F.lit(-KEY), F.lit(KEY))))
    children = nodes.where("depth > 0").groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("n_children"))
    whole = nodes.join(children, "key", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    whole = materialise(whole.withColumns({"n_leaves": (F.col("n_children") == 0).cast("long"), "saved_tokens": (F.col("n_convs") - 1) * F.col("bytes")}))
    totals = subtree_totals(whole, ["n_leaves", "saved_tokens"], band)
    above = nodes.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    ends = end_digests(visits.where("is_end").select("key", "conv_id"))
    out = whole.drop("n_leaves", "saved_tokens").join(totals, "key").join(ends, "key", "left").join(above, "parent", "left")
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", F.col("n_children").cast("long").alias("n_children"), "n_leaves", "saved_tokens", F.coalesce("ends_sha256", none).alias("ends_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op12: the trie of all conversations, rebuilt with the heads of their families."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return trie(with_heads(turn_rows(rows)))


#: crc32 bit by bit: each byte of the text is mixed in, then eight shifts (marked -1).
_CRC = """xor(list_reduce(flatten(list_prepend([4294967295::bigint],
    list_transform(string_split(conv_id::varchar, ''), lambda x: [ascii(x)::bigint, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda a, x: case when x >= 0 then xor(a, x) when a & 1 = 1 then xor(a >> 1, 3988292384::bigint) else a >> 1 end), 4294967295::bigint)"""

SQL = f"""
with t as (
  select conv_id, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) as said, strlen(coalesce(text, '')) as bytes,
    row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), sha256(coalesce(text, ''))) - 1 as k
  from conversations where conv_id is not null
), c as (
  select conv_id, conv_id - conv_id % {FAMILY} as family, {_CRC} % {HEAD_MOD} as h from (select distinct conv_id from t)
), rebuilt as (
  select c.conv_id, 0 as part, t.k, t.said, t.bytes from c join t on t.conv_id = c.family and t.k < c.h
  union all select c.conv_id, 1, t.k, t.said, t.bytes from c join t using (conv_id) where t.k >= c.h
), lists as (
  select c.conv_id, coalesce(list(said order by part, k) filter (said is not null), []) as said, coalesce(list(bytes order by part, k) filter (said is not null), []) as bytes
  from c left join rebuilt using (conv_id) group by 1
), visits as (
  select conv_id, d as depth, len(said) = d as is_end, sha256(array_to_string(said[1:d], ',')) as key,
    case when d > 0 then sha256(array_to_string(said[1:d - 1], ',')) end as parent, case when d > 0 then bytes[d] else 0 end as bytes
  from (select *, unnest(range(len(said) + 1)) as d from lists)
), nodes as (
  select key, depth, any_value(parent) as parent, min(conv_id) as conv_id, count(*) as n_convs, (count(*) - 1) * any_value(bytes) as saved,
    sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (is_end), '')) as ends_sha256
  from visits group by 1, 2
), kids as (
  select parent as key, count(*) as n from nodes where parent is not null group by 1
), below as (
  select distinct a.key as top, b.key from visits a join visits b on a.conv_id = b.conv_id and a.depth <= b.depth
), totals as (
  select top as key, count(*) filter (kids.n is null) as n_leaves, sum(saved)::bigint as saved_tokens
  from below join nodes using (key) left join kids using (key) group by 1
)
select n.conv_id, n.depth, p.conv_id as parent_conv_id, n.n_convs, coalesce(kids.n, 0) as n_children, n_leaves, saved_tokens, n.ends_sha256
from nodes n join totals using (key) left join kids using (key) left join nodes p on p.key = n.parent
"""
