"""SimHash near-duplicates over a Gray-order hierarchical index.

Fingerprints: 64 bits, each the majority of that bit over the XXH64 hashes
of a text's 3-word shingles. Two fingerprints link if they differ in at most
``MAX_DISTANCE`` bits; linked documents, directly or through others, form a
group, named by its smallest doc_id.

Search works on distinct fingerprints, so exact copies cost one row. To
divide the work, each fingerprint goes to the bucket of each of its
``MAX_DISTANCE + 1`` equal parts: two that link agree in at least one part.
Buckets of all sizes are searched by a hierarchical index (``Index``), one
over all the buckets of a part that a task reads at a time: fingerprints are
sorted by the Gray rank of the bucket's bits, then by their own, so that
neighbours differ in few bits; every node over a run of them holds the bits
that all its fingerprints share, as a mask and a pattern, without those that
its parent holds already. So the upper nodes hold the buckets' bits, in
which nothing may differ, and a search from the root leaves a whole group
where these differ, or as soon as the differences that it has added up on
each node's own bits pass the distance.

A bucket of more than ``BLOCK`` fingerprints is divided again, by the parts
of its other bits; what is still larger is cut into blocks by hash, and each
pair of its blocks is one search. So no task holds a hot bucket, and no link
is lost.

Each search gives a spanning forest of its links instead of all pairs: a
link between fingerprints already joined adds nothing to the groups. The
groups follow by large-star and small-star steps, each a join and an
aggregation over links, written to the shared folder after each round.

Defined results: texts without words (null, empty) have fingerprint zero and
link like any other; a text of one or two words is one shingle; rows that
repeat a doc_id are members on their own, and where one of them is to stay it
is the one with the smallest hash of its whole row; a null doc_id never names a group
unless all its members have none (then null); an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import annotate, free_name, materialise, table

SHINGLE, SEED, MAX_DISTANCE = 3, 42, 3
#: Most fingerprints of a bucket or of a block of one, children of a node of the index, fingerprints of an index over buckets.
BLOCK, FANOUT, SEARCH_ROWS = 4096, 8, 1 << 16
#: Numbers of buckets of the second division start here.
AGAIN = 1 << 48
#: Shingles whose bits are counted at once, and frontier pairs of a search step.
CHUNK = 1 << 15


def fingerprint(text: str | None, size: int = SHINGLE, seed: int = SEED) -> int:
    """Unsigned; 0 for a text without words."""
    from xxhash import xxh64_intdigest

    words = text.encode().lower().split() if text else []  # bytes: A-Z and the six white-space characters only
    if not words:
        return 0
    if len(words) < size:
        return xxh64_intdigest(b" ".join(words), seed)
    join = b" ".join
    shingles = zip(*(words[k:] for k in range(size)))
    ones, n = np.zeros(64, dtype=np.int64), len(words) - size + 1
    hashes = np.fromiter((xxh64_intdigest(join(s), seed) for s in shingles), dtype=np.uint64, count=n)
    for k in range(0, n, CHUNK):
        ones += np.unpackbits(hashes[k : k + CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def with_fingerprint(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> tuple[DataFrame, str]:
    """docs and the fingerprint of each text as a signed long; the new column's name."""

    def make():
        return lambda texts: [pa.array(np.array([fingerprint(t, shingle, seed) for t in texts.to_pylist()], dtype=np.uint64).view(np.int64), pa.int64())]

    name = free_name(docs, "fingerprint")
    return annotate(docs.withColumn("text", F.col("text").cast("string")), ["text"], f"{name} bigint", make), name


def gray_rank(values: np.ndarray) -> np.ndarray:
    """The rank of each value in the Gray code's order (the code's inverse)."""
    out = values.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        out ^= out >> np.uint64(shift)
    return out


class Index:
    """Hierarchical index over fingerprints in Gray order; levels from the leaves (single values) to the root.

    A level holds, for each node, the bits that its group shares but its
    parent's group does not (mask), and their pattern.
    """

    def __init__(self, values: np.ndarray, fanout: int = FANOUT):
        self.values, self.fanout = values, fanout
        #: Of all searches: groups left by a query as a whole, and single values met.
        self.groups_left = self.values_met = 0
        alike, pattern = [np.full(len(values), ~np.uint64(0))], [values]
        while len(pattern[-1]) > 1:
            starts = np.arange(0, len(pattern[-1]), fanout)
            ones = np.bitwise_and.reduceat(pattern[-1] & alike[-1], starts)
            zeros = np.bitwise_and.reduceat(~pattern[-1] & alike[-1], starts)
            alike.append(ones | zeros)
            pattern.append(ones)
        masks = [a & ~np.repeat(b, fanout)[: len(a)] for a, b in zip(alike, alike[1:])] + [alike[-1]]
        self.levels = [(m, p & m) for m, p in zip(masks, pattern)][::-1]
        self.top = int(alike[-1][0]), int(pattern[-1][0])

    def search(self, queries: np.ndarray, distance: int, after: np.ndarray | None = None, exact: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query, value) positions within the distance. after: a query sees only values at its own position there or later. exact: of each query, bits in which nothing may differ."""
        step = max(1, CHUNK // self.fanout)
        for low in range(0, len(queries), step):
            yield from self._descend(0, np.arange(low, min(low + step, len(queries))), None, queries, distance, after, exact)

    def _descend(self, level, q, state, queries, distance, after, exact):
        mask, pattern = self.levels[level]
        if state is None:
            node, so_far = np.zeros(len(q), dtype=np.int64), np.zeros(len(q), dtype=np.uint8)
        else:
            node, so_far = state
        differ = (queries[q] ^ pattern[node]) & mask[node]
        so_far = so_far + np.bitwise_count(differ)
        keep = so_far <= distance
        if exact is not None:
            keep &= (differ & exact[q]) == 0
        height = len(self.levels) - 1 - level  # a node covers fanout ** height values
        if height:
            self.groups_left += int((~keep).sum())
        else:
            self.values_met += len(keep)
        if after is not None:
            keep &= (node + 1) * self.fanout**height > after[q]
        q, node, so_far = q[keep], node[keep], so_far[keep]
        if not height:
            if len(q):
                yield q, node
            return
        below = len(self.levels[level + 1][0])
        step = max(1, CHUNK // self.fanout) * 4  # groups are opened a bounded number at a time
        for k in range(0, len(q), step):
            child = (node[k : k + step, None] * self.fanout + np.arange(self.fanout)).ravel()
            inside = child < below
            again = np.repeat(q[k : k + step], self.fanout)[inside]
            yield from self._descend(level + 1, again, (child[inside], np.repeat(so_far[k : k + step], self.fanout)[inside]), queries, distance, after, exact)


class Forest:
    """Union-find over positions, fed with arrays of links."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def roots(self, x: np.ndarray) -> np.ndarray:
        r = self.parent[x]
        while (above := self.parent[r]).tobytes() != r.tobytes():
            r = above
        self.parent[x] = r
        return r

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.roots(a), self.roots(b)
            apart = a != b
            low, high = np.minimum(a[apart], b[apart]), np.maximum(a[apart], b[apart])
            if not len(low):
                return
            np.minimum.at(self.parent, high, low)
            a, b = low, high

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """Each position that is not its own root, and its root."""
        every = np.arange(len(self.parent))
        root = self.roots(every)
        return every[root != every], root[root != every]


def links(values: np.ndarray, others: np.ndarray | None = None, distance: int = MAX_DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among values, or between values and others (all distinct)."""
    values = values[np.argsort(gray_rank(values))]
    if others is None:
        forest, every, index = Forest(len(values)), values, Index(values)
        for q, node in index.search(values, distance, np.arange(1, len(values) + 1)):
            later = node > q
            forest.add(q[later], node[later])
    else:
        others = others[np.argsort(gray_rank(others))]
        forest, every, index = Forest(len(values) + len(others)), np.concatenate([values, others]), Index(others)
        for q, node in index.search(values, distance):
            forest.add(q, node + len(values))
    a, b = forest.links()
    return every[a], every[b]


def bucket_bits(buckets: np.ndarray, distance: int) -> np.ndarray:
    """The bits that the fingerprints of each bucket share by its number (as bucket_links numbers them)."""
    parts = distance + 1
    width = 64 // parts
    finer = (64 - width) // parts
    own = [((1 << width) - 1) << k * width for k in range(parts)]
    # bits of a second division are those of the others, moved together
    spread = [[sum(1 << (x if x < k * width else x + width) for x in range(j * finer, (j + 1) * finer)) for j in range(parts)] for k in range(parts)]
    one = np.array(own, dtype=np.uint64)
    two = np.array([[own[k] | spread[k][j] for j in range(parts)] for k in range(parts)], dtype=np.uint64)
    again = buckets >= AGAIN
    top = np.where(again, (buckets - AGAIN) >> finer, 0)
    return np.where(again, two[(top // parts) >> width, top % parts], one[np.where(again, 0, buckets >> width)])


def links_in_buckets(buckets: np.ndarray, values: np.ndarray, distance: int = MAX_DISTANCE, seen: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links within each of many buckets, by one index for each part. seen: gets the indexes."""
    shared, found = bucket_bits(buckets, distance), []
    for bits in np.unique(shared):
        own = np.flatnonzero(shared == bits)
        own = own[np.lexsort((gray_rank(values[own]), gray_rank(buckets[own].astype(np.uint64))))]
        v, of, index = values[own], buckets[own], Index(values[own])
        forest = Forest(len(v))
        for q, node in index.search(v, distance, np.arange(1, len(v) + 1), np.full(len(v), bits)):
            later = (node > q) & (of[node] == of[q])
            forest.add(q[later], node[later])
        a, b = forest.links()
        found.append((v[a], v[b]))
        if seen is not None:
            seen.append(index)
    return np.concatenate([x for x, _ in found] or [values[:0]]), np.concatenate([x for _, x in found] or [values[:0]])


def _links_batch(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])


def part_of(bits: Column, width: int, k: int) -> Column:
    return F.shiftrightunsigned(bits, k * width).bitwiseAND(F.lit((1 << width) - 1))


def without_part(f: Column, width: int, k: int) -> Column:
    """f's other bits, moved together."""
    low = f.bitwiseAND(F.lit((1 << k * width) - 1))
    high = F.shiftrightunsigned(f, (k + 1) * width) if (k + 1) * width < 64 else F.lit(0).cast("long")
    return F.shiftleft(high, k * width).bitwiseOR(low)


def sized_buckets(rows: DataFrame) -> DataFrame:
    """rows (bucket, f) with n, the bucket's number of rows; buckets of one row are left out."""
    return rows.join(rows.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "bucket")


def bucket_links(prints: DataFrame, distance: int = MAX_DISTANCE, block: int = BLOCK, search_rows: int = SEARCH_ROWS) -> DataFrame:
    """prints: distinct fingerprints f. Returns links (a, b) whose groups are those of all links."""
    parts = distance + 1
    width = 64 // parts
    finer = (64 - width) // parts
    f = F.col("f")
    coarse = F.array(*(F.struct(F.lit(k).alias("part"), (part_of(f, width, k) + (k << width)).alias("bucket")) for k in range(parts)))
    first = materialise(sized_buckets(prints.select("f", F.explode(coarse).alias("p")).select("p.part", "p.bucket", "f")).select("part", "bucket", "f", "n"))
    # a large bucket again, by the parts of its other bits; numbers above those of the first division
    others = F.lit(None).cast("long")
    for k in range(parts):
        others = F.when(F.col("part") == k, without_part(f, width, k)).otherwise(others)
    again = F.array(*(F.shiftleft(F.col("bucket") * parts + k, finer) + part_of(F.col("others"), finer, k) + AGAIN for k in range(parts)))
    second = materialise(sized_buckets(first.where(F.col("n") > block).select("f", "bucket", others.alias("others")).select("f", F.explode(again).alias("bucket"))).select("bucket", "f", "n"))

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets, values = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.uint64)
        for batch in batches:
            buckets = np.concatenate([buckets, batch.column("bucket").to_numpy()])
            values = np.concatenate([values, batch.column("f").to_numpy().view(np.uint64)])
            if len(buckets) >= search_rows:
                whole = np.searchsorted(buckets, buckets[-1])  # the last bucket may go on
                yield _links_batch(*links_in_buckets(buckets[:whole], values[:whole], distance))
                buckets, values = buckets[whole:], values[whole:]
        yield _links_batch(*links_in_buckets(buckets, values, distance))

    def paired(pdf: pd.DataFrame) -> pd.DataFrame:
        values, side = pdf["f"].to_numpy(np.int64).view(np.uint64), pdf["side"].to_numpy()
        if pdf["i"].iloc[0] == pdf["j"].iloc[0]:
            a, b = links(values, None, distance)
        elif side.any() and not side.all():
            a, b = links(values[side == 0], values[side == 1], distance)
        else:
            a = b = values[:0]
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    whole = first.where(F.col("n") <= block).select("bucket", "f").unionByName(second.where(F.col("n") <= block).select("bucket", "f"))
    few = whole.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(searched, "a long, b long")
    blocks = F.ceil(F.col("n") / block).cast("int")
    cut = second.where(F.col("n") > block).select("bucket", "f", blocks.alias("blocks"), F.pmod(F.xxhash64("f"), blocks).cast("int").alias("own"))
    pairs = cut.select("bucket", "f", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("o"))
    pairs = pairs.select("bucket", "f", F.least("own", "o").alias("i"), F.greatest("own", "o").alias("j"), (F.col("own") > F.col("o")).cast("int").alias("side"))
    many = pairs.groupBy("bucket", "i", "j").applyInPandas(paired, "a long, b long")
    return few.unionByName(many).distinct()


def groups(edges: DataFrame) -> DataFrame:
    """edges: (a, b). Returns f, root: each vertex's smallest vertex of its group, for all vertices but the roots."""
    edges = materialise(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    state = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
    before, now = None, state(edges)
    while before != now:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        met = large.join(least, "a")
        small = met.select("a", F.col("m").alias("b")).unionByName(met.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct()
        edges = materialise(small)
        before, now = now, state(edges)
    return edges.select(F.col("a").alias("f"), F.col("b").alias("root"))


def named_groups(prints: DataFrame, distance: int = MAX_DISTANCE) -> DataFrame:
    """prints: (f, doc_id), a row for each document. Returns f, component_id, and keeper: the fingerprint of the group's first document."""
    distinct = materialise(prints.groupBy("f").agg(F.min("doc_id").alias("first")))
    roots = groups(bucket_links(distinct.select("f"), distance))
    rooted = materialise(distinct.join(roots, "f", "left").select("f", "first", F.coalesce("root", "f").alias("root")))
    names = rooted.groupBy("root").agg(F.min(F.struct(F.col("first").isNull().alias("none"), "first", "f")).alias("m"))
    return rooted.join(names, "root").select("f", F.col("m.first").alias("component_id"), F.col("m.f").alias("keeper"))


def one_of_each(docs: DataFrame, shingle: int = SHINGLE, distance: int = MAX_DISTANCE) -> DataFrame:
    """The rows of docs that stay: of each group the document with the smallest doc_id."""
    marked, f = with_fingerprint(docs, shingle)
    key = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    prints = materialise(marked.select(F.col(f).alias("f"), F.col("doc_id").cast("long").alias("doc_id")))
    kept = named_groups(prints, distance).where("f = keeper").select(F.col("f").alias("k_f"), key(F.col("component_id")).alias("k_id"))
    # by fingerprint and doc_id, under which copies are not hot
    rows = marked.select(F.struct(*docs.columns).alias("row"), F.col(f).alias("k_f"), key(F.col("doc_id").cast("long")).alias("k_id"))
    stay = rows.join(kept, ["k_f", "k_id"], "left_semi").withColumn("n", F.row_number().over(Window.partitionBy("k_f", "k_id").orderBy(F.xxhash64("row"))))
    return stay.where("n = 1").select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: every document's fingerprint and group."""
    docs, f = with_fingerprint(table(spark, sf_dir, "documents").select("doc_id", "text"))
    prints = materialise(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(f).alias("f")))
    named = named_groups(prints).select("f", "component_id")
    return prints.join(named, "f").select("doc_id", F.lpad(F.lower(F.hex("f")), 16, "0").alias("fingerprint"), "component_id")
