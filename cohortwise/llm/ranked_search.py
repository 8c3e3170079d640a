r"""Ranked lexical search: top documents by impact score, over buckets of vectors of like length.

A term is a maximal run of ASCII letters and digits and of characters beyond
ASCII, with A-Z lower-cased. A document's score for an item is the sum, over
the item's terms with repeats, of the term's weight times its impact there,
both whole numbers.

So the score is an inner product. Documents become vectors of impacts, of the
items' terms only, and items vectors of counts; the square root of a term's
weight goes to either side. The search follows LEMP:

- vectors are ordered by length, in levels ``STEPS`` to an octave; a level is
  cut by hash into buckets of about ``BUCKET`` vectors, so that copies and
  common lengths spread;
- an item leaves a bucket whose longest vector cannot bring it to the score
  of its tenth-best document so far (Cauchy-Schwarz);
- inside a bucket, the product on the item's heaviest coordinates, with
  Cauchy-Schwarz on what both have left, leaves out most documents;
- those that stay are scored exactly in integers.

The longest levels, ``FIRST`` vectors or the few levels more that end them,
are searched first; their tenth-best scores are where the search of all other
levels begins, each task walking its buckets from long to short. Bounds are
loosened by ``SLACK`` against rounding, so no document is left out that an
exhaustive search would rank.

The items are a stated query set, taken in blocks of at most ``BLOCK_CHARS``
characters against all documents; a block's terms, weights, vectors and tenth
scores go to the tasks. Texts are not shuffled; the vectors are, once.

Defined results: null and empty texts have no terms and no rank; items
without terms, or none of whose terms is anywhere, have no rows; rows that
repeat an item's id and text are one item, those that repeat only its id are
ranked each; documents that repeat a doc_id each have a rank; null doc_ids
come after all others of the same score; further columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import LOWER, UPPER, materialise, ship, table

TOP = 10
#: Levels of length to an octave, vectors of a bucket, vectors searched first.
STEPS, BUCKET, FIRST = 8, 2048, 16_384
#: Coordinates of an item that the bound uses: the heaviest, up to this share of its squared length.
FOCUS = 0.8
SLACK = 1e-9
BLOCK_CHARS = 8_000_000
#: Fixed values of the score.
WEIGHT, IMPACT, K1, K2, B_NUM, B_DEN = 1000, 1_000_000_000, 1000, 8, 75, 100

_KEPT = b"0123456789abcdefghijklmnopqrstuvwxyz"
_FOLD = bytes(c if c >= 128 or c in _KEPT else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def terms_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(_FOLD).split() if text else []


@dataclass
class Items:
    """The items of a block: ids, and their terms as numbers with counts."""

    ids: list[int | None]
    terms: list[np.ndarray]
    counts: list[np.ndarray]
    vocabulary: dict[bytes, int]

    @classmethod
    def of(cls, rows: list[tuple[int | None, str]]) -> Items:
        bags = [(i, Counter(terms_of(text))) for i, text in rows]
        bags = [(i, bag) for i, bag in bags if bag]
        vocabulary = {w: k for k, w in enumerate(sorted({w for _, bag in bags for w in bag}))}
        terms = [np.array([vocabulary[w] for w in bag], dtype=np.int64) for _, bag in bags]
        return cls([i for i, _ in bags], terms, [np.array(list(bag.values()), dtype=np.int64) for _, bag in bags], vocabulary)


def blocks_of(items: DataFrame, block_chars: int = BLOCK_CHARS) -> Iterator[Items]:
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    n = -(-(rows.agg(F.sum(F.length("text"))).first()[0] or 0) // block_chars)
    for k in range(n):
        own = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).distinct().collect()  # one block
        block = Items.of(sorted(((r["item_id"], r["text"]) for r in own), key=lambda x: (x[0] is None, x[0] or 0, x[1])))
        if block.ids:
            yield block


def count_terms(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """A row for each document with a term: doc_id, n (its terms), and the vocabulary's terms there with their counts."""
    known = ship(docs.sparkSession, vocabulary)  # the terms of one block

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = known()
        for batch in batches:
            ids, sizes, terms, counts = [], [], [], []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                words = terms_of(text)
                if words:
                    bag = Counter(filter(number.__contains__, words))
                    ids.append(doc_id)
                    sizes.append(len(words))
                    terms.append([number[w] for w in bag])
                    counts.append(list(bag.values()))
            columns = (ids, pa.int64()), (sizes, pa.int64()), (terms, pa.list_(pa.int32())), (counts, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in columns], names=["doc_id", "n", "terms", "counts"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(count, "doc_id long, n long, terms array<int>, counts array<int>")


def length_norm(n: int, documents: int, total: int) -> int:
    return B_DEN - B_NUM + (B_NUM * n * documents) // total


class Searcher:
    """An item block's search over buckets of document vectors, from long to short. Holds each item's best so far."""

    def __init__(self, items: Items, weights: np.ndarray, floors: np.ndarray, top: int = TOP):
        self.items, self.top, self.weights = items, top, weights
        self.root = np.sqrt(weights.astype(np.float64))
        self.floors = floors.copy()  # the least score that still counts
        self.best: list[np.ndarray] = [np.empty((3, 0), dtype=np.int64)] * len(items.ids)  # score, null doc_id, doc_id
        self.queries, self.exact = [], []
        for terms, counts in zip(items.terms, items.counts):
            values = counts * self.root[terms]
            heavy = np.argsort(-values, kind="stable")
            mass = np.cumsum(values[heavy] ** 2)
            focus = heavy[: int(np.searchsorted(mass, FOCUS * mass[-1])) + 1]
            rest = math.sqrt(max(0.0, float((np.delete(values, focus) ** 2).sum())))
            self.queries.append((terms[focus], values[focus], rest))
            self.exact.append(counts * weights[terms])
        self.lengths = np.array([math.sqrt(float((c * c * weights[t]).sum())) for t, c in zip(items.terms, items.counts)])
        self.seen = Counter()

    def bucket(self, doc_ids: np.ndarray, missing: np.ndarray, starts: np.ndarray, terms: np.ndarray, impacts: np.ndarray) -> None:
        """Documents as rows of (terms, impacts) between starts; missing: null doc_ids."""
        n = len(doc_ids)
        row = np.repeat(np.arange(n), np.diff(starts))
        values = impacts * self.root[terms]
        squares = np.bincount(row, values * values, n)
        longest = math.sqrt(float(squares.max(initial=0)))
        active = np.flatnonzero(self.lengths * longest * (1 + SLACK) >= self.floors)
        self.seen.update(items=len(self.lengths), items_inside=len(active), pairs=len(active) * n)
        if not len(active):
            return
        by_term = np.argsort(terms, kind="stable")
        edges = np.searchsorted(terms[by_term], np.arange(len(self.weights) + 1))
        rows_of, values_of = row[by_term], values[by_term]
        for q in active.tolist():
            focus, weights, rest = self.queries[q]
            product, left = np.zeros(n), squares.copy()
            for t, w in zip(focus.tolist(), weights.tolist()):
                at = slice(edges[t], edges[t + 1])
                product[rows_of[at]] += w * values_of[at]
                left[rows_of[at]] -= values_of[at] ** 2
            bound = (product + rest * np.sqrt(np.maximum(left, 0) + SLACK * squares)) * (1 + SLACK)
            stay = np.flatnonzero((bound >= self.floors[q]) & (bound > 0))
            if len(stay):
                self.seen.update(pairs_scored=len(stay))
                self._score(q, stay, doc_ids, missing, starts, terms, impacts)

    def _score(self, q, stay, doc_ids, missing, starts, terms, impacts):
        factor = np.zeros(len(self.weights), dtype=np.int64)
        factor[self.items.terms[q]] = self.exact[q]
        sizes = starts[stay + 1] - starts[stay]
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1]) + np.repeat(starts[stay] - (ends - sizes), sizes)
        score = np.add.reduceat(factor[terms[at]] * impacts[at], ends - sizes)  # vectors here are never empty
        kept = score >= max(1, int(self.floors[q]))
        found = np.stack([score[kept], missing[stay][kept].astype(np.int64), doc_ids[stay][kept]])
        found = np.concatenate([self.best[q], found], axis=1)
        found = found[:, np.lexsort((found[2], found[1], -found[0]))[: self.top]]
        self.best[q] = found
        if found.shape[1] == self.top:
            self.floors[q] = max(self.floors[q], found[0, -1])

    def rows(self) -> pa.RecordBatch:
        sizes = [b.shape[1] for b in self.best]
        score, missing, doc_id = np.concatenate(self.best, axis=1)
        item_id = pa.array([i for i, n in zip(self.items.ids, sizes) for _ in range(n)], pa.int64())
        columns = pa.array(np.repeat(np.arange(len(sizes)), sizes)), item_id, pa.array(doc_id, mask=missing.astype(bool)), pa.array(score)
        return pa.RecordBatch.from_arrays(list(columns), names=["item", "item_id", "doc_id", "score"])


def search_levels(vectors: DataFrame, items: Items, weights: np.ndarray, floors: np.ndarray, top: int) -> DataFrame:
    """vectors: doc_id, level, bucket, terms, impacts. Each task's best documents: item (its place in the block), item_id, doc_id, score."""
    shipped = ship(vectors.sparkSession, (items, weights, floors))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searcher = Searcher(*shipped(), top)
        for rows in buckets(batches):
            doc_ids, lists, impacts = rows.column("doc_id"), rows.column("terms").combine_chunks(), rows.column("impacts").combine_chunks()
            offsets = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())]).astype(np.int64)
            missing = doc_ids.is_null().to_numpy()
            ids = doc_ids.fill_null(0).to_numpy()
            searcher.bucket(ids, missing, offsets, lists.flatten().to_numpy().astype(np.int64), impacts.flatten().to_numpy())
        yield searcher.rows()

    ordered = vectors.repartition("level", "bucket").sortWithinPartitions(F.desc("level"), "bucket")
    return ordered.mapInArrow(search, "item long, item_id long, doc_id long, score long")


def buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Runs of rows of one level and bucket; a run of very many rows comes in pieces."""
    held: list[pa.RecordBatch] = []
    now, size = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([batch.column("level").to_numpy(), batch.column("bucket").to_numpy()])
        cuts = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            own = tuple(key[:, a].tolist())
            if held and (own != now or size >= 4 * BUCKET):
                yield pa.Table.from_batches(held)
                held, size = [], 0
            now = own
            held.append(batch.slice(a, b - a))
            size += b - a
    if held:
        yield pa.Table.from_batches(held)


def search(docs: DataFrame, items: DataFrame, top: int = TOP, block_chars: int = BLOCK_CHARS, first: int = FIRST) -> DataFrame:
    """item_id, rank, doc_id, score: each item's ``top`` best documents with a score above 0."""
    spark = docs.sparkSession
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for block in blocks_of(items, block_chars):
        counted = materialise(count_terms(docs, block.vocabulary))
        documents, total = counted.agg(F.count("*"), F.sum("n")).first()
        if not documents:
            continue
        term = F.explode("terms").alias("term")
        weight = F.floor(F.lit(WEIGHT) * F.log((F.lit(2 * documents + 2)) / (2 * F.col("df") + 1)))
        weights = np.zeros(len(block.vocabulary), dtype=np.int64)  # a row for each term of the block at most
        for r in counted.select(term).groupBy("term").agg(F.count("*").alias("df")).select("term", weight.alias("w")).collect():
            weights[r["term"]] = r["w"]
        vectors = materialise(with_levels(counted, weights, documents, total))
        levels = sorted(((r["level"], r["n"]) for r in vectors.groupBy("level").agg(F.count("*").alias("n")).collect()), reverse=True)  # lengths span few octaves
        if not levels:
            continue
        cuts = F.create_map(*(F.lit(int(x)) for level, n in levels for x in (level, -(-n // BUCKET))))
        vectors = vectors.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "terms"), cuts[F.col("level")]).cast("int"))
        least, seen = levels[0][0], 0
        for level, n in levels:
            if seen >= first:
                break
            least, seen = level, seen + n
        floors = np.zeros(len(block.ids), dtype=np.int64)
        longest = materialise(best(search_levels(vectors.where(F.col("level") >= least), block, weights, floors, top), top))
        for r in longest.groupBy("item").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") == top).collect():
            floors[r["item"]] = r["least"]
        rest = search_levels(vectors.where(F.col("level") < least), block, weights, floors, top)
        found = best(longest.drop("rank").unionByName(rest), top)
        out = out.unionByName(found.select("item_id", "rank", "doc_id", "score"))
    return out


def best(found: DataFrame, top: int) -> DataFrame:
    """The best rows of each item, ranked: highest score, then smallest doc_id."""
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def with_levels(counted: DataFrame, weights: np.ndarray, documents: int, total: int) -> DataFrame:
    """doc_id, level (of the vector's length), terms, impacts; vectors of length zero score nothing and go."""
    shipped = ship(counted.sparkSession, weights)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = shipped().astype(np.float64)
        for batch in batches:
            lists, counts = batch.column("terms"), batch.column("counts")
            sizes = lists.value_lengths().to_numpy().astype(np.int64)
            terms, tf = lists.flatten().to_numpy(), counts.flatten().to_numpy().astype(np.int64)
            norm = np.array([length_norm(n, documents, total) for n in batch.column("n").to_pylist()], dtype=np.int64)
            impacts = IMPACT * tf // (K1 * tf + K2 * np.repeat(norm, sizes))
            row = np.repeat(np.arange(len(sizes)), sizes)
            squares = np.bincount(row, impacts.astype(np.float64) ** 2 * weight[terms], len(sizes))
            level = np.floor(np.log2(np.maximum(squares, 1e-300)) * STEPS / 2).astype(np.int32)
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
            columns = [batch.column("doc_id"), pa.array(level), pa.ListArray.from_arrays(offsets, pa.array(terms, pa.int32())), pa.ListArray.from_arrays(offsets, pa.array(impacts, pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "level", "terms", "impacts"]).filter(pa.array(squares > 0))

    return counted.mapInArrow(measure, "doc_id long, level int, terms array<int>, impacts array<long>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op11: the ten best documents of each benchmark item."""
    return search(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


_TERMS = f"regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"

SQL = f"""
with d as (
  select row_number() over () as k, doc_id, {_TERMS} as terms from documents
), tf as (
  select k, any_value(doc_id) as doc_id, term, count(*) as tf, any_value(n) as n
  from (select k, doc_id, len(terms) as n, unnest(terms) as term from d) group by k, term
), s as (
  select count(*) as docs, sum(len(terms))::bigint as total from d where len(terms) > 0
), w as (
  select term, floor({WEIGHT} * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1)))::bigint as w from tf, s group by term
), i as (
  select item_id, text, unnest({_TERMS}) as term from (select distinct item_id, text from benchmark)
), scored as (
  select item_id, i.text, k, any_value(doc_id) as doc_id,
    sum(w * (({IMPACT} * tf) // ({K1} * tf + {K2} * ({B_DEN - B_NUM} + ({B_NUM} * n * docs) // total))))::bigint as score
  from i join tf using (term) join w using (term), s group by item_id, i.text, k
), ranked as (
  select *, row_number() over (partition by item_id, text order by score desc, doc_id nulls last) as rank from scored where score > 0
)
select item_id, rank::integer as rank, doc_id, score from ranked where rank <= {TOP}
"""
