"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Words are lower-cased runs of letters and digits. Every item of the
benchmark gives its 3-word grams as seeds where they are rare: the product
of the three words' shares among all words of the corpus, counted over
every document, is ``RARE`` or less; an item with few such grams adds its
rarest others. Judging grams by their words keeps the seeds of a passage
that many documents copy. Seeds join the documents' grams to items in a
hash lookup; the passage around the hits of an item is then aligned with it
word by word (local alignment, linear gaps), so that edited copies score by
what they keep.

A document leaks an item if the alignment reaches ``MIN_RATIO`` of the
item's own score with ``MIN_MATCHES`` equal words (all, for shorter items),
or holds ``LONG_MATCHES`` equal words at ``LONG_IDENTITY`` of its columns.
Items under ``MIN_ITEM_WORDS`` words are too short to align: they are found
where all their words stand in a row, word by word along a trie.

The benchmark is a stated query set: it goes to the tasks in blocks of at
most ``BLOCK_CHARS`` characters, each held against all documents. No rows of
documents are shuffled.

Defined results: null and empty texts have no hits; items
without a word are not searched; edited copies of items up to eight words are
not found; repeated rows get the same hits;
all columns of the documents stay.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import annotate, free_name, ship, table

SEED_WORDS = 3
RARE = 1e-9
#: An item takes at least so many of its grams as seeds, the rarest first.
LEAST_SEEDS = 6
MIN_ITEM_WORDS = 5
MIN_RATIO, MIN_MATCHES = 0.5, 8
LONG_MATCHES, LONG_IDENTITY = 12, 0.8
MATCH, MISMATCH, GAP = 2, 1, 1
BLOCK_CHARS = 8_000_000

HITS = "array<struct<item_id: bigint, score: double, n_matches: int, start: int, end: int>>"
_WORD = re.compile(r"[^\W_]+")
_PACK = 1 << 24  # an alignment's value is score * _PACK + its number of equal words


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def _values(window: np.ndarray, item: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place of the window, the best local alignment that ends there (packed), and its item place."""
    gaps = np.arange(len(window), dtype=np.int64) * (GAP * _PACK)
    before = np.zeros(len(window) + 1, dtype=np.int64)
    best, where = np.zeros(len(window), dtype=np.int64), np.zeros(len(window), dtype=np.int64)
    for i, word in enumerate(item):
        row = before[:-1] + np.where(window == word, MATCH * _PACK + 1, -MISMATCH * _PACK)
        np.maximum(row, before[1:] - GAP * _PACK, out=row)
        row[row < _PACK] = 0
        row = np.maximum.accumulate(row + gaps) - gaps
        row[row < _PACK] = 0
        before[1:] = row
        better = row > best
        best[better], where[better] = row[better], i
    return best, where


def align(window: np.ndarray, item: np.ndarray) -> tuple[int, int, int, int, int, int]:
    """Best local alignment: score, equal words, [start, end) in the window and [start, end) in the item."""
    best, where = _values(window, item)
    end = int(best.argmax())
    value, item_end = int(best[end]), int(where[end])
    back, _ = _values(window[: end + 1][::-1], item[: item_end + 1][::-1])
    start = end - int(back.argmax())
    _, where_back = _values(window[start : end + 1][::-1], item[: item_end + 1][::-1])
    item_start = item_end - int(where_back[-1])
    return value // _PACK, value % _PACK, start, end + 1, item_start, item_end + 1


def leaks(score: int, matches: int, columns: int, item_words: int) -> bool:
    whole = score >= MIN_RATIO * MATCH * item_words and matches >= min(MIN_MATCHES, item_words)
    return whole or (matches >= LONG_MATCHES and matches >= LONG_IDENTITY * columns)


class Block:
    """The items of a block as word numbers, and their seeds as a sorted array of gram numbers."""

    def __init__(self, items: list[tuple[int, list[str]]], share: dict[str, float], floor: float):
        self.vocabulary = {w: k for k, w in enumerate(sorted({w for _, words in items for w in words}))}
        self.size = len(self.vocabulary)
        p = np.array([share.get(w, floor) for w in self.vocabulary], dtype="float64")
        self.items = [(item_id, np.array([self.vocabulary[w] for w in words], dtype=np.int64)) for item_id, words in items]
        seeds: dict[int, list[tuple[int, int]]] = defaultdict(list)
        short: dict[tuple[int, ...], list[int]] = defaultdict(list)
        for k, (_, ids) in enumerate(self.items):
            if len(ids) < MIN_ITEM_WORDS:
                short[tuple(ids.tolist())].append(k)
                continue
            chance = p[ids[:-2]] * p[ids[1:-1]] * p[ids[2:]]
            chosen = set(np.flatnonzero(chance <= RARE)) | set(np.argsort(chance, kind="stable")[:LEAST_SEEDS])
            for at in chosen:
                seeds[int(self.gram(ids, int(at)))].append((k, int(at)))
        self.grams = np.array(sorted(seeds), dtype=np.int64)
        self.places = [seeds[g] for g in self.grams.tolist()]
        #: A trie of the short items: for each depth the sorted (node above, word) pairs as numbers, and who ends there.
        self.trie: list[tuple[np.ndarray, dict[int, list[int]]]] = []
        above = {(): 0}
        for depth in range(1, MIN_ITEM_WORDS):
            keys = {words[:depth]: above[words[: depth - 1]] * self.size + words[depth - 1] for words in short if len(words) >= depth}
            if not keys:
                break
            level = np.array(sorted(set(keys.values())), dtype=np.int64)
            above = {words: int(np.searchsorted(level, key)) for words, key in keys.items()}
            self.trie.append((level, {above[words]: short[words] for words in keys if words in short}))

    def gram(self, ids: np.ndarray, at: int) -> int:
        return (int(ids[at]) * self.size + int(ids[at + 1])) * self.size + int(ids[at + 2])

    def hits(self, text: str | None) -> list[dict]:
        words = words_of(text)
        if not words:
            return []
        ids = np.fromiter(map(self.vocabulary.get, words, repeat(-1)), dtype=np.int64, count=len(words))
        found = [*self.aligned(ids), *self.exact(ids)]
        if not found:
            return []
        spans = [m.span() for m in _WORD.finditer(text)]
        shifted = len(spans) != len(words)  # lower() changed the words' number: no offsets then
        out = []
        for item, score, matches, first, last in found:
            item_id, item_words = self.items[item]
            start, end = (None, None) if shifted else (spans[first][0], spans[last][1])
            out.append({"item_id": item_id, "score": score / (MATCH * len(item_words)), "n_matches": matches, "start": start, "end": end})
        return sorted(out, key=lambda h: (h["item_id"] is None, h["item_id"] or 0))

    def exact(self, ids: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
        """item, score, equal words, first and last word of the first whole occurrence of each short item."""
        at, node = np.flatnonzero(ids >= 0), np.int64(0)
        for depth, (level, ends) in enumerate(self.trie):
            keys = node * self.size + ids[at + depth]
            node = np.minimum(np.searchsorted(level, keys), len(level) - 1)
            same = level[node] == keys
            at, node = at[same], node[same]
            nodes, first = np.unique(node, return_index=True)
            for k, place in zip(nodes.tolist(), at[first].tolist()):
                for item in ends.get(k, ()):
                    yield item, MATCH * (depth + 1), depth + 1, place, place + depth
            further = at + depth + 1 < len(ids)
            at, node = at[further], node[further]
            known = ids[at + depth + 1] >= 0
            at, node = at[known], node[known]

    def aligned(self, ids: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
        """item, score, equal words, first and last word of the best alignment of each longer item that leaks."""
        at = np.flatnonzero((ids[:-2] >= 0) & (ids[1:-1] >= 0) & (ids[2:] >= 0)) if len(ids) >= SEED_WORDS else ids[:0]
        if not len(at) or not len(self.grams):
            return
        grams = (ids[at] * self.size + ids[at + 1]) * self.size + ids[at + 2]
        found = np.searchsorted(self.grams, grams)
        found[found == len(self.grams)] = 0
        same = self.grams[found] == grams
        diagonals: dict[int, list[int]] = defaultdict(list)
        for place, k in zip(at[same].tolist(), found[same].tolist()):
            for item, item_at in self.places[k]:
                diagonals[item].append(place - item_at)
        for item, starts in diagonals.items():
            item_words = self.items[item][1]
            n, best = len(item_words), None
            starts.sort()
            cuts = [0, *(k for k in range(1, len(starts)) if starts[k] - starts[k - 1] > n), len(starts)]
            for a, b in zip(cuts, cuts[1:]):
                low = max(0, starts[a] - n // 2)
                window = ids[low : starts[b - 1] + n + n // 2 + 1]
                score, matches, x, y, ix, iy = align(window, item_words)
                if leaks(score, matches, max(y - x, iy - ix), n) and (best is None or score > best[1]):
                    best = item, score, matches, low + x, low + y - 1
            if best:
                yield best


def word_shares(docs: DataFrame, vocabulary: set[str]) -> tuple[dict[str, float], int]:
    """Shares of the given words among all words of all documents, and the number of all words."""
    known = ship(docs.sparkSession, vocabulary)  # the words of one block

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts, total, is_known = Counter(), 0, known().__contains__
        for pdf in batches:
            for text in pdf.text:
                words = words_of(text)
                total += len(words)
                counts.update(filter(is_known, words))
        yield pd.DataFrame({"word": [None, *counts], "n": [total, *counts.values()]})

    rows = docs.select(F.col("text").cast("string").alias("text")).mapInPandas(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    counts = {r["word"]: r["n"] for r in rows}
    total = max(1, counts.pop(None, 0))
    return {w: n / total for w, n in counts.items()}, total


def blocks_of(benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> Iterator[list[tuple[int, list[str]]]]:
    """The benchmark's items in blocks of about ``block_chars`` characters."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    n = -(-(items.agg(F.sum(F.length("text"))).first()[0] or 0) // block_chars)
    for k in range(n):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).distinct().collect()  # one block
        block = [(r["item_id"], w) for r in rows if (w := words_of(r["text"]))]
        if block:
            yield sorted(block, key=lambda x: (x[0] is None, x[0] or 0, x[1]))


def find_leaks(docs: DataFrame, benchmark: DataFrame, column: str = "hits", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """docs and a column of HITS, an empty list for clean documents."""
    found = []
    for items in blocks_of(benchmark, block_chars):
        share, total = word_shares(docs, {w for _, words in items for w in words})
        block = ship(docs.sparkSession, Block(items, share, 1 / total))
        name = free_name(docs, "leaks")

        def make(block=block):
            kind = pa.list_(pa.struct([("item_id", pa.int64()), ("score", pa.float64()), ("n_matches", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))
            hits = block().hits
            return lambda texts: [pa.array([hits(t) for t in texts.to_pylist()], kind)]

        docs = annotate(docs, ["text"], f"{name} {HITS}", make)
        found.append(name)
    joined = F.concat(*found) if found else F.array().cast(HITS)
    return docs.select(*(F.col(f"`{c}`") for c in docs.columns if c not in found), joined.alias(column))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: one row for each document and benchmark item that it leaks."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    hits = find_leaks(docs, table(spark, sf_dir, "benchmark")).select("doc_id", F.explode("hits").alias("hit")).select("doc_id", "hit.*")
    return hits.groupBy("doc_id", "item_id").agg(F.max(F.struct("score", "n_matches", "start", "end")).alias("h")).select("doc_id", "item_id", "h.*")
