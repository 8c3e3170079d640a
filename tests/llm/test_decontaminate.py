from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from cohortwise.llm import decontaminate as D

ITEM = "the quick umber fox vaults over nineteen lazy badgers while seven curious owls watch quietly from the old oak branches above"


def brute(window, item):
    """Smith-Waterman by the textbook: best (score, matches)."""
    h = [[(0, 0)] * (len(window) + 1) for _ in range(len(item) + 1)]
    best = (0, 0)
    for i, a in enumerate(item, 1):
        for j, b in enumerate(window, 1):
            s, m = h[i - 1][j - 1]
            step = (s + D.MATCH, m + 1) if a == b else (s - D.MISMATCH, m)
            up, left = h[i - 1][j], h[i][j - 1]
            h[i][j] = max((0, 0), step, (up[0] - D.GAP, up[1]), (left[0] - D.GAP, left[1]))
            if h[i][j][0] <= 0:
                h[i][j] = (0, 0)
            best = max(best, h[i][j])
    return best


def test_alignment_equals_the_textbook():
    rng = random.Random(3)
    for _ in range(60):
        window = np.array([rng.randrange(5) for _ in range(rng.randrange(1, 30))])
        item = np.array([rng.randrange(5) for _ in range(rng.randrange(1, 15))])
        score, matches, start, end, istart, iend = D.align(window, item)
        assert (score, matches) == brute(window.tolist(), item.tolist())
        if score:
            assert 0 <= start < end <= len(window) and 0 <= istart < iend <= len(item)


def documents(spark):
    words = ITEM.split()
    edited = [w for k, w in enumerate(words) if k % 7 != 3]  # some words lost
    edited[4] = "replaced"
    filler = " ".join(f"w{k}" for k in range(500))
    rows = [
        (1, f"{filler}\n{ITEM.upper()}! {filler}"),
        (2, f"{filler} {' '.join(edited)} {filler}"),
        (3, filler),
        (4, "the old oak and the lazy owls"),
        (5, None),
        (6, ""),
        (7, ITEM),
        (7, ITEM),
        (None, ITEM + " " + filler * 50),
        (8, " ".join(words[:6])),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("leaks", F.lit("clash"))


def items(spark):
    return spark.createDataFrame([(1, ITEM), (2, "short one"), (3, None), (4, ""), (9, ITEM)], "item_id long, text string")


def test_exact_and_edited_copies_are_found_and_clean_rows_stay(spark):
    rows = D.find_leaks(documents(spark), items(spark)).collect()
    got = [(r.doc_id, [h.item_id for h in r.hits]) for r in rows]
    assert sorted(got, key=str) == sorted([(1, [1, 9]), (2, [1, 9]), (3, []), (4, []), (5, []), (6, []), (7, [1, 9]), (7, [1, 9]), (None, [1, 9]), (8, [])], key=str)
    hit = next(r for r in rows if r.doc_id == 1).hits[0]
    text = next(r for r in documents(spark).collect() if r.doc_id == 1).text
    assert text[hit.start : hit.end] == ITEM.upper() and hit.score == 1.0
    assert rows[0].leaks == "clash"


def test_blocks_of_items_give_the_same(spark):
    one = D.find_leaks(documents(spark), items(spark)).select("doc_id", "hits.item_id").collect()
    many = D.find_leaks(documents(spark), items(spark), block_chars=20).select("doc_id", F.array_sort("hits.item_id").alias("item_id")).collect()
    assert sorted(map(str, one)) == sorted(map(str, many))


def test_empty_tables(spark):
    docs = documents(spark)
    assert all(r.hits == [] for r in D.find_leaks(docs, items(spark).limit(0)).collect())
    assert D.find_leaks(docs.limit(0), items(spark)).count() == 0


def test_planted_passages_against_containment(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: " ".join(D.words_of(r.text)) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    bench = {r.item_id: " ".join(D.words_of(r.text)) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    whole = {(d, i) for d, t in docs.items() for i, b in bench.items() if b and f" {b} " in f" {t} "}
    got = {(r.doc_id, r.item_id): r.score for r in D.query(spark, sf).collect()}
    assert whole and whole <= set(got)
    assert all(got[p] == 1.0 for p in whole)


def test_short_items_exactly_against_brute_force():
    rng = random.Random(11)
    words = list("abcde")
    items = [(k, [rng.choice(words) for _ in range(rng.randrange(1, D.MIN_ITEM_WORDS))]) for k in range(25)] + [(99, ["q", "a"])]
    block = D.Block(items, {}, 0.1)
    for _ in range(200):
        text = [rng.choice([*words, "z", "y"]) for _ in range(rng.randrange(12))]
        want = {}
        for k, item in items:
            places = [p for p in range(len(text)) if text[p : p + len(item)] == item]
            if places:
                want[k] = (1.0, len(item), " ".join(text[: places[0]] + [""]), len(" ".join(item)))
        got = {h["item_id"]: (h["score"], h["n_matches"], " ".join(text)[: h["start"]], h["end"] - h["start"]) for h in block.hits(" ".join(text))}
        assert got == want


def test_short_and_long_items_together(spark):
    docs = spark.createDataFrame([(1, f"A Short-One, here. {ITEM}"), (2, "short two one"), (3, "short one"), (4, "one"), (5, None)], "doc_id long, text string")
    got = {r.doc_id: [(h.item_id, h.n_matches) for h in r.hits] for r in D.find_leaks(docs, items(spark)).collect()}
    assert got == {1: [(1, 21), (2, 2), (9, 21)], 2: [], 3: [(2, 2)], 4: [], 5: []}
