"""Ranked search, prefix trie and suffix-tree model against brute force and the registered SQL."""

from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cohortwise.llm import prefix_trie as P
from cohortwise.llm import ranked_search as R
from cohortwise.llm import suffix_tree_lm as M
from cohortwise.llm.common import table

# --- ranked search -----------------------------------------------------------

WORDS = [f"w{k}" for k in range(60)] + ["é", "Éa", "ſ", "the", "The", "a1"]


def corpus(seed=5, n=400):
    rng = random.Random(seed)
    weights = [1 / (k + 1) for k in range(len(WORDS))]
    rows = [(k, " ".join(rng.choices(WORDS, weights, k=rng.randrange(0, 60)))) for k in range(n)]
    rows += [(7, rows[9][1]), (7, rows[9][1]), (None, rows[11][1]), (None, rows[11][1]), (5000, None), (5001, ""), (5002, "?!, \n-")]
    rows += [(6000 + k, rows[3][1]) for k in range(40)]  # a group of copies, tied
    rows.append((7000, "w1 w2-w3_w4 " * 30_000))
    return rows


ITEMS = [(1, "w1 w2 w3 w3 the THE"), (2, "é w59 w58 w57"), (3, "nowhere"), (4, None), (5, "--"), (5, "w50 w40"), (5, "w50 w40"), (None, "w9 w8 w7 a1"), (6, "w0")]


def brute_search(docs, items, top):
    bags = [(i, Counter(R.terms_of(t))) for i, t in docs]
    bags = [(i, b) for i, b in bags if b]
    n, total = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(w for _, b in bags for w in b)
    out = []
    for item, text in set(items):
        found = []
        for i, b in bags:
            m = 25 + 75 * sum(b.values()) * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (10**9 * b[w] // (1000 * b[w] + 8 * m)) for w in R.terms_of(text) if b[w])
            if s > 0:
                found.append((-s, i is None, i or 0))
        out += [(item, k + 1, None if none else i, -s) for k, (s, none, i) in enumerate(sorted(found)[:top])]
    return Counter(out)


@pytest.fixture(scope="module")
def searched(spark):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string").withColumns({"score": F.lit("clash"), "level": F.lit(1)}).repartition(5)
    return docs, spark.createDataFrame(ITEMS, "item_id long, text string")


@pytest.mark.parametrize("first,block_chars", [(R.FIRST, R.BLOCK_CHARS), (20, 12)])
def test_search_equals_exhaustive_search(searched, first, block_chars):
    docs, items = searched
    found = R.search(docs, items, first=first, block_chars=block_chars)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert Counter(map(tuple, found.collect())) == brute_search(corpus(), ITEMS, R.TOP)


def test_search_equals_its_sql(spark, searched):
    docs, items = searched
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text").toArrow())
    con.register("benchmark", items.toArrow())
    assert Counter(map(tuple, con.execute(R.SQL).fetchall())) == Counter(map(tuple, R.search(docs, items).collect()))


def test_search_of_empty_tables(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")
    assert R.search(docs, items).count() == 0
    assert R.search(spark.createDataFrame([(1, "w1")], docs.schema), items.where("false")).count() == 0


def test_buckets_and_coordinates_leave_most_pairs_out():
    """Long-to-short order, Cauchy-Schwarz and the coordinate bound each prune; none loses a document."""
    rng = random.Random(2)
    items = R.Items.of([(k, " ".join(rng.sample(WORDS, 6))) for k in range(30)])
    weights = np.array([rng.randrange(500, 9000) for _ in items.vocabulary], dtype=np.int64)
    size = len(items.vocabulary)
    docs = [sorted(rng.sample(range(size), rng.randrange(1, size))) for _ in range(3000)]
    values = [[rng.randrange(1, 10**6) // (1 + k % 40) for _ in d] for k, d in enumerate(docs)]
    docs, values = zip(*sorted(zip(docs, values), key=lambda x: -sum(weights[t] * v * v for t, v in zip(*x))))
    searcher = R.Searcher(items, weights, np.zeros(30, dtype=np.int64))
    for low in range(0, 3000, 100):
        own, of = docs[low : low + 100], values[low : low + 100]
        starts = np.concatenate([[0], np.cumsum([len(d) for d in own])])
        searcher.bucket(np.arange(low, low + 100), np.zeros(100, dtype=bool), starts, np.concatenate(own), np.concatenate(of).astype(np.int64))
    assert searcher.seen["items_inside"] < searcher.seen["items"] / 2
    assert searcher.seen["pairs_scored"] < searcher.seen["pairs"] / 2
    for q, (terms, counts) in enumerate(zip(items.terms, items.counts)):
        factor = dict(zip(terms.tolist(), (counts * weights[terms]).tolist()))
        scores = sorted(((-sum(factor.get(t, 0) * v for t, v in zip(d, x)), k) for k, (d, x) in enumerate(zip(docs, values))))[: R.TOP]
        assert [(-s, k) for s, k in scores if s] == [(int(s), int(k)) for s, _, k in searcher.best[q].T]


# --- prefix trie -------------------------------------------------------------


def conversations():
    rng = random.Random(4)
    rows = []
    for c in range(-7, 40):
        if c % 11 == 0:
            continue
        for t in range(rng.randrange(1, 14)):
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", rng.choice(["é", "b", "", "long " * 50])))
    rows += [(3, None, None, None), (3, None, None, None), (8, 1, "user", "tie"), (8, 1, "user", "tie"), (8, 1, "system", None)]
    rows += [(None, 1, "user", "no conversation"), (None, None, None, None)]
    rows += [(100 + k, t, "user", f"same {t}") for k in range(60) for t in range(3)]
    rows += [(c, t, "user", f"deep {t}" if t < 150 else f"deep {c} {t}") for c in (200, 201) for t in range(170)]  # 201 mod 5 = 1
    rows += [(10**15 + 5 * k, 0, "user", "same 0") for k in range(3)]
    return rows


@pytest.fixture(scope="module")
def talks(spark):
    return spark.createDataFrame(conversations(), "conv_id long, turn long, role string, text string").withColumn("key", F.lit("clash")).repartition(5)


def brute_trie(rows, heads):
    import zlib

    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    import hashlib

    own = {c: [x[2:] for x in sorted(v, key=lambda x: (*x[:3], hashlib.sha256(x[3].encode()).hexdigest()))] for c, v in own.items()}
    nodes = defaultdict(list)
    ends = defaultdict(list)
    for c, turns in own.items():
        if heads:
            h = zlib.crc32(str(c).encode()) % 9
            turns = own.get(c - int(math.fmod(c, 5)), [])[:h] + turns[h:]
        for d in range(len(turns) + 1):
            nodes[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    leaves, saved = Counter(), Counter()
    inner = {n[:-1] for n in nodes if n}
    for n, of in nodes.items():
        for d in range(len(n) + 1):
            leaves[n[:d]] += n not in inner
            saved[n[:d]] += (len(of) - 1) * (len(n[-1][1].encode()) if n else 0)
    children = Counter(n[:-1] for n in nodes if n)
    sha = lambda n: hashlib.sha256(",".join(map(str, sorted(ends[n]))).encode()).hexdigest()
    return Counter((min(of), len(n), min(nodes[n[:-1]]) if n else None, len(of), children[n], leaves[n], saved[n], sha(n)) for n, of in nodes.items())


@pytest.mark.parametrize("heads,band", [(True, P.BAND), (True, 2), (False, 3), (True, 1000)])
def test_trie_equals_brute_force(talks, heads, band):
    turns = P.turn_rows(talks)
    found = P.trie(P.with_heads(turns) if heads else P.without_heads(turns), band)
    assert Counter(map(tuple, found.collect())) == brute_trie(conversations(), heads)


def test_trie_equals_its_sql(talks):
    con = duckdb.connect()
    con.register("conversations", talks.select("conv_id", "turn", "role", "text").toArrow())
    assert Counter(map(tuple, con.execute(P.SQL).fetchall())) == brute_trie(conversations(), True)


def test_trie_of_an_empty_table(talks):
    assert P.trie(P.with_heads(P.turn_rows(talks.where("false")))).count() == 0


def test_digest_streams_blocks_in_order(spark):
    ids = [-5000, -4097, -4096, -1, 0, 4095, 4096, 10**15]
    rows = spark.createDataFrame([(b"k", i) for i in ids] + [(b"l", 3)], "key binary, conv_id long").repartition(4)
    import hashlib

    sha = lambda x: hashlib.sha256(",".join(map(str, x)).encode()).hexdigest()
    assert {bytes(k): v for k, v in P.end_digests(rows).collect()} == {b"k": sha(ids), b"l": sha([3])}


def test_rollup_grows_by_a_band_a_node(talks):
    """Rows given out in the rollup: at most BAND a node in its band, and BAND a band root on the way down."""
    turns = P.with_heads(P.turn_rows(talks))
    ups = P.members(turns).select("key", "depth", "ups").distinct().collect()
    assert all(len(u) <= P.KEY * P.BAND for r in ups for u in r["ups"])
    deep = max(ups, key=lambda r: r["depth"])
    assert deep["depth"] >= 170 and all(len(r["ups"]) == sum(r["depth"] % P.BAND**k == 0 for k in range(6)) for r in ups if r["depth"])


# --- suffix tree -------------------------------------------------------------


def texts(n=120):
    rng = random.Random(8)
    syllables = ["th", "er", "on", "ÿa", "sh", "e"]
    words = ["".join(rng.choices(syllables, k=rng.randrange(1, 4))) for _ in range(80)]
    rows = [(k, " ".join(rng.choices(words, [1 / (j + 1) for j in range(80)], k=rng.randrange(0, 80)))) for k in range(n)]
    return rows + [(500, None), (501, ""), (502, " \t\n"), (None, "The the THE"), (None, None), (3, "the"), (3, "the"), (3, "other"), (600, "a\x0bb " * 20_000), (601, "x" * 9000)]


def held(doc_id):
    import zlib

    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 7 == 2


class BruteTree:
    def __init__(self, spellings, depth, penalty):
        self.depth, self.n = depth, [defaultdict(Counter) for _ in range(depth + 1)]
        for s in spellings:
            s = M.END * depth + s
            for i in range(depth, len(s)):
                for k in range(depth + 1):
                    self.n[k][s[i - k : i]][s[i]] += 1
        positions = sum(self.n[0][b""].values()) + 1
        self.kept = {b""}
        for k in range(1, depth + 1):
            for s, c in self.n[k].items():
                up = self.n[k - 1][s[1:]]
                total, up_total = sum(c.values()), sum(up.values())
                gain = sum(x * math.log((x / total) / (up[a] / up_total)) for a, x in c.items())
                if gain >= penalty * math.log(positions) * len(c):
                    self.kept |= {s[j:] for j in range(k)}

    def p(self, s, a):
        c = self.n[len(s)].get(s, Counter())
        total = sum(c.values())
        if not s:
            return (c[a] + 1) / (total + 256)
        return (c[a] + len(c) * self.p(s[1:], a)) / (total + len(c))

    def state(self, history):
        return next(s for k in range(self.depth, -1, -1) if (s := history[len(history) - k :]) in self.kept)

    def score(self, s):
        s = M.END * self.depth + s
        return sum(math.log10(self.p(self.state(s[i - self.depth : i]), s[i])) for i in range(self.depth, len(s)))


def check_scores(rows, source, depth, penalty):
    train = [t for i, t in source if not held(i)]
    c = Counter(w for t in train for w in [*M.words_of(t), None])
    tokens, types = sum(c.values()), len(c)
    brute = BruteTree([M.spelled(t) for t in train], depth, penalty)
    want = []
    for i, t in source:
        words = [*M.words_of(t), None]
        base = sum(math.log10((c[w] + 1) / (tokens + types + 1)) for w in words)
        want.append((i, held(i), len(words), sum(c[w] > 0 for w in words), tokens, base, brute.score(M.spelled(t))))
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:4], round(r[5], 6))
    got = sorted((tuple(r) for r in rows), key=key)
    want.sort(key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5] for r in got], [r[5] for r in want], rtol=1e-9)
    assert np.allclose([r[6] for r in got], [r[6] for r in want], rtol=1e-6)
    return brute


@pytest.mark.parametrize("options", [{}, {"shard_rows": 40, "group_words": 50, "heavy_bits": 5}, {"depth": 3, "penalty": 0.5}])
def test_scores_equal_brute_force(spark, options):
    docs = spark.createDataFrame(texts(), "doc_id long, text string").withColumns({"score": F.lit("clash"), "part": F.lit(0)}).repartition(3)
    rows = M.score(docs, M.fold_of("doc_id", 7) == 2, **options).collect()
    check_scores(rows, texts(), options.get("depth", M.DEPTH), options.get("penalty", M.PENALTY))


def test_contexts_of_several_lengths_stay_and_distributions_sum_to_one(spark):
    source = texts()
    brute = BruteTree([M.spelled(t) for i, t in source if not held(i)], M.DEPTH, M.PENALTY)
    sizes = Counter(map(len, brute.kept))
    assert len(sizes) > 2 and any(sizes[k] < len(brute.n[k]) for k in range(1, M.DEPTH + 1))
    for s in random.Random(1).sample(sorted(brute.kept), 20):
        assert abs(sum(brute.p(s, a) for a in range(256)) - 1) < 1e-9


def test_no_training_rows_and_empty_tables(spark):
    docs = spark.createDataFrame([(k, "some words") for k in range(6)], "doc_id long, text string")
    rows = M.score(docs, F.lit(True)).collect()
    assert len(rows) == 6 and all(r["n_known"] == 0 and r["train_tokens"] == 0 and r["base_score"] == 0 for r in rows)
    assert all(abs(r["score"] + 11 * math.log10(256)) < 1e-9 for r in rows)
    assert M.score(docs.where("false"), F.lit(True)).count() == 0


def test_long_spellings_are_cut_without_a_trace():
    spellings = [b"abcabd" * 40 + M.END, M.END, b"xyz" + M.END]
    whole = M.grams(spellings)
    for size in (1, 4, 7, 1000):
        parts = [M.run_grams(run, M.DEPTH) for run in M.chunks(iter(spellings), M.DEPTH, size)]
        assert np.array_equal(np.concatenate([p[0] for p in parts]), whole)
        sizes = Counter()
        for _, numbers, n in parts:
            for k, x in zip(numbers.tolist(), n.tolist()):
                sizes[k] += x
        assert sizes == {0: 241, 1: 1, 2: 4}


@pytest.mark.parametrize("depth", [1, 3, 5, 6, 7])
def test_grams_sorted_with_their_pieces(depth):
    """At six bytes gram and piece share a number up to 256 pieces, at seven for one piece only."""
    rng = random.Random(9)
    for n in (1, 40, 300):
        spellings = [bytes(rng.choices(b"ab\xff ", k=rng.randrange(30))) + M.END for _ in range(n)]
        keys = M.grams(spellings, depth)
        padded = [M.END * depth + s for s in spellings]
        assert keys.tolist() == [int.from_bytes(s[i - depth : i + 1], "big") for s in padded for i in range(depth, len(s))]
        sizes = np.array([len(s) for s in spellings])
        distinct, times, piece = M.sort_grams(keys, sizes, depth)
        got = Counter(zip(np.repeat(distinct, times).tolist(), piece.tolist()))
        assert got == Counter(zip(keys.tolist(), np.repeat(np.arange(n), sizes).tolist()))
        assert np.all(distinct[1:] > distinct[:-1])


def test_a_tree_keeps_the_grams_it_has_scored(monkeypatch):
    """Texts scored in turn, through what was scored before, get what each gets alone."""
    levels = [[(k, True, c, -0.5) for c in (97, 98)] + [(k, False, c << 8 | b, -0.1 * b) for c in (97, 98) for b in (97, 32)] for k in (1,)]
    rows = [(0, False, b, -2.0) for b in range(256)] + levels[0]
    columns = [pa.array(x, t) for x, t in zip(zip(*rows), (pa.int32(), pa.bool_(), pa.int64(), pa.float64()))]
    table = pa.table(columns, names=["level", "is_context", "key", "value"])
    make = lambda: M.Tree(table, 1, True, np.empty(0, dtype=np.int64))
    spellings = [b"ab a" + M.END, b"aab" + M.END, b"zzz" + M.END, b"ab a" + M.END]
    alone = [float(make().scores([s])[0]) for s in spellings]
    for held in (1_000_000, 0):
        monkeypatch.setattr(M, "HELD_GRAMS", held)
        tree = make()
        assert np.allclose([float(tree.scores([s])[0]) for s in spellings], alone)
        assert len(tree.known) == len(np.unique(M.grams(spellings if held else spellings[-1:], 1)))


def test_held_out_texts_score_above_word_counts(spark):
    """Whole documents at sf0.1: the tree gives held-out texts more than their word counts do."""
    docs = table(spark, "/root/testdata/sf0.1", "documents")
    out = M.score(docs, M.fold_of("doc_id", 7) == 2).where("held_out")
    base, own, better = out.agg(F.sum("base_score"), F.sum("score"), F.avg((F.col("score") > F.col("base_score")).cast("int"))).first()
    assert own > base and better > 0.7


def test_a_large_batch_is_not_made_strings_at_once(monkeypatch):
    """Blocks of 1 MB out of a batch of 24 MB: what is held of it as strings goes by the block, and no row is lost."""
    import tracemalloc

    monkeypatch.setattr(M, "BLOCK_BYTES", 1 << 20)
    n = 12_000
    batch = pa.record_batch([pa.array(range(n), pa.int64()), pa.array([f"{k:06d} " + "x" * 2000 for k in range(n)])], names=["doc_id", "text"])
    seen = []
    tracemalloc.start()
    try:
        for block in M.blocks(iter([batch])):
            assert sum(map(len, block["text"])) < 1 << 21
            seen += block["doc_id"]
        assert tracemalloc.get_traced_memory()[1] < 6 << 20
    finally:
        tracemalloc.stop()
    assert seen == list(range(n))


def test_texts_come_to_python_in_small_batches(spark, monkeypatch):
    """Batches go by bytes while the operator runs, and the session's setting is as before."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    monkeypatch.setattr(M, "BATCH_BYTES", 100_000)
    docs = spark.createDataFrame([(k, f"{k} " * 2000) for k in range(200)], "doc_id long, text string").coalesce(1)

    def sizes(batches):
        for b in batches:
            yield pa.record_batch([pa.array([b.nbytes], pa.int64())], names=["n"])

    with M.small_batches(spark):
        got = [r["n"] for r in docs.mapInArrow(sizes, "n long").collect()]
    assert len(got) > 10 and max(got) < 200_000
    assert len(M.score(docs, M.fold_of("doc_id", 7) == 2).collect()) == 200 and spark.conf.get(name) == before


def test_counts_of_a_block_missing_an_answer_are_refused(spark):
    """Each block's rows are told by number: an answer that is lost, or told of other rows, is no silent undercount."""
    docs = spark.createDataFrame(texts(), "doc_id long, text string").repartition(3)
    none = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    sent = M.materialise(M.word_blocks(M.text_rows(docs, F.lit(False)), 5, none))
    assert sent.where("rows is not null").count() == sent.select("block").distinct().count() and sent.where("rows is null").count()
    assert M.word_scores(sent, 1, 1).count() == len(texts())
    lost = sent.where("rows is null").select("block", "part").first()
    with pytest.raises(Exception, match="another order"):
        M.word_scores(sent.where((F.col("block") != lost["block"]) | (F.col("part") != lost["part"])), 1, 1).count()


def test_a_shard_arrives_as_the_arrays_that_were_sent():
    """No pickled copy beside a shard's arrays; scoring through them does not change them."""
    rows = [(0, False, b, -2.0) for b in range(256)]
    columns = [pa.array(x, t) for x, t in zip(zip(*rows), (pa.int32(), pa.bool_(), pa.int64(), pa.float64()))]
    sent = vars(M.Tree(pa.table(columns, names=["level", "is_context", "key", "value"]), 1, True, np.empty(0, dtype=np.int64)))
    for _ in range(2):
        tree = M.Tree.of(sent)
        assert tree.grams[0][1] is sent["grams"][0][1] and len(tree.known) == 0
        assert np.allclose(tree.scores([b"ab" + M.END]), -6.0) and len(sent["known"]) == 0
