from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cohortwise.llm import decontaminate, language_id, quality, simhash
from cohortwise.llm.common import py_fold

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.01"


def brute_statistics(text):
    text = text or ""
    words = WORD.findall(text)
    symbols = sum(c in "#*$%&|<>" for c in text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
    counts = Counter(windows)
    covered = {k + j for k, w in enumerate(windows) if counts[w] > 1 for j in range(8)}
    return len(words), sum(map(len, words)), symbols, dup, len(covered)


def test_statistics_by_brute_force():
    rng = random.Random(4)
    texts = [None, "", " \n\t", "é\x85ü\xa0x y", "a b c d e f g h " * 3, "a " * 9, "a\n\na\n \n b\na", "#|<> x"]
    texts += [" ".join(rng.choice("abc") for _ in range(rng.randrange(60))) for _ in range(40)]
    texts += ["\n".join(rng.choice(["x y", "x  y", "", "#1"]) for _ in range(20)) for _ in range(10)]
    for t in texts:
        assert quality.statistics(t)[:5] == brute_statistics(t)


def test_hash_collisions_do_not_count(monkeypatch):
    monkeypatch.setattr(quality, "_POWERS", np.zeros(8, dtype=np.uint64))  # every window has the same hash
    text = "a b c d e f g h i j k l a b c d e f g h"
    assert quality.statistics(text)[:5] == brute_statistics(text)


def test_mcd_ignores_junk_in_its_sample():
    rng = np.random.default_rng(0)
    clean, junk = rng.normal(size=(300, 3)), rng.normal(loc=9, scale=0.3, size=(90, 3))
    centre, inverse = quality.mcd(np.vstack([clean, junk]), np.full(3, 0.05))
    d = lambda x: np.einsum("ij,jk,ik->i", x - centre, inverse, x - centre)
    limit = quality.chi_square(3, 4.0)
    assert abs(centre).max() < 0.4 and (d(clean) < limit).mean() > 0.98 and (d(junk) > limit).all()


def corpus(spark):
    rng = random.Random(8)
    words = [f"w{rng.randrange(10**6)}x" for _ in range(400)]
    body = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(k, "en", "a" if k % 3 else None, body(rng.randrange(30, 400))) for k in range(200)]
    rows += [(300, "xx", "rare", body(90)), (301, None, None, body(80)), (302, "en", "a", " | ".join("ABC" * 30 for _ in range(40))), (303, "en", "a", None), (304, "en", "a", "few words"), (305, "en", "a", body(60_000)), (None, "en", "a", body(50))]
    return spark.createDataFrame([*rows, rows[0], rows[0]], "doc_id long, lang string, source string, text string").withColumn("distance", F.lit("x"))


def test_verdicts(spark):
    docs = corpus(spark).drop("distance")
    got = {r.doc_id: r for r in quality.judge(quality.with_statistics(docs)).collect()}
    assert quality.judge(quality.with_statistics(docs)).count() == docs.count()
    assert not got[302].kept and got[302].distance > quality.chi_square(len(quality.FLOOR), quality.CUTOFF_Z)
    assert got[303].base_failed and not got[303].kept and not got[304].kept
    assert got[300].kept and got[301].kept and got[None].kept  # small groups take the models above them
    assert sum(got[k].kept for k in range(200)) >= 198
    assert quality.judge(quality.with_statistics(docs.limit(0))).count() == 0
    few = quality.judge(quality.with_statistics(docs.where("doc_id in (300, 304)"))).collect()
    assert {(r.doc_id, r.kept, r.distance) for r in few} == {(300, True, None), (304, False, None)}


def test_labelled_documents_are_told_apart(spark):
    rows = quality.query(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").collect()
    clean = [r for r in rows if r.quality == 1 and not r.base_failed]
    assert sum(r.kept for r in clean) >= 0.98 * len(clean)
    junk = [r for r in rows if r.quality == 0]
    assert sum(not r.kept for r in junk) >= 0.9 * len(junk)


def test_probabilities_equal_a_plain_kneser_ney(spark):
    texts = {"a": ["abra cadabra", "abba", "Cab! 7 cab"], "b": ["xyz zyx éé", "zzz yyy"]}
    rows = [(k, lang, t) for lang, ts in texts.items() for k, t in enumerate(ts)] + [(9, None, "qqq"), (8, "a", None), (7, "b", "123")]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, lang string, text string"))
    assert model.langs == ["a", "b"]
    probes = ["   a", "abra", "cada", "zzzz", "qqqq", " éé ", "bra ", "dabx"]
    keys = np.array([sum(ord(c) << 16 * (3 - k) for k, c in enumerate(p)) for p in probes], dtype=np.uint64)
    got = model.log_prob(keys, 4)
    symbols = len({ch for ts in texts.values() for x in ts for ch in " ".join(re.findall(r"[^\W\d_]+", x.lower())) + " "})
    for c, lang in enumerate(model.langs):
        for row, p in zip(got, probes):
            assert math.isclose(math.exp(row[c]), plain_kneser_ney(texts[lang], p, symbols), rel_tol=1e-4), (lang, p)


def plain_kneser_ney(texts, gram, symbols):
    """The probability of a gram's last character after the others, with dictionaries; symbols: of all languages."""
    norm = [" ".join(re.findall(r"[^\W\d_]+", t.lower())) + " " for t in texts]
    top = Counter()
    for t in norm:
        padded = "   " + t
        for k in range(3, len(padded)):
            top[padded[k - 3 : k + 1]] += 1
    levels = [top]
    for _ in range(3):
        levels.insert(0, Counter(g[1:] for g in levels[0]))

    def prob(g):
        if not g:
            return 1 / (symbols + 1)
        counts = levels[len(g) - 1]
        n1, n2 = (sum(c == x for c in counts.values()) for x in (1, 2))
        d = min(max(n1 / (n1 + 2 * n2) if n1 else 0.5, 0.05), 0.95)
        same = [c for h, c in counts.items() if h[:-1] == g[:-1]]
        if not same:
            return prob(g[1:])
        return max(counts.get(g, 0) - d, 0) / sum(same) + d * len(same) / sum(same) * prob(g[1:])

    return prob(gram)


def test_language_rows_of_all_kinds(spark):
    rng = random.Random(1)
    make = lambda letters, n: " ".join("".join(rng.choice(letters) for _ in range(rng.randrange(2, 8))) for _ in range(n))
    train = spark.createDataFrame([(k, "aa" if k % 2 else "bb", make("abcde" if k % 2 else "vwxyz", 60)) for k in range(60)], "doc_id long, lang string, text string")
    judge = language_id.learn(train)
    rows = [(1, make("abcde", 40)), (2, make("VWXYZ", 40)), (3, None), (4, ""), (5, "12 !? 34"), (6, "語語語語 語語" * 40), (7, make("abcde", 60_000)), (7, "a"), (None, "abc de"), (1, "𐐀𐐁")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit("zz"))
    got = [(r.doc_id, r.lang_pred, r.rejected) for r in language_id.predict(docs, judge).collect()]
    assert got[0][1:] == ("aa", False) and got[1][1:] == ("bb", False) and got[6][1:] == ("aa", False)
    assert [g[1:] for g in got[2:5]] == [("und", True)] * 3
    assert got[5][1] in ("aa", "bb") and got[5][2]
    assert all(0 <= r.score <= 1 for r in language_id.predict(docs, judge).collect())
    nothing = language_id.learn(train.limit(0))
    assert {r.lang_pred for r in language_id.predict(docs, nothing).collect()} == {"und"}
    assert language_id.predict(docs.limit(0), judge).count() == 0


def test_chunks_and_bounds(spark, monkeypatch):
    is_letter = language_id.letters()
    texts = ["one Two", None, "", "3", "é" * 50, "a b"]
    train = spark.createDataFrame([(1, "x", "one two three"), (2, "y", "éé aa bb")], "doc_id long, lang string, text string")
    model = language_id.fit(train)
    want = model.entropies(texts, is_letter)
    monkeypatch.setattr(language_id, "CHUNK", 5)
    for a, b in zip(want, model.entropies(texts, is_letter)):
        assert np.allclose(a, b)
    small = language_id.fit(train, max_cells=2 * 4 * 4 * 6)
    assert all(len(k) <= 12 for k in small.keys)


def test_held_out_languages(spark):
    rows = language_id.query(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (py_fold(r.doc_id, 3) == 1) for r in rows)
    assert sum(r.lang_pred == r.lang for r in held) >= 0.97 * len(held)


@pytest.fixture(scope="module")
def stages(spark):
    """Every stage's rows over sf0.01, by name, with the input first."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = {"documents": docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialise(stage(spark, docs, SF))
        out[name] = docs.collect()
    return out


def test_stage_columns_and_rejections(stages):
    columns = stages["documents"][0].asDict().keys()
    for name, _ in corpus_pipeline.STAGES[:-1]:
        assert stages[name][0].asDict().keys() == columns
    gone = len(stages["documents"]) - len(stages["language_id"])
    assert gone <= 0.01 * len(stages["documents"])
    assert all(re.search(r"[^\W\d_]", r.text) for r in stages["language_id"])


def test_stage_line_dedup_by_brute_force(stages):
    before = {r.doc_id: r.text or "" for r in stages["language_id"]}
    holders = defaultdict(set)
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    for d, t in before.items():
        for line in t.split("\n"):
            if len(key(line)) >= 40:
                holders[key(line)].add(d)
    lost = {k: max(v) for k, v in holders.items() if len(v) >= 5}
    assert lost
    for r in stages["line_dedup"]:
        want = "\n".join(x for x in before[r.doc_id].split("\n") if lost.get(key(x), r.doc_id) == r.doc_id)
        assert (r.text, r.n_chars) == (want, len(want))


def test_stage_simhash_by_brute_force(stages):
    prints = {r.doc_id: simhash.fingerprint(r.text) for r in stages["line_dedup"]}
    ids = sorted(prints)
    parent = {d: d for d in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    values = np.array([prints[d] for d in ids], dtype=np.uint64)
    for k, d in enumerate(ids):
        for j in np.flatnonzero(np.bitwise_count(values[k + 1 :] ^ values[k]) <= 3):
            parent[find(ids[k + 1 + int(j)])] = find(d)
    groups = defaultdict(list)
    for d in ids:
        groups[find(d)].append(d)
    assert sorted(r.doc_id for r in stages["simhash_near_dedup"]) == sorted(min(g) for g in groups.values())


def test_stage_decontaminate_by_containment(spark, stages):
    words = lambda t: " ".join(decontaminate.words_of(t))
    bench = [words(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    before = {r.doc_id: words(r.text) for r in stages["simhash_near_dedup"]}
    after = {r.doc_id for r in stages["decontaminate"]}
    holds = {d for d, t in before.items() if any(f" {b} " in f" {t} " for b in bench)}
    assert holds and not holds & after
    half = {d for d, t in before.items() if any(" ".join(b.split()[k : k + 6]) in t for b in bench for k in range(0, len(b.split()) - 6, 3))}
    assert set(before) - after <= half  # what goes shares passages with an item


def test_stage_mixing_comes_near_its_targets(stages):
    taken, target = Counter(), {}
    for r in stages["mix_sources"]:
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert r.taken <= 3 * r.size and r.size == len(WORD.findall(r.text or ""))
    assert len(stages["mix_sources"]) == len(stages["decontaminate"])
    assert all(abs(taken[s] - t) <= 0.01 * t + 1 for s, t in target.items())


def test_every_gram_is_kept(spark):
    rng = random.Random(5)
    text = " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(4_000))
    rows = [(k, f"l{k:02}", "a few words") for k in range(20)] + [(20, "l00", text)]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, lang string, text string"))
    padded = f"   {text} "
    assert len(model.keys[3]) >= len({padded[k : k + 4] for k in range(len(padded) - 3)}) > 5_000


def test_pruned_models_sum_to_one(spark):
    rows = [(1, "x", "one two three four five six"), (2, "y", "éé aa bb")]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, lang string, text string"), max_cells=2 * 4 * 4 * 6)
    symbols = sorted({c for r in rows for c in r[2]}) + ["Ω"]  # the last stands for all unseen ones
    for context in ("   ", "one", " tw", "éé ", "zzz"):
        keys = np.array([sum(ord(c) << 16 * (3 - k) for k, c in enumerate(context + s)) for s in symbols], dtype=np.uint64)
        assert np.allclose(np.exp(model.log_prob(keys, 4)).sum(axis=0), 1, atol=1e-5)


def test_outlier_models_are_fitted_on_all_rows(spark, monkeypatch):
    rng = np.random.default_rng(3)
    p = len(quality.FLOOR)
    x = rng.normal(size=(6_000, p)) * np.linspace(0.5, 2, p)
    x[4_500:] += 25  # junk: a quarter of the rows
    rows = spark.createDataFrame([(k, "en", "hot", v.tolist()) for k, v in enumerate(x)], "doc_id long, lang string, source string, vector array<double>").repartition(8)
    found = []
    for sample in (100, 400):  # the start may not decide
        monkeypatch.setattr(quality, "SAMPLE_ROWS", sample)
        m = quality.models(rows).first()
        found.append((np.array(m.centre), np.array(m.inverse).reshape(p, p)))
    (c1, i1), (c2, i2) = found
    assert abs(c1 - c2).max() < 0.01 and abs(i1 / np.diag(i1).max() - i2 / np.diag(i1).max()).max() < 0.01
    d = x - c1
    distance = np.einsum("ij,jk,ik->i", d, i1, d)
    assert abs(np.median(distance) / quality.chi_square(p, 0.0) - 1) < 0.02  # scaled by the median of all rows
    near = x[np.argsort(distance, kind="stable")[: int(quality.SUPPORT * len(x))]]
    assert abs(near.mean(axis=0) - c1).max() < 0.02


def test_short_texts_of_an_unlearned_language_are_rejected(spark):
    rng = random.Random(11)
    vocabulary = lambda letters: ["".join(rng.choice(letters) for _ in range(rng.randrange(3, 8))) for _ in range(150)]
    text = lambda words, n: " ".join(rng.choice(words) for _ in range(n))
    one, two, other = vocabulary("abcdefghijklm"), vocabulary("ijklmnopqrstu"), vocabulary("abcdefghijklmnopqrstu")
    rows = [(k, "one" if k % 2 else "two", text(one if k % 2 else two, rng.randrange(6, 80))) for k in range(1_200)]
    rows += [(5_000 + k, "one", text(two, 20)) for k in range(6)]  # mislabelled
    rows += [(6_000 + k, "tiny", "".join(rng.choice("vwxyz") for _ in range(60))) for k in range(3)]
    judge = language_id.learn(spark.createDataFrame(rows, "doc_id long, lang string, text string"))
    assert np.isfinite(judge.mean).all() and np.isfinite(judge.limit).all()
    is_letter = language_id.letters()
    rejected = lambda words: np.mean(judge.predict([text(words, 8) for _ in range(300)], is_letter)[3])
    assert rejected(other) > 0.9 and rejected(one) < 0.02 and rejected(two) < 0.02
    assert judge.predict(["語" * 9 + "vwxyzvvw語" * 9], is_letter)[3][0]


def test_letters_beyond_the_lower_planes_are_letters():
    """Two letters of CJK extension B, and a sign of the same plane that is none."""
    is_letter = language_id.letters()
    symbols, starts = language_id.normalise(["\U00020000\U00020001", "\U000E0001", "a"], is_letter)
    assert (symbols == language_id._OTHER).sum() == 2
    keys, at = language_id.grams(symbols, starts)
    assert [int(n > 0) for n in np.diff(at)] == [1, 0, 1]


def vectors(n, seed):
    """Correlated statistics, with an eighth of far rows."""
    rng, p = np.random.default_rng(seed), len(quality.FLOOR)
    x = rng.normal(size=(n, p)) @ (np.eye(p) + 0.3 * rng.normal(size=(p, p)))
    x[: n // 8] += rng.choice([2.0, 6.0, 20.0], size=(n // 8, 1)) * rng.normal(size=p)
    return x


def test_verdicts_equal_plain_concentration(spark):
    groups = {("en", "a"): vectors(2600, 1), ("en", None): vectors(1200, 2), ("de", "a"): vectors(300, 3)}
    data, ids = [], iter(range(10**6))
    for (lang, source), x in groups.items():
        data += [(next(ids), lang, source, row.tolist()) for row in x]
    rows = spark.createDataFrame(data, "doc_id long, lang string, source string, vector array<double>")
    hashes = dict(rows.select("doc_id", F.xxhash64("doc_id")).collect())
    fitted = {(r.lang, r.source): r for r in quality.models(rows).collect()}
    floors, limit, p = np.array(list(quality.FLOOR.values())), quality.chi_square(len(quality.FLOOR), quality.CUTOFF_Z), len(quality.FLOOR)
    distance = lambda x, centre, inverse: np.einsum("ij,jk,ik->i", x - centre, inverse, x - centre)
    rejected = 0
    for (lang, source), x in groups.items():
        order = np.argsort([hashes[d] for d, *key, _ in data if tuple(key) == (lang, source)], kind="stable")
        centre, inverse = quality.mcd(x[order[: quality.SAMPLE_ROWS]], floors)
        for _ in range(100):  # over all rows, sorted, until nothing moves
            near = x[np.argsort(distance(x, centre, inverse), kind="stable")[: max(int(quality.SUPPORT * len(x)), p + 1)]]
            centre, inverse = near.mean(axis=0), np.linalg.inv(np.cov(near.T) + np.diag(floors**2))
        plain = distance(x, centre, inverse)
        plain = plain / max(np.median(plain) / quality.chi_square(p, 0.0), 1.0)
        got = fitted[lang, source]
        own = distance(x, np.array(got.centre), np.array(got.inverse).reshape(p, p))
        assert np.quantile(abs(own / plain - 1), 0.99) < 0.1
        clear = abs(plain / limit - 1) > 0.1
        assert ((own <= limit) == (plain <= limit))[clear].all()
        rejected += int((plain > limit).sum())
    assert rejected > 100


def test_start_sample_does_not_grow_with_rows_or_tasks(spark):
    def counted(n, parts):
        rows = spark.range(0, n, 1, parts).select(F.col("id").alias("doc_id"), F.array(F.lit(0.5)).alias("vector"), F.explode(F.expr("array(1, 2)")).alias("level"), F.lit(None).cast("string").alias("lang"), F.lit("s").alias("source"))
        found = quality.candidates(rows.withColumn("h", quality.place_of(F.col("doc_id"), F.col("vector")))).where("level = 2")
        return {r.doc_id for r in found.collect()}, [r.id for r in spark.range(n).orderBy(F.xxhash64("id")).limit(quality.SAMPLE_ROWS).collect()]

    for n in (500, 20_000, 80_000):
        few, smallest = counted(n, 2)
        many, _ = counted(n, 60)
        assert few == many and few >= set(smallest) and len(few) < 3 * quality.SAMPLE_ROWS
