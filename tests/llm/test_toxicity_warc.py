from __future__ import annotations

import gzip
import hashlib
import io
import itertools
import random
import time
import zlib

import pytest
from pyspark.sql import functions as F

from cohortwise.llm import toxicity, warc
from cohortwise.llm.common import py_fold, shared_folder


def test_fold_reads_homoglyphs_digits_and_accents():
    assert toxicity.fold("1D10T") == " idiot "
    assert toxicity.fold("іdіоt") == " idiot "  # Cyrillic letters
    assert toxicity.fold("Réeux, 2024 x") == " reeux 2024 x "
    assert toxicity.fold("") == "  "


def test_exceptions_mask_terms_and_length_normalises():
    m = toxicity.matcher({" clown ": 4.0, " achlich": 2.0}, ["class clown"])
    assert toxicity.evidence(m, toxicity.fold("the class clown laughed")) == 0
    short, long = (toxicity.evidence(m, toxicity.fold("you clown" + " word" * n)) for n in (3, 3000))
    assert short > long > 0
    assert toxicity.evidence(m, toxicity.fold("achlichpf ist")) > 0
    assert toxicity.evidence(m, toxicity.fold("nachlich")) == 0  # stems match at the start of a word only


def readings(word):
    return {"".join(c) for c in itertools.product(*("il" if x == "ı" else x for x in word))}


def test_both_readings_of_one_and_masks_against_brute_force():
    rng = random.Random(5)
    weights = {" kill": 3.0, " loser ": 2.0, " ioser ": 1.0, " lil ": 4.0, " fail ": 1.5, " clown ": 2.5}
    exceptions = ["class clown", "loser lil kill", "lil fail"]
    found = toxicity.matcher(weights, exceptions)
    words = ["ki11", "kill", "k11ling", "1oser", "loser", "l1l", "1i1", "fai1", "fall", "clown", "c1own", "class", "c1ass", "x", "11", "1ll"]
    assert toxicity.evidence(found, toxicity.marked("ki11")) > 0 and toxicity.evidence(found, toxicity.marked("a 1oser")) > 0
    assert toxicity.evidence(found, toxicity.marked("fal1")) == 0  # fall or fali
    for _ in range(300):
        text = toxicity.marked(" ".join(rng.choice(words) for _ in range(rng.randrange(7))))
        hits, masks = set(), set()
        for read in readings(text):
            for key, w in [*weights.items(), *((f" {e} ", None) for e in exceptions)]:
                for at in range(len(read)):
                    if read.startswith(key, at):
                        (masks if w is None else hits).add((at, at + len(key) - 1, w))
        kept = {h for h in hits if not any(a <= h[0] and h[1] <= b for a, b, _ in masks)}
        assert set(found.outside(text)) == kept


def test_many_masks_take_linear_time():
    found = toxicity.matcher({" clown ": 2.5}, ["class clown"])

    def seconds(n):
        text = toxicity.marked("class clown here clown " * n)
        start = time.process_time()
        assert len(found.outside(text)) == n
        return time.process_time() - start

    seconds(1000)
    assert seconds(80_000) < 40 * max(seconds(8_000), 0.005)  # 10 in proportion, 100 by squares


def test_exception_phrases_are_learned(spark):
    rows = [(i, "what a gloopy day" if i % 4 else "you gloopy thing", int(i % 4 == 0)) for i in range(40)]
    rows += [(100 + i, f"such a gloopy person {i}", 1) for i in range(200)] + [(400 + i, f"plain text {i}", 0) for i in range(300)]
    model = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string, toxic int"))
    assert "gloopy day" in model.exceptions and "a gloopy" not in model.exceptions
    found = toxicity.matcher(model.weights, model.exceptions)
    assert toxicity.evidence(found, toxicity.marked("one gloopy day")) == 0 < toxicity.evidence(found, toxicity.marked("gloopy person"))


def labelled(spark, n=400):
    rows = []
    for i in range(n):
        toxic = i % 4 == 0
        rows.append((i, f"text number {i % 7} about plain things" + (" you total 1diot scumbag" if toxic else ""), int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int")


def test_scores_learn_and_take_any_row(spark):
    model = toxicity.fit(labelled(spark))
    docs = spark.createDataFrame([(1, "an idiot, a SCUMBAG"), (2, "plain things"), (2, "plain things"), (3, None), (4, ""), (None, "total idiot scumbag " + "x" * 200_000)], "doc_id long, text string").withColumn("score", F.lit("clash"))
    got = {(r.doc_id, r.predicted): r.score for r in toxicity.score(docs, model).collect()}
    assert set(got) == {(1, 1), (2, 0), (3, 0), (4, 0), (None, 1)}
    assert all(0 <= s <= 1 for s in got.values()) and got[1, 1] > got[2, 0] == got[3, 0]
    assert toxicity.score(docs, model).count() == 6
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_fit_without_a_label_of_one_kind(spark):
    model = toxicity.fit(labelled(spark).where("toxic = 0"))
    assert not model.weights and 0 < model.score(0.0) < 0.5


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    rows = toxicity.query(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    assert all(r.held_out == (py_fold(r.doc_id, 5) == 0) for r in rows)
    assert sum(r.predicted == r.toxic for r in rows) >= 0.93 * len(rows)


PAGES = [(5, "http://a/\r\nx", "same"), (3, None, "same"), (9, "http://b/", None), (8, "http://c/", ""), (7, "http://ü/", "ü\r\n\r\nWARC/1.1"), (7, "http://ü/", "ü\r\n\r\nWARC/1.1"), (None, "n", "same"), (1, "l", "long " * 300_000)]


def test_every_page_comes_back(spark):
    folder = shared_folder(spark)
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("payload", F.lit(1)).repartition(3)
    files = warc.write_and_normalise(pages, folder)
    got = sorted(warc.read_records(files, folder).drop("url").collect(), key=str)
    want = []
    for page, _, html in PAGES:
        data = (html or "").encode()
        first = min(p for p, _, h in PAGES if p is not None and (h or "") == (html or ""))
        want.append((page, len(data), warc.digest_of(data), "response" if page == first else "revisit", None if page == first else first))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_members_stand_alone_and_runs_agree(spark):
    folder = shared_folder(spark)
    files = warc.write_and_normalise(spark.createDataFrame(PAGES, "page_id long, url string, html string").coalesce(1), folder)
    (name,) = [r.file for r in files.collect()]
    data = warc.opened(f"{folder}/members/{name}.warc.gz").read()
    whole = list(warc.records(warc.inflate(io.BytesIO(data))))
    assert len(whole) == len(PAGES) and gzip.decompress(data)  # any gzip reader takes the members as one file
    again = warc.write_and_normalise(spark.createDataFrame(PAGES, "page_id long, url string, html string").coalesce(1), other := shared_folder(spark))
    assert again.count() == 1
    assert hashlib.md5(data).digest() == hashlib.md5(warc.opened(f"{other}/members/{name}.warc.gz").read()).digest()


def test_empty_pages(spark):
    folder = shared_folder(spark)
    files = warc.write_and_normalise(spark.createDataFrame([], "page_id long, url string, html string"), folder)
    assert warc.read_records(files, folder).count() == 0


def test_revisits_can_ask_for_a_least_size(spark):
    folder = shared_folder(spark)
    files = warc.write_and_normalise(spark.createDataFrame(PAGES, "page_id long, url string, html string"), folder, min_bytes=1)
    assert {r.record_type for r in warc.read_records(files, folder).where("payload_bytes = 0").collect()} == {"response"}


def test_cut_off_streams_are_refused():
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    data = z.compress(warc.record("response", 1, "u", b"x" * 1000, "D", 1000)) + z.flush()
    with pytest.raises((EOFError, ValueError, zlib.error)):
        list(warc.records(warc.inflate(io.BytesIO(data[:-20]))))
