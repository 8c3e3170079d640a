"""Toxicity: a weighted lexicon matched by Aho-Corasick over folded text.

Folding lower-cases, strips combining marks, maps look-alike letters of
other scripts to Latin ones, and reads digits and symbols inside words as
the letters they stand for ("1d10t"). The digit 1 stands for i or l: every
reading of a word with such digits is held against the lexicon. The lexicon holds words and word
stems (prefixes); a stem matches at the start of a word. Exception phrases
are matched by the same automaton: a term inside an exception does not
count. Exceptions of one to three words are learned too: phrases around a
term that several clean rows and no toxic row of the sample hold. Of the terms that match at one place (a word and its stems) the
heaviest counts; the sum over all places is normalised by the text's length
and turned into a probability.

Lexicon, weights, exceptions and the two calibration constants are learned
from a bounded sample of labelled training rows (``SAMPLE_ROWS``); every
text is then scored whole.

Defined results: null and empty texts have no match and get the score of a
text without matches; repeated rows are scored each on their own; further
columns of the input are left out of the output.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_sample, fold_of, materialise, table

#: Look-alike letters of other scripts, and what they are read as.
HOMOGLYPHS = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "к": "k", "м": "m", "т": "t", "в": "b", "н": "h",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    "ı": "i", "ł": "l", "ø": "o",
}
#: Digits and symbols read as letters where a word has a letter too. The mark ı stands for i or l; folded
#: text holds no other ı, which the table above reads as i.
DIGITS = {"0": "o", "1": "ı", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s"}
#: Phrases in which a lexicon term is harmless; more are learned.
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "class clown", "clown fish", "sore loser")

#: Bound of the labelled rows that the model is fitted on.
SAMPLE_ROWS = 12_000
STEMS = range(5, 9)
MIN_DOCS = 4

_GLYPH_TABLE = {ord(k): v for k, v in HOMOGLYPHS.items()}
_DIGIT_TABLE = {ord(k): v for k, v in DIGITS.items()}
_WORD = re.compile(r"[^\W_]+")
#: A token with such a digit or symbol; possessive, so that a long token without one is passed over once.
_LEET = re.compile(r"(?<![\w@$])[^\W013-578]*+[013-578@$][\w@$]*")
_LETTER = re.compile(r"[^\W\d_]")


def marked(text: str) -> str:
    """Words of folded letters between single blanks, blanks at both ends; ı where a 1 may be i or l."""
    text = text.lower()
    if not text.isascii():
        text = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).translate(_GLYPH_TABLE)
    text = _LEET.sub(lambda m: m[0].translate(_DIGIT_TABLE) if _LETTER.search(m[0]) else m[0], text)
    return f" {' '.join(_WORD.findall(text))} "


def fold(text: str) -> str:
    """The marked text with every 1 inside a word read as i."""
    return marked(text).replace("ı", "i")


class Matcher:
    """Aho-Corasick automata. A key " term" matches a word's start; an exception's weight is None."""

    def __init__(self, weights: dict[str, float], exceptions: list[str]):
        keys = [*weights.items(), *((f" {phrase} ", None) for phrase in exceptions)]
        self.plain = self._automaton({key: [(key, w)] for key, w in keys})
        alike: dict[str, list] = {}
        for key, w in keys:
            if "l" in key:
                alike.setdefault(key.replace("l", "i"), []).append((key, w))
        #: Keys with an l, where l and i are one letter: candidates for texts with a mark.
        self.alike = self._automaton(alike)

    @staticmethod
    def _automaton(keys: dict[str, list]):
        import ahocorasick

        found = ahocorasick.Automaton()
        for key, entries in keys.items():
            found.add_word(key, (len(key), entries))
        if len(found):
            found.make_automaton()
        return found

    def matches(self, text: str) -> Iterator[tuple[int, int, float | None]]:
        """First place, last place and weight of every key in any reading of a marked text."""
        read = text.replace("ı", "i")
        if len(self.plain):
            for end, (size, entries) in self.plain.iter(read):
                for _, w in entries:
                    yield end - size + 1, end, w
        if "ı" in text and len(self.alike):
            for end, (size, entries) in self.alike.iter(read.replace("l", "i")):
                start = end - size + 1
                here = text[start : end + 1]
                if "ı" in here:
                    for key, w in entries:
                        if all(x == y or (x == "ı" and y in "il") for x, y in zip(here, key)):
                            yield start, end, w

    def outside(self, text: str) -> list[tuple[int, int, float]]:
        """The matches of terms that lie inside no match of an exception."""
        masks: list[tuple[int, int]] = []
        hits: list[tuple[int, int, float]] = []
        for start, end, w in self.matches(text):
            masks.append((start, end)) if w is None else hits.append((start, end, w))
        if not masks or not hits:
            return hits
        masks.sort()
        starts, reach = [a for a, _ in masks], list(accumulate((b for _, b in masks), max))
        # of the masks that start at or before a hit, the one that reaches farthest holds it if any does
        return [h for h in hits if not ((k := bisect_right(starts, h[0])) and reach[k - 1] >= h[1])]


def matcher(weights: dict[str, float], exceptions: list[str]) -> Matcher:
    return Matcher(weights, exceptions)


def evidence(found: Matcher, text: str) -> float:
    """Sum, over the places where terms match outside exception phrases, of the heaviest term's weight; divided by the root of the length."""
    best: dict[int, float] = {}  # of the terms that match at one place (a word, its stems) the heaviest
    for start, _, w in found.outside(text):
        best[start] = max(best.get(start, 0.0), w)
    if not best:
        return 0.0
    words = text.count(" ") - 1
    return sum(best.values()) / math.sqrt(1 + words / 200)


def phrases_of(found: Matcher, text: str) -> set[str]:
    """The phrases of two and three words of a marked text that hold a match of a term."""
    words = text.split()
    number = {at: k for k, at in enumerate(accumulate((len(w) + 1 for w in words), initial=0))}  # of the blank before a word
    out = set()
    for k in {number[start] for start, _, _ in found.outside(text)}:
        for n in (2, 3):
            out.update(" ".join(words[a : a + n]) for a in range(max(0, k - n + 1), min(k, len(words) - n) + 1))
    return {p.replace("ı", "i") for p in out}


def terms_of(folded: str) -> set[str]:
    """Candidate terms: whole words (" word ") and stems (" stem")."""
    words = set(folded.split())
    out = {f" {w} " for w in words if len(w) >= 3}
    for n in STEMS:
        out.update(" " + w[:n] for w in words if len(w) > n)
    return out


def _count_terms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        toxic, clean = Counter(), Counter()
        for text, y in zip(pdf.text, pdf.toxic):
            (toxic if y else clean).update(terms_of(fold(text or "")))
        keys = list(toxic | clean)
        if keys:
            yield pd.DataFrame({"term": keys, "n_toxic": [toxic[k] for k in keys], "n_clean": [clean[k] for k in keys]})


class Model:
    """weights: key -> weight; exceptions: phrases; a, b: score = 1 / (1 + exp(-(a * evidence + b)))."""

    def __init__(self, weights: dict[str, float], exceptions: list[str], a: float, b: float):
        self.weights, self.exceptions, self.a, self.b = weights, exceptions, a, b

    def score(self, x):
        return 1 / (1 + np.exp(-np.clip(self.a * x + self.b, -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """One-dimensional logistic regression with a weak prior, by Newton steps."""
    w, m = np.zeros(2), np.column_stack([x, np.ones_like(x)])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(m @ w, -30, 30)))
        grad = m.T @ (p - y) + 0.05 * w
        step = np.linalg.solve((m * (p * (1 - p))[:, None]).T @ m + 0.05 * np.eye(2), grad)
        w -= step
        if abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def fit(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """labelled: (doc_id, text, toxic 0/1), training rows only."""
    rows = materialise(bounded_sample(labelled.where("toxic is not null").select("doc_id", "text", "toxic"), sample_rows, F.col("doc_id")))
    totals = {r["toxic"]: r["n"] for r in rows.groupBy((F.col("toxic") != 0).cast("int").alias("toxic")).agg(F.count("*").alias("n")).collect()}
    n_toxic, n_clean = totals.get(1, 0), totals.get(0, 0)
    if not n_toxic or not n_clean:
        p = min(max((n_toxic + 0.5) / (n_toxic + n_clean + 1), 0.01), 0.99)
        return Model({}, [], 1.0, math.log(p / (1 - p)))
    counts = (
        rows.select("text", "toxic").repartition(max(1, min(64, (n_toxic + n_clean) // 500 + 1)))
        .mapInPandas(_count_terms, "term string, n_toxic long, n_clean long")
        .groupBy("term").agg(F.sum("n_toxic").alias("n_toxic"), F.sum("n_clean").alias("n_clean"))
    )
    odds = F.log((F.col("n_toxic") + 0.5) / (n_toxic + 1)) - F.log((F.col("n_clean") + 0.5) / (n_clean + 1))
    # one standard error below the log-odds: rare terms need cleaner evidence
    sure = odds - F.sqrt(1 / (F.col("n_toxic") + 0.5) + 1 / (F.col("n_clean") + 0.5)) * 0.7
    lexicon = counts.where(F.col("n_toxic") >= MIN_DOCS).withColumn("w", odds).withColumn("sure", sure).where("w > 2.0 and sure > 1.0")
    weights = {r["term"]: float(r["w"]) for r in lexicon.select("term", "w").collect()}  # at most the words of the bounded sample
    stems = [t for t in weights if not t.endswith(" ")]
    learned: list[str] = []
    if stems:
        harmless = counts.where("n_toxic = 0 and n_clean >= 3 and term like '% '").where(F.col("term").rlike("^(" + "|".join(map(re.escape, stems)) + ")"))
        learned = [r["term"].strip() for r in harmless.select("term").collect()]
    exceptions = [*(fold(e).strip() for e in EXCEPTIONS), *learned]

    def count_phrases(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = matcher(weights, exceptions)
        for pdf in batches:
            toxic, clean = Counter(), Counter()
            for text, y in zip(pdf.text, pdf.toxic):
                (toxic if y else clean).update(phrases_of(found, marked(text or "")))
            keys = list(toxic | clean)
            if keys:
                yield pd.DataFrame({"term": keys, "n_toxic": [toxic[k] for k in keys], "n_clean": [clean[k] for k in keys]})

    if weights:
        phrases = rows.select("text", "toxic").mapInPandas(count_phrases, "term string, n_toxic long, n_clean long").groupBy("term").agg(F.sum("n_toxic").alias("n_toxic"), F.sum("n_clean").alias("n_clean"))
        exceptions += [r["term"] for r in phrases.where((F.col("n_toxic") == 0) & (F.col("n_clean") >= MIN_DOCS)).select("term").collect()]

    def evidences(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = matcher(weights, exceptions)
        for pdf in batches:
            yield pd.DataFrame({"x": [evidence(found, marked(t or "")) for t in pdf.text], "y": (pdf.toxic != 0).astype("float64")})

    xy = rows.select("text", "toxic").mapInPandas(evidences, "x double, y double").toPandas()  # two numbers for each row of the bounded sample
    return Model(weights, exceptions, *_logistic(xy.x.to_numpy(), xy.y.to_numpy()))


def score(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, score double, predicted int, for every row and its whole text."""

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = matcher(model.weights, model.exceptions)
        for pdf in batches:
            x = np.array([evidence(found, marked(t)) if t else 0.0 for t in pdf.text], dtype="float64")
            p = model.score(x)
            yield pd.DataFrame({"doc_id": pdf.doc_id, "score": p, "predicted": (p >= 0.5).astype("int32")})

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInPandas(scored, "doc_id long, score double, predicted int")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: fitted on labelled rows of folds 1 to 4 of 5, applied to every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    training = docs.where(fold_of("doc_id", 5) != 0).join(labels, "doc_id")
    held_out = (fold_of("doc_id", 5) == 0).alias("held_out")
    return score(docs, fit(training)).select("doc_id", held_out, "score", "predicted")
