"""Quality rules: robust multivariate outliers per language and source.

Base statistics of every whole text are counted exactly. A vector of
transformed statistics (logarithms, square roots of shares) then goes
through a minimum-covariance-determinant model of the document's language
and source: the mean and covariance of the ``SUPPORT`` of its rows whose
covariance has the smallest determinant, found by concentration steps from
seeded starts, so that junk among the rows doesn't widen it. Documents
whose squared Mahalanobis distance passes ``CUTOFF`` are rejected.

The starts are made on at most ``SAMPLE_ROWS`` documents of a group, those
with the smallest hash of doc_id, found among the rows under a limit of the
hash that goes by the group's size. The concentration steps from the best start
and the final centre, covariance and scale run over all rows of every group:
each step adds up count, sums and products of the rows by class of distance
(``CLASSES`` to a doubling), combined in each task before the shuffle, and
takes the nearest classes that hold the support. A group of fewer than
``LEAST_ROWS`` documents takes its language's model, and that of all
documents if the language has as few. Documents that fail the base rules are
left out of the fit.
``FLOOR`` keeps a statistic that hardly varies in the sample (no symbols at
all, say) from rejecting documents over nothing.

Defined results: a null text has no words and fails the base rules; null
languages and sources are groups like others; without any model (too few
documents) only the base rules decide; repeated rows are judged alike;
further columns stay.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACE_CHARS, annotate, materialise, table

SYMBOLS = "#*$%&|<>"
WINDOW = 8
LEAST_WORDS, MOST_REPEATED = 20, 30
SAMPLE_ROWS, LEAST_ROWS = 800, 60
#: Share of the rows that a model describes, starts, concentration steps (on the sample, and then on all rows).
SUPPORT, STARTS, STEPS = 0.6, 24, 12
#: Classes of squared distance to a doubling; the steps end when no centre or covariance moves by more than SETTLED, in deviations.
CLASSES, SETTLED = 64, 1e-3
#: Transformed statistics and the least standard deviation that each is given.
FLOOR = {"log_words": 0.35, "word_length": 0.35, "symbols": 0.05, "repeated": 0.12, "dup_lines": 0.12, "distinct": 0.06, "upper": 0.05, "digits": 0.05, "punctuation": 0.05}
#: Standard normal quantile behind the cut-off of the squared distance.
CUTOFF_Z = 6.0
STATISTICS = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, vector array<double>"
_UPPER = bytes(range(65, 91))
_DIGITS = b"0123456789"
_PUNCTUATION = bytes(c for c in range(33, 127) if not chr(c).isalnum())
_POWERS = np.array([pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(WINDOW)], dtype=np.uint64)


def repeated_words(words: list[bytes], hashes: np.ndarray) -> int:
    """Words inside 8-word windows that the text holds twice or more."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    rolled = np.zeros(n, dtype=np.uint64)
    for k in range(WINDOW):
        rolled += hashes[k : k + n] * _POWERS[k]
    order = np.argsort(rolled, kind="stable")
    same = rolled[order][1:] == rolled[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, dtype=bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    at = np.flatnonzero(twice).tolist()
    windows = [tuple(words[k : k + WINDOW]) for k in at]  # the words themselves decide, not their hashes
    counts = Counter(windows)
    covered = np.zeros(len(words) + 1, dtype=np.int64)
    for k, w in zip(at, windows):
        if counts[w] > 1:
            covered[k] += 1
            covered[k + WINDOW] -= 1
    return int((np.cumsum(covered[:-1]) > 0).sum())


def statistics(text: str | None) -> tuple[int, int, int, int, int, list[float]]:
    text = text or ""
    data = text.encode()
    words = data.split()
    n = len(words)
    hashes = np.fromiter(map(hash, words), dtype=np.int64, count=n).view(np.uint64)
    chars = len(text) - sum(map(text.count, SPACE_CHARS))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [line for line in text.split("\n") if line.strip(SPACE_CHARS)]
    dup_lines = len(lines) - len(set(lines))
    repeat = repeated_words(words, hashes)
    without = lambda kind: (len(data) - len(data.translate(None, kind))) / max(1, len(data))
    distinct = len(set(words)) / n**0.85 if n else 0.0  # distinct words grow more slowly than words
    vector = [np.log1p(n), chars / max(1, n), (symbols / max(1, chars)) ** 0.5, (repeat / max(1, n)) ** 0.5, (dup_lines / max(1, len(lines))) ** 0.5, distinct, without(_UPPER) ** 0.5, without(_DIGITS) ** 0.5, without(_PUNCTUATION) ** 0.5]
    return n, chars, symbols, dup_lines, repeat, [float(x) for x in vector]


def with_statistics(docs: DataFrame) -> DataFrame:
    def make():
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.float64()))
        return lambda texts: [pa.array(c, kind) for c, kind in zip(zip(*map(statistics, texts.to_pylist())), kinds)]

    rows = annotate(docs.withColumn("text", F.col("text").cast("string")), ["text"], STATISTICS, make)
    return rows.withColumn("base_failed", F.expr(f"n_words < {LEAST_WORDS} or 100 * n_repeat_words > {MOST_REPEATED} * n_words"))


def chi_square(dimensions: int, z: float) -> float:
    """Quantile of the chi-square distribution at a normal quantile (Wilson and Hilferty)."""
    a = 2 / (9 * dimensions)
    return dimensions * (1 - a + z * a**0.5) ** 3


def mcd(x: np.ndarray, floors: np.ndarray, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Centre and inverse covariance of the minimum-covariance-determinant subset, scaled to the median distance."""
    n, p = x.shape
    h = max(int(SUPPORT * n), min(n, p + 1))
    ridge = np.diag(floors**2)
    rng, best = np.random.default_rng(seed), (np.inf, None)

    def moments(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        centre = rows.mean(axis=0)
        return centre, (rows - centre).T @ (rows - centre) / max(1, len(rows) - 1) + ridge

    def distances(centre: np.ndarray, covariance: np.ndarray) -> np.ndarray:
        return np.einsum("ij,jk,ik->i", x - centre, np.linalg.inv(covariance), x - centre)

    for start in range(STARTS):
        if start:
            chosen = x[rng.choice(n, size=min(n, p + 1), replace=False)]
        else:
            middle = np.median(x, axis=0)  # one start from the coordinatewise median
            chosen = x[np.argsort((((x - middle) / floors) ** 2).sum(axis=1), kind="stable")[:h]]
        centre, covariance = moments(chosen)
        for _ in range(STEPS):
            near = np.argsort(distances(centre, covariance), kind="stable")[:h]
            centre, new = moments(x[near])
            if np.allclose(new, covariance):
                break
            covariance = new
        determinant = np.linalg.slogdet(covariance)[1]
        if determinant < best[0]:
            best = determinant, (centre, covariance)
    centre, covariance = best[1]
    scale = np.median(distances(centre, covariance)) / chi_square(p, 0.0)
    return centre, np.linalg.inv(covariance * max(scale, 1.0))


GROUP = "level int, lang string, source string"


def squared_distance(vectors: pa.Array, centres: pa.Array, inverses: pa.Array) -> np.ndarray:
    """Squared Mahalanobis distances; NaN without a model."""
    p = len(FLOOR)
    out = np.full(len(vectors), np.nan)
    has = np.flatnonzero(~centres.is_null().to_numpy(zero_copy_only=False))
    if len(has):
        at = pa.array(has)
        x, c, inverse = (a.take(at).flatten().to_numpy() for a in (vectors, centres, inverses))
        d = (x - c).reshape(-1, p)
        out[has] = np.einsum("ij,ijk,ik->i", d, inverse.reshape(-1, p, p), d)
    return out


def inverted(covariance: np.ndarray, scale: float = 1.0) -> list[float]:
    p = len(FLOOR)
    return np.linalg.inv(np.asarray(covariance).reshape(p, p) * scale).ravel().tolist()


def by_class(spread: DataFrame, fitted: DataFrame) -> DataFrame:
    """Per group and class of distance under the fitted models: rows, sums and products of the differences from the centre."""
    p = len(FLOOR)
    names = ("level", "lang", "source")
    models = fitted.select(*(F.col(c).alias(f"m_{c}") for c in names), "centre", "inverse")
    same = (F.col("level") == F.col("m_level")) & F.col("lang").eqNullSafe(F.col("m_lang")) & F.col("source").eqNullSafe(F.col("m_source"))
    joined = spread.join(models, same).select(*names, "vector", "centre", "inverse")

    def make():
        def differences(vectors, centres, inverses):
            d2 = squared_distance(vectors, centres, inverses)
            classes = np.floor(np.log2(np.maximum(d2, 1e-9)) * CLASSES).astype(np.int32)
            d = vectors.flatten().to_numpy() - centres.flatten().to_numpy()
            return [pa.array(classes, pa.int32()), *(pa.array(d[k::p]) for k in range(p))]

        return differences

    rows = annotate(joined, ["vector", "centre", "inverse"], ", ".join(["class int", *(f"d{k} double" for k in range(p))]), make)
    sums = [F.sum(f"d{k}").alias(f"s{k}") for k in range(p)]
    products = [F.sum(F.col(f"d{j}") * F.col(f"d{k}")).alias(f"q{j}_{k}") for j in range(p) for k in range(j, p)]
    return rows.groupBy(*names, "class").agg(F.count("*").alias("n"), *sums, *products)


def concentrated(classes: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, float]:
    """Shift of the centre and covariance of the nearest classes that hold the support, and the median distance of all rows."""
    p = len(FLOOR)
    t = classes.sort_values("class", ignore_index=True)
    upto = t["n"].cumsum().to_numpy()
    total = int(upto[-1])
    last = int(np.searchsorted(upto, max(int(SUPPORT * total), min(total, p + 1))))
    near = t.iloc[: last + 1]
    n = int(upto[last])
    shift = near[[f"s{k}" for k in range(p)]].sum().to_numpy() / n
    products = np.zeros((p, p))
    for j in range(p):
        for k in range(j, p):
            products[j, k] = products[k, j] = near[f"q{j}_{k}"].sum()
    covariance = (products - n * np.outer(shift, shift)) / max(1, n - 1) + np.diag(np.array(list(FLOOR.values())) ** 2)
    middle = int(np.searchsorted(upto, (total + 1) / 2))
    before = int(upto[middle - 1]) if middle else 0
    within = ((total + 1) / 2 - before) / int(t["n"].iloc[middle])  # the class's rows taken as evenly spread
    return shift, covariance, float(2 ** ((t["class"].iloc[middle] + within) / CLASSES))


def place_of(doc_id: Column, vector: Column) -> Column:
    """The hash by which the start sample is taken; rows without an id are told apart by their vectors."""
    return F.when(doc_id.isNull(), F.xxhash64(doc_id, vector)).otherwise(F.xxhash64(doc_id))


def candidates(spread: DataFrame) -> DataFrame:
    """spread: (.., h, level, lang, source). The rows that may be in a group's start sample: about ``2 * SAMPLE_ROWS`` hashes of each.

    The share of the hash's range comes from a sketch of fixed size of the
    group's distinct hashes, so what goes to the ranking does not grow with
    the rows, nor with the tasks that read them. An estimate is off by some
    5%, which leaves ``SAMPLE_ROWS`` hashes under the limit in any case. Only
    copies of one row (equal ids too) share a hash; a task sends ``SAMPLE_ROWS``
    of them at most.
    """
    names = ("level", "lang", "source")
    limits = materialise(spread.groupBy(*names).agg((F.lit(2.0 * SAMPLE_ROWS) / F.approx_count_distinct("h")).alias("share")))
    limits = limits.select(*(F.col(c).alias(f"l_{c}") for c in names), "share")
    same = (F.col("level") == F.col("l_level")) & F.col("lang").eqNullSafe(F.col("l_lang")) & F.col("source").eqNullSafe(F.col("l_source"))
    at = (F.col("h").cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return spread.join(limits, same & (at <= F.col("share"))).select(*spread.columns)


def models(rows: DataFrame) -> DataFrame:
    """rows: (doc_id, lang, source, vector). A model for each (lang, source): lang, source, centre, inverse (null without one)."""
    floors = np.array(list(FLOOR.values()))
    p = len(FLOOR)
    rows = materialise(rows)  # read once a step

    def start(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("place", ignore_index=True)
        centre, inverse = mcd(np.stack(pdf["vector"].to_numpy()), floors)
        return pd.DataFrame({"level": pdf["level"].iloc[:1], "lang": pdf["lang"].iloc[:1], "source": pdf["source"].iloc[:1], "centre": [centre.tolist()], "inverse": [inverse.ravel().tolist()]})

    def step(pdf: pd.DataFrame) -> pd.DataFrame:
        """A concentration step's model; moved: by how much it differs from the last; scaled: the last, by the median of all rows."""
        shift, covariance, median = concentrated(pdf)
        shift, covariance = shift.round(10), covariance.round(10)  # whatever the order in which the sums met
        old = np.linalg.inv(np.array(pdf["inverse"].iloc[0]).reshape(p, p))
        widths = np.sqrt(np.diag(old))
        moved = max(float((abs(shift) / widths).max()), float((abs(covariance - old) / np.outer(widths, widths)).max()))
        centre = np.array(pdf["centre"].iloc[0])
        scaled = inverted(old, max(median / chi_square(p, 0.0), 1.0))
        return pd.DataFrame({"level": pdf["level"].iloc[:1], "lang": pdf["lang"].iloc[:1], "source": pdf["source"].iloc[:1], "centre": [(centre + shift).tolist()], "inverse": [inverted(covariance)], "last": [centre.tolist()], "scaled": [scaled], "moved": [moved]})

    null = F.lit(None).cast("string")
    level = lambda k, lang, source: F.struct(F.lit(k).alias("level"), lang.alias("lang"), source.alias("source"))
    levels = F.explode(F.array(level(0, F.col("lang"), F.col("source")), level(1, F.col("lang"), null), level(2, null, null)))
    spread = rows.select("doc_id", "vector", place_of(F.col("doc_id"), F.col("vector")).alias("h"), levels.alias("g")).select("doc_id", "vector", "h", "g.*")
    order = Window.partitionBy("level", "lang", "source").orderBy("h", "doc_id", "vector")
    sample = candidates(spread).withColumn("place", F.row_number().over(order)).where(F.col("place") <= SAMPLE_ROWS)
    enough = sample.withColumn("n", F.count("*").over(Window.partitionBy("level", "lang", "source"))).where(F.col("n") >= LEAST_ROWS)
    kinds = f"{GROUP}, centre array<double>, inverse array<double>"
    fitted = materialise(enough.groupBy("level", "lang", "source").applyInPandas(start, kinds))
    if fitted.isEmpty():
        return rows.select("lang", "source").distinct().select("lang", "source", F.lit(None).cast("array<double>").alias("centre"), F.lit(None).cast("array<double>").alias("inverse"))
    names = ["level", "lang", "source"]
    for k in range(STEPS + 1):  # the last one measures the model of the step before over all rows
        known = fitted.select(*(F.col(c).alias(f"m_{c}") for c in names), "centre", "inverse")
        same = (F.col("level") == F.col("m_level")) & F.col("lang").eqNullSafe(F.col("m_lang")) & F.col("source").eqNullSafe(F.col("m_source"))
        steps = by_class(spread, fitted).join(known, same).drop("m_level", "m_lang", "m_source")
        fitted = materialise(steps.groupBy(*names).applyInPandas(step, f"{kinds}, last array<double>, scaled array<double>, moved double"))
        if k and fitted.agg(F.max("moved")).first()[0] <= SETTLED:
            break
    fitted = fitted.select(*names, F.col("last").alias("centre"), F.col("scaled").alias("inverse"))
    found = rows.select("lang", "source").distinct()
    for k, on in enumerate((("lang", "source"), ("lang",))):
        model = fitted.where(F.col("level") == k).select(*(F.col(c).alias(f"{c}{k}") for c in on), F.struct("centre", "inverse").alias(f"m{k}"))
        same = F.lit(True)
        for c in on:
            same = same & F.col(c).eqNullSafe(F.col(f"{c}{k}"))
        found = found.join(model, same, "left").drop(*(f"{c}{k}" for c in on))
    whole = fitted.where("level = 2").select("centre", "inverse").first()  # one model, of a fixed size
    last = [F.struct(F.lit(whole["centre"]).alias("centre"), F.lit(whole["inverse"]).alias("inverse"))] if whole else []
    return found.select("lang", "source", F.coalesce("m0", "m1", *last).alias("m")).select("lang", "source", "m.*")


def judge(docs: DataFrame, cutoff_z: float = CUTOFF_Z) -> DataFrame:
    """docs: with_statistics rows with doc_id, lang, source. Adds distance (squared; null without a model) and kept."""
    fitting = docs.where(~F.col("base_failed")).select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), "vector")
    found = models(fitting).withColumnsRenamed({"lang": "m_lang", "source": "m_source"})
    joined = docs.join(found, docs["lang"].cast("string").eqNullSafe(F.col("m_lang")) & docs["source"].cast("string").eqNullSafe(F.col("m_source")), "left").drop("m_lang", "m_source")

    def make():
        return lambda *columns: [pa.array(squared_distance(*columns), pa.float64(), from_pandas=True)]

    judged = annotate(joined, ["vector", "centre", "inverse"], "distance double", make).drop("centre", "inverse")
    limit = chi_square(len(FLOOR), cutoff_z)
    return judged.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("distance") <= limit, F.lit(True)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: every document's statistics and verdict."""
    rows = materialise(with_statistics(table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")).drop("text"))
    return judge(rows).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")
