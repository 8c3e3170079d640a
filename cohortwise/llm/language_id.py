"""Language ID: interpolated Kneser-Ney character models, one for each language.

Texts are lower-cased; runs of letters stand between single blanks. For
every language the 4-grams of characters are counted over all its training
texts; the lower orders hold continuation counts (in how many types a gram
ends), each order has its own absolute discount, and the mass that
discounting frees goes to the next lower order, down to a uniform share.

A gram of up to four characters is packed into one 64-bit key. A language's
model is for each order a sorted array of keys with their log probabilities,
and one of contexts with the log weights of the lower order; it holds what
the language has, not what the others have. A text goes to the language of the
lowest cross-entropy per character. Rejected are null texts, those without
letters, and those of a cross-entropy above their language's limit, which
short texts widen. The limits are calibrated on a bounded sample of training
rows of each language, by models without these rows' counts: robust centre
and spread, in whose units the limit is passed by ``FALSE_REJECTIONS`` of the
language's own texts. Rows that another language's model claims are taken as
mislabelled. A language of too few rows takes the quantile of all languages'
rows, and centre and spread from them; no limit is infinite.

Counts cover all training rows; they are combined in each task before the
shuffle. Every gram counted is in the arrays sent to the tasks, so these grow
with the distinct grams of all languages (12 bytes a gram or context). Only a
caller that gives ``fit`` a bound loses grams, those of the smallest counts;
the weights of the lower orders then take over what the lost ones had.

Defined results: ``und`` with score 0 for null texts, texts without a letter
and without any learned language; ties go to the first language by name;
repeated rows are counted and predicted each; null languages teach nothing;
further columns stay. Letters beyond the 16-bit planes share one symbol.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import annotate, fold_of, materialise, ship, table

ORDER = 4
#: Rows of each language that calibrate the rejection, about: at most so many, and this share of its rows.
CALIBRATION_ROWS, CALIBRATION_SHARE = 4_000, 0.25
#: Share of a language's own texts that its limit may reject; the limit, in deviations, where fewer rows than that needs are there.
FALSE_REJECTIONS, FEW_Z = 0.002, 8.0
#: Rows from which a language has a centre and a spread of its own.
LEAST_ROWS = 5
#: Characters whose evidence the score counts, tempered.
SCORE_CHARS, TEMPER = 200, 0.25
#: Characters that are worked on at once.
CHUNK = 1 << 20
_OTHER = 0xFFFE


def letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def normalise(texts: list[str], is_letter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols (uint64) of all texts, each after ORDER - 1 blanks, and the place of each text's first symbol (with an end place)."""
    low = [f" {t.lower()} " for t in texts]
    codes = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = is_letter[codes]
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # a blank after each word, which follows a letter
    ends = np.cumsum([len(t) for t in low])
    sizes = np.diff(np.concatenate([[0], np.cumsum(keep)[ends - 1]]))
    symbols = np.where(letter, np.where(codes > 0xFFFF, _OTHER, codes), 32)[keep]
    pad = ORDER - 1
    out = np.full(len(symbols) + pad * len(texts), 32, dtype=np.uint64)
    starts = np.concatenate([[0], np.cumsum(sizes + pad)])
    out[np.arange(len(symbols)) + np.repeat(pad * np.arange(1, len(texts) + 1), sizes)] = symbols
    return out, starts


def grams(symbols: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The key of the ORDER-gram that ends at each symbol of the texts, and each text's first place among them."""
    key = symbols.copy()
    for back in range(1, ORDER):
        key[back:] |= symbols[:-back] << np.uint64(16 * back)
    real = np.ones(len(symbols), dtype=bool)
    for k in range(ORDER - 1):
        real[starts[:-1] + k] = False
    return key[real], starts - (ORDER - 1) * np.arange(len(starts))


def chunks(texts: list[str | None]) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of about CHUNK characters, with the place of their first; a longer text is a run of its own."""
    low, size = 0, 0
    for k, t in enumerate(texts):
        if size and size + len(t or "") > CHUNK:
            yield low, [x or "" for x in texts[low:k]]
            low, size = k, 0
        size += len(t or "")
    if low < len(texts):
        yield low, [x or "" for x in texts[low:]]


def count_grams(training: DataFrame) -> DataFrame:
    """training: (lang, text, held). Returns lang, held, gram, n over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        is_letter, seen = letters(), {}
        for batch in batches:
            by_lang: dict[tuple[str, bool], list[str]] = {}
            for lang, text, held in zip(*(column.to_pylist() for column in batch.columns)):
                by_lang.setdefault((lang, held), []).append(text)
            for lang, texts in by_lang.items():
                for _, run_of in chunks(texts):
                    keys, n = np.unique(grams(*normalise(run_of, is_letter))[0], return_counts=True)
                    if lang in seen:  # one sorted array for each language, held out or not, and task
                        old, old_n = seen[lang]
                        keys, at = np.unique(np.concatenate([old, keys]), return_inverse=True)
                        n = np.bincount(at, weights=np.concatenate([old_n, n]), minlength=len(keys)).astype(np.int64)
                    seen[lang] = keys, n
        for (lang, held), (keys, n) in seen.items():
            for k in range(0, len(keys), 100_000):
                part = keys[k : k + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part), pa.string()), pa.array([held] * len(part)), pa.array(part.view(np.int64)), pa.array(n[k : k + 100_000])], names=["lang", "held", "gram", "n"])

    plain = training.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"), "held").where("lang is not null and text is not null")
    return plain.mapInArrow(run, "lang string, held boolean, gram long, n long").groupBy("lang", "held", "gram").agg(F.sum("n").alias("n"))


class Order:
    """One order of one language: keys with their counts, and per context the total over all its grams, kept or not."""

    def __init__(self, keys: np.ndarray, n: np.ndarray, contexts: np.ndarray, totals: np.ndarray, discount: float):
        self.keys, self.n, self.contexts, self.totals, self.discount = keys, n, contexts, totals, discount


def place(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of wanted in sorted keys, and whether they are there."""
    if not len(keys):
        return np.zeros(len(wanted), dtype=np.int64), np.zeros(len(wanted), dtype=bool)
    at = np.searchsorted(keys, wanted)
    at[at == len(keys)] = 0
    return at, keys[at] == wanted


def picked(values: np.ndarray, at: np.ndarray, known: np.ndarray, otherwise: float) -> np.ndarray:
    return np.where(known, values[at], otherwise) if len(values) else np.full(len(at), otherwise)


def gram_mask(order: int) -> np.uint64:
    return np.uint64((1 << 16 * order) - 1)


class Model:
    """The languages' models, each over sorted arrays of its own: keys, log probabilities, contexts, log weights by order."""

    def __init__(self, orders: dict[str, list[Order]], symbols: int):
        self.langs = sorted(orders)
        self.floor = -np.log(symbols + 1)
        self.orders: list[list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]] = []
        for x in self.langs:
            own: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
            for k, o in enumerate(orders[x]):
                lower = np.exp(self._of_language(own, o.keys & gram_mask(k), k))
                at, known = place(o.contexts, o.keys >> np.uint64(16))
                left = np.where(known, np.maximum(o.n - o.discount, 0), 0.0)
                # what the kept grams leave of a context's mass, also that of grams left out, goes to the lower order
                spare = o.totals - np.bincount(at, weights=left, minlength=len(o.totals)) if len(o.totals) else o.totals
                p = np.where(known, left / picked(o.totals, at, known, 1.0) + picked(spare / o.totals, at, known, 1.0) * lower, lower)
                own.append((o.keys, np.log(p).astype(np.float32), o.contexts, np.log(spare / o.totals).astype(np.float32)))
            self.orders.append(own)

    @property
    def keys(self) -> list[np.ndarray]:
        """The keys of each order, of all languages."""
        return [np.unique(np.concatenate([own[k][0] for own in self.orders])) for k in range(ORDER if self.langs else 0)]

    def _of_language(self, own: list, keys: np.ndarray, order: int) -> np.ndarray:
        if not order:
            return np.full(len(keys), self.floor)
        known_keys, log_p, contexts, log_w = own[order - 1]
        at, known = place(known_keys, keys)
        out = picked(log_p, at, known, 0.0)
        rest = np.flatnonzero(~known)
        if len(rest):
            at, known = place(contexts, keys[rest] >> np.uint64(16))
            out[rest] = self._of_language(own, keys[rest] & gram_mask(order - 1), order - 1) + picked(log_w, at, known, 0.0)
        return out

    def log_prob(self, keys: np.ndarray, order: int) -> np.ndarray:
        """A row of log probabilities (a column a language) for each gram of the order; each distinct gram is looked up once."""
        distinct, back = np.unique(keys, return_inverse=True)
        out = np.empty((len(distinct), len(self.langs)), dtype=np.float32)
        for c, own in enumerate(self.orders):
            out[:, c] = self._of_language(own, distinct, order)
        return out[back]

    def entropies(self, texts: list[str | None], is_letter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy per character (a column a language) and number of characters of each text; no letter: 0 characters."""
        sums, sizes = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts), dtype=np.int64)
        for low, run_of in chunks(texts):
            keys, starts = grams(*normalise(run_of, is_letter))
            n = np.diff(starts)
            full = np.flatnonzero(n)
            sizes[low : low + len(run_of)] = n
            if len(full):
                sums[low + full] = -np.add.reduceat(self.log_prob(keys, ORDER), starts[:-1][full], axis=0, dtype=np.float64)
        return sums / np.maximum(sizes, 1)[:, None], sizes


def fit(training: DataFrame, max_cells: int | None = None) -> Model:
    """training: (lang, text). Counts of all rows and every gram of them, unless max_cells bounds the grams and contexts kept."""
    return model_of(materialise(count_grams(training.withColumn("held", F.lit(False))).drop("held")), max_cells)


def model_of(counts: DataFrame, max_cells: int | None = None) -> Model:
    """counts: lang, gram, n."""
    mask = lambda k: F.lit((1 << 16 * k) - 1)
    levels = [counts]
    for k in range(ORDER - 1, 0, -1):  # continuation counts: of a gram's types one order up
        levels.insert(0, materialise(levels[0].groupBy("lang", F.col("gram").bitwiseAND(mask(k)).alias("gram")).agg(F.count("*").alias("n"))))
    langs = [r["lang"] for r in levels[0].select("lang").distinct().collect()]
    bound = None if max_cells is None else max_cells // max(1, 2 * ORDER * len(langs) ** 2)  # grams and contexts of each order and language
    orders: dict[str, list[Order]] = {x: [] for x in langs}
    for level in levels:
        ones = {r["lang"]: r for r in level.groupBy("lang").agg(F.count_if(F.col("n") == 1).alias("n1"), F.count_if(F.col("n") == 2).alias("n2")).collect()}
        contexts = level.groupBy("lang", F.shiftrightunsigned("gram", 16).alias("gram")).agg(F.sum("n").alias("n"))
        kept, kept_contexts = _arrays(level, bound), _arrays(contexts, bound)
        for x in langs:
            n1, n2 = ones[x]["n1"], ones[x]["n2"]
            discount = min(max(n1 / (n1 + 2 * n2) if n1 else 0.5, 0.05), 0.95)
            orders[x].append(Order(*kept[x], *kept_contexts[x], discount))
    return Model(orders, levels[0].select("gram").distinct().count())


def _arrays(rows: DataFrame, bound: int | None) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """gram and n of each language by gram; given a bound, a language of more rows keeps its classes of largest counts."""
    sizes = {r["lang"]: r["m"] for r in rows.groupBy("lang").agg(F.count("*").alias("m")).collect()}
    least = dict.fromkeys(sizes, 0)
    over = [x for x, m in sizes.items() if bound is not None and m > bound]
    size_class = F.floor(F.log2("n") * 8).cast("int")  # classes of counts: some hundreds at most
    if over:
        spread = rows.where(F.col("lang").isin(over)).groupBy("lang", size_class.alias("c")).agg(F.count("*").alias("m")).collect()
        for x in over:
            total = 0
            for c, m in sorted(((r["c"], r["m"]) for r in spread if r["lang"] == x), reverse=True):
                total += m
                if total > bound:
                    least[x] = c + 1
                    break
        floor = F.create_map(*(F.lit(v) for x in over for v in (x, least[x])))
        rows = rows.where(size_class >= F.coalesce(F.try_element_at(floor, "lang"), F.lit(0)))
    found = rows.select("lang", "gram", "n").toArrow().combine_chunks()
    names = found.column("lang").combine_chunks().dictionary_encode()
    code = {x: k for k, x in enumerate(names.dictionary.to_pylist())}
    codes, keys, n = names.indices.to_numpy(), found.column("gram").to_numpy().view(np.uint64), found.column("n").to_numpy()
    out = {}
    for x in sizes:
        own = np.flatnonzero(codes == code.get(x, -1))
        own = own[np.argsort(keys[own])]
        out[x] = keys[own], n[own].astype(np.float64)
    return out


class Judge:
    """A model and, for each language, centre and deviation of its texts' cross-entropy, spread per character, and limit in deviations."""

    def __init__(self, model: Model, mean: np.ndarray, deviation: np.ndarray, per_char: np.ndarray, limit: np.ndarray):
        self.model, self.mean, self.deviation, self.per_char, self.limit = model, mean, deviation, per_char, limit

    def predict(self, texts: list[str | None], is_letter: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Language, score, cross-entropy and rejected for each text."""
        if not self.model.langs:
            nothing = np.zeros(len(texts))
            return ["und"] * len(texts), nothing, nothing, np.ones(len(texts), dtype=bool)
        ce, n = self.model.entropies(texts, is_letter)
        best = ce.argmin(axis=1)
        rows = np.arange(len(texts))
        low = ce[rows, best]
        evidence = TEMPER * np.minimum(n, SCORE_CHARS)[:, None] * (ce - low[:, None])
        score = 1 / np.exp(-evidence).sum(axis=1)
        limit = self.mean[best] + self.limit[best] * np.sqrt(self.deviation[best] ** 2 + self.per_char[best] ** 2 / np.maximum(n, 1))
        none = n == 0
        score[none] = 0.0
        return ["und" if e else self.model.langs[b] for e, b in zip(none, best)], score, np.where(none, 0.0, low), none | (low > limit)


def held_out(training: DataFrame) -> DataFrame:
    """training with held: whether the row calibrates; a uniform share of each language's rows, by hash of doc_id."""
    lang = F.col("lang").cast("string")
    sizes = {r["lang"]: r["m"] for r in training.where("lang is not null and text is not null").groupBy(lang.alias("lang")).agg(F.count("*").alias("m")).collect()}
    below = {x: int(min(CALIBRATION_SHARE, CALIBRATION_ROWS / m) * (1 << 30)) for x, m in sizes.items()}
    limit = F.try_element_at(F.create_map(*(F.lit(v) for pair in below.items() for v in pair)), lang) if below else F.lit(0)
    return training.withColumn("held", F.coalesce(F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1 << 30)) < limit, F.lit(False)))


def spread_of(x: np.ndarray) -> float:
    return 1.4826 * float(np.median(abs(x))) if len(x) else 0.0


def quantile(z: np.ndarray) -> float | None:
    """The limit that a further value passes by FALSE_REJECTIONS at most; None if z is too short to tell."""
    at = int(np.ceil((len(z) + 1) * (1 - FALSE_REJECTIONS)))
    return float(np.sort(z)[at - 1]) if at <= len(z) else None


def calibrate(model: Model, without: Model, rows: DataFrame) -> Judge:
    """The model with limits from rows (lang, text), judged by the models that were fitted without them."""
    k = len(model.langs)
    at, ce, n = np.zeros(0, dtype=np.int64), np.zeros(0), np.zeros(0, dtype=np.int64)
    if without.langs:
        shipped = ship(rows.sparkSession, without)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, is_letter = shipped(), letters()
            for batch in batches:
                ce, n = own.entropies(batch.column(1).to_pylist(), is_letter)
                best = ce.argmin(axis=1)
                right = np.array([own.langs[b] == x for b, x in zip(best, batch.column(0).to_pylist())], dtype=bool) & (n > 0)
                yield pa.RecordBatch.from_arrays([pa.array(best[right]), pa.array(ce.min(axis=1)[right]), pa.array(n[right])], names=["at", "ce", "n"])

        plain = rows.where("lang is not null and text is not null").select(F.col("lang").cast("string"), F.col("text").cast("string"))
        found = plain.mapInArrow(run, "at long, ce double, n long").toArrow()  # three numbers for each row of the sample
        at, ce, n = (found.column(c).to_numpy() for c in ("at", "ce", "n"))
        at = np.array([model.langs.index(x) for x in without.langs], dtype=np.int64)[at]
    # without any row: a text must be likelier than letters drawn evenly
    mean, deviation, per_char = np.full(k, -model.floor), np.zeros(k), np.zeros(k)
    long, short = n >= 50, n < 500
    enough = [c for c in range(k) if (long & (at == c)).sum() >= LEAST_ROWS]
    for c in enough:
        mean[c] = np.median(ce[long & (at == c)])
        deviation[c] = spread_of(ce[long & (at == c)] - mean[c]) + 0.05
    few = [c for c in range(k) if c not in enough]
    if enough:
        for c in few:
            own = ce[at == c]
            mean[c], deviation[c] = max(mean[enough].max(), np.median(own) if len(own) else 0.0), deviation[enough].max()
    else:
        for c in few:
            deviation[c] = 0.05
    short &= np.isin(at, enough)
    each = (ce - mean[at]) * np.sqrt(n)
    pooled = max(0.5, spread_of(each[short]))
    for c in range(k):
        own = each[short & (at == c)]
        per_char[c] = max(0.5, spread_of(own)) if len(own) >= LEAST_ROWS else pooled
    z = (ce - mean[at]) / np.sqrt(deviation[at] ** 2 + per_char[at] ** 2 / np.maximum(n, 1))
    of_all = quantile(z[np.isin(at, enough)])
    limit = np.empty(k)
    for c in range(k):
        own = quantile(z[at == c]) if c in enough else None
        limit[c] = own if own is not None else of_all if of_all is not None else FEW_Z
    return Judge(model, mean, deviation, per_char, np.maximum(limit, 0.0))


def learn(training: DataFrame) -> Judge:
    """training: (doc_id, lang, text). Texts are counted once, those that calibrate apart from the others."""
    rows = held_out(training)
    counts = materialise(count_grams(rows))
    model = model_of(materialise(counts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))))
    without = model_of(counts.where(~F.col("held")).drop("held"))
    return calibrate(model, without, rows.where("held"))


PREDICTED = "lang_pred string, score double, cross_entropy double, rejected boolean"


def predict(docs: DataFrame, judge: Judge, names: tuple[str, ...] = ("lang_pred", "score", "cross_entropy", "rejected")) -> DataFrame:
    """docs and the columns of PREDICTED, under the given names."""
    shipped = ship(docs.sparkSession, judge)

    def make():
        own, is_letter = shipped(), letters()

        def f(texts):
            lang, score, ce, rejected = own.predict(texts.to_pylist(), is_letter)
            return [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(ce, pa.float64()), pa.array(rejected, pa.bool_())]

        return f

    kinds = [x.split()[1] for x in PREDICTED.split(", ")]
    return annotate(docs.withColumn("text", F.col("text").cast("string")), ["text"], ", ".join(f"{n} {kind}" for n, kind in zip(names, kinds)), make)


def training_rows(docs: DataFrame) -> DataFrame:
    """Rows that may teach: a language is given, and the fold of doc_id is not 1 of 3."""
    return docs.where(F.col("lang").isNotNull() & (fold_of("doc_id", 3) != 1)).select("doc_id", "lang", "text")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: learned on folds 0 and 2, applied to every document."""
    docs = table(spark, sf_dir, "documents")
    judge = learn(training_rows(docs))
    out = predict(docs.select("doc_id", "text"), judge)
    return out.select("doc_id", (fold_of("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")
