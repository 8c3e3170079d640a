r"""Language-model scores of a probabilistic suffix tree, beside those of word counts.

Text: A-Z lower-cased; its words are what the six ASCII white-space
characters separate. The tree's symbols are bytes: a text is spelled as its
words with one space between and a line feed at the end, which no word holds,
so texts of equal words, and only they, are spelled alike, and the tree's
probabilities of all spellings sum to at most one.

The tree. Every training position counts its byte after the ``DEPTH`` bytes
before it (line feeds before the beginning); counts of shorter contexts are
sums of these. A context stays if its next-byte distribution diverges from
that of its parent, the context without its oldest byte: its count times the
Kullback-Leibler divergence must reach ``PENALTY`` log(training positions)
for each next byte that it has seen. Parents of what stays, stay. A state's
distribution is smoothed towards its parent's (Witten-Bell), the root's
towards equal shares of 256 bytes. A position is scored in the state of the
longest context that stays. All of this are Spark aggregations and joins over
all training texts; nothing is cut by size.

The tree goes to the tasks in shards of at most ``SHARD_ROWS`` rows, split by
the context's last two bytes: a position needs the states with its own last
two bytes only, so each shard scores its positions and a text's parts are
added up. (One pair of bytes is not split; contexts of one byte or none, at
most 65,792 rows, are in each shard.)

Word counts (``base_score``) need every word's count in every text, and the
vocabulary grows with the corpus, so it is never sent to tasks. Texts are
taken in blocks; a block's words go, with the places and numbers of their
occurrences, to the group of the word's hash, which counts the words and
returns to each block its texts' sums. What is known of the texts themselves
travels with one of a block's rows, so that blocks are made once and written
nowhere. The few words with at least a share of 2**-HEAVY_BITS of all (and
2**HEAVY_BITS occurrences), at most 2**HEAVY_BITS words, are the exception:
their counts go to the blocks, so that no group holds a hot word. Words are
told apart by 64-bit hashes.

Memory of a task goes by the constants below, not by its input: texts come to
Python in batches of ``BATCH_BYTES``, become strings ``SLICE_ROWS`` at a time
and are held by blocks; counts go back in pieces of ``OUT_ROWS``; a shard is
held once, as its arrays were sent.

Defined results: a null text is empty and has the end token alone; without
training texts, all words are unknown and counts are 0; a null doc_id is of
the fold of the empty text; rows that repeat a document get equal scores;
further columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold_of, materialise, ship, table

#: Longest context in bytes (at most 7), and the divergence asked for, in units of log(positions) a next byte seen.
DEPTH, PENALTY = 5, 0.1
#: Rows of the tree sent at once; occurrences of words that a group counts.
SHARD_ROWS, GROUP_WORDS = 4_000_000, 1 << 21
HEAVY_BITS = 20
#: A block of texts ends at so many texts or bytes; bytes whose grams are counted or scored at once; grams held in a task.
BLOCK_DOCS, BLOCK_BYTES, CHUNK, HELD_GRAMS = 4096, 4 << 20, 1 << 19, 1_000_000
#: Bytes of texts that come to Python at once, rows of them made strings at once, rows that go back at once.
BATCH_BYTES, SLICE_ROWS, OUT_ROWS = 4 << 20, 128, 1 << 16
FOLDS, HELD_FOLD = 7, 2
END = b"\n"
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
WORD_ROWS, GRAM_ROWS, TEXT_ROWS = 0, 1, 2


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(_LOWER).split() if text else []


def spelled(text: str | None) -> bytes:
    return spelling(words_of(text))


def spelling(words: list[bytes]) -> bytes:
    return b" ".join(words) + END


def grams(spellings: list[bytes], depth: int = DEPTH) -> np.ndarray:
    """The gram of each position: its byte lowest, the bytes before it above, line feeds before the beginning."""
    pad = END * depth
    # the eight bytes up to each position, read as one number
    big = END * (7 - depth) + b"".join(x for s in spellings for x in (pad, s))
    keys = np.ndarray(len(big) - 7, dtype=">u8", buffer=big, strides=(1,)).astype(np.uint64)
    keys &= np.uint64((1 << 8 * (depth + 1)) - 1)
    sizes = np.array([len(s) for s in spellings])
    inside = np.ones(len(keys) + depth, dtype=bool)
    starts = np.cumsum(sizes + depth) - (sizes + depth)
    inside[(starts[:, None] + np.arange(depth)).ravel()] = False
    return keys[inside[depth:]]


def chunks(spellings: Iterator[bytes], depth: int, size: int = CHUNK) -> Iterator[list[tuple[int, bytes, int]]]:
    """Spellings in runs of about ``size`` bytes, as (number, piece, bytes that are context only); a long one is cut."""
    run, held = [], 0
    for k, s in enumerate(spellings):
        for low in range(0, len(s), size):
            before = min(low, depth)
            run.append((k, s[low - before : low + size], before))
            held += len(run[-1][1])
            if held >= size:
                yield run
                run, held = [], 0
    if run:
        yield run


def run_grams(run: list[tuple[int, bytes, int]], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A run's grams, without positions that are context only; numbers of its spellings, and each one's grams."""
    keys = grams([s for _, s, _ in run], depth)
    sizes = np.array([len(s) for _, s, _ in run])
    before = np.array([b for _, _, b in run])
    if before.any():
        starts = np.cumsum(sizes) - sizes
        drop = np.concatenate([np.arange(a, a + b) for a, b in zip(starts, before) if b])
        keys = np.delete(keys, drop)
    return keys, np.array([k for k, _, _ in run]), sizes - before


def sort_grams(keys: np.ndarray, sizes: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct grams of pieces (sizes: grams of each), how often each stands, and the piece of each position in the order of grams."""
    piece = np.repeat(np.arange(len(sizes), dtype=np.uint64), sizes)
    room = 64 - 8 * (depth + 1)
    if len(sizes) <= 1 << room:  # gram and piece in one number: a plain sort takes a third of the time of one that gives the order
        keys = keys << np.uint64(room) | piece
        keys.sort()
        piece = keys & np.uint64((1 << room) - 1)
        keys >>= np.uint64(room)
    else:
        order = np.argsort(keys)
        keys, piece = keys[order], piece[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.diff(np.append(first, len(keys))), piece.view(np.int64)


class GramCounts:
    """Counts of grams, given out when many are held."""

    def __init__(self):
        self.keys, self.n = np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)

    def add(self, keys: np.ndarray) -> None:
        own, n = np.unique(keys, return_counts=True)
        at, known = place(self.keys, own)
        self.n[at[known]] += n[known]
        before = np.searchsorted(self.keys, own[~known])
        self.keys, self.n = np.insert(self.keys, before, own[~known]), np.insert(self.n, before, n[~known])

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        out = self.keys, self.n
        self.__init__()
        return out


def word_hashes(words) -> np.ndarray:
    from xxhash import xxh64_intdigest

    return np.fromiter((xxh64_intdigest(w) for w in words), dtype=np.uint64, count=len(words)).view(np.int64)


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Jobs run meanwhile send rows to Python in batches of BATCH_BYTES, not 10,000 rows of any length."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def text_rows(docs: DataFrame, held_out: Column) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held_out.alias("held_out"))


def count_corpus(texts: DataFrame, depth: int = DEPTH) -> DataFrame:
    """kind, key, n, n_train. Words by hash, grams (training only), and one row of all texts (key 0)."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = GramCounts()

        def rows(kind, keys, n, trained):
            for low in range(0, len(keys), OUT_ROWS):
                own = keys[low : low + OUT_ROWS]
                columns = pa.array(np.full(len(own), kind, dtype=np.int8)), pa.array(own.view(np.int64)), pa.array(n[low : low + OUT_ROWS]), pa.array(trained[low : low + OUT_ROWS])
                yield pa.RecordBatch.from_arrays(list(columns), names=["kind", "key", "n", "n_train"])

        for block in blocks(batches):
            hashes, spellings = {False: [], True: []}, []
            for text, h in zip(block["text"], map(bool, block["held_out"])):
                words = words_of(text)
                hashes[h].append(word_hashes(words))
                if not h:
                    spellings.append(spelling(words))
            held, trained = (np.concatenate([np.empty(0, dtype=np.int64), *hashes[h]]) for h in (True, False))
            own, n = np.unique(np.concatenate([held, trained]), return_counts=True)
            own_trained, n_trained = np.unique(trained, return_counts=True)
            n_train = np.zeros(len(own), dtype=np.int64)
            n_train[place(own, own_trained)[0]] = n_trained
            yield from rows(WORD_ROWS, own, n, n_train)
            yield from rows(TEXT_ROWS, np.zeros(1, dtype=np.int64), np.array([len(block["text"])]), np.array([len(spellings)]))
            for run in chunks(iter(spellings), depth):
                found.add(run_grams(run, depth)[0])
                if len(found.keys) >= HELD_GRAMS:
                    keys, n = found.take()
                    yield from rows(GRAM_ROWS, keys, n, n)
        keys, n = found.take()
        yield from rows(GRAM_ROWS, keys, n, n)

    found = texts.mapInArrow(tally, "kind byte, key long, n long, n_train long")
    return materialise(found.groupBy("kind", "key").agg(F.sum("n").alias("n"), F.sum("n_train").alias("n_train")), "kind")


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list]]:
    """Rows in blocks, as lists by column."""
    names, held, size = None, None, 0
    for piece in (batch.slice(low, SLICE_ROWS) for batch in batches for low in range(0, batch.num_rows, SLICE_ROWS)):
        names = piece.schema.names
        text = names.index("text")
        for row in zip(*(piece.column(n).to_pylist() for n in names)):
            if held is None:
                held, size = {n: [] for n in names}, 0
            for n, v in zip(names, row):
                held[n].append(v)
            size += len(row[text] or "")
            if len(held["text"]) >= BLOCK_DOCS or size >= BLOCK_BYTES:
                yield held
                held = None
    if held:
        yield held


# --- the tree ----------------------------------------------------------------


def low_bytes(n: int) -> Column:
    return F.lit((1 << 8 * n) - 1)


def tree(gram_counts: DataFrame, depth: int = DEPTH, penalty: float = PENALTY) -> DataFrame:
    """gram_counts: key, n. Rows level, key, value, is_context.

    Of a gram (level: the length of its context) value is log10 of its last byte's probability in the
    context's state; of a context, log10 of what its state leaves to the parent for a byte that it has not seen.
    """
    levels = {depth: gram_counts.select("key", "n")}
    for k in range(depth - 1, -1, -1):
        levels[k] = materialise(levels[k + 1].groupBy(F.col("key").bitwiseAND(low_bytes(k + 1)).alias("key")).agg(F.sum("n").alias("n")))
    context = F.shiftrightunsigned("key", 8).alias("context")
    contexts = {k: materialise(levels[k].groupBy(context).agg(F.sum("n").alias("total"), F.count("*").alias("types"))) for k in range(depth + 1)}
    positions = (contexts[0].agg(F.sum("total")).first()[0] or 0) + 1
    kept = {}
    for k in range(depth, 0, -1):
        up = levels[k - 1].select(F.col("key").alias("up"), F.col("n").alias("up_n"))
        up_totals = contexts[k - 1].select(F.col("context").alias("up_context"), F.col("total").alias("up_total"))
        both = levels[k].select("key", "n", context, F.col("key").bitwiseAND(low_bytes(k)).alias("up")).join(up, "up").join(contexts[k], "context")
        both = both.withColumn("up_context", F.shiftrightunsigned("up", 8)).join(up_totals, "up_context")
        gain = F.sum(F.col("n") * F.log(F.col("n") / F.col("total") / (F.col("up_n") / F.col("up_total"))))
        diverges = both.groupBy("context").agg(gain.alias("gain"), F.max("types").alias("types")).where(F.col("gain") >= F.lit(penalty * float(np.log(positions))) * F.col("types"))
        own = diverges.select("context")
        if k < depth:
            own = own.unionByName(kept[k + 1].select(F.col("context").bitwiseAND(low_bytes(k)).alias("context"))).distinct()
        kept[k] = materialise(own)
    every = gram_counts.sparkSession.range(256).select(F.col("id").alias("key")).join(levels[0], "key", "left")
    p = materialise(every.select("key", ((F.coalesce("n", F.lit(0)) + 1) / F.lit(positions + 255)).alias("p")))  # positions is one more than there are
    out = p.select(F.lit(0).alias("level"), "key", F.log10("p").alias("value"), F.lit(False).alias("is_context"))
    for k in range(1, depth + 1):
        states = contexts[k].join(kept[k], "context", "left_semi")
        own = levels[k].select("key", "n", context, F.col("key").bitwiseAND(low_bytes(k)).alias("up")).join(states, "context")
        share = (F.col("n") + F.col("types") * F.col("up_p")) / (F.col("total") + F.col("types"))
        p = materialise(own.join(p.select(F.col("key").alias("up"), F.col("p").alias("up_p")), "up").select("key", share.alias("p")))
        spare = F.log10(F.col("types") / (F.col("total") + F.col("types")))
        out = out.unionByName(p.select(F.lit(k).alias("level"), "key", F.log10("p").alias("value"), F.lit(False).alias("is_context")))
        out = out.unionByName(states.select(F.lit(k).alias("level"), F.col("context").alias("key"), spare.alias("value"), F.lit(True).alias("is_context")))
    return materialise(out)


def place(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the wanted keys in sorted ones, and whether they are there."""
    if not len(keys):
        return np.zeros(len(wanted), dtype=np.int64), np.zeros(len(wanted), dtype=bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


class Tree:
    """A shard of the tree as sorted arrays by level."""

    def __init__(self, rows: pa.Table, depth: int, whole: bool, pairs: np.ndarray):
        level, is_context = rows.column("level").to_numpy(), rows.column("is_context").to_numpy()
        keys, values = rows.column("key").to_numpy().view(np.uint64), rows.column("value").to_numpy()
        self.depth, self.whole, self.pairs = depth, whole, np.sort(pairs.astype(np.uint64))
        self.known, self.values = np.empty(0, dtype=np.uint64), np.empty(0)  # grams scored before
        self.grams, self.contexts = [], []
        for k in range(depth + 1):
            for kind, into in ((False, self.grams), (True, self.contexts)):
                own = np.flatnonzero((level == k) & (is_context == kind))
                own = own[np.argsort(keys[own])]
                into.append((keys[own], values[own]))

    @classmethod
    def of(cls, parts: dict) -> Tree:
        """A tree upon the arrays of another one, given by vars(); they are not changed."""
        tree = cls.__new__(cls)
        vars(tree).update(parts)
        return tree

    def own(self, keys: np.ndarray) -> np.ndarray:
        """Whether the shard scores these grams."""
        return np.ones(len(keys), dtype=bool) if self.whole else place(self.pairs, keys >> np.uint64(8) & np.uint64(0xFFFF))[1]

    def log_probs(self, keys: np.ndarray) -> np.ndarray:
        out, open_ = np.zeros(len(keys)), np.arange(len(keys))
        for k in range(self.depth, 0, -1):
            part = keys[open_] & np.uint64((1 << 8 * (k + 1)) - 1)
            at, is_state = place(self.contexts[k][0], part >> np.uint64(8))
            spare = self.contexts[k][1][at[is_state]]
            seen_at, seen = place(self.grams[k][0], part[is_state])
            out[open_[is_state]] += np.where(seen, self.grams[k][1][seen_at], spare) if len(seen) else spare
            done = np.zeros(len(open_), dtype=bool)
            done[np.flatnonzero(is_state)[seen]] = True
            open_ = open_[~done]
        at, _ = place(self.grams[0][0], keys[open_] & np.uint64(0xFF))
        out[open_] += self.grams[0][1][at]
        return out

    def scores(self, spellings: list[bytes]) -> np.ndarray:
        """log10 of each spelling's probability, of its positions that are the shard's."""
        out = np.zeros(len(spellings))
        for run in chunks(iter(spellings), self.depth):
            keys, numbers, sizes = run_grams(run, self.depth)
            distinct, times, piece = sort_grams(keys, sizes, self.depth)
            at, old = place(self.known, distinct)
            p = np.zeros(len(distinct))
            p[old] = self.values[at[old]]
            new = distinct[~old]
            fresh = np.zeros(len(new))
            mine = self.own(new)
            fresh[mine] = self.log_probs(new[mine])
            p[~old] = fresh
            np.add.at(out, numbers, np.bincount(piece, np.repeat(p, times), len(sizes)))
            if len(self.known) + len(new) > HELD_GRAMS:
                self.known, self.values = distinct, p
            else:
                before = np.searchsorted(self.known, new)
                self.known, self.values = np.insert(self.known, before, new), np.insert(self.values, before, fresh)
        return out


def shards(states: DataFrame, depth: int = DEPTH, shard_rows: int = SHARD_ROWS) -> Iterator[Tree]:
    """states: as tree gives them."""
    pair = F.when(F.col("is_context"), F.col("key")).otherwise(F.shiftrightunsigned("key", 8)).bitwiseAND(low_bytes(2))
    sizes = states.where("level > 1").groupBy(pair.alias("pair")).agg(F.count("*").alias("n")).orderBy("pair").collect()  # 65,536 at most
    groups, room = [[]], shard_rows
    for r in sizes:
        if r["n"] > room and groups[-1]:
            groups.append([])
            room = shard_rows
        groups[-1].append(r["pair"])
        room -= r["n"]
    whole = len(groups) == 1
    for g, own in enumerate(groups):
        rows = states if whole else states.where((F.col("level") < 2) | pair.isin(own))
        # pairs without rows of their own belong to the first shard
        others = np.setdiff1d(np.arange(1 << 16), np.array([p for x in groups for p in x])) if g == 0 and not whole else np.empty(0, dtype=np.int64)
        yield Tree(rows.toArrow().combine_chunks(), depth, whole, np.concatenate([np.array(own, dtype=np.int64), others]))


def tree_scores(texts: DataFrame, states: DataFrame, depth: int = DEPTH, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """doc_id, text_hash, score: log10 of the probability of each distinct (doc_id, text)."""
    parts = None
    for g, shard in enumerate(shards(states, depth, shard_rows)):
        sent = texts.sparkSession.sparkContext.broadcast(vars(shard))  # plain arrays: workers hold no pickled copy beside them

        def run(batches: Iterator[pa.RecordBatch], sent=sent, g=g) -> Iterator[pa.RecordBatch]:
            model = Tree.of(sent.value)
            for block in blocks(batches):
                score = model.scores([spelled(t) for t in block["text"]])
                columns = pa.array(block["doc_id"], pa.int64()), pa.array(text_hashes(block["text"])), pa.array(np.full(len(score), g, dtype=np.int32)), pa.array(score)
                yield pa.RecordBatch.from_arrays(list(columns), names=["doc_id", "text_hash", "shard", "score"])

        own = texts.mapInArrow(run, "doc_id long, text_hash long, shard int, score double")
        parts = own if parts is None else parts.unionByName(own)
    once = parts.groupBy("doc_id", "text_hash", "shard").agg(F.max("score").alias("score"))  # repeated rows have equal scores
    return once.groupBy("doc_id", "text_hash").agg(F.sum("score").alias("score"))


def text_hashes(texts: list[str | None]) -> np.ndarray:
    return word_hashes([(t or "").encode("utf-8", "replace") for t in texts])


# --- word counts -------------------------------------------------------------

_SENT = "part int, block long, hashes array<long>, trained array<int>, sizes array<int>, places array<int>, times array<int>"
_INFO = "rows int, doc_ids array<long>, text_hashes array<long>, held array<boolean>, n_tokens array<long>, own_known array<long>, own_sums array<double>"


def word_blocks(texts: DataFrame, parts: int, heavy: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """Of each block, for each part, the words of it with the places of their occurrences; one of the rows also tells about the block's texts.

    heavy: sorted hashes and training counts of words that are summed here.
    """
    shipped = ship(texts.sparkSession, heavy)
    kinds = dict(part=pa.int32(), block=pa.int64(), hashes=pa.list_(pa.int64()), trained=pa.list_(pa.int32()), sizes=pa.list_(pa.int32()), places=pa.list_(pa.int32()), times=pa.list_(pa.int32()))
    kinds |= dict(rows=pa.int32(), doc_ids=pa.list_(pa.int64()), text_hashes=pa.list_(pa.int64()), held=pa.list_(pa.bool_()), n_tokens=pa.list_(pa.int64()), own_known=pa.list_(pa.int64()), own_sums=pa.list_(pa.float64()))
    schema = pa.schema(list(kinds.items()))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        from xxhash import xxh64_intdigest

        heavy_hashes, heavy_n = shipped()
        task = TaskContext.get().partitionId()
        for k, block in enumerate(blocks(batches)):
            number, held = defaultdict(count().__next__), np.array(block["held_out"], dtype=bool)
            ids = []
            for text in block["text"]:
                words = words_of(text)
                ids.append(np.fromiter(map(number.__getitem__, words), dtype=np.int64, count=len(words)))
            sizes, docs = np.array([len(x) for x in ids]), len(held)
            hashes = word_hashes(number)
            pairs, times = np.unique(np.concatenate(ids) * docs + np.repeat(np.arange(docs), sizes), return_counts=True)
            word, place_of = pairs // docs, pairs % docs
            at, is_heavy = place(heavy_hashes, hashes)
            n = heavy_n[at] if len(heavy_n) else np.zeros(len(hashes), dtype=np.int64)
            mine = is_heavy[word]
            known, sums = _sums(n[word[mine]], place_of[mine], times[mine], docs)
            about = dict(doc_ids=block["doc_id"], text_hashes=text_hashes(block["text"]), held=held, n_tokens=sizes + 1, own_known=known, own_sums=sums)
            # a task run again after a loss may read other rows first: then the block has another name, and word_scores misses rows
            name = int(np.uint64(xxh64_intdigest(repr((task, k, block["doc_id"])).encode() + about["text_hashes"].tobytes())).astype(np.int64))
            # the others by part, words of a part together
            word, place_of, times = word[~mine], place_of[~mine], times[~mine]
            trained = np.bincount(word, times * ~held[place_of], len(hashes)).astype(np.int32)
            spread = np.bincount(word, minlength=len(hashes))
            part = (hashes.view(np.uint64) >> np.uint64(16)) % np.uint64(parts)
            own = np.flatnonzero(spread)
            own = own[np.argsort(part[own], kind="stable")]
            starts = np.cumsum(spread) - spread
            first, none = (task + k) % parts, np.empty(0, dtype=np.int64)
            out = {first: dict(part=first, block=name, hashes=none, trained=none, sizes=none, places=none, times=none, **about)}
            for group in np.split(own, np.flatnonzero(np.diff(part[own].astype(np.int64))) + 1):
                if len(group):
                    ends = np.cumsum(spread[group])
                    at = np.arange(ends[-1]) + np.repeat(starts[group] - (ends - spread[group]), spread[group])
                    p = int(part[group[0]])
                    out.setdefault(p, dict(part=p, block=name)).update(hashes=hashes[group], trained=trained[group], sizes=spread[group], places=place_of[at], times=times[at])
            out[first]["rows"] = len(out)
            yield _rows(schema, list(out.values()))

    return texts.mapInArrow(send, f"{_SENT}, {_INFO}")


def _rows(schema: pa.Schema, rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in rows], f.type) for f in schema], schema=schema)


def _sums(n: np.ndarray, places: np.ndarray, times: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each text: tokens whose count n is above 0, and the sum of log10(n + 1)."""
    return np.bincount(places, times * (n > 0), docs).astype(np.int64), np.bincount(places, times * np.log10(n + 1), docs)


def word_sums(sent: DataFrame) -> DataFrame:
    """sent: as word_blocks gives them. Of each (part, block): places (texts), known, sums, and what was told about the texts."""
    info = [c.split()[0] for c in _INFO.split(", ")]

    def answer(group: pa.Table) -> pa.Table:
        hashes = np.concatenate([x.values.to_numpy() for x in group.column("hashes")])
        trained = np.concatenate([x.values.to_numpy() for x in group.column("trained")])
        distinct, back = np.unique(hashes, return_inverse=True)
        n = np.bincount(back, trained, len(distinct)).astype(np.int64)[back]
        out, low = [], 0
        for sizes, places, times in zip(*(group.column(c) for c in ("sizes", "places", "times"))):
            sizes, places, times = (x.values.to_numpy() for x in (sizes, places, times))
            known, sums = _sums(np.repeat(n[low : low + len(sizes)], sizes), places, times, int(places.max(initial=-1)) + 1)
            low += len(sizes)
            there = np.flatnonzero(np.bincount(places))
            out.append((there, known[there], sums[there]))
        lists = [pa.array([x[i] for x in out], pa.list_(kind)) for i, kind in enumerate((pa.int32(), pa.int64(), pa.float64()))]
        return pa.table([group.column("block"), *lists, *map(group.column, info)], names=["block", "places", "known", "sums", *info])

    return sent.groupBy("part").applyInArrow(answer, f"block long, places array<int>, known array<long>, sums array<double>, {_INFO}")


def word_scores(sent: DataFrame, tokens: int, types: int) -> DataFrame:
    """doc_id, text_hash, held_out, n_tokens, n_known, base_score of each text. tokens, types: of words and ends in training."""
    floor = float(np.log10(tokens + types + 1))

    def gather(answers: pa.Table) -> pa.Table:
        info = answers.filter(answers.column("rows").is_valid())
        if info.column("rows").to_pylist() != [len(answers)]:
            raise RuntimeError("the texts were read again in another order: write the input to a table first")
        one = {f: info.column(f).combine_chunks().flatten() for f in ("doc_ids", "text_hashes", "held", "n_tokens", "own_known", "own_sums")}
        known, sums = one["own_known"].to_numpy().copy(), one["own_sums"].to_numpy().copy()
        for places, k, s in zip(*(answers.column(c) for c in ("places", "known", "sums"))):
            at = places.values.to_numpy()
            known[at] += k.values.to_numpy()
            sums[at] += s.values.to_numpy()
        base = sums - one["n_tokens"].to_numpy() * floor
        return pa.table([one["doc_ids"], one["text_hashes"], one["held"], one["n_tokens"], pa.array(known), pa.array(base)], names=["doc_id", "text_hash", "held_out", "n_tokens", "n_known", "base_score"])

    return word_sums(sent).groupBy("block").applyInArrow(gather, "doc_id long, text_hash long, held_out boolean, n_tokens long, n_known long, base_score double")


def score(docs: DataFrame, held_out: Column, depth: int = DEPTH, penalty: float = PENALTY, shard_rows: int = SHARD_ROWS, group_words: int = GROUP_WORDS, heavy_bits: int = HEAVY_BITS) -> DataFrame:
    """docs: (doc_id, text). The scores of every row; the models learn from rows that are not held out."""
    texts = text_rows(docs, held_out)
    with small_batches(docs.sparkSession):
        counts = count_corpus(texts, depth)
    words = counts.where(F.col("kind") == WORD_ROWS)
    all_words, trained_words, types = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("n_train"), F.lit(0)), F.count_if(F.col("n_train") > 0)).first()
    trained_texts = counts.where(F.col("kind") == TEXT_ROWS).agg(F.coalesce(F.sum("n_train"), F.lit(0))).first()[0]
    # the end is a token of its own, once a text
    tokens, types = trained_words + trained_texts, types + (trained_texts > 0)
    most = max(1 << heavy_bits, all_words >> heavy_bits)
    heavy = words.where(F.col("n") >= most).select("key", "n_train").toArrow().combine_chunks()  # 2 ** heavy_bits rows at most
    order = np.argsort(heavy.column("key").to_numpy())
    heavy = heavy.column("key").to_numpy()[order], heavy.column("n_train").to_numpy()[order]
    sent = word_blocks(texts, max(1, -(-all_words // group_words)), heavy)
    with small_batches(docs.sparkSession):
        base = materialise(word_scores(sent, tokens, types))
    end = float(np.log10(trained_texts + 1))  # the end token's share of the sum, in every text
    states = tree(counts.where(F.col("kind") == GRAM_ROWS).select("key", F.col("n_train").alias("n")), depth, penalty)
    with small_batches(docs.sparkSession):
        scored = materialise(tree_scores(texts, states, depth, shard_rows))
    same = base.join(scored.withColumnsRenamed({"doc_id": "id", "text_hash": "hash"}), F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("text_hash") == F.col("hash")))
    return same.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.lit(int(trained_texts > 0))).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.lit(end)).alias("base_score"),
        "score",
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op13: every document's scores."""
    return score(table(spark, sf_dir, "documents").select("doc_id", "text"), fold_of("doc_id", FOLDS) == HELD_FOLD)
