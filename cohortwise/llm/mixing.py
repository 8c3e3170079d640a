"""Mixing sources to target weights by subset-sum budget fitting.

A text's size is its number of words. Sources in code point order (null
last) weigh 1, 2, 3, 1, 2, 3, ...; they share the sum of all sizes by weight,
a target stops at ``MAX_REPEATS`` times its source's size, and the excess is
reshared by weight until no target is above. Each document is taken as often
as its source's target holds the whole source; the budget that remains is
fitted by documents taken once more:

1. documents are counted by (source, exact size);
2. per source, each size gives its proportional whole number of documents,
   and a bounded-knapsack dynamic program over the documents left of each
   size (then over further copies, up to ``MAX_REPEATS``) meets the rest;
   where it cannot meet it exactly, documents are given back, more and more
   of each size, up to all of them, and the program chooses anew among all
   that is open. It holds at most ``DP_BITS`` bits of sums; a source whose
   budget is met exactly earlier, as most are, needs few. Only a source that
   is not met exactly within that memory stays at the nearest sum found;
3. of each (source, size), the chosen number of documents is selected in the
   order of a seeded hash of doc_id.

Step 2 sees one row per size of a source, never documents. In step 3 the
hash's range is cut into ``SLICES`` slices, counted per (source, size): all
documents of the slices before the one that holds the last choice are
selected, and only the hashes inside that slice are counted in order. So no
task ranks a whole source, nor a whole group of copies. The last choice comes
back to the rows as a hash: whole rows, texts among them, stay where they
are, unless the plan (one row per size of a source) passes ``SENT_ROWS``
rows. Only rows that share the last choice's hash (repeats of a doc_id) are
ranked themselves, and only if not all of them are taken.

Defined results: a null text has size 0, documents of size 0 are taken 0
words; a null source is a source of its own; an empty table gives no rows;
repeated rows are documents of their own (rows alike in all but text may
trade places); further columns stay.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import annotate, free_name, materialise, table

MAX_REPEATS = 3
WEIGHTS = 3
#: Bits of the reachable sums that one fit holds at once (128 MB).
DP_BITS = 1 << 30
SLICES = 1024
SEED = 7
#: Rows of a plan, one a (source, size), that are sent to all tasks at most; a longer plan is joined by a shuffle.
SENT_ROWS = 500_000


def targets(sources: DataFrame) -> DataFrame:
    """sources: (source, source_size). Adds weight and target.

    With sources in rising order of cap / weight, the level per weight after
    all before are capped is (total - their caps) / (weights from here on).
    It rises while caps are too small and falls after, so its largest value
    is the level at which no target is above its cap. One row a source.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    rows = sources.withColumn("weight", (rank - 1) % WEIGHTS + 1).withColumn("cap", F.col("source_size") * MAX_REPEATS)
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn("level", (F.sum("source_size").over(everything) - before) / rest)
    level = F.max("level").over(everything)
    return rows.select("source", "source_size", "weight", F.least(F.col("cap").cast("double"), level * F.col("weight")).alias("target"))


def fit_budget(sizes: np.ndarray, counts: np.ndarray, budget: int, copies: int = 1, bits: int = DP_BITS) -> np.ndarray:
    """How many documents of each size to take, at most copies * counts, so that their words come as near to budget as can be.

    Each size first gets its proportional whole number, and the knapsack fits
    the rest with the documents left. Where that is not exact, 1, 2, 4, ..
    documents of each size are given back and fitted anew, until the budget
    is met, or all choices are open, or the sums to be held pass ``bits``.
    Up to counts of a size are different documents; further copies come last.
    """
    total = int((sizes * counts).sum())
    if total <= 0 or budget <= 0 or copies <= 0:
        return np.zeros(len(sizes), dtype=np.int64)
    if budget >= total * copies:
        return counts * copies
    shares = [divmod(int(c) * budget, total) for c in counts]
    held = np.array([whole for whole, _ in shares], dtype=np.int64)
    rest = budget - int((sizes * held).sum())
    # the largest fractions one more, while the rest is longer than any document
    longest = int(sizes[counts > 0].max())
    for k in sorted(range(len(sizes)), key=lambda k: (-shares[k][1], int(sizes[k]))):
        if sizes[k] and longest < rest and held[k] < counts[k]:
            held[k] += 1
            rest -= int(sizes[k])
    best, back = held, 0
    while True:
        kept = np.maximum(held - back, 0)
        open_ = budget - int((sizes * kept).sum())
        found = kept + knapsack(sizes, counts - kept, counts * (copies - 1), open_, bits)
        if abs(int((sizes * found).sum()) - budget) < abs(int((sizes * best).sum()) - budget) or best is held:
            best = found
        # items of the next round, and the sums that each needs held
        back = max(1, 2 * back)
        wider = budget - int((sizes * np.maximum(held - back, 0)).sum())
        rounds = 2 * int(np.log2(counts[sizes > 0] * copies + 1).sum()) + 2
        if int((sizes * best).sum()) == budget or not kept.any() or 2 * wider * rounds > bits:
            return best


def knapsack(sizes: np.ndarray, counts: np.ndarray, more: np.ndarray, budget: int, bits: int = DP_BITS) -> np.ndarray:
    """The bounded knapsack: of counts (then of more) of each size, so many that the words are nearest to budget, exactly.

    Sums that can be reached are the bits of one whole number, one for each
    item, and an item is some documents of a size: 1, 2, 4, .. of them. Sums
    over twice the budget are never nearer than nothing. Only if all these
    numbers would pass ``bits``, a step counts more than one word, as many as
    needed; the result is then off by less than a step a document.
    """
    chosen = np.zeros(len(sizes), dtype=np.int64)
    falling = [k for k in sorted(range(len(sizes)), key=lambda k: -int(sizes[k])) if sizes[k]]
    items = []
    for k, left in [(k, int(n[k])) for n in (counts, more) for k in falling]:
        left, bundle = min(left, 2 * budget // int(sizes[k])), 1
        while left > 0:
            items.append((k, min(bundle, left)))
            left, bundle = left - min(bundle, left), bundle * 2
    if budget <= 0 or not items:
        return chosen
    step = max(1, -(-2 * budget * len(items) // bits))
    words = [max(1, round(int(sizes[k]) / step)) * n for k, n in items]
    goal, most = budget // step, (1 << 2 * budget // step + 1) - 1
    reached, before = 1, []
    for w in words:
        if reached >> goal & 1:
            break
        before.append(reached)
        reached |= reached << w & most
    under, over = (reached & ((1 << goal + 1) - 1)).bit_length() - 1, reached >> goal
    over = goal + (over & -over).bit_length() - 1 if over else None
    at = over if over is not None and over - goal < goal - under else under
    for j in range(len(before) - 1, -1, -1):
        if not before[j] >> at & 1:
            chosen[items[j][0]] += items[j][1]
            at -= words[j]
    return chosen


def _fit(rows: pd.DataFrame) -> pd.DataFrame:
    """One source's (size, n, source_size, target) rows: repeats of every document of a size, and how many of them go once more."""
    rows = rows.sort_values("size", ignore_index=True)
    total, target = int(rows["source_size"].iloc[0]), float(rows["target"].iloc[0])
    repeats = int(target // total) if total else 0
    n = rows["n"].to_numpy(np.int64)
    more = fit_budget(rows["size"].to_numpy(np.int64), n, int(target - repeats * total + 1e-6) if total else 0, MAX_REPEATS - repeats)
    return rows.assign(repeats=repeats + more // n, chosen=more % n)


def with_size(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs and the number of words of each text; the new column's name."""

    def make():
        return lambda texts: [pa.array([len(t.encode().split()) if t else 0 for t in texts.to_pylist()], pa.int64())]

    size = free_name(docs, "size")
    return annotate(docs.withColumn("text", F.col("text").cast("string")), ["text"], f"{size} bigint", make), size


def _same(left: DataFrame, right: DataFrame, how: str = "left") -> DataFrame:
    """left with the columns of right's row of the same source and size."""
    right = right.withColumnsRenamed({"source": "r_source", "size": "r_size"})
    return left.join(right, F.col("source").eqNullSafe(F.col("r_source")) & (F.col("size") == F.col("r_size")), how).drop("r_source", "r_size")


def _small(rows: DataFrame, most: int) -> DataFrame:
    """rows, to be sent to all tasks if they are ``most`` at most; the join gives the same either way."""
    return F.broadcast(rows) if rows.count() <= most else rows


def mix(sized: DataFrame, size: str = "size", seed: int = SEED, most_sent: int = SENT_ROWS) -> DataFrame:
    """sized: doc_id, source, a size column and any others. Adds source_size, target, taken."""
    # rows without an id are told apart by the whole row, so that they do not share one slice
    key = F.when(F.col("doc_id").isNull(), F.xxhash64(F.lit(seed), F.struct(*sized.columns))).otherwise(F.xxhash64(F.lit(seed), F.col("doc_id")))
    # each row travels as one struct, so that no column of it can clash with those of the plan; the table is read twice
    rows = materialise(sized.select(F.struct("*").alias("row"), F.col("source").cast("string").alias("source"), F.col(size).alias("size"), F.pmod(key, F.lit(SLICES)).cast("int").alias("slice"), key.alias("key")))
    counts = materialise(rows.groupBy("source", "size", "slice").agg(F.count("*").alias("n")))
    by_size = counts.groupBy("source", "size").agg(F.sum("n").alias("n"))
    goals = targets(by_size.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))).select(F.col("source").alias("of"), "source_size", "target")
    given = by_size.join(goals, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    fitted = materialise(given.groupBy("source").applyInPandas(_fit, "source string, size long, n long, source_size long, target double, repeats long, chosen long"))

    # the slice that holds the last choice of each (source, size): a window over at most SLICES counts
    sliced = _same(counts, fitted.where("chosen > 0").select("source", "size", "chosen")).where("chosen is not null")
    upto = F.sum("n").over(Window.partitionBy("source", "size").orderBy("slice"))
    cut = materialise(sliced.withColumn("upto", upto).where("upto >= chosen and upto - n < chosen").select("source", "size", F.col("slice").alias("cut"), F.expr("chosen - (upto - n)").alias("needed")))
    # the last choice in that slice, among its keys and their counts: rows of smaller keys go once more, of its own key so many as are still needed
    keys = _same(rows.select("source", "size", "slice", "key"), _small(cut, most_sent)).where("slice = cut").groupBy("source", "size", "key").agg(F.count("*").alias("n"), F.first("needed").alias("needed"))
    upto = F.sum("n").over(Window.partitionBy("source", "size").orderBy("key"))
    last = keys.withColumn("upto", upto).where("upto >= needed and upto - n < needed").select("source", "size", F.col("key").alias("last"), F.expr("needed - (upto - n)").alias("of_last"), F.expr("upto > needed").alias("shared"))
    plan = _same(_same(fitted, cut.drop("needed")), last).select("source", "size", "source_size", "target", "repeats", "cut", "last", "of_last", F.coalesce("shared", F.lit(False)).alias("shared"))
    plan = materialise(plan)
    # the plan goes to the rows; only rows that share a key of which not all are taken are ranked
    planned = _same(rows, _small(plan, most_sent))
    at_last = F.col("shared") & (F.col("key") == F.col("last"))
    more = (F.col("slice") < F.col("cut")) | ((F.col("slice") == F.col("cut")) & (F.col("key") <= F.col("last")))
    plain = planned.where(~F.coalesce(at_last, F.lit(False))).withColumn("more", F.coalesce(more, F.lit(False)).cast("int"))
    tied = _same(rows, _small(plan.where("shared"), most_sent), "inner").where(at_last)
    rank = F.row_number().over(Window.partitionBy("source", "size").orderBy("row.doc_id"))
    ranked = tied.withColumn("more", (rank <= F.col("of_last")).cast("int"))
    names = [free_name(sized, n) for n in ("source_size", "target", "taken")]
    values = ("source_size", "target", F.col("size") * (F.col("repeats") + F.col("more")))
    return plain.unionByName(ranked).select(*(F.col(f"row.`{c}`").alias(c) for c in sized.columns), *((F.col(v) if isinstance(v, str) else v).alias(n) for v, n in zip(values, names)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: all documents."""
    sized, size = with_size(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return mix(sized.select("doc_id", "source", F.col(size).alias("size"))).select("doc_id", "size", "source_size", "target", "taken")
