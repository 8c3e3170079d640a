"""Line dedup over levelled sorted runs of line hashes.

A line's key is the line without the six ASCII white-space characters at its
ends, with A-Z lower-cased; its hash is the key's MD5. ``LineRuns`` keeps
what is known of hashes as runs: tables of (key, n_docs, owner), all cut into
the same buckets of key, one file a bucket, sorted by key. A batch of documents is reduced to one row a key;
merge-anti-joined with the runs, which are read in their order without
shuffle or sort, its keys that no run holds yet get their
owner, the batch's largest doc_id; the others only add to the count. The
batch's rows become a run of level 0, and as soon as a level has ``fanout``
runs they are merged, bucket by bucket, into one of the next level. Batches come in falling
order of doc_id, so the first holder met is the largest.

A state's folder has a manifest, to which each ``add`` appends the levels that
it left as its last act; ``LineRuns.open`` goes on from there in a later
session. An ``add`` that broke off leaves files that no manifest names.

Lines whose key has ``MIN_CHARS`` code points and is held by ``MIN_DOCS``
documents are dropped everywhere but in the owner.

Rows are pre-aggregated by document before they meet by key, so a key that a
third of all documents hold is one row for each of them at most, and the
join that hands verdicts back to documents is a plain equi-join, which
adaptive execution splits where a key is hot. The state is files in the
shared folder; lost executors cost reruns of tasks.

Defined results: a null or empty text is one empty line and stays as an
empty text; rows that repeat a doc_id are one document in the counts, and
each is rewritten; null doc_ids are one document, never an owner; further
columns stay.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sqltext import lit
from .common import LOWER, SPACE_CHARS, UPPER, annotate, free_name, materialise, shared_folder, table

MIN_CHARS, MIN_DOCS = 40, 5
BATCHES, FANOUT = 4, 2


def keys_of(lines: list[str], min_chars: int) -> list[bytes | None]:
    """The hash of each line's key, None for short keys."""
    out = []
    for line in lines:
        key = line.strip(SPACE_CHARS)
        out.append(hashlib.md5(key.encode().lower()).digest() if len(key) >= min_chars else None)
    return out


def document_keys(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, key: the distinct hashes of each document's long lines."""

    def make():
        kind = pa.list_(pa.binary())
        return lambda texts: [pa.array([sorted({k for k in keys_of((t or "").split("\n"), min_chars) if k}) for t in texts.to_pylist()], kind)]

    found = annotate(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), ["text"], "keys array<binary>", make)
    return found.select("doc_id", F.explode("keys").alias("key"))


@contextmanager
def ordered_scans(spark: SparkSession) -> Iterator[None]:
    """Plans made meanwhile take a bucket's single file for sorted, as it was written."""
    name = "spark.sql.legacy.bucketedTableScan.outputOrdering"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


class LineRuns:
    """Levels of runs of (key, n_docs, owner) in a folder. A key has a row in each run that saw it, and an owner in the first."""

    RUN, MANIFEST = "key binary, n_docs bigint, owner bigint", "version bigint, fanout int, buckets int, floor bigint, levels array<array<string>>"

    def __init__(self, spark: SparkSession, folder: str | None = None, fanout: int = FANOUT, buckets: int | None = None):
        """A new, empty state. buckets: as many as the session's shuffle partitions unless given; every run has the same."""
        self.spark, self.folder, self.fanout = spark, (folder or shared_folder(spark)).rstrip("/"), fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.version, self.floor, self.levels = 0, None, []

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> LineRuns:
        """The state that the last finished ``add`` left in the folder, in whichever session."""
        rows = spark.read.schema(cls.MANIFEST).parquet(f"{folder.rstrip('/')}/manifest")
        last = rows.orderBy(F.col("version").desc()).first()
        state = cls(spark, folder, last["fanout"], last["buckets"])
        state.version, state.floor, state.levels = last["version"], last["floor"], [list(level) for level in last["levels"]]
        return state

    def runs(self) -> list[DataFrame]:
        return [self._read(run) for level in self.levels for run in level]

    def add(self, batch: DataFrame) -> None:
        """batch: (doc_id, key), no document of which any other batch holds; refused if a doc_id is not under all added earlier."""
        low, high = batch.agg(F.min("doc_id"), F.max("doc_id")).first()
        if self.floor is not None and high is not None and high >= self.floor:
            raise ValueError(f"batches come in falling order of doc_id: {high} after {self.floor}")
        own = batch.distinct().groupBy("key").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("owner"))
        with ordered_scans(self.spark):
            name = self._write(self._aligned(own))
            if self.levels:
                name, every = self._write(self.disowned(self._read(name))), name
                self._forget(every)
            self._put(0, name)
        self.floor = self.floor if low is None else low
        self.version += 1
        state = [(self.version, self.fanout, self.buckets, self.floor, self.levels)]
        self.spark.createDataFrame(state, self.MANIFEST).coalesce(1).write.mode("append").parquet(f"{self.folder}/manifest")

    def disowned(self, own: DataFrame) -> DataFrame:
        """own, a row a key: rows that merge-anti-join the runs keep their owner, rows that meet one lose it."""
        for run in self.runs():
            held = run.select("key", F.lit(True).alias("held")).hint("merge")
            own = own.join(held, "key", "left").withColumn("owner", F.expr("if(held, null, owner)")).drop("held")
        return own

    def merged(self) -> DataFrame:
        """One row a key over all runs."""
        return self._merge(self.runs())

    def _put(self, level: int, name: str) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)
        if len(self.levels[level]) >= self.fanout:
            full, self.levels[level] = self.levels[level], []
            self._put(level + 1, self._write(self._merge([self._read(run) for run in full])))
            self._forget(*full)

    def _write(self, rows: DataFrame) -> str:
        """A run of rows that stand in their buckets already."""
        name = f"cohortwise_lines_{uuid.uuid4().hex}"
        out = rows.select("key", "n_docs", "owner").write.format("parquet").bucketBy(self.buckets, "key").sortBy("key")
        out.option("path", f"{self.folder}/{name}").saveAsTable(name)
        return name

    def _forget(self, *runs: str) -> None:
        """Takes runs out of the session's catalog; their files stay."""
        for run in runs:
            self.spark.sql(f"DROP TABLE {run}")

    def _read(self, run: str) -> DataFrame:
        if not self.spark.catalog.tableExists(run):  # written by another session
            path = lit(f"{self.folder}/{run}")
            self.spark.sql(f"CREATE TABLE {run} ({self.RUN}) USING parquet CLUSTERED BY (key) SORTED BY (key) INTO {self.buckets} BUCKETS LOCATION {path}")
        return self.spark.table(run)

    def _aligned(self, rows: DataFrame) -> DataFrame:
        """rows, grouped by key, in the runs' buckets; they are, where the session shuffles into as many partitions."""
        return rows if int(self.spark.conf.get("spark.sql.shuffle.partitions")) == self.buckets else rows.repartition(self.buckets, "key")

    @staticmethod
    def _merge(runs: list[DataFrame]) -> DataFrame:
        """Runs of one row a key, merge-joined. Not a union with an aggregation: Spark 4.1 takes
        a union of bucketed scans for bucketed and adds no shuffle, but reads them one after the other,
        so that a key of two runs stays two rows."""
        rows = runs[0]
        for run in runs[1:]:
            run = run.select("key", F.col("n_docs").alias("more"), F.col("owner").alias("other")).hint("merge")
            n_docs = F.coalesce("n_docs", F.lit(0)) + F.coalesce("more", F.lit(0))
            rows = rows.join(run, "key", "full").select("key", n_docs.alias("n_docs"), F.greatest("owner", "other").alias("owner"))
        return rows


def batch_of(doc_id: Column, low: int | None, high: int | None, batches: int) -> Column:
    """0 for the largest doc_ids up to batches - 1 for the smallest, and for null."""
    if low is None:
        return F.lit(0)
    width = (high - low) // batches + 1
    return F.coalesce(F.floor((F.lit(high).cast("decimal(20,0)") - doc_id) / width).cast("int"), F.lit(batches - 1))


def drops(docs: DataFrame, batches: int = BATCHES, fanout: int = FANOUT, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc_id, dropped: the hashes of the lines that each document loses; documents without any are absent."""
    low, high = docs.agg(F.min(F.col("doc_id").cast("long")), F.max(F.col("doc_id").cast("long"))).first()
    keys = document_keys(docs, min_chars)
    lines = materialise(keys.withColumn("batch", batch_of(F.col("doc_id"), low, high, batches)), "batch")
    state = LineRuns(docs.sparkSession, fanout=fanout)
    for k in range(batches):
        state.add(lines.where(F.col("batch") == k).select("doc_id", "key"))
    # off the buckets again: only a side that is shuffled or broadcast lets adaptive execution deal with hot keys
    frequent = materialise(state.merged().where(F.col("n_docs") >= min_docs).select("key", "owner"))
    lost = lines.select("doc_id", "key").join(frequent, "key").where(~F.col("doc_id").eqNullSafe(F.col("owner")))
    return lost.groupBy("doc_id").agg(F.collect_set("key").alias("dropped"))


def dedup(docs: DataFrame, **limits: int) -> DataFrame:
    """docs with their texts rewritten, and n_lines, n_dropped as further columns."""
    lost, min_chars = drops(docs, **limits), limits.get("min_chars", MIN_CHARS)
    name = free_name(docs, "dropped")
    joined = docs.join(lost.select(F.col("doc_id").alias(free_name(docs, "lost_id")), F.col("dropped").alias(name)), docs["doc_id"].eqNullSafe(F.col(free_name(docs, "lost_id"))), "left").select(docs["*"], name)
    text, lines, gone = (free_name(joined, n) for n in ("new_text", "n_lines", "n_dropped"))

    def make():
        def f(texts, dropped):
            rows = []
            for t, d in zip(texts.to_pylist(), dropped.to_pylist()):
                lines = (t or "").split("\n")
                if not d:
                    rows.append((t or "", len(lines), 0))
                    continue
                d = set(d)
                kept = [x for x, k in zip(lines, keys_of(lines, min_chars)) if k is None or k not in d]
                rows.append(("\n".join(kept), len(lines), len(lines) - len(kept)))
            return [pa.array(c, kind) for c, kind in zip(zip(*rows), (pa.string(), pa.int64(), pa.int64()))]

        return f

    out = annotate(joined.withColumn("text", F.col("text").cast("string")), ["text", name], f"{text} string, {lines} bigint, {gone} bigint", make)
    kept = [F.col(text).alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns]
    return out.select(*kept, lines, gone)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: every line of every document."""
    rows = dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


_SPACES = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
SQL = f"""
with d as (select row_number() over () as rid, doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents),
l as (select rid, doc_id, unnest(lines) as line, generate_subscripts(lines, 1) as i from d),
k as (select *, translate(trim(line, {_SPACES}), '{UPPER}', '{LOWER}') as key from l),
f as (select key, max(doc_id) as owner from k where length(key) >= {MIN_CHARS} group by key having count(distinct coalesce(doc_id::varchar, '')) >= {MIN_DOCS}),
m as (select k.*, f.key is not null and k.doc_id is distinct from f.owner as gone from k left join f using (key))
select any_value(doc_id) as doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by i) filter (not gone), '')) as kept_sha256
from m group by rid
"""
