"""Secret scans with corpus-wide ownership frequency. DataFrame functions only.

Three base kinds of spans are found in every text (assignments, access keys,
long hexadecimal runs); a fourth, ``value``, holds other long tokens outside
them. Every candidate's value is hashed, and the hashes are aggregated over
the corpus by distinct repositories and owners. A value that
``COPIED_OWNERS`` owners or ``COPIED_REPOSITORIES`` repositories or more hold
is a widely copied example; a value of fewer that looks live (letters of both cases and digits, or long hex;
varied characters; no placeholder) is an owner's credential. Base spans
always stay; a ``value`` span is kept only as an owner's live-looking
credential, so example tokens that everybody copies are left out.

In ``documents`` a document stands for a repository and its source for the
owner.

Spans are code points, end exclusive. Java's regular expressions give no
offsets, so a kind's matches and the pieces between them are taken with one
pattern, and their lengths added up block by block, so that a text's cost
grows with its matches, not with their square.

Defined results: a null text is empty; null owners count as one owner, null
doc_ids as one repository of their owner; repeated rows are each scanned and count once for
their repository; further columns stay out of the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, table

KEYWORDS = ("password", "passwd", "secret", "token", "api_?key")
COPIED_OWNERS, COPIED_REPOSITORIES = 3, 10
#: Elements of an array whose running total is taken one by one; longer arrays add up whole blocks first.
BLOCK = 128
#: Parts of tokens that are placeholders.
PLACEHOLDERS = ("example", "sample", "placeholder", "changeme", "yourkey", "dummy", "xxxx", "test", "00000", "12345", "abcdef")


def either_case(pattern: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in pattern)


ASSIGN = f"({'|'.join(map(either_case, KEYWORDS))})" + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: The contract's runs with their least lengths built in: a run's match is the whole run either way.
ACCESS, HEX = "AKIA[A-Z0-9]{16,}", "[0-9a-f]{24,}"
VALUE = "[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "value")
#: The same matches for Java, which then turns most places down after a character or two.
FAST = {
    ASSIGN: "(?=[PpSsTtAa][AaEeOoPp][SsCcKkIi])" + ASSIGN,
    ACCESS: ACCESS,
    HEX: "(?<![0-9a-f])" + HEX,
    VALUE: "(?<![A-Za-z0-9+/_=-])" + VALUE,
}


def running(rows: DataFrame, column: str, out: str, add) -> DataFrame:
    """A further column: for each element of the array, ``add`` over 0 and the elements before it (null for none).

    Whole blocks are added up first. Each step is a column of its own, read
    twice by the next, so that no step is computed again for every element.
    """
    a, t, u = F.col(column), F.col(f"{out}_t"), F.col(f"{out}_u")
    block = lambda k: F.slice(a, k * BLOCK + 1, F.lit(BLOCK))
    total = lambda x, start: F.aggregate(x, start, add)
    blocks = F.sequence(F.lit(0), F.floor((F.size(a) - 1) / BLOCK).cast("int"))
    rows = rows.withColumn(f"{out}_t", F.when(F.size(a) > 0, F.transform(blocks, lambda k: total(block(k), F.lit(0)))))
    rows = rows.withColumn(f"{out}_u", F.when(F.size(t) > 0, F.transform(t, lambda _, k: total(F.slice(t, F.lit(1), k), F.lit(0)))))
    inside = lambda u, k: F.transform(block(k), lambda _, i: total(F.slice(a, k * BLOCK + 1, i), u))
    return rows.withColumn(out, F.when(F.size(u) > 0, F.flatten(F.transform(u, inside)))).drop(f"{out}_t", f"{out}_u")


def matches(found: Column, at: Column, rank: int) -> Column:
    """array<struct<start, rank, end, value>> from a pattern's matches and their starts."""

    def span(m: Column, i: Column) -> Column:
        start = F.get(at, i)
        value = F.regexp_extract(m, ASSIGN, 2) if rank == 0 else m
        return F.struct(start.alias("start"), F.lit(rank).alias("rank"), (start + F.length(m)).alias("end"), value.alias("value"))

    return F.when(F.size(found) > 0, F.transform(found, span))


def looks_live(value: Column) -> Column:
    lower = F.lower(value)
    varied = F.size(F.array_distinct(F.split(value, ""))) >= 8
    mixed = value.rlike("[0-9]") & value.rlike("[A-Z]") & value.rlike("[a-z]")
    placeholder = lower.rlike("|".join(PLACEHOLDERS))
    return varied & ~placeholder & (mixed | value.rlike("^[0-9a-f]{24,}$") | value.rlike("^AKIA[A-Z0-9]{16,}$"))


def candidates(docs: DataFrame, repository: str, owner: str) -> DataFrame:
    """repository, owner, and found: array<struct<start, rank, end, hash, live>> by start and kind."""
    kinds = {"m0": ASSIGN, "m1": ACCESS, "m2": HEX, "m3": VALUE}
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col(repository).alias("repository"), F.col(owner).cast("string").alias("owner"), text.alias("text"))
    # one step each, so that no expression over the text stands in a lambda or twice
    rows = rows.select("*", *(F.regexp_extract_all("text", F.lit(FAST[p]), F.lit(0)).alias(m) for m, p in kinds.items()))
    rows = rows.select("repository", "owner", *kinds, *(F.when(F.size(m) > 0, F.transform(F.split("text", FAST[p], -1), F.length)).alias(f"p{m}") for m, p in kinds.items()))
    step = lambda p: lambda x, i: F.get(F.col(p), i) + F.length(x)
    after = lambda p: lambda b, i: b + F.get(F.col(p), i)
    # a match starts where its own piece and all matches and pieces before that end
    for m in kinds:
        rows = rows.withColumn(f"s{m}", F.when(F.size(m) > 0, F.transform(m, step(f"p{m}"))))
        rows = running(rows, f"s{m}", f"b{m}", lambda s, x: s + x)
        rows = rows.withColumn(f"a{m}", F.when(F.size(f"b{m}") > 0, F.transform(f"b{m}", after(f"p{m}"))))
    rows = rows.select("repository", "owner", *(matches(F.col(f"m{r}"), F.col(f"am{r}"), r).alias(f"k{r}") for r in range(4)))
    spans = F.flatten(F.array_compact(F.array(F.filter("k0", lambda s: F.length(s["value"]) >= 6), F.col("k1"), F.col("k2"), F.col("k3"))))
    rows = rows.select("repository", "owner", F.array_sort(spans).alias("every"))
    # how far the base spans before each span reach
    rows = rows.withColumn("ends", F.transform("every", lambda s: F.when(s["rank"] < 3, s["end"]).otherwise(0)))
    rows = running(rows, "ends", "reach", lambda s, x: F.greatest(s, x))
    # a long token inside a base span, or around one, is not a candidate of its own; values do not overlap each
    # other, so of the spans that start later only the next one can be a base span inside this value
    following = lambda i: F.get("every", i + 1)
    met = lambda v, i: (F.get("reach", i) > v["start"]) | F.coalesce((following(i)["rank"] < 3) & (following(i)["start"] < v["end"]), F.lit(False))
    apart = F.filter("every", lambda v, i: (v["rank"] < 3) | (~met(v, i) & looks_live(v["value"])))
    every = F.when(F.size("reach") > 0, apart).otherwise(F.col("every"))
    return rows.select(
        "repository", "owner",
        F.transform(every, lambda s: F.struct(s["start"], s["rank"], s["end"], F.sha2(s["value"], 256).alias("hash"), F.coalesce(looks_live(s["value"]), F.lit(False)).alias("live"))).alias("found"),
    )


def ownership(found: DataFrame) -> DataFrame:
    """Per hash the numbers of its distinct repositories and owners; counted in levels, each combined before its shuffle."""
    rows = found.select("repository", "owner", F.explode(F.array_distinct(F.transform("found", lambda s: s["hash"]))).alias("hash"))
    held = rows.distinct().groupBy("hash", "owner").agg(F.count("*").alias("n"))
    return held.groupBy("hash").agg(F.sum("n").alias("repositories"), F.count("*").alias("owners"))


def scan(docs: DataFrame, repository: str = "doc_id", owner: str = "source", copied_owners: int = COPIED_OWNERS, copied_repositories: int = COPIED_REPOSITORIES) -> DataFrame:
    """repository, and spans: array<struct<start, rank, end, hash, live, copied>> by start and kind, for every row."""
    found = materialise(candidates(docs, repository, owner))
    copied = ownership(found).where((F.col("owners") >= copied_owners) | (F.col("repositories") >= copied_repositories)).select("hash")
    held = found.where(F.size("found") > 0).select("repository", F.explode(F.array_distinct(F.transform("found", lambda s: s["hash"]))).alias("hash")).distinct()
    here = held.join(copied, "hash").groupBy(F.col("repository").alias("r")).agg(F.collect_list("hash").alias("copied"))
    marked = F.transform("found", lambda s: s.withField("copied", F.coalesce(F.array_contains("copied", s["hash"]), F.lit(False))))
    kept = F.filter(marked, lambda s: (s["rank"] < 3) | (s["live"] & ~s["copied"]))
    return found.join(here, found.repository.eqNullSafe(here.r), "left").select("repository", kept.alias("spans"))


def listed(spans: Column | str) -> Column:
    kind = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kind, s["rank"]), s["start"], s["end"])), ",")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: every text scanned, judged by its values' owners in the whole corpus."""
    spans = scan(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    count = lambda test: F.size(F.filter("spans", test)).cast("long")
    of_kind = lambda r: lambda s: s["rank"] == r
    return spans.select(
        F.col("repository").alias("doc_id"),
        *(count(of_kind(r)).alias(f"n_{KINDS[r]}") for r in range(3)),
        F.sha2(listed(F.filter("spans", lambda s: s["rank"] < 3)), 256).alias("base_sha256"),
        listed("spans").alias("spans"),
        count(lambda s: s["copied"]).alias("n_copied"),
        count(lambda s: s["live"] & ~s["copied"]).alias("n_owner_live"),
    )


def _sql() -> str:
    quoted = lambda p: "'" + p.replace("'", "''") + "'"

    def spans(pattern: str, rank: int) -> str:
        p, group = quoted(pattern), 2 if rank == 0 else 0
        m = f"regexp_extract_all(t, {p})"
        piece = f"string_split_regex(t, {p})"
        start = f"list_sum(list_transform(({piece})[1:i], lambda x: length(x)))::bigint + coalesce(list_sum(list_transform(({m})[1:i - 1], lambda x: length(x))), 0)::bigint"
        return f"list_transform(regexp_extract_all(t, {p}, {group}), lambda v, i: {{'s': {start}, 'r': {rank}, 'e': {start} + length(({m})[i]), 'v': v}})"

    live = f"""(len(list_distinct(string_split(v, ''))) >= 8 and not regexp_matches(lower(v), '{'|'.join(PLACEHOLDERS)}')
      and (regexp_matches(v, '[0-9]') and regexp_matches(v, '[A-Z]') and regexp_matches(v, '[a-z]') or regexp_full_match(v, '[0-9a-f]{{24,}}') or regexp_full_match(v, 'AKIA[A-Z0-9]{{16,}}')))"""
    return f"""
with d as (select row_number() over () as rid, doc_id, source, coalesce(text, '') as t from documents),
k as (
  select rid, doc_id, source, list_concat(list_filter({spans(ASSIGN, 0)}, lambda x: length(x.v) >= 6), {spans(ACCESS, 1)}, {spans(HEX, 2)}) as base, {spans(VALUE, 3)} as extra from d
), c as (
  select rid, doc_id, source, unnest(list_concat(base, list_filter(extra, lambda x: len(list_filter(base, lambda b: b.s < x.e and x.s < b.e)) = 0))) as x from k
), f as (
  select rid, doc_id, source, coalesce(doc_id::varchar, '') || '/' || coalesce(source, chr(0)) as place, x.s as s, x.r as r, x.e as e, x.v as v, {live.replace("(v", "(x.v")} as live from c
), g as (select * from f where r < 3 or live),
o as (select v from g group by v having count(distinct coalesce(source, chr(0))) >= {COPIED_OWNERS} or count(distinct place) >= {COPIED_REPOSITORIES}),
m as (select g.*, o.v is not null as copied, case r when 0 then 'assign' when 1 then 'access' when 2 then 'hex' else 'value' end || ':' || s || ':' || e as label from g left join o using (v)),
a as (
  select rid, count(*) filter (r = 0) as n_assign, count(*) filter (r = 1) as n_access, count(*) filter (r = 2) as n_hex,
    coalesce(string_agg(label, ',' order by s, r) filter (r < 3), '') as base, string_agg(label, ',' order by s, r) as spans,
    count(*) filter (copied) as n_copied, count(*) filter (live and not copied) as n_owner_live
  from m where r < 3 or live and not copied group by rid
)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, sha256(coalesce(base, '')) as base_sha256,
  coalesce(spans, '') as spans, coalesce(n_copied, 0) as n_copied, coalesce(n_owner_live, 0) as n_owner_live
from d left join a using (rid)
"""


SQL = _sql()
