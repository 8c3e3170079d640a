r"""Chat formatting from a declarative template. DataFrame functions only.

A ``Template`` names the markers around a turn, the roles whose text carries
loss, the control strings, and the turn order as a finite-state machine
(state, role) -> state. ``format_conversations`` gives one row per
conversation: the formatted text, its segments with a loss flag each, and
whether the machine accepts the order of roles (and the first turn that it
rejects). Every turn is formatted, also in a conversation that is rejected.

Control strings inside roles and texts are escaped: a backslash is doubled,
and a control string gets a backslash after its first character. So no
control string stands in a text, the markers alone delimit turns, and
``read_back`` restores roles and texts exactly.

A conversation is one row of the result, so its turns meet in one task; they
are the only thing grouped, and their texts are what the row holds anyway.

Defined results: null texts and null roles are empty (an empty role is
outside the machine's alphabet); turns are ordered by (turn, role, text),
nulls first, so that ties and repeated rows have one order and all stay;
null conv_ids are one conversation; further columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table


@dataclass(frozen=True)
class Template:
    start: str = "<|im_start|>"
    separator: str = "<|im_sep|>"
    end: str = "<|im_end|>"
    after: str = "\n"
    loss_roles: tuple[str, ...] = ("assistant",)
    #: Further strings that must not stand in a text.
    controls: tuple[str, ...] = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|endoftext|>")
    order: dict[tuple[str, str], str] = field(
        default_factory=lambda: {
            ("start", "system"): "system",
            ("start", "user"): "user",
            ("system", "user"): "user",
            ("user", "assistant"): "assistant",
            ("assistant", "user"): "user",
        }
    )
    accepted: tuple[str, ...] = ("assistant",)

    def all_controls(self) -> tuple[str, ...]:
        return (self.start, self.separator, self.end, *self.controls)


def escape(text: Column, template: Template) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for control in template.all_controls():
        out = F.replace(out, F.lit(control), F.lit(f"{control[0]}\\{control[1:]}"))
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def run_machine(roles: Column, template: Template) -> Column:
    """struct<state, at, bad>: the last state, the number of roles read, the place of the first rejected one (or null)."""
    moves = F.create_map(*(F.lit(x) for (state, role), to in template.order.items() for x in (f"{state}\n{role}", to)))

    def step(s: Column, role: Column) -> Column:
        to = F.when(s["bad"].isNull(), F.try_element_at(moves, F.concat_ws("\n", s["state"], role)))
        bad = F.coalesce(s["bad"], F.when(to.isNull(), s["at"]))
        return F.struct(F.coalesce(to, s["state"]).alias("state"), (s["at"] + 1).alias("at"), bad.alias("bad"))

    return F.aggregate(roles, F.struct(F.lit("start").alias("state"), F.lit(0).alias("at"), F.lit(None).cast("int").alias("bad")), step)


def format_conversations(rows: DataFrame, template: Template = Template()) -> DataFrame:
    """rows: (conv_id, turn, role, text). Returns conv_id, valid, first_bad_turn, formatted, segments array<struct<text, loss>>."""
    words = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    plain = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), words("role").alias("role"), words("text").alias("text"))
    plain = plain.select("conv_id", F.struct("turn", "role", "text", escape(F.col("role"), template).alias("head"), escape(F.col("text"), template).alias("body")).alias("t"))
    turns = plain.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))

    def segments(t: Column) -> Column:
        piece = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
        return F.array(
            piece(F.concat(F.lit(template.start), t["head"], F.lit(template.separator)), F.lit(False)),
            piece(t["body"], t["role"].isin(*template.loss_roles)),
            piece(F.lit(template.end + template.after), F.lit(False)),
        )

    out = turns.select("conv_id", run_machine(F.transform("turns", lambda t: t["role"]), template).alias("m"), F.flatten(F.transform("turns", segments)).alias("segments"))
    return out.select(
        "conv_id",
        (F.col("m.bad").isNull() & F.col("m.state").isin(*template.accepted)).alias("valid"),
        F.col("m.bad").alias("first_bad_turn"),
        F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"),
        "segments",
    )


def read_back(formatted: DataFrame, template: Template = Template()) -> DataFrame:
    """Adds turns array<struct<role, text>>, parsed from the formatted text, and loss_text, from the segments' mask."""
    quoted = lambda s: f"\\Q{s}\\E"

    def turn(piece: Column) -> Column:
        parts = F.split(piece, f"{quoted(template.separator)}|{quoted(template.end + template.after)}", -1)
        return F.struct(unescape(F.get(parts, F.lit(0))).alias("role"), unescape(F.get(parts, F.lit(1))).alias("text"))

    pieces = F.split("formatted", quoted(template.start), -1)
    masked = F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"]))
    return formatted.withColumns({"turns": F.transform(F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0))), turn), "loss_text": F.array_join(masked, "")})


PROBE = "</s>[INST] ok [/INST]"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: every conversation and the probe -1, formatted and read back."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    out = read_back(format_conversations(rows.unionByName(probe)))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )


def _sql() -> str:
    t = Template()
    marks = len(t.start) + len(t.separator) + len(t.end) + len(t.after)
    n_controls = lambda c: " + ".join(f"(length({c}) - length(replace({c}, '{x}', ''))) // {len(x)}" for x in t.all_controls())
    size = lambda c: f"length({c}) + length({c}) - length(replace({c}, chr(92), '')) + {n_controls(c)}"
    return f"""
with c as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '{PROBE}' union all select -1, 1, 'assistant', '{PROBE}'
), n as (
  select *, lag(role) over w as before, row_number() over w as k, count(*) over (partition by conv_id) as n
  from c window w as (partition by conv_id order by turn nulls first, role, text)
)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by k)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by k) filter (role = 'assistant'), '')) as loss_sha256,
  sum({marks} + {size('role')} + {size('text')})::bigint as formatted_chars,
  bool_and(case when k = 1 then role in ('system', 'user') else (before, role) in (('system', 'user'), ('user', 'assistant'), ('assistant', 'user')) end
    and (k < n or role = 'assistant')) as valid
from n group by conv_id
"""


SQL = _sql()
