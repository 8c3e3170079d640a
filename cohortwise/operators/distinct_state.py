"""Exact distinct counts that merge: bitmaps of whole-number ids.

A distinct count of a longer range is not the sum of its months' counts, so
a plain count is of no use to the next report. The state kept here is: per
cell (month and segment, say) and block of 32,768 neighbouring ids one bitmap
of fixed size for each count. States of other ranges or other days are merged
by ``or``; a count over coarser cells is a merge, too. A range that grows by a
month reads the states of the months before and the events of the new one.

A state's size follows the blocks in use, 4 kB a cell, block and count, so
ids should be dense (numbered users); for sparse ones the rows of
``per_entity`` are the smaller state, and merge as well. Ids must be whole
numbers: other types are refused. Rows without an id make their cell appear
and count nothing, as in COUNT(DISTINCT id).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import renewal as N

#: Counts of D9 and D10: all users of a cell, and those of them that renewed.
RENEWAL_COUNTS = {"base_users": "TRUE", "repay_users": "has_repay = 1"}
BLOCK = "_cw_block"
_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def per_entity(rows: DataFrame, keys: list[str], entity: str, counts: dict[str, str]) -> DataFrame:
    """One row per cell and id, with a flag per count (name -> SQL condition). Combines map-side."""
    flags = [F.expr(f"max(coalesce({condition}, FALSE)) AS {name}") for name, condition in counts.items()]
    return rows.groupBy(*keys, entity).agg(*flags)


def distinct_state(rows: DataFrame, keys: list[str], entity: str, counts: dict[str, str]) -> DataFrame:
    """The state of COUNT(DISTINCT entity) under each condition: keys, block, one binary per count."""
    kind = rows.schema[entity].dataType
    if not isinstance(kind, _WHOLE):
        raise ValueError(f"{entity} is {kind.simpleString()}; bitmaps hold whole-number ids")
    # one row an id first: bitmaps are built from reduced rows
    reduced = per_entity(rows, keys, entity, counts)
    bits = [F.expr(f"bitmap_construct_agg(bitmap_bit_position(CASE WHEN {name} THEN CAST({entity} AS BIGINT) END)) AS {name}") for name in counts]
    return reduced.groupBy(*keys, F.expr(f"bitmap_bucket_number(CAST({entity} AS BIGINT)) AS {BLOCK}")).agg(*bits)


def merge_states(*states: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The state of all rows of the given states, by the same keys or by fewer of them."""
    both = reduce(DataFrame.unionByName, states)
    names = [f.name for f in both.schema.fields if isinstance(f.dataType, T.BinaryType)]
    if keys is None:
        keys = [c for c in both.columns if c not in names and c != BLOCK]
    return both.groupBy(*keys, BLOCK).agg(*[F.expr(f"bitmap_or_agg({n}) AS {n}") for n in names])


def state_counts(state: DataFrame) -> DataFrame:
    """The counts of a merged state: one row a cell."""
    names = [f.name for f in state.schema.fields if isinstance(f.dataType, T.BinaryType)]
    keys = [c for c in state.columns if c not in names and c != BLOCK]
    return state.groupBy(*keys).agg(*[F.expr(f"sum(bitmap_count({n})) AS {n}") for n in names])


def inapp_user_state(flags: DataFrame) -> DataFrame:
    """The state of D9: users and renewed users per month and report segment."""
    rows = flags.selectExpr("first_month", f"{N.inapp_segment_sql()} AS segment", "user_id", "has_repay")
    return distinct_state(rows, ["first_month", "segment"], "user_id", RENEWAL_COUNTS)


def web_user_state(flagged_first_orders: DataFrame) -> DataFrame:
    """The state of D10: users and renewed users per web segment."""
    return distinct_state(flagged_first_orders, N.WEB_SEGMENT_KEYS, "user_id", RENEWAL_COUNTS)
