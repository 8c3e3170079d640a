"""Input schemas of the event and cohort tables.

The reports read one wide, sparse event table. Only the columns below are
used; a table may carry more, which column pruning never reads.
"""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(12, 2)

PURCHASE_COLUMNS = T.StructType(
    [
        T.StructField("event", T.StringType()),
        T.StructField("date", T.DateType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("distinct_id", T.StringType()),
        T.StructField("order_id", T.LongType()),
        T.StructField("product_id_all_product", T.StringType()),
        T.StructField("product_is_subscribe", T.IntegerType()),
        T.StructField("is_first_purchase_withmoney", T.IntegerType()),
        T.StructField("device_type", T.StringType()),
        T.StructField("origin_money", MONEY),
        T.StructField("all_product_order_type", T.StringType()),
        T.StructField("webob_product_type", T.StringType()),
        T.StructField("webob_product_type_is_double_extra", T.StringType()),
        T.StructField("purchase_entrance_all_product", T.StringType()),
    ]
)

WALK_COLUMNS = T.StructType(
    [
        T.StructField("event", T.StringType()),
        T.StructField("date", T.DateType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("page_id", T.IntegerType()),
        T.StructField("pageinfo", T.StringType()),
        T.StructField("click_id", T.IntegerType()),
        T.StructField("click_source_url", T.StringType()),
        T.StructField("action_entrance_wup", T.StringType()),
        T.StructField("action_entrance_id_wup", T.StringType()),
    ]
)

COHORT_COLUMNS = T.StructType(
    [
        T.StructField("group_name", T.StringType()),
        T.StructField("user_id", T.LongType()),
    ]
)
