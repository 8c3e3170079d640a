"""Independent DuckDB SQL for every registered query of the library.

Written from the definitions of the metrics, with constants of its own: a
purchase is renewed if a later purchase of the same event, user and product
EXISTS in its window; rules are small tables joined by rank; a user's first
order is the first by day, product and money; the funnel is one pass of
flags per user. The views ``orders`` and ``events`` are the driver's tables;
``purchase_events`` and ``walk_events`` map them as FIXTURES.md says.

Rounding is written in integers (half away from zero); metrics are DOUBLE
and counts BIGINT, so that both engines print equal values.
"""

from __future__ import annotations


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n"


def pick(expr: str, values: list[str]) -> str:
    """values[expr]; values are SQL."""
    return f"([{', '.join(values)}])[1 + {expr}]"


def half_up(num: str, den: str, places: int) -> str:
    """round(num / den, places) for whole numbers; NULL when den is 0."""
    n, d = f"({num})::HUGEINT * {10**places}", f"({den})::HUGEINT"
    return f"(CASE WHEN {d} > 0 THEN ((2 * {n} + {d}) // (2 * {d}))::DOUBLE / {10**places} END)"


def per_order(money: str, n: str) -> str:
    """round(money / n, 2); money to 8 places."""
    m, d = f"(({money})::DECIMAL(30, 8) * 100000000)::HUGEINT", f"({n})::HUGEINT"
    return f"(CASE WHEN {d} > 0 THEN sign({m}) * ((abs({m}) * 200 + {d} * 100000000) // ({d} * 200000000))::DOUBLE / 100 END)"


# --- test-data mapping (FIXTURES.md) ------------------------------------------

PURCHASES = """
raw_purchases AS (
  SELECT o_orderkey AS k, o_custkey AS c, o_custkey + (o_orderkey % 4 = 3)::INT AS g, o_custkey // 10 + o_orderkey % 3 AS code,
    (o_custkey // 5 + (o_orderkey % 7 = 6)::INT) % 2 = 0 AS in_app, (o_custkey + o_orderkey % 2) % 7 AS device,
    ((date_diff('day', DATE '1995-01-01', o_orderdate::DATE) % 640) + 640) % 640 AS day, o_totalprice
  FROM orders
), mapped AS (
  SELECT k, CASE WHEN k % 59 > 0 THEN k END AS order_id, CASE WHEN k % 53 > 0 THEN c END AS user_id,
    DATE '2024-01-01' + day::INT AS date,
    (['purchase_vip_order_wup_h2o', 'purchase_vip_order_h2o', 'purchase_vip_order_df_h2o', 'purchase_vip_order_mm_h2o', 'purchase_vip_order_db_h2o'])[1 + c % 5] AS event,
    CASE WHEN c = 50 THEN '90451406' WHEN c % 97 <> 3 THEN c::VARCHAR END AS distinct_id,
    CASE WHEN in_app
      THEN (['vip.gold_1_month', 'vip.GoldYear', 'vip.3_month.v2', 'app.auto.month', 'vip_180_day', 'coins_pack_100', 'vip.silveryearsale', NULL])[1 + code % 8]
      ELSE (['webob_0d7-29.9d30', 'webob_9.9d7-29.9d28', 'webob_0d30-19.9d30', 'webob_19.9d14-19.9d14', 'webob_29.9d30-29.9d30',
             'webob_0d7-79.9d90', 'webob_79.9d84-79.9d90', 'webob_169d168-169d168', 'webob_special', 'webob_5d60-5d60'])[1 + code % 10]
    END AS product,
    CASE WHEN k % 13 = 0 THEN NULL WHEN k % 11 = 0 THEN 0::DECIMAL(12,2) ELSE o_totalprice::DECIMAL(12,2) END AS money,
    CASE WHEN k % 41 > 0 THEN (k % 3 = 0)::INT END AS first_pay,
    (k % 10 <> 9)::INT AS subscribed,
    CASE WHEN device <= 2 THEN 'IOS' WHEN device <= 5 THEN 'Android' ELSE 'Web' END AS device,
    CASE WHEN k % 8 <= 2 THEN '新增' WHEN k % 8 <= 6 THEN '续订' ELSE '升级' END AS order_type,
    CASE WHEN g % 29 = 5 THEN NULL WHEN g % 3 = 0 THEN '会员' ELSE '增值' END AS kind,
    CASE WHEN g % 29 = 5 OR g % 3 = 0 THEN NULL WHEN g % 3 = 1 THEN '非二级增值' ELSE '二级增值' END AS extra,
    CASE k % 9 WHEN 0 THEN '75' WHEN 1 THEN NULL ELSE '10001' END AS entrance
  FROM raw_purchases
), purchase_events AS (
  SELECT * FROM mapped
  UNION ALL SELECT * FROM mapped WHERE k % 17 = 0
  UNION ALL SELECT * REPLACE ((money + 1)::DECIMAL(12,2) AS money) FROM mapped WHERE k % 19 = 0
  UNION ALL SELECT * REPLACE ((money + 2)::DECIMAL(12,2) AS money, 'alt_' || product AS product) FROM mapped WHERE k % 23 = 0
  UNION ALL SELECT * REPLACE (date + CASE WHEN contains(product, 'webob') THEN 36 ELSE 41 END AS date, '续订' AS order_type) FROM mapped WHERE k % 29 = 0
)"""

WALKS = """
walk_events AS (
  SELECT user_id, ts::DATE AS date, event_id % 10 AS kind, (event_id // 10) % 4 AS page, (event_id // 40) % 3 AS info,
    (event_id // 40) % 2 AS source, (event_id // 10) % 5 AS entrance, (event_id // 50) % 2 AS entrance_id
  FROM events
), cohort_lists AS (
  SELECT '实验组' AS group_name, user_id FROM events WHERE user_id % 2 = 0 OR user_id % 10 = 1
  UNION ALL SELECT '对照组', user_id FROM events WHERE user_id % 2 = 1
)"""

# --- in-app ---------------------------------------------------------------------

INAPP = """
plans(rank, period_type, diff_days, pattern) AS (VALUES
  (1, '年', 380, '(?i)1_year|12_month|goldyear|yearly|auto\\.year|silveryear|365_day|d365|silveryearsale|salesyear'),
  (2, '半年', 190, '(?i)6_month|180_day|d180'),
  (3, '季', 100, '(?i)3_month|90_day|d90'),
  (4, '月', 40, '(?i)1_month|monthly|goldmonth|auto\\.month|silvermonth|30_day|d30')
), product_plans AS (
  SELECT product, arg_min(period_type, rank) AS period_type, arg_min(diff_days, rank) AS diff_days
  FROM (SELECT DISTINCT product FROM purchase_events) JOIN plans ON regexp_matches(product, pattern) GROUP BY product
), inapp AS (
  SELECT * FROM purchase_events
  WHERE event = 'purchase_vip_order_wup_h2o' AND NOT contains(product, 'webob') AND money > 0 AND subscribed = 1
    AND distinct_id <> '90451406' AND device IN ('IOS', 'Android')
), bought AS (
  SELECT DISTINCT event, date_trunc('month', date)::DATE AS first_month, user_id, product, first_pay, device, money, date AS first_date,
    period_type, diff_days
  FROM inapp LEFT JOIN product_plans USING (product) WHERE date BETWEEN DATE '2024-01-01' AND DATE '2024-06-30'
), cohort AS (
  SELECT b.*, EXISTS (
      SELECT 1 FROM inapp r WHERE r.event = b.event AND r.user_id = b.user_id AND r.product = b.product
        AND r.date > b.first_date AND r.date <= b.first_date + b.diff_days) AS renewed
  FROM bought b WHERE period_type IS NOT NULL
), segments(segment, period_type, first_pay, device) AS (VALUES
  ('年_首付_and', '年', 1, 'Android'), ('年_首付_ios', '年', 1, 'IOS'), ('年_非首付_and', '年', 0, 'Android'), ('年_非首付_ios', '年', 0, 'IOS'),
  ('月_首付', '月', 1, NULL), ('月_非首付', '月', 0, NULL), ('季_首付', '季', 1, NULL), ('季_非首付', '季', 0, NULL),
  ('半年_首付', '半年', 1, NULL), ('半年_非首付', '半年', 0, NULL)
), placed AS (
  SELECT c.*, s.segment FROM cohort c LEFT JOIN segments s
    ON s.period_type = c.period_type AND s.first_pay = c.first_pay AND (s.device IS NULL OR s.device = c.device)
)"""
INAPP_SEGMENTS = ["年_首付_and", "年_首付_ios", "年_非首付_and", "年_非首付_ios", "月_首付", "月_非首付", "季_首付", "季_非首付", "半年_首付", "半年_非首付"]
_IN = with_(PURCHASES, INAPP)
_FLAG_KEYS = "first_month, user_id, period_type, first_pay AS is_first_purchase_withmoney, device AS device_type"
_USERS = "COUNT(DISTINCT user_id) AS base_users, COUNT(DISTINCT user_id) FILTER (renewed) AS repay_users"


def _inapp_report() -> str:
    users = lambda c, more="": f"COUNT(DISTINCT user_id) FILTER (segment = '{c}'{more})"
    rates = ", ".join(f'{half_up(users(c, " AND renewed"), users(c), 2)} AS "{c}"' for c in INAPP_SEGMENTS)
    money = ", ".join(f"COALESCE(SUM(money) FILTER (segment = '{c}'), 0)::DOUBLE AS \"{c}\"" for c in INAPP_SEGMENTS)
    return _IN + f"""SELECT '续订率' AS "指标类型", first_month AS "续订基数发生月份", {rates} FROM placed GROUP BY first_month
UNION ALL SELECT '续订收入基数', first_month, {money} FROM placed GROUP BY first_month"""


# --- web ------------------------------------------------------------------------

WEB = r"""
codes AS (
  SELECT product, regexp_extract(product, '([0-9]+\.?[0-9]*)d([0-9]+)-([0-9]+\.?[0-9]*)d([0-9]+)', ['price', 'days', 'later_price', 'later_days']) AS x
  FROM (SELECT DISTINCT product FROM purchase_events WHERE contains(product, 'webob'))
), parts AS (
  SELECT product, TRY_CAST(x.price AS DOUBLE) AS price, TRY_CAST(x.days AS INT) AS first_days, TRY_CAST(x.later_days AS INT) AS later_days FROM codes
), web_plans(rank, renewal_plan, sales_plan, free, firsts, laters) AS (VALUES
  (1, '0元7天-月', '0元7天-月', TRUE, [7], [28, 30]), (2, '0元7天-季度', '0元7天-季', TRUE, [7], [84, 90]), (3, '0元-月', '首月0元', TRUE, [28, 30], [28, 30]),
  (4, '7天-月', '7天-月_首付非0', FALSE, [7], [28, 30]), (5, '半月', '半月', FALSE, [14], [14]), (6, '月', '月', FALSE, [28, 30], [28, 30]),
  (7, '季度', '季', FALSE, [84, 90], [84, 90]), (8, '半年', '半年', FALSE, [168], [168])
), labeled AS (
  SELECT product, first_days, later_days, arg_min(renewal_plan, rank) AS renewal_plan, arg_min(sales_plan, rank) AS sales_plan
  FROM parts LEFT JOIN web_plans ON (NOT free OR price = 0) AND list_contains(firsts, first_days) AND list_contains(laters, later_days)
  GROUP BY product, first_days, later_days
), windows(raw, days) AS (VALUES (7, 9), (14, 17), (28, 35), (30, 35), (84, 99), (90, 99), (168, 190)),
web AS (
  SELECT e.*, l.* EXCLUDE (product),
    CASE WHEN extra = '二级增值' THEN '二级增值' WHEN extra = '非二级增值' AND kind = '增值' THEN '一级增值' WHEN kind = '会员' THEN '会员' END AS product_group
  FROM purchase_events e JOIN labeled l USING (product)
  WHERE event = 'purchase_vip_order_wup_h2o' AND order_type IN ('新增', '续订')
    AND COALESCE(entrance NOT IN ('75', '10042', '30033', '100040', '50024'), TRUE)
), subscriptions AS (
  SELECT DISTINCT event, user_id, product, order_type, product_group, money, date, renewal_plan, raw, days
  FROM (SELECT *, CASE order_type WHEN '新增' THEN first_days ELSE later_days END AS raw FROM web) LEFT JOIN windows USING (raw)
  WHERE subscribed = 1 AND product_group IS NOT NULL AND renewal_plan IS NOT NULL AND raw IS NOT NULL
    AND date BETWEEN DATE '2024-01-01' AND DATE '2024-06-30'
), web_base AS (
  SELECT event, '健走' AS event_cn, date_trunc('month', date)::DATE AS first_month, user_id, product, order_type, product_group,
    COALESCE(money, 0) AS money, date AS first_date, renewal_plan, raw, days
  FROM subscriptions
), renewals AS (
  SELECT DISTINCT event, user_id, product, date FROM web WHERE subscribed = 1 AND order_type = '续订'
), first_orders AS (
  SELECT f.*, EXISTS (
      SELECT 1 FROM renewals r WHERE r.event = f.event AND r.user_id = f.user_id AND r.product = f.product
        AND r.date > f.first_date AND r.date <= f.first_date + f.days) AS renewed
  FROM (SELECT * FROM web_base
    QUALIFY row_number() OVER (PARTITION BY first_month, product_group, renewal_plan, order_type, user_id ORDER BY first_date, product, money) = 1) f
)"""
# distinct orders of the order reports
WEB_ORDERS = """
sold AS (
  SELECT DISTINCT order_id, date, product, order_type, COALESCE(money, 0) AS money, product_group, renewal_plan, sales_plan, first_days,
    date_trunc('month', date)::DATE AS stat_month
  FROM web WHERE product_group IS NOT NULL AND date BETWEEN DATE '2024-01-01' AND DATE '2024-06-30'
)"""
_WEB, _SOLD = with_(PURCHASES, WEB), with_(PURCHASES, WEB, WEB_ORDERS)
_WEB_ROW = """event, event_cn, first_month, user_id, product AS product_id_all_product, order_type, product_group AS product_type_group,
  money::DOUBLE AS origin_money, first_date, renewal_plan AS product_period_type, raw AS window_days_raw, days AS diff_days"""
_WEB_CELL = "event_cn, first_month, product_group AS product_type_group, renewal_plan AS product_period_type, order_type"
WEB_RENEWAL_PLANS = ["7天-月", "0元7天-月", "0元7天-季度", "0元-月", "半月", "月", "季度", "半年"]
SALES_COLUMNS = [
    ("【会员】7天_月（首付非0）", "会员", "7天-月_首付非0"),
    ("【会员】月", "会员", "月"),
    ("【会员】季", "会员", "季"),
    ("【会员】半月（14d）", "会员", "半月"),
    ("【会员】半年（168d）", "会员", "半年"),
    ("【一级增值】首月0元", "一级增值", "首月0元"),
    ("【一级增值】月", "一级增值", "月"),
    ("【一级增值】季", "一级增值", "季"),
    ("【一级增值】7天_月（首付0元）", "一级增值", "0元7天-月"),
    ("【一级增值】7天_季（首付0元）", "一级增值", "0元7天-季"),
    ("【二级增值】月", "二级增值", "月"),
    ("【二级增值】季", "二级增值", "季"),
]


def _web_renewal_report() -> str:
    cells = [(f"{p}_{o}", f"renewal_plan = '{p}' AND order_type = '{o}'") for p in WEB_RENEWAL_PLANS for o in ("新增", "续订")]
    users = lambda c: f"COUNT(DISTINCT user_id) FILTER ({c})"
    rates = ", ".join(f'{half_up(users(c + " AND renewed"), users(c), 4)} AS "{n}"' for n, c in cells)
    money = ", ".join(f'ROUND(SUM(money) FILTER ({c}), 0)::DOUBLE AS "{n}"' for n, c in cells)
    return _WEB + f"""SELECT '续订率' AS "指标类型", event_cn AS "项目", first_month AS "续订基数发生月份", product_group AS "产品类型", {rates}
FROM first_orders GROUP BY 2, 3, 4
UNION ALL SELECT '续订收入基数', event_cn, first_month, product_group, {money} FROM first_orders GROUP BY 2, 3, 4"""


def _sales(value: str) -> str:
    """One column per report column; value is SQL with {0} for the column's condition."""
    return ", ".join(f"{value.format(f"product_group = '{g}' AND sales_plan = '{p}'")} AS \"{c}\"" for c, g, p in SALES_COLUMNS)


_ARPPU = per_order("SUM(money) FILTER ({0})", "COUNT(DISTINCT order_id) FILTER ({0})")
_NEW = "FROM sold WHERE sales_plan IS NOT NULL AND order_type = '新增' GROUP BY"

# --- experiment -----------------------------------------------------------------

EXPERIMENT = """
members AS (SELECT DISTINCT group_name, user_id FROM cohort_lists WHERE user_id IS NOT NULL),
arms AS (SELECT group_name, COUNT(*) AS user_base, CASE group_name WHEN '实验组' THEN 1 ELSE 2 END AS group_order FROM members GROUP BY group_name),
flags AS (
  SELECT user_id, did_start, did_end, viewed AND page = 0 AS walk, viewed AND page = 1 AS workout,
    viewed AND page = 1 AND info = 0 AS home, viewed AND page = 1 AND info = 1 AS walkbeat, viewed AND page = 2 AS filter_page,
    kind = 2 AND page = 0 AND source = 0 AS filter_use, entrance = 0 AS from_home, entrance = 1 AS from_walkbeat,
    entrance IN (0, 1) OR entrance = 2 AND entrance_id = 0 AS from_workout
  FROM (SELECT *, kind IN (0, 1) AS viewed, kind BETWEEN 3 AND 6 AS did_start, kind IN (7, 8) AS did_end FROM walk_events)
  WHERE date BETWEEN DATE '2024-01-05' AND DATE '2024-01-11'
), users AS (
  SELECT user_id, bool_or(walk) AS walk, bool_or(workout) AS workout, bool_or(home) AS home, bool_or(walkbeat) AS walkbeat,
    bool_or(filter_page) AS page, bool_or(filter_use) AS used,
    COUNT(*) FILTER (did_start) AS s1, COUNT(*) FILTER (did_end) AS e1,
    COUNT(*) FILTER (did_start AND from_workout) AS s2, COUNT(*) FILTER (did_end AND from_workout) AS e2,
    COUNT(*) FILTER (did_start AND from_home) AS s3, COUNT(*) FILTER (did_end AND from_home) AS e3,
    COUNT(*) FILTER (did_start AND from_walkbeat) AS s4, COUNT(*) FILTER (did_end AND from_walkbeat) AS e4
  FROM flags GROUP BY user_id
), scenes AS (
  SELECT group_name, user_id, UNNEST([
    {'scene': 'walk整体', 'n': 1, 'base': walk, 'inside': TRUE, 's': s1, 'e': e1},
    {'scene': 'workout页面', 'n': 2, 'base': workout, 'inside': TRUE, 's': s2, 'e': e2},
    {'scene': 'tab_home', 'n': 3, 'base': home, 'inside': TRUE, 's': s3, 'e': e3},
    {'scene': 'tab_walkbeat', 'n': 4, 'base': walkbeat, 'inside': TRUE, 's': s4, 'e': e4},
    {'scene': '进入筛选二级页面', 'n': 5, 'base': page, 'inside': page, 's': s1, 'e': e1},
    {'scene': '使用筛选', 'n': 6, 'base': used, 'inside': used, 's': s1, 'e': e1},
    {'scene': '未使用筛选', 'n': 7, 'base': page AND NOT used, 'inside': page AND NOT used, 's': s1, 'e': e1}], recursive := TRUE)
  FROM members LEFT JOIN users USING (user_id)
), activity AS (
  SELECT group_name, scene, user_id, s AS n_start, e AS n_complete FROM scenes WHERE inside AND s + e > 0
), uv AS (
  SELECT group_name, scene, COUNT(*) FILTER (n_start > 0) AS start_uv, COUNT(*) FILTER (n_complete > 0) AS complete_uv,
    COUNT(*) FILTER (n_start >= 2) AS retrain_uv
  FROM activity GROUP BY 1, 2
), grid AS (
  SELECT group_name, group_order, scene, n AS scene_order, COUNT(*) FILTER (base) AS user_base FROM scenes JOIN arms USING (group_name) GROUP BY 1, 2, 3, 4
)"""
_EXP = with_(WALKS, EXPERIMENT)
_RETRAIN = f"COALESCE({half_up('retrain_uv', 'start_uv', 4)}, 0)"


def placed(report: str, order: str) -> str:
    """A report's rows with their place by the given order."""
    return f"SELECT *, ROW_NUMBER() OVER (ORDER BY {order}) AS position FROM ({report})"


ORACLE_SQL: dict[str, str] = {
    "inapp_base_orders": _IN + """SELECT event, first_month, user_id, product AS product_id_all_product, first_pay AS is_first_purchase_withmoney,
      device AS device_type, money::DOUBLE AS origin_money, first_date, period_type, diff_days FROM cohort""",
    "inapp_plan_mix": _IN + "SELECT period_type, COUNT(*) AS purchases, COUNT(DISTINCT user_id) AS users FROM bought GROUP BY 1",
    "web_base_orders": _WEB + f"SELECT {_WEB_ROW} FROM web_base",
    "web_product_group_mix": _SOLD + """SELECT product_group AS product_type_group, COUNT(DISTINCT order_id) AS orders, SUM(money)::DOUBLE AS revenue
      FROM sold GROUP BY 1""",
    "web_plan_mix": with_(PURCHASES, WEB, WEB_ORDERS.replace("SELECT DISTINCT order_id", "SELECT DISTINCT user_id, order_id")) + """
      SELECT renewal_plan, sales_plan AS period_group, (first_days IS NOT NULL)::INT AS code_parsed, COUNT(DISTINCT order_id) AS orders,
        COUNT(DISTINCT user_id) AS users, SUM(money)::DOUBLE AS revenue FROM sold GROUP BY 1, 2, 3""",
    "first_order_per_segment": _WEB + f"SELECT {_WEB_ROW} FROM first_orders",
    "renewal_candidates": _IN + """SELECT DISTINCT event, user_id, product AS product_id_all_product, date AS repay_date FROM inapp r
      WHERE date > DATE '2024-01-01' AND date <= DATE '2024-06-30' + 380
        AND EXISTS (SELECT 1 FROM cohort c WHERE c.event = r.event AND c.user_id = r.user_id AND c.product = r.product)""",
    "renewal_flags": _IN + f"SELECT {_FLAG_KEYS}, MAX(renewed::INT) AS has_repay FROM cohort GROUP BY ALL",
    "renewal_flags_matured": _IN + f"""SELECT {_FLAG_KEYS}, MAX(renewed::INT) AS has_repay,
      MIN((first_date + diff_days <= DATE '2025-02-28')::INT) AS matured FROM cohort GROUP BY ALL""",
    "web_renewal_candidates": _WEB + """SELECT event, user_id, product AS product_id_all_product, date AS repay_date FROM renewals r
      WHERE date > DATE '2024-01-01' AND date <= DATE '2024-06-30' + 190
        AND EXISTS (SELECT 1 FROM first_orders f WHERE f.event = r.event AND f.user_id = r.user_id AND f.product = r.product)""",
    "web_renewal_flags": _WEB + f"SELECT {_WEB_CELL}, user_id, renewed::INT AS has_repay FROM first_orders",
    "inapp_renewal_users": _IN + f"SELECT first_month, segment, {_USERS} FROM placed GROUP BY 1, 2",
    "web_renewal_users": _WEB + f"SELECT {_WEB_CELL}, {_USERS} FROM first_orders GROUP BY ALL",
    "renewal_rate": _IN + f"""SELECT *, {half_up('repay_users', 'base_users', 2)} AS rate
      FROM (SELECT first_month, segment, {_USERS} FROM placed GROUP BY 1, 2)""",
    "web_renewal_rate": _WEB + f"""SELECT *, {half_up('repay_users', 'base_users', 4)} AS rate
      FROM (SELECT {_WEB_CELL}, {_USERS} FROM first_orders GROUP BY ALL)""",
    "inapp_revenue_base": _IN + "SELECT first_month, segment, SUM(money)::DOUBLE AS revenue FROM placed GROUP BY 1, 2",
    "web_revenue_base": _WEB + f"SELECT {_WEB_CELL}, ROUND(SUM(money), 0)::BIGINT AS revenue_base FROM first_orders GROUP BY ALL",
    "web_arppu": _SOLD + f"""SELECT order_type, stat_month, product_group AS product_type_group, sales_plan AS period_group, SUM(money)::DOUBLE AS revenue,
      COUNT(DISTINCT order_id) AS orders, {per_order('SUM(money)', 'COUNT(DISTINCT order_id)')} AS arppu
      FROM sold WHERE sales_plan IS NOT NULL GROUP BY 1, 2, 3, 4""",
    "web_new_sales": _SOLD + f"""SELECT stat_month, product_group AS product_type_group, sales_plan AS period_group,
      ROUND(SUM(money), 2)::DOUBLE AS revenue, COUNT(DISTINCT order_id) AS orders {_NEW} 1, 2, 3""",
    "scene_user_activity": _EXP + "SELECT * FROM activity",
    "experiment_groups": _EXP + "SELECT * FROM arms",
    "exposure_base": _EXP + "SELECT group_name, scene, user_base FROM grid WHERE scene_order <= 4 AND user_base > 0",
    "filter_funnel_users": _EXP + "SELECT group_name, user_id, scene FROM scenes WHERE n >= 5 AND base",
    "scene_uv": _EXP + "SELECT group_name, scene, start_uv, complete_uv FROM uv",
    "repeat_users": _EXP + f"SELECT group_name, scene, retrain_uv, {_RETRAIN} AS retrain_rate FROM uv",
    "dense_scene_grid": _EXP + "SELECT * FROM grid",
    "segment_pivot": _SOLD + f"SELECT stat_month, {_sales('COUNT(DISTINCT order_id) FILTER ({0})')} {_NEW} 1",
    "inapp_renewal_report": _inapp_report(),
    "web_renewal_report": _web_renewal_report(),
    "web_arppu_report": _SOLD + f"""SELECT order_type AS "新增/续订", stat_month AS "年月", {_sales(_ARPPU)}
      FROM sold WHERE sales_plan IS NOT NULL GROUP BY 1, 2""",
    "web_new_sales_report": _SOLD + f"""SELECT '销售额' AS "数据类型", stat_month AS "年月",
      {_sales('COALESCE(ROUND(SUM(money) FILTER ({0}), 2), 0)::DOUBLE')} {_NEW} 2
      UNION ALL SELECT '订单数', stat_month, {_sales('(COUNT(DISTINCT order_id) FILTER ({0}))::DOUBLE')} {_NEW} 2""",
    "experiment_training_report": _EXP + f"""SELECT group_name AS "分组", scene AS "场景", user_base AS "用户基数",
      COALESCE(start_uv, 0) AS "开训（用户数）", COALESCE(complete_uv, 0) AS "完训（用户数）", {_RETRAIN} AS "复训率"
      FROM grid LEFT JOIN uv USING (group_name, scene) ORDER BY group_order, scene_order""",
}

# the same definitions, reached by other ways
ORACLE_SQL |= {
    "inapp_renewal_users_merged": ORACLE_SQL["inapp_renewal_users"],
    "web_renewal_users_merged": ORACLE_SQL["web_renewal_users"],
    "inapp_renewal_users_total": _IN + f"SELECT segment, {_USERS} FROM placed GROUP BY 1",
    "inapp_renewal_report_by_user": ORACLE_SQL["inapp_renewal_report"],
    "web_renewal_report_by_user": ORACLE_SQL["web_renewal_report"],
    "experiment_training_report_by_user": ORACLE_SQL["experiment_training_report"],
    "cohort_lists": _EXP + "SELECT group_name, user_id FROM members",
    "experiment_training_report_from_lists": ORACLE_SQL["experiment_training_report"],
    # sort orders written from the reports' definitions
    "inapp_renewal_report_ordered": placed(ORACLE_SQL["inapp_renewal_report"], """"指标类型" <> '续订率', "续订基数发生月份" """),
    "web_renewal_report_ordered": placed(ORACLE_SQL["web_renewal_report"], '"项目", "续订基数发生月份", "产品类型", "指标类型"'),
    "web_arppu_report_ordered": placed(ORACLE_SQL["web_arppu_report"], """array_position(['新增', '续订'], "新增/续订"), "年月" """),
    "web_new_sales_report_ordered": placed(ORACLE_SQL["web_new_sales_report"], '"年月", "数据类型" DESC'),
    "experiment_training_report_ordered": placed(
        ORACLE_SQL["experiment_training_report"],
        """"分组" <> '实验组', array_position(['walk整体', 'workout页面', 'tab_home', 'tab_walkbeat', '进入筛选二级页面', '使用筛选', '未使用筛选'], "场景")""",
    ),
}
