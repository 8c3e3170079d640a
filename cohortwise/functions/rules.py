"""Rule tables of the subscription and experiment reports.

FIXED VALUES. Everything in this module must equal the report definitions
for the results to match: event names, product-code patterns, window
lengths, label strings and the column lists of the wide reports. They are
stated once, in natural order, and every operator reads them from here.
The oracle SQL states them again on its own.
"""

from __future__ import annotations

# --- FIXED VALUES: product line -> purchase event -------------------------
LINE_EVENTS: dict[str, str] = {
    "健走": "purchase_vip_order_wup_h2o",
    "瑜伽": "purchase_vip_order_h2o",
    "舞蹈": "purchase_vip_order_df_h2o",
    "健身": "purchase_vip_order_mm_h2o",
    "拉伸": "purchase_vip_order_db_h2o",
}

# --- FIXED VALUES: in-app purchases ---------------------------------------
# (plan, case-insensitive unanchored pattern, renewal window in days);
# tried in this order, the first match wins.
INAPP_PLANS: list[tuple[str, str, int]] = [
    ("年", r"1_year|12_month|goldyear|yearly|auto\.year|silveryear|365_day|d365|silveryearsale|salesyear", 380),
    ("半年", r"6_month|180_day|d180", 190),
    ("季", r"3_month|90_day|d90", 100),
    ("月", r"1_month|monthly|goldmonth|auto\.month|silvermonth|30_day|d30", 40),
]
INAPP_TEST_DISTINCT_ID = "90451406"
INAPP_DEVICES = ("IOS", "Android")

# --- FIXED VALUES: web purchases ------------------------------------------
WEB_MARKER = "webob"
# first price, first days, renewal price, renewal days
WEB_CODE_PATTERN = r"([0-9]+\.?[0-9]*)d([0-9]+)-([0-9]+\.?[0-9]*)d([0-9]+)"
WEB_EXCLUDED_ENTRANCES = ("75", "10042", "30033", "100040", "50024")
ORDER_NEW = "新增"
ORDER_RENEW = "续订"
WEB_ORDER_TYPES = (ORDER_NEW, ORDER_RENEW)

# product group: first match wins; rows matching none are dropped
GROUP_EXTRA2 = "二级增值"
GROUP_EXTRA1 = "一级增值"
GROUP_MEMBER = "会员"
RAW_TYPE_EXTRA = "增值"
RAW_TYPE_MEMBER = "会员"
RAW_DOUBLE_EXTRA = "二级增值"
RAW_NOT_DOUBLE_EXTRA = "非二级增值"

# web plan, first match wins:
# (label in the renewal report, label in the ARPPU/sales reports,
#  first-price rule, first-days set, renewal-days set).
# Price rule "zero": price = 0; "positive": price > 0 in the ARPPU/sales
# label set only (the renewal label set has no price test for that rule);
# None: no price test.
WEB_PLANS: list[tuple[str, str, str | None, tuple[int, ...], tuple[int, ...]]] = [
    ("0元7天-月", "0元7天-月", "zero", (7,), (28, 30)),
    ("0元7天-季度", "0元7天-季", "zero", (7,), (84, 90)),
    ("0元-月", "首月0元", "zero", (28, 30), (28, 30)),
    ("7天-月", "7天-月_首付非0", "positive", (7,), (28, 30)),
    ("半月", "半月", None, (14,), (14,)),
    ("月", "月", None, (28, 30), (28, 30)),
    ("季度", "季", None, (84, 90), (84, 90)),
    ("半年", "半年", None, (168,), (168,)),
]

# raw window (first days for new orders, renewal days for renewals) -> days
WEB_WINDOW_DAYS: list[tuple[tuple[int, ...], int]] = [
    ((7,), 9),
    ((14,), 17),
    ((28, 30), 35),
    ((84, 90), 99),
    ((168,), 190),
]

# scan bound for renewals: the longest window of each family
INAPP_MAX_WINDOW = 380
WEB_MAX_WINDOW = 190

# --- FIXED VALUES: report labels and column lists -------------------------
METRIC_RATE = "续订率"
METRIC_REVENUE_BASE = "续订收入基数"
METRIC_SALES = "销售额"
METRIC_ORDERS = "订单数"

COL_METRIC_KIND = "指标类型"
COL_BASE_MONTH = "续订基数发生月份"
COL_LINE = "项目"
COL_PRODUCT_TYPE = "产品类型"
COL_ORDER_TYPE = "新增/续订"
COL_MONTH = "年月"
COL_DATA_KIND = "数据类型"

FIRST_PAY = "首付"
NOT_FIRST_PAY = "非首付"

# in-app report columns: (column, plan, is_first_purchase, device or None)
INAPP_REPORT_COLUMNS: list[tuple[str, str, int, str | None]] = [
    ("年_首付_and", "年", 1, "Android"),
    ("年_首付_ios", "年", 1, "IOS"),
    ("年_非首付_and", "年", 0, "Android"),
    ("年_非首付_ios", "年", 0, "IOS"),
    ("月_首付", "月", 1, None),
    ("月_非首付", "月", 0, None),
    ("季_首付", "季", 1, None),
    ("季_非首付", "季", 0, None),
    ("半年_首付", "半年", 1, None),
    ("半年_非首付", "半年", 0, None),
]

# web renewal report columns: plan x order type, in this order
WEB_RENEWAL_REPORT_PLANS = ["7天-月", "0元7天-月", "0元7天-季度", "0元-月", "半月", "月", "季度", "半年"]
WEB_RENEWAL_REPORT_COLUMNS: list[tuple[str, str, str]] = [
    (f"{plan}_{otype}", plan, otype) for plan in WEB_RENEWAL_REPORT_PLANS for otype in WEB_ORDER_TYPES
]

# ARPPU and sales report columns: (column, product group, plan label)
WEB_SALES_REPORT_COLUMNS: list[tuple[str, str, str]] = [
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

# --- FIXED VALUES: experiment training report -----------------------------
GROUP_EXPERIMENT = "实验组"
GROUP_CONTROL = "对照组"

EV_PAGEVIEW = "pageview_general_wup_h2o"
EV_CLICK = "click_general_wup_h2o"
EV_START = "start_action_wup_h2o"
EV_END = "end_action_wup_h2o"

PAGE_WALK = 60000
PAGE_WORKOUT = 60001
PAGE_FILTER = 60067
PAGEINFO_HOME = "Homeworkout"
PAGEINFO_WALKBEAT = "WalBeat"
CLICK_FILTER = 600077
CLICK_SOURCE_FILTER = "筛选"
ENTRANCE_HOME = "504"
ENTRANCE_WALKBEAT = "503"
ENTRANCE_OTHER = "502"
ENTRANCE_OTHER_ID = "2"

SCENE_WALK = "walk整体"
SCENE_WORKOUT = "workout页面"
SCENE_HOME = "tab_home"
SCENE_WALKBEAT = "tab_walkbeat"
SCENE_FILTER_PAGE = "进入筛选二级页面"
SCENE_FILTER_USED = "使用筛选"
SCENE_FILTER_NOT_USED = "未使用筛选"
SCENES = [
    SCENE_WALK,
    SCENE_WORKOUT,
    SCENE_HOME,
    SCENE_WALKBEAT,
    SCENE_FILTER_PAGE,
    SCENE_FILTER_USED,
    SCENE_FILTER_NOT_USED,
]

COL_GROUP = "分组"
COL_SCENE = "场景"
COL_USER_BASE = "用户基数"
COL_START_UV = "开训（用户数）"
COL_COMPLETE_UV = "完训（用户数）"
COL_RETRAIN_RATE = "复训率"


def line_event(line: str) -> str | None:
    """Purchase event of a product line; None for an unknown line (no rows)."""
    return LINE_EVENTS.get(line)
