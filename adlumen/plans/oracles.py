"""The registered queries as plain SQL.

Written from the meaning of each report, with the self-joins and row-level
steps the DataFrame operators avoid. Rounded ratios are whole-number
arithmetic, so that both sides round half up exactly.
"""

from __future__ import annotations


def half_up(part: str, base: str, digits: int) -> str:
    """``part / base`` for whole numbers, rounded half away from zero."""
    scale = 10 ** digits
    return (f"(sign({part}) * ((2 * {scale} * abs(CAST({part} AS HUGEINT)) + CAST({base} AS HUGEINT))"
            f" // (2 * nullif(CAST({base} AS HUGEINT), 0))) / {float(scale)})")


def units(total: str) -> str:
    """A DECIMAL(…,4) total in ten-thousandths."""
    return f"CAST({total} * 10000 AS HUGEINT)"


def pct(part: str, base: str) -> str:
    return half_up(f"(100 * ({part}))", f"({base})", 2)


def mean(total: str, count: str) -> str:
    """Mean cost with eight digits."""
    return f"({half_up(f'(10000 * {units(total)})', f'({count})', 0)} / 100000000.0)"


TENANT = "CAST(1 + {c} % 3 AS BIGINT)"
AD = f"""ad AS (
  SELECT p_partkey AS id, {TENANT.format(c='(p_partkey % 20)')} AS tenant_id,
         p_partkey % 20 AS campaign_id, p_name AS creative_url, p_type AS target_audience
  FROM part)"""
CAMPAIGN = f"""campaign AS (
  SELECT p_partkey % 20 AS id, {TENANT.format(c='(p_partkey % 20)')} AS tenant_id,
         'Campaign ' || CAST(p_partkey % 20 AS VARCHAR) AS name,
         SUM(CAST(p_retailprice AS DECIMAL(12,2))) AS budget,
         CASE WHEN p_partkey % 20 % 5 = 4 THEN 'paused' ELSE 'active' END AS status,
         DATE '1995-01-01' AS start_date, DATE '2024-12-31' AS end_date
  FROM part GROUP BY ALL)"""
VOLUME = f"""impression AS (
  SELECT l_partkey AS ad_id, {TENANT.format(c='(l_partkey % 20)')} AS tenant_id,
         l_orderkey AS user_id, l_shipdate AS timestamp, CAST(l_shipdate AS DATE) AS day,
         CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * 0.01 AS DECIMAL(10,4)) AS cost
  FROM lineitem)"""
EVENT = f"""ev AS (
  SELECT event_id AS id, ts AS timestamp, CAST(ts AS DATE) AS day, user_id, event_type, value,
         CAST(props->>'$.k' AS BIGINT) AS ad_id, CAST(props->>'$.k' AS BIGINT) % 20 AS campaign_id,
         {TENANT.format(c="(CAST(props->>'$.k' AS BIGINT) % 20)")} AS tenant_id
  FROM events)"""
IMPRESSION = """impression AS (
  SELECT id, tenant_id, campaign_id, ad_id, user_id, timestamp, day,
         CAST(value AS DECIMAL(10,4)) AS cost FROM ev WHERE event_type = 'view')"""
# The newest earlier event, found by a join over all earlier ones.
CLICK = """click AS (
  SELECT c.id, c.tenant_id, max_by(v.id, (v.timestamp, v.id)) AS impression_id, c.timestamp
  FROM ev c LEFT JOIN ev v ON v.event_type = 'view' AND v.tenant_id = c.tenant_id
    AND v.user_id = c.user_id AND (v.timestamp, v.id) < (c.timestamp, c.id)
  WHERE c.event_type = 'click' GROUP BY c.id, c.tenant_id, c.timestamp)"""
CONVERSION = """conversion AS (
  SELECT s.id, s.tenant_id, max_by(c.id, (c.timestamp, c.id)) AS click_id, s.timestamp,
         CAST(s.value AS DECIMAL(10,2)) AS conversion_value
  FROM ev s LEFT JOIN ev c ON c.event_type = 'click' AND c.tenant_id = s.tenant_id
    AND c.user_id = s.user_id AND (c.timestamp, c.id) < (s.timestamp, s.id)
  WHERE s.event_type = 'purchase' GROUP BY s.id, s.tenant_id, s.timestamp, s.value)"""
LOG = """log AS (
  SELECT * FROM (
    SELECT id, tenant_id, CAST(campaign_id AS VARCHAR) AS aggregate_id, campaign_id, timestamp, day,
           CASE event_type WHEN 'view' THEN 'impression_created' WHEN 'click' THEN 'click_registered'
                WHEN 'purchase' THEN 'conversion_tracked' ELSE event_type END AS event_type,
           user_id, CAST(value AS DECIMAL(10,4)) AS cost,
           row_number() OVER (PARTITION BY tenant_id, campaign_id ORDER BY timestamp, id)
             AS sequence_number
    FROM ev)
  WHERE event_type <> 'error')"""
TENANTS = "tenants AS (SELECT r_regionkey + 1 AS tenant_id FROM region)"
NOON = "TIMESTAMP '2024-01-30 12:00:00'"
LATER = "TIMESTAMP '2002-01-01 00:00:00'"


def _with(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


E_ALL = (AD, CAMPAIGN, EVENT, IMPRESSION)
V_ALL = (AD, CAMPAIGN, VOLUME)


BORN = """born AS (
  SELECT DISTINCT ON (tenant_id, user_id) tenant_id, user_id, day AS cohort_month
  FROM impression {when} ORDER BY tenant_id, user_id, timestamp)"""
AGES = """ages AS (
  SELECT tenant_id, cohort_month, day - cohort_month AS period_days,
         count(DISTINCT user_id) AS seen, count(*) AS total_impressions, sum(cost) AS spend
  FROM impression JOIN born USING (tenant_id, user_id)
  WHERE day - cohort_month <= 30 {more} GROUP BY ALL)"""
SIZE = "arg_min(seen, period_days) OVER (PARTITION BY tenant_id, cohort_month)"


def _cohort(*sources: str) -> str:
    return _with(*sources, BORN.format(when=""), AGES.format(more=""),
                 f"sized AS (SELECT *, {SIZE} AS size FROM ages)") + f"""
SELECT tenant_id, cohort_month, period_days, seen AS users, total_impressions,
       {pct('seen', 'size')} AS retention_rate FROM sized"""


def _advanced(now: str, days: int, *sources: str, extra: str = "") -> str:
    recent = f"WHERE timestamp BETWEEN {now} - INTERVAL {days} DAY AND {now}"
    return _with(*sources, BORN.format(when=recent),
                 AGES.format(more=f"AND timestamp <= {now} {extra}"),
                 f"sized AS (SELECT *, {SIZE} AS cohort_size FROM ages)") + f"""
SELECT tenant_id, cohort_month, period_days, seen AS active_users, total_impressions,
       CAST(spend AS DOUBLE) AS cohort_spend, cohort_size,
       {pct('seen', 'cohort_size')} AS retention_rate,
       {half_up(units('spend'), 'seen', 0)} / 10000.0 AS revenue_per_user
FROM sized"""


def _trailing(spend: str) -> str:
    return f"""count(*) AS impressions_last_hour, count(DISTINCT i.user_id) AS unique_users,
       CAST(coalesce(sum(cost), 0) AS DOUBLE) AS {spend},
       coalesce({mean('sum(cost)', 'count(*)')}, 0) AS avg_cpm,
       coalesce({half_up('count(*)', 'count(DISTINCT i.user_id)', 4)}, 0) AS frequency"""


# Journey rows with the sums of their user and campaign beside them.
_JOURNEY = ("""steps AS (
  SELECT i.tenant_id, i.user_id, i.day, ad.campaign_id, c.id AS click, v.id AS sale,
         v.conversion_value AS worth,
         (i.timestamp, i.id, coalesce(c.id, -1), coalesce(v.id, -1)) AS place
  FROM impression i LEFT JOIN ad ON ad.id = i.ad_id
  LEFT JOIN click c ON c.impression_id = i.id LEFT JOIN conversion v ON v.click_id = c.id)""",
            """placed AS (
  SELECT *, place = min(place) OVER (PARTITION BY tenant_id, user_id) AS opens FROM steps)""",
            """weighted AS (
  SELECT *, max(day) OVER pair - min(day) OVER pair AS days, count(*) OVER pair AS pair_rows,
         count(click) OVER pair AS pair_clicks, count(sale) OVER pair AS pair_sales,
         sum(worth) OVER pair AS pair_worth,
         if(max(day) OVER pair = min(day) OVER pair, 1.0,
            if(opens OR sale IS NOT NULL, 0.4, 0.2)) AS weight
  FROM placed WHERE campaign_id IS NOT NULL
  WINDOW pair AS (PARTITION BY tenant_id, user_id, campaign_id))""")


def _attribution(revenue: str, shown: str, clicked: str, converted: str) -> str:
    return _with(*E_ALL, CLICK, CONVERSION, *_JOURNEY, f"""totals AS (
  SELECT tenant_id, campaign_id, count(DISTINCT user_id) AS attributed_users,
         CAST(sum({revenue}) AS DOUBLE) AS attributed_revenue,
         {half_up('sum(days)', 'count(*)', 4)} AS avg_journey_days,
         CAST({shown} AS DOUBLE) AS total_impressions, CAST({clicked} AS DOUBLE) AS total_clicks,
         CAST({converted} AS DOUBLE) AS total_conversions
  FROM weighted GROUP BY ALL)""") + """
SELECT *, total_conversions / total_impressions * 100 AS conversion_rate FROM totals"""


def _replay(conversions: str, kinds: str) -> str:
    return _with(EVENT, LOG) + f"""
SELECT tenant_id, campaign_id, day AS date,
       count(*) FILTER (event_type = 'impression_created') AS impressions,
       count(*) FILTER (event_type = 'click_registered') AS clicks,
       CAST({conversions} AS BIGINT) AS conversions,
       CAST(coalesce(sum(cost) FILTER (event_type = 'impression_created'), 0) AS DOUBLE) AS spend,
       count(DISTINCT user_id) FILTER (user_id <> 0
         AND event_type IN ('impression_created', 'click_registered')) AS unique_users
FROM log WHERE event_type IN ({kinds}) GROUP BY ALL"""


_TWO = "'impression_created', 'click_registered'"
_THREE = _TWO + ", 'conversion_tracked'"
_STORED = """stored AS (
  SELECT CAST(1 + (l_partkey % 20) % 3 AS BIGINT) AS tenant_id, l_partkey % 20 AS campaign_id,
         CAST(l_shipdate AS DATE) AS date, CAST(1 AS BIGINT) AS impressions,
         count(*) FILTER (l_returnflag = 'R') AS clicks,
         count(*) FILTER (l_returnflag = 'A') AS conversions, CAST(1 AS DOUBLE) AS spend
  FROM lineitem GROUP BY ALL)"""
_GAPS = """looked AS (
  SELECT *, lag(sequence_number, 1, 0) OVER (
    PARTITION BY tenant_id, aggregate_id ORDER BY sequence_number, id) + 1 AS expected FROM log)"""
_ORDERS = """rows AS (
  SELECT o_orderkey AS id, o_custkey, o_totalprice, CAST(o_orderdate AS DATE) AS start_date,
         CASE o_orderstatus WHEN 'F' THEN 'active' WHEN 'O' THEN 'paused' ELSE 'stopped' END
           AS status,
         CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'draft' WHEN '2' THEN 'active'
              WHEN '3' THEN 'paused' WHEN '4' THEN 'stopped' ELSE 'completed' END AS before
  FROM orders)"""


def _stream(limit: int) -> str:
    return _with(EVENT, LOG) + f"""
SELECT tenant_id, aggregate_id, id AS event_id, event_type, timestamp,
       '{{"user_id":' || user_id || ',"cost":"' || cost || '"}}' AS payload, sequence_number
FROM log QUALIFY row_number() OVER (
  PARTITION BY tenant_id, aggregate_id ORDER BY timestamp DESC, id DESC) <= {limit}"""


def _warehouse_rows() -> str:
    return """SELECT i.tenant_id, ad.campaign_id, ad_id, user_id, CAST(cost AS DOUBLE) AS cost,
       timestamp, 'US' AS country, 'desktop' AS device_type
FROM impression i JOIN ad ON i.ad_id = ad.id"""


_DAYS = """days AS (
  SELECT c.tenant_id, c.id AS campaign_id, c.name AS campaign_name, i.day AS date,
         count(*) AS impressions, sum(cost) AS total, count(DISTINCT user_id) AS unique_users
  FROM campaign c JOIN ad ON ad.campaign_id = c.id JOIN impression i ON i.ad_id = ad.id
  GROUP BY ALL)"""

_LIVE = """live AS (
  SELECT id AS event_id,
         CASE event_type WHEN 'view' THEN 'impression_created' ELSE 'click_registered' END
           AS event_type,
         tenant_id, campaign_id, ad_id, user_id,
         CASE WHEN event_type = 'view' THEN CAST(value AS DECIMAL(10,4)) END AS cost, timestamp
  FROM ev WHERE event_type IN ('view', 'click'))"""

# The parts of tenant 1's pages over the event tables.
_COHORT_PART = f"""
SELECT '{{name}}' AS part, cohort_month AS day, period_days AS item, CAST(users AS DOUBLE) AS a,
       CAST(total_impressions AS DOUBLE) AS b, CAST(retention_rate AS DOUBLE) AS c
FROM ({_cohort(EVENT, IMPRESSION)}) WHERE tenant_id = 1 {{cut}}"""
_TOP_PART = _with(*E_ALL) + f"""
SELECT 'top_campaigns' AS part, CAST(NULL AS DATE) AS day, c.id AS item,
       CAST(count(*) AS DOUBLE) AS a, CAST(sum(cost) AS DOUBLE) AS b,
       {half_up(units('sum(cost)'), 'count(*)', 0)} / 10000.0 AS c
FROM campaign c JOIN ad ON ad.campaign_id = c.id
JOIN impression i ON i.ad_id = ad.id WHERE c.tenant_id = 1
GROUP BY c.id ORDER BY count(*) DESC, c.id LIMIT {{limit}}"""
_TOTAL_PART = _with(EVENT, IMPRESSION, LOG) + """
SELECT 'totals' AS part, CAST(NULL AS DATE) AS day, CAST(NULL AS BIGINT) AS item,
       CAST(count(*) AS DOUBLE) AS a,
       CAST(count(*) FILTER (event_type = 'impression_created') AS DOUBLE) AS b,
       CAST((SELECT count(*) FROM impression WHERE tenant_id = 1) AS DOUBLE) AS c
FROM log WHERE tenant_id = 1"""
_LIVE_PART = _with(*E_ALL) + f"""
SELECT 'realtime_metrics' AS part, CAST(NULL AS DATE) AS day, CAST(NULL AS BIGINT) AS item,
       CAST(count(*) AS DOUBLE) AS a, CAST(coalesce(sum(cost), 0) AS DOUBLE) AS b,
       CAST(coalesce({half_up('count(*)', 'count(DISTINCT user_id)', 4)}, 0) AS DOUBLE) AS c
FROM impression WHERE tenant_id = 1 AND ad_id IN (SELECT id FROM ad)
  AND timestamp >= {NOON} - INTERVAL 1 HOUR AND timestamp <= {NOON}"""
_DAY_PART = _with(*E_ALL) + """
SELECT 'performance_metrics' AS part, i.day, c.id AS item, CAST(count(*) AS DOUBLE) AS a,
       CAST(sum(cost) AS DOUBLE) AS b, CAST(count(DISTINCT user_id) AS DOUBLE) AS c
FROM campaign c JOIN ad ON ad.campaign_id = c.id JOIN impression i ON i.ad_id = ad.id
WHERE c.tenant_id = 1 GROUP BY c.id, i.day ORDER BY c.id, i.day DESC LIMIT 5"""
_FIRST_TEN = "ORDER BY cohort_month, period_days LIMIT 10"


def _pages(*parts: str) -> str:
    return " UNION ALL ".join(f"SELECT * FROM ({part})" for part in parts)


ORACLES: dict[str, str] = {
    "cohort_retention": _cohort(EVENT, IMPRESSION),
    "cohort_retention_volume": _cohort(VOLUME),
    "advanced_cohort": _advanced(NOON, 20, EVENT, IMPRESSION),
    "advanced_cohort_non_negative": _advanced(
        NOON, 20, EVENT, IMPRESSION, extra="AND day >= cohort_month"),
    "advanced_cohort_volume": _advanced(LATER, 1500, VOLUME),
    "warehouse_cohort": _advanced(NOON, 30, EVENT, IMPRESSION),
    "campaign_daily_performance": _with(*V_ALL, _DAYS, """ranked AS (
  SELECT *, row_number() OVER (PARTITION BY tenant_id, campaign_id
              ORDER BY impressions DESC, date) AS daily_rank,
         lag(impressions) OVER (PARTITION BY tenant_id, campaign_id ORDER BY date)
           AS prev_day_impressions FROM days)""") + f"""
SELECT tenant_id, campaign_id, campaign_name, date, impressions, CAST(total AS DOUBLE) AS total_cost,
       {mean('total', 'impressions')} AS avg_cost, unique_users, daily_rank, prev_day_impressions,
       {pct('impressions - prev_day_impressions', 'prev_day_impressions')} AS growth_rate
FROM ranked""",
    "top_campaigns": _with(*V_ALL, """totals AS (
  SELECT c.tenant_id, c.id, c.name, count(*) AS total_impressions, sum(cost) AS total,
         count(DISTINCT user_id) AS unique_users
  FROM campaign c JOIN ad ON ad.campaign_id = c.id JOIN impression i ON i.ad_id = ad.id
  GROUP BY ALL)""", f"""priced AS (
  SELECT *, {half_up(units('total'), 'total_impressions', 0)} / 10000.0 AS avg_cpm
  FROM totals)""") + """
SELECT tenant_id, id, name, total_impressions, CAST(total AS DOUBLE) AS total_spend, unique_users,
       avg_cpm, rank() OVER (PARTITION BY tenant_id ORDER BY total_impressions DESC)
         AS impression_rank,
       rank() OVER (PARTITION BY tenant_id ORDER BY avg_cpm NULLS FIRST) AS efficiency_rank
FROM priced
QUALIFY row_number() OVER (PARTITION BY tenant_id ORDER BY total_impressions DESC, id) <= 5""",
    "campaign_ranking": _with(*V_ALL, f"""totals AS (
  SELECT c.tenant_id, c.id AS campaign_id, c.name AS campaign_name, c.budget,
         count(*) AS total_impressions, count(DISTINCT i.user_id) AS unique_users,
         sum(i.cost) AS total, date_diff('day', c.start_date, CAST({LATER} AS DATE)) AS days_running
  FROM impression i JOIN ad ON ad.id = i.ad_id
  JOIN campaign c ON c.id = ad.campaign_id AND c.tenant_id = i.tenant_id
  WHERE c.status = 'active' GROUP BY ALL)""", f"""priced AS (
  SELECT *, {mean('total', 'total_impressions')} AS avg_cpm FROM totals)""", """ranked AS (
  SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY total_impressions DESC, campaign_id)
           AS impression_rank,
         row_number() OVER (PARTITION BY tenant_id ORDER BY avg_cpm, campaign_id)
           AS efficiency_rank,
         row_number() OVER (PARTITION BY tenant_id ORDER BY unique_users DESC, campaign_id)
           AS reach_rank FROM priced)""", f"""scored AS (
  SELECT *, {half_up('(impression_rank + efficiency_rank + reach_rank)', '3', 1)} AS overall_score
  FROM ranked)""") + f"""
SELECT tenant_id, campaign_id, campaign_name, CAST(budget AS DOUBLE) AS budget, total_impressions,
       unique_users, CAST(total AS DOUBLE) AS total_spend, avg_cpm,
       {half_up('total_impressions', 'unique_users', 4)} AS frequency, days_running,
       {half_up(units('total'), 'CAST(budget * 100 AS HUGEINT)', 2)} AS budget_utilization,
       {half_up('total_impressions', 'days_running', 0)} AS daily_impression_rate,
       impression_rank, efficiency_rank, reach_rank, overall_score
FROM scored
QUALIFY row_number() OVER (PARTITION BY tenant_id ORDER BY overall_score, campaign_id) <= 20""",
    "hourly_trend": _with(*E_ALL, f"""hours AS (
  SELECT i.tenant_id, ad.campaign_id, strftime(i.timestamp, '%Y-%m-%d %H:00:00') AS hour_bucket,
         count(*) AS impressions, count(DISTINCT user_id) AS unique_users, sum(cost) AS total
  FROM impression i JOIN ad ON i.ad_id = ad.id
  WHERE i.timestamp >= {NOON} - INTERVAL 240 HOUR AND i.timestamp <= {NOON} GROUP BY ALL)""",
                          """listed AS (
  SELECT *, lag(impressions) OVER (PARTITION BY tenant_id, campaign_id ORDER BY hour_bucket)
    AS prev_hour_impressions FROM hours)""") + f"""
SELECT tenant_id, campaign_id, hour_bucket, impressions, unique_users, CAST(total AS DOUBLE) AS spend,
       {mean('total', 'impressions')} AS avg_cost, prev_hour_impressions,
       CASE WHEN prev_hour_impressions IS NULL THEN 0 ELSE
       {pct('impressions - prev_hour_impressions', 'prev_hour_impressions')} END AS growth_rate
FROM listed""",
    "warehouse_daily_performance": _with(*E_ALL, f"""days AS (
  SELECT i.tenant_id, ad.campaign_id, i.day AS date, count(*) AS impressions,
         count(DISTINCT user_id) AS unique_users, sum(cost) AS total
  FROM impression i JOIN ad ON i.ad_id = ad.id
  WHERE i.timestamp >= {NOON} - INTERVAL 30 DAY AND i.timestamp <= {NOON} GROUP BY ALL)""",
                                         """listed AS (
  SELECT *, lag(impressions) OVER (PARTITION BY tenant_id, campaign_id ORDER BY date)
    AS prev_day_impressions FROM days)""") + f"""
SELECT tenant_id, campaign_id, date, impressions, unique_users, CAST(total AS DOUBLE) AS total_cost,
       {mean('total', 'impressions')} AS avg_cost, prev_day_impressions,
       CASE WHEN prev_day_impressions IS NULL THEN 0 ELSE
       {pct('impressions - prev_day_impressions', 'prev_day_impressions')} END AS growth_rate
FROM listed""",
    "campaign_report": _with(AD, VOLUME, """days AS (
  SELECT i.tenant_id, ad.campaign_id, i.day AS date, count(*) AS impressions, sum(cost) AS total,
         count(DISTINCT user_id) AS unique_users
  FROM impression i JOIN ad ON i.ad_id = ad.id GROUP BY ALL)""") + f"""
SELECT tenant_id, campaign_id, date, impressions, CAST(total AS DOUBLE) AS spend, unique_users,
       {mean('total', 'impressions')} AS avg_cpm FROM days
QUALIFY row_number() OVER (PARTITION BY tenant_id, campaign_id ORDER BY date DESC) <= 30""",
    "daily_aggregate": _with(AD, VOLUME) + """
SELECT i.tenant_id, ad.campaign_id, i.day AS date, count(*) AS impressions,
       CAST(sum(cost) AS DOUBLE) AS total_cost
FROM impression i JOIN ad ON i.ad_id = ad.id GROUP BY ALL""",
    "attribution": _attribution("pair_worth * weight", "sum(pair_rows)", "sum(pair_clicks)",
                                "sum(pair_sales)"),
    "attribution_per_touch": _attribution("worth * weight", "count(*)", "count(click)",
                                          "count(sale)"),
    "realtime_metrics": _with(*E_ALL, TENANTS) + f"""
SELECT CAST(t.tenant_id AS BIGINT) AS tenant_id,
       {_trailing('spend_last_hour').replace('count(*)', 'count(i.id)')}
FROM tenants t LEFT JOIN (SELECT impression.* FROM impression JOIN ad ON ad_id = ad.id) i
  ON i.tenant_id = t.tenant_id AND i.timestamp >= {NOON} - INTERVAL 24 HOUR
 AND i.timestamp <= {NOON} GROUP BY ALL""",
    "campaign_live_metrics": _with(*E_ALL) + f"""
SELECT c.tenant_id, c.id AS campaign_id, count(i.id) AS impressions_last_hour,
       count(DISTINCT i.user_id) AS unique_users,
       CAST(coalesce(sum(cost), 0) AS DOUBLE) AS total_spend,
       coalesce({mean('sum(cost)', 'count(i.id)')}, 0) AS avg_cpm,
       coalesce({half_up('count(i.id)', 'count(DISTINCT i.user_id)', 4)}, 0) AS frequency,
       CASE WHEN count(i.id) > 0 THEN 'active' ELSE 'idle' END AS status
FROM campaign c LEFT JOIN ad ON ad.campaign_id = c.id
LEFT JOIN impression i ON i.ad_id = ad.id AND i.timestamp >= {NOON} - INTERVAL 24 HOUR
  AND i.timestamp <= {NOON} GROUP BY ALL""",
    "active_campaign_count": _with(CAMPAIGN, TENANTS) + """
SELECT CAST(t.tenant_id AS BIGINT) AS tenant_id,
       (SELECT count(*) FROM campaign c WHERE c.tenant_id = t.tenant_id AND status = 'active')
         AS active_campaigns FROM tenants t""",
    "impressions_on_day": _with(VOLUME, TENANTS) + """
SELECT CAST(t.tenant_id AS BIGINT) AS tenant_id, count(i.ad_id) AS impressions
FROM tenants t LEFT JOIN impression i ON i.tenant_id = t.tenant_id AND day = DATE '2000-04-04'
GROUP BY ALL""",
    "unique_users_on_day": _with(EVENT, IMPRESSION, TENANTS) + """
SELECT CAST(t.tenant_id AS BIGINT) AS tenant_id, count(DISTINCT user_id) AS unique_users
FROM tenants t LEFT JOIN impression i ON i.tenant_id = t.tenant_id AND day = DATE '2024-01-20'
GROUP BY ALL""",
    "spend_last_hour": _with(EVENT, IMPRESSION, TENANTS) + f"""
SELECT CAST(t.tenant_id AS BIGINT) AS tenant_id, CAST(coalesce(sum(cost), 0) AS DOUBLE) AS spend
FROM tenants t LEFT JOIN impression i ON i.tenant_id = t.tenant_id
  AND timestamp >= {NOON} - INTERVAL 24 HOUR AND timestamp <= {NOON} GROUP BY ALL""",
    "top_campaign_on_day": _with(*E_ALL, """totals AS (
  SELECT c.tenant_id, c.id, c.name, count(i.id) AS impressions
  FROM campaign c LEFT JOIN ad ON ad.campaign_id = c.id
  LEFT JOIN impression i ON i.ad_id = ad.id AND i.tenant_id = c.tenant_id
    AND i.day = DATE '2024-01-20' GROUP BY ALL)""") + """
SELECT *, rank() OVER (PARTITION BY tenant_id ORDER BY impressions DESC) AS impression_rank
FROM totals QUALIFY row_number() OVER (PARTITION BY tenant_id ORDER BY impressions DESC, id) = 1""",
    "dashboard_totals": _with(*E_ALL, TENANTS) + """
SELECT CAST(t.tenant_id AS BIGINT) AS tenant_id, count(DISTINCT c.id) AS active_campaigns, count(i.id) AS impressions_today,
       CAST(coalesce(sum(i.cost), 0) AS DOUBLE) AS spend_today,
       count(DISTINCT i.user_id) AS unique_users_today
FROM tenants t LEFT JOIN campaign c ON c.tenant_id = t.tenant_id AND c.status = 'active'
LEFT JOIN ad ON ad.campaign_id = c.id AND ad.tenant_id = c.tenant_id
LEFT JOIN impression i ON i.ad_id = ad.id AND i.tenant_id = c.tenant_id
  AND i.day = DATE '2024-01-20'
GROUP BY ALL""",
    "bid_price": _with(*E_ALL, TENANTS, f"""recent AS (
  SELECT t.tenant_id, count(i.id) AS volume,
         coalesce(nullif({half_up("(10000 * " + units('sum(cost)') + ")", 'count(i.id)', 0)}, 0),
                  50000000) AS mean8
  FROM tenants t LEFT JOIN impression i
    ON i.tenant_id = t.tenant_id AND i.timestamp >= {NOON} - INTERVAL 24 HOUR
   AND i.timestamp <= {NOON} GROUP BY ALL)""", """priced AS (
  SELECT *, CAST(mean8 AS HUGEINT) * CASE WHEN volume > 100 THEN 11 ELSE 9 END AS p9
  FROM recent)""") + f"""
SELECT CAST(tenant_id AS BIGINT) AS tenant_id, {half_up('p9', '100000', 0)} / 10000.0 AS bid_price,
       CASE WHEN volume > 50 THEN 'high' ELSE 'medium' END AS confidence FROM priced""",
    "dashboard_bundle": _with(EVENT, IMPRESSION, LOG) + """
SELECT tenant_id, coalesce(total_events, 0) AS total_events,
       coalesce(total_impression_events, 0) AS total_impression_events,
       coalesce(total_impressions, 0) AS total_impressions
FROM (SELECT tenant_id, count(*) AS total_events,
             count(*) FILTER (event_type = 'impression_created') AS total_impression_events
      FROM log GROUP BY ALL)
FULL JOIN (SELECT tenant_id, count(*) AS total_impressions FROM impression GROUP BY ALL)
  USING (tenant_id)""",
    "unique_users_sketched": _with(EVENT, IMPRESSION) + """
SELECT tenant_id, count(*) AS impressions, count(DISTINCT user_id) AS exact_users,
       TRUE AS within_bound
FROM impression GROUP BY ALL""",
    "dashboard_realtime": _pages(
        _COHORT_PART.format(name="cohort_data", cut=_FIRST_TEN), _TOP_PART.format(limit=5),
        _TOTAL_PART, _LIVE_PART),
    "dashboard_overview": _pages(
        _COHORT_PART.format(name="cohort_data", cut=""), _TOP_PART.format(limit=5), _TOTAL_PART),
    "dashboard_analysis": _pages(
        _COHORT_PART.format(name="cohort_analysis", cut=""), _DAY_PART,
        _TOP_PART.format(limit=10)),
    "query_log_stats": f"""
SELECT count(*) AS total_queries,
       {half_up('CAST(sum(CAST(value AS DECIMAL(12,2))) * 10000 AS HUGEINT) * 100', 'count(*)', 0)}
         / 1000000.0 AS avg_query_time,
       max(value) AS max_query_time, count(*) FILTER (value > 1) AS slow_queries FROM events""",
    "distinct_campaign_count": _with(*V_ALL) + """
SELECT c.tenant_id, count(DISTINCT c.id) AS campaigns
FROM campaign c LEFT JOIN ad ON c.id = ad.campaign_id LEFT JOIN impression i ON ad.id = i.ad_id
GROUP BY ALL""",
    "ads_with_campaign": _with(AD, CAMPAIGN) + """
SELECT ad.campaign_id, ad.id, ad.tenant_id, creative_url, target_audience, c.name AS campaign_name,
       CAST(c.budget AS DOUBLE) AS campaign_budget, c.status AS campaign_status,
       c.start_date AS campaign_start_date, c.end_date AS campaign_end_date
FROM ad JOIN campaign c ON ad.campaign_id = c.id""",
    "tenant_table": _with(CAMPAIGN) + """
SELECT id, tenant_id, name, CAST(budget AS DOUBLE) AS budget, status, start_date, end_date
FROM campaign WHERE tenant_id = 2""",
    "date_range_filter": _with(EVENT, IMPRESSION) + f"""
SELECT id, tenant_id, ad_id, user_id, timestamp, CAST(cost AS DOUBLE) AS cost FROM impression
WHERE tenant_id = 1 AND timestamp BETWEEN TIMESTAMP '2024-01-10 12:00:00' AND {NOON}""",
    "tenant_stats": _with(*V_ALL) + """
SELECT c.tenant_id, any_value(i.n) AS total_impressions, count(*) AS total_campaigns,
       any_value(a.n) AS total_ads
FROM campaign c
JOIN (SELECT tenant_id, count(*) AS n FROM impression GROUP BY ALL) i ON i.tenant_id = c.tenant_id
JOIN (SELECT tenant_id, count(*) AS n FROM ad GROUP BY ALL) a ON a.tenant_id = c.tenant_id
GROUP BY c.tenant_id""",
    "permission_check": """
SELECT CAST(1 AS BIGINT) AS tenant_id, l_partkey AS user_id, l_returnflag AS resource,
       l_linestatus AS action, l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber
FROM lineitem i WHERE EXISTS (SELECT 1 FROM lineitem g WHERE g.l_suppkey = i.l_partkey
  AND g.l_returnflag = i.l_returnflag AND g.l_linestatus = i.l_linestatus)""",
    "tenant_admins": """
SELECT c_custkey AS id, CAST(c_nationkey AS BIGINT) AS tenant_id,
       CASE c_mktsegment WHEN 'MACHINERY' THEN 'admin' ELSE 'super_admin' END AS role
FROM customer WHERE c_mktsegment IN ('MACHINERY', 'HOUSEHOLD')""",
    "creative_urls": _with(AD) + """
SELECT ad.*, 'https://cdn.example.com/tenant_' || tenant_id || '/creative_' || id AS cdn_url
FROM ad""",
    "sync_status": _with(*E_ALL, TENANTS) + """
SELECT CAST(t.tenant_id AS BIGINT) AS tenant_id, count(i.id) AS total_rows,
       count(DISTINCT i.campaign) AS campaigns,
       max(timestamp) AS latest_timestamp, min(timestamp) AS earliest_timestamp,
       CASE WHEN count(i.id) > 0 THEN 'connected' ELSE 'no_data' END AS status
FROM tenants t LEFT JOIN (SELECT impression.*, ad.campaign_id AS campaign
                          FROM impression JOIN ad ON ad_id = ad.id) i
  ON i.tenant_id = t.tenant_id GROUP BY ALL""",
    "sync_stored": _with(*E_ALL) + _warehouse_rows() + " WHERE i.tenant_id = 1",
    "sync_published": _with(*E_ALL) + _warehouse_rows(),
    "sync_impressions": _with(*E_ALL) + _warehouse_rows() + """
WHERE timestamp >= TIMESTAMP '2024-01-05 12:00:00'
  AND (timestamp > TIMESTAMP '2024-01-05 12:00:00' OR i.id > 0)""",
    "daily_metrics_upsert": _with(*V_ALL, _STORED, """fresh AS (
  SELECT c.tenant_id, c.id AS campaign_id, DATE '2000-04-04' AS date, count(i.ad_id) AS impressions,
         coalesce(sum(i.cost), 0) AS spend
  FROM campaign c LEFT JOIN ad ON ad.campaign_id = c.id AND ad.tenant_id = c.tenant_id
  LEFT JOIN impression i ON i.ad_id = ad.id AND i.tenant_id = c.tenant_id
    AND i.day = DATE '2000-04-04' GROUP BY ALL)""") + """
SELECT tenant_id, campaign_id, date, coalesce(f.impressions, s.impressions) AS impressions,
       coalesce(s.clicks, 0) AS clicks, coalesce(s.conversions, 0) AS conversions,
       coalesce(CAST(f.spend AS DOUBLE), s.spend) AS spend
FROM stored s FULL JOIN fresh f USING (tenant_id, campaign_id, date)""",
    "event_replay": _replay("0", _TWO),
    "event_replay_with_conversions": _replay(
        "count(*) FILTER (event_type = 'conversion_tracked')", _THREE),
    "event_totals": _with(EVENT, LOG) + f"""
SELECT tenant_id, campaign_id, count(*) AS replayed_events,
       count(*) FILTER (event_type = 'impression_created') AS total_impressions,
       count(*) FILTER (event_type = 'click_registered') AS total_clicks,
       count(*) FILTER (event_type = 'conversion_tracked') AS total_conversions,
       CAST(coalesce(sum(cost) FILTER (event_type = 'impression_created'), 0) AS DOUBLE)
         AS total_spend,
       count(DISTINCT user_id) FILTER (user_id <> 0 AND event_type IN ({_THREE})) AS unique_users
FROM log GROUP BY ALL""",
    "append_events": _with(EVENT, LOG) + """
SELECT id, tenant_id, aggregate_id, event_type, timestamp,
       row_number() OVER (PARTITION BY tenant_id, aggregate_id
         ORDER BY timestamp, id) AS sequence_number
FROM log""",
    "log_from_facts": _with(EVENT, IMPRESSION, CLICK, CONVERSION, """linked AS (
  SELECT tenant_id, 'impression_created' AS event_type, campaign_id, timestamp, id AS source_id,
         '{"impression_id":' || id || ',"ad_id":' || ad_id || ',"user_id":' || user_id
           || ',"cost":"' || cost || '"}' AS payload FROM impression
  UNION ALL
  SELECT c.tenant_id, 'click_registered', i.campaign_id, c.timestamp, c.id,
         '{"click_id":' || c.id || ',"impression_id":' || i.id || '}'
  FROM click c JOIN impression i ON c.impression_id = i.id
  UNION ALL
  SELECT v.tenant_id, 'conversion_tracked', i.campaign_id, v.timestamp, v.id,
         '{"conversion_id":' || v.id || ',"click_id":' || c.id || ',"value":"'
           || v.conversion_value || '"}'
  FROM conversion v JOIN click c ON v.click_id = c.id JOIN impression i ON c.impression_id = i.id)""") + """
SELECT tenant_id, event_type, CAST(campaign_id AS VARCHAR) AS aggregate_id, payload, timestamp,
       source_id, row_number() OVER (PARTITION BY tenant_id, campaign_id
         ORDER BY timestamp, event_type, source_id) AS sequence_number FROM linked""",
    "event_replay_stored": _with(EVENT, LOG, _STORED, "replayed AS (" + _replay("0", _TWO).split(
        LOG, 1)[1].strip() + ")") + """
SELECT tenant_id, campaign_id, date, impressions, clicks, conversions, spend
FROM stored s WHERE NOT EXISTS (SELECT 1 FROM replayed r
  WHERE r.tenant_id = s.tenant_id AND r.campaign_id = s.campaign_id)
UNION ALL BY NAME SELECT * FROM replayed""",
    "append_events_reserved": _with(EVENT, LOG) + """
SELECT id, tenant_id, aggregate_id, event_type, timestamp,
       row_number() OVER (PARTITION BY tenant_id, aggregate_id
         ORDER BY id % 2 DESC, timestamp, id) AS sequence_number
FROM log""",
    "event_stream": _stream(20),
    "event_stream_sliced": _stream(40),
    "audit_trail": _stream(100),
    "validate_sequence": _with(EVENT, LOG, _GAPS) + """
SELECT tenant_id, aggregate_id, expected, sequence_number AS found, id AS event_id
FROM looked WHERE sequence_number <> expected""",
    "validate_sequence_summary": _with(EVENT, LOG, _GAPS) + """
SELECT tenant_id, aggregate_id, count(*) FILTER (sequence_number <> expected) = 0 AS valid,
       count(*) FILTER (sequence_number <> expected) AS gaps, count(*) AS total_events,
       max(sequence_number) AS last_sequence FROM looked GROUP BY ALL""",
    "event_stats": _with(EVENT, LOG) + f"""
SELECT tenant_id, count(*) AS total_events,
       count(*) FILTER (timestamp >= {NOON} - INTERVAL 1 HOUR AND timestamp <= {NOON})
         AS events_last_hour,
       count(*) FILTER (event_type = 'impression_created') AS impression_created,
       count(*) FILTER (event_type = 'click_registered') AS click_registered,
       count(*) FILTER (event_type = 'conversion_tracked') AS conversion_tracked
FROM log GROUP BY ALL""",
    "event_batch_counts": _with(EVENT, LOG) + """
SELECT (SELECT count(*) FROM events) AS events_processed, count(*) AS matched,
       count(*) FILTER (event_type = 'impression_created') AS impressions,
       count(*) FILTER (event_type = 'click_registered') AS clicks,
       count(*) FILTER (event_type = 'conversion_tracked') AS conversions
FROM log WHERE id IN (SELECT event_id FROM events)""",
    "retention_split": _with(EVENT, LOG) + f"""
SELECT tenant_id, count(*) FILTER (timestamp >= {NOON} - INTERVAL 10 DAY) AS kept_events,
       count(*) FILTER (timestamp < {NOON} - INTERVAL 10 DAY) AS deleted_events
FROM log GROUP BY ALL""",
    "retained_events": _with(EVENT, LOG) + f"""
SELECT id, tenant_id, aggregate_id, event_type, timestamp FROM log
WHERE timestamp >= {NOON} - INTERVAL 10 DAY""",
    "v_unique_name": """
SELECT p_partkey AS id, CASE WHEN count(*) OVER (PARTITION BY p_brand, p_name) > 1
  THEN 'A campaign with name ''' || p_name || ''' already exists for this tenant.' ELSE '' END
  AS errors FROM part""",
    "v_budget_cap": """
WITH checked AS (
  SELECT l_suppkey AS advertiser_id, CASE WHEN CAST(l_extendedprice AS DECIMAL(12,2))
           > 5 * CAST(s_acctbal AS DECIMAL(12,2))
    THEN 'Campaign budget cannot exceed advertiser monthly budget: $'
      || CAST(5 * CAST(s_acctbal AS DECIMAL(12,2)) AS DECIMAL(14,2)) ELSE '' END AS errors
  FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey)
SELECT advertiser_id, errors, count(*) AS rows FROM checked GROUP BY ALL""",
    "v_date_order": """
SELECT CAST(o_orderdate AS DATE) AS start_date,
       CASE WHEN CAST(o_orderdate AS DATE) >= CAST(l_shipdate AS DATE)
            THEN 'start_date must be before end_date' ELSE '' END AS errors, count(*) AS rows
FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL""",
    "v_status_transition": _with(_ORDERS) + """
SELECT status, CASE WHEN before = status OR (before, status) IN (('draft', 'active'),
         ('active', 'paused'), ('active', 'stopped'), ('paused', 'active'), ('paused', 'stopped'))
       THEN '' ELSE 'Cannot transition from ' || before || ' to ' || status END AS errors,
       count(*) AS rows FROM rows GROUP BY ALL""",
    "v_required_fields": _with(EVENT, IMPRESSION) + """
SELECT id, CASE WHEN campaign_id = 0 OR ad_id = 0 OR user_id = 0
  THEN 'Missing required fields: campaign_id, ad_id, user_id' ELSE '' END AS errors
FROM impression""",
    "v_required_fields_click": _with(EVENT) + """
SELECT id, CASE WHEN campaign_id = 0 OR ad_id = 0 OR user_id = 0
  THEN 'Missing required fields: campaign_id, ad_id, user_id' ELSE '' END AS errors
FROM ev WHERE event_type = 'click'""",
    "v_required_fields_conversion": _with(EVENT) + """
SELECT id, CASE WHEN campaign_id = 0 OR user_id = 0
  THEN 'Missing required fields: campaign_id, user_id' ELSE '' END AS errors
FROM ev WHERE event_type = 'purchase'""",
    "v_schema": _with(_ORDERS) + """
SELECT concat_ws('; ',
         CASE WHEN o_custkey % 120 > 100 THEN 'name is longer than 100 characters' END,
         CASE WHEN o_custkey % 3 <> 0 THEN 'budget is not a number with 10 digits and 2 decimals' END,
         CASE WHEN status = 'stopped' THEN 'status is not a valid choice' END) AS errors,
       count(*) AS rows
FROM rows GROUP BY ALL""",
    "stream_publish": _with(EVENT, _LIVE) + """
SELECT CASE event_type WHEN 'impression_created' THEN 'impressions' ELSE 'clicks' END
         || '-tenant-' || tenant_id AS topic,
       '{"event_id":' || event_id || ',"event_type":"' || event_type || '","tenant_id":'
         || tenant_id || ',"campaign_id":' || campaign_id || ',"ad_id":' || ad_id
         || ',"user_id":' || user_id || coalesce(',"cost":"' || cost || '"', '')
         || ',"timestamp":"' || strftime(timestamp, '%Y-%m-%d %H:%M:%S.%f') || '"}' AS value
FROM live""",
    "stream_ingest_events": _with(EVENT, _LIVE) + """
SELECT event_id, event_type, tenant_id, campaign_id, user_id, CAST(cost AS DOUBLE) AS cost, timestamp
FROM live""",
    "stream_dedup_events": _with(EVENT, _LIVE) + """
SELECT * REPLACE (CAST(cost AS DOUBLE) AS cost) FROM live""",
    "stream_running_counts": _with(EVENT, _LIVE) + """
SELECT tenant_id, campaign_id, count(*) FILTER (event_type = 'impression_created') AS impressions,
       count(*) FILTER (event_type = 'click_registered') AS clicks,
       CAST(coalesce(sum(cost), 0) AS DOUBLE) AS spend, max(timestamp) AS last_update
FROM live GROUP BY ALL""",
    "stream_live_metrics": _with(EVENT, _LIVE, """panes AS (
  SELECT live.*, time_bucket(INTERVAL 5 MINUTE, timestamp) - to_minutes(CAST(5 * n AS INTEGER))
    AS window_start
  FROM live, range(12) r(n) WHERE event_type = 'impression_created')""", """totals AS (
  SELECT window_start, window_start + INTERVAL 1 HOUR AS window_end, tenant_id, campaign_id,
         count(*) AS n, count(DISTINCT user_id) AS unique_users, sum(cost) AS total
  FROM panes GROUP BY ALL)""") + f"""
SELECT window_start, window_end, tenant_id, campaign_id, n AS impressions_last_hour, unique_users,
       CAST(total AS DOUBLE) AS total_spend, {mean('total', 'n')} AS avg_cpm,
       {half_up('n', 'unique_users', 4)} AS frequency
FROM totals""",
    "stream_dashboard": _with(CAMPAIGN, EVENT, _LIVE, TENANTS, """under AS (
  SELECT CAST(timestamp AS DATE) AS date, live.* FROM live
  JOIN campaign c ON c.id = live.campaign_id AND c.tenant_id = live.tenant_id
  WHERE c.status = 'active' AND event_type = 'impression_created')""") + """
SELECT d.date, CAST(t.tenant_id AS BIGINT) AS tenant_id,
       (SELECT count(*) FROM campaign c WHERE c.tenant_id = t.tenant_id AND c.status = 'active')
         AS active_campaigns,
       count(u.event_id) AS impressions_today, CAST(coalesce(sum(cost), 0) AS DOUBLE) AS spend_today,
       count(DISTINCT user_id) AS unique_users_today
FROM tenants t CROSS JOIN (SELECT DISTINCT date FROM under) d
LEFT JOIN under u ON u.tenant_id = t.tenant_id AND u.date = d.date GROUP BY ALL""",
    "stream_metric_snapshot": _with(EVENT, _LIVE) + """
SELECT tenant_id, campaign_id, count(*) FILTER (event_type = 'impression_created') AS impressions,
       count(*) FILTER (event_type = 'click_registered') AS clicks,
       CAST(CAST(coalesce(sum(cost), 0) AS DECIMAL(12,2)) AS DOUBLE) AS spend
FROM live GROUP BY ALL""",
    "stream_sync": _with(*E_ALL) + _warehouse_rows().replace(
        "\nFROM", ", CAST(timestamp AS DATE) AS date\nFROM"),
}


# The stored table keeps two digits of the spend.
ORACLES["daily_metrics_upsert_stored"] = _with(*E_ALL, LOG, "replayed AS (" + _replay(
    "0", _TWO).split(LOG, 1)[1].strip() + ")", """fresh AS (
  SELECT c.tenant_id, c.id AS campaign_id, DATE '2024-01-20' AS date, count(i.id) AS impressions,
         coalesce(sum(i.cost), 0) AS spend
  FROM campaign c LEFT JOIN ad ON ad.campaign_id = c.id AND ad.tenant_id = c.tenant_id
  LEFT JOIN impression i ON i.ad_id = ad.id AND i.tenant_id = c.tenant_id
    AND i.day = DATE '2024-01-20' GROUP BY ALL)""") + """
SELECT tenant_id, campaign_id, date, coalesce(f.impressions, s.impressions) AS impressions,
       coalesce(s.clicks, 0) AS clicks, coalesce(s.conversions, 0) AS conversions,
       CAST(round(CAST(coalesce(f.spend, s.spend) AS DECIMAL(18,4)), 2) AS DOUBLE) AS spend
FROM replayed s FULL JOIN fresh f USING (tenant_id, campaign_id, date)"""
# A published table keeps money in two digits. Campaigns from 20 on are not in the log.
ORACLES["event_replay_published"] = _with(EVENT, LOG, "replayed AS (" + _replay("0", _TWO).split(
    LOG, 1)[1].strip() + ")") + """
SELECT tenant_id, campaign_id + 20 AS campaign_id, day AS date, count(*) AS impressions,
       count(*) FILTER (event_type = 'error') AS clicks, CAST(0 AS BIGINT) AS conversions,
       CAST(1 AS DOUBLE) AS spend, CAST(NULL AS BIGINT) AS unique_users FROM ev GROUP BY ALL
UNION ALL BY NAME
SELECT * REPLACE (CAST(round(CAST(spend AS DECIMAL(18,4)), 2) AS DOUBLE) AS spend) FROM replayed
UNION ALL BY NAME
SELECT tenant_id, campaign_id, day AS date, count(*) AS impressions,
       count(*) FILTER (event_type = 'error') AS clicks, CAST(0 AS BIGINT) AS conversions,
       CAST(1 AS DOUBLE) AS spend, CAST(NULL AS BIGINT) AS unique_users FROM ev e
WHERE NOT EXISTS (SELECT 1 FROM log l
  WHERE l.tenant_id = e.tenant_id AND l.campaign_id = e.campaign_id) GROUP BY ALL"""
for _name, _same in (("stream_live_metrics_chained", "stream_live_metrics"),
                     ("stream_live_metrics_late", "stream_live_metrics"),
                     ("stream_running_counts_published", "stream_running_counts"),
                     ("stream_dashboard_late", "stream_dashboard"),
                     ("stream_sync_published", "stream_sync")):
    ORACLES[_name] = ORACLES[_same]


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
