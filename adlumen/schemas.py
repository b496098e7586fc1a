"""Explicit schemas of the tables the operators read and write."""

from __future__ import annotations

from pyspark.sql import types as T

BIG, INT, STR = T.LongType(), T.IntegerType(), T.StringType()
DAY, TIME, BOOL = T.DateType(), T.TimestampType(), T.BooleanType()
UNIT_COST, PRICE, MONEY = T.DecimalType(10, 4), T.DecimalType(10, 2), T.DecimalType(12, 2)


def _table(**columns: T.DataType) -> T.StructType:
    head = [T.StructField("id", BIG, False), T.StructField("tenant_id", INT, False)]
    return T.StructType(head + [T.StructField(name, kind, True) for name, kind in columns.items()])


# Table and column names, types, choices and rules of the data model.
TABLES: dict[str, T.StructType] = {
    "campaign": _table(
        name=STR, budget=MONEY, status=STR, start_date=DAY, end_date=DAY, advertiser_id=BIG
    ),
    "ad": _table(
        campaign_id=BIG, creative_url=STR, target_audience=STR, creative_id=BIG, audience_id=BIG
    ),
    "impression": _table(ad_id=BIG, user_id=BIG, timestamp=TIME, cost=UNIT_COST),
    "impression_event": _table(
        campaign_id=BIG, ad_id=BIG, user_id=BIG, cost=UNIT_COST, timestamp=TIME
    ),
    "click_event": _table(impression_id=BIG, timestamp=TIME),
    "conversion_event": _table(click_id=BIG, conversion_value=PRICE, timestamp=TIME),
    "ad_event": _table(
        event_type=STR, aggregate_id=STR, payload=STR, timestamp=TIME, sequence_number=BIG
    ),
    "campaign_metrics": _table(
        campaign_id=BIG, date=DAY, impressions=BIG, clicks=BIG, conversions=BIG, spend=MONEY,
        unique_users=BIG,
    ),
    "metric_snapshot": _table(
        campaign_id=BIG, impressions=BIG, clicks=BIG, spend=MONEY, timestamp=TIME
    ),
    "bid_request": _table(
        request_id=STR, user_id=BIG, placement_id=STR, floor_price=UNIT_COST, timestamp=TIME
    ),
    "bid_response": _table(
        bid_request_id=BIG, campaign_id=BIG, bid_price=UNIT_COST, won=BOOL, timestamp=TIME
    ),
    "advertiser": _table(name=STR, email=STR, status=STR, created_at=TIME),
    "advertiser_budget": _table(advertiser_id=BIG, monthly_budget=MONEY, spent=MONEY),
    "audience_segment": _table(name=STR, description=STR, criteria=STR, size=BIG, created_at=TIME),
    "user_segment": _table(user_id=BIG, segment_id=BIG, added_at=TIME),
    "creative": _table(name=STR, asset_url=STR, creative_type=STR, status=STR, created_at=TIME),
    "invoice": _table(
        advertiser_id=BIG, amount=MONEY, period_start=DAY, period_end=DAY, status=STR,
        created_at=TIME,
    ),
    "payment": _table(invoice_id=BIG, amount=MONEY, payment_method=STR, processed_at=TIME),
    "user": _table(role=STR, email=STR),
    "user_permission": _table(user_id=BIG, resource=STR, action=STR),
}

# Warehouse copy: same facts, one row per impression, partitioned by day.
WAREHOUSE_IMPRESSIONS = T.StructType([
    T.StructField("tenant_id", INT, False),
    T.StructField("campaign_id", BIG, True),
    T.StructField("ad_id", BIG, True),
    T.StructField("user_id", BIG, True),
    T.StructField("cost", UNIT_COST, True),
    T.StructField("timestamp", TIME, True),
    T.StructField("country", STR, True),
    T.StructField("device_type", STR, True),
])

WAREHOUSE_DAILY_METRICS = T.StructType([
    T.StructField("tenant_id", INT, False),
    T.StructField("campaign_id", BIG, False),
    T.StructField("date", DAY, False),
    T.StructField("impressions", BIG, True),
    T.StructField("clicks", BIG, True),
    T.StructField("conversions", BIG, True),
    T.StructField("spend", MONEY, True),
])

# Log event types.
IMPRESSION = "impression_created"
CLICK = "click_registered"
CONVERSION = "conversion_tracked"
EVENT_TYPES = (IMPRESSION, CLICK, CONVERSION)

# Campaign status choices and the allowed moves between them.
STATUSES = ("draft", "active", "paused", "stopped", "completed")
STATUS_MOVES = (
    ("draft", "active"),
    ("active", "paused"),
    ("active", "stopped"),
    ("paused", "active"),
    ("paused", "stopped"),
)

# Roles that count as tenant administrators.
ADMIN_ROLES = ("admin", "super_admin")

# Union of the payload keys of all log writers; money travels as text.
PAYLOAD = T.StructType([
    T.StructField("campaign_id", BIG),
    T.StructField("ad_id", BIG),
    T.StructField("user_id", STR),
    T.StructField("cost", STR),
    T.StructField("timestamp", STR),
    T.StructField("impression_id", BIG),
    T.StructField("click_id", BIG),
    T.StructField("conversion_id", BIG),
    T.StructField("conversion_value", STR),
    T.StructField("value", STR),
])

# Messages on the live topics.
MESSAGE = T.StructType([
    T.StructField("event_id", BIG),
    T.StructField("event_type", STR),
    T.StructField("tenant_id", INT),
    T.StructField("campaign_id", BIG),
    T.StructField("ad_id", BIG),
    T.StructField("user_id", BIG),
    T.StructField("impression_id", BIG),
    T.StructField("cost", STR),
    T.StructField("timestamp", STR),
    T.StructField("data", T.StructType([
        T.StructField("user_id", BIG),
        T.StructField("cost", STR),
        T.StructField("placement", STR),
    ])),
])
