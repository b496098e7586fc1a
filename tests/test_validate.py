from datetime import date
from decimal import Decimal

from adlumen.operators import validate as v
from adlumen.schemas import STATUSES
from tests.tables import rows_of


def errors(df, key="id"):
    return {row[key]: row["errors"] for row in df.collect()}


def named(spark, *rows):
    return spark.createDataFrame(list(rows), "id bigint, tenant_id int, name string")


def test_name_is_unique_per_tenant(spark):
    stored = named(spark, (1, 1, "Summer"), (2, 2, "Winter"), (123, 1, "Mine"))
    rows = named(spark, (10, 1, "Summer"), (11, 2, "Summer"), (12, 1, "Fresh"), (123, 1, "Mine"),
                 (13, 1, "summer"))
    taken = ["A campaign with name 'Summer' already exists for this tenant."]
    assert errors(v.v_unique_name(rows, stored)) == {10: taken, 11: [], 12: [], 123: [], 13: []}
    loose = errors(v.v_unique_name(rows, stored, ignore_case=True))
    assert loose[13] and loose[10] and not loose[11]


def test_names_within_a_batch_of_new_rows(spark):
    rows = named(spark, (None, 1, "Twice"), (None, 1, "Twice"), (None, 1, "Once"), (None, 2, "Twice"))
    found = [(r["tenant_id"], r["name"], bool(r["errors"])) for r in v.v_unique_name(rows).collect()]
    assert sorted(found) == [(1, "Once", False), (1, "Twice", True), (1, "Twice", True),
                             (2, "Twice", False)]


def test_budget_cap(spark):
    rows = spark.createDataFrame(
        [(1, 1, 5, Decimal("100.00")), (2, 1, 5, Decimal("100.01")), (3, 1, 6, Decimal("999")),
         (4, 2, 5, Decimal("999")), (5, 1, 7, Decimal("60"))],
        "id bigint, tenant_id int, advertiser_id bigint, budget decimal(12,2)")
    caps = spark.createDataFrame(
        [(1, 1, 5, Decimal("100.00")), (2, 1, 7, Decimal("50.00")), (3, 1, 7, Decimal("70.00"))],
        "id bigint, tenant_id int, advertiser_id bigint, monthly_budget decimal(12,2)")
    over = "Campaign budget cannot exceed advertiser monthly budget: $"
    assert errors(v.v_budget_cap(rows, caps)) == {
        1: [], 2: [over + "100.00"], 3: [], 4: [], 5: [over + "50.00"]}


def test_date_order(spark):
    rows = spark.createDataFrame(
        [(1, date(2025, 1, 1), date(2025, 12, 31)), (2, date(2025, 12, 31), date(2025, 1, 1)),
         (3, date(2025, 1, 1), date(2025, 1, 1))], "id bigint, start_date date, end_date date")
    bad = ["start_date must be before end_date"]
    assert errors(v.v_date_order(rows)) == {1: [], 2: bad, 3: bad}


def test_all_status_pairs(spark):
    pairs = [(i, a, b) for i, (a, b) in enumerate((a, b) for a in STATUSES for b in STATUSES)]
    stored = spark.createDataFrame([(i, a) for i, a, _ in pairs], "id bigint, status string")
    rows = spark.createDataFrame([(i, b) for i, _, b in pairs] + [(99, "stopped")],
                                 "id bigint, status string")
    found = errors(v.v_status_transition(rows, stored))
    allowed = {(a, b) for i, a, b in pairs if not found[i]}
    assert allowed == {(s, s) for s in STATUSES} | {
        ("draft", "active"), ("active", "paused"), ("active", "stopped"), ("paused", "active"),
        ("paused", "stopped")}
    assert found[99] == []
    refused = next(i for i, a, b in pairs if (a, b) == ("stopped", "active"))
    assert found[refused] == ["Cannot transition from stopped to active"]


def test_required_fields(spark):
    rows = spark.createDataFrame(
        [(1, 1, 2, "3", None), (2, 0, 2, "3", Decimal("1")), (3, 1, None, "3", None),
         (4, 1, 2, "", None)],
        "id bigint, campaign_id bigint, ad_id bigint, user_id string, cost decimal(10,4)")
    checked = v.v_required_fields(rows, "impression")
    missing = ["Missing required fields: campaign_id, ad_id, user_id"]
    assert errors(checked) == {1: [], 2: missing, 3: missing, 4: missing}
    assert rows_of(checked.filter("id = 1"), "cost") == [(0.0,)]
    assert errors(v.v_required_fields(rows, "conversion")) == {
        1: [], 2: ["Missing required fields: campaign_id, user_id"], 3: [],
        4: ["Missing required fields: campaign_id, user_id"]}


def test_schema(spark):
    rows = spark.createDataFrame(
        [(1, "ok", "5000.00", "active"), (2, "x" * 101, "1", "draft"), (3, "ok", "1.234", "draft"),
         (4, "ok", "12345678901.00", "draft"), (5, "ok", "money", "draft"), (6, "ok", "1", "gone"),
         (7, "ok", None, "draft"), (8, "x" * 100, "9999999999.99", "completed")],
        "id bigint, name string, budget string, status string")
    money = "budget is not a number with 10 digits and 2 decimals"
    assert errors(v.v_schema(rows)) == {
        1: [], 2: ["name is longer than 100 characters"], 3: [money], 4: [money], 5: [money],
        6: ["status is not a valid choice"], 7: [money], 8: []}


def test_checks_chain(spark):
    rows = spark.createDataFrame(
        [(1, 1, "n", "x", "gone", date(2025, 1, 2), date(2025, 1, 1))],
        "id bigint, tenant_id int, name string, budget string, status string, start_date date, "
        "end_date date")
    stored = named(spark, (2, 1, "n"))
    found = v.v_schema(v.v_date_order(v.v_unique_name(rows, stored)))
    assert len(errors(found)[1]) == 4
    assert found.columns == [*rows.columns, "errors"]
