from datetime import date

from pyspark.sql import functions as F

from adlumen.operators import cohort
from adlumen.operators.cohort import advanced_cohort, cohort_retention
from tests.tables import NOW, day, impressions, rows_of


def edge(spark):
    return impressions(spark, [
        (1, 1, 1, 10, "01-01 10:00", "1.0000"),   # period 0
        (2, 1, 1, 10, "01-01 11:00", "2.0000"),   # same day again
        (3, 1, 1, 10, "01-31 10:00", "1.0000"),   # period 30
        (4, 1, 1, 10, "02-01 10:00", "1.0000"),   # period 31: outside
        (5, 1, 1, 11, "01-01 23:59", "1.0000"),   # same cohort
        (6, 1, 1, 12, "02-20 08:00", "3.0000"),   # later cohort
        (7, 2, 1, 10, "02-25 08:00", "5.0000"),   # same user, other tenant
    ])


def test_periods_up_to_thirty_days(spark):
    assert rows_of(cohort_retention(edge(spark), tenant_id=1)) == [
        (day("01-01"), 0, 2, 3, 100.0),
        (day("01-01"), 30, 1, 1, 50.0),
        (day("02-20"), 0, 1, 1, 100.0),
    ]


def test_all_tenants_keep_users_apart(spark):
    everyone = cohort_retention(edge(spark))
    assert everyone.columns[0] == "tenant_id"
    assert rows_of(everyone.filter("tenant_id = 2")) == [(2, day("02-25"), 0, 1, 1, 100.0)]
    alone = rows_of(cohort_retention(edge(spark), tenant_id=1))
    assert [row[1:] for row in rows_of(everyone.filter("tenant_id = 1"))] == alone


def test_activity_before_the_cutoff_gives_negative_periods(spark):
    # Cutoff 2024-01-31 12:00: user 10 reopens on 02-01, its January is negative.
    found = rows_of(advanced_cohort(edge(spark), 1, days_back=30, as_of=NOW),
                    "cohort_month", "period_days", "active_users", "cohort_spend", "cohort_size",
                    "retention_rate", "revenue_per_user")
    assert found == [
        (day("02-01"), -31, 1, 3.0, 1, 100.0, 3.0),
        (day("02-01"), -1, 1, 1.0, 1, 100.0, 1.0),
        (day("02-01"), 0, 1, 1.0, 1, 100.0, 1.0),
        (day("02-20"), 0, 1, 3.0, 1, 100.0, 3.0),
    ]


def test_non_negative_leaves_them_out(spark):
    found = rows_of(advanced_cohort(edge(spark), 1, 30, NOW, non_negative=True),
                    "cohort_month", "period_days")
    assert found == [(date(2024, 2, 1), 0), (date(2024, 2, 20), 0)]


def test_rows_after_as_of_do_not_exist_yet(spark):
    facts = impressions(spark, [(1, 1, 1, 1, "02-28 10:00", "1"), (2, 1, 1, 1, "03-02 10:00", "1")])
    assert rows_of(advanced_cohort(facts, 1, as_of=NOW), "period_days") == [(0,)]


def test_empty(spark):
    assert cohort_retention(impressions(spark, []), 1).count() == 0
    assert advanced_cohort(impressions(spark, []), 1, as_of=NOW).count() == 0


def test_rows_without_user_belong_to_no_cohort(spark):
    facts = impressions(spark, [(1, 1, 1, None, "02-28 10:00", "1"), (2, 1, 1, 1, "02-28 10:00", "1")])
    assert rows_of(cohort_retention(facts, 1)) == [(day("02-28"), 0, 1, 1, 100.0)]


def test_many_openers_are_added_up_in_parts_of_bounded_length(spark, monkeypatch):
    rows = [(i, 1 + i % 2, 1, i % 70, f"0{1 + i % 2}-{1 + i % 28:02d} 10:00", "1") for i in range(600)]
    rows += [(900, None, 1, 3, "02-28 10:00", "1"), (901, 1, 1, None, "02-28 10:00", "1"),
             (902, 1, 1, 800, "01-03 10:00", "1")]    # the last one opens no cohort
    facts = impressions(spark, rows)
    few = rows_of(advanced_cohort(facts, days_back=20, as_of=NOW))
    monkeypatch.setattr(cohort, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(cohort, "ROWS_A_TASK", 25)
    found = advanced_cohort(facts, days_back=20, as_of=NOW)
    assert rows_of(found) == few
    # 25 parts for about 600 rows, and what is sorted and added up in one holds no join.
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "RepartitionByExpression [tenant_id" in plan
    laid = cohort._of_openers(facts, ["tenant_id"], F.lit(NOW).cast("timestamp_ntz") - F.expr("interval 20 days"))
    assert laid.rdd.getNumPartitions() == -(-603 // 25)
