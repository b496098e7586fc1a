"""Attribution against hand-worked journeys and against the row-by-row definition."""

import random
from collections import defaultdict
from datetime import timedelta

import pytest

from adlumen.operators.attribution import attribution
from tests.tables import ads, at, clicks, conversions, impressions, rows_of

COLUMNS = ["campaign_id", "attributed_users", "attributed_revenue", "avg_journey_days",
           "total_impressions", "total_clicks", "total_conversions"]


def journey(spark):
    """One user, one campaign: three impressions over two days, two clicks on the
    second, one of which converts."""
    return (
        impressions(spark, [(1, 1, 11, 7, "02-01 10:00", "1"), (2, 1, 11, 7, "02-02 10:00", "1"),
                            (3, 1, 11, 7, "02-03 09:00", "1")]),
        ads(spark, [(11, 1, 1)]),
        clicks(spark, [(1, 1, 2, "02-02 10:01"), (2, 1, 2, "02-02 10:02")]),
        conversions(spark, [(1, 1, 2, "100.00", "02-02 11:00")]),
    )


def test_totals_repeat_per_journey_row(spark):
    # Four rows: weights 0.4 first, 0.2 click, 0.4 converting click, 0.2 last.
    found = attribution(*journey(spark), tenant_id=1)
    assert rows_of(found) == [(1, 1, 120.0, 2.0, 16, 8, 4, 25.0)]


def test_per_touch_counts_each_row_once(spark):
    found = attribution(*journey(spark), tenant_id=1, mode="per_touch")
    assert rows_of(found) == [(1, 1, 40.0, 2.0, 4, 2, 1, 25.0)]


def test_one_day_journey_and_first_touch_conversion(spark):
    facts = impressions(spark, [
        (1, 1, 11, 7, "02-01 10:00", "1"), (2, 1, 11, 7, "02-01 23:00", "1"),   # one day
        (3, 1, 11, 8, "02-01 10:00", "1"), (4, 1, 11, 8, "02-05 10:00", "1"),   # first converts
        (5, 1, 99, 7, "02-01 09:00", "1"),                                      # unknown ad
    ])
    found = attribution(facts, ads(spark, [(11, 1, 1)]), clicks(spark, [
        (1, 1, 1, "02-01 10:01"), (2, 1, 3, "02-01 10:01")]), conversions(spark, [
            (1, 1, 1, "10.00", "02-01 10:05"), (2, 1, 2, "50.00", "02-09 10:05")]), tenant_id=1)
    # user 7: 10 * (1 + 1); user 8: 50 * (0.4 + 0.2)
    assert rows_of(found, *COLUMNS[:3]) == [(1, 2, 50.0)]


def test_campaign_filter_applies_to_finished_groups(spark):
    facts = impressions(spark, [(1, 1, 11, 7, "02-01 10:00", "1"), (2, 1, 21, 7, "02-02 10:00", "1"),
                                (3, 1, 21, 7, "02-03 10:00", "1")])
    both = ads(spark, [(11, 1, 1), (21, 1, 2)])
    none = clicks(spark, []), conversions(spark, [])
    assert rows_of(attribution(facts, both, *none, tenant_id=1, campaign_id=2), *COLUMNS) == [
        (2, 1, None, 1.0, 4, 0, 0)]


def test_unknown_mode(spark):
    with pytest.raises(ValueError):
        attribution(*journey(spark), mode="other")


def by_definition(shown, placed, clicked, converted, reference):
    """The report spelled out row by row."""
    rows = []
    for i, tenant, ad, user, when, _ in shown:
        hits = sorted(c for c in clicked if c[2] == i) or [None]
        for hit in hits:
            sales = sorted(v for v in converted if hit and v[2] == hit[0]) or [None]
            for sale in sales:
                rows.append((user, (at(when), i, hit[0] if hit else -1, sale[0] if sale else -1),
                             placed.get(ad), hit, sale))
    firsts = {}
    for row in rows:
        firsts[row[0]] = min(firsts.get(row[0], row[1]), row[1])
    groups = defaultdict(list)
    for row in rows:
        if row[2] is not None:
            groups[row[0], row[2]].append(row)
    report = {}
    for (user, campaign), members in groups.items():
        days = (max(m[1][0] for m in members).date() - min(m[1][0] for m in members).date()).days
        sales = [float(m[4][3]) for m in members if m[4]]
        entry = report.setdefault(campaign, [0, None, 0, 0, 0, 0, 0])
        entry[0] += 1
        for member in members:
            first = member[1] == firsts[user]
            weight = 1.0 if days == 0 else 0.4 if first or member[4] else 0.2
            own = ([float(member[4][3])] if member[4] else []) if not reference else sales
            if own:
                entry[1] = (entry[1] or 0) + sum(own) * weight
            entry[2] += days
            entry[3] += 1
            entry[4] += len(members) if reference else 1
            entry[5] += sum(1 for m in members if m[3]) if reference else bool(member[3])
            entry[6] += len(sales) if reference else bool(member[4])
    return sorted((c, e[0], None if e[1] is None else round(e[1], 6), round(e[2] / e[3], 4), *e[4:])
                  for c, e in report.items())


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("mode", ["reference", "per_touch"])
def test_random_journeys(spark, seed, mode):
    dice = random.Random(seed)

    def moment():
        return (at("02-01 00:00") + timedelta(minutes=30 * dice.randrange(200))).strftime("%m-%d %H:%M")

    # User 1 and impression 1 get about a third of everything.
    shown = [(i, 1, dice.choice([11, 12, 21, 99]), dice.choice([1, 1, 2, 3, 4]), moment(), "1")
             for i in range(60)]
    clicked = [(i, 1, dice.choice([1, dice.randrange(70), dice.randrange(70)]), moment())
               for i in range(40)]
    converted = [(i, 1, dice.choice([1, dice.randrange(45), dice.randrange(45)]),
                  f"{dice.randrange(1, 9000) / 100:.2f}", moment()) for i in range(30)]
    found = attribution(impressions(spark, shown), ads(spark, [(11, 1, 1), (12, 1, 1), (21, 1, 2)]),
                        clicks(spark, clicked), conversions(spark, converted), 1, mode=mode)
    expected = by_definition(shown, {11: 1, 12: 1, 21: 2}, clicked, converted, mode == "reference")
    assert sorted(rows_of(found, *COLUMNS)) == expected


def test_most_clicks_and_purchases_are_linked(spark):
    """The journeys of the registered queries are not starved, and links fan out."""
    from adlumen.plans import facts

    folder = "/root/testdata/sf0.01"
    clicks, sales = facts.clicks(spark, folder), facts.conversions(spark, folder)
    for rows, link in ((clicks, "impression_id"), (sales, "click_id")):
        assert rows.filter(f"{link} IS NOT NULL").count() > rows.count() / 2
        assert rows.groupBy(link).count().filter(f"{link} IS NOT NULL AND count > 1").count() > 0


def test_products_of_large_counts(spark):
    from adlumen.operators.attribution import _product_sum
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(4_000_000_000,), (5_000_000_000,)], "rows bigint")
    total = rows.agg(_product_sum("rows", F.col("rows")).alias("t")).first().t
    assert int(total) == 4_000_000_000 ** 2 + 5_000_000_000 ** 2
