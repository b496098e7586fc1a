import json

from adlumen.operators import eventlog as e
from tests.tables import NOW, ads, at, clicks, conversions, day, impressions, log, rows_of

I, C, V = "impression_created", "click_registered", "conversion_tracked"


def pay(**fields):
    return json.dumps(fields)


def edge(spark):
    return log(spark, [
        (1, 1, I, "5", pay(user_id=7, cost="0.50"), "02-01 10:00", 2),      # gap at the start
        (2, 1, I, "5", pay(user_id=0, cost="0.25"), "02-01 11:00", 3),      # user 0
        (3, 1, C, "5", pay(user_id=8), "02-01 12:00", 5),                   # gap in the middle
        (4, 1, I, "5", None, "02-02 10:00", 5),                             # number twice, no payload
        (5, 1, I, "5", pay(user_id=""), "02-02 11:00", 6),                  # no cost, empty user
        (6, 1, "page_view", "5", pay(user_id=9), "02-02 12:00", 7),         # unknown type
        (7, 1, V, "5", pay(user_id=9, conversion_value="5.00"), "02-03 10:00", 8),
        (8, 1, I, "6", pay(user_id=7, cost="1.00"), "02-01 10:00", 1),
        (9, 2, I, "5", pay(user_id=7, cost="1.00"), "02-29 12:00", 1),
    ])


def test_replay_of_a_campaign(spark):
    assert sorted(rows_of(e.event_replay(edge(spark), 1, 5))) == [
        (1, 5, day("02-01"), 2, 1, 0, 0.75, 2),
        (1, 5, day("02-02"), 2, 0, 0, 0.0, 0),
    ]


def test_replay_with_conversions_lists_their_days(spark):
    assert (1, 5, day("02-03"), 0, 0, 1, 0.0, 0) in rows_of(
        e.event_replay(edge(spark), 1, 5, with_conversions=True))


def test_replay_totals(spark):
    assert rows_of(e.event_totals(edge(spark), 1, 5)) == [(1, 5, 7, 4, 1, 1, 0.75, 3)]


def test_replay_does_not_depend_on_order(spark):
    shuffled = edge(spark).orderBy("payload").repartition(5)
    assert sorted(rows_of(e.event_replay(shuffled))) == sorted(rows_of(e.event_replay(edge(spark))))


def test_gaps_and_summary(spark):
    assert sorted(rows_of(e.sequence_gaps(edge(spark), 1, 5), "expected", "found", "event_id")) == [
        (1, 2, 1), (4, 5, 3), (6, 5, 4)]
    assert rows_of(e.validate_sequence(edge(spark), 1, 5)) == [(False, 3, 7, 8)]
    assert rows_of(e.validate_sequence(edge(spark), 1, 6)) == [(True, 0, 1, 1)]
    assert rows_of(e.validate_sequence(edge(spark), 1, 99)) == [(True, 0, 0, 0)]
    assert sorted(rows_of(e.validate_sequence(edge(spark)))) == [
        ((1, "5", False, 3, 7, 8)), (1, "6", True, 0, 1, 1), (2, "5", True, 0, 1, 1)]


def test_stream_is_newest_first_and_limited(spark):
    assert rows_of(e.event_stream(edge(spark), 1, 5, limit=2), "event_id", "event_type") == [
        (7, V), (6, "page_view")]
    assert e.event_stream(edge(spark), limit=1).count() == 3
    assert e.audit_trail(edge(spark), 1, 5).count() == 7
    assert e.audit_trail(edge(spark), 1, 5).columns == [
        "event_id", "event_type", "timestamp", "payload", "sequence_number"]


def test_stats(spark):
    assert rows_of(e.event_stats(edge(spark), 1, at("02-02 12:00"))) == [(8, 2, 5, 1, 1)]
    assert rows_of(e.event_stats(edge(spark), 3, NOW)) == [(0, 0, 0, 0, 0)]


def test_batch_counts_list_and_match(spark):
    ids = spark.createDataFrame([(1,), (3,), (7,), (9,), (1000,)], "event_id bigint")
    assert rows_of(e.event_batch_counts(edge(spark), ids, 1)) == [(5, 3, 1, 1, 1)]
    assert rows_of(e.event_batch_counts(edge(spark), ids.limit(0), 1)) == [(0, 0, 0, 0, 0)]


def test_retention_keeps_the_cutoff_itself(spark):
    rows = log(spark, [(1, 1, I, "5", None, "02-29 12:00", 1), (2, 1, I, "5", None, "02-29 11:59", 2),
                       (3, 2, I, "5", None, "01-01 00:00", 1)])
    kept = e.retained_events(rows, 1, as_of=NOW)
    assert rows_of(kept, "id") == [(1,)]
    scoped = e.retained_events(rows, 1, tenant_id=1, as_of=NOW)
    assert sorted(rows_of(scoped, "id")) == [(1,), (3,)]
    assert sorted(rows_of(e.retention_split(rows, 1, as_of=NOW))) == [(1, 1, 1), (2, 0, 1)]
    assert sorted(rows_of(e.retention_split(rows, 1, 1, NOW))) == [(1, 1, 1), (2, 1, 0)]


def recorded(spark):
    return impressions(spark, [(21, 1, 11, 7, "02-05 10:00", "0.5"), (22, 1, 11, 8, "02-05 09:00", "1")]
                       ).selectExpr("*", "5L as campaign_id")


def test_appending_numbers_from_the_last(spark):
    new = e.impression_events(recorded(spark))
    found = e.append_events(new, edge(spark))
    assert sorted(rows_of(found, "id", "aggregate_id", "sequence_number")) == [
        (21, "5", 10), (22, "5", 9)]
    first = e.append_events(new)
    assert sorted(rows_of(first, "id", "sequence_number")) == [(21, 2), (22, 1)]


def test_appending_from_a_kept_table_of_last_numbers(spark):
    last = e.last_sequences(edge(spark))
    first = e.append_events(e.impression_events(recorded(spark)), last=last)
    last = e.advanced_sequences(last, first)
    assert sorted(rows_of(last)) == [(1, "5", 10), (1, "6", 1), (2, "5", 1)]
    again = e.append_events(e.impression_events(recorded(spark)), last=last)
    assert sorted(rows_of(again, "sequence_number")) == [(11,), (12,)]


def test_batch_list_with_repeats(spark):
    ids = spark.createDataFrame([(1,)] * 5, "event_id bigint")
    assert rows_of(e.event_batch_counts(edge(spark), ids, 1)) == [(5, 1, 1, 0, 0)]


def test_payloads(spark):
    body = json.loads(e.impression_events(recorded(spark)).filter("id = 21").first()["payload"])
    assert body == {"campaign_id": 5, "ad_id": 11, "user_id": 7, "cost": "0.5000",
                    "timestamp": "2024-02-05T10:00:00.000000+00:00"}
    click = recorded(spark).selectExpr("*", "cast(null as bigint) as impression_id")
    assert json.loads(e.click_events(click).first()["payload"])["impression_id"] is None
    sale = recorded(spark).selectExpr("*", "cast(9.5 as decimal(10,2)) as conversion_value")
    assert json.loads(e.conversion_events(sale).first()["payload"])["conversion_value"] == "9.50"


def test_recorded_impressions_need_an_ad_of_the_tenant(spark):
    assert e.recorded_impressions(recorded(spark), ads(spark, [(11, 1, 5)])).count() == 2
    assert e.recorded_impressions(recorded(spark), ads(spark, [(11, 2, 5)])).count() == 0


def test_log_from_facts_follows_the_chain(spark):
    shown = recorded(spark)
    found = e.log_from_facts(
        shown, clicks(spark, [(1, 1, 21, "02-05 10:01"), (2, 1, 999, "02-05 10:01")]),
        conversions(spark, [(1, 1, 1, "3.00", "02-05 10:02"), (2, 1, 2, "3.00", "02-05 10:02")]),
        edge(spark))
    assert sorted(rows_of(found, "sequence_number", "event_type", "source_id", "aggregate_id")) == [
        (9, I, 22, "5"), (10, I, 21, "5"), (11, C, 1, "5"), (12, V, 1, "5")]
    sale = found.filter("event_type = 'conversion_tracked'").first()["payload"]
    assert json.loads(sale) == {"conversion_id": 1, "click_id": 1, "value": "3.00"}
