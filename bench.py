"""Median time of warm runs of the headline queries; prints one JSON line.

Each query is timed to its last row: results are written to Spark's no-op sink.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql.functions import lit  # noqa: E402

from adlumen.operators.cohort import cohort_retention  # noqa: E402
from adlumen.operators.page import open_page  # noqa: E402
from adlumen.operators.performance import campaign_daily_performance  # noqa: E402
from adlumen.plans import facts  # noqa: E402
from adlumen.plans.facts import VOLUME_NOW  # noqa: E402
from adlumen.plans.queries import QUERIES  # noqa: E402
from adlumen.session import build_session, shared_folder  # noqa: E402
from adlumen.sources.generate import (  # noqa: E402
    generate_ads, generate_campaigns, generate_impressions,
)
from adlumen.sources.tables import append_rows, read_table  # noqa: E402

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))

CHOSEN = [name for name in os.environ.get("BENCH_QUERIES", "").split(",") if name]
HEADLINE = [name for name in CHOSEN if name != "generated"] if CHOSEN else [
    "cohort_retention_volume",
    "advanced_cohort_volume",
    "campaign_daily_performance",
    "top_campaigns",
    "campaign_ranking",
    "campaign_report",
    "daily_aggregate",
    "impressions_on_day",
    "distinct_campaign_count",
    "tenant_stats",
    "daily_metrics_upsert",
    "cohort_retention",
    "attribution",
    "hourly_trend",
    "realtime_metrics",
    "campaign_live_metrics",
    "dashboard_totals",
    "bid_price",
    "sync_impressions",
    "event_replay",
    "event_stats",
    "event_stream",
    "append_events",
    "log_from_facts",
    "validate_sequence",
    "v_unique_name",
    "v_budget_cap",
    "v_status_transition",
    "stream_running_counts",
    "stream_live_metrics",
]


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def together(queries) -> None:
    """Several queries at once in one session, each to its last row."""
    with ThreadPoolExecutor(len(queries)) as pool:
        list(pool.map(lambda query: run(query()), queries))


def one_tenant(spark) -> dict:
    """The published limits are for one tenant's page: the same pages over the line items."""
    shown = facts.volume_impressions(spark, FOLDER)
    campaigns, ads = facts.campaigns(spark, FOLDER), facts.ads(spark, FOLDER)
    log = facts.log(spark, FOLDER)

    def page() -> None:
        with open_page(campaigns, ads, shown, log, 1, VOLUME_NOW) as parts:
            together([lambda part=part: part for part in parts.values()])

    return {
        "tenant_cohort": lambda: run(cohort_retention(shown, 1)),
        "tenant_daily_performance": lambda: run(
            campaign_daily_performance(campaigns, ads, shown, 1)),
        "tenant_dashboard": page,
        "tenant_cohort_10_at_once": lambda: together(
            [lambda: cohort_retention(shown, 1)] * 10),
    }


MILLION = int(os.environ.get("BENCH_IMPRESSIONS", "1000000"))
GENERATED_AT = datetime(2025, 6, 1)


def generated(spark) -> dict:
    """The same pages over generated impressions, stored by day as an application stores them."""
    root = f"{shared_folder(spark)}/generated"
    campaigns = generate_campaigns(spark)
    append_rows(campaigns, root, "campaign")
    append_rows(generate_ads(campaigns), root, "ad")
    append_rows(generate_impressions(spark, MILLION, as_of=GENERATED_AT), root, "impression")
    campaigns, ads, shown = (read_table(spark, root, name)
                             for name in ("campaign", "ad", "impression"))
    log = shown.select("tenant_id", lit("impression_created").alias("event_type"))

    def page() -> None:
        with open_page(campaigns, ads, shown, log, 1, GENERATED_AT) as parts:
            together([lambda part=part: part for part in parts.values()])

    return {
        "cohort": lambda: run(cohort_retention(shown, 1)),
        "daily_performance": lambda: run(campaign_daily_performance(campaigns, ads, shown, 1)),
        "dashboard": page,
        "cohort_10_at_once": lambda: together([lambda: cohort_retention(shown, 1)] * 10),
    }


def median_seconds(job) -> float:
    taken = []
    for _ in range(RUNS + 1):
        start = time.perf_counter()
        job()
        taken.append(time.perf_counter() - start)
    return round(statistics.median(taken[1:]), 4)


def main() -> None:
    spark = build_session("bench", f"local[{CPUS}]", **{
        "spark.sql.shuffle.partitions": CPUS,
        "spark.ui.enabled": "false",
        "spark.driver.memory": os.environ.get("BENCH_MEMORY", "8g"),
    })
    spark.sparkContext.setLogLevel("ERROR")
    seconds: dict[str, float] = {}
    jobs = {name: lambda name=name: run(QUERIES[name](spark, FOLDER)) for name in HEADLINE}
    if not CHOSEN:
        jobs.update(one_tenant(spark))
    for name, job in jobs.items():
        seconds[name] = median_seconds(job)
    million = {}
    if not CHOSEN or "generated" in CHOSEN:
        million = {name: median_seconds(job) for name, job in generated(spark).items()}
    rows = spark.read.parquet(f"{FOLDER}/events.parquet").count()
    print(json.dumps({
        "metric": "total_seconds_of_medians", "value": round(sum(seconds.values()), 4),
        "unit": "sec", "queries": seconds, "sf": Path(FOLDER).name.removeprefix("sf"),
        "stream_rows_per_sec": round(rows / seconds["stream_running_counts"])
        if "stream_running_counts" in seconds else None,
        "generated_impressions": MILLION, "generated_pages": million,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
