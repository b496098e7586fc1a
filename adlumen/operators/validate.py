"""Table checks: rows in, the same rows with an ``errors`` array out.

Checks can be chained; each adds its messages to those already there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adlumen.schemas import STATUS_MOVES, STATUSES

# Wording of the messages and limits of the fields.
NAME_TAKEN = "A campaign with name '%s' already exists for this tenant."
OVER_BUDGET = "Campaign budget cannot exceed advertiser monthly budget: $%s"
BAD_DATES = "start_date must be before end_date"
BAD_MOVE = "Cannot transition from %s to %s"
MISSING = "Missing required fields: "
REQUIRED = {
    "impression": ("campaign_id", "ad_id", "user_id"),
    "click": ("campaign_id", "ad_id", "user_id"),
    "conversion": ("campaign_id", "user_id"),
}
MAX_NAME, MAX_STATUS = 100, 20


def _report(rows: DataFrame, *checks: tuple[Column, Column]) -> DataFrame:
    """Rows with a message for every check whose condition holds."""
    found = F.array_compact(F.array(*[F.when(bad, text) for bad, text in checks]))
    if "errors" in rows.columns:
        found = F.concat("errors", found)
    return rows.withColumn("errors", found)


def v_unique_name(rows: DataFrame, stored: DataFrame | None = None,
                  ignore_case: bool = False) -> DataFrame:
    """The name may not occur on another row of the tenant, stored or in the batch.

    A row with an id updates that stored row and does not collide with itself;
    rows without an id are new. Each (tenant, name) is reduced to its lowest
    and highest id first, so a name shared by very many rows stays one row.
    """
    name = F.lower("name") if ignore_case else F.col("name")
    holders = rows.select("tenant_id", name.alias("_name"), "id")
    if stored is not None:
        holders = holders.unionByName(stored.select("tenant_id", name.alias("_name"), "id"))
    taken = holders.groupBy("tenant_id", "_name").agg(
        F.min("id").alias("_low"), F.max("id").alias("_high"),
        F.count_if(F.col("id").isNull()).alias("_new"),
    )
    looked = rows.withColumn("_name", name).join(taken, ["tenant_id", "_name"], "left")
    other_id = (F.col("_low") != F.col("id")) | (F.col("_high") != F.col("id"))
    clash = F.when(F.col("id").isNull(), F.col("_low").isNotNull() | (F.col("_new") > 1)).otherwise(
        other_id | (F.col("_new") > 0)
    )
    checked = _report(looked, (clash, F.format_string(NAME_TAKEN, "name")))
    return checked.select(*rows.columns, *(() if "errors" in rows.columns else ("errors",)))


def v_budget_cap(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """The budget may not exceed the advertiser's monthly one; no such row, no limit.

    Of several budget rows the first by id counts.
    """
    caps = budgets.groupBy("tenant_id", "advertiser_id").agg(
        F.min_by("monthly_budget", "id").alias("_cap")
    )
    looked = rows.join(caps, ["tenant_id", "advertiser_id"], "left")
    over = F.col("budget") > F.col("_cap")
    text = F.format_string(OVER_BUDGET, F.col("_cap").cast("string"))
    checked = _report(looked, (over, text))
    return checked.select(*rows.columns, *(() if "errors" in rows.columns else ("errors",)))


def v_date_order(rows: DataFrame) -> DataFrame:
    """The start must come before the end."""
    return _report(rows, (F.col("start_date") >= F.col("end_date"), F.lit(BAD_DATES)))


def v_status_transition(rows: DataFrame, stored: DataFrame) -> DataFrame:
    """The status may change only along the allowed moves; new rows are free."""
    before = stored.select("id", F.col("status").alias("_before"))
    looked = rows.join(before, "id", "left")
    move = F.concat_ws(">", "_before", "status")
    allowed = move.isin(*[f"{old}>{new}" for old, new in STATUS_MOVES])
    bad = (F.col("_before") != F.col("status")) & ~allowed
    checked = _report(looked, (bad, F.format_string(BAD_MOVE, "_before", "status")))
    return checked.select(*rows.columns, *(() if "errors" in rows.columns else ("errors",)))


def _missing(field: str) -> Column:
    text = F.col(field).cast("string")
    return text.isNull() | text.isin("", "0")


def v_required_fields(rows: DataFrame, kind: str) -> DataFrame:
    """Event rows need their ids; 0 and empty text count as missing.

    An absent ``cost`` or ``conversion_value`` becomes 0.00.
    """
    fields = REQUIRED[kind]
    absent = _missing(fields[0])
    for field in fields[1:]:
        absent = absent | _missing(field)
    amount = "conversion_value" if kind == "conversion" else "cost"
    if kind != "click" and amount in rows.columns:
        rows = rows.withColumn(amount, F.coalesce(F.col(amount), F.lit("0.00").cast(
            rows.schema[amount].dataType)))
    return _report(rows, (absent, F.lit(MISSING + ", ".join(fields))))


def v_schema(rows: DataFrame) -> DataFrame:
    """Campaign fields fit their columns: lengths, money as DECIMAL(12,2), known status."""
    money = F.col("budget").try_cast("decimal(38,10)")
    fits = (money == F.round(money, 2)) & (F.abs(money) < F.lit(10_000_000_000))
    return _report(
        rows,
        (F.length("name") > MAX_NAME, F.lit(f"name is longer than {MAX_NAME} characters")),
        (F.length("status") > MAX_STATUS, F.lit(f"status is longer than {MAX_STATUS} characters")),
        (F.col("budget").isNull() | ~F.coalesce(fits, F.lit(False)),
         F.lit("budget is not a number with 10 digits and 2 decimals")),
        (~F.col("status").isin(*STATUSES), F.lit("status is not a valid choice")),
    )
