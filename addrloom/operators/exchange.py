"""What leaves a run: request rows for a model, rows it did not answer, and the clean, review and dropped tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.address import nfc
from .admin import sort_key
from .records import components
from .review import drop_reason, review_reasons

RAW_CHARS, UNIT_CHARS = 420, 120  # fixed values: what a request carries of the raw text and of a unit's name
# Fixed value: why a repeated row is dropped; %s is its first row.
REPEATED = "Trùng lặp với dòng %s (cùng địa chỉ và 3 cột hành chính)"


def request_rows(rows: DataFrame) -> DataFrame:
    """(row_id, request): the JSON of a record as a model is asked about it.

    rows(row_id, raw, ward, district, province, poi, street, level4, flags, confidence). Empty details, no flags and a null
    confidence are left out; null texts are ''. The raw text's first 420 characters are sent, as the request's format says.
    """
    sent = lambda c, most: F.left(F.trim(nfc(F.col(c))), F.lit(most)).alias(c)
    given = lambda c: F.nullif(F.coalesce(F.col(c), F.lit("")), F.lit("")).alias(c)
    flags = F.when(F.size(F.coalesce("flags", F.array().cast("array<string>"))) > 0, F.array_distinct("flags")).alias("flags")
    rule = F.struct(given("poi"), given("street"), given("level4"), flags, "confidence").alias("rule")
    item = F.struct("row_id", sent("raw", RAW_CHARS), sent("ward", UNIT_CHARS), sent("district", UNIT_CHARS), sent("province", UNIT_CHARS), rule)
    return rows.select("row_id", F.to_json(item).alias("request"))


def unanswered(asked: DataFrame, answers: DataFrame) -> DataFrame:
    """The asked rows whose row_id no answer has; a null row_id is never answered."""
    return asked.join(answers.select("row_id"), "row_id", "left_anti")


def with_flag(rows: DataFrame, which, flag: str) -> DataFrame:
    """rows whose `which` holds get the flag at the end of flags, once."""
    flags = F.coalesce("flags", F.array().cast("array<string>"))
    add = F.coalesce(which, F.lit(False)) & ~F.array_contains(flags, flag)
    return rows.withColumn("flags", F.when(add, F.array_append(flags, F.lit(flag))).otherwise(flags))


def clean_table(results: DataFrame) -> DataFrame:
    """A row for each detail of a kept record: row_id, position, kind, value and its units.

    results(row_id, first, pois, streets, level4s, ward, district, province). Repeated rows and rows without details go.
    Order it by `clean_order()`; the order is not part of the table.
    """
    details = ["pois", "streets", "level4s"]
    kept = results.where(F.col("first").eqNullSafe(F.col("row_id")))
    units = kept.select("row_id", "ward", "district", "province")
    return components(kept, details, "row_id").where("value is not null").join(units, "row_id")


def clean_order() -> list:
    """What a clean table is ordered by: its units, then the record and the place of the detail in it."""
    return [sort_key(F.col("province"), F.col("district"), F.col("ward")), F.col("row_id"), F.col("position")]


def review_table(results: DataFrame) -> DataFrame:
    """(row_id, raw, reasons, flags): records that a person should look at; repeated rows go."""
    rows = results.where(F.col("first").eqNullSafe(F.col("row_id"))).withColumn("reasons", review_reasons(F.col("flags")))
    return rows.where("reasons <> ''").select("row_id", "raw", "reasons", F.array_join("flags", ", ").alias("flags"))


def dropped_table(results: DataFrame, model_on: bool) -> DataFrame:
    """(row_id, raw, reason): repeated rows and those without details, results(row_id, first, raw, flags, has_detail)."""
    again = ~F.col("first").eqNullSafe(F.col("row_id"))
    said = F.format_string(REPEATED, F.col("first"))
    reason = F.when(again, said).otherwise(drop_reason(F.col("raw"), F.col("flags"), F.col("has_detail"), model_on))
    return results.withColumn("reason", reason).where("reason is not null").select("row_id", "raw", "reason")
