"""Address tables from delimited files, and the columns they keep their fields in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import norm

# What the header of each field contains, without accents.
NEEDLES = {
    "address": ["dia chi"],
    "ward": ["phuong xa", "phuong", "xa"],
    "district": ["quan huyen", "quan", "huyen"],
    "province": ["tinh thanh", "tinh", "thanh pho"],
}


def separator(spark: SparkSession, path: str) -> str:
    """Tab for .tsv; else the semicolon where the first line holds more of them than commas; else the comma."""
    if path.rstrip("/").lower().endswith(".tsv"):
        return "\t"
    first = spark.read.text(path).limit(1).collect()
    line = first[0].value if first else ""
    return ";" if line.count(";") > line.count(",") else ","


def read_delimited(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text, quoted line breaks kept, short rows filled with nulls."""
    options = {"header": True, "sep": separator(spark, path), "quote": '"', "escape": '"', "multiLine": True, "mode": "PERMISSIVE"}
    return spark.read.options(**options).csv(path)


def field_columns(df: DataFrame, needles: dict[str, list[str]] = NEEDLES) -> dict[str, str]:
    """Field to the first column whose header equals, or else contains, one of its needles; earlier needles first.

    Raises LookupError naming the fields that no column carries.
    """
    spark = df.sparkSession
    plain = [r.h for r in spark.createDataFrame([(i, c) for i, c in enumerate(df.columns)], "i int, c string").select("i", norm(F.col("c")).alias("h")).orderBy("i").collect()]
    found = {}
    for field, words in needles.items():
        tests = [lambda h, w=w: h == w for w in words] + [lambda h, w=w: w in h for w in words]
        hit = next((c for test in tests for c, h in zip(df.columns, plain, strict=True) if test(h)), None)
        if hit is not None:
            found[field] = hit
    if missing := [f for f in needles if f not in found]:
        raise LookupError(f"no column for {', '.join(missing)} among {df.columns}")
    return found


def canonical(df: DataFrame) -> DataFrame:
    """address, ward, district, province as text; nulls become empty."""
    columns = field_columns(df)
    return df.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(f) for f, c in columns.items()])
