"""Flags of raw texts: how often a text is gone through, and where words begin and end."""

import pytest
from pyspark.sql import functions as F

from addrloom.functions import address as D
from addrloom.functions import text as T

VERSION = ["ADMIN_VERSION_AMBIGUOUS", "NEED_REVIEW_ADMIN_VERSION"]
NOW, BOTH, OFFICE, PHONE = "RAW_CONTAINS_NAY_THUOC", "RAW_HAS_OLD_AND_NEW_ADDRESS", "TRU_SO_DETECTED", "RAW_CONTAINS_PHONE"


def test_a_text_is_composed_once_and_stripped_of_marks_once(spark):
    df = spark.range(1).select(F.concat(F.col("id").cast("string"), F.lit(" cũ")).alias("t"))
    plan = df.select(D.raw_flags(F.col("t"), T.first_phone(F.col("t"))).alias("flags"))._jdf.queryExecution().optimizedPlan().toString()
    assert (plan.count("Normalizer, compose"), plan.count("Normalizer, decompose")) == (1, 1)


@pytest.mark.parametrize(
    ("text", "flags"),
    [
        ("xã cũ và MỚI", [*VERSION, BOTH]),
        ("_cũ cũ1 mớic", []),
        ("Nay-THUỘC tỉnh Y", [*VERSION, NOW]),
        ("nay,là", [*VERSION, NOW]),
        ("xnay thuoc nay thuocx naythuoc", []),
        ("trước khi Sáp  Nhập", VERSION),
        ("sau sapnhap sap nhap2 1sap nhap", []),
        ("TRỤ SỞ", [OFFICE]),
        ("Truſo", [OFFICE]),
        ("xtrụ sở trụ sởx tr so", []),
        ("a0123456789b", [PHONE]),
        ("a012345678b", [PHONE]),
        ("٣012345678 12345678901", []),
        ("+84 912 345 678", [PHONE]),
        ("8 0912 345 67", []),
    ],
)
def test_words_begin_and_end(spark, text, flags):
    df = spark.createDataFrame([(text,)], "t string")
    row = df.select(D.raw_flags(F.col("t"), T.first_phone(F.col("t"))), D.has_old_or_new(F.col("t"))).first()
    assert tuple(row) == (flags, VERSION[0] in flags)
