"""Edge cases of records' flags, routes, counts, output tables and streams."""

import json

from pyspark.sql import functions as F

from addrloom.functions import address as D
from addrloom.functions import segments as S
from addrloom.functions import text as T
from addrloom.operators import admin as A
from addrloom.operators import exchange as X
from addrloom.operators import review as V
from addrloom.streaming import records as stream

RESULT = "row_id long, first long, raw string, pois array<string>, streets array<string>, level4s array<string>, ward string, district string, province string, flags array<string>, has_detail boolean"


def test_nulls_and_blanks(spark):
    df = spark.createDataFrame([(None, None), ("  ", None), ("x cũ", ["MISSING_ADMIN_COLUMN"])], "t string, f array<string>")
    t, f = F.col("t"), F.col("f")
    got = df.select(D.raw_flags(t, T.first_phone(t)), V.route(f, t), V.review_reasons(f), V.result_score(t, t, f), S.expanded(t), S.segments(t), S.display(t), D.is_note(t), D.is_customer_name(t), D.old_unit_note(t)).collect()
    blank = ["NO_POI_FOUND", "NO_LEVEL4_FOUND", "LOW_CONFIDENCE"]
    assert tuple(got[0]) == (blank, "ACCEPT_RULE", "", 0.9, "", [], "", True, False, None)
    assert got[1][0] == blank
    assert tuple(got[2])[:4] == (["ADMIN_VERSION_AMBIGUOUS", "NEED_REVIEW_ADMIN_VERSION"], "REVIEW_MANUAL", "Thiếu/không khớp cột hành chính", 0.97)


def test_codes_and_notes(spark):
    df = spark.createDataFrame([("A1103 số 5 B12/3 SP12345-x",), ("An Phú ( công an huyện cũ)",)], "t string")
    got = df.select(D.order_codes("t"), D.without_order_codes(F.col("t")), D.old_unit_note(F.col("t")), D.without_old_unit_note(F.col("t"))).collect()
    assert got[0][0] == ["A1103"] and got[0][1] == "  số 5 B12/3 SP12345-x"
    assert got[1][2:] == ("công an huyện cũ", "An Phú")


def test_tables(spark):
    rows = [
        (1, 1, "a", ["P"], [], ["Thôn 1", "Thôn 1", ""], "Phường 2", "d", "B", [], True),
        (2, 1, "a", ["P"], [], [], "Phường 2", "d", "B", [], True),
        (3, 3, "", [], [], [], "", "", "", None, False),
        (4, 4, "z", None, ["Q"], None, "Phường 10", None, "A", ["LLM_SKIPPED_QUOTA", "ADMIN_NEW_FORMAT"], True),
        (5, 5, "y", None, None, None, None, None, None, ["LLM_SKIPPED_QUOTA"], None),
    ]
    df = spark.createDataFrame(rows, RESULT)
    clean = [(r.row_id, r.value) for r in X.clean_table(df).orderBy(*X.clean_order()).collect()]
    assert sorted(clean) == [(1, "P"), (1, "Thôn 1"), (4, "Q")] and clean[0] == (4, "Q")
    dropped = {r.row_id: r.reason for r in X.dropped_table(df, model_on=True).collect()}
    assert dropped == {2: X.REPEATED % 1, 3: V.NO_TEXT, 5: V.NO_DETAIL + V.NOT_ASKED}
    assert {r.row_id: r.reasons for r in X.review_table(df).collect()} == {4: V.REASONS["LLM_SKIPPED_QUOTA"], 5: V.REASONS["LLM_SKIPPED_QUOTA"]}
    stats = V.run_stats(df.withColumn("parts", F.lit(2))).first().asDict()
    assert stats == {"input_n": 5, "duplicates": 1, "unique_n": 4, "removed": 2, "output_n": 4, "full_admin": 4, "mapped_new": 1, "review_n": 2}
    assert set(V.run_stats(df.withColumn("parts", F.lit(2)).limit(0)).first()) == {0}


def test_requests(spark):
    schema = "row_id long, raw string, ward string, district string, province string, poi string, street string, level4 string, flags array<string>, confidence double"
    df = spark.createDataFrame([(1, " số 5 ", "x", None, "Hà Nội", "", "Lê Lợi", None, ["A", "A"], 0.95), (2, "ư" * 500, None, None, None, None, None, None, None, None)], schema)
    got = {r.row_id: json.loads(r.request) for r in X.request_rows(df).collect()}
    assert got[1] == {"row_id": 1, "raw": "số 5", "ward": "x", "district": "", "province": "Hà Nội", "rule": {"street": "Lê Lợi", "flags": ["A"], "confidence": 0.95}}
    assert got[2] == {"row_id": 2, "raw": "ư" * 420, "ward": "", "district": "", "province": "", "rule": {}}
    assert [r.row_id for r in X.unanswered(df, df.where("row_id = 1")).collect()] == [2]
    assert [r.flags for r in X.with_flag(df, F.col("row_id") == 2, "A").orderBy("row_id").collect()] == [["A", "A"], ["A"]]


def test_directory_and_keys(spark):
    assert [r[0] for r in spark.createDataFrame([("Phường",), ("Văn Miếu-Quốc Tử Giám",), ("TP. Huế",), (None,)], "n string").select(A.flex_key(F.col("n"))).collect()] == ["", "vanmieuquoctugiam", "hue", ""]
    fields = ", ".join(f"{c} string" for c in A.ENTRY_FIELDS)
    rows = spark.createDataFrame([("09", None, None, "", "w", None, None, None, None), (None, "n", "s", "", "w", None, None, None, None)], f"phone string, note string, {fields}")
    known = spark.createDataFrame([("09", "s", None, "other", None, None, None, None), (None,) + ("q",) * 7], f"phone string, {fields}")
    got = {r.phone: r for r in A.enriched(rows, known).collect()}
    assert (got["09"].street, got["09"].ward, got["09"].note, got["09"].phone_hit) == ("s", "w", A.FROM_DIRECTORY + A.FILLED, True)
    assert (got[None].street, got[None].note, got[None].phone_hit, got[None].conflict) == ("s", "n", False, False)


def test_stream(spark, tmp_path):
    schema = "row_id long, at timestamp, text string"
    rows = [(1, "5 Lê Lợi, Huế"), (2, "5 LE LOI HUE"), (3, "xã cũ 0912345678"), (4, None)]
    df = spark.createDataFrame(rows, "row_id long, text string").selectExpr("row_id", "timestamp'2024-01-01 10:00:00' as at", "text")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    once = stream.first_seen(stream.parsed(stream.read_records(spark, str(tmp_path / "in"), schema)), "at")
    stream.write(once, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = {r.row_id: r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert len(got) == 3 and len({1, 2} & set(got)) == 1 and got[3].phone == "0912345678" and "RAW_CONTAINS_PHONE" in got[3].flags
    again = stream.first_seen(stream.parsed(stream.read_records(spark, str(tmp_path / "in"), schema)), "at")
    stream.write(again, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
    tally = {(r.flag): r.n for r in stream.counts(stream.parsed(df), "at").collect()}
    assert tally == {"": 2, "RAW_CONTAINS_PHONE": 1, "ADMIN_VERSION_AMBIGUOUS": 1, "NEED_REVIEW_ADMIN_VERSION": 1, "NO_POI_FOUND": 1, "NO_LEVEL4_FOUND": 1, "LOW_CONFIDENCE": 1}
