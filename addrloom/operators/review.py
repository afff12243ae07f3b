"""What becomes of a parsed record: score, route, reasons to review or drop it, and the counts of a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.address import has_old_or_new
from ..functions.text import norm

# What each flag costs (others 0.03), where it sends a record, and how it is explained.
PENALTIES = {
    "ORDER_CODE_REMOVED": 0.0, "MULTIPLE_POI_FOUND": 0.12, "MULTIPLE_LEVEL4_FOUND": 0.08, "RAW_ADMIN_CONFLICT_WITH_COLUMNS": 0.2,
    "ONLY_STREET_LEVEL_FOUND": 0.05, "ONLY_ADMIN_UNITS_FOUND": 0.08, "LOW_CONFIDENCE": 0.25, "AMBIGUOUS_HOUSE_TOKEN": 0.12,
    "INFERRED_LEVEL4_NO_KEYWORD": 0.2, "UNKNOWN_BEFORE_ADMIN": 0.2, "HOUSE_CODE_STREET_AMBIGUOUS": 0.08,
    "LEVEL4_LONG_NAME_AMBIGUOUS": 0.08, "POI_MULTI_OBJECT_AMBIGUOUS": 0.08,
}
TO_MODEL = [
    "INFERRED_LEVEL4_NO_KEYWORD", "POSSIBLE_POI_MISSED", "POSSIBLE_LEVEL4_MISSED", "MULTIPLE_POI_FOUND", "MULTIPLE_LEVEL4_FOUND",
    "POI_STREET_BOUNDARY_AMBIGUOUS", "LEVEL4_ADMIN_BOUNDARY_AMBIGUOUS", "LEVEL4_NAME_BOUNDARY_AMBIGUOUS", "POI_LEVEL4_OVERLAP",
    "STREET_LEVEL4_OVERLAP", "UNPREFIXED_STREET_FROM_HOUSE_NUMBER", "UNPREFIXED_STREET_AMBIGUOUS_DROPPED", "HOUSE_NUMBER_BIS_AMBIGUOUS",
    "HOUSE_CODE_STREET_AMBIGUOUS", "LEVEL4_LONG_NAME_AMBIGUOUS", "LEVEL4_MISSING_UNIT_PREFIX", "POI_ADMIN_OVERLAP_TRIMMED",
    "POI_ADMIN_TAIL_TRIMMED", "POI_MULTI_OBJECT_AMBIGUOUS", "STREET_NAME_SUSPICIOUS", "EMPTY_RESULT_RAW_HAS_CONTENT", "STRICT_DROPPED_DETAIL",
    "RAW_BAD_SPELLING_DROPPED_DETAIL", "ONLY_STREET_LEVEL_FOUND",
]
TO_PERSON = [
    "ADMIN_CONFLICT_HIGH_RISK", "MISSING_ADMIN_COLUMN", "MULTIPLE_ADDRESS_BLOCKS", "NEED_REVIEW_ADMIN_VERSION", "RAW_HAS_OLD_AND_NEW_ADDRESS",
    "UNKNOWN_LONG_SEGMENT_BEFORE_ADMIN",
]
WITH_FLAGS = [
    "ADMIN_FILLED_FROM_RAW", "ADMIN_VERSION_AMBIGUOUS", "INVALID_POI_BLACKLIST", "OLD_NEW_ADMIN_CONFLICT", "RAW_ADMIN_CONFLICT_WITH_COLUMNS",
    "RAW_CONTAINS_NAY_THUOC", "TRU_SO_DETECTED", "UNKNOWN_BEFORE_ADMIN",
]
REASONS = {
    "MISSING_ADMIN_COLUMN": "Thiếu/không khớp cột hành chính",
    "LLM_SKIPPED_QUOTA": "Dòng mơ hồ chưa qua LLM (hết quota)",
    "STRICT_DROPPED_DETAIL": "Rule loại chi tiết vì nghi vấn",
    "RULE_DETAIL_DROPPED_AFTER_LLM_REJECT": "LLM không xác nhận được chi tiết của rule",
    "LLM_NO_VALID_DETAIL": "LLM không tìm được chi tiết hợp lệ",
    "NEED_REVIEW_ADMIN_VERSION": "Địa chỉ có yếu tố cũ/mới, cần review",
    "RAW_HAS_OLD_AND_NEW_ADDRESS": "Raw chứa cả địa chỉ cũ và mới",
    "RAW_ADMIN_CONFLICT_WITH_COLUMNS": "Raw mâu thuẫn với cột hành chính",
    "MULTIPLE_ADDRESS_BLOCKS": "Raw chứa nhiều khối địa chỉ",
    "UNKNOWN_LONG_SEGMENT_BEFORE_ADMIN": "Cụm dài không nhận diện được",
    "LLM_MISSING_IN_RESPONSE": "LLM bỏ sót dòng trong phản hồi (đã retry, vẫn thiếu)",
    "LLM_BATCH_ERROR": "Lỗi khi gọi LLM, đang dùng kết quả rule",
    "FUZZY_ADMIN_TRIMMED": "Đã cắt admin gõ sai khỏi tên đường (đối chiếu địa chỉ gốc)",
    "ADMIN_FILLED_FROM_RAW": "Cột hành chính trống, đã bóc từ địa chỉ thô - cần xác nhận",
}
NO_TEXT, NO_DETAIL = "Địa chỉ thô để trống", "Không bóc được POI/tên đường/cấp 4 từ địa chỉ thô"
NOT_ASKED, ASK_OFF = "; dòng mơ hồ chưa qua LLM (hết quota)", "; dòng mơ hồ cần LLM (Cerebras chưa bật)"
STATS = {
    "input_n": "Tổng dòng đầu vào", "duplicates": "Dòng trùng lặp đã bỏ", "unique_n": "Dòng đưa vào xử lý (sau lọc trùng)",
    "removed": "Dòng bị loại (không bóc được thông tin)", "output_n": "Dòng xuất ra (đã tách thành phần)", "full_admin": "Dòng đủ cấp hành chính",
    "mapped_new": "Dòng địa chỉ 2 cấp mới (sau sáp nhập)", "review_n": "Dòng cần kiểm tra tay",
}
MAIN_LEVEL4 = ["thon", "ap", "khu pho", "khoi", "ban", "buon", "soc", "lang", "khom", "khu", "tieu khu", "cum dan cu"]


def _flags(flags: Column) -> Column:
    return F.coalesce(flags, F.array().cast("array<string>"))


def _any(flags: Column, these: list[str]) -> Column:
    return F.exists(_flags(flags), lambda f: f.isin(these))


def _given(value: Column) -> Column:
    return F.coalesce(value, F.lit("")) != ""


def result_score(poi: Column, level4: Column, flags: Column) -> Column:
    """1 less 0.05 for a missing POI and level 4 each and every flag's penalty, within 0 and 1, to three places."""
    table = F.create_map(*[F.lit(x) for pair in PENALTIES.items() for x in pair])
    start = F.lit(1.0) - F.when(_given(poi), 0.0).otherwise(0.05) - F.when(_given(level4), 0.0).otherwise(0.05)
    left = F.aggregate(_flags(flags), start, lambda acc, f: acc - F.coalesce(F.try_element_at(table, f), F.lit(0.03)))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.round(left, 3)))


def route(flags: Column, raw: Column) -> Column:
    """Where a record goes after the rules; null flags are none, a null raw text is empty."""
    by_hand = _any(flags, TO_PERSON) | has_old_or_new(raw)
    found = F.when(_any(flags, TO_MODEL), "SEND_LLM").when(by_hand, "REVIEW_MANUAL").when(_any(flags, WITH_FLAGS), "ACCEPT_RULE_WITH_FLAGS")
    return found.otherwise("ACCEPT_RULE")


def review_reasons(flags: Column) -> Column:
    """The explanations of a record's flags in their fixed order, joined by '; '; '' where none asks for a review."""
    each = [F.when(F.array_contains(_flags(flags), name), F.lit(label)) for name, label in REASONS.items()]
    return F.array_join(F.array_compact(F.array(*each)), "; ")


def drop_reason(raw: Column, flags: Column, has_detail: Column, model_on: bool) -> Column:
    """Why a record without POI, street and level 4 is dropped; null where it has one."""
    why = F.when(F.coalesce(raw, F.lit("")).rlike(r"(?U)^\s*$"), NO_TEXT).when(F.array_contains(_flags(flags), "LLM_SKIPPED_QUOTA"), NO_DETAIL + NOT_ASKED)
    if not model_on:
        why = why.when(_any(flags, TO_MODEL), NO_DETAIL + ASK_OFF)
    return F.when(~F.coalesce(has_detail, F.lit(False)), why.otherwise(NO_DETAIL))


def run_stats(results: DataFrame) -> DataFrame:
    """The one row of a run's counts over results(row_id, first, flags, has_detail, parts, ward, district, province).

    `first` points at a duplicate's first row; `parts` counts the rows that a record is written as. Duplicates count as
    input only. A record without details is removed; one with a ward and a province, and a district or the new format,
    counts as complete with all its parts. One aggregation, combined before the shuffle; an empty table gives zeros.
    """
    own, detail = F.col("first").eqNullSafe(F.col("row_id")), F.coalesce("has_detail", F.lit(False))
    new = F.array_contains(_flags(F.col("flags")), "ADMIN_NEW_FORMAT")
    complete = _given(F.col("ward")) & _given(F.col("province")) & (_given(F.col("district")) | new)
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("parts"))), F.lit(0)).cast("long")
    return results.agg(
        F.count("*").alias("input_n"), F.count_if(~own).alias("duplicates"), F.count_if(own).alias("unique_n"),
        F.count_if(own & ~detail).alias("removed"), total(own & detail).alias("output_n"), total(own & detail & complete).alias("full_admin"),
        F.count_if(own & new).alias("mapped_new"), F.count_if(own & (review_reasons(F.col("flags")) != "")).alias("review_n"),
    )


def stats_sheet(stats: DataFrame) -> DataFrame:
    """(position, label, value): the counts as they are reported."""
    rows = [F.struct(F.lit(i).alias("position"), F.lit(label).alias("label"), F.col(name).cast("long").alias("value")) for i, (name, label) in enumerate(STATS.items())]
    return stats.select(F.inline(F.array(*rows)))


def level4_primary(items: Column) -> Column:
    """struct(primary, sub) of an array of structs (type, value): the first of a main type, else the first; the others by '; '."""
    main = F.filter(items, lambda x: x["type"].isin(MAIN_LEVEL4))
    primary = F.coalesce(F.get(main, F.lit(0))["value"], F.get(items, F.lit(0))["value"], F.lit(""))
    others = F.transform(F.filter(items, lambda x: x["value"] != primary), lambda x: x["value"])
    return F.struct(primary.alias("primary"), F.coalesce(F.array_join(others, "; "), F.lit("")).alias("sub"))


def request_pointer(rows: DataFrame) -> DataFrame:
    """rows(row_id, raw, ward, district, province, ...) plus `first`: the smallest row_id of equal normalised addresses.

    Rows whose four fields are all empty are their own first. The key travels as its SHA-256 and is pre-aggregated.
    """
    fields = [norm(F.col(c)) for c in ("raw", "ward", "district", "province")]
    text = F.concat_ws("\t", *fields)
    keyed = rows.withColumn("_key", F.when(F.btrim(text, F.lit("\t")) != "", F.sha2(text, 256)))
    firsts = keyed.where("_key is not null").groupBy("_key").agg(F.min("row_id").alias("first"))
    return keyed.join(firsts, "_key", "left").select(*rows.columns, F.coalesce("first", "row_id").alias("first"))
