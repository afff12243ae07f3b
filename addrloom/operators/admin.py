"""Administrative columns of address records: catalogue lookup, migration to the new units, snapping, labels, sort keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import base_name, norm

# The labels of a record's confidence.
CHECK, KNOWN_PHONE, HIGH, MEDIUM, LOW = "Cần kiểm tra", "Cao (SĐT khách cũ)", "Cao", "Trung bình", "Thấp"
# The unit words that sorting passes over.
SORT_PREFIX = r"^(thanh pho|thi tran|thi xa|phuong|quan|huyen|tinh|xa|tp|tt|tx) "


def _catalogue(units: DataFrame, level: str, parent: str | None) -> DataFrame:
    """The first unit, by ord, of every base name (under its parent)."""
    key = [base_name(F.col("name")).alias(f"_{level}")] + ([F.col("parent").alias(parent)] if parent else [])
    first = F.min_by(F.struct("uid", "name"), "ord")
    return units.groupBy(*key).agg(first.alias("_u")).select(f"_{level}", *([parent] if parent else []), F.col("_u.uid").alias(f"{level}_uid"), F.col("_u.name").alias(f"{level}_name"))


def lookup_units(rows: DataFrame, provinces: DataFrame, districts: DataFrame, wards: DataFrame) -> DataFrame:
    """rows(ward, district, province, ...) plus <level>_uid and <level>_name of the units that the labels name.

    Units are (uid, name, ord) and, below the province, parent. A district is sought in its province only and a ward in
    its district. Empty, null and unknown labels give nulls. Three equi-joins with catalogues of one row a key.
    """
    out = rows
    for level, units, parent in (("province", provinces, None), ("district", districts, "province_uid"), ("ward", wards, "district_uid")):
        key = F.when(base_name(F.col(level)) != "", base_name(F.col(level)))
        out = out.withColumn(f"_{level}", key).join(_catalogue(units, level, parent), [f"_{level}", *([parent] if parent else [])], "left").drop(f"_{level}")
    levels = [f"{level}_{what}" for level in ("province", "district", "ward") for what in ("uid", "name")]
    return out.select(*rows.columns, *levels)


def migrated(found: DataFrame, ward_moves: DataFrame, province_moves: DataFrame) -> DataFrame:
    """found(province_uid, ward_uid, ...) plus ward_new and province_new.

    ward_moves (uid, ward_new, province_new) go first; province_moves (uid, province_new) serve rows without one. Each uid
    moves once.
    """
    wards = ward_moves.select(F.col("uid").alias("ward_uid"), "ward_new", F.col("province_new").alias("_by_ward"), F.lit(True).alias("_moved"))
    provinces = province_moves.select(F.col("uid").alias("province_uid"), F.col("province_new").alias("_by_province"))
    both = found.join(wards, "ward_uid", "left").join(provinces, "province_uid", "left")
    return both.select(*found.columns, "ward_new", F.when(F.col("_moved"), F.col("_by_ward")).otherwise(F.col("_by_province")).alias("province_new"))


def _one_less(text: Column) -> Column:
    """A text and all that it gives without one character: texts at most one edit apart share one of these."""
    cut = F.transform(F.sequence(F.lit(1), F.char_length(text)), lambda i: F.concat(F.left(text, i - 1), F.substr(text, i + 1)))
    return F.when(F.char_length(text) > 0, F.array_distinct(F.array_append(cut, text))).otherwise(F.array(text))


def snapped(names: DataFrame, units: DataFrame) -> DataFrame:
    """(row_id, uid) of names(row_id, name): the first unit of that base name, else the one base name a single edit away.

    units are (uid, name, ord). Names near several base names, empty and unknown ones give no row; row_id is unique. An
    equi-join on shortened names, so no name meets units that differ from it by more than two edits.
    """
    wanted = names.select("row_id", base_name(F.col("name")).alias("q")).where("q <> ''")
    known = units.select(base_name(F.col("name")).alias("b"), "uid", "ord").groupBy("b").agg(F.min_by("uid", "ord").alias("uid"))
    probe = wanted.select("row_id", "q", F.explode(_one_less(F.col("q"))).alias("_v"))
    near = probe.join(known.select("b", "uid", F.explode(_one_less(F.col("b"))).alias("_v")), "_v").where(F.levenshtein("q", "b", 1) >= 0)
    best = near.groupBy("row_id").agg(F.max(F.when(F.col("q") == F.col("b"), F.col("uid"))).alias("_same"), F.min("b").alias("_low"), F.max("b").alias("_high"), F.min_by("uid", "b").alias("uid"))
    return best.where("_same is not null or _low = _high").select("row_id", F.coalesce("_same", "uid").alias("uid"))


def confidence_label(ward: Column, province: Column, fuzzy: Column, phone_hit: Column, conflict: Column) -> Column:
    """How far a record's units can be trusted; nulls count as empty or false."""
    given = lambda c: F.coalesce(c, F.lit("")) != ""
    true = lambda c: F.coalesce(c, F.lit(False))
    label = F.when(true(conflict), CHECK).when(true(phone_hit), KNOWN_PHONE).when(given(ward) & ~true(fuzzy), HIGH)
    return label.when(given(ward) | given(province), MEDIUM).otherwise(LOW)


def sort_text(value: Column) -> Column:
    """A text whose plain order is the natural order of unit names: no accents, no unit word, numbers by size, empty last."""
    parts = F.regexp_extract_all(F.regexp_replace(norm(value), SORT_PREFIX, ""), F.lit(r"\d+|\D+"), F.lit(0))
    bare = lambda p: F.regexp_replace(p, "^0+(?=.)", "")
    number = lambda p: F.concat(F.lit("0"), F.lpad(F.char_length(bare(p)).cast("string"), 6, "0"), bare(p))
    keys = F.transform(parts, lambda p: F.when(p.rlike(r"^\d"), number(p)).otherwise(F.concat(F.lit("1"), p)))
    return F.when(F.size(keys) > 0, F.array_join(keys, "\t")).otherwise("~")


def sort_key(province: Column, district: Column, ward: Column) -> Column:
    """What rows are ordered by: province, then district, then ward."""
    return F.struct(sort_text(province).alias("province"), sort_text(district).alias("district"), sort_text(ward).alias("ward"))


# Fixed value: the unit words that a flexible key leaves out.
FLEX_PREFIX = r"^(thanh pho|thi tran|thi xa|phuong|tinh|xa|tp|tt|tx)( |$)"
# A record's fields that a phone directory can fill, and what is noted.
ENTRY_FIELDS = ["street", "hamlet", "ward", "district", "province", "ward_new", "province_new"]
OTHER_PROVINCE, FROM_DIRECTORY, FILLED = "SĐT trùng khách cũ nhưng khác tỉnh - cần kiểm tra", "đối chiếu SĐT khách cũ", " (bổ sung từ danh bạ)"


def flex_key(name: Column) -> Column:
    """A unit's name without accents, blanks, punctuation and its unit word; '' for a mere unit word."""
    return F.replace(F.regexp_replace(norm(name), FLEX_PREFIX, ""), F.lit(" "), F.lit(""))


def new_units(provinces: DataFrame, wards: DataFrame) -> DataFrame:
    """(_p, _w, new_ward, new_province) of the two-level catalogue: the first province of a key, and in it the first ward."""
    first = provinces.groupBy(flex_key(F.col("name")).alias("_p")).agg(F.min_by(F.struct("uid", "name"), "ord").alias("_u")).where("_p <> ''")
    first = first.select("_p", F.col("_u.uid").alias("parent"), F.col("_u.name").alias("new_province"))
    named = wards.withColumn("_w", flex_key(F.col("name"))).join(first, "parent")
    return named.groupBy("_p", "_w").agg(F.min_by(F.struct("name", "new_province"), "ord").alias("_u")).select("_p", "_w", F.col("_u.name").alias("new_ward"), F.col("_u.new_province").alias("new_province"))


def _in_new_units(rows: DataFrame, catalogue: DataFrame) -> DataFrame:
    """rows(_ward, _district, _province) with new_ward and new_province where there is no district and the pair is known."""
    asked = (F.col("_district") == "") & (F.col("_ward") != "") & (F.col("_province") != "")
    keyed = rows.withColumn("_w", F.when(asked, flex_key(F.col("_ward")))).withColumn("_p", F.when(asked, flex_key(F.col("_province"))))
    return keyed.join(catalogue, ["_p", "_w"], "left").drop("_p", "_w")


def resolved(found: DataFrame, provinces_new: DataFrame, wards_new: DataFrame) -> DataFrame:
    """found plus clean_ward, clean_district, clean_province and admin_flags.

    found has the given ward, district and province, what lookup_units made of them (<level>_name) and what the raw text
    names (parsed_ward, parsed_district, parsed_province). Catalogue names go before given ones, and the raw text only
    fills what is empty. Without a district the pair is sought among the new two-level units, before and after filling.
    provinces_new (uid, name, ord), wards_new (uid, name, ord, parent). Nulls count as empty.
    """
    levels = ["ward", "district", "province"]
    given = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    catalogue = new_units(provinces_new, wards_new)
    rows = found.select("*", *[F.coalesce(F.nullif(given(f"{v}_name"), F.lit("")), given(v)).alias(f"_{v}") for v in levels])
    rows = _in_new_units(rows, catalogue).withColumn("_new", F.col("new_ward").isNotNull())
    rows = rows.withColumn("_ward", F.coalesce("new_ward", "_ward")).drop("new_ward", "new_province")
    fills = {v: ~F.col("_new") & (F.col(f"_{v}") == "") & (given(f"parsed_{v}") != "") for v in levels}
    rows = rows.withColumn("_filled", fills["ward"] | fills["district"] | fills["province"])
    rows = rows.withColumns({f"_{v}": F.when(fills[v], given(f"parsed_{v}")).otherwise(F.col(f"_{v}")) for v in levels})
    rows = _in_new_units(rows, catalogue).withColumn("_again", F.col("_filled") & F.col("new_ward").isNotNull())
    rows = rows.withColumn("_ward", F.when(F.col("_again"), F.col("new_ward")).otherwise(F.col("_ward")))
    new = F.col("_new") | F.col("_again")
    missing = (F.col("_ward") == "") | (F.col("_province") == "") | ((F.col("_district") == "") & ~new)
    flags = [F.when(F.col("_new"), F.lit("ADMIN_NEW_FORMAT")), F.when(F.col("_filled"), F.lit("ADMIN_FILLED_FROM_RAW"))]
    flags += [F.when(F.col("_again"), F.lit("ADMIN_NEW_FORMAT")), F.when(missing, F.lit("MISSING_ADMIN_COLUMN"))]
    return rows.select(*found.columns, *[F.col(f"_{v}").alias(f"clean_{v}") for v in levels], F.array_compact(F.array(*flags)).alias("admin_flags"))


def enriched(results: DataFrame, directory: DataFrame) -> DataFrame:
    """results(phone, note, ENTRY_FIELDS, ...) filled from directory(phone, ENTRY_FIELDS), one row a phone, plus phone_hit and conflict.

    A known phone whose province differs is a conflict and fills nothing; otherwise empty fields take the directory's.
    A null phone is unknown. An equi-join; Spark broadcasts the directory where its size allows.
    """
    known = directory.where("phone is not null").select("phone", F.lit(True).alias("_known"), *[F.col(c).alias(f"_{c}") for c in ENTRY_FIELDS])
    rows = results.join(known, "phone", "left")
    given = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    found = F.coalesce("_known", F.lit(False))
    conflict = found & given("province") & given("_province") & (base_name(F.col("province")) != base_name(F.col("_province")))
    rows = rows.withColumn("conflict", conflict).withColumn("phone_hit", found & ~F.col("conflict"))
    fills = {c: F.col("phone_hit") & ~given(c) & given(f"_{c}") for c in ENTRY_FIELDS}
    any_fill = F.exists(F.array(*fills.values()), lambda x: x)
    said = F.when(F.col("conflict"), F.lit(OTHER_PROVINCE)).when(F.col("phone_hit"), F.concat(F.lit(FROM_DIRECTORY), F.when(any_fill, FILLED).otherwise("")))
    note = F.when(said.isNull(), F.col("note")).otherwise(F.concat(F.when(given("note"), F.concat("note", F.lit("; "))).otherwise(""), said))
    changed = {c: F.when(fills[c], F.col(f"_{c}")).otherwise(F.col(c)) for c in ENTRY_FIELDS} | {"note": note}
    return rows.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in results.columns], "phone_hit", "conflict")
