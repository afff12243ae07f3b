"""Gazetteer lookups: the aliases of administrative units, and the units that a text names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import norm

# Unit words and the forms they are written in.
UNIT_FORMS = {
    "quan": ["quan", "q"],
    "huyen": ["huyen", "h"],
    "thi xa": ["thi xa", "tx"],
    "thanh pho": ["thanh pho", "tp"],
    "phuong": ["phuong", "p", "f"],
    "xa": ["xa"],
    "thi tran": ["thi tran", "tt"],
}
PROVINCE_FORMS = ["tinh", "thanh pho", "tp", "t p"]
UNIT_WORD = r"^(thanh pho|tinh|quan|huyen|thi xa|thi tran|phuong|xa)\s+(?=\S)"
# Words after which a bare name is no unit, and those of them that a ward's name may follow.
BLOCKING = [
    "thon", "ap", "xom", "ban", "buon", "khu", "kp", "tdp", "to", "duong", "pho", "ngo", "ngach", "hem", "so", "sn", "cau", "cho", "doi",
    "phuong", "xa", "tt", "tx",
]
BEFORE_WARDS = ["phuong", "xa", "tt", "tx"]
# Further names of provinces, by their unit number.
SPECIAL = {
    "79": ["tp hcm", "tphcm", "hcm", "hcmc", "sai gon", "sg", "ho chi minh", "hochiminh"],
    "01": ["ha noi", "hn"],
    "48": ["da nang"],
    "77": ["ba ria vung tau", "brvt", "vung tau"],
    "46": ["thua thien hue", "tp hue", "thanh pho hue"],
}
BROADCAST_ALIASES = 200_000  # aliases are short: some 20 MB at most


def number_forms(base: Column) -> Column:
    """A numeric name as written, without and with a leading zero; other names alone."""
    bare = F.coalesce(base.cast("decimal(38,0)").cast("string"), base)
    padded = F.when(F.length(bare) < 2, F.lpad(bare, 2, "0")).otherwise(bare)
    return F.when(base.rlike(r"^\d+$"), F.array_distinct(F.array(base, bare, padded))).otherwise(F.array(base))


def aliases(units: DataFrame) -> DataFrame:
    """(uid, alias, strong) of units(uid, name, kind); kind 'province' or another.

    Strong: the full name and its base after every form of its unit word; weak: the bare base (never a mere number), and
    a province's without blanks. Null and empty names give no rows.
    """
    table = F.create_map(*[x for word, forms in UNIT_FORMS.items() for x in (F.lit(word), F.array(*map(F.lit, forms)))])
    rows = units.select("uid", "kind", norm(F.col("name")).alias("_n")).where("_n <> ''")
    rows = rows.withColumn("_word", F.regexp_extract("_n", UNIT_WORD, 1)).withColumn("_base", F.regexp_replace("_n", UNIT_WORD, ""))
    province, number = F.col("kind") == "province", F.col("_base").rlike(r"^\d+$")
    own = F.coalesce(F.try_element_at(table, F.col("_word")), F.when(F.col("_word") != "", F.array("_word")).otherwise(F.array().cast("array<string>")))
    forms = F.when(province, F.array(*map(F.lit, PROVINCE_FORMS))).otherwise(own)
    bases = F.when(province, F.array("_base")).otherwise(number_forms(F.col("_base")))
    spaced = F.flatten(F.transform(forms, lambda f: F.transform(bases, lambda b: F.concat(f, F.lit(" "), b))))
    short = F.when(number & ~province, F.filter(forms, lambda f: F.length(f) == 1)).otherwise(F.array().cast("array<string>"))
    glued = F.flatten(F.transform(short, lambda f: F.transform(bases, lambda b: F.concat(f, b))))
    joined = F.when(province & F.contains("_base", F.lit(" ")) & (F.length("_base") >= 6), F.array(F.replace("_base", F.lit(" "), F.lit(""))))
    weak = F.when(province | ~number, F.concat(F.array("_base"), F.coalesce(joined, F.array().cast("array<string>"))))
    each = lambda names, strong: F.transform(F.array_distinct(names), lambda a: F.struct(a.alias("alias"), F.lit(strong).alias("strong")))
    found = F.concat(each(F.concat(F.array("_n"), spaced, glued), True), F.coalesce(each(weak, False), F.array().cast("array<struct<alias:string,strong:boolean>>")))
    return rows.select("uid", F.inline(found))


def special_aliases(units: DataFrame) -> DataFrame:
    """(uid, alias, strong) of the provinces among units(uid, kind) that go by further names, all of them strong."""
    table = F.create_map(*[x for uid, names in SPECIAL.items() for x in (F.lit(uid), F.array(*map(F.lit, names)))])
    known = units.where("kind = 'province'").select("uid", F.explode(F.try_element_at(table, F.col("uid").cast("string"))).alias("alias"))
    return known.withColumn("strong", F.lit(True))


def blocked(before: Column, second: Column, ward: bool) -> Column:
    """Does the word before a bare name (and the one before that) make it part of something else?"""
    city = (before == "pho") & second.endswith("thanh")
    words = [w for w in BLOCKING if not (ward and w in BEFORE_WARDS)]
    return F.coalesce(before.isin(words) | before.rlike(r"^\d+$"), F.lit(False)) & ~F.coalesce(city, F.lit(False))


def named_units(records: DataFrame, names: DataFrame, most_words: int = 6, ward: bool = False) -> DataFrame:
    """(row_id, uid, score, pos, words): every unit that a text of records(row_id, text) names, at its last place.

    names: (uid, alias, strong). Strong aliases score 2 and are preferred to weak ones, which score 1; a unit followed
    by 'cu' scores 3, by 'moi' 0. pos counts words. An equi-join of word windows with aliases of at most `most_words`
    words; the aliases are broadcast only where they are few, by count. Null and empty texts name nothing. Only the last
    place of an alias counts: a weak one that follows a blocking word or a number there names nothing (ward: a ward's
    may follow another unit word).
    """
    words = records.select("row_id", F.split(norm(F.col("text")), " ").alias("_w"))
    gram = lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(most_words), F.size("_w") - i)), lambda k: F.struct(
        i.alias("pos"), k.alias("words"), F.array_join(F.slice("_w", i + 1, k), " ").alias("alias"), F.get("_w", i + k).alias("_after"),
        F.get("_w", i - 1).alias("_before"), F.get("_w", i - 2).alias("_second")))
    grams = words.select("row_id", F.inline(F.flatten(F.transform(F.sequence(F.lit(0), F.size("_w") - 1), gram))))
    few = names.limit(BROADCAST_ALIASES + 1).count() <= BROADCAST_ALIASES
    hits = grams.join(F.broadcast(names) if few else names, "alias")
    last = hits.groupBy("row_id", "uid", "alias", "strong").agg(F.max(F.struct("pos", "words", "_after", "_before", "_second")).alias("l")).select("row_id", "uid", "strong", "l.*")
    free = last.where(F.col("strong") | ~blocked(F.col("_before"), F.col("_second"), ward))
    best = free.groupBy("row_id", "uid").agg(F.max(F.struct("strong", "pos", "words", "_after")).alias("b"))
    score = F.when(F.col("b._after") == "cu", 3).when(F.col("b._after") == "moi", 0).otherwise(F.when(F.col("b.strong"), 2).otherwise(1))
    return best.select("row_id", "uid", score.alias("score"), "b.pos", "b.words")


def best_unit(found: DataFrame, units: DataFrame, by_position: bool = False) -> DataFrame:
    """(row_id, uid): the unit of the highest score, then the longest or (by_position) the last; ties to the smallest `ord` of units(uid, ord)."""
    order = ["score", "pos", "words"] if by_position else ["score", "words", "pos"]
    ranked = found.join(units.select("uid", "ord"), "uid").withColumn("_first", -F.col("ord"))
    return ranked.groupBy("row_id").agg(F.max_by("uid", F.struct(*order, "_first")).alias("uid"))


# What is noted of units that no text names outright.
PROVINCE_INFERRED, DISTRICT_INFERRED = "suy ra tỉnh/TP từ quận/huyện", "suy ra quận/huyện từ phường/xã"
NO_PROVINCE, NO_DISTRICT, NO_WARD = "không tìm thấy tỉnh/TP trong địa chỉ", "không tìm thấy quận/huyện", "không tìm thấy phường/xã"


def catalogue(provinces: DataFrame, districts: DataFrame, wards: DataFrame) -> DataFrame:
    """(alias, strong, level, uid, parent, province, ord, base, name) of all units; parent and province are uids as strings.

    provinces are (uid, name, ord); districts and wards have parent as well. Provinces go by their further names too.
    """
    text = lambda c: F.col(c).cast("string").alias(c)
    above = districts.select(F.col("uid").cast("string").alias("parent"), F.col("parent").cast("string").alias("province"))
    plain = lambda units, *more: units.select(text("uid"), "name", "ord", *more)
    levels = {
        "province": plain(provinces).withColumn("parent", F.lit(None).cast("string")).withColumn("province", F.col("uid")),
        "district": plain(districts, text("parent")).withColumn("province", F.col("parent")),
        "ward": plain(wards, text("parent")).join(above, "parent"),
    }
    out = None
    for level, units in levels.items():
        units = units.select("uid", "name", "ord", "parent", "province").withColumn("kind", F.lit(level))
        names = aliases(units).unionByName(special_aliases(units)).distinct()
        key = norm(F.col("name"))
        rows = names.join(units, "uid").select("alias", "strong", F.col("kind").alias("level"), "uid", "parent", "province", "ord", F.regexp_replace(key, UNIT_WORD, "").alias("base"), key.alias("name"))
        out = rows if out is None else out.unionAll(rows)
    return out


def matched_units(records: DataFrame, names: DataFrame, most_words: int = 6) -> DataFrame:
    """(row_id, province, district, ward, note): the units that a text names, each sought only inside the one above it.

    names is a catalogue(). A province is the best named one, the last of equal scores. A district is sought in it, before
    it where possible and not in its words; without a province, districts of one base name and one province give both. A
    ward is sought in the district; else among the province's, where its name has one district, which it then gives.
    Texts that name nothing have nulls, as have null and empty ones; row_id is unique. The places that a record's aliases
    have are gathered by record (as many as its text holds), and everything else is done inside the row: one shuffle.
    """
    words = records.select("row_id", F.split(norm(F.col("text")), " ").alias("_w"))
    gram = lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(most_words), F.size("_w") - i)), lambda k: F.struct(
        i.alias("pos"), k.alias("words"), F.array_join(F.slice("_w", i + 1, k), " ").alias("alias"), F.get("_w", i + k).alias("_after"),
        F.get("_w", i - 1).alias("_before"), F.get("_w", i - 2).alias("_second")))
    grams = words.select("row_id", F.inline(F.flatten(F.transform(F.sequence(F.lit(0), F.size("_w") - 1), gram))))
    last = grams.groupBy("row_id", "alias").agg(F.max(F.struct("pos", "words", "_after", "_before", "_second")).alias("l")).select("row_id", "alias", "l.*")
    few = names.limit(BROADCAST_ALIASES + 1).count() <= BROADCAST_ALIASES
    hits = last.join(F.broadcast(names) if few else names, "alias")
    stop = F.when(F.col("level") == "ward", blocked(F.col("_before"), F.col("_second"), True)).otherwise(blocked(F.col("_before"), F.col("_second"), False))
    score = F.when(F.col("_after") == "cu", 3).when(F.col("_after") == "moi", 0).otherwise(F.when(F.col("strong"), 2).otherwise(1))
    hits = hits.where(F.col("strong") | ~stop).withColumn("chars", F.char_length("alias")).withColumn("score", score)
    hit = F.struct("level", "uid", "parent", "province", "ord", "base", "name", "strong", "pos", "words", "chars", "score")
    rows = records.select("row_id").join(hits.groupBy("row_id").agg(F.collect_list(hit).alias("_h")), "row_id", "left")
    rows = rows.withColumn("_h", F.coalesce("_h", F.array().cast(hits.select(F.array(hit).alias("a")).schema["a"].dataType)))

    def units(level, inside=None, outside=()):
        """A unit's one place: its last strong one that lies outside the spans, else its last weak one."""
        fits = lambda h: (h["level"] == level) & (F.lit(True) if inside is None else inside(h))
        for span in outside:
            fits = (lambda f, s: lambda h: f(h) & ~F.coalesce((s["pos"] < h["pos"] + h["words"]) & (h["pos"] < s["pos"] + s["words"]), F.lit(False)))(fits, span)
        mine = F.filter("_h", fits)
        rank = lambda h: F.struct(h["strong"], h["pos"], h["chars"])
        return F.filter(mine, lambda h: ~F.exists(mine, lambda g: (g["uid"] == h["uid"]) & (rank(g) > rank(h))))

    def best(found, *order):
        """The first by the order, then by the catalogue's."""
        ranked = F.transform(found, lambda h: F.struct(*[h[c].alias(c) for c in order], (-h["ord"]).alias("first"), h.alias("h")))
        return F.array_max(ranked)["h"]

    def in_front(found, at):
        before = F.filter(found, lambda h: h["pos"] < at)
        return F.when((at >= 0) & (F.size(before) > 0), before).otherwise(found)

    only = lambda found, field: F.size(F.array_distinct(F.transform(found, lambda h: h[field]))) == 1
    p, d, w = F.col("_p"), F.col("_d"), F.col("_o")
    rows = rows.withColumn("_p", best(units("province"), "score", "pos", "chars")).withColumn("_at", F.coalesce(p["pos"], F.lit(-1)))
    rows = rows.withColumn("_in", best(in_front(units("district", lambda h: h["parent"] == p["uid"], [p]), F.col("_at")), "score", "chars", "pos"))
    rows = rows.withColumn("_all", F.filter(units("district"), lambda h: (h["score"] >= 2) | ((h["score"] == 1) & (h["chars"] >= 6))))
    rows = rows.withColumn("_any", best(F.col("_all"), "score", "pos", "chars"))
    sure = p.isNull() & only(F.filter("_all", lambda h: h["base"] == F.col("_any")["base"]), "parent")
    rows = rows.withColumn("_guess", F.coalesce(sure, F.lit(False))).withColumn("_d", F.when(F.col("_guess"), F.col("_any")).otherwise(F.col("_in")))
    rows = rows.withColumn("_province", F.when(F.col("_guess"), d["parent"]).otherwise(p["uid"])).withColumn("_at", F.coalesce(d["pos"], p["pos"], F.lit(-1)))
    rows = rows.withColumn("_o", best(in_front(units("ward", lambda h: h["parent"] == d["uid"], [p, d]), F.col("_at")), "score", "chars", "pos"))
    rows = rows.withColumn("_all", in_front(units("ward", lambda h: h["province"] == F.col("_province"), [p, d]), F.col("_at")))
    rows = rows.withColumn("_any", best(F.col("_all"), "score", "chars", "pos"))
    # a district that was found has no such ward, so only a missing one can be filled
    sure = w.isNull() & d.isNull() & only(F.filter("_all", lambda h: h["name"] == F.col("_any")["name"]), "parent")
    rows = rows.withColumn("_told", F.coalesce(sure, F.lit(False)))
    rows = rows.withColumn("ward", F.when(F.col("_told"), F.col("_any")["uid"]).otherwise(w["uid"]))
    rows = rows.withColumn("district", F.when(F.col("_told"), F.col("_any")["parent"]).otherwise(d["uid"])).withColumn("province", F.col("_province"))
    known = F.col("province").isNotNull()
    notes = [F.when(F.col("_guess"), PROVINCE_INFERRED), F.when(F.col("_told"), DISTRICT_INFERRED), F.when(~known, NO_PROVINCE)]
    notes += [F.when(known & F.col("district").isNull(), NO_DISTRICT), F.when(known & F.col("ward").isNull(), NO_WARD)]
    return rows.select("row_id", "province", "district", "ward", F.array_join(F.array_compact(F.array(*notes)), "; ").alias("note"))
