"""Named queries over the driver's tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import address as D
from ..functions import segments as S
from ..functions import text as T
from ..operators import admin as A
from ..operators import exchange as X
from ..operators import gazetteer as G
from ..operators import records as R
from ..operators import review as V

PENALTIES = {"SMALL": 0.05, "LARGE": 0.2, "CHEAP": 0.0}
_SQL_NORM = "trim(regexp_replace(strip_accents(replace(replace(lower(coalesce({0}, '')), 'đ', 'd'), 'Đ', 'D')), '[^a-z0-9]+', ' ', 'g'))"
QUERIES: dict = {}
ORACLES: dict = {}


def _read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


@query(f"SELECT doc_id, {_SQL_NORM.format('text')} AS norm FROM documents")
def norm_text(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select("doc_id", T.norm(F.col("text")).alias("norm"))


@query(f"SELECT p_partkey, replace({_SQL_NORM.format('p_name')}, ' ', '') AS compact FROM part")
def compact_key(spark, sf_dir):
    return _read(spark, sf_dir, "part").select("p_partkey", T.compact(F.col("p_name")).alias("compact"))


@query(f"SELECT norm, min(doc_id) AS first, count(*) AS copies FROM (SELECT doc_id, {_SQL_NORM.format('text')} AS norm FROM documents) GROUP BY norm")
def dedupe_first(spark, sf_dir):
    return R.first_of_key(norm_text(spark, sf_dir), "norm", "doc_id")


@query(f"""WITH k AS (SELECT doc_id, {_SQL_NORM.format('text')} AS norm FROM documents)
SELECT doc_id, CASE WHEN norm = '' THEN doc_id ELSE min(doc_id) OVER (PARTITION BY norm) END AS first,
  norm = '' OR doc_id = min(doc_id) OVER (PARTITION BY norm) AS is_first FROM k""")
def dup_pointer(spark, sf_dir):
    return R.pointed(norm_text(spark, sf_dir), "norm", "doc_id").select("doc_id", "first", "is_first")


@query(r"""WITH f AS (SELECT doc_id, list_transform(regexp_extract_all(coalesce(text, ''), '(?:\+?84|0)[0-9 .\-]{8,13}'),
  lambda x: regexp_replace(regexp_replace(x, '[^0-9]', '', 'g'), '^84', '0')) AS found FROM documents)
SELECT doc_id, list_filter(found, lambda d: d[1] = '0' AND len(d) BETWEEN 10 AND 11)[1] AS phone FROM f
WHERE len(list_filter(found, lambda d: d[1] = '0' AND len(d) BETWEEN 10 AND 11)) > 0""")
def phone_extract(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select("doc_id", T.first_phone(F.col("text")).alias("phone")).where("phone is not null")


@query("SELECT c_custkey, n FROM customer JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON c_custkey = o_custkey")
def cache_hit(spark, sf_dir):
    cache = _read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return R.split_by_cache(_read(spark, sf_dir, "customer").select("c_custkey"), cache, "c_custkey")[0]


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def cache_miss(spark, sf_dir):
    cache = _read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")).distinct()
    return R.split_by_cache(_read(spark, sf_dir, "customer").select("c_custkey"), cache, "c_custkey")[1]


@query("""SELECT user_id, arg_max(value, event_id) FILTER (WHERE value > 5) AS value, arg_max(event_type, event_id) AS event_type, count(*) AS n
FROM events GROUP BY user_id""")
def directory_learn(spark, sf_dir):
    rows = _read(spark, sf_dir, "events").withColumn("value", F.expr("case when value > 5 then value end"))
    return R.fold_last(rows, "user_id", "event_id", ["value", "event_type"])


@query("""SELECT c_mktsegment, min(n_regionkey) AS n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey
GROUP BY 1 HAVING count(DISTINCT n_regionkey) = 1
UNION ALL SELECT n_name, n_regionkey FROM nation""")
def infer_parent_unique(spark, sf_dir):
    nation = _read(spark, sf_dir, "nation")
    named = _read(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    rows = named.select("c_mktsegment", "n_regionkey").union(nation.select("n_name", "n_regionkey"))
    return R.unique_parent(rows, "c_mktsegment", "n_regionkey")


@query("SELECT a.n_name AS l, b.n_name AS r, levenshtein(a.n_name, b.n_name)::INTEGER AS distance FROM nation a JOIN nation b ON levenshtein(a.n_name, b.n_name) <= 1 AND a.n_name[1] = b.n_name[1]")
def fuzzy_blocked_join(spark, sf_dir):
    names = _read(spark, sf_dir, "nation").select("n_name")
    return R.fuzzy_pairs(names.toDF("l"), names.toDF("r"), 1)


_FLAGS = "list_filter([CASE WHEN p_size < 10 THEN 'SMALL' END, CASE WHEN p_size > 40 THEN 'LARGE' END, CASE WHEN p_retailprice < 950 THEN 'CHEAP' END, CASE WHEN p_partkey % 7 = 0 THEN 'OTHER' END], lambda x: x IS NOT NULL)"


def _flagged(spark, sf_dir):
    flags = F.array(*[F.when(F.expr(c), F.lit(n)) for c, n in (("p_size < 10", "SMALL"), ("p_size > 40", "LARGE"), ("p_retailprice < 950", "CHEAP"), ("p_partkey % 7 = 0", "OTHER"))])
    return _read(spark, sf_dir, "part").select("p_partkey", F.array_compact(flags).alias("flags"))


@query(f"""SELECT p_partkey, round(greatest(0.0::DOUBLE, 1.0::DOUBLE - list_sum(list_concat([0.0::DOUBLE], list_transform({_FLAGS},
  lambda f: CASE f WHEN 'SMALL' THEN 0.05::DOUBLE WHEN 'LARGE' THEN 0.2::DOUBLE WHEN 'CHEAP' THEN 0.0::DOUBLE ELSE 0.03::DOUBLE END)))), 3) AS score FROM part""")
def flag_score(spark, sf_dir):
    return _flagged(spark, sf_dir).select("p_partkey", R.flag_score(F.col("flags"), PENALTIES).alias("score"))


@query(f"""SELECT p_partkey, CASE WHEN list_contains({_FLAGS}, 'LARGE') THEN 'SEND_LLM' WHEN list_contains({_FLAGS}, 'OTHER') THEN 'REVIEW_MANUAL'
  WHEN list_contains({_FLAGS}, 'SMALL') THEN 'ACCEPT_RULE_WITH_FLAGS' ELSE 'ACCEPT_RULE' END AS route FROM part""")
def route_class(spark, sf_dir):
    has = lambda f: F.array_contains("flags", f)
    route = F.when(has("LARGE"), "SEND_LLM").when(has("OTHER"), "REVIEW_MANUAL").when(has("SMALL"), "ACCEPT_RULE_WITH_FLAGS").otherwise("ACCEPT_RULE")
    return _flagged(spark, sf_dir).select("p_partkey", route.alias("route"))


@query("SELECT c_custkey, floor((row_number() OVER (ORDER BY c_custkey) - 1) / 5)::BIGINT AS batch FROM customer QUALIFY row_number() OVER (ORDER BY c_custkey) <= 150")
def batch_assign(spark, sf_dir):
    return R.batches(_read(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", 5, 150)


@query("SELECT o_orderpriority AS label, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'F') AS finished FROM orders GROUP BY 1")
def label_histogram(spark, sf_dir):
    return _read(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("label")).agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("finished"))


@query("""SELECT p_partkey, (row_number() OVER (PARTITION BY p_partkey ORDER BY o, i) - 1)::BIGINT AS position, kind, value FROM (
  SELECT p_partkey, 0 AS o, 'words' AS kind, unnest(string_split(p_name, ' ')) AS value, generate_subscripts(string_split(p_name, ' '), 1) AS i FROM part
  UNION ALL SELECT p_partkey, 1, 'brand', p_brand, 1 FROM part)""")
def component_explode(spark, sf_dir):
    rows = _read(spark, sf_dir, "part").select("p_partkey", F.split("p_name", " ").alias("words"), F.array("p_brand").alias("brand"))
    return R.components(rows, ["words", "brand"], "p_partkey")


@query(f"""WITH n AS (SELECT n_nationkey AS uid, {_SQL_NORM.format('n_name')} AS b FROM nation)
SELECT uid, b AS alias, true AS strong FROM n
UNION ALL SELECT uid, f || ' ' || b, true FROM n, (SELECT unnest(['tinh', 'thanh pho', 'tp', 't p']) AS f)
UNION ALL SELECT uid, b, false FROM n
UNION ALL SELECT uid, replace(b, ' ', ''), false FROM n WHERE contains(b, ' ') AND length(b) >= 6""")
def gazetteer_aliases(spark, sf_dir):
    return G.aliases(_read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("uid"), F.col("n_name").alias("name"), F.lit("province").alias("kind")))


@query(f"""SELECT s_suppkey AS row_id, n_nationkey AS uid, 2 AS score, 3 AS pos, (len(string_split({_SQL_NORM.format('n_name')}, ' ')))::INTEGER AS words
FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def gazetteer_match(spark, sf_dir):
    nation = _read(spark, sf_dir, "nation")
    text = F.concat(F.lit("Số 7, tỉnh "), F.col("n_name"))
    rows = _read(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("row_id"), text.alias("text"))
    return G.named_units(rows, gazetteer_aliases(spark, sf_dir))


_SQL_BASE = rf"regexp_replace(regexp_replace({_SQL_NORM}, '^(thanh pho|tinh|quan|huyen|thi xa|thi tran|phuong|xa)\s+', ''), '\b0([0-9])\b', '\1', 'g')"
_SQL_PHONE = r"'(?:\+?84|0)[0-9 .\-]{8,13}'"


@query(f"SELECT doc_id, {_SQL_BASE.format('text')} AS base FROM documents")
def base_name(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select("doc_id", T.base_name(F.col("text")).alias("base"))


@query(f"""WITH f AS (SELECT doc_id, string_split_regex(coalesce(text, ''), {_SQL_PHONE}) AS parts, list_transform(regexp_extract_all(coalesce(text, ''), {_SQL_PHONE}),
  lambda x: regexp_replace(regexp_replace(x, '[^0-9]', '', 'g'), '^84', '0')) AS d FROM documents)
SELECT doc_id, array_to_string(list_transform(generate_series(1, len(parts)), lambda i: parts[i] || coalesce('0' || repeat('x', len(d[i]) - 1), '')), '') AS masked FROM f""")
def phone_mask(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select("doc_id", T.masked_phones(F.col("text")).alias("masked"))


def _units(spark, sf_dir):
    """Regions as provinces, nations as districts, suppliers as wards."""
    level = lambda table, uid, name, *parent: _read(spark, sf_dir, table).select(F.col(uid).alias("uid"), F.col(name).alias("name"), F.col(uid).alias("ord"), *[F.col(p).alias("parent") for p in parent])
    return level("region", "r_regionkey", "r_name"), level("nation", "n_nationkey", "n_name", "n_regionkey"), level("supplier", "s_suppkey", "s_name", "s_nationkey")


def _labelled(spark, sf_dir):
    """Customers with the labels of their nation and of the supplier of their number, which may be of another nation."""
    rows = _read(spark, sf_dir, "customer").join(_read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(_read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = rows.join(_read(spark, sf_dir, "supplier"), F.col("c_custkey") == F.col("s_suppkey"), "left")
    named = lambda word, c: F.concat(F.lit(word), F.lower(c))
    return rows.select("c_custkey", named("Tỉnh ", "r_name").alias("province"), named("HUYỆN ", "n_name").alias("district"), named("xã ", "s_name").alias("ward"))


_SQL_FOUND = """SELECT c_custkey, r_regionkey, r_name AS province_name, n_name AS district_name, CASE WHEN s_nationkey = c_nationkey THEN s_name END AS ward_name, s_acctbal FROM customer
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey LEFT JOIN supplier ON s_suppkey = c_custkey"""


@query(f"SELECT c_custkey, province_name, district_name, ward_name FROM ({_SQL_FOUND})")
def hierarchy_lookup(spark, sf_dir):
    return A.lookup_units(_labelled(spark, sf_dir), *_units(spark, sf_dir)).select("c_custkey", "province_name", "district_name", "ward_name")


@query(f"""SELECT c_custkey, CASE WHEN s_acctbal > 0 THEN ward_name || ' II' END AS ward_new,
  CASE WHEN ward_name IS NOT NULL AND s_acctbal > 0 THEN 'JOINED' WHEN r_regionkey > 1 THEN province_name || ' II' END AS province_new FROM ({_SQL_FOUND})""")
def migration_coalesce(spark, sf_dir):
    provinces, districts, wards = _units(spark, sf_dir)
    moved = _read(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("uid"), F.expr("s_name || ' II'").alias("ward_new"), F.lit("JOINED").alias("province_new"))
    found = A.lookup_units(_labelled(spark, sf_dir), provinces, districts, wards)
    renamed = provinces.where("uid > 1").select("uid", F.expr("name || ' II'").alias("province_new"))
    return A.migrated(found, moved, renamed).select("c_custkey", "ward_new", "province_new")


@query(f"""WITH u AS (SELECT n_nationkey AS uid, {_SQL_BASE.format('n_name')} AS b FROM nation), q AS (SELECT s_suppkey, {_SQL_BASE.format('substr(n_name, 2)')} AS q FROM supplier JOIN nation ON s_nationkey = n_nationkey)
SELECT s_suppkey AS row_id, coalesce(min(uid) FILTER (WHERE q = b), min(uid)) AS uid FROM q JOIN u ON levenshtein(q, b) <= 1 GROUP BY 1 HAVING count(DISTINCT b) = 1 OR count(*) FILTER (WHERE q = b) > 0""")
def snap_unit(spark, sf_dir):
    units = _units(spark, sf_dir)[1]
    rows = _read(spark, sf_dir, "supplier").join(_read(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return A.snapped(rows.select(F.col("s_suppkey").alias("row_id"), F.expr("substring(n_name, 2)").alias("name")), units)


@query(f"""SELECT c_custkey, CASE WHEN s_acctbal < 0 THEN 'Cần kiểm tra' WHEN s_acctbal > 5000 THEN 'Cao (SĐT khách cũ)' WHEN ward_name IS NOT NULL THEN 'Cao' ELSE 'Trung bình' END AS label FROM ({_SQL_FOUND})""")
def confidence_label(spark, sf_dir):
    found = A.lookup_units(_labelled(spark, sf_dir), *_units(spark, sf_dir)).join(_read(spark, sf_dir, "supplier"), F.col("c_custkey") == F.col("s_suppkey"), "left")
    label = A.confidence_label(F.col("ward_name"), F.col("province_name"), F.lit(False), F.col("s_acctbal") > 5000, F.col("s_acctbal") < 0)
    return found.select("c_custkey", label.alias("label"))


@query(rf"""WITH k AS (SELECT doc_id, list_transform(regexp_extract_all(regexp_replace({_SQL_NORM.format('text')}, '{A.SORT_PREFIX}', ''), '[0-9]+|[^0-9]+'),
  lambda p: CASE WHEN regexp_matches(p, '^[0-9]') THEN '0' || lpad(len(CASE WHEN ltrim(p, '0') = '' THEN '0' ELSE ltrim(p, '0') END)::VARCHAR, 6, '0') || CASE WHEN ltrim(p, '0') = '' THEN '0' ELSE ltrim(p, '0') END ELSE '1' || p END) AS k FROM documents)
SELECT doc_id, CASE WHEN len(k) = 0 THEN '~' ELSE array_to_string(k, chr(9)) END AS sort_text FROM k""")
def natural_sort(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select("doc_id", A.sort_text(F.col("text")).alias("sort_text"))


# Every document with one of five endings that flags depend on.
_ENDINGS = ["", " nay thuộc tỉnh Y", " xã cũ", " xã cũ và mới", " trụ sở"]
_SQL_ENDED = f"SELECT doc_id, coalesce(text, '') || [{', '.join(repr(e) for e in _ENDINGS)}][(doc_id % 5 + 1)::INTEGER] AS text FROM documents"


def _ended(spark, sf_dir):
    ending = F.get(F.array(*map(F.lit, _ENDINGS)), (F.col("doc_id") % 5).cast("int"))
    return _read(spark, sf_dir, "documents").select("doc_id", F.concat(F.coalesce("text", F.lit("")), ending).alias("text"))


@query(rf"""WITH d AS ({_SQL_ENDED}), f AS (SELECT doc_id, text, len(list_filter(list_transform(regexp_extract_all(text, {_SQL_PHONE}),
  lambda x: regexp_replace(regexp_replace(x, '[^0-9]', '', 'g'), '^84', '0')), lambda d: d[1] = '0' AND len(d) BETWEEN 10 AND 11)) > 0
  OR regexp_matches(text, '(^|[^0-9])0[0-9]{{8,10}}([^0-9]|$)') AS phone FROM d)
SELECT doc_id, CASE WHEN trim(text) = '' THEN 'NO_POI_FOUND,NO_LEVEL4_FOUND,LOW_CONFIDENCE' ELSE array_to_string(list_filter([CASE WHEN phone THEN 'RAW_CONTAINS_PHONE' END,
  CASE WHEN doc_id % 5 IN (1, 2, 3) THEN 'ADMIN_VERSION_AMBIGUOUS' END, CASE WHEN doc_id % 5 IN (1, 2, 3) THEN 'NEED_REVIEW_ADMIN_VERSION' END, CASE WHEN doc_id % 5 = 1 THEN 'RAW_CONTAINS_NAY_THUOC' END,
  CASE WHEN doc_id % 5 = 3 THEN 'RAW_HAS_OLD_AND_NEW_ADDRESS' END, CASE WHEN doc_id % 5 = 4 THEN 'TRU_SO_DETECTED' END], lambda x: x IS NOT NULL), ',') END AS flags FROM f""")
def raw_flags(spark, sf_dir):
    return _ended(spark, sf_dir).select("doc_id", F.array_join(D.raw_flags(F.col("text"), T.first_phone(F.col("text"))), ",").alias("flags"))


_RAISED = [
    ("p_size < 10", "MULTIPLE_POI_FOUND"), ("p_size > 40", "RAW_ADMIN_CONFLICT_WITH_COLUMNS"), ("p_retailprice < 950", "ORDER_CODE_REMOVED"),
    ("p_partkey % 7 = 0", "MISSING_ADMIN_COLUMN"), ("p_partkey % 11 = 0", "LLM_SKIPPED_QUOTA"), ("p_partkey % 4 = 0", "ADMIN_NEW_FORMAT"),
]


def _results(spark, sf_dir):
    """Parts as parsed records: the name's words are details, every third has none; the brand's first part is the first of its copies."""
    part = _read(spark, sf_dir, "part")
    flags = F.array_compact(F.array(*[F.when(F.expr(c), F.lit(f)) for c, f in _RAISED]))
    poi, level4 = F.expr("if(p_partkey % 3 = 0, '', p_name)"), F.expr("if(p_partkey % 2 = 0, '', p_type)")
    rows = part.select(F.col("p_partkey").alias("row_id"), poi.alias("poi"), level4.alias("level4"), flags.alias("flags"), F.col("p_name").alias("raw"), F.expr("p_partkey % 3 <> 0").alias("has_detail"))
    named = rows.withColumn("first", F.expr("row_id - if(row_id % 10 = 9, 1, 0)")).withColumn("parts", F.expr("cast(row_id % 3 as int)"))
    return named.withColumn("ward", F.lit("w")).withColumn("district", F.expr("if(row_id % 5 = 0, '', 'd')")).withColumn("province", F.lit("p"))


def _sql_flag(name):
    return next(c for c, f in _RAISED if f == name)


_SQL_COST = " - ".join(f"CASE WHEN {c} THEN {V.PENALTIES.get(f, 0.03)}::DOUBLE ELSE 0::DOUBLE END" for c, f in _RAISED)


@query(f"""SELECT p_partkey AS row_id, greatest(0::DOUBLE, round(1::DOUBLE - CASE WHEN p_partkey % 3 = 0 THEN 0.05::DOUBLE ELSE 0::DOUBLE END
  - CASE WHEN p_partkey % 2 = 0 THEN 0.05::DOUBLE ELSE 0::DOUBLE END - {_SQL_COST}, 3)) AS score FROM part""")
def result_score(spark, sf_dir):
    return _results(spark, sf_dir).select("row_id", V.result_score(F.col("poi"), F.col("level4"), F.col("flags")).alias("score"))


@query(f"""SELECT p_partkey AS row_id, CASE WHEN {_sql_flag("MULTIPLE_POI_FOUND")} THEN 'SEND_LLM' WHEN {_sql_flag("MISSING_ADMIN_COLUMN")} THEN 'REVIEW_MANUAL'
  WHEN {_sql_flag("RAW_ADMIN_CONFLICT_WITH_COLUMNS")} THEN 'ACCEPT_RULE_WITH_FLAGS' ELSE 'ACCEPT_RULE' END AS route FROM part""")
def route_record(spark, sf_dir):
    return _results(spark, sf_dir).select("row_id", V.route(F.col("flags"), F.col("raw")).alias("route"))


@query(f"""SELECT p_partkey AS row_id, array_to_string(list_filter([CASE WHEN {_sql_flag("MISSING_ADMIN_COLUMN")} THEN 'Thiếu/không khớp cột hành chính' END,
  CASE WHEN {_sql_flag("LLM_SKIPPED_QUOTA")} THEN 'Dòng mơ hồ chưa qua LLM (hết quota)' END,
  CASE WHEN {_sql_flag("RAW_ADMIN_CONFLICT_WITH_COLUMNS")} THEN 'Raw mâu thuẫn với cột hành chính' END], lambda x: x IS NOT NULL), '; ') AS reasons,
  CASE WHEN p_partkey % 3 <> 0 THEN NULL ELSE 'Không bóc được POI/tên đường/cấp 4 từ địa chỉ thô' || CASE WHEN {_sql_flag("LLM_SKIPPED_QUOTA")} THEN '; dòng mơ hồ chưa qua LLM (hết quota)'
  WHEN {_sql_flag("MULTIPLE_POI_FOUND")} THEN '; dòng mơ hồ cần LLM (Cerebras chưa bật)' ELSE '' END END AS dropped FROM part""")
def review_reasons(spark, sf_dir):
    dropped = V.drop_reason(F.col("raw"), F.col("flags"), F.col("has_detail"), model_on=False)
    return _results(spark, sf_dir).select("row_id", V.review_reasons(F.col("flags")).alias("reasons"), dropped.alias("dropped"))


_SQL_STATS = """SELECT count(*) AS input_n, count(*) FILTER (WHERE p_partkey % 10 = 9) AS duplicates, count(*) FILTER (WHERE p_partkey % 10 <> 9) AS unique_n,
  count(*) FILTER (WHERE p_partkey % 10 <> 9 AND p_partkey % 3 = 0) AS removed, (coalesce(sum(p_partkey % 3) FILTER (WHERE p_partkey % 10 <> 9), 0))::BIGINT AS output_n,
  (coalesce(sum(p_partkey % 3) FILTER (WHERE p_partkey % 10 <> 9 AND (p_partkey % 5 <> 0 OR p_partkey % 4 = 0)), 0))::BIGINT AS full_admin,
  count(*) FILTER (WHERE p_partkey % 10 <> 9 AND p_partkey % 4 = 0) AS mapped_new,
  count(*) FILTER (WHERE p_partkey % 10 <> 9 AND (p_size > 40 OR p_partkey % 7 = 0 OR p_partkey % 11 = 0)) AS review_n FROM part"""


@query(_SQL_STATS)
def run_stats(spark, sf_dir):
    return V.run_stats(_results(spark, sf_dir))


@query(f"WITH s AS ({_SQL_STATS}) " + " UNION ALL ".join(f"SELECT {i} AS position, '{label}' AS label, {name} AS value FROM s" for i, (name, label) in enumerate(V.STATS.items())))
def stats_sheet(spark, sf_dir):
    return V.stats_sheet(run_stats(spark, sf_dir))


_SQL_REQUEST = f"{_SQL_NORM.format('text')} || chr(9) || {_SQL_NORM.format('lang')} || chr(9) || {_SQL_NORM.format('source')} || chr(9)"


@query(f"SELECT doc_id, min(doc_id) OVER (PARTITION BY {_SQL_REQUEST}) AS first FROM documents")
def request_pointer(spark, sf_dir):
    docs = _read(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_id"), F.col("text").alias("raw"), F.col("lang").alias("ward"), F.col("source").alias("district"), F.lit(None).cast("string").alias("province"))
    return V.request_pointer(docs).select(F.col("row_id").alias("doc_id"), "first")


@query("""SELECT p_partkey, CASE WHEN p_size < 10 THEN p_name ELSE p_brand END AS "primary", CASE WHEN p_size < 10 THEN p_brand ELSE p_name END AS sub FROM part""")
def level4_primary(spark, sf_dir):
    items = F.array(F.struct(F.lit("to").alias("type"), F.col("p_brand").alias("value")), F.struct(F.when(F.col("p_size") < 10, "ap").otherwise("xom").alias("type"), F.col("p_name").alias("value")))
    return _read(spark, sf_dir, "part").select("p_partkey", V.level4_primary(items).alias("x")).select("p_partkey", "x.*")


_SQL_NEW = "c_custkey % 3 = 0 AND c_custkey % 5 <> 0 AND c_custkey % 2 = 0"
_SQL_AGAIN = "c_custkey % 15 = 0 AND c_custkey % 7 <> 0"
_SQL_TOLD = f"c_custkey % 3 = 0 AND c_custkey % 7 = 0 AND NOT ({_SQL_NEW})"


@query(f"""SELECT c_custkey, CASE WHEN {_SQL_NEW} OR {_SQL_AGAIN} THEN 'Phường ' || n_name WHEN c_custkey % 5 = 0 THEN 'phường ' || n_name WHEN c_custkey % 2 = 0 THEN 'phường ' || lower(n_name) ELSE 'xã lạ' END AS ward,
  CASE WHEN c_custkey % 3 <> 0 THEN n_name WHEN {_SQL_TOLD} THEN 'Huyện Chữ' ELSE '' END AS district, r_name AS province,
  array_to_string(list_filter([CASE WHEN {_SQL_NEW} THEN 'ADMIN_NEW_FORMAT' END, CASE WHEN c_custkey % 5 = 0 OR {_SQL_TOLD} THEN 'ADMIN_FILLED_FROM_RAW' END, CASE WHEN {_SQL_AGAIN} THEN 'ADMIN_NEW_FORMAT' END,
  CASE WHEN c_custkey % 3 = 0 AND NOT ({_SQL_TOLD}) AND NOT ({_SQL_NEW}) AND NOT ({_SQL_AGAIN}) THEN 'MISSING_ADMIN_COLUMN' END], lambda x: x IS NOT NULL), ',') AS flags
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def resolve_admin(spark, sf_dir):
    provinces, districts, wards = _units(spark, sf_dir)
    nation = _read(spark, sf_dir, "nation")
    rows = _read(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(provinces, F.col("n_regionkey") == F.col("uid"))
    ward = F.expr("case when c_custkey % 5 = 0 then '' when c_custkey % 2 = 0 then 'phường ' || lower(n_name) else 'xã lạ' end")
    district = F.expr("case when c_custkey % 3 <> 0 then 'HUYỆN ' || lower(n_name) end")
    parsed = [F.expr("'phường ' || n_name").alias("parsed_ward"), F.expr("if(c_custkey % 7 = 0, 'Huyện Chữ', null)").alias("parsed_district"), F.lit("").alias("parsed_province")]
    rows = rows.select("c_custkey", ward.alias("ward"), district.alias("district"), F.concat(F.lit("Tỉnh "), F.lower("name")).alias("province"), *parsed)
    new_wards = nation.select(F.col("n_nationkey").alias("uid"), F.concat(F.lit("Phường "), "n_name").alias("name"), F.col("n_nationkey").alias("ord"), F.col("n_regionkey").alias("parent"))
    out = A.resolved(A.lookup_units(rows, provinces, districts, wards), provinces, new_wards)
    return out.select("c_custkey", F.col("clean_ward").alias("ward"), F.col("clean_district").alias("district"), F.col("clean_province").alias("province"), F.array_join("admin_flags", ",").alias("flags"))


@query("""WITH e AS (SELECT n_nationkey, 'Tỉnh ' || r_name AS province, r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey > 4), c AS (
  SELECT c_custkey, c_nationkey, CASE WHEN c_custkey % 2 = 0 THEN '' ELSE 'đường A' END AS street, CASE WHEN c_custkey % 3 = 0 THEN NULL WHEN c_custkey % 3 = 1 THEN 'EUROPE' ELSE 'ASIA' END AS province FROM customer)
SELECT c_custkey, CASE WHEN hit AND c.street = '' THEN 'phố B' ELSE c.street END AS street, CASE WHEN hit THEN coalesce(c.province, e.province) ELSE c.province END AS province, hit AS phone_hit, bad AS conflict,
  CASE WHEN bad THEN 'x; SĐT trùng khách cũ nhưng khác tỉnh - cần kiểm tra' WHEN hit THEN 'x; đối chiếu SĐT khách cũ' || CASE WHEN c.street = '' OR c.province IS NULL THEN ' (bổ sung từ danh bạ)' ELSE '' END ELSE 'x' END AS note
FROM c LEFT JOIN e ON c_nationkey = n_nationkey, LATERAL (SELECT e.r_name IS NOT NULL AND coalesce(c.province <> e.r_name, false) AS bad, e.r_name IS NOT NULL AND NOT coalesce(c.province <> e.r_name, false) AS hit)""")
def directory_enrich(spark, sf_dir):
    empty = [F.lit(None).cast("string").alias(c) for c in ("hamlet", "ward", "district", "ward_new", "province_new")]
    phone = lambda c: F.concat(F.lit("0912"), F.lpad(F.col(c).cast("string"), 6, "0")).alias("phone")
    province = F.expr("case c_custkey % 3 when 1 then 'EUROPE' when 2 then 'ASIA' end").alias("province")
    rows = _read(spark, sf_dir, "customer").select("c_custkey", phone("c_nationkey"), F.lit("x").alias("note"), F.expr("if(c_custkey % 2 = 0, '', 'đường A')").alias("street"), province, *empty)
    known = _read(spark, sf_dir, "nation").where("n_nationkey > 4").join(_read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    directory = known.select(phone("n_nationkey"), F.lit("phố B").alias("street"), F.concat(F.lit("Tỉnh "), "r_name").alias("province"), *empty)
    return A.enriched(rows, directory).select("c_custkey", "street", "province", "phone_hit", "conflict", "note")


@query(r"""SELECT doc_id, array_to_string(list_transform(regexp_extract_all(coalesce(text, ''), '\s+|/|[^\s/]+'), lambda w: CASE WHEN regexp_matches(w, '[0-9]') THEN lower(w) ELSE replace(upper(w[1]), 'ẞ', 'SS') || lower(w[2:]) END), '') AS titled,
  array_to_string(regexp_extract_all(coalesce(text, ''), '[\pL\pN\pM]+'), ' ') AS words FROM documents""")
def titled_words(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select("doc_id", D.title_case(F.col("text")).alias("titled"), F.array_join(D.words(F.col("text")), " ").alias("words"))


@query(r"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '[\r\n\t]+', ', ', 'g'), '\s+', ' ', 'g'), '\s*,\s*', ', ', 'g'), ',{2,}', ',', 'g'), '^[ ,.\-]+|[ ,.\-]+$', '', 'g') AS spaced FROM documents""")
def clean_spaces(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select("doc_id", D.clean_spaces(F.col("text")).alias("spaced"))


# Texts, and for each: note, goods, customer's name, price or weight, alley only.
_PIECES = [
    ("giao buổi chiều nhé", 1, 0, 0, 0, 0), ("Sửa xe Tuấn Cường", 0, 1, 0, 0, 0), ("Nguyễn Thị Hoa", 0, 0, 1, 0, 0), ("Đường Nguyễn Trãi", 0, 0, 0, 0, 0), ("chị Hoa", 0, 0, 0, 0, 0),
    ("Iphone X11", 1, 1, 0, 0, 0), ("áo size M", 1, 1, 0, 0, 0), ("390k", 0, 0, 0, 1, 0), ("10kg gạo", 0, 0, 0, 1, 0), ("số 3 ngõ 48", 0, 0, 0, 0, 0), ("ngõ 48", 0, 0, 0, 0, 1), ("hẻm 12/3a.", 0, 0, 0, 0, 1), ("ngõ 48 Ninh Hiệp", 0, 0, 0, 0, 0),
    ("", 1, 0, 0, 0, 0), ("Trần 2 Hoa", 0, 0, 0, 0, 0), ("free ship", 1, 0, 0, 0, 0), ("Công Ty Hoa Sen", 0, 0, 0, 0, 0), ("Phạm Văn Đồng", 0, 0, 1, 0, 0),
]


@query("SELECT * FROM (VALUES " + ", ".join("('{}', {})".format(p[0], ", ".join("true" if x else "false" for x in p[1:])) for p in _PIECES) + ") AS t(piece, note, goods, customer, junky, alley)")
def piece_kinds(spark, sf_dir):
    rows = spark.createDataFrame([(p[0],) for p in _PIECES], "piece string")
    c = F.col("piece")
    return rows.select("piece", D.is_note(c).alias("note"), D.has_product_note(c).alias("goods"), D.is_customer_name(c).alias("customer"), D.is_junky(c).alias("junky"), D.is_alley_only(c).alias("alley"))


# Texts, and what each function makes of them: abbreviations, courier phrases, segments, display.
_REWRITES = [
    ("expanded", "64/54 hòa bih p5q11", "64/54 hòa bih p5 q 11"), ("expanded", "Tôn Đức Thắng Ph , Hoà Khánh Bắc Q, Liên Chiểu", "Tôn Đức Thắng, Phường Hoà Khánh Bắc, Quận Liên Chiểu"),
    ("expanded", "Phường X, Hoà Khánh", "Phường X, Hoà Khánh"), ("expanded", "tdp 5 ql1a", "Tổ Dân Phố 5 Quốc Lộ 1A"), ("expanded", "Sài Gòn180 Cao Lỗ", "Sài Gòn 180 Cao Lỗ"), ("expanded", "TrỗiKhu Phố 1B", "Trỗi Khu Phố 1B"),
    ("expanded", "kp3 Kim Sơn1", "Khu Phố 3 Kim Sơn 1"), ("expanded", "cty Hoa Sen bv dk", "Công Ty Hoa Sen Bệnh Viện Đa Khoa"), ("expanded", "Trưng_ Phường", "Trưng, Phường"), ("expanded", "", ""), ("expanded", "ĐT.199 0912345678", "Đường Tỉnh 199 0912345678"),
    ("without_intro", "ship đến: 12 Lê Lợi", "12 Lê Lợi"), ("without_intro", "** đc: 5 Hàng Bài", "5 Hàng Bài"), ("without_intro", "12 Lê Lợi", "12 Lê Lợi"),
    ("segments", "02 Lê Lai . Hợp Thành", "02 Lê Lai|Hợp Thành"), ("segments", "Waterfront 2-Võ Nguyên Giáp- Lê Chân", "Waterfront 2|Võ Nguyên Giáp|Lê Chân"), ("segments", "Đường D8-5A (cũ); số 1 - 3", "Đường D8-5A|cũ|số 1-3"),
    ("segments", "Trường TH - THCS Lê Lợi", "Trường TH-THCS Lê Lợi"), ("segments", " , .", ""),
    ("display", "trường thcs nguyễn trãi d8a", "Trường THCS Nguyễn Trãi D8A"), ("display", "ubnd xã, công ty tnhh abc", "UBND Xã, Công ty TNHH Abc"), ("display", "trạm  y tế P9 .", "Trạm y tế P9"),
]


@query("SELECT * FROM (VALUES " + ", ".join(f"('{f}', '{a}', '{b}')" for f, a, b in _REWRITES) + ") AS t(rewrite, given, made)")
def rewrites(spark, sf_dir):
    rows = spark.createDataFrame([(f, a) for f, a, _ in _REWRITES], "rewrite string, given string")
    c = F.col("given")
    made = F.when(F.col("rewrite") == "expanded", S.expanded(c)).when(F.col("rewrite") == "without_intro", S.without_intro(c))
    return rows.select("rewrite", "given", made.when(F.col("rewrite") == "segments", F.array_join(S.segments(c), "|")).otherwise(S.display(c)).alias("made"))


@query(f"""SELECT s_suppkey AS row_id, r_regionkey::VARCHAR AS province, n_nationkey::VARCHAR AS district, s_suppkey::VARCHAR AS ward,
  CASE s_suppkey % 3 WHEN 1 THEN '{G.PROVINCE_INFERRED}' WHEN 2 THEN '{G.DISTRICT_INFERRED}' ELSE '' END AS note
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def matched_units(spark, sf_dir):
    rows = _read(spark, sf_dir, "supplier").join(_read(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(_read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    parts = [F.lit("Ấp 3"), F.concat(F.lit("thị trấn "), "s_name"), F.when(F.col("s_suppkey") % 3 != 2, F.col("n_name")), F.when(F.col("s_suppkey") % 3 != 1, F.col("r_name"))]
    records = rows.select(F.col("s_suppkey").alias("row_id"), F.concat_ws(", ", *parts).alias("text"))
    return G.matched_units(records, G.catalogue(*_units(spark, sf_dir)))


@query(f"""SELECT * FROM (SELECT p_partkey AS row_id, p_name AS raw, CASE WHEN p_partkey % 10 = 9 THEN 'Trùng lặp với dòng ' || (p_partkey - 1) || ' (cùng địa chỉ và 3 cột hành chính)'
  WHEN p_partkey % 3 = 0 THEN '{V.NO_DETAIL}' || CASE WHEN {_sql_flag("LLM_SKIPPED_QUOTA")} THEN '{V.NOT_ASKED}' ELSE '' END END AS reason FROM part) WHERE reason IS NOT NULL""")
def dropped_rows(spark, sf_dir):
    return X.dropped_table(_results(spark, sf_dir), model_on=True)
