"""Column functions on free-text addresses: spacing, case, tokens, and what a piece of text is; all run in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import NORMALIZER, norm, strip_marks

# Patterns and words that decide the answers. Those that long texts are searched for begin with letters and look
# back at what is before them: a boundary tried at every character takes two to four times as long.
OLD, NEW = r"(?U)cũ(?<=\bcũ)\b", r"(?U)mới(?<=\bmới)\b"
NOW_OF = r"nay(?<![a-z0-9]nay)[^a-z0-9]+(?:thuoc|la)(?![a-z0-9])"
MERGED = r"sap(?<![a-z0-9]sap)[^a-z0-9]+nhap(?![a-z0-9])"
LONE_PHONE = r"(?U)0(?<!\d0)\d{8,10}(?!\d)"
HEAD_OFFICE = r"(?U)[tT][rR](?i:(?<=\btr)(?:ụ\s*sở|u\s*so)\b)"
ORDER_CODE = r"(?U)\b[A-Za-z]{1,3}\d{4,}\b(?![/\-.]\w)"
OLD_UNIT_NOTE = r"(?iU)\(\s*[^)]*\b(?:cũ|cu)\b[^)]*\)\s*$"
MONEY_OR_WEIGHT = r"(?U)^\d+[.,]?\d*(k|kg|g|gr|tr|ky|d|vnd)\w*$"
HOUSE = r"(?:[a-z]{0,4}\d+[a-z0-9]*|\d+[a-z]+[0-9]*|[a-z]+\d+[a-z0-9]*)"
NOTES = [
    "khong dung hang", "ko dung hang", "tra lai", "hoan hang", "doi hang", "mien ship", "free ship", "freeship", "ship nhe", "ship nha",
    "goi truoc", "dung goi", "gio hanh chinh", "gio hanh chanh", "thu ho", "cod", "khach tra", "chi tra", "anh tra", "em tra",
    "sai mau", "sai size", "sai m", "khong giong hinh", "ko giong hinh", "cho xem hang", "dong kiem", "hang de vo", "huy don",
    "khong lay", "ko lay", "tranh thu", "khi chua nhap",
]
BRANDS = ["vivo", "iphone", "oppo", "samsung", "xiaomi", "realme", "nokia", "redmi", "tecno", "infinix"]
CLOTHES = ["ao", "quan", "vay", "dam", "giay", "dep", "tui"]
MODIFIERS = ["mau", "size", "sz", "sai"]
SURNAMES = [
    "nguyen", "tran", "le", "pham", "hoang", "huynh", "phan", "vu", "vo", "dang", "bui", "do", "ho", "ngo", "duong", "ly", "dinh", "lam",
    "phung", "mai", "truong", "cao", "chu", "ta", "tong", "kieu", "luong", "la", "ha", "quach", "thai", "chau", "trinh", "ninh", "nghiem",
    "ong", "nong",
]
NOT_IN_NAMES = [
    "duong", "pho", "ngo", "ngach", "hem", "kiet", "ap", "thon", "xom", "to", "khu", "kp", "tdp", "doi", "ban", "buon", "lang", "ql", "tl",
    "hl", "dt", "km", "quoc", "lo", "so", "sn", "khom", "truong", "mn", "thpt", "thcs", "cty", "tnhh", "chua", "toa", "bv", "pk", "shop",
    "kho", "xuong", "cang", "ubnd", "building", "ks", "cho", "bhxh", "gara", "garage", "hkd", "mieu", "dinh",
]
CALLED = (
    r"(?iU)^\s*(?:anh|chị|chi|cô|co|chú|chu|em|a|c|bố|bo|bà|ba|ông|ong|cụ|cu|thầy|thay|mẹ|me|bé|be|khách\s*hàng|khach\s*hang|tên\s*kh|ten\s*kh"
    r"|người\s*nhận|nguoi\s*nhan)\.?\s+([a-zà-ỹA-ZÀ-Ỹ]+(?:\s+[a-zà-ỹA-ZÀ-Ỹ]+){0,2})\b"
)


def nfc(text: Column) -> Column:
    """Composed letters; a null counts as ''."""
    return F.reflect(F.lit(NORMALIZER), F.lit("compose"), F.coalesce(text, F.lit("")), F.lit(False))


def plain(text: Column) -> Column:
    """Lower case without accents; punctuation stays."""
    return strip_marks(F.lower(nfc(text)))


def clean_spaces(text: Column) -> Column:
    """Line breaks and tabs become commas, runs of blanks one blank; blanks, commas, dots and dashes at the ends go."""
    lines = F.regexp_replace(nfc(text), r"[\r\n\t]+", ", ")
    commas = F.regexp_replace(F.regexp_replace(lines, r"(?U)\s+", " "), r"\s*,\s*", ", ")
    return F.btrim(F.regexp_replace(commas, ",{2,}", ","), F.lit(" ,.-"))


def optional_text(text: Column) -> Column:
    """One blank between words, no punctuation at the ends; null where nothing is left."""
    return F.nullif(F.btrim(F.regexp_replace(nfc(text), r"(?U)\s+", " "), F.lit(" ,.-–—/:;")), F.lit(""))


def title_case(text: Column) -> Column:
    """Words between blanks and slashes with a capital first letter, those with a digit in lower case."""
    parts = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?U)\s+|/|[^\s/]+"), F.lit(0))
    cased = lambda w: F.when(w.rlike(r"(?U)\d"), F.lower(w)).otherwise(F.concat(F.upper(F.left(w, F.lit(1))), F.lower(F.substr(w, F.lit(2)))))
    return F.array_join(F.transform(parts, cased), "")


def words(text: Column) -> Column:
    """Runs of letters and digits, accents included."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?U)[^\W_]+"), F.lit(0))


def order_codes(text: Column) -> Column:
    """Shipping codes that stand alone: up to three letters and four digits or more."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(ORDER_CODE), F.lit(0))


def without_order_codes(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), ORDER_CODE, " ")


def old_unit_note(text: Column) -> Column:
    """What a closing parenthesis says about a former unit, null where there is none."""
    return F.nullif(F.btrim(F.regexp_extract(F.coalesce(text, F.lit("")), OLD_UNIT_NOTE, 0), F.lit(" ()")), F.lit(""))


def without_old_unit_note(text: Column) -> Column:
    had = old_unit_note(text).isNotNull()
    return F.when(had, F.btrim(F.regexp_replace(text, OLD_UNIT_NOTE, ""), F.lit(" ,.-–/:;"))).otherwise(F.coalesce(text, F.lit("")))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), the value computed once; without this Spark computes it again wherever `use` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _versions(text: Column) -> Column:
    """Does the text speak of old, new or merged units, or of what a unit is now?"""
    ascii = lambda t: F.octet_length(t) == F.char_length(t)
    bare = _once(F.lower(F.coalesce(text, F.lit(""))), lambda t: F.when(ascii(t), t).otherwise(strip_marks(t)))
    forms = F.struct(F.lower(nfc(text)).alias("low"), bare.alias("bare"))
    said = [("old", "low", OLD), ("new", "low", NEW), ("now", "bare", NOW_OF), ("merged", "bare", MERGED)]
    return _once(forms, lambda f: F.struct(*[f[form].rlike(pattern).alias(name) for name, form, pattern in said]))


def _any_version(said: Column) -> Column:
    return said["old"] | said["new"] | said["now"] | said["merged"]


def has_old_or_new(text: Column) -> Column:
    """Does the text speak of former, new or merged units?"""
    return _once(_versions(text), _any_version)


def _found_flags(text: Column, phone: Column, said: Column) -> Column:
    rules = [
        ("RAW_CONTAINS_PHONE", phone.isNotNull() | text.rlike(LONE_PHONE)),
        ("ADMIN_VERSION_AMBIGUOUS", _any_version(said)),
        ("NEED_REVIEW_ADMIN_VERSION", _any_version(said)),
        ("RAW_CONTAINS_NAY_THUOC", said["now"]),
        ("RAW_HAS_OLD_AND_NEW_ADDRESS", said["old"] & said["new"]),
        ("TRU_SO_DETECTED", text.rlike(HEAD_OFFICE)),
    ]
    return F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in rules]))


def raw_flags(text: Column, phone: Column) -> Column:
    """Flags that the raw text alone decides, in the order in which they are raised; `phone` is text.first_phone(text).

    Null and blank texts raise those of a record in which nothing was found.
    """
    blank = F.array(F.lit("NO_POI_FOUND"), F.lit("NO_LEVEL4_FOUND"), F.lit("LOW_CONFIDENCE"))
    found = lambda t: _once(_versions(t), lambda said: _found_flags(t, phone, said))
    return _once(text, lambda t: F.when(F.coalesce(t, F.lit("")).rlike(r"(?U)^\s*$"), blank).otherwise(found(t)))


def is_junky(value: Column) -> Column:
    """Is a word of it a price or a weight?"""
    return F.exists(F.split(plain(value), r"(?U)\s+"), lambda w: w.rlike(MONEY_OR_WEIGHT))


def is_alley_only(text: Column) -> Column:
    """Is there an alley's number and nothing else? A house number before it goes with one letter more, so 'số 3 ngõ 48' is none."""
    number = rf"(?U)^\s*(?:so\s*nha|snha|so|sn|nha)?\s*{HOUSE}(?:\s*[/\-.]\s*{HOUSE})*(?:\s+[a-z])?\s*"
    rest = F.btrim(F.regexp_replace(F.regexp_replace(plain(text), number, ""), r"(?U)\s+", " "), F.lit(" ,.-–/:"))
    return rest.rlike(r"(?U)^(?:ngo|ngach|hem|kiet)\s*\d+[a-z]?(?:\s*[/\-.]\s*\d+[a-z]?)*$")


def _has(key: Column, these: list[str]) -> Column:
    return key.rlike(rf"\b(?:{'|'.join(these)})\b")


def has_product_note(text: Column) -> Column:
    """Does the piece name goods: a brand with a model or price, supplements, milk, clothes with a size or colour?"""
    key = norm(text)
    priced = key.rlike(r"\b[a-z]{1,4}\d+[a-z0-9]*\b|\b\d+k\b")
    supplement = F.contains(key, F.lit("nghe nano")) | (_has(key, ["nano"]) & (_has(key, ["plus"]) | key.rlike(r"\d")))
    milk = key.startswith("sua ") & (F.size(F.split(key, " ")) <= 4)
    dressed = _has(key, CLOTHES) & _has(key, MODIFIERS)
    coded = key.rlike(r"\bq\d{4,}\b") & _has(key, MODIFIERS + CLOTHES)
    return (_has(key, BRANDS) & priced) | supplement | milk | dressed | coded


def is_note(text: Column) -> Column:
    """Is the piece a remark to the courier, a time, a measure or goods? Empty pieces are."""
    key = norm(text)
    remark = _has(key, NOTES) | key.rlike(r"\bt[2-7]\b|\bchu nhat\b|\bthu\s*[2-7]\b")
    times = key.rlike(r"^(trua|chieu|toi|sang)$|\b(?:giao|ship|goi|nhan|lay|hen)\b.{0,24}\b(?:trua|chieu|toi|sang)\b")
    small = key.rlike(r"\b(?:cao|nang)\s*\d|^(ok|nhe|nha|a|e|em|chi|anh|vietnam|viet nam)$|^(size|sz|mau|kg|cod|thu ho|phi ship|cuoc)")
    return (key == "") | remark | times | small | (~key.rlike("^(?:tiem )?sua xe |^sua xe$") & has_product_note(text))


def is_customer_name(text: Column) -> Column:
    """Two to four capitalised words without digits, a surname first or second and no word of an address."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), CALLED, "")
    parts = F.filter(F.split(bare, r"(?U)\s+"), lambda w: w != "")
    keys = F.transform(parts, lambda w: strip_marks(F.lower(w)))
    named = F.arrays_overlap(F.slice(keys, 1, 2), F.array(*map(F.lit, SURNAMES)))
    capital = F.forall(parts, lambda w: w.rlike(r"^[A-ZÀ-Ỹ]") & ~w.rlike(r"(?U)\d"))
    return F.size(parts).between(2, 4) & capital & named & ~F.arrays_overlap(keys, F.array(*map(F.lit, NOT_IN_NAMES)))
