"""Column functions for accent-free matching keys, phones and notes; all run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: what counts as a candidate phone number; the look ahead only makes the search faster.
PHONE = r"(?=[+08])(?:\+?84|0)[\d .\-]{8,13}"
NORMALIZER = "com.ibm.icu.text.Normalizer"


def strip_marks(text: Column) -> Column:
    """Without accents; đ and Đ become d and D. A null counts as ''."""
    plain = F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("đ"), F.lit("d")), F.lit("Đ"), F.lit("D"))
    return F.regexp_replace(F.reflect(F.lit(NORMALIZER), F.lit("decompose"), plain, F.lit(False)), r"\p{Mn}", "")


def norm(text: Column) -> Column:
    """Lower case, no accents, every run of other than a-z and 0-9 one blank, trimmed."""
    return F.trim(F.regexp_replace(strip_marks(F.lower(F.coalesce(text, F.lit("")))), "[^a-z0-9]+", " "))


def compact(text: Column) -> Column:
    return F.replace(norm(text), F.lit(" "), F.lit(""))


def base_name(text: Column) -> Column:
    """norm without one leading unit word, and two-digit numbers without their zero."""
    bare = F.regexp_replace(norm(text), r"^(thanh pho|tinh|quan|huyen|thi xa|thi tran|phuong|xa)\s+", "")
    return F.regexp_replace(bare, r"\b0(\d)\b", "$1")


def without_notes(text: Column) -> Column:
    """Without parentheses that say 'cũ' and isolated runs of 9 to 11 digits that start with 0."""
    kept = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?iU)\([^)]*\bc[ũu]\b[^)]*\)", " ")
    return F.regexp_replace(kept, r"(?<!\d)0\d{8,10}(?!\d)", " ")


def record_key(text: Column) -> Column:
    return norm(without_notes(text))


def phones(text: Column) -> Column:
    """Candidate phone numbers as digits, a leading 84 read as 0."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PHONE), F.lit(0))
    return F.transform(found, lambda x: F.regexp_replace(F.regexp_replace(x, r"\D", ""), "^84", "0"))


def masked_phones(text: Column) -> Column:
    """The text with each candidate phone number as 0 and an x for every further digit (a leading 84 read as 0)."""
    masks = F.transform(phones(text), lambda d: F.concat(F.lit("0"), F.call_function("repeat", F.lit("x"), F.char_length(d) - 1)))
    between = F.split(F.coalesce(text, F.lit("")), PHONE, -1)
    return F.array_join(F.zip_with(between, masks, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")


def first_phone(text: Column) -> Column:
    good = F.filter(phones(text), lambda d: d.startswith("0") & F.char_length(d).between(10, 11))
    return F.get(good, F.lit(0))


def natural_tokens(text: Column) -> Column:
    """Digit runs as numbers before words, for sorting: array of (kind, number, word)."""
    parts = F.regexp_extract_all(norm(text), F.lit(r"\d+|[^\d]+"), F.lit(0))
    digits = lambda p: p.rlike(r"^\d+$")
    return F.transform(parts, lambda p: F.struct(F.when(digits(p), 0).otherwise(1).alias("kind"), F.when(digits(p), p.cast("decimal(38,0)")).otherwise(0).alias("number"), F.when(digits(p), "").otherwise(p).alias("word")))
