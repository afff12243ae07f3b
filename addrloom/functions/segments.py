"""Abbreviations, courier phrases, segments and display forms of free-text addresses, as ordered rewrites in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .address import clean_spaces, nfc, title_case

# The rewrites of abbreviated addresses, in the order in which they apply.
UNITS = (
    "đường|duong|phố|pho|ngõ|ngo|ngách|ngach|hẻm|hem|kiệt|kiet|thôn|thon|xóm|xom|ấp|ap|tổ|to|khu|khối|khoi|đội|doi|bản|ban|buôn|buon|khóm|khom"
)
SEPARATORS = [(r"(?U)\s*_+\s*", ", "), (r"(?U)\s*[!！]+\s*", ", ")]
BEFORE_ROADS = [
    (r"(?iU)\bkhu\s*dc\b", "Khu Dân Cư"),
    (r"(?iU)\b([pxqh])\.?\s*(\d{1,2})([qxph]\d{1,2})\b", "$1$2 $3"),
    (r"(?iU)([A-Za-zÀ-ỹĐđ]{2,})([qpxh]\d{1,2})\b", "$1 $2"),
    (r"(?iU)\b(số|so|sn|nhà|nha)(?=\d)", "$1 "),
    (rf"(?iU)(?<=\d)(?=(?:{UNITS})(?:\d|\b))", " "),
    (rf"(?iU)\b({UNITS})(?=\d)", "$1 "),
    (r"(?U)\b(\d+)([A-Za-zÀ-ỹĐđ]{2,})(?=\s|$)", "$1 $2"),
    (r"(?iU)\b[đd]\s*[.,/]\s*c\b", "Địa chỉ"),
    (r"(?iU)\bng\.\s*", "Ngõ "),
    (r"(?iU)\bngo[õồỗ]\b|\bngõo\b", "Ngõ"),
    (r"(?U)\b[Đđ]\s+(?=[A-ZÀ-Ỹ][a-zà-ỹ])", "Đường "),
]
ROAD_CODE, ROADS = r"(?iU)\b(?:đt|dt|ql|tl|hl)\s*\.?\s*[1-9]\d{0,2}[a-zA-Z]?\b", {"đt": "Đường Tỉnh", "dt": "Đường Tỉnh", "ql": "Quốc Lộ", "tl": "Tỉnh Lộ", "hl": "Hương Lộ"}
AFTER_ROADS = [
    (r"(?iU)\b[đd]\.(?!\s*c)\s*", "Đường "),
    (r"(?iU)\bđ/c\b|\bd/c\b|\bđc\b|\bdc\b", "Địa chỉ"),
    (r"(?iU)\b(?:địa\s*chỉ|dia\s*chi)\b\s*[.:：-]*", ", "),
    (r"(?iU)(?:địa\s*chỉ|dia\s*chi)(?:\s+(?:của|cua)\s+\w+)?\s*[:：]", ", "),
    (r"(?iU)\bsnha\b|\bsn\b", "Số nhà"),
    (r"(?iU)\btthcs\b", "Trường THCS"),
    (r"(?iU)\btrường\s+mn\b", "Trường Mầm Non"),
    (r"(?iU)\bmn\s+(?=[A-ZÀ-Ỹ])", "Mầm Non "),
    (r"(?iU)\bbv\b", "Bệnh Viện"),
    (r"(?iU)\bub\s*nd\b", "UBND"),
    (r"(?iU)\bcty\b|\bc\.ty\b|\bcông\s*tỷ\b", "Công Ty"),
    (r"(?iU)\bkcn\b|\bkhu\s*cn\b", "Khu Công Nghiệp"),
    (r"(?iU)\bcụm\s*cn\b|\bcum\s*cn\b", "Cụm Công Nghiệp"),
    (r"(?iU)\bkcx\b", "Khu Chế Xuất"),
    (r"(?iU)\bkdc\b", "Khu Dân Cư"),
    (r"(?iU)\bk[dđ]t\b", "Khu Đô Thị"),
    (r"(?iU)\bcc\b", "Chung Cư"),
    (r"(?iU)\b(?:kp|k\.p)\.?\s*(\d+[a-zA-Z]?)\b", "Khu Phố $1"),
    (r"(?iU)\btdp\.?\s*(\d+[a-zA-Z]?)\b", "Tổ Dân Phố $1"),
    (r"(?iU)\bsap\.?\s*(\d+[a-zA-Z]?)\b", "Sạp $1"),
    (r"(?iU)\btk\.?\s*([1-9]\d{0,2}[a-zA-Z]?)\b", "Tiểu Khu $1"),
    (r"(?U)([A-Za-zĐđ]*[à-ỹ][a-zà-ỹ]*)(\d{1,2})\b", "$1 $2"),
    (r"(?iU)(bệnh\s*viện)\s+[đd]k\b", "$1 Đa Khoa"),
    (r"(?iU)\b(khu\s*phố|khu\s*pho)\s*(\d)", "$1 $2"),
    (r"(?iU)\b(ấp|ap|thôn|thon|xóm|xom|tổ|to|đội|doi|khóm|khom|khối|khoi|bản|ban|buôn|buon|sóc|soc)\s*(\d+[a-zA-Z]?)\b", "$1 $2"),
    (r"(?U)(?<=[a-zà-ỹđ])(?=(?:Khu\s*Phố|Khóm|Thôn|Xóm|Ấp|Tổ\s|Phường|Xã|Quận|Huyện|Tỉnh|Đường|Phố)\b)", " "),
    (r"(?U)(?<=[a-zà-ỹđ])(?=\d{2,}\b)", " "),
]
# Unit words left behind at the end of a name, what they stand for, and the words after which they are names.
DANGLING = {"ph": "Phường", "p": "Phường", "f": "Phường", "q": "Quận", "h": "Huyện", "x": "Xã", "tp": "Thành phố", "tt": "Thị trấn", "tx": "Thị xã"}
BEFORE_A_NAME = [
    "phường", "phuong", "xã", "xa", "quận", "quan", "huyện", "huyen", "tỉnh", "tinh", "tp", "tt", "tx", "thị", "thi", "trấn", "tran",
    "phố", "pho", "đường", "duong", "ngõ", "ngo", "hẻm", "hem", "kiệt", "kiet", "khu", "lô", "lo", "tòa", "toà", "toa", "tổ", "to", "ấp",
    "ap", "thôn", "thon", "xóm", "xom", "số", "so", "p", "q", "h", "x", "f",
]
UNIT_AHEAD = r"(?i:phường|phuong|xã|xa|quận|quan|huyện|huyen|tỉnh|tinh|thành|thanh|thị|thi|tp|tt|tx|p|q|h|x|f)\b"
# What couriers and customers write before an address.
INTRO = (
    r"(?iU)^\s*(?:ok[!.]?\s*)?(?:em\s+g(?:ửi|ởi|ui|oi)\s+về\s+địa\s+chỉ\s+người\s+nhận|em\s+g(?:ửi|ởi|ui|oi)\s+ve\s+dia\s+chi\s+nguoi\s+nhan"
    r"|em\s+g(?:ửi|ởi|ui|oi)\s+về|em\s+g(?:ửi|ởi|ui|oi)\s+ve|hàng\s+g(?:ửi|ởi)\s+về\s+địa\s+chỉ\s+này\s+giúp\s+mình\s+nhé"
    r"|hang\s+g(?:ui|oi)\s+ve\s+dia\s+chi\s+nay\s+giup\s+minh\s+nhe|địa\s+chỉ\s+giao\s+hàng|dia\s+chi\s+giao\s+hang|viet\s+ship\s+mình\s+địa\s+chỉ"
    r"|viet\s+ship\s+minh\s+dia\s+chi|ship\s+mình\s+đến\s+địa\s+chỉ|ship\s+minh\s+den\s+dia\s+chi|ship\s+đến|ship\s+den|giao\s+đến|giao\s+den"
    r"|gửi\s+chị\s+đi\s+nhé\s+về|gui\s+chi\s+di\s+nhe\s+ve|gửi\s+chị\s+đi\s+nhé|gui\s+chi\s+di\s+nhe|g(?:ửi|ởi)\s+về|g(?:ui|oi)\s+ve|gửi\s+chị|gui\s+chi"
    r"|địa\s+chỉ|dia\s+chi|đc|dc|đ/c|d/c|người\s+nhận|nguoi\s+nhan|khách\s*hàng|khach\s*hang|tên\s*kh|ten\s*kh)\s*[:：\-.]*\s*"
)
# Words and phrases that are not shown in title case.
SHOWN = [
    ("Ubnd", "UBND"), ("Thcs", "THCS"), ("thcs", "THCS"), ("Thpt", "THPT"), ("Tnhh", "TNHH"), ("Bhxh", "BHXH"), ("Kcn", "KCN"), ("Kcx", "KCX"),
    ("Kdc", "KDC"), ("Kdt", "KĐT"), ("Ttyt", "TTYT"), ("Vg", "VG"), ("Cp", "CP"), ("Cđ", "CĐ"), ("Mn", "Mầm non"), ("Bv", "Bệnh viện"),
    ("Cty", "Công ty"), ("Toà", "Tòa"), ("Vpbank", "VPBank"), ("Cntt", "CNTT"), ("Tt", "TT"), ("Ptdtbt", "PTDTBT"), ("Mầm Non", "Mầm non"),
    ("Tiểu Học", "Tiểu học"), ("Trung Học", "Trung học"), ("Công Ty", "Công ty"), ("Bệnh Viện", "Bệnh viện"), ("Ngân Hàng", "Ngân hàng"),
    ("Khu Phố", "Khu phố"), ("Tổ Dân Phố", "Tổ dân phố"), ("Tòa Nhà", "Tòa nhà"), ("Nhà Thuốc", "Nhà thuốc"), ("Phòng Khám", "Phòng khám"),
    ("Trạm Y Tế", "Trạm y tế"), ("Trung Tâm", "Trung tâm"), ("Nhà Văn Hóa", "Nhà văn hóa"), ("Khu Công Nghiệp", "Khu công nghiệp"),
    ("Cụm Công Nghiệp", "Cụm công nghiệp"), (r"PTDTBT\s+Th", "PTDTBT TH"), ("Th-THCS", "TH-THCS"),
]


def rewritten(text: Column, rules: list[tuple[str, str]]) -> Column:
    """The rules applied one after the other."""
    for pattern, replacement in rules:
        text = F.regexp_replace(text, pattern, replacement)
    return text


def mapped(text: Column, pattern: str, change: Callable[[Column], Column]) -> Column:
    """Every match of the pattern changed by a column function, which a plain replacement cannot do."""
    found = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), change)
    return F.array_join(F.zip_with(F.split(text, pattern, -1), found, lambda between, hit: F.concat(between, F.coalesce(hit, F.lit("")))), "")


def _named(table: dict[str, str], key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def full_roads(text: Column) -> Column:
    """Road codes such as ql1a written out: the kind of road and the number with a capital letter."""
    kind = lambda hit: _named(ROADS, F.lower(F.left(hit, F.lit(2))))
    return mapped(text, ROAD_CODE, lambda hit: F.concat(kind(hit), F.lit(" "), F.upper(F.regexp_extract(hit, r"[1-9]\d{0,2}[a-zA-Z]?$", 0))))


def moved_units(text: Column) -> Column:
    """'Thắng Ph , Hoà' becomes 'Thắng, Phường Hoà': a unit word before a comma belongs to the name after it.

    Not where the word before makes it a name, or where the next piece has a unit word of its own.
    """
    pattern = rf"(?U)\w+\s+(?:Ph|P|F|Q|H|X|Tp|TP|Tt|TT|Tx|TX)\.?\s*,\s*(?=[A-ZĐÀ-Ỹ])(?!{UNIT_AHEAD})"
    before = lambda hit: F.regexp_extract(hit, r"(?U)^\w+", 0)
    word = lambda hit: F.lower(F.regexp_extract(hit, r"(?U)^\w+\s+([A-Za-z]+)", 1))
    moved = lambda hit: F.concat(before(hit), F.lit(", "), _named(DANGLING, word(hit)), F.lit(" "))
    return mapped(text, pattern, lambda hit: F.when(F.lower(before(hit)).isin(BEFORE_A_NAME), hit).otherwise(moved(hit)))


def expanded(text: Column) -> Column:
    """Abbreviations written out, glued words and numbers parted, odd separators as commas; a null counts as ''."""
    return rewritten(full_roads(rewritten(moved_units(rewritten(nfc(text), SEPARATORS)), BEFORE_ROADS)), AFTER_ROADS)


def without_intro(text: Column) -> Column:
    """Without what introduces an address."""
    blank = F.lit(" \t\n\r")
    bare = F.btrim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^[^\wÀ-ỹĐđ]+", " "), blank)
    return F.btrim(F.regexp_replace(bare, INTRO, ""), blank)


def segments(text: Column) -> Column:
    """The pieces between separators, none of them empty. Dashes inside codes and number ranges stay; others separate."""
    rules = [
        (r"[()]+", ","),
        (r"(?U)\s+\.\s+", ", "),
        (r"(?U)(?<=\d)[-–—](?=[A-ZÀ-ỸĐ][a-zà-ỹđ])", ","),
        (r"(?U)(?<=\w)[-–—](?=\w)", "\u0001"),
        (r"(?U)(?<=\d)\s*[-–—]\s*(?=\d)", "\u0001"),
        (r"(?iU)\b(th)\s*[-–—]\s*(thcs)\b", "$1\u0001$2"),
        (r"(?U)\s*[-–—|;]\s*", ","),
        ("\u0001", "-"),
    ]
    parts = F.split(rewritten(F.coalesce(text, F.lit("")), rules), r"[,;\n\r\t|]+")
    return F.filter(F.transform(parts, lambda p: F.btrim(p, F.lit(" ,.-:/"))), lambda p: p != "")


def display(text: Column) -> Column:
    """How a piece is shown: title case, known abbreviations and phrases, short codes with a digit in capitals."""
    titled = title_case(F.regexp_replace(clean_spaces(text), r"(?iU)\bCông\s*Tỷ\b", "Công Ty"))
    shown = rewritten(titled, [(rf"(?U)\b{a}\b", b) for a, b in SHOWN])
    return F.btrim(mapped(shown, r"(?U)\b(?=[A-Za-z0-9]*\d)[A-Za-z0-9]{1,6}\b", F.upper), F.lit(" ,.-"))
