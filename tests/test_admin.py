from pyspark.sql import functions as F

from addrloom.functions import text as T
from addrloom.operators import admin as A


def test_sort_key(spark):
    """By province, district and ward; numbers by size, unit words passed over, empty ones last."""
    rows = [
        ("Thành phố Hà Nội", "Huyện Đông Anh", "Thị trấn Đông Anh"),
        ("Hà Nội", "Quận Nam Từ Liêm", None),
        ("Tỉnh Lào Cai", "H. 3", "Phường 02"),
        ("TP Lào Cai", "H. 3", "P 10"),
        ("Lào Cai", "H. 12", "Xã 99999999999999999999999999999999999999999"),
        ("", "Quận 1", "Phường 2"),
        (None, None, None),
    ]
    df = spark.createDataFrame(list(reversed(rows)), "province string, district string, ward string")
    got = [tuple(r) for r in df.orderBy(A.sort_key(F.col("province"), F.col("district"), F.col("ward"))).collect()]
    assert got == rows


def test_lookup_and_migration(spark):
    unit = "uid string, name string, ord int, parent string"
    provinces = spark.createDataFrame([("p1", "Tỉnh Gia Lai", 1, None), ("p2", "Hà Nội", 2, None)], unit).drop("parent")
    districts = spark.createDataFrame([("d1", "Quận 5", 1, "p1"), ("d2", "Quận 5", 2, "p2"), ("d3", "Huyện 05", 3, "p2")], unit)
    wards = spark.createDataFrame([("w1", "Phường 1", 1, "d2"), ("w2", "Phường 1", 2, "d1")], unit)
    rows = [(1, "P. 1", "quan 05", "ha noi"), (2, "phường 01", "Quận 5", "HÀ NỘI"), (3, "Phường 1", None, "Gia Lai"), (4, None, "", "x"), (5, "Phường 1", "5", "gia lai")]
    found = A.lookup_units(spark.createDataFrame(rows, "row_id int, ward string, district string, province string"), provinces, districts, wards)
    moves = spark.createDataFrame([("w1", "Phường Mới", None)], "uid string, ward_new string, province_new string")
    regions = spark.createDataFrame([("p1", "Gia Lai mới"), ("p2", "Hà Nội mới")], "uid string, province_new string")
    got = {r.row_id: (r.province_uid, r.district_uid, r.ward_uid, r.ward_new, r.province_new) for r in A.migrated(found, moves, regions).collect()}
    assert got == {
        1: ("p2", "d2", None, None, "Hà Nội mới"),
        2: ("p2", "d2", "w1", "Phường Mới", None),
        3: ("p1", None, None, None, "Gia Lai mới"),
        4: (None, None, None, None, None),
        5: ("p1", "d1", "w2", None, "Gia Lai mới"),
    }


def test_snap(spark):
    units = spark.createDataFrame([(1, "Phường An Phú", 2), (2, "Xã An Phú", 1), (3, "An Phu A", 3), (4, "Bình Hưng", 4), (5, "Binh Hung B", 5), (6, "Tan 1", 6), (7, "Tan 2", 7)], "uid int, name string, ord int")
    names = [(1, "an phú"), (2, "An Phuu"), (3, "Binh Hun"), (4, "Tan 3"), (5, ""), (6, None), (7, "Binh"), (8, "Xã Bình Hưng")]
    got = {r.row_id: r.uid for r in A.snapped(spark.createDataFrame(names, "row_id int, name string"), units).collect()}
    assert got == {1: 2, 2: 2, 3: 4, 8: 4}


def test_masked_phones(spark):
    texts = ["gọi 0912345678 hay +84 912 345 678.", "0912345678", "84912345678x", "không", "", None, "số 012"]
    df = spark.createDataFrame([(t,) for t in texts], "text string").select(T.masked_phones(F.col("text")).alias("m"))
    assert [r.m for r in df.collect()] == ["gọi 0xxxxxxxxxhay 0xxxxxxxxx", "0xxxxxxxxx", "0xxxxxxxxxx"[:10] + "x", "không", "", "", "số 012"]
