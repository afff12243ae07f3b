from addrloom.operators import gazetteer as G
from addrloom.sources import delimited


def units(spark):
    rows = [("d1", "Quận 5", "district", 1), ("d2", "Huyện Bình Chánh", "district", 2), ("p1", "Tỉnh Gia Lai", "province", 3), ("p2", "Thành phố Đà Nẵng", "province", 4), ("x", None, "district", 5)]
    return spark.createDataFrame(rows, "uid string, name string, kind string, ord int")


def test_aliases(spark):
    got = {}
    for r in G.aliases(units(spark)).collect():
        got.setdefault((r.uid, r.strong), set()).add(r.alias)
    assert got["d1", True] == {"quan 5", "q 5", "q5", "quan 05", "q 05", "q05"} and ("d1", False) not in got
    assert got["d2", True] == {"huyen binh chanh", "h binh chanh"} and got["d2", False] == {"binh chanh"}
    assert got["p1", True] == {"tinh gia lai", "thanh pho gia lai", "tp gia lai", "t p gia lai"} and got["p1", False] == {"gia lai", "gialai"}
    assert not any(uid == "x" for uid, _ in got)


def test_named_units(spark):
    texts = [(1, "12 Lê Lợi, Q5, tp Đà Nẵng"), (2, "Gia Lai cũ, Bình Chánh, Gialai mới"), (3, None), (4, ""), (5, "đường Gia Lai, tỉnh Gia Lai")]
    records = spark.createDataFrame(texts, "row_id int, text string")
    found = G.named_units(records, G.aliases(units(spark)))
    got = {(r.row_id, r.uid): (r.score, r.pos, r.words) for r in found.collect()}
    assert got == {(1, "d1"): (2, 3, 1), (1, "p2"): (2, 4, 3), (2, "p1"): (0, 5, 1), (2, "d2"): (1, 3, 2), (5, "p1"): (2, 3, 3)}
    best = {r.row_id: r.uid for r in G.best_unit(found, units(spark)).collect()}
    assert best == {1: "p2", 2: "d2", 5: "p1"}


def test_blocked_names(spark):
    texts = [(1, "đường Gia Lai"), (2, "Gia Lai, đường Gia Lai"), (3, "thành phố Bình Chánh"), (4, "xã Bình Chánh"), (5, "5 Bình Chánh"), (6, "phố Gia Lai, tỉnh Gia Lai"), (7, "Gia Lai")]
    records, names = spark.createDataFrame(texts, "row_id int, text string"), G.aliases(units(spark))
    assert {r.row_id for r in G.named_units(records, names).collect()} == {3, 6, 7}
    assert {r.row_id for r in G.named_units(records, names, ward=True).collect()} == {3, 4, 6, 7}
    special = spark.createDataFrame([("79", "province"), ("79", "district"), ("80", "province"), (None, "province")], "uid string, kind string")
    assert sorted(r.alias for r in G.special_aliases(special).collect()) == sorted(G.SPECIAL["79"])


def test_matched_units(spark):
    """Units inside units, before them and not in their words; what one name alone tells; nulls."""
    unit = "uid string, name string, ord int, parent string"
    provinces = spark.createDataFrame([("p1", "Tỉnh Gia Lai", 1, None), ("p2", "Thành phố Đà Nẵng", 2, None)], unit).drop("parent")
    districts = spark.createDataFrame([("d1", "Huyện Hòa Vang", 1, "p2"), ("d2", "Quận 5", 2, "p1"), ("d3", "Quận 5", 3, "p2")], unit)
    wards = spark.createDataFrame([("w1", "Phường An Phú", 1, "d1"), ("w2", "Xã An Phú", 2, "d2"), ("w3", "Phường 5", 3, "d3"), ("w4", "Xã Ia Pa", 4, "d2")], unit)
    texts = [
        (1, "An Phú, Hòa Vang, Đà Nẵng"), (2, "An Phú, Hòa Vang"), (3, "p5 q5, Đà Nẵng"), (4, "An Phú, Quận 5"), (5, "xã Ia Pa, Gia Lai"),
        (6, None), (7, ""), (8, "Gia Lai cũ, Hòa Vang, Đà Nẵng"), (9, "đường Gia Lai, Hòa Vang"),
    ]
    found = G.matched_units(spark.createDataFrame(texts, "row_id int, text string"), G.catalogue(provinces, districts, wards))
    got = {r.row_id: (r.province, r.district, r.ward) for r in found.collect()}
    none = (None, None, None)
    assert got == {1: ("p2", "d1", "w1"), 2: ("p2", "d1", "w1"), 3: ("p2", "d3", "w3"), 4: none, 5: ("p1", "d2", "w4"), 6: none, 7: none, 8: ("p1", None, None), 9: ("p2", "d1", None)}


def test_delimited(spark, tmp_path):
    path = tmp_path / "rows.csv"
    path.write_text('Địa chỉ;Phường/Xã;Quận/Huyện;Tỉnh/Thành;Ghi chú\n"1 A;B";P1;Q1;T1;x\n2 C\n', encoding="utf-8")
    df = delimited.canonical(delimited.read_delimited(spark, f"file://{path}"))
    assert [tuple(r) for r in df.collect()] == [("1 A;B", "P1", "Q1", "T1"), ("2 C", "", "", "")]
