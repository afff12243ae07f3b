import re
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from addrloom.llm import common, fingerprints, line_dedup, ngram_join, packing, quality, sharding, topk, toxicity
from addrloom.llm.sentencepiece_codec import Codec, first_draws, gaps_of

public_tokenizers = pytest.importorskip("public_tokenizers")
WORDS = "ash bay cob dew elm fig gum hay ivy jay".split()


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, sig long, line string")


@pytest.fixture(scope="module")
def docs(spark):
    base = " ".join(WORDS[(i * i + 3 * i) % 10] + str(i) for i in range(80))
    rows = [(1, base), (2, base), (3, base.replace("ash0", "xxx")), (4, None), (5, ""), (6, "two words"), (7, "two words"), (8, base[:200]), (9, "x" * 50_000)]
    return frame(spark, [(i, t, 0, "clash") for i, t in rows]).cache()


def shingles(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else ({tuple(words)} if words else set())


@pytest.mark.parametrize("threshold, block", [(Fraction(9, 10), 10**6), (Fraction(4, 5), 100)])
def test_ngram_join_against_all_pairs(docs, threshold, block):
    sets = {r.doc_id: shingles(r.text, 3) for r in docs.collect()}
    root = {i: i for i in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]):
                low, high = sorted((root[a], root[b]))
                root = {k: low if v == high else v for k, v in root.items()}
    got = ngram_join.jaccard_components(docs, 3, threshold, block).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {i: (len(sets[i]), root[i]) for i in sets}


def test_ngram_join_of_nothing(docs):
    assert ngram_join.jaccard_components(docs.where("doc_id < 0")).count() == 0


def test_packing_round_trip(docs):
    path = public_tokenizers.path("word_bpe_49k.json")
    got = packing.pack(docs, path, window=64, open_windows=4).collect()
    encode = packing.word_encoder(path)
    for r in docs.collect():
        parts = sorted((p for p in got if p.doc_id == r.doc_id), key=lambda p: p.start)
        assert b"".join(bytes(p.ids) for p in parts) == encode([r.text or ""])[0] + (2).to_bytes(4, "little")
    for s in {p.sequence_id for p in got}:
        own = sorted((p.offset, p.length) for p in got if p.sequence_id == s)
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:])) and sum(n for _, n in own) <= 64


def test_sharding_moves_rows_only_into_the_new_shard(spark):
    got = sharding.assign(spark.range(3000).withColumnRenamed("id", "doc_id"), "doc_id", [1.0, 2.0, 1.0], grow_by=1.0, cells=8).collect()
    assert all(r.grown_shard in (r.shard, 3) for r in got)
    for s in range(3):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))
    assert 1300 < sum(r.shard == 1 for r in got) < 1700


def test_topk_against_sorting(spark):
    rows = [(i, [(i * 7 + j * 3) % 11 - 5 for j in range(4)]) for i in range(60)] + [(99, None)]
    df = spark.createDataFrame(rows, "id long, vector array<long>")
    got = topk.exact_topk(df.where("id % 20 = 0"), df, 5, tile=2, shard=7, block=3, fan_in=2).collect()
    for q in (0, 20, 40):
        want = sorted((-sum(a * b for a, b in zip(rows[q][1], v)), i) for i, v in rows if v and i != q)[:5]
        assert [(r.vec_id, r.score) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] == [(i, -s) for s, i in want]


def test_fingerprints(docs):
    got = {r.doc_id: r for r in fingerprints.edited_pairs(docs, samples=8).collect()}
    assert got[1].fingerprint == got[2].fingerprint and got[1].near_next == 1.0
    assert got[4].fingerprint == got[5].fingerprint == "" and got[4].near_next == 1.0 and got[4].n_chars == 0


@pytest.mark.parametrize("most", [48, 1])
def test_lines_one_edit_apart(spark, most):
    lines = ["the quick brown fox jumps", "the quick brown fox jump", "the quick brown fix jumps", "the slow brown fox jumps!", "tiny", "the quick brown fox jumps"]
    df = frame(spark, [(1, "\n".join(lines[:3]), 0, ""), (2, "\n".join(lines[3:]), 0, ""), (3, None, 0, "")])
    got = {(r.doc_id, r.line_no): (r.class_doc_id, r.class_line_no, r.kept) for r in line_dedup.line_classes(df, 1, 10, most).collect()}
    assert got == {(1, 0): (1, 0, True), (1, 1): (1, 0, False), (1, 2): (1, 0, False), (2, 0): (2, 0, True), (2, 2): (1, 0, False)}
    left = {r.doc_id: r.text for r in line_dedup.without_repeats(df, line_dedup.line_classes(df, 1, 10, most)).collect()}
    assert left == {1: lines[0], 2: lines[3] + "\n" + lines[4], 3: None}


def test_every_line_has_a_row(spark):
    """Short lines go when equal, a 23-character line one edit from a 24-character one too; short ones never by edits."""
    texts = ["All rights reserved.\nLes.\nDes.\nabcdefghijklmnopqrstuvw", "Les.\n\nabcdefghijklmnopqrstuvwx\nAll rights reserved."]
    df = frame(spark, [(i, t, 0, "") for i, t in enumerate(texts)])
    classes = line_dedup.line_classes(df)
    got = {(r.doc_id, r.line_no): (r.class_doc_id, r.class_line_no, r.class_size) for r in classes.collect()}
    assert got == {(0, 0): (0, 0, 2), (0, 1): (0, 1, 2), (0, 2): (0, 2, 1), (0, 3): (0, 3, 2), (1, 0): (0, 1, 2), (1, 2): (0, 3, 2), (1, 3): (0, 0, 2)}
    assert {r.doc_id: r.text for r in line_dedup.without_repeats(df, classes).collect()} == {0: texts[0], 1: ""}


@pytest.mark.parametrize("most", [48, 1])
def test_lines_of_several_edits_against_all_pairs(spark, most):
    """Edited copies of lines of 10 to 70 characters, numbered lines and lines of one beginning, in small and hot groups."""
    import random

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    dice = random.Random(11)
    lines = [f"page {7 * i} of the book of hours" for i in range(12)]
    for n in (10, 12, 23, 24, 36, 40, 70):
        for start in ("", "the same start "):
            line = start + "".join(dice.choice("abcde é") for _ in range(n - len(start)))
            lines.append(line)
            for _ in range(6):
                new = list(line)
                for _ in range(dice.randrange(1, 5)):
                    at = dice.randrange(len(new))
                    new[at : at + dice.randrange(2)] = dice.choice(["", "x", "e"])
                lines.append("".join(new))
    root = list(range(len(lines)))
    for a in range(len(lines)):
        for b in range(a):
            if lines[a] == lines[b] or distance(lines[a], lines[b]) <= min(3, min(len(lines[a]), len(lines[b])) // 12):
                low, high = sorted((root[a], root[b]))
                root = [low if x == high else x for x in root]
    df = frame(spark, [(i, t, 0, "") for i, t in enumerate(lines)])
    got = {r.doc_id: r.class_doc_id for r in line_dedup.line_classes(df, most=most).collect()}
    assert got == dict(enumerate(root)) and len(set(root)) < len(lines) - 20


def test_one_changed_word_links_by_default(spark):
    df = frame(spark, [(1, "a line of ingedre and more, ble.", 0, ""), (2, "a line of ingedre and more, the.", 0, ""), (3, "a line of ingedre and less, the.", 0, "")])
    assert {r.doc_id: r.class_doc_id for r in line_dedup.line_classes(df).collect()} == {1: 1, 2: 1, 3: 3}


def test_sentencepiece_equals_the_library_and_decodes():
    import sentencepiece
    from array import array

    path = public_tokenizers.path("piece_bpe_32k.model")
    own, model = Codec(path), sentencepiece.SentencePieceProcessor(model_file=path)
    for text in ["", " ", "  two  blanks\n\nand lines\t", "日本語 é 🎉", "plain words, and more."]:
        plain = array("I")
        plain.frombytes(own.encode_texts([text])[0])
        assert list(plain) == model.encode(text)
    for text in ["a ▁ b", "x y", "varied segmentations of ordinary words"]:
        assert all(own.decode(own.encode_texts([text], seed, 0, 0.3)[0]) == text for seed in range(20))
    assert len({own.encode_texts(["varied segmentations of ordinary words"], seed, 0, 0.3)[0] for seed in range(20)}) > 5


def test_sentencepiece_dropout_is_drawn_for_every_occurrence():
    """Occurrences of a word vary in a text and between texts, as often as merge dropout with draws of its own would."""
    from array import array

    own, times = Codec(public_tokenizers.path("piece_bpe_32k.model"), limit=50), 4000
    text = " ".join(["segmentation"] * times)
    pieces, rest = own.segment("▁segmentation")
    one, two = own.encode_texts([text, text], 5, [1, 2], 0.1)
    assert one != two and [one, two] == own.encode_texts([text, text], 5, [1, 2], 0.1) and own.decode(one) == text
    assert one == own.encode_texts([text], 5, 1, 0.1)[0]
    starts = own.encode_texts([text], 5, 1, 0.0)[0]
    assert starts == own.ids_of(pieces) * times
    units = own.encode_units(["▁segmentation"] * times, first_draws([(5, 1)], [times]), 0.1)
    assert b"".join(units) == one and len(set(units)) > 10
    # replayed one by one from the same gaps, without the cache
    draws = first_draws([(5, 1)], [times])
    for k in range(0, times, 97):
        gaps = (int(gaps_of(draws[k : k + 1], turn, 0.1)[0]) for turn in range(200))
        assert units[k] == own.ids_of(own.segment("▁segmentation", gaps)[0])
    for unit in ["▁segmentation", "▁antidisestablishment", "aaaaaaaa", "▁", ""]:
        for gaps in ([], [0], [1], [0, 0], [2, 1, 0]):
            with_heap = own.segment(unit + "\x00" * 30, gaps)[0]
            assert own.segment(unit, gaps)[0] == [p for p in with_heap if p != "\x00"]
    unskipped = sum(int(g) >= rest for g in gaps_of(draws, 0, 0.1)) / times
    assert abs(unskipped - 0.9**rest) < 0.04
    long = "x" * 300
    assert own.decode(own.encode_texts([long], 1, 1, 0.3)[0]) == long != "" and len(array("I", own.encode_texts([long], 1, 1, 1.0)[0])) >= 300


def test_quality_and_toxicity_on_odd_rows(spark, docs):
    model = quality.fit(docs)
    assert quality.score(docs, model).count() == docs.count()
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 9)], "doc_id long, toxic int")
    scores = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
    assert len(scores) == docs.count() and all(0 <= r.score <= 1 for r in scores)
    assert [c for c in toxicity.score(docs, {"constant": 0.0}).columns if c == "line"] == ["line"]
    assert toxicity.score(docs.withColumn("score", F.lit("x")), {"constant": 0.5}).first().score == 0.5


@pytest.mark.parametrize("group", [ngram_join.GROUP_SETS, 2])
def test_ngram_join_of_shared_passages(spark, monkeypatch, group):
    """Texts of one long passage and words of their own, some of them near copies, against all pairs."""
    import random

    monkeypatch.setattr(ngram_join, "GROUP_SETS", group)
    dice = random.Random(7)
    passage = [f"p{i}" for i in range(70)]
    texts = []
    for i in range(40):
        own = [f"w{dice.randrange(10**6)}" for _ in range(dice.choice([5, 20, 60, 120]))]
        texts.append(own[:10] + passage + own[10:])
        if i % 3 == 0:
            texts.append([w if dice.random() > 0.01 else "zz" for w in texts[-1]])
    df = frame(spark, [(i, " ".join(t), 0, "") for i, t in enumerate(texts)])
    sets = [shingles(" ".join(t), 5) for t in texts]
    root = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                low, high = sorted((root[a], root[b]))
                root = [low if x == high else x for x in root]
    got = {r.doc_id: r.component_id for r in ngram_join.jaccard_components(df, 5, Fraction(4, 5)).collect()}
    assert got == dict(enumerate(root))


def test_parity_bits_never_reject_a_link():
    import numpy as np

    dice = np.random.default_rng(3)
    for size in (50, 700, 5000):
        one = np.unique(dice.integers(0, 2**63, size, dtype=np.uint64))
        for changed in (0, 2, size // 20, size // 9):
            other = np.unique(np.concatenate((one[changed:], dice.integers(0, 2**63, changed, dtype=np.uint64))))
            linked = 5 * len(np.intersect1d(one, other)) >= 4 * len(np.union1d(one, other))
            tied = ngram_join._tied([1, 2], [len(one), len(other)], [ngram_join.parity_bits(one), ngram_join.parity_bits(other)], Fraction(4, 5))
            assert tied == [(1, 2)] or not linked


def test_near_copies_keep_rows_without_an_id(spark):
    import corpus_pipeline

    text = " ".join(WORDS)
    df = frame(spark, [(1, text, 0, ""), (2, text, 0, ""), (None, text, 0, ""), (None, None, 0, "")])
    got = [(r.doc_id, r.text) for r in corpus_pipeline.drop_near_copies(spark, df, "").collect()]
    assert sorted(got, key=str) == sorted([(1, text), (None, text), (None, None)], key=str)


def test_what_no_line_indexes_is_not_shuffled(spark, monkeypatch):
    from addrloom.llm import common

    class Seen(Exception):
        pass

    write = common.materialize

    def seen(df, label):
        if label == "distinct":
            return write(df, label)
        raise Seen(df._jdf.queryExecution().executedPlan().toString())

    monkeypatch.setattr(common, "materialize", seen)
    lines = spark.createDataFrame([(" ".join(WORDS) + str(i),) for i in range(9)], "line string")
    with pytest.raises(Seen) as found:
        line_dedup.line_links(lines)
    plan = str(found.value)
    assert plan.index("hashpartitioning(sig") < plan.index("BroadcastHashJoin [_word") < plan.index("Generate explode")
    own = line_dedup.segments(lines.withColumn("size", F.char_length("line")), 3, only_own=True)
    assert own.where("own").count() == own.count() == 9 * 4


def test_linked_short_sets_share_a_signature():
    import numpy as np

    dice = np.random.default_rng(5)
    for threshold in (Fraction(9, 10), Fraction(4, 5)):
        bands, seen = ngram_join.Bands(threshold), 0
        for _ in range(6000):
            size = int(dice.integers(1, 130))
            one = np.unique(dice.integers(0, 2**64, size, dtype=np.uint64))
            changed = int(dice.integers(0, size // 4 + 2))
            other = np.unique(np.concatenate((one[changed:] if size % 2 else one, dice.integers(0, 2**64, changed, dtype=np.uint64))))
            if set(one) != set(other) and len(np.intersect1d(one, other)) >= threshold * len(np.union1d(one, other)):
                seen += 1
                assert np.intersect1d(bands.signatures(one), bands.signatures(other)).size
        assert seen > 500


def test_short_texts_of_one_phrase_make_no_block(spark, monkeypatch):
    """Short texts that share a phrase, and no others, are not compared; a near copy among them still is."""
    import random

    from addrloom.llm import common

    write, blocks = common.materialize, []

    def seen(df, label):
        out = write(df, label)
        if label == "members":
            blocks.extend(r["count"] for r in out.groupBy("block").count().collect())
        return out

    monkeypatch.setattr(common, "materialize", seen)
    dice = random.Random(3)
    texts = [[f"w{dice.randrange(10**6)}" for _ in range(22)] for _ in range(400)]
    texts = [t[: i % 20] + "all rights are reserved by us".split() + t[i % 20 :] for i, t in enumerate(texts)]
    texts.append([*texts[7], "more"])
    got = ngram_join.jaccard_components(frame(spark, [(i, " ".join(t), 0, "") for i, t in enumerate(texts)])).collect()
    assert {r.doc_id: r.component_id for r in got} == {**{i: i for i in range(400)}, 400: 7}
    assert max(blocks) < 10


def test_new_units_of_a_batch_are_segmented_together(monkeypatch):
    import random

    import numpy as np

    own, dice = Codec(public_tokenizers.path("piece_bpe_32k.model")), random.Random(9)
    units = ["", "a", "▁", "日本語é", "\udc80x", "x" * 24, "aaaaaaaa", "y" * 40]
    units += ["▁" * dice.randrange(2) + "".join(dice.choice("etaoinshrdlu0é") for _ in range(dice.randrange(1, 30))) for _ in range(600)]
    for turns in (0, 1, 3):
        gaps = np.array([[dice.randrange(5) for _ in range(turns)] for _ in units], np.int64).reshape(len(units), turns)
        for unit, row, (ids, rest) in zip(units, gaps.tolist(), own.together(units, gaps), strict=True):
            pieces, left = own.segment(unit, row)
            assert (ids, rest) == (own.ids_of(pieces), left)
    calls, segment = [], Codec.segment
    monkeypatch.setattr(Codec, "segment", lambda self, *args: calls.append(1) or segment(self, *args))
    texts = [" ".join("".join(dice.choice("etaoinshr") for _ in range(7)) for _ in range(400)) for _ in range(5)]
    assert [own.decode(x) for x in own.encode_texts(texts, 5, [1, 2, 3, 4, 5], 0.1)] == texts
    assert len(calls) < 200


def test_marks_never_rule_out_a_link(spark):
    import random

    dice, rows = random.Random(4), []
    for _ in range(400):
        line = "".join(dice.choice("abcde é") for _ in range(dice.randrange(12, 60)))
        new = list(line)
        edits = dice.randrange(1, 4)
        for _ in range(edits):
            at = dice.randrange(len(new))
            new[at : at + dice.randrange(2)] = dice.choice(["", "x", "e"])
        rows.append((line, "".join(new), edits))
    one = line_dedup.marks(spark.createDataFrame(rows, "line string, other string, edits int")).toDF("line", "other", "edits", "even_a", "odd_a")
    both = line_dedup.marks(one.drop("line").withColumnRenamed("other", "line"))
    got = both.selectExpr("edits", "bit_count(even_a ^ even) + bit_count(odd_a ^ odd) as apart").collect()
    assert all(r.apart <= line_dedup.MARKS * r.edits for r in got) and max(r.apart for r in got) > 6


def test_lines_of_other_words_are_not_paired(spark, monkeypatch):
    """Copies of one line in which words differ meet in one group; the pairs written are few, and near ones still link."""
    import random

    from addrloom.llm import common

    write, pairs = common.materialize, []

    def seen(df, label):
        out = write(df, label)
        if label == "pairs":
            pairs.append(out.count())
        return out

    monkeypatch.setattr(common, "materialize", seen)
    dice = random.Random(8)
    word = lambda: "".join(dice.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(8))
    base, lines = [word() for _ in range(12)], []
    for _ in range(200):
        new = list(base)
        for at in dice.sample(range(12), 2):
            new[at] = word()
        lines.append(" ".join(new))
    lines.append("0" + lines[5][1:-1])
    df = frame(spark, [(i, t, 0, "") for i, t in enumerate(lines)])
    got = {r.doc_id: r.class_doc_id for r in line_dedup.line_classes(df).collect()}
    assert got == {**{i: i for i in range(200)}, 200: 5}
    assert pairs[-1] < 200


def one_place_each(dice, count):
    """Copies of one line, each with four letters put in behind one of its words; a few of them with two edits more."""
    letters = lambda n: "".join(dice.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    base, lines = [letters(dice.randrange(3, 9)) for _ in range(60)], []
    for i in range(count):
        new = list(base)
        new[dice.randrange(60)] += letters(4)
        lines.append(" ".join(new))
        if not i % 20:
            lines.append("0" + lines[-1][1:-1])
    return lines


def classes_of(spark, lines, most):
    return {r.doc_id: r.class_doc_id for r in line_dedup.line_classes(frame(spark, [(i, t, 0, "") for i, t in enumerate(lines)]), most=most).collect()}


@pytest.mark.parametrize("crowd", [256, 2])
def test_lines_that_part_in_other_places_are_not_paired(spark, monkeypatch, crowd):
    """Lines of one hot group that part from its pivot in other cells make no pair; the classes are those of all pairs."""
    import random

    from addrloom.llm import common

    lines = one_place_each(random.Random(3), 240)
    want = classes_of(spark, lines, 10**6)
    write, pairs = common.materialize, []

    def seen(df, label):
        out = write(df, label)
        if label == "pairs":
            pairs.append(out.count())
        return out

    monkeypatch.setattr(common, "materialize", seen)
    monkeypatch.setattr(line_dedup, "CROWD", crowd, raising=False)
    assert classes_of(spark, lines, 48) == want and len(set(want.values())) < len(lines) - 10
    assert sum(pairs) < 6000


def test_grossly_different_strings_are_ruled_out_by_windows(spark):
    """No pair within the edits is ruled out, and one that differs at both ends or in the middle is."""
    import random

    dice, rows = random.Random(6), []
    for _ in range(400):
        line = "".join(dice.choice("abcde é") for _ in range(dice.choice([12, 30, 36, 80, 300])))
        new, edits = list(line), dice.randrange(4)
        for _ in range(edits):
            at = dice.choice([0, len(new) - 1, dice.randrange(len(new))])
            new[at : at + dice.randrange(2)] = dice.choice(["", "x", "e"])
        rows.append((line, "".join(new), True))
    far = "".join(dice.choice("abcdefghijklmnop") for _ in range(300))
    rows += [(far, far[:100] + far[150:200] + far[100:150] + far[200:], False), (far, far[50:] + far[:50], False)]
    got = spark.createDataFrame(rows, "a string, b string, near boolean").select("near", line_dedup.plausible(3).alias("kept")).collect()
    assert all(r.near == r.kept for r in got)


def jobs_of(spark, run):
    """What run() returns, and how many Spark jobs it took."""
    spark.sparkContext.setJobGroup("counted", "counted")
    before = len(spark.sparkContext.statusTracker().getJobIdsForGroup("counted"))
    try:
        return run(), len(spark.sparkContext.statusTracker().getJobIdsForGroup("counted")) - before
    finally:
        spark.sparkContext._jsc.clearJobGroup()


def test_components_of_a_small_graph_take_few_jobs(spark, monkeypatch):
    chain = [(i, i + 1) for i in range(-40, 40)]
    odd = [(7, 7), (3, 2), (-(2**63), 2**63 - 1), (500, 300), (300, 900), (900, 500), (None, 1), (60, None), (70, 70)]
    edges = spark.createDataFrame(chain + odd, "src long, dst long")
    root = {i: -40 for i in range(-40, 41)} | {-(2**63): -(2**63), 2**63 - 1: -(2**63), 300: 300, 500: 300, 900: 300}
    got, jobs = jobs_of(spark, lambda: common.star_fold(edges).collect())
    assert {r.node: r.component for r in got} == root and len(got) == len(root)
    assert jobs <= 8  # 84 in rounds
    monkeypatch.setattr(common, "FOLD_EDGES", 0)
    assert sorted(common.star_fold(edges).collect()) == sorted(got)


@pytest.mark.parametrize("at_most", [0, common.FOLD_EDGES])
def test_components_of_no_edges(spark, monkeypatch, at_most):
    monkeypatch.setattr(common, "FOLD_EDGES", at_most)
    assert common.star_fold(spark.createDataFrame([(5, 5)], "src long, dst long")).collect() == []


def test_components_against_a_search(spark):
    import numpy as np

    for nodes, count in ((30, 20), (2000, 1500), (300, 3000)):
        u, v = np.random.default_rng(nodes).integers(-nodes, nodes, (2, count))
        near = {}
        for a, b in zip(u.tolist(), v.tolist(), strict=True):
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
        expected = {}
        for start in sorted(near):
            left = [start] if start not in expected else []
            while left:
                node = left.pop()
                if expected.setdefault(node, start) == start:
                    left.extend(x for x in near[node] if x not in expected)
        assert dict(zip(*(x.tolist() for x in common.folded(u, v)), strict=True)) == expected
