"""Queries' digests and odd rows against plain Python."""

import hashlib
import json
import math
import os
import random
import re
import subprocess
import sys
from collections import Counter

import pytest
from pyspark.sql import functions as F

from addrloom.llm import chat, common, fingerprints, line_dedup, packing, quality, sharding, toxicity
from addrloom.llm.sentencepiece_codec import Codec

public_tokenizers = pytest.importorskip("public_tokenizers")


def test_sharding_against_hashlib(spark):
    keys = [None, "", "a", "a", "ключ", *map(str, range(200))]
    df = spark.createDataFrame([(k, "old", 7) for k in keys], "k string, shard string, _cell int")
    weights = [1.0, 2.5, 1.0]

    def best(key, ws):
        u = lambda s: (int(hashlib.md5(f"{key or ''}:{s}".encode()).hexdigest()[:13], 16) + 0.5) / 2.0**52
        return min(range(len(ws)), key=lambda s: (-math.log(u(s)) / ws[s], s))

    out = sharding.assign(df, "k", weights, grow_by=1.0)
    assert out.columns == ["k", "_cell", "shard", "slot", "grown_shard"]
    got = out.collect()
    assert len(got) == len(keys) and all(r.shard == best(r.k, weights) and r.grown_shard == best(r.k, [*weights, 1.0]) for r in got)
    for s in range(3):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))


def test_chat_against_python(spark):
    dice = random.Random(3)
    turn = lambda: (dice.choice(["user", "assistant"]), dice.choice(["", "hi", "no " * 20_000, "né"]))
    rows = []
    for i in range(30):
        a = [turn() for _ in range(dice.randrange(5))]
        rows.append((i, a, dice.choice([a, a[:1] + [turn()], [turn()], []]), "clash", "clash"))
    rows += [(99, None, rows[0][1], "clash", "clash"), (99, None, None, "clash", "clash")]
    df = spark.createDataFrame(rows, f"id int, chosen {chat.TURNS}, rejected {chat.TURNS}, prompt string, p string")
    out = chat.preference_rows(df)
    assert out.columns == ["id", "p", *chat.RESULTS]

    def shown(turns):
        text, spans = "", []
        for role, said in turns:
            text += f"<|{role}|>\n"
            if role == "assistant":
                spans.append((len(text), len(text + said + "<|end|>\n")))
            text += said + "<|end|>\n"
        return text, spans

    want = []
    for i, a, b, _, p in rows:
        a, b = a or [], b or []
        n = next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
        (c, cm), (r, rm) = shown(a[n:]), shown(b[n:])
        want.append((i, p, n, shown(a[:n])[0], c, cm, r, rm))
    got = [(r.id, r.p, r.prompt_turns, r.prompt, r.chosen, [tuple(s) for s in r.chosen_mask], r.rejected, [tuple(s) for s in r.rejected_mask]) for r in out.collect()]
    assert sorted(got) == sorted(want)


def test_fingerprints_of_repeated_and_null_ids(spark):
    words = [f"w{i}" for i in range(60)]
    rows = [(2, " ".join(words)), (2, " ".join(words)), (2, "other words here"), (None, "İx a null id"), (5, None), (9, " ".join(words[:40]))]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, key string")
    got = fingerprints.edited_pairs(df, samples=8).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in rows)
    hashed = {(r.doc_id, r.text): r.h for r in df.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).distinct().collect()}
    order = sorted(hashed, key=lambda k: (k[0] is not None, k[0] or 0, hashed[k]))
    want = []
    for at, (doc_id, text) in enumerate(order):
        text, after = text or "", order[(at + 1) % len(order)][1] or ""
        n = len(text) // 4
        edited = text[: len(text) - n] + after[:n]
        want += [(doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest())] * rows.count((doc_id, order[at][1]))
    key = lambda r: (str(r[0]), r[1], r[2])
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in got), key=key) == sorted(want, key=key)
    alone = {(r.doc_id, r.fingerprint) for r in fingerprints.fingerprints(df, samples=8).collect()}
    assert alone == {(r.doc_id, r.fingerprint) for r in got} and fingerprints.fingerprints(df, 8).count() == len(rows)
    assert fingerprints.edited_pairs(df.limit(0), samples=8).count() == 0


def test_fingerprints_shuffle_no_terms(spark, monkeypatch):
    plans, write = [], common.materialize

    def seen(df, label):
        if label != "fingerprints":
            return write(df, label)
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        raise StopIteration

    monkeypatch.setattr(common, "materialize", seen)
    docs = spark.createDataFrame([(i, f"one two three {i}") for i in range(9)], "doc_id long, text string")
    with pytest.raises(StopIteration):
        fingerprints.edited_pairs(docs)
    assert "hashpartitioning(key" in plans[0] and not re.search(r"hashpartitioning\([^)]*term", plans[0])


def test_fingerprints_estimate_weighted_jaccard(spark):
    """The share of equal samples against the generalised Jaccard similarity of word-pair counts, within 4 standard errors."""
    dice, samples = random.Random(5), 48
    base = [f"w{dice.randrange(30)}" for _ in range(300)]
    texts = [base, base[:200] + [f"x{i}" for i in range(100)], base[:250], [f"y{i}" for i in range(50)], base + base]
    pairs = [Counter(zip(t, t[1:])) for t in texts]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    prints = {r.doc_id: r.fingerprint for r in fingerprints.fingerprints(df, samples).collect()}
    for a in range(len(texts)):
        for b in range(a):
            truth = sum((pairs[a] & pairs[b]).values()) / sum((pairs[a] | pairs[b]).values())
            found = sum(prints[a][6 * k : 6 * k + 6] == prints[b][6 * k : 6 * k + 6] for k in range(samples)) / samples
            assert abs(found - truth) <= 4 * math.sqrt(truth * (1 - truth) / samples) + 1e-9


def test_packing_ids_equal_the_tokenizer():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    own, real, dice = packing.word_encoder(path), Tokenizer.from_file(path), random.Random(1)
    texts = ["İ. İ, EMRİ. EMRİ x̂, ǅ. ŉ, ẞ. Σ. ΟΔΟΣ, ﬁ."]
    for _ in range(400):
        texts.append("".join(dice.choice("abİIıßǅΣσé.,  \ṅ́xKA1'ﬁ日") for _ in range(dice.randrange(30))))
    for text, ids in zip(texts, own(texts), strict=True):
        want = real.encode(text, add_special_tokens=False).ids
        assert [int.from_bytes(ids[i : i + 4], "little") for i in range(0, len(ids), 4)] == want, text


def test_sentencepiece_private_characters():
    own = Codec(public_tokenizers.path("piece_bpe_32k.model"))
    text = "some words ▁ and  more words"
    ids = own.encode_texts([text])[0]
    assert own.decode(ids) == text and len(ids) / 4 < len(text)


def test_expectation_maximisation_by_hand():
    """Two labellers that always agree: their votes are the classes; abstaining says nothing, so the prior stands."""
    n = len(quality.LABELLERS)
    junk, fine, silent = "00" + "3" * (n - 2), "11" + "3" * (n - 2), "3" * n
    posteriors, model = quality.expectation_maximisation({junk: 300, fine: 900, silent: 100})
    assert posteriors[junk] < 0.01 and posteriors[fine] > 0.99
    assert posteriors[silent] == pytest.approx(model["prior"], abs=1e-6) and model["prior"] == pytest.approx(0.75, abs=0.02)
    assert quality.votes(quality.measures("  ")[0]) == "3" * n and quality.votes(quality.measures("#@$ %%^ &&*")[0])[6:] == "33"


def test_isotonic_against_all_block_means():
    """Each value is the largest, over starts at or before it, of the smallest mean of a run that reaches it."""
    import numpy as np

    dice = random.Random(2)
    p = np.array(sorted(dice.sample(range(1000), 40))) / 1000
    y = np.array([float(dice.random() < x) for x in p])
    want = [max(min(y[a : b + 1].mean() for b in range(i, len(y))) for a in range(i + 1)) for i in range(len(y))]
    knots, values = toxicity.isotonic(p, y)
    assert sorted(values) == list(values) and np.allclose(sorted(set(np.round(want, 9))), sorted(set(np.round(values, 9))))


def test_contradicting_and_held_out_labels_teach_nothing(spark):
    rows = [(i, "you vile fool " * 5 if i % 2 else "a calm day by the sea " * 5) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows] + [(7, 0)], "doc_id long, toxic int")
    turned = labels.withColumn("toxic", F.when(toxicity.held_out() | (F.col("doc_id") == 7), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    scores = [{r.doc_id: r.score for r in toxicity.score(docs, toxicity.fit(docs, x)).collect()} for x in (labels, turned)]
    assert scores[0] == scores[1] and all((s > 0.7) == bool(i % 2) for i, s in scores[0].items())


def test_common_prefix_of_millions_of_characters(spark):
    row = spark.sql("select repeat('abcdefghé ', 250000) as a").selectExpr("a", "concat(left(a, 2400000), 'X', substring(a, 2400002)) as b")
    assert row.select(line_dedup.common_prefix(F.col("a"), F.col("b"))).first()[0] == 2_400_000


def test_lines_without_an_id(spark):
    df = spark.createDataFrame([(None, "one line here"), (1, "one line here"), (2, "one line here\nanother"), (3, "")], "doc_id long, text string")
    classes = line_dedup.line_classes(df)
    assert not [r for r in classes.collect() if r.kept is None]
    assert {r.doc_id: r.text for r in line_dedup.without_repeats(df, classes).collect()} == {None: "one line here", 1: "", 2: "another", 3: ""}
    assert {r.doc_id for r in line_dedup.without_repeats(df, classes, drop_emptied=True).collect()} == {None, 2, 3}


def test_tables_live_as_long_as_their_owner(spark):
    free = common.materialize(spark.range(3), "free")
    with common.tables_of(spark, "test"):
        kept = common.materialize(spark.range(3), "kept")
    assert kept.count() == 3
    with common.tables_of(spark, "test"):
        pass
    assert free.count() == 3
    with pytest.raises(Exception, match="FILE_NOT_EXIST|does not exist"):
        kept.count()


def test_a_worker_returns_the_memory_of_the_operator_before():
    code = """
from addrloom.llm import words
rss = lambda: int(next(x for x in open("/proc/self/status") if x.startswith("VmRSS")).split()[1]) // 1024
import pyarrow
before = rss()
held = [bytes(1000) for _ in range(100_000)]
last = bytes(1000)
words.take_over("one", held.clear)
full = rss()
words.take_over("two", held.clear)
assert full - before > 80 and rss() - before < 40, (before, full, rss())
"""
    subprocess.run([sys.executable, "-c", code], check=True, timeout=60, cwd=os.path.dirname(os.path.dirname(packing.__file__)) + "/..")
