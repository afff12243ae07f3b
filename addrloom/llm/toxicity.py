"""Toxicity: boosted trees on dense features of whole texts, calibrated by isotonic regression.

The lexicon is learned from training labels: words, and beginnings of words, that are far commoner in toxic documents
(smoothed log odds), after undoing look-alike characters and drawn-out letters. Features are the lexicon's densities,
its closeness to words for the reader, capitals, punctuation and obfuscation rates. Training documents take their
lexicon from the other half of the training rows, so that the trees see hits as new documents have them. Trees predict
the half they were not fitted on to fit the calibration.

At most `train_rows` labelled rows (the first by a hash of the id) are used for fitting; lexicon counts are grouped in
Spark, and only the lexicon and the training rows' dense features reach the driver. Scoring is one map over all texts.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .words import take_over

TRAIN_ROWS, LEXICON, PREDICT_AT = 20_000, 4000, 0.7
TREES, DEPTH, RATE, BINS, LEAST = 120, 3, 0.1, 64, 10
FEATURES = [
    "log_words", "word_hits", "word_density", "word_peak", "word_mass", "stem_hits", "stem_density", "stem_mass", "kinds", "window",
    "reader_density", "reader_near", "capital_words", "capital_hits", "exclaims", "questions", "marks", "obfuscated", "obfuscated_hits", "drawn_out", "digits", "mean_length",
]
#: words for the reader in the corpora's languages
READER = frozenset("you your yours yourself u ur ya tu toi te ton ta tes vous votre vos du dich dir dein deine deinen ihr euch euer sie ihre ihnen usted ustedes ti tus contigo vosotros os".split())
_LOOK_ALIKE = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "i", "€": "e"})
_DRAWN = re.compile(r"(.)\1{2,}")
_EDGE = " \t.,;:!?\"'()[]{}*#%&-_~<>/\\|+="


def plain_word(word: str) -> tuple[str, bool, bool]:
    """(letters only, was it obfuscated, was it drawn out) of a word as it stands in a text."""
    core = word.strip(_EDGE).lower()
    if core.isalpha():
        short = _DRAWN.sub(r"\1", core)
        return short, False, short != core
    inner = any(map(str.isalpha, core)) and core.strip("0123456789") == core
    letters = "".join(filter(str.isalpha, core.translate(_LOOK_ALIKE)))
    short = _DRAWN.sub(r"\1", letters)
    return short, inner and bool(core) and "'" not in core and "-" not in core, short != letters


def units(word: str) -> list[str]:
    """What a plain word may match in the lexicon: itself and its beginnings."""
    return [word, *[f"{word[:k]}*" for k in (4, 5, 6) if len(word) >= k]]


class Lexicon(dict):
    """word of a text -> packed integer: strength * 1000 of word and stem, flags; forgets after `limit` words."""

    limit = 250_000

    def __init__(self, weights: dict[str, float]):
        super().__init__()
        self.weights = weights

    def __missing__(self, word: str) -> int:
        plain, hidden, drawn = plain_word(word)
        found = self.weights.get(plain, 0.0)
        stem = max((self.weights.get(u, 0.0) for u in units(plain)[1:]), default=0.0) if plain else 0.0
        letters = sum(map(str.isalpha, word))
        flags = (plain in READER) | (letters >= 2 and word.upper() == word) << 1 | hidden << 2 | drawn << 3
        code = (hash_of(plain) & 0xFFFFF) << 40 | min(int(found * 1000), 16383) << 24 | min(int(stem * 1000), 16383) << 8 | int(flags)
        if len(word) <= 60:
            if len(self) >= self.limit:
                self.clear()
            self[word] = code
        return code


def hash_of(word: str) -> int:
    import zlib

    return zlib.crc32(word.encode())


def features(text: str | None, lexicon: Lexicon):
    """The FEATURES of a whole text; null, empty and wordless ones give zeros."""
    import numpy as np

    out = np.zeros(len(FEATURES))
    text = text or ""
    words = text.split()
    if not words:
        return out
    codes = np.fromiter(map(lexicon.__getitem__, words), np.int64, len(words))
    n = len(codes)
    word, stem = (codes >> 24 & 0xFFFF) / 1000.0, (codes >> 8 & 0xFFFF) / 1000.0
    hit, near = np.flatnonzero(word > 0), np.flatnonzero(stem > 0)
    either = np.flatnonzero((word > 0) | (stem > 0))
    flag = [(codes >> i & 1).astype(bool) for i in range(4)]
    out[:10] = (
        math.log1p(n), len(hit), len(hit) / n, word.max(), word.sum() / math.sqrt(n), len(near), len(near) / n, stem.sum() / math.sqrt(n),
        len(np.unique(codes[either] >> 40)), 0,
    )
    if len(either):
        strong = np.cumsum(np.maximum(word, stem))
        span = min(50, n)
        out[9] = (strong[span - 1 :] - np.concatenate(([0.0], strong[: n - span]))).max()
        reader = np.flatnonzero(flag[0])
        if len(reader):
            at = np.clip(np.searchsorted(reader, either), 1, len(reader)) - 1
            left = np.abs(either - reader[at])
            right = np.abs(either - reader[np.minimum(at + 1, len(reader) - 1)])
            out[11] = 1.0 / (1.0 + np.minimum(left, right).min())
    chars = len(text)
    out[10] = flag[0].sum() / n
    out[12], out[13] = flag[1].sum() / n, flag[1][either].sum()
    out[14], out[15] = text.count("!") / n, text.count("?") / n
    out[16] = sum(map(text.count, ".,;:*#%&$")) / chars
    out[17], out[18], out[19] = flag[2].sum() / n, flag[2][either].sum(), flag[3].sum() / n
    out[20], out[21] = sum(map(text.count, "0123456789")) / chars, chars / n
    return out


def lexicon_weights(counts: DataFrame, toxic: int, other: int, most: int) -> dict[str, float]:
    """The `most` units with the highest strength from (unit, t, o): documents that hold a unit, by class."""
    least = max(2, math.ceil(0.004 * toxic))
    odds = F.log((F.col("t") + 0.5) / (toxic + 1.0)) - F.log((F.col("o") + 0.5) / (other + 1.0))
    best = counts.where(F.col("t") >= least).withColumn("w", odds).where("w > 2.3")
    best = best.orderBy(F.col("w").desc(), F.col("t").desc(), "unit").limit(most)
    return {r["unit"]: min(r["w"], 12.0) for r in best.collect()}


def _unit_rows(batches):
    import pyarrow as pa

    known: dict[str, list[str]] = {}
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            part = batch.slice(at, 64)
            names, toxic, half = [], [], []
            for text, label, side in zip(part.column("text"), part.column("toxic").to_pylist(), part.column("half").to_pylist(), strict=True):
                found = set()
                for w in set((text.as_py() or "").split()):
                    if w not in known:
                        if len(known) > 200_000:
                            known.clear()
                        plain = plain_word(w)[0]
                        known[w] = units(plain) if len(plain) > 2 else []
                    found.update(known[w])
                names.extend(found)
                toxic.extend([label] * len(found))
                half.extend([side] * len(found))
            yield pa.record_batch([pa.array(names, pa.string()), pa.array(toxic, pa.int32()), pa.array(half, pa.int32())], names=["unit", "toxic", "half"])


class Trees:
    """Gradient-boosted regression trees for the logistic loss on binned dense features."""

    def __init__(self, trees: int = TREES, depth: int = DEPTH, rate: float = RATE, bins: int = BINS, least: int = LEAST):
        self.trees, self.depth, self.rate, self.bins, self.least = trees, depth, rate, bins, least
        self.edges, self.start, self.model = [], 0.0, []

    def _binned(self, x):
        import numpy as np

        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], axis=1)

    def fit(self, x, y):
        import numpy as np

        self.edges = [np.unique(np.quantile(np.unique(x[:, j]), np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        binned, width = self._binned(x), self.bins + 1
        share = min(max(float(y.mean()), 1e-4), 1 - 1e-4)
        self.start = math.log(share / (1 - share))
        f = np.full(len(y), self.start)
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-f))
            slope, curve = y - p, np.maximum(p * (1 - p), 1e-9)
            node, tree = np.zeros(len(y), np.int64), {}
            for level in range(self.depth):
                first = 2**level - 1
                for k in range(first, 2 * first + 1):
                    rows = np.flatnonzero(node == k)
                    if len(rows) < 2 * self.least:
                        continue
                    best = (1e-6, -1, -1)
                    g_all, h_all = slope[rows].sum(), curve[rows].sum()
                    for j in range(x.shape[1]):
                        b = binned[rows, j]
                        g, h, c = (np.cumsum(np.bincount(b, v, width)) for v in (slope[rows], curve[rows], None))
                        gain = g**2 / (h + 1) + (g_all - g) ** 2 / (h_all - h + 1) - g_all**2 / (h_all + 1)
                        gain[(c < self.least) | (len(rows) - c < self.least)] = -1
                        at = int(gain.argmax())
                        if gain[at] > best[0]:
                            best = (float(gain[at]), j, at)
                    if best[1] >= 0:
                        tree[k] = best[1:]
                        node[rows] = 2 * k + 1 + (binned[rows, best[1]] > best[2])
            leaves = np.zeros(2 ** (self.depth + 1))
            for k in np.unique(node):
                rows = node == k
                leaves[k] = self.rate * slope[rows].sum() / (curve[rows].sum() + 1)
            f += leaves[node]
            self.model.append((tree, leaves))
        return self

    def predict(self, x):
        """Probabilities for the rows of x."""
        import numpy as np

        binned, f = self._binned(x), np.full(len(x), self.start)
        for tree, leaves in self.model:
            node = np.zeros(len(x), np.int64)
            for k in sorted(tree):
                j, at = tree[k]
                rows = node == k
                node[rows] = 2 * k + 1 + (binned[rows, j] > at)
            f += leaves[node]
        return 1 / (1 + np.exp(-f))


def isotonic(p, y):
    """Knots (x, value) of the least-squares non-decreasing fit of y on p, by pooling neighbours that violate it."""
    import numpy as np

    order = np.argsort(p, kind="stable")
    blocks: list[list[float]] = []  # sum of y, count, sum of p
    for a, b in zip(p[order], y[order], strict=True):
        blocks.append([float(b), 1.0, float(a)])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            for i in range(3):
                blocks[-1][i] += last[i]
    return np.array([b[2] / b[1] for b in blocks]), np.array([b[0] / b[1] for b in blocks])


def calibrated(p, knots):
    """The isotonic value between knots, with a fiftieth of p so that flat steps keep their order; within 0 and 1."""
    import numpy as np

    return np.clip(0.98 * np.interp(p, *knots) + 0.02 * p, 0.0, 1.0)


def held_out() -> Column:
    """Rows whose labels are never learned from."""
    return F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 3 == 1


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> dict:
    """A model from docs(doc_id, text) and labels(doc_id, toxic), of which held-out rows and null labels are left out.

    Repeated labels of a document count once; contradicting ones not at all.

    Without both classes among the training rows the model gives every document the share of toxic ones (0 if none).
    """
    import numpy as np

    chosen = labels.where(~held_out() & F.col("toxic").isin(0, 1)).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    chosen = chosen.groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most")).where("toxic = most").drop("most")
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    chosen = chosen.withColumn("half", F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(2)).cast("int"))
    from .common import materialize

    train = materialize(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"), "train")  # train_rows ids
    sums = {(r["toxic"], r["half"]): r["count"] for r in train.groupBy("toxic", "half").count().collect()}
    total = lambda t, halves: sum(sums.get((t, h), 0) for h in halves)
    if not total(1, (0, 1)) or not total(0, (0, 1)):
        return {"constant": 1.0 if total(1, (0, 1)) else 0.0}
    of = lambda t, h: F.count_if((F.col("toxic") == t) & (F.col("half") == h)).alias(f"c{t}{h}")
    counts = train.select("text", "toxic", "half").mapInArrow(_unit_rows, "unit string, toxic int, half int")
    counts = materialize(counts.groupBy("unit").agg(*[of(t, h) for t in (0, 1) for h in (0, 1)]).where("c10 + c11 >= 2"), "units")
    weights = {}
    for name, halves in ((0, (0,)), (1, (1,)), (2, (0, 1))):
        pick = counts.select("unit", sum(F.col(f"c1{h}") for h in halves).alias("t"), sum(F.col(f"c0{h}") for h in halves).alias("o"))
        weights[name] = lexicon_weights(pick, total(1, halves), total(0, halves), LEXICON)

    def dense(batches):
        import pyarrow as pa

        own = {h: Lexicon(weights[1 - h]) for h in (0, 1)}
        for batch in batches:
            rows = [features(t.as_py(), own[h]).tolist() for t, h in zip(batch.column("text"), batch.column("half").to_pylist(), strict=True)]
            yield pa.record_batch([pa.array(rows, pa.list_(pa.float64())), batch.column("toxic"), batch.column("half"), batch.column("doc_id")], names=["x", "toxic", "half", "doc_id"])

    got = train.mapInArrow(dense, "x array<double>, toxic int, half int, doc_id long").orderBy("doc_id").limit(2 * train_rows).toArrow()
    x, y, half = np.array(got.column("x").to_pylist()), got.column("toxic").to_numpy().astype(float), got.column("half").to_numpy()
    if min(len(set(y[half == h])) for h in (0, 1)) == 2:
        away = np.empty(len(y))
        for h in (0, 1):
            away[half == h] = Trees().fit(x[half != h], y[half != h]).predict(x[half == h])
        knots = isotonic(away, y)
    else:
        knots = (np.array([0.0, 1.0]), np.array([0.0, 1.0]))
    return {"weights": weights[2], "trees": Trees().fit(x, y), "knots": knots}


def score(docs: DataFrame, model: dict) -> DataFrame:
    """docs(text, ...) with `score`, the calibrated probability of being toxic, which replaces a column of that name.

    Null and empty texts are scored from zero features. Repeated rows are scored each; other columns pass through.
    """

    def run(batches):
        import numpy as np
        import pyarrow as pa

        take_over("toxicity", lambda: None)
        lexicon = Lexicon(model.get("weights", {}))
        for batch in batches:
            if not batch.num_rows:
                continue
            if "constant" in model:
                scores = np.full(batch.num_rows, model["constant"])
            else:
                x = np.stack([features(t.as_py(), lexicon) for t in batch.column("text")])
                scores = calibrated(model["trees"].predict(x), model["knots"])
            yield pa.record_batch([*batch.columns, pa.array(scores, pa.float64())], names=[*batch.schema.names, "score"])

    plain = docs.drop("score")
    return plain.mapInArrow(run, StructType([*plain.schema.fields, StructField("score", DoubleType())]))


def op3_toxicity(spark, sf_dir):
    """Score and prediction for every document."""
    from .common import documents, read_table

    docs = documents(spark, sf_dir)
    scored = score(docs.select("doc_id", "text"), fit(docs, read_table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= PREDICT_AT).cast("int").alias("predicted"))
