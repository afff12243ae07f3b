"""Quality classifier: weak labels by expectation-maximisation, then a hashed linear scorer.

Heuristic labellers look at a document's words and vote junk (0), fine (1) or nothing (2). EM over the counts of the
distinct vote patterns (3 ** labellers at most, whatever the corpus) estimates each labeller's accuracies and every
pattern's posterior. A logistic scorer on hashed word shapes and binned signals is fitted to those posteriors on at most
`train_rows` documents (the first by a hash of the id, half of each weak class if there are enough) and scores all.

Both passes over the corpus are maps over whole texts; only pattern counts and the bounded sample reach the driver.
"""

from __future__ import annotations

import math
import re
import zlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .words import take_over

TRAIN_ROWS, BUCKETS, KEEP_AT = 4000, 1024, 0.5
JUNK, FINE, NONE, UNDEFINED = 0, 1, 2, 3
#: name: (fine up to, junk from) of a share between 0 and 1
LABELLERS = {
    "symbol_words": (0.02, 0.12),  # words that hold symbols
    "capital_words": (0.05, 0.25),  # words of two letters and more, all capitals
    "shouted_words": (0.05, 0.25),  # words that end in !! or ??
    "mark_runs": (0.02, 0.12),  # words that hold a symbol three times in a row
    "bars": (0.01, 0.08),  # words that are separators
    "stutter": (0.03, 0.15),  # words that repeat the word before
    "top_word": (0.12, 0.30),  # share of the commonest word among 20 and more
    "monotony": (0.70, 0.90),  # 1 - distinct words / words, capped for long texts
}
_SHAPE = [(re.compile(r"[^\W\d_]*[a-zß-öø-ÿ][^\W\d_]*"), "a"), (re.compile(r"[^\W\d_]+"), "A"), (re.compile(r"\d+"), "0")]
_RUN = re.compile(r"(\W)\1+")
_TRIPLE = re.compile(r"([^\w\s.!?-])\1\1")
_BARS = frozenset(["|", "||", "¦", "•", "·", "\\", "//"])


def shape(word: str) -> str:
    """Letters to a (or A, all capitals), digits to 0, repeated marks to one and a plus: 'As%%%' -> 'a%+'."""
    for pattern, mark in _SHAPE:
        word = pattern.sub(mark, word)
    return _RUN.sub(r"\1+", word)[:12]


class _Codes(dict):
    """word -> 10 bits of its shape's bucket, 5 flags, 45 bits of its hash; forgets everything after `limit` words."""

    limit = 250_000

    def __missing__(self, word: str) -> int:
        import xxhash

        core = word.rstrip(".,;:!?")
        if core.isalpha():  # most words
            capital, tail = core.upper() == core, word[len(core) :]
            flags = (len(core) >= 2 and capital) << 1 | (tail.endswith(("!!", "??"))) << 2
            pattern = ("A" if capital else "a") + (_RUN.sub(r"\1+", tail) if tail else "")
            return self.keep(word, xxhash.xxh3_64_intdigest(word), flags, pattern[:12])
        letters = sum(map(str.isalpha, word))
        symbols = sum(1 for c in word if not (c.isalnum() or c in ".,;:!?'\"()-|"))
        flags = (symbols > 0) | (letters >= 2 and word.upper() == word) << 1 | (word.endswith(("!!", "??"))) << 2
        flags |= bool(_TRIPLE.search(word)) << 3 | (word in _BARS) << 4
        return self.keep(word, xxhash.xxh3_64_intdigest(word), int(flags), shape(word))

    def keep(self, word: str, digest: int, flags: int, pattern: str) -> int:
        code = (digest >> 19) << 15 | flags << 10 | zlib.crc32(pattern.encode()) % BUCKETS
        if len(word) <= 60:
            if len(self) >= self.limit:
                self.clear()
            self[word] = code
        return code


_codes = _Codes()


def measures(text: str | None, hashing: bool = True):
    """(labellers' shares, hashed features) of a whole text; a share that is undefined is NaN, features not asked for are 0.

    Undefined: all shares of a text without words, the stutter of one word, the last two of fewer than 20 words.
    """
    import numpy as np

    words = (text or "").split()
    values = np.full(len(LABELLERS), np.nan)
    hashed = np.zeros(BUCKETS, np.float32)
    if not words:
        return values, hashed
    codes = np.fromiter(map(_codes.__getitem__, words), np.int64, len(words))
    n = len(codes)
    for i in range(5):
        values[i] = np.count_nonzero(codes >> (10 + i) & 1) / n
    if n > 1:
        values[5] = np.count_nonzero(codes[1:] == codes[:-1]) / n
    if n >= 20:
        counts = np.unique(codes >> 15, return_counts=True)[1]
        values[6] = counts.max() / n
        values[7] = max(0.0, 1 - len(counts) / min(n, 400))
    if not hashing:
        return values, hashed
    shapes = np.bincount(codes & (BUCKETS - 1), minlength=BUCKETS)
    hashed += np.sqrt(shapes / n)
    for slots, value in zip(_SLOTS, values, strict=True):
        if value == value:
            hashed[slots[int(math.sqrt(value) * 8)]] += 1
    return values, hashed


_SLOTS = [[zlib.crc32(f"{name}:{step}".encode()) % BUCKETS for step in range(9)] for name in LABELLERS]


def votes(values) -> str:
    """A digit for each labeller; between its bounds it is undecided (which may tell of junk too), without a share it abstains."""
    return "".join(str(JUNK if v >= junk else FINE if v <= fine else NONE if v == v else UNDEFINED) for v, (fine, junk) in zip(values, LABELLERS.values(), strict=True))


def expectation_maximisation(patterns: dict[str, int], rounds: int = 200) -> tuple[dict[str, float], dict]:
    """Posterior of `fine` for each vote pattern, and the fitted model.

    Votes are taken as independent given the class; who abstains (UNDEFINED) says nothing of either class. The start says
    that a junk vote is right nine times in ten.
    """
    import numpy as np

    if not patterns:
        return {}, {"prior": 1.0, "accuracy": {}}
    keys = sorted(patterns)
    seen = np.array([patterns[k] for k in keys], float)
    cast = np.array([[int(c) for c in k] for k in keys])
    junk_votes = (cast == JUNK).sum(1)
    fine = np.where(junk_votes == 0, 0.95, 0.1**junk_votes)
    rates = None
    for _ in range(rounds):
        weight = np.stack([(1 - fine) * seen, fine * seen])
        prior = (weight.sum(1) + 1) / (seen.sum() + 2)
        rates = np.stack([[(weight[c][:, None] * (cast == v)).sum(0) + 0.5 for v in (JUNK, FINE, NONE)] for c in range(2)])
        rates /= rates.sum(1, keepdims=True)
        logs = np.log(prior)[:, None] + np.array([[sum(math.log(rates[c, v, i]) for i, v in enumerate(row) if v != UNDEFINED) for row in cast] for c in range(2)])
        new = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -50, 50)))
        done, fine = np.abs(new - fine).max() < 1e-9, new
        if done:
            break
    accuracy = {name: {"junk_if_junk": float(rates[0, JUNK, i]), "junk_if_fine": float(rates[1, JUNK, i])} for i, name in enumerate(LABELLERS)}
    return dict(zip(keys, map(float, fine), strict=True)), {"prior": float(prior[1]), "accuracy": accuracy}


def fit_linear(x, target, prior: float, rounds: int = 400, rate: float = 1.0, ridge: float = 1e-4):
    """Logistic weights for soft targets; the intercept is moved from the sample's share of `fine` to the prior."""
    import numpy as np

    x, target = x.astype(np.float32), target.astype(np.float32)
    weights, bias, momentum = np.zeros(x.shape[1], np.float32), np.float32(0), np.zeros(x.shape[1] + 1, np.float32)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ weights + bias, -30, 30)))
        slope = np.append(x.T @ (p - target) / len(x) + ridge * weights, (p - target).mean())
        momentum = (0.9 * momentum + slope).astype(np.float32)
        weights -= rate * momentum[:-1]
        bias -= rate * momentum[-1]
    share = min(max(float(target.mean()), 1e-3), 1 - 1e-3)
    prior = min(max(prior, 1e-3), 1 - 1e-3)
    return weights, float(bias) + math.log(prior / (1 - prior)) - math.log(share / (1 - share))


def _vote_rows(batches):
    import pyarrow as pa

    take_over("quality", _codes.clear)
    for batch in batches:
        yield pa.record_batch([batch.column(0), pa.array([votes(measures(t.as_py(), hashing=False)[0]) for t in batch.column(1)], pa.string())], names=["doc_id", "votes"])


def _feature_rows(batches):
    import pyarrow as pa

    take_over("quality", _codes.clear)
    for batch in batches:
        yield pa.record_batch([batch.column(0), pa.array([measures(t.as_py())[1].tolist() for t in batch.column(1)], pa.list_(pa.float32()))], names=["doc_id", "features"])


def _score_rows(weights, bias, posteriors):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        take_over("quality", _codes.clear)
        for batch in batches:
            cast, scores = [], []
            for text in batch.column("text"):
                values, hashed = measures(text.as_py())
                cast.append(votes(values))
                scores.append(1 / (1 + math.exp(-float(np.clip(hashed @ weights + bias, -30, 30)))))
            added = [pa.array(cast, pa.string()), pa.array([posteriors.get(v, 1.0) for v in cast], pa.float64()), pa.array(scores, pa.float64())]
            yield pa.record_batch([*batch.columns, *added], names=[*batch.schema.names, *ADDED])

    return run


ADDED = ("votes", "weak_label", "score")


def fit(docs: DataFrame, train_rows: int = TRAIN_ROWS) -> dict:
    """The model of docs(doc_id, text): posteriors of vote patterns, labellers' accuracies, weights and bias."""
    import numpy as np

    plain = docs.select(F.col("doc_id").cast("long"), "text")
    cast = plain.mapInArrow(_vote_rows, "doc_id long, votes string")
    # one pass: a pattern's count, and its first ids by hash as the pool that the sample is drawn from
    slot = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(train_rows)).cast("int")
    cells = cast.groupBy("votes", slot.alias("slot")).agg(F.count("*").alias("n"), F.min_by("doc_id", F.xxhash64("doc_id")).alias("doc_id"))
    from .common import materialize

    cells = materialize(cells, "votes")
    patterns = {r["votes"]: r["n"] for r in cells.groupBy("votes").agg(F.sum("n").alias("n")).collect()}
    posteriors, model = expectation_maximisation(patterns)
    junk = [v for v, p in posteriors.items() if p < 0.5]
    # each task sorts out its own first rows, and only those meet
    first = lambda part: part.orderBy(F.xxhash64("doc_id", F.lit(2)), "doc_id").limit(train_rows // 2).select("doc_id", "votes")
    sample = first(cells.where(F.col("votes").isin(junk))).union(first(cells.where(~F.col("votes").isin(junk))))
    rows = plain.join(F.broadcast(sample), "doc_id").select("doc_id", "text").mapInArrow(_feature_rows, "doc_id long, features array<float>").join(F.broadcast(sample), "doc_id")
    got = rows.orderBy("doc_id").limit(train_rows).toArrow()  # train_rows * BUCKETS floats at most
    if got.num_rows:
        x = np.concatenate([c.flatten().to_numpy() for c in got.column("features").chunks]).reshape(got.num_rows, BUCKETS)
        weights, bias = fit_linear(x, np.array([posteriors[v] for v in got.column("votes").to_pylist()]), model["prior"])
    else:
        weights, bias = np.zeros(BUCKETS), 10.0
    return model | {"posteriors": posteriors, "weights": weights, "bias": bias}


def score(docs: DataFrame, model: dict) -> DataFrame:
    """docs(text, ...) with votes, weak_label and score for every row, which replace columns of those names.

    Null, empty and wordless texts get no votes, so the prior decides. Other columns pass through; repeated rows are
    scored each.
    """
    plain = docs.drop(*ADDED)
    schema = StructType([*plain.schema.fields, StructField("votes", StringType()), StructField("weak_label", DoubleType()), StructField("score", DoubleType())])
    return plain.mapInArrow(_score_rows(model["weights"], model["bias"], model["posteriors"]), schema)


def accepted() -> Column:
    """Kept: the scorer, which the weak labels have trained, does not call it junk."""
    return F.col("score") >= KEEP_AT


def op2_quality(spark, sf_dir):
    """Votes, weak label, score and decision for every document."""
    from .common import documents

    docs = documents(spark, sf_dir)
    return score(docs.select("doc_id", "text"), fit(docs)).drop("text").withColumn("accepted", accepted())
