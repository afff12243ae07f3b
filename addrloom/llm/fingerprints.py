"""Document fingerprints by consistent weighted sampling, in DataFrame expressions only.

A document's terms are its `words`-word shingles, weighted by how often they occur. For sample k and a term with weight
S, keyed hashes give r, c ~ Gamma(2, 1) and b ~ Uniform(0, 1); t = floor(ln S / r + b) and
ln a = ln c - r * (t - b) - r. The term with the smallest a, together with its t, is the sample. Two documents agree in
a sample with a probability equal to the generalised Jaccard similarity of their weights (Ioffe's scheme).

Gamma(2, 1) = -ln(u1 * u2), drawn from two keyed hashes. A sample is held as one long, ln a above 24 bits of
hash(term, t), and the sample is the grouped minimum: plain long aggregates inside generated code. Rows meet by
document id only, so a hot source or group of copies is spread evenly and no task needs a group of documents.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLES, WORDS = 24, 2
SPACE = "[\\x20\\x09-\\x0D]+"
_SCALE, _LOW, _BITS = float(2**31), 150.0, 24


def word_array(text: Column) -> Column:
    """Lower-cased words of a text between ASCII white space; none: an empty array."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), SPACE), "")


def shingle_hashes(words: Column, n: int) -> Column:
    """64-bit hashes of the n-word shingles in order; a shorter sequence is one shingle, none gives an empty array.

    Pass a plain column: it is referred to several times.
    """
    count = F.size(words)
    shifted = [F.slice(words, 1 + i, F.greatest(count - (n - 1), F.lit(0))) for i in range(n)]
    many = F.transform(F.arrays_zip(*[s.alias(f"w{i}") for i, s in enumerate(shifted)]), lambda z: F.xxhash64(*[z[f"w{i}"] for i in range(n)]))
    return F.when(count >= n, many).when(count > 0, F.array(F.xxhash64(words))).otherwise(F.array().cast("array<bigint>"))


def sample(term: Column, log_weights: list[Column], k: int) -> list[Column]:
    """Sample k's packed long for one term under each of several weights: ln a above a hash of (term, t)."""
    uniform = lambda h, shift, bits: (F.shiftrightunsigned(h, shift).bitwiseAND(F.lit(2**bits - 1)).cast("double") + F.lit(0.5)) * F.lit(2.0**-bits)
    h, g = F.xxhash64(term, F.lit(2 * k)), F.xxhash64(term, F.lit(2 * k + 1))
    r = -F.ln(uniform(h, 0, 21) * uniform(h, 21, 21))
    ln_c = F.ln(-F.ln(uniform(g, 0, 31) * uniform(g, 31, 31)))
    b = uniform(h, 42, 22)
    out = []
    for ln_s in log_weights:
        t = F.floor(ln_s / r + b)
        ln_a = ln_c - r * (t.cast("double") - b + F.lit(1.0))
        top = F.floor((ln_a + F.lit(_LOW)) * F.lit(_SCALE)).cast("bigint")
        out.append(F.shiftleft(top, _BITS).bitwiseOR(F.xxhash64(term, t).bitwiseAND(F.lit(2**_BITS - 1))))
    return out


def packed_samples(weights: DataFrame, key: str, columns: dict[str, str], samples: int) -> DataFrame:
    """(key, term, weight columns) -> one row for each key with `<name>_<k>` longs; a weight of 0 takes no part."""
    logs = {name: F.when(F.col(w) > 0, F.ln(F.col(w).cast("double"))) for name, w in columns.items()}
    aggs = []
    staged = weights.select(key, "term", *[v.alias(f"_ln_{n}") for n, v in logs.items()])
    for k in range(samples):
        for name, packed in zip(columns, sample(F.col("term"), [F.col(f"_ln_{n}") for n in columns], k), strict=True):
            aggs.append(F.min(packed).alias(f"{name}_{k}"))
    return staged.groupBy(key).agg(*aggs)


def signature(name: str, samples: int) -> Column:
    """The fingerprint string of packed samples: 6 hex digits each; '' where there is no term."""
    low = lambda k: F.lower(F.lpad(F.hex(F.col(f"{name}_{k}").bitwiseAND(F.lit(2**_BITS - 1))), 6, "0"))
    return F.when(F.col(f"{name}_0").isNull(), F.lit("")).otherwise(F.concat(*[low(k) for k in range(samples)]))


def likeness(one: Column, other: Column, samples: int = SAMPLES) -> Column:
    """Share of agreeing samples of two fingerprint strings; two empty ones agree, an empty and a full one do not."""
    same = [F.when(F.substring(one, 6 * k + 1, 6) == F.substring(other, 6 * k + 1, 6), 1).otherwise(0) for k in range(samples)]
    total = functools.reduce(lambda a, b: a + b, same)
    return F.when((one == "") | (other == ""), (one == other).cast("double")).otherwise(total.cast("double") / F.lit(float(samples)))


def fingerprints(docs: DataFrame, samples: int = SAMPLES, words: int = WORDS) -> DataFrame:
    """(doc_id, fingerprint) of every row of docs(doc_id, text). Null and empty texts: ''. Equal texts: equal strings.

    Rows that repeat a doc_id, or have none, are fingerprinted each by its text. Other columns are ignored.
    """
    keyed = keyed_rows(docs)
    copies = keyed.groupBy("key").agg(F.count("*").alias("copies"))
    split = keyed.dropDuplicates(["key"]).select("key", word_array(F.col("text")).alias("words"))
    terms = split.select("key", F.explode_outer(shingle_hashes(F.col("words"), words)).alias("term"))
    weights = terms.groupBy("key", "term").agg(F.count("term").alias("w"))
    packed = packed_samples(weights, "key", {"own": "w"}, samples)
    return repeated(packed.join(copies, "key")).select("key.doc_id", signature("own", samples).alias("fingerprint"))


def keyed_rows(docs: DataFrame) -> DataFrame:
    """(key, text) of docs: key = (doc_id, a hash of the text), which tells rows with one doc_id, or without, apart.

    The cast lets the hash be null, as in a table read back: else a join casts the key itself, and what follows the join
    no longer counts as dealt by key, so that all terms are shuffled once more.
    """
    plain = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    key = F.struct("doc_id", F.xxhash64("text").alias("hash"))
    return plain.select(key.cast(f"struct<doc_id:{docs.schema['doc_id'].dataType.simpleString()},hash:bigint>").alias("key"), "text")


def repeated(rows: DataFrame) -> DataFrame:
    """Each row as often as its `copies` say."""
    return rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop("_copy", "copies")


def edited_pairs(docs: DataFrame, samples: int = SAMPLES, words: int = WORDS) -> DataFrame:
    """Fingerprints of each text and of its edit: the last quarter of its code points gives way to the next's first ones.

    The next document is the next in ascending doc_id, after the last the first; n = floor(n_chars / 4) code points go,
    the next document's first n (or all) come. Null texts are empty. A null doc_id comes first; different texts with one
    doc_id follow each other by a hash; rows that repeat both are one document and get its row each. A text and its edit
    share the shingles before the cut, which are drawn once with both weights.
    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.
    """
    from .common import materialize, successor

    plain = keyed_rows(docs)
    ids = plain.groupBy("key").agg(F.max(F.char_length("text").cast("bigint")).alias("n_chars"), F.count("*").alias("copies"))
    ids = materialize(successor(ids, "key", []), "order")
    if not ids.where("copies > 1").isEmpty():
        plain = plain.dropDuplicates(["key"])
    before = ids.select(F.col("next_key").alias("key"), F.col("key").alias("prev"), F.floor(F.col("n_chars") / 4).alias("prev_cut"))
    heads = plain.join(before, "key").select(F.col("prev").alias("key"), F.expr("substring(text, 1, cast(prev_cut as int))").alias("head"))
    cut = F.floor(F.char_length("text") / 4)
    both = (
        plain.join(heads, "key")
        .withColumn("common", F.expr("substring(text, 1, char_length(text) - cast(floor(char_length(text) / 4) as int))"))
        .withColumn("edited", F.when(cut > 0, F.concat("common", "head")).otherwise(F.col("text")))
    )
    # the two readers of `both` share its exchange
    facts = both.select("key", F.char_length("text").cast("bigint").alias("n_chars"), F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"))
    split = both.select(
        "key",
        word_array(F.col("text")).alias("own"),
        word_array(F.col("edited")).alias("new"),
        # shingles that end before the last, perhaps cut, word of the common part
        F.greatest(F.size(word_array(F.col("common"))) - F.lit(words), F.lit(0)).alias("shared"),
    )
    hashed = split.select("key", "shared", shingle_hashes(F.col("own"), words).alias("own"), shingle_hashes(F.col("new"), words).alias("new"))
    flagged = F.concat(
        F.transform("own", lambda t, i: F.struct(t.alias("term"), F.lit(1).alias("w"), F.when(i < F.col("shared"), 1).otherwise(0).alias("e"))),
        F.transform(F.expr("slice(new, shared + 1, size(new))"), lambda t: F.struct(t.alias("term"), F.lit(0).alias("w"), F.lit(1).alias("e"))),
    )
    terms = hashed.select("key", F.inline_outer(flagged))
    weights = terms.groupBy("key", "term").agg(F.sum("w").alias("w"), F.sum("e").alias("e"))
    packed = packed_samples(weights, "key", {"own": "w", "new": "e"}, samples)
    prints = packed.select("key", signature("own", samples).alias("fingerprint"), signature("new", samples).alias("edited_fingerprint"))
    found = materialize(prints.join(facts, "key"), "fingerprints")
    after = ids.select("key", "next_key", "copies").join(found.select(F.col("key").alias("next_key"), F.col("fingerprint").alias("next_fingerprint")), "next_key")
    return repeated(found.join(after.select("key", "next_fingerprint", "copies"), "key")).select(
        "key.doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint"), samples).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint"), samples).alias("near_next"),
    )


def op9_fingerprints(spark, sf_dir):
    """Fingerprints of every document, of its edited text, and their likeness to each other and to the next document."""
    from .common import documents

    return edited_pairs(documents(spark, sf_dir))
