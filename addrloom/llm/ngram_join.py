"""N-gram Jaccard self-join by prefix trees.

Every document becomes a set of word n-gram hashes in one global order (the 64-bit hash itself). Blocks of sets are
held in a trie of those ordered sets; a probe walks it once, sharing the overlap counted along a path among all the
sets below, and leaves a subtree when the n-grams that remain cannot reach the needed overlap, or when all of it is in
the probe's class already, so a group of near copies costs one comparison a member and never all its pairs.

Blocks. A pair at similarity t of sizes up to N differs in at most D = floor(2 N (1 - t) / (1 + t)) n-grams, so all but
D of m > D ranges of the global order hold the same n-grams in both. Each set emits a signature of every non-empty
range, for its own band of sizes and for the next (a linked pair lies in one band or two neighbours); m is D and as many
more as large sets leave empty, as far as ranges stay filled. The rare sets whose equal ranges might all be empty also
emit the n-grams of their prefix (the first n - ceil(t n) + 1 in the order).

Documents that merely hold the same passage share a signature now and then. So sets that share many (STRONG_LEAST or more, as
one of a short text's few says little) are tied first; a
signature that still spans several of those ties compares its sets by parity bitmaps of their n-grams (bits that differ
never outnumber the n-grams that do) and ties only those which may be linked. Ties, chained, make the blocks. A block of more than `block_ngrams` n-grams is cut: each part is
joined, one set of every class found meets the others', and at last all sets outside the largest class meet every part.
No link is lost and no task holds more than two parts.

Sets that are equal collapse first, by 128 bits of their n-grams. What is shuffled: signatures, ids, and the texts of
sets that have a partner to meet; a bitmap of fixed size keeps the others out.
"""

from __future__ import annotations

import math
from fractions import Fraction

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .words import take_over

BLOCK_NGRAMS = 1_500_000
SETS = "doc_id long, n long, hi long, lo long, bits binary, sigs array<long>"
STRONG = 8  # sets that share one in so many of their signatures are tied without a look at their bitmaps
STRONG_LEAST = 3  # signatures
LEAST_BITS, MOST_BITS = 64, 8192
GROUP_SETS = 20_000  # a signature of more sets ties them all: their blocks are cut and joined exactly
_MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)


class _WordHash(dict):
    """bytes -> 64-bit hash; forgets everything after `limit` words."""

    limit = 300_000

    def __missing__(self, word: bytes) -> int:
        import xxhash

        found = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            if len(self) >= self.limit:
                self.clear()
            self[word] = found
        return found


_hashes = _WordHash()


def _mixed(x):
    import numpy as np

    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(_MIX[3])
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(_MIX[4])
    return x ^ (x >> np.uint64(32))


def ngram_set(text: bytes | None, n: int):
    """The sorted distinct hashes of a UTF-8 text's n-word shingles (A-Z lower-cased, words between ASCII white space).

    Fewer than n words: the sequence as one shingle. No words or no text: an empty array.
    """
    import numpy as np

    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    ids = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    width = min(n, len(ids))
    total = np.full(len(ids) - width + 1, width * _MIX[6] % 2**64, np.uint64)
    for i in range(width):
        total += _mixed(ids[i : len(ids) - width + 1 + i] + np.uint64((i + 1) * _MIX[0] % 2**64)) * np.uint64(_MIX[1] + 2 * i)
    return np.unique(_mixed(total))


def digest(ordered) -> tuple[int, int]:
    """128 bits of a set as two signed 64-bit numbers."""
    import numpy as np
    import xxhash

    return tuple(int(x) for x in np.frombuffer(xxhash.xxh3_128_digest(ordered.tobytes()), "<i8"))


def parity_bits(ordered) -> bytes:
    """Which of 2^k slots hold an odd number of the set's hashes; as many slots as hashes, within the two bounds."""
    import numpy as np

    slots = min(max(1 << max(len(ordered) - 1, 0).bit_length(), LEAST_BITS), MOST_BITS)
    odd = np.bincount((ordered & np.uint64(slots - 1)).astype(np.int64), minlength=slots) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _tied(ids: list, sizes: list, bits: list, threshold: Fraction) -> list[tuple[int, int]]:
    """A spanning forest over the sets of one signature whose bitmaps allow a link."""
    import numpy as np

    width = min(map(len, bits))
    maps = np.zeros((len(ids), width // 8), np.uint64)
    for at, own in enumerate(bits):  # a wider bitmap folds to the narrowest
        maps[at] = np.bitwise_xor.reduce(np.frombuffer(own, np.uint64).reshape(-1, width // 8), axis=0)
    counts = np.array(sizes, np.int64)
    up, down = threshold.numerator, threshold.denominator
    left, out = np.arange(len(ids)), []
    while len(left):
        reached, left = [int(left[0])], left[1:]
        while reached and len(left):
            a = reached.pop()
            near = np.zeros(len(left), bool)
            for at in range(0, len(left), 4096):
                part = left[at : at + 4096]
                differ = np.bitwise_count(maps[part] ^ maps[a]).sum(axis=1, dtype=np.int64)
                near[at : at + 4096] = differ * (down + up) <= (counts[part] + counts[a]) * (down - up)
            found = left[near]
            out.extend((ids[a], ids[b]) for b in found.tolist())
            reached.extend(found.tolist())
            left = left[~near]
    return out


def _ties(threshold: Fraction):
    """Rows (sig, id, n, bits) in the order of sig to ties (src, dst)."""

    def run(batches):
        import pyarrow as pa

        def table(pairs):
            return pa.record_batch([pa.array([a for a, _ in pairs], pa.int64()), pa.array([b for _, b in pairs], pa.int64())], names=["src", "dst"])

        sig, ids, sizes, bits, out = None, [], [], [], set()
        for batch in batches:
            for s, i, n, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if s != sig:
                    if len(ids) > 1:
                        out.update(_tied(ids, sizes, bits, threshold))
                        if len(out) > 100_000:
                            yield table(out)
                            out = set()
                    sig, ids, sizes, bits = s, [], [], []
                ids.append(i)
                sizes.append(n)
                bits.append(b)
        if len(ids) > 1:
            out.update(_tied(ids, sizes, bits, threshold))
        yield table(out)

    return run


class Bands:
    """Bands of set sizes for a threshold, and the ranges that a set's signatures come from."""

    def __init__(self, threshold: Fraction):
        self.t = threshold
        self.starts = [1]
        self.cuts: dict[int, int] = {}

    def band(self, size: int) -> int:
        import bisect

        while self.starts[-1] <= size:
            self.starts.append(int(self.starts[-1] / self.t) + 1)
        return bisect.bisect_right(self.starts, size) - 1

    def differ(self, total: int) -> int:
        """How many n-grams two linked sets with `total` members together may differ in."""
        return int(total * (1 - self.t) / (1 + self.t))

    def ranges(self, band: int) -> int:
        """How many ranges the sets of a window (larger set in `band`) are cut into; 0: equal sets only.

        Beyond the D ranges that may differ, there are as many more as the largest sets are likely to leave empty, where
        that adds at most half as many; else fewer, and sets with more empty ranges emit their prefix as well.
        """
        if band not in self.cuts:
            while len(self.starts) <= band + 1:
                self.starts.append(int(self.starts[-1] / self.t) + 1)
            top = self.starts[band + 1] - 1
            differ = self.differ(2 * top)

            def fewest(enough) -> int | None:
                for more in range(differ // 2 + 1):
                    empty = (differ + 1 + more) * (1 - 1 / (differ + 1 + more)) ** top
                    if enough(more, empty):
                        return more
                return None

            more = fewest(lambda more, empty: more >= empty + 6 * math.sqrt(empty) + 1)
            if more is None:
                more = fewest(lambda more, empty: more + 0.5 >= empty + 3 * math.sqrt(empty))
            self.cuts[band] = differ + 1 + (differ // 2 if more is None else more) if differ else 0
        return self.cuts[band]

    def signatures(self, ordered):
        import numpy as np

        out, size = [], len(ordered)
        band = self.band(size)
        for window in (band, band + 1):
            m = self.ranges(window)
            salt = np.uint64((window + 1) * _MIX[2] % 2**64)
            if m:
                at = ((ordered >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
                first = np.concatenate(([0], np.flatnonzero(at[1:] != at[:-1]) + 1))
                full = at[first]
                out.append(_mixed(np.add.reduceat(ordered, first) + _mixed(full * np.uint64(_MIX[5]) + salt)))
                partner = min(self.starts[window + 1] - 1, int(size / self.t))
                if m - len(full) >= m - self.differ(size + partner):  # its equal ranges may all be empty
                    prefix = size - math.ceil(self.t * size) + 1
                    out.append(_mixed(ordered[:prefix] + salt))
        return np.concatenate(out).view(np.int64) if out else np.empty(0, np.int64)


def _sets_of(n: int, threshold: Fraction):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        take_over("n-grams", _hashes.clear)
        bands = Bands(threshold)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sizes, his, los, bits, sigs = [], [], [], [], []
                for text in part.column(1):
                    ordered = ngram_set(text.as_py(), n)
                    hi, lo = digest(ordered)
                    sizes.append(len(ordered))
                    his.append(hi)
                    los.append(lo)
                    bits.append(parity_bits(ordered))
                    sigs.append(bands.signatures(ordered) if len(ordered) else np.empty(0, np.int64))
                offsets = np.concatenate(([0], np.cumsum([len(s) for s in sigs]))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sigs)))
                yield pa.record_batch([part.column(0), pa.array(sizes, pa.int64()), pa.array(his, pa.int64()), pa.array(los, pa.int64()), pa.array(bits, pa.binary()), lists], names=["doc_id", "n", "hi", "lo", "bits", "sigs"])

    return run


class _Node:
    __slots__ = ("run", "children", "leaves", "least", "most", "any", "uniform", "end")

    def __init__(self, run, end, size, member):
        self.run, self.end, self.children, self.leaves = run, end, {}, []
        self.least = self.most = size
        self.any, self.uniform = member, True


class Trie:
    """Globally ordered sets, joined on the way in. Members carry class labels, kept in a union-find."""

    def __init__(self, threshold: Fraction):
        import numpy as np

        self.up, self.down = threshold.numerator, threshold.denominator
        self.parent: dict = {}
        self.links: list[tuple] = []
        self.root = _Node(np.empty(0, np.uint64), 0, 0, None)
        self.empty = True

    def find(self, x):
        parent = self.parent
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def links_at(self, overlap: int, one: int, other: int) -> bool:
        return self.down * overlap >= self.up * (one + other - overlap)

    def probe(self, ordered, label) -> None:
        """Link label with the class of every set at or above the threshold, skipping subtrees of its own class."""
        import numpy as np

        if self.empty:
            return
        size, find = len(ordered), self.find
        stack = [(self.root, 0)]
        while stack:
            node, overlap = stack.pop()
            if node.uniform and node.any is not None and find(node.any) == find(label):
                continue
            # sizes below this node that could still link
            low, high = max(node.least, -(-size * self.up // self.down)), min(node.most, size * self.down // self.up)
            if low > high:
                continue
            run, behind = node.run, 0
            if len(run):
                at = np.searchsorted(ordered, run)
                at_safe = np.minimum(at, size - 1)
                overlap += int(np.count_nonzero(ordered[at_safe] == run))
                behind = int(np.searchsorted(ordered, run[-1], side="right"))
            # the rest of the larger sets below, or of the probe, must be able to fill the gap
            if not (self.links_at(overlap + high - node.end, size, high) and self.links_at(overlap + size - behind, size, low)):
                continue
            for member, their in node.leaves:
                if find(member) != find(label) and self.links_at(overlap, size, their):
                    self.parent[find(member)] = find(label)
                    self.links.append((label, member))
            stack.extend((child, overlap) for child in node.children.values())

    def insert(self, ordered, label) -> None:
        import numpy as np

        size, root = len(ordered), self.find(label)
        node, at = self.root, 0
        if self.empty:
            node.least = node.most = size
            node.any, self.empty = label, False
        while True:
            node.least, node.most = min(node.least, size), max(node.most, size)
            node.uniform = node.uniform and self.find(node.any) == root
            if at == size:
                node.leaves.append((label, size))
                return
            child = node.children.get(int(ordered[at]))
            if child is None:
                leaf = _Node(ordered[at:], size, size, label)
                leaf.leaves.append((label, size))
                node.children[int(ordered[at])] = leaf
                return
            span = min(len(child.run), size - at)
            differ = np.flatnonzero(child.run[:span] != ordered[at : at + span])
            same = int(differ[0]) if len(differ) else span
            if same < len(child.run):  # cut the run: the old child hangs below the common part
                upper = _Node(child.run[:same], at + same, child.least, child.any)
                upper.most, upper.uniform = child.most, child.uniform
                child.run = child.run[same:]
                upper.children[int(child.run[0])] = child
                node.children[int(ordered[at])] = upper
                child = upper
            node, at = child, at + same


def _join_block(n: int, threshold: Fraction):
    """Rows (key, hi, lo, text, label, role): role 0 goes into the trie and probes it, 1 goes in, 2 probes."""

    def run(table):
        import pyarrow as pa

        take_over("n-grams", _hashes.clear)
        trie, seen, late = Trie(threshold), set(), []
        cols = [table.column(c) for c in ("key", "hi", "lo", "text", "label", "role")]
        for key, hi, lo, text, label, role in zip(*cols, strict=True):
            key, label, role = key.as_py(), label.as_py(), role.as_py()
            ordered = ngram_set(text.as_py(), n)
            if (key, role) in seen or digest(ordered) != (hi.as_py(), lo.as_py()):
                continue  # another row with that id
            seen.add((key, role))
            if role == 2:
                late.append((ordered, label))
                continue
            if role == 0:
                trie.probe(ordered, label)
            trie.insert(ordered, label)
        for ordered, label in late:
            trie.probe(ordered, label)
        return pa.table([pa.array([a for a, _ in trie.links], pa.int64()), pa.array([b for _, b in trie.links], pa.int64())], names=["src", "dst"])

    return run


def _joined(rows: DataFrame, keys: list[str], n: int, threshold: Fraction) -> DataFrame:
    return rows.groupBy(*keys).applyInArrow(_join_block(n, threshold), "src long, dst long")


def jaccard_components(docs: DataFrame, n: int = 3, threshold: Fraction = Fraction(9, 10), block_ngrams: int = BLOCK_NGRAMS) -> DataFrame:
    """(doc_id, n_shingles, component_id) of all rows of docs(doc_id, text).

    Two documents link when |A & B| / |A | B| >= threshold over their n-word shingle sets, compared exactly;
    component_id is the smallest doc_id reachable by links. Null, empty and wordless texts have no shingles and link
    with nothing (component_id = doc_id). Equal sets always link. Repeated ids give a row each. Other columns are
    ignored. No rows: no rows. Shingles are compared by 64-bit hashes.
    """
    from .common import BITMAP_WORDS, materialize, only_near, star_fold

    plain = docs.select(F.col("doc_id").cast("long"), F.encode(F.col("text"), "UTF-8").alias("text"))
    sets = materialize(plain.mapInArrow(_sets_of(n, threshold), SETS), "sets")
    copies = materialize(sets.where("n > 0").groupBy("hi", "lo").agg(F.min("doc_id").alias("key"), F.max("n").alias("n")), "copies")

    # candidate blocks: ties of sets that share signatures
    signed = sets.where("n > 0").select(F.col("hi").alias("id"), F.size("sigs").alias("own"), F.explode("sigs").alias("sig"))
    shared = signed.groupBy("sig").agg(F.min("id").alias("leader"), F.max("id").alias("_last")).where("leader < _last").select("sig", "leader")
    shared = materialize(shared, "shared")
    held = only_near(signed, "sig", shared.select("sig"), 2 * BITMAP_WORDS).join(shared, "sig").distinct()
    held = materialize(held, "held")
    often = held.where("id <> leader").groupBy("id", "leader").agg(F.count("*").alias("common"), F.max("own").alias("own"))
    strong = materialize(often.where((F.col("common") >= STRONG_LEAST) & (F.col("common") * STRONG >= F.col("own"))).select(F.col("id").alias("src"), F.col("leader").alias("dst")), "strong")
    tied = star_fold(strong).withColumnRenamed("node", "id")
    spread = held.select("sig", "id").join(tied, "id", "left").withColumn("component", F.coalesce("component", "id"))
    spread = spread.groupBy("sig").agg(F.min("component").alias("_a"), F.max("component").alias("_b"), F.count("*").alias("_sets")).where("_a < _b")
    spread = materialize(spread.select("sig", (F.col("_sets") > GROUP_SETS).alias("wide")), "spread")
    bitmaps = sets.where("n > 0").groupBy(F.col("hi").alias("id")).agg(F.max("n").alias("n"), F.min("bits").alias("bits"))
    loose = materialize(held.join(spread.where("not wide").select("sig"), "sig").select("sig", "id"), "loose")
    loose = loose.join(only_near(bitmaps, "id", loose.select("id")), "id").select("sig", "id", "n", "bits")
    loose = loose.repartition(F.col("sig")).sortWithinPartitions("sig").mapInArrow(_ties(threshold), "src long, dst long")
    wide = held.join(spread.where("wide").select("sig"), "sig").select(F.col("id").alias("src"), F.col("leader").alias("dst"))
    blocks = star_fold(strong.unionAll(loose).unionAll(wide)).select(F.col("node").alias("hi"), F.col("component").alias("block"))
    wanted = copies.join(blocks, "hi")
    weight = wanted.groupBy("block").agg(F.sum("n").alias("w"))
    wanted = wanted.join(weight, "block").withColumn("parts", F.ceil(F.col("w") / block_ngrams).cast("long"))
    wanted = materialize(wanted.withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts"))).drop("w"), "wanted")

    # the texts of those sets
    near = only_near(plain.withColumnRenamed("doc_id", "key"), "key", wanted.select("key"))
    members = near.join(wanted, "key").select("key", "hi", "lo", "n", "text", "block", "part", "parts")
    members = materialize(members, "members")

    fresh = lambda df: df.withColumn("label", F.col("key")).withColumn("role", F.lit(0))
    links = materialize(_joined(fresh(members), ["block", "part"], n, threshold), "links")
    if members.where("parts > 1").limit(1).count():
        links = links.unionAll(_cut_blocks(members.where("parts > 1"), links, n, threshold, block_ngrams))
    classes = star_fold(links)

    found = copies.join(classes.withColumnRenamed("node", "key"), "key", "left").select("hi", "lo", F.coalesce("component", "key").alias("component_id"))
    linked = sets.where("n > 0").join(found, ["hi", "lo"]).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return linked.unionAll(sets.where("n = 0").select("doc_id", "n", "doc_id"))


def _cut_blocks(members: DataFrame, links: DataFrame, n: int, threshold: Fraction, block_ngrams: int) -> DataFrame:
    """The links between the parts of blocks too large for a task."""
    from .common import materialize, star_fold

    def labelled(found: DataFrame) -> DataFrame:
        classes = star_fold(found).select(F.col("node").alias("key"), F.col("component").alias("label"))
        return members.join(classes, "key", "left").withColumn("label", F.coalesce("label", "key"))

    # one set of each class meets those of the other parts, again in parts while that merges classes
    every, before = links, None
    while True:
        now = labelled(every)
        pivots = now.where("key = label").withColumn("role", F.lit(0))
        count = pivots.count()
        if count == before:
            break
        before = count
        width = pivots.groupBy("block").agg(F.ceil(F.sum("n") / block_ngrams).cast("long").alias("groups"))
        grouped = pivots.join(F.broadcast(width) if width.count() <= 10_000 else width, "block").withColumn("group", F.pmod(F.xxhash64("key", F.lit(count)), F.col("groups")))
        every = every.unionAll(materialize(_joined(grouped, ["block", "group"], n, threshold), "pivots"))

    # whatever is not in its block's largest class meets every part
    now = materialize(labelled(every), "labels")
    sizes = now.groupBy("block", "label").agg(F.count("*").alias("size"))
    main = sizes.groupBy("block").agg(F.max_by("label", F.struct("size", "label")).alias("main"))
    now = now.join(main, "block")
    rest = now.where("label <> main")
    width = rest.groupBy("block").agg(F.ceil(F.sum("n") / block_ngrams).cast("long").alias("chunks"))
    index = now.join(width, "block").withColumn("chunk", F.explode(F.expr("sequence(0L, chunks - 1)"))).withColumn("role", F.lit(1))
    probes = rest.join(width, "block").withColumn("chunk", F.pmod(F.xxhash64("key"), F.col("chunks")))
    probes = probes.withColumn("part", F.explode(F.expr("sequence(0L, parts - 1)"))).withColumn("role", F.lit(2))
    columns = ["block", "part", "chunk", "key", "hi", "lo", "text", "label", "role"]
    return every.unionAll(_joined(index.select(columns).unionAll(probes.select(columns)), ["block", "part", "chunk"], n, threshold))


def op1_ngram_join(spark, sf_dir):
    """All documents joined on 3-word shingles at a Jaccard similarity of 0.9."""
    from .common import documents

    return jaccard_components(documents(spark, sf_dir))
