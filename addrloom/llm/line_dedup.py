"""Line dedup by a segment-partition edit join, in DataFrame expressions only.

Two lines link within `edits` edits, but the shorter must have LINK_CHARS characters for each edit: k = `allowed` edits.
A line of length L within k edits of a line of length l <= L holds one of its k + 1 segments unchanged, near the place
it had. Every line indexes its own segments under (l, segment number, hash) and probes the substrings of a longer line
that could be such a segment, for every length from L - k to L (the offsets that two-sided counting of edits leaves).
Lines that meet are compared in a few short windows, then by the built-in distance; those of more than SHORT characters
after trimming their common prefix and suffix, by a banded bit-parallel automaton: 2 k + 1 diagonals in one word for each
number of edits.

Groups of more than `most` lines under one segment are not paired at once. Each of their lines first emits what is left
around every window of k characters, and every string that lacks one of its characters: lines of one length that agree
outside one window are all linked, so a star does; a line that equals another's shortened string is linked with it. That
costs a line's length in rows, and with one edit it finds every link. With more, lines of a group that these links have
not made one class are compared with one line of it, the pivot: of two lines that link, each must leave the pivot's text
before the other has gone too far from it, from the beginning as from the end. So lines meet only in the cells of that
text (l from the beginning, r from the end) where both may part from it, one of them for the first time. More than CROWD lines of one cell are
split again by the segments of what surrounds the shared one (a pair within k edits shares one of those as well), and
lines of different classes that still meet are compared: all of them, however many. Both joins look at parity marks of
their bigrams, which an edit changes in at most 4 places, and make a row only of those which may be linked.
What is left of the square: lines of one cell, up to CROWD of them each with each, and beyond that those that also share
a segment around.
Links make classes (connected components); a class keeps its first line, by document id and line number.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EDITS, MIN_CHARS, MOST = 3, 1, 48
INDEX_WORDS = 1 << 20  # of the bitmap of indexed segments, 40 MB as a broadcast table; beyond some 25 million distinct lines it keeps little out
MARKS = 4  # slots of the marks that an edit may change
WINDOW, WINDOWS = 32, 8  # characters and number of the windows that rule out most pairs
SHORT = 1000  # characters of the longest strings that the built-in distance compares
CROWD = 256  # lines that part from a pivot in one cell and are compared at once; more are split again
CELLS, LOOKS = 16, (8, 16, 32, 64, 128, 256)  # parts of a pivot's text; characters after which a line is compared with it
LINK_CHARS = 12  # of the shorter line, for each edit of a link: in less, one edit makes another word


def lines_of(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, line_no, line) of the lines of at least min_chars characters; line_no counts all lines, from 0."""
    every = docs.select("doc_id", F.posexplode(F.split(F.col("text"), "\n")).alias("line_no", "line"))
    return every.where(F.char_length("line") >= min_chars)


def probes(edits: int):
    """(shorter by, segment, offset) of every substring that a line looks up; offset 0 at its own length is its index."""
    for less in range(edits + 1):
        for i in range(edits + 1):
            for offset in range(max(-i, less - (edits - i)), min(i, less + (edits - i)) + 1):
                yield less, i, offset


def allowed(size: Column, edits: int) -> Column:
    """The edits that a link may take whose shorter line has `size` characters."""
    return F.least(F.floor(size / LINK_CHARS).cast("int"), F.lit(edits))


def segments(lines: DataFrame, edits: int, only_own: bool = False) -> DataFrame:
    """lines(..., size) with a row for every segment that a line indexes (own) or looks up; only_own: for those it indexes.

    Adds most, whole, i, start and width: segment i of lines of `whole` characters, where `most` edits are allowed (or
    as many as a column k says), begins after `start` characters. The looked-up places are exploded as a literal, so that
    one short generated expression serves them all.
    """
    every = [(most, *probe) for most in range(1, edits + 1) for probe in probes(most) if not only_own or probe[0] == probe[2] == 0]
    names = ("most", "less", "i", "offset")
    literal = lambda some: F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, probe, strict=True)]) for probe in some])
    long = F.col("k") == edits if "k" in lines.columns else F.col("size") >= (LINK_CHARS + 1) * edits  # no shorter line has fewer edits
    each = F.when(long, literal([probe for probe in every if probe[0] == edits])).otherwise(literal(every))
    rows = lines.withColumn("_x", F.explode(each)).select(*lines.columns, "_x.*").withColumn("whole", F.expr("size - less"))
    rows = rows.where(F.col("most") == (F.col("k") if "k" in lines.columns else allowed(F.col("whole"), edits)))
    # the last whole % (most + 1) segments have one character more
    rows = rows.withColumn("base", F.expr("cast(whole div (most + 1) as int)")).withColumn("short", F.expr("most + 1 - whole % (most + 1)"))
    rows = rows.withColumn("start", F.expr("base * i + greatest(i - short, 0) + offset")).withColumn("width", F.expr("base + if(i >= short, 1, 0)"))
    rows = rows.where("whole >= 0 and start >= 0 and start + width <= size").withColumn("own", F.expr("less = 0 and offset = 0"))
    return rows.select(*lines.columns, "most", "whole", "i", "start", "width", "own")


def signature(text: str, *inside: str) -> Column:
    """The hash of a row of segments; equal ones are where lines meet."""
    return F.xxhash64(*inside, "whole", "i", F.substr(text, F.col("start") + 1, "width"))


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the common prefix of two strings by halving steps, however long they are."""
    steps = F.filter(F.array(*[F.lit(1 << k) for k in range(30, -1, -1)]), lambda s: s <= F.greatest(F.char_length(a), F.lit(1)))
    return F.aggregate(steps, F.lit(0), lambda at, s: F.when((at + s <= F.least(F.char_length(a), F.char_length(b))) & (F.substr(a, at + 1, s) == F.substr(b, at + 1, s)), at + s).otherwise(at))


def within(left: Column, right: Column, n: Column, m: Column, edits: int, k: Column, first: int | None = None) -> Column:
    """Is the edit distance of two character arrays of n and m characters at most k (1 to `edits`)?

    Bit r of word d at column j: cost <= d at row j - edits + r. With `first`, only that many columns are looked at, and
    the answer is whether k edits are still possible. Pass plain columns.
    """
    start = F.struct(*[F.lit(sum(1 << (edits + i) for i in range(d + 1))).alias(f"r{d}") for d in range(edits + 1)])
    upto = m if first is None else F.least(m, F.lit(first))
    columns = F.when(upto > 0, F.sequence(F.lit(1), upto)).otherwise(F.array().cast("array<int>"))
    same = lambda j: sum((F.when(F.get(left, j - edits + r - 1) == F.get(right, j - 1), 1 << r).otherwise(0) for r in range(2 * edits + 1)), F.lit(0))

    def step(state, match):
        rows = []
        for d in range(edits + 1):
            now = state[f"r{d}"].bitwiseAND(match)
            if d:
                now = now.bitwiseOR(state[f"r{d - 1}"]).bitwiseOR(F.shiftright(state[f"r{d - 1}"], 1)).bitwiseOR(F.shiftleft(rows[-1], 1))
            rows.append(now.bitwiseAND(F.lit((1 << (2 * edits + 1)) - 1)))
        return F.struct(*[row.alias(f"r{d}") for d, row in enumerate(rows)])

    def finish(state):
        return F.coalesce(*[F.when(k == d, state[f"r{d}"]) for d in range(1, edits + 1)])

    last = F.aggregate(F.transform(columns, same), start, step, finish)
    if first is not None:
        return last != 0
    return (F.abs(n - m) <= k) & (F.call_function("shiftright", last, n - m + edits).bitwiseAND(F.lit(1)) == 1)


def plausible(edits: int) -> Column:
    """False only for strings a and b that more than `edits` edits part, by a look at short windows at equal places.

    What a window of a is aligned with begins and ends at most `edits` characters from the window of b at its place, so
    that one is at most 3 * edits edits away; at the common beginning, or at the common end, 2 * edits.
    """
    window = lambda side, at: F.substr(F.col(side), at + 1, F.lit(WINDOW))
    near = lambda a, b, most: F.levenshtein(a, b, most) >= 0
    last = lambda side: F.call_function("right", F.col(side), F.lit(WINDOW))
    ends = near(window("a", F.lit(0)), window("b", F.lit(0)), 2 * edits) & near(last("a"), last("b"), 2 * edits)
    inner = [F.expr(f"cast(char_length(a) * {i} div {WINDOWS} as int)") for i in range(1, WINDOWS)]
    return reduce(lambda x, y: x & y, [near(window("a", at), window("b", at), 3 * edits) for at in inner], ends)


def verified(pairs: DataFrame, edits: int) -> DataFrame:
    """The pairs (src, dst) of rows (src, dst, a, b) whose strings a and b are within the edits allowed for the shorter.

    The built-in distance takes time with the product of the lengths, so pairs of more than SHORT characters are trimmed
    and run through the automaton instead. The trimmed strings are written once: a filter above them would otherwise be
    rewritten in terms of the whole trim.
    """
    from .common import materialize

    sized = pairs.withColumn("k", allowed(F.least(F.char_length("a"), F.char_length("b")), edits)).withColumn("long", F.char_length("a") > SHORT)
    sized = sized.where("k > 0 and abs(char_length(a) - char_length(b)) <= k").where(plausible(edits))
    sized = sized.where(F.col("long") | F.levenshtein("a", "b", edits).between(0, F.col("k")))
    text = lambda c: F.when(F.col("long"), F.col(c)).alias(c)
    sized = materialize(sized.select("src", "dst", "k", "long", text("a"), text("b")), "plausible")
    trimmed = sized.where("long").withColumn("p", common_prefix(F.col("a"), F.col("b")))
    trimmed = trimmed.select("src", "dst", "k", F.expr("substring(a, p + 1)").alias("a"), F.expr("substring(b, p + 1)").alias("b"))
    trimmed = trimmed.withColumn("s", common_prefix(F.reverse("a"), F.reverse("b")))
    trimmed = trimmed.select("src", "dst", "k", F.expr("left(a, char_length(a) - s)").alias("a"), F.expr("left(b, char_length(b) - s)").alias("b"))
    sides = [F.split("a", "").alias("left"), F.split("b", "").alias("right"), F.char_length("a").alias("n"), F.char_length("b").alias("m")]
    trimmed = materialize(trimmed.select("src", "dst", "k", *sides), "trimmed")
    # both ends differ now, so one edit leaves no two characters on both sides
    trimmed = trimmed.where("k > 1 or n < 2 and m < 2")
    sides = [F.col(c) for c in ("left", "right", "n", "m")]
    # most pairs differ early
    near = trimmed.where(within(*sides, edits, F.col("k"), 16))
    return sized.where("not long").select("src", "dst").union(near.where(within(*sides, edits, F.col("k"))).select("src", "dst"))


def reach(x: str, t: str, edits: int) -> Column:
    """(start, stop): x leaves t after `start` characters and is more than `edits` edits off any beginning of t by `stop`.

    Two strings within `edits` edits, one of which equals t for the first `stop` + edits characters of the other, would
    leave that many edits to less text than needs them; so the spans start to stop + edits - 1 of linked strings overlap.
    stop is null where x stays near t for as far as looked. x and t are columns without their common beginning of
    `start` characters: pass what is left of them.
    """
    beginning = lambda c, n: F.expr(f"left({c}, {n})")
    near = lambda n: reduce(lambda a, b: a | b, [F.levenshtein(beginning(x, n), beginning(t, n + o), edits) >= 0 for o in range(-edits, edits + 1)])
    return F.coalesce(*[F.when(~near(n), n) for n in LOOKS])


def spans(lines: DataFrame, edits: int) -> DataFrame:
    """lines(id, group, pivot, a, t) with a row for each cell (l, r) of the pivot's text t in which a may part from it.

    l counts from the beginning and r from the end; begins and ends: it is the first in which a does. Lines that link
    share a cell (l, r) in which one of them begins and one ends, and no more than one such cell.
    """
    rows = lines.withColumn("step", F.expr(f"char_length(t) div {CELLS} + 1"))
    for side, turn in (("l", lambda c: F.col(c)), ("r", F.reverse)):
        rows = rows.withColumn("x", turn("a")).withColumn("y", turn("t")).withColumn("start", common_prefix(F.col("x"), F.col("y")))
        rows = rows.withColumn("x", F.expr("substring(x, start + 1, 300)")).withColumn("y", F.expr("substring(y, start + 1, 300)"))
        rows = rows.withColumn("stop", F.coalesce(F.col("start") + reach("x", "y", edits) + (edits - 1), F.char_length("t")))
        rows = rows.withColumn(side, F.expr("sequence(cast(start div step as int), cast(least(stop, char_length(t)) div step as int))"))
    rows = rows.select("id", "group", "pivot", F.posexplode("l").alias("_l", "l"), "r").select("id", "group", "pivot", "_l", "l", F.posexplode("r").alias("_r", "r"))
    return rows.select("id", "group", "pivot", "l", "r", F.expr("_l = 0").alias("begins"), F.expr("_r = 0").alias("ends"))


def marks(lines: DataFrame) -> DataFrame:
    """lines(..., line) with even and odd: which of 128 slots hold an odd number of the line's bigrams.

    A replaced character takes two bigrams and brings two, one put in or left out changes three: at most MARKS slots an edit.
    """
    nothing = F.lit(0).cast("long")
    bigrams = F.transform(F.sequence(F.lit(1), F.char_length("line")), lambda at: F.xxhash64(F.substr(F.col("line"), at, F.lit(2))))
    bit = lambda h: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 1).bitwiseAND(F.lit(63)).cast("int"))
    held = lambda side: F.aggregate("_bigrams", nothing, lambda all, h: all.bitwiseXOR(F.when(h.bitwiseAND(F.lit(1)) == side, bit(h)).otherwise(nothing)))
    return lines.withColumn("_bigrams", bigrams).withColumn("even", held(0)).withColumn("odd", held(1)).drop("_bigrams")


def met(members: DataFrame, edits: int | None = None) -> DataFrame:
    """Pairs (src, dst) of members(sig, id, own, ...) with one sig, where src owns it; columns group: of different groups only.

    edits: members have marks, and pairs whose marks rule out so few edits are left out. Columns begins and ends: only
    pairs of which one begins and one ends there.
    """
    apart = "src <> dst and (not both or src < dst)"
    apart += " and group_a <> group_b" if "group" in members.columns else ""
    apart += " and (begins_a or begins_b) and (ends_a or ends_b)" if "begins" in members.columns else ""
    apart += f" and bit_count(even_a ^ even_b) + bit_count(odd_a ^ odd_b) <= {MARKS * edits}" if edits else ""
    seen = [c for c in ("group", "begins", "ends", "even", "odd") if c in members.columns]
    own = members.where("own").select("sig", F.col("id").alias("src"), *[F.col(c).alias(f"{c}_a") for c in seen])
    other = members.select("sig", F.col("id").alias("dst"), F.col("own").alias("both"), *[F.col(c).alias(f"{c}_b") for c in seen])
    return own.join(other, "sig").where(apart).select("src", "dst").distinct()


def line_links(lines: DataFrame, edits: int = EDITS, most: int = MOST) -> DataFrame:
    """Links (src, dst) between hashes of different lines within `edits`, enough for the components to be right.

    The shorter line of a link has LINK_CHARS characters or more for each edit.
    """
    from .common import materialize, only_near, star_fold

    if edits < 1:
        raise ValueError("edits must be 1 or more; equal lines need no join")
    lines = lines.where(F.char_length("line") >= LINK_CHARS)
    keyed = lines.select(F.xxhash64("line").alias("id"), "line").dropDuplicates(["id"])  # copies are one line from here on
    keyed = materialize(keyed, "distinct")
    sized = keyed.withColumn("size", F.char_length("line"))
    # what is looked up but nowhere indexed mostly stays behind; the rest is shuffled once, for the groups and their members
    signed = segments(sized, edits).select("id", signature("line").alias("sig"), "own")
    signed = only_near(signed, "sig", segments(sized, edits, only_own=True).select(signature("line").alias("sig")), INDEX_WORDS)
    signed = signed.repartition(F.col("sig"))
    shared = signed.groupBy("sig").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.max("own").alias("own"))
    members = signed.join(shared.where("low < high and own").select("sig"), "sig").groupBy("sig", "id").agg(F.max("own").alias("own"))
    members = materialize(members, "members")
    size = members.groupBy("sig").agg(F.count("*").alias("size"))
    pairs = materialize(met(members.join(size.where(F.col("size") <= most), "sig")), "pairs")
    hot = members.join(size.where(F.col("size") > most), "sig")
    crowd = materialize(hot.select("id").distinct(), "crowd")
    wanted = materialize(pairs.select("src").union(pairs.select("dst")).union(crowd).distinct().toDF("id"), "ids")
    texts = materialize(only_near(keyed, "id", wanted).join(wanted, "id"), "lines")
    side = lambda key, text: texts.select(F.col("id").alias(key), F.col("line").alias(text))
    links = verified(pairs.join(side("src", "a"), "src").join(side("dst", "b"), "dst"), edits)

    packed = texts.join(crowd, "id")
    places = packed.withColumn("at", F.explode(F.sequence(F.lit(1), F.char_length("line"))))
    parted = lambda width: [F.char_length("line").alias("size"), F.expr("left(line, at - 1)").alias("head"), F.substr("line", F.col("at") + width).alias("tail")]
    less = parted(F.lit(1))[1:]
    holes = places.select("id", "at", *parted(allowed(F.char_length("line"), edits)), F.xxhash64(F.concat(*less)).alias("shorter"))
    holes = materialize(holes.select("id", F.xxhash64("size", "at", "head", "tail").alias("hole"), F.when(F.col("size") > LINK_CHARS, F.col("shorter")).alias("dst")), "holes")
    swaps = holes.select(F.col("id").alias("src"), F.min("id").over(Window.partitionBy("hole")).alias("dst")).where("src <> dst")
    shorter = holes.select("id", "dst").join(crowd.select(F.col("id").alias("dst")), "dst")
    shorter = shorter.where("id <> dst").select(F.col("id").alias("src"), "dst")
    links = links.union(swaps).union(shorter).distinct()
    if edits == 1:
        return links

    links = materialize(links, "links")
    grouped = hot.join(star_fold(links).withColumnRenamed("node", "id"), "id", "left")
    grouped = grouped.select("sig", "id", "own", F.coalesce("component", "id").alias("group"))
    crowds = grouped.select("id", "group").distinct().groupBy("group").agg(F.count("*").alias("ids"))
    # the line that stands for the largest class of a group is its pivot
    parts = grouped.join(crowds, "group").groupBy("sig").agg(F.min("group").alias("low"), F.max("group").alias("high"), F.max(F.struct("ids", "group")).alias("_most"))
    parts = materialize(parts.where("low < high").select("sig", F.col("_most.group").alias("pivot")), "parts")
    grouped = materialize(grouped.join(parts, "sig").select("sig", "id", "group", "pivot"), "grouped")
    placed = grouped.select("id", "group", "pivot").distinct().join(side("id", "a"), "id").join(side("pivot", "t"), "pivot")
    placed = materialize(spans(placed, edits).withColumn("part", F.xxhash64("pivot", "l", "r")), "placed")
    mixed = placed.groupBy("part").agg(F.count("*").alias("size"), F.min("group").alias("low"), F.max("group").alias("high"))
    mixed = materialize(mixed.where("low < high").select("part", "size"), "mixed")
    marked = materialize(marks(packed).select("id", "even", "odd"), "marks")
    few = placed.join(mixed.where(F.col("size") <= CROWD), "part").select(F.col("part").alias("sig"), "id", "group", F.lit(True).alias("own"), "begins", "ends")
    pairs = met(few.join(marked, "id"), edits)

    many = placed.join(mixed.where(F.col("size") > CROWD), "part").join(grouped.drop("group"), ["id", "pivot"]).select("sig", "part", "id", "group")
    around = segments(packed.withColumn("size", F.char_length("line")), edits).withColumn("sig", signature("line"))
    rest = F.expr("concat(left(line, start), substring(line, start + width + 1))")
    around = around.select("id", "sig", F.col("most").alias("k"), rest.alias("rest")).join(many, ["sig", "id"])
    split = segments(around.withColumn("size", F.char_length("rest")), edits).select("id", "group", signature("rest", "part").alias("sig"), "own")
    split = materialize(split.groupBy("sig", "id", "group").agg(F.max("own").alias("own")), "split")
    mixed = split.groupBy("sig").agg(F.min("group").alias("low"), F.max("group").alias("high"), F.max("own").alias("own"))
    split = split.join(mixed.where("low < high and own").select("sig"), "sig").join(marked, "id")
    pairs = materialize(pairs.union(met(split, edits)).distinct(), "pairs")
    return links.union(verified(pairs.join(side("src", "a"), "src").join(side("dst", "b"), "dst"), edits)).distinct()


def line_classes(docs: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS, most: int = MOST) -> DataFrame:
    """Every line of at least min_chars characters with its class: one row for each line of docs(doc_id, text).

    Returns doc_id, line_no, class_doc_id, class_line_no (the class's first line by document id and line number),
    class_size and kept (it is that line). Lines within `edits` edits link, where the shorter has LINK_CHARS characters
    for each edit; equal lines of any length always do. Lines under min_chars (1: only empty lines, which part paragraphs), null and empty
    texts give no rows. Rows that repeat a doc_id are lines of one document: the smallest (doc_id, line_no)
    counts as first, and ties are all kept. A null doc_id comes before all others. Other columns are ignored.
    """
    from .common import materialize, star_fold

    lines = lines_of(docs, min_chars)
    classes = star_fold(line_links(lines, edits, most)).withColumnRenamed("node", "id")
    places = materialize(lines.select("doc_id", F.col("line_no").cast("long").alias("line_no"), F.xxhash64("line").alias("id"), F.xxhash64(F.lit(1), "line").alias("second")), "places")
    grouped = places.join(classes, "id", "left").select(
        "doc_id", "line_no", F.coalesce("component", "id").alias("c1"), F.when(F.col("component").isNull(), F.col("second")).otherwise(0).alias("c2")
    )
    first = grouped.groupBy("c1", "c2").agg(F.min(F.struct("doc_id", "line_no")).alias("first"), F.count("*").alias("class_size"))
    return grouped.join(first, ["c1", "c2"]).select(
        "doc_id", "line_no", F.col("first.doc_id").alias("class_doc_id"), F.col("first.line_no").alias("class_line_no"), "class_size",
        (F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("line_no") == F.col("first.line_no"))).alias("kept"),
    )


def without_repeats(docs: DataFrame, classes: DataFrame, drop_emptied: bool = False) -> DataFrame:
    """docs with the lines that line_classes did not keep taken out of `text` (n_chars follows, where there is one).

    drop_emptied: documents whose lines all went go as well; those that were empty before stay. Rows without a doc_id
    keep all their lines.
    """
    gone = classes.where("not kept and doc_id is not null").groupBy("doc_id").agg(F.collect_set("line_no").alias("_gone"))
    joined = docs.join(gone, "doc_id", "left")
    left = F.filter(F.split("text", "\n"), lambda _, i: ~F.array_contains("_gone", i.cast("long")))
    out = joined.withColumn("text", F.when(F.col("_gone").isNull(), F.col("text")).otherwise(F.array_join(left, "\n")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("_gone").isNull(), F.col("n_chars")).otherwise(F.char_length("text")).cast(docs.schema["n_chars"].dataType))
    if drop_emptied:
        out = out.where(F.col("_gone").isNull() | F.col("text").rlike("[^\n]"))
    return out.select(*docs.columns)


def op10_line_dedup(spark, sf_dir):
    """The classes of all lines: equal, or at most 3 edits apart (one for each 12 characters of the shorter)."""
    from .common import documents

    return line_classes(documents(spark, sf_dir))
