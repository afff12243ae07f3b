"""What the corpus operators share: tables on the shared folder, total orders, document columns."""

from __future__ import annotations

import contextlib
import functools
import tempfile
import threading
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CHECKPOINT_CONF = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and every executor can read: spark.checkpoint.dir.

    Only where that setting is missing and the master is local a temporary folder is made and kept for the session;
    a cluster without the setting raises RuntimeError.
    """
    found = spark.conf.get(CHECKPOINT_CONF, None) or spark.sparkContext.getConf().get(CHECKPOINT_CONF)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="addrloom-")
        spark.conf.set(CHECKPOINT_CONF, found)
    return found.rstrip("/")


_written: dict[tuple[str, int], list[str]] = {}  # paths by owner and thread
_owner = threading.local()


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df once as Parquet in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/addrloom/{label}-{uuid.uuid4().hex}"
    if getattr(_owner, "name", None):
        _written.setdefault((_owner.name, threading.get_ident()), []).append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def tables_of(spark: SparkSession, owner: str):
    """What materialize writes inside belongs to `owner` (in this thread), whose earlier tables are deleted first.

    So an owner's results must be stored before it starts anew. Tables without an owner are never deleted here.
    """
    before, key = getattr(_owner, "name", None), (owner, threading.get_ident())
    for path in _written.pop(key, []):
        delete(spark, path)
    _owner.name = owner
    try:
        yield
    finally:
        _owner.name = before


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents")


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def successor(keys: DataFrame, order: str, carry: Sequence[str], prefix: str = "next_") -> DataFrame:
    """Each row's next row under the ascending total order of the unique column `order`; the last row's next is the first.

    keys: narrow rows (identifiers and sizes, never texts). Rows are range-partitioned, so no task gets more than its
    range; only one boundary row of each range meets in a single task, and their number is the number of partitions.
    Returns keys plus `prefix + c` for order and each carried column. One row: its next is itself. No rows: no rows.
    """
    spark = keys.sparkSession
    wanted = [order, *carry]
    ranged = keys.repartitionByRange(shuffle_width(spark), F.col(order).asc()).withColumn("_range", F.spark_partition_id())
    ranged = materialize(ranged, "ranges")
    nexts = F.struct(*[F.col(c) for c in wanted])
    inside = Window.partitionBy("_range").orderBy(F.col(order).asc())
    rows = ranged.withColumn("_next", F.lead(nexts).over(inside))
    firsts = ranged.groupBy("_range").agg(F.min_by(nexts, F.col(order)).alias("_first"))
    across = Window.partitionBy(F.lit(0)).orderBy("_range")
    wrap = Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    firsts = firsts.select("_range", F.coalesce(F.lead("_first").over(across), F.first("_first").over(wrap)).alias("_after"))
    joined = rows.join(F.broadcast(firsts), "_range")  # one row for each range
    got = F.coalesce("_next", "_after")
    return joined.select(*keys.columns, *[got[c].alias(prefix + c) for c in wanted])


FOLD_EDGES = 1 << 18  # edges of the largest graph that the driver folds by itself, 4 MB; 0: none


def folded(u, v):
    """Connected components of the edges (u, v), two arrays: (nodes, the smallest node that each can reach)."""
    import numpy as np

    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = np.split(at, 2)
    root = np.arange(len(nodes))
    while True:
        low = root.copy()  # of two roots with an edge between their nodes, the larger hangs below the smaller
        np.minimum.at(low, root[a], root[b])
        np.minimum.at(low, root[b], root[a])
        if np.array_equal(low, root):
            return nodes, nodes[root]
        while not np.array_equal(low, low[low]):
            low = low[low]
        root = low


def star_fold(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of an undirected graph given as edges (src, dst) of longs.

    A graph of up to FOLD_EDGES distinct edges is folded on the driver, as a round below runs some seven times as many tasks
    as there are shuffle partitions, however few its edges. A larger graph
    alternates the large-star and small-star steps (each a grouped minimum that is pre-aggregated before the shuffle,
    joined back on the centre, which Spark may split when it is skewed) until every edge points at its component's
    smallest node. Each round is written to the shared folder. Returns (node, component) for nodes with an edge; self
    loops and repeated edges are harmless, no edges give no rows. Raises if `rounds` do not suffice.
    """
    spark = edges.sparkSession
    now = edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct()
    now = materialize(now, "edges")
    if now.count() <= FOLD_EDGES:
        import pyarrow as pa

        got = now.toArrow()
        nodes, components = folded(*(got.column(c).to_numpy() for c in ("u", "v")))
        found = pa.table([pa.array(nodes, pa.int64()), pa.array(components, pa.int64())], names=["node", "component"])
        return materialize(spark.createDataFrame(found), "components")
    before = None
    for _ in range(rounds):
        # large star: every larger neighbour of u points at the smallest of u and its neighbours
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: u and its smaller neighbours point at the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        linked = large.join(low, "u")
        small = linked.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(low.select("u", F.col("m").alias("v"))).distinct()
        now = materialize(small, "stars")
        state = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.count_distinct("u")).first()
        if state[0] == state[2] and state == before or state[0] == 0:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(
                now.select(F.col("v").alias("node"), F.col("v").alias("component"))
            ).distinct()
        before = state
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def chunks(items: Sequence, size: int):
    for at in range(0, len(items), size):
        yield items[at : at + size]


@functools.lru_cache(maxsize=1)
def numpy():
    import numpy

    return numpy


BITMAP_WORDS = 1 << 17  # of 64 bits, a power of two: 1 MB, however many keys there are


def only_near(df: DataFrame, key: str, wanted: DataFrame, words: int = BITMAP_WORDS) -> DataFrame:
    """The rows of df whose long `key` may be among wanted's only column: a bitmap of fixed size, broadcast, drops most others.

    False positives pass, so join with wanted afterwards; what it saves is the shuffle of rows that cannot match.
    """
    # bit operations are never null, so the join adds no filter that would compute the key a second time
    place = lambda c: F.xxhash64(c).bitwiseAND(F.lit(words * 64 - 1))
    word = F.shiftrightunsigned(F.col("_b"), 6).alias("_word")
    bits = wanted.select(place(F.col(wanted.columns[0])).alias("_b")).groupBy(word)
    bits = bits.agg(F.bit_or(F.expr("shiftleft(1L, cast(_b & 63 as int))")).alias("_bits"))
    rows = df.withColumn("_b", place(F.col(key))).withColumn("_word", word)
    rows = rows.join(F.broadcast(bits), "_word").where("(shiftrightunsigned(_bits, cast(_b & 63 as int)) & 1L) = 1L")
    return rows.drop("_b", "_word", "_bits")
