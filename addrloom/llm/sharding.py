"""Rendezvous hashing of stable keys over weighted shards.

Every (key, shard) pair gets a uniform draw u from MD5; the key goes to the shard with the largest -weight / ln(u)
(ties, which take equal draws, to the smaller shard). A key's draws do not depend on the other shards, so adding a
shard moves only the keys that the new one wins, and each shard gets its weight's portion of the keys.

The map is one projection in the JVM. Slots need a count for each (shard, cell) - shards times `cells` rows at most,
so it is safe to broadcast - and a sort inside cells; no task ever gets a whole shard.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CELLS = 256


def draw(key: Column, shard: int) -> Column:
    """A uniform number in (0, 1) with 52 bits from MD5 of 'key:shard'."""
    hexes = F.substring(F.md5(F.concat(key.cast("string"), F.lit(f":{shard}"))), 1, 13)
    return (F.conv(hexes, 16, 10).cast("bigint").cast("double") + F.lit(0.5)) / F.lit(float(2**52))


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard (0-based) of a key among len(weights) shards. Weights must be positive; a null key counts as ''."""
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")
    key = F.coalesce(key.cast("string"), F.lit(""))
    # -ln(u) / weight is smallest where weight / -ln(u) is largest
    costs = [F.struct((-F.log(draw(key, i)) / F.lit(float(w))).alias("cost"), F.lit(i).alias("shard")) for i, w in enumerate(weights)]
    return (F.least(*costs) if len(costs) > 1 else costs[0])["shard"]


def assign(df: DataFrame, key: str, weights: Sequence[float], grow_by: float | None = None, cells: int = CELLS) -> DataFrame:
    """df plus `shard`, gapless `slot` within the shard, and `grown_shard`: the shard if one more of weight grow_by joined.

    Rows with equal keys get the same shard; slots follow (cell, key, a hash of the row), cell being a hash of the
    key. Narrow df before calling: its columns travel through one shuffle. A null key counts as ''. No rows: no rows.
    Columns of df named shard, slot or grown_shard are replaced (the key must not be one of them).
    """
    if key in ("shard", "slot", "grown_shard"):
        raise ValueError(f"the key {key} would be replaced by the result")
    df = df.drop("shard", "slot", "grown_shard")
    _cell, _n, _start, _rank = (name + "_" * (1 + max(map(len, df.columns))) for name in ("cell", "n", "start", "rank"))
    grown = rendezvous(F.col(key), [*weights, grow_by]) if grow_by else F.lit(None).cast("int")
    cell = F.conv(F.substring(F.md5(F.concat(F.lit("cell:"), F.coalesce(F.col(key).cast("string"), F.lit("")))), 1, 8), 16, 10).cast("bigint") % cells
    placed = df.withColumns({"shard": rendezvous(F.col(key), weights), "grown_shard": grown, _cell: cell})
    counts = placed.groupBy("shard", _cell).agg(F.count("*").alias(_n))
    before = Window.partitionBy("shard").orderBy(_cell).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", _cell, F.coalesce(F.sum(_n).over(before), F.lit(0)).alias(_start))
    inside = Window.partitionBy("shard", _cell).orderBy(F.col(key).asc(), F.xxhash64(*df.columns))
    ranked = placed.withColumn(_rank, F.row_number().over(inside) - F.lit(1))
    joined = ranked.join(F.broadcast(starts), ["shard", _cell])  # len(weights) * cells rows at most
    return joined.withColumn("slot", (F.col(_start) + F.col(_rank)).cast("bigint")).select(*df.columns, "shard", "slot", "grown_shard")


def op4_sharding(spark, sf_dir):
    """All documents over 16 equal shards by law `key`: the document id and the shard count alone decide."""
    from .common import documents

    text = F.coalesce("text", F.lit(""))
    rows = documents(spark, sf_dir).select(
        "doc_id",
        (F.octet_length(text).cast("bigint") + F.lit(1)).alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    return assign(rows, "doc_id", [1.0] * 16, grow_by=1.0)
