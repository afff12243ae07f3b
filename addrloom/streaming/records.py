"""Address records as a stream: each is flagged and cut into segments, repeats within the watermark go."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..functions.address import raw_flags
from ..functions.segments import expanded, segments
from ..functions.text import first_phone, record_key


def read_records(spark: SparkSession, folder: str, schema: StructType | str, files_at_once: int = 100) -> DataFrame:
    """A stream of the Parquet files that arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(folder)


def parsed(stream: DataFrame, text: str = "text") -> DataFrame:
    """The records with phone, flags and segments of a text column; one narrow map, for streams and tables alike."""
    phone = first_phone(F.col(text))
    return stream.withColumns({"phone": phone, "flags": raw_flags(F.col(text), phone), "segments": segments(expanded(F.col(text)))})


def first_seen(stream: DataFrame, time: str, text: str = "text", late: str = "1 hour") -> DataFrame:
    """One record for each matching key within `late`; keys are kept as hashes, and the watermark bounds their number.

    Records without a key are all the same one. Which of several copies stays is the first to arrive.
    """
    keyed = stream.withWatermark(time, late).withColumn("_key", F.sha2(record_key(F.col(text)), 256))
    return keyed.dropDuplicatesWithinWatermark(["_key"]).drop("_key")


def counts(stream: DataFrame, time: str, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Records of each window and flag; records without flags count under ''."""
    flag = F.explode(F.when(F.size("flags") > 0, F.col("flags")).otherwise(F.array(F.lit("")))).alias("flag")
    each = stream.withWatermark(time, late).select(F.window(time, width).start.alias("start"), flag)
    return each.groupBy("start", "flag").agg(F.count("*").alias("n"))


def write(stream: DataFrame, folder: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Appends to Parquet files, exactly once by its checkpoint; `once` ends when all that has arrived is written."""
    writer = stream.writeStream.format("parquet").outputMode("append").option("path", folder).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
