"""Where model texts come from: files of responses, and files of chunks or SSE lines read as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNKS = "stream_id string, seq long, chunk string, is_last boolean"


def responses(spark: SparkSession, path: str, kind: str = "parquet", text_col: str = "text") -> DataFrame:
    """A table with a text column: parquet, json or (one response a file) text."""
    reader = spark.read
    return reader.text(path, wholetext=True).withColumnRenamed("value", text_col) if kind == "text" else reader.format(kind).load(path)


def spread(df: DataFrame, path: str, least: int = 1 << 20) -> DataFrame:
    """df, read from path, on all cores: a small table lies in one file and would be parsed by one task. A table that fills its own partitions
    (over ``least`` bytes for each core) is left as it is, without a shuffle."""
    spark = df.sparkSession
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    size = place.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(place).getLength()
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if size < least * cores else df


def chunk_stream(spark: SparkSession, path: str, kind: str = "json", files_per_trigger: int = 1000) -> DataFrame:
    return spark.readStream.schema(CHUNKS).format(kind).option("maxFilesPerTrigger", files_per_trigger).load(path)


def sse_events(lines: DataFrame, line_col: str = "value") -> DataFrame:
    """lines with data (the JSON of a data line, else null) and done (the end mark)."""
    body = F.trim(F.regexp_extract(F.col(line_col), r"^\s*data:\s*(.*)$", 1))
    return lines.withColumn("done", body == "[DONE]").withColumn("data", F.when((body != "") & (body != "[DONE]") & F.try_parse_json(body).isNotNull(), body))


def sse_text(protocol: str, event: str = "event", data: str = "data"):
    """A column that renders events as SSE; only one protocol names its events."""
    head = F.concat(F.lit("event: "), F.col(event), F.lit("\n")) if protocol == "anthropic" else F.lit("")
    return F.concat(head, F.lit("data: "), F.col(data), F.lit("\n\n"))
