"""Daily port statistics files.

* NDJSON records ``{"day", "port", "attackProbability", "openPortProbability"}``.
* The nested document ``{"data": {day: {"attacker_strategy": {port: p},
  "production_distribution": {port: s}}}, "metadata": {...}}`` (read only; small input).
* Per-day lines ``{"day", "attacker_strategy", "production_distribution", "created"}``:
  the distributed way to write the nested form, one line per day, no single-task document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_PORT_MAP = T.MapType(T.StringType(), T.DoubleType())
_DAY_ENTRY = T.StructType([
    T.StructField("attacker_strategy", _PORT_MAP, True),
    T.StructField("production_distribution", _PORT_MAP, True),
])
_DOCUMENT = T.StructType([
    T.StructField("data", T.MapType(T.StringType(), _DAY_ENTRY), True),
    T.StructField("metadata", T.MapType(T.StringType(), T.StringType()), True),
])
_LINE = T.StructType([T.StructField("day", T.StringType(), True), *_DAY_ENTRY.fields])
_RECORD = T.StructType([
    T.StructField("day", T.StringType(), True),
    T.StructField("port", T.StringType(), True),
    T.StructField("attackProbability", T.DoubleType(), True),
    T.StructField("openPortProbability", T.DoubleType(), True),
])


def _day_from_text(c):
    # Day keys come as "2016-09-29 00:00:00.0" or "2018-09-18:10.0.0": the date is the first 10 chars.
    return F.substring(c, 1, 10).try_cast("date")


def maps_to_long(days: DataFrame) -> DataFrame:
    """(day, attacker_strategy map, production_distribution map) -> long statistics.

    Ports are the union of both maps' keys; a port missing from one map counts 0.
    """
    a, s = F.col("attacker_strategy"), F.col("production_distribution")
    ports = F.array_distinct(F.concat(F.coalesce(F.map_keys(a), F.array()), F.coalesce(F.map_keys(s), F.array())))
    return (days.select("day", a.alias("a"), s.alias("s"), F.explode(ports).alias("port_text"))
            .select("day",
                    F.col("port_text").try_cast("int").alias("port"),
                    F.coalesce(F.col("a")[F.col("port_text")], F.lit(0.0)).alias("attack_probability"),
                    F.coalesce(F.col("s")[F.col("port_text")], F.lit(0.0)).alias("open_port_probability")))


def read_statistics_document(spark: SparkSession, path: str) -> DataFrame:
    """Nested statistics document -> (day, port, attack_probability, open_port_probability)."""
    doc = spark.read.schema(_DOCUMENT).option("multiLine", True).json(path)
    days = doc.select(F.explode("data").alias("day_text", "entry")).select(
        _day_from_text(F.col("day_text")).alias("day"),
        F.col("entry.attacker_strategy").alias("attacker_strategy"),
        F.col("entry.production_distribution").alias("production_distribution"))
    return maps_to_long(days)


def read_daily_statistics(spark: SparkSession, path: str) -> DataFrame:
    """NDJSON statistic records -> (day, port, attack_probability, open_port_probability)."""
    raw = spark.read.schema(_RECORD).json(path)
    return raw.select(_day_from_text(F.col("day")).alias("day"),
                      F.col("port").try_cast("int").alias("port"),
                      F.col("attackProbability").alias("attack_probability"),
                      F.col("openPortProbability").alias("open_port_probability"))


def read_statistics_lines(spark: SparkSession, path: str) -> DataFrame:
    """Per-day lines (``write_statistics_lines``) -> (day, port, attack_probability, open_port_probability)."""
    raw = spark.read.schema(_LINE).json(path)
    return maps_to_long(raw.select(_day_from_text(F.col("day")).alias("day"), "attacker_strategy", "production_distribution"))


def write_daily_statistics(stats: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Long statistics -> NDJSON records with the original field names."""
    (stats.select(F.col("day").cast("string").alias("day"),
                  F.col("port").cast("string").alias("port"),
                  F.col("attack_probability").alias("attackProbability"),
                  F.col("open_port_probability").alias("openPortProbability"))
     .write.mode(mode).json(path))


def write_statistics_lines(document: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Per-day nested statistics (``operators.ports.daily_statistics_document``) -> JSON lines.

    Each line carries the creation time, as the document's metadata did.
    """
    (document.select(F.col("day").cast("string").alias("day"), "attacker_strategy",
                     "production_distribution",
                     F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss").alias("created"))
     .write.mode(mode).json(path))
