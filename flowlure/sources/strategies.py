"""Strategy files.

Records: ``date STRING, rationality DOUBLE, num_of_hp DOUBLE, reward DOUBLE,
used_hps DOUBLE, stg`` where ``stg`` is either a list ``[{"port": 22, "prob": 0.1}, ...]``
(one JSON object per line) or an object ``{"22": 0.1, ...}`` (the pretty-printed document
form, wrapped as ``{"data": [records...]}``). Both read into the list form.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

STG_TYPE = T.ArrayType(T.StructType([
    T.StructField("port", T.IntegerType(), True),
    T.StructField("prob", T.DoubleType(), True),
]))

_RECORD_FIELDS = [
    T.StructField("date", T.StringType(), True),
    T.StructField("rationality", T.DoubleType(), True),
    T.StructField("num_of_hp", T.DoubleType(), True),
    T.StructField("reward", T.DoubleType(), True),
    T.StructField("used_hps", T.DoubleType(), True),
]
# stg is read as raw JSON text first, so either shape can be decoded afterwards.
_RAW_RECORD = T.StructType(_RECORD_FIELDS + [T.StructField("stg", T.StringType(), True)])
_RAW_DOCUMENT = T.StructType([T.StructField("data", T.ArrayType(_RAW_RECORD), True)])


def _decode_stg(raw_records: DataFrame) -> DataFrame:
    text = F.trim(F.col("stg"))
    as_list = F.from_json(text, STG_TYPE)
    as_map = F.from_json(text, T.MapType(T.StringType(), T.DoubleType()))
    from_map = F.transform(
        F.map_entries(as_map),
        lambda e: F.struct(e["key"].try_cast("int").alias("port"), e["value"].alias("prob")),
    )
    stg = F.when(text.startswith("["), as_list).otherwise(F.array_sort(from_map))
    return raw_records.select(*[f.name for f in _RECORD_FIELDS], stg.alias("stg"))


def read_strategies(spark: SparkSession, path: str, document: bool = False) -> DataFrame:
    """Strategy records from NDJSON (default) or from a ``{"data": [...]}`` document."""
    if document:
        raw = (spark.read.schema(_RAW_DOCUMENT).option("multiLine", True).json(path)
               .select(F.inline("data")))
    else:
        raw = spark.read.schema(_RAW_RECORD).json(path)
    return _decode_stg(raw)


def records_from_long(long: DataFrame) -> DataFrame:
    """Long strategy rows (date, rationality, num_of_hp, reward, used_hps, port, prob) -> records.

    Groups by (date, rationality, num_of_hp); a group holds one strategy's ports (bounded
    by the ports of one day), never flow rows.
    """
    keys = ["date", "rationality", "num_of_hp"]
    return (long.groupBy(*keys)
            .agg(F.max("reward").alias("reward"), F.max("used_hps").alias("used_hps"),
                 F.array_sort(F.collect_list(F.struct(F.col("port").cast("int").alias("port"),
                                                      F.col("prob").cast("double").alias("prob"))))
                 .alias("stg")))


def write_strategies(records: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One JSON object per line, list-shaped ``stg`` (what the evaluators read)."""
    records.write.mode(mode).json(path)
