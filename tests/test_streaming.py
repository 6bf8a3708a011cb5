"""The daily statistics stream equals the batch job, also after more days arrive."""

from pyspark.sql import functions as F

from conftest import SF_SMALL
from flowlure.operators import daily_port_statistics, prepare_flows
from flowlure.plans import catalog
from flowlure.streaming import start_daily_statistics_stream


def _rows(df):
    return sorted((tuple(r) for r in df.select("day", "port", "attack_probability", "open_port_probability").collect()), key=repr)


def test_flows_stored_after_midnight(spark, tmp_path):
    """A folder that holds late flows of the day before must not replace that day by a fragment."""
    root, out, ckpt = str(tmp_path / "archive"), str(tmp_path / "stats"), str(tmp_path / "ckpt")

    def rows(day, folder, port, sources, time="12:00:00"):
        return [("tcp", f"10.0.0.{s}", f"147.32.80.{h}", str(port), "S_SA", f"{day} {time}", folder) for s in sources for h in range(5)]

    schema = "Proto string, SrcAddr string, DstAddr string, Dport string, State string, StartTime string, _yyyymd string"
    second = rows("2024/01/02", "2024-1-2", 22, (1, 2)) + rows("2024/01/02", "2024-1-2", 23, (2,))
    third = rows("2024/01/03", "2024-1-3", 80, (1,)) + rows("2024/01/02", "2024-1-3", 23, (3,), "23:59:59.9")
    for batch in (second, third):
        spark.createDataFrame(batch, schema).write.mode("append").partitionBy("_yyyymd").parquet(root)
        start_daily_statistics_stream(spark, root, out, ckpt).awaitTermination()
    whole = prepare_flows(spark.createDataFrame(second + third, schema).drop("_yyyymd"), "147.32.")
    assert _rows(spark.read.parquet(out)) == _rows(daily_port_statistics(whole))


def test_stream_matches_batch(spark, tmp_path):
    root, out, ckpt = str(tmp_path / "archive"), str(tmp_path / "stats"), str(tmp_path / "ckpt")
    raw = catalog.raw_flows(spark, SF_SMALL)
    raw = raw.withColumn("_yyyymd", F.date_format(F.to_date(F.substring("StartTime", 1, 10), "yyyy/MM/dd"), "yyyy-M-d"))
    early = raw.where(F.substring("StartTime", 1, 10) <= "2024/01/10")
    late = raw.where(F.substring("StartTime", 1, 10) > "2024/01/10")
    early.write.partitionBy("_yyyymd").parquet(root)
    start_daily_statistics_stream(spark, root, out, ckpt).awaitTermination()
    first = spark.read.parquet(out)
    want_early = daily_port_statistics(prepare_flows(early.drop("_yyyymd"), "147.32."))
    assert _rows(first) == _rows(want_early)
    late.write.mode("append").partitionBy("_yyyymd").parquet(root)
    start_daily_statistics_stream(spark, root, out, ckpt).awaitTermination()
    want_all = daily_port_statistics(prepare_flows(raw.drop("_yyyymd"), "147.32."))
    assert _rows(spark.read.parquet(out)) == _rows(want_all)


def test_flows_stored_days_away(spark, tmp_path):
    """Flows three folders from their day, before and after that day's own folder has come."""
    root, out, ckpt = str(tmp_path / "archive"), str(tmp_path / "stats"), str(tmp_path / "ckpt")

    def rows(day, folder, port, sources):
        return [("tcp", f"10.0.0.{s}", f"147.32.80.{h}", str(port), state, f"{day} 12:00:00", folder) for s in sources for h in range(5) for state in ("S_RA", "S_SA")[: s]]

    schema = "Proto string, SrcAddr string, DstAddr string, Dport string, State string, StartTime string, _yyyymd string"
    early = rows("2024/01/05", "2024-1-2", 22, (1,)) + rows("2024/01/02", "2024-1-2", 80, (2,)) + rows("bad", "2024-1-2", 81, (2,))
    own = rows("2024/01/05", "2024-1-5", 23, (2, 1))
    late = rows("2024/01/05", "2024-1-8", 25, (3, 1)) + rows("2024/01/08", "2024-1-8", 22, (1,))
    seen = []
    for batch in (early, own, late):
        seen += batch
        spark.createDataFrame(batch, schema).write.mode("append").partitionBy("_yyyymd").parquet(root)
        start_daily_statistics_stream(spark, root, out, ckpt).awaitTermination()
        whole = prepare_flows(spark.createDataFrame(seen, schema).drop("_yyyymd"), "147.32.").where("day IS NOT NULL")
        assert _rows(spark.read.parquet(out)) == _rows(daily_port_statistics(whole))
    assert {str(r["day"]) for r in spark.read.parquet(out).select("day").distinct().collect()} == {"2024-01-02", "2024-01-05", "2024-01-08"}
