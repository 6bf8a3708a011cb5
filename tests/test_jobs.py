"""End-to-end jobs on a small partitioned archive built from the test events."""

import os

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from flowlure.plans import catalog, jobs


@pytest.fixture(scope="module")
def archive(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("archive")) + "/flows"
    raw = catalog.raw_flows(spark, SF_SMALL)
    day = F.date_format(F.to_date(F.substring("StartTime", 1, 10), "yyyy/MM/dd"), "yyyy-M-d")
    raw.withColumn("_yyyymd", day).write.partitionBy("_yyyymd").parquet(root)
    return root


def test_statistics_to_strategies_to_evaluation(spark, archive, tmp_path):
    out = str(tmp_path)
    jobs.daily_statistics_job(spark, archive, f"{out}/stats")
    jobs.strategy_generation_job(spark, f"{out}/stats/records", f"{out}/strategies", rationality_step=0.5,
                                 max_honeypots=2.0)
    strategies = spark.read.json(f"{out}/strategies")
    assert strategies.select("rationality", "num_of_hp").distinct().count() == 9
    jobs.strategy_evaluation_job(spark, archive, f"{out}/strategies", f"{out}/summary")
    summary = spark.read.option("header", True).csv(f"{out}/summary")
    assert set(summary.columns) == {"rationality", "num_of_hp", "avg_saved_ratio", "stddev"}
    assert summary.count() > 0
    jobs.port_evaluation_job(spark, archive, f"{out}/strategies", f"{out}/ports", rationality=0.5, num_of_hp=1.0)
    assert os.path.isdir(f"{out}/ports")


def test_fixed_and_pair_jobs(spark, archive, tmp_path):
    out = str(tmp_path)
    jobs.fixed_strategy_job(spark, archive, f"{out}/fixed")
    expected = sorted(tuple(r) for r in catalog.q_fixed_strategy_daily_results(spark, SF_SMALL).collect())
    assert sorted(tuple(r) for r in spark.read.parquet(f"{out}/fixed").collect()) == expected
    jobs.pair_comparison_job(spark, archive, f"{out}/pair", rate=0.5)
    jobs.attack_probability_job(spark, archive, f"{out}/attack", days=["2024-1-2", "2024-1-3"])
    days = {r.day.isoformat() for r in spark.read.parquet(f"{out}/attack").select("day").distinct().collect()}
    assert days == {"2024-01-02", "2024-01-03"}
    jobs.port_reports_job(spark, archive, f"{out}/reports")


def test_scratch_tables_are_removed(spark, tmp_path):
    from flowlure.plans.persist import ScratchTables

    with ScratchTables(spark) as keep:
        df = keep(spark.range(10), "probe")
        assert df.count() == 10
        paths = list(keep.paths)
        assert all(os.path.isdir(p.replace("file:", "")) for p in paths)
    assert not any(os.path.exists(p.replace("file:", "")) for p in paths)


def test_command_line(archive, tmp_path):
    import subprocess
    import sys

    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = dict(os.environ, PYTHONPATH=repo)
    out = str(tmp_path / "cli-stats")
    subprocess.run([sys.executable, "-m", "flowlure.plans.jobs", "daily-statistics", "--archive", archive,
                    "--output", out, "--days", "2024-1-2,2024-1-3"],
                   check=True, env=env, cwd=str(tmp_path), timeout=600, capture_output=True)
    assert os.path.isdir(f"{out}/records") and os.path.isdir(f"{out}/document")
    strategies = str(tmp_path / "cli-strategies")
    subprocess.run([sys.executable, "-m", "flowlure.plans.jobs", "strategy-generation", "--statistics",
                    f"{out}/records", "--output", strategies, "--rationality", "0.5", "--num-of-hp", "1"],
                   check=True, env=env, cwd=str(tmp_path), timeout=600, capture_output=True)
    assert any(name.endswith(".json") for name in os.listdir(strategies))


def test_attacker_flows_equal_a_plain_join(spark, archive):
    from flowlure.config import NETWORK_PREFIX_EVAL
    from flowlure.operators import attacker_flows, daily_attackers, prepare_flows
    from flowlure.sources import read_flow_archive

    flows = prepare_flows(read_flow_archive(spark, archive), NETWORK_PREFIX_EVAL)
    keys = daily_attackers(flows).select("SrcAddr", "day")
    want = sorted((tuple(r) for r in flows.join(keys, ["SrcAddr", "day"], "left_semi").select(*flows.columns).collect()), key=repr)
    assert sorted((tuple(r) for r in attacker_flows(flows).select(*flows.columns).collect()), key=repr) == want


def test_outputs_are_not_replaced_unasked(spark, archive, tmp_path):
    from pyspark.errors import AnalysisException

    out = str(tmp_path / "attack")
    jobs.attack_probability_job(spark, archive, out, days=["2024-1-2"])
    with pytest.raises(AnalysisException):
        jobs.attack_probability_job(spark, archive, out, days=["2024-1-3"])
    jobs.attack_probability_job(spark, archive, out, days=["2024-1-3"], write_mode="overwrite")
    assert {str(r.day) for r in spark.read.parquet(out).select("day").distinct().collect()} == {"2024-01-03"}


def test_strategies_from_per_day_lines_and_map_documents(spark, archive, tmp_path):
    import json

    out = str(tmp_path)
    jobs.daily_statistics_job(spark, archive, f"{out}/stats", days=["2024-1-2"])
    for name, kind in (("records", {}), ("document", {"lines": True})):
        jobs.strategy_generation_job(spark, f"{out}/stats/{name}", f"{out}/{name}", rationalities=[0.5], honeypots=[1.0], **kind)
    both = [sorted((r.date, r.rationality, r.num_of_hp, r.stg) for r in spark.read.json(f"{out}/{n}").collect()) for n in ("records", "document")]
    assert both[0] == both[1]
    record = {"date": "2024-01-01", "rationality": 0.5, "num_of_hp": 1.0, "reward": 0.0, "used_hps": 0.9, "stg": {"22": 0.4, "80": 0.5}}
    listed = dict(record, stg=[{"port": 22, "prob": 0.4}, {"port": 80, "prob": 0.5}])
    with open(f"{out}/maps.json", "w") as fh:
        json.dump({"data": [record]}, fh, indent=1)
    with open(f"{out}/lists.json", "w") as fh:
        fh.write(json.dumps(listed))
    jobs.strategy_evaluation_job(spark, archive, f"{out}/maps.json", f"{out}/a", document=True)
    jobs.strategy_evaluation_job(spark, archive, f"{out}/lists.json", f"{out}/b")
    read = lambda x: sorted(tuple(r) for r in spark.read.csv(f"{out}/{x}_daily", header=True).collect())
    assert read("a") == read("b")


def test_choice_of_the_fixed_map(spark, archive, tmp_path):
    from flowlure import config

    for name in config.FIXED_MAPS:
        jobs.fixed_strategy_job(spark, archive, f"{tmp_path}/{name}", fixed_map=name)
        assert spark.read.parquet(f"{tmp_path}/{name}").columns == ["day", "saved_count", "hp_count"]


def test_checkpoint_folder_is_required_off_a_local_master():
    from flowlure.session import _local_folder

    class Conf:
        def __init__(self, master):
            self.get = lambda key, default=None: master

    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            _local_folder(type("Session", (), {"conf": Conf(master)})())
    assert os.path.isdir(_local_folder(type("Session", (), {"conf": Conf("local[2]")})()))
