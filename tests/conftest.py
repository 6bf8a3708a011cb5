import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"
SF_CHECK = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from flowlure.session import local_session

    session = local_session(master="local[*]", shuffle_partitions=8)
    yield session
    session.stop()


@pytest.fixture
def scratch(tmp_path):
    return str(tmp_path)


def raw_rows(spark, rows):
    """Raw flow rows: (Proto, SrcAddr, DstAddr, Dport, State, StartTime)."""
    from flowlure.sources.flows import FLOW_COLUMNS

    schema = ", ".join(f"{c} string" for c in FLOW_COLUMNS)
    return spark.createDataFrame(rows, schema)
