"""What the planner makes of the queries."""

import pytest

import __spark_entry__ as entry_module
from netspark import session
from netspark.operators import flows, graph
from netspark.plans import fixtures
from netspark.plans.registry import QUERIES, Inputs

SF_DIR = "/root/testdata/sf0.001"
EAGER = ("stream_queries", "storage_queries", "model_queries", "graph_queries", "job_queries")
LAZY = sorted(n for n in QUERIES if not entry_module.module_of(n).endswith(EAGER))


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", LAZY)
def test_no_pairing_and_no_row_functions(spark, name):
    plan = plan_of(QUERIES[name].run(spark, SF_DIR))
    assert "CartesianProduct" not in plan and "BatchEvalPython" not in plan
    if name not in ("reputation_rollup",) and "reputation" not in name and name not in ("distinct_categories", "read_reputation_feeds", "feed_rows"):
        # The feed fixture itself crosses addresses with three provider names.
        assert "BroadcastNestedLoopJoin" not in plan


def test_filters_and_columns_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "packets")
    Inputs(spark, SF_DIR).view("packets").write.parquet(path)
    df = flows.port_scan_behavior(spark.read.parquet(path).filter("timestamp > 5"))
    plan = plan_of(df)
    assert "GreaterThan(timestamp,5.0)" in plan and "IsNotNull(src_ip)" in plan
    assert "ReadSchema: struct<timestamp:double,src_ip:string,dst_port:int>" in plan


def test_degrees_shuffle_once_after_edges(spark):
    edges = spark.createDataFrame([("a", "b", 1)], "src string, dst string, weight bigint")
    assert plan_of(graph.degrees(edges)).count("Exchange") == 1


def test_port_scan_counts_before_the_last_shuffle(spark):
    packets = fixtures.view(spark, SF_DIR, "packets")
    plan = plan_of(flows.port_scan_behavior(packets))
    assert plan.count("Exchange hashpartitioning") == 2 and "partial_count" in plan


class FakeSession:
    """Just the parts of a session that decide where scratch data goes."""

    def __init__(self, setting, master):
        self.master, self.folder, self.sparkContext = master, None, self
        self.applicationId = "app-1"
        self.conf = {} if setting is None else {"spark.checkpoint.dir": setting}

    def getCheckpointDir(self):
        return self.folder

    def setCheckpointDir(self, folder):
        self.folder = folder


def test_scratch_folder_follows_the_session():
    cluster = FakeSession("hdfs://shared/x", "yarn")
    assert session.scratch_path(cluster, "t").startswith("hdfs://shared/x/app-1/t-")
    assert cluster.folder == "hdfs://shared/x"
    assert session.scratch_path(cluster, "t") != session.scratch_path(cluster, "t")
    with pytest.raises(RuntimeError):
        session.shared_dir(FakeSession(None, "yarn"))
    alone = FakeSession(None, "local[2]")
    assert session.shared_dir(alone) == alone.folder == session.shared_dir(alone)


def test_no_machine_local_state_in_the_library():
    import pathlib

    source = "\n".join(p.read_text() for p in pathlib.Path(fixtures.__file__).parents[1].rglob("*.py"))
    assert "localCheckpoint" not in source and "crossJoin" not in source
