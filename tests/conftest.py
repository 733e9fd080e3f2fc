import os
import sys
import tempfile
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]
os.environ["PYTHONPATH"] = os.pathsep.join([str(ROOT), os.environ.get("PYTHONPATH", "")])


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .appName("waymark-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="waymark-wh-"))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    if not session.conf.get("spark.checkpoint.dir", None):
        session.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="waymark-ck-"))
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make(spark):
    """Episodes from ``(id, problem, outcome, states, pass rates or None)`` tuples."""

    def build(*episodes, max_attempts=5):
        rows = []
        for i, (eid, pid, outcome, states, rates) in enumerate(episodes):
            rates = rates or [0.0] * len(states)
            items = [(k + 1, s, r) for k, (s, r) in enumerate(zip(states, rates))]
            hidden = {"FINAL_PASS": 1.0, "FINAL_FAIL": 0.5}.get(outcome, 0.0)
            rows.append((eid, pid, "m", max_attempts, items, outcome, hidden, i))
        return spark.createDataFrame(
            rows,
            "episode_id string, problem_id string, model_id string, max_attempts int, "
            "trajectory array<struct<attempt:int,state:string,feedback_pass_rate:double>>, "
            "final_outcome string, final_hidden_pass_rate double, episode_seq long",
        )

    return build


def rows(df):
    return [tuple(r) for r in df.collect()]
