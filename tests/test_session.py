"""The shared folder comes from the session."""

import os
import subprocess
import sys
from pathlib import Path

import pytest

from fleetlens import session


class Fake:
    applicationId = "fake"

    def __init__(self, master, **conf):
        self.conf, self.sparkContext, self.master = conf, self, master


def test_shared_dir_is_that_of_the_session():
    assert session.shared_dir(Fake("yarn", **{"spark.checkpoint.dir": "hdfs://x/y/"})) == "hdfs://x/y"


def test_own_folder_only_in_local_mode():
    local = Fake("local[2]")
    assert session.shared_dir(local) == session.shared_dir(local)
    for master in ("yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            session.shared_dir(Fake(master))


PLAIN = """
import os, sys
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
assert spark.conf.get("spark.checkpoint.dir", None) is None
from fleetlens import session
from fleetlens.operators.changes import only_set_changes
rows = spark.createDataFrame([(1, 1, 2), (1, 2, 2), (1, 3, 5)], "k INT, seq INT, v INT")
assert only_set_changes(rows, ["k"], ["seq"], ["v"]).count() == 2
assert session.run_dir(spark, "x").startswith(session.shared_dir(spark))
assert os.path.isdir(session.shared_dir(spark))
"""


def test_a_plain_local_session_can_write_and_checkpoint(tmp_path):
    env = {**os.environ, "PYTHONPATH": str(Path(__file__).resolve().parent.parent), "SPARK_CONF_DIR": str(tmp_path)}
    subprocess.run([sys.executable, "-c", PLAIN], env=env, cwd=tmp_path, check=True, timeout=180)


def test_run_dirs_differ(spark):
    a, b = session.run_dir(spark, "x"), session.run_dir(spark, "x")
    assert a != b and a.startswith(session.shared_dir(spark))


def test_checkpoint_lies_in_the_shared_folder(spark):
    df = session.reliable_checkpoint(spark.range(3))
    assert df.count() == 3
    assert session.shared_dir(spark) in spark.sparkContext.getCheckpointDir()
