"""Session settings and the shared folder used by streams and checkpoints."""

import os
import tempfile

from pyspark.sql import SparkSession


def local_session(cpus="8", app="fleetlens", shuffle_partitions="8"):
    """Session for tests and the bench. On a cluster the session comes from spark-submit."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", shuffle_partitions)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
        .getOrCreate()
    )


#: folder of each application without one of its own (application id -> path)
_OWN_DIRS = {}


def shared_dir(spark):
    """The cluster's shared folder. Only a local session without one (tests) gets a folder of its own."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        # a setting of the core can't be set in a running session, so the folder is remembered here
        context = spark.sparkContext
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors can reach")
        if context.applicationId not in _OWN_DIRS:
            _OWN_DIRS[context.applicationId] = tempfile.mkdtemp(prefix="fleetlens-")
        path = _OWN_DIRS[context.applicationId]
    return path.rstrip("/")


def run_dir(spark, name):
    """A fresh folder for one run, below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{os.urandom(6).hex()}"


def reliable_checkpoint(df):
    """Checkpoint to the shared folder, so that a lost executor does not lose the rows."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)
