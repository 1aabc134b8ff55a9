"""Session helpers: one place for the configs the library relies on."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Configs every query in the library assumes.  ANSI mode stays on (the 4.x
# default); operators use try_cast / try_divide where a bad value must be NULL.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app_name: str = "retentia", extra: dict | None = None) -> SparkSession:
    """Local session for tests and the bench; on a cluster use the provided session."""
    builder = SparkSession.builder.master(master).appName(app_name)
    conf = dict(BASE_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.setdefault("spark.driver.memory", "8g")
    if extra:
        conf.update(extra)
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the cluster.

    On a cluster ``spark.checkpoint.dir`` points at shared storage and is used
    as is.  Only when it is unset (local tests) a fresh folder is made.
    """
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    try:
        sc = spark.sparkContext
    except Exception:  # Spark Connect: the server owns the checkpoint folder
        if not conf_dir:
            raise RuntimeError("spark.checkpoint.dir must name a shared folder")
        return conf_dir
    current = sc.getCheckpointDir()
    if current:
        return current
    if not conf_dir:
        # Only in local mode: on a cluster each executor would write to its own disk.
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        conf_dir = tempfile.mkdtemp(prefix="retentia-ckpt-", dir=os.environ.get("RETENTIA_SCRATCH", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", conf_dir)
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


_STAGED: dict[str, list] = {}


def staging_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared checkpoint folder for a table that a job writes and re-reads.

    Every call gets a folder of its own, so queries never overwrite each other's
    input; the folders of an application are deleted when its driver ends.
    """
    base = ensure_checkpoint_dir(spark).rstrip("/") + f"/staging/{uuid.uuid4().hex}"
    app = spark.sparkContext.applicationId
    if app not in _STAGED:
        _STAGED[app] = []
        atexit.register(clean_staging, spark)
    _STAGED[app].append(base)
    return f"{base}/{name}"


def clean_staging(spark: SparkSession) -> None:
    """Delete what ``staging_path`` handed out in this application."""
    try:
        if spark.sparkContext._jsc is None or spark.sparkContext._jsc.sc().isStopped():
            return
        conf = spark._jsc.hadoopConfiguration()
        for base in _STAGED.pop(spark.sparkContext.applicationId, []):
            path = spark._jvm.org.apache.hadoop.fs.Path(base)
            path.getFileSystem(conf).delete(path, True)
    except Exception:  # the JVM is gone already: nothing can be deleted from here
        return


def materialize(df):
    """Checkpoint ``df`` to the shared checkpoint folder, computing it once.

    A reliable checkpoint re-runs its plan when it writes unless the data is
    persisted, so persist, checkpoint (eager), and drop the persisted copy.
    The result's lineage is cut: it survives executor loss by re-reading the
    checkpoint files.
    """
    from pyspark import StorageLevel

    ensure_checkpoint_dir(df.sparkSession)
    held = df.persist(StorageLevel.MEMORY_AND_DISK)
    out = held.checkpoint(eager=True)
    held.unpersist()
    return out


def scale_conf(input_bytes: int, target_partition_bytes: int = 256 << 20) -> dict:
    """Shuffle / scan sizing for a job reading ``input_bytes``.

    Shuffle partitions start at input / target (so a partition of the widest
    shuffle fits an executor's memory budget) and AQE coalesces the small ones
    at run time; skewed partitions above 4x the advisory size are split.
    Returned as a dict to pass to ``SparkSession.builder.config`` or ``spark.conf.set``.
    """
    initial = max(200, -(-int(input_bytes) // int(target_partition_bytes)))
    return {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(initial),
        "spark.sql.shuffle.partitions": str(initial),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(4 * target_partition_bytes),
        "spark.sql.files.maxPartitionBytes": str(min(target_partition_bytes, 512 << 20)),
        "spark.sql.autoBroadcastJoinThreshold": str(64 << 20),
    }
