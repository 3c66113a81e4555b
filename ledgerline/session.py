"""Session helpers: one place for the settings the plans rely on.

Library functions never create a session; they take the caller's.  These
helpers are for tests, the bench and local runs.  On a cluster the same
keys go into ``spark-defaults.conf`` and the checkpoint directory is a
shared folder named by ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every plan in this package is written against.
PLAN_CONF = {
    "spark.sql.session.timeZone": "UTC",
    # Runtime re-planning: broadcast conversion from measured sizes,
    # partition coalescing, and splitting of skewed join partitions.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Bloom filters built from the selective side of a shuffle join and
    # applied to the scan of the big side (orders -> order_items).
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_spark(cores: int | str = "*", shuffle_partitions: int | None = None,
              app: str = "ledgerline", extra: dict | None = None) -> SparkSession:
    """Local session for tests / bench (UI off, AQE on)."""
    n = shuffle_partitions or (os.cpu_count() if cores == "*" else int(cores))
    b = (SparkSession.builder.master(f"local[{cores}]").appName(app)
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.driver.memory", "16g")
         .config("spark.sql.shuffle.partitions", str(n)))
    for k, v in {**PLAN_CONF, **(extra or {})}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's shared folder for staged data.

    A cluster names it in ``spark.checkpoint.dir``; that folder is used as
    is.  Where the setting is absent, a local session (master ``local[...]``)
    gets a scratch folder, since its driver and executors are one process;
    any other master raises, because a machine-local folder would be
    invisible to the other executors.
    """
    sc = spark.sparkContext
    d = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not d:
        if not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="ledgerline-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(d)
    return d


STAGE_FOLDER = "ledgerline-stage"


def stage_root(spark: SparkSession) -> str:
    """``<checkpoint dir>/ledgerline-stage/<application id>``: other applications keep theirs beside it."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{STAGE_FOLDER}/{spark.sparkContext.applicationId}"


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh subfolder of :func:`stage_root` (for staged writes)."""
    return f"{stage_root(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df, name: str = "stage"):
    """Write ``df`` once as parquet under the shared checkpoint folder and read it back.

    Cuts the lineage like a reliable checkpoint, but computes the plan once
    (a reliable RDD checkpoint runs its job a second time to write).  The
    folder survives executor loss because it lives in the cluster's shared
    checkpoint location, never on a machine-local disk.  :func:`clear_stage`
    removes this application's folders once the results that read them are
    written.
    """
    spark = df.sparkSession
    path = scratch_dir(spark, name)
    df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear_stage(spark: SparkSession) -> None:
    """Delete the staged folders of this application (never another's).

    Call it at the end of a job, after the outputs that read staged data are
    written (DataFrames built on staged data cannot be evaluated afterwards).
    """
    p = spark._jvm.org.apache.hadoop.fs.Path(stage_root(spark))
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(p):
        fs.delete(p, True)


def ship_package(spark: SparkSession) -> None:
    """Send this package's modules to the Python workers, once per application.

    Needed where the package is not installed on the executors (as with
    ``--py-files``); harmless where it is.
    """
    import zipfile

    sc = spark.sparkContext
    if any(str(p).endswith("ledgerline_code.zip") for p in sc._python_includes):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="ledgerline-code-"), "ledgerline_code.zip")
    with zipfile.ZipFile(target, "w") as z:
        for at, _, names in os.walk(root):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(at, n)
                    z.write(full, os.path.join("ledgerline", os.path.relpath(full, root)))
    sc.addPyFile(target)
