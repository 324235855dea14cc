"""Spark session helpers.

The library never hard-codes cluster settings; ``get_session`` only fills in defaults
for a local run (tests, bench).  ``ensure_checkpoint_dir`` reads
``spark.checkpoint.dir`` from the session and only invents a directory when the
setting is absent *and* the master is local.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "ledgermatch") -> SparkSession:
    cpus = os.environ.get("BENCH_CPUS", "8")
    master = master or f"local[{cpus}]"
    builder = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or int(cpus)))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("LEDGERMATCH_DRIVER_MEMORY", "16g"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint directory, configuring the context if needed.

    On a cluster ``spark.checkpoint.dir`` must name a shared folder (HDFS/S3/...);
    a machine-local temporary folder is only created for ``local[...]`` masters.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # Spark Connect: no SparkContext; the configured folder is used as is
        conf_dir = spark.conf.get("spark.checkpoint.dir", None)
        if not conf_dir:
            raise RuntimeError("spark.checkpoint.dir is not set; point it at a shared folder") from None
        return conf_dir
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return sc.getCheckpointDir()
    if not (sc.master == "local" or sc.master.startswith("local[")):
        raise RuntimeError(
            "spark.checkpoint.dir is not set; point it at a shared folder the cluster can read")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="ledgermatch-ckpt-"))
    return sc.getCheckpointDir()


_SHIPPED: set[str] = set()


def ship_code(spark: SparkSession) -> None:
    """Send this package to the session's workers, once an application: functions that run
    there in Python import it.  Spark serves the archive from the driver to every executor."""
    import zipfile

    try:
        app, add = spark.sparkContext.applicationId, spark.sparkContext.addPyFile
    except Exception:  # Spark Connect
        app, add = spark.conf.get("spark.app.id", "connect"), lambda path: spark.addArtifacts(path, pyfile=True)
    if app in _SHIPPED:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="ledgermatch-code-"), "ledgermatch.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, os.path.dirname(package)))
    add(archive)
    _SHIPPED.add(app)


def materialize(df, label: str):
    """Write ``df`` as parquet under the (shared) checkpoint directory and read it back.

    Used for intermediate tables that several branches of a plan reuse: they are
    computed once, and the lineage is cut so a lost executor does not replay the
    whole upstream plan.
    """
    import uuid

    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
