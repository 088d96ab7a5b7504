"""Session settings and the shared scratch folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "millrace", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC, AQE and Arrow on; a cluster's own settings win over these."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share.

    Only on one machine (a local master) may that setting be absent: a temporary folder then stands in for it and is set
    for the session, so that later calls share it. On a cluster its absence is an error, as each executor would write to
    its own disk.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="millrace-")
        spark.conf.set("spark.checkpoint.dir", root)
        atexit.register(shutil.rmtree, root.removeprefix("file://"), True)
    return f"{root.rstrip('/')}/millrace-{uuid.uuid4().hex}"


#: Tables that written() made and that discard() has not deleted, by application.
_WRITTEN: dict[str, list[str]] = {}


def written(df: DataFrame, spark: SparkSession | None = None) -> DataFrame:
    """The rows of df as a Parquet table in the shared folder: cuts lineage and survives lost executors.

    The table stays until discard(): the frame that comes out of an operator may still read it.
    """
    spark = spark or df.sparkSession
    path = shared_dir(spark)
    df.write.parquet(path)
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession) -> int:
    """Deletes the tables that written() made in this application; for when their results are stored or no longer needed."""
    paths = _WRITTEN.pop(spark.sparkContext.applicationId, [])
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)
    return len(paths)
