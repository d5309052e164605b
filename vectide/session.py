"""Session settings and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    # events carry zone-less timestamps; they are read as UTC
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a skewed join even where a following operator then needs one more exchange
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def build(app: str = "vectide", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings above; `conf` keys use `__` for the dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for name, value in SETTINGS.items():
        builder = builder.config(name, value)
    for name, value in conf.items():
        builder = builder.config(name.replace("__", "."), value)
    return apply_settings(builder.getOrCreate())


def apply_settings(spark: SparkSession) -> SparkSession:
    for name, value in SETTINGS.items():
        spark.conf.set(name, value)
    return spark


def shared_root(spark: SparkSession) -> str:
    """The folder all executors can reach, as the session names it in `spark.checkpoint.dir`.

    Only a local master falls back to a temporary folder; a cluster without the setting is an error,
    since a folder on one machine would be lost with it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    root = tempfile.mkdtemp(prefix="vectide-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


# working folders that this process has named and not removed yet
_FOLDERS: list[str] = []


def new_folder(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that no earlier run has used."""
    _FOLDERS.append(f"{shared_root(spark)}/vectide/{name}-{uuid.uuid4().hex}")
    return _FOLDERS[-1]


def remove_working_folders(spark: SparkSession) -> int:
    """Deletes the working folders that this process has named, and gives their number.

    Call it once the results have been read or written elsewhere: tables that lie in these folders, and results that
    are still to be computed from them, are gone. Checkpoints go with `spark.cleaner.referenceTracking.cleanCheckpoints`.
    """
    gone = 0
    while _FOLDERS:
        path = spark._jvm.org.apache.hadoop.fs.Path(_FOLDERS.pop())
        gone += bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True))
    return gone


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint of `df`: survives lost executors and ends the plan's growth in loops."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_root(df.sparkSession))
    return df.checkpoint(eager=True)
