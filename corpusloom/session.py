"""Session helpers shared by every plan."""

from __future__ import annotations

import hashlib
import io
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table for work that costs much more than reading: rows are spread where a scan has fewer splits than there are cores."""
    df = table(spark, sf_dir, name)
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def ship(spark: SparkSession) -> None:
    """Give this package to the executors of a session once, so that their Python workers can import it wherever they run."""
    sc = spark.sparkContext
    if getattr(sc, "_corpusloom_shipped", False):
        return
    root = Path(__file__).resolve().parent
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.writestr(zipfile.ZipInfo(f"{root.name}/{p.relative_to(root)}"), p.read_bytes())
    name = f"corpusloom-{hashlib.sha256(data.getvalue()).hexdigest()[:16]}.zip"
    folder = Path(tempfile.mkdtemp(prefix="corpusloom-"))
    (folder / name).write_bytes(data.getvalue())
    sc.addPyFile(str(folder / name))
    sc._corpusloom_shipped = True


def checkpoint(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read back, so that lost executors can't undo it.

    The folder is the one the cluster names in ``spark.checkpoint.dir``; only where that is unset and everything runs on
    this machine (local tests) is a temporary one made. On a cluster a missing setting is an error, since executors would
    each write to a disk of their own.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="corpusloom-checkpoint-"))
    return df.checkpoint()


def local_session(cores: str = "*", memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
