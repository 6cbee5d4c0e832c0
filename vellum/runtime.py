"""Session settings, table loading and shared storage."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
_SHIPPED: set[str] = set()


def session(cpus: int | str = "*", app: str = "vellum", memory: str = "16g") -> SparkSession:
    """A local session as tests and the benchmark use it; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package when it isn't installed on them: local ones by their
    path, those of other machines by an archive that Spark hands them."""
    sc = spark.sparkContext
    if sc.master.startswith("local") and not sc.master.startswith("local-cluster"):
        env = sc.environment
        paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
        if ROOT not in paths:
            env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])
    elif sc.applicationId not in _SHIPPED:
        folder = tempfile.mkdtemp()  # the driver serves the archive from there until it ends
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        name = os.path.join(folder, f"{__package__}-{uuid.uuid4().hex}.zip")
        with zipfile.ZipFile(name, "w") as archive:
            for path in sorted(Path(ROOT, __package__).rglob("*.py")):
                archive.write(path, path.relative_to(ROOT))
        sc.addPyFile(name)
        _SHIPPED.add(sc.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, as in
    local tests, one below Spark's warehouse is set; on a cluster that is an error, as the
    warehouse may be a folder of one machine."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir", None)
    if not found:
        have = sc._jsc.sc().getCheckpointDir()
        if have.isEmpty():
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
            warehouse = spark.conf.get("spark.sql.warehouse.dir")
            sc.setCheckpointDir(f"{warehouse.rstrip('/')}/_shared")
            have = sc._jsc.sc().getCheckpointDir()
        found = have.get()
    return found.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again: this cuts lineage, and a
    lost executor costs no more than the tasks it ran. The files go when the application ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop_path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
