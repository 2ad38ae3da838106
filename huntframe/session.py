"""Session helpers: where shared scratch data lives and how lineage is cut.

Iterative operators must survive the loss of an executor, so intermediate results go to
the folder that the cluster names in ``spark.checkpoint.dir`` (never to executor-local
storage). A folder of our own is made only where that setting is missing, as in tests.
"""

from __future__ import annotations

import atexit
import io
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can read, without a trailing slash."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="huntframe-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(own)
    return shared_dir(spark)


_scratch: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path for a table of this run."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _scratch.append(path)
    return path


def cleanup(spark: SparkSession) -> int:
    """Removes the scratch tables of this process; results that still read them must be written first."""
    n = len(_scratch)
    while _scratch:
        remove(spark, _scratch.pop())
    return n


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Gives the executors this package, once per application, so that they need no copy of their own."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        for at, _, files in os.walk(root):
            for f in sorted(files):
                if f.endswith(".py"):
                    full = os.path.join(at, f)
                    z.write(full, os.path.join("huntframe", os.path.relpath(full, root)))
    path = f"{scratch(spark, 'ship')}/huntframe.zip"
    fs, p = _fs(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(packed.getvalue()))
    finally:
        out.close()
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)


class Stages:
    """Written intermediate tables of one operator run, dropped once superseded.

    ``cut`` writes a DataFrame as Parquet in the shared folder and reads it back: the plan
    starts anew from files that outlive any executor, and the next plan sees true sizes.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n = spark, scratch(spark, name), 0
        self.paths: dict[str, str] = {}

    def cut(self, df: DataFrame, key: str) -> DataFrame:
        """Writes ``df`` as the current table of ``key``; the former one goes."""
        self.n += 1
        path = f"{self.root}/{self.n:04d}-{key}"
        df.write.parquet(path)
        if key in self.paths:
            remove(self.spark, self.paths[key])
        self.paths[key] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *keys: str) -> None:
        for key in keys:
            if key in self.paths:
                remove(self.spark, self.paths.pop(key))


def session(app: str = "huntframe", cpus: int | None = None, **conf: str) -> SparkSession:
    """A local UTC session with the settings the engine is tested under."""
    b = SparkSession.builder.appName(app).master(f"local[{cpus or '*'}]")
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    for k, v in {**base, **conf}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table: one Parquet file or folder per table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
