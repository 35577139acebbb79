"""Session settings and code shipping."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent


def session(app: str = "marlstone", cores: int | str = "*", **conf: str) -> SparkSession:
    """A session with the settings the operators rely on: UTC, ANSI, adaptive execution."""
    os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [str(ROOT.parent), os.environ.get("PYTHONPATH")]))
    builder = SparkSession.builder.appName(app).master(f"local[{cores}]")
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | {k.replace("_", "."): str(v) for k, v in conf.items()}
    spark = builder.config(map=settings).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers that were not started with it on their path."""
    context = spark.sparkContext
    if getattr(context, "_marlstone_shipped", False):
        return
    inherited = os.environ.get("PYTHONPATH", "").split(os.pathsep)
    if str(ROOT.parent) not in inherited:
        target = Path(tempfile.mkdtemp(prefix="marlstone-")) / "marlstone.zip"
        with zipfile.ZipFile(target, "w") as z:
            for f in ROOT.rglob("*.py"):
                z.write(f, f.relative_to(ROOT.parent))
        context.addPyFile(str(target))
    context._marlstone_shipped = True


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, spark.checkpoint.dir.

    Where it is unset a temporary folder is taken and set, but only if the whole session is one machine: on a cluster
    the tables written there would be lost between executors, so that is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        root = f"file://{tempfile.gettempdir()}/marlstone-scratch"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def materialise(df, name: str = "table"):
    """``df`` written once to :func:`shared_folder` and read back.

    Iterative fits plan the same input dozens of times; a written table keeps those plans small and survives the loss of
    executors.
    """
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
