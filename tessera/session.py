"""Session factory with the settings the package is written for, and the package on its workers."""

from __future__ import annotations

import os
import shutil
import tempfile
from pathlib import Path

from pyspark import SparkConf
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent


def ship(spark: SparkSession) -> None:
    """Python workers find the package: by path on this machine, as an archive that Spark deals out on a cluster."""
    context = spark.sparkContext
    paths = context.environment.get("PYTHONPATH", "").split(os.pathsep)
    if str(ROOT) not in paths:
        context.environment["PYTHONPATH"] = os.pathsep.join([str(ROOT), *filter(None, paths)])
    if not context.master.startswith("local") and spark.conf.get("spark.tessera.shipped", None) != "true":
        folder = tempfile.mkdtemp()
        context.addPyFile(shutil.make_archive(f"{folder}/tessera", "zip", ROOT, "tessera"))
        spark.conf.set("spark.tessera.shipped", "true")


def session(name: str = "tessera", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC; ``conf`` adds or replaces settings (dots as double underscores).

    The master is what is given here, or configured for the launch, and else this machine.
    """
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    builder = SparkSession.builder.appName(name)
    master = master or os.environ.get("SPARK_MASTER")
    if master or not SparkConf().get("spark.master"):
        builder = builder.master(master or "local[*]")
    spark = builder.config(map=settings).getOrCreate()
    ship(spark)
    return spark
