"""Session helpers shared by scripts, tests and the entry module."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def build_session(name: str = "docloom", cores: str | int = "*", **conf: str) -> SparkSession:
    """A local session with the settings the queries expect; a cluster passes its own."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.cteRecursionLevelLimit": "1000",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": os.environ.get("DOCLOOM_DRIVER_MEMORY", "8g"),
    } | conf
    builder = SparkSession.builder.master(f"local[{cores}]").appName(name)
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors once a session, as ``--py-files`` would."""
    context = spark.sparkContext
    if not getattr(context, "_docloom_shipped", False):
        root = Path(__file__).parent
        archive = Path(tempfile.mkdtemp(prefix="docloom-")) / "docloom_package.zip"
        with zipfile.ZipFile(archive, "w") as out:
            for path in sorted(root.rglob("*.py")):
                out.write(path, path.relative_to(root.parent))
        context.addPyFile(str(archive))
        context._docloom_shipped = True
    return spark
