"""Sessions, and the package's own code on executors."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

PACKAGE = os.path.dirname(os.path.abspath(__file__))


def session(master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are planned for; a cluster's own settings stay."""
    builder = SparkSession.builder.appName("lodestone")
    if master:
        builder = builder.master(master)
    for k, v in {"spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.session.timeZone": "UTC", **conf}.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once per context, unless their path already has its folder."""
    root = os.path.dirname(PACKAGE)
    context = spark.sparkContext
    if getattr(context, "_lodestone_shipped", False) or root in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="lodestone-code-"), "lodestone.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(PACKAGE):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, root))
    context.addPyFile(path)
    context._lodestone_shipped = True
