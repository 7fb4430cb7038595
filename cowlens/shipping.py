"""Sends this package to the executors, so that workers can import it wherever they start."""

from __future__ import annotations

import io
import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Once for each application. The folder holds the source only, for Spark to take it from."""
    sc = spark.sparkContext
    if getattr(sc, "_cowlens_shipped", False):
        return
    top = Path(__file__).resolve().parent
    blob = io.BytesIO()
    with zipfile.ZipFile(blob, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, Path(top.name) / p.relative_to(top))
    path = os.path.join(tempfile.mkdtemp(prefix="cowlens-"), "cowlens_src.zip")
    Path(path).write_bytes(blob.getvalue())
    sc.addPyFile(path)
    sc._cowlens_shipped = True


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path in the cluster's shared folder (spark.checkpoint.dir). Where that is unset, as in tests, one of our
    own, if driver and executors are one process; an error on a cluster."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if not given and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"{given or tempfile.gettempdir()}/cowlens-{name}-{uuid.uuid4().hex}"
