"""What a session needs before Python code of this package can run on its executors."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once for each application, so that nobody has to install it there."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    top = Path(__file__).parent
    target = Path(tempfile.mkdtemp(prefix="wayline-code-")) / "wayline-package.zip"
    with zipfile.ZipFile(target, "w") as archive:
        for file in sorted(top.rglob("*.py")):
            archive.write(file, f"{top.name}/{file.relative_to(top)}")
    spark.sparkContext.addPyFile(str(target))
    _shipped.add(app)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below ``spark.checkpoint.dir``, which driver and executors share; where that is unset, in local tests, in
    a temporary folder of this machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="wayline-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
