"""The session: code for the executors, and folders that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()

#: Rows may hold whole texts or packed arrays, so batches for Python are smaller than by default.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}


def ship(spark: SparkSession) -> SparkSession:
    """Sends the package's code to the executors, once for each application, and sets the sizes of batches for Python
    where the session has none of its own."""
    sc = spark.sparkContext
    given = spark.conf.getAll
    for key, value in BATCHES.items():
        if key not in given:
            spark.conf.set(key, value)
    if sc.applicationId not in _shipped:
        top = Path(__file__).resolve().parent
        to = Path(tempfile.mkdtemp(prefix="quarry-code-")) / "quarry_code.zip"
        with zipfile.ZipFile(to, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(top.rglob("*.py")):
                z.write(p, p.relative_to(top.parent))
        sc.addPyFile(str(to))
        _shipped.add(sc.applicationId)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the session names none, a temporary folder is set and kept on a local master (tests, one machine); a cluster
    has to name one, as its executors would not see the driver's.
    """
    context = spark.sparkContext._jsc.sc()
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found is None and context.getCheckpointDir().isDefined():
        return context.getCheckpointDir().get()
    if found is None:
        if not context.isLocal():
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="quarry-shared-")
    if not context.getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(found)
    return found


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder that this library wrote, wherever Spark keeps it."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
