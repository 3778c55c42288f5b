"""Makes the package importable in the executors' Python workers."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_sent: set[str] = set()
#: Rows and bytes of one Arrow batch sent to Python: long rows stay within a worker's memory.
BATCH_ROWS, BATCH_BYTES = 10_000, 16 << 20


def ship(spark: SparkSession) -> None:
    """Sends this package to every executor, once for an application (a zip of its sources)."""
    app = spark.sparkContext.applicationId
    if app in _sent:
        return
    here = Path(__file__).resolve().parent
    with tempfile.TemporaryDirectory() as folder:
        copy = Path(folder, "src", here.name)
        shutil.copytree(here, copy, ignore=shutil.ignore_patterns("__pycache__"))
        kept = tempfile.mkdtemp()  # the driver serves the file from there
        atexit.register(shutil.rmtree, kept, ignore_errors=True)
        made = shutil.make_archive(str(Path(kept, here.name)), "zip", copy.parent)
    spark.sparkContext.addPyFile(made)
    _sent.add(app)


def tune(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Sends the package to the executors and lowers the Arrow batch limits to the bounds above (never
    raises them)."""
    ship(spark)
    for key, limit in (
        ("spark.sql.execution.arrow.maxRecordsPerBatch", rows),
        ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES),
    ):
        try:
            now = int(str(spark.conf.get(key)).rstrip("bB"))
        except ValueError:
            now = 0
        if now <= 0 or now > limit:
            spark.conf.set(key, str(limit))
