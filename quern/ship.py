"""Sending the package to executors that don't have it.

Functions that run in Arrow batches import ``quern`` on the executors. Install the package there, set
PYTHONPATH, pass ``--py-files`` with the archive that ``archive`` makes, or call ``ship`` once in a session.
"""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_HERE = Path(__file__).resolve().parent


def archive(path: str | Path) -> Path:
    """A zip of the package's modules at ``path``, which executors can import from."""
    out = Path(path)
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for module in sorted(_HERE.rglob("*.py")):
            z.write(module, module.relative_to(_HERE.parent))
    return out


def ship(spark: SparkSession) -> None:
    """Hands the package to Spark, which serves it to present and later executors. The archive's own folder
    is the driver's; executors get it through Spark."""
    folder = tempfile.mkdtemp(prefix="quern-ship-")
    spark.sparkContext.addPyFile(str(archive(f"{folder}/quern.zip")))
