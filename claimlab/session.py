"""Sessions: the settings the engine relies on, and its code on the executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

PACKAGE = Path(__file__).resolve().parent
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Send the package's source to the executors, once per application, for the
    operators that run Python there."""
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        archive = Path(tempfile.mkdtemp(prefix="claimlab-code-")) / "claimlab_code.zip"
        with zipfile.ZipFile(archive, "w") as z:
            for source in sorted(PACKAGE.rglob("*.py")):
                z.write(source, source.relative_to(PACKAGE.parent))
        context.addPyFile(str(archive))
        _SHIPPED.add(context.applicationId)
    return spark


def local_session(cores: str = "*", partitions: int = 8) -> SparkSession:
    """A session for tests and single machines."""
    return (SparkSession.builder.master(f"local[{cores}]").appName("claimlab")
            .config("spark.sql.shuffle.partitions", str(partitions))
            .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
            .config("spark.driver.memory", "8g").getOrCreate())
