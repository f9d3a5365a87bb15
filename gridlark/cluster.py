"""Makes this package importable on executors that don't share the driver's folders."""

from __future__ import annotations

import io
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_sent: dict[str, str] = {}


def ship(spark: SparkSession) -> None:
    """Send the package's sources to all executors, once for each Spark application."""
    sc = spark.sparkContext
    if sc.applicationId in _sent:
        return
    root = Path(__file__).resolve().parent
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, f"{root.name}/{p.relative_to(root)}")
    path = Path(tempfile.mkdtemp(prefix="gridlark-src-")) / "gridlark_src.zip"
    path.write_bytes(packed.getvalue())
    sc.addPyFile(str(path))
    _sent[sc.applicationId] = str(path)
