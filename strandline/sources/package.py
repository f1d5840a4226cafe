"""This package for the Python workers of a cluster."""

from __future__ import annotations

import hashlib
import io
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

from strandline.sources.shared import shared_dir

_SENT: set[str] = set()


def archive() -> bytes:
    """The package's sources as a zip file, equal for equal sources."""
    root, out = Path(__file__).resolve().parents[1], io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.writestr(zipfile.ZipInfo(str(p.relative_to(root.parent))), p.read_bytes())
    return out.getvalue()


def ship(spark: SparkSession) -> None:
    """Let every Python worker of this application import the package: it goes to the shared folder once, and Spark hands it
    to the executors. A package that came with ``--py-files`` or is installed everywhere need not be sent; then this does no harm."""
    sc = spark.sparkContext
    if sc.applicationId in _SENT or not Path(__file__).exists():  # inside a zip: the workers have it
        return
    data = archive()
    path = f"{shared_dir(spark)}/strandline-{hashlib.sha256(data).hexdigest()[:16]}.zip"
    where = sc._jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(sc._jsc.hadoopConfiguration())
    if not system.exists(where):
        out = system.create(where, True)
        try:
            out.write(data)
        finally:
            out.close()
    sc.addPyFile(path)
    _SENT.add(sc.applicationId)
