"""Giving the workers this package."""

from __future__ import annotations

import hashlib
import io
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

from riskloom.functions.lineage import shared_folder

_shipped: set[str] = set()


def archive(package: Path) -> bytes:
    """The package's modules as a zip file; equal sources give equal bytes."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as packed:
        for path in sorted(package.rglob("*.py")):
            packed.writestr(zipfile.ZipInfo(str(path.relative_to(package.parent))), path.read_bytes())
    return out.getvalue()


def ship(spark: SparkSession) -> None:
    """Send the package to all present and future executors, once for each application.

    Functions then travel by name, and what a module remembers lives as long as
    the worker process. The archive lies in the shared folder, Spark hands it out.
    A package that itself came in an archive is there already.
    """
    context, package = spark.sparkContext, Path(__file__).parent.parent
    if context.applicationId in _shipped or not package.is_dir():
        return
    data = archive(package)
    path = f"{shared_folder(spark)}/packages/{context.applicationId}/{package.name}_{hashlib.md5(data).hexdigest()}.zip"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = place.getFileSystem(spark._jsc.hadoopConfiguration()).create(place, True)
    stream.write(bytearray(data))
    stream.close()
    context.addPyFile(path)
    _shipped.add(context.applicationId)
