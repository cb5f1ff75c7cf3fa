"""The library on the workers of a cluster."""

from __future__ import annotations

import io
import os
import zipfile

from pyspark.sql import SparkSession

from nodeloom.sources.scratch import folder

_shipped: dict[str, str] = {}


def archive() -> bytes:
    """This package as a zip file that can be imported from."""
    root, out = os.path.dirname(os.path.abspath(__file__)), io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for base, _, names in sorted(os.walk(root)):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(base, name)
                    z.write(path, os.path.join(os.path.basename(root), os.path.relpath(path, root)))
    return out.getvalue()


def ship(spark: SparkSession) -> None:
    """Makes the package importable on all workers, once per application: by their path on one machine, by an archive elsewhere."""
    context = spark.sparkContext
    if context.master.startswith("local") and not context.master.startswith("local-cluster"):
        root, env = os.path.dirname(os.path.dirname(os.path.abspath(__file__))), context.environment
        if root not in env.get("PYTHONPATH", "").split(os.pathsep):
            env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH")) if x)
        return
    if context.applicationId in _shipped:
        return
    path = f"{folder(spark, 'code')}/nodeloom.zip"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target)
    out.write(bytearray(archive()))
    out.close()
    context.addPyFile(path)
    _shipped[context.applicationId] = path
