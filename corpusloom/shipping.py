"""Makes the package importable in Python workers that don't have it installed."""

from __future__ import annotations

import io
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
_sent: set[str] = set()


def _seen_by_workers() -> bool:
    """Workers inherit PYTHONPATH, and on this machine look in the folder that the driver was started in."""
    return str(ROOT) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or Path.cwd() == ROOT


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; where it is unset, on one machine, a temporary one, and on a cluster an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="corpusloom-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def ship(spark: SparkSession) -> None:
    """Sends the package to the workers, once an application, as a zip in the shared folder that the cluster names."""
    app = spark.sparkContext.applicationId
    if app in _sent or _seen_by_workers():
        return
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        for path in sorted((ROOT / "corpusloom").rglob("*.py")):
            z.write(path, path.relative_to(ROOT))
    import pyarrow.fs

    shared = shared_folder(spark)
    fs, inner = pyarrow.fs.FileSystem.from_uri(shared)
    fs.create_dir(inner, recursive=True)
    with fs.open_output_stream(f"{inner}/corpusloom-{app}.zip") as out:
        out.write(packed.getvalue())
    spark.sparkContext.addPyFile(f"{shared}/corpusloom-{app}.zip")
    _sent.add(app)
