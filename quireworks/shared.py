"""The folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. In one process a folder of our own will do; on a cluster each executor would
    then write to a disk of its own, so a session that names no folder is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='quireworks-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Folders that go when the application ends.
_KEPT: set[str] = set()


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the application's own part of the shared folder. Results that are read later stay until the application ends; then
    the file system deletes the whole of it, unless the driver is killed."""
    context = spark.sparkContext
    own = f"{shared_dir(spark)}/quireworks-{context.applicationId}"
    if own not in _KEPT:
        at = context._jvm.org.apache.hadoop.fs.Path(own)
        fs = at.getFileSystem(context._jsc.hadoopConfiguration())
        fs.mkdirs(at)
        fs.deleteOnExit(at)
        _KEPT.add(own)
    return f"{own}/{name}-{uuid.uuid4().hex}"
