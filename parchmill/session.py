"""Session settings and the shared working folder."""

from __future__ import annotations

import io
import posixpath
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

import pyarrow.fs as pafs

from pyspark.sql import SparkSession

from parchmill.formats.storage import reachable, resolve

_CHECKPOINT_KEY = "spark.checkpoint.dir"

# Settings that suit the jobs of this package. All of them are ordinary Spark
# settings; pass them to your own session builder or to spark-submit.
RECOMMENDED_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # Many small files per task: starting a Python task costs more than opening files.
    "spark.sql.files.openCostInBytes": "1048576",
    # File bytes and texts travel to Python in batches of at most this size.
    "spark.sql.execution.arrow.maxBytesPerBatch": "67108864",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "4096",
}


def python_env_conf(archive: str, alias: str = "env") -> dict[str, str]:
    """Settings that ship a packed Python environment to every executor."""
    return {
        "spark.archives": f"{archive}#{alias}",
        "spark.pyspark.python": f"./{alias}/bin/python",
    }


def full_uri(spark: SparkSession, path: str) -> str:
    """A path without a scheme as Spark reads it: on the default file system."""
    if ":" in path.partition("/")[0]:
        return path
    default = spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS")
    if default.startswith("file:"):
        return path
    return default.rstrip("/") + "/" + path.lstrip("/")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors see, as the session names it.

    Only a local session that names none (a test) gets a folder of its own, which
    is then set on the session so that it is made once.
    """
    root = spark.conf.get(_CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(
        _CHECKPOINT_KEY
    )
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {_CHECKPOINT_KEY} to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="parchmill-")
        spark.conf.set(_CHECKPOINT_KEY, root)
    return full_uri(spark, root.rstrip("/"))


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new, unused path below the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


@contextmanager
def batches_of(spark: SparkSession, n_bytes: int) -> Iterator[None]:
    """Batches of at most `n_bytes`, or one row, go to Python in what is run inside."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(n_bytes))
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def ship_package(spark: SparkSession, *folders: str) -> None:
    """Send this package (and further ones by folder) to every executor, once per
    session. Not needed where executors have it installed."""
    done = f"parchmill.shipped.{spark.sparkContext.applicationId}"
    if spark.conf.get(done, None):
        return
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        for root in (Path(__file__).parent, *map(Path, folders)):
            for file in sorted(root.rglob("*.py")):
                z.write(file, file.relative_to(root.parent))
    target = f"{shared_dir(spark)}/parchmill_{uuid.uuid4().hex}.zip"
    if not reachable(target):  # the driver hands it out itself
        target = f"{tempfile.mkdtemp()}/{posixpath.basename(target)}"
    fs, path = resolve(target)
    fs.create_dir(posixpath.dirname(path), recursive=True)
    with fs.open_output_stream(path) as out:
        out.write(packed.getvalue())
    spark.sparkContext.addPyFile(path if isinstance(fs, pafs.LocalFileSystem) else target)
    spark.conf.set(done, "true")
