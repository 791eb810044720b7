"""Tables and files that the driver and all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_roots: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """This application's own folder below ``spark.checkpoint.dir``.

    Where that setting is absent, a local master (tests) gets a temporary folder; any other master is refused, because
    a machine-local folder would not be seen by the other executors.
    """
    app = spark.sparkContext.applicationId
    if app in _roots:
        return _roots[app]
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="chronograph-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
    root = f"{base.rstrip('/')}/chronograph-{app}"
    _roots[app] = root
    if local_path(root):
        atexit.register(shutil.rmtree, local_path(root), ignore_errors=True)
    return root


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings for the jobs of one block."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and read it back: the lineage ends in replicated files, so a lost
    executor costs only its running tasks, and later passes read only the columns they need. The write's shuffle files
    go when it ends, instead of when the driver next collects garbage."""
    spark = df.sparkSession
    path = new_path(spark, name)
    with settings(spark, {CLEANUP: "true"}):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._chronograph_path = path
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables made by :func:`materialize` that nothing reads any more."""
    for t in tables:
        if path := getattr(t, "_chronograph_path", None):
            delete(t.sparkSession, path)


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def make_folder(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(p)


def unused(columns: list[str], *names: str) -> list[str]:
    """``names``, with underscores in front of those that are among ``columns`` (in any case)."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def local_path(uri: str) -> str | None:
    u = urlparse(uri)
    return u.path if u.scheme in ("", "file") else None


def filesystem(uri: str):
    """A pyarrow filesystem and the path in it, for byte-range reads and writes on executors (local or mounted paths,
    and the stores that pyarrow reaches: hdfs, s3, gs, abfs)."""
    from pyarrow import fs

    if path := local_path(uri):
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(uri)


def ensure_local_parent(uri: str) -> None:
    if path := local_path(uri):
        Path(path).mkdir(parents=True, exist_ok=True)


BATCH, UNBOUNDED = "spark.sql.execution.arrow.maxBytesPerBatch", "256MB"
_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give the executors this package, once per application, where the driver runs it from a source folder, and bound the
    bytes that travel to Python at once (4 MB or one longer row), unless the session has a bound of its own."""
    app = spark.sparkContext.applicationId
    if spark.conf.get(BATCH, UNBOUNDED) in (UNBOUNDED, str(256 << 20)):
        spark.conf.set(BATCH, "4m")
    if app in _shipped:
        return
    _shipped.add(app)
    source = Path(__file__).resolve().parents[1]
    folder = Path(tempfile.mkdtemp(prefix="chronograph-"))  # the driver's own: Spark sends the archive to executors
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = folder / f"{source.name}.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(source.rglob("*.py")):
            z.write(f, f.relative_to(source.parent))
    spark.sparkContext.addPyFile(str(archive))
