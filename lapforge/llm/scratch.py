"""Tables written to the folder that all executors share, to cut lineage.

A written table survives the loss of any executor, is computed once however often
it is read, and carries file sizes, so the planner chooses broadcasts by measured
size. The folder is the session's ``spark.checkpoint.dir``. Frames are lazy, so an
operator can't know when its tables are done with: who runs it deletes them, by
``scope`` around the work (as the pipeline does around each stage) or by ``clear``.
"""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_WRITTEN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder.

    Where it is unset, a local session, whose executors are its own threads, gets a
    temporary one that goes with the process; on a cluster that is an error, as
    executors would write to disks that others can't read.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="lapforge-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        found = "file://" + folder
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet under the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lapforge-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    _WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession, since: int = 0) -> None:
    """Delete the tables written so far (from the ``since``-th on); frames that read them become invalid."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    while len(_WRITTEN) > since:
        path = jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop()).getParent()
        path.getFileSystem(conf).delete(path, True)


@contextlib.contextmanager
def scope(spark: SparkSession):
    """Deletes, at its end, the tables written within; yields a function that exempts a frame's own table."""
    start, kept = len(_WRITTEN), []

    def keep(df: DataFrame, name: str) -> DataFrame:
        out = materialize(df, name)
        kept.append(_WRITTEN.pop())
        return out

    yield keep
    clear(spark, start)
    _WRITTEN.extend(kept)


@contextlib.contextmanager
def sifted(spark: SparkSession, keys: int):
    """Joins that are run within send only rows that a Bloom filter of the other side lets pass.

    It is Spark's own runtime filter, which by default waits for far larger tables: for
    semi and inner joins whose smaller side has a filter of its own. ``keys`` sizes it,
    up to 8 MB; beyond that it lets more rows pass, which the join drops as without it.
    """
    name = "spark.sql.optimizer.runtime.bloomFilter."
    wanted = {"applicationSideScanSizeThreshold": "0", "creationSideThreshold": "1PB", "expectedNumItems": str(min(8_000_000, max(10_000, keys))), "maxNumItems": "8000000"}
    before = {k: spark.conf.get(name + k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(name + k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(name + k) if v is None else spark.conf.set(name + k, v)
