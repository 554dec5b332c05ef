"""Tables written once to the cluster's shared folder, to cut lineage.

A staged table survives the loss of any executor, unlike a local checkpoint, and it is columnar and compressed, unlike
``DataFrame.checkpoint()``. The folder is the one the cluster names in ``spark.checkpoint.dir``; only where that is unset in local
mode, as in tests on one machine, a fresh temporary folder is used. The tables of an application share a folder, which
``clear_staged`` removes once its results are written.
"""

from __future__ import annotations

import tempfile
import uuid

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors and the driver can read and write. Raises ``RuntimeError`` on a cluster that names none."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master.partition("[")[0] != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="lettermill-")
    return _own[app]


def _tables_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/staged-{spark.sparkContext.applicationId}"


def fresh_path(spark: SparkSession, name: str = "table") -> str:
    """A path in the shared folder that nothing has been written to."""
    return f"{_tables_dir(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the same rows without their lineage."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear_staged(spark: SparkSession) -> None:
    """Removes the application's staged tables. Results that are not written yet may still need them."""
    store, path = fs.FileSystem.from_uri(_tables_dir(spark))
    if store.get_file_info(path).type == fs.FileType.Directory:
        store.delete_dir(path)
