"""Tables that a long job writes between its steps, in the folder all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Where none is set, a folder of this machine, in local mode
    only: on a cluster executors could not see it, so that is an error."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        made = spark.sparkContext._jsc.sc().getCheckpointDir()
        if made.isDefined():
            found = made.get()
        elif not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        else:
            found = "file://" + tempfile.mkdtemp(prefix="weftgraph-")
            spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def materialize(df: DataFrame, name: str = "step") -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: cuts the lineage, and what is
    read twice is computed once. Survives lost executors, as nothing stays with them."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Delete the files of tables of ``materialize`` that nothing reads any more; what was computed from
    them has to be written itself."""
    for table in tables:
        path = getattr(table, "written_to", None)
        if path:
            context = table.sparkSession.sparkContext
            place = context._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)


def folder_for(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, not yet made."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
