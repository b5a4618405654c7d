"""Session-level helpers shared by all operators."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: White space removed at both ends of identifiers: blanks, tabs and line ends.
ID_SPACE = " \t\r\n"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder of ``spark.checkpoint.dir``. Where that is unset a folder of this machine serves a local master only:
    on a cluster each executor would write to its own disk, so that is refused."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(shared or os.path.join(tempfile.gettempdir(), "linkloom-checkpoints"))


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from there: lineage ends, lost executors are survived.

    Files of checkpoints that nothing refers to any more go with the cleaner where
    ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set, and all of them when the driver ends.
    """
    ensure_checkpoint_dir(df.sparkSession)
    _remove_at_end(df.sparkSession, df.sparkSession.sparkContext.getCheckpointDir())
    return df.checkpoint(eager=True)


_REMOVED: set[str] = set()


def _remove_at_end(spark: SparkSession, path: str) -> None:
    """Delete a folder that this session wrote, once, when the driver ends; one that has gone already is no error."""
    if path in _REMOVED:
        return
    _REMOVED.add(path)

    def remove() -> None:
        try:
            place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
        except Exception:  # the session has ended already
            pass

    atexit.register(remove)


def clean_id(col: Column | str) -> Column:
    """The id without white space at its ends; null where nothing is left."""
    c = F.col(col) if isinstance(col, str) else col
    return F.nullif(F.btrim(c, F.lit(ID_SPACE)), F.lit(""))


def fresh(columns: list[str], wanted: str) -> str:
    """A column name like ``wanted`` that none of ``columns`` has."""
    taken = {c.lower() for c in columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt to all cores where it comes in less than half as many pieces, as one small file does, before slow Python.

    A table of more pieces stays as it is: its contents are not exchanged.
    """
    if df.isStreaming or 2 * df.rdd.getNumPartitions() > df.sparkSession.sparkContext.defaultParallelism:
        return df
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


def keep(df: DataFrame, by: str | None = None) -> DataFrame:
    """Like ``cut`` through a Parquet table in the shared folder, of which later steps read only the columns that they need,
    and with ``by`` only the values of that column that they ask for.

    The table is removed when the driver ends.
    """
    ensure_checkpoint_dir(df.sparkSession)
    spark = df.sparkSession
    path = f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/kept-{uuid.uuid4()}"
    df.write.parquet(path, partitionBy=by)
    _remove_at_end(spark, path)
    return spark.read.schema(df.schema).parquet(path)
