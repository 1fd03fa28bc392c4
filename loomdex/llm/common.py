"""What the corpus operators share: tables, shared storage, words, Arrow columns."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes that separate words: space and \t \n \v \f \r.
BLANKS = " \t\n\x0b\x0c\r"
BATCH_ROWS, BATCH_BYTES = 500, 1 << 23


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch of whole texts holds, by rows and bytes; lower settings of the session stay."""
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        name = f"spark.sql.execution.arrow.{key}"
        held = spark.conf.get(name, None)
        if held is None or not held.isdigit() or not 0 < int(held) <= most:
            spark.conf.set(name, str(most))


def shared_dir(spark: SparkSession) -> str:
    """A new folder below the shared checkpoint folder. Only a session in one process may do without that setting.

    The folder goes when the driver ends, if nothing deletes it before.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        root = "file://" + tempfile.mkdtemp(prefix="loomdex-")
        spark.sparkContext.setCheckpointDir(root)
    folder = f"{root.rstrip('/')}/loomdex-{uuid.uuid4().hex}"
    fs, path = _file_system(spark, folder)
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    return folder


def _file_system(spark: SparkSession, folder: str) -> tuple:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def stored(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write a table to shared storage and read it back: later jobs don't repeat its work, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = path or shared_dir(spark)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession, folder: str) -> None:
    """Delete a table that no later plan reads."""
    fs, path = _file_system(spark, folder)
    fs.delete(path, True)


def release(spark: SparkSession) -> None:
    """Have each executor's JVM and the driver's collect garbage, so that heap they no longer need goes back to the machine before Python needs it.

    There are as many tasks as cores, so that idle executors all get some.
    """
    n = spark.sparkContext.defaultParallelism
    spark.range(0, n, 1, n).select(F.expr("java_method('java.lang.System', 'gc')")).collect()
    spark.sparkContext._jvm.java.lang.System.gc()
    pa.default_memory_pool().release_unused()


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for working columns, lengthened until df has none of them."""
    held = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in held:
            name += "_"
        out.append(name)
    return out


def words_of(text: Column) -> Column:
    """Array of the words [^\\x20\\x09-\\x0D]+ of a text; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")


def without(text: Column, chars: str) -> Column:
    """The text less some ASCII characters."""
    for c in chars:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def with_columns(df: DataFrame, needs: Sequence[str], fields: Sequence[T.StructField], fn: Callable, drop: Sequence[str] = ()) -> DataFrame:
    """df, less the columns in drop, with columns that fn makes, batch by batch, from the columns in needs.

    fn takes an Arrow array for each needed column and returns one for each field. A column of
    df that has the name of a new field, in any case, is replaced.
    """
    small_batches(df.sparkSession)
    new = {f.name.lower() for f in fields}
    keep = [c for c in df.columns if c.lower() not in new and c not in drop]
    more = [c for c in needs if c not in keep]
    names = [*keep, *(f.name for f in fields)]
    schema = T.StructType([*(df.schema[c] for c in keep), *fields])

    def run(batches):
        for b in batches:
            made = fn(*(b.column(b.schema.get_field_index(c)) for c in needs))
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in keep), *made], names=names)

    return df.select(*(F.col(f"`{c}`") for c in [*keep, *more])).mapInArrow(run, schema)
