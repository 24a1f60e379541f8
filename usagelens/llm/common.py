"""Helpers that the operators share: staged tables, carried columns, Arrow batches."""

import os

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from usagelens.runtime import work_folder


def stage(rows: DataFrame, purpose: str, *partition_by: str, compression: str | None = None) -> tuple[DataFrame, str]:
    """Write rows to the shared folder and read them back: a lost executor costs a re-read, not a re-run."""
    spark = rows.sparkSession
    path = work_folder(spark, purpose)
    rows.write.partitionBy(*partition_by).parquet(path, compression=compression)
    return spark.read.schema(rows.schema).parquet(path).select(*rows.columns), path


def stage_sealed(rows: DataFrame, purpose: str) -> tuple[DataFrame, str]:
    """``stage`` for texts that must not lie in the shared folder in clear: string columns are written encrypted.

    The key is made for this one table and lives in the plans of this session only, so nobody reads the table after it.
    Nulls stay nulls. Event logs, if they are kept, hold plans and with them the key.
    """
    key = F.lit(os.urandom(16))
    texts = {field.name for field in rows.schema if isinstance(field.dataType, T.StringType)}
    sealed = rows.select(*[F.aes_encrypt(F.col(f"`{name}`").cast("binary"), key).alias(name) if name in texts
                           else F.col(f"`{name}`") for name in rows.columns])
    written, path = stage(sealed, purpose)
    return written.select(*[F.aes_decrypt(F.col(f"`{name}`"), key).cast("string").alias(name) if name in texts
                            else F.col(f"`{name}`") for name in rows.columns]), path


def drop_stage(spark, path: str) -> None:
    """Remove a staged table that no later plan reads."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def carried(rows: DataFrame, outputs, keep=None) -> DataFrame:
    """The columns that go along with an operator's output.

    An input column whose name equals an output's in any letter case gives way to the output.
    """
    taken = {name.lower() for name in outputs}
    wanted = rows.columns if keep is None else keep
    return rows.select(*[F.col(f"`{name}`") for name in wanted if name.lower() not in taken])


def with_text(docs: DataFrame, rest: DataFrame, text_col: str):
    """Rows for a batch function, the place of the text in them and the places of the carried columns.

    A text that is carried along travels once. Batches are kept small, as texts pass through Python's memory.
    """
    conf = docs.sparkSession.conf
    if conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "67108864b":
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")
    names = rest.columns
    if text_col in names:
        return rest, names.index(text_col), range(len(names))
    rows = docs.select(F.col(f"`{text_col}`").alias("__text"), *[F.col(f"`{name}`") for name in names])
    return rows, 0, range(1, len(names) + 1)


def numbered(rows: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``rows`` under plain column names that no operator uses, and those names by the old ones."""
    names = {name: f"input{k}" for k, name in enumerate(rows.columns)}
    return rows.toDF(*names.values()), names


def free_name(rows: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column is called so."""
    used = {column.lower() for column in rows.columns}
    while name.lower() in used:
        name = "_" + name
    return name


def utf8(column: pa.Array) -> list[bytes]:
    """Values of a string or binary column as bytes, null as empty."""
    return [value or b"" for value in column.cast(pa.binary()).to_pylist()]


def slices_by_bytes(batch: pa.RecordBatch, sizes, limit: int):
    """(start, length) of consecutive rows with about ``limit`` bytes; a longer row is alone."""
    start = total = 0
    for row, size in enumerate(sizes):
        if row > start and total + size > limit:
            yield start, row - start
            start, total = row, 0
        total += size
    if batch.num_rows > start:
        yield start, batch.num_rows - start
