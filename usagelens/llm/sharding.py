"""Random order at any size in two passes: scatter to buckets by seeded hash, shuffle each bucket, deal to shards."""

from pyspark.sql import Column, DataFrame, functions as F, types as T, Window as W

from usagelens.llm.common import stage

BUCKET_ROWS = 2_000
BUCKET_BYTES = 32 << 20
GROUP = 1_000  # buckets whose sizes are summed up in one window


def _blurred(kind: T.DataType) -> bool:
    """Whether grouping changes values of this type (zeros lose their sign) or refuses them (maps)."""
    if isinstance(kind, T.ArrayType):
        return _blurred(kind.elementType)
    if isinstance(kind, T.StructType):
        return any(_blurred(field.dataType) for field in kind)
    return isinstance(kind, (T.FloatType, T.DoubleType, T.MapType))


def _exact(value: Column, kind: T.DataType) -> Column:
    """``value`` in a form that can be grouped and sorted and that ``_restored`` takes back as it was."""
    if not _blurred(kind):
        return value
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda one: _exact(one, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform(F.map_entries(value), lambda entry: F.struct(
            _exact(entry["key"], kind.keyType).alias("key"), _exact(entry["value"], kind.valueType).alias("value")))
    if isinstance(kind, T.StructType):
        fields = [_exact(value[field.name], field.dataType).alias(f"f{k}") for k, field in enumerate(kind)]
        return F.when(value.isNotNull(), F.struct(*fields))
    return F.when(value.isNotNull(), F.struct(value.alias("number"), value.cast("string").startswith("-").alias("minus")))


def _restored(value: Column, kind: T.DataType) -> Column:
    if not _blurred(kind):
        return value
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda one: _restored(one, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.map_from_entries(F.transform(value, lambda entry: F.struct(
            _restored(entry["key"], kind.keyType), _restored(entry["value"], kind.valueType))))
    if isinstance(kind, T.StructType):
        fields = [_restored(value[f"f{k}"], field.dataType).alias(field.name) for k, field in enumerate(kind)]
        return F.when(value.isNotNull(), F.struct(*fields))
    negative_zero = (value["number"] == 0) & value["minus"]
    return F.when(negative_zero, F.lit(-0.0).cast(kind)).otherwise(value["number"])


def _row_bytes(rows: DataFrame, columns: list[str]) -> Column:
    """Bytes of a row's strings and nested values, eight for each other one."""
    def own(field):
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.StringType, T.BinaryType)):
            return F.octet_length(column)
        if isinstance(field.dataType, (T.ArrayType, T.StructType, T.MapType)):
            return F.octet_length(column.cast("string"))
        return F.lit(8)

    return sum((F.coalesce(own(rows.schema[c]), F.lit(0)).cast("long") for c in columns), F.lit(0).cast("long"))


def _starts(buckets: DataFrame) -> DataFrame:
    """(bucket, start): rows in all buckets before it, by sums within groups of buckets and over the groups."""
    sized = buckets.select("bucket", F.size("rows").cast("long").alias("n"),
                           F.expr(f"bucket div {GROUP}").alias("part"))
    inner = W.partitionBy("part").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    outer = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = sized.groupBy("part").agg(F.sum("n").alias("n")).select(
        "part", F.coalesce(F.sum("n").over(outer), F.lit(0)).alias("before"))
    within = sized.select("bucket", "part", F.coalesce(F.sum("n").over(inner), F.lit(0)).alias("inside"))
    return within.join(parts, "part").select("bucket", (F.col("before") + F.col("inside")).alias("start"))


def shuffle_to_shards(rows: DataFrame, shards: int = 16, seed: int = 7, bytes_col: str | None = None,
                      bucket_rows: int = BUCKET_ROWS, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``rows`` with shard and slot: a random order dealt out in turn, so shard sizes differ by at most one.

    Pass one scatters rows by a seeded hash of all their columns into buckets of about ``bucket_rows`` rows and
    ``bucket_bytes`` bytes at most, whose number follows the table; ``bytes_col`` may name the rows' sizes, which are
    measured otherwise. Rows that are alike are counted first and numbered, so that copies scatter like any others. Pass
    two puts each bucket, which fits in memory, in random order with Spark's seeded Fisher-Yates ``shuffle`` and writes
    it; order is fixed from then on. Bucket sizes give each bucket its start, and the row at place p goes to shard p mod
    ``shards``, slot p div ``shards``. The same rows, seed and shuffle partitions give the same order.

    Nulls are values like others, ties do not occur, an empty table gives none. All values come back as they were, the
    sign of a zero and the order of a map's entries included; columns of variants or intervals are refused. Input columns
    called shard or slot give way.
    """
    columns = [c for c in rows.columns if c.lower() not in ("shard", "slot")]
    spark = rows.sparkSession
    size = F.col(f"`{bytes_col}`") if bytes_col else _row_bytes(rows, columns)
    total, weight = rows.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0)).cast("long")).first()
    buckets = max(1, -(-total // bucket_rows), -(-weight // bucket_bytes))
    partitions = max(1, min(buckets, 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    quoted = [_exact(F.col(f"`{c}`"), rows.schema[c].dataType).alias(c) for c in columns]
    counted = rows.select(F.struct(*quoted).alias("row")).groupBy("row").agg(F.count("*").alias("copies"))
    single = counted.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"))
    scattered = single.select("row", F.pmod(F.xxhash64("row", "copy", F.lit(seed)), F.lit(buckets)).alias("bucket"))
    filled = (scattered.repartition(partitions, "bucket").groupBy("bucket")
              .agg(F.sort_array(F.collect_list("row")).alias("rows")).sortWithinPartitions("bucket")
              .select("bucket", F.shuffle("rows", F.lit(seed)).alias("rows")))
    written, _ = stage(filled, "shuffled", compression="zstd")
    placed = written.join(_starts(written), "bucket").select("start", F.posexplode("rows").alias("at", "row"))
    place = F.col("start") + F.col("at")
    own = [_restored(F.col("row")[c], rows.schema[c].dataType).alias(c) for c in columns]
    return placed.select(*own, (place % shards).cast("int").alias("shard"),
                         F.expr(f"(start + at) div {shards}").alias("slot"))


def write_shards(rows: DataFrame, path: str, shards: int = 16, **options) -> None:
    """One folder for each shard, whose files are sorted by slot; large shards have several files."""
    placed = shuffle_to_shards(rows, shards, **options)
    placed.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(
        path)
