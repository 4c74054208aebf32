"""Explicit order: positions over large streams, dense date x entity panels."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _bucket(value: Column, bounds: list, base: int = 0) -> Column:
    if not bounds:
        return F.lit(base)
    mid = len(bounds) // 2
    return F.when(value < F.lit(bounds[mid]), _bucket(value, bounds[:mid], base)).otherwise(_bucket(value, bounds[mid + 1 :], base + mid + 1))


def ranges(df: DataFrame) -> int:
    """Ranges to cut an order into: as many as tasks, which bounds their table too."""
    return max(64, min(4_096, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def _cut(df: DataFrame, value: Column, name: str, n: int) -> DataFrame:
    cuts = df.select(value.cast("double").alias("v")).where("v is not null").approxQuantile("v", [k / n for k in range(1, n)], 0.2 / n)
    return df.withColumn(name, _bucket(value.cast("double"), sorted(set(cuts))))


def running_sum(df: DataFrame, value: str, order: str, name: str) -> DataFrame:
    """Adds the sum of ``value`` over the rows with a smaller ``order``, a number without
    ties: sums inside ranges of it after those of the ranges before."""
    rows = _cut(df, F.col(order), "__range", ranges(df))
    sums = rows.groupBy("__range").agg(F.sum(value).alias("__sum"))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("__range", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__base"))
    inside = F.sum(value).over(Window.partitionBy("__range").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)) - F.col(value)
    return rows.withColumn(name, inside).join(F.broadcast(bases), "__range").withColumn(name, F.col(name) + F.col("__base")).drop("__range", "__base")


def with_position(df: DataFrame, time_col: str, *ties: str, name: str = "pos", buckets: int | None = None) -> DataFrame:
    """Number the rows from 0 by (time, ties) without bringing them into one task.

    The stream is cut into ranges of time, rows are numbered inside their range and the
    ranges' counts are summed up before them.  Equal times share a range.
    """
    buckets = buckets or ranges(df)
    stamp = F.unix_micros(F.col(time_col).cast("timestamp"))
    cuts = df.select(stamp.alias("t")).approxQuantile("t", [k / buckets for k in range(1, buckets)], 0.2 / buckets)
    rows = df.withColumn("__bucket", _bucket(stamp, sorted({int(c) for c in cuts})))
    counts = rows.groupBy("__bucket").count()
    before = Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("__bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__base"))
    inside = Window.partitionBy("__bucket").orderBy(time_col, *ties)
    numbered = rows.withColumn("__in", F.row_number().over(inside) - 1).join(bases, "__bucket")
    return numbered.withColumn(name, F.col("__base") + F.col("__in")).drop("__bucket", "__base", "__in")


def densify(panel: DataFrame, date: str = "date", entity: str = "market") -> DataFrame:
    """Every date that occurs with every entity, missing values NULL: what shifts and
    rolling windows over panel rows count.  Its size is that of the dense panel."""
    dates, entities = panel.select(date).distinct(), panel.select(entity).distinct()
    return dates.crossJoin(entities).join(panel, [date, entity], "left")


def means_in_file_order(table: DataFrame, keys: dict[str, Column], **values: Column) -> DataFrame:
    """Keys and the mean of each value, summed in the order the rows have in their files.

    Sums of decimals as doubles depend on their order in the last bit, and with it whether
    a mean that equals a bound is within it.  Running sums over the rows' places are the
    same however Spark cuts the files.  ``table``: read from parquet files.
    """
    rows = table.select(*[k.alias(n) for n, k in keys.items()], *[v.alias(n) for n, v in values.items()], F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    order = Window.partitionBy(*keys).orderBy("__file", "__row")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    means = rows.select(*keys, *[F.avg(n).over(so_far).alias(n) for n in values], F.lead(F.lit(True)).over(order).alias("__more"))
    return means.where("__more is null").drop("__more")


#: Rows of a file that are looked up together for their row group.
CELL = 1 << 16


def _row_groups(table: DataFrame) -> DataFrame:
    """(file, cell, first, end, group): the rows of every row group, cut at multiples of
    ``CELL``, from the files' footers.  Groups are numbered over all files, by name."""
    spark = table.sparkSession
    jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    parquet, pieces, group = jvm.org.apache.parquet.hadoop, [], 0
    for name in sorted(table.inputFiles()):
        path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(name))
        reader = parquet.ParquetFileReader.open(parquet.util.HadoopInputFile.fromPath(path, conf))
        try:
            sizes = [g.getRowCount() for g in reader.getRowGroups()]
        finally:
            reader.close()
        # Rows tell their path with or without an empty host, with or without escapes.
        bare = name.replace("file:///", "file:/", 1)
        spelled, end = {name, bare, unquote(name), unquote(bare)}, 0
        for size in sizes:
            first, end = end, end + size
            pieces += [(f, k, max(first, k * CELL), min(end, (k + 1) * CELL), group) for f in spelled for k in range(first // CELL, -(-end // CELL))]
            group += 1
    return spark.createDataFrame(pieces, "file string, cell long, first long, end long, group int")


def means_by_row_group(table: DataFrame, keys: dict[str, Column], **values: Column) -> DataFrame:
    """Keys and the mean of each value, summed in every row group in the order of its rows,
    then over the row groups in order: as engines do that scan row groups in parallel.

    Where a key's rows lie in one row group these are ``means_in_file_order``.  The number
    of row groups bounds what is gathered for a key.  ``table``: read from parquet files.
    """
    row = F.col("_metadata.row_index")
    rows = table.select(*[k.alias(n) for n, k in keys.items()], *[v.cast("double").alias(n) for n, v in values.items()], F.col("_metadata.file_path").alias("__file"), row.alias("__row"))
    there = [F.col("__file") == F.col("file"), F.floor(F.col("__row") / CELL) == F.col("cell"), F.col("__row") >= F.col("first"), F.col("__row") < F.col("end")]
    known = F.when(F.col("group").isNotNull(), F.col("group")).otherwise(F.raise_error(F.lit("a row outside the row groups of its file")).cast("int"))
    placed = rows.join(F.broadcast(_row_groups(table)), there, "left").select(*keys, *values, known.alias("__group"), "__row")
    order = Window.partitionBy(*keys, "__group").orderBy("__row")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    sums = [F.struct(F.coalesce(F.sum(n).over(so_far), F.lit(0.0)).alias("total"), F.count(n).over(so_far).alias("n")).alias(n) for n in values]
    last = placed.select(*keys, "__group", *sums, F.lead(F.lit(True)).over(order).alias("__more")).where("__more is null")
    parts = last.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("__group", *values))).alias("__parts"))

    def mean(name: str) -> Column:
        total = F.aggregate("__parts", F.lit(0.0), lambda t, p: t + p[name]["total"])
        return (total / F.nullif(F.aggregate("__parts", F.lit(0).cast("long"), lambda n, p: n + p[name]["n"]), F.lit(0))).alias(name)

    return parts.select(*keys, *[mean(n) for n in values])
