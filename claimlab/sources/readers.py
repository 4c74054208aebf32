"""Sources: files in the shapes the engine meets, checked as they are read."""

from __future__ import annotations

import base64
import gzip
import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimlab.session import ship


def read_panel_csv(spark: SparkSession, path: str, as_of: str) -> DataFrame:
    """Wide month-end panel with ``#`` comments and columns ``SYM_close``,
    ``SYM_trade_close``, ``SYM_v<window>`` as long rows up to ``as_of``."""
    wide = spark.read.csv(path, header=True, comment="#")
    markets = sorted({c.rsplit("_close", 1)[0].removesuffix("_trade") for c in wide.columns if c.endswith("_close")})
    fields = sorted({c.split("_", 1)[1] for c in wide.columns if "_" in c})
    one = lambda m: F.struct(F.lit(m).alias("market"), *[(F.col(f"{m}_{f}") if f"{m}_{f}" in wide.columns else F.lit(None)).cast("double").alias(f) for f in fields])
    rows = wide.select(F.to_date("date").alias("date"), F.inline(F.array(*map(one, markets))))
    return rows.where(F.col("date") <= F.lit(as_of).cast("date"))


def read_json(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """JSON documents, one a file; a schema makes unknown shapes fail."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema).option("mode", "FAILFAST") if schema else reader).json(path)


def read_texts(spark: SparkSession, path: str, most: int = 120_000) -> DataFrame:
    """(path, text) of whole text files; longer ones are refused."""
    texts = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return texts.withColumn("text", F.when(F.length("text") <= most, F.col("text")).otherwise(F.raise_error(F.concat(F.col("path"), F.lit(": text too long")))))


def read_zipped_table(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Data lines - YYYYMMDD and percentages - of the single member of ZIP archives, from
    the first such line to the first other one; percentages become fractions."""
    ship(spark)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    names = z.namelist()
                    if len(names) != 1:
                        raise ValueError("one member is expected")
                    lines = z.read(names[0]).decode("latin-1").splitlines()
                data, inside = [], False
                for line in lines:
                    cells = [c.strip() for c in line.split(",")]
                    if len(cells) == len(columns) + 1 and cells[0].isdigit() and len(cells[0]) == 8:
                        data.append([cells[0], *(float(c) / 100 for c in cells[1:])])
                        inside = True
                    elif inside:
                        break
                yield pd.DataFrame(data, columns=["day", *columns])

    schema = "day string, " + ", ".join(f"`{c}` double" for c in columns)
    rows = spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, schema)
    return rows.select(F.to_date("day", "yyyyMMdd").alias("date"), *[F.col(f"`{c}`") for c in columns])


def decode_blob(rows: DataFrame, blob: str, md5: str) -> DataFrame:
    """base64 of gzip as text; a digest that does not match stops the read."""
    ship(rows.sparkSession)

    @F.pandas_udf("string")
    def unpack(blobs: pd.Series) -> pd.Series:
        return blobs.map(lambda b: gzip.decompress(base64.b64decode(b)).decode())

    text = F.col("text")
    return rows.withColumn("text", unpack(F.col(blob))).withColumn("text", F.when(F.md5(text) == F.col(md5), text).otherwise(F.raise_error(F.lit("digest does not match"))))


def read_returns_csv(spark: SparkSession, path: str, least: int = 12) -> DataFrame:
    """A user's series: ``date``, ``return`` and numeric benchmarks; refused with counts of
    what is wrong."""
    raw = spark.read.csv(path, header=True)
    missing = {"date", "return"} - set(raw.columns)
    if missing:
        raise ValueError(f"missing columns: {', '.join(sorted(missing))}")
    values = [c for c in raw.columns if c != "date"]
    typed = raw.select(F.expr("try_cast(date as date)").alias("date"), *[F.expr(f"try_cast(`{c}` as double)").alias(c) for c in values])
    bad = lambda c: F.col(c).isNull() | F.isnan(c) | F.col(c).isin(float("inf"), float("-inf"))
    found = typed.agg(F.count("*").alias("n"), F.count(F.when(F.col("date").isNull(), 1)).alias("dates"), (F.count("date") - F.countDistinct("date")).alias("repeats"), *[F.count(F.when(bad(c), 1)).alias(f"bad_{c}") for c in values]).first()
    wrong = [f"{k}: {v}" for k, v in found.asDict().items() if k != "n" and v]
    if wrong or found["n"] < least:
        raise ValueError("; ".join([*wrong, f"{found['n']} rows"]))
    return typed
