"""Helpers shared by the operators: tables, spare column names, text as bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepanel.session import small_batches  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spare(df: DataFrame, stem: str) -> str:
    """Column name that ``df`` does not have yet."""
    name, taken = stem, {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def id_bucket(doc_id: Column, buckets: int) -> Column:
    """crc32 of the id as text, modulo ``buckets``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % buckets


def utf8(values) -> list[bytes]:
    """Arrow strings as bytes, null as the empty text."""
    return [b"" if v is None else v.encode() for v in values.to_pylist()]


def each_utf8(values):
    """The same one by one, so that only one text is held as bytes; binary values too."""
    for value in values:
        buffer = value.as_buffer()
        yield b"" if buffer is None else buffer.to_pybytes()
