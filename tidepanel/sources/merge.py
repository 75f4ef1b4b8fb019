"""Stored tables that take new rows by key.

A batch is written to a folder of its own, split by a hash bucket of its keys, and becomes visible with its
success marker. Nothing that is stored is read or rewritten, so writers never meet, a batch that fails leaves
no trace, and one that is repeated under its own name overwrites itself. Readers take the newest row of a key
with ``max_by``, which combines map-side; a key is looked up in one bucket.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T


def latest_per_key(rows: DataFrame, keys: list[str], order: str = "updated_at",
                   tie: str | None = None) -> DataFrame:
    """One row per key: the newest by ``order``; on equal times the greatest ``tie``
    (all other columns in their order when no ``tie`` is given)."""
    rest = [c for c in rows.columns if c not in keys]
    body = F.struct(*rest)
    rank = F.struct(F.col(order), F.col(tie)) if tie else F.struct(
        F.col(order), *[F.col(c) for c in rest if c != order])
    best = rows.groupBy(*keys).agg(F.max_by(body, rank).alias("_row"))
    return best.select(*keys, "_row.*").select(*rows.columns)


def _folder(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _children(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders below ``path`` that hold a success marker."""
    at, fs = _folder(spark, path)
    if not fs.exists(at):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(at) if s.isDirectory()]
    return sorted(n for n in names if fs.exists(_folder(spark, f"{path}/{n}/_SUCCESS")[0]))


class BucketTable:
    """Table of rows by ``key``, kept as batches split into hash buckets.

    With ``order`` a key has one row, the one with the greatest ``order`` (on equal ones that of the later batch).
    Without it a batch replaces all rows of the keys it holds. ``buckets`` is fixed for the life of a table.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, key: list[str], *,
                 order: str | None = "updated_at", buckets: int = 64):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self.key, self.order, self.buckets = key, order, buckets

    # ---- batches ----
    def _folds(self) -> dict[str, list[str]]:
        """{folded batch: the batches it stands for}; a handful of names."""
        done = set(self._complete())
        return {n: [r[0] for r in self.spark.read.parquet(f"{self.path}/_folded/{n}").collect()]
                for n in _children(self.spark, f"{self.path}/_folded") if n in done}

    def _complete(self) -> list[str]:
        return [n.removeprefix("batch=") for n in _children(self.spark, self.path) if n.startswith("batch=")]

    def batches(self) -> list[str]:
        """Names of the batches that make up the table, in the order they were written."""
        gone = {name for names in self._folds().values() for name in names}
        return [n for n in self._complete() if n not in gone]

    def _next(self) -> str:
        """A name after all others; no two writers choose the same."""
        at, fs = _folder(self.spark, self.path)
        names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
        last = max((int(n[6:16]) for n in names if n.startswith("batch=")), default=0)
        return f"{last + 1:010d}-{uuid.uuid4().hex[:12]}"

    def _bucket(self, columns: list[Column]) -> Column:
        return F.pmod(F.xxhash64(*columns), F.lit(self.buckets)).cast("int")

    # ---- writing ----
    def write(self, new: DataFrame, batch: int | None = None, run: str = "") -> None:
        """Add a batch. Only the buckets of its keys get files; rows of one bucket are split or joined by their size.

        ``batch`` and ``run`` name the batch of a stream: written again, it takes its own place.
        """
        name = self._next() if batch is None else f"{batch + 1:010d}-{run}"
        self._store(new, name)

    def _store(self, rows: DataFrame, name: str) -> None:
        (rows.select(*self.schema.names, self._bucket([F.col(k) for k in self.key]).alias("bucket"))
         .hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/batch={name}"))

    def fold(self) -> None:
        """Join all batches into one, without repeats.

        What an earlier fold has joined is removed now, so that its readers had the time in between.
        Batches that come meanwhile stay as they are; a fold that fails changes nothing.
        """
        names = self.batches()
        if len(names) < 2:
            return
        for folded, old in self._folds().items():
            for name in old:
                self._drop(f"batch={name}")
            self._drop(f"_folded/{folded}")
        into = names[-1] + "+"
        self.spark.createDataFrame([(n,) for n in names], "name string").write.mode("overwrite").parquet(
            f"{self.path}/_folded/{into}")
        self._store(self._current(self._rows(names)), into)

    def _drop(self, name: str) -> None:
        at, fs = _folder(self.spark, f"{self.path}/{name}")
        fs.delete(at, True)

    # ---- reading ----
    def _rows(self, names: list[str]) -> DataFrame:
        schema = T.StructType([*self.schema.fields, T.StructField("batch", T.StringType()),
                               T.StructField("bucket", T.IntegerType())])
        if not names:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", self.path).parquet(
            *[f"{self.path}/batch={n}" for n in names])

    def _current(self, rows: DataFrame) -> DataFrame:
        if self.order:
            return latest_per_key(rows.drop("bucket"), self.key, self.order, "batch").select(*self.schema.names)
        last = rows.groupBy(*self.key).agg(F.max("batch").alias("_last"))
        same = [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in self.key]
        found = rows.alias("o").join(last.alias("n"), [*same, F.col("o.batch") == F.col("n._last")], "left_semi")
        return found.select(*[F.col(f"o.{c}") for c in self.schema.names])

    def read(self) -> DataFrame:
        return self._current(self._rows(self.batches()))

    def lookup(self, **values) -> DataFrame:
        """Rows of one key (all its columns); reads its bucket alone."""
        literals = [F.lit(values[k]).cast(self.schema[k].dataType) for k in self.key]
        rows = self._rows(self.batches()).where(F.col("bucket") == self._bucket(literals))
        for k, v in zip(self.key, literals):
            rows = rows.where(F.col(k).eqNullSafe(v))
        return self._current(rows)


class BatchLog:
    """Append-only table with one folder per query and micro-batch.

    A batch costs what it holds and never touches older rows. A batch that runs
    again overwrites its own folder, so replays change nothing; a query with a new
    checkpoint has a new id and writes beside the rows of the one before it.
    """

    def __init__(self, spark: SparkSession, path: str, schema):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def write(self, rows: DataFrame, batch: int, run: str = "0") -> None:
        rows.select(*self.schema.names).write.mode("overwrite").parquet(f"{self.path}/run={run}/batch={batch}")

    def read(self) -> DataFrame:
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return self.spark.createDataFrame([], self.schema).withColumns(
                {"run": F.lit("0"), "batch": F.lit(0)})
        schema = T.StructType([*self.schema.fields, T.StructField("run", T.StringType()),
                               T.StructField("batch", T.IntegerType())])
        return self.spark.read.schema(schema).parquet(self.path)
