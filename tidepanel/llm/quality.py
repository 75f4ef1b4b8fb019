"""Quality by compression: two zstandard dictionaries, one from good and one from bad text.

A text is cut into blocks; each block is compressed with either dictionary, and
the difference of the two sizes per byte is turned into a probability by a
logistic curve. All blocks of a text count, so long texts are judged whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tidepanel.llm.common import id_bucket, spare
from tidepanel.session import written

BLOCK = 1024  # bytes compressed together
LEVEL = 3
DICTIONARY = 110_000  # bytes of each dictionary
SAMPLE_ROWS = 2_000  # labelled rows per class for the dictionaries, at most
SAMPLE_BLOCKS = 8  # blocks taken from one sampled text, spread over the whole of it
CURVE_ROWS = 4_000  # labelled rows for the curve, at most
FOLDS = 5
REJECT_BELOW = 0.3


@dataclass(frozen=True)
class Model:
    """Dictionaries of both classes and the curve; ``None`` where a class has no text."""

    good: bytes | None
    bad: bytes | None
    slope: float
    offset: float


def blocks_of(data: bytes, size: int = BLOCK) -> list[bytes]:
    return [data[i:i + size] for i in range(0, len(data), size)]


def _dictionary(samples: list[bytes], size: int) -> bytes | None:
    import zstandard

    samples = [s for s in samples if len(s) >= 16]
    if not samples:
        return None
    try:
        return zstandard.train_dictionary(size, samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:  # too few samples to train on: their bytes serve as they are
        return b"".join(samples)[-size:]


def _compressor(dictionary: bytes):
    import zstandard

    shared = zstandard.ZstdCompressionDict(dictionary)
    shared.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(
        dict_data=shared, level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False)


def margin(model: Model):
    """Function: text -> (size with the bad dictionary - size with the good one) / bytes."""
    if model.good is None or model.bad is None:
        return lambda text: 0.0
    good, bad = _compressor(model.good), _compressor(model.bad)

    def of(text: str | None) -> float:
        data = (text or "").encode()
        gain = sum(len(bad.compress(b)) - len(good.compress(b)) for b in blocks_of(data))
        return gain / max(len(data), 1)

    return of


def margins(texts: "F.Column", model: Model):
    """Margin of each text, as a column."""

    @F.pandas_udf(DoubleType())
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        of = margin(model)
        for batch in batches:
            yield batch.map(of).astype("float64")

    return scored(texts)


def curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic curve by Newton steps, with targets drawn in (Platt) so that it stays finite."""
    ones = float(y.sum())
    goal = np.where(y == 1, (ones + 1) / (ones + 2), 1 / (len(y) - ones + 2))
    rate = (ones + 1) / (len(y) + 2)
    beta = np.array([0.0, np.log(rate / (1 - rate))])
    design = np.column_stack([x, np.ones_like(x)])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -35, 35)))
        slope = design.T @ (goal - p) - 1e-6 * beta
        curvature = (design * (p * (1 - p))[:, None]).T @ design + 1e-6 * np.eye(2)
        step = np.linalg.solve(curvature, slope)
        beta = beta + np.clip(step, -50, 50)
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0]), float(beta[1])


def _sampled(labels: DataFrame, docs: DataFrame, rows: int) -> DataFrame:
    """(text, quality) of at most ``rows`` labelled documents, drawn by a hash of the id."""
    some = labels.orderBy(F.xxhash64("doc_id", F.lit(17)), "doc_id").limit(rows)
    # at most ``rows`` pairs of numbers
    return docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").select("text", "quality")


def fit(docs: DataFrame, labels: DataFrame, *, sample_rows: int = SAMPLE_ROWS, curve_rows: int = CURVE_ROWS,
        sample_blocks: int = SAMPLE_BLOCKS, dictionary: int = DICTIONARY) -> Model:
    """Model from labelled rows outside the held-out fold (crc32 of the id modulo 5 is 0).

    Folds 1 to 3 train the dictionaries, fold 4 the curve. Both samples are bounded by
    ``sample_rows`` (per class) and ``curve_rows``, counted over labels that have a document; of each
    text the dictionaries see ``sample_blocks`` blocks of BLOCK bytes, spread evenly over it, the curve
    all of it. A document with labels of both kinds, or a null
    one, is not used. Without labels of both classes the score is one constant.
    """
    clear = (labels.where("doc_id is not null").groupBy("doc_id")
             .agg(F.min("quality").alias("quality"), F.max("quality").alias("_high"))
             .where("quality = _high and quality in (0, 1)").drop("_high")
             .withColumn("_fold", id_bucket(F.col("doc_id"), FOLDS)))
    clear = written(clear.join(docs.select("doc_id").distinct(), "doc_id", "left_semi"), "labelled")

    @F.pandas_udf("array<binary>")
    def spread(texts: pd.Series) -> pd.Series:
        def some(text):
            data = blocks_of((text or "").encode())
            if len(data) > sample_blocks:
                data = [data[i * len(data) // sample_blocks] for i in range(sample_blocks)]
            return data
        return texts.map(some)

    train = clear.where("_fold between 1 and 3")
    made: dict[int, bytes | None] = {}
    for quality in (0, 1):
        rows = _sampled(train.where(F.col("quality") == quality), docs, sample_rows)
        found = sorted(bytes(b) for r in rows.select(spread("text")).collect() for b in r[0])
        made[quality] = _dictionary(found, dictionary)
    model = Model(made[1], made[0], 0.0, 0.0)
    held = _sampled(clear.where("_fold = 4"), docs, curve_rows)
    rows = held.select(margins(F.col("text"), model).alias("x"), "quality").collect()
    if not rows:
        return model
    rows.sort()
    slope, offset = curve(np.array([r[0] for r in rows], float), np.array([r[1] for r in rows], float))
    return Model(made[1], made[0], slope, offset)


def score(texts, model: Model):
    """Probability that a text is of good quality, as a column; null and empty texts have margin 0."""
    return 1 / (1 + F.exp(-(margins(texts, model) * model.slope + F.lit(model.offset))))


def accepted(docs: DataFrame, model: Model, least: float = REJECT_BELOW) -> DataFrame:
    """Rows of ``docs`` whose text scores ``least`` or more; columns as they came."""
    name = spare(docs, "score")
    return docs.withColumn(name, score(F.col("text"), model)).where(F.col(name) >= least).drop(name)
