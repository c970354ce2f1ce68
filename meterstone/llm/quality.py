"""Quality by compression: a text is compressed with a dictionary of good and with one of bad labelled texts.

The difference of the two compressed sizes, divided by their sum, is mapped to a probability by a logistic curve. Texts
are compressed whole, in pieces of ``PIECE`` bytes, so that a long text cannot fall back on its own repetitions.

The model is fitted on a bounded sample: at most ``max_rows`` labelled rows of each label, and at most ``max_bytes`` of
their text, taken in the order of a hash of the id. One half makes the dictionaries, the other half the curve.

Null and empty texts have no difference and get the calibrated score of the difference 0. Rows whose label is null or
not 0 or 1 are no training rows; ids labelled twice count twice. With labels of one kind only, every score is that
label's share (0 or 1); without any, 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterstone.llm.common import crc32_rest, table

PIECE, LEVEL, DICTIONARY_BYTES = 2048, 3, 112 << 10


@dataclass(frozen=True)
class QualityModel:
    good: bytes
    bad: bytes
    slope: float
    intercept: float


def differences(texts: list[str | None], good: bytes, bad: bytes) -> np.ndarray:
    """(size with the bad dictionary - size with the good one) / sum of both, per text; 0 for empty texts."""
    import zstandard

    packers = []
    for content in (good, bad):
        words = zstandard.ZstdCompressionDict(content)
        words.precompute_compress(level=LEVEL)
        packers.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=words, write_content_size=False, write_dict_id=False).compress)
    out = np.zeros(len(texts))
    for i, text in enumerate(texts):
        raw = (text or "").encode("utf-8", "replace")
        sizes = [sum(len(pack(raw[k:k + PIECE])) for k in range(0, len(raw), PIECE)) for pack in packers]
        out[i] = (sizes[1] - sizes[0]) / max(1, sizes[0] + sizes[1])
    return out


def dictionary(texts: list[str]) -> bytes:
    """A trained dictionary; with too little text to train on, the text itself."""
    import zstandard

    raw = [t.encode("utf-8", "replace") for t in texts]
    pieces = [r[k:k + PIECE] for r in raw for k in range(0, len(r), PIECE)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, pieces, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(pieces)[-DICTIONARY_BYTES:] or b" " * 8


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 60) -> tuple[float, float]:
    """Slope and intercept by Newton steps with a small ridge, which also bounds the slope of separable data."""
    scale = float(x.std()) or 1.0
    a = np.column_stack([x / scale, np.ones(len(x))])
    w = np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        gradient = a.T @ (p - y) + 1e-2 * w
        hessian = (a * (p * (1 - p))[:, None]).T @ a + 1e-2 * np.eye(2)
        w = w - np.linalg.solve(hessian, gradient)
    return float(w[0] / scale), float(w[1])


def fit_quality(docs: DataFrame, labels: DataFrame, max_rows: int = 4000, max_bytes: int = 48 << 20) -> QualityModel | float:
    """Fit on labelled rows (``labels`` has doc_id and quality); a plain number if only one label or none is there."""
    marks = labels.where(F.col("quality").isin(0, 1)).select("doc_id", F.col("quality").alias("label"))
    turns = marks.withColumn("turn", F.xxhash64("doc_id", F.lit("sample")))
    # Only ids are sorted, and each task passes on its first max_rows; the chosen ids are at most 2 * max_rows rows.
    good, bad = (turns.where(F.col("label") == x).orderBy("turn", "doc_id").limit(max_rows) for x in (1, 0))
    chosen = good.unionByName(bad)
    rows = (docs.select("doc_id", "text").where("text is not null and text != ''")
            .join(F.broadcast(chosen), "doc_id").orderBy("turn", "doc_id").toLocalIterator())
    used, kept = 0, {0: ([], []), 1: ([], [])}
    for row in rows:
        used += len(row["text"])
        if used > max_bytes and all(a and b for a, b in kept.values()):
            break
        halves = kept[row["label"]]
        halves[len(halves[0]) > len(halves[1])].append(row["text"])
    counts = {label: len(a) + len(b) for label, (a, b) in kept.items()}
    if min(counts.values()) < 2:
        return counts[1] / sum(counts.values()) if sum(counts.values()) else 0.5
    good, bad = dictionary(kept[1][0]), dictionary(kept[0][0])
    x = differences(kept[1][1] + kept[0][1], good, bad)
    y = np.array([1.0] * len(kept[1][1]) + [0.0] * len(kept[0][1]))
    return QualityModel(good, bad, *logistic(x, y))


def score_quality(docs: DataFrame, model: QualityModel | float, column: str = "quality_score") -> DataFrame:
    """The columns of ``docs`` plus ``column`` (0 to 1). Only the text is looked at."""
    if not isinstance(model, QualityModel):
        return docs.withColumn(column, F.lit(float(model)))

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            z = model.slope * differences(list(texts), model.good, model.bad) + model.intercept
            yield pd.Series(1 / (1 + np.exp(-np.clip(z, -30, 30))))

    return docs.withColumn(column, score("text"))


def op10_quality(spark, sf_dir: str) -> DataFrame:
    """Score every document with a model of the labelled rows whose crc32 modulo 3 is not 1."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit_quality(docs, labels.where(crc32_rest(F.col("doc_id"), 3) != 1))
    scored = score_quality(docs.select("doc_id", "text"), model)
    return scored.select(
        "doc_id", F.coalesce(crc32_rest(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"),
        F.col("quality_score").alias("score"), (F.col("quality_score") >= 0.5).cast("int").alias("predicted"))
