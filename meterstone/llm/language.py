"""Language of a text: averaged hashed subword embeddings and a linear softmax, with calibrated rejection.

The subwords of a text are its runs of one to three signs, lower-cased, every run of other signs than letters read as one
blank. Each is hashed to a row of an embedding table; the mean of the rows goes through a linear layer and a softmax.
Table and layer are trained by stochastic gradient descent in numpy. As both are linear, their product is kept: a text
is scored by the mean of its subwords' rows of logits.

The model is fitted on a bounded sample: at most ``max_rows`` labelled rows of each language, in the order of a hash of the
id, cut into pieces of several lengths all over their texts. A fifth of the rows is held back from training; it sets the
temperature that makes scores honest and the score below which a prediction counts as rejected.

Null texts and texts without a letter are ``und`` with score 0. Texts are read whole. Without any labelled row all texts
are ``und``. Ties go to the language that comes first in the alphabet.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from meterstone.llm.common import crc32_rest, received, sent, table

BUCKETS = 1 << 16
#: Signs that are hashed at a time.
STEP = 1 << 20
UNKNOWN = "und"


@dataclass(frozen=True)
class LanguageModel:
    names: tuple[str, ...]
    logits: np.ndarray
    temperature: float
    least_score: float


def letters_of(text: str) -> np.ndarray:
    """Code points of the lower-cased letters, with single blanks (32) before, between and after words."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype="<u4")
    ascii_letter = (points >= 97) & (points <= 122)
    # Above ASCII, letters are all but the signs and spaces of the first block and of general punctuation.
    wide = (points >= 0xAA) & (points != 0xAB) & (points != 0xBB) & (points != 0xBF) & ((points < 0x2000) | (points > 0x2BFF))
    points = np.where(ascii_letter | wide, points, 32).astype(np.uint32)
    framed = np.concatenate([[32], points, [32]]).astype(np.uint32)
    keep = np.ones(len(framed), bool)
    keep[1:] = (framed[1:] != 32) | (framed[:-1] != 32)
    return framed[keep]


def subwords(signs: np.ndarray) -> np.ndarray:
    """Bucket of each run of one, two and three signs."""
    with np.errstate(over="ignore"):
        mixed = signs * np.uint32(0x9E3779B1)
        mixed ^= mixed >> np.uint32(15)
        two = mixed[1:] * np.uint32(0x85EBCA6B) + mixed[:-1]
        three = mixed[2:] * np.uint32(0xC2B2AE35) + two[:-1] * np.uint32(0x27D4EB2F)
        runs = np.concatenate([mixed, two, three]) * np.uint32(0x2C1B3C6D)
    return (runs >> np.uint32(16)).astype(np.int64)


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def text_logits(text: str, logits: np.ndarray) -> np.ndarray:
    """Mean of the subwords' logits, a step of the text at a time."""
    signs = letters_of(text)
    total, n = np.zeros(logits.shape[1]), 0
    for k in range(0, len(signs), STEP):
        buckets = subwords(signs[k:k + STEP])
        total += np.bincount(buckets, minlength=BUCKETS) @ logits if len(buckets) > BUCKETS else logits[buckets].sum(axis=0)
        n += len(buckets)
    return total / max(1, n)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def pieces_of(texts: list[str], rng: np.random.Generator) -> list[str]:
    """Pieces of 12 to 800 signs from all over each text, and short texts whole."""
    out = []
    for text in texts:
        if len(text) <= 12:
            out.append(text)
            continue
        for length in (12, 40, 150, 800):
            start = int(rng.integers(0, max(1, len(text) - length)))
            out.append(text[start:start + length])
    return [t for t in out if has_letter(t)]


def train(texts: list[str], marks: np.ndarray, n_langs: int, size: int, epochs: int, rate: float, rng: np.random.Generator) -> np.ndarray:
    """Embeddings times layer, after descending over batches of texts in random order."""
    bags = [subwords(letters_of(t)) for t in texts]
    table_, layer = rng.normal(0, 0.1, (BUCKETS, size)), rng.normal(0, 0.5, (size, n_langs))
    batch = 32
    for epoch in range(epochs):
        order, step = rng.permutation(len(bags)), rate * (1 - epoch / epochs)
        for k in range(0, len(order), batch):
            chosen = order[k:k + batch]
            ids = np.concatenate([bags[i] for i in chosen])
            sizes = np.array([len(bags[i]) for i in chosen])
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            means = np.add.reduceat(table_[ids], starts, axis=0) / sizes[:, None]
            error = softmax(means @ layer)
            error[np.arange(len(chosen)), marks[chosen]] -= 1
            back = (error @ layer.T) / sizes[:, None]
            layer -= step / len(chosen) * (means.T @ error)
            np.subtract.at(table_, ids, step * np.repeat(back, sizes, axis=0))
    return (table_ @ layer).astype(np.float32)


def fit_language(docs: DataFrame, max_rows: int = 600, size: int = 16, epochs: int = 6, rate: float = 0.5, seed: int = 17,
                 accuracy: float = 0.98) -> LanguageModel | None:
    """Fit on rows of ``docs`` with text and lang. ``accuracy`` is asked of the predictions that are not rejected."""
    order = Window.partitionBy("lang").orderBy("turn", "doc_id")
    chosen = (docs.where("lang is not null and text is not null").select("doc_id", "lang").withColumn("turn", F.xxhash64("doc_id", F.lit("sample")))
              .withColumn("place", F.row_number().over(order)).where(F.col("place") <= max_rows).select("doc_id", "lang"))
    kept = docs.select("doc_id", "text", "lang").where("text is not null").join(F.broadcast(chosen.withColumnRenamed("lang", "mark")), "doc_id")
    # Dealt to a few partitions first: the table is read once by all tasks, then the bounded sample comes part by part.
    sample = kept.where("lang = mark").repartition(16, "doc_id").toLocalIterator()
    rows = sorted((r["doc_id"], r["mark"], r["text"]) for r in sample if has_letter(r["text"]))
    names = tuple(sorted({r[1] for r in rows}))
    if not names:
        return None
    rng = np.random.default_rng(seed)
    held = rng.random(len(rows)) < 0.2
    if len(rows) < 20:
        held[:] = False

    def examples(picked: list) -> tuple[list[str], np.ndarray]:
        pairs = [(piece, names.index(lang)) for _, lang, text in picked for piece in pieces_of([text], rng)]
        return [p[0] for p in pairs], np.array([p[1] for p in pairs], dtype=np.int64)

    texts, marks = examples([r for r, h in zip(rows, held) if not h])
    logits = train(texts, marks, len(names), size, epochs, rate, rng)
    texts, marks = examples([r for r, h in zip(rows, held) if h])
    if not texts:
        return LanguageModel(names, logits, 1.0, 0.0)
    z = np.array([text_logits(t, logits) for t in texts])
    heats = np.geomspace(0.05, 5, 60)
    temperature = float(min(heats, key=lambda h: -np.log(softmax(z / h)[np.arange(len(z)), marks] + 1e-12).mean()))
    p = softmax(z / temperature)
    best, right = p.max(axis=1), p.argmax(axis=1) == marks
    order_ = np.argsort(-best)
    good = np.cumsum(right[order_]) / np.arange(1, len(best) + 1)
    passing = np.flatnonzero(good >= accuracy)
    return LanguageModel(names, logits, temperature, float(best[order_][passing[-1]]) if len(passing) else 1.0)


def predict_language(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """The columns of ``docs`` plus ``language`` (lang_pred, score, rejected). Only the text is looked at."""
    kind = "lang_pred string, score double, rejected boolean"
    if model is None:
        return docs.withColumn("language", F.struct(F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("rejected")))
    shared = sent(docs.sparkSession, model)

    @F.pandas_udf(kind)
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = received(shared)
        for texts in batches:
            out = []
            for text in texts:
                if not has_letter(text):
                    out.append((UNKNOWN, 0.0, True))
                    continue
                p = softmax(text_logits(text, m.logits) / m.temperature)
                best = int(p.argmax())
                out.append((m.names[best], float(p[best]), bool(p[best] < m.least_score)))
            yield pd.DataFrame(out, columns=["lang_pred", "score", "rejected"])

    return docs.withColumn("language", predict("text"))


def op7_language(spark, sf_dir: str) -> DataFrame:
    """Predict every document with a model of the rows whose crc32 modulo 4 is not 2."""
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(crc32_rest(F.col("doc_id"), 4) == 2, F.lit(False))
    model = fit_language(docs.where(~held).select("doc_id", "text", "lang"))
    return predict_language(docs.select("doc_id", "text"), model).select(
        "doc_id", held.alias("held_out"), "language.lang_pred", "language.score", "language.rejected")
