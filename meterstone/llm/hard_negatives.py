"""Hard-negative mining with rotated one-bit codes whose intervals are certain.

Vectors hold integers; a score is their inner product. Each row belongs to the nearest of a few centres. What it differs by from its
centre is turned by a random rotation and kept as one sign bit a dimension, with two numbers: its inner product with the code
(the alignment) and the length of what the code leaves over (the rest).

An anchor, turned too and rounded to ``PLANES`` bits a dimension, meets a code by popcounts of its bit planes. With code b of length one,
anchor q and g its estimate of <b, q>, wrong by e at most (the length of what rounding changed), Cauchy and Schwarz give

    score = <centre, q> + alignment * g  +-  (alignment * e + rest * sqrt(|q|^2 - max(0, |g| - e)^2))

for certain, so a row whose interval ends below the best found, or outside the wanted range, is left out without loss. All others
are scored in integers. Results are exact whatever the centres are: they, fitted on ``sample_rows`` rows, only shorten intervals.

Anchors are taken in blocks of about ``block`` rows, the only thing sent to all tasks. For each block all codes are read twice:
once for the positives, once for the negatives, as their range follows from the positives' scores. A task keeps the best of
its rows as it reads, and passes on no more than asked, so neither a common label nor a common vector meets in one task. Results of a block are written.

Rows without id or label, null vectors, and vectors with null or non-finite components take no part, nor do vectors of another length than
most (ties: the shorter). Rows with the id of an anchor are the anchor; of rows with one id the smallest label, then vector, counts. Ties in
score go to the smaller id. Too few rows give fewer, none give none. Other columns are not read. Scores beyond a long are an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from meterstone.llm.common import stored, table
from meterstone.session import work_folder

#: Bits an anchor's component is rounded to.
PLANES = 8


def quantised(vectors: DataFrame, label: Column, vector: str = "embedding", scale: int = 256) -> DataFrame:
    """(vec_id, label, u) of the rows that take part: ``u`` is the floor of ``scale`` times each component."""
    v = F.col("v")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = vectors.select("vec_id", label.cast("long").alias("label"), F.col(vector).cast("array<double>").alias("v")).where(
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & v.isNotNull() & finite)
    one = good.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("first")).select("vec_id", "first.label", F.transform("first.v", lambda x: F.floor(x * scale)).alias("u"))
    lengths = good.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "n").limit(1).collect()
    return one.where(F.size("u") == (lengths[0]["n"] if lengths else 0))


def fit(rows: DataFrame, centres: int, sample_rows: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Centres by a few of Lloyd's rounds on a sample in hash order, and a random rotation."""
    sample = np.array([r["u"] for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id").select("u").limit(sample_rows).collect()], float)
    rng = np.random.default_rng(seed)
    middle = sample[rng.choice(len(sample), min(centres, len(sample)), replace=False)]
    for _ in range(8):
        near = nearest(sample, middle)
        counts = np.bincount(near, minlength=len(middle))[:, None]
        sums = np.zeros_like(middle)
        np.add.at(sums, near, sample)
        middle = np.where(counts, sums / np.maximum(counts, 1), middle)
    turned, _ = np.linalg.qr(rng.normal(size=(sample.shape[1], sample.shape[1])))
    return middle, turned


def nearest(v: np.ndarray, middle: np.ndarray) -> np.ndarray:
    return np.argmin((middle ** 2).sum(axis=1) - 2 * (v @ middle.T), axis=1)


def bit_words(bits: np.ndarray) -> np.ndarray:
    """Rows of bits as rows of 64-bit words."""
    raw = np.packbits(bits, axis=1, bitorder="little")
    return np.pad(raw, ((0, 0), (0, -raw.shape[1] % 8))).view(np.uint64)


def coded(rows: DataFrame, middle: np.ndarray, turned: np.ndarray) -> DataFrame:
    """Add to each row its centre, its code, the alignment and the rest."""
    def code(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                u = np.stack(batch["u"].to_numpy()).astype(float)
                centre = nearest(u, middle)
                v = (u - middle[centre]) @ turned
                alignment = np.abs(v).sum(axis=1) / np.sqrt(max(1, v.shape[1]))
                rest = np.sqrt(np.maximum(0, (v ** 2).sum(axis=1) - alignment ** 2))
                yield batch.assign(centre=centre, code=[w.tobytes() for w in bit_words(v > 0)], alignment=alignment, rest=rest)

    return rows.mapInPandas(code, "vec_id long, label long, u array<long>, centre int, code binary, alignment double, rest double")


class Codes:
    """A batch of coded rows, and the intervals of their scores with an anchor."""

    def __init__(self, batch: pd.DataFrame, middle: np.ndarray) -> None:
        self.ids, self.labels, self.middle = batch["vec_id"].to_numpy(), batch["label"].to_numpy(), middle
        self.u = np.stack(batch["u"].to_numpy())
        self.centre, self.alignment, self.rest = (batch[c].to_numpy() for c in ("centre", "alignment", "rest"))
        self.words = np.frombuffer(b"".join(batch["code"]), np.uint64).reshape(len(batch), -1)
        self.ones = np.bitwise_count(self.words).sum(axis=1, dtype=np.int64)
        self.longest = float(np.abs(self.u).max(initial=0)) * self.u.shape[1]

    def interval(self, rows: np.ndarray, anchor: np.ndarray, turned: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Smallest and largest score that the ``rows`` can have."""
        dims = len(anchor)
        if self.longest * float(np.abs(anchor).max(initial=0)) >= 2 ** 62:
            raise ValueError("scores do not fit a long")
        q = anchor @ turned
        low, step = q.min(initial=0), (q.max(initial=0) - q.min(initial=0)) / (2 ** PLANES - 1) or 1.0
        levels = np.rint((q - low) / step).astype(np.int64)
        e = np.sqrt(((q - low - levels * step) ** 2).sum())
        planes = bit_words(((levels[None] >> np.arange(PLANES)[:, None]) & 1).astype(bool))
        words = self.words[rows]
        met = sum((np.bitwise_count(words & plane).sum(axis=1, dtype=np.int64) << j) for j, plane in enumerate(planes))
        g = (low * (2 * self.ones[rows] - dims) + step * (2 * met - levels.sum())) / np.sqrt(max(1, dims))
        beyond = np.sqrt(np.maximum(0, (q ** 2).sum() - np.maximum(0, np.abs(g) - e) ** 2))
        guess = (self.middle @ anchor)[self.centre[rows]] + self.alignment[rows] * g
        # The last term is far above what rounding in doubles can change.
        half = self.alignment[rows] * e + self.rest[rows] * beyond + 1e-6 + 1e-9 * (np.abs(guess) + self.longest * float(np.abs(anchor).max(initial=0)))
        return guess - half, guess + half

    def scores(self, rows: np.ndarray, anchor: np.ndarray) -> np.ndarray:
        return self.u[rows] @ anchor


def nth_largest(x: np.ndarray, n: int) -> float:
    return float(np.partition(x, len(x) - n)[len(x) - n]) if len(x) >= n else -np.inf


class Best:
    """The first ``n`` rows so far: higher scores first, ties by smaller id."""

    def __init__(self, n: int) -> None:
        self.n, self.ids, self.scores = n, np.zeros(0, np.int64), np.zeros(0, np.int64)

    @property
    def least(self) -> float:
        return self.scores[-1] if len(self.scores) == self.n else -np.inf

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        ids, scores = np.concatenate([self.ids, ids]), np.concatenate([self.scores, scores])
        order = np.lexsort((ids, -scores))[:self.n]
        self.ids, self.scores = ids[order], scores[order]


def positives_of(batch: Codes, anchor_id: int, label: int, anchor: np.ndarray, turned: np.ndarray, best: Best) -> int:
    """Add a batch's rows of the anchor's label; gives how many had to be scored."""
    rows = np.flatnonzero((batch.labels == label) & (batch.ids != anchor_id))
    low, high = batch.interval(rows, anchor, turned)
    rows = rows[high >= max(best.least, nth_largest(low, best.n))]
    best.add(batch.ids[rows], batch.scores(rows, anchor))
    return len(rows)


def score_range(positive: int, low: int, high: int) -> tuple[int, int]:
    """Smallest and largest score within ``low`` and ``high`` percent of the positive's."""
    return -(-low * positive // 100), high * positive // 100


def negatives_of(batch: Codes, anchor_id: int, label: int, anchor: np.ndarray, turned: np.ndarray, ranges: list[tuple[int, int]], bests: list[Best]) -> int:
    """Add a batch's rows of other labels to each positive's best; gives how many had to be scored."""
    rows = np.flatnonzero((batch.labels != label) & (batch.ids != anchor_id))
    low, high = batch.interval(rows, anchor, turned)
    needed = np.zeros(len(rows), bool)
    for (first, last), best in zip(ranges, bests):
        inside = low[(low >= first) & (high <= last)]  # in the range for certain
        needed |= (low <= last) & (high >= max(first, best.least, nth_largest(inside, best.n)))
    rows = rows[needed]
    scores = batch.scores(rows, anchor)
    for (first, last), best in zip(ranges, bests):
        fits = (scores >= first) & (scores <= last)
        best.add(batch.ids[rows[fits]], scores[fits])
    return len(rows)


def mine(rows: DataFrame, anchors: DataFrame, n_positives: int = 5, n_negatives: int = 10, low: int = 30, high: int = 90,
         centres: int = 256, sample_rows: int = 20_000, block: int = 2048, seed: int = 11) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for each id of ``anchors`` among ``rows`` (``quantised``)."""
    spark, kinds = rows.sparkSession, "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    rows = stored(rows, "integers")
    if rows.isEmpty():
        return spark.createDataFrame([], kinds)
    middle, turned = fit(rows, centres, sample_rows, seed)
    codes = stored(coded(rows, middle, turned), "codes")
    asked = codes.join(anchors.select("vec_id").distinct(), "vec_id", "left_semi").select("vec_id", "label", "u")
    blocks = max(1, -(-asked.count() // block))
    asked = stored(asked.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks))), "anchors")
    path = work_folder(spark, "negatives")
    for number in range(blocks):
        held = asked.where(F.col("block") == number).orderBy("vec_id").collect()  # about ``block`` rows
        if held:
            mined(codes, held, middle, turned, n_positives, n_negatives, low, high).write.mode("append").parquet(path)
    return spark.read.schema(kinds).parquet(path) if asked.limit(1).count() else spark.createDataFrame([], kinds)


def mined(codes: DataFrame, held: list, middle: np.ndarray, turned: np.ndarray, n_positives: int, n_negatives: int, low: int, high: int) -> DataFrame:
    """The negatives of a block of anchors."""
    context = codes.sparkSession.sparkContext
    ids, labels, u = [r["vec_id"] for r in held], [r["label"] for r in held], np.array([r["u"] for r in held], np.int64)
    sent = context.broadcast((ids, labels, u, middle, turned))

    def find_positives(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, labels, u, middle, turned = sent.value
        best = [Best(n_positives) for _ in ids]
        for batch in batches:
            if len(batch):
                held = Codes(batch, middle)
                for i, found in enumerate(best):
                    positives_of(held, ids[i], labels[i], u[i], turned, found)
        yield pd.DataFrame([(i, int(p), int(s)) for i, b in zip(ids, best) for p, s in zip(b.ids, b.scores)], columns=["anchor_id", "positive_id", "positive_score"])

    first = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    found = codes.mapInPandas(find_positives, "anchor_id long, positive_id long, positive_score long")
    positives: dict[int, list] = {}
    for r in found.withColumn("i", F.row_number().over(first)).where(F.col("i") <= n_positives).collect():  # of one block
        positives.setdefault(r["anchor_id"], []).append((r["positive_id"], r["positive_score"]))
    known = context.broadcast(positives)

    def find_negatives(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, labels, u, middle, turned = sent.value
        wanted = [known.value.get(i, []) for i in ids]
        ranges = [[score_range(s, low, high) for _, s in w] for w in wanted]
        best = [[Best(n_negatives) for _ in w] for w in wanted]
        for batch in batches:
            if len(batch):
                held = Codes(batch, middle)
                for i, found in enumerate(best):
                    if found:
                        negatives_of(held, ids[i], labels[i], u[i], turned, ranges[i], found)
        yield pd.DataFrame([(i, p, s, int(n), int(t)) for i, w, bs in zip(ids, wanted, best) for (p, s), b in zip(w, bs) for n, t in zip(b.ids, b.scores)],
                           columns=["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"])

    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    all_found = codes.mapInPandas(find_negatives, "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long")
    return all_found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n_negatives).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def op11_hard_negatives(spark, sf_dir: str) -> DataFrame:
    """Ten negatives for each of five positives of every vector whose id is divisible by 100."""
    vectors = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))
    return mine(quantised(vectors, label), vectors.where("vec_id % 100 = 0"))
