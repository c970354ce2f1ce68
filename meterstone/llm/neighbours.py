"""Approximate nearest neighbours by an adaptive dimension scan inside probed lists.

Index: centres are fitted on at most ``sample_rows`` vectors (the only bounded part); every vector goes to the list of its
nearest centre. Equal vectors are one class with its smallest ids; a list with many classes is cut into chunks of about
``chunk_rows``, so neither a common vector nor a crowded list is one task's work.

The number of lists to probe follows from the data: for ``trial_queries`` vectors of the sample the true neighbours are found
by comparing them with all vectors (one linear pass), and as many lists are probed as hold ``target`` of them. A query whose
lists hold too few ids goes on to the next ones until they suffice.

Search: a query probes the lists of its nearest centres. In each chunk the vectors, turned by a random rotation,
are read a block of columns after the other. After each block a test on the partial distance (it tells the whole distance
up to a factor that shrinks with the number of columns read) drops candidates that are almost surely too far; what is
left at the end gets its distance from the original vectors in double precision.

Vectors that are null, zero, hold null or non-finite components, have no id, or another length than most, take no part.
Rows with the id of the query count as the query itself. Fewer candidates than asked give fewer rows. Equal distances go
to the smaller id.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from meterstone.llm.common import stored, table


class Index(NamedTuple):
    centres: np.ndarray
    rotation: np.ndarray


def usable(vectors: DataFrame, vector: str) -> DataFrame:
    """(vec_id, v) of the vectors that take part."""
    v = F.col("v")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = vectors.select(F.col("vec_id"), F.col(vector).cast("array<double>").alias("v")).where(
        F.col("vec_id").isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0))
    lengths = good.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "n").limit(1).collect()
    return good.where(F.size("v") == (lengths[0]["n"] if lengths else 0))


def nearest_centres(v: np.ndarray, centres: np.ndarray, n: int) -> np.ndarray:
    d = (centres ** 2).sum(axis=1) - 2 * (v @ centres.T)
    n = min(n, len(centres))
    return np.argsort(d, axis=1, kind="stable")[:, :n]


def fit_index(classes: DataFrame, n_classes: int, sample_rows: int, max_lists: int, seed: int) -> tuple[Index, np.ndarray]:
    """Centres by Lloyd's rounds on a sample in hash order, and a random rotation; also the sample."""
    rows = classes.orderBy(F.xxhash64("key", F.lit("sample")), "key").select("v").limit(sample_rows).collect()
    sample = np.array([r["v"] for r in rows])
    rng = np.random.default_rng(seed)
    lists = max(1, min(max_lists, int(np.sqrt(n_classes)), len(sample)))
    centres = sample[rng.choice(len(sample), lists, replace=False)].copy()
    for _ in range(12):
        near = np.concatenate([nearest_centres(sample[k:k + 4096], centres, 1)[:, 0] for k in range(0, len(sample), 4096)])
        sums, counts = np.zeros_like(centres), np.bincount(near, minlength=lists)
        np.add.at(sums, near, sample)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    turned, upper = np.linalg.qr(rng.normal(size=(sample.shape[1], sample.shape[1])))
    return Index(centres, turned * np.sign(np.diag(upper))), sample


def probes_needed(listed: DataFrame, index, trials: np.ndarray, k: int, target: float) -> int:
    """How many of the nearest lists hold ``target`` of the true ``k`` neighbours of the trial vectors."""
    def near(batches):
        place = np.argsort(nearest_centres(trials, index.value[0], len(index.value[0])), axis=1)
        for batch in batches:
            if len(batch):
                v, lists = np.stack(batch["v"].to_numpy()), batch["list"].to_numpy()
                d = (v ** 2).sum(axis=1)[None, :] - 2 * trials @ v.T + (trials ** 2).sum(axis=1)[:, None]
                d[d < 1e-9] = np.inf  # the trial vector itself
                best = np.argpartition(d, min(k, d.shape[1]) - 1, axis=1)[:, :k]
                q = np.repeat(np.arange(len(trials)), best.shape[1])
                best = best.ravel()
                yield pd.DataFrame({"trial": q, "d": d[q, best], "place": place[q, lists[best]]})

    found = listed.select("v", "list").mapInPandas(near, "trial int, d double, place int")
    order = Window.partitionBy("trial").orderBy("d", "place")
    places = [r["place"] for r in found.withColumn("i", F.row_number().over(order)).where((F.col("i") <= k) & (F.col("d") < float("inf"))).collect()]
    return int(np.quantile(places, target)) + 1 if places else 1


def scan(query: np.ndarray, turned_query: np.ndarray, original: np.ndarray, turned: np.ndarray, k: int, block: int, strictness: float) -> tuple[np.ndarray, np.ndarray]:
    """The up to ``k`` nearest rows of a chunk and their distances."""
    rows, dims = turned.shape
    first = np.arange(min(rows, 4 * k))
    known = np.sqrt(((original[first] - query) ** 2).sum(axis=1))
    limit = np.partition(known, k - 1)[k - 1] if len(known) >= k else np.inf
    left = np.arange(len(first), rows)
    partial = np.zeros(len(left))
    for start in range(0, dims, block):
        if not len(left):
            break
        stop = min(dims, start + block)
        partial += ((turned[left, start:stop] - turned_query[start:stop]) ** 2).sum(axis=1)
        if stop < dims:  # at the end nothing is left to be guessed
            stays = np.sqrt(partial * dims / stop) <= limit * (1 + strictness / np.sqrt(stop)) + 1e-9
            left, partial = left[stays], partial[stays]
    exact = np.sqrt(((original[left] - query) ** 2).sum(axis=1))
    places, distances = np.concatenate([first, left]), np.concatenate([known, exact])
    if len(places) > k:  # all that tie with the last stay
        near = distances <= np.partition(distances, k - 1)[k - 1]
        places, distances = places[near], distances[near]
    return places, distances


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, vector: str = "embedding", target: float = 0.97, trial_queries: int = 200,
           sample_rows: int = 20_000, max_lists: int = 1024, chunk_rows: int = 4096, block: int = 16, strictness: float = 2.1, seed: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): for each id in ``queries`` its ``k`` nearest other vectors of ``vectors``."""
    key = F.struct(F.xxhash64("v"), F.xxhash64(F.lit(1), "v")).alias("key")
    rows = stored(usable(vectors, vector).select("vec_id", "v", key).distinct(), "vectors")
    # Of equal vectors any query needs the k + 1 smallest ids at most; each task passes on no more.
    smallest = Window.partitionBy("key").orderBy("vec_id")
    few = rows.select("key", "vec_id").withColumn("i", F.row_number().over(smallest)).where(F.col("i") <= k + 1)
    ids = few.groupBy("key").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    one = rows.groupBy("key").agg(F.first("v").alias("v"))
    classes = stored(one.join(ids, "key"), "classes")
    n_classes = classes.count()
    asked = rows.join(queries.select(F.col("vec_id")).distinct(), "vec_id", "left_semi").select("vec_id", "key")
    if not n_classes:
        return asked.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score")).where("false")
    fitted, sample = fit_index(classes, n_classes, sample_rows, max_lists, seed)
    index = classes.sparkSession.sparkContext.broadcast(tuple(fitted))  # plain arrays: workers need not have this package
    asked = stored(asked, "queries")

    def probe(frame: DataFrame, n: int, held: np.ndarray | None = None) -> DataFrame:
        """The ``n`` nearest lists of each row; with ``held`` (ids of each list) as many more as ``k`` ids and its own take."""
        def add(batches):
            for batch in batches:
                for start in range(0, len(batch), 1024):
                    part = batch.iloc[start:start + 1024]
                    near = nearest_centres(np.stack(part["v"].to_numpy()), index.value[0], n if held is None else len(index.value[0]))
                    counts = np.full(len(near), n) if held is None else np.maximum(n, (np.cumsum(held[near], axis=1) <= k).sum(axis=1) + 1)
                    yield part.assign(lists=[list(map(int, r[:m])) for r, m in zip(near, counts)])

        probed = frame.mapInPandas(add, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in frame.schema.fields) + ", lists array<int>")
        return probed.select(*frame.columns, F.explode("lists").alias("list"))

    flat = classes.select(F.col("key.*"), "v", "ids").toDF("h1", "h2", "v", "ids")
    listed = stored(probe(flat, 1), "lists")
    probes = probes_needed(listed, index, sample[:trial_queries], k, target)
    # At most ``max_lists`` rows.
    sizes = F.broadcast(listed.groupBy("list").agg(F.ceil(F.count("*") / chunk_rows).cast("int").alias("chunks")))
    chunked = listed.join(sizes, "list").withColumn("chunk", F.pmod("h1", F.col("chunks")).cast("int")).drop("chunks")
    wanted = classes.join(asked.select("key").distinct(), "key", "left_semi").select(F.col("key.*"), "v").toDF("h1", "h2", "v")
    held = np.zeros(len(fitted.centres), np.int64)
    for r in listed.groupBy("list").agg(F.sum(F.size("ids")).alias("n")).collect():  # at most ``max_lists`` rows
        held[r["list"]] = r["n"]
    probing = probe(wanted, probes, held).join(sizes, "list").select("h1", "h2", "v", "list", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))

    def scan_chunk(held: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(held) and len(asking):
            original = np.stack(held["v"].to_numpy())
            turned = original @ index.value[1]
            ids_ = held["ids"].to_numpy()
            for h1, h2, v in zip(asking["h1"], asking["h2"], asking["v"]):
                places, distances = scan(v, v @ index.value[1], original, turned, k + 1, block, strictness)
                found = sorted((d, int(i)) for p, d in zip(places.tolist(), distances.tolist()) for i in ids_[p])[:k + 1]
                out += [(h1, h2, i, d) for d, i in found]
        return pd.DataFrame(out, columns=["h1", "h2", "vec_id", "score"])

    found = chunked.groupBy("list", "chunk").cogroup(probing.groupBy("list", "chunk")).applyInPandas(
        scan_chunk, "h1 long, h2 long, vec_id long, score double")
    best = Window.partitionBy("h1", "h2").orderBy("score", "vec_id")
    top = found.withColumn("i", F.row_number().over(best)).where(F.col("i") <= k + 1).groupBy("h1", "h2").agg(
        F.array_sort(F.collect_list(F.struct("score", "vec_id"))).alias("near"))
    flat_asked = asked.select(F.col("vec_id").alias("query_id"), F.col("key.*")).toDF("query_id", "h1", "h2")
    others = flat_asked.join(top, ["h1", "h2"]).select("query_id", F.slice(F.filter(
        "near", lambda x: x["vec_id"] != F.col("query_id")), 1, k).alias("near"))
    return others.select("query_id", F.posexplode("near").alias("place", "n")).select(
        "query_id", (F.col("place") + 1).alias("rank"), "n.vec_id", "n.score")


def op3_neighbours(spark, sf_dir: str) -> DataFrame:
    """The 10 nearest of every vector whose id is divisible by 100, among all others."""
    vectors = table(spark, sf_dir, "embeddings")
    return search(vectors, vectors.where("vec_id % 100 = 0").select("vec_id"))
