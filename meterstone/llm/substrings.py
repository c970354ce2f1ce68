"""Removal of repeated passages: windows of 50 words are counted approximately first, and only likely repeats exactly.

1. Count-min. The windows of a document share anchors: the smallest hash of the grams (runs of ``window // 2 + 1`` words) inside
   a window. Equal windows have equal anchors, so an anchor stands in at least as many documents as each of its windows, and
   there are about a tenth as many anchors as windows. Each task adds the anchors of its documents to its own sketch of two
   rows of cells and passes on the cells it used; the sketches are merged block by block. A window counts as likely repeated
   if both cells of its anchor were used by two documents or more. That overestimates, so no repeat is lost.
2. Exact pass. Likely repeated windows are grouped by 96 bits of hash. Inside a task the smallest document of each window
   already settles the others, so a window goes through the shuffle once per task at most, however common it is.
   What is left is compared across tasks. A window is removed in every document but the one(s) with the smallest id.
3. The removed places of each document are applied to its text.

The merged sketch is the one thing every task holds. It grows with the corpus up to ``max_cells`` cells a row (a bit each,
32 MB a row by default). A corpus beyond that fills it: more windows are then grouped exactly, up to all of them, and the
result stays the same.

Null and empty texts, and texts of less than a window, lose nothing. A row without an id loses nothing and makes no other row
lose anything. Rows with equal ids do not count against each other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from meterstone.llm.common import stored, table
from meterstone.llm.hashing import BASES, USED, Rolling, WordHashes, chunks, merged_sketch, sketch_cells, sliding_min, used_cells, used_twice

class Windows:
    """Anchors and hashes of the windows of a chunk of documents."""

    def __init__(self, window: int) -> None:
        self.window, self.gram = window, window // 2 + 1
        self.words, self.first, self.second = WordHashes(), Rolling(BASES[0]), Rolling(BASES[1])

    def of(self, texts: list[str | None], with_hashes: bool) -> tuple[np.ndarray, ...]:
        """Document number, place and anchor of each window, and its two hashes if asked for."""
        hashes, sizes = self.words.of(texts)
        ends = np.cumsum(sizes)
        starts = np.concatenate([np.arange(e - s, max(e - s, e - self.window + 1)) for s, e in zip(sizes, ends)])
        number = np.repeat(np.arange(len(sizes)), np.maximum(0, sizes - self.window + 1))
        if not len(starts):
            none = np.zeros(0, np.uint64)
            return (number, starts, none, none, none) if with_hashes else (number, starts, none)
        sums = self.first.sums(hashes)
        anchors = sliding_min(self.first.runs(sums, self.gram), self.window - self.gram + 1)[starts]
        place = starts - (ends - sizes)[number]
        if not with_hashes:
            return number, place, anchors
        second = self.second.runs(self.second.sums(hashes), self.window)[starts]
        return number, place, anchors, self.first.runs(sums, self.window)[starts], second


def sketch(docs: DataFrame, window: int, cells: int, chunk_words: int) -> np.ndarray:
    """Bits of the cells used by two documents or more: array (2, cells / 8)."""

    def use(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        maker = Windows(window)
        for chunk in chunks(batches, chunk_words):
            number, _, anchors = maker.of(list(chunk["text"]), False)
            fresh = np.ones(len(anchors), bool)
            fresh[1:] = (anchors[1:] != anchors[:-1]) | (number[1:] != number[:-1])
            pairs = np.unique(np.stack([number[fresh].astype(np.uint64), anchors[fresh]], axis=1), axis=0)[:, 1] if fresh.any() else anchors
            yield used_cells(pairs, cells)

    return merged_sketch(docs.select("text").where("text is not null").mapInPandas(use, USED), cells)


def likely_repeats(docs: DataFrame, bits: np.ndarray, window: int, chunk_words: int) -> DataFrame:
    """Per document: the places settled inside its task, and its likely repeated windows that are not.

    ``docs`` has doc_id (long, no nulls), text_key and text.
    """
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        maker, filled = Windows(window), shared.value
        for chunk in chunks(batches, chunk_words):
            number, place, anchors, h1, h2 = maker.of(list(chunk["text"]), True)
            likely = used_twice(anchors, filled)
            number, place, h1, h2 = (x[likely] for x in (number, place, h1, h2))
            ids = chunk["doc_id"].to_numpy(np.int64)[number]
            order = np.lexsort((place, ids, h2, h1))
            number, place, h1, h2, ids = (x[order] for x in (number, place, h1, h2, ids))
            head = np.ones(len(h1), bool)
            head[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
            smallest = ids[head][np.cumsum(head) - 1] if len(ids) else ids
            settled = ids > smallest
            back = np.argsort(number, kind="stable")
            number, place, h1, h2, settled = (x[back] for x in (number, place, h1, h2, settled))
            cuts = np.searchsorted(number, np.arange(len(chunk) + 1))
            spans = [slice(a, b) for a, b in zip(cuts[:-1], cuts[1:])]
            yield pd.DataFrame({
                "doc_id": chunk["doc_id"], "text_key": chunk["text_key"],
                "settled": [place[s][settled[s]].astype(np.int32) for s in spans],
                "place": [place[s][~settled[s]].astype(np.int32) for s in spans],
                "h1": [h1[s][~settled[s]].view(np.int64) for s in spans],
                "h2": [(h2[s][~settled[s]] & np.uint64(0x7FFFFFFF)).astype(np.int32) for s in spans],
            })

    return docs.mapInPandas(find, "doc_id long, text_key long, settled array<int>, place array<int>, h1 array<long>, h2 array<int>")


def repeated_places(docs: DataFrame, window: int = 50, max_cells: int = 1 << 28, cells_per_anchor: int = 8, chunk_words: int = 500_000) -> DataFrame:
    """(doc_id, text_key, places): where the windows start that also start in a document with a smaller id."""
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text").where(
        "doc_id is not null and text is not null")
    size = keyed.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    anchors = max(1, size // 6 * 2 // (window - window // 2 + 1))
    cells = sketch_cells(anchors, cells_per_anchor, max_cells)
    found = stored(likely_repeats(keyed, sketch(keyed, window, cells, chunk_words), window, chunk_words).where(
        "size(settled) > 0 or size(place) > 0"), "windows")
    each = found.select("doc_id", "text_key", F.explode(F.arrays_zip("place", "h1", "h2")).alias("w")).select("doc_id", "text_key", "w.*")
    # A window comes here once per task and smallest document, so no key is heavy.
    same = Window.partitionBy("h1", "h2")
    across = each.withColumn("smallest", F.min("doc_id").over(same)).where("doc_id > smallest").select("doc_id", "text_key", F.array("place").alias("places"))
    settled = found.where("size(settled) > 0").select("doc_id", "text_key", F.col("settled").alias("places"))
    gathered = across.groupBy("doc_id", "text_key").agg(F.flatten(F.collect_list("places")).alias("places")).unionByName(settled)
    return gathered.groupBy("doc_id", "text_key").agg(F.flatten(F.collect_list("places")).alias("places"))


def remove_repeats(docs: DataFrame, window: int = 50, **options) -> DataFrame:
    """(doc_id, n_words, n_removed, text): the kept words joined by single blanks."""
    places = repeated_places(docs, window, **options).withColumnRenamed("doc_id", "id").withColumnRenamed("text_key", "key")
    plain = docs.select("doc_id", "text")
    joined = plain.join(places, (F.col("doc_id").cast("long") == F.col("id")) & (F.xxhash64("text") == F.col("key")), "left")

    @F.pandas_udf("n_words long, n_removed long, text string")
    def keep(texts: pd.Series, places_: pd.Series) -> pd.DataFrame:
        out = []
        for text, at in zip(texts, places_):
            words = (text or "").encode("utf-8", "replace").split()
            if at is not None and len(at):
                change = np.zeros(len(words) + 1, np.int32)
                np.add.at(change, np.asarray(at, np.int64), 1)
                np.subtract.at(change, np.asarray(at, np.int64) + window, 1)
                kept = [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0)]
            else:
                kept = words
            out.append((len(words), len(words) - len(kept), b" ".join(kept).decode("utf-8", "replace")))
        return pd.DataFrame(out, columns=["n_words", "n_removed", "text"])

    return joined.select("doc_id", keep("text", "places").alias("k")).select("doc_id", "k.*")


def op8_substrings(spark, sf_dir: str) -> DataFrame:
    """Remove words in windows of 50 that also start in a document with a smaller id."""
    return remove_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
