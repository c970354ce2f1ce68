"""Benchmark decontamination with suffix arrays over the training text.

Each task turns its documents, a shard of a bounded number of words at a time, into one sequence of word numbers and sorts
the suffixes of that sequence (prefix doubling). Every suffix of every benchmark item is searched in each shard by bisection;
its neighbours there give the longest verbatim match and its places. Nothing is shuffled.

Only words that occur in the benchmark get a number, all others end a run. A suffix can start a match only if the run it
starts is as long as the shortest window, so the array holds just those suffixes; no match is lost.

The benchmark goes to the tasks in blocks of at most ``block_words`` words. Each block is one pass over the documents; the
hits of several passes are put together per document. So the memory of a task is bounded, whatever the benchmark's size.

Words: after lower-casing A-Z, runs of digits, letters a to z and signs beyond ASCII. A window is ``window`` consecutive words
of an item; an item with fewer words, but not none, is one window. Null and empty texts have no words and no hits; items
without words or without id take no part; items with equal ids count once. Repeated documents are judged one by one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterstone.llm.common import drop_stored, received, sent, stored, table

#: Maps bytes to lower case, and all bytes of no word to a blank.
TO_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(TO_WORDS).split()


class TestBlock:
    """Items as sequences of word numbers (from 1), and all their suffixes."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int) -> None:
        self.numbers: dict[bytes, int] = {}
        self.names = [name for name, _ in items]
        self.window = window
        coded = [[self.numbers.setdefault(w, len(self.numbers) + 1) for w in words] for _, words in items]
        self.longest = max(map(len, coded))
        self.least = min(window, min(map(len, coded)))
        # One row per suffix that starts a window: item, place in the item, words of the window, and the words to the item's end.
        rows = [(i, k, min(window, len(c)), c[k:]) for i, c in enumerate(coded) for k in range(max(1, len(c) - window + 1))]
        self.item = np.array([r[0] for r in rows])
        self.place = np.array([r[1] for r in rows])
        self.size = np.array([r[2] for r in rows])
        self.rest = np.array([len(r[3]) for r in rows])
        self.words = np.zeros((len(rows), self.longest + 1), dtype=np.int32)
        for n, r in enumerate(rows):
            self.words[n, :len(r[3])] = r[3]


def suffix_array(sequence: np.ndarray, starts: np.ndarray, depth: int) -> np.ndarray:
    """``starts`` in the order of the suffixes there, compared by ``depth`` words at least. 0 ends a suffix."""
    rank = sequence.astype(np.int64)
    reach = 1
    while reach < depth and len(starts):
        ahead = np.zeros_like(rank)
        ahead[:-reach] = rank[reach:] if reach < len(rank) else 0
        ahead[sequence == 0] = 0
        both = rank * (rank.max() + 1) + ahead
        rank = np.unique(both, return_inverse=True)[1].astype(np.int64)
        reach *= 2
    return starts[np.argsort(rank[starts], kind="stable")]


def bisect(sequence: np.ndarray, suffixes: np.ndarray, block: TestBlock, width: np.ndarray, after: bool) -> np.ndarray:
    """First place whose suffix is not below (``after``: is above) each test suffix, compared by ``width`` words."""
    low, high = np.zeros(len(width), np.int64), np.full(len(width), len(suffixes), np.int64)
    while (low < high).any():
        middle = np.minimum((low + high) // 2, len(suffixes) - 1)
        at, going, below = suffixes[middle], np.ones(len(width), bool), np.zeros(len(width), bool)
        for k in range(int(width.max())):
            mine, theirs = sequence[np.minimum(at + k, len(sequence) - 1)], block.words[:, k]
            going &= k < width
            below |= going & (mine < theirs)
            going &= mine == theirs
            if not going.any():
                break
        # ``going`` marks what is equal in all compared words, once the words beyond the width are left out.
        equal = going_equal(sequence, at, block, width) if after else None
        right = (below | equal) if after else below
        open_ = low < high
        low = np.where(open_ & right, middle + 1, low)
        high = np.where(open_ & ~right, middle, high)
    return low


def going_equal(sequence: np.ndarray, at: np.ndarray, block: TestBlock, width: np.ndarray) -> np.ndarray:
    same = np.ones(len(width), bool)
    for k in range(int(width.max())):
        same &= (k >= width) | (sequence[np.minimum(at + k, len(sequence) - 1)] == block.words[:, k])
    return same


def shared_words(sequence: np.ndarray, at: np.ndarray, test: np.ndarray, block: TestBlock) -> np.ndarray:
    """How many words the suffixes at ``at`` share with the test suffixes numbered ``test``."""
    same, n = np.ones(len(at), bool), np.zeros(len(at), np.int64)
    for k in range(block.longest):
        same &= (sequence[np.minimum(at + k, len(sequence) - 1)] == block.words[test, k]) & (k < block.rest[test])
        if not same.any():
            break
        n += same
    return n


def search_shard(texts: list[list[bytes]], block: TestBlock) -> list[tuple[int, int, int, int, int, int]]:
    """Matches (text, place in the text, window's words, item, place in the item, longest match) of a shard."""
    get = block.numbers.get
    coded = [np.fromiter((get(w, 0) for w in words), np.int32, len(words)) for words in texts]
    lengths = np.array([len(c) + 1 for c in coded])
    begins = np.concatenate([[0], np.cumsum(lengths)])
    sequence = np.zeros(int(begins[-1]) + 1, np.int32)
    for c, b in zip(coded, begins):
        sequence[b:b + len(c)] = c
    ends = np.flatnonzero(sequence == 0)
    filled = np.flatnonzero(sequence)
    run_left = ends[np.searchsorted(ends, filled)] - filled
    starts = filled[run_left >= block.least]
    if not len(starts):
        return []
    # Only the runs that are long enough are kept together, with one 0 between them.
    keep = np.zeros(len(sequence), bool)
    longest_run = np.zeros(len(sequence), np.int64)
    longest_run[filled] = run_left
    first = filled[(sequence[filled - 1] == 0) | (filled == 0)]
    for b in first[longest_run[first] >= block.least]:
        keep[b:b + longest_run[b] + 1] = True
    where = np.flatnonzero(keep)
    short = np.concatenate([sequence[where], [0]]).astype(np.int32)
    can_start = np.flatnonzero((short[:-1] != 0) & (longest_run[where] >= block.least))
    suffixes = suffix_array(short, can_start, block.longest)
    low = bisect(short, suffixes, block, block.size, after=False)
    high = bisect(short, suffixes, block, block.size, after=True)
    test = np.repeat(np.arange(len(low)), np.maximum(0, high - low))
    if not len(test):
        return []
    inside = np.arange(len(test)) - np.repeat(np.cumsum(np.maximum(0, high - low)) - np.maximum(0, high - low), np.maximum(0, high - low))
    at = suffixes[low[test] + inside]
    longest = shared_words(short, at, test, block)
    place = where[at]
    text = np.searchsorted(begins, place, "right") - 1
    return list(zip(text.tolist(), (place - begins[text]).tolist(), block.size[test].tolist(), block.item[test].tolist(),
                    block.place[test].tolist(), longest.tolist()))


def test_blocks(benchmark: DataFrame, window: int, block_words: int) -> Iterator[TestBlock]:
    """The items, one block after the other through the driver."""
    items, size = [], 0
    for row in benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("string").alias("name"), "text").toLocalIterator():
        words = words_of(row["text"])
        if not words:
            continue
        if items and size + len(words) > block_words:
            yield TestBlock(items, window)
            items, size = [], 0
        items.append((row["name"], words))
        size += len(words)
    if items:
        yield TestBlock(items, window)


MATCHES = "matches array<struct<start:int,words:int,item_id:string,item_start:int,longest:int>>"


def find_matches(docs: DataFrame, block: TestBlock | None, shard_words: int = 1_000_000) -> DataFrame:
    """(doc_id, text_key, n_words, matches) per document for one block of items."""
    key = docs.schema["doc_id"].dataType.simpleString()
    shared = sent(docs.sparkSession, block)

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        b = received(shared)

        def done(ids: list, keys: list, texts: list[list[bytes]]) -> pd.DataFrame:
            found: list[list[dict]] = [[] for _ in texts]
            for text, start, words, item, item_start, longest in (search_shard(texts, b) if b else []):
                found[text].append({"start": start, "words": words, "item_id": b.names[item], "item_start": item_start, "longest": longest})
            return pd.DataFrame({"doc_id": pd.Series(ids, dtype=kind), "text_key": pd.Series(keys, dtype="int64"), "n_words": pd.Series(map(len, texts), dtype="int64"),
                                 "matches": pd.Series(found, dtype=object)})

        ids, keys, texts, size, kind = [], [], [], 0, None
        for batch in batches:
            kind = batch["doc_id"].dtype if kind is None or kind == batch["doc_id"].dtype else object
            for doc_id, text_key, text in zip(batch["doc_id"].array, batch["text_key"], batch["text"]):
                words = words_of(text)
                ids.append(doc_id)
                keys.append(text_key)
                texts.append(words)
                size += len(words) + 1
                if size > shard_words:
                    yield done(ids, keys, texts)
                    ids, keys, texts, size = [], [], [], 0
        if ids:
            yield done(ids, keys, texts)

    keyed = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_key"), "text")
    return keyed.mapInPandas(search, f"doc_id {key}, text_key long, n_words long, {MATCHES}")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 13, block_words: int = 2_000_000) -> DataFrame:
    """Per document: doc_id, text_key (hash of the text), n_words, and all matches (place, words, item, place in the item, longest)."""
    blocks = test_blocks(benchmark, window, block_words)
    block, following = next(blocks, None), next(blocks, None)
    found = find_matches(docs, block)
    if following is None:
        return found
    # One block is on the driver at a time; what it gave is written before the next one comes.
    found = stored(found, "matches")
    while following is not None:
        more = find_matches(docs, following).groupBy("doc_id", "text_key").agg(F.first("matches").alias("more"))
        same = found["doc_id"].eqNullSafe(more["doc_id"]) & (found["text_key"] == more["text_key"])
        both = stored(found.join(more, same, "left").select(
            found["doc_id"], found["text_key"], found["n_words"],
            F.concat("matches", F.coalesce("more", F.array().cast(MATCHES.split(" ", 1)[1]))).alias("matches")), "matches")
        drop_stored(found)
        found, following = both, next(blocks, None)
    return found


def with_hits(found: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Add n_hit (words inside any match), n_items, items_sha256 and contaminated to the result of ``decontaminate``."""

    @F.pandas_udf("n_hit long, n_items long, items_sha256 string")
    def count(matches: pd.Series) -> pd.DataFrame:
        out = []
        for found_here in matches:
            found_here = found_here if found_here is not None else []
            last = hit = 0
            for start, end in sorted((m["start"], m["start"] + m["words"]) for m in found_here):
                hit += max(0, end - max(start, last))
                last = max(last, end)
            names = sorted({m["item_id"] for m in found_here})
            out.append((hit, len(names), hashlib.sha256(",".join(names).encode()).hexdigest()))
        return pd.DataFrame(out, columns=["n_hit", "n_items", "items_sha256"])

    counted = found.withColumn("c", count("matches"))
    hit = F.col("c.n_hit")
    return counted.select(*keys, "n_words", "c.*", ((hit > 0) & (20 * hit >= F.col("n_words"))).alias("contaminated"),
                          F.aggregate("matches", F.lit(0), lambda best, m: F.greatest(best, m["longest"])).alias("longest_match"))


def op6_decontamination(spark, sf_dir: str) -> DataFrame:
    """Judge every document against the whole benchmark."""
    return with_hits(decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))
