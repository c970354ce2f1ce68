"""Cross-tokenizer alignment by anchors at white space.

Every text is fully tokenised by both vocabularies: a byte-level one (A, ranks of its tokens) and a merge-type piece model (B).
Byte offsets where tokens of both end cut the tokens into groups; all tokens of A and of B in one group are linked.

Anchors: an offset where both have a token end, checked on the bytes, and both go on with a token that starts with a blank. They
split a document into windows, a word or so each. A window's groups depend on nothing but its ids of A and B, so in each chunk of
texts equal windows, by both tuples of ids, are aligned once and the result serves all of them; a text without blanks is one window.

Counts over the corpus: the texts of a task are taken in chunks of a bounded number of signs. A chunk passes on, for each pair of ids,
in how many of its documents it is linked, and for each document the numbers of its windows. The counts are summed by pair, and
joined back to the pairs of each chunk only, so no table of all pairs is ever sent to every task. A window's sums follow from
its pairs, a document's from its windows. One pair in all chunks is one row a chunk. Tables between are written below the shared folder.

Texts that are null or empty, or whose tokens of A or of B do not give back a blank and the text (B does so where the text holds its
own blank sign), have no tokens: zeros and an empty ``groups_sha256``. Repeated rows and rows without an id each count as a
document. Other columns are not read, so their names cannot clash. An empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterstone.llm.common import stored, table
from meterstone.llm.hashing import mixed
from meterstone.llm.packing import default_vocabulary
from meterstone.llm.piece_codec import CONTROL, UNKNOWN, PieceCodec, default_model, slices

#: Signs of text in a chunk; a longer text is a chunk of its own.
CHUNK = 4 << 20


class Tokens:
    """What the ids of a vocabulary stand for: bytes, their number, and whether they start with a blank."""

    def __init__(self, parts: list[bytes]) -> None:
        self.parts = parts
        self.lengths = np.array([len(p) for p in parts], np.int64)
        self.blank = np.array([p[:1] == b" " for p in parts])
        self.known: dict[str, np.ndarray] = {}

    def joined(self, ids: list[int]) -> bytes:
        return b"".join(map(self.parts.__getitem__, ids))

    def shown(self, sign: str) -> np.ndarray:
        """Every id as text after a sign."""
        if sign not in self.known:
            self.known[sign] = np.array([sign + str(i) for i in range(len(self.parts))], object)
        return self.known[sign]


def rank_tokens(vocabulary: str) -> tuple[Tokens, dict[bytes, int]]:
    """Tokens of a rank file, and the ranks."""
    with open(vocabulary, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    parts = {i: part for part, i in ranks.items()}
    return Tokens([parts.get(i, b"") for i in range(max(parts) + 1)]), ranks


def window_starts(a: np.ndarray, b: np.ndarray, a_ends: np.ndarray, b_ends: np.ndarray, a_tokens: Tokens, b_tokens: Tokens, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First tokens of A and of B of every window, and the texts' first windows.

    Texts lie one after the other and end at the offsets ``bounds``; windows start with them, and at the anchors between.
    """
    a_cuts, b_cuts = a_ends[:-1][a_tokens.blank[a[1:]]], b_ends[:-1][b_tokens.blank[b[1:]]]
    texts = np.concatenate([[0], bounds[:-1]])
    cuts = distinct(np.concatenate([np.intersect1d(a_cuts, b_cuts, assume_unique=True), texts]))
    return np.searchsorted(a_ends, cuts, "right"), np.searchsorted(b_ends, cuts, "right"), np.searchsorted(cuts, texts)


def equal_windows(a: np.ndarray, b: np.ndarray, a_first: np.ndarray, b_first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first of each kind of equal windows, and the kind of every window.

    Windows are equal if both their id tuples are. Hashes find them, and the ids themselves are compared after that; should two
    different windows ever share a hash, another hash is taken.
    """
    a_sizes, b_sizes = np.diff(a_first, append=len(a)), np.diff(b_first, append=len(b))
    for seed in range(1, 1000):
        hashes = np.zeros(len(a_first), np.uint64)
        for ids, first, sizes, odd in ((a, a_first, a_sizes, 0x9E3779B97F4A7C15), (b, b_first, b_sizes, 0xD1342543DE82EF95)):
            places = np.arange(len(ids)) - np.repeat(first, sizes)
            hashes += np.add.reduceat(mixed((ids.astype(np.uint64) + np.uint64(seed << 32)) * np.uint64(odd) + mixed(places.astype(np.uint64) + np.uint64(odd))), first)
        _, kinds, kind = np.unique(hashes, return_index=True, return_inverse=True)
        same = kinds[kind]
        if all((sizes == sizes[same]).all() and (ids == ids[spread(first[same], sizes)]).all() for ids, first, sizes in ((a, a_first, a_sizes), (b, b_first, b_sizes))):
            return kinds, kind
    raise AssertionError("no hash tells the windows apart")


class Windows:
    """The different windows of a chunk, aligned in one go: their groups as text, their linked pairs of ids and how often each."""

    def __init__(self, a: np.ndarray, b: np.ndarray, a_window: np.ndarray, b_window: np.ndarray, a_tokens: Tokens, b_tokens: Tokens) -> None:
        """The ids of the windows one after the other, and the window each belongs to; both sides have equal bytes in each."""
        n = int(a_window[-1]) + 1 if len(a) else 0
        a_ends, b_ends = np.cumsum(a_tokens.lengths[a]), np.cumsum(b_tokens.lengths[b])
        shared = np.intersect1d(a_ends, b_ends, assume_unique=True)
        a_group, b_group = np.searchsorted(shared, a_ends), np.searchsorted(shared, b_ends)
        n_a, n_b = np.bincount(a_group, minlength=len(shared)), np.bincount(b_group, minlength=len(shared))
        group_window = a_window[np.cumsum(n_a) - 1]
        self.n_groups = np.bincount(group_window, minlength=n)
        self.n_links = np.bincount(group_window, n_a * n_b, n).astype(np.int64)
        # Each group's ids with how often they are in it, so a long group of equal ids stays small.
        (ga, ia, ma), (gb, ib, mb) = counted(a_group, a), counted(b_group, b)
        b_first, b_many = np.searchsorted(gb, np.arange(len(shared))), np.bincount(gb, minlength=len(shared))
        left, right = np.repeat(np.arange(len(ga)), b_many[ga]), spread(b_first[ga], b_many[ga])
        pair, self.ids = pd.factorize(ia[left] << 32 | ib[right])
        # Pairs of window w: places starts[w] to starts[w + 1]. A pair in several of its groups counts for each.
        window, self.pairs, first, order = runs_of(group_window[ga[left]], pair)
        self.times = np.add.reduceat((ma[left] * mb[right])[order], first) if len(first) else np.zeros(0, np.int64)
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(window, minlength=n))])
        self.docs = np.zeros(len(self.ids), np.int64)
        # Tokens in the order of the groups, A before B, each after a sign that tells what it follows.
        order = np.argsort(np.concatenate([2 * a_group, 2 * b_group + 1]), kind="stable")
        texts = np.concatenate([np.where(np.diff(a_group, prepend=-1) > 0, a_tokens.shown(";")[a], a_tokens.shown(",")[a]),
                                np.where(np.diff(b_group, prepend=-1) > 0, b_tokens.shown("|")[b], b_tokens.shown(",")[b])])[order].tolist()
        stops = np.cumsum(np.bincount(a_window, minlength=n) + np.bincount(b_window, minlength=n)).tolist()
        self.texts = ["".join(texts[i:j])[1:] for i, j in zip([0, *stops], stops)]

    def count(self, windows: np.ndarray) -> None:
        """The pairs of a document's windows are linked in one more document."""
        different = distinct(windows)
        self.docs[distinct(self.pairs[spread(self.starts[different], self.starts[different + 1] - self.starts[different])])] += 1

    def packed(self) -> bytes:
        """Pairs of each window and how often, for the second pass."""
        parts = [np.array([len(self.ids), len(self.starts) - 1], "<u4"), self.ids.astype("<i8"), *(x.astype("<u4") for x in (np.diff(self.starts), self.pairs, self.times))]
        return zstandard.ZstdCompressor(level=1).compress(b"".join(x.tobytes() for x in parts))


def distinct(x: np.ndarray) -> np.ndarray:
    """Different numbers in order; sorting is faster than hashing on short arrays."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def runs_of(groups: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Different (group, id) in order, where each begins in that order, and the order. ``groups`` come in order."""
    # Nearly sorted already, which a stable sort makes use of.
    order = np.argsort(groups << 32 | ids, kind="stable")
    groups, ids = groups[order], ids[order]
    first = np.flatnonzero(np.concatenate([[True], (groups[1:] != groups[:-1]) | (ids[1:] != ids[:-1])])) if len(ids) else np.zeros(0, np.int64)
    return groups[first], ids[first], first, order


def counted(groups: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different (group, id) in order, and how often each occurs."""
    found, which, first, _ = runs_of(groups, ids)
    return found, which, np.diff(first, append=len(ids))


def spread(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """``first``, ``first`` + 1, ... of each run, ``sizes`` numbers each."""
    return np.repeat(first - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())


class Aligner:
    """Both tokenisers, and the alignment of a chunk of texts."""

    def __init__(self, vocabulary: str, model: str) -> None:
        import public_tokenizers
        import tiktoken

        codec = PieceCodec(model)
        self.a_tokens, ranks = rank_tokens(vocabulary)
        self.b_tokens = Tokens([b"" if k in (CONTROL, UNKNOWN) else p for p, k in zip(codec.parts, codec.kinds)])
        # Strings of added tokens are plain text here.
        self.encode_a = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.encode_b = codec.library.encode

    def chunk(self, texts: list[str], each: bool = False) -> tuple[list[tuple], Windows]:
        """(n_a, n_b, n_groups, n_links, groups_sha256, windows) of each text, and the windows of all.

        Byte-level tokens are pieces of the text's own bytes, so as many bytes as the text has are its bytes. The bytes of B are checked
        against those of A in each kind of window; should one differ, the texts are gone through again and checked ``each``.
        """
        a_ids, b_ids, bounds, valid = [], [], [], []
        for i, (text, b) in enumerate(zip(texts, self.encode_b(texts, num_threads=1))):
            raw = (" " + text).encode("utf-8", "replace")
            x, y = np.array(self.encode_a(" " + text), np.int64), np.array(b, np.int64)
            fits = text and self.a_tokens.lengths[x].sum() == self.b_tokens.lengths[y].sum() == len(raw)
            if fits and (not each or self.a_tokens.joined(x.tolist()) == self.b_tokens.joined(b) == raw):
                a_ids.append(x)
                b_ids.append(y)
                bounds.append(len(raw))
                valid.append(i)
        nothing = packed_numbers(np.zeros(0, np.int64))
        rows = [(0, 0, 0, 0, "", nothing)] * len(texts)
        empty = np.zeros(0, np.int64)
        if not valid:
            return rows, Windows(empty, empty, empty, empty, self.a_tokens, self.b_tokens)
        a, b = np.concatenate(a_ids), np.concatenate(b_ids)
        a_ends, b_ends = np.cumsum(self.a_tokens.lengths[a]), np.cumsum(self.b_tokens.lengths[b])
        a_first, b_first, texts_first = window_starts(a, b, a_ends, b_ends, self.a_tokens, self.b_tokens, np.cumsum(bounds))
        del a_ends, b_ends
        kinds, kind = equal_windows(a, b, a_first, b_first)
        a_many, b_many = np.diff(a_first, append=len(a))[kinds], np.diff(b_first, append=len(b))[kinds]
        numbers = np.arange(len(kinds))
        a, b = a[spread(a_first[kinds], a_many)], b[spread(b_first[kinds], b_many)]
        if not each and self.a_tokens.joined(a.tolist()) != self.b_tokens.joined(b.tolist()):
            return self.chunk(texts, each=True)
        found = Windows(a, b, np.repeat(numbers, a_many), np.repeat(numbers, b_many), self.a_tokens, self.b_tokens)
        for i, x, y, mine in zip(valid, a_ids, b_ids, np.split(kind, texts_first[1:])):
            found.count(mine)
            sha = hashlib.sha256(";".join(map(found.texts.__getitem__, mine.tolist())).encode()).hexdigest()
            rows[i] = (len(x), len(y), int(found.n_groups[mine].sum()), int(found.n_links[mine].sum()), sha, packed_numbers(mine))
        return rows, found


def packed_numbers(numbers: np.ndarray) -> bytes:
    """Numbers in any order, sorted and compressed by their differences."""
    return zstandard.ZstdCompressor(level=1).compress(np.diff(np.sort(numbers), prepend=0).astype("<u4").tobytes())


def unpacked_numbers(raw: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), "<u4").astype(np.int64))


def aligned_chunks(docs: DataFrame, vocabulary: str, model: str, chunk_signs: int) -> DataFrame:
    """Rows of three kinds: documents with the numbers of their windows, pairs of a chunk with ``docs``, tables of a chunk's windows."""
    key_type = docs.schema["doc_id"].dataType.simpleString()
    schema = (f"chunk long, doc_id {key_type}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, windows binary, "
              "pair long, docs long, pairs_of binary")

    names = ["chunk", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "windows", "pair", "docs", "pairs_of"]
    kinds = [pa.int64(), None, *[pa.int64()] * 4, pa.string(), pa.binary(), pa.int64(), pa.int64(), pa.binary()]

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, chunk = Aligner(vocabulary, model), TaskContext.get().partitionId() << 32
        for batch in batches:
            key = batch.schema.field(0).type

            def rows(n: int, **given) -> pa.RecordBatch:
                held = {"chunk": pa.array(np.full(n, chunk), pa.int64())} | given
                return pa.RecordBatch.from_arrays([held[c] if c in held else pa.nulls(n, key if c == "doc_id" else k) for c, k in zip(names, kinds)], names=names)

            texts = [t or "" for t in batch.column(1).to_pylist()]
            for start, stop in slices(texts, chunk_signs):
                out, windows = aligner.chunk(texts[start:stop])
                yield rows(len(out), doc_id=batch.column(0).slice(start, stop - start), **{c: pa.array(x, k) for c, k, x in zip(names[2:8], kinds[2:8], zip(*out))})
                yield rows(len(windows.ids), pair=pa.array(windows.ids), docs=pa.array(windows.docs))
                yield rows(1, pairs_of=pa.array([windows.packed()], pa.binary()))
                chunk += 1

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(align, schema)


def align(docs: DataFrame, vocabulary: str | None = None, model: str | None = None, chunk_signs: int = CHUNK) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    found = stored(aligned_chunks(docs, vocabulary or default_vocabulary(), model or default_model(), chunk_signs), "aligned")
    linked = found.where("pair is not null").select("chunk", "pair", "docs")
    counts = linked.groupBy("pair").agg(F.sum("docs").alias("n"))
    best = counts.groupBy(F.shiftright("pair", 32).alias("a")).agg(F.max("n").alias("highest"))
    told = counts.join(best, F.shiftright("pair", 32) == F.col("a")).select("pair", "n", (F.col("n") == F.col("highest")).alias("is_best"))
    told = linked.select("chunk", "pair").join(told, "pair").select(F.col("chunk").alias("of_chunk"), "pair", "n", "is_best")
    columns = ["n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    rows = found.where("pair is null").select("chunk", "doc_id", *columns, "windows", "pairs_of")
    key_type = docs.schema["doc_id"].dataType.simpleString()

    def add_up(mine: pd.DataFrame, counted: pd.DataFrame) -> pd.DataFrame:
        tables = mine["pairs_of"].dropna()
        texts = mine[mine["pairs_of"].isna()]
        by_window = np.zeros((2, 1), np.int64)
        if len(tables):
            raw = zstandard.ZstdDecompressor().decompress(tables.iloc[0])
            n_pairs, n_windows = np.frombuffer(raw, "<u4", 2)
            pairs = np.frombuffer(raw, np.int64, n_pairs, 8)
            rest = np.frombuffer(raw, "<u4", offset=8 + 8 * int(n_pairs)).astype(np.int64)
            sizes = rest[:n_windows]
            local, times = rest[n_windows:].reshape(2, -1)
            order = np.argsort(counted["pair"].to_numpy())
            place = order[np.searchsorted(counted["pair"].to_numpy(), pairs, sorter=order)]
            n, is_best = counted["n"].to_numpy()[place], counted["is_best"].to_numpy()[place]
            if n_windows:
                starts = np.cumsum(sizes) - sizes
                by_window = np.stack([np.add.reduceat(times * x[local], starts) for x in (is_best.astype(np.int64), n)])
        sums = [by_window[:, unpacked_numbers(w)].sum(axis=1) for w in texts["windows"]]
        return texts[["doc_id", *columns]].assign(n_best=[s[0] for s in sums], count_sum=[s[1] for s in sums])

    kinds = f"doc_id {key_type}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long"
    return rows.groupBy("chunk").cogroup(told.groupBy("of_chunk")).applyInPandas(add_up, kinds).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op13_alignment(spark, sf_dir: str) -> DataFrame:
    """Align both tokenisations of every document."""
    return align(table(spark, sf_dir, "documents"))
