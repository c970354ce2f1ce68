"""Line dedup with MinHash: of all lines that are alike, directly or through others, the first one stays.

1. Every line of ``min_chars`` signs or more (stripped, lower-cased; the query and the pipeline take all lines that are not
   blank) is a set of character shingles; a line shorter than a shingle is its one shingle. Its signature of 64
   minima is banded (16 bands of four): of pairs with similarity 0.8 more than 99.9 percent share a band. Lines with many
   shingles take the minima of 64 ranges of one hash instead of 64 hashes; around the size where that begins lines
   have both signatures, so no pair falls between the two. Lines of 24 to 119 signs also have a signature of shorter shingles,
   in 46 bands of eight: 99.9 percent as well, and few of the many lines with some short shingles in common.
   Lines that occur again in the same task are settled there.
2. Lines that stand in several tasks are made one. A count-min sketch of all bands tells which stand in two lines or more;
   these few are counted exactly. Only lines with such a band go on.
3. Lines of a band are compared with one line of it, by the exact Jaccard similarity of their shingles (of either length), and the links give
   components. Bands that still hold several components are compared in full, in parts of bounded size, each line only
   with lines it is not yet joined to. Bitmaps of the shingles, and then their hashes, first rule out the pairs that cannot be alike.
4. The first line (by id, then place) of each component stays; the others are taken out of their texts.

Lines under ``min_chars`` and blank lines stay. Null texts stay null. Rows without an id keep all lines and no other line goes because of them.
Identical rows are one document: both keep the same lines. A table without lines to compare comes back as it is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterstone.llm.common import drop_stored, stored, table
from meterstone.llm.components import components, open_groups
from meterstone.llm.hashing import BASES, USED, Rolling, bitmap, chunks, merged_sketch, mixed, sketch_cells, used_cells, used_twice

BANDS, ROWS = 16, 4
#: From ``SPLIT`` different shingles on, ranges of one hash; up to ``WHOLE``, 64 hashes. Sets between have both: sizes
#: of similar sets differ by a quarter at most.
SPLIT, WHOLE = 200, 280
PERCENT = 80
#: One changed sign touches 9 of a line's shingles of 9, too many in lines under 89 signs. Lines of ``SHORT_FROM`` to
#: ``SHORT_TO`` signs (exclusive) are also compared by shingles of ``SHORT_K``, beyond that border so that no pair falls between.
SHORT_K, SHORT_FROM, SHORT_TO = 3, 24, 120
#: Lines of one language share many short shingles: with bands of four, nearly all short lines share a band with unlike ones, and the pairs grow
#: with the square of the lines. Longer bands, and more of them, are as likely to be shared at a similarity of 0.8, and a two-hundredth as likely at 0.2.
SHORT_BANDS, SHORT_ROWS = 46, 8
#: Signs whose lines are signed at once, few enough to stay in a core's cache.
PART_SIGNS = 80_000


def plain(line: str) -> str:
    return line.strip().lower()


def shingle_set(line: str, k: int) -> set[str]:
    text = plain(line)
    return {text[i:i + k] for i in range(max(1, len(text) - k + 1))}


def alike(a: set[str], b: set[str]) -> bool:
    both = len(a & b)
    return 100 * both >= PERCENT * (len(a) + len(b) - both)


def is_short(line: str) -> bool:
    return SHORT_FROM <= len(line) < SHORT_TO


def shingle_sets(line: str, k: int) -> tuple[set[str], set[str] | None]:
    """The shingles of a line, and its short ones if it is compared by them too."""
    return shingle_set(line, k), shingle_set(line, SHORT_K) if is_short(plain(line)) else None


def either_alike(a: tuple[set[str], set[str] | None], b: tuple[set[str], set[str] | None]) -> bool:
    """Whether two lines are alike by their shingles, or by the short ones where both have them."""
    return any(x is not None and y is not None and 100 * min(len(x), len(y)) >= PERCENT * max(len(x), len(y)) and alike(x, y) for x, y in zip(a, b))


class Signer:
    """Band keys of lines. Keys of other ``kind`` never meet; a signer uses ``kind`` and the next one.

    All lines of a call are signed at once, in arrays.
    """

    def __init__(self, k: int, kind: int = 0, bands: int = BANDS, rows: int = ROWS) -> None:
        self.k, self.kind, self.bands, self.rows, self.rolling = k, kind, bands, rows, Rolling(BASES[0])
        rng = np.random.default_rng(11)
        self.turn = rng.integers(0, 1 << 32, bands * rows, dtype=np.uint32)
        self.odd = rng.integers(0, 1 << 31, bands * rows, dtype=np.uint32) * np.uint32(2) + np.uint32(1)

    def keys(self, lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of lines, in order, and a band key of each."""
        points = np.frombuffer("".join(lines).encode("utf-32-le", "replace"), "<u4")
        sizes = np.array([len(x) for x in lines], np.int64)
        ends = np.cumsum(sizes)
        begins = ends - sizes
        sums = self.rolling.sums(mixed(points.astype(np.uint64) + np.uint64(1)))
        runs = (self.rolling.runs(sums, self.k) >> np.uint64(32)).astype(np.uint32)
        counts = np.maximum(1, sizes - self.k + 1)
        starts = np.cumsum(counts) - counts
        owner = np.repeat(np.arange(len(lines)), counts)
        at = np.arange(len(owner)) + (begins - starts)[owner]
        x = runs[np.minimum(at, len(runs) - 1)] if len(runs) else np.zeros(len(at), np.uint32)
        tiny = np.flatnonzero(sizes < self.k)  # the whole line is its one shingle
        x[starts[tiny]] = (mixed((sums[ends[tiny]] - sums[begins[tiny]]) * self.rolling.up[begins[tiny]]) >> np.uint64(32)).astype(np.uint32)
        long = counts >= SPLIT
        mine = long[owner]
        sets = np.sort(owner[mine].astype(np.uint64) << np.uint64(32) | x[mine])
        sets = sets[np.concatenate([[True], sets[1:] != sets[:-1]])] if len(sets) else sets
        different = np.where(long, np.bincount((sets >> np.uint64(32)).astype(np.int64), minlength=len(lines)), counts)
        few, many = np.flatnonzero(different <= WHOLE), np.flatnonzero(long & (different >= SPLIT))
        found = [(few, self.banded(self.minima(x, starts, counts, few), self.bands, self.kind)),
                 (many, self.banded(self.lowest(sets, many, len(lines)), BANDS, self.kind + 1))]
        line = np.concatenate([np.repeat(who, keys.shape[1]) for who, keys in found])
        order = np.argsort(line, kind="stable")
        return line[order], np.concatenate([keys.ravel() for _, keys in found])[order]

    def minima(self, x: np.ndarray, starts: np.ndarray, counts: np.ndarray, some: np.ndarray) -> np.ndarray:
        """Of each of ``some`` lines the minima of its shingles by each hash."""
        out = np.empty((len(self.turn), len(some)), np.uint32)
        if len(some):
            first = np.cumsum(counts[some]) - counts[some]
            mine = x[np.repeat(starts[some] - first, counts[some]) + np.arange(counts[some].sum())]
            turned = np.empty_like(mine)
            for r, (turn, odd) in enumerate(zip(self.turn, self.odd)):
                np.bitwise_xor(mine, turn, out=turned)
                np.multiply(turned, odd, out=turned)
                np.minimum.reduceat(turned, first, out=out[r])
        return out.T

    @staticmethod
    def lowest(sets: np.ndarray, some: np.ndarray, lines: int) -> np.ndarray:
        """Of each of ``some`` lines the minima of ``BANDS * ROWS`` ranges, from sorted numbers of lines and their shingles."""
        row = np.full(lines, -1)
        row[some] = np.arange(len(some))
        cell = (sets >> np.uint64(26)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])) if len(cell) else cell
        first = first[row[cell[first] >> 6] >= 0]
        out = np.full((len(some), BANDS * ROWS), 0xFFFFFFFF, np.uint32)
        out[row[cell[first] >> 6], cell[first] & 63] = (sets[first] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        return out

    @staticmethod
    def banded(minima: np.ndarray, bands: int, kind: int) -> np.ndarray:
        rows = minima.astype(np.uint64).reshape(len(minima), bands, -1) if len(minima) else np.zeros((0, bands, 1), np.uint64)
        key = np.zeros(rows.shape[:2], np.uint64)
        for r in range(rows.shape[2]):
            key = mixed(key + rows[:, :, r] * np.uint64(BASES[1]) + np.uint64(r + 1))
        return mixed(key + np.arange(bands, dtype=np.uint64) * np.uint64(BASES[0]) + np.uint64(kind)).view(np.int64)


def signed(lines: list[str], signer: Signer, short_signer: Signer) -> list[bytes]:
    """The bands of each line, those of its short shingles included."""
    short = np.array([i for i, x in enumerate(lines) if is_short(x)], np.int64)
    found = [(np.arange(len(lines)), lines, signer), (short, [lines[i] for i in short.tolist()], short_signer)]
    who, keys = [], []
    for numbers, some, by in found:
        signs = np.cumsum([0] + [len(x) for x in some])
        parts = np.flatnonzero(np.diff(signs[1:] // PART_SIGNS)) + 1 if some else ()
        for start, end in zip([0, *parts], [*parts, len(some)]) if some else ():
            line, key = by.keys(some[start:end])
            who.append(numbers[start:end][line])
            keys.append(key)
    line = np.concatenate(who)
    raw = np.concatenate(keys)[np.argsort(line, kind="stable")].tobytes()
    ends = (8 * np.cumsum(np.bincount(line, minlength=len(lines)))).tolist()
    return [raw[a:b] for a, b in zip([0, *ends], ends)]


def line_keys(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The two halves of the 128-bit hash of each line."""
    import xxhash

    both = np.frombuffer(b"".join([xxhash.xxh3_128_digest(x.encode("utf-8", "replace")) for x in lines]), ">u8").reshape(-1, 2).astype(np.uint64)
    return both[:, 0].copy().view(np.int64), both[:, 1].copy().view(np.int64)


def signed_lines(docs: DataFrame, k: int, min_chars: int, chunk_words: int) -> DataFrame:
    """Per different line of a chunk: its key (h1, h2), first place and bands; and the later places in that chunk.

    ``docs`` has doc_id (long, no nulls), text_key and text.
    """

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        signer, short_signer = Signer(k), Signer(SHORT_K, 2, SHORT_BANDS, SHORT_ROWS)
        for chunk in chunks(batches, chunk_words):
            firsts: dict[str, tuple] = {}
            again: dict[str, set] = {}
            for doc_id, key, text in zip(chunk["doc_id"].tolist(), chunk["text_key"].tolist(), chunk["text"]):
                for n, line in enumerate(text.split("\n")):
                    line = plain(line)
                    if len(line) < min_chars:
                        continue
                    place = (doc_id, key, n)
                    held = firsts.setdefault(line, place)
                    if held != place:
                        firsts[line] = min(held, place)
                        again.setdefault(line, set()).add(max(held, place))
            lines = list(firsts)
            for start in range(0, len(lines), 1000):
                part = lines[start:start + 1000]
                h1, h2 = line_keys(part)
                places = [firsts[x] for x in part]
                yield pd.DataFrame({
                    "h1": h1, "h2": h2,
                    "doc_id": [p[0] for p in places], "text_key": [p[1] for p in places], "line": [p[2] for p in places],
                    "again": [[{"doc_id": p[0], "text_key": p[1], "line": p[2]} for p in again.get(x, ())] for x in part],
                    "bands": signed(part, signer, short_signer)})

    place = "doc_id long, text_key long, line int"
    return docs.mapInPandas(sign, f"h1 long, h2 long, {place}, again array<struct<{place.replace(' ', ':').replace(',:', ',')}>>, bands binary")


def repeated_bits(lines: DataFrame, max_cells: int) -> Broadcast:
    """A broadcast sketch of ``h1``: it lets the lines through that stand in two rows or more, and very few others."""
    cells = sketch_cells(max(1, lines.count()), 16, max_cells)

    def use(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield used_cells(batch["h1"].to_numpy(np.int64).view(np.uint64), cells)

    return lines.sparkSession.sparkContext.broadcast(merged_sketch(lines.select("h1").mapInPandas(use, USED), cells))


def shared_bands(lines: DataFrame, repeated: Broadcast, max_cells: int) -> DataFrame:
    """(id, band): the bands that stand in two different lines or more. The sketch leaves few others, which are then counted.

    Lines that may stand in several rows (``repeated``) are made one row first, so that copies alone share no band.
    """

    def rows_of(batches: Iterator[pd.DataFrame], copied: bool | None) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if copied is not None:
                batch = batch[used_twice(batch["h1"].to_numpy(np.int64).view(np.uint64), repeated.value) == copied]
            if len(batch):
                yield batch

    slim = lines.select("h1", "h2", "bands")
    several = stored(slim.mapInPandas(lambda batches: rows_of(batches, True), slim.schema).groupBy("h1", "h2").agg(F.first("bands").alias("bands")), "repeated")
    # Of all rows those that stand alone, and the rows of ``several``.
    sources = ((slim, False), (several, None))
    bands = lines.agg(F.sum(F.length("bands"))).first()[0] or 0
    cells = sketch_cells(max(1, bands // 8), 4, max_cells)

    def use(copied: bool | None):
        def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in rows_of(batches, copied):
                yield used_cells(np.frombuffer(b"".join(batch["bands"]), np.uint64), cells)

        return sketch

    first, second = (rows.mapInPandas(use(copied), USED) for rows, copied in sources)
    bits = lines.sparkSession.sparkContext.broadcast(merged_sketch(first.unionByName(second), cells))

    def keep(copied: bool | None):
        def likely(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in rows_of(batches, copied):
                every = np.frombuffer(b"".join(batch["bands"]), np.int64)
                owner = np.repeat(np.arange(len(batch)), [len(b) // 8 for b in batch["bands"]])
                twice = used_twice(every.view(np.uint64), bits.value)
                owner = owner[twice]
                yield pd.DataFrame({"h1": batch["h1"].to_numpy()[owner], "h2": batch["h2"].to_numpy()[owner], "band": every[twice]}).drop_duplicates()

        return likely

    first, second = (rows.mapInPandas(keep(copied), "h1 long, h2 long, band long") for rows, copied in sources)
    found = stored(first.unionByName(second), "bands")
    drop_stored(several)
    shared = found.groupBy("band").agg(F.count("*").alias("rows")).where("rows > 1").select("band")
    members = stored(found.join(shared, "band").select(F.struct("h1", "h2").alias("id"), "band"), "members")
    drop_stored(found)
    return members


def lines_of(lines: DataFrame, compared: Broadcast, repeated: Broadcast) -> DataFrame:
    """Rows (id, place) of the lines that are compared or stand in several rows, and of very few others."""

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            hashes = batch["h1"].to_numpy(np.int64).view(np.uint64)
            yield batch[used_twice(hashes, compared.value) | used_twice(hashes, repeated.value)]

    slim = lines.select("h1", "h2", "doc_id", "text_key", "line")
    return slim.mapInPandas(keep, slim.schema).select(F.struct("h1", "h2").alias("id"), F.struct("doc_id", "text_key", "line").alias("place"))


def texts_of(docs: DataFrame, compared: Broadcast, min_chars: int) -> DataFrame:
    """(id, text) of the lines that are compared, and of very few others, once each. They are read again rather than stored with all lines."""

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), 1000):
                different = dict.fromkeys(plain(x) for text in batch["text"].iloc[start:start + 1000] for x in text.split("\n"))
                some = [x for x in different if len(x) >= min_chars]
                if some:
                    h1, h2 = line_keys(some)
                    wanted = used_twice(h1.view(np.uint64), compared.value)
                    yield pd.DataFrame({"h1": h1[wanted], "h2": h2[wanted], "text": np.array(some, object)[wanted]})

    found = docs.select("text").mapInPandas(find, "h1 long, h2 long, text string")
    return found.groupBy(F.struct("h1", "h2").alias("id")).agg(F.first("text").alias("text"))


class Bounds:
    """Per line the number of its shingles, a bitmap of them, and their hashes; two of these bound how many shingles two lines share."""

    #: Places of the table in which the shingles of one line are marked, to count those of others.
    MARKS = 1 << 18

    def __init__(self, k: int) -> None:
        self.kinds = (k, SHORT_K)
        self.rolling = Rolling(BASES[0])

    def of(self, lines: list[str]) -> list[tuple[np.ndarray, ...]]:
        """For shingles and short shingles: sizes, bitmaps, how many shingles share a bit, and the places of all shingles with
        where those of each line end. No size: not compared by these."""
        points = np.frombuffer("".join(lines).encode("utf-32-le", "replace"), "<u4")
        sizes = np.array([len(x) for x in lines], np.int64)
        begins = np.cumsum(sizes) - sizes
        sums = self.rolling.sums(mixed(points.astype(np.uint64) + np.uint64(1)))
        taking_part = np.ones(len(lines), bool), (sizes >= SHORT_FROM) & (sizes < SHORT_TO)
        return [self.kind(sums, begins, sizes, k, takes) for k, takes in zip(self.kinds, taking_part)]

    def kind(self, sums: np.ndarray, begins: np.ndarray, sizes: np.ndarray, k: int, takes: np.ndarray) -> tuple[np.ndarray, ...]:
        counts = np.where(takes, np.maximum(0, sizes - k + 1), 0)
        owner = np.repeat(np.arange(len(sizes)), counts).astype(np.uint64)
        at = np.repeat(begins - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
        runs = self.rolling.runs(sums, k)
        keys = np.sort(owner << np.uint64(40) | runs[at] >> np.uint64(24)) if len(at) else owner
        keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])] if len(at) else keys
        owner = (keys >> np.uint64(40)).astype(np.int64)
        n = np.bincount(owner, minlength=len(sizes))
        bits = np.zeros(len(sizes) * 256, bool)
        bits[owner * 256 + (keys & np.uint64(255)).astype(np.int64)] = True
        bits[np.flatnonzero(takes & (n == 0)) * 256] = True  # shorter than a shingle: one shingle
        places, ends = (keys & np.uint64(self.MARKS - 1)).astype(np.int32), np.cumsum(n)
        n = np.where(takes, np.maximum(1, n), 0)
        words = np.packbits(bits.reshape(-1, 256), axis=1, bitorder="little").view(np.uint64)
        return n, words, n - np.bitwise_count(words).sum(axis=1, dtype=np.int64), places, ends

    @classmethod
    def may_be_alike(cls, left: list, right: list, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether lines ``i`` of ``left`` and ``j`` of ``right`` can be alike: true for all that are.

        Bitmaps first; they are full where lines are long, so what they leave is counted by the places of all shingles.
        """
        out = np.zeros(len(i), bool)
        for (n, words, loose, places, ends), (m, others, slack, theirs, stops) in zip(left, right):
            x, y = n[i], m[j]
            fits = np.flatnonzero(~out & (x > 0) & (y > 0) & (100 * np.minimum(x, y) >= PERCENT * np.maximum(x, y) - 100))
            most = np.bitwise_count(words[i[fits]] & others[j[fits]]).sum(axis=1, dtype=np.int64) + np.minimum(loose[i[fits]], slack[j[fits]])
            # One more, as two shingles of a line may have the same 40 bits.
            fits = fits[(100 + PERCENT) * (most + 1) >= PERCENT * (x[fits] + y[fits])]
            fits = fits[np.argsort(i[fits], kind="stable")]
            most = cls.common(places, ends, theirs, stops, i[fits], j[fits])
            out[fits] = (100 + PERCENT) * (most + 1) >= PERCENT * (x[fits] + y[fits])
        return out

    @classmethod
    def common(cls, places: np.ndarray, ends: np.ndarray, theirs: np.ndarray, stops: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """At most so many shingles that lines ``i``, in order, and ``j`` share."""
        out, table = np.zeros(len(i), np.int64), np.zeros(cls.MARKS, bool)
        begin = lambda at, n: at[n - 1] if n else 0
        groups = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]])).tolist() if len(i) else []
        others, after = j.tolist(), stops.tolist()
        for start, end in zip(groups, [*groups[1:], len(i)]):
            a = int(i[start])
            mine = places[begin(ends, a):ends[a]]
            parts = [theirs[begin(after, b):after[b]] for b in others[start:end]]
            sizes = np.array([len(p) for p in parts])
            if not len(mine) or not sizes.all():  # a line shorter than a shingle
                out[start:end] = np.maximum(1, np.minimum(len(mine), sizes))
                continue
            table[mine] = True
            out[start:end] = np.add.reduceat(table[np.concatenate(parts)], np.cumsum(sizes) - sizes, dtype=np.int64)
            table[mine] = False
        return out


def alike_pairs(pairs: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """The pairs (a, b) of line keys that are similar enough."""

    @F.pandas_udf("boolean")
    def test(left: pd.Series, right: pd.Series) -> pd.Series:
        bounds, out = Bounds(k), np.zeros(len(left), bool)
        signs = np.cumsum(left.str.len().to_numpy(np.int64) + right.str.len().to_numpy(np.int64))
        for rows in np.split(np.arange(len(left)), np.flatnonzero(np.diff(signs // PART_SIGNS)) + 1):
            a, b = left.iloc[rows].tolist(), right.iloc[rows].tolist()
            likely = bounds.may_be_alike(bounds.of(a), bounds.of(b), np.arange(len(rows)), np.arange(len(rows)))
            for n in np.flatnonzero(likely).tolist():
                out[rows[n]] = either_alike(shingle_sets(a[n], k), shingle_sets(b[n], k))
        return pd.Series(out)

    both = pairs.join(texts.toDF("a", "ta"), "a").join(texts.toDF("b", "tb"), "b")
    return both.where(test("ta", "tb")).select("a", "b")


def cell_pairs(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of all pairs inside cells of these sizes, which follow one another."""
    ends = np.repeat(np.cumsum(sizes), sizes)
    rows = np.arange(len(ends))
    later = ends - rows - 1
    i = np.repeat(rows, later)
    return i, i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(later) - later, later)


def compare_bands(rows: DataFrame, k: int, part_rows: int, most_pairs: int = 500_000, most_signs: int = 2_000_000, deal: str = "cell") -> DataFrame:
    """Links (a, b) between the components of each band, from rows (band, id, comp, text, rows of the band).

    ``deal`` is an expression of the cell and the columns of ``rows``: cells of one value go to the same task.
    A task bounds the similarity of all pairs of some cells at once, in arrays, and checks exactly what is left and not yet joined.
    """
    parts = F.ceil(F.col("rows") / part_rows).cast("int")
    grid = rows.withColumn("part", F.pmod(F.xxhash64("id"), parts).cast("int")).select(
        "*", F.explode(F.sequence(F.lit(0), parts - 1)).alias("with")).withColumn(
        "cell", F.xxhash64("band", F.least("part", "with"), F.greatest("part", "with"))).select(
        F.expr(deal).alias("deal"), "cell", (F.col("part") != F.col("with")).alias("across"), "id.h1", "id.h2", F.xxhash64("comp").alias("comp"), "part", "text")
    # Rows of a cell off the diagonal all have ``across``, as their own part meets another one there.

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bounds, group = Bounds(k), {}

        def top(c: int) -> int:
            while group.setdefault(c, c) != c:
                group[c] = group[group[c]]
                c = group[c]
            return c

        def links(cells: pd.DataFrame, sizes: np.ndarray) -> Iterator[tuple[int, int]]:
            known: dict[str, int] = {}
            numbers = np.array([known.setdefault(x, len(known)) for x in cells["text"].tolist()], np.int64)
            texts = list(known)
            held, comp, part = bounds.of(texts), cells["comp"].to_numpy(np.int64), cells["part"].to_numpy(np.int64)
            across, sets = cells["across"].to_numpy(bool), {}

            def of(n: int) -> tuple[set[str], set[str] | None]:
                if n not in sets:
                    sets[n] = shingle_sets(texts[n], k)
                return sets[n]

            i, j = cell_pairs(sizes)
            open_ = (comp[i] != comp[j]) & ~(across[i] & (part[i] == part[j]))
            i, j = i[open_], j[open_]
            likely = bounds.may_be_alike(held, held, numbers[i], numbers[j])
            for x, y in zip(i[likely].tolist(), j[likely].tolist()):
                a, b = top(int(comp[x])), top(int(comp[y]))
                if a != b and either_alike(of(int(numbers[x])), of(int(numbers[y]))):
                    group[a] = b
                    yield x, y

        def found(frame: pd.DataFrame) -> Iterator[pd.DataFrame]:
            marks = frame["cell"].to_numpy()
            starts = np.concatenate([[0], np.flatnonzero(marks[1:] != marks[:-1]) + 1, [len(marks)]]).astype(np.int64)
            sizes = np.diff(starts)
            signs = np.add.reduceat(frame["text"].str.len().to_numpy(np.int64), starts[:-1])
            turn = np.cumsum(sizes * (sizes - 1) // 2 + sizes) // most_pairs + np.cumsum(signs) // most_signs
            for cells in np.split(np.arange(len(sizes)), np.flatnonzero(turn[1:] != turn[:-1]) + 1):
                some = frame.iloc[starts[cells[0]]:starts[cells[-1] + 1]]
                x, y = np.array(list(links(some, sizes[cells])), np.int64).reshape(-1, 2).T
                h1, h2 = some["h1"].to_numpy(), some["h2"].to_numpy()
                yield pd.DataFrame({"a1": h1[x], "a2": h2[x], "b1": h1[y], "b2": h2[y]})

        held: list[pd.DataFrame] = []  # rows of the last cell so far
        for batch in batches:
            if not len(batch):
                continue
            rows_ = pd.concat([*held, batch], ignore_index=True)
            last = rows_["cell"].to_numpy() == rows_["cell"].iloc[-1]
            if not last.all():
                yield from found(rows_[~last])
            held = [rows_[last]]
        if held:
            yield from found(held[0])

    links_ = grid.repartition("deal").drop("deal").sortWithinPartitions("cell").mapInPandas(compare, "a1 long, a2 long, b1 long, b2 long").distinct()
    return links_.select(F.struct(F.col("a1").alias("h1"), F.col("a2").alias("h2")).alias("a"), F.struct(F.col("b1").alias("h1"), F.col("b2").alias("h2")).alias("b"))


def repeated_lines(docs: DataFrame, k: int = 9, min_chars: int = 24, part_rows: int = 800, max_cells: int = 1 << 28, chunk_words: int = 400_000) -> DataFrame:
    """(doc_id, text_key, line): the places of all lines that go."""
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text").where(
        "doc_id is not null and text is not null")
    lines = stored(signed_lines(keyed, k, min_chars, chunk_words), "lines")
    settled = stored(lines.where("size(again) > 0").select(F.explode("again").alias("p")).select("p.*"), "settled")
    repeated = repeated_bits(lines, max_cells)
    members = shared_bands(lines, repeated, max_cells)
    compared = bitmap(stored(members.select("id.h1").distinct(), "near"), max_cells)
    kept = stored(lines_of(lines, compared, repeated), "shared")
    drop_stored(lines)
    texts = stored(texts_of(keyed, compared, min_chars), "texts")
    pivots = members.groupBy("band").agg(F.min("id").alias("pivot"), F.count("*").alias("rows")).where("rows > 1")
    # Of the lines it could be compared with first, each takes the one it shares most bands with.
    tries = members.join(pivots, "band").where("id != pivot").groupBy("id", "pivot").agg(F.count("*").alias("shared"))
    best = tries.groupBy("id").agg(F.max(F.struct("shared", "pivot")).alias("t")).select(F.col("id").alias("a"), F.col("t.pivot").alias("b"))
    links = stored(alike_pairs(best, texts, k), "links")
    labels = components(links)
    marked = stored(members.join(labels.withColumnRenamed("root", "comp"), "id", "left").withColumn("comp", F.coalesce("comp", "id")), "marked")
    drop_stored(members)
    open_ = open_groups(marked, "band", part_rows, 20_000)
    left = marked.join(open_, "band").join(texts, "id").select("band", "id", "comp", "text", "rows", "low", "tasks")
    # A line stands in many bands with much the same lines: in one task its text is read once, and its rows compress to little more than one.
    more = stored(compare_bands(left, k, part_rows, deal="xxhash64(low, pmod(cell, tasks))"), "links")
    drop_stored(marked)
    drop_stored(texts)
    labels = components(links.unionByName(more))
    rooted = kept.select("id", "place").join(labels, "id", "left").withColumn("root", F.coalesce("root", "id"))
    first = rooted.groupBy("root").agg(F.min("place").alias("stays"), F.count("*").alias("n")).where("n > 1")
    later = rooted.join(first, "root").where("place != stays").select("place.*")
    return later.unionByName(settled)


def remove_lines(docs: DataFrame, counts: str = "line_counts", **options) -> DataFrame:
    """The rows and columns of ``docs`` with the remaining text, plus a column ``counts`` (n_lines, n_removed)."""
    places = stored(repeated_lines(docs.select("doc_id", "text"), **options).groupBy(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key")).agg(
        F.collect_set("line").alias("__gone")), "places")
    named = bitmap(places.select(F.col("__key").alias("h1")).distinct())

    @F.pandas_udf("boolean")
    def loses(keys: pd.Series) -> pd.Series:
        return pd.Series(used_twice(keys.to_numpy(np.int64).view(np.uint64), named.value))

    # Texts without a line that goes stay where they are; very few others are joined and find nothing.
    key = F.xxhash64(F.coalesce("text", F.lit("")))
    whole = docs.where(~loses(key)).withColumn("__gone", F.lit(None).cast("array<int>"))
    joined = docs.where(loses(key)).join(places, (F.col("doc_id").cast("long") == F.col("__id")) & (F.xxhash64("text") == F.col("__key")), "left").select(
        *docs.columns, "__gone").unionByName(whole.select(*docs.columns, "__gone"))

    @F.pandas_udf("text string, n_lines long, n_removed long")
    def keep(texts: pd.Series, gone: pd.Series) -> pd.DataFrame:
        out = []
        for text, places_ in zip(texts, gone):
            rows = text.split("\n") if text is not None else []
            drop = set() if places_ is None else set(places_)
            out.append(("\n".join(r for i, r in enumerate(rows) if i not in drop) if drop else text, len(rows), len(drop)))
        return pd.DataFrame(out, columns=["text", "n_lines", "n_removed"])

    done = joined.withColumn("__kept", keep("text", "__gone"))
    return done.select(*[F.col("__kept.text").alias("text") if c == "text" else F.col(c) for c in docs.columns],
                       F.struct("__kept.n_lines", "__kept.n_removed").alias(counts))


def op5_lines(spark, sf_dir: str) -> DataFrame:
    """Per document: its lines, how many went, and the hash of what is left."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_lines(docs, min_chars=1).select("doc_id", "line_counts.n_lines", "line_counts.n_removed",
                                     F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))
