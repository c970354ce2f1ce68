"""Jaccard join on word n-grams with signature trees: every pair with similarity 0.8 or more is linked.

1. A text is the set of its shingles (hashes of five words). Equal sets are linked to their smallest id by a group-by.
2. Which documents can have a partner at all. Shingles have one order: first the rare ones (by a table of document counts of
   hash buckets), then by hash. Two linked sets share a shingle among the first fifth of each, and a twentieth of their
   shingles among the first quarter. A count-min sketch of those shingles over all documents tells which stand in two
   documents or more; documents with too few of these are done. Only the others keep their sets.
3. Blocks: the kept sets that share one of their first shingles. In families of near copies nearly all members link to one
   member, so some rounds first compare each set with one member of its most shared blocks and join the components.
4. Blocks that still hold several components are joined exactly: the sets of a block are the rows of a signature tree. Each
   node holds the OR of its rows' bitmaps, their range of sizes, and their component if it is one. Two trees (or a tree and
   itself) are walked from the top; a pair of nodes goes on only if the sizes fit and the most overlap that its bitmaps
   allow reaches the least that 0.8 needs. Large blocks are cut into a grid of parts, so no task holds more than two parts.
5. Of the pairs of rows that get through, a task gives only a spanning forest of the components they would join, the
   likeliest first. They are checked on the whole sets, and links give components (``components.components``). Where all pairs
   of a tree are joined, the pairs left out lie inside one component. Components of other trees are walked again in full.

No link between different texts is lost; pairs inside one component are not listed again.

Words: runs of anything but white space, A-Z lower-cased. A text with fewer than five words is one shingle; without words, or
null, the set is empty and has no link. Rows without an id have their set's size and no component. Rows with equal ids are one
document. Extra columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterstone.llm.common import drop_stored, stored, table
from meterstone.llm.components import components, open_groups
from meterstone.llm.hashing import BASES, USED, Rolling, WordHashes, bitmap, chunks, merged_sketch, mixed, sketch_cells, used_cells, used_twice

#: Buckets of the table of document counts, and how many of them make a row of the shuffle.
COUNT_BUCKETS, COUNT_BLOCK = 1 << 17, 1 << 12
LEAF, FAN = 16, 8


class Shingles:
    """Distinct shingles of a chunk of texts."""

    def __init__(self, n: int) -> None:
        self.n, self.words, self.rolling = n, WordHashes(), Rolling(BASES[0])

    def of(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(text number, shingle), each pair once, by number and shingle."""
        hashes, sizes = self.words.of(texts, lower=True)
        ends = np.cumsum(sizes)
        sums = self.rolling.sums(hashes)
        counts = np.maximum(0, sizes - self.n + 1)
        number = np.repeat(np.arange(len(sizes)), counts)
        begins = np.repeat(ends - sizes, counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        runs = self.rolling.runs(sums, self.n)
        shingle = runs[begins] if len(begins) else np.zeros(0, np.uint64)
        short = np.flatnonzero((sizes > 0) & (sizes < self.n))
        whole = [mixed((sums[ends[i]:ends[i] + 1] - sums[ends[i] - sizes[i]]) * self.rolling.up[ends[i] - sizes[i]] + np.uint64(int(sizes[i]))) for i in short]
        if whole:
            number, shingle = np.concatenate([number, short]), np.concatenate([shingle, *whole])
            order = np.argsort(number, kind="stable")
            number, shingle = number[order], shingle[order]
        cuts = np.searchsorted(number, np.arange(len(texts) + 1)).tolist()
        for a, b in zip(cuts[:-1], cuts[1:]):
            shingle[a:b].sort()
        fresh = np.ones(len(number), bool)
        fresh[1:] = (number[1:] != number[:-1]) | (shingle[1:] != shingle[:-1])
        return number[fresh], shingle[fresh]


def bucket_of(shingle: np.ndarray) -> np.ndarray:
    return (mixed(shingle * np.uint64(BASES[1])) & np.uint64(COUNT_BUCKETS - 1)).astype(np.int64)


def rare_first(number: np.ndarray, shingle: np.ndarray, levels: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows in order (number, level of rarity, shingle), and the place of each inside its document."""
    level, ends, order = levels[bucket_of(shingle)], np.cumsum(sizes), np.arange(len(shingle))
    for i in np.unique(number[level > 0]):  # all others are in order already
        own = slice(ends[i] - sizes[i], ends[i])
        order[own] = own.start + np.argsort(level[own], kind="stable")
    return order, np.arange(len(order)) - np.repeat(ends - sizes, sizes)


def first_fifth(n: np.ndarray) -> np.ndarray:
    """So many shingles of a set of ``n`` cannot all be missing from a set linked to it."""
    return n - -(-4 * n // 5) + 1


def measure(docs: DataFrame, n: int, chunk_words: int) -> DataFrame:
    """Per row with an id: doc_id, size and two hashes of its set. Row -1 of each chunk: nothing but document counts."""

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        maker = Shingles(n)
        for chunk in chunks(batches, chunk_words):
            number, shingle = maker.of(list(chunk["text"]))
            sizes = np.bincount(number, minlength=len(chunk))
            sums = np.concatenate([[np.uint64(0)], np.cumsum(shingle, dtype=np.uint64)])
            others = np.concatenate([[np.uint64(0)], np.cumsum(mixed(shingle + np.uint64(1)), dtype=np.uint64)])
            ends = np.cumsum(sizes)
            counts = np.minimum(np.bincount(bucket_of(shingle), minlength=COUNT_BUCKETS), 65535).astype("<u2")  # of one chunk
            yield pd.DataFrame({
                "doc_id": chunk["doc_id"], "n": sizes, "h1": (sums[ends] - sums[ends - sizes]).view(np.int64),
                "h2": (others[ends] - others[ends - sizes]).view(np.int64), "block": -1, "counts": None})
            blocks = range(0, COUNT_BUCKETS, COUNT_BLOCK)
            yield pd.DataFrame({"doc_id": None, "n": 0, "h1": 0, "h2": 0, "block": [b // COUNT_BLOCK for b in blocks],
                                "counts": [counts[b:b + COUNT_BLOCK].tobytes() for b in blocks]}).astype({"doc_id": "Int64"})

    return docs.mapInPandas(sets, "doc_id long, n long, h1 long, h2 long, block int, counts binary")


def rarity_levels(measured: DataFrame) -> np.ndarray:
    """Level of each bucket: 0 for those up to twice the mean, then one more for each doubling."""

    def add(parts: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.frombuffer(c, "<u2") for c in parts["counts"]], axis=0, dtype=np.int64)
        return pd.DataFrame({"block": parts["block"].iloc[:1], "counts": [total.astype("<i8").tobytes()]})

    counts = np.zeros(COUNT_BUCKETS)
    for r in measured.where("block >= 0").select("block", "counts").groupBy("block").applyInPandas(add, "block int, counts binary").collect():
        counts[r["block"] * COUNT_BLOCK:(r["block"] + 1) * COUNT_BLOCK] = np.frombuffer(r["counts"], "<i8")
    return np.log2(np.maximum(1, counts / max(1e-9, 2 * counts.mean()))).astype(np.int8)


def signature(number: np.ndarray, shingle: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """A bitmap per document, of the power of two that is at least two bits a shingle."""
    out, end = [], 0
    mixed_all = mixed(shingle + np.uint64(7))
    for size in sizes:
        width = max(64, 1 << int(2 * max(1, size) - 1).bit_length())
        bits = np.zeros(width, bool)
        bits[(mixed_all[end:end + size] & np.uint64(width - 1)).astype(np.int64)] = True
        out.append(np.packbits(bits, bitorder="little").tobytes())
        end += size
    return out


def candidates(docs: DataFrame, n: int, levels: np.ndarray, max_cells: int, chunk_words: int, n_shingles: int) -> DataFrame:
    """Documents that may have a partner: id, n, firsts (first shingles that stand elsewhere too), bits and the set."""
    spark = docs.sparkSession
    ranks = spark.sparkContext.broadcast(levels)

    def prefixes(batches):
        maker = Shingles(n)
        for chunk in chunks(batches, chunk_words):
            number, shingle = maker.of(list(chunk["text"]))
            sizes = np.bincount(number, minlength=len(chunk))
            order, place = rare_first(number, shingle, ranks.value, sizes)
            size = sizes[number]  # numbers stay grouped in ``order``
            quarter = first_fifth(size) + size // 20
            yield chunk, number, shingle, sizes, order, place, place < quarter

    def use(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, _, shingle, _, order, _, early in prefixes(batches):
            yield used_cells(shingle[order][early], cells)

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for chunk, number, shingle, sizes, order, place, early in prefixes(batches):
            ordered = shingle[order]
            shared = early.copy()
            shared[early] = used_twice(ordered[early], bits.value)
            enough = np.bincount(number, weights=shared, minlength=len(chunk)) >= np.maximum(1, 1 + sizes // 20)
            first = shared & (place < first_fifth(sizes[number]))
            ends = np.cumsum(sizes)
            seen, rows = set(), []
            for i in np.flatnonzero(enough & (sizes > 0)):
                own = slice(ends[i] - sizes[i], ends[i])
                same = (int(sizes[i]), shingle[own].tobytes())
                if same in seen:  # an equal set in this chunk has been kept
                    continue
                seen.add(same)
                rows.append((i, own))
            for start in range(0, len(rows), 500):
                part = rows[start:start + 500]
                yield pd.DataFrame({
                    "id": chunk["doc_id"].to_numpy(np.int64)[[i for i, _ in part]], "n": [int(sizes[i]) for i, _ in part],
                    "firsts": [ordered[own][first[own]].view(np.int64) for _, own in part],
                    "bits": signature(None, np.concatenate([shingle[own] for _, own in part]), np.array([sizes[i] for i, _ in part])) if part else [],
                    "shingles": [shingle[own].view(np.int64) for _, own in part]})

    cells = sketch_cells(max(1, n_shingles // 4), 4, max_cells)
    bits = spark.sparkContext.broadcast(merged_sketch(docs.mapInPandas(use, USED), cells))
    return docs.mapInPandas(keep, "id long, n int, firsts array<long>, bits binary, shingles array<long>").where("size(firsts) > 0")


def checked(pairs: DataFrame, kept: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough: 100 * intersection >= 80 * union."""
    named = bitmap(pairs.select(F.explode(F.array("a", "b")).alias("h1")).distinct())

    @F.pandas_udf("boolean")
    def wanted(ids: pd.Series) -> pd.Series:
        return pd.Series(used_twice(ids.to_numpy(np.int64).view(np.uint64), named.value))

    sets = kept.select("id", "n", "shingles").where(wanted("id"))
    left = sets.toDF("a", "na", "sa")
    right = sets.toDF("b", "nb", "sb")
    both = pairs.join(left, "a").join(right, "b")
    return both.where(9 * F.size(F.array_intersect("sa", "sb")) >= 4 * (F.col("na") + F.col("nb"))).select("a", "b")


class Tree:
    """Levels of nodes over rows: OR of bitmaps, sizes from and to, most collisions, and the component if it is one."""

    def __init__(self, words: np.ndarray, sizes: np.ndarray, groups: np.ndarray) -> None:
        slack = sizes - np.bitwise_count(words).sum(axis=1)
        self.levels = [(words, sizes, sizes, slack, groups)]
        step = LEAF
        while len(self.levels[-1][0]) > 1:
            bits, low, high, loose, group = self.levels[-1]
            at = np.arange(0, len(bits), step)
            one = np.minimum.reduceat(group, at) == np.maximum.reduceat(group, at)
            self.levels.append((np.bitwise_or.reduceat(bits, at, axis=0), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at),
                                np.maximum.reduceat(loose, at), np.where(one, group[at], -1)))
            step = FAN

    def children(self, level: int, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First child and number of children of nodes of a level above 0."""
        step = LEAF if level == 1 else FAN
        first = node * step
        return first, np.minimum(step, len(self.levels[level - 1][0]) - first)


def most_shared(a: tuple, b: tuple, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """A bound of the shingles that rows below the nodes ``i`` and ``j`` share."""
    return np.bitwise_count(a[0][i] & b[0][j]).sum(axis=1, dtype=np.int64) + np.minimum(a[3][i], b[3][j])


def promising(a: tuple, b: tuple, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether a pair of rows below the nodes ``i`` and ``j`` can be similar enough and join two components."""
    out = np.zeros(len(i), bool)
    for k in range(0, len(i), 4096):
        x, y = i[k:k + 4096], j[k:k + 4096]
        fits = (5 * a[2][x] >= 4 * b[1][y]) & (5 * b[2][y] >= 4 * a[1][x]) & ((a[4][x] != b[4][y]) | (a[4][x] < 0))
        x, y = x[fits], y[fits]
        fits[fits] = 9 * most_shared(a, b, x, y) >= 4 * (a[1][x] + b[1][y])
        out[k:k + 4096] = fits
    return out


def walk(a: Tree, b: Tree) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the pairs that get through; each pair once if both trees are the same."""
    level_a, level_b = len(a.levels) - 1, len(b.levels) - 1
    i = j = np.zeros(1, np.int64)
    while True:
        going = promising(a.levels[level_a], b.levels[level_b], i, j)
        i, j = i[going], j[going]
        if not len(i) or level_a == level_b == 0:
            break
        if level_a >= level_b:
            first, n = a.children(level_a, i)
            i, j, level_a = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum()), np.repeat(j, n), level_a - 1
        else:
            first, n = b.children(level_b, j)
            j, i, level_b = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum()), np.repeat(i, n), level_b - 1
        if a is b and level_a == level_b:
            i, j = i[i <= j], j[i <= j]
    if a is b:
        i, j = i[i < j], j[i < j]
    return i, j


def folded(words: np.ndarray) -> np.ndarray:
    half = words.shape[1] // 2
    return words[:, :half] | words[:, half:]


def join_block(block: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of rows of a block worth a check, and their scores. ``part`` tells the two sides of a grid cell off its diagonal."""
    sizes, groups, parts = (block[c].to_numpy(np.int64) for c in ("n", "comp", "part"))
    widths = np.array([len(b) for b in block["bits"]])
    sides = [np.ones(len(sizes), bool)] * 2 if len(np.unique(parts)) == 1 else [parts == p for p in np.unique(parts)]
    out: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int64),) * 3]
    forest: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
    for width in np.unique(widths):
        for side in (0, 1) if sides[0] is not sides[1] else (0,):
            rows = np.flatnonzero((widths == width) & sides[side])
            if len(rows):
                words = np.frombuffer(b"".join(block["bits"].iloc[rows]), np.uint64).reshape(len(rows), -1)
                order = np.lexsort(words.T[:4])
                forest[side, int(width)] = rows[order], words[order]

    def tree(rows: np.ndarray, words: np.ndarray) -> Tree:
        return Tree(words, sizes[rows], groups[rows])

    def meet(x: tuple, y: tuple, same: bool) -> None:
        one = tree(*x)
        two = one if same else tree(*y)
        i, j = walk(one, two)
        a, b = one.levels[0], two.levels[0]
        scores = [score(most_shared(a, b, i[k:k + 4096], j[k:k + 4096]), a[1][i[k:k + 4096]] + b[1][j[k:k + 4096]]) for k in range(0, len(i), 4096)]
        out.append((x[0][i], y[0][j], np.concatenate([out[0][2], *scores])))

    other = 0 if sides[0] is sides[1] else 1
    for (side, width), held in forest.items():
        if side == 0 and (other, width) in forest:
            meet(held, forest[other, width], other == 0)
        # Sets of the next width are at most twice as large and can still be similar: their bitmaps are folded.
        for mine, theirs in {(0, other), (other, 0)}:
            if side == mine and (theirs, width * 2) in forest:
                rows, words = forest[theirs, width * 2]
                meet(held, (rows, folded(words)), False)
    return tuple(np.concatenate(x) for x in zip(*out))


def score(most: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """How likely a pair is similar enough, from a bound of what it shares and the sum of its sizes."""
    return 10_000 * most // sizes


def join_small(frame: pd.DataFrame, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of rows worth a check, and their scores, of many blocks of one leaf each: the same tests as in a walk, for all of them at once."""
    ids, n, group, part = (frame[c].to_numpy(np.int64) for c in ("id", "n", "comp", "part"))
    rows = np.repeat(starts, sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    ends = np.repeat(starts + sizes, sizes)
    later = ends - rows - 1
    i = np.repeat(rows, later)
    j = i + 1 + np.arange(later.sum()) - np.repeat(np.cumsum(later) - later, later)
    mixed_block = np.repeat(np.repeat(np.maximum.reduceat(part, starts) != np.minimum.reduceat(part, starts), sizes), later) if len(starts) else np.zeros(0, bool)
    fits = (5 * n[i] >= 4 * n[j]) & (5 * n[j] >= 4 * n[i]) & (group[i] != group[j]) & ~(mixed_block & (part[i] == part[j]))
    i, j = i[fits], j[fits]
    i, j = np.where(ids[i] < ids[j], i, j), np.where(ids[i] < ids[j], j, i)
    _, once = np.unique(np.stack([ids[i], ids[j]], axis=1), axis=0, return_index=True)  # a pair shares many shingles
    i, j = i[once], j[once]
    bits = frame["bits"].to_numpy()
    widths = np.array([len(b) for b in bits])
    keep, scores = np.zeros(len(i), bool), np.zeros(len(i), np.int64)
    for width in np.unique(np.minimum(widths[i], widths[j])) if len(i) else ():
        mine = np.flatnonzero(np.minimum(widths[i], widths[j]) == width)
        used = np.unique(np.concatenate([i[mine], j[mine]]))
        words = np.stack([np.bitwise_or.reduce(np.frombuffer(bits[r], np.uint64).reshape(-1, width // 8), axis=0) for r in used])
        loose = n[used] - np.bitwise_count(words).sum(axis=1)
        x, y = np.searchsorted(used, i[mine]), np.searchsorted(used, j[mine])
        for k in range(0, len(mine), 4096):
            u, v = x[k:k + 4096], y[k:k + 4096]
            most = np.bitwise_count(words[u] & words[v]).sum(axis=1, dtype=np.int64) + np.minimum(loose[u], loose[v])
            both = n[used[u]] + n[used[v]]
            keep[mine[k:k + 4096]], scores[mine[k:k + 4096]] = 9 * most >= 4 * both, score(most, both)
    return i[keep], j[keep], scores[keep]


def spanning(pairs: pd.DataFrame) -> pd.DataFrame:
    """Of different pairs (a, b, ca, cb, score) a forest that joins all the components ``ca`` and ``cb``, highest scores first.

    ``tree`` names the tree of a pair where other pairs of its components are left out; null where none are.
    """
    tops: dict[int, int] = {}

    def top(c: int) -> int:
        while tops.setdefault(c, c) != c:
            tops[c] = tops[tops[c]]
            c = tops[c]
        return c

    pairs = pairs.sort_values(["score", "a", "b"], ascending=[False, True, True], ignore_index=True)
    taken = np.zeros(len(pairs), bool)
    best = np.flatnonzero(~pairs.duplicated(["ca", "cb"]).to_numpy())
    for at, x, y in zip(best.tolist(), pairs["ca"].to_numpy()[best].tolist(), pairs["cb"].to_numpy()[best].tolist()):
        x, y = top(x), top(y)
        if x != y:
            tops[x], taken[at] = y, True
    different, number = np.unique(pairs["ca"].to_numpy(), return_inverse=True)
    roots = np.array([top(c) for c in different.tolist()], np.int64)[number]
    run, short = uuid.uuid4().hex, np.isin(roots[taken], roots[~taken])
    return pairs[taken].assign(tree=np.array([f"{run}-{r}" if s else None for r, s in zip(roots[taken].tolist(), short.tolist())], object))


def join_blocks(blocks: DataFrame, part_rows: int, forest: bool = False) -> DataFrame:
    """Pairs worth a check (a, b, their components ca and cb, tree), from rows (shingle, id, n, comp, bits) and columns of ``open_groups``.

    With ``forest`` a task gives only those of ``spanning``.
    """
    parts = F.ceil(F.col("rows") / part_rows).cast("int")
    own = F.pmod(F.xxhash64("id"), parts).cast("int")
    grid = blocks.withColumn("part", own).select("*", F.explode(F.sequence(F.lit(0), parts - 1)).alias("with")).select(
        F.xxhash64("shingle", F.least("part", "with"), F.greatest("part", "with")).alias("cell"), "part", "id", "n", "comp", "bits", "low", "tasks")

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def done(frame: pd.DataFrame) -> Iterator[pd.DataFrame]:
            marks = frame["cell"].to_numpy()
            starts = np.concatenate([[0], np.flatnonzero(marks[1:] != marks[:-1]) + 1]).astype(np.int64)
            sizes = np.diff(np.append(starts, len(marks)))
            few = sizes <= LEAF
            found = [join_small(frame, starts[few], sizes[few])]
            for s, n in zip(starts[~few], sizes[~few]):
                i, j, scores = join_block(frame.iloc[s:s + n])
                found.append((i + s, j + s, scores))
            i, j, scores = (np.concatenate(x) for x in zip(*found))
            ids, comp = frame["id"].to_numpy(np.int64), frame["comp"].to_numpy(np.int64)
            pairs = pd.DataFrame({"a": np.minimum(ids[i], ids[j]), "b": np.maximum(ids[i], ids[j]), "ca": np.minimum(comp[i], comp[j]),
                                  "cb": np.maximum(comp[i], comp[j]), "score": scores, "tree": None}).drop_duplicates(["a", "b"])
            yield (spanning(pairs) if forest else pairs).drop(columns="score")

        for batch in batches:
            if not len(batch):
                continue
            last = batch["cell"].to_numpy() == batch["cell"].iloc[-1]
            closed = pd.concat([*held, batch[~last]]) if not last.all() else None
            if closed is not None:
                yield from done(closed)
                held = [batch[last]]
            elif held and held[-1]["cell"].iloc[-1] != batch["cell"].iloc[0]:
                yield from done(pd.concat(held))
                held = [batch]
            else:
                held.append(batch)
        if held:
            yield from done(pd.concat(held))

    # A set stands in many blocks of its family: in one task its rows follow one another and compress to little more than one.
    dealt = grid.withColumn("deal", F.xxhash64("low", F.pmod("cell", "tasks"))).drop("low", "tasks").repartition("deal").sortWithinPartitions("cell")
    return dealt.mapInPandas(join, "a long, b long, ca long, cb long, tree string")


def similar_sets(docs: DataFrame, n: int = 5, rounds: int = 2, part_rows: int = 1500, max_cells: int = 1 << 28, chunk_words: int = 400_000) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs`` (doc_id, text)."""
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    measured = stored(measure(keyed, n, chunk_words), "sets")
    sets = measured.where("block < 0").select("doc_id", "n", "h1", "h2")
    levels = rarity_levels(measured)
    full = sets.where("n > 0 and doc_id is not null")
    total = full.agg(F.sum("n")).first()[0] or 0
    equal = full.groupBy("n", "h1", "h2").agg(F.min("doc_id").alias("b"))
    same = full.join(equal, ["n", "h1", "h2"]).where("doc_id != b").select(F.col("doc_id").alias("a"), "b")
    kept = stored(candidates(keyed.where("doc_id is not null and text is not null"), n, levels, max_cells, chunk_words, total), "candidates")
    firsts = stored(kept.select(F.explode("firsts").alias("shingle"), "id", "n"), "firsts")
    links, labels = stored(same, "links"), None
    for turn in range(rounds):
        labels = components(links)
        marked = firsts.join(labels.withColumnRenamed("root", "comp"), "id", "left").withColumn("comp", F.coalesce("comp", "id"))
        if turn == rounds - 1:
            blocks = stored(marked.join(open_groups(marked, "shingle", part_rows, 20_000), "shingle"), "blocks")
            break
        open_ = marked.groupBy("shingle").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.min(
            F.struct(F.xxhash64("id", F.lit(turn)).alias("h"), F.col("id").alias("pivot"), F.col("n").alias("pn"), F.col("comp").alias("pc"))).alias("p")).where("low != high")
        blocks = stored(marked.join(open_.select("shingle", "p.pivot", "p.pn", "p.pc"), "shingle"), "blocks")
        tries = blocks.where("id != pivot and comp != pc and 5 * n >= 4 * pn and 5 * pn >= 4 * n").groupBy("id", "n", "pivot").agg(F.count("*").alias("shared"))
        one = tries.groupBy("id", "n").agg(F.max(F.struct("shared", "pivot")).alias("t")).where("40 * t.shared >= n")
        found = stored(checked(one.select(F.col("id").alias("a"), F.col("t.pivot").alias("b")), kept), "links")
        drop_stored(blocks)
        links = links.unionByName(found)
    bits = kept.select("id", "bits")
    tried = stored(join_blocks(blocks.join(bits, "id"), part_rows, forest=True).distinct(), "pairs")
    links = links.unionByName(stored(checked(tried.select("a", "b").distinct(), kept), "links"))
    labels = components(links)
    # Trees with a pair that is not joined, and the components of these: only among them can a pair left out be a link.
    roots = tried.where("tree is not null").join(labels.toDF("a", "ra"), "a", "left").join(labels.toDF("b", "rb"), "b", "left")
    broken = roots.where("coalesce(ra, a) != coalesce(rb, b)").select("tree").distinct()
    again = stored(tried.join(broken, "tree", "left_semi").select(F.explode(F.array("ca", "cb")).alias("comp")).distinct(), "again")
    if not again.isEmpty():
        marked = blocks.join(again, "comp", "left_semi").select("shingle", "id", "n").join(
            labels.withColumnRenamed("root", "comp"), "id", "left").withColumn("comp", F.coalesce("comp", "id"))
        rest = marked.join(open_groups(marked, "shingle", part_rows, 20_000), "shingle").join(bits, "id")
        worth = join_blocks(rest, part_rows).select("a", "b").distinct().join(tried.select("a", "b").distinct(), ["a", "b"], "left_anti")
        labels = components(links.unionByName(stored(checked(stored(worth, "pairs"), kept), "links")))
    drop_stored(blocks)
    drop_stored(firsts)
    drop_stored(kept)
    return sets.join(labels, sets["doc_id"] == labels["id"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("root", "doc_id").alias("component_id"))


def op1_ngram_join(spark, sf_dir: str) -> DataFrame:
    """Components of documents that share 80 percent of their five-word shingles."""
    return similar_sets(table(spark, sf_dir, "documents"))
