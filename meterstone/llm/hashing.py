"""Hashes of words and of runs of words, in numpy, and count-min sketches of hashes merged from all tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame

#: A row of a sketch is merged in so many blocks, of at least 65,536 cells.
BLOCKS, LEAST_BLOCK = 256, 1 << 16
BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
MIX = np.uint64(0xFF51AFD7ED558CCD)
#: Bytes hashed at a time.
SEGMENT = 1 << 20
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * MIX
    return x ^ (x >> np.uint64(29))


class Rolling:
    """Hashes of all runs of a number of words, from running sums; arithmetic modulo 2 ** 64."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def sums(self, hashes: np.ndarray) -> np.ndarray:
        if len(self.up) < len(hashes) + 1:
            for name, factor in (("up", self.base), ("down", self.inverse)):
                powers = np.full(len(hashes) + 1, factor, np.uint64)
                powers[0] = 1
                setattr(self, name, np.cumprod(powers, dtype=np.uint64))
        out = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(hashes * self.down[:len(hashes)], out=out[1:])
        return out

    def runs(self, sums: np.ndarray, length: int) -> np.ndarray:
        n = len(sums) - length
        return mixed((sums[length:] - sums[:n]) * self.up[:n]) if n > 0 else np.zeros(0, np.uint64)


class WordHashes:
    """Hashes of the words of texts (runs of bytes other than white space), from running sums over their bytes."""

    def __init__(self) -> None:
        rng = np.random.default_rng(2)
        self.values = rng.integers(0, 1 << 64, 256, dtype=np.uint64)
        self.rolling = Rolling(0xA0761D6478BD642F)

    def of(self, texts: list[str | None], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """All hashes, text after text, and the number of words of each text. ``lower`` lower-cases A to Z."""
        parts = [(t or "").encode("utf-8", "replace") for t in texts]
        raw = b"\n".join(parts)
        points = np.frombuffer(raw.lower() if lower else raw, np.uint8)
        gaps = np.ones(len(points) + 2, bool)
        gaps[1:-1] = SPACE[points]
        edges = np.flatnonzero(gaps[1:] != gaps[:-1])
        starts, ends = edges[::2], edges[1::2]
        out, i = np.zeros(len(starts), np.uint64), 0
        while i < len(starts):
            j = max(i + 1, int(np.searchsorted(ends, starts[i] + SEGMENT, "right")))
            low = starts[i]
            sums = self.rolling.sums(self.values[points[low:ends[j - 1]]])
            first = starts[i:j] - low
            out[i:j] = mixed((sums[ends[i:j] - low] - sums[first]) * self.rolling.up[first])
            i = j
        bounds = np.cumsum([0] + [len(p) + 1 for p in parts])
        return out, np.diff(np.searchsorted(starts, bounds))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Smallest of each ``width`` neighbours."""
    n, reach = len(x) - width + 1, 1
    while reach * 2 <= width:
        x = np.minimum(x[:-reach], x[reach:])
        reach *= 2
    return np.minimum(x[:n], x[width - reach:width - reach + n])


def cells_of(anchors: np.ndarray, cells: int) -> list[np.ndarray]:
    """The anchor's cell in each row of the sketch. ``cells`` is a power of two."""
    return [(mixed(anchors * np.uint64(odd)) & np.uint64(cells - 1)).astype(np.int64) for odd in BASES]


def chunks(batches: Iterator[pd.DataFrame], words: int) -> Iterator[pd.DataFrame]:
    """Rows gathered until their texts have about ``words`` words (six bytes each)."""
    held, size = [], 0
    for batch in batches:
        sizes = batch["text"].str.len().fillna(0).to_numpy()
        start = 0
        for i in range(len(batch)):
            size += sizes[i] / 6
            if size > words:
                held.append(batch.iloc[start:i + 1])
                yield pd.concat(held, ignore_index=True)
                held, size, start = [], 0, i + 1
        if start < len(batch):
            held.append(batch.iloc[start:])
    if held:
        yield pd.concat(held, ignore_index=True)


USED = "row int, block int, many boolean, used binary"


def sketch_cells(distinct: int, cells_each: int, most: int) -> int:
    """Cells a row for so many different hashes: a power of two, ``most`` at most."""
    return min(most, max(LEAST_BLOCK, 1 << (cells_each * distinct - 1).bit_length()))


def block_size(cells: int) -> int:
    return max(LEAST_BLOCK, cells // BLOCKS)


def packed(cells: np.ndarray, size: int) -> bytes:
    """Sorted cells of a block in two bytes each, after how many there are in each 65,536."""
    counts = np.bincount(cells >> 16, minlength=size >> 16).astype("<u4")
    return counts.tobytes() + (cells & 0xFFFF).astype("<u2").tobytes()


def unpacked(raw: bytes, size: int) -> np.ndarray:
    counts = np.frombuffer(raw, "<u4", size >> 16)
    return np.frombuffer(raw, "<u2", offset=counts.nbytes).astype(np.int64) + np.repeat(np.arange(len(counts)) << 16, counts)


def used_cells(hashes: np.ndarray, cells: int) -> pd.DataFrame:
    """A task's sketch: the cells used once, and those used more often, by blocks of cells."""
    out, size = [], block_size(cells)
    for row, used in enumerate(cells_of(hashes, cells)):
        cell, times = np.unique(used, return_counts=True)
        for many in (False, True):
            mine = cell[(times > 1) == many]
            blocks, begins = np.unique(mine // size, return_index=True)
            parts = np.split(mine % size, begins[1:]) if len(mine) else []
            out += [(row, int(b), many, packed(p, size)) for b, p in zip(blocks, parts)]
    return pd.DataFrame(out, columns=["row", "block", "many", "used"])


def merged_sketch(used: DataFrame, cells: int) -> np.ndarray:
    """Bits (2 rows) of the cells used twice or more over all tasks. ``cells`` bounds what comes to the driver."""

    size = block_size(cells)

    def merge(parts: pd.DataFrame) -> pd.DataFrame:
        times = np.zeros(size, np.int8)
        for many, part in zip(parts["many"], parts["used"]):
            at = unpacked(part, size)
            times[at] = np.minimum(2, times[at] + (2 if many else 1))
        return pd.DataFrame({"row": parts["row"].iloc[:1], "block": parts["block"].iloc[:1], "bits": [np.packbits(times > 1, bitorder="little").tobytes()]})

    bits = np.zeros((2, cells // 8), np.uint8)
    for r in used.groupBy("row", "block").applyInPandas(merge, "row int, block int, bits binary").collect():
        start = r["block"] * (size // 8)
        bits[r["row"], start:start + size // 8] = np.frombuffer(r["bits"], np.uint8)
    return bits


def used_twice(hashes: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Whether both cells of each hash were used twice or more; true for every hash that was."""
    yes = np.ones(len(hashes), bool)
    for row, cell in enumerate(cells_of(hashes, bits.shape[1] * 8)):
        yes &= (bits[row][cell >> 3] >> (cell & 7).astype(np.uint8)) & 1 == 1
    return yes


def bitmap(ids: DataFrame, max_cells: int = 1 << 28) -> Broadcast:
    """A broadcast bitmap of the distinct ``h1``; it lets very few others through."""
    cells = sketch_cells(max(1, ids.count()), 64, max_cells)

    def use(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield used_cells(np.repeat(batch["h1"].to_numpy(np.int64).view(np.uint64), 2), cells)

    return ids.sparkSession.sparkContext.broadcast(merged_sketch(ids.mapInPandas(use, USED), cells))
