"""Packing by minimum bin slack: pieces of documents fill sequences of a fixed number of tokens.

Every document becomes its token ids plus one end id. Only documents longer than a sequence are cut, into whole
sequences; their first piece takes the rest and may be shorter.

Only the number of pieces of each length matters for the plan, and there are at most ``capacity`` lengths, so the plan is
made on the driver from that table. For each sequence the longest piece left is taken, and a bitset of reachable sums over
the lengths left finds the fullest combination that goes with it. The combination is used as often as its pieces
last, which gives the same sequences as searching it again each time; then the next is sought. Each search uses up at least
one length, so there are at most ``capacity`` searches, whatever the number of documents. The pieces of one length are
numbered (``common.ranked``) and look up their place in the plan.

Null texts count as empty; an empty text is its end id alone. Repeated rows are packed one by one. Ties between
combinations of one fullness go to the longest lengths. An empty table gives no rows.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterstone.llm.common import ranked, stored, table

CAPACITY, END_ID = 1024, 2
#: Chunks of text whose ids a task remembers.
REMEMBERED = 400_000
#: A blank between two signs that are no blanks always starts a new token, so texts can be cut there. Other texts are cut
#: only between printable ASCII signs or Latin letters.
ODD_BLANK = re.compile(r" (?=[\s\x1c-\x1f\x85᠎​﻿])|(?<=[\s\x1c-\x1f\x85᠎​﻿]) ")
SAFE_BLANK = re.compile(r"(?<=[!-~À-ɏ]) (?=[!-~À-ɏ])")


def default_vocabulary() -> str:
    """The rank file of the same vocabulary as byte_bpe_50k.json; both give the same ids between added tokens."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def default_added() -> dict[str, int]:
    """The added tokens of byte_bpe_50k.json with their ids. Each stands for its exact text, wherever it occurs."""
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        return {t["content"]: t["id"] for t in json.load(file)["added_tokens"]}


class ChunkEncoder:
    """Token ids of texts, each chunk between single blanks looked up once and then remembered.

    ``added`` maps texts to the one id each of them has; what stands between them is encoded part by part.
    """

    def __init__(self, vocabulary: str, added: dict[str, int] | None = None) -> None:
        import public_tokenizers
        import tiktoken

        with open(vocabulary, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encode = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.known: dict[str, bytes] = {}
        self.added = {text: np.array([i], dtype="<u4").tobytes() for text, i in (added or {}).items()}
        self.find_added = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None

    def ids(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit numbers."""
        if self.find_added is None:
            return self.plain_ids(text)
        return b"".join(self.added[part] if i % 2 else self.plain_ids(part) for i, part in enumerate(self.find_added.split(text)))

    def plain_ids(self, text: str) -> bytes:
        """Ids of a text without added tokens."""
        first, *rest = (SAFE_BLANK.split(text) if ODD_BLANK.search(text) else text.split(" "))
        known = self.known
        missing = set(rest).difference(known)
        if len(known) + len(missing) > REMEMBERED:
            known.clear()
            missing = set(rest)
        for chunk in missing:
            known[chunk] = np.array(self.encode(" " + chunk), dtype="<u4").tobytes()
        return np.array(self.encode(first), dtype="<u4").tobytes() + b"".join(map(known.__getitem__, rest))


def cut(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False,
        added: dict[str, int] | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every document."""
    end = np.array([end_id], dtype="<u4").tobytes()
    key = docs.schema["doc_id"].dataType.simpleString()
    extra = ", ids binary" if with_ids else ""

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = ChunkEncoder(vocabulary, added)
        names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
        for batch in batches:
            out = []
            for doc_id, text in zip(batch["doc_id"].array, batch["text"]):
                raw = encoder.ids(text or "") + end
                n = len(raw) // 4
                stop = (n - 1) % capacity + 1
                start = piece = 0
                while start < n:
                    part = raw[4 * start:4 * stop]
                    out.append((doc_id, piece, start, stop - start, zlib.crc32(part)) + ((part,) if with_ids else ()))
                    start, stop, piece = stop, stop + capacity, piece + 1
            done = pd.DataFrame(out, columns=names)
            done["doc_id"] = pd.array(done["doc_id"], dtype=batch["doc_id"].dtype) if len(done) else done["doc_id"]
            yield done

    return docs.select("doc_id", "text").mapInPandas(pieces, f"doc_id {key}, piece int, start long, length long, ids_crc32 long{extra}")


def fullest(lengths: list[int], counts: dict[int, int], room: int) -> list[int]:
    """The combination of available lengths whose sum comes nearest to ``room``; longer lengths are preferred.

    ``reach[i]`` has bit s set when the i shortest usable lengths can give the sum s.
    """
    usable = sorted(x for x in lengths if x <= room and counts[x])
    mask, reach = (1 << (room + 1)) - 1, [1]
    for length in usable:
        sums, left, part = reach[-1], min(counts[length], room // length), 1
        while left:  # 1, 2, 4, ... copies at a time, then the rest
            take = min(part, left)
            sums |= (sums << (length * take)) & mask
            left, part = left - take, part * 2
        reach.append(sums)
    target, picked = reach[-1].bit_length() - 1, []
    for i in range(len(usable) - 1, -1, -1):
        # As many copies of the longest length as leave a sum that the shorter ones can give.
        length = usable[i]
        copies = min(counts[length], target // length)
        while not (reach[i] >> (target - copies * length)) & 1:
            copies -= 1
        picked += [length] * copies
        target -= copies * length
    return picked


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first, last, per_sequence, sequence, offset).

    The pieces of ``length`` numbered ``first`` to ``last`` (exclusive) go, ``per_sequence`` at a time, into the sequences
    from ``sequence`` on, the first of each sequence at ``offset``.
    """
    counts, used, rows, sequence = dict(histogram), dict.fromkeys(histogram, 0), [], 0
    while any(counts.values()):
        lengths = [x for x in counts if counts[x]]
        longest = max(lengths)
        counts[longest] -= 1
        parts = [longest, *fullest(lengths, counts, capacity - longest)]
        counts[longest] += 1
        need = {x: parts.count(x) for x in parts}
        times, offset = min(counts[x] // k for x, k in need.items()), 0
        for length, copies in need.items():
            rows.append((length, used[length], used[length] + times * copies, copies, sequence, offset))
            used[length] += times * copies
            counts[length] -= times * copies
            offset += length * copies
        sequence += times
    return rows


def place(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset``. ``pieces`` has doc_id, piece, start and length and is read twice."""
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    rows = plan(histogram, capacity)
    by_length: dict[int, list] = {}
    for length, *rest in rows:
        by_length.setdefault(length, []).append(rest)
    tables = {k: np.array(v, dtype=np.int64).T for k, v in by_length.items()}  # first, last, per_sequence, sequence, offset
    numbered = ranked(pieces, ["length"], F.struct("doc_id", "piece", "start", "ids_crc32"), "number")
    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema.fields) + ", sequence_id long, offset long"

    def look_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sequence, offset = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
            lengths, numbers = batch["length"].to_numpy(), batch["number"].to_numpy()
            for length in np.unique(lengths):
                first, _, per_sequence, start, at = tables[int(length)]
                mine = np.flatnonzero(lengths == length)
                row = np.searchsorted(first, numbers[mine], "right") - 1
                beyond = numbers[mine] - first[row]
                sequence[mine] = start[row] + beyond // per_sequence[row]
                offset[mine] = at[row] + beyond % per_sequence[row] * length
            yield batch.drop(columns="number").assign(sequence_id=sequence, offset=offset)

    return numbered.select(*pieces.columns, "number").mapInPandas(look_up, kind)


def pack(docs: DataFrame, vocabulary: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Pieces of ``docs`` with their sequence and place; ``with_ids`` adds the ids themselves as bytes.

    Only the default vocabulary has added tokens.
    """
    added = None if vocabulary else default_added()
    pieces = stored(cut(docs, vocabulary or default_vocabulary(), capacity, end_id, with_ids, added), "pieces")
    return place(pieces, capacity)


def op4_packing(spark, sf_dir: str) -> DataFrame:
    """Pack every document into sequences of at most 1024 tokens."""
    return pack(table(spark, sf_dir, "documents"))
