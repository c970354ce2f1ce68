"""SentencePiece encoding and decoding of merge-type vocabularies by a score-ordered agenda.

Encoding: a text's characters are its first symbols. All adjacent pairs that join to a piece of the vocabulary go on an
agenda, best score first, then leftmost. The best pair is joined, pairs that one of its symbols had with a neighbour are
passed over when their turn comes, and the pairs of the new symbol go on the agenda, until it is empty. What is no piece
at the end becomes byte pieces, or the unknown piece where the vocabulary has no bytes.

No piece of usual vocabularies holds a blank sign after another sign, so no pair across such a place ever joins: texts are
cut there, and each task remembers the ids of the parts it has met. Vocabularies with such pieces are not cut. The agendas of short
new parts are rows of arrays, worked off side by side: each round takes the best pair of every row. Longer parts, and
those where pieces of one score meet, have a heap each, so time grows with a part's length times its logarithm and a text without blanks is no danger.

The library checks the work within each batch: it encodes every part that is new to the task, and decodes the ids of every text. Column
``agrees`` says whether it gave the same for all parts of a text and for the decoded text.

A null text counts as empty: begin and end ids alone, decoded to an empty text. Repeated rows and null ids are kept as they
are, row by row. Other columns are not passed on, so their names cannot clash. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import struct
from collections import Counter
from collections.abc import Iterable, Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterstone.llm.common import table

#: The sign that stands for a blank in pieces.
BLANK = "▁"
#: Parts of texts whose ids a task remembers (twice over), and signs of text handled at a time.
REMEMBERED, SLICE = 500_000, 1 << 22
#: Parts up to so many signs are merged side by side.
SHORT = 24
#: Numbers of fields and kinds in a model file.
PIECES, TRAINER, NORMALIZER = 1, 2, 3
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
MERGE_TYPE = 2


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def fields(raw: bytes) -> Iterator[tuple[int, int | float | bytes]]:
    """(number, value) of the fields of a protocol buffer message; nested messages and texts as bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            value, at, shift = value | (byte & 127) << shift, at + 1, shift + 7
            if byte < 128:
                return value

    while at < len(raw):
        number, kind = divmod(varint(), 8)
        if kind == 0:
            yield number, varint()
        elif kind == 2:
            size = varint()
            yield number, raw[at:at + size]
            at += size
        else:
            size = 4 if kind == 5 else 8
            yield number, struct.unpack("<f" if kind == 5 else "<d", raw[at:at + size])[0]
            at += size


class PieceCodec:
    """Ids of texts and texts of ids, as the library gives them for a model file of merge type."""

    def __init__(self, model: str, check: bool = False) -> None:
        """``check`` compares all new parts with the library."""
        self.check, self.wrong = check, set()
        with open(model, "rb") as file:
            message = list(fields(file.read()))
        trainer = dict(fields(next((v for k, v in message if k == TRAINER), b"")))
        rules = dict(fields(next((v for k, v in message if k == NORMALIZER), b"")))
        if trainer.get(3, 1) != MERGE_TYPE:
            raise ValueError("the vocabulary is not of merge type")
        pieces = [{1: b"", 2: 0.0, 3: NORMAL} | dict(fields(v)) for k, v in message if k == PIECES]
        if any(p[3] not in (NORMAL, UNKNOWN, CONTROL, BYTE) for p in pieces):
            raise ValueError("user-defined and unused pieces are not supported")
        names = [p[1].decode("utf-8") for p in pieces]
        self.kinds = np.array([p[3] for p in pieces], np.int8)
        places = {score: i for i, score in enumerate(sorted({p[2] for p in pieces}, reverse=True))}
        self.order = {n: places[p[2]] for n, p in zip(names, pieces) if p[3] == NORMAL and len(n) > 1}
        self.id_of = {n: i for i, (n, p) in enumerate(zip(names, pieces)) if p[3] == NORMAL}
        self.names = names
        self.unknown = int(np.flatnonzero(self.kinds == UNKNOWN)[0])
        self.byte_ids = [int(i) for i in np.flatnonzero(self.kinds == BYTE)] if trainer.get(35) else []
        ids = {name: int(trainer.get(field, i)) for name, field, i in (("begin", 41, 1), ("end", 42, 2))}
        self.begin, self.end = ([i] if i < len(names) else [] for i in ids.values())  # -1 stands as a huge number
        #: What a piece gives in a decoded text.
        surface = trainer.get(44, " ⁇ ".encode())
        self.parts = [b"" if k == CONTROL else surface if k == UNKNOWN else bytes([int(n[3:5], 16)]) if k == BYTE else n.replace(BLANK, " ").encode() for n, k in zip(names, self.kinds)]
        self.prefix, self.squeeze, escape = (bool(rules.get(k, 1)) for k in (3, 4, 5))
        self.plain_rules = not rules.get(2) and not self.squeeze and escape and not trainer.get(24)
        self.cuts = not any(BLANK in n.lstrip(BLANK) for n in self.order)
        self.model, self.library_, self.known, self.older = model, None, {}, {}
        self.words = {}  # ids of words (``words_of``); a second way to the parts in ``known``
        self.line_ends = not any("\n" in n for n in self.id_of)
        # The number of a symbol is its id, or that of its sign after all ids.
        signs = {c: len(names) + ord(c) for n in self.id_of for c in n}
        numbers, self.width = signs | self.id_of, len(names) + 0x110000
        self.sign_number = np.arange(len(names), self.width, dtype=np.int32)
        self.sign_number[[ord(c) for c in signs]] = [numbers[c] for c in signs]
        # In the arrays each piece has a place of its own. Where pieces share a score, the leftmost would go first, which arrays do not see.
        ordered = sorted(self.order, key=self.order.__getitem__)
        shared = Counter(self.order.values())
        self.tied = np.array([shared[self.order[n]] > 1 for n in ordered] + [False])
        self.piece_at, self.no_pair = np.array([self.id_of[n] for n in ordered] + [0], np.int32), len(ordered)
        joined = sorted((numbers[n[:k]] * self.width + numbers[n[k:]], place) for place, n in enumerate(ordered) for k in range(1, len(n)) if n[:k] in numbers and n[k:] in numbers)
        self.pair_keys, self.pair_places = (np.array(x, kind) for x, kind in zip(zip(*joined) if joined else ([], []), (np.int64, np.int32)))

    @property
    def library(self):
        if self.library_ is None:
            import sentencepiece

            self.library_ = sentencepiece.SentencePieceProcessor(model_file=self.model)
        return self.library_

    def normalised(self, text: str) -> str:
        """The text with its blanks as signs. Only vocabularies with further rules need the library for it."""
        if not self.plain_rules:
            return self.library.normalize(text)
        return (BLANK if self.prefix and text else "") + text.replace(" ", BLANK)

    def merge(self, part: str) -> bytes:
        """Ids of a normalised text, as little-endian unsigned 32-bit numbers."""
        order, symbols, n = self.order.get, [*part, ""], len(part)
        before, after = [*range(-1, n)], [*range(1, n + 1)]
        # An entry is the place of the pair's score among all scores, then the place of its left symbol.
        agenda = [place << 32 | i for i in range(n - 1) if (place := order(symbols[i] + symbols[i + 1])) is not None]
        heapify(agenda)
        while agenda:
            entry = heappop(agenda)
            i = entry & 0xFFFFFFFF
            left, j = symbols[i], after[i]
            if not left or j >= n or order(left + symbols[j]) != entry >> 32:
                continue  # one of both has joined another symbol since
            symbols[i] = left = left + symbols[j]
            symbols[j] = ""
            after[i] = j = after[j]
            if j < n:
                before[j] = i
                if (place := order(left + symbols[j])) is not None:
                    heappush(agenda, place << 32 | i)
            j = before[i]
            if j >= 0 and (place := order(symbols[j] + left)) is not None:
                heappush(agenda, place << 32 | j)
        return self.packed(filter(None, symbols))

    def packed(self, symbols: Iterable[str]) -> bytes:
        """Ids of symbols; a sign that is no piece becomes byte pieces, or the unknown piece once for a run of them."""
        ids, found = [], self.id_of
        for symbol in symbols:
            if symbol in found:
                ids.append(found[symbol])
            elif self.byte_ids:
                ids += [self.byte_ids[b] for b in symbol.encode("utf-8", "replace")]
            elif not ids or ids[-1] != self.unknown:
                ids.append(self.unknown)
        return struct.pack(f"<{len(ids)}I", *ids)

    def with_bytes(self, numbers: bytes) -> bytes:
        """Ids of symbols given by their numbers."""
        first = len(self.names)
        return self.packed(self.names[i] if i < first else chr(i - first) for i in np.frombuffer(numbers, "<u4").tolist())

    def split(self, text: str) -> list[str]:
        """Parts of a normalised text, cut before each blank sign that follows another sign."""
        if not self.cuts or not self.byte_ids:  # unknown pieces run on across blanks
            return [text] if text else []
        first, *rest = text.split(BLANK)
        parts, blanks = [first] if first else [], ""
        for word in rest:
            blanks += BLANK
            if word:
                parts.append(blanks + word)
                blanks = ""
        return [*parts, blanks] if blanks else parts

    def places(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """For pairs of symbols the place of the piece they join to, or ``no_pair``."""
        keys = left.astype(np.int64) * self.width + right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), max(0, len(self.pair_keys) - 1))
        return np.where(self.pair_keys[at] == keys, self.pair_places[at], self.no_pair)

    def merge_side_by_side(self, parts: list[str]) -> None:
        """Remember the ids of parts of one length; each row is the agenda of a part."""
        n, known = len(parts[0]), self.known
        symbols = self.sign_number[np.frombuffer("".join(parts).encode("utf-32-le", "replace"), "<u4")].reshape(-1, n)
        place, rows = self.places(symbols[:, :-1], symbols[:, 1:]), np.arange(len(parts))
        tied = self.tied[place].any(axis=1)
        while len(rows):
            best = place.argmin(axis=1) if n > 1 else np.zeros(len(rows), np.int64)
            piece = place[np.arange(len(rows)), best] if n > 1 else np.full(len(rows), self.no_pair)
            done = piece == self.no_pair
            if done.any():
                raw, size = symbols[done].astype("<u4").tobytes(), 4 * n
                odd = (symbols[done] >= len(self.parts)).any(axis=1).tolist()  # signs that are no pieces
                for k, row in enumerate(rows[done].tolist()):
                    ids = raw[k * size:k * size + size]
                    known[parts[row]] = self.merge(parts[row]) if tied[row] else self.with_bytes(ids) if odd[k] else ids
                rows, symbols, place, best, piece = rows[~done], symbols[~done], place[~done], best[~done], piece[~done]
                if not len(rows):
                    return
            each, columns = np.arange(len(rows)), np.arange(n)
            symbols[each, best] = self.piece_at[piece]
            # The right symbol and one pair go; what stood after them moves up.
            symbols = symbols[columns != best[:, None] + 1].reshape(len(rows), n - 1)
            place = place[columns[:-1] != best[:, None]].reshape(len(rows), n - 2)
            n -= 1
            for at, there in ((best - 1, best > 0), (best, best < n - 1)):
                r, c = each[there], at[there]
                place[r, c] = met = self.places(symbols[r, c], symbols[r, c + 1])
                tied[rows[r[self.tied[met]]]] = True

    def remember(self, missing: Iterable[str]) -> None:
        """Work out the ids of parts that are not known."""
        older, known, short = self.older, self.known, {}
        fresh = []
        for part in missing:
            if part in older:
                known[part] = older[part]
            elif part == BLANK:  # to the library it would be an empty text
                known[part] = self.merge(part)
            else:
                fresh.append(part)
        # The library puts a blank sign of its own before a text.
        own = self.check and self.cuts and self.plain_rules and self.prefix
        theirs = self.library.encode([p[1:] if p[0] == BLANK else p for p in fresh], num_threads=1) if own else []
        for part in fresh:
            if len(part) <= SHORT:
                short.setdefault(len(part), []).append(part)
            else:
                known[part] = self.merge(part)
        for parts in short.values():
            self.merge_side_by_side(parts)
        self.wrong.update(part for part, ids in zip(fresh, theirs) if known[part] != struct.pack(f"<{len(ids)}I", *ids)[0 if part[0] == BLANK else 4:])

    def words_of(self, text: str) -> list[str]:
        """Words of a text where every word follows one blank, the first one that of the prefix; none for other texts.

        A line end that is in no piece never joins anything, so texts are cut before it too: such a word follows no blank.
        """
        if self.line_ends:
            text = text.replace("\n", " \n")
        fits = self.cuts and self.prefix and self.plain_rules and self.byte_ids and text and "  " not in text and BLANK not in text and text[0] != " " != text[-1]
        return text.split(" ") if fits else []

    def part_of(self, word: str) -> str:
        return word if self.line_ends and word[0] == "\n" else BLANK + word

    def ids_of(self, texts: list[str]) -> list[bytes]:
        """Ids of texts, without begin and end, as little-endian unsigned 32-bit numbers."""
        return [raw for raw, _ in self.checked(texts)]

    def checked(self, texts: list[str]) -> list[tuple[bytes, bool]]:
        """Ids of texts, and whether the library gives the same ids for all parts of the text."""
        words = [self.words_of(t) for t in texts]
        odd = [[] if w else self.split(self.normalised(t)) for t, w in zip(texts, words)]
        fresh = set().union(*words).difference(self.words)
        parts = [self.part_of(w) for w in fresh]
        self.remember(set().union(parts, *odd).difference(self.known))
        self.words.update(zip(fresh, map(self.known.__getitem__, parts)))
        out = [b"".join(map(self.words.__getitem__, w)) if w else b"".join(map(self.known.__getitem__, p)) for w, p in zip(words, odd)]
        right = [not self.wrong or self.wrong.isdisjoint(map(self.part_of, w) if w else p) for w, p in zip(words, odd)]
        if len(self.known) > REMEMBERED:  # what is met again soon is taken over from the older half
            self.known, self.older, self.words = {}, self.known, {}
        return list(zip(out, right))

    def ids(self, text: str) -> bytes:
        return self.ids_of([text])[0]

    def encode(self, text: str) -> bytes:
        """Ids with begin and end ids."""
        return self.framed(self.ids(text))

    def framed(self, raw: bytes) -> bytes:
        return np.array(self.begin, "<u4").tobytes() + raw + np.array(self.end, "<u4").tobytes()

    def decode(self, ids: np.ndarray, listed: list[int] | None = None) -> str:
        """The text of any ids of the vocabulary. Runs of byte pieces that are no characters give one mark for each bad byte."""
        listed = ids.tolist() if listed is None else listed
        is_byte = self.kinds[ids] == BYTE
        edges = [0, *(np.flatnonzero(is_byte[1:] != is_byte[:-1]) + 1), len(ids)]
        out, opening = [], self.prefix or self.squeeze  # opening: a leading blank is still to be taken off
        for start, stop in zip(edges[:-1], edges[1:]):
            if start == stop:
                continue
            run = listed[start:stop]
            if is_byte[start]:
                out.append(characters(b"".join(map(self.parts.__getitem__, run))))
                opening = False
                continue
            while opening and run:
                part, known = self.parts[run[0]], self.kinds[run[0]] == NORMAL
                cut = known and part[:1] == b" "
                part = part[1:] if cut else part
                opening = not part and not (cut and not self.squeeze)
                out.append(part.decode())
                del run[0]
            out.append(b"".join(map(self.parts.__getitem__, run)).decode())
        return "".join(out)


def characters(raw: bytes) -> str:
    """The characters of a run of bytes; each byte that starts none becomes the replacement mark."""
    out = []
    while raw:
        try:
            return "".join(out) + raw.decode()
        except UnicodeDecodeError as bad:
            out.append(raw[:bad.start].decode() + "�")
            raw = raw[bad.start + 1:]
    return "".join(out)


def slices(texts: list[str], signs: int = SLICE) -> Iterator[tuple[int, int]]:
    """Bounds of runs of texts of about ``signs`` signs together; a longer text is a run of its own."""
    start = size = 0
    for i, text in enumerate(texts):
        if size and size + len(text) > signs:
            yield start, i
            start, size = i, 0
        size += len(text) + 1
    if size:
        yield start, len(texts)


def encode_decode(docs: DataFrame, model: str | None = None, with_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, agrees[, ids, decoded]) of every row of ``docs`` (doc_id, text).

    ``with_ids`` adds the ids as bytes and the decoded text themselves.
    """
    model = model or default_model()
    key = docs.schema["doc_id"].dataType.simpleString()

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = PieceCodec(model, check=True)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for start, stop in slices(texts):
                found = codec.checked(texts[start:stop])
                raw = [codec.framed(r) for r, _ in found]
                numbers = [np.frombuffer(r, "<u4") for r in raw]
                listed = [n.tolist() for n in numbers]
                decoded = [codec.decode(n, x) for n, x in zip(numbers, listed)]
                # Vocabularies that are not cut are compared text by text.
                whole = [True] * len(raw) if codec.cuts and codec.plain_rules and codec.prefix else [
                    n == codec.library.encode(t, add_bos=True, add_eos=True) for n, t in zip(listed, texts[start:stop])]
                agrees = [right and same and codec.library.decode(n) == d for (_, right), same, n, d in zip(found, whole, listed, decoded)]
                sha = [[hashlib.sha256(x).hexdigest() for x in xs] for xs in (raw, [d.encode() for d in decoded])]
                columns = [batch.column(0).slice(start, stop - start), pa.array([len(n) for n in numbers], pa.int64()), *map(pa.array, (sha[0], sha[1], agrees))]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "agrees"]
                if with_ids:
                    columns, names = [*columns, pa.array(raw, pa.binary()), pa.array(decoded, pa.string())], [*names, "ids", "decoded"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    extra = ", ids binary, decoded string" if with_ids else ""
    return docs.select(F.col("doc_id"), F.col("text").cast("string")).mapInArrow(
        code, f"doc_id {key}, n_tokens long, ids_sha256 string, decoded_sha256 string, agrees boolean{extra}")


def op12_sentencepiece(spark, sf_dir: str) -> DataFrame:
    """Encode every document with begin and end ids, and decode the ids again."""
    return encode_decode(table(spark, sf_dir, "documents"))
