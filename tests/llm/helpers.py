"""Small tables with the awkward cases every operator has to bear, and plain versions to compare with."""

import re
from collections import defaultdict

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sentence(seed: int, n: int) -> str:
    """``n`` made-up words that depend on ``seed``."""
    state, out = seed * 7919 + 17, []
    for _ in range(n):
        state = (state * 1103515245 + 12345) % (1 << 31)
        out.append("".join("etaoinshrdlu"[(state >> k) % 12] for k in (3, 7, 11, 15, 19)))
    return " ".join(out)


def awkward_rows() -> list[tuple]:
    """Nulls in all columns, empty and blank texts, copies, repeated rows, ties, one very long text."""
    long = sentence(99, 30_000)
    base = sentence(1, 120)
    near = base.split(" ")
    near[60] = "changed"
    rows = [
        (1, base, "en", "a", len(base)), (2, base, "en", "a", None), (3, " ".join(near), None, None, 1), (4, "", "en", "a", 0),
        (5, None, None, None, None), (6, "   \n\t ", "de", "b", 6), (7, "one two", "en", "b", 7), (8, "ONE two", "en", "b", 7),
        (9, long, "en", "c", len(long)), (None, base, "en", "a", 1), (10, sentence(3, 80) + "\n" + sentence(4, 30) + "\n" + sentence(5, 30), "en", "a", 1),
        (11, sentence(6, 80) + "\n" + sentence(4, 30) + "\n" + sentence(5, 30), "en", "a", 1), (12, "\n".join([sentence(4, 30)] * 3), "fr", "a", 1),
        (13, sentence(7, 60) + " " + sentence(8, 70), "es", "d", 9), (14, sentence(9, 20) + " " + sentence(8, 70) + " tail", "es", "d", 9),
        (15, "😀 ünïcode 𝒳 " + sentence(10, 55), "fr", "d", 3),
    ]
    return rows + [rows[0], rows[12]]


def frame(spark, rows, schema=SCHEMA):
    """The rows, with extra columns whose names operators use inside."""
    extra = ["id", "a", "b", "n", "hub", "shard", "number", "text_key", "places", "bands", "key", "comp", "root", "label_", "language"]
    return spark.createDataFrame(rows, schema).repartition(3).withColumns({c: F.lit(c) for c in extra})


class Unions(dict):
    """Union-find over whatever is asked for."""

    def top(self, x):
        while self.setdefault(x, x) != x:
            x = self[x]
        return x

    def join(self, a, b):
        self[self.top(a)] = self.top(b)


def shingles(text: str | None) -> frozenset:
    words = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(words[k:k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()


def joined_sets(rows) -> dict:
    """(size, smallest id of the component) by id, comparing all pairs."""
    sets, unions = {r[0]: shingles(r[1]) for r in rows if r[0] is not None}, Unions()
    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and sets[a] and 100 * both >= 80 * len(sets[a] | sets[b]):
                unions.join(a, b)
    groups = defaultdict(list)
    for a in sets:
        groups[unions.top(a)].append(a)
    return {a: (len(sets[a]), min(groups[unions.top(a)])) for a in sets}
