"""Hard negatives, SentencePiece codec and cross-tokenizer alignment against the libraries and plain versions."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from meterstone.llm import alignment, hard_negatives, piece_codec
from tests.llm.helpers import awkward_rows, frame, sentence

ODD = list(" ▁  abthe\n\n\t\x00é😀x41中文ﬁ​́�0123456789====") + ["<s>", "</s>", "<unk>", "<|endoftext|>", "<0x41>", " the", " word", "====", "    "]


def odd_texts(n: int, length: int = 30) -> list[str]:
    rng = random.Random(7)
    return ["".join(rng.choice(ODD) for _ in range(rng.randrange(length))) for _ in range(n)]


# 11


def plain_negatives(rows, anchors, n_positives=5, n_negatives=10):
    """Every anchor with every row, by (id, label, integers)."""
    known, out = {r[0]: r for r in rows}, []
    ids, labels, u = [r[0] for r in rows], [r[1] for r in rows], np.array([r[2] for r in rows], dtype=np.int64)
    for a in anchors:
        if a not in known:
            continue
        ordered = sorted((-int(s), i, label) for s, i, label in zip(u @ np.array(known[a][2], dtype=np.int64), ids, labels) if i != a)
        same = [(i, -s) for s, i, label in ordered if label == known[a][1]][:n_positives]
        other = [(i, -s) for s, i, label in ordered if label != known[a][1]]
        for p, score in same:
            found = [(i, s) for i, s in other if 30 * score <= 100 * s <= 90 * score][:n_negatives]
            out += [(a, p, k, i, score, s) for k, (i, s) in enumerate(found, 1)]
    return sorted(out)


def integers(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, label long, u array<long>")


def random_rows(seed, n, dims, labels, spread=0.2):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(n // 15 + 1, dims))
    u = np.floor(256 * (middle[rng.integers(0, len(middle), n)] + spread * rng.normal(size=(n, dims)))).astype(int)
    u[n // 2:n // 2 + n // 5] = u[0]  # one vector in a fifth of all rows
    u[n - 1] = 0
    return [(i, int(rng.integers(0, labels)), u[i].tolist()) for i in range(n)]


@pytest.mark.parametrize("dims, labels, block", [(64, 10, 2048), (5, 3, 7), (70, 2, 2048)])
def test_negatives_equal_brute_force(spark, dims, labels, block):
    rows = random_rows(dims, 400, dims, labels)
    frame_ = integers(spark, rows).repartition(5)
    found = hard_negatives.mine(frame_, frame_.where("vec_id % 10 = 0"), block=block, centres=9, sample_rows=120)
    want = plain_negatives(rows, range(0, 400, 10))
    assert sorted(tuple(r) for r in found.collect()) == want and want


def test_intervals_hold_and_leave_rows_out():
    rows = random_rows(3, 2000, 64, 5, spread=0.05)
    u = np.array([r[2] for r in rows], float)
    rng = np.random.default_rng(0)
    middle, (turned, _) = u[rng.choice(2000, 40, replace=False)], np.linalg.qr(rng.normal(size=(64, 64)))
    import pandas as pd

    centre = hard_negatives.nearest(u, middle)
    v = (u - middle[centre]) @ turned
    alignment_ = np.abs(v).sum(axis=1) / 8
    batch = hard_negatives.Codes(pd.DataFrame({
        "vec_id": range(2000), "label": [r[1] for r in rows], "u": [np.array(r[2]) for r in rows], "centre": centre, "alignment": alignment_,
        "code": [w.tobytes() for w in hard_negatives.bit_words(v > 0)], "rest": np.sqrt(np.maximum(0, (v ** 2).sum(axis=1) - alignment_ ** 2))}), middle)
    everything = np.arange(2000)
    for i in range(0, 2000, 50):
        anchor = u[i].astype(np.int64)
        low, high = batch.interval(everything, anchor, turned)
        scores = batch.scores(everything, anchor)
        assert (low <= scores).all() and (scores <= high).all()
    assert hard_negatives.positives_of(batch, 0, rows[0][1], u[0].astype(np.int64), turned, hard_negatives.Best(5)) < 600


def test_score_range_at_its_ends():
    for p in (-7, 0, 1, 3, 10, 99, 100, 101):
        first, last = hard_negatives.score_range(p, 30, 90)
        for n in range(-150, 150):
            assert (30 * p <= 100 * n <= 90 * p) == (first <= n <= last)


def test_rows_that_take_no_part_and_repeated_ids(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, 0, [1.0, -0.001]), (1, 0, [1.0, -0.001]), (2, 0, None), (3, None, [1.0, 1.0]), (4, 1, [nan, 1.0]), (5, 1, [inf, 1.0]), (6, 1, [None, 1.0]),
            (None, 1, [1.0, 1.0]), (7, 1, [0.0, 0.0]), (8, 1, [1.0]), (9, 2, [2.0, 2.0]), (9, 1, [0.5, 0.25])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").withColumns({c: F.lit(1) for c in ("u", "code", "rank", "v", "block")})
    kept = hard_negatives.quantised(df, F.col("label"))
    assert sorted((r["vec_id"], r["label"], r["u"]) for r in kept.collect()) == [(1, 0, [256, -1]), (7, 1, [0, 0]), (9, 1, [128, 64])]
    assert hard_negatives.mine(kept, df.where("vec_id = 1")).count() == 0  # no other row of its label


def test_ties_go_to_the_smaller_id_and_empty_tables(spark):
    rows = [(100, 0, [10, 0]), (1, 0, [10, 0]), (2, 0, [10, 0])] + [(k, 1, [5, k]) for k in range(30, 10, -1)]
    found = hard_negatives.mine(integers(spark, rows), spark.createDataFrame([(100,), (555,)], "vec_id long"), n_positives=1)
    assert [tuple(r)[1:4] for r in sorted(found.collect())] == [(1, k, 10 + k) for k in range(1, 11)]
    none = integers(spark, [])
    assert hard_negatives.mine(none, none).collect() == []
    assert hard_negatives.mine(integers(spark, rows), none).collect() == []
    kinds = "vec_id long, label int, embedding array<float>"
    assert hard_negatives.quantised(spark.createDataFrame([], kinds), F.col("label")).collect() == []


# 12


@pytest.fixture(scope="module")
def codec():
    return piece_codec.PieceCodec(piece_codec.default_model())


def test_agenda_gives_the_ids_and_texts_of_the_library(codec):
    for text in [*odd_texts(4000), "", " ", "   ", "a" * 3000, "ab" * 2000 + " " + "=" * 700, sentence(5, 300), "\n".join(sentence(k, 9) for k in range(30))]:
        ids = np.frombuffer(codec.encode(text), "<u4")
        assert ids.tolist() == codec.library.encode(text, add_bos=True, add_eos=True), repr(text)
        assert codec.decode(ids) == codec.library.decode(ids.tolist())


def test_any_ids_are_decoded_as_by_the_library(codec):
    rng = random.Random(2)
    for _ in range(4000):
        ids = [rng.choice([rng.randrange(262), rng.randrange(32000), codec.id_of["▁"], codec.id_of["▁▁"], 0, 1]) for _ in range(rng.randrange(9))]
        assert codec.decode(np.array(ids, np.int64)) == codec.library.decode(ids), ids


def test_wrong_parts_are_told():
    checked = piece_codec.PieceCodec(piece_codec.default_model(), check=True)
    checked.merge_side_by_side = lambda parts: checked.known.update((p, b"") for p in parts)
    assert [right for _, right in checked.checked(["abc def", ""])] == [False, True]


def test_without_cuts_and_with_a_small_memory_ids_stay(codec, monkeypatch):
    texts = odd_texts(300)
    want = [codec.ids(t) for t in texts]
    other = piece_codec.PieceCodec(piece_codec.default_model())
    other.cuts = False
    assert [other.ids(t) for t in texts] == want
    monkeypatch.setattr(piece_codec, "REMEMBERED", 3)
    small = piece_codec.PieceCodec(piece_codec.default_model())
    assert [small.ids(t) for t in texts * 2] == want * 2 and len(small.known) < 60


def test_every_document_is_encoded_and_decoded(spark, codec):
    rows = awkward_rows()
    found = piece_codec.encode_decode(frame(spark, rows), with_ids=True).collect()
    assert all(r["agrees"] for r in found)
    want = []
    for r in rows:
        ids = codec.library.encode(r[1] or "", add_bos=True, add_eos=True)
        raw, text = np.array(ids, "<u4").tobytes(), codec.library.decode(ids)
        want.append((r[0], len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(text.encode()).hexdigest(), raw, text))
    order = lambda r: tuple((v is None, v) for v in r)
    assert sorted(((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"], bytes(r["ids"]), r["decoded"]) for r in found), key=order) == sorted(want, key=order)
    assert piece_codec.encode_decode(frame(spark, [])).collect() == []


def test_slices_cover_all_texts():
    texts = ["a" * n for n in (5, 0, 0, 50, 1, 2, 3, 0)]
    bounds = list(piece_codec.slices(texts, 10))
    assert [x for a, b in bounds for x in texts[a:b]] == texts and list(piece_codec.slices([])) == []
    assert max(sum(map(len, texts[a:b])) for a, b in bounds if b - a > 1) <= 10


# 13


def byte_signs():
    """The sign that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def plain_alignment(rows):
    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True  # the contract: their strings are plain text
    pieces, signs, found = sentencepiece.SentencePieceProcessor(model_file=piece_codec.default_model()), byte_signs(), []
    for doc_id, text in rows:
        a = tokenizer.encode(" " + (text or ""), add_special_tokens=False).ids
        b = pieces.encode(text or "")
        a_parts = [bytes(signs[c] for c in tokenizer.id_to_token(i)) for i in a]
        b_parts = [bytes([int(p[3:5], 16)]) if pieces.is_byte(i) else p.replace("▁", " ").encode() for i in b for p in [pieces.id_to_piece(i)]]
        groups = []
        if text and b"".join(a_parts) == b"".join(b_parts) == (" " + text).encode():
            a_ends, b_ends = (np.cumsum([len(p) for p in parts]).tolist() for parts in (a_parts, b_parts))
            start = 0
            for end in sorted(set(a_ends) & set(b_ends)):
                groups.append(([i for i, e in zip(a, a_ends) if start < e <= end], [i for i, e in zip(b, b_ends) if start < e <= end]))
                start = end
        found.append((doc_id, groups, Counter((x, y) for u, v in groups for x in u for y in v)))
    counts = Counter(pair for _, _, links in found for pair in links)
    highest = defaultdict(int)
    for (x, _), n in counts.items():
        highest[x] = max(highest[x], n)
    return [(i, sum(len(u) for u, _ in g), sum(len(v) for _, v in g), len(g), sum(links.values()), sum(m for p, m in links.items() if counts[p] == highest[p[0]]),
             sum(m * counts[p] for p, m in links.items()),
             hashlib.sha256(";".join(",".join(map(str, u)) + "|" + ",".join(map(str, v)) for u, v in g).encode()).hexdigest() if g else "") for i, g, links in found]


def in_order(rows):
    return sorted(rows, key=lambda r: tuple((v is None, v) for v in r))


@pytest.mark.parametrize("signs", [alignment.CHUNK, 300, 1])
def test_alignment_equals_the_plain_one(spark, signs):
    rows = [(r[0], r[1]) for r in awkward_rows() if r[0] != 9] + [(100 + k, t) for k, t in enumerate(odd_texts(150, 20))]
    rows += [(1000, "=a" * 300), (1001, "ab" * 400), (1002, "é" * 200), (1003, "  "), (1004, "=" * 999), (1005, "a▁b")]
    found = alignment.align(frame(spark, [(i, t, None, None, None) for i, t in rows]), chunk_signs=signs)
    assert found.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert in_order([tuple(r) for r in found.collect()]) == in_order(plain_alignment(rows))


def test_alignment_of_tables_without_texts(spark):
    assert alignment.align(frame(spark, [])).collect() == []
    assert [tuple(r) for r in alignment.align(frame(spark, [(1, None, None, None, None)])).collect()] == [(1, 0, 0, 0, 0, 0, 0, "")]


def test_groups_of_a_window_end_where_both_end():
    tokens = alignment.Tokens([b"", b"a", b"aa", b"aaa"])
    a, b = ([2, 1, 3], [2, 1], [1], [1, 1]), ([1, 1, 1, 1, 2], [1, 2], [1], [2])
    flat = lambda side: (np.concatenate(side), np.repeat(np.arange(4), [len(x) for x in side]))
    (a_ids, a_window), (b_ids, b_window) = flat(a), flat(b)
    windows = alignment.Windows(a_ids, b_ids, a_window, b_window, tokens, tokens)
    assert windows.texts == ["2|1,1;1|1;3|1,2", "2,1|1,2", "1|1", "1,1|2"] and windows.n_groups.tolist() == [3, 1, 1, 1] and windows.n_links.tolist() == [5, 4, 1, 2]
    windows.count(np.array([3, 2, 3]))
    assert windows.docs.sum() == 2
    # The pair of ids (1, 2) is linked twice in the last window.
    assert windows.times[windows.starts[3]:].tolist() == [2]


def test_equal_windows_have_equal_ids_on_both_sides():
    a, b = np.array([1, 2, 1, 2, 1, 2, 3]), np.array([5, 5, 5, 5, 6])
    kinds, kind = alignment.equal_windows(a, b, np.array([0, 2, 4, 6]), np.array([0, 1, 2, 4]))
    assert kind[0] == kind[1] and len(set(kind.tolist())) == 3 and sorted(kinds.tolist()) == [0, 2, 3]


def test_texts_that_only_look_alike_in_length_have_no_tokens():
    from meterstone.llm.packing import default_vocabulary

    aligner = alignment.Aligner(default_vocabulary(), piece_codec.default_model())
    right = aligner.chunk(["ab cd", "ab xy"])[0]
    # A piece that stands for other bytes of the same length, as if the vocabulary held such a one.
    wrong = next(i for i in aligner.encode_b(["ab xy"])[0] if b"x" in aligner.b_tokens.parts[i])
    aligner.b_tokens.parts[wrong] = b"?" * len(aligner.b_tokens.parts[wrong])
    first, second = aligner.chunk(["ab cd", "ab xy"])[0]
    assert first[:5] == right[0][:5] and second[:5] == (0, 0, 0, 0, "")


def test_numbers_survive_packing():
    for numbers in (np.zeros(0, np.int64), np.array([7]), np.array([5, 5, 0, 70_000, 3])):
        assert alignment.unpacked_numbers(alignment.packed_numbers(numbers)).tolist() == sorted(numbers.tolist())


@pytest.mark.parametrize("name", ["op1_ngram_join", "op6_decontamination", "op8_substrings", "op11_hard_negatives"])
def test_queries_equal_their_sql(spark, name):
    import duckdb

    from meterstone.llm.queries import ORACLES, QUERIES

    connection = duckdb.connect()
    for table in ("documents", "benchmark", "embeddings"):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '/root/testdata/sf0.001/{table}.parquet'")
    found = connection.execute(ORACLES[name])
    columns, want = [c[0] for c in found.description], sorted(found.fetchall())
    result = QUERIES[name](spark, "/root/testdata/sf0.001")
    assert sorted(result.columns) == sorted(columns)
    assert sorted(tuple(r) for r in result.select(*columns).collect()) == want and want
