"""Every operator against a plain version of itself, on awkward rows and on empty tables."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from meterstone.llm import decontamination, language, lines, neighbours, ngram_join, packing, pii, quality, sharding, substrings
from meterstone.llm.common import ranked
from meterstone.llm.components import components, open_groups
from tests.llm.helpers import LOWER, SCHEMA, WORD, Unions, awkward_rows, frame, joined_sets, sentence


@pytest.fixture(scope="module")
def rows():
    return awkward_rows()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return frame(spark, rows)


def empty(spark):
    return frame(spark, [])


def got(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


# Helpers


def test_ranks_have_no_gaps_and_no_ties(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), "id")
    numbered = defaultdict(list)
    for k, n in got(ranked(df, ["k"], F.col("id"), "n", buckets=7), "k", "n"):
        numbered[k].append(n)
    assert all(sorted(v) == list(range(len(v))) for v in numbered.values()) and len(numbered) == 3


@pytest.mark.parametrize("edges", [[], [(1, 2)], [(5, 5)], [(k, k + 1) for k in range(40)], [(0, k) for k in range(1, 50)] + [(100, 101), (101, 103)]])
def test_components(spark, edges):
    unions = Unions()
    for a, b in edges:
        unions.join(a, b)
    low = defaultdict(list)
    for x in unions:
        low[unions.top(x)].append(x)
    want = {x: min(v) for v in low.values() for x in v if len(v) > 1}
    assert dict(got(components(spark.createDataFrame(edges, "a long, b long")), "id", "root")) == want


# 1


def test_join_links_every_pair(docs, rows):
    want = joined_sets(rows)
    found = got(ngram_join.similar_sets(docs), "doc_id", "n_shingles", "component_id")
    assert sorted(map(str, found)) == sorted(str((i, *want[i])) if i is not None else str((None, 116, None)) for i, *_ in rows)


def test_join_finds_chains_and_borders(spark):
    """Texts that differ in one word each are linked as a chain; sets at the border of 80 percent decide exactly."""
    words = sentence(40, 60).split(" ")
    chain = []
    for step in range(12):
        words = words[:5 * step % 60] + [f"new{step}"] + words[5 * step % 60 + 1:]
        chain.append((step + 1, " ".join(words), None, None, None))
    long = sentence(41, 104).split(" ")
    border = [(100 + k, " ".join(long[:104 - k]), None, None, None) for k in (0, 19, 20, 21, 22)]
    data = chain + border + [(200 + k, sentence(50 + k, 30) + " " + sentence(60, 40), None, None, None) for k in range(30)]
    found = {r[0]: r[1:] for r in got(ngram_join.similar_sets(frame(spark, data), part_rows=4), "doc_id", "n_shingles", "component_id")}
    assert found == joined_sets(data)


def test_blocks_without_rounds_give_the_same(spark):
    data = [(k, sentence(k // 6, 50) + f" end{k} last{k % 3}", None, None, None) for k in range(60)]
    found = {r[0]: r[1:] for r in got(ngram_join.similar_sets(frame(spark, data), rounds=1, part_rows=3), "doc_id", "n_shingles", "component_id")}
    assert found == joined_sets(data)


def test_pairs_checked_are_no_square_of_a_family(spark, monkeypatch):
    """Sixty near copies are linked by about as many pairs as there are copies, not by all 1,770."""
    words, data, tried = sentence(70, 120).split(" "), [], []
    for k in range(60):
        own = list(words)
        own[2 * k % 120] = f"own{k}"
        data.append((k, " ".join(own), None, None, None))
    checked = ngram_join.checked
    monkeypatch.setattr(ngram_join, "checked", lambda pairs, kept: (tried.append(pairs.count()), checked(pairs, kept))[1])
    found = {r[0]: r[1:] for r in got(ngram_join.similar_sets(frame(spark, data), rounds=1), "doc_id", "n_shingles", "component_id")}
    assert found == joined_sets(data) and 59 <= sum(tried) <= 59 * 10


def test_trees_that_break_are_walked_again(spark, monkeypatch):
    """Two families whose members nearly link: pairs between them get through the bitmaps, and the one link among them is found."""
    words, data, tried = sentence(71, 120).split(" "), [], []
    for k in range(24):
        own = list(words)
        if k % 2:
            own[:17] = [f"other{j}" for j in range(17)]
        own[100 + k % 12] = f"own{k}"
        data.append((k, " ".join(own), None, None, None))
    checked = ngram_join.checked
    monkeypatch.setattr(ngram_join, "checked", lambda pairs, kept: (tried.append(pairs.count()), checked(pairs, kept))[1])
    for extra in ([], [(50, " ".join([*(f"other{j}" for j in range(8)), *words[8:]]), None, None, None)]):
        tried.clear()
        found = {r[0]: r[1:] for r in got(ngram_join.similar_sets(frame(spark, data + extra), rounds=1), "doc_id", "n_shingles", "component_id")}
        assert found == joined_sets(data + extra)
    assert len({c for _, c in joined_sets(data).values()}) > 1


def test_a_forest_joins_all_components_likeliest_first():
    pairs = pd.DataFrame([(1, 2, 1, 2, 90), (3, 4, 1, 2, 95), (2, 5, 2, 5, 80), (1, 5, 1, 5, 85), (7, 8, 7, 8, 70)], columns=["a", "b", "ca", "cb", "score"])
    rows = [tuple(r) for r in ngram_join.spanning(pairs)[["a", "b", "tree"]].itertuples(index=False)]
    assert [r[:2] for r in rows] == [(3, 4), (1, 5), (7, 8)]
    assert rows[0][2] == rows[1][2] is not None and rows[2][2] is None
    assert len(ngram_join.spanning(pairs[:0])) == 0


def test_join_of_nothing(spark):
    assert ngram_join.similar_sets(empty(spark)).count() == 0
    assert got(ngram_join.similar_sets(frame(spark, [(1, None, None, None, None)])), "doc_id", "n_shingles", "component_id") == [(1, 0, 1)]


# 2


@pytest.mark.parametrize("shards", [1, 4, 7, 40])
def test_shards_are_even_and_slots_gapless(docs, rows, shards):
    found = got(sharding.shard_documents(docs, shards), "doc_id", "size", "text_crc32", "shard", "slot")
    assert sorted(f[0] for f in found if f[0]) == sorted(r[0] for r in rows if r[0])
    texts = {r[0]: (r[1] or "").encode() for r in rows}
    assert all(f[1] == len(texts[f[0]]) + 16 and f[2] == zlib.crc32(texts[f[0]]) for f in found)
    by = defaultdict(list)
    for f in found:
        by[f[3]].append(f[4])
    counts = [len(by.get(s, [])) for s in range(shards)]
    assert max(counts) - min(counts) <= 1 and set(by) <= set(range(shards))
    assert all(sorted(v) == list(range(len(v))) for v in by.values())


def test_copies_share_a_shard_where_they_fit(spark):
    data = [(k, sentence(k // 5 if k < 200 else k, 20), None, None, None) for k in range(400)] + [(1000 + k, "hot", None, None, None) for k in range(200)]
    found = got(sharding.shard_documents(frame(spark, data), 10), "text_crc32", "shard")
    places = defaultdict(set)
    for crc, shard in found:
        places[crc].add(shard)
    hot = zlib.crc32(b"hot")
    assert len(places.pop(hot)) >= 4  # 200 rows, 60 a shard
    assert sum(len(p) for p in places.values()) <= len(places) + 4


def test_groups_stay_whole_where_all_rows_have_copies(spark):
    """Groups of 2 to 11 rows and no row without a copy, and a group of 0.8 of a shard: hardly any has to be cut."""
    data = [(100 * k + j, f"text {k}", None, None, None) for k in range(150) for j in range(2 + k % 10)] + [(10 ** 6 + j, "large", None, None, None) for j in range(100)]
    places, counts = defaultdict(set), defaultdict(int)
    for crc, shard in got(sharding.shard_documents(frame(spark, data), 8), "text_crc32", "shard"):
        places[crc].add(shard)
        counts[shard] += 1
    assert sum(counts.values()) == len(data) and max(counts.values()) - min(counts.values()) <= 1 and len(counts) == 8
    assert sum(len(p) > 1 for p in places.values()) <= 8 and len(places[zlib.crc32(b"large")]) == 1


def test_rows_with_several_hubs_are_even(spark):
    links = spark.range(200).select(F.col("id").alias("row_id"), F.explode(F.array(F.floor(F.col("id") / 10), F.lit(100) + F.floor((F.col("id") + 5) / 10))).alias("hub"))
    found = dict(got(sharding.assign(spark.range(300).select(F.col("id").alias("row_id")), links, 5), "row_id", "shard"))
    assert sorted(found) == list(range(300)) and all(list(found.values()).count(s) == 60 for s in range(5))


@pytest.mark.parametrize("even", [True, False])
def test_plan_of_groups_places_each_row_once(even):
    for sizes, room in [({11: 7, 5: 20, 2: 31}, [60, 60, 60, 59]), ({60: 1, 25: 1}, [20, 20, 20, 25]), ({2: 30}, [15, 15, 15, 15]), ({3: 4}, [40] * 3), ({}, [1])]:
        whole, parts = sharding.deal(sizes, room, even)
        used = defaultdict(int)
        for size, first, last, shard in whole:
            used[shard] += size * (last - first)
        for size, _, start, stop, shard in parts:
            used[shard] += stop - start
        for size, count in sizes.items():
            done = [n for s, first, last, _ in whole if s == size for n in range(first, last)]
            cut = sorted({p[1] for p in parts if p[0] == size})
            assert sorted(done + cut) == list(range(count))
            assert all(sum(p[3] - p[2] for p in parts if p[:2] == (size, n)) == size for n in cut)
        assert all(used[s] <= r for s, r in enumerate(room)) and len({p[:2] for p in parts}) <= len(room)


def test_sharding_uses_no_python(docs):
    plan = docs._sc._jvm.PythonSQLUtils.explainString(sharding.shard_documents(docs, 3)._jdf.queryExecution(), "formatted")
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))


def test_sharding_of_nothing(spark):
    assert sharding.shard_documents(empty(spark)).count() == 0


# 3


def vectors():
    rng = np.random.default_rng(3)
    v = rng.normal(size=(600, 12)).astype(np.float32)
    data = [(int(k), [float(x) for x in v[k]]) for k in range(600)]
    data += [(600 + k, data[0][1]) for k in range(40)]  # a common vector
    bad = [(1000, None), (1001, [0.0] * 12), (1002, [float("nan")] * 12), (1003, [None] + [1.0] * 11), (1004, [1.0, 2.0]), (None, [1.0] * 12), (1005, [float("inf")] * 12)]
    return data, bad


def test_neighbours_are_nearly_exact(spark):
    data, bad = vectors()
    df = spark.createDataFrame(data + bad + data[:3], "vec_id long, embedding array<float>").withColumn("key", F.lit(1)).withColumn("v", F.lit(2))
    asked = spark.range(0, 2000, 20).select(F.col("id").alias("vec_id"))
    found = defaultdict(list)
    for q, rank, i, score in got(neighbours.search(df, asked, chunk_rows=50), "query_id", "rank", "vec_id", "score"):
        found[q].append((rank, i, score))
    ids, m = np.array([d[0] for d in data]), np.array([d[1] for d in data], dtype=np.float32).astype(np.float64)
    queries = [i for i in ids if i % 20 == 0]
    assert sorted(found) == sorted(queries)
    hits = 0
    for q in queries:
        d = np.sqrt(((m - m[q]) ** 2).sum(axis=1))
        best = sorted((x, i) for x, i in zip(d.tolist(), ids.tolist()) if i != q)[:10]
        mine = sorted(found[q])
        assert [r for r, _, _ in mine] == list(range(1, 11)) and [(s, i) for _, i, s in mine] == sorted((s, i) for _, i, s in mine)
        assert all(abs(s - d[i]) < 1e-12 for _, i, s in mine)
        hits += len({i for _, i, _ in mine} & {i for _, i in best})
    assert hits >= 0.9 * 10 * len(queries)
    assert [i for _, i, _ in sorted(found[0])] == list(range(600, 610))  # ties go to smaller ids


def test_lone_vectors_get_all_their_neighbours(spark):
    """Tight clusters and outliers: lists of the outliers hold fewer vectors than are asked for."""
    rng = np.random.default_rng(8)
    tight = np.repeat(rng.normal(size=(80, 16)), 12, axis=0) + rng.normal(size=(960, 16)) * 0.001
    v = np.concatenate([tight, rng.normal(size=(60, 16)) * 30])
    df = spark.createDataFrame([(k, [float(x) for x in row]) for k, row in enumerate(v)], "vec_id long, embedding array<double>")
    for k in (10, 200):
        found = defaultdict(list)
        for q, rank, i, score in got(neighbours.search(df, df.where("vec_id >= 940").select("vec_id"), k=k), "query_id", "rank", "vec_id", "score"):
            found[q].append((rank, i))
        assert sorted(found) == list(range(940, 1020))
        for q, mine in found.items():
            assert [r for r, _ in sorted(mine)] == list(range(1, k + 1)) and len({i for _, i in mine} - {q}) == k


def test_few_or_no_neighbours(spark):
    kind = "vec_id long, embedding array<float>"
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])], kind)
    assert sorted(got(neighbours.search(few, few.where("vec_id = 0")), "query_id", "rank", "vec_id")) == [(0, 1, 2), (0, 2, 1)]
    none = spark.createDataFrame([], kind)
    assert neighbours.search(none, none).count() == 0


# 4


def check_packing(found, rows, capacity=1024):
    by, sequences = defaultdict(list), defaultdict(list)
    for r in found:
        by[r[0]].append(r)
        sequences[r[5]].append((r[6], r[3]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return by, sequences


def test_packing_is_a_round_trip(docs, rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    found = got(packing.pack(docs, with_ids=True), "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "ids")
    check_packing(found, rows)
    texts = defaultdict(list)
    for r in rows:
        texts[r[0]].append(r[1])
    for doc_id, same in texts.items():
        ids = tokenizer.encode(same[0] or "", add_special_tokens=False).ids + [2]
        parts = sorted((r for r in found if r[0] == doc_id), key=lambda r: r[1])
        assert len(parts) == len(same) * -(-len(ids) // 1024)
        for _, _, start, length, crc, _, _, raw in parts:
            piece = np.array(ids[start:start + length], "<u4").tobytes()
            assert raw == piece and crc == zlib.crc32(piece)


@pytest.mark.parametrize("text", ["", " ", "a  b", " a b ", "a \n b\tc  d", "it's we'll  x　y z w", "a\x85 b", "x\x1c y", "é è 12 3 !? <|endoftext|> 'm", "​ q ﻿"])
def test_chunks_give_the_ids_of_the_whole_text(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    mine = np.frombuffer(packing.ChunkEncoder(packing.default_vocabulary(), packing.default_added()).ids(text), "<u4").tolist()
    assert mine == tokenizer.encode(text, add_special_tokens=False).ids


def test_added_tokens_have_the_ids_of_the_tokenizer(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    mark = "<|endoftext|>"
    texts = [f"end{mark}start", mark, f"{mark}{mark} a", f" a {mark} b ", f"<|endoftext|{mark}>", "<|ENDOFTEXT|> <|endoftext|", f"x\n{mark}\n y  {mark}z", f"a b {mark} " * 400]
    found = defaultdict(bytes)
    for doc_id, _, raw in sorted(got(packing.pack(frame(spark, [(k, t, None, None, None) for k, t in enumerate(texts)]), with_ids=True), "doc_id", "piece", "ids")):
        found[doc_id] += bytes(raw)
    for k, text in enumerate(texts):
        assert np.frombuffer(found[k], "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids + [2], text


def test_fullest_combination():
    from itertools import combinations

    lengths, counts = [3, 5, 7], {3: 2, 5: 1, 7: 2}
    every = [3, 3, 5, 7, 7]
    for room in range(1, 30):
        best = max(sum(c) for n in range(6) for c in combinations(every, n) if sum(c) <= room)
        picked = packing.fullest(lengths, counts, room)
        assert sum(picked) == best and all(picked.count(x) <= counts[x] for x in picked)


def test_plan_packs_every_piece_once():
    histogram = {1024: 5, 700: 40, 324: 30, 100: 500, 3: 7, 1: 1000}
    rows_ = packing.plan(histogram, 1024)
    assert {x: sum(r[2] - r[1] for r in rows_ if r[0] == x) for x in histogram} == histogram
    total = sum(k * v for k, v in histogram.items())
    assert max(r[4] + (r[2] - r[1]) // r[3] for r in rows_) <= -(-total // 1024) + 2


def test_packing_of_nothing(spark):
    assert packing.pack(empty(spark)).count() == 0


# 5


def test_lines_keep_one_of_each_component(docs, rows):
    unions, first, seen = Unions(), {}, []
    real = sorted({r[:2] for r in rows if r[0] is not None and r[1] is not None})
    places = [(i, n, lines.plain(x)) for i, t in real for n, x in enumerate(t.split("\n")) if len(lines.plain(x)) >= 24]
    for k, (_, _, a) in enumerate(places):
        for _, _, b in places[:k]:
            if lines.alike(lines.shingle_set(a, 9), lines.shingle_set(b, 9)):
                unions.join(a, b)
    gone = defaultdict(set)
    for i, n, x in places:
        if unions.top(x) in first:
            gone[i].add(n)
        first.setdefault(unions.top(x), (i, n))
    want = []
    for i, t, *_ in rows:
        left = None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if i is None or n not in gone[i])
        want.append((i, left))
    done = lines.remove_lines(docs)
    assert sorted(map(str, got(done, "doc_id", "text"))) == sorted(map(str, want))
    assert done.columns == [*docs.columns, "line_counts"]


def test_short_lines_take_part(spark, tmp_path):
    """Lines of any length but blank ones: exact repeats go, in one document and across documents."""
    texts = ["wh the.\nwh the.\n\nx\nall rights reserved.", "All rights reserved. \nX\n\ny\nwh the", "\n \n", "wh the.", "all rights reversed."]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = ["wh the.\n\nx\nall rights reserved.", "\ny\nwh the", "\n \n", "", "all rights reversed."]
    found = got(lines.op5_lines(spark, str(tmp_path)), "doc_id", "n_lines", "n_removed", "kept_sha256")
    assert sorted(found) == [(k, a.count("\n") + 1, gone, hashlib.sha256(b.encode()).hexdigest())
                             for k, (a, b, gone) in enumerate(zip(texts, want, (1, 2, 0, 1, 0)))]


def test_fuzzy_lines_of_all_sizes_are_found(spark):
    """One added sign in lines of 180 to 3000 signs, across the size where signatures change."""
    data = []
    for k, n in enumerate((30, 40, 45, 50, 70, 80, 90, 110, 200, 500)):
        line = sentence(300 + k, n)
        data += [(2 * k, line, None, None, None), (2 * k + 1, line[:len(line) // 2] + "#" + line[len(line) // 2 + 1:], None, None, None)]
    found = dict(got(lines.remove_lines(frame(spark, data)), "doc_id", "text"))
    assert all(found[2 * k] and not found[2 * k + 1] for k in range(10))


def test_one_changed_sign_in_ordinary_lines_is_found(spark):
    """Lines of 36 to 130 signs with one sign changed in the middle, also across the size where shingles change."""
    data = []
    for k, n in enumerate((36, 50, 64, 80, 88, 90, 100, 118, 119, 120, 130)):
        line = sentence(700 + k, 30)[:n - 1] + "."
        data += [(2 * k, line, None, None, None), (2 * k + 1, line[:n // 2] + "#" + line[n // 2 + 1:], None, None, None)]
    found = dict(got(lines.remove_lines(frame(spark, data)), "doc_id", "text"))
    assert all(found[2 * k] and not found[2 * k + 1] for k in range(11))


def test_bands_with_several_components(spark):
    pairs = spark.createDataFrame([(1, (k, k), (k % 2, 0), sentence(400 + k % 2, 12) + f" {k}", 10) for k in range(6)],
                                  "band long, id struct<h1:long,h2:long>, comp struct<h1:long,h2:long>, text string, rows long")
    assert lines.compare_bands(pairs, 9, 2).count() == 0  # alike ones share a component already
    split = pairs.withColumn("comp", F.col("id"))
    unions = Unions()
    for a, b in got(lines.compare_bands(split, 9, 2), "a", "b"):
        unions.join(a[0], b[0])
    assert len({unions.top(k) for k in range(6)}) == 2


def test_bands_of_one_family_share_a_task(spark):
    """Bands whose smallest component is the same go to as many tasks as their rows fill; the links are the same."""
    bands = spark.createDataFrame([(band, (k, k), (k, 0), sentence(400 + k // 4, 12) + f" {k}") for band in range(9) for k in range(4 * (band % 3), 4 * (band % 3) + 4)],
                                  "band long, id struct<h1:long,h2:long>, comp struct<h1:long,h2:long>, text string")
    groups = open_groups(bands, "band", 800, 8)
    assert sorted(got(groups, "band", "rows", "low.h1", "tasks")) == [(b, 4, 4 * (b % 3), 2) for b in range(9)]
    unions = Unions()
    for a, b in got(lines.compare_bands(bands.join(groups, "band"), 9, 800, deal="xxhash64(low, pmod(cell, tasks))"), "a", "b"):
        unions.join(a[0], b[0])
    assert len({unions.top(k) for k in range(12)}) == 3


def test_bounds_rule_out_most_pairs_and_no_alike_ones():
    """Short and long lines, repeated shingles, and lines shorter than a shingle; a bound below the similarity would lose a link."""
    some = [lines.plain(sentence(900 + k, 1 + k % 40)) for k in range(120)]
    some += [x[:len(x) // 2] + "#" + x[len(x) // 2 + 1:] for x in some] + ["x", "y", "ab " * 30, "ab " * 31]
    held = lines.Bounds(9).of(some)
    i, j = lines.cell_pairs(np.array([len(some)]))
    likely = lines.Bounds.may_be_alike(held, held, i, j)
    alike = np.array([lines.either_alike(lines.shingle_sets(some[a], 9), lines.shingle_sets(some[b], 9)) for a, b in zip(i, j)])
    assert len(i) == len(some) * (len(some) - 1) // 2 and alike.sum() >= 60
    assert likely[alike].all() and likely[~alike].mean() < 0.2


def test_unlike_short_lines_share_few_bands(spark):
    """Short lines made of the same syllables; of 300 unlike ones few go on to be compared, of those with one changed sign all do."""
    rng = random.Random(5)
    parts = ["th", "wh", "es", "nd", "an", "or", "ing", "he", "at", "er", "st", "o", "ve", "li", "cra", "mu"]
    some = ["".join(rng.choice(parts) + " " * (rng.random() < 0.3) for _ in range(40)).strip() for _ in range(300)]
    twins = [x[:30] + "#" + x[31:] for x in some[:20]]
    docs = spark.createDataFrame([(k, k, x) for k, x in enumerate(some + twins)], "doc_id long, text_key long, text string")
    signed = lines.stored(lines.signed_lines(docs, 9, 1, 400_000), "lines")
    members = lines.shared_bands(signed, lines.repeated_bits(signed, 1 << 20), 1 << 20)
    h1, h2 = lines.line_keys(twins + some[:20])
    found = {tuple(r.id) for r in members.select("id").distinct().collect()}
    assert set(zip(h1.tolist(), h2.tolist())) <= found and len(found) < 80


def test_long_lines_are_counted_where_bitmaps_are_full():
    """Lines of 400 to 900 signs that share half their shingles: 256 bits say little of them, the places of their shingles rule them out."""
    whole = [sentence(1200 + k, 200)[:400 + 25 * k] for k in range(20)]
    some = whole + [a[:len(a) // 2] + b[len(b) // 2:] for a, b in zip(whole, whole[1:])] + [x[:-1] + "#" for x in whole]
    held = lines.Bounds(9).of(some)
    i, j = lines.cell_pairs(np.array([len(some)]))
    likely = lines.Bounds.may_be_alike(held, held, i, j)
    alike = np.array([lines.either_alike(lines.shingle_sets(some[a], 9), lines.shingle_sets(some[b], 9)) for a, b in zip(i, j)])
    assert alike.sum() >= 20 and likely[alike].all() and likely[~alike].mean() < 0.02


def test_copies_in_several_tasks_are_one_line_in_bands(spark):
    data = [(k, sentence(950 + k % 2, 12), None, None, None) for k in range(12)]
    docs = frame(spark, data).select("doc_id", F.xxhash64("text").alias("text_key"), "text").repartition(6, "doc_id")
    signed = lines.stored(lines.signed_lines(docs, 9, 1, 1), "lines")
    members = lines.shared_bands(signed, lines.repeated_bits(signed, 1 << 20), 1 << 20)
    assert signed.count() == 12 and members.groupBy("id", "band").count().where("count > 1").isEmpty()
    assert members.select("id").distinct().count() in (0, 2)


def test_lines_of_nothing(spark):
    assert lines.remove_lines(empty(spark)).count() == 0
    assert got(lines.remove_lines(frame(spark, [(1, None, None, None, None), (2, "", None, None, None)])), "doc_id", "text") in ([(1, None), (2, "")], [(2, ""), (1, None)])


# 6


ITEMS = [(1, sentence(8, 70)), (2, sentence(70, 5)), (3, None), (4, "..."), (None, sentence(9, 20)), (5, sentence(8, 70)), (2, sentence(71, 14)), (6, "One TWO")]


def plain_hits(text, items, window=13):
    find = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+").findall
    words, hit, names = find((text or "").translate(LOWER)), set(), set()
    for name, item in items:
        own = find((item or "").translate(LOWER))
        if name is None or not own:
            continue
        size = min(window, len(own))
        windows = {tuple(own[k:k + size]) for k in range(len(own) - size + 1)}
        for k in range(len(words) - size + 1):
            if tuple(words[k:k + size]) in windows:
                hit |= set(range(k, k + size))
                names.add(str(name))
    joined = ",".join(sorted(names))
    return len(words), len(hit), len(names), hashlib.sha256(joined.encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(words)


@pytest.mark.parametrize("block_words", [10, 1_000_000])
def test_decontamination_equals_plain_search(spark, docs, rows, block_words):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("n_words", F.lit(1))
    found = got(decontamination.with_hits(decontamination.decontaminate(docs, bench, block_words=block_words)),
                "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert sorted(map(str, found)) == sorted(str((r[0], *plain_hits(r[1], ITEMS))) for r in rows)


def test_longest_match_and_place(spark):
    doc = sentence(500, 30) + " " + " ".join(sentence(8, 70).split(" ")[3:40]) + " " + sentence(501, 9)
    found = decontamination.decontaminate(frame(spark, [(1, doc, None, None, None)]), spark.createDataFrame(ITEMS[:1], "item_id long, text string"))
    first = min(found.first()["matches"], key=lambda m: m["start"])
    assert (first["start"], first["item_start"], first["longest"], first["item_id"]) == (30, 3, 37, "1")


def test_decontamination_of_nothing(spark, docs, rows):
    none = spark.createDataFrame([], "item_id long, text string")
    assert not decontamination.with_hits(decontamination.decontaminate(docs, none)).where("contaminated or n_hit > 0").count()
    assert decontamination.decontaminate(empty(spark), spark.createDataFrame(ITEMS, "item_id long, text string")).count() == 0


# 7


def test_language_learns_and_rejects(spark, docs):
    alphabets = {"aa": "abcdef", "bb": "ghijkl", "cc": "uvwxyz"}
    rng = np.random.default_rng(1)

    def text(lang, n):
        return " ".join("".join(rng.choice(list(alphabets[lang]), 5)) for _ in range(n))

    data = [(k, text(lang, 5 + k % 30), lang, None, None) for k in range(120) for lang in [list(alphabets)[k % 3]]]
    model = language.fit_language(frame(spark, data + awkward_rows()[:8]), epochs=3)
    probe = frame(spark, [(k, text(list(alphabets)[k % 3], 8), None, None, None) for k in range(30)] + [(100, None, None, None, None), (101, "12 !? \n", None, None, None), (102, "", None, None, None)])
    found = {r["doc_id"]: r["language"] for r in language.predict_language(probe, model).collect()}
    assert sum(found[k]["lang_pred"] == list(alphabets)[k % 3] for k in range(30)) >= 28
    assert all(found[k]["lang_pred"] == "und" and found[k]["score"] == 0 and found[k]["rejected"] for k in (100, 101, 102))
    assert all(0 <= f["score"] <= 1 for f in found.values())
    assert language.predict_language(docs, model).count() == docs.count()


def test_language_without_labels(spark, docs):
    model = language.fit_language(empty(spark))
    assert model is None
    assert language.predict_language(docs, model).where("language.lang_pred != 'und'").count() == 0


def test_language_mean_in_steps_is_the_mean(monkeypatch):
    logits = np.random.default_rng(0).normal(size=(language.BUCKETS, 3))
    text = sentence(77, 400)
    whole = language.text_logits(text, logits)
    assert np.allclose(whole, logits[language.subwords(language.letters_of(text))].mean(axis=0))


# 8


@pytest.mark.parametrize("options", [{}, {"max_cells": 1 << 16, "chunk_words": 200}])
def test_windows_are_removed_where_a_smaller_id_has_them(spark, docs, rows, options):
    shared = sentence(600, 90)
    more = [(50 + k, sentence(610 + k, 20 * k) + " " + shared + " " + sentence(620 + k, 10), None, None, None) for k in range(4)]
    more += [(60, sentence(630, 49), None, None, None), (61, sentence(630, 49), None, None, None), (62, sentence(631, 50), None, None, None), (63, sentence(631, 50), None, None, None)]
    data = rows + more
    smallest = {}
    for i, t, *_ in data:
        words = WORD.findall(t or "")
        for k in range(len(words) - 49):
            if i is not None:
                w = tuple(words[k:k + 50])
                smallest[w] = min(smallest.get(w, i), i)
    want = []
    for i, t, *_ in data:
        words = WORD.findall(t or "")
        gone = {k + j for k in range(len(words) - 49) if i is not None and smallest[tuple(words[k:k + 50])] < i for j in range(50)}
        want.append((i, len(words), len(gone), " ".join(w for k, w in enumerate(words) if k not in gone)))
    found = got(substrings.remove_repeats(frame(spark, data), **options), "doc_id", "n_words", "n_removed", "text")
    assert sorted(map(str, found)) == sorted(map(str, want))


def test_substrings_of_nothing(spark):
    assert substrings.remove_repeats(empty(spark)).count() == 0


# 9


PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (13 <= len(d) <= 19 and sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(d))) % 10 == 0):
                continue
            if kind == "phone" and not 9 <= len(d) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


TRICKY = [
    "a@b.c@d.e x@y.com_x@d.e .@-.- a@b a@b..c", "1.2.3.4.5 256.1.1.1 001.2.3.255 1.2.3 1.2.3.4", "4539 1488 0343 6467 and 4539-1488-0343-6468 4539148803436467",
    "+1 (389) 555-5010 +49 30 1234567. +12 +1 2", "é😀 me@x.org 𝒳 +44 20 7946 0958 10.0.0.1", "x" * 5000, "9" * 5000, "a." * 3000 + "@" + "b." * 3000 + "c",
    "+" + "1 " * 500, "0" * 16, "12 34 56 78 90 12 34 56 78 90", "mail: a%b@c-d.e-f",
]


def test_spans_equal_the_plain_search(spark, docs, rows):
    data = [(k, t, None, None, None) for k, t in enumerate(TRICKY)] + rows
    found = pii.find_spans(frame(spark, data)).select("doc_id", F.filter("spans", lambda x: x["kind"].isin(*PLAIN)).alias("s"))
    mine = [(r[0], [(x["kind"], x["start"], x["end"]) for x in r[1]]) for r in found.collect()]
    assert sorted(map(str, mine)) == sorted(str((r[0], plain_spans(r[1]))) for r in data)


def test_checksums_and_context(spark):
    data = [(1, "iban GB82 WEST 1234 5698 7654 32 ok", None, None, None), (2, "GB83 WEST 1234 5698 7654 32", None, None, None),
            (3, "ssn 123-45-6789", None, None, None), (4, "part 123-45-6789", None, None, None)]
    found = {r[0]: [(x["kind"], x["match"], round(x["score"], 1)) for x in r[1]] for r in pii.find_spans(frame(spark, data)).collect()}
    assert found[2] == [] and found[3] == [("ssn", "123-45-6789", 0.5)] and found[4] == []
    assert found[1][0][:2] == ("iban", "GB82 WEST 1234 5698 7654 32")


def test_spans_use_no_python(spark, docs):
    read = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = read._sc._jvm.PythonSQLUtils.explainString(pii.find_spans(read)._jdf.queryExecution(), "formatted")
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow", "Exchange"))
    assert pii.find_spans(docs.limit(0)).count() == 0


# 10


def test_quality_separates_good_from_bad(spark, docs):
    def bad(k):
        return " ".join(w + "$$$" for w in sentence(k, 60).upper().split(" "))

    data = [(k, sentence(k, 60) if k % 2 else bad(k), None, None, None) for k in range(400)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(300)] + [(301, None), (302, 7), (None, 1)], "doc_id long, quality int")
    model = quality.fit_quality(frame(spark, data), labels)
    scored = got(quality.score_quality(frame(spark, data), model), "doc_id", "quality_score")
    assert sum((s >= 0.5) == bool(k % 2) for k, s in scored if k >= 300) >= 97
    assert all(0 <= s <= 1 for _, s in got(quality.score_quality(docs, model), "doc_id", "quality_score"))


def test_quality_without_labels_or_with_one_kind(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.fit_quality(docs, none) == 0.5
    assert quality.fit_quality(docs, spark.createDataFrame([(1, 1), (2, 1), (7, 1)], "doc_id long, quality int")) == 1.0
    assert quality.score_quality(docs, 0.5).where("quality_score = 0.5").count() == docs.count()
    assert quality.fit_quality(empty(spark), none) == 0.5


# 2, its rounds


def test_allowed_moves_keep_every_shard_within_its_room():
    rng = np.random.default_rng(6)
    for shards in (2, 3, 7):
        for _ in range(60):
            wanted = {(a, b): int(rng.integers(0, 9)) for a in range(shards) for b in range(shards) if a != b and rng.random() < 0.5}
            room = rng.integers(0, 3, shards).tolist()
            moves = sharding.admitted(wanted, room)
            assert all(0 < n <= wanted[pair] for pair, n in moves.items())
            for s in range(shards):
                assert sum(n for (_, b), n in moves.items() if b == s) - sum(n for (a, _), n in moves.items() if a == s) <= room[s]
            # Nothing more could go: no room is left for a move, and no circle of moves.
            left = {pair: n - moves.get(pair, 0) for pair, n in wanted.items()}
            free = [room[s] - sum(n for (_, b), n in moves.items() if b == s) + sum(n for (a, _), n in moves.items() if a == s) for s in range(shards)]
            assert not any(n and free[b] > 0 for (_, b), n in left.items()) and not sharding.circle(left)
    assert sharding.admitted({(0, 1): 4, (1, 0): 3}, [0, 0]) == {(0, 1): 3, (1, 0): 3}
    assert sharding.admitted({(0, 1): 2, (1, 2): 2, (2, 0): 1}, [0, 0, 0]) == {(0, 1): 1, (1, 2): 1, (2, 0): 1}
    assert sharding.admitted({(0, 1): 2, (1, 2): 2}, [0, 0, 1]) == {(0, 1): 1, (1, 2): 1}


def plain_rounds(shard_of, hub_of, quotas):
    """Pieces of hubs after each round of a plain propagation without ties by hash: a row moves while its target has room."""
    shard_of, history = dict(shard_of), []
    while True:
        votes = defaultdict(lambda: defaultdict(int))
        for row, hub in hub_of.items():
            votes[hub][shard_of[row]] += 1
        pieces = sum(map(len, votes.values()))
        if history and pieces >= history[-1]:
            return history
        history.append(pieces)
        counts = defaultdict(int)
        for s in shard_of.values():
            counts[s] += 1
        for row, hub in hub_of.items():
            target = max(votes[hub], key=lambda s: (votes[hub][s], s))
            if target != shard_of[row] and counts[target] < quotas[target]:
                counts[target] += 1
                counts[shard_of[row]] -= 1
                shard_of[row] = target


def test_rounds_run_and_bring_copies_together(spark, monkeypatch):
    """The query's own path: labels really move, round by round, and the cut ends no worse than that of a plain propagation."""
    data = [(k, f"copied {k % 40}" if k < 200 else f"alone {k}", None, None, None) for k in range(500)] + [(1000 + k, "hot", None, None, None) for k in range(150)]
    seen, begun, kept = [], [], sharding.stored

    def watched(df, label):
        out = kept(df, label)
        if label == "held":
            seen.append(out.count())
        if label == "start":
            begun.append({r["row_id"]: r["shard"] for r in out.collect()})
        if label == "links":
            begun.append({r["row_id"]: r["hub"] for r in out.collect()})
        return out

    monkeypatch.setattr(sharding, "stored", watched)
    found = got(sharding.shard_documents(frame(spark, data), 8), "text_crc32", "shard")
    assert len(seen) >= 2 and seen[0] > 3 * len(set(begun[0].values())) and seen[1] < seen[0] / 2  # the start is cut, the first round mends most
    places = defaultdict(set)
    for crc, shard in found:
        places[crc].add(shard)
    hub_of, start = begun
    plain = plain_rounds(start, hub_of, [82] * 2 + [81] * 6)
    repeated = {zlib.crc32(f"copied {k}".encode()) for k in range(40)} | {zlib.crc32(b"hot")}
    assert sum(len(places[c]) for c in repeated) <= plain[-1] and sum(len(places[c]) > 1 for c in repeated) <= 2


# 7 and 10 against plain predictors, and on nothing


def test_predictions_are_those_of_a_plain_predictor(spark):
    """The same model, word by word in Python: the mean of the rows of all subwords, softmax, the best."""
    alphabets = {"aa": "abcdef", "bb": "ghijkl"}
    rng = np.random.default_rng(3)
    data = [(k, " ".join("".join(rng.choice(list(alphabets[lang]), 4)) for _ in range(9)), lang, None, None) for k in range(60) for lang in [list(alphabets)[k % 2]]]
    model = language.fit_language(frame(spark, data), epochs=2)
    probes = [(k, t, None, None, None) for k, t in enumerate(["abc ghi", "Abc! 12", "ghi" * 400, "é", "ab\ncd", "zz zz"])]
    found = {r["doc_id"]: r["language"] for r in language.predict_language(frame(spark, probes), model).collect()}
    for k, text, *_ in probes:
        rows_ = [model.logits[i].astype(float) for i in language.subwords(language.letters_of(text))]
        z = [sum(column) / len(rows_) / model.temperature for column in zip(*rows_)]
        p = [np.exp(x - max(z)) / sum(np.exp(y - max(z)) for y in z) for x in z]
        best = max(range(len(p)), key=lambda i: (p[i], -i))
        assert found[k]["lang_pred"] == model.names[best] and abs(found[k]["score"] - p[best]) < 1e-6 and found[k]["rejected"] == (p[best] < model.least_score)
    assert language.predict_language(empty(spark), model).count() == 0
    assert {"lang", "source", "id"} <= set(language.predict_language(empty(spark), model).columns)


def test_scores_are_those_of_a_plain_scorer(spark):
    """Sizes of texts compressed with either dictionary, one text at a time, through the logistic curve."""
    import zstandard

    data = [(k, sentence(k, 60) if k % 2 else "buy now cheap cheap " * (5 + k % 7), None, None, None) for k in range(80)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(80)], "doc_id long, quality int")
    model = quality.fit_quality(frame(spark, data), labels)
    probes = [(100 + k, t, None, None, None) for k, t in enumerate([sentence(900, 50), "cheap cheap buy now " * 9, "a", "é" * 30])]
    found = {r["doc_id"]: r["quality_score"] for r in quality.score_quality(frame(spark, probes), model).collect()}
    for k, text, *_ in probes:
        good, bad = (len(zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_dict_id=False).compress(text.encode()))
                     for d in (model.good, model.bad))
        z = model.slope * (bad - good) / (bad + good) + model.intercept
        assert abs(found[k] - 1 / (1 + np.exp(-z))) < 1e-6, text
    assert found[100] > 0.5 > found[101]
    assert quality.score_quality(empty(spark), model).count() == 0


def test_blocks_of_a_benchmark_come_one_at_a_time(spark, docs, monkeypatch):
    alive, made = [], decontamination.test_blocks

    def watched(*args):
        for block in made(*args):
            alive.append(block)
            yield block

    monkeypatch.setattr(decontamination, "test_blocks", watched)
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    found = decontamination.decontaminate(docs, bench, block_words=40)
    assert len(alive) > 2 and found.count() == docs.count() and hasattr(found, "stored_at")
