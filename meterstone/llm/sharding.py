"""Sharding by balanced label propagation, with DataFrame functions only.

Documents that share a link go to the same shard as far as room allows, and all shards hold the same number of documents, one
more or less (law ``rows``). A link is a hub: a row (doc_id, hub) says that the document hangs on that hub; all documents of a
hub are neighbours. So a group of copies is one row per document, never a row per pair.

1. Linked documents start in an even deal over all shards.
2. Rounds: each hub counts its documents per shard and calls them to the shard that holds most of them (ties by a hash). A document
   follows the hub that has most documents at its target. How many may go from one shard to another is a table of pairs of
   shards on the driver: moves there and back are exchanged, and free room is used up along chains, so no shard ever
   holds more than its quota. Among those that want to go, hubs with many documents already there come first. A hub larger than a
   shard fills one shard after the other. Rounds go on as long as they bring hubs together. Hubs that are still cut then, as may be where
   all rows have copies and no shard has free room, are put whole into the room that the others leave, if that cuts less.
3. Documents without links fill what is left. As linked documents never take more than a shard may hold, the counts come out
   exactly even.

A round's joins are on documents, and on hubs; hubs with more than a thousandth of all documents, fewer than a thousand, are sent to all
tasks, so no hub is one task's work. Counts are combined inside the tasks first; ranks come from ``common.ranked``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from meterstone.llm.common import ranked, stored, table


def hash_of(*columns) -> Column:
    return F.xxhash64(*columns, F.lit("shard"))


def deal(sizes: dict[int, int], room: list[int], even: bool) -> tuple[list[tuple], list[tuple]]:
    """Where the groups of each size go: rows (size, first, last, shard) for whole ones, (size, number, start, stop, shard) for parts.

    Groups of one size are numbered. The largest come first, to the shards with most room (``even``) or to the first ones with
    enough. A group that fits nowhere is cut, and its first part fills the shard with most room, so at most as many
    groups are cut as there are shards. ``room`` must hold all.
    """
    if sum(size * n for size, n in sizes.items()) > sum(room):
        raise ValueError("the shards have no room for all rows")
    room, whole, parts = list(room), [], []
    for size in sorted(sizes, reverse=True):
        count, most = sizes[size], [r // size for r in room]
        fits = min(count, sum(most))
        if even:  # the highest level of room that is left when at most ``fits`` groups go to the shards above it
            def taken(level: int) -> list[int]:
                return [min(m, max(0, (r - level) // size)) for m, r in zip(most, room)]

            low, high = 0, max(room)
            while low < high:
                middle = (low + high) // 2
                low, high = (low, middle) if sum(taken(middle)) <= fits else (middle + 1, high)
            take = taken(low)
            for j in sorted(range(len(room)), key=lambda j: take[j] * size - room[j]):
                if sum(take) < fits and take[j] < most[j]:
                    take[j] += 1
        else:
            take, left = [], fits
            for m in most:
                take.append(min(m, left))
                left -= take[-1]
        number = 0
        for shard, n in enumerate(take):
            if n:
                whole.append((size, number, number + n, shard))
                room[shard] -= n * size
                number += n
        fits = number
        for number in range(fits, count):
            start = 0
            while start < size:
                shard = max(range(len(room)), key=room.__getitem__)
                stop = min(size, start + room[shard])
                parts.append((size, number, start, stop, shard))
                room[shard] -= stop - start
                start = stop
    return whole, parts


def literal_table(spark: SparkSession, rows: list[tuple], names: list[str]) -> DataFrame:
    """A small table of numbers from the driver, without Python in its plan."""
    joined = ";".join(",".join(map(str, r)) for r in rows)
    cells = spark.range(1 if rows else 0).select(F.explode(F.split(F.lit(joined), ";")).alias("row")).select(F.split("row", ",").alias("c"))
    return cells.select(*[F.col("c")[i].cast("long").alias(name) for i, name in enumerate(names)])


def admitted(wanted: dict[tuple[int, int], int], room: list[int]) -> dict[tuple[int, int], int]:
    """How many rows may move from one shard to another: moves there and back cancel out, then free room is used up.

    A row that leaves makes room for another, so moves into free room go on along chains. No shard ends above its room.
    """
    room, left = list(room), dict(wanted)
    moves = {pair: min(n, wanted.get(pair[::-1], 0)) for pair, n in wanted.items()}
    left = {pair: n - moves[pair] for pair, n in wanted.items()}
    while True:
        done = True
        for (here, there), n in sorted(left.items(), key=lambda x: (-x[1], x[0])):
            go = min(n, room[there])
            if go:
                left[here, there] -= go
                moves[here, there] += go
                room[there] -= go
                room[here] += go
                done = False
        if done:
            break
    while cycle := circle(left):
        go = min(left[pair] for pair in cycle)
        for pair in cycle:
            left[pair] -= go
            moves[pair] += go
    return {pair: n for pair, n in moves.items() if n}


def circle(wanted: dict[tuple[int, int], int]) -> list[tuple[int, int]]:
    """Moves that form a circle of shards, so that all of them can be made without any room; none if there is no circle."""
    following: dict[int, list[int]] = {}
    for (here, there), n in sorted(wanted.items()):
        if n:
            following.setdefault(here, []).append(there)
    closed: set[int] = set()
    for start in following:
        path, on_path, open_ = [start], {start}, [iter(following[start])]
        while path:
            there = next((x for x in open_[-1] if x not in closed), None)
            if there is None:
                closed.add(path[-1])
                on_path.discard(path.pop())
                open_.pop()
            elif there in on_path:
                ring = path[path.index(there):] + [there]
                return list(zip(ring, ring[1:]))
            else:
                path.append(there)
                on_path.add(there)
                open_.append(iter(following.get(there, [])))
    return []


def targets_of(held: DataFrame, quotas: Column) -> DataFrame:
    """(hub, target, there, whole) from the rows of each hub in each shard: the shard that holds most of them, ties by a hash.

    A hub larger than a shard fills one after the other: a shard that holds nothing but the hub is full and calls no more.
    """
    calls = F.struct((F.col("votes") < quotas).cast("int").alias("open"), "votes", hash_of("hub", "shard").alias("tie"), F.col("shard").alias("target"))
    return held.groupBy("hub").agg(F.max(calls).alias("c"), F.count("*").alias("pieces")).where("c.open = 1").select(
        "hub", "c.target", F.col("c.votes").alias("there"))


def by_hub(links: DataFrame, hubs: DataFrame) -> DataFrame:
    """Join on hub. The hubs with more than a thousandth of all links, fewer than a thousand, go to all tasks; the others are shuffled."""
    large = links.where("large").join(F.broadcast(hubs.where("large").drop("large")), "hub")
    return large.unionByName(links.where("not large").join(hubs.where("not large").drop("large"), "hub"))


def by_hub_size(named: DataFrame, sizes: DataFrame) -> DataFrame:
    """Links of hubs with several rows, marked ``large``; the large hubs go to all tasks."""
    large = F.broadcast(sizes.where("large"))
    return named.join(large, "hub").unionByName(
        named.join(F.broadcast(sizes.where("large").select("hub")), "hub", "left_anti").join(sizes.where("not large"), "hub"))


def propagate(start: DataFrame, links: DataFrame, quotas: list[int]) -> DataFrame:
    """(row_id, shard) for linked rows after rounds of moves; no shard ever holds more than its quota.

    ``start`` has row_id and shard, ``links`` row_id, hub and whether the hub is large. Rounds go on as long as they lower the number
    of shards that hubs stand in, summed over all hubs.
    """
    spark, labels, pieces = start.sparkSession, start, None
    quota = F.element_at(F.array(*map(F.lit, quotas)), F.col("shard") + 1)
    while True:
        labelled = stored(links.join(labels, "row_id"), "labelled")
        held = stored(labelled.groupBy("hub", "large", "shard").agg(F.count("*").alias("votes")), "held")
        now = held.count()
        if pieces is not None and now >= pieces:
            return best
        best, pieces = labels, now
        targets = targets_of(held, quota).join(held.select("hub", "large").distinct(), "hub")
        # Each row follows the hub that has most rows at its target; one that is there already stays.
        follow = by_hub(labelled, targets).groupBy("row_id", "shard").agg(F.max(F.struct("there", "hub", "target")).alias("to"))
        wants = stored(follow.select("row_id", "shard", "to.*").where("shard != target and there < " + str(max(quotas))), "wants")
        cells = wants.groupBy("shard", "target", "there", "hub").agg(F.count("*").alias("n"))
        flows = {(r["shard"], r["target"]): r["n"] for r in cells.groupBy("shard", "target").agg(F.sum("n").alias("n")).collect()}  # shards squared
        if not flows:
            return best
        taken = {r["shard"]: r["n"] for r in labels.groupBy("shard").agg(F.count("*").alias("n")).collect()}
        allowed = admitted(flows, [q - taken.get(shard, 0) for shard, q in enumerate(quotas)])
        table_ = pair_table(spark, allowed)
        # The cells of a pair of shards in order: hubs with many rows at the target first. Sums over buckets, then inside each.
        bucket = F.concat(F.lpad((F.lit(999_999_999) - F.least("there", F.lit(999_999_999))).cast("string"), 9, "0"), F.lpad(F.pmod(hash_of("hub"), F.lit(64)).cast("string"), 2, "0"))
        dealt = cells.withColumn("bucket", bucket)
        pair_ = ["shard", "target"]
        before = Window.partitionBy(*pair_).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        sums = dealt.groupBy(*pair_, "bucket").agg(F.sum("n").alias("all")).withColumn("before", F.coalesce(F.sum("all").over(before), F.lit(0))).drop("all")
        inside = Window.partitionBy(*pair_, "bucket").orderBy("hub").rowsBetween(Window.unboundedPreceding, -1)
        placed = dealt.withColumn("inner", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(sums, [*pair_, "bucket"]).join(F.broadcast(table_), pair_)
        go = F.least("n", F.col("allowed") - F.col("before") - F.col("inner"))
        going = stored(placed.withColumn("go", go).where("go > 0").select("shard", "hub", "n", "go", (F.col("n") * 1000 > F.lit(sum(flows.values()))).alias("large")), "going")
        rows = wants.select("row_id", "shard", "hub", "target")
        cell = ["shard", "hub"]
        # Fewer than a thousand cells are large.
        moving = rows.join(F.broadcast(going.where("large").drop("large")), cell).unionByName(
            rows.join(F.broadcast(going.where("large").select(*cell)), cell, "left_anti").join(going.where("not large").drop("large"), cell))
        whole = moving.where("go = n").select("row_id", "target")
        some = ranked(moving.where("go < n").select("row_id", "target", "shard", "hub", "go"), cell, F.col("row_id"), "place", buckets=16).where("place < go")
        moves = whole.unionByName(some.select("row_id", "target"))
        labels = stored(labels.join(moves, "row_id", "left").select("row_id", F.coalesce("target", "shard").cast("int").alias("shard")), "shards")


def pair_table(spark: SparkSession, allowed: dict[tuple[int, int], int]) -> DataFrame:
    """(shard, target, allowed), a row for each pair of shards at most, without Python in its plan."""
    rows = [F.struct(F.lit(a).alias("shard"), F.lit(b).alias("target"), F.lit(n).cast("long").alias("allowed")) for (a, b), n in sorted(allowed.items())]
    if not rows:
        return spark.range(0).select(F.lit(0).alias("shard"), F.lit(0).alias("target"), F.col("id").alias("allowed"))
    return spark.range(1).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def place_whole(links: DataFrame, room: list[int]) -> DataFrame:
    """(row_id, shard) for linked rows, each with the largest of its hubs; groups stay whole where a shard has room for them."""
    spark = links.sparkSession
    sizes = links.groupBy("hub", "large").agg(F.count("*").alias("n"))
    groups = stored(by_hub(links, sizes).groupBy("row_id").agg(F.max(F.struct("n", "hub", "large")).alias("g")).select("row_id", "g.hub", "g.large"), "groups")
    numbered = stored(ranked(groups.groupBy("hub", "large").agg(F.count("*").alias("size")), ["size"], F.col("hub"), "number", buckets=16), "numbered")
    histogram = {r["size"]: r["n"] for r in numbered.groupBy("size").agg(F.count("*").alias("n")).collect()}
    whole, parts = min((deal(histogram, room, even) for even in (True, False)), key=lambda plan: len(plan[1]))
    spans = literal_table(spark, whole, ["size", "first", "last", "shard"])
    uncut = numbered.join(spans, "size").where("number >= first and number < last").select("hub", "large", "shard")
    # At most two pieces a shard.
    pieces = F.broadcast(numbered.join(literal_table(spark, parts, ["size", "number", "start", "stop", "shard"]), ["size", "number"]).select("hub", "start", "stop", "shard"))
    cut = ranked(groups.join(pieces.select("hub").distinct(), "hub", "left_semi"), ["hub"], F.col("row_id"), "place")
    cut = cut.join(pieces, "hub").where("place >= start and place < stop")
    return stored(by_hub(groups, uncut).select("row_id", F.col("shard").cast("int")).unionByName(cut.select("row_id", F.col("shard").cast("int"))), "shards")


def place_rest(placed: DataFrame, hubs: DataFrame, quotas: list[int]) -> DataFrame:
    """Rows of hubs that the rounds have left in several shards, put anew, whole hubs first, into the room the others leave.

    Where no shard has free room, moves alone may come to rest with small hubs still cut. The new places are taken if they cut less.
    """
    held = hubs.join(placed, "row_id").groupBy("hub").agg(F.count_distinct("shard").alias("pieces"))
    cut = stored(held.where("pieces > 1"), "cut")
    before = cut.agg(F.sum("pieces"), F.count("*")).first()
    if not before[1]:
        return placed
    again = stored(by_hub(hubs, cut.join(hubs.select("hub", "large").distinct(), "hub")).select("row_id").distinct(), "again")
    kept = placed.join(again, "row_id", "left_anti")
    taken = {r["shard"]: r["n"] for r in kept.groupBy("shard").agg(F.count("*").alias("n")).collect()}
    moved = place_whole(hubs.join(again, "row_id"), [q - taken.get(shard, 0) for shard, q in enumerate(quotas)])
    newer = stored(kept.unionByName(moved), "shards")
    after = hubs.join(newer, "row_id").groupBy("hub").agg(F.count_distinct("shard").alias("pieces")).agg(F.sum(F.col("pieces") - 1)).first()[0]
    return newer if after < before[0] - before[1] else placed


def assign(rows: DataFrame, links: DataFrame, shards: int) -> DataFrame:
    """(row_id, shard) for every row of ``rows`` (row_id, unique), numbers of rows per shard at most one apart.

    ``links`` has row_id and hub. Rows without links, and all rows when there are no links, are dealt evenly.
    """
    total = rows.count()
    quota = total // shards
    quotas = [quota + (shard < total % shards) for shard in range(shards)]
    named = links.where("hub is not null").select("row_id", F.xxhash64("hub").alias("hub")).distinct()
    sizes = named.groupBy("hub").agg(F.count("*").alias("n")).where("n > 1").select("hub", (F.col("n") * 1000 > total).alias("large"))
    hubs = stored(by_hub_size(named, sizes), "links")
    # The start is an even deal, so linked rows leave the room of the others free in every shard.
    linked = hubs.select("row_id").distinct().withColumn("all", F.lit(0))
    placed = stored(ranked(linked, ["all"], F.col("row_id"), "number").select("row_id", (F.col("number") % shards).cast("int").alias("shard")), "start")
    if not placed.isEmpty():
        placed = place_rest(propagate(placed, hubs, quotas), hubs, quotas)
    free = rows.select("row_id").join(placed, "row_id", "left_anti")
    numbered = ranked(free.withColumn("all", F.lit(0)), ["all"], F.col("row_id"), "number").drop("all")
    spark = rows.sparkSession
    shard_table = spark.range(shards).select(F.col("id").cast("int").alias("shard")).join(
        placed.groupBy("shard").agg(F.count("*").alias("n")), "shard", "left")
    lacking = shard_table.select("shard", (F.lit(quota) + (F.col("shard") < total % shards).cast("int") - F.coalesce("n", F.lit(0))).alias("lack"))
    through = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # ``shards`` rows
    ends = sorted((r["end"], r["shard"]) for r in lacking.withColumn("end", F.sum("lack").over(through)).where("lack > 0").collect())
    target = F.lit(None).cast("int")
    for end, shard in reversed(ends):
        target = F.when(F.col("number") < end, shard).otherwise(target)
    return placed.unionByName(numbered.select("row_id", target.alias("shard")))


def shard_documents(docs: DataFrame, shards: int = 40) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot): equal texts are linked. Slots count from 0 in each shard.

    A null text counts as an empty one. Rows get numbers when their sizes are written, so repeated rows, and rows without an
    id, are rows like any others. An empty table gives no rows.
    """
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    keyed = stored(docs.select(F.monotonically_increasing_id().alias("row_id"), "doc_id", (F.length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
                               F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2")), "sizes")
    links = keyed.select("row_id", F.struct("h1", "h2", "size").alias("hub"))
    placed = assign(keyed.select("row_id"), links, shards)
    full = keyed.join(placed, "row_id").select("doc_id", "size", "text_crc32", "shard", "row_id")
    return ranked(full, ["shard"], F.col("row_id"), "slot").drop("row_id")


def op2_sharding(spark, sf_dir: str) -> DataFrame:
    """Put all documents into 40 shards with equal numbers of rows."""
    return shard_documents(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
