"""Balanced label propagation: documents go to shards near the documents they are linked with.

Documents that share a link key (here: equal texts) form a group. Those of one group are
interchangeable, so the state is a table of cells (group, shard, number of documents), which has
at most as many rows for a group as there are shards. In each round a cell asks to move to the
shard that holds most of its group and has room; a group too large for one shard has as many
such targets as it needs. The driver grants numbers of rows for each pair of shards: what has room,
what takes a place that another request leaves, and what two or three shards can exchange; so full
shards still pass rows on. Within a pair requests are granted in order of gain. Rounds go on until none brings
documents of a group together. Documents
without a link are no part of this: at the end they fill every shard up to its exact share.

Sizes follow the law ``rows``: the numbers of documents differ by one at most. All ranks are
made from counts by lane (a hash of doc_id), so no task gets all rows of a group or a shard.
Only built-in DataFrame functions are used; the driver sees one row for each pair of shards and round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.llm.common import durable, running_offsets

LAW = "rows"
#: A lane is meant to hold about so many rows of a group that takes in every row.
LANE_ROWS = 100_000
LEAST_LANES = 256
GROUP = ["link", "link2"]


def _pick(values: list[int], at: Column) -> Column:
    """``values[at]`` for a short list of the driver's."""
    return F.element_at(F.array(*[F.lit(v).cast("long") for v in values]), (at + 1).cast("int"))


def _granted(requests: DataFrame, room: list[int], lanes: int) -> DataFrame:
    """Adds ``granted``: what of ``n`` still fits ``room[to]``, in order of lane and gain."""
    requests = requests.withColumn("lane", F.pmod(F.xxhash64(*GROUP), F.lit(lanes)))
    by_lane = running_offsets(requests.groupBy("to", "lane").agg(F.sum("n").alias("lane_n")), ["to"], "lane", "lane_n", "lane_before")
    w = Window.partitionBy("to", "lane").orderBy(F.desc("gain"), *GROUP, "shard").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("lane_before") + F.coalesce(F.sum("n").over(w), F.lit(0))
    return requests.join(by_lane.select("to", "lane", "lane_before"), ["to", "lane"]).withColumn(
        "granted", F.greatest(F.lit(0), F.least(F.col("n"), _pick(room, F.col("to")) - before)).cast("long")
    )


def _flows(asked: dict[tuple[int, int], int], room: list[int]) -> list[int]:
    """Rows granted from shard to shard, at place ``from * shards + to``: no shard takes in more
    than its room and what leaves it."""
    shards, room = len(room), list(room)
    left, granted = dict(asked), [0] * len(room) ** 2

    def grant(n: int, *steps: tuple[int, int]) -> None:
        for s, t in steps:
            left[s, t] -= n
            granted[s * shards + t] += n

    for s, t in list(left):
        if n := min(left[s, t], left.get((t, s), 0)):
            grant(n, (s, t), (t, s))
    for s, t in list(left):
        for u in range(shards):
            if n := min(left[s, t], left.get((t, u), 0), left.get((u, s), 0)):
                grant(n, (s, t), (t, u), (u, s))
    free = [t for t in range(shards) if room[t] > 0]
    while free:
        t = free.pop()
        for s in range(shards):
            if (n := min(room[t], left.get((s, t), 0))) > 0:
                grant(n, (s, t))
                room[t] -= n
                room[s] += n
                free.append(s)
    return granted


def propagate(cells: DataFrame, shards: int, quota: int, lanes: int, rounds: int | None = None) -> DataFrame:
    """Cells (link, link2, shard, n) after label propagation under ``quota`` rows a shard, until
    no round brings groups together (or for so many rounds)."""
    w = Window.partitionBy(*GROUP)
    reached, kept, only_room, done = -1, cells, False, 0
    while rounds is None or done <= rounds:
        loads = cells.groupBy("shard").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("together")).collect()
        together = sum(r["together"] for r in loads)
        if together > reached:
            reached, kept = together, cells
            only_room = False
        elif only_room or not loads:
            break
        else:
            # exchanges bring nothing more; where the best shard is full, others may have room
            only_room, cells = True, kept
            loads = cells.groupBy("shard").agg(F.sum("n").alias("n")).collect()
        if done == rounds:
            break
        done += 1
        held = {r["shard"]: r["n"] for r in loads}
        room = [quota - held.get(s, 0) for s in range(shards)]
        order = F.struct((-F.col("n")).alias("less"), (_pick(room, F.col("shard")) <= 0).cast("int").alias("full"), F.xxhash64(*GROUP, "shard").alias("tie"), F.col("shard"))
        ranked = (
            cells.withColumn("tops", F.array_sort(F.collect_list(order).over(w)))
            .withColumn("wanted", F.ceil(F.sum("n").over(w) / F.lit(max(1, quota))).cast("int"))
            .withColumn("place", F.array_position(F.transform("tops", lambda x: x["shard"]), F.col("shard")).cast("int"))
        )
        # shards that hold more of the group, the first of which are the targets
        better = F.slice("tops", F.lit(1), F.col("place") - 1)
        if only_room:
            better = F.filter(better, lambda x: _pick(room, x["shard"]) > 0)
        asked = durable(
            ranked.where("place > wanted")
            .withColumn("better", better)
            .where(F.size("better") > 0)
            .withColumn("top", F.element_at("better", F.pmod(F.col("place") - 1, F.least(F.size("better"), "wanted")) + 1))
            .select(*GROUP, "shard", "n", F.col("top.shard").alias("target"), (-F.col("top.less") - F.col("n")).alias("gain"))
            .withColumn("to", F.col("shard") * shards + F.col("target"))
        )
        flows = _flows({(r["shard"], r["target"]): r["n"] for r in asked.groupBy("shard", "target").agg(F.sum("n").alias("n")).collect()}, room)
        moves = _granted(asked, flows, lanes).where("granted > 0")
        changes = moves.select(*GROUP, F.explode(F.array(F.struct(F.col("shard"), (-F.col("granted")).alias("n")), F.struct(F.col("target").alias("shard"), F.col("granted").alias("n")))).alias("x"))
        cells = durable(
            cells.select(*GROUP, "shard", "n")
            .unionByName(changes.select(*GROUP, "x.shard", "x.n"))
            .groupBy(*GROUP, "shard")
            .agg(F.sum("n").alias("n"))
            .where("n > 0")
        )
    return kept


def shard_documents(docs: DataFrame, shards: int = 40, rounds: int | None = None) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    ``size`` is the text's UTF-8 bytes plus 16 (16 for a null text, whose crc32 is that of no
    bytes). Equal texts are linked; null texts are not. Rows that repeat are documents of their
    own. An empty table gives no rows. ``grown_shard`` is null under this law. Other columns of
    ``docs`` are not read.
    """
    text = F.col("text").cast("string")
    crc = F.crc32(F.coalesce(text, F.lit("")).cast("binary")).cast("long")
    length = F.octet_length(F.coalesce(text, F.lit(""))).cast("long")
    base = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (length + 16).alias("size"),
        crc.alias("text_crc32"),
        F.when(text.isNotNull(), F.xxhash64(text)).alias("link"),
        F.when(text.isNotNull(), F.shiftleft(crc, 31).bitwiseXOR(length)).alias("link2"),
    )
    base = durable(base)
    total = base.count()
    quota, extra = divmod(total, shards)
    share = [quota + (s < extra) for s in range(shards)]
    lanes = max(LEAST_LANES, total // LANE_ROWS)
    # the rows are written down, so their numbers stay: they tell rows without doc_id apart
    told = F.coalesce("doc_id", F.monotonically_increasing_id())
    base = base.withColumn("lane", F.pmod(F.xxhash64(told, F.lit(7)), F.lit(lanes)))

    by_lane = base.where("link is not null").groupBy(*GROUP, "lane").agg(F.count("*").alias("n"))
    by_lane = by_lane.withColumn("members", F.sum("n").over(Window.partitionBy(*GROUP))).where("members > 1")
    by_lane = durable(running_offsets(by_lane, GROUP, "lane", "n", "before"))

    cells = by_lane.groupBy(*GROUP, F.pmod("lane", F.lit(shards)).cast("int").alias("shard")).agg(F.sum("n").alias("n"))
    cells = propagate(durable(cells), shards, quota, lanes, rounds)
    kept = _granted(cells.select(*GROUP, "shard", "n", F.col("shard").alias("to"), F.col("n").alias("gain")), share, lanes)
    to = Window.partitionBy(*GROUP).orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)
    ranges = (
        kept.where("granted > 0")
        .withColumn("upto", F.sum("granted").over(to))
        .groupBy(*GROUP)
        .agg(F.array_sort(F.collect_list(F.struct("upto", "shard"))).alias("ranges"))
    )
    placed = by_lane.join(ranges, GROUP).select(*GROUP, "lane", "before", "ranges")

    in_lane = Window.partitionBy(*GROUP, "lane").orderBy("doc_id")
    found = F.filter("ranges", lambda x: x["upto"] > F.col("at"))
    rows = (
        base.withColumn("nth", F.row_number().over(in_lane) - 1)
        .join(placed, [*GROUP, "lane"], "left")
        .withColumn("at", F.col("before") + F.col("nth"))
        .select("doc_id", "size", "text_crc32", "lane", F.when(F.size(found) > 0, found[0]["shard"]).alias("shard"))
    )
    rows = durable(rows)

    taken = {r["shard"]: r["n"] for r in rows.where("shard is not null").groupBy("shard").agg(F.count("*").alias("n")).collect()}
    filled, upto = [], 0
    for s in range(shards):
        upto += share[s] - taken.get(s, 0)
        filled.append(upto)
    order = ["doc_id", "text_crc32", "size"]
    loose = rows.where("shard is null").drop("shard")
    offsets = running_offsets(loose.groupBy("lane").agg(F.count("*").alias("n")).withColumn("all", F.lit(0)), ["all"], "lane", "n", "before")
    at = F.col("before") + F.row_number().over(Window.partitionBy("lane").orderBy(*order)) - 1
    free = F.size(F.filter(F.array(*[F.lit(x).cast("long") for x in filled]), lambda x: x <= F.col("at")))
    loose = loose.join(offsets.select("lane", "before"), "lane").withColumn("at", at).select("doc_id", "size", "text_crc32", "lane", free.cast("int").alias("shard"))
    rows = rows.where("shard is not null").unionByName(loose)

    offsets = running_offsets(rows.groupBy("shard", "lane").agg(F.count("*").alias("n")), ["shard"], "lane", "n", "before")
    slot = F.col("before") + F.row_number().over(Window.partitionBy("shard", "lane").orderBy(*order)) - 1
    return rows.join(offsets.select("shard", "lane", "before"), ["shard", "lane"]).select(
        "doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), F.col("shard").cast("int").alias("shard"), slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
