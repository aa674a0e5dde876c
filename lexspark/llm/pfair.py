"""Mixing sources to target weights by Pfair scheduling.

The rows of a source, in an order spread by a hash of their ids, are cut into blocks of
BLOCK rows. Block i (from 1) of a source of weight w may not start before slot
floor((i-1)/w) and is due by slot ceil(i/w); in every slot the released block of the
earliest deadline goes out. Every source so stays less than one block from w times the
slots gone by, however many slots there are: weights are exact fractions, and the
scheduler runs over all blocks (on the driver, one step and eight bytes for each, so
for every BLOCK rows). When a source has run out, the others go on with their weights
scaled up; every row is placed exactly once, and ``on_target`` marks the part before the
first source runs out, in which all sources have their target weights.

Without given weights, targets are shares flattened by the power FLATTEN. Every source
has a lane and a weight of its own; their names and counts are held on the driver.

Defined cases: a null source is a source; rows of equal ids follow each other by text
hash; a source with weight 0 comes after all others; sources that ``weights`` does not
name have weight 0; an empty table gives an empty result; extra columns are kept unless
they bear the name of a result column, which replaces them.
"""

from __future__ import annotations

import heapq
import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

BLOCK = 64
FLATTEN = 0.7
GROUP_ROWS = 4000
BROADCAST_BYTES = 8 << 20
RESULT = ["block", "slot", "place", "target_weight", "on_target"]


def quanta(weights: dict, period: int) -> dict:
    """Whole shares of ``period`` per lane, at least one each, by largest remainder; ``mix`` uses the exact weights instead."""
    total = sum(weights.values())
    exact = {k: w / total * period for k, w in weights.items()}
    whole = {k: max(1, int(x)) for k, x in exact.items()}
    order = sorted(weights, key=lambda k: (int(exact[k]) - exact[k], str(k)))
    i = 0
    while sum(whole.values()) < period:
        whole[order[i % len(order)]] += 1
        i += 1
    while sum(whole.values()) > period:
        whole[max(whole, key=lambda k: (whole[k], str(k)))] -= 1
    return whole


def timetable(blocks: dict, weights: dict) -> tuple[dict, int]:
    """Slots (from 0) of all blocks of each lane, and the number of slots until the first lane with a weight has run out.

    Releases and deadlines are those of the exact weights, in whole numbers. Time counts slots
    until the first lane runs out and after that runs faster, by the weight of all lanes over
    that of the lanes left, so what a lane is owed is carried over. Lanes without a weight come
    after the others, by their sizes.
    """
    slots = {k: np.zeros(n, np.int64) for k, n in blocks.items()}
    ranks = {k: i for i, k in enumerate(sorted(blocks, key=str))}
    ratio = {k: Fraction(weights.get(k, 0)) for k, n in blocks.items() if n > 0}
    weighted = {k: w for k, w in ratio.items() if w > 0}
    slot, on_target = 0, None
    for live in (weighted, {k: Fraction(blocks[k]) for k in ratio if k not in weighted}):
        if not live:
            continue
        common = math.lcm(*(w.denominator for w in live.values()))
        share = {k: int(w * common) for k, w in live.items()}
        total = left = sum(share.values())
        # time has 64 binary places; it is a whole number until a lane runs out
        time, ready = 0, []
        waiting = [(0, ranks[k], k, 0) for k in live]
        heapq.heapify(waiting)
        while left:
            if not ready and waiting[0][0] > time >> 64:
                time = waiting[0][0] << 64
            while waiting and waiting[0][0] <= time >> 64:
                _, rank, k, i = heapq.heappop(waiting)
                heapq.heappush(ready, (-(-(i + 1) * total // share[k]), rank, k, i))
            _, rank, k, i = heapq.heappop(ready)
            slots[k][i] = slot
            slot += 1
            if i + 1 < blocks[k]:
                heapq.heappush(waiting, ((i + 1) * total // share[k], rank, k, i + 1))
            else:
                left -= share[k]
                if on_target is None and live is weighted:
                    on_target = slot
            if left:
                time += (total << 64) // left
    return slots, on_target or 0


def schedule(shares: dict, period: int) -> dict:
    """Slots (0-based) of the blocks of each lane in one period; ``shares`` add up to ``period``."""
    slots, _ = timetable({k: 2 * q for k, q in shares.items()}, shares)  # no lane runs out within the first period
    return {k: slots[k][:q].tolist() for k, q in shares.items()}


def mix(documents: DataFrame, weights: dict | None = None, source: str = "source", block: int = BLOCK) -> DataFrame:
    """All rows with block (of their source), slot, place (row in the block), target_weight and on_target."""
    spark = documents.sparkSession
    documents = documents.drop(*RESULT, "lane", "spread", "bucket")
    counts = documents.groupBy(source).agg(F.count("*").alias("n"))
    lanes = {r[source]: r["n"] for r in counts.orderBy(F.desc("n"), F.col(source).asc_nulls_first()).collect()}  # one row per source
    if not lanes:
        return documents.withColumns({"block": F.lit(0).cast("bigint"), "slot": F.lit(0).cast("bigint"), "place": F.lit(0).cast("bigint"), "target_weight": F.lit(0.0), "on_target": F.lit(True)})
    names = list(lanes)
    sizes = dict(enumerate(lanes.values()))
    name_type = documents.schema[source].dataType
    table = spark.createDataFrame(pa.table({"name": pa.array(names, to_arrow_type(name_type)), "lane": pa.array(range(len(names)), pa.int32())}))
    # rows of all sources beyond BROADCAST_BYTES of names meet their lanes in a shuffle
    size = sum(len(str(name)) + 16 for name in names)
    laned = documents.join(F.broadcast(table) if size <= BROADCAST_BYTES else table, documents[source].eqNullSafe(table["name"])).drop("name")
    text = F.xxhash64("text") if "text" in documents.columns else F.lit(0).cast("bigint")
    buckets = max(1, -(-max(sizes.values()) // GROUP_ROWS))
    width = 2**32 // buckets + 1
    spread = F.shiftrightunsigned(F.xxhash64("doc_id"), 32)
    laned = laned.withColumns({"spread": spread, "bucket": F.floor(spread / width).cast("int")})
    # rows before each group of rows: groups are of bounded size, so ranks need no task that holds a source
    groups = laned.groupBy("lane", "bucket").agg(F.count("*").alias("n"))
    before = groups.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("lane").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = Window.partitionBy("lane", "bucket").orderBy("spread", "doc_id", text)
    target = {i: float(weights.get(names[i], 0.0) if weights is not None else n**FLATTEN) for i, n in sizes.items()}
    whole = sum(target.values()) or 1.0
    slots, on_target = timetable({i: -(-n // block) for i, n in sizes.items()}, target)
    # one row per block; a group of rows takes the slots of the few blocks it lies in
    table = pa.table({
        "lane": pa.array(np.repeat(np.array(list(slots), np.int32), [len(s) for s in slots.values()])),
        "block": pa.array(np.concatenate([np.arange(len(s)) for s in slots.values()])), "slot": pa.array(np.concatenate(list(slots.values())))})
    rules = spark.createDataFrame(table)
    first, last = F.floor(F.col("before") / block), F.floor((F.col("before") + F.col("n") - 1) / block)
    spans = before.select("lane", "bucket", "before", F.explode(F.sequence(first, last)).alias("block")).join(rules, ["lane", "block"])
    spans = spans.groupBy("lane", "bucket", "before").agg(F.map_from_entries(F.collect_list(F.struct("block", "slot"))).alias("_slots"))
    goals = np.array(list(target.values()))
    shares = spark.createDataFrame(pa.table({"lane": pa.array(list(target), pa.int32()), "target_weight": goals / whole, "_weighted": goals > 0}))
    spans = spans.join(shares, "lane")
    ranked = laned.withColumn("rank", F.row_number().over(inside)).join(spans, ["lane", "bucket"])
    position = F.col("before") + F.col("rank") - 1
    placed = ranked.withColumns({"block": F.floor(position / block), "place": position % block})
    slot = F.element_at("_slots", F.col("block"))
    return placed.select(
        *documents.columns, F.col("block").cast("bigint"), slot.cast("bigint").alias("slot"), F.col("place").cast("bigint"),
        "target_weight", (F.col("_weighted") & (slot < on_target)).alias("on_target"))
