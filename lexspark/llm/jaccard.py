"""N-gram Jaccard join by vertical partitioning, and the components of its links.

The distinct word n-grams of all texts have one global order, rare before frequent
(by a table of SLOTS counters over all texts, then by hash). The order is cut into
FRAGMENTS of equal mass. A text's set is thereby cut into segments; the overlap of a
pair is counted in every fragment separately and summed per pair, which decides the
link exactly. Which pairs are counted follows from the head of the order: linked sets
must share an n-gram among their first ``n - ceil(t n) + 1``, at places that leave
room for the overlap they need.

Equal sets are one class from the start (named by a 64-bit digest), and no group
emits all its pairs. Under each n-gram of a head, members first meet the member with
the fewest rarer n-grams. Members that this leaves apart then meet those members of
other components whose size and place still allow a link; sizes and places are
compared as distinct values before any members are. Links inside a component change
nothing and are not counted. The heads of a pair, which are at hand, are counted before
its fragments: most pairs that share an n-gram by chance end there, and no set is sent
for them.

Defined cases: null or blank texts have size 0 and are linked with nothing; a text of
fewer words than the n-gram has its whole sequence as its only one; rows with a null
id get no component (null) and lend none; repeated rows are copies of each other;
extra columns are ignored; an empty table gives an empty result. N-grams are compared
by 57 bits of a hash within one level of frequency.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspark.llm.common import Batches
from lexspark.llm.components import connected_components
from lexspark.llm.words import chunks, shingles, split_words, text_buffer
from lexspark.session import cut_lineage

SLOT_BITS = 20
SLOTS = 1 << SLOT_BITS
BLOCK = 1 << 13
LEVEL_SHIFT = np.uint64(57)
FRAGMENTS = 8
# keys of sets that are to be counted: a bitmap of this many bits says which sets to send
FILTER_BITS = 1 << 23


def _sets(batch: pa.RecordBatch, size: int):
    """First row, sorted n-grams and their run starts, for groups of rows of a batch."""
    data, offsets = text_buffer(batch.column("text"))
    for at, end in chunks(offsets):
        grams, runs = shingles(split_words(data, offsets[at : end + 1]), size)
        yield at, grams, runs


def _tally(size: int):
    def tally(batches: Batches) -> Batches:
        counts = np.zeros(SLOTS, np.uint32)
        for batch in batches:
            for _, grams, _ in _sets(batch, size):
                counts += np.bincount((grams >> np.uint64(64 - SLOT_BITS)).astype(np.int64), minlength=SLOTS).astype(np.uint32)
        blocks = [(i, zlib.compress(counts[i * BLOCK : (i + 1) * BLOCK].tobytes(), 1)) for i in range(SLOTS // BLOCK)]
        yield pa.RecordBatch.from_pydict({"block": pa.array([i for i, _ in blocks], pa.int32()), "counts": pa.array([c for _, c in blocks], pa.binary())})

    return tally


def _fold(batches: Batches) -> Batches:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for i, c in zip(batch.column("block").to_pylist(), batch.column("counts"), strict=True):
            total[i] = total.get(i, 0) + np.frombuffer(zlib.decompress(c.as_py()), np.uint32).astype(np.uint64)
    yield pa.RecordBatch.from_pydict({
        "block": pa.array(list(total), pa.int32()), "counts": pa.array([v.tobytes() for v in total.values()], pa.binary()),
    })


def _levels(texts: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Level of frequency of every slot (0 to 63), and the pivots that cut the order into fragments."""
    spark = texts.sparkSession
    rows = (
        texts.mapInArrow(_tally(size), "block int, counts binary").repartition(min(16, SLOTS // BLOCK), "block")
        .mapInArrow(_fold, "block int, counts binary").collect()
    )  # SLOTS counters, whatever the corpus
    counts = np.zeros(SLOTS, np.uint64)
    for r in rows:
        counts[r["block"] * BLOCK : (r["block"] + 1) * BLOCK] = np.frombuffer(r["counts"], np.uint64)
    levels = np.minimum(63, 2 * np.log2(counts.astype(np.float64) + 1)).astype(np.uint8)
    mass = np.bincount(levels, weights=counts.astype(np.float64), minlength=64)
    edges, total = np.concatenate([[0], np.cumsum(mass)]), mass.sum()
    pivots = []
    for f in range(1, FRAGMENTS):
        level = int(np.searchsorted(edges, total * f / FRAGMENTS, "right")) - 1
        level = min(max(level, 0), 63)
        inside = (total * f / FRAGMENTS - edges[level]) / mass[level] if mass[level] else 0.0
        pivots.append((level << int(LEVEL_SHIFT)) + int(inside * 2**56) * 2)
    return levels, np.array(pivots, np.uint64)


def _ordered(grams: np.ndarray, runs: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """The n-grams of each run as values of the global order, sorted."""
    token = (levels[(grams >> np.uint64(64 - SLOT_BITS)).astype(np.int64)].astype(np.uint64) << LEVEL_SHIFT) | (grams >> np.uint64(7))
    owner = np.repeat(np.arange(len(runs) - 1), np.diff(runs))
    return token[np.lexsort((token, owner))]


def _key(grams: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(grams.tobytes())).astype(np.int64))


def _heads(shared, size: int, num: int, den: int):
    def heads(batches: Batches) -> Batches:
        levels = shared.value[0]
        for batch in batches:
            ids = batch.column("doc_id")
            for at, grams, runs in _sets(batch, size):
                tokens = _ordered(grams, runs, levels).astype(np.int64)
                n = np.diff(runs)
                length = np.where(n > 0, n - (-(-num * n // den)) + 1, 0)
                keys = [_key(grams[a:b]) if b > a else 0 for a, b in zip(runs[:-1], runs[1:], strict=True)]
                offsets = np.zeros(len(n) + 1, np.int32)
                np.cumsum(length, out=offsets[1:])
                take = np.arange(offsets[-1]) - np.repeat(offsets[:-1], length) + np.repeat(runs[:-1], length)
                head = pa.ListArray.from_arrays(pa.array(offsets), pa.array(tokens[take]))
                yield pa.RecordBatch.from_arrays([ids.slice(at, len(n)), pa.array(n, pa.int64()), pa.array(keys, pa.int64()), head], ["doc_id", "n", "key", "head"])

    return heads


def _segments(shared, size: int):
    def segments(batches: Batches) -> Batches:
        levels, pivots, wanted = shared.value
        for batch in batches:
            sent: set[int] = set()
            for _, grams, runs in _sets(batch, size):
                tokens = None
                rows: list[tuple] = []
                for i, (a, b) in enumerate(zip(runs[:-1], runs[1:], strict=True)):
                    if a == b:
                        continue
                    key = _key(grams[a:b])
                    slot = key % FILTER_BITS
                    if key in sent or not wanted[slot >> 3] >> (slot & 7) & 1:
                        continue
                    sent.add(key)
                    if tokens is None:
                        tokens = _ordered(grams, runs, levels)
                    own = tokens[a:b]
                    cuts = [0, *np.searchsorted(own, pivots).tolist(), b - a]
                    rows += [(key, f, own[x:y].astype(np.int64)) for f, (x, y) in enumerate(zip(cuts, cuts[1:], strict=False)) if y > x]
                if rows:
                    yield pa.RecordBatch.from_pydict({
                        "key": pa.array([r[0] for r in rows], pa.int64()), "fragment": pa.array([r[1] for r in rows], pa.int32()),
                        "segment": pa.array([r[2] for r in rows], pa.list_(pa.int64())),
                    })

    return segments


def _can_link(num: int, den: int) -> str:
    """SQL test on two sets' sizes and places of a shared n-gram: if it is their first, is there room for a link?"""
    return (
        f"{den} * least(n, other_n) >= {num} * greatest(n, other_n) AND "
        f"{num + den} * (1 + least(n - place - 1, other_n - other_place - 1)) >= {num} * (n + other_n)"
    )


def _bitmap(pairs: DataFrame) -> bytes:
    """FILTER_BITS bits that are set for the keys of the pairs (and for some others, which later joins drop)."""
    slot = F.pmod(F.col("key"), F.lit(FILTER_BITS)) + 1
    rows = (
        pairs.select(F.explode(F.array("a", "b")).alias("key")).select(slot.alias("slot"))
        .groupBy(F.bitmap_bucket_number("slot").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits")).collect()
    )
    wanted = bytearray(FILTER_BITS // 8)
    for r in rows:
        wanted[(r["bucket"] - 1) * 4096 : r["bucket"] * 4096] = r["bits"]
    return bytes(wanted)


def _wanted(shared):
    def wanted(batches: Batches) -> Batches:
        bits = np.frombuffer(shared.value, np.uint8)
        for batch in batches:
            slot = batch.column("key").to_numpy() % FILTER_BITS
            yield batch.filter(pa.array((bits[slot >> 3] >> (slot & 7).astype(np.uint8) & 1).astype(bool)))

    return wanted


def _promising(pairs: DataFrame, sets: DataFrame, bits: bytes, num: int, den: int) -> DataFrame:
    """The pairs that their heads do not rule out.

    Up to the lesser of the two last n-grams the heads tell the overlap exactly; beyond it
    the shorter remainder bounds it.
    """
    shared = pairs.sparkSession.sparkContext.broadcast(bits)
    heads = sets.select("key", "head").mapInArrow(_wanted(shared), "key bigint, head array<bigint>").dropDuplicates(["key"])
    both = (
        pairs.join(heads.select(F.col("key").alias("a"), F.col("head").alias("head_a")), "a")
        .join(heads.select(F.col("key").alias("b"), F.col("head").alias("head_b")), "b")
        .withColumn("last", F.least(F.element_at("head_a", -1), F.element_at("head_b", -1)))
        .withColumns({c: F.filter(c, lambda g: g <= F.col("last")) for c in ("head_a", "head_b")})
    )
    most = F.size(F.array_intersect("head_a", "head_b")) + F.least(F.col("na") - F.size("head_a"), F.col("nb") - F.size("head_b"))
    return both.where((num + den) * most >= num * (F.col("na") + F.col("nb"))).select("a", "b", "na", "nb")


def _linked(pairs: DataFrame, sets: DataFrame, texts: DataFrame, order, size: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b, of sizes na, nb) whose overlap, summed over the fragments, makes a link."""
    pairs = cut_lineage(_promising(pairs, sets, _bitmap(pairs), num, den))
    shared = texts.sparkSession.sparkContext.broadcast((*order, _bitmap(pairs)))
    segments = texts.mapInArrow(_segments(shared, size), "key bigint, fragment int, segment array<bigint>")
    # one copy of each set: equal sets come from several tasks
    segments = cut_lineage(segments.groupBy("key", "fragment").agg(F.any_value("segment").alias("segment")))
    left = segments.select(F.col("key").alias("a"), "fragment", F.col("segment").alias("left_segment"))
    right = segments.select(F.col("key").alias("b"), "fragment", F.col("segment").alias("right_segment"))
    counted = (
        pairs.join(left, "a").join(right, ["b", "fragment"])
        .select("a", "b", "na", "nb", F.size(F.array_intersect("left_segment", "right_segment")).alias("partial"))
        .groupBy("a", "b", "na", "nb").agg(F.sum("partial").alias("overlap"))
    )
    return counted.where(f"{num + den} * overlap >= {num} * (na + nb)").select("a", "b")


def _pairs(candidates: DataFrame) -> DataFrame:
    """Distinct unordered pairs of columns key, n and other, other_n."""
    swap = F.col("key") > F.col("other")
    return candidates.select(
        F.when(swap, F.col("other")).otherwise(F.col("key")).alias("a"), F.when(swap, F.col("key")).otherwise(F.col("other")).alias("b"),
        F.when(swap, F.col("other_n")).otherwise(F.col("n")).alias("na"), F.when(swap, F.col("n")).otherwise(F.col("other_n")).alias("nb"),
    ).distinct()


def jaccard_components(documents: DataFrame, size: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """doc_id, n_shingles and component_id (least id that links reach) of every row.

    Two rows link when ``den * overlap >= num * union`` over their distinct word n-grams of ``size`` words.
    """
    spark = documents.sparkSession
    texts = documents.select("text")
    order = _levels(texts, size)
    shared = spark.sparkContext.broadcast(order)
    id_type = documents.schema["doc_id"].dataType.simpleString()
    sets = cut_lineage(documents.select("doc_id", "text").mapInArrow(
        _heads(shared, size, num, den), f"doc_id {id_type}, n bigint, key bigint, head array<bigint>"))
    members = sets.where("n > 0")
    postings = members.dropDuplicates(["key"]).select("key", "n", F.posexplode("head").alias("place", "gram"))
    shared_grams = postings.groupBy("gram").agg(F.count("*").alias("members"), F.min(F.struct("place", F.negative("n").alias("minus"), "key")).alias("lead"))
    shared_grams = shared_grams.where("members > 1").select(
        "gram", F.col("lead.key").alias("other"), F.negative("lead.minus").alias("other_n"), F.col("lead.place").alias("other_place"))
    met = cut_lineage(postings.join(shared_grams, "gram"))
    test = _can_link(num, den)
    first = cut_lineage(_pairs(met.where(f"key <> other AND {test}")))
    links = cut_lineage(_linked(first, sets, texts, order, size, num, den))
    labels = connected_components(links)
    named = labels.select(F.col("node").alias("key"), "label")
    # members outside their leader's component, and the sizes and places under the same n-gram that could link with theirs
    of = met.join(named, "key", "left").withColumn("label", F.coalesce("label", "key"))
    lead = named.select(F.col("key").alias("other"), F.col("label").alias("lead_label"))
    of = of.join(lead, "other", "left").withColumn("lead_label", F.coalesce("lead_label", "other"))
    of = cut_lineage(of.select("gram", "key", "n", "place", "label", "lead_label"))
    apart = of.where("label <> lead_label").select("gram", "key", "n", "place", "label")
    kinds = of.select("gram", F.col("n").alias("other_n"), F.col("place").alias("other_place")).distinct()
    others = of.select("gram", F.col("key").alias("other"), F.col("n").alias("other_n"), F.col("place").alias("other_place"), F.col("label").alias("other_label"))
    second = (
        apart.join(kinds, "gram").where(test)
        .join(others, ["gram", "other_n", "other_place"]).where("label <> other_label AND key <> other")
    )
    second = cut_lineage(_pairs(second).join(first.select("a", "b"), ["a", "b"], "left_anti"))
    if not second.isEmpty():
        more = _linked(second, sets, texts, order, size, num, den)
        labels = connected_components(more.unionByName(labels.select(F.col("node").alias("a"), F.col("label").alias("b"))))
    least = members.groupBy("key").agg(F.min("doc_id").alias("least"))
    named = labels.select(F.col("node").alias("key"), "label")
    least = least.join(named, "key", "left").withColumn("label", F.coalesce("label", "key"))
    components = least.groupBy("label").agg(F.min("least").alias("component_id"))
    classes = least.join(components, "label").select("key", "component_id")
    found = sets.select("doc_id", "n", "key").join(classes, "key", "left")
    return found.select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("n") == 0, F.col("doc_id")).when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"),
    )
