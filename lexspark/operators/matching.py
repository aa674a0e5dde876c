"""Exact edit-distance joins without comparing all pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexspark.functions import windows as W
from lexspark.session import write_out

# what every character weighs beside the rarity of its word
LEAST_WEIGHT = 0.02
# pairs that one even segment may make
HOT_PAIRS = 20_000
# so many (size, length, place) of segments go to every task, more are joined
FEW_KINDS = 50_000
# so many subsequences are shuffled at a time
WAVE_KEYS = 300_000_000
# a word is common where it is in more than one of so many texts
COMMON_SHARE = 4096


def _allowed_edits(longer: Column, threshold: float) -> Column:
    """Most edits a pair may have whose longer side has this length."""
    return F.floor(longer * (1.0 - threshold) + F.lit(1e-9)).cast("int")


def _char_weights(texts: DataFrame) -> DataFrame:
    """(text, weights): for each character the rarity of its word among the texts, divided by the word's length."""
    n = texts.count()
    words = texts.select("text", F.posexplode(F.split("text", " ")).alias("at", "word"))
    df = words.select("text", "word").distinct().groupBy("word").agg(F.count("*").alias("df"))
    # the blank after a word counts with it
    weight = F.log2(F.lit(n + 1.0) / F.col("df")) / (F.length("word") + 1) + F.lit(LEAST_WEIGHT)
    runs = words.join(df, "word").select("text", "at", F.array_repeat(weight, F.length("word") + 1).alias("run"))
    ordered = runs.groupBy("text").agg(F.sort_array(F.collect_list(F.struct("at", "run"))).alias("runs"))
    return ordered.select("text", F.slice(F.flatten(F.transform("runs", lambda r: r["run"])), F.lit(1), F.length("text")).alias("weights"))


def balanced_segments(texts: DataFrame, threshold: float) -> DataFrame:
    """(text, edits, segments): distinct non-empty texts cut into segments of about equal rarity.

    A text has so many segments that of the edits any partner allows one of them has at most
    one. A word that many texts share weighs little, so it ends up in one segment with rarer
    neighbours instead of filling segments by itself.
    """
    size = F.length("text")
    edits = F.least(_allowed_edits(F.floor(size / F.lit(threshold) + F.lit(1e-9)), threshold), size - 1)
    rows = _char_weights(texts).withColumn("edits", edits).withColumn("cuts", (F.floor(F.col("edits") / 2) + 1).cast("int"))
    sums = F.transform(F.sequence(F.lit(1), size), lambda j: F.aggregate(F.slice("weights", F.lit(1), j), F.lit(0.0), lambda a, x: a + x))
    # each step is written out: inside a lambda the next one would work it out again for every element
    rows = write_out(rows.withColumn("sums", sums).withColumn("whole", F.element_at("sums", -1)))
    # a character counts where its middle is, so that a cut is at the nearest one
    rows = rows.withColumn("sums", F.zip_with("sums", "weights", lambda c, w: c - w / 2)).drop("weights")
    # where the share of each segment is reached, moved on so that no segment is empty
    reached = F.transform(
        F.sequence(F.lit(0), F.col("cuts") - 1),
        lambda i: F.when(i == 0, 0).otherwise(F.size(F.filter("sums", lambda c: c < i * F.col("whole") / F.col("cuts"))) - i),
    )
    rows = write_out(rows.withColumn("ahead", reached).drop("sums"))
    starts = F.transform(
        F.sequence(F.lit(0), F.col("cuts") - 1),
        lambda i: F.least(i + F.greatest(F.array_max(F.slice("ahead", F.lit(1), i + 1)), F.lit(0)), size - F.col("cuts") + i),
    )
    rows = write_out(rows.withColumn("starts", starts))
    segments = F.transform(
        F.sequence(F.lit(0), F.col("cuts") - 1),
        lambda i: F.struct(
            F.get("starts", i).alias("start"),
            F.substr(F.col("text"), F.get("starts", i) + 1, F.coalesce(F.get("starts", i + 1), size) - F.get("starts", i)).alias("segment"),
        ),
    )
    return rows.select("text", "edits", segments.alias("segments"))


def _sizes(threshold: float) -> Column:
    """The lengths a similar text may have."""
    size = F.length("text")
    return F.sequence(F.ceil(size * threshold - F.lit(1e-9)).cast("int"), F.floor(size / F.lit(threshold) + F.lit(1e-9)).cast("int"))


def _even_edits(threshold: float) -> Column:
    return F.least(_allowed_edits(F.floor(F.col("size") / F.lit(threshold) + F.lit(1e-9)), threshold), F.col("size") - 1)


def _even_right(texts: DataFrame, threshold: float) -> DataFrame:
    """(right, size, number, segment): texts cut evenly into one segment more than any partner's edits."""
    rows = texts.withColumn("size", F.length("text")).withColumn("edits", _even_edits(threshold))
    rows = rows.withColumn("number", F.explode(F.sequence(F.lit(0), F.col("edits"))))
    start = F.floor(F.col("number") * F.col("size") / (F.col("edits") + 1)).cast("int")
    end = F.floor((F.col("number") + 1) * F.col("size") / (F.col("edits") + 1)).cast("int")
    return rows.select(F.col("text").alias("right"), "size", "number", F.substr(F.col("text"), start + 1, end - start).alias("segment"))


def _even_left(texts: DataFrame, threshold: float) -> DataFrame:
    """(left, size, number, segment): what an even segment of a text of some size may be in a similar text."""
    rows = texts.withColumn("size", F.explode(_sizes(threshold))).where("size > 0").withColumn("edits", _even_edits(threshold))
    rows = rows.withColumn("number", F.explode(F.sequence(F.lit(0), F.col("edits"))))
    start = F.floor(F.col("number") * F.col("size") / (F.col("edits") + 1)).cast("int")
    span = F.floor((F.col("number") + 1) * F.col("size") / (F.col("edits") + 1)).cast("int") - start
    shift = _allowed_edits(F.greatest(F.length("text"), F.col("size")), threshold)
    first, last = F.greatest(start - shift, F.lit(0)), F.least(start + shift, F.length("text") - span)
    return rows.where(last >= first).select(
        F.col("text").alias("left"), "size", "number",
        F.explode(F.array_distinct(F.transform(F.sequence(first, last), lambda at: F.substr(F.col("text"), at + 1, span)))).alias("segment"),
    )


def similar_candidates(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """(left, right) pairs of the distinct texts of both sides (column ``text``) that are worth comparing.

    Short right texts with a rare beginning or end meet on subsequences of it
    (``functions/windows.py``), all others on segments. Pairs are compared where they meet, so
    only similar ones of the former are shuffled again.
    """
    left, right = write_out(left), write_out(right)
    placed = _placed(right, threshold)
    # sizes are as many as the longest text has characters
    rights = [tuple(r) for r in placed.groupBy("size", "place").agg(F.count("*").alias("n")).collect()]
    found = _subsequence_pairs(left, placed.where("place IS NOT NULL"), [r for r in rights if r[1] is not None], threshold)
    if all(place is not None for _, place, _ in rights):
        return found
    # a text of either kind is in one of the two, so no pair comes twice
    return found.unionByName(_segment_candidates(left, placed.where("place IS NULL").select("text"), threshold))


def _placed(texts: DataFrame, threshold: float) -> DataFrame:
    """(text, size, place): the end at which a short text is rare, NULL where neither is, and for long ones."""
    n = texts.count()
    # of short texts alone: so the common words are at most some thousands for each word a text may have
    words = texts.where(F.length("text") <= W.longest_short(threshold)).select(F.explode(F.split("text", " ")).alias("word"))
    common = words.where("word <> ''").groupBy("word").agg(F.count("*").alias("df")).where(F.col("df") > max(1, n // COMMON_SHARE))
    shared = {r["word"]: r["df"] for r in common.collect()}
    return write_out(texts.select("text").mapInArrow(W.placed_texts(shared, n, threshold), "text string, size int, place int"))


def _subsequence_pairs(left: DataFrame, right: DataFrame, rights: list[tuple[int, int, int]], threshold: float) -> DataFrame:
    """(left, right), distinct: the similar pairs of ``right`` (text, size, place), which has ``rights`` (size, place, count).

    Keys are made, shuffled and compared in waves of ``WAVE_KEYS``.
    """
    lefts = left.select("text", F.length("text").alias("size"), F.lit(0).alias("place"))
    near = sorted({n for s, _, _ in rights for n in W.similar_sizes(s, threshold)})
    lefts = lefts.where(F.col("size").isin(near))
    sizes = {r["size"]: r["n"] for r in lefts.groupBy("size").agg(F.count("*").alias("n")).collect()}
    ends = [(s, place) for s, place, _ in rights]
    of_left = {(n, 0): W.kinds_of_left(n, ends, threshold) for n in sizes}
    of_right = {(s, place): {(*kind, place) for kind in W.kinds_of_right(s, sizes, threshold)} for s, place in ends}
    keys = sum(sizes[n] * W.key_count(k[:3], n) for (n, _), kinds in of_left.items() for k in kinds)
    keys += sum(count * W.key_count(k[:3], s) for s, place, count in rights for k in of_right[s, place])
    waves = max(1, -(-keys // WAVE_KEYS))
    found = None
    for wave in range(waves):
        a = lefts.mapInArrow(W.keyed_texts(of_left, wave, waves), "key bigint, text string").withColumnRenamed("text", "left")
        b = right.mapInArrow(W.keyed_texts(of_right, wave, waves), "key bigint, text string").withColumnRenamed("text", "right")
        edits = F.levenshtein(F.col("left"), F.col("right"), W.MOST_EDITS)
        longer = F.greatest(F.length("left"), F.length("right"))
        # what a scan in Python makes is many times as long as Spark takes it for
        pairs = a.hint("merge").join(b, "key").where((edits >= 0) & (edits <= _allowed_edits(longer, threshold))).select("left", "right").distinct()
        pairs = write_out(pairs)
        found = pairs if found is None else found.unionByName(pairs)
    return found if waves == 1 else found.distinct()


def _segment_candidates(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """As ``similar_candidates``: texts meet on even segments.

    A segment that would pair more than ``HOT_PAIRS`` texts takes its right texts out; those
    are cut by rarity instead (``balanced_segments``).
    """
    # only the texts are written out: their windows are many times as long
    lefts, rights = _even_left(left, threshold), _even_right(right, threshold)
    hashed = F.xxhash64("size", "number", "segment").alias("key")
    lefts, rights = lefts.select("left", hashed), rights.select("right", hashed)
    load = lefts.groupBy("key").agg(F.count("*").alias("a")).join(rights.groupBy("key").agg(F.count("*").alias("b")), "key")
    hot = write_out(
        rights.join(load.where(F.col("a") * F.col("b") > HOT_PAIRS), "key", "left_semi").select(F.col("right").alias("text")).distinct()
    )
    calm = _even_right(right.join(hot, "text", "left_anti"), threshold).select("right", hashed)
    met = lefts.join(calm, "key").select("left", "right").distinct()
    # a text of either kind is in one of the two, so no pair comes twice
    return met if hot.isEmpty() else met.unionByName(_balanced_candidates(left, hot, threshold))


def _without_one(text: Column) -> Column:
    """The distinct texts that lack one character of ``text``."""
    return F.array_distinct(F.transform(
        F.sequence(F.lit(1), F.length(text)), lambda at: F.concat(F.substr(text, F.lit(1), at - 1), F.substr(text, at + 1))
    ))


def _balanced_candidates(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """As ``similar_candidates``, by segments of equal rarity.

    Of the segments of a right text one has at most one edit. The first stands at the
    beginning of a similar left text, the last at its end, any other near its own place. Two
    texts of one length that one edit tells apart, or a text and the window of its length at
    such a place, are equal once each lacks one character, so they meet on these variants. Segments are as long as
    few edits allow, so names that share a word still differ in most of them.
    """
    cut = write_out(balanced_segments(right, threshold))
    parts = cut.select("text", F.size("segments").alias("cuts"), F.posexplode("segments").alias("number", "s")).select(
        F.col("text").alias("right"), F.length("text").alias("size"),
        F.when(F.col("number") == 0, 0).when(F.col("number") == F.col("cuts") - 1, -1).otherwise(F.col("s.start")).alias("place"),
        F.length("s.segment").alias("span"), F.col("s.segment").alias("segment"),
    )
    keys = parts.select("right", F.explode(_without_one(F.col("segment"))).alias("variant"), "place", "span")
    # left texts are cut only into what some right text of a possible size has there
    kinds = parts.select("size", "place", "span").distinct()
    sized = left.select(F.col("text").alias("left"), F.explode(_sizes(threshold)).alias("size"))
    length, place, span = F.length("left"), F.col("place"), F.col("span")
    kinds = write_out(kinds)
    asked = sized.join(F.broadcast(kinds) if kinds.count() <= FEW_KINDS else kinds, "size").withColumn("edits", _allowed_edits(F.greatest(length, F.col("size")), threshold))
    asked = asked.groupBy("left", "place", "span").agg(F.max("edits").alias("edits"))
    starts = (
        F.when(place == 0, F.array(F.lit(0))).when(place == -1, F.array(F.greatest(length - span, F.lit(0))))
        .otherwise(F.sequence(F.greatest(place - F.col("edits"), F.lit(0)), place + F.col("edits")))
    )
    windows = asked.withColumn("at", F.explode(starts)).select("left", "place", "span", F.substr(F.col("left"), F.col("at") + 1, span).alias("window"))
    # a window that the end of the text cuts short by one character lacks it already
    lacking = F.when(F.length("window") == span, _without_one(F.col("window"))).when(F.length("window") == span - 1, F.array("window"))
    pieces = windows.select("left", F.explode(lacking).alias("variant"), "place", "span")
    hashed = F.xxhash64("place", "span", "variant").alias("key")
    return pieces.select("left", hashed).join(keys.select("right", hashed), "key").select("left", "right").distinct()


def similar_join(left: DataFrame, left_text: str, right: DataFrame, right_text: str, threshold: float) -> DataFrame:
    """Pairs whose similarity 1 - edits / longer length is at least ``threshold``; exact."""
    def texts(rows: DataFrame, column: str) -> DataFrame:
        return rows.where(F.length(column) > 0).select(F.col(column).alias("text")).distinct()

    pairs = similar_candidates(texts(left, left_text), texts(right, right_text), threshold)
    longer = F.greatest(F.length("left"), F.length("right"))
    edits = F.levenshtein(F.col("left"), F.col("right"))
    close = pairs.withColumn("_edits", edits).where(F.col("_edits") <= _allowed_edits(longer, threshold)).select(
        F.col("left").alias(left_text), F.col("right").alias(right_text), (1.0 - F.col("_edits") / longer).alias("similarity")
    )
    return left.join(close, left_text).join(right, right_text).select(*left.columns, *right.columns, "similarity").dropDuplicates()
