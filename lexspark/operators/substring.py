"""Substring lookups on a stored positional gram index of distinct texts.

Every text of a scope (a jurisdiction, a country) has a posting (gram, scope, text id,
position) for each of its character grams of length ``GRAM``; the shorter ends of a text are
grams too. Where a gram is frequent, the posting is split by what follows: the gram of
twice the length at that place is stored as well, and so on for ``LEVELS`` lengths.

A key is found by its grams: a text that contains it has each of them, at the key's
offsets. The frequency table tells which are rarest in the key's scope, and that a key with
an unknown gram is nowhere. The two rarest meet on (text, start of the key), and only
texts that have both are fetched, by id, and compared. Texts never enter a gram
shuffle; a key whose grams are frequent one by one is looked up by the longer ones, so
candidates grow with keys and matches, not with their product.

An index pays where many calls read it. A single call asks the other way round
(``occurrences``): the keys' heads, lengths and last characters go to every task, and the
rows are read once and send only the substrings of such a shape.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspark.session import cut_lineage

GRAM = 4
LEVELS = 3
# postings of a gram beyond which the places it stands at get a longer one
FREQUENT = 256
# a gram with so few postings needs no second one beside it
RARE = 64
# so many hashes of frequent grams go to every task (2 MB), more are joined
FEW_GRAMS = 250_000
ANY = "*"
# so many probes go to every task that reads postings, more are joined by gram
FEW_PROBES = 50_000
# so many heads of keys go to every task; of more, only shorter ones
FEW_HEADS = 200_000
# so many keys go to every task, more meet their substrings in a shuffle
FEW_KEYS = 50_000


class SubstringIndex(NamedTuple):
    """``texts`` (text_id, scope, text, least, rows), ``postings`` (gram, scope, text_id, place) and their counts
    ``grams`` (gram, scope, level, shown, n, total), which has rows of scope ANY for all scopes together."""

    texts: DataFrame
    grams: DataFrame
    postings: DataFrame


def _hash(text: Column) -> Column:
    return F.xxhash64(text)


def _length(level: int) -> int:
    return GRAM << level


def _gram(text: str, place: str, level: int) -> Column:
    return F.substr(F.col(text), F.col(place) + 1, F.lit(_length(level)))


def substring_index(rows: DataFrame, text: str, scope: str, value: str) -> SubstringIndex:
    """Index of the distinct (``text``, ``scope``) pairs of ``rows``; each pair has its least ``value`` and its number of rows.

    A null or empty text is not indexed; a null scope is one that only unscoped keys see.
    """
    texts = (
        rows.where(F.length(text) > 0)
        .groupBy(F.col(text).alias("text"), F.coalesce(F.col(scope), F.lit("")).alias("scope"))
        .agg(F.min(value).alias("least"), F.count("*").alias("rows")).withColumn("text_id", _hash(F.col("text")))
    )
    texts = cut_lineage(texts.select("text_id", "scope", "text", "least", "rows"))
    postings, grams, frequent = None, None, None
    for level in range(LEVELS):
        # the ends of a text, shorter than a gram, are grams of the first level
        last = F.length("text") - (1 if level == 0 else _length(level))
        placed = texts.where(last >= 0).select("text_id", "scope", "text", F.explode(F.sequence(F.lit(0), last)).alias("place"))
        if level:
            few = frequent.count() <= FEW_GRAMS
            shorter = placed.withColumn("_short", _hash(_gram("text", "place", level - 1)))
            placed = shorter.join(F.broadcast(frequent) if few else frequent, "_short", "left_semi")
        shown = _gram("text", "place", 0) if level == 0 else F.lit(None).cast("string")
        found = placed.select(_hash(_gram("text", "place", level)).alias("gram"), "scope", "text_id", "place", shown.alias("shown"))
        counted = found.groupBy("gram", "shown", "scope").agg(F.count("*").alias("n")).withColumn("level", F.lit(level))
        counted = cut_lineage(counted)
        totals = counted.groupBy("gram").agg(F.sum("n").alias("n"))
        frequent = totals.where(F.col("n") > FREQUENT).select(F.col("gram").alias("_short"))
        found = found.drop("shown")
        postings = found if postings is None else postings.unionByName(found)
        grams = counted if grams is None else grams.unionByName(counted)
    totals = grams.groupBy("gram", "level", "shown").agg(F.sum("n").alias("total"))
    # both forms of a count in one table: a key needs one join to know its grams
    everywhere = totals.select("gram", F.lit(ANY).alias("scope"), "level", "shown", F.col("total").alias("n"), "total")
    scoped = grams.join(totals.select("gram", "total"), "gram").select(everywhere.columns)
    return SubstringIndex(texts, scoped.unionByName(everywhere), postings)


def write_substring_index(index: SubstringIndex, path: str) -> None:
    """Store an index under ``path``. Postings stay where they were made, sorted by gram, so that a frequent gram is in no file alone."""
    index.texts.write.mode("overwrite").parquet(f"{path}/texts")
    index.grams.write.mode("overwrite").parquet(f"{path}/grams")
    index.postings.sortWithinPartitions("gram").write.mode("overwrite").parquet(f"{path}/postings")


def read_substring_index(spark: SparkSession, path: str) -> SubstringIndex:
    """The index that ``write_substring_index`` stored."""
    return SubstringIndex(*(spark.read.parquet(f"{path}/{part}") for part in ("texts", "grams", "postings")))


def _grams_of(keys: DataFrame, index: SubstringIndex, levels: range) -> DataFrame:
    """(key, scope, offset, level, gram, n, total) of the grams of ``keys``; 0 for one that no text of the scope has."""
    places = keys.select("key", "scope", F.explode(F.sequence(F.lit(0), F.length("key") - GRAM)).alias("offset"))
    tries = F.array(*[F.struct(F.lit(n).alias("level"), F.lit(_length(n)).alias("size"), _hash(_gram("key", "offset", n)).alias("gram")) for n in levels])
    grams = places.select("key", "scope", "offset", F.inline(tries)).where(F.col("offset") + F.col("size") <= F.length("key"))
    return grams.drop("size").join(index.grams.select("gram", "scope", "n", "total"), ["gram", "scope"], "left").na.fill(0, ["n", "total"])


def _rarest(steps: DataFrame) -> DataFrame:
    """(key, scope, needed, ranked): the grams of a key, one for each offset, rarest first."""
    ranked = F.sort_array(F.collect_list(F.struct("n", "short", "offset", "gram")))
    one = (F.col("ranked")[0]["n"] <= RARE) | (F.size("ranked") == 1)
    return (
        steps.groupBy("key", "scope").agg(ranked.alias("ranked")).where(F.col("ranked")[0]["n"] > 0)
        .withColumn("needed", F.when(one, 1).otherwise(2))
    )


def _long_probes(keys: DataFrame, index: SubstringIndex) -> DataFrame:
    """(key, scope, gram, offset, needed): the rarest one or two grams of every key of at least GRAM characters that may be somewhere."""
    first = cut_lineage(_rarest(_grams_of(keys.where(F.length("key") >= GRAM), index, range(1)).withColumn("short", F.lit(0))))
    known = first.where(F.col("ranked")[0]["n"] <= FREQUENT)
    # keys of frequent grams alone: a longer gram is stored wherever the shorter one is
    # frequent, so there its absence is the text's
    ladders = (
        _grams_of(first.where(F.col("ranked")[0]["n"] > FREQUENT).select("key", "scope"), index, range(LEVELS))
        .groupBy("key", "scope", "offset").agg(F.sort_array(F.collect_list(F.struct("level", "n", "total", "gram"))).alias("ladder"))
    )
    expected = F.filter("ladder", lambda step: (step["level"] == 0) | (F.get(F.col("ladder"), step["level"] - 1)["total"] > FREQUENT))
    best = F.array_min(F.transform(expected, lambda step: F.struct(step["n"].alias("n"), (-step["level"]).alias("short"), step["gram"].alias("gram"))))
    longer = _rarest(ladders.select("key", "scope", "offset", best.alias("best")).select("key", "scope", "offset", "best.*"))
    return known.unionByName(longer).select("key", "scope", "needed", F.inline(F.slice("ranked", F.lit(1), F.col("needed")))).select(
        "key", "scope", "gram", "offset", "needed"
    )


def _short_probes(keys: DataFrame, index: SubstringIndex) -> DataFrame:
    """As ``_long_probes`` for keys under GRAM characters: every gram that begins with the key."""
    first = index.grams.where((F.col("level") == 0) & (F.col("scope") == ANY)).select("gram", "shown")
    begins = first.select(
        "gram", F.explode(F.transform(F.sequence(F.lit(1), F.lit(GRAM - 1)), lambda n: F.when(F.length("shown") >= n, F.substr(F.col("shown"), F.lit(1), n)))).alias("key")
    ).where(F.col("key").isNotNull())
    return keys.where(F.length("key") < GRAM).join(begins, "key").select(
        "key", "scope", "gram", F.lit(0).alias("offset"), F.lit(1).alias("needed")
    )


def candidates(keys: DataFrame, index: SubstringIndex) -> DataFrame:
    """(key, scope, text_id, text_scope) of the texts to compare with each distinct key; ``scope`` ANY is all of them."""
    probes = cut_lineage(_long_probes(keys, index).unionByName(_short_probes(keys, index)))
    scopes = index.grams.where(F.col("scope") != ANY).select("gram", F.col("scope").alias("text_scope"))
    placed = probes.where(F.col("scope") != ANY).withColumn("text_scope", F.col("scope")).unionByName(
        probes.where(F.col("scope") == ANY).join(scopes, "gram")
    )
    postings = index.postings.withColumnRenamed("scope", "text_scope")
    few = probes.count() <= FEW_PROBES
    met = postings.join(F.broadcast(placed) if few else placed, ["gram", "text_scope"]).select(
        "key", "scope", "text_scope", "text_id", "needed", (F.col("place") - F.col("offset")).alias("start")
    )
    single = met.where(F.col("needed") == 1)
    both = met.where(F.col("needed") == 2).groupBy("key", "scope", "text_scope", "text_id", "start").agg(F.count("*").alias("n")).where(F.col("n") == 2)
    columns = ["key", "scope", "text_id", "text_scope"]
    return single.select(*columns).unionByName(both.select(*columns)).distinct()


def containing(keys: DataFrame, index: SubstringIndex, key: str = "key", scope: str = "scope") -> DataFrame:
    """(key, scope, text_id, text_scope, text, least, rows): the texts of its scope that contain each distinct key.

    A null scope, and ANY, mean all scopes; a null or empty key is in no text.
    """
    asked = keys.where(F.length(key) > 0).select(F.col(key).alias("key"), F.coalesce(F.col(scope), F.lit(ANY)).alias("scope")).distinct()
    texts = index.texts.withColumnRenamed("scope", "text_scope")
    return candidates(asked, index).join(texts, ["text_id", "text_scope"]).where(F.contains(F.col("text"), F.col("key")))


def _asked(keys: DataFrame, key: str, scope: str) -> DataFrame:
    """The distinct (key, scope) that can be somewhere; a null scope is ANY."""
    return keys.where(F.length(key) > 0).select(F.col(key).alias("key"), F.coalesce(F.col(scope), F.lit(ANY)).alias("scope")).distinct()


def _shapes(asked: DataFrame) -> tuple[DataFrame, list[int]]:
    """(head, sizes: the lengths of the keys with that head and the last characters they have), and the lengths of the heads."""
    for gram in range(GRAM, 0, -1):
        head = F.substring("key", 1, gram)
        ends = asked.groupBy(head.alias("head"), F.length("key").alias("size")).agg(F.array_join(F.collect_set(F.right("key", F.lit(1))), "").alias("ends"))
        shapes = cut_lineage(ends.groupBy("head").agg(F.sort_array(F.collect_list(F.struct("size", "ends"))).alias("sizes")))
        if gram == 1 or shapes.count() <= FEW_HEADS:
            return shapes, sorted(r[0] for r in shapes.select(F.length("head")).distinct().collect())


def _occurrences(asked: DataFrame, rows: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """(keep..., key): the substrings of ``text`` that are shaped like a key, which all its keys are; some are no key."""
    shapes, lengths = _shapes(asked)
    length = F.length("_text")
    placed = rows.select(*keep, F.col(text).alias("_text")).where(length > 0).select(
        *keep, "_text", F.explode(F.sequence(F.lit(0), length - 1)).alias("_place")
    )
    heads = F.array(*[F.when(F.col("_place") + n <= length, F.substr("_text", F.col("_place") + 1, F.lit(n))) for n in lengths])
    met = placed.select("*", F.explode(heads).alias("head")).join(F.broadcast(shapes), "head")
    fits = F.filter("sizes", lambda s: (F.col("_place") + s["size"] <= length) & F.contains(s["ends"], F.substr(F.col("_text"), F.col("_place") + s["size"], F.lit(1))))
    found = met.select(*keep, "_text", "_place", F.explode(F.transform(fits, lambda s: s["size"])).alias("_size")).select(
        *keep, F.substr("_text", F.col("_place") + 1, F.col("_size")).alias("key")
    )
    known = asked.select("key").distinct()
    return found.join(F.broadcast(known), "key", "left_semi") if known.count() <= FEW_KEYS else found


def occurrences(
    keys: DataFrame, rows: DataFrame, text: str, text_scope: str, keep: list[str], key: str = "key", scope: str = "scope"
) -> DataFrame:
    """(key, scope, keep...), distinct: the rows of its scope whose text contains each key, without an index; scopes as of ``containing``."""
    asked = cut_lineage(_asked(keys, key, scope))
    # ``keep`` may hold the scope under any name
    scoped = rows.withColumn("_scope", F.coalesce(F.col(text_scope), F.lit("")))
    found = _occurrences(asked, scoped, text, ["_scope", *keep])
    return _in_scope(asked, found).select("key", "scope", *keep).distinct()


def least_containing(
    keys: DataFrame, rows: DataFrame, text: str, text_scope: str, value: str, key: str = "key", scope: str = "scope"
) -> DataFrame:
    """(key, scope, least): the least ``value`` of the rows of its scope whose text contains each key, without an index.

    Scopes are those of ``containing``. Only substrings shaped like a key leave the scan, one for each task.
    """
    asked = cut_lineage(_asked(keys, key, scope))
    scoped = rows.select(F.col(text).alias("_row"), F.coalesce(F.col(text_scope), F.lit("")).alias("_scope"), F.col(value).alias("_value"))
    found = _occurrences(asked, scoped, "_row", ["_scope", "_value"]).groupBy("key", "_scope").agg(F.min("_value").alias("_value"))
    return _in_scope(asked, found).groupBy("key", "scope").agg(F.min("_value").alias("least"))


def _in_scope(asked: DataFrame, found: DataFrame) -> DataFrame:
    return asked.join(found, "key").where((F.col("scope") == ANY) | (F.col("scope") == F.col("_scope")))
