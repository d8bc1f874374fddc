"""Exact Jaccard join of documents by grouped prefixes, up to connected components.

A document is the set of its word shingles. Documents with equal sets are one class. A class with too many shingles
that no other class has can't link with any and is left out. The shingles of the others are
ordered by how many classes have them; two sets that link share a shingle of their prefixes. Classes
with equal size and prefix are one group, and pairs of groups are filtered by size and position
before their members are compared in full.

Only connectivity is wanted, so a first round compares each class with the most central class for each shingle of
its prefix. The second round takes all remaining pairs of groups, between different components only; this
loses no link between components, and copies of one text are never paired with each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinara.llm.components import connected
from opinara.llm.shared import count_once, let, lower_ascii, words_of
from opinara.workspace import stored

#: Words in a shingle and the similarity, in percent, from which documents link.
WIDTH, LINK = 4, 85
#: Not more classes than this are broadcast to be looked up; more are joined as Spark plans it.
MOST_BROADCAST = 500_000


def shingles(text: Column, width: int = WIDTH) -> Column:
    """Hashes of the distinct shingles, in order; a shorter text is one shingle, a text without words none.

    A hash of 64 bits stands for a shingle.
    """

    def hashed(words: Column) -> Column:
        n = F.size(words)
        many = F.transform(F.sequence(F.lit(1), n - width + 1), lambda i: F.xxhash64(F.slice(words, i, F.lit(width))))
        return F.when(n >= width, many).when(n > 0, F.array(F.xxhash64(words))).otherwise(F.array().cast("array<bigint>"))

    return F.sort_array(F.array_distinct(let(words_of(lower_ascii(F.coalesce(text, F.lit("")))), hashed)))


def _at_least(n: Column, link: int) -> Column:
    """The smallest overlap of a set of this size with any set it links with."""
    return F.floor((n * link + 99) / 100)


def _needed(n: Column, m: Column, link: int) -> Column:
    """The smallest overlap of two linked sets."""
    return F.ceil((n + m) * link / (100 + link))


def _sizes_fit(n: Column, m: Column, link: int) -> Column:
    return 100 * F.least(n, m) >= link * F.greatest(n, m)


def _verified(pairs: DataFrame, sets: DataFrame, link: int) -> DataFrame:
    """The pairs (a, b) of classes that link."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("of_a"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("of_b"))
    both = pairs.join(left, "a").join(right, "b")
    sized = both.select("a", "b", F.size(F.array_intersect("of_a", "of_b")).alias("common"), (F.size("of_a") + F.size("of_b")).alias("total"))
    return sized.where(100 * F.col("common") >= link * (F.col("total") - F.col("common"))).select("a", "b")


def _candidates(classes: DataFrame, link: int) -> DataFrame:
    """Classes that share enough shingles with others to have a link, by the shingles of one part of the hashes.

    The part is wide enough that the shingles a linked set may have alone don't fill it.
    """
    part = classes.select("node", F.explode("part").alias("shingle"))
    alone = part.groupBy("shingle").agg(F.min("node").alias("node"), F.max("node").alias("other")).where("node = other")
    alone = alone.groupBy("node").agg(F.count(F.lit(1)).alias("alone"))
    distinct = classes.groupBy("node").agg(F.min("key").alias("key"), F.max("n").alias("n"))
    may = F.coalesce("alone", F.lit(0)) <= F.col("n") - _at_least(F.col("n"), link)
    return distinct.join(alone, "node", "left").where(may).select("node", "key", "n")


def _prefixes(sets: DataFrame, link: int) -> DataFrame:
    """Per class: size, shingles it alone has, and its prefix of shared shingles, rarest first."""
    each = sets.select("node", F.size("shingles").alias("n"), F.explode("shingles").alias("shingle"))
    shared = stored(each.groupBy("shingle").agg(F.count(F.lit(1)).alias("classes")).where("classes > 1"), "shared-shingles")
    listed = each.join(shared, "shingle").groupBy("node", "n").agg(F.collect_list(F.struct("classes", "shingle")).alias("shared"))
    alone = F.col("n") - F.size("shared")
    reach = F.col("n") - _at_least(F.col("n"), link) + 1 - F.col("alone")
    listed = listed.withColumn("alone", alone).withColumn("reach", reach.cast("int")).where("reach > 0")
    prefix = F.slice(F.array_sort("shared"), F.lit(1), F.col("reach"))["shingle"]
    return listed.select("node", "n", "alone", prefix.alias("prefix")).withColumn("group", F.xxhash64("n", "alone", "prefix"))


def _can_link(x: str, y: str, link: int) -> Column:
    """Size and position filter for groups ``x`` and ``y`` that have a shingle at their places ``at``.

    Of the overlap, the part up to the place is at most the shared shingles up to it, the part
    after it at most the shorter rest. The smaller group has the first common shingle within a
    shorter prefix, since what it links with is no smaller than itself.
    """
    n, m = F.col(f"{x}.n"), F.col(f"{y}.n")
    up_to = F.least(F.col(f"{x}.at") - F.col(f"{x}.alone"), F.col(f"{y}.at") - F.col(f"{y}.alone"))
    after = F.least(n - F.col(f"{x}.at"), m - F.col(f"{y}.at"))
    smaller, at = F.least(n, m), F.when(n <= m, F.col(f"{x}.at")).otherwise(F.col(f"{y}.at"))
    return _sizes_fit(n, m, link) & (up_to + after >= _needed(n, m, link)) & (at <= smaller - _needed(smaller, smaller, link) + 1)


def _links(sets: DataFrame, link: int) -> DataFrame:
    """(node, root) for every class that links with another."""
    prefixes = stored(_prefixes(sets, link), "prefixes")
    members = prefixes.select("node", "group", "n")
    places = prefixes.select("group", "n", "alone", F.posexplode("prefix").alias("i", "shingle"))
    places = places.select("shingle", "group", "n", "alone", (F.col("alone") + F.col("i") + 1).alias("at")).distinct()
    places = stored(places, "prefix-places")
    heads = members.groupBy("group").agg(F.min("node").alias("head"))

    # First round: each group with the group that has fewest shingles of its own, for each shingle.
    centre = F.min(F.struct("alone", "group", "n", "at")).alias("c")
    centres = stored(places.groupBy("shingle").agg(centre, F.count(F.lit(1)).alias("k")).where("k > 1").select("shingle", "c"), "centres")
    near = places.alias("p").join(centres, "shingle").where(F.col("p.group") != F.col("c.group")).where(_can_link("p", "c", link))
    near = stored(near.select("p.group", F.col("c.group").alias("centre")).distinct(), "group-pairs")
    to_centre = members.join(near, "group").join(heads.select(F.col("group").alias("centre"), "head"), "centre")
    in_group = members.join(stored(heads, "group-heads"), "group")
    star = to_centre.select(F.col("node").alias("a"), F.col("head").alias("b")).union(in_group.select(F.col("node").alias("a"), F.col("head").alias("b")))
    star = stored(_verified(stored(star.where("a <> b").distinct(), "star-pairs"), sets, link), "star-links")
    roots = stored(connected(star), "roots")

    # Second round: all pairs of groups in different components.
    placed = stored(members.join(roots, "node", "left").select("node", "group", F.coalesce("root", "node").alias("root")), "placed")
    units = places.join(placed.select("group", "root").distinct(), "group")
    mixed = units.groupBy("shingle").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least <> most").select("shingle")
    units = stored(units.join(stored(mixed, "mixed-shingles"), "shingle"), "units")
    x, y = units.alias("x"), units.alias("y")
    met = x.join(y, F.col("x.shingle") == F.col("y.shingle")).where((F.col("x.root") < F.col("y.root")) & _can_link("x", "y", link))
    sides = [F.col(f"{s}.{c}").alias(f"{s}_{c}") for s in "xy" for c in ("group", "root", "n")]
    met = met.select(*sides, F.col("x.at").alias("x_at"), F.col("y.at").alias("y_at"))
    met = met.groupBy([c for c in met.columns if not c.endswith("_at")]).agg(F.count(F.lit(1)).alias("k"), F.max("x_at").alias("i"), F.max("y_at").alias("j"))
    most = F.col("k") + F.least(F.col("x_n") - F.col("i"), F.col("y_n") - F.col("j"))
    met = met.where(most >= _needed(F.col("x_n"), F.col("y_n"), link))
    pairs = stored(met.select("x_group", "x_root", "y_group", "y_root"), "group-pairs")
    for s, name in (("x", "a"), ("y", "b")):
        side = placed.select(F.col("group").alias(f"{s}_group"), F.col("root").alias(f"{s}_root"), F.col("node").alias(name))
        pairs = pairs.join(side, [f"{s}_group", f"{s}_root"])
    more = stored(_verified(stored(pairs.select("a", "b").distinct(), "pairs"), sets, link), "links")
    return connected(star.union(more))


def _rows_and_roots(df: DataFrame, key: str, text: str, width: int, link: int, hashed: bool = False) -> tuple[DataFrame, DataFrame]:
    """Per row its key, the hash of its text if ``hashed``, its class ``node`` and ``n`` shingles; and per linked class its ``root``."""
    low = max(2, 60 // (100 - link))
    part = lambda s: F.filter(s, lambda x: F.pmod(x, F.lit(low)) == 0)
    body = shingles(F.col(f"`{text}`"), width)
    rows = df.select(
        F.col(f"`{key}`").alias("key"),
        *([F.xxhash64(f"`{text}`").alias("hash")] if hashed else []),
        let(body, lambda s: F.struct(F.xxhash64(s).alias("node"), F.size(s).cast("long").alias("n"), part(s).alias("part"))).alias("s"),
    )
    rows = stored(rows.select("key", *["hash"] * hashed, "s.*"), "shingle-classes")
    classes = rows.where("n > 0")
    wanted = stored(_candidates(classes, link), "linkable-classes")
    few = count_once(wanted, MOST_BROADCAST) <= MOST_BROADCAST
    wanted = wanted.select("node", F.col("key").alias("wanted"))
    again = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    again = again.join(F.broadcast(wanted) if few else wanted, F.col("key").eqNullSafe(F.col("wanted")))
    # Tested on the written table: above the join the test would become a key of it, and every text would be shingled.
    made = stored(again.select("node", shingles(F.col("text"), width).alias("shingles")), "looked-up-sets")
    sets = stored(made.where(F.col("node") == F.xxhash64("shingles")).dropDuplicates(["node"]), "shingle-sets")
    return rows.drop("part"), _links(sets, link)


def jaccard_components(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, link: int = LINK) -> DataFrame:
    """Per row of ``df``: its key, ``n_shingles`` and ``component_id``, the smallest key reachable by links.

    A null, empty or wordless text has no shingles and its own key as component. Rows with equal texts, repeated
    rows too, are in one component. A null key counts as larger than any other. An empty table gives
    no rows. Columns besides key and text are not looked at.
    """
    rows, roots = _rows_and_roots(df, key, text, width, link)
    least = rows.where("n > 0").groupBy("node").agg(F.min("key").alias("least"))
    rooted = least.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component"))
    component = stored(rooted.join(smallest, "root").select("node", "component"), "components")
    found = rows.join(component, "node", "left")
    return found.select(
        F.col("key").alias(key),
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("key")).alias("component_id"),
    )


def one_of_each(df: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, link: int = LINK) -> DataFrame:
    """One row of each component with all its columns: that of the smallest key, then text hash; null keys come last.

    Rows are named by key and text, so that rows which share an id, or have none, are judged one by one. Rows that
    repeat both are the same document, and all stay or go. A text without shingles stays.
    """
    rows, roots = _rows_and_roots(df, key, text, width, link, hashed=True)
    rows = rows.where("n > 0")
    name = F.struct(F.col("key").isNull().alias("none"), "key", "hash")
    rooted = rows.groupBy("node").agg(F.min(name).alias("least")).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("first"))
    first = stored(rooted.join(smallest, "root").select("node", "first"), "first-of-component")
    gone = rows.join(first, "node").where(~name.eqNullSafe(F.col("first")))
    gone = stored(gone.select(F.col("key").alias("__gone"), F.col("hash").alias("__hash")).distinct(), "near-duplicates")
    small = count_once(gone, MOST_BROADCAST) <= MOST_BROADCAST
    same = F.col(f"`{key}`").eqNullSafe(F.col("__gone")) & (F.xxhash64(f"`{text}`") == F.col("__hash"))
    return df.join(F.broadcast(gone) if small else gone, same, "left_anti")
