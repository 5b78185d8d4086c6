"""Near-duplicate documents by MinHash with tensored banding, confirmed on full shingle sets.

A document has ``m`` small collections of ``r`` minhashes each. A table's key combines two collections, so
``m*(m-1)/2`` tables of ``2*r`` minhashes each cost ``m*r`` minhashes instead of ``m*(m-1)*r``: about the square
root. A pair of similarity s shares a table unless fewer than two collections agree: with r=2, m=10 that is a
chance of 7e-5 at s=0.85 and 1e-5 at 0.88; with m=12 1e-4 at 0.8.

Copies (equal sets) collapse to one representative first. In each table's bucket every member meets the smallest
one. The documents of buckets that this leaves in several components are settled among one another on their sets'
rarest shingles, again by representatives, until nothing is left that could be a link. So no link that a bucket
shows is lost, and a group of near copies, however large, costs its members and not its pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch, Words, arrow_map, column, distinct_sets, fresh, list_array, mix, need, shuffle_partitions, steps, texts

#: Documents up to which the ids of candidates are broadcast (8 bytes each); beyond it the texts are shuffled.
BROADCAST_IDS = 1_000_000
#: Rows of numbers that a file of a scratch table holds, and rows with arrays. Where adaptive execution joins no partitions,
#: Spark would write a file for each; for every file on a local file system Hadoop starts three processes beside its executor.
FILE_ROWS, FILE_ARRAYS = 50_000, 1_000


def _files(df: DataFrame, rows: int, of: int = FILE_ROWS) -> DataFrame:
    """``df``, which has no more than about ``rows`` rows, in as few partitions as hold ``of`` of them each."""
    return df.coalesce(1 + rows // of)


def _seeds(n: int) -> tuple[np.ndarray, np.ndarray]:
    x = mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
    return x[:n], x[n:] | np.uint64(1)


def sketches(docs: DataFrame, collections: int = 10, rows: int = 2, k: int = 5) -> DataFrame:
    """``doc_id, n_shingles, h1, h2, bands``: the size of a document's set, a 128-bit hash of it and its collections.

    A null or wordless text has an empty set: n_shingles 0 and no bands.
    """
    seeds, factors = _seeds(collections * rows)

    def run(batch: pa.RecordBatch):
        ids, values = column(batch, "doc_id"), texts(batch)
        for a, b in steps(values):
            h, first = distinct_sets(*Words(values[a:b]).shingles(k), b - a)
            n = np.diff(first)
            some = np.flatnonzero(n)
            bands = np.zeros((len(some), collections), np.uint64)
            if len(some):
                at = first[:-1][some]
                for c in range(collections):
                    for r in range(rows):
                        i = c * rows + r
                        least = np.minimum.reduceat((h ^ seeds[i]) * factors[i], at)
                        bands[:, c] = mix(bands[:, c] + least)
                sums = [np.add.reduceat(mix(h ^ s), at) for s in seeds[:2]]
            h1, h2 = np.zeros(b - a, np.uint64), np.zeros(b - a, np.uint64)
            if len(some):
                h1[some], h2[some] = sums
            offsets = np.concatenate([[0], np.cumsum(np.where(n > 0, collections, 0))])
            yield {"doc_id": ids[a:b], "n_shingles": n, "h1": h1.view(np.int64), "h2": h2.view(np.int64), "bands": list_array(bands.reshape(-1).view(np.int64), offsets)}

    return arrow_map(need(docs, doc_id="long", text="string"), run, "doc_id long, n_shingles long, h1 long, h2 long, bands array<long>")


def shingle_sets(docs: DataFrame, k: int = 5) -> DataFrame:
    """``doc, shingles``: each document's whole set as ascending 64-bit hashes."""

    def run(batch: pa.RecordBatch):
        ids, values = column(batch, "doc_id"), texts(batch)
        for a, b in steps(values):
            h, first = distinct_sets(*Words(values[a:b]).shingles(k), b - a)
            yield {"doc": ids[a:b], "shingles": list_array(h.view(np.int64), first)}

    return arrow_map(need(docs, doc_id="long", text="string"), run, "doc long, shingles array<long>")


def connected_components(spark: SparkSession, edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``doc, root``: the smallest vertex that each vertex of ``edges`` (a, b) reaches, by alternating large and
    small stars. Each round is written, read back and its predecessor dropped; only a fingerprint comes to the driver.
    """
    rows = edges.count()

    def stars(e: DataFrame) -> DataFrame:
        both = e.select(F.col("a").alias("v"), F.col("b").alias("u")).unionByName(e.select(F.col("b").alias("v"), F.col("a").alias("u")))
        low = both.groupBy("v").agg(F.min("u").alias("m")).select("v", F.least("m", "v").alias("m"))
        return both.where("u > v").join(low, "v").where("u != m").select(F.col("m").alias("a"), F.col("u").alias("b"))

    def small(e: DataFrame) -> DataFrame:
        # a < b in every edge: each b gathers its smaller neighbours around the smallest
        low = e.groupBy("b").agg(F.min("a").alias("m"))
        near = e.join(low, "b")
        return near.select(F.col("m").alias("a"), "b").unionByName(near.where("a != m").select(F.col("m").alias("a"), F.col("a").alias("b"))).distinct()

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now = scratch.write(_files(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), rows), "edges")
    seen = mark(now)
    while seen[0]:
        after = scratch.write(_files(small(stars(now)), rows), "stars")
        new = mark(after)
        scratch.drop(now)
        now = after
        if new == seen:
            break
        seen = new
    roots = now.select(F.col("b").alias("doc"), F.col("a").alias("root")).unionByName(now.select(F.col("a").alias("doc"), F.col("a").alias("root"))).distinct()
    return _files(roots, 2 * rows)


def _close(n1: Column, n2: Column, num: int, den: int) -> Column:
    """A bound on sizes that every link satisfies."""
    return F.least(n1, n2) * den >= F.greatest(n1, n2) * num


def _confirm(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose full sets have intersection/union of at least num/den."""
    b = sets.select(F.col("doc").alias("b"), F.col("shingles").alias("sb"))
    a = sets.select(F.col("doc").alias("a"), F.col("shingles").alias("sa"))
    both = F.size(F.array_intersect("sa", "sb"))
    return pairs.join(b, "b").join(a, "a").withColumn("i", both).where(F.col("i") * den >= (F.size("sa") + F.size("sb") - F.col("i")) * num).select("a", "b")


def _prefixes(sets: DataFrame, num: int, den: int) -> DataFrame:
    """``doc, n, own, prefix, last, rest``: of each set the rarest shingles among which it shares one with any set that it links with.

    With the shingles of all sets in one order, two sets of similarity t share one of their first
    n - ceil(t*n) + 1. In the order of frequency those are a document's own ones, which no other holds and which
    are left out (``own`` many): what differs too much from everything drops out, however large the group.
    last: the prefix's end in that order; rest: how many shared shingles come after it.
    """
    named = sets.select("doc", F.xxhash64("doc", "shingles").alias("set"), "shingles")
    flat = named.select("set", F.explode("shingles").alias("s"))
    often = flat.groupBy("s").agg(F.count("*").alias("df")).where("df > 1")
    shared = flat.join(often, "s").groupBy("set").agg(F.array_sort(F.collect_list(F.struct("df", "s"))).alias("held"))
    whole = named.select("set", "doc", F.size("shingles").alias("n")).join(shared, "set")
    # shingles of its own come first in the order
    cut = whole.withColumn("own", F.col("n") - F.size("held")).withColumn("room", (F.col("n") - F.ceil(F.col("n") * num / den) + 1 - F.col("own")).cast("int"))
    cut = cut.where("room > 0").withColumn("first", F.slice("held", 1, F.col("room")))
    return cut.select("doc", "n", "own", F.transform("first", lambda x: x["s"]).alias("prefix"), F.element_at("first", -1).alias("last"), (F.size("held") - F.size("first")).alias("rest"))


def _room(x: str, y: str, num: int, den: int) -> Column:
    """Whether sets of such prefixes can link: where one's prefix ends first, what it shares with the other is in both
    prefixes or after that end.
    """
    at = lambda t, c: F.col(f"{t}.{c}")
    most = F.size(F.array_intersect(at(x, "prefix"), at(y, "prefix"))) + F.when(at(x, "last") <= at(y, "last"), at(x, "rest")).otherwise(at(y, "rest"))
    return most * den >= (at(x, "n") + at(y, "n") - most) * num


def near_duplicates(docs: DataFrame, num: int = 85, den: int = 100, collections: int = 10, rows: int = 2, k: int = 5) -> DataFrame:
    """Classes of documents linked by Jaccard similarity of at least ``num/den`` over distinct k-word shingles.

    Returns ``doc_id, n_shingles, component_id, kept``, a row per input row: component_id is the smallest doc_id
    that links reach, and kept says whether it is the row's own. A null or wordless text links with nothing. Rows
    that share a doc_id are one document, linked through any of its texts. A row without doc_id takes no part:
    component_id is null and it is kept. An empty table gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "neardup")
    base = need(docs, doc_id="long", text="string")
    sketch = scratch.write(sketches(base, collections, rows, k), "sketches")
    named = sketch.where("n_shingles > 0 and doc_id is not null")
    first = named.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"))
    reps = named.join(first, ["h1", "h2"]).where("doc_id = rep").select(F.col("doc_id").alias("doc"), "bands").dropDuplicates(["doc", "bands"])
    copies = named.join(first, ["h1", "h2"]).where("doc_id != rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))

    pairs_of = [(i, j) for i in range(collections) for j in range(i + 1, collections)]
    keys = F.array(*(F.xxhash64(F.lit(t), F.col("bands")[i], F.col("bands")[j]) for t, (i, j) in enumerate(pairs_of)))
    # many rows come from each: dealt out, so that no task makes more than its share
    rows_of = reps.repartition(shuffle_partitions(spark), "doc").select("doc", F.explode(keys).alias("key"))
    shared = rows_of.groupBy("key").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).where("lo < hi").select("key", "lo")
    buckets = scratch.write(rows_of.join(shared, "key"), "buckets")

    # the sets of all documents that any bucket holds with another
    places = buckets.count()
    ids = scratch.write(_files(buckets.select("doc").distinct(), places), "candidates")

    def held(written: DataFrame) -> DataFrame:
        """Broadcast if its rows, of two numbers at most, are few enough."""
        return F.broadcast(written) if written.count() <= BROADCAST_IDS else written

    sets = scratch.write(shingle_sets(base.join(held(ids), base["doc_id"] == ids["doc"], "left_semi"), k), "sets", "lz4")
    scratch.drop(ids)
    sizes = sets.select("doc", F.size("shingles").alias("n"))

    def confirmed(pairs: DataFrame) -> DataFrame:
        """The pairs that link; of the sets only those that they name are moved."""
        some = scratch.write(pairs, "pairs")
        ids = some.select(F.explode(F.array("a", "b")).alias("doc")).distinct()
        ids = F.broadcast(ids) if 2 * some.count() <= BROADCAST_IDS else ids
        links = scratch.write(_confirm(some, sets.join(ids, "doc", "left_semi"), num, den), "links")
        scratch.drop(some)
        return links

    def worth(pairs: DataFrame) -> DataFrame:
        na, nb = sizes.select(F.col("doc").alias("a"), F.col("n").alias("na")), sizes.select(F.col("doc").alias("b"), F.col("n").alias("nb"))
        return pairs.join(na, "a").join(nb, "b").where(_close(F.col("na"), F.col("nb"), num, den)).select("a", "b").distinct()

    star = worth(buckets.where("doc != lo").select(F.col("lo").alias("a"), F.col("doc").alias("b")).distinct())
    parts = scratch.write(connected_components(spark, confirmed(_files(star, places)), scratch), "parts")

    # what is left: the documents of buckets that hold several components
    rooted = buckets.select("key", "doc").join(held(parts), "doc", "left").select("key", "doc", F.coalesce("root", "doc").alias("root"))
    open_keys = rooted.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x < y").select("key")
    open_keys = scratch.write(_files(open_keys, places), "open")
    open_docs = scratch.write(_files(rooted.join(held(open_keys), "key", "left_semi").select("doc").distinct(), places), "unsettled")
    rest = _prefixes(sets.join(held(open_docs), "doc", "left_semi"), num, den)
    rest = scratch.write(_files(rest, open_docs.count(), FILE_ARRAYS), "prefixes")

    def with_roots(rows: DataFrame) -> DataFrame:
        return rows.join(held(parts), "doc", "left").withColumn("root", F.coalesce("root", "doc"))

    # of each prefix shingle's holders the one with the fewest shingles of its own, which links with most, meets the
    # others; then the next eight meet those after them that are still of other components, and so on. A round keeps the
    # holders that come after the last round's, and of them the shingles' that hold several components
    key = W.partitionBy("key")
    rank = F.row_number().over(key.orderBy("own", "doc")) - 1
    left = with_roots(rest).withColumn("key", F.explode("prefix")).withColumn("rank", rank)
    high, read = 1, []
    holders = rest.agg(F.sum(F.size("prefix"))).first()[0] or 0
    while True:
        several_ = left.withColumn("lo", F.min("root").over(key)).withColumn("hi", F.max("root").over(key)).where("lo < hi").drop("lo", "hi")
        ranked = scratch.write(_files(several_, holders, FILE_ARRAYS), "ranked")
        holders = ranked.count()
        scratch.drop(*read)
        x, y = ranked.where(F.col("rank") < high).alias("x"), ranked.alias("y")
        # what is a set's own is in no other
        most = F.least(F.col("x.n") - F.col("x.own"), F.col("y.n") - F.col("y.own"))
        can = most * den >= (F.col("x.n") + F.col("y.n") - most) * num
        apart = (F.col("x.rank") < F.col("y.rank")) & (F.col("x.root") != F.col("y.root")) & can
        # of the shingles that show a pair, the smallest does
        shown = F.array_min(F.array_intersect("x.prefix", "y.prefix")) == F.col("x.key")
        pairs = x.join(y, (F.col("x.key") == F.col("y.key")) & apart & _room("x", "y", num, den) & shown).select(F.col("x.doc").alias("a"), F.col("y.doc").alias("b"))
        links = confirmed(pairs)
        more = not ranked.where(F.col("rank") >= high).isEmpty()
        if not links.isEmpty():
            parts = scratch.write(connected_components(spark, parts.where("doc != root").select(F.col("root").alias("a"), F.col("doc").alias("b")).unionByName(links), scratch), "parts")
        read = [ranked]
        if not more:
            break
        left, high = with_roots(ranked.where(F.col("rank") >= high).drop("root")), high * 9

    # an id with several texts joins what each of them belongs to
    several = named.groupBy("doc_id").agg(F.min(F.struct("h1", "h2")).alias("x"), F.max(F.struct("h1", "h2")).alias("y")).where("x != y").select("doc_id")
    bridges = scratch.write(copies.join(several, F.col("b") == F.col("doc_id"), "left_semi"), "bridges")
    if not bridges.isEmpty():
        parts = connected_components(spark, parts.where("doc != root").select(F.col("root").alias("a"), F.col("doc").alias("b")).unionByName(bridges), scratch)
    scratch.drop(buckets, sets, rest, bridges, *read)
    roots = parts.select(F.col("doc").alias("rep"), "root")
    found = sketch.where("doc_id is not null").join(first, ["h1", "h2"], "left").withColumn("rep", F.when(F.col("n_shingles") > 0, F.col("rep")).otherwise(F.col("doc_id")))
    # a bridged id is a vertex itself; another one belongs where its representative does
    own = parts.select(F.col("doc").alias("doc_id"), F.col("root").alias("own_root"))
    found = found.join(roots, "rep", "left").join(own, "doc_id", "left")
    found = found.select("doc_id", "n_shingles", F.least(F.coalesce("root", "rep"), F.coalesce("own_root", "doc_id")).alias("component_id"))
    found = found.withColumn("kept", F.col("doc_id") == F.col("component_id"))
    nameless = sketch.where("doc_id is null").select("doc_id", "n_shingles", F.lit(None).cast("long").alias("component_id"), F.lit(True).alias("kept"))
    return found.unionByName(nameless)


def keep_first(docs: DataFrame, num: int = 80, den: int = 100, **how: int) -> DataFrame:
    """The documents without those that a near duplicate with a smaller doc_id stands for, all columns kept.

    Of rows that share a doc_id one stays: that with the smallest text, and of equal texts with the smallest JSON of
    all columns. A row without doc_id stays. A null or wordless text stays. An empty table gives an empty result.
    """
    scratch = Scratch(docs.sparkSession, "kept")
    classes = near_duplicates(docs, num, den, **how)
    id_, rows, kept = fresh(docs, "id", "rows", "kept")
    ids = classes.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias(rows), F.min("kept").alias(kept))
    ids = scratch.write(ids.where(~F.col(kept) | (F.col(rows) > 1)).select(F.col("doc_id").alias(id_), kept), "special")
    same = F.col("doc_id").cast("long") == F.col(id_)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    once = docs.join(ids, same, "left_anti")
    repeated = docs.join(ids.where(kept), same, "left_semi").groupBy(F.col("doc_id").cast("long"))
    one = repeated.agg(F.min_by(F.struct(*columns), F.struct(F.col("text").cast("string"), F.to_json(F.struct(*columns)))).alias(kept))
    return once.unionByName(one.select(*(F.col(kept)[c].alias(c) for c in docs.columns)))
