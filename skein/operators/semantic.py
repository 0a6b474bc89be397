"""A store of answered queries that also answers similar ones.

stored: query, engine, vector, pos, title, url, content, one row for an item;
a query's vector stands in each of its rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.vectors import DIMENSIONS, let, vectorize
from skein.operators.dedup import first_by
from skein.operators.scan import checkpointed

THRESHOLD, SIMILAR, MOST = 0.7, 5, 50
#: Vectors of up to so many buckets are looked up by sets of these; a vector has up to 2 ** SHORT.
SHORT = 6


def stored_rows(items: DataFrame) -> DataFrame:
    """items (query, engine, pos, title, url, content) with the vector of their query."""
    return items.withColumn("vector", vectorize(F.col("query")))


def put(stored: DataFrame, items: DataFrame) -> DataFrame:
    """items in place of what is stored for their queries and engines."""
    new = stored_rows(items)
    return stored.join(new.select("query", "engine").distinct(), ["query", "engine"], "left_anti").unionByName(new)


def clear_query(stored: DataFrame, query: str) -> DataFrame:
    return stored.where(F.col("query") != query)


def _ranks(vectors: DataFrame) -> list[int]:
    """The place of each bucket in the order of how many vectors have it, rare ones first; a number for each of the DIMENSIONS buckets."""
    has = vectors.select(F.posexplode("vector").alias("bucket", "w")).where("w != 0").groupBy("bucket").count()
    count = {r.bucket: r["count"] for r in has.collect()}  # a row a bucket
    order = sorted(range(DIMENSIONS), key=lambda b: (count.get(b, 0), b))
    return [order.index(b) for b in range(DIMENSIONS)]


def _sparse(vector: Column, ranks: list[int]) -> Column:
    """rank, w and tail (the length of what is left from this one on) of the buckets that a vector has, by rank."""
    table = F.array(*map(F.lit, ranks))
    some = F.array_sort(F.filter(F.transform(vector, lambda w, i: F.struct(F.get(table, i).alias("rank"), w.alias("w"))), lambda x: x["w"] != 0))
    tail = lambda e, i: F.sqrt(F.aggregate(F.slice(e, i + 1, F.size(e)), F.lit(0.0), lambda a, x: a + x["w"] * x["w"]))
    return let(some, lambda e: F.transform(e, lambda x, i: F.struct(x["rank"].alias("rank"), x["w"].alias("w"), tail(e, i).alias("tail"))))


def _keys(e: Column, threshold: float) -> Column:
    """The keys of which a vector shares one with each other of at least this similarity.

    If two vectors share one bucket only, both have a weight of the threshold or
    more there. Else let a and b be the first two that they share, by rank: then
    their product is at most that of the lengths of what each has at a and from
    b on, so that each of these lengths is the threshold or more.
    """
    least = threshold - 1e-9
    alone = F.transform(F.filter(e, lambda x: x["w"] >= least), lambda x: F.struct(x["rank"].alias("a"), F.lit(-1).alias("b")))

    def after(x: Column, i: Column) -> Column:
        later = F.filter(F.slice(e, i + 2, F.size(e)), lambda y: F.sqrt(x["w"] * x["w"] + y["tail"] * y["tail"]) >= least)
        return F.transform(later, lambda y: F.struct(x["rank"].alias("a"), y["rank"].alias("b")))

    return F.concat(alone, F.flatten(F.transform(e, after)))


def keyed(vectors: DataFrame, name: str, ranks: list[int], threshold: float) -> DataFrame:
    """A row for each key of each distinct vector: e, name (the least that has it), key."""
    sparse = vectors.select(name, _sparse(F.col("vector"), ranks).alias("e")).groupBy("e").agg(F.min(name).alias(name))
    return sparse.select(name, "e", F.explode(_keys(F.col("e"), threshold)).alias("key"))


def _near_by_keys(theirs: DataFrame, mine: DataFrame, threshold: float, most: int) -> DataFrame:
    """asked, query and similarity of all pairs by the keys of two buckets; of queries of one vector the first ones.

    Pairs below the threshold without such a key are never formed. A pair is
    looked at for the first key that it shares only.
    """
    ranks = _ranks(theirs)
    a, b = keyed(mine, "asked", ranks, threshold), keyed(theirs, "query", ranks, threshold)
    pairs = a.withColumnRenamed("e", "_a").join(b.withColumnRenamed("e", "_b"), "key")
    shared = F.array_intersect(F.transform("_a", lambda x: x["rank"]), F.transform("_b", lambda x: x["rank"]))
    first = F.struct(F.get(shared, F.lit(0)).alias("a"), F.coalesce(F.get(shared, F.lit(1)), F.lit(-1)).alias("b"))
    weights = F.map_from_entries(F.transform("_b", lambda x: F.struct(x["rank"], x["w"])))
    product = F.aggregate("_a", F.lit(0.0), lambda acc, x: acc + x["w"] * F.coalesce(F.col("_w")[x["rank"]], F.lit(0.0)))
    near = pairs.where(F.col("key") == first).withColumn("_w", weights).select("asked", "query", F.least(F.lit(1.0), F.round(product, 9)).alias("similarity"))
    near = near.where(F.col("similarity") >= threshold)

    def members(df: DataFrame, name: str) -> DataFrame:
        """name of the distinct vector, and of each that has it."""
        of = df.select(name, _sparse(F.col("vector"), ranks).alias("e"))
        return of.join(of.groupBy("e").agg(F.min(name).alias("_rep")), "e").select(F.col("_rep").alias(name), F.col(name).alias(f"_each_{name}"))

    # Of queries of one vector the first ones are enough: all are equally near.
    w = Window.partitionBy("query").orderBy("_each_query")
    few = members(theirs, "query").withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")
    near = near.join(few, "query").join(members(mine, "asked"), "asked")
    return near.select(F.col("_each_asked").alias("asked"), F.col("_each_query").alias("query"), "similarity")


def _weights(vector: Column) -> Column:
    """bucket and w of the buckets that a vector has."""
    return F.filter(F.transform(vector, lambda w, i: F.struct(i.alias("bucket"), w.alias("w"))), lambda x: x["w"] != 0)


def _parts(e: Column, threshold: float, both: bool) -> Column:
    """buckets, weights and strong of the subsets of a vector's buckets of which a near vector may share no more.

    If two vectors share just these, their similarity is at most the product of
    the lengths of what each has in them. So both are of the threshold at
    least, and one of them, the strong one, of its root. strong tells it of
    this vector, or, where ``both``, of the other one, as far as it has to be.
    """
    slack = 1e-6

    def part(m: Column) -> Column:
        some = F.filter(e, lambda x, i: F.call_function("shiftright", m, i).bitwiseAND(F.lit(1)) == 1)
        square = F.aggregate(some, F.lit(0.0), lambda acc, x: acc + x["w"] * x["w"])
        return F.struct(F.transform(some, lambda x: x["bucket"]).alias("buckets"), F.transform(some, lambda x: x["w"]).alias("weights"), square.alias("square"))

    parts = F.filter(F.transform(F.sequence(F.lit(1), F.call_function("shiftleft", F.lit(1), F.size(e)) - 1), part), lambda p: p["square"] >= threshold**2 - slack)
    strong = lambda p: p["square"] >= threshold - slack
    told = lambda p, flag: F.struct(p["buckets"].alias("buckets"), p["weights"].alias("weights"), flag.alias("strong"))
    if not both:
        return F.transform(parts, lambda p: told(p, strong(p)))
    return F.concat(F.transform(parts, lambda p: told(p, F.lit(True))), F.transform(F.filter(parts, strong), lambda p: told(p, F.lit(False))))


def _first(df: DataFrame, by: list[str], order: list[Column | str], most: int, name: str = "_n") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(name) <= most)


def _near_by_parts(theirs: DataFrame, mine: DataFrame, threshold: float, most: int) -> DataFrame:
    """asked, query and similarity of the first ``most`` of each asked one; vectors (e) of at most SHORT buckets.

    A near query shares a set of buckets with the asked one. Of all stored
    queries with the same weights in that set the first ``most`` are enough:
    each of them is at least as near as any other. So the stored side keeps
    that many a set and weights, and each asked vector looks up its own sets;
    pairs of all near vectors are never formed. Where a pair shares more
    buckets than a set, the larger set tells its similarity.
    """
    held = _first(theirs, ["e"], ["query"], most).select("query", F.explode(_parts(F.col("e"), threshold, False)).alias("p")).select("query", "p.*")
    lists = _first(held, ["buckets", "strong", "weights"], ["query"], most).groupBy("buckets", "strong", "weights").agg(F.collect_list("query").alias("queries"))
    vectors = checkpointed(mine.select("e").distinct().withColumn("id", F.monotonically_increasing_id()))
    sets = vectors.select("id", F.explode(_parts(F.col("e"), threshold, True)).alias("p")).select("id", "p.buckets", "p.strong", F.col("p.weights").alias("own"))
    product = F.aggregate(F.zip_with("own", "weights", lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)
    found = sets.join(lists, ["buckets", "strong"]).select("id", F.least(F.lit(1.0), F.round(product, 9)).alias("similarity"), "queries").where(F.col("similarity") >= threshold)
    each = found.repartition("id").select("id", "similarity", F.explode("queries").alias("query")).groupBy("id", "query").agg(F.max("similarity").alias("similarity"))
    near = _first(each, ["id"], [F.desc("similarity"), "query"], most).drop("_n")
    return mine.join(vectors, "e").select("asked", "id").join(near, "id").select("asked", "query", "similarity")


def similar(stored: DataFrame, asked: DataFrame, threshold: float = THRESHOLD, most: int = SIMILAR) -> DataFrame:
    """asked, query and similarity of the stored queries next to each asked one (asked: a column of queries).

    Equal vectors are compared once. Vectors of at most SHORT buckets meet by
    the sets of buckets that they share (_near_by_parts), in work that grows
    with the queries; where one has more, by pairs of buckets, rare ones
    first, that a pair of enough similarity must share (_keys).
    """
    theirs = stored.select("query", "vector").dropDuplicates(["query"])
    mine = asked.select("asked").distinct().withColumn("vector", vectorize(F.col("asked")))
    b, a = (checkpointed(x.select(name, _weights(F.col("vector")).alias("e")).where(F.size("e") > 0)) for x, name in ((theirs, "query"), (mine, "asked")))
    long = F.size("e") > SHORT
    near = _near_by_parts(b.where(~long), a.where(~long), threshold, most)
    wide = F.size(_weights(F.col("vector"))) > SHORT
    if a.where(long).take(1):
        near = near.unionByName(_near_by_keys(theirs, mine.where(wide), threshold, most))
    if b.where(long).take(1):
        near = near.unionByName(_near_by_keys(theirs.where(wide), mine.where(~wide), threshold, most))
    return _first(near, ["asked"], [F.desc("similarity"), "query"], most, "rank")


def get(stored: DataFrame, asked: DataFrame, engine: str, most: int = MOST) -> DataFrame:
    """asked, place, title, url and content: the items of the very query if it is stored, else of the next ones, each URL once."""
    own = stored.where(F.col("engine") == engine)
    exact = asked.select("asked").distinct().join(own, F.col("asked") == F.col("query")).withColumn("rank", F.lit(0))
    others = asked.select("asked").distinct().join(exact.select("asked").distinct(), "asked", "left_anti")
    found = similar(own, others).join(own, "query").withColumnRenamed("rank", "rank")
    columns = ["asked", "rank", "pos", "title", "url", "content"]
    once = first_by(found.select(*columns), F.struct("asked", "url"), ("rank", "pos"))
    place = F.row_number().over(Window.partitionBy("asked").orderBy("rank", "pos"))
    every = exact.select(*columns).withColumn("place", place).unionByName(once.withColumn("place", place).where(F.col("place") <= most))
    return every.select("asked", "place", "title", "url", "content")


def combined(stored: DataFrame, asked: DataFrame, most: int = MOST) -> DataFrame:
    """As get, over all engines: the query's own items and those of similar ones, each URL once whatever its case."""
    exact = asked.select("asked").distinct().join(stored, F.col("asked") == F.col("query")).withColumn("rank", F.lit(0))
    found = similar(stored, asked).where("asked != query").join(stored, "query")
    columns = ["asked", "rank", "engine", "pos", "title", "url", "content"]
    once = first_by(exact.select(*columns).unionByName(found.select(*columns)), F.struct("asked", F.lower("url")), ("rank", "engine", "pos"))
    place = F.row_number().over(Window.partitionBy("asked").orderBy("rank", "engine", "pos"))
    return once.withColumn("place", place).where(F.col("place") <= most).select("asked", "place", "title", "url", "content")
