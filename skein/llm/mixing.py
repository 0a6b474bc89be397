"""Mixing sources to target weights by weighted fair queueing.

Documents of a source are shuffled by a keyed hash. A pass over a source
gives each document a virtual finish time: the words of its source up to and
with it, passes before included, divided by the source's target; each word in it
has one likewise, so that a very long document does not block its source. The
queue is served in the global order of finish times (ties: by source, null
last) and truncated at the total budget, the sum of all sizes; the last
document that a source is served of is thus taken in part.

The order is cut in two steps. At virtual time 1 every source has been served
its target, rounded down: all words with a finish time of at most 1 come before
the cut. What the budget leaves then, less than a word for each source, goes
to the words that follow, which are few; they are sorted by finish time and
truncated.

Running sums: a source's hash range is cut into equal buckets, enough of them
for each to stay small; sums of buckets are combined before the shuffle, and
only a bucket's documents are ordered in one task, so that a source with a
third of all rows is spread like any other.

Edge cases: a null or empty text has size 0 and is taken 0 times; a null
source is a source of its own, last in order; rows that repeat a doc_id, or
have none, are documents of their own, in the order of a hash of doc_id and
text; equal rows tie, and any of them may come first; a table without words
has targets 0; an empty table gives no rows; columns of the caller are not
kept unless asked for, whatever their names; where a kept column has the name
of a result, the result gives way to it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.llm.common import cut
from skein.operators.scan import join_unique, numbered, running

#: Documents of one bucket of a source, about.
BUCKET_ROWS = 4096
#: Tables of a row a source are broadcast up to so many.
FEW_SOURCES = 10_000
SPACES = r"[^\x20\x09-\x0D]+"
DIGITS = 8
#: A source by columns without nulls, in order.
BY = ["no_source", "source_key"]


def size_in_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(SPACES)), F.lit(0)).cast("bigint")


def targets(sizes: Sequence[tuple[str | None, int]], weights: Sequence[float], most: float = 3.0) -> list[tuple[str | None, int, float]]:
    """(source, size, target) by code point, null last; weights repeat.

    The targets share the sum of all sizes by weight; none exceeds most times
    its source's size, and the excess is shared by weight again until none is
    above. Sources that stop are a prefix in the order of size / weight.
    """
    order = sorted(sizes, key=lambda s: (s[0] is None, s[0] or ""))
    rows = [(s, n, float(weights[i % len(weights)])) for i, (s, n) in enumerate(order)]
    left, weight = float(sum(n for _, n, _ in rows)), sum(w for _, _, w in rows)
    share = 0.0
    for k, (_, n, w) in enumerate(by := sorted(rows, key=lambda r: (most * r[1] / r[2]))):
        share = left / weight if weight else 0.0
        if share <= most * n / w or k == len(by):
            break
        left, weight = left - most * n, weight - w
    return [(s, n, float(min(most * n, share * w))) for s, n, w in rows]


def plans(sources: DataFrame, weights: Sequence[float], most: int = 3) -> DataFrame:
    """The columns of sources (BY, source_size, rows) with target, as targets has it, and budget, a whole number.

    Sources are numbered, and sizes and weights summed up, over ranges: any number of sources will do.
    """
    n = len(weights)
    turn = F.pmod(F.col("_turn") - 1, F.lit(n)).cast("int")
    known = numbered(sources, [F.asc(c) for c in BY], "_turn").withColumn("_turn", turn)
    known = known.withColumn("_weight", F.get(F.array(*[F.lit(float(w)) for w in weights]), F.col("_turn")))
    known = known.withColumn("_stop", most * F.col("source_size") / F.col("_weight"))
    order = ["_stop", *BY]
    upto = cut(running(known, [], [F.asc(c) for c in order], {"_words": F.col("source_size")} | {f"_turn{i}": (F.col("_turn") == i).cast("int") for i in range(n)}))
    weighed = lambda row: sum((float(w) * row(f"_turn{i}") for i, w in enumerate(weights)), F.lit(0.0))
    all_ = upto.agg(F.sum("source_size").alias("words"), *[F.count_if(F.col("_turn") == i).alias(f"_turn{i}") for i in range(n)]).first()
    # What is left to share, and the weights to share it by, before each source in the order in which they stop.
    left = F.lit(float(all_.words or 0)) - most * (F.col("_words") - F.col("source_size"))
    weight = weighed(lambda c: F.lit(float(all_[c]))) - weighed(F.col) + F.col("_weight")
    shared = upto.withColumn("_share", F.try_divide(left, weight))
    place = F.struct(*order)
    found = shared.agg(F.min_by(F.when(F.col("_share") <= F.col("_stop"), F.col("_share")), F.when(F.col("_share") <= F.col("_stop"), place)).alias("first"), F.max_by("_share", place).alias("last")).first()
    share = found.first if found.first is not None else found.last if found.last is not None else 0.0
    target = F.least(most * F.col("source_size").cast("double"), F.lit(share) * F.col("_weight"))
    return upto.select(*BY, "source_size", "rows", target.alias("target"), F.floor(target).cast("bigint").alias("budget"))


def _numbered(rows: DataFrame, digits: int, sums: DataFrame) -> DataFrame:
    """up_to: the words of the source up to and with the document, in the order of h."""
    w = Window.partitionBy(*BY, "bucket").orderBy("h", "size").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("bucket", F.substring("h", 1, digits)).withColumn("within", F.sum("size").over(w)).join(sums, [*BY, "bucket"]).withColumn("up_to", F.col("before") + F.col("within")).drop("bucket", "before", "within")


def mix(documents: DataFrame, weights: Sequence[float] = (5, 2, 1), most: int = 3, seed: str = "", keep: Sequence[str] = ()) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, virtual_finish and keep.

    virtual_finish: the time at which the document's first pass ends.
    """
    digest = F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), F.md5(F.coalesce("text", F.lit("")))))
    keep = [c for c in keep if c not in ("doc_id", "source")]
    rows = documents.select(
        F.col("doc_id"), F.col("source"), size_in_words(F.col("text")).alias("size"), digest.alias("h"), F.col("source").isNull().alias("no_source"), F.coalesce("source", F.lit("")).alias("source_key"), F.struct(*keep).alias("kept") if keep else F.lit(None).alias("kept")
    )
    sizes = cut(rows.drop("kept"))
    plan = cut(plans(sizes.groupBy(*BY).agg(F.sum("size").alias("source_size"), F.count("*").alias("rows")), weights, most))
    told = plan.agg(F.count("*").alias("sources"), F.max("rows").alias("rows"), F.sum("source_size").alias("words"), F.sum(F.when(F.col("target") < most * F.col("source_size"), F.col("target"))).alias("open")).first()
    # Buckets: equal ranges of the first digits of the hash.
    digits = 1
    while digits < DIGITS and 16**digits * BUCKET_ROWS < (told.rows or 0):
        digits += 1
    sums = sizes.groupBy(*BY, F.substring("h", 1, digits).alias("bucket")).agg(F.sum("size").alias("words"))
    sums = cut(sums.withColumn("before", F.sum("words").over(Window.partitionBy(*BY).orderBy("bucket")) - F.col("words")).drop("words"))

    def planned(some: DataFrame) -> DataFrame:
        """With the plan of each row's source: few sources are broadcast, else those that many rows have."""
        if told.sources <= FEW_SOURCES:
            return some.join(F.broadcast(plan.drop("rows")), BY)
        return join_unique(cut(some), plan, BY, F.col("rows")).drop("rows")

    # What each pass gets by time 1.
    size, start = F.col("size"), lambda p: F.col("up_to") - F.col("size") + p * F.col("source_size")
    by_one = lambda p: F.greatest(F.lit(0), F.least(size, F.col("budget") - start(p)))
    head = sum((by_one(F.lit(p)) for p in range(1, most)), by_one(F.lit(0)))
    timed = cut(planned(_numbered(sizes, digits, sums)))
    served = timed.agg(F.sum(head).alias("n")).first().n or 0
    left = (told.words or 0) - served
    # By this time the queue has served more than is left.
    until = 1 + 3 * (left + told.sources) / told.open if told.open else 1.0
    passes = timed.where(size > 0).withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(most - 1)))).withColumns({"start": start(F.col("p")), "done": by_one(F.col("p"))})
    passes = passes.withColumn("most", F.least(size, F.ceil(until * F.col("target")) - F.col("start"))).where(F.col("done") < F.col("most"))
    each = passes.withColumn("end", F.explode(F.sequence(F.col("start") + F.col("done") + 1, F.col("start") + F.col("most"))))
    each = each.withColumn("finish", F.col("end").cast("double") / F.col("target")).where(F.col("finish") <= until)
    tail = numbered(each, [F.asc("finish"), *map(F.asc, BY), F.asc("end")], "place").where(F.col("place") <= left)
    tail = cut(tail.groupBy(*BY, F.col("up_to").alias("at")).agg(F.count("*").alias("got")))

    placed = planned(_numbered(rows, digits, sums)) if keep else timed.withColumn("kept", F.lit(None))
    tail = tail.select(F.col("no_source").alias("ns"), F.col("source_key").alias("sk"), "at", "got")
    mine = (F.col("ns") == F.col("no_source")) & (F.col("sk") == F.col("source_key")) & (F.col("at") == F.col("up_to")) & (size > 0)
    taken = head + F.coalesce("got", F.lit(0))
    finish = F.try_divide(F.col("up_to").cast("double"), F.col("target"))
    out = {"doc_id": F.col("doc_id"), "source": F.col("source"), "size": size, "source_size": F.col("source_size"), "target": F.col("target"), "taken": taken.cast("bigint"), "virtual_finish": finish}
    # The tail has less than a word for each source.
    return placed.join(F.broadcast(tail) if told.sources <= FEW_SOURCES else tail, mine, "left").select(*(v.alias(c) for c, v in out.items() if c not in keep), *[F.col("kept")[c].alias(c) for c in keep])


def queue(documents: DataFrame, weights: Sequence[float] = (5, 2, 1), most: int = 3) -> DataFrame:
    """A row of the columns of documents for each time that it is served, in the order of virtual finish times.

    A last pass of which the mix takes less than half is dropped, one of
    which it takes half or more is served whole. The rows are range-sorted.
    """
    inner = documents.select("doc_id", "text", "source", F.struct(*[F.col(c) for c in documents.columns]).alias("_row"))
    mixed = mix(inner, weights, most, keep=["_row"])
    size, taken = F.col("size"), F.col("taken")
    whole = F.when(size > 0, F.floor((2 * taken + size) / (2 * size))).otherwise(0).cast("int")
    served = mixed.withColumn("times", whole).where(F.col("times") > 0).withColumn("pass", F.explode(F.sequence(F.lit(1), F.col("times"))))
    at = F.col("virtual_finish") + (F.col("pass") - 1) * F.try_divide(F.col("source_size").cast("double"), F.col("target"))
    return served.withColumn("at", at).orderBy("at", F.asc_nulls_last("source"), "doc_id").select("_row.*")
