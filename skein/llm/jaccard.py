"""Exact set-similarity join on word shingles by multiple global orders.

Documents of equal shingle sets are one class, found by digests: where sets of
one digest differ in size or sketch, they go by another digest. If two sets are similar enough
they share a token among the first of each, its prefix, under *any* total
order of all tokens. Three orders are used; in each, frequent tokens come
last, and tokens of about one frequency by a hash of the order's own. The
prefixes under the first order are joined. A pair stays a candidate if sizes
and sketches allow it, first those of one size, then wider ones that grow with
the set. Only then are the two texts brought together, shingled again, and
compared: by their prefixes under the second and the third order, and whole.

Large groups: in a group (a token, and for frequent tokens a salt) each class
is first compared with a central one only; what these links connect
needs no further comparison. Only classes of different components that still
share a token are paired. Where more than SPLIT classes do, they are joined by
their prefix tokens under the second order instead, so that a token that many
have by itself pairs nothing. Where more than CROWD share one of these, too,
each is first linked with the nearest of a few of its group, in rounds; only
classes that this leaves apart are paired, all of them. Thus thousands of near
copies cost a comparison each, and no pair of texts that might be linked is
left out.

Texts are shingled for their digests and for the prefixes under the first
order; prefixes under the others and sets are made again of the classes in
question only. Sets are never shuffled: they are hashes, which no codec makes
smaller, while a text is packed to about a third of them.

Frequent tokens are those met repeatedly within tasks; the list holds at most
the HEAVY most frequent and only decides an order: any order gives the same
result, so its bound affects speed alone.

Edge cases: texts that are null or without words have empty sets and link
with nothing; fewer words than a shingle are one shingle; rows that repeat a
doc_id are one document (of the largest set for n_shingles of each row: its
own); rows without doc_id link with nothing and have a null component; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.llm.common import begin, connected_components, cut, membership, possibly_in, snug, string_slices, sweep
from skein.llm.hashing import SEEDS, mix, shingles

WORDS = 5
PERCENT = 80
HEAVY = 1 << 17
#: Tokens are counted over so many at a time.
COUNTED = 1 << 21
#: Parts of the group of a frequent token, at least, and documents of a part, about.
SALTS = 32
PART = 1024
#: Above so many classes of a token the second order pairs them.
SPLIT = 64
#: Digests that different sets share, which are told apart at once: more are told in further rounds.
MOST_CLASHES = 10_000
#: Above so many classes of a token under the second order, each is linked with the nearest of some MIDDLES of them before those left apart are paired.
CROWD = 256
MIDDLES = 16
#: So many keys of a class are compared to pair two classes once; it affects speed alone.
FIRST = 6
SKETCH = 1024
#: Words of the sketches, folded in two, that pairs of a token are held against first.
FOLDED = 8


def distinct_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each row."""
    h, bounds = shingles(data, offsets, k)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        x = np.sort(h[a:b])
        out.append(x[np.append(True, x[1:] != x[:-1])] if len(x) else x)
    return out


def _digest(x: np.ndarray, seed: int) -> int:
    total = (int(mix(x ^ SEEDS[seed]).sum()) + len(x) * int(SEEDS[51])) % 2**64
    return int(mix(np.array([total], np.uint64)).view(np.int64)[0])


@dataclass(frozen=True)
class Digest:
    """The number of a set's class: equal for equal sets.

    bits: those of the first digest that count. apart: first digests that
    different sets were found to have; such sets go by a second one.
    """

    bits: int = 64
    apart: frozenset[int] = frozenset()

    def __call__(self, x: np.ndarray) -> int:
        first = _digest(x, 50)
        if self.bits < 64:
            first &= (1 << self.bits) - 1
        return _digest(x, 58) if first in self.apart else first


def sketch(x: np.ndarray) -> np.ndarray:
    """SKETCH bits: the parities of how many elements fall on each.

    Two sets differ in at least as many elements as their sketches in bits.
    """
    bits = np.bincount((mix(x ^ SEEDS[54]) >> np.uint64(54)).astype(np.int64), minlength=SKETCH) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def four_bytes(x: Column) -> Column:
    """The 32-bit numbers in x, whatever the order of their bytes."""
    return F.transform(F.regexp_extract_all(F.hex(x), F.lit(".{8}"), F.lit(0)), lambda h: F.conv(h, 16, 10).cast("bigint"))


def wide_sketch(x: np.ndarray) -> np.ndarray:
    """The size of a set, then a sketch of two to four bits an element, SKETCH at least."""
    size = max(SKETCH, 1 << (2 * len(x)).bit_length())
    bits = np.bincount((mix(x ^ SEEDS[57]) & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.concatenate([np.array([len(x)], np.uint64), np.packbits(bits.astype(np.uint8)).view(np.uint64)])


def wide_may_be_similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """As may_be_similar, of wide sketches; the longer is folded to the length of the other."""
    n, m, x, y = int(x[0]), int(y[0]), x[1:], y[1:]
    if percent * max(n, m) > 100 * min(n, m):
        return False
    while len(x) != len(y):
        if len(x) < len(y):
            x, y = y, x
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return (100 + percent) * int(np.bitwise_count(x ^ y).sum()) <= (100 - percent) * (n + m)


def sketch_words(x: str = "sketch", to: str = "s") -> list[Column]:
    """A sketch as columns; a join's condition over array elements is too large a method to be compiled."""
    return [F.col(x)[i].alias(f"{to}{i}") for i in range(SKETCH // 64)]


def bits_apart(x: str, y: str, words: int = SKETCH // 64) -> Column:
    return sum((F.bit_count(F.col(f"{x}{i}").bitwiseXOR(F.col(f"{y}{i}"))) for i in range(1, words)), F.bit_count(F.col(f"{x}0").bitwiseXOR(F.col(f"{y}0"))))


def may_be_similar(n: Column, m: Column, apart: Column, percent: int) -> Column:
    """Whether sets of sizes n, m whose sketches differ in so many bits may be similar; never false for a pair that is."""
    sizes = (100 * n >= percent * m) & (100 * m >= percent * n)
    return sizes & ((100 + percent) * apart <= (100 - percent) * (n + m))


def prefix_length(n: int, percent: int) -> int:
    return n - (percent * n + 99) // 100 + 1 if n else 0


def ranks(x: np.ndarray, heavy: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """How frequent the tokens are: 0, or the binary logarithm of a count and one."""
    if not len(heavy):
        return np.zeros(len(x), np.uint64)
    at = np.minimum(np.searchsorted(heavy, x), len(heavy) - 1)
    return np.where(heavy[at] == x, rank[at], 0).astype(np.uint64)


def prefix(x: np.ndarray, known: np.ndarray, order: int, percent: int) -> np.ndarray:
    """Where in x its prefix under an order (0, 1, 2) is, in no order; known: the ranks."""
    p = prefix_length(len(x), percent)
    if p >= len(x):
        return np.arange(len(x))
    key = (known << np.uint64(58)) | (mix(x ^ SEEDS[51 + order]) >> np.uint64(6))
    return np.argpartition(key, p - 1)[:p]


def meet(x: np.ndarray, y: np.ndarray) -> int:
    """How many elements two sorted sets share."""
    if len(x) > len(y):
        x, y = y, x
    if not len(x):
        return 0
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    return int((y[at] == x).sum())


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    if percent * max(len(x), len(y)) > 100 * min(len(x), len(y)):
        return False
    both = meet(x, y)
    return 100 * both >= percent * (len(x) + len(y) - both)


def signatures(documents: DataFrame, k: int, digest: Digest) -> DataFrame:
    """A row for each document (doc_id, n, c, sketch) and, with a null c, for each token that a task met repeatedly (token, times)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("sets")
        held: list[np.ndarray] = []
        size = 0

        def tokens() -> pa.RecordBatch:
            x = np.sort(np.concatenate(held))
            edge = np.flatnonzero(np.append(True, x[1:] != x[:-1]))
            times = np.diff(np.append(edge, len(x)))
            often = times > 1
            return pa.RecordBatch.from_arrays([pa.array(x[edge[often]].view(np.int64)), pa.array(times[often]), *(pa.nulls(int(often.sum()), t) for t in (pa.int64(), pa.list_(pa.int64())))], names=["doc_id", "n", "c", "sketch"])

        seen: set[int] = set()
        for batch in batches:
            for a, b, data, offsets in string_slices(batch.column(1)):
                sets = distinct_sets(data, offsets, k)
                c = [digest(x) for x in sets]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([len(x) for x in sets], pa.int64()), pa.array(c, pa.int64()), pa.array([sketch(x) for x in sets], pa.list_(pa.int64()))], names=["doc_id", "n", "c", "sketch"])
                for x, key in zip(sets, c):
                    if len(x) and key not in seen:
                        seen.add(key)
                        held.append(x)
                        size += len(x)
                if size >= COUNTED:
                    yield tokens()
                    held, size = [], 0
        if held:
            yield tokens()

    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(task, "doc_id bigint, n bigint, c bigint, sketch array<bigint>")


def frequent(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent tokens, at most HEAVY, ascending, and their ranks; what the driver gets is bounded by that."""
    counts = cut(rows.where("c is null").groupBy("doc_id").agg(F.sum("n").alias("n")))
    level = F.floor(8 * F.log2("n")).cast("int")
    left, least = HEAVY, None
    for r in sorted(counts.groupBy(level.alias("level")).count().collect(), key=lambda r: -r.level):
        left -= r["count"]
        if left < 0:
            break
        least = r.level
    if least is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    got = counts.where(level >= least).toPandas()
    heavy = got["doc_id"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(heavy)
    return heavy[order], 1 + np.log2(got["n"].to_numpy(np.float64))[order].astype(np.int64)


def postings(documents: DataFrame, k: int, percent: int, heavy: np.ndarray, rank: np.ndarray, digest: Digest) -> DataFrame:
    """salt, token and c: the prefixes under the first order, of each class once a task.

    In this order a row's hashes stand together, and all else in it is alike in
    most rows: a shuffle's codec finds it in one run.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("sets")
        seen: set[int] = set()
        for batch in batches:
            for _, _, data, offsets in string_slices(batch.column(0)):
                salt, token, c = [], [], []
                for x in distinct_sets(data, offsets, k):
                    key = digest(x)
                    if not len(x) or key in seen:
                        continue
                    seen.add(key)
                    known = ranks(x, heavy, rank)
                    at = prefix(x, known, 0, percent)
                    often = known[at].astype(np.int64)
                    parts = np.maximum(SALTS, (1 << np.minimum(often, 40)) // PART)
                    token.append(x[at].view(np.int64))
                    salt.append(np.where(often > 0, 1 + (key & (2**62 - 1)) % parts, 0))
                    c.append(np.full(len(at), key))
                if token:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v)) for v in (salt, token, c)], names=["salt", "token", "c"])

    return documents.where("doc_id is not null").select("text").mapInArrow(task, "salt bigint, token bigint, c bigint")


def of_classes(documents: DataFrame, wanted: DataFrame, k: int, name: str, make: Callable[[np.ndarray, np.ndarray], bytes], digest: Digest) -> DataFrame:
    """c and, named so, what make gives for the set and the text of each class in wanted (c, rep); only documents that may be in wanted are shingled."""
    texts = possibly_in(documents.where("doc_id is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), "doc_id", membership(wanted, "rep"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("sets")
        for batch in batches:
            for a, b, data, offsets in string_slices(batch.column(1)):
                sets = distinct_sets(data, offsets, k)
                made = pa.array([make(x, data[i:j]) for x, i, j in zip(sets, offsets[:-1].tolist(), offsets[1:].tolist())], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([digest(x) for x in sets], pa.int64()), made], names=["doc_id", "c", name])

    # A class's smallest doc_id only, and one row of it whose set is the class's. A merge join by c alone (as an equality,
    # that of the documents would be one of its keys) leaves the rows where the distinct ones and the pairs want them, so
    # that they are dealt once.
    found = texts.mapInArrow(task, f"doc_id bigint, c bigint, {name} binary").join(wanted.hint("merge"), "c").where(F.col("doc_id").bitwiseXOR(F.col("rep")) == 0)
    return found.drop("doc_id", "rep").dropDuplicates(["c"])


def with_both(pairs: DataFrame, made: DataFrame, name: str) -> DataFrame:
    """Pairs of classes (a, b) with the column made for both, that of b with a 2."""
    first = made.select(F.col("c").alias("a"), F.col(name).alias(f"{name}1"))
    second = made.select(F.col("c").alias("b"), F.col(name).alias(f"{name}2"))
    return pairs.hint("merge").join(first, "a").hint("merge").join(second, "b").select("a", "b", f"{name}1", f"{name}2")


def compared(batches: Iterator[pa.RecordBatch], test: Callable[[pa.Buffer, pa.Buffer], bool]) -> Iterator[pa.RecordBatch]:
    """Of rows (a, b, and two binary columns), a and b where the test of the two holds."""
    begin("sets")
    for batch in batches:
        keep = pa.array([test(x.as_buffer(), y.as_buffer()) for x, y in zip(batch.column(2), batch.column(3))], pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])


def verified(documents: DataFrame, pairs: DataFrame, classes: DataFrame, k: int, percent: int, orders: Callable[[np.ndarray], list[np.ndarray]], digest: Digest, wide: bool = True) -> DataFrame:
    """Of pairs of classes (a, b), those whose sets are similar; wide: only pairs that wide sketches allow get their texts."""

    def wanted(some: DataFrame) -> DataFrame:
        return snug(some.select(F.explode(F.array("a", "b")).alias("c")).distinct().join(classes.select("c", "rep"), "c"))

    def may_be(x: pa.Buffer, y: pa.Buffer) -> bool:
        return wide_may_be_similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent)

    def similar_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Pairs come by their b: of each two texts one is often that of the pair before.
        @lru_cache(maxsize=2)
        def of_text(x: bytes) -> tuple[np.ndarray, list[np.ndarray]]:
            data = np.frombuffer(zlib.decompress(x), np.uint8)
            found = distinct_sets(data, np.array([0, len(data)]), k)[0]
            return found, orders(found)

        def are(x: pa.Buffer, y: pa.Buffer) -> bool:
            (one, firsts), (other, seconds) = of_text(x.to_pybytes()), of_text(y.to_pybytes())
            return all(map(meet, firsts, seconds)) and similar(one, other, percent)

        return compared(batches, are)

    pairs = snug(pairs)
    sweep(documents.sparkSession)
    candidates = pairs
    if wide:
        sketches = of_classes(documents, wanted(pairs), k, "w", lambda x, _: wide_sketch(x).tobytes(), digest)
        candidates = snug(with_both(pairs, sketches, "w").mapInArrow(lambda batches: compared(batches, may_be), "a bigint, b bigint"))
    texts = of_classes(documents, wanted(candidates), k, "t", lambda _, text: zlib.compress(text, 1), digest)
    return with_both(candidates, texts, "t").mapInArrow(similar_texts, "a bigint, b bigint")


def components(documents: DataFrame, k: int = WORDS, percent: int = PERCENT, bits: int = 64) -> DataFrame:
    """doc_id, n_shingles and component_id for each row."""
    digest = Digest(bits)
    while True:
        rows = cut(signatures(documents, k, digest))
        signed = rows.where("c is not null")
        both = [f(F.struct("n", "sketch")).alias(x) for f, x in ((F.min, "low"), (F.max, "high"))]
        classes = signed.where("doc_id is not null and n > 0").groupBy("c").agg(F.min("doc_id").alias("rep"), *both)
        classes = snug(classes.select("c", "rep", "high.n", "high.sketch", (F.col("low") != F.col("high")).alias("clash")))
        # Different sets of one digest: they have different sizes or sketches. None or a few, at any size of table.
        clashes = classes.where("clash").select("c").take(MOST_CLASHES)
        if not clashes:
            break
        digest = Digest(bits, digest.apart | {r.c for r in clashes})
    heavy, rank = frequent(rows)
    classes = classes.drop("clash")
    sweep(documents.sparkSession)

    # Groups of at least two classes; of frequent tokens also what is alone with its salt. Tokens
    # with the same classes are one group: their key is what these classes' hashes add up to.
    group = Window.partitionBy("token", "salt")
    member = F.pmod(F.xxhash64("c"), F.lit(1 << 32))
    held = postings(documents, k, percent, heavy, rank, digest).withColumns({"low": F.min("c").over(group), "high": F.max("c").over(group), "sum": F.sum(member).over(group)})
    held = held.where("low != high or salt > 0").select(F.when(F.col("salt") > 0, F.col("token")).otherwise(F.xxhash64("sum", "low", "high")).alias("key"), "salt", "c")
    held = snug(held.groupBy("key", "salt", "c").agg(F.count("*").alias("tokens")))
    sweep(documents.sparkSession)

    def orders(x: np.ndarray) -> list[np.ndarray]:
        known = ranks(x, heavy, rank)
        return [np.unique(x[prefix(x, known, i, percent)].astype(np.uint32)) for i in (1, 2)]

    # The centre of a group shares most of its prefix. Each class is compared with one centre: the one that it
    # shares most tokens with, of those of its groups; and the centres of a frequent token with the best of them.
    sized = classes.select("c", "n", *sketch_words())
    shared = held.groupBy("c").agg(F.sum("tokens").alias("shared")).join(classes.select("c", "n"), "c").select("c", (F.col("n") - 5 * F.col("shared")).alias("odd"))
    in_group = Window.partitionBy("key", "salt")
    centred = snug(held.join(shared, "c").withColumn("centre", F.min(F.struct("odd", "c")).over(in_group)).select("key", "salt", "c", "tokens", "centre"))
    tops = centred.where("salt > 0 and c = centre.c").select("key", "tokens", "centre")
    best = tops.groupBy("key").agg(F.min("centre").alias("top"))
    near = centred.select("c", "tokens", F.col("centre.c").alias("centre")).unionByName(tops.join(best, "key").select(F.col("centre.c").alias("c"), "tokens", F.col("top.c").alias("centre"))).where("c != centre")
    near = near.groupBy("c", "centre").agg(F.sum("tokens").alias("tokens")).groupBy("c").agg(F.max(F.struct("tokens", "centre")).alias("x"))
    stars = snug(near.select("c", F.col("x.centre").alias("centre")))
    linked = snug(verified(documents, likely(stars.select(F.least("c", "centre").alias("a"), F.greatest("c", "centre").alias("b")).distinct(), sized, percent), classes, k, percent, orders, digest))
    sweep(documents.sparkSession)
    joined = snug(connected_components(linked).withColumnRenamed("node", "c"))

    # What these links leave apart, in the groups of a key.
    apart = labelled(held.select("key", "c").distinct(), joined)
    folded = classes.select("c", "n", *[F.col("sketch")[i].bitwiseXOR(F.col("sketch")[i + FOLDED]).alias(f"s{i}") for i in range(FOLDED)])
    many = snug(apart.where(F.col("m") > SPLIT).select("c").distinct().join(classes.select("c", "rep"), "c"))
    second = of_classes(documents, many, k, "p2", lambda x, _: orders(x)[0].tobytes(), digest)
    by_second = labelled(many.join(second, "c").select(F.explode(four_bytes(F.col("p2"))).alias("key"), "c"), joined)

    # Families of near copies that their centres leave apart: one link a class and round, not one for each pair of near
    # classes. A round follows while they halve the components; whatever is still apart after the last is paired below.
    left = parts(by_second)
    while left:
        crowded = by_second.where(F.col("m") > CROWD)
        some = membership(crowded, "c")
        near = likely(nearest(crowded, possibly_in(folded, "c", some), percent), possibly_in(sized, "c", some), percent)
        near = snug(verified(documents, near, classes, k, percent, orders, digest, wide=False))
        joined = snug(connected_components(joined.where("c != component").select(F.col("c").alias("a"), F.col("component").alias("b")).unionByName(near)).withColumnRenamed("node", "c"))
        by_second = labelled(by_second.select("key", "c"), joined)
        sweep(documents.sparkSession)
        before, left = left, parts(by_second)
        if 2 * left > before:
            break
    few = apart.where(F.col("m") <= SPLIT).drop("component").join(joined, "c", "left").select("key", "c", F.coalesce("component", "c").alias("component"))
    found = paired(few, folded, percent).unionByName(paired(by_second, folded, percent)).distinct()
    more = verified(documents, likely(found, sized, percent), classes, k, percent, orders, digest)

    more = snug(more)
    sweep(documents.sparkSession)
    # Classes that a document has rows of are together, too.
    of_documents = signed.where("doc_id is not null and n > 0").select("doc_id", "c")
    several = of_documents.groupBy("doc_id").agg(F.min("c").alias("a"), F.max("c").alias("b")).where("a != b")
    edges = joined.where("c != component").select(F.col("c").alias("a"), F.col("component").alias("b")).unionByName(more).unionByName(of_documents.join(several.select("doc_id", "a"), "doc_id").select("a", F.col("c").alias("b")).where("a != b"))
    found = connected_components(edges).join(classes.select(F.col("c").alias("node"), "rep"), "node")
    smallest = found.groupBy("component").agg(F.min("rep").alias("least"))
    by_class = classes.select("c", "rep").join(found.join(smallest, "component").select(F.col("node").alias("c"), "least"), "c", "left")
    out = signed.select("doc_id", F.col("n").alias("n_shingles"), "c").join(by_class.select("c", F.coalesce("least", "rep").alias("component")), "c", "left")
    own = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("component"))
    return out.select("doc_id", "n_shingles", F.coalesce(own, "doc_id").alias("component_id"))


def likely(pairs: DataFrame, sized: DataFrame, percent: int) -> DataFrame:
    """Of pairs of classes, those that sizes and whole sketches allow."""
    # All columns renamed on both sides: the same exchange then serves both.
    first, second = (sized.select(F.col("c").alias(c), F.col("n").alias(n), *[F.col(f"s{i}").alias(f"{s}{i}") for i in range(SKETCH // 64)]) for c, n, s in (("a", "n1", "u"), ("b", "n2", "t")))
    return pairs.join(first, "a").join(second, "b").where(may_be_similar(F.col("n1"), F.col("n2"), bits_apart("u", "t"), percent)).select("a", "b")


def labelled(rows: DataFrame, joined: DataFrame) -> DataFrame:
    """key, c and component of rows (key, c) whose key different components have, and m: how many rows have it."""
    rows = rows.join(joined, "c", "left").withColumn("component", F.coalesce("component", "c"))
    several = rows.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("m")).where("low != high").select("key", "m")
    return snug(rows.join(several, "key"))


def parts(rows: DataFrame) -> int:
    """How many components the classes of crowded keys have."""
    return rows.where(F.col("m") > CROWD).select("component").distinct().count()


def nearest(rows: DataFrame, sized: DataFrame, percent: int) -> DataFrame:
    """a, b: each class with the nearest, by folded sketches, of some MIDDLES classes of each of its keys, where components differ.

    At most a pair a class; others that may be similar are left for paired.
    """
    own = rows.join(sized, "c")
    some = own.where(F.pmod(F.xxhash64("key", "component", "c"), F.col("m")) < MIDDLES)
    some = some.select("key", *[F.col(x).alias(f"{x}2") for x in ("c", "n", "component")], *[F.col(f"s{i}").alias(f"t{i}") for i in range(FOLDED)])
    apart = bits_apart("s", "t", FOLDED)
    met = own.join(some, "key").where((F.col("component") != F.col("component2")) & may_be_similar(F.col("n"), F.col("n2"), apart, percent))
    best = met.groupBy("c").agg(F.min(F.struct(apart.alias("apart"), "c2")).alias("x"))
    return best.select(F.least("c", "x.c2").alias("a"), F.greatest("c", "x.c2").alias("b")).distinct()


def paired(rows: DataFrame, sized: DataFrame, percent: int) -> DataFrame:
    """a, b: classes of different components that share a key, as far as sizes and folded sketches allow."""
    # A pair is made at the smallest key that both have, as far as the FIRST smallest keys of each tell.
    keys = rows.groupBy("c").agg(F.slice(F.sort_array(F.collect_set("key")), 1, FIRST).alias("keys"))
    own = rows.join(sized.join(keys, "c"), "c")
    # All columns renamed on both sides: the same exchange then serves both.
    first, second = (own.select("key", *[F.col(x).alias(f"{x}{i}") for x in ("c", "n", "component", "keys")], *[F.col(f"s{j}").alias(f"{s}{j}") for j in range(FOLDED)]) for i, s in ((1, "u"), (2, "t")))
    smallest = F.coalesce(F.array_min(F.array_intersect("keys1", "keys2")), F.col("key")) >= F.col("key")
    near = may_be_similar(F.col("n1"), F.col("n2"), bits_apart("u", "t", FOLDED), percent)
    # In this form the keys are intersected only for pairs that pass the rest.
    wanted = F.when((F.col("c1") < F.col("c2")) & (F.col("component1") != F.col("component2")) & near, smallest).otherwise(F.lit(False))
    return first.join(second, "key").where(wanted).select(F.col("c1").alias("a"), F.col("c2").alias("b"))


def keep_one(documents: DataFrame, k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row of each component: its smallest doc_id; all columns are kept.

    Rows without doc_id stay. Of rows that repeat a doc_id all stay or go.
    """
    gone = components(documents, k, percent).where("doc_id != component_id").select("doc_id").distinct()
    return documents.join(gone, "doc_id", "left_anti")
