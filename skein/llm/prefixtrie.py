"""The prefix trie of conversations, by smallest-member ownership.

A node is a distinct sequence of first turns; the conversations that begin
with it are its members. Each node is owned by its smallest member. A
conversation that owns a node owns all later nodes of its path, so that it owns
a suffix of it: one mark a conversation, the depth where its suffix begins,
tells all. What a subtree saves is the sum of its members' tokens (here: bytes)
from the node on, less those of the nodes that these members own; since both
are the same from a member's owned suffix on, a member adds to a node just what
stands on its path between the node and its suffix. Leaves are counted by a
flag at their owner. So one group-by of all prefixes sums what whole subtrees
hold, without walking any tree.

Sequences are told apart by sums, turn by turn, of digests of (depth, role,
text): 124 bits of SHA-256 for each. No step holds a whole conversation, a
node's members or a node's children in one task: positions and prefix sums go
over ranges (operators.scan), group-bys are combined before they shuffle, joins
split keys that many rows have; the suffix is marked by a minimum for each
owner, as a window would gather a long conversation. The hash of the members
that end in a node is sequential by its nature: their ids are first joined to
strings of up to PIECE bytes in ranges, and only these pass through one task a
node, one at a time.

Edge cases: a null role or text is an empty one; turns are ordered by number,
null first, equal numbers by digest; rows without conv_id are left out; a
repeated row is a turn of its own; an empty table has no nodes, not even the
root; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.common import begin, cut
from skein.operators.scan import join_unique, ranges, running

#: Ids of one node that stand in one string, in bytes.
PIECE = 1 << 20
#: The sums that tell sequences apart, and their bits: 2**32 turns of a conversation can be summed.
SUMS, BITS = 4, 31
NODE = ["depth", "_a", "_b"]


def _digest(*parts: Column) -> Column:
    """SHA-256 of parts, each after its length."""
    return F.sha2(F.concat(*[x for p in parts for x in (F.octet_length(p).cast("string"), F.lit(":"), p)]), 256)


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), _digest and n_bytes of each turn."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("bigint").alias("conv_id"), "turn", _digest(role, text).alias("_digest"), F.octet_length(text).cast("bigint").alias("n_bytes"))
    return running(rows, ["conv_id"], [F.asc_nulls_first("turn"), F.asc("_digest")], {"pos": F.lit(1)}).drop("turn")


def lengths(rows: DataFrame) -> DataFrame:
    """conv_id and n, its number of turns."""
    return rows.groupBy("conv_id").agg(F.count("*").alias("n"))


def with_shared_heads(rows: DataFrame, group: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """Turns and lengths where the first h turns of each conversation c are those of c - c % group; h: crc32(c) % most.

    % is that of SQL: a negative c has a negative rest, so that its base is nearer to 0.
    A conversation without turns of its own after these has those alone.
    """
    c = F.col("conv_id")
    own = lengths(rows)
    own = own.withColumns({"base": c - c % group, "h": F.crc32(c.cast("string").cast("binary")) % most})
    heads = own.select(c.alias("base"), F.col("n").alias("_base_n"))
    head = F.least(F.col("h"), F.coalesce("_base_n", F.lit(0)))
    info = cut(own.join(heads, "base", "left").withColumn("head", head).drop("_base_n"))
    kept = join_unique(rows, info, ["conv_id"], F.col("n")).where(F.col("pos") > F.col("h"))
    kept = kept.select("conv_id", (F.col("pos") - F.col("h") + F.col("head")).alias("pos"), "_digest", "n_bytes")
    # At most `most` - 1 turns of each base, for the few conversations that share it.
    first = rows.where((F.col("pos") < most) & (c % group == 0)).withColumnRenamed("conv_id", "base")
    taken = first.join(info.select("conv_id", "base", "head"), "base").where(F.col("pos") <= F.col("head"))
    new = F.col("head") + F.greatest(F.col("n") - F.col("h"), F.lit(0))
    return kept.unionByName(taken.select("conv_id", "pos", "_digest", "n_bytes")), info.select("conv_id", new.alias("n"))


def _steps(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """The nodes on each conversation's path, the root first: their keys and their parents', and the bytes up to them."""
    ends = rows.join(sizes.withColumn("pos", F.col("n")).select("conv_id", "pos", F.lit(True).alias("_end")), ["conv_id", "pos"], "left")
    roots = sizes.select("conv_id", F.lit(0).cast("bigint").alias("pos"), F.lit(None).cast("string").alias("_digest"), F.lit(0).cast("bigint").alias("n_bytes"), (F.col("n") == 0).alias("_end"))
    steps = ends.unionByName(roots).withColumn("_end", F.coalesce("_end", F.lit(False)))
    placed = F.sha2(F.concat(F.col("pos").cast("string"), F.lit(":"), "_digest"), 256)
    bits = [F.coalesce(F.conv(F.substring(placed, 8 * i + 1, 8), 16, 10).cast("bigint").bitwiseAND((1 << BITS) - 1), F.lit(0)).alias(f"_t{i}") for i in range(SUMS)]
    steps = steps.select("conv_id", F.col("pos").alias("depth"), "n_bytes", "_end", *bits)
    steps = running(steps, ["conv_id"], [F.asc("depth")], {f"_k{i}": F.col(f"_t{i}") for i in range(SUMS)} | {"_upto": F.col("n_bytes")})

    def key(sums: list[Column], i: int) -> Column:
        return F.shiftleft(sums[i] % (1 << BITS), BITS) + sums[i + 1] % (1 << BITS)

    here = [F.col(f"_k{i}") for i in range(SUMS)]
    before = [F.col(f"_k{i}") - F.col(f"_t{i}") for i in range(SUMS)]
    names = [key(here, 0).alias("_a"), key(here, 2).alias("_b"), key(before, 0).alias("_pa"), key(before, 2).alias("_pb")]
    return steps.select("conv_id", "depth", "n_bytes", "_end", (F.col("_upto") - F.col("n_bytes")).alias("_before"), *names)


def hashes_of_ends(ends: DataFrame) -> DataFrame:
    """ends_sha256 of each node: of the decimal ids that end there, ascending, comma-joined."""
    schema = "depth bigint, _a bigint, _b bigint, first bigint, ids string"

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("trie")
        for batch in batches:
            cells = [np.asarray(c) for c in batch.columns]
            n = len(cells[0])
            new = np.ones(n, bool)
            new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in cells[:3]])
            at = np.flatnonzero(new)
            # A long run is cut: an id and its comma take 21 bytes at most.
            bounds = np.array([y for a, b in zip(at.tolist(), [*at[1:].tolist(), n]) for y in range(a, b, PIECE // 21)], np.int64)
            ids = cells[3].astype(str).tolist()
            text = [",".join(ids[a:b]) for a, b in zip(bounds.tolist(), [*bounds[1:].tolist(), n])]
            yield pa.RecordBatch.from_arrays([*[pa.array(c[bounds]) for c in cells], pa.array(text, pa.string())], names=["depth", "_a", "_b", "first", "ids"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("trie")
        node, digest = None, hashlib.sha256()
        for batch in batches:
            done = []
            for *at, ids in zip(*(c.to_pylist() for c in (*batch.columns[:3], batch.columns[4]))):
                if at != node:
                    if node is not None:
                        done.append((*node, digest.hexdigest()))
                    node, digest = at, hashlib.sha256()
                    digest.update(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            yield _table(done)
        if node is not None:
            yield _table([(*node, digest.hexdigest())])

    def _table(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) or [(), (), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string()))], names=[*NODE, "ends_sha256"])

    n = ranges(ends.sparkSession)
    ordered = ends.select(*NODE, "conv_id").repartitionByRange(n, *NODE, "conv_id").sortWithinPartitions(*NODE, "conv_id")
    pieces = ordered.mapInArrow(strings, schema)
    return pieces.repartition(n, *NODE).sortWithinPartitions(*NODE, "first").mapInArrow(hashed, "depth bigint, _a bigint, _b bigint, ends_sha256 string")


def trie(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """Of each node: conv_id (its smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    steps = _steps(rows, sizes)
    col = F.col
    nodes = steps.groupBy(*NODE).agg(
        F.min("conv_id").alias("owner"), F.count("*").alias("n_convs"), F.count_if("_end").alias("n_ends"), F.max("_before").alias("_before"), F.max("_pa").alias("_pa"), F.max("_pb").alias("_pb")
    )
    nodes = cut(nodes)
    childless = (col("n_ends") == col("n_convs")).cast("bigint")
    owned = nodes.groupBy(col("owner").alias("conv_id")).agg(F.min(F.struct("depth", "_before", "_pa", "_pb")).alias("top"), F.max(childless).alias("leaf"), F.count("*").alias("n_owned"))
    owned = cut(owned)
    ends = steps.where("_end")
    # What a member that owns nothing adds reaches to the end of its path.
    members = cut(ends.select("conv_id", "depth", (col("_before") + col("n_bytes")).alias("_all")).join(owned, "conv_id", "left"))
    members = members.select("conv_id", (col("depth") + 1).alias("n_steps"), F.coalesce("top._before", "_all").alias("_until"), F.coalesce("leaf", F.lit(0)).alias("leaf"))
    added = F.greatest(col("_until") - col("_before"), F.lit(0))
    sums = join_unique(steps, members, ["conv_id"], col("n_steps")).groupBy(*NODE).agg(F.sum(added).alias("saved_tokens"), F.sum("leaf").alias("n_leaves"))
    children = nodes.where("depth > 0").groupBy((col("depth") - 1).alias("depth"), col("_pa").alias("_a"), col("_pb").alias("_b")).agg(F.count("*").alias("n_children"))
    nothing = F.sha2(F.lit(""), 256)
    whole = nodes.join(sums, NODE).join(children, NODE, "left").join(hashes_of_ends(ends), NODE, "left")
    whole = cut(whole.select(*NODE, "owner", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), "n_leaves", "saved_tokens", F.coalesce("ends_sha256", nothing).alias("ends_sha256")))
    tops = owned.select("conv_id", "n_owned", col("top.depth").alias("_top"), (col("top.depth") - 1).alias("depth"), col("top._pa").alias("_a"), col("top._pb").alias("_b"))
    parents = whole.where("n_children > 0").select(*NODE, col("owner").alias("_parent"), "n_children")
    tops = cut(join_unique(tops, parents, NODE, col("n_children"), "left").select(col("conv_id").alias("owner"), "n_owned", "_top", "_parent"))
    found = join_unique(whole, tops, ["owner"], col("n_owned"))
    parent = F.when(col("depth") == col("_top"), col("_parent")).otherwise(col("owner"))
    return found.select(col("owner").alias("conv_id"), "depth", parent.alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
