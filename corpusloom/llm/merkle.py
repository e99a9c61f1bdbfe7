"""Merkle manifest of a document table, checked by octopus multiproofs.

Every row is a leaf: the hash of its columns, each with its length. The leaves of
a source, by doc_id, are joined in runs of ARITY, level by level, to its
subroot; the subroots, by source, likewise to the root. A leaf's proof holds the
other nodes of each run on its way up.

Proofs are made for a partition of neighbouring leaves at a time. The nodes that
the partition can't work out from its own leaves, at most 2 (ARITY - 1) of each
level of a tree, are one set of coordinates; they are fetched by one join. From
them and its leaves the partition derives all nodes inside, and takes each
leaf's proof from those. The text of a document is hashed where it is read and
isn't shuffled; a source of any size is spread over partitions of neighbouring ids.

A null column is hashed as `-`; a null source is a source, before the others, and a null
doc_id is before the others of its source. Rows of equal source and doc_id are
leaves of their own in the order of their hashes. Other columns play no part.
An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import discard, keep

ARITY, SHIFT = 16, 4
#: Tree number of the tree over subroots; sources count from 0.
UPPER = -1
_TEXTS = ("leaf", "subroot", "root", "proof_sha256", "folded_root")
_PROVED = pa.schema([("doc_id", pa.int64()), *((c, pa.string()) for c in _TEXTS), ("verified", pa.bool_())])


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_hash(text: Column) -> Column:
    """Hash of a row with this text."""

    def part(c: Column) -> Column:
        value = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return F.sha2(F.concat(*(part(c) for c in (F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text))), 256)


def lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tampered(docs: DataFrame, divisor: int = 5) -> DataFrame:
    """doc_id, source, leaf, changed: hashes of each row, and of it with its text in lower case where crc32 of the doc_id is divisible."""
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % divisor == 0, F.lit(False))
    both = docs.select("doc_id", "source", leaf_hash(F.col("text")).alias("leaf"), F.when(hit, leaf_hash(lower_ascii(F.col("text")))).alias("changed"))
    return both.withColumn("changed", F.coalesce("changed", "leaf"))


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A sorted partition's rows, with the number of their source in it and their place among those of that source."""
    part, ordinal, after, last = TaskContext.get().partitionId(), -1, 0, None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        source = batch.column("source").to_numpy(zero_copy_only=False)
        new = np.ones(n, bool)
        new[0] = ordinal < 0 or source[0] != last
        new[1:] = source[1:] != source[:-1]
        number = ordinal + np.cumsum(new)
        local = np.arange(n) - np.maximum.accumulate(np.where(new, np.arange(n), -after))
        ordinal, after, last = int(number[-1]), int(local[-1]) + 1, source[-1]
        own = [pa.array(np.full(n, part, np.int32)), pa.array(number.astype(np.int64)), pa.array(local.astype(np.int64))]
        yield pa.RecordBatch.from_arrays([*own, *batch.columns], names=["part", "ordinal", "local", *batch.schema.names])


def ordered(leaves: DataFrame, per_part: int) -> DataFrame:
    """part, tree, idx, doc_id, leaf, changed: leaves numbered within their source, and neighbours in one part of about per_part rows.

    The driver sees a row of fixed size for each part, from which the first number of each follows.
    """
    spark = leaves.sparkSession
    rows = keep(leaves.withColumn("source", F.coalesce(F.concat(F.lit("1"), "source"), F.lit("0"))), "leaves")
    parts = max(-(-rows.count() // per_part), int(spark.conf.get("spark.sql.shuffle.partitions")))
    order = ["source", "doc_id", "leaf", "tie"]  # equal rows are spread too
    spread = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    local = keep(spread.drop("tie").mapInArrow(_numbered, "part int, ordinal bigint, local bigint, doc_id bigint, source string, leaf string, changed string"), "ordered")
    discard(rows)
    name = F.sha2("source", 256)
    sizes = local.groupBy("part").agg(F.min_by(name, "ordinal").alias("low"), F.max_by(name, "ordinal").alias("high"), F.max("ordinal").alias("more"), F.max(F.struct("ordinal", "local"))["local"].alias("end"))
    starts, tree, before, last = [], -1, 0, None
    for part, low, high, more, end in sorted(sizes.collect()):
        goes_on = low == last
        first, before = (tree, before) if goes_on else (tree + 1, 0)
        starts.append((part, first, before))
        tree, before, last = first + more, (0 if more else before) + end + 1, high
    known = F.broadcast(spark.createDataFrame(starts, "part int, first bigint, before bigint"))  # a row of three numbers for each part
    place = F.col("local") + F.when(F.col("ordinal") == 0, F.col("before")).otherwise(0)
    return local.join(known, "part").select("part", (F.col("first") + F.col("ordinal")).alias("tree"), place.alias("idx"), "doc_id", "leaf", "changed")


def levels(leaves: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Nodes (tree, level, idx, digest) above the leaves (tree, idx, digest), a table for each level, and the top (tree, digest) of each tree."""
    above, tops, nodes = [], [], leaves
    for level in range(1, 64):
        run = nodes.groupBy("tree", F.shiftright("idx", SHIFT).alias("idx")).agg(F.sort_array(F.collect_list(F.struct("idx", "digest"))).alias("pairs"))
        runs = keep(run.select("tree", "idx", F.size("pairs").alias("n"), F.array_join("pairs.digest", "").alias("digests")), "runs")
        alone = (F.col("idx") == 0) & (F.col("n") == 1)  # the only node of its tree
        tops.append(runs.where(alone).select("tree", F.col("digests").alias("digest")))
        nodes = runs.where(~alone).select("tree", F.lit(level).alias("level"), "idx", F.sha2("digests", 256).alias("digest"))
        if nodes.isEmpty():
            break
        above.append(nodes)
    top = tops[0]
    for t in tops[1:]:
        top = top.unionByName(t)
    return above, top


def missing(spans: DataFrame, n_levels: int) -> DataFrame:
    """part, tree, level, idx of the nodes that the leaves low to high of a tree of n can't give, each once."""
    rows = spans.select("*", F.explode(F.sequence(F.lit(0), F.lit(max(0, n_levels - 1)))).alias("level"))
    rows = rows.withColumns({name: F.expr(f"shiftright({c}, {SHIFT} * level)") for name, c in (("a", "low"), ("b", "high"), ("last", "n - 1"))})
    start, stop = F.col("a") - F.col("a") % ARITY, F.least(F.col("b") - F.col("b") % ARITY + ARITY - 1, "last")
    none = F.array().cast("array<bigint>")
    left = F.when(F.col("a") > start, F.sequence(start, F.col("a") - 1)).otherwise(none)
    right = F.when(stop > F.col("b"), F.sequence(F.col("b") + 1, stop)).otherwise(none)
    return rows.select("part", "tree", "level", F.explode(F.concat(left, right)).alias("idx"))


class Octopus:
    """All nodes on and beside the ways up from neighbouring leaves of a tree."""

    def __init__(self, low: int, own: list[str], fetched: dict[tuple[int, int], str]):
        self.windows: list[tuple[int, list[str]]] = []  # of each level: first index, digests of whole runs
        level = 0
        while True:
            first, after = low, low + len(own)
            window = list(own)
            while (level, first - 1) in fetched:
                first -= 1
                window.insert(0, fetched[level, first])
            while (level, after) in fetched:
                window.append(fetched[level, after])
                after += 1
            if first == 0 and len(window) == 1:
                self.top = window[0]
                break
            self.windows.append((first, window))
            own = [digest("".join(window[i : i + ARITY])) for i in range(0, len(window), ARITY)]
            low, level = first // ARITY, level + 1
        self._known: dict[tuple[int, int], tuple[list[tuple[str, str]], str]] = {}

    def siblings(self, idx: int, level: int = 0) -> tuple[list[tuple[str, str]], str]:
        """What is left and right of a node in its run, and of the nodes above it; and all that, joined."""
        if level == len(self.windows):
            return [], ""
        if (level, idx) not in self._known:
            first, window = self.windows[level]
            start = idx - idx % ARITY - first
            beside = "".join(window[start : idx - first]), "".join(window[idx - first + 1 : start + ARITY])
            steps, joined = self.siblings(idx // ARITY, level + 1)
            found = [beside, *steps], beside[0] + beside[1] + joined
            if not level:
                return found
            self._known[level, idx] = found
        return self._known[level, idx]


def _prove(published: str):
    def run(leaves: pa.Table, fetched: pa.Table) -> pa.Table:
        leaves = leaves.sort_by([("tree", "ascending"), ("idx", "ascending")])
        known: dict[int, dict] = {}
        for tree, level, idx, d in zip(*(fetched.column(c).to_pylist() for c in ("tree", "level", "idx", "digest")), strict=True):
            known.setdefault(tree, {})[level, idx] = d
        tree, idx = leaves.column("tree").to_numpy(), leaves.column("idx").to_numpy()
        leaf, changed = leaves.column("leaf").to_pylist(), leaves.column("changed").to_pylist()
        cut = [0, *(np.flatnonzero(np.diff(tree)) + 1).tolist(), len(tree)]
        spans = [(int(tree[a]), a, b) for a, b in zip(cut, cut[1:], strict=False) if b > a]
        trees = {t: Octopus(int(idx[a]), leaf[a:b], known.get(t, {})) for t, a, b in spans}
        upper = Octopus(spans[0][0], [trees[t].top for t, *_ in spans], known.get(UPPER, {}))
        proofs, folded, tops = [], [], []
        for t, a, b in spans:
            steps_up, joined_up = upper.siblings(t)
            tops += [trees[t].top] * (b - a)
            for i in range(a, b):
                steps, joined = trees[t].siblings(int(idx[i]))
                proofs.append(digest(joined + joined_up))
                node = changed[i]
                for left, right in steps:
                    node = digest(left + node + right)
                for left, right in steps_up:
                    node = digest(left + node + right)
                folded.append(node)
        n = len(leaf)
        return pa.Table.from_arrays([leaves.column("doc_id"), pa.array(leaf, pa.string()), pa.array(tops, pa.string()), pa.array([upper.top] * n, pa.string()), pa.array(proofs, pa.string()), pa.array(folded, pa.string()), pa.array([f == published for f in folded], pa.bool_())], schema=_PROVED)

    return run


def manifest(docs: DataFrame, per_part: int = 50_000) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every row; tampered rows fold to another root.

    A task holds the leaves of one part, about per_part of them, and the nodes fetched for it.
    """
    leaves = keep(ordered(tampered(docs), per_part), "numbered")
    own, subroots = levels(leaves.select("tree", "idx", F.col("leaf").alias("digest")))
    roots = subroots.select(F.lit(UPPER).cast("bigint").alias("tree"), F.col("tree").alias("idx"), "digest")
    above, top = levels(roots)
    published = top.first()
    spans = leaves.groupBy("part", "tree").agg(F.min("idx").alias("low"), F.max("idx").alias("high"), F.count("*").alias("held"))
    sizes = spans.groupBy("tree").agg(F.sum("held").alias("n"))
    mine = spans.join(sizes, "tree").select("part", "tree", "low", "high", "n")
    n_trees = subroots.count()
    whole = spans.groupBy("part").agg(F.min("tree").alias("low"), F.max("tree").alias("high")).select("part", F.lit(UPPER).cast("bigint").alias("tree"), "low", "high", F.lit(n_trees).cast("bigint").alias("n"))
    wanted = missing(mine, len(own)).unionByName(missing(whole, len(above)))
    nodes = leaves.select("tree", F.lit(0).alias("level"), "idx", F.col("leaf").alias("digest")).unionByName(roots.select("tree", F.lit(0).alias("level"), "idx", "digest"))
    for table in own + above:
        nodes = nodes.unionByName(table)
    fetched = keep(wanted.join(nodes, ["tree", "level", "idx"]).select("part", "tree", "level", "idx", "digest"), "fetched")
    kinds = "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return leaves.groupBy("part").cogroup(fetched.groupBy("part")).applyInArrow(_prove(published["digest"] if published else ""), kinds)
