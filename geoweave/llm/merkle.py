"""Merkle manifest of a dataset by time-forward processing.

Every row is a leaf; leaves of one source, in order, form a tree of runs of three, and the roots of the sources form one more such tree. A node is labelled (tree, level, index).
Digests travel forward in order of labels through a priority queue: a node is worked off when all digests that its children sent to its label are at the head. Then the
order is reversed, and each node sends the proof of what lies above it to its children. Inside a task the queue is a heap over one block of 3**6 neighbouring nodes; between blocks
the queue is external: a shuffle that brings the messages of a block together, sorted. So a pass climbs six levels, and ten thousand million leaves take four passes up and four down.
"""

from __future__ import annotations

import hashlib
import heapq

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoweave.llm.common import is_broadcastable
from geoweave.session import cut_lineage

ARITY, LEVELS = 3, 6
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf_digest(docs: DataFrame, **changed: Column) -> Column:
    """SHA-256 of the fields of a row, each `-` if null and otherwise its UTF-8 length, a colon and the value; `changed` replaces columns. A missing column counts as null."""
    def part(name: str) -> Column:
        value = changed.get(name, F.col(f"`{name}`") if name in docs.columns else F.lit(None)).cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))
    return F.sha2(F.concat(*[part(c) for c in FIELDS]), 256)


def joined(digests: list[str]) -> str:
    return hashlib.sha256("".join(digests).encode()).hexdigest()


def height(n: int, most: int) -> int:
    """Levels above `n` neighbouring nodes until one is left, at most `most`."""
    levels = 0
    while n > 1 and levels < most:
        n, levels = -(-n // ARITY), levels + 1
    return levels


def climb(digests: list[str], levels: int) -> tuple[str, list[tuple[int, int, list[str]]]]:
    """The top of a block and its inner nodes (level, index, digests of the children) in order of labels; a run at the end may be short."""
    queue = [(1, i // ARITY, i % ARITY, d) for i, d in enumerate(digests)] if levels else []
    inner, top = [], digests[0]
    while queue:
        level, index = queue[0][:2]
        run = []
        while queue and queue[0][:2] == (level, index):
            run.append(heapq.heappop(queue)[3])
        inner.append((level, index, run))
        top = joined(run)
        if level < levels:
            heapq.heappush(queue, (level + 1, index // ARITY, index % ARITY, top))
    return top, inner


def descend(inner: list[tuple[int, int, list[str]]], leaves: int, proof: list[str]) -> list[list[str]]:
    """For each node at the foot of a block its proof, from its own run upwards: the siblings to the left as one string, then those to the right, for each level. `proof` is that of the top."""
    if not inner:
        return [proof] * leaves
    sent = {inner[-1][:2]: proof}
    foot = [proof] * leaves
    for level, index, run in reversed(inner):
        above = sent.pop((level, index))
        for k in range(len(run)):
            own = ["".join(run[:k]), "".join(run[k + 1:]), *above]
            if level > 1:
                sent[level - 1, index * ARITY + k] = own
            else:
                foot[index * ARITY + k] = own
    return foot


def fold(digest: str, proof: list[str]) -> str:
    """The root that a leaf and its proof lead to."""
    for left, right in zip(proof[::2], proof[1::2]):
        digest = joined([left, digest, right])
    return digest


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)


def _blocks(batches, columns: tuple[str, ...]):
    """((tree, block), rows) of neighbouring rows of one block."""
    key, rows = None, []
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in columns)):
            if rows and row[:2] != key:
                yield key, rows
                rows = []
            key = row[:2]
            rows.append(row[2:])
    if rows:
        yield key, rows


def in_order(rows: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """`rows` with `index` from 0 and `n`, the count, inside each `tree` (a non-null string column), ordered by `order`, nulls first.

    Rows are sorted over range partitions, a number inside the partition is added to the count of the partitions before, so a tree with a third of the rows is spread. Equal rows are
    spread too: a row number breaks their tie, which changes nothing. Only one row for each partition and tree is summed by a window.
    """
    keys = [F.col(c).asc_nulls_first() for c in order]
    fields = rows.columns
    ranged = rows.withColumn("m_tie", F.monotonically_increasing_id()).repartitionByRange(F.col(tree), *keys, "m_tie").withColumn("m_part", F.spark_partition_id()).sortWithinPartitions(F.col(tree), *keys, "m_tie")

    def number(batches):
        last, at = None, 0
        for batch in batches:
            own = []
            for t in batch.column(tree).to_pylist():
                last, at = t, at + 1 if t == last else 0
                own.append(at)
            yield batch.append_column("m_at", pa.array(own, pa.int64()))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranged.schema) + ", m_at bigint"
    placed = cut_lineage(ranged.mapInArrow(number, kinds).drop("m_tie"))
    counts = placed.groupBy(tree, "m_part").agg(F.count(F.lit(1)).alias("m_n"))
    before, whole = Window.partitionBy(tree).orderBy("m_part").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(tree)
    offsets = cut_lineage(counts.select(tree, "m_part", F.coalesce(F.sum("m_n").over(before), F.lit(0)).alias("m_before"), F.sum("m_n").over(whole).alias("n")))
    side = F.broadcast(offsets) if is_broadcastable(offsets.count(), 80) else offsets
    return placed.join(side, [tree, "m_part"]).select(*fields, (F.col("m_before") + F.col("m_at")).alias("index"), "n")


def _climbed(nodes: DataFrame, levels: int) -> DataFrame:
    """One pass up: (tree, index, n, digest) of the block tops of (tree, index, n, digest)."""
    def run(batches):
        out = []
        for (tree, block), rows in _blocks(batches, ("tree", "block", "n", "digest")):
            n = rows[0][0]
            out.append((tree, block, -(-n // ARITY ** levels), climb([d for _, d in rows], height(n, levels))[0]))
            if len(out) >= 4000:
                yield _batch(out, names, kinds)
                out = []
        if out:
            yield _batch(out, names, kinds)
    names, kinds = ["tree", "index", "n", "digest"], [pa.string(), pa.int64(), pa.int64(), pa.string()]
    dealt = nodes.select("tree", F.floor(F.col("index") / ARITY ** levels).alias("block"), "index", "n", "digest")
    return dealt.repartition("tree", "block").sortWithinPartitions("tree", "block", "index").mapInArrow(run, "tree string, index bigint, n bigint, digest string")


def _descended(nodes: DataFrame, above: DataFrame, levels: int, finish=None, schema: str = "tree string, index bigint, proof array<string>, subroot string", kept: tuple[str, ...] = ()) -> DataFrame:
    """One pass down: the proof of every node of (tree, index, n, digest) from (tree, index, proof, subroot) of the block tops, which is sent to its block ahead of the nodes.

    `finish(row, proof, subroot)` makes the output rows of the last pass from the columns `kept`.
    """
    blank = {c: F.lit(None).cast(nodes.schema[c].dataType).alias(c) for c in ("n", "digest", *kept)}
    sent = above.select("tree", F.col("index").alias("block"), F.lit(-1).cast("bigint").alias("index"), *blank.values(), "proof", "subroot")
    dealt = nodes.select("tree", F.floor(F.col("index") / ARITY ** levels).alias("block"), "index", "n", "digest", *kept, F.lit(None).cast("array<string>").alias("proof"), F.lit(None).cast("string").alias("subroot"))
    both = dealt.unionByName(sent).repartition("tree", "block").sortWithinPartitions("tree", "block", "index")
    names = [c.split()[0] for c in schema.split(", ")]
    types = {"bigint": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}
    kinds = [types[c.split()[1]] for c in schema.split(", ")]

    def run(batches):
        out = []
        for (tree, block), rows in _blocks(batches, ("tree", "block", "index", "n", "digest", *kept, "proof", "subroot")):
            message, rows = rows[0], rows[1:]
            proof, subroot = message[-2], message[-1]
            inner = climb([r[2] for r in rows], height(rows[0][1], levels))[1]
            for row, own in zip(rows, descend(inner, len(rows), proof)):
                out.append(finish(row[3:-2], own, subroot) if finish else (tree, row[0], own, subroot))
            if len(out) >= 4000:
                yield _batch(out, names, kinds)
                out = []
        if out:
            yield _batch(out, names, kinds)
    return both.mapInArrow(run, schema)


def _tree_passes(nodes: DataFrame, levels: int) -> list[DataFrame]:
    """`nodes` and the tables of block tops above it, until every tree has one node."""
    passes = [nodes]
    while passes[-1].agg(F.max("n")).first()[0] > 1:
        passes.append(cut_lineage(_climbed(passes[-1], levels)))
    return passes


def manifest(docs: DataFrame, presented: Column | None = None, with_proofs: bool = False, levels: int = LEVELS) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified), one row for each row of `docs`, and with `with_proofs` the proof itself.

    Leaves of a source are ordered by doc_id (null first), then by digest; sources by their UTF-8 bytes, null first. `presented` is the leaf that somebody presents for
    verification (default: the leaf itself): it is folded with the siblings of the proof, and verified says whether that leads to the root. A pass climbs `levels` levels. Null fields are part of the digest;
    repeated rows are leaves of their own; an empty table gives no rows.
    """
    source = F.col("source").cast("string") if "source" in docs.columns else F.lit(None).cast("string")
    # null sources sort before all others, the empty one included
    rows = docs.select(F.coalesce(F.concat(F.lit("+"), source), F.lit("")).alias("tree"), F.col("doc_id").cast("bigint").alias("doc_id"), leaf_digest(docs).alias("digest"),
                       (leaf_digest(docs) if presented is None else presented).alias("shown"))
    rows = cut_lineage(rows.withColumn("shown", F.when(F.col("shown") != F.col("digest"), F.col("shown"))))
    schema = "doc_id bigint, leaf string, subroot string, proof_sha256 string, folded_root string" + (", proof array<string>" if with_proofs else "")
    leaves = cut_lineage(in_order(rows, "tree", ["doc_id", "digest"]))
    if leaves.isEmpty():
        return docs.sparkSession.createDataFrame([], "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean" + (", proof array<string>" if with_proofs else ""))
    passes = _tree_passes(leaves, levels)
    tops = passes[-1].select(F.lit("").alias("tree"), F.col("tree").alias("of"), "digest")
    forest = _tree_passes(cut_lineage(in_order(tops, "tree", ["of"])), levels)
    root = forest[-1].first()["digest"]
    down = docs.sparkSession.range(1).select(F.lit("").alias("tree"), F.lit(0).cast("bigint").alias("index"), F.array().cast("array<string>").alias("proof"), F.lit(None).cast("string").alias("subroot"))
    for nodes in reversed(forest[1:-1]):
        down = cut_lineage(_descended(nodes, down, levels))
    down = cut_lineage(_descended(forest[0].withColumn("own", F.col("digest")), down, levels, lambda row, proof, _: (row[0], 0, proof, row[1]), kept=("of", "own")) if len(forest) > 1 else
                       forest[0].select(F.col("of").alias("tree"), F.lit(0).cast("bigint").alias("index"), F.array().cast("array<string>").alias("proof"), F.col("digest").alias("subroot")))
    for nodes in reversed(passes[1:-1]):
        down = cut_lineage(_descended(nodes, down, levels))

    def finish(row, proof, subroot):
        doc_id, leaf, shown = row
        return (doc_id, leaf, subroot, joined(proof), fold(shown or leaf, proof), *([proof] if with_proofs else []))
    out = _descended(leaves.withColumn("leaf", F.col("digest")), down, levels, finish, schema, ("doc_id", "leaf", "shown"))
    out = out.withColumn("root", F.lit(root)).withColumn("verified", F.col("folded_root") == F.lit(root))
    return out.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", *(["proof"] if with_proofs else []))
