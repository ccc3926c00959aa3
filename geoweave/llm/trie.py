"""Conversation prefix trie, built as burst tries.

A conversation is a path of turn ids (128-bit digests of role and text, fixed width, so byte order of paths is the order of the trie). Equal paths are counted once. A container
holds the paths below one head, a prefix that they share. A container above its size bursts: its head is lengthened to the longest prefix that all of its paths share, and the
paths are dealt into one container for each next turn id. What is left after that is bounded; those containers are spread by head, sorted, and swept into nodes with a stack
as deep as the path. The burst heads themselves are summed up from their containers, last burst first.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoweave.session import cut_lineage

#: Bytes of a turn id.
ID = 16
NODE = "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string, head binary, up binary, top boolean"
NONE = hashlib.sha256(b"").hexdigest()


def turn_paths(conversations: DataFrame) -> DataFrame:
    """(conv_id, path, sizes): the turn ids of each conversation in order of `turn` (null first, ties by role and id) and the code points of each text; no text is shuffled.

    Null roles and texts are empty. Rows without a conv_id belong to no conversation.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    name = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))
    turn = F.struct(F.col("turn").isNotNull().alias("has"), F.col("turn").cast("bigint").alias("turn"), role.alias("role"), name.alias("id"), F.length(text).alias("size"))
    rows = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("bigint").alias("conv_id"), turn.alias("t"))
    ordered = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    return ordered.select("conv_id", F.unhex(F.array_join("t.id", "")).alias("path"), F.col("t.size").alias("sizes"))


def rebuilt_paths(paths: DataFrame) -> DataFrame:
    """`paths` with the first h turns of each conversation c replaced by the first h of conversation c-c%100 (none if it is absent), where h = crc32 of the decimal c, modulo 6."""
    shared = F.crc32(F.col("conv_id").cast("string")) % 6
    own = paths.withColumn("h", shared.cast("int")).withColumn("base", F.col("conv_id") - F.col("conv_id") % 100)
    bases = paths.filter("conv_id % 100 = 0").select(F.col("conv_id").alias("base"), F.substring("path", 1, 5 * ID).alias("b_path"), F.slice("sizes", 1, 5).alias("b_sizes"))
    both = own.join(bases, "base", "left")
    path = F.concat(F.coalesce(F.substring("b_path", F.lit(1), F.col("h") * ID), F.unhex(F.lit(""))), F.substring("path", F.col("h") * ID + 1, F.octet_length("path")))
    sizes = F.concat(F.coalesce(F.slice("b_sizes", F.lit(1), F.col("h")), F.array().cast("array<int>")), F.slice("sizes", F.col("h") + 1, F.size("sizes")))
    return both.select("conv_id", path.alias("path"), sizes.alias("sizes"))


def member_digests(keyed: DataFrame, block: int = 1 << 14) -> DataFrame:
    """(key, n, least, sha) of (key, conv_id): the SHA-256 of the ids of each key, ascending and comma-joined.

    Ids are sorted over all range partitions, so a key with a third of them is spread; each partition writes blocks of at most `block` ids as text, and one task then
    feeds the blocks of a key in order to a running digest, which holds one block at a time.
    """
    def blocks(batches):
        key, ids = None, []
        for batch in batches:
            for k, c in zip(batch.column("key").to_pylist(), batch.column("conv_id").to_pylist()):
                if ids and (k != key or len(ids) >= block):
                    yield key, ids
                    ids = []
                key = k
                ids.append(c)
        if ids:
            yield key, ids

    def write_blocks(batches):
        out, size = [], 0
        for key, ids in blocks(batches):
            out.append((key, ids[0], len(ids), ",".join(map(str, ids))))
            size += len(out[-1][3])
            if size > 1 << 20 or len(out) >= 10000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.binary(), pa.int64(), pa.int64(), pa.string()))], names=["key", "least", "n", "ids"])
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.binary(), pa.int64(), pa.int64(), pa.string()))], names=["key", "least", "n", "ids"])

    def digest(batches):
        key, state, n, least = None, None, 0, 0
        for batch in batches:
            out = []
            for k, first, count, ids in zip(*(batch.column(c).to_pylist() for c in ("key", "least", "n", "ids"))):
                if k == key:
                    state.update(b",")
                else:
                    if state is not None:
                        out.append((key, n, least, state.hexdigest()))
                    key, state, n, least = k, hashlib.sha256(), 0, first
                state.update(ids.encode())
                n += count
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.binary(), pa.int64(), pa.int64(), pa.string()))], names=["key", "n", "least", "sha"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in ((key, pa.binary()), (n, pa.int64()), (least, pa.int64()), (state.hexdigest(), pa.string()))], names=["key", "n", "least", "sha"])

    spread = keyed.select("key", "conv_id").repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    chunks = spread.mapInArrow(write_blocks, "key binary, least bigint, n bigint, ids string")
    return chunks.repartition("key").sortWithinPartitions("key", "least").mapInArrow(digest, "key binary, n bigint, least bigint, sha string")


def _depth(path: str = "path") -> Column:
    return (F.octet_length(path) / ID).cast("int")


def _shared_turns(a: str, b: str) -> Column:
    """How many turns two paths share from the start."""
    n = F.least(_depth(a), _depth(b))
    differs = F.filter(F.sequence(F.lit(0), n), lambda i: (i == n) | (F.substring(F.col(a), i * ID + 1, F.lit(ID)) != F.substring(F.col(b), i * ID + 1, F.lit(ID))))
    return F.get(differs, F.lit(0))


def burst(paths: DataFrame, container_bytes: int) -> tuple[DataFrame, list[DataFrame]]:
    """The containers, as rows (head, up, depth, level, path, sizes, n, least, sha) of `paths` (path, sizes, n, least, sha), and one table of burst heads for each round.

    Every round measures the containers of the last one (partial sums, least and greatest path) and bursts those above `container_bytes`; only their rows are written again. A
    container of one path is never burst. Rounds: as many as there are branchings with more than `container_bytes` of paths below, along one path.
    """
    live = paths.withColumn("head", F.unhex(F.lit(""))).withColumn("up", F.lit(None).cast("binary")).withColumn("depth", F.lit(0)).withColumn("level", F.lit(0))
    live, settled, heads = cut_lineage(live), [], []
    while True:
        held = live.groupBy("head").agg(F.count(F.lit(1)).alias("paths"), F.sum(F.octet_length("path") - F.col("depth") * ID + ID).alias("bytes"), F.min("path").alias("lo"), F.max("path").alias("hi"),
                                        F.first("depth").alias("from"), F.first("up").alias("over"))
        large = cut_lineage(held.filter((F.col("paths") > 1) & (F.col("bytes") > container_bytes)).withColumn("to", _shared_turns("lo", "hi")))
        if large.isEmpty():
            settled.append(live)
            break
        marked = live.join(large.select("head", "to"), "head", "left")
        settled.append(live.join(large.select("head"), "head", "left_anti"))
        opened = marked.filter("to is not null")
        ending = opened.filter(_depth() == F.col("to")).select("head", F.col("n").alias("end_n"), F.col("least").alias("end_least"), F.col("sha").alias("end_sha"))
        sizes = opened.groupBy("head").agg(F.first(F.slice("sizes", F.lit(1), F.col("to"))).alias("sizes"))
        heads.append(cut_lineage(large.select("head", "over", "from", "to").join(sizes, "head").join(ending, "head", "left")))
        below = opened.filter(_depth() > F.col("to")).select(F.substring("path", F.lit(1), (F.col("to") + 1) * ID).alias("head"), F.col("head").alias("up"), (F.col("to") + 1).alias("depth"),
                                                             (F.col("level") + 1).alias("level"), "path", "sizes", "n", "least", "sha")
        live = cut_lineage(below)
    columns = ["head", "up", "depth", "level", "path", "sizes", "n", "least", "sha"]
    out = settled[0].select(columns)
    for part in settled[1:]:
        out = out.unionByName(part.select(columns))
    return out, heads


def sweep(rows: list[tuple], depth: int) -> list[list]:
    """Nodes of one container in preorder: [depth, parent's number, n, least, children, leaves, saved, sha]; rows (path, sizes, n, least, sha), sorted, distinct, with `depth` shared turns.

    The stack holds the path of the last row. A node is closed as soon as a row leaves it and adds itself to its parent, so every node is touched twice.
    """
    first = rows[0]
    nodes = [[depth, -1, 0, None, 0, 0, 0, NONE]]
    stack, texts, last = [0], [first[1][depth - 1] if depth else 0], None

    def close():
        own, size = nodes[stack.pop()], texts.pop()
        own[5] = own[5] or 1
        own[6] += (own[2] - 1) * size
        if stack:
            over = nodes[stack[-1]]
            over[2] += own[2]
            over[3] = own[3] if over[3] is None or own[3] < over[3] else over[3]
            over[4] += 1
            over[5] += own[5]
            over[6] += own[6]

    for path, sizes, n, least, sha in rows:
        end, keep = len(path) // ID, depth
        if last is not None:
            most = min(end, len(last) // ID)
            while keep < most and path[keep * ID:keep * ID + ID] == last[keep * ID:keep * ID + ID]:
                keep += 1
            while nodes[stack[-1]][0] > keep:
                close()
        for d in range(keep + 1, end + 1):
            nodes.append([d, stack[-1], 0, None, 0, 0, 0, NONE])
            stack.append(len(nodes) - 1)
            texts.append(sizes[d - 1])
        own = nodes[stack[-1]]
        own[2], own[3], own[7] = own[2] + n, least if own[3] is None else min(own[3], least), sha
        last = path
    while stack:
        close()
    return nodes


def _arrow(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (*[pa.int64()] * 7, pa.string(), pa.binary(), pa.binary(), pa.bool_())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=[c.split()[0] for c in NODE.split(", ")])


def swept(containers: DataFrame) -> DataFrame:
    """The nodes of all containers; one task holds one container at a time."""
    def run(batches):
        def close():
            nodes = sweep(rows, depth)
            return [(x[3], x[0], nodes[x[1]][3] if x[1] >= 0 else None, x[2], x[4], x[5], x[6], x[7], head, up if x[1] < 0 else None, x[1] < 0) for x in nodes]
        head, up, depth, rows, out = None, None, 0, [], []
        for batch in batches:
            for h, u, d, *row in zip(*(batch.column(c).to_pylist() for c in ("head", "up", "depth", "path", "sizes", "n", "least", "sha"))):
                if rows and h != head:
                    out += close()
                    rows = []
                    if len(out) >= 5000:
                        yield _arrow(out)
                        out = []
                head, up, depth = h, u, d
                rows.append(row)
        if rows:
            out += close()
        if out:
            yield _arrow(out)
    sorted_paths = containers.drop("level").repartition("head").sortWithinPartitions("head", "path")
    return sorted_paths.mapInArrow(run, NODE)


def _head_nodes(summed: DataFrame) -> DataFrame:
    """The nodes of burst heads, depth `from` to `to`, of rows (head, over, from, to, sizes, n, least, children, leaves, saved, end_sha)."""
    def run(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                saved, chain = r["saved"], []
                for d in range(r["to"], r["from"] - 1, -1):
                    saved += (r["n"] - 1) * r["sizes"][d - 1] if d else 0
                    last, first = d == r["to"], d == r["from"]
                    chain.append((r["least"], d, None if first else r["least"], r["n"], r["children"] if last else 1, r["leaves"], saved, (r["end_sha"] or NONE) if last else NONE,
                                  r["head"], r["over"] if first else None, first))
                out += chain
            if out:
                yield _arrow(out)
    return summed.mapInArrow(run, NODE)


def trie_nodes(paths: DataFrame, container_bytes: int = 1 << 16) -> DataFrame:
    """The trie of (conv_id, path, sizes): per node conv_id (its smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256.

    The root has depth 0 and no parent; a conversation without turns is a member of the root only; an empty table has no nodes.
    """
    keyed = cut_lineage(paths.withColumn("key", F.unhex(F.md5("path"))))
    alike = keyed.groupBy("key").agg(F.first("path").alias("path"), F.first("sizes").alias("sizes"))
    containers, heads = burst(alike.join(member_digests(keyed), "key").drop("key"), container_bytes)
    nodes = [cut_lineage(swept(containers))]
    known = None
    for table in reversed(heads):
        tops = [n.filter("top and up is not null").select("up", "n_convs", "conv_id", "n_leaves", "saved_tokens") for n in nodes]
        below = tops[0]
        for more in tops[1:]:
            below = below.unionByName(more)
        sums = below.groupBy(F.col("up").alias("head")).agg(F.sum("n_convs").alias("n"), F.min("conv_id").alias("least"), F.count(F.lit(1)).alias("children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
        joined = table.join(sums, "head").withColumn("n", F.col("n") + F.coalesce("end_n", F.lit(0))).withColumn("least", F.least("least", "end_least"))
        nodes.append(cut_lineage(_head_nodes(joined.select("head", "over", "from", "to", "sizes", "n", "least", "children", "leaves", "saved", "end_sha"))))
        least = nodes[-1].groupBy("head").agg(F.min("conv_id").alias("over_id"))
        known = least if known is None else known.unionByName(least)
    out = nodes[0]
    for more in nodes[1:]:
        out = out.unionByName(more)
    if known is not None:
        out = out.join(known.withColumnRenamed("head", "up"), "up", "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "over_id"))
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def conversation_trie(conversations: DataFrame, container_bytes: int = 1 << 16) -> DataFrame:
    """`trie_nodes` of the rebuilt conversations of a table (conv_id, turn, role, text); other columns are not read. Repeated rows are repeated turns."""
    own = cut_lineage(turn_paths(conversations))
    return trie_nodes(rebuilt_paths(own), container_bytes)
