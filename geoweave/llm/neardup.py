"""Near-duplicate documents by BagMinHash.

A document is the bag of its shingles of five words. BagMinHash (Ertl, 2018) gives each shingle a Poisson process over its discretised weight: weights are cut into the
levels (0,1], (1,2], (2,4], (4,8], ..., each level has a process of its own, and inside the level that holds the weight points are split into halves again and again, so
two documents see the same points as far as both weights reach. A signature component is the first point that falls on it, which makes the share of equal
components an unbiased estimate of the weighted Jaccard similarity. Only points up to a horizon are made, at which all components are expected to be filled; a text with an
empty component doubles its horizon.

Signatures are banded; what shares a band is compared by multiset overlap, through leaders instead of all pairs, and linked documents form classes.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoweave.llm.common import is_broadcastable, packed, text_of, unpacked
from geoweave.operators.components import connected_components
from geoweave.session import cut_lineage

SHINGLE, BANDS, ROWS, SIMILARITY = 5, 28, 5, 0.8
U = np.uint64
_CLASS = np.zeros(256, dtype=bool)
_CLASS[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x + U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def shingles(texts: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(shingle hashes, document number of each) of a string array without nulls, in order.

    Words are runs of digits, letters a-z (A-Z folded) and bytes beyond ASCII. A text of fewer words than `size`, but not none, is one shingle.
    """
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = _FOLD[np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[offsets[0]:offsets[-1]]]
    offsets = offsets - offsets[0]
    inside = _CLASS[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    begins[edges] = inside[edges]
    start = np.flatnonzero(begins)
    if not len(start):
        return np.zeros(0, dtype=U), np.zeros(0, dtype=np.int64)
    # polynomial hash of each word, by sums over the bytes weighted from the left, seeded by place in the word
    length = np.add.reduceat(inside, start, dtype=np.int64)
    document = np.searchsorted(offsets, start, side="right") - 1
    place = np.zeros(len(data), dtype=np.int64)
    place[start[0]:] = np.arange(start[0], len(data)) - np.repeat(start, np.diff(np.append(start, len(data))))
    power = mix(np.arange(int(place.max()) + 1, dtype=U)) | U(1)
    value = np.where(inside, (data.astype(U) + U(1)) * power[place], U(0))
    words = mix(np.add.reduceat(value, start) ^ (length.astype(U) << U(48)))
    # shingles: a window belongs to a text if its last word does
    n = np.bincount(document, minlength=len(texts))
    first = np.cumsum(n) - n
    windows = np.maximum(n - size + 1, np.minimum(n, 1))
    owner = np.repeat(np.arange(len(texts)), windows)
    at = np.repeat(first, windows) + np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
    out = np.zeros(len(owner), dtype=U)
    for k in range(size):
        has = (k < n[owner])
        out = mix(out ^ np.where(has, words[np.minimum(at + k, len(words) - 1)] + U(k), U(0)))
    return out, owner


def bags(hashes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, owner, weight) of the distinct shingles of each document."""
    if not len(hashes):
        return hashes, owner, np.zeros(0, dtype=np.int64)
    order = np.lexsort((hashes, owner))
    h, o = hashes[order], owner[order]
    new = np.append(True, (h[1:] != h[:-1]) | (o[1:] != o[:-1]))
    at = np.flatnonzero(new)
    return h[at], o[at], np.diff(np.append(at, len(h)))


def _uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> U(11)).astype(np.float64) + 0.5) * 2.0 ** -53


def bag_signatures(h: np.ndarray, o: np.ndarray, w: np.ndarray, documents: int, m: int = BANDS * ROWS) -> np.ndarray:
    """(documents, m) signatures: for each component the hash of the first point on it; rows of documents without shingles are 0."""
    total = np.bincount(o, weights=w, minlength=documents)
    best = np.full((documents, m), np.inf)
    mark = np.zeros((documents, m), dtype=U)
    horizon = np.where(total > 0, (np.log(m) + 4.0) / np.maximum(total, 1), 0.0)
    todo = total > 0
    while todo.any():
        mine = todo[o]
        # the levels of each shingle: 0 covers (0,1], level j covers (2**(j-1), 2**j]
        eh, eo, ew = h[mine], o[mine], w[mine]
        levels = np.where(ew > 1, np.ceil(np.log2(np.maximum(ew, 1))).astype(np.int64), 0) + 1
        sh, so, sw = np.repeat(eh, levels), np.repeat(eo, levels), np.repeat(ew, levels)
        level = np.arange(len(sh)) - np.repeat(np.cumsum(levels) - levels, levels)
        low = np.where(level > 0, 1 << np.maximum(level - 1, 0), 0)
        span = np.where(level > 0, low, 1)
        state = mix(sh ^ mix(level.astype(U) + U(77)))
        x = np.zeros(len(sh))
        draw = 0
        while len(state):
            draw += 1
            state = mix(state + U(draw))
            x = x - np.log(_uniform(state)) / (span * float(m))
            live = x <= horizon[so]
            state, x, so, sw, low, span = state[live], x[live], so[live], sw[live], low[live], span[live]
            if not len(state):
                break
            # halve the level until the part of the point is wholly below or above the weight; parts above are no points of this document
            a, width, bits = low.copy(), span.copy(), mix(state ^ U(0xA5A5A5A5))
            while True:
                split = (a < sw) & (a + width > sw)
                if not split.any():
                    break
                width = np.where(split, width >> 1, width)
                a = np.where(split & ((bits & U(1)) == U(1)), a + width, a)
                bits = np.where(split, mix(bits), bits)
            below = a < sw
            doc, part = so[below], (mix(state[below] ^ U(0x5BD1E995)) % U(m)).astype(np.int64)
            point, name = x[below], mix(state[below] ^ U(0xC2B2AE35))
            cell = doc * m + part
            order = np.lexsort((point, cell))
            cell, point, name = cell[order], point[order], name[order]
            lead = np.append(True, cell[1:] != cell[:-1]) if len(cell) else np.zeros(0, dtype=bool)
            cell, point, name = cell[lead], point[lead], name[lead]
            better = point < best.ravel()[cell]
            best.ravel()[cell[better]], mark.ravel()[cell[better]] = point[better], name[better]
        todo &= np.isinf(best).any(axis=1)
        horizon = np.where(todo, horizon * 2, horizon)
    return mark


def band_hashes(mark: np.ndarray, bands: int = BANDS) -> np.ndarray:
    rows = mark.reshape(len(mark), bands, -1)
    out = np.broadcast_to(mix(np.arange(bands, dtype=U)), (len(mark), bands))
    for r in range(rows.shape[2]):
        out = mix(out ^ rows[:, :, r])
    return out


def _chunks(batches, most_bytes: int = 2 << 20):
    """Arrow batches cut so that each holds about `most_bytes` of text, or one text."""
    for batch in batches:
        sizes = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + most_bytes, side="right")))
            yield batch.slice(at, to - at)
            at = to


def _list_array(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), pa.array(values.view(np.int64), pa.int64()))


def with_bands(texts: DataFrame) -> DataFrame:
    """(doc_id, key, bands) of (doc_id, key, text): array of band hashes, empty for texts without words."""
    def run(batches):
        for part in _chunks(batches):
            h, o = shingles(part.column("text"))
            counts = np.bincount(o, minlength=part.num_rows)
            bands = band_hashes(bag_signatures(*bags(h, o), part.num_rows))[counts > 0]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("key"), _list_array(bands.ravel(), np.where(counts > 0, BANDS, 0))], names=["doc_id", "key", "bands"])
    return texts.select("doc_id", "key", "text").mapInArrow(run, "doc_id bigint, key string, bands array<bigint>")


def with_bags(texts: DataFrame) -> DataFrame:
    """(node, bag) of (node, text): the multiset of shingles as a set, each further occurrence of a shingle hashed with its number."""
    def run(batches):
        for part in _chunks(batches):
            h, o, w = bags(*shingles(part.column("text")))
            again = np.arange(w.sum()) - np.repeat(np.cumsum(w) - w, w) if len(w) else w
            values = np.repeat(h, w)
            values = np.where(again > 0, mix(values ^ mix(again.astype(U))), values) if len(w) else values
            yield pa.RecordBatch.from_arrays([part.column("node"), _list_array(values, np.bincount(np.repeat(o, w), minlength=part.num_rows))], names=["node", "bag"])
    return texts.select("node", "text").mapInArrow(run, "node bigint, bag array<bigint>")


def verified(pairs: DataFrame, bag: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) whose weighted Jaccard similarity is at least `similarity`: least weights over greatest weights, summed over shingles."""
    both = pairs.join(bag.select(F.col("node").alias("a"), F.col("bag").alias("bag_a")), "a").join(bag.select(F.col("node").alias("b"), F.col("bag").alias("bag_b")), "b")
    both = both.select("a", "b", F.size(F.array_intersect("bag_a", "bag_b")).alias("common"), F.size("bag_a").alias("na"), F.size("bag_b").alias("nb"))
    return both.filter((F.col("na") + F.col("nb") > 0) & (F.col("common") >= similarity * (F.col("na") + F.col("nb") - F.col("common")))).select("a", "b")


def block_links(rows: DataFrame, similarity: float, block: int) -> DataFrame:
    """(a, b) links inside buckets too large to emit their pairs; rows(bucket, n, node, component, bands, bag).

    The members of a bucket are dealt into blocks of about `block`; a task gets two of them and compares their members of different components, each pair only in the first
    bucket that it shares. What it has linked already it does not compare again, so it returns fewer links than members.
    """
    def run(key, pdf):
        bucket = key[0]
        bands = np.stack(pdf["bands"].to_numpy())
        mine, other = np.flatnonzero(pdf["own"].to_numpy() == key[1]), np.flatnonzero(pdf["own"].to_numpy() == key[2])
        same = bands[mine][:, None, :] == bands[other][None, :, :]
        ours = np.argmax(bands[mine] == bucket, axis=1)
        component, sizes = pdf["component"].to_numpy(), pdf["bag"].map(len).to_numpy()
        small, large = np.minimum(sizes[mine][:, None], sizes[other][None]), np.maximum(sizes[mine][:, None], sizes[other][None])
        wanted = (np.argmax(same, axis=2) == ours[:, None]) & (component[mine][:, None] != component[other][None]) & (small >= similarity * large)
        if key[1] == key[2]:
            wanted = np.triu(wanted, 1)
        parent, out, nodes, bag = {}, [], pdf["node"].to_numpy(), pdf["bag"].to_numpy()

        def top(x):
            while parent.get(x, x) != x:
                x = parent[x]
            return x
        for i, j in zip(*(x.tolist() for x in np.nonzero(wanted))):
            i, j = mine[i], other[j]
            a, b = top(component[i]), top(component[j])
            if a != b:
                common = len(np.intersect1d(bag[i], bag[j], assume_unique=True))
                if common >= similarity * (sizes[i] + sizes[j] - common):
                    parent[a] = b
                    out.append((nodes[i], nodes[j]))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    blocks = F.ceil(F.col("n") / block)
    dealt = rows.withColumn("own", F.pmod(F.xxhash64("node"), blocks)).withColumn("with", F.explode(F.sequence(F.lit(0).cast("bigint"), blocks - 1)))
    dealt = dealt.withColumn("lo", F.least("own", "with")).withColumn("hi", F.greatest("own", "with"))
    return dealt.select("bucket", "lo", "hi", "own", "node", "component", "bands", "bag").groupBy("bucket", "lo", "hi").applyInPandas(run, "a bigint, b bigint")


def link_classes(members: DataFrame, nodes: DataFrame, bag: DataFrame, similarity: float, most_emitted: int = 32, block: int = 256) -> DataFrame:
    """(node, component) of the graph of all verified pairs that share a bucket; members(bucket, node), nodes(node, bands), bag(node, bag).

    First every bucket compares its members with one leader, which joins dense groups at a linear cost. What is left are members of different components in one bucket.
    Buckets of up to `most_emitted` members emit those pairs, at most that many to a row; larger ones compare them block by block inside tasks. So every pair of one bucket
    is compared or already in one component, and no group emits all its pairs.
    """
    leaders = members.groupBy("bucket").agg(F.min("node").alias("leader"))
    stars = members.join(leaders, "bucket").filter("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
    first = cut_lineage(verified(stars, bag, similarity))
    labels = cut_lineage(connected_components(first, members.select("node").distinct()))
    now = members.join(labels, "node")
    open_buckets = cut_lineage(now.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("component").alias("c1"), F.max("component").alias("c2")).filter("c1 <> c2").select("bucket", "n"))
    rows = open_buckets.count()
    now = cut_lineage(now.join(F.broadcast(open_buckets) if is_broadcastable(rows, 24) else open_buckets, "bucket"))
    few = now.filter(F.col("n") <= most_emitted)
    pairs = few.select("bucket", F.col("node").alias("a"), F.col("component").alias("ca")).join(few.select("bucket", F.col("node").alias("b"), F.col("component").alias("cb")), "bucket")
    pairs = pairs.filter("a < b and ca <> cb").select("a", "b").distinct().join(stars, ["a", "b"], "left_anti")
    many = now.filter(F.col("n") > most_emitted).join(nodes.select("node", "bands"), "node").join(bag, "node")
    found = cut_lineage(verified(pairs, bag, similarity).unionByName(block_links(many, similarity, block)))
    return cut_lineage(connected_components(first.unionByName(found), labels.select("node")))


def near_classes(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, key, class_id, rep_key): the class of each distinct (doc_id, text); `key` is the MD5 of the text, `class_id` the least doc_id of the class and `rep_key` the text it belongs to.

    Equal texts are one class whatever they hold; texts with words are also linked where the weighted Jaccard similarity of their bags of five-word shingles is at least
    `similarity`. A pair at exactly 0.8 shares a band with probability 1 - (1 - 0.8**5)**28, that is 0.99999.
    """
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.md5(text_of()).alias("key"), text_of().alias("text"))
    signed = with_bands(texts).groupBy("key").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"))
    nodes = cut_lineage(signed.withColumn("node", F.monotonically_increasing_id()))
    banded = nodes.select("node", F.explode("bands").alias("bucket"))
    shared = cut_lineage(banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("bucket"))
    rows = shared.count()
    members = cut_lineage(banded.join(F.broadcast(shared) if is_broadcastable(rows, 16) else shared, "bucket", "left_semi").select("bucket", "node"))
    wanted = cut_lineage(members.select("node").distinct().join(nodes.select("node", "key", "rep"), "node"))
    rows = wanted.count()
    wanted_side = F.broadcast(wanted) if is_broadcastable(rows, 96) else wanted
    own = texts.join(wanted_side, (texts["key"] == wanted_side["key"]) & texts["doc_id"].eqNullSafe(wanted_side["rep"])).select("node", "text")
    bag = cut_lineage(with_bags(own).dropDuplicates(["node"]))
    labels = link_classes(members, nodes, bag, similarity)
    linked = nodes.select("node", "key", "rep").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    best = linked.groupBy("component").agg(F.min(F.struct("rep", "key")).alias("best"))
    classes = cut_lineage(linked.join(best, "component").select("key", F.col("best.rep").alias("class_id"), F.col("best.key").alias("rep_key")))
    return texts.select("doc_id", "key").join(classes, "key")


def keep_one(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row of each class: the one with the least doc_id (nulls first) and, of its texts, the least MD5; of repeated rows one. Columns as in `docs`."""
    classes = near_classes(docs, similarity).filter("key = rep_key and doc_id <=> class_id").groupBy("doc_id", "key").agg(F.count(F.lit(1)).alias("copies"))
    own = packed(docs).withColumn("id", F.col("doc_id").cast("bigint")).withColumn("key", F.md5("text"))
    kept = own.join(classes.withColumnRenamed("doc_id", "id2").withColumnRenamed("key", "key2"), (F.col("key") == F.col("key2")) & F.col("id").eqNullSafe(F.col("id2")))
    once, more = kept.filter("copies = 1"), kept.filter("copies > 1")
    more = more.groupBy("id", "key").agg(F.min("row").alias("row"))
    return unpacked(once.select("row").unionByName(more.select("row")), docs.columns)
