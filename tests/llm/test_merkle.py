import hashlib
import random

import pytest

from geoweave.llm import merkle
from tests.llm.conftest import CLASHES

SCHEMA = "doc_id bigint, source string, lang string, n_chars bigint, text string"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(nodes):
    """(root, siblings of each node with their place) of a list of digests, level by level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i:i + 3] for i in range(0, len(nodes), 3)]
        for k, i in enumerate(at):
            paths[k].append((runs[i // 3][:i % 3], runs[i // 3][i % 3 + 1:]))
        nodes, at = [sha(*r) for r in runs], [i // 3 for i in at]
    return nodes[0], paths


def brute_manifest(rows, presented=lambda row: row):
    groups = {}
    for row in rows:
        groups.setdefault(row[1], []).append(row)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for s in order:
        groups[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    trees = {s: tree([leaf(r) for r in groups[s]]) for s in order}
    root, over = tree([trees[s][0] for s in order])
    out = []
    for s, above in zip(order, over):
        for row, path in zip(groups[s], trees[s][1]):
            folded = leaf(presented(row))
            for left, right in path + above:
                folded = sha(*left, folded, *right)
            out.append((row[0], leaf(row), trees[s][0], root, sha(*(d for left, right in path + above for d in left + right)), folded, folded == root))
    return sorted(out, key=str)


def some_rows(counts):
    r = random.Random(5)
    rows = [(r.choice([i, None]) if i % 50 == 0 else i, s, r.choice(["en", None]), i, r.choice([None, "", f"línea\n{i}", "a\nb\n" * 3])) for s, n in counts for i in range(n)]
    return rows + rows[:7]


@pytest.mark.parametrize("counts", [[("a", 1)], [("a", 1), ("b", 2), (None, 4), ("", 3)], [("hot", 2300), ("z", 730), ("ä", 729), (None, 5)], [(f"s{i}", 1 + i % 3) for i in range(800)]])
def test_manifest_matches_brute_force(spark, counts):
    rows = some_rows(counts)
    spoil = lambda r: r if r[4] is None or (r[0] or 0) % 2 else (*r[:4], r[4].replace("\n", ""))
    docs = spark.createDataFrame(rows, SCHEMA)
    from pyspark.sql import functions as F
    changed = F.when(F.coalesce("doc_id", F.lit(0)) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    got = merkle.manifest(docs, merkle.leaf_digest(docs, text=changed)).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_manifest(rows, spoil)


def test_blocks_of_blocks(spark):
    """Four passes up and down, with blocks of nine."""
    rows = some_rows([("hot", 800), ("b", 10)] + [(f"s{i}", 1) for i in range(95)])
    got = merkle.manifest(spark.createDataFrame(rows, SCHEMA), with_proofs=True, levels=2).collect()
    assert sorted((tuple(r)[:7] for r in got), key=str) == brute_manifest(rows)
    assert all(merkle.fold(r.leaf, r.proof) == r.root and merkle.joined(r.proof) == r.proof_sha256 for r in got)


def test_empty_clashing_and_missing_columns(spark):
    assert merkle.manifest(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(1, "a", None, 3, "x" * 3_000_000), (2, "a", None, 3, "y")]
    more = spark.createDataFrame([(*r, *["x"] * 9) for r in rows], SCHEMA + ", " + CLASHES).withColumnRenamed("bands", "tree").withColumnRenamed("spans", "digest").withColumnRenamed("h", "index")
    assert sorted((tuple(r) for r in merkle.manifest(more.drop("lang")).collect()), key=str) == brute_manifest(rows)
