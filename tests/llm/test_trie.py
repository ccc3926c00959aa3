import hashlib
import random
import zlib

import pytest

from geoweave.llm import trie

SCHEMA = "conv_id bigint, turn int, role string, text string"


def brute_trie(rows):
    """Every prefix of every rebuilt conversation as a key of a dictionary."""
    turns = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            turns.setdefault(conv, []).append(((turn is not None, turn or 0, role, hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()), (role, text)))
    own = {c: [x for _, x in sorted(v)] for c, v in turns.items()}
    members, ends = {}, {}
    for c, v in own.items():
        h, base = zlib.crc32(str(c).encode()) % 6, c - (c % 100 if c >= 0 else -(-c % 100))
        whole = tuple(own.get(base, [])[:h] + v[h:])
        ends.setdefault(whole, []).append(c)
        for d in range(len(whole) + 1):
            members.setdefault(whole[:d], []).append(c)
    children, leaves, saved, out = {}, {}, {}, []
    for p in sorted(members, key=len, reverse=True):
        below = children.get(p, [])
        leaves[p] = sum(leaves[x] for x in below) or 1
        saved[p] = sum(saved[x] for x in below) + ((len(members[p]) - 1) * len(p[-1][1]) if p else 0)
        if p:
            children.setdefault(p[:-1], []).append(p)
        out.append((min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(below), leaves[p], saved[p],
                    hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest()))
    return sorted(out, key=str)


def messy_rows():
    r = random.Random(3)
    rows = [(c, None if r.random() < 0.05 else t, r.choice(["user", "assistant", None]), r.choice(["a", "bb", None, "", "cé😀"])) for c in range(250) for t in range(r.randrange(1, 9))]
    rows += [(c, t, "user", f"copied {t}") for c in range(1000, 1100) for t in range(7)]
    rows += [(4000, t, "user", "long" * 50 + str(t)) for t in range(300)] + [(4100, 0, "user", "x" * 300000)]
    return rows + [(None, 1, "user", "of no conversation"), (-5, 0, "user", "n"), (-100, 0, "user", "q"), (-7, 0, "user", "n"), (None, None, None, None)] + rows[:9]


@pytest.mark.parametrize("container_bytes", [1 << 16, 400])
def test_trie_matches_brute_force(spark, container_bytes):
    rows = messy_rows()
    got = trie.conversation_trie(spark.createDataFrame(rows, SCHEMA), container_bytes)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_trie(rows)


def test_trie_of_nothing_and_clashing_columns(spark):
    assert trie.conversation_trie(spark.createDataFrame([], SCHEMA)).count() == 0
    more = spark.createDataFrame([(1, 0, "user", "a", "x", 5, "y")], SCHEMA + ", path string, depth int, head string")
    assert [tuple(r) for r in trie.conversation_trie(more).collect()] == brute_trie([(1, 0, "user", "a")])


def test_member_digests_in_blocks(spark):
    rows = [(bytes([k]), c) for k in range(3) for c in range(-20, 1000 * k + 1)]
    got = trie.member_digests(spark.createDataFrame(rows, "key binary, conv_id bigint"), block=7).collect()
    want = {bytes([k]): hashlib.sha256(",".join(map(str, range(-20, 1000 * k + 1))).encode()).hexdigest() for k in range(3)}
    assert {bytes(r.key): r.sha for r in got} == want and {bytes(r.key): (r.n, r.least) for r in got} == {bytes([k]): (1000 * k + 21, -20) for k in range(3)}


def test_containers_burst_to_their_bound(spark):
    paths = trie.rebuilt_paths(trie.turn_paths(spark.createDataFrame(messy_rows(), SCHEMA)))
    keyed = paths.groupBy("path").agg({"sizes": "first", "conv_id": "min"}).toDF("path", "sizes", "least").selectExpr("*", "1L as n", "'' as sha")
    held = trie.burst(keyed, 512)[0].groupBy("head").agg({"path": "count", "depth": "max"}).toDF("head", "paths", "depth")
    # bytes below the head, a turn id of 16 bytes each: no container of several paths holds more than 512
    assert held.filter("paths > 32").count() == 0
