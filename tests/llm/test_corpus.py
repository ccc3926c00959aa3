"""Operators over the whole corpus: line chunks, packing, winnowing, near-duplicates, shards."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from geoweave.llm import neardup, packing, shards, winnow
from tests.llm.conftest import MESSY, WORDS, documents, prose


def brute_best_fit(pieces, capacity):
    bins, out = [], []
    for length, s, c in pieces:
        fits = [(capacity - b["n"], i) for i, b in enumerate(bins) if capacity - b["n"] >= length and b["n"] < capacity and not (s >= 0 and s in b["s"]) and not (c >= 0 and c in b["c"])]
        i = min(fits)[1] if fits else len(bins)
        if not fits:
            bins.append({"n": 0, "s": set(), "c": set()})
        bins[i]["n"] += length
        bins[i]["s"].add(s)
        bins[i]["c"].add(c)
        out.append(i)
    return out


def test_best_fit_matches_brute_force():
    r = random.Random(1)
    for _ in range(60):
        pieces = sorted(((r.randrange(0, 40), r.randrange(-1, 6), r.randrange(-1, 10)) for _ in range(r.randrange(0, 60))), reverse=True)
        assert packing.best_fit(pieces, 40) == brute_best_fit(pieces, 40)
    with pytest.raises(ValueError):
        packing.best_fit([(41, -1, -1)], 40)


def test_packing_keeps_everything(spark, messy, nothing):
    r = random.Random(2)
    rows = MESSY + [(100 + i, prose(i, r.randrange(1, 60)), r.choice("abcdefgh") if i % 3 else "hot") for i in range(200)]
    items = packing.packing_items(documents(spark, rows))
    got = packing.pack(items, capacity=256, group_rows=50).collect()
    want = Counter((x.doc_id, x.length) for x in items.collect())
    tokens = Counter()
    for g in got:
        tokens[g.doc_id] += g.length
    expected = Counter()
    for (i, n), copies in want.items():
        expected[i] += n * copies
    assert {k: v for k, v in tokens.items() if v} == {k: v for k, v in expected.items() if v} and {g.doc_id for g in got} == {i for i, _ in want}
    bins = {}
    for g in got:
        bins.setdefault(g.bin_id, []).append(g)
    for b in bins.values():
        assert sum(g.length for g in b) <= 256 and sorted(g.slot for g in b) == list(range(len(b)))
        for field in ("source", "cluster"):
            named = [getattr(g, field) for g in b if getattr(g, field) is not None]
            assert len(named) == len(set(named))
    assert packing.pack_documents(nothing).count() == 0 and packing.pack_documents(messy).count() >= len(MESSY)


def fold(text):
    return [w for w in re.split("[\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or "")) if w]


def brute_hits(rows, items):
    out = []
    for i, t, _ in rows:
        w, hit, ids = fold(t), set(), set()
        for item, text in items:
            v = fold(text)
            n = min(len(v), 10)
            wanted = {tuple(v[k:k + n]) for k in range(len(v) - n + 1)} if n else set()
            for p in range(len(w) - n + 1) if n else []:
                if tuple(w[p:p + n]) in wanted:
                    hit.update(range(p, p + n))
                    ids.add(str(item))
        out.append((i, len(w), len(hit), sorted(ids)))
    return out


def test_winnowing_matches_brute_force(spark, messy, nothing):
    r = random.Random(6)
    say = lambda n: [r.choice(WORDS) for _ in range(n)]
    texts = [say(n) for n in (30, 25, 10, 11, 9, 7, 4, 2, 40)]
    items = [(i, " ".join(t)) for i, t in enumerate(texts)] + [(90, None), (91, "?!"), (2, " ".join(texts[2])), (92, "zz " * 14)]
    rows = list(MESSY)
    for i in range(60):
        own = say(r.randrange(0, 40))
        for _ in range(r.randrange(0, 3)):
            t = r.choice(texts)
            a = r.randrange(len(t))
            part = t[a:a + r.choice((1, 5, 9, 10, 11, 30))]
            at = r.randrange(len(own) + 1)
            own[at:at] = part
        rows.append((500 + i, ", ".join(w.upper() if r.random() < 0.3 else w for w in own), "a"))
    rows.append((700, "zz " * 50, "a"))
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = winnow.decontaminate(documents(spark, rows), bench)
    order = lambda x: (x[0] is None, x[0] or 0, x[1:])
    assert sorted(((x.doc_id, x.n_words, x.n_hit, x.items) for x in got.collect()), key=order) == sorted(brute_hits(rows, items), key=order)
    assert winnow.decontaminate(nothing, bench).count() == 0 and not winnow.decontaminate(messy, bench.limit(0)).filter("contaminated").count()
    clean = winnow.keep_uncontaminated(messy, bench)
    assert clean.columns == messy.columns and {x.n_words for x in clean.collect()} == {"x"}


def bag(text):
    w = fold(text)
    return Counter(tuple(w[i:i + 5]) for i in range(max(len(w) - 4, 1))) if w else Counter()


def similarity(a, b):
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def test_bag_signatures_are_unbiased():
    r = random.Random(7)
    one = [r.choice(WORDS) for _ in range(60)]
    texts = [" ".join(one * 1), " ".join(one * 2), " ".join(one * 5), " ".join(one[:40] * 3 + one[40:]), " ".join(one[::-1] + one), "a b", "a b c d e f g h i", ""]
    h, o = neardup.shingles(pa.array(texts))
    assert np.bincount(o, minlength=len(texts)).tolist() == [sum(bag(t).values()) for t in texts]
    marks = neardup.bag_signatures(*neardup.bags(h, o), len(texts), 8000)
    for i in range(6):
        for j in range(i):
            assert abs((marks[i] == marks[j]).mean() - similarity(bag(texts[i]), bag(texts[j]))) < 0.025
    assert (marks[7] == 0).all() and not (marks[:7] == 0).any()
    sliced = neardup.shingles(pa.array(["zz zz", *texts]).slice(1))
    assert (sliced[0] == h).all() and (sliced[1] == o).all()


def near_rows():
    r, rows = random.Random(9), list(MESSY)
    for g in range(4):
        base = [r.choice(WORDS) + str(r.randrange(40)) for _ in range(120)]
        for k in range(25):
            own = list(base)
            for _ in range(r.randrange(0, 6)):
                own[r.randrange(len(own))] = "edit" + str(r.randrange(1000))
            rows.append((1000 + 100 * g + k, " ".join(own), "a"))
    rows += [(2000 + k, " ".join(["spam ham eggs toast jam"] * (20 + k)), "b") for k in range(8)]
    return rows


def brute_classes(rows):
    distinct = sorted({(i, t or "") for i, t, _ in rows}, key=lambda x: (x[0] is None, x))
    bags, parent = [bag(t) for _, t in distinct], list(range(len(distinct)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i in range(len(distinct)):
        for j in range(i):
            if distinct[i][1] == distinct[j][1] or similarity(bags[i], bags[j]) >= 0.8:
                parent[top(i)] = top(j)
    return distinct, [top(i) for i in range(len(distinct))]


def test_near_classes_match_brute_force(spark, nothing):
    rows = near_rows()
    distinct, label = brute_classes(rows)
    import hashlib
    want = {}
    for (i, t), c in zip(distinct, label):
        want.setdefault(c, set()).add((i, hashlib.md5(t.encode()).hexdigest()))
    found = {}
    for x in neardup.near_classes(documents(spark, rows)).collect():
        found.setdefault((x.class_id, x.rep_key), set()).add((x.doc_id, x.key))
    assert sorted(map(sorted, ([(-1 if i is None else i, k) for i, k in s] for s in found.values()))) == sorted(map(sorted, ([(-1 if i is None else i, k) for i, k in s] for s in want.values())))
    assert neardup.near_classes(nothing).count() == 0


def test_one_of_each_class_stays(spark):
    rows = near_rows()
    df = documents(spark, rows, clashes=True)
    kept = neardup.keep_one(df)
    assert kept.columns == df.columns
    got = kept.collect()
    distinct, label = brute_classes(rows)
    where = {d: c for d, c in zip(distinct, label)}
    assert Counter(where[(x.doc_id, x.text or "")] for x in got) == Counter(set(label)) and {x.bands for x in got} == {"x"}


def test_leaders_find_links_that_bypass_the_first_one(spark):
    # one bucket; 0 is similar to 1 only, 2 to 3, 1 to 2: a chain, and 9 to none
    bags = {0: range(0, 10), 1: range(1, 11), 2: range(2, 12), 3: range(3, 13), 9: range(50, 60)}
    bag_table = spark.createDataFrame([(n, list(v)) for n, v in bags.items()], "node bigint, bag array<bigint>")
    members = spark.createDataFrame([(7, n) for n in bags], "bucket bigint, node bigint")
    nodes = spark.createDataFrame([(n, [100 + n, 7]) for n in bags], "node bigint, bands array<bigint>")
    for emitted, block in ((32, 256), (1, 256), (1, 2), (1, 1)):
        got = {r.node: r.component for r in neardup.link_classes(members, nodes, bag_table, 0.8, emitted, block).collect()}
        assert got == {0: 0, 1: 0, 2: 0, 3: 0, 9: 9}


def test_hilbert_neighbours_touch():
    for n, bits in ((2, 3), (3, 2), (3, 4)):
        cells = [tuple(c >> bits * i & (1 << bits) - 1 for i in range(n)) for c in range(1 << bits * n)]
        line = sorted(cells, key=lambda c: shards.hilbert_place(c, bits))
        assert sorted(shards.hilbert_place(c, bits) for c in cells) == list(range(len(cells)))
        assert all(sum(abs(a - b) for a, b in zip(x, y)) == 1 for x, y in zip(line, line[1:]))


def test_shards_follow_the_law(spark, messy, nothing):
    rows = MESSY + [(200 + i, "é" * (i % 50), f"s{i % 7}") for i in range(300)] + [(77, "same", "hot")] * 150
    got = shards.shard_documents(documents(spark, rows)).collect()
    assert sorted((x.doc_id or -1, x.size, x.crc) for x in got) == sorted((i or -1, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    per = Counter(x.shard for x in got)
    assert set(per) == set(range(24)) and max(per.values()) - min(per.values()) <= 1
    for s in per:
        assert sorted(x.slot for x in got if x.shard == s) == list(range(per[s]))
    runs = sorted((x.shard, x.slot, x.h) for x in got)
    assert [h for _, _, h in runs] == sorted(h for _, _, h in runs)
    assert shards.shard_documents(nothing).count() == 0


def test_written_shards_prune(spark, tmp_path):
    rows = [(i, "x" * (1 + i % 97), f"https:/site{i % 16:02d}") for i in range(2000)]
    shards.write_shards(documents(spark, rows), str(tmp_path / "out"), 16)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r.doc_id, r.text) for r in back.collect()) == sorted((i, t) for i, t, _ in rows)
    boxes = back.groupBy("shard").agg(F.min("source"), F.max("source"), F.min(F.length("text")), F.max(F.length("text"))).collect()
    assert len(boxes) == 16 and sum(b[1] <= "https:/site03" <= b[2] and b[3] <= 40 <= b[4] for b in boxes) <= 5
