"""Linking of parts longer than the scope, against brute force."""

import random

from geoweave.llm import secrets


def test_long_parts_meet(spark):
    r = random.Random(5)
    rows = [(1, 0, 500, "endpoint"), (1, 600, 640, "material"), (2, 0, 30, "material"), (2, 231, 900, "endpoint"), (3, 0, 900, "material"), (3, 1100, 1200, "identity"), (3, 1301, 1330, "hex")]
    for key in range(10, 40):
        at = 0
        for _ in range(r.randrange(2, 12)):
            start = max(0, at + r.randrange(-30, 330))
            at = start + r.choice((5, 40, 199, 200, 201, 450, 1500))
            rows.append((key, start, at, r.choice(("assign", "hex", "material", "access", "identity", "endpoint"))))
    rows = list(dict.fromkeys(rows))
    secret = lambda x: x[3] in secrets.SECRET
    want = {}
    for a in rows:
        mates = sum(a[0] == b[0] and secret(a) != secret(b) and 0 <= max(b[1] - a[2], a[1] - b[2]) <= 200 for b in rows)
        if mates:
            want[a] = mates
    parts = spark.createDataFrame(rows, "key bigint, start bigint, end bigint, kind string")
    assert {tuple(x)[:4]: x.mates for x in secrets.linked_parts(parts, 200).collect()} == want and (1, 0, 500, "endpoint") in want


def test_long_endpoint_is_reported(spark):
    text = "see https://host.example/" + "a" * 480 + " " + "x " * 40 + "password = hunter2hunter2 end"
    docs = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    assert secrets.scan_secrets(docs).first().n_linked == 1
