"""Scalar rules on small rows."""

import math

from pyspark.sql import functions as F

from geoweave.functions import geo, news, social, urls
from geoweave.functions.aircraft import is_degraded
from geoweave.functions.text import normalize_text


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_article_keys(spark):
    def keys(url):
        r = one(spark, strict=urls.article_url_key(F.lit(url)), loose=urls.article_group_key(F.lit(url)))
        return r.strict, r.loose
    assert keys("HTTPS://Example.test/story/?utm_source=x&b=2&a=1#top")[0] == "https://example.test/story?a=1&b=2"
    assert keys("https://example.test/")[0] is None and keys("https://example.test/news?id=7")[0] == "https://example.test/news?id=7"
    assert keys("https://user@example.test/a")[0] is None and keys("https://example.test:99999/a")[0] is None and keys("ftp://example.test/a")[0] is None
    assert keys("http://example.test:8080/a")[0] == "http://example.test:8080/a"
    assert keys("https://www.example.test/a/?ref=x&id=3")[1] == "https://example.test/a?id=3"


def test_degraded_is_three_valued(spark):
    cases = [(8, 9, False), (5, 9, True), (8, 4, True), (None, None, None), (None, 3, True)]
    rows = spark.createDataFrame([(a, b) for a, b, _ in cases], "nic int, nac_p int")
    assert [r[0] for r in rows.select(is_degraded(F.col("nic"), F.col("nac_p"))).collect()] == [c[2] for c in cases]


def test_social_text_rules(spark):
    r = one(spark, a=social.geolocate(F.lit("Position 26.5661, 56.2501 reported")), b=social.geolocate(F.lit("Strait of Hormuz closed")), c=social.geolocate(F.lit("nothing here")),
            d=social.extract_keywords(F.lit("Drone attack on tanker")), e=social.views_count(F.lit("1.2K")), f=social.views_count(F.lit("x")), g=social.geolocate(F.lit("99.1234, 56.1234 near dubai")))
    assert (r.a.lat, r.a.lon, r.a.place) == (26.5661, 56.2501, "26.566,56.250")
    assert r.b.place == "Strait Of Hormuz" and r.c is None and r.d == ["tanker", "drone", "attack"]
    assert r.e == 1200 and r.f is None and r.g.place == "Dubai"


def test_actors_and_floor(spark):
    r = one(spark, a=news.resolve_actor(F.lit("U.S.")), b=news.resolve_actor(F.lit(" the ")), c=news.resolve_actor(F.lit("Kyiv")), d=geo.cell_index(F.lit(-0.5)), e=normalize_text(F.lit("ＡＢＣ—Straße")))
    assert (r.a, r.b, r.c, r.d, r.e) == ("UNITED STATES", None, "UKRAINE", -1, "abc strasse")


def test_every_perimeter_point_lies_in_a_box(spark):
    centres = [(26.0, 56.0), (10.0, 179.8), (-10.0, -179.8), (89.0, 0.0), (-89.0, 30.0)]
    rows = spark.createDataFrame([(i, *c, 250.0) for i, c in enumerate(centres)], "id int, lat double, lon double, radius_nm double")
    boxes = {r.id: r.b for r in rows.select("id", geo.circle_boxes(F.col("lat"), F.col("lon"), F.col("radius_nm")).alias("b")).collect()}
    angle = 250 * 1.852 / 6371.0088
    for i, (lat, lon) in enumerate(centres):
        for k in range(72):
            t, p = 2 * math.pi * k / 72, math.radians(lat)
            la = math.asin(math.sin(p) * math.cos(angle) + math.cos(p) * math.sin(angle) * math.cos(t))
            lo = math.degrees(math.radians(lon) + math.atan2(math.sin(t) * math.sin(angle) * math.cos(p), math.cos(angle) - math.sin(p) * math.sin(la)))
            la, lo = math.degrees(la), (lo + 180) % 360 - 180
            assert any(b.south - 1e-6 <= la <= b.north + 1e-6 and b.west - 1e-6 <= lo <= b.east + 1e-6 for b in boxes[i]), (lat, lon, k)
