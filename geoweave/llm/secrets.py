"""Secret scan with multipart credential linking.

Strong patterns (assignments, access ids, long hex runs) are secrets by themselves. Weak candidates (user or client names, mixed random-looking strings, addresses of services) say
little alone; they are reported only where parts that complete each other stand within one scope: an identifier beside a secret, an endpoint beside a secret. Scopes are found by an
interval join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoweave.llm.common import joined_spans, spans_of, text_of
from geoweave.session import cut_lineage

#: Kinds in the order of reports, and the patterns of the strong ones.
BASE = ("assign", "access", "hex")
KINDS = (*BASE, "identity", "material", "endpoint")
ASSIGN = "(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"']?+\\x20*+[:=]\\x20*+[\"']?+([A-Za-z0-9+/_.=-]++)"
ACCESS = "AKIA[A-Z0-9]++"
HEX = "(?<![0-9a-f])[0-9a-f]{24,}+"
IDENTITY = "(?<![A-Za-z0-9_])(?:[uU][sS][eE][rR](?:[nN][aA][mM][eE])?+|[lL][oO][gG][iI][nN]|[cC][lL][iI][eE][nN][tT]_?+[iI][dD])[\"']?+\\x20*+[:=]\\x20*+[\"']?+[A-Za-z0-9@._-]{3,}+"
MATERIAL = "(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])(?=[a-z0-9+/_-]*+[A-Z])(?=[A-Z0-9+/_-]*+[a-z])[A-Za-z0-9+/_-]{20,}+"
ENDPOINT = "(?<![A-Za-z0-9+.-])[a-z][a-z0-9+.-]{1,15}+://[^\\s\"'<>]++"

SECRET, IDENTIFIER, PLACE = ("assign", "hex", "material"), ("access", "identity"), ("endpoint",)


def strong_spans(text: Column) -> Column:
    """Spans of the strong kinds. Leftmost non-overlapping per kind; a match whose value is too short is dropped and not tried again.

    Patterns never backtrack, and a run of hex digits is entered at its start only, so time is linear in the text.
    """
    value = lambda s: F.length(F.regexp_extract(s["value"], ASSIGN, 1))
    return F.concat(F.filter(spans_of(text, ASSIGN, "assign", text.contains("=") | text.contains(":")), lambda s: value(s) >= 6),
                    F.filter(spans_of(text, ACCESS, "access", text.contains("AKIA")), lambda s: s["end"] - s["start"] >= 20), spans_of(text, HEX, "hex"))


def weak_spans(text: Column) -> Column:
    return F.concat(spans_of(text, IDENTITY, "identity", text.contains("=") | text.contains(":")), spans_of(text, MATERIAL, "material"), spans_of(text, ENDPOINT, "endpoint", text.contains("://")))


def linked_parts(parts: DataFrame, scope: int = 200) -> DataFrame:
    """(key, start, end, kind, mates) of the parts (key, start, end, kind) that complete another one within `scope` code points; mates counts those.

    Interval join: every part looks from its END for mates that start up to `scope` code points behind it, in the block of its end and the next one, and stands in the block of its start.
    So a pair is met once, by its earlier part, however long the parts are, and a block of `scope` code points bounds what meets. Complementary are identifier and secret, endpoint and
    secret. A part does not complete one that it overlaps.
    """
    role = F.when(F.col("kind").isin(*SECRET), "secret").when(F.col("kind").isin(*PLACE), "endpoint").otherwise("identifier")
    own = parts.withColumn("role", role)
    block = F.floor(F.col("end") / scope)
    ahead = own.withColumn("block", F.explode(F.array(block, block + 1)))
    behind = own.select("key", F.floor(F.col("start") / scope).alias("block"), F.col("start").alias("s2"), F.col("end").alias("e2"), F.col("kind").alias("k2"), F.col("role").alias("role2"))
    met = ahead.join(behind, ["key", "block"]).filter(((F.col("role") == "secret") != (F.col("role2") == "secret")) & (F.col("s2") - F.col("end")).between(0, scope))
    sides = F.array(F.struct("start", "end", "kind"), F.struct(F.col("s2").alias("start"), F.col("e2").alias("end"), F.col("k2").alias("kind")))
    met = met.select("key", F.explode(sides).alias("p")).select("key", "p.*")
    return met.groupBy("key", "start", "end", "kind").agg(F.count(F.lit(1)).alias("mates"))


def scan_secrets(docs: DataFrame, scope: int = 200) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base, spans, n_linked): one row per row of `docs`.

    `base` holds the strong spans, `spans` these and the linked weak ones, by start. Null and empty texts have none; repeated rows are alike; overlapping kinds are all reported.
    A weak span that a strong one covers is not reported twice. Texts are scanned once; only spans are joined, and only of texts that hold an identifier or endpoint and a secret.
    """
    key = F.struct(F.xxhash64(text_of()).alias("h"), F.length(text_of()).alias("n"))
    found = docs.select(F.col("doc_id").alias("doc_id"), key.alias("key"), text_of().alias("text")).select("doc_id", "key", strong_spans(F.col("text")).alias("base"), weak_spans(F.col("text")).alias("weak"))
    bare = lambda a: F.transform(a, lambda s: F.struct(s["start"], s["end"], s["kind"]))
    free = F.filter("weak", lambda w: ~F.exists("base", lambda b: (b["start"] <= w["start"]) & (b["end"] >= w["end"])))
    found = cut_lineage(found.select("doc_id", "key", bare(F.col("base")).alias("base"), bare(free).alias("weak")))
    some = found.filter("size(weak) > 0").select("key", F.concat("base", "weak").alias("parts")).dropDuplicates(["key"])
    linked = linked_parts(some.select("key", F.explode("parts").alias("p")).select("key", "p.*"), scope).filter(~F.col("kind").isin(*BASE))
    linked = linked.groupBy("key").agg(F.collect_list(F.struct("start", "end", "kind")).alias("linked"))
    out = found.join(linked, "key", "left").withColumn("linked", F.coalesce("linked", F.array().cast("array<struct<start:bigint,end:bigint,kind:string>>")))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return out.select("doc_id", *[count(k) for k in BASE], F.col("base"), F.concat("base", "linked").alias("spans"), F.size("linked").cast("bigint").alias("n_linked"))


def report(found: DataFrame) -> DataFrame:
    """Digest of `scan_secrets`."""
    return found.select("doc_id", *[f"n_{k}" for k in BASE], F.sha2(joined_spans(F.col("base"), list(KINDS)), 256).alias("base_sha256"), joined_spans(F.col("spans"), list(KINDS)).alias("spans"), "n_linked")
