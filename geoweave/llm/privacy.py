"""Personal data and information-theoretic sanitisation.

E-mail addresses, IP addresses, card and phone numbers are protected entities. A term discloses an entity to the degree that it tells which entity is meant: by the
pointwise mutual information of the two over the texts of the corpus, against the information content of the entity (as in C-sanitisation, Sanchez and Batet 2016). Terms of a text
that disclose one of its entities beyond a threshold are generalised or removed with it, wherever they stand in the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoweave.llm.common import document_key, filtered, is_broadcastable, joined_spans, packed, spans_of, text_of, unpacked
from geoweave.session import cut_lineage

#: Kinds in the order of reports, and their patterns. Possessive loops and a start only at the head of a run (or where the last match ended) keep them linear.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "general", "removed")
EMAIL = "(?:\\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)++"
IP = "(?:\\G|(?<![0-9]))[0-9]++(?:\\.[0-9]++){3}"
CARD = "[0-9](?:[\\x20-]?[0-9])++"
PHONE = "\\+[0-9][\\x20().0-9-]+[0-9]"
TERM = "[\\p{L}\\p{N}]++"


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]+", "")


def passes_luhn(number: Column) -> Column:
    """The check digit of a string of digits."""
    places = F.transform(F.split(F.reverse(number), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise((d.cast("int") * 2) % 10 + F.floor(d.cast("int") / 5).cast("int")))
    return F.aggregate(F.filter(places, lambda d: d.isNotNull()), F.lit(0), lambda a, d: a + d) % 10 == 0


def base_spans(text: Column) -> Column:
    """Spans of the four kinds. Leftmost non-overlapping per kind; matches that fail their test are dropped and not tried again."""
    parts = lambda v: F.transform(F.split(v, "\\."), lambda p: F.regexp_replace(p, "^0+(?=.)", ""))
    n = lambda s: F.length(digits(s["value"]))
    cards = F.filter(spans_of(text, CARD, "card", text.rlike("(?:[0-9][\\x20-]?){11}[0-9]")), lambda s: F.when(n(s).between(12, 19), passes_luhn(digits(s["value"]))).otherwise(False))
    return F.concat(spans_of(text, EMAIL, "email", text.contains("@")),
                    F.filter(spans_of(text, IP, "ip"), lambda s: F.forall(parts(s["value"]), lambda p: (F.length(p) <= 3) & (p.cast("int") <= 255))),
                    cards, F.filter(spans_of(text, PHONE, "phone", text.contains("+")), lambda s: n(s).between(9, 15)))


def _entity() -> Column:
    """What a base span `s` names: addresses folded, numbers as digits."""
    name = F.when(F.col("s.kind") == "email", F.lower("s.value")).when(F.col("s.kind") == "ip", F.col("s.value")).otherwise(digits(F.col("s.value")))
    return F.xxhash64(F.col("s.kind"), name)


def term_hash(word: Column) -> Column:
    return F.xxhash64(F.lower(word))


def disclosing_places(found: DataFrame, told: DataFrame) -> DataFrame:
    """(key, terms): every place of a term that discloses an entity of the same text, as array<struct<start, end, kind>>; found(key, text, base), told(entity, term, kind).

    A text is searched once, for the words of its own that are told of; words are letters and digits only, so they are a pattern as they stand.
    """
    here = found.select("key", F.explode("base").alias("s")).select("key", _entity().alias("entity")).distinct()
    wanted = here.join(told, "entity").groupBy("key", "term").agg(F.max("kind").alias("kind")).groupBy("key").agg(F.collect_list(F.struct("term", "kind")).alias("wanted"))
    held = found.join(cut_lineage(wanted), "key").withColumn("hashes", F.col("wanted.term"))
    words = F.filter(F.array_distinct(F.regexp_extract_all("text", F.lit(TERM), F.lit(0))), lambda w: F.array_contains("hashes", term_hash(w)))
    held = filtered(held.withColumn("words", words), F.size("words") > 0, [F.col(c) for c in ("key", "text", "wanted", "hashes", "words")])
    held = held.withColumn("pattern", F.concat(F.lit("(?<![\\p{L}\\p{N}])(?:"), F.array_join("words", "|"), F.lit(")(?![\\p{L}\\p{N}])")))
    kind = lambda s: F.get("wanted", (F.array_position("hashes", term_hash(s["value"])) - 1).cast("int"))["kind"]
    terms = F.transform(spans_of(F.col("text"), F.col("pattern"), "term", F.lit(True)), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), kind(s).alias("kind")))
    return held.select("key", terms.alias("terms"))


def text_terms(texts: DataFrame) -> DataFrame:
    """(h, term) of (h, text): the distinct terms of each text, as hashes of their lower-case forms."""
    words = F.array_distinct(F.transform(F.array_distinct(F.regexp_extract_all("text", F.lit(TERM), F.lit(0))), term_hash))
    return texts.select("h", F.explode_outer(words).alias("term")).filter("term is not null")


def disclosures(found: DataFrame, texts: DataFrame, generalise: float, remove: float, discount: float) -> DataFrame:
    """(entity, term, kind): terms whose mutual information with an entity is at least `generalise` times the entity's information content; from `remove` times on they go.

    found(h, text, base) are the texts that hold entities, texts(h, text) all texts, each once. With n_ct texts that hold both, n_c the entity, n_t the term, of N:
    PMI = log((n_ct - discount) N / (n_c n_t)), IC = log(N / n_c). So PMI / IC nears 1 where the term stands with the entity only. The discount is a bound on what little evidence says: by it a
    term seen with an entity in one text reaches `generalise`, but not `remove`. A term in many other texts cannot reach the threshold; it is left out before pairs are made, by a bound
    that follows from n_ct <= n_c, so a long text pairs its entities with its rare terms only.
    """
    here = cut_lineage(found.select("h", F.explode("base").alias("s")).select("h", _entity().alias("entity")).distinct())
    counts = text_terms(texts).groupBy("term").agg(F.count(F.lit(1)).alias("n_t"))
    total = float(texts.count())
    per_entity = here.groupBy("entity").agg(F.count(F.lit(1)).alias("n_c"))
    owners = cut_lineage(here.join(per_entity, "entity"))
    rarest = (F.col("n_c") - discount) * F.pow(F.lit(max(total, 1.0)) / F.col("n_c"), F.lit(1.0 - generalise))
    reach = owners.groupBy("h").agg(F.max(rarest).alias("most"))
    mine = cut_lineage(text_terms(found).join(reach, "h"))
    wanted = mine.select("term").distinct()
    rare = mine.join(counts.join(wanted, "term", "left_semi"), "term").filter(F.col("n_t") <= F.col("most") * (1 + 1e-9)).select("h", "term", "n_t")
    joint = owners.join(rare, "h").filter(F.col("n_t") <= rarest * (1 + 1e-9)).groupBy("entity", "term").agg(F.count(F.lit(1)).alias("n_ct"), F.first("n_c").alias("n_c"), F.first("n_t").alias("n_t"))
    content = F.log(F.lit(total) / F.col("n_c"))
    told = content + F.log((F.col("n_ct") - discount) / F.col("n_t"))
    kept = joint.filter((content > 0) & (F.col("n_ct") > discount) & (told >= generalise * content))
    return kept.select("entity", "term", F.when(told >= remove * content, "removed").otherwise("general").alias("kind"))


def sanitise(docs: DataFrame, generalise: float = 0.9, remove: float = 0.97, discount: float = 0.5) -> DataFrame:
    """The rows of `docs` with `base` and `spans` (arrays of start, end, kind, value) and the `sanitised` text.

    In it base spans read [EMAIL], [IP], [CARD], [PHONE], terms to generalise [NAME] or [WORD], and terms to remove nothing. Of overlapping spans the earliest, then the longest counts. A
    term is a run of letters and digits. Copies of a text are one text for the counts. Null and empty texts have no spans, texts without an entity none either; repeated rows are alike.
    """
    texts = packed(docs).withColumn("key", document_key())
    found = cut_lineage(filtered(texts.withColumn("base", base_spans(F.col("text"))), F.size("base") > 0, [F.col("key"), F.xxhash64("text").alias("h"), F.col("text"), F.col("base")]))
    once = texts.select(F.xxhash64("text").alias("h"), "text").groupBy("h").agg(F.first("text").alias("text"))
    told = cut_lineage(disclosures(found.dropDuplicates(["h"]), once, generalise, remove, discount))
    terms = disclosing_places(found.dropDuplicates(["key"]), told)
    none = "array<struct<start:bigint,end:bigint,kind:string,value:string>>"
    spans = found.dropDuplicates(["key"]).join(terms, "key", "left").withColumn("more", F.transform(F.coalesce("terms", F.array().cast("array<struct<start:bigint,end:bigint,kind:string>>")), lambda t: F.struct(
        t["start"].alias("start"), t["end"].alias("end"), t["kind"].alias("kind"), F.substring("text", t["start"].cast("int") + 1, (t["end"] - t["start"]).cast("int")).alias("value"))))
    free = F.filter("more", lambda t: ~F.exists("base", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))
    spans = cut_lineage(spans.select("key", "base", F.concat("base", free).alias("spans")))
    rows = spans.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("spans")), F.lit(0))).first()
    out = texts.join(F.broadcast(spans) if is_broadcastable(rows[0] * 64 + rows[1] * 160, 1) else spans, "key", "left")
    out = out.withColumn("base", F.coalesce("base", F.array().cast(none))).withColumn("spans", F.coalesce("spans", F.array().cast(none)))
    return unpacked(out.withColumn("clean", rewritten(F.col("text"), F.col("spans"))), docs.columns, base=F.col("base"), spans=F.col("spans"), sanitised=F.col("clean"))


def rewritten(text: Column, spans: Column) -> Column:
    """`text` with its spans replaced."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["end"].alias("end"), s["kind"].alias("kind"), s["value"].alias("value"))))

    def put(s):
        return (F.when(s["kind"] == "removed", "").when(s["kind"] == "general", F.when(s["value"].rlike("^\\p{Lu}"), "[NAME]").otherwise("[WORD]")).otherwise(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))))

    def step(acc, s):
        more = F.struct(s["end"].alias("at"), F.array_append(acc["out"], F.concat(F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), put(s))).alias("out"))
        return F.when(s["start"] < acc["at"], acc).otherwise(more)
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("out"))
    whole = F.aggregate(ordered, start, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, (acc["at"] + 1).cast("int"), F.length(text))))
    return F.when(F.size(spans) > 0, whole).otherwise(text)


def report(found: DataFrame) -> DataFrame:
    """Digest of `sanitise`."""
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in BASE], F.sha2(joined_spans(F.col("base"), list(KINDS)), 256).alias("base_sha256"), joined_spans(F.col("spans"), list(KINDS)).alias("spans"),
                        F.size(F.filter("spans", lambda s: s["kind"].isin("general", "removed"))).cast("bigint").alias("n_terms"))
