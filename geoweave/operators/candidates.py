"""Candidate pairs of evidence records: retrieval, tiers, deduplication and batch selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoweave.fixed_values import CENTROID_TYPES, KIND_TOPIC, NEWS_KINDS, PAIR_FAMILIES, TIER_BASE, TIERS
from geoweave.functions.geo import cell_index, haversine_km, round_to
from geoweave.functions.hashing import pair_key
from geoweave.functions.news import lookup
from geoweave.functions.text import RECORD_FIELDS, complete_record, record_features
from geoweave.functions.urls import source_key
from geoweave.operators.filters import retrieval_worthy
from geoweave.operators.joins import balanced_join, in_order, phrase_hits, radius_join
from geoweave.session import cut_lineage, shuffled


def records_from_sources(events: DataFrame | None = None, tracks: DataFrame | None = None, hotspots: DataFrame | None = None,
                         vessels: DataFrame | None = None) -> DataFrame:
    """All sources as one table of evidence records."""
    parts = []

    def add(df: DataFrame, kind: Column, label: Column, timestamp_kind: Column, source: Column, record_id: Column = F.col("id")) -> None:
        base = df.withColumns({"id": record_id, "kind": kind, "label": label, "timestamp_kind": timestamp_kind, "source": source})
        names = ["id", "kind", "label", "t", "timestamp_kind", "lat", "lon", "source"]
        base = complete_record(base)
        parts.append(base.select(*names, *[F.col(n).cast(k).alias(n) for n, k in RECORD_FIELDS.items()]))

    def optional(df: DataFrame, name: str, kind: str = "string") -> Column:
        return F.col(name) if name in df.columns else F.lit(None).cast(kind)

    if events is not None:
        kind = F.coalesce(optional(events, "platform"), F.lit("gdelt"))
        root = F.coalesce(optional(events, "root_label"), optional(events, "root_code"), F.lit(""))
        add(events, kind, F.concat(root, F.lit(": "), F.coalesce("place", F.lit(""))),
            F.when(kind == "gdelt", "gdelt_date_added_not_incident_time").otherwise(F.concat(kind, F.lit("_post_time"))), optional(events, "source_domain"))
    if tracks is not None:
        names = F.coalesce(optional(tracks, "callsign"), optional(tracks, "registration"), F.col("hex"))
        add(tracks, F.lit("adsb"), names, F.lit("aircraft_observation_time"), optional(tracks, "source"), F.concat(F.lit("adsb:"), "hex"))
    if hotspots is not None:
        label = F.concat(F.lit("FIRMS thermal anomaly "), F.coalesce(optional(hotspots, "satellite"), F.lit("")))
        add(hotspots, F.lit("firms"), label, F.lit("satellite_acquisition_time"), F.lit("NASA FIRMS"))
    if vessels is not None:
        label = F.coalesce(F.nullif(F.col("name"), F.lit("")), F.concat(F.lit("Vessel "), F.col("mmsi").cast("string")))
        add(vessels, F.lit("ais"), label, F.lit("vessel_position_report_time"), F.lit("aisstream.io"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


#: Rules between two reports.
_NEWS_RULES = [i for i, family in enumerate(PAIR_FAMILIES) if family[0] == family[1] == "news"]


def _with_rules(side: DataFrame, which: int) -> DataFrame:
    """A record once per rule family in which its kind takes this side."""
    group = F.when(F.col("kind").isin(*NEWS_KINDS), F.lit("news")).otherwise(F.col("kind"))
    rules = F.array(*[F.struct(F.lit(i).alias("rule"), F.lit(family[which]).alias("group"), F.lit(family[2]).alias("radius"),
                               F.lit(family[3]).alias("span_min")) for i, family in enumerate(PAIR_FAMILIES)])
    mine = F.filter(rules, lambda r: r["group"] == group)
    return side.withColumn("_rule", F.explode(mine)).select("*", "_rule.rule", "_rule.radius", "_rule.span_min").drop("_rule")


def retrieval_table(records: DataFrame) -> DataFrame:
    """What pairing needs of each record: position, word sets, source key and the known phrases its text mentions.

    Texts stop here. Every phrase any record carries (asset identities, named entities, actors) is looked up in every text
    once, so the pairs only ever compare short arrays.
    """
    full = record_features(records).withColumn("rid", F.concat("kind", F.lit(":"), "id", F.lit("@"), F.col("t").cast("string")))
    full = cut_lineage(full.select("rid", "id", "kind", "t", "lat", "lon", "label", "url", "geo_type", "entities", "actors", "topics", "identities",
                                   "text_norm", "tokens", retrieval_worthy().alias("worthy")))
    news = full.filter(F.col("kind").isin(*NEWS_KINDS))
    phrases = (full.select(F.explode(F.transform("identities", lambda i: i["phrase"])).alias("phrase"))
               .unionByName(news.select(F.explode("entities").alias("phrase"))).unionByName(news.select(F.explode("actors").alias("phrase"))))
    hits = phrase_hits(news.select("rid", "text_norm", "tokens"), phrases)
    mentions = hits.groupBy("rid").agg(F.collect_set("phrase").alias("mentions"))
    none = F.array().cast("array<string>")
    out = full.drop("text_norm", "tokens").withColumn("source_key", source_key(F.col("kind"), F.col("id"), F.col("url"))).drop("url")
    whole = cut_lineage(out.join(shuffled(mentions), "rid", "left").withColumn("mentions", F.coalesce("mentions", none)))
    # numbers in the order of the names they stand for: a pair is two numbers
    sources = in_order(whole.select("source_key").distinct(), "s", "source_key")
    return cut_lineage(in_order(whole, "n", "rid").join(shuffled(sources), "source_key"))


def identity_hits() -> Column:
    """Identities of the right record that the left report mentions."""
    return F.filter("r_identities", lambda i: F.array_contains("l_mentions", i["phrase"])
                    & (~i["maritime_context"] | F.array_contains("l_topics", F.lit("maritime"))))


def match_pairs(pairs: DataFrame, most_overlap: int | None = None, most_named: int | None = None) -> DataFrame:
    """Adds match_type, overlap and why: identifier, name, entity, topic or proximity.

    `most_overlap` and `most_named` shorten the shared names and their mention in `why` for display.
    """
    def first(names: Column, most: int | None) -> Column:
        return names if most is None else F.slice(names, 1, most)

    none = F.array().cast("array<string>")
    both_news = F.col("l_kind").isin(*NEWS_KINDS) & F.col("r_kind").isin(*NEWS_KINDS)
    report = F.col("l_kind").isin(*NEWS_KINDS)

    def shared(field: str) -> Column:
        left, right = F.col(f"l_{field}"), F.col(f"r_{field}")
        return F.array_sort(F.array_union(F.array_intersect(left, right), F.array_union(
            F.array_intersect(left, F.col("r_mentions")), F.array_intersect(right, F.col("l_mentions")))))

    topic_of = lookup(KIND_TOPIC, F.col("r_kind"))
    p = pairs.withColumn("_ids", F.when(report & ~both_news, identity_hits()))
    p = p.withColumns({
        "_entities": F.when(both_news, shared("entities")).otherwise(none),
        "_actors": F.when(both_news, shared("actors")).otherwise(none),
        "_topics": F.when(both_news, F.array_sort(F.array_intersect("l_topics", "r_topics")))
        .when(report & F.array_contains("l_topics", topic_of), F.array(topic_of)).otherwise(none)})
    labels = F.array_sort(F.array_distinct(F.transform("_ids", lambda i: i["label"])))
    has_ids = F.coalesce(F.size("_ids") > 0, F.lit(False))
    strong = F.exists("_ids", lambda i: i["kind"] == "identifier")
    by_actor = both_news & (F.size("_topics") > 0) & (F.size("_actors") > 0)
    by_topic = ~both_news & (F.size("_topics") > 0)
    kind = (F.when(has_ids & strong, "identifier").when(has_ids, "name").when(F.size("_entities") > 0, "entity")
            .when(by_actor | by_topic, "topic").otherwise("proximity"))
    overlap = (F.when(has_ids, labels).when(F.size("_entities") > 0, first(F.col("_entities"), most_overlap)).when(by_actor, first(F.col("_actors"), most_overlap)).otherwise(none))
    relevant = F.concat(F.lit("relevant reporting: "), F.array_join("_topics", ", "))
    why = (F.when(has_ids, F.transform(labels, lambda v: F.concat(F.lit("reported "), v)))
           .when(F.size("_entities") > 0, F.array(F.concat(F.lit("shared named entities: "), F.array_join(first(F.col("_entities"), most_named), ", "))))
           .when(by_actor, F.array(relevant, F.concat(F.lit("shared report actors: "), F.array_join(first(F.col("_actors"), most_named), ", "))))
           .when(by_topic, F.array(relevant)).otherwise(F.array(F.lit("proximity only; no shared identity or relevant reporting"))))
    return p.withColumns({"match_type": kind, "overlap": overlap, "why": why}).drop("_ids", "_entities", "_actors", "_topics")


#: What the block joins move, and what pairs of two kinds of report are given afterwards.
_PLACE = ["n", "s", "source_key", "id", "kind", "t", "lat", "lon"]
_WORDS = ["entities", "actors", "topics", "identities", "mentions"]
_NONE = "cast(array() as array<string>)"


def _named_identity(side: str) -> Column:
    """Phrases that name an asset as one list of keys: those that count in maritime reports alone are marked."""
    return F.transform(f"{side}_identities", lambda i: F.concat(F.when(i["maritime_context"], "~").otherwise(""), i["phrase"]))


def candidate_pairs(table: DataFrame, **join_options) -> DataFrame:
    """All admissible pairs with tier and score, from space-time blocks and from phrases anchored in reports.

    Pairs that match by identity come only from the phrase side, which is not limited by distance; the block side drops
    them, so the two sides are disjoint and need no distinct. What decides a pair is known before the block join (the topic of a rule, the mention that is the key), so pairs carry places and
    numbers and no words are joined to them. Two reports of one kind must share a mention, which is an equality key there, so a busy block compares only reports about the same name.
    """
    def half(df: DataFrame, side: str, more: tuple[str, ...] = ()) -> DataFrame:
        return df.select(*[c for c in ("rule", "radius", "span_min") if c in df.columns], *[F.col(c).alias(f"{side}_{c}") for c in (*_PLACE, *more)])

    def with_words(pairs: DataFrame) -> DataFrame:
        for side in ("l", "r"):
            pairs = pairs.join(shuffled(table.select(*[F.col(c).alias(f"{side}_{c}") for c in ("n", *_WORDS)])), f"{side}_n")
        return pairs

    def near(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
        return radius_join(left, right, F.col("radius"), F.col("span_min"), on=on, right_id="r_n", left_id="l_n", **join_options)

    none = F.expr(_NONE)
    report = F.col("kind").isin(*NEWS_KINDS)
    worthy = table.filter("worthy")
    reports, assets = worthy.filter(report), worthy.filter(~report)
    known = table.filter(~report).select(F.explode(F.transform("identities", lambda i: i["phrase"])).alias("phrase")).distinct()
    told = reports.select("n", F.explode("mentions").alias("phrase")).join(known, "phrase", "left_semi").groupBy("n").agg(F.collect_set("phrase").alias("told"))
    reports = reports.join(shuffled(told), "n", "left").withColumn("told", F.coalesce("told", none))

    # a report and an asset: the rule fixes the topic, and a bare neighbour of a country's or state's centre is dropped before it meets anything
    topic = F.element_at(F.array(*[F.lit(KIND_TOPIC.get(f[1])) for f in PAIR_FAMILIES]), F.col("rule") + 1)
    marked = F.concat("told", F.when(F.array_contains("topics", F.lit("maritime")), F.transform("told", lambda p: F.concat(F.lit("~"), p))).otherwise(none))
    centroid = F.coalesce((F.col("kind") == "gdelt") & F.col("geo_type").isin(*CENTROID_TYPES), F.lit(False))
    left = _with_rules(reports.select(*_PLACE, "geo_type", "topics", marked.alias("told")), 0).filter(~F.col("rule").isin(*_NEWS_RULES))
    left = left.withColumn("on_topic", F.coalesce(F.array_contains("topics", topic), F.lit(False))).filter(F.col("on_topic") | ~centroid)
    right = _with_rules(assets.select(*_PLACE, "identities"), 1)
    mixed = near(half(left, "l", ("told", "on_topic")), half(right, "r", ("identities",)).withColumn("r_named", _named_identity("r")).drop("r_identities"), ["rule"])
    mixed = mixed.filter((F.col("l_id") != F.col("r_id")) & ~F.coalesce(F.arrays_overlap("l_told", "r_named"), F.lit(False)))
    bare = F.array(F.lit("proximity only; no shared identity or relevant reporting"))
    mixed = mixed.withColumns({"match_type": F.when(F.col("l_on_topic"), "topic").otherwise("proximity"), "overlap": none,
                               "why": F.when(F.col("l_on_topic"), F.array(F.concat(F.lit("relevant reporting: "), topic))).otherwise(bare)})
    # two assets can only be near each other
    solid = near(half(_with_rules(assets.select(*_PLACE), 0), "l"), half(right, "r"), ["rule"]).filter((F.col("l_id") != F.col("r_id")) & (F.col("l_kind") != F.col("r_kind")))
    solid = solid.withColumns({"match_type": F.lit("proximity"), "overlap": none, "why": bare})

    # two reports of one kind: texts include a record's own names, so whatever they share is among the mentions of both; a mention that is a name of neither shows nothing, and actors count
    # with a common topic only
    about = _with_rules(reports.select(*_PLACE, "topics", "entities", "actors", F.explode("mentions").alias("mention")), 0).filter(F.col("rule").isin(*_NEWS_RULES))
    about = about.withColumns({"ent": F.coalesce(F.array_contains("entities", F.col("mention")), F.lit(False)), "act": F.coalesce(F.array_contains("actors", F.col("mention")), F.lit(False))})
    sides = [half(about, s, ("topics", "ent", "act", "mention")).withColumnRenamed(f"{s}_mention", "mention").withColumn("same", F.col(f"{s}_kind")) for s in ("l", "r")]
    alike = near(*sides, ["rule", "mention", "same"])
    on_entity, on_actor = F.col("l_ent") | F.col("r_ent"), (F.col("l_act") | F.col("r_act")) & F.coalesce(F.arrays_overlap("l_topics", "r_topics"), F.lit(False))
    alike = alike.filter((F.col("l_id") < F.col("r_id")) & (F.col("l_s") != F.col("r_s")) & (on_entity | on_actor))
    # the two numbers are the key; what else a pair has is the same in all its rows, and columns that nobody reads are not shuffled
    same = ["rule", "km", "minutes", *[f"{side}_{c}" for side in ("l", "r") for c in (*_PLACE, "topics") if c != "n"]]
    alike = alike.groupBy("l_n", "r_n").agg(*[F.any_value(c).alias(c) for c in same], F.max(on_entity).alias("_entity"), F.array_sort(F.collect_set(F.when(on_entity, F.col("mention")))).alias("_entities"),
                                     F.array_sort(F.collect_set(F.when(on_actor, F.col("mention")))).alias("_actors"))
    listed = lambda title, names: F.concat(F.lit(title), F.array_join(names, ", "))
    alike = alike.withColumns({
        "match_type": F.when(F.col("_entity"), "entity").otherwise("topic"), "overlap": F.when(F.col("_entity"), F.col("_entities")).otherwise(F.col("_actors")),
        "why": F.when(F.col("_entity"), F.array(listed("shared named entities: ", F.col("_entities")))).otherwise(
            F.array(listed("relevant reporting: ", F.array_sort(F.array_intersect("l_topics", "r_topics"))), listed("shared report actors: ", F.col("_actors"))))})

    # two reports of different kinds may also be bare neighbours; they meet kind by kind
    news = _with_rules(reports.select(*_PLACE, "geo_type"), 0).filter(F.col("rule").isin(*_NEWS_RULES))
    later = F.explode(F.filter(F.array(*[F.lit(k) for k in NEWS_KINDS]), lambda k: k > F.col("l_kind")))
    across = near(half(news, "l", ("geo_type",)).withColumn("other", later), half(news, "r", ("geo_type",)).withColumn("other", F.col("r_kind")), ["rule", "other"])
    across = match_pairs(with_words(across.filter((F.col("l_id") != F.col("r_id")) & (F.col("l_s") != F.col("r_s")))))
    central = ((F.col("l_kind") == "gdelt") & F.col("l_geo_type").isin(*CENTROID_TYPES)) | ((F.col("r_kind") == "gdelt") & F.col("r_geo_type").isin(*CENTROID_TYPES))
    across = across.filter((F.col("match_type") != "proximity") | ~F.coalesce(central, F.lit(False)))

    span = 240.0 * 60.0
    assets = _with_rules(table.filter(F.col("kind").isin("ais", "adsb")).select(*_PLACE, F.transform("identities", lambda i: i["phrase"]).alias("phrases")), 1).filter(F.col("span_min") == 240.0)
    named = half(assets, "r", ("phrases",)).withColumn("phrase", F.explode("r_phrases")).drop("r_phrases").withColumn("_slot", F.floor(F.col("r_t") / span))
    told = table.filter(F.col("kind").isin(*NEWS_KINDS)).select(*[F.col(c).alias(f"l_{c}") for c in _PLACE], F.explode("mentions").alias("phrase"))
    # only phrases that name an asset: a hot entity that is nobody's identity never reaches the join
    told = told.join(named.select("phrase").distinct(), "phrase", "left_semi")
    slot = F.floor(F.col("l_t") / span)
    told = told.withColumn("_slot", F.explode(F.sequence(slot - 1, slot + 1)))
    tied = balanced_join(told, named, ["phrase", "_slot"], F.abs(F.col("r_t") - F.col("l_t")) <= span, probe_id=F.xxhash64("l_n"), build_id=F.xxhash64("r_n"), **join_options)
    tied = tied.drop("phrase", "_slot").dropDuplicates(["l_n", "r_n"])
    tied = tied.withColumn("km", haversine_km(F.col("l_lat"), F.col("l_lon"), F.col("r_lat"), F.col("r_lon"))).withColumn(
        "minutes", F.abs(F.col("r_t") - F.col("l_t")) / 60.0)
    tied = match_pairs(with_words(tied)).filter(F.col("match_type").isin("identifier", "name"))
    radius = F.when(F.col("rule").isNotNull(), F.element_at(F.array(*[F.lit(f[2]) for f in PAIR_FAMILIES]), F.col("rule") + 1))
    minutes = F.element_at(F.array(*[F.lit(f[3]) for f in PAIR_FAMILIES]), F.col("rule") + 1)
    rid = lambda s: F.concat(f"{s}_kind", F.lit(":"), f"{s}_id", F.lit("@"), F.col(f"{s}_t").cast("string"))
    shared = ["rule", *[f"{s}_{c}" for s in ("l", "r") for c in _PLACE], "km", "minutes", "match_type", "overlap", "why"]
    both = tied.select(*shared)
    for part in (mixed, solid, alike, across):
        both = both.unionByName(part.select(*shared))
    both = both.withColumns({"l_rid": rid("l"), "r_rid": rid("r")})
    spatial = F.greatest(F.lit(0.0), F.lit(1.0) - F.col("km") / radius)
    temporal = F.greatest(F.lit(0.0), F.lit(1.0) - F.col("minutes") / minutes)
    base = F.element_at(F.create_map(*[F.lit(x) for kv in TIER_BASE.items() for x in kv]), F.col("match_type"))
    score = F.when(base > 0, base + 0.03 * spatial + 0.03 * temporal).otherwise(0.22 * spatial + 0.17 * temporal)
    return both.withColumns({
        "score": round_to(score, 3), "coverage_key": pair_key(F.col("l_source_key"), F.col("r_source_key")),
        "kind_pair": pair_key(F.col("l_kind"), F.col("r_kind"))})


def best_per_coverage(pairs: DataFrame, table: DataFrame) -> DataFrame:
    """One pair per unordered source pair: the best score, ties to the smaller record keys.

    Sources and records go by their numbers, and the rank of a pair is one number, so that the aggregate is one of fixed-width values (`overlap` and `why` are lists: only who selects them pays
    for sorting). Names and places come from the table of records, for the winners alone.
    """
    return _with_records(_ranked(pairs, table), table)


def _ranked(pairs: DataFrame, table: DataFrame) -> DataFrame:
    count = table.count()
    milli = F.round(F.col("score") * 1000).cast("bigint" if 2000 * count * count < 2 ** 63 else "decimal(38,0)")
    rank = (milli * F.lit(count) + (F.lit(count - 1) - F.col("l_n"))) * F.lit(count) + (F.lit(count - 1) - F.col("r_n"))
    tier = F.array_position(F.array(*[F.lit(t) for t in TIERS]), F.col("match_type")).cast("int")
    pairs = pairs.withColumns({"_rank": rank, "tier": tier, "n_overlap": F.size("overlap")})
    payload = ["l_n", "r_n", "rule", "score", "km", "minutes", "tier", "n_overlap", "overlap", "why"]
    best = pairs.groupBy(F.least("l_s", "r_s").alias("_s1"), F.greatest("l_s", "r_s").alias("_s2")).agg(*[F.max_by(c, "_rank").alias(c) for c in payload])
    return best.withColumn("match_type", F.element_at(F.array(*[F.lit(t) for t in TIERS]), F.col("tier"))).drop("_s1", "_s2", "tier")


def _with_records(best: DataFrame, table: DataFrame) -> DataFrame:
    for s in ("l", "r"):
        best = best.join(shuffled(table.select(*[F.col(c).alias(f"{s}_{c}") for c in (*_PLACE, "rid")])), f"{s}_n")
    return best.withColumns({"coverage_key": pair_key(F.col("l_source_key"), F.col("r_source_key")), "kind_pair": pair_key(F.col("l_kind"), F.col("r_kind"))})


def generate_candidates(records: DataFrame, limit: int | None = None, **join_options) -> DataFrame:
    """The best pair of each coverage key, or the `limit` best of them (a review list holds 250)."""
    table = retrieval_table(records)
    return best_candidates(candidate_pairs(table, **join_options), table, limit)


def best_candidates(pairs: DataFrame, table: DataFrame, limit: int | None = None) -> DataFrame:
    if limit is None:
        return best_per_coverage(pairs, table)
    # names break ties of the score only, so what scores below the last place is left before names are joined
    best = _ranked(pairs, table)
    narrow = cut_lineage(best.select("l_n", "r_n", "score"))
    last = narrow.orderBy(F.col("score").desc()).limit(limit).agg(F.min("score")).first()[0]
    few = cut_lineage(_with_records(narrow.filter(F.col("score") >= F.lit(last)), table).orderBy(F.col("score").desc(), "coverage_key").limit(limit).select("l_n", "r_n"))
    return _with_records(best.join(F.broadcast(few), ["l_n", "r_n"]), table).orderBy(F.col("score").desc(), "coverage_key").limit(limit)


def with_hot_flag(candidates: DataFrame, incident_cells: DataFrame) -> DataFrame:
    """Adds `hot`: either side lies in a cell of a current incident."""
    hot = incident_cells.select("row", "col").distinct().withColumn("_hot", F.lit(True))
    out = candidates
    for side in ("l", "r"):
        named = hot.select(F.col("row").alias(f"_{side}row"), F.col("col").alias(f"_{side}col"), F.col("_hot").alias(f"_{side}hot"))
        out = out.withColumns({f"_{side}row": cell_index(F.col(f"{side}_lat")), f"_{side}col": cell_index(F.col(f"{side}_lon"))}).join(
            named, [f"_{side}row", f"_{side}col"], "left").drop(f"_{side}row", f"_{side}col")
    return out.withColumn("hot", F.coalesce("_lhot", F.lit(False)) | F.coalesce("_rhot", F.lit(False))).drop("_lhot", "_rhot")


def select_batch(candidates: DataFrame, limit: int = 12, proximity_limit: int = 2) -> DataFrame:
    """Next pairs for review: best tiers first, kind pairs taken in turn inside a tier, few bare proximity pairs.

    Needs `hot`. One pair per source pair, from its best tier. Turn `k` of a tier holds the k-th best of every kind pair. Only `limit`
    rows per (tier, kind pair) can be chosen, so the ranking is a top-k per group.
    """
    tier = F.element_at(F.create_map(*[F.lit(x) for i, t in enumerate(TIERS) for x in (t, i)]), F.col("match_type"))
    c = candidates.withColumn("_tier", tier)
    payload = [x for x in c.columns if x != "coverage_key"]
    rank = F.struct("_tier", (~F.col("hot")).alias("cold"), (-F.col("score")).alias("s"), "l_rid", "r_rid")
    c = c.groupBy("coverage_key").agg(F.min_by(F.struct(*payload), rank).alias("_p")).select("coverage_key", *[F.col(f"_p.{x}").alias(x) for x in payload])
    order = [F.col("hot").desc(), F.col("score").desc(), F.col("coverage_key")]
    turn = F.row_number().over(Window.partitionBy("_tier", "kind_pair").orderBy(*order))
    c = c.withColumn("turn", turn).filter(F.col("turn") <= limit)
    # at most limit x tiers x kind pairs rows are left: few enough for one ordered pass
    spot = F.row_number().over(Window.partitionBy("_tier").orderBy("turn", *order))
    c = c.withColumn("_spot", spot).filter((F.col("match_type") != "proximity") | (F.col("_spot") <= proximity_limit))
    return c.orderBy("_tier", "_spot").limit(limit).drop("_spot", "_tier")


def adjudication_order(candidates: DataFrame, limit: int = 12) -> DataFrame:
    """Replay order: incident cells first, then most overlap, then news pairs, then score."""
    both_news = (F.col("l_kind") == "gdelt") & (F.col("r_kind") == "gdelt")
    return candidates.orderBy(F.col("hot").desc(), F.col("n_overlap").desc(), both_news.desc(), F.col("score").desc(), "coverage_key").limit(limit)
