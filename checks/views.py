"""Surrogate views over the given tables, in both dialects.

The tables have no coordinates, so positions and codes are derived from their keys by integer arithmetic. Each view is one
text; only a few words differ between Spark and DuckDB.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

T0 = 1704067200
DAYS = 30
T1 = T0 + DAYS * 86400 - 1

_VIEWS: dict[str, str] = {
    "obs": """select event_id, user_id, event_type, value, @T@ as t,
        24e0 + ((event_id * 7919) % 400) / 1e2 as lat, 54e0 + ((event_id * 104729) % 397) / 1e2 as lon from events""",
    "v_news": """select concat('gdelt:', event_id) as id, t, lat, lon,
        concat('Place ', cast(floor(lat) as bigint), ' ', cast(floor(lon) as bigint)) as place,
        cast(1 + event_id % 5 as int) as geo_type, lpad(cast(1 + event_id % 20 as varchar(9)), 2, '0') as root_code,
        cast(event_id % 21 - 10 as double) as goldstein, cast(event_id % 31 - 15 as double) as tone,
        cast(event_id % 60 as int) as num_mentions,
        concat('https://www.s', cast(floor(event_id / 20) as bigint) % 20, '.example.com/a/', cast(floor(event_id / 20) as bigint),
               '?utm_source=x&id=', cast(floor(event_id / 20) as bigint)) as url,
        concat('s', cast(floor(event_id / 20) as bigint) % 20, '.example.com') as source_domain,
        (event_id % 20 + 1) in (14, 15, 17, 18, 19, 20) as is_conflict, false as is_social,
        case event_id % 6 when 0 then 'U.S.' when 1 then 'Kyiv' when 2 then 'Government' when 3 then 'Tehran' when 4 then 'NAVY' else null end as actor1,
        case event_id % 4 when 0 then 'Moscow' when 1 then 'Oman Ports' else null end as actor2,
        @ARRAY@(concat('Jane Smith ', event_id % 45), concat('Omar Haddad ', event_id % 89)) as persons,
        @ARRAY@(concat('Gulf Lines ', event_id % 83), 'Reuters') as orgs,
        case event_id % 8 when 0 then @ARRAY@('MARITIME', concat('VESSEL ', event_id % 50)) when 1 then @ARRAY@('AIRSTRIKE') else @ARRAY@('ECON') end as themes
        from obs where event_type in ('click', 'error')""",
    "v_points": """select concat('h', user_id) as hex, t, lat, lon,
        case when event_id % 7 = 0 then null else cast((event_id * 37) % 40000 as int) end as alt_ft,
        user_id % 5 = 0 as military, case when event_id % 97 = 0 then '7700' else null end as squawk, cast(null as varchar(9)) as emergency,
        case when event_id % 4 = 0 then null else cast(event_id % 11 as int) end as nic,
        case when event_id % 6 = 0 then null else cast(event_id % 12 as int) end as nac_p,
        case when event_id % 3 = 0 then concat('FL', user_id) else null end as flight from obs where event_type = 'view'""",
    "v_vessels": """select concat('ais:', 200000000 + user_id) as id, 200000000 + user_id as mmsi, t, lat, lon,
        concat('VESSEL ', user_id) as name, value as sog from obs where event_type = 'purchase'""",
    "v_firms": """select concat('firms:', event_id) as id, t, lat, lon, value as frp, t < 1705363200 as is_baseline,
        (event_id % 11) / 1e1 as novelty from obs where event_type = 'signup'""",
    "v_regions": """select n_nationkey as id, n_name as name, 24.5e0 + n_nationkey % 4 as lat, 54.5e0 + (n_nationkey * 3) % 4 as lon,
        1e1 + 5 * (n_nationkey % 4) as radius_nm from nation""",
    "v_posts": """select concat(case doc_id % 4 when 0 then 'tg:' when 1 then 'reddit:' when 2 then 'bsky:' else 'mastodon:' end, source, '/', doc_id) as id,
        cast(1704067200 + (doc_id * 997) % 2592000 as double) as t, 24e0 + ((doc_id * 7919) % 400) / 1e2 as lat,
        54e0 + ((doc_id * 104729) % 397) / 1e2 as lon, source as channel, lang, text, (doc_id * 37) % 9000 as views,
        case doc_id % 4 when 0 then concat('https://t.me/', source, '/', doc_id) when 1 then concat('https://www.reddit.com/r/', source, '/', doc_id)
             when 2 then concat('https://bsky.app/profile/', source, '/post/', doc_id) else concat('https://mastodon.example.org/@', source, '/', doc_id) end as url,
        case doc_id % 4 when 0 then 'telegram' when 1 then 'reddit' when 2 then 'bluesky' else 'mastodon' end as platform,
        doc_id from documents""",
    "v_verdicts": """select o_orderkey as id, concat('gdelt:', o_custkey) as left_id, concat('adsb:', (o_custkey * 7 + o_orderkey) % 1500) as right_id,
        'gdelt' as left_kind, 'adsb' as right_kind,
        case o_orderstatus when 'F' then 'SUPPORTED' when 'O' then 'PLAUSIBLE' else 'INSUFFICIENT_EVIDENCE' end as verdict,
        (o_orderkey % 100) / 1e2 as evidence_strength, concat('article:', o_custkey % 400) as left_group,
        concat('record:adsb:', (o_custkey * 7 + o_orderkey) % 1500) as right_group, o_orderkey * 1e0 as created_at,
        o_orderkey % 9 = 0 as same_article from orders""",
}
_NEEDS = {"v_news": ("obs",), "v_points": ("obs",), "v_vessels": ("obs",), "v_firms": ("obs",)}
_DUCK = {"@T@": "epoch(ts)", "@ARRAY@": "list_value"}
_SPARK = {"@T@": "timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts) / 1e6", "@ARRAY@": "array"}


def _dialect(text: str, words: dict[str, str]) -> str:
    for key, value in words.items():
        text = text.replace(key, value)
    return text


def oracle(views: str, body: str) -> str:
    """DuckDB text: the named views as CTEs, then the body (which may continue with its own CTEs)."""
    wanted: list[str] = []
    for name in views.split():
        for need in (*_NEEDS.get(name, ()), name):
            if need not in wanted:
                wanted.append(need)
    ctes = ",\n".join(f"{name} as ({_dialect(_VIEWS[name], _DUCK)})" for name in wanted)
    body = body.strip()
    if not ctes:
        return body
    if body[:5].lower() == "with ":
        return f"with recursive {ctes},\n{body[5:]}"
    return f"with recursive {ctes}\n{body}"


_SHARED: dict[tuple, object] = {}


class Tables:
    """The given tables and the surrogate views as DataFrames."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def shared(self, name: str, build):
        """A derived table that many queries read: built once per session and folder, then reused."""
        key = (self.spark.sparkContext.applicationId, self.folder, name)
        if key not in _SHARED:
            _SHARED[key] = build()
        return _SHARED[key]

    @staticmethod
    def forget() -> None:
        _SHARED.clear()

    def _view(self, name: str, source: DataFrame, source_name: str) -> DataFrame:
        text = _dialect(_VIEWS[name], _SPARK).replace(f"from {source_name}", "from {src}")
        return self.spark.sql(text, src=source)

    @cached_property
    def obs(self) -> DataFrame:
        return self._view("obs", self.raw("events"), "events")

    def _of_obs(self, name: str) -> DataFrame:
        return self._view(name, self.obs, "obs")

    @cached_property
    def news(self) -> DataFrame:
        return self._of_obs("v_news")

    @cached_property
    def points(self) -> DataFrame:
        return self._of_obs("v_points")

    @cached_property
    def vessels(self) -> DataFrame:
        return self._of_obs("v_vessels")

    @cached_property
    def firms(self) -> DataFrame:
        return self._of_obs("v_firms")

    @cached_property
    def regions(self) -> DataFrame:
        return self._view("v_regions", self.raw("nation"), "nation")

    @cached_property
    def posts(self) -> DataFrame:
        return self._view("v_posts", self.raw("documents"), "documents")

    @cached_property
    def verdicts(self) -> DataFrame:
        return self._view("v_verdicts", self.raw("orders"), "orders")
