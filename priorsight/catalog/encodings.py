"""Encodings, details of the latest logins, and rare categories."""

from __future__ import annotations

from pyspark.sql import functions as F

from priorsight.catalog import query
from priorsight.catalog.binding import LOGS, logins, rounded, trades
from priorsight.functions.scalars import composite_key
from priorsight.operators import encoding, links
from priorsight.operators.history import link_last_events, with_last_event

START_US = 1_704_067_200_000_000  # 2024-01-01
END_US = 1_706_745_600_000_000  # 2024-02-01

# The nine encoded keys, four single ones and five combinations.
_SINGLE = ("id", "ip", "device", "city")
_COMBINED = {
    "ip_device": ("ip", "device"),
    "ip_id": ("ip", "id"),
    "device_id": ("id", "device"),
    "city_id": ("city", "id"),
    "device_id_city": ("id", "device", "city"),
}

def _encoding_sql(noise: str = "") -> str:
    keys = {c: f"cast({c} as varchar)" for c in _SINGLE}
    for name, parts in _COMBINED.items():
        keys[name] = " || '|' || ".join(f"coalesce(cast({p} as varchar), 'nan')" for p in parts)
    base = (
        f"with {LOGS}, p as (select t.rowkey, l.ip, l.device, l.city, row_number() over (partition by t.rowkey order by l.us desc, l.log_id desc) as n "
        "from t join l on l.id = t.id and l.us < t.us), "
        "q as (select t.rowkey, t.us, t.id, t.is_risk, p.ip, p.device, p.city from t left join p on p.rowkey = t.rowkey and p.n = 1), "
        "k as (select rowkey, us, is_risk, " + ", ".join(f"{e} as k_{n}" for n, e in keys.items()) + " from q) select a.rowkey, "
    )
    return base + ", ".join(
        f"round(coalesce((select avg(b.is_risk) from k b where b.k_{n} = a.k_{n} and b.us < a.us), 0){noise}, 6) as {n}_t_encoding"
        for n in keys
    ) + " from k a"


def _encoded(spark, sf):
    last = {"ip": "ip", "device": "device", "city": "city"}
    log = with_last_event(logins(spark, sf), trades(spark, sf).select("rowkey", "id", "us", "is_risk"), last)
    keys = {c: F.col(c) for c in _SINGLE}
    keys |= {name: composite_key(*[F.col(p) for p in parts]) for name, parts in _COMBINED.items()}
    return encoding.past_target_encoding(log, keys)


@query("E11_past_target_encoding", _encoding_sql())
def past_target_encoding(spark, sf):
    return rounded(_encoded(spark, sf))


@query(
    "E12_encoding_noise",
    _encoding_sql(
        " * (0.9 + 0.2 * (cast('0x' || substr(md5('noise' || cast(a.rowkey as varchar)), 1, 13) as bigint) / 4503599627370496.0))"
    ),
)
def encoding_noise(spark, sf):
    encoded = _encoded(spark, sf)
    return rounded(encoding.with_noise(encoded, [c for c in encoded.columns if c.endswith("_t_encoding")]))


_DETAILS = ("timelong", "log_from", "city", "result", "type", "is_scan", "device", "ip")

_RANKED = f"""{LOGS}, r as (select t.rowkey, l.*, row_number() over (partition by t.rowkey order by l.us desc, l.log_id desc) as n
    from t join l on l.id = t.id and l.us < t.us)"""


def _recent(spark, sf):
    asked = trades(spark, sf).select("rowkey", "id", "us")
    return link_last_events(logins(spark, sf), asked, ["log_id", *_DETAILS], 3)


@query(
    "E13_recent_login_detail",
    f"with {_RANKED} select t.rowkey, "
    + ", ".join(f"max({c}) filter (where n = {i + 1}) as {c}_login_{i}" for i in range(3) for c in _DETAILS)
    + ", least(count(n), 3) as recent_login_number from t left join (select * exclude (id, us, time, period) from r) r on r.rowkey = t.rowkey group by t.rowkey",
)
def recent_login_detail(spark, sf):
    return links.recent_details(_recent(spark, sf), _DETAILS).drop("id", "us", "last_0", "last_1", "last_2")


@query(
    "E14_same_as_previous",
    f"with {_RANKED}, w as (select t.rowkey, "
    + ", ".join(f"max({c}) filter (where n = {i + 1}) as {c}_{i}" for i in range(3) for c in links.COMPARED)
    + " from t left join (select * exclude (id, us, time, period) from r) r on r.rowkey = t.rowkey group by t.rowkey) select rowkey, "
    + ", ".join(f"cast(coalesce({c}_0 = {c}_{i}, false) as int) as {c}_comparing_login_{i}" for c in links.COMPARED for i in (1, 2))
    + " from w",
)
def same_as_previous(spark, sf):
    flagged = links.comparison_flags(links.recent_details(_recent(spark, sf), _DETAILS))
    return flagged.select("rowkey", *[c for c in flagged.columns if "_comparing_" in c])


_GAPS = (
    f"with {_RANKED}, w as (select t.rowkey, t.id, t.us, "
    + ", ".join(f"(t.us - max(r.us) filter (where n = {i + 1})) / 1e6 as d{i}" for i in range(3))
    + " from t left join (select rowkey, us, n from r) r on r.rowkey = t.rowkey group by t.rowkey, t.id, t.us) "
)


@query("E15_login_gaps", _GAPS + "select rowkey, " + ", ".join(f"round(ln(d{i}), 6) as log_distance_{i}" for i in range(3)) + " from w")
def login_gaps(spark, sf):
    gaps = links.login_gaps(_recent(spark, sf))
    return rounded(gaps.select("rowkey", *[F.ln(f"login_distance_{i}").alias(f"log_distance_{i}") for i in range(3)]))


_MEAN_GAP = f"""m as (select t.id, case when count(distinct l.log_id) >= 2 then (max(l.us) - min(l.us)) / (count(distinct l.log_id) - 1)
    when count(distinct l.log_id) = 1 then least({END_US} - min(l.us), min(l.us) - {START_US}) else {END_US} - {START_US} end / 1e6 as mean
    from t left join l on l.id = t.id group by t.id)"""


@query("E16_mean_login_gap", f"with {LOGS}, {_MEAN_GAP} select id, round(mean, 3) as mean_login_distance from m")
def mean_login_gap(spark, sf):
    return rounded(links.mean_login_gap(logins(spark, sf), trades(spark, sf), START_US, END_US), 3)


@query(
    "E16_mean_gap_before",
    f"with {LOGS} select t.rowkey, round(case when count(l.us) >= 2 then (max(l.us) - min(l.us)) / (count(l.us) - 1) / 1e6 end, 3) as mean_gap_before "
    "from t left join l on l.id = t.id and l.us < t.us group by t.rowkey",
)
def mean_gap_before(spark, sf):
    return rounded(links.mean_gap_before(logins(spark, sf), trades(spark, sf)), 3)


@query(
    "E17_filled_gaps",
    _GAPS
    + f", {_MEAN_GAP}, s as (select rowkey, d0, d1, d2, mean, (us - {START_US}) / 1e6 as age from w join m using (id)), "
    "a as (select *, coalesce(d0, greatest(mean, age)) as a0 from s), "
    "b as (select *, case when d0 is null then a0 + mean when d1 is null then greatest(mean + d0, age) else d1 end as a1 from a), "
    "c as (select *, case when d1 is null then a1 + mean when d2 is null then greatest(mean + d1, age) else d2 end as a2 from b) "
    "select rowkey, round(ln(a0), 6) as login_distance_0_al, round(ln(a1), 6) as login_distance_1_al, round(ln(a2), 6) as login_distance_2_al from c",
)
def filled_gaps(spark, sf):
    means = links.mean_login_gap(logins(spark, sf), trades(spark, sf), START_US, END_US)
    gaps = links.login_gaps(_recent(spark, sf)).join(means, "id")
    filled = links.fill_gaps(gaps, START_US)
    return rounded(filled.select("rowkey", *[f"login_distance_{i}_al" for i in range(3)]))


@query("E18_gap_change", _GAPS + "select rowkey, round(abs(d2 + d0 - 2 * d1), 6) as login_distance_diff from w")
def gap_change(spark, sf):
    return rounded(links.gap_change(links.login_gaps(_recent(spark, sf))).select("rowkey", "login_distance_diff"))


# How often a value must occur to be kept.
LEAST_SEEN = {"id": 10, "ip": 6, "device": 6, "city": 20}


@query(
    "E19_rare_categories",
    f"with {LOGS}, u as (select rowkey, t.id, (select l.ip from l where l.id = t.id and l.us < t.us order by l.us desc, l.log_id desc limit 1) as ip, "
    "(select l.device from l where l.id = t.id and l.us < t.us order by l.us desc, l.log_id desc limit 1) as device, "
    "(select l.city from l where l.id = t.id and l.us < t.us order by l.us desc, l.log_id desc limit 1) as city from t) select rowkey, "
    + ", ".join(f"case when {c} is not null and count(*) over (partition by {c}) < {n} then -5 else {c} end as {c}_kept" for c, n in LEAST_SEEN.items())
    + " from u",
)
def rare_categories(spark, sf):
    last = {"ip": "ip", "device": "device", "city": "city"}
    out = with_last_event(logins(spark, sf), trades(spark, sf).select("rowkey", "id", "us"), last)
    for column, least in LEAST_SEEN.items():
        out = encoding.collapse_rare(out, column, least)
    return out.select("rowkey", *[f"{c}_kept" for c in LEAST_SEEN])
