"""Feature statistics, imputation, normalisation and outlier flags."""

from __future__ import annotations

from pyspark.sql import functions as F

from priorsight.catalog import query
from priorsight.catalog.binding import LOGS, logins, rounded, table, trades
from priorsight.operators import featurestats as fs

_QUALITY = "d as (select doc_id, quality, n_chars, cast(substr(source, 4) as int) as source_no, cast(lang = 'en' as int) as english from labels join documents using (doc_id))"


def _documents(spark, sf):
    documents = table(spark, sf, "documents").select(
        "doc_id", "n_chars", F.substring("source", 4, 10).cast("int").alias("source_no"), (F.col("lang") == "en").cast("int").alias("english")
    )
    return table(spark, sf, "labels").select("doc_id", "quality").join(documents, "doc_id")


_CHI = """{f}_t as (select {c} as category, count(*) filter (where quality = 0) as o0, count(*) filter (where quality = 1) as o1 from {s} group by 1),
{f}_a as (select *, sum(o0) over () as a0, sum(o1) over () as a1, count(*) over () as k from {f}_t),
{f}_e as (select k, abs(o0 - (o0 + o1) * a0 / (a0 + a1)) as d0, (o0 + o1) * a0 / (a0 + a1) as e0, abs(o1 - (o0 + o1) * a1 / (a0 + a1)) as d1, (o0 + o1) * a1 / (a0 + a1) as e1 from {f}_a),
{f}_r as (select '{f}' as feature, sum(power(d0 - case when k = 2 then least(d0, 0.5) else 0 end, 2) / e0 + power(d1 - case when k = 2 then least(d1, 0.5) else 0 end, 2) / e1) as chi2, max(k) - 1 as degrees from {f}_e)"""


_CHI_ALL = (
    f"with {_QUALITY}, s as (select *, cast(ceil(10 * row_number() over (order by source_no, doc_id) / count(*) over ()) as int) - 1 as source_bin, "
    "cast(ceil(10 * row_number() over (order by n_chars, doc_id) / count(*) over ()) as int) - 1 as size_bin from d), "
    + _CHI.format(f="english", c="english", s="d") + ", " + _CHI.format(f="n_chars", c="size_bin", s="s") + ", "
    + _CHI.format(f="source_no", c="source_bin", s="s")
    + ", c as (select * from english_r union all select * from n_chars_r union all select * from source_no_r) "
)


@query("H1_chi_square", _CHI_ALL + "select feature, round(chi2, 6) as chi2, degrees from c")
def chi_square(spark, sf):
    documents = _documents(spark, sf)
    parts = [fs.chi_square(documents, c, "quality", "doc_id") for c in ("english", "n_chars", "source_no")]
    return rounded(parts[0].unionByName(parts[1]).unionByName(parts[2]))


# The tail is the integral of the density over u = sqrt(t), by Simpson's rule on 4,000 steps of 1/200.
_TAIL = (
    "u as (select feature, any_value(degrees) as k, sqrt(any_value(chi2)) as low, unnest(range(0, 4001)) as i from c group by feature), "
    "v as (select feature, k, i, cast(low as double) + i / 200.0::double as u from u), "
    "tail as (select feature, sum(case when i in (0, 4000) then 1 when i % 2 = 1 then 4 else 2 end * power(u, k - 1) * exp(-u * u / 2)) / 600.0::double "
    "* 2 / (power(2.0::double, k / 2.0::double) * gamma(k / 2.0::double)) as p from v group by feature, k) "
)


@query(
    "H1_chi_square_p_values",
    _CHI_ALL + f", {_TAIL} select feature, round(chi2, 6) as chi2, degrees, round(p, 6) as p from c join tail using (feature)",
)
def chi_square_p_values(spark, sf):
    return rounded(fs.chi_square_p_values(_documents(spark, sf), ["english", "n_chars", "source_no"], "quality", "doc_id"))


@query(
    "H2_equal_count_bins",
    "select o_orderkey, cast(ceil(10 * row_number() over (order by o_totalprice, o_orderkey) / count(*) over ()) as int) - 1 as bin from orders",
)
def equal_count_bins(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return fs.equal_count_bins(orders, "o_totalprice", "o_orderkey").drop("o_totalprice")


@query(
    "H3_quantile_edge_bins",
    "with e as (select " + ", ".join(f"quantile_cont(o_totalprice, 0.{i}) as e{i}" for i in range(1, 10)) + " from orders) select o_orderkey, "
    + " + ".join(f"cast(o_totalprice >= e{i} as int)" for i in range(1, 10)) + " as bin from orders, e",
)
def quantile_edge_bins(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return fs.quantile_edge_bins(orders, "o_totalprice").drop("o_totalprice")


_MEASURED = ("l_quantity", "l_extendedprice", "l_discount")

_NORMAL_SQL = """select '{c}' as feature, n, avg(power(x - m, 3)) / power(avg(power(x - m, 2)), 1.5) as g1, avg(power(x - m, 4)) / power(avg(power(x - m, 2)), 2) as b2
    from (select {c} as x, avg({c}) over () as m, cast(count(*) over () as double) as n from lineitem) group by n"""


@query(
    "H4_normality",
    "with s as (" + " union all ".join(_NORMAL_SQL.format(c=c) for c in _MEASURED) + """),
a as (select *, g1 * sqrt((n + 1) * (n + 3) / (6 * (n - 2))) as y,
    sqrt(2 * (3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9)) - 1)) - 1 as w2,
    (b2 - 3 * (n - 1) / (n + 1)) / sqrt(24 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))) as x,
    6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3))) as r from s),
b as (select *, asinh(y / sqrt(2 / (w2 - 1))) / sqrt(0.5 * ln(w2)) as z1, 6 + 8 / r * (2 / r + sqrt(1 + 4 / (r * r))) as a from a),
c as (select *, 1 + x * sqrt(2 / (a - 4)) as q from b),
d as (select *, (1 - 2 / (9 * a) - sign(q) * power((1 - 2 / a) / abs(q), 1.0 / 3)) / sqrt(2 / (9 * a)) as z2 from c)
select feature, round(z1 * z1 + z2 * z2, 3) as k2, round(exp(-(z1 * z1 + z2 * z2) / 2), 3) as p from d""",
)
def normality(spark, sf):
    return rounded(fs.normality(table(spark, sf, "lineitem"), _MEASURED), 3)


_GAPPY = "g as (select l_orderkey, l_linenumber, l_partkey, l_shipdate, case when l_discount > 0.02 then l_discount end as discount, case when l_tax > 0 then l_tax end as tax from lineitem)"


def _gappy(spark, sf):
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_shipdate",
        F.when(F.col("l_discount") > 0.02, F.col("l_discount")).alias("discount"), F.when(F.col("l_tax") > 0, F.col("l_tax")).alias("tax"),
    )


@query(
    "H5_median_imputation",
    f"with {_GAPPY}, m as (select median(discount) as md, median(tax) as mt from g where year(l_shipdate) <= 1999) "
    "select l_orderkey, l_linenumber, l_partkey, round(coalesce(discount, md), 6) as discount, round(coalesce(tax, mt), 6) as tax from g, m",
)
def median_imputation(spark, sf):
    rows = _gappy(spark, sf)
    fitted_on = rows.filter(F.year("l_shipdate") <= 1999)
    return rounded(fs.impute_median(rows, ["discount", "tax"], fitted_on).drop("l_shipdate"))


@query(
    "H6_mean_imputation",
    f"with {_GAPPY}, m as (select avg(discount) as md, avg(tax) as mt from g) "
    "select l_orderkey, l_linenumber, l_partkey, round(coalesce(discount, md), 6) as discount, round(coalesce(tax, mt), 6) as tax from g, m",
)
def mean_imputation(spark, sf):
    return rounded(fs.impute_mean(_gappy(spark, sf), ["discount", "tax"]).drop("l_shipdate"))


def _box_cox_sql(low: float = -2.0, high: float = 2.0, steps: int = 20, rounds: int = 4) -> str:
    """The grids of powers one after another, each around the best power of the one before."""
    power = "case when abs({p}) < 1e-12 then ln(x) else (power(x, {p}) - 1) / {p} end"
    parts = [
        "o as (select o_orderkey, cast(o_totalprice as double) + case when low <= 0 then abs(low) + 1 else 0 end as x from orders, (select min(o_totalprice) as low from orders))",
        f"r0 as (select {low}::double as low, {high}::double as high)",
    ]
    for i in range(rounds):
        parts += [
            f"g{i} as (select low, high, low + (high - low) * g / {steps}::double as p from r{i}, (select unnest(range(0, {steps + 1}))::double as g))",
            f"l{i} as (select low, high, p, (p - 1) * sum(ln(x)) - count(*) / 2.0::double * ln(var_pop({power.format(p='p')})) as fit from o, g{i} group by low, high, p)",
            f"r{i + 1} as (select p - (high - low) / {steps}::double as low, p + (high - low) / {steps}::double as high from l{i} order by fit desc, p limit 1)",
        ]
    last = f"best as (select (low + high) / 2 as best from r{rounds})"
    return f"with {', '.join(parts)}, {last} select o_orderkey, round({power.format(p='best')}, 6) as o_totalprice, round(best, 6) as power from o, best"


@query("H7_box_cox", _box_cox_sql())
def box_cox(spark, sf):
    orders = fs.shift_positive(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice")
    power = fs.fit_box_cox(orders, "o_totalprice")
    return rounded(fs.box_cox(orders, "o_totalprice", power).withColumn("power", F.lit(power)))


@query(
    "H8_normalised_columns",
    "select c_custkey, round((c_acctbal - avg(c_acctbal) over ()) / stddev_samp(c_acctbal) over (), 6) as z, "
    "round(c_acctbal / sqrt(sum(c_acctbal * c_acctbal) over ()), 6) as unit, cast(sign(c_acctbal) as double) as row_unit from customer",
)
def normalised_columns(spark, sf):
    customers = table(spark, sf, "customer").select("c_custkey", *[F.col("c_acctbal").alias(n) for n in ("z", "unit", "row_unit")])
    return rounded(fs.row_unit_norm(fs.unit_norm(fs.z_score(customers, "z"), "unit"), "row_unit"))


@query(
    "H9_one_hot",
    f"with {LOGS} select log_id, result, " + ", ".join(f'cast(result = {v} as int) as "result_{v}"' for v in (-2, -1, 1, 31)) + " from l",
)
def one_hot(spark, sf):
    return fs.one_hot(logins(spark, sf).select("log_id", "result"), "result")


@query("H10_repaired_flags", f"with {LOGS} select rowkey, cast(coalesce(case when amount > 20 then amount > 100 end, false) as int) as flag from t")
def repaired_flags(spark, sf):
    flag = F.when(F.col("amount") > 20, F.col("amount") > 100).alias("flag")
    return fs.repair_flags(trades(spark, sf).select("rowkey", flag), ["flag"])


@query(
    "H11_three_sigma",
    "with s as (select avg(value) as m, stddev_samp(value) as s from events) select event_id, case when value > m + 3 * s then 1 when value < m - 3 * s then -1 else 0 end as value_3sigma from events, s",
)
def three_sigma(spark, sf):
    return fs.three_sigma(table(spark, sf, "events").select("event_id", "value"), ["value"]).drop("value")


def _tukey_sql(low: float, high: float) -> str:
    return (
        f"with q as (select quantile_cont(value, {low}) as a, quantile_cont(value, {high}) as b from events) select event_id, "
        "case when value > b + 1.5 * (b - a) then 1 when value < a - 1.5 * (b - a) then -1 else 0 end as value_tukey from events, q"
    )


@query("H12_tukey_narrow", _tukey_sql(0.0025, 0.0075))
def tukey_narrow(spark, sf):
    return fs.tukey(table(spark, sf, "events").select("event_id", "value"), ["value"]).drop("value")


@query("H12_tukey_quartiles", _tukey_sql(0.25, 0.75))
def tukey_quartiles(spark, sf):
    return fs.tukey(table(spark, sf, "events").select("event_id", "value"), ["value"], fs.QUARTILES).drop("value")


@query("H13_principal_components")
def principal_components(spark, sf):
    columns = [f"e{i}" for i in range(64)]
    vectors = table(spark, sf, "embeddings").select("vec_id", *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(columns)])
    white, explained = fs.principal_components(vectors, columns, "vec_id", 20)
    return white.withColumn("explained", F.array(*[F.lit(e) for e in explained]))
