"""Run named queries and compare their rows with the SQL definitions in DuckDB."""

from __future__ import annotations

import decimal
import math
import sys
import time

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{sf}/{name}.parquet'")
    return con


def normal(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return ("bool", value)
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return ("num", round(value, 6) + 0.0) if value != int(value) or abs(value) > 1e15 else ("num", float(int(value)))
    if isinstance(value, int):
        return ("num", float(value))
    if isinstance(value, (list, tuple)):
        return tuple(normal(v) for v in value)
    if hasattr(value, "tzinfo") and value.tzinfo is not None:
        value = value.replace(tzinfo=None)
    return ("other", str(value))


def sort_rows(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(normal(r[i]) for i in order) for r in rows), key=repr)


def kind(name: str) -> str:
    """Integer, float, or the name of any other type, for both engines."""
    name = name.lower().split("(")[0]
    if name in ("tinyint", "smallint", "int", "integer", "bigint"):
        return "integer"
    return {"float": "double", "varchar": "string", "timestamp_ntz": "timestamp"}.get(name, name)


def compare(spark, con, name, function, sql, sf) -> tuple[bool, str]:
    started = time.time()
    df = function(spark, sf)
    got = df.collect()
    took = time.time() - started
    if sql is None:
        return True, f"{len(got)} rows, no SQL, {took:.1f}s"
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    want = result.fetchall()
    if sorted(columns) != sorted(df.columns):
        return False, f"columns differ: {sorted(set(columns) ^ set(df.columns))}"
    ours = {n: kind(t) for n, t in df.dtypes}
    theirs = {r[0]: kind(r[1]) for r in con.execute("describe " + sql).fetchall()}
    apart = [(n, ours[n], theirs[n]) for n in ours if ours[n] != theirs[n] and "array" not in ours[n]]
    if apart:
        return False, f"types differ: {apart[:8]}"
    a, b = sort_rows(got, df.columns), sort_rows(want, columns)
    if a != b:
        names = sorted(columns)
        bad = [(x, y) for x, y in zip(a, b) if x != y]
        detail = ""
        if bad:
            x, y = bad[0]
            detail = str([(n, p, q) for n, p, q in zip(names, x, y) if p != q][:4])
        return False, f"{len(a)} rows against {len(b)}, {len(bad)} differ {detail[:600]}"
    return True, f"{len(got)} rows equal, {took:.1f}s"


def session():
    import tempfile

    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="checkpoints-"))
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


if __name__ == "__main__":
    sys.path.insert(0, __file__.rsplit("/tests/", 1)[0])
    import __spark_entry__ as entry

    sf = "/root/testdata/sf0.01"
    wanted = sys.argv[1:]
    spark, con = session(), duck(sf)
    oracles = entry.oracle_sql()
    for name, function in entry.queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        try:
            ok, text = compare(spark, con, name, function, oracles.get(name), sf)
        except Exception as e:  # noqa: BLE001
            ok, text = False, repr(e)[:700]
        print("ok  " if ok else "FAIL", name, text, flush=True)
