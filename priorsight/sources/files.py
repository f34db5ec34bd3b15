"""Typed scans, sinks, and the keyed feature store."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from priorsight.plans.lineage import checkpoint_dir

LOGIN_SCHEMA = T.StructType(
    [
        T.StructField("log_id", T.StringType()),
        T.StructField("id", T.StringType()),
        T.StructField("time", T.StringType()),
        T.StructField("timestamp", T.LongType()),
        T.StructField("timelong", T.LongType()),
        T.StructField("device", T.IntegerType()),
        T.StructField("ip", T.IntegerType()),
        T.StructField("city", T.IntegerType()),
        T.StructField("log_from", T.IntegerType()),
        T.StructField("result", T.IntegerType()),
        T.StructField("type", T.IntegerType()),
        T.StructField("is_scan", T.IntegerType()),
        T.StructField("is_sec", T.IntegerType()),
    ]
)

TRADE_SCHEMA = T.StructType(
    [
        T.StructField("rowkey", T.StringType()),
        T.StructField("id", T.StringType()),
        T.StructField("time", T.StringType()),
        T.StructField("is_risk", T.IntegerType()),
    ]
)

TRADE_WITH_LOGIN_SCHEMA = T.StructType([*TRADE_SCHEMA.fields, T.StructField("login_id", T.StringType())])

LISTING_SCHEMA = T.StructType(
    [
        T.StructField("listing_id", T.LongType()),
        T.StructField("interest_level", T.StringType()),
        T.StructField("price", T.DoubleType()),
        T.StructField("bedrooms", T.IntegerType()),
        T.StructField("bathrooms", T.DoubleType()),
        T.StructField("latitude", T.DoubleType()),
        T.StructField("longitude", T.DoubleType()),
        T.StructField("manager_id", T.StringType()),
        T.StructField("building_id", T.StringType()),
        T.StructField("street_address", T.StringType()),
        T.StructField("display_address", T.StringType()),
        T.StructField("features", T.ArrayType(T.StringType())),
        T.StructField("num_photos", T.IntegerType()),
        T.StructField("cluster_id_10", T.IntegerType()),
        T.StructField("cluster_id_30", T.IntegerType()),
    ]
)


def read_csv(spark: SparkSession, path: str, schema: T.StructType, malformed: str = "fail") -> DataFrame:
    """The columns of ``schema``, found by the names in the header, in any order; others are not read.

    A column that the header lacks is an error, and so is a file whose header differs from the first one's.  A field that
    does not fit its type is an error, or null if ``malformed`` is ``"null"``.
    """
    header = spark.read.option("header", True).csv(path).columns
    missing = [f.name for f in schema.fields if f.name not in header]
    if missing:
        raise ValueError(f"{path} has no column {', '.join(missing)}; it has {', '.join(header)}")
    text = T.StructType([T.StructField(c, T.StringType()) for c in header])
    rows = spark.read.schema(text).options(header=True, enforceSchema=False, mode=_mode(malformed)).csv(path)
    typed = lambda f: F.col(f"`{f.name}`").try_cast(f.dataType) if malformed == "null" else F.col(f"`{f.name}`").cast(f.dataType)
    return rows.select(*[typed(f).alias(f.name) for f in schema.fields])


def read_json(spark: SparkSession, path: str, schema: T.StructType, malformed: str = "fail") -> DataFrame:
    """The fields of ``schema``, by name; a record may lack some.  Records that do not fit are an error, or null if ``malformed`` is ``"null"``."""
    return spark.read.schema(schema).option("mode", _mode(malformed)).json(path)


_RAW = "_raw"


def read_csv_apart(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """The records that fit ``schema``, and those that do not: ``raw`` text, ``file``, ``reason`` and ``parsed``, the fields that could be read.

    Columns are found by the header's names, as in ``read_csv``, whose errors for a header apply.  Both tables are one
    scan each and neither holds a record of the other.
    """
    header = spark.read.option("header", True).csv(path).columns
    missing = [f.name for f in schema.fields if f.name not in header]
    if missing:
        raise ValueError(f"{path} has no column {', '.join(missing)}; it has {', '.join(header)}")
    types = {f.name: f.dataType for f in schema.fields}
    fields = [T.StructField(c, types.get(c, T.StringType())) for c in header]
    asked = T.StructType([*fields, T.StructField(_RAW, T.StringType())])
    rows = spark.read.schema(asked).options(header=True, mode="PERMISSIVE", columnNameOfCorruptRecord=_RAW).csv(path)
    text = T.StructType([T.StructField(c, T.StringType()) for c in header])
    as_text = F.from_csv(F.col(_RAW), text.simpleString()[len("struct<") : -1].replace(":", " "))
    wrong = [F.when(as_text[c].isNotNull() & F.col(f"`{c}`").isNull(), F.lit(c)) for c in header]
    named = F.array_join(F.array_compact(F.array(*wrong)), ", ")
    reason = F.when(named != "", F.concat(F.lit("does not fit: "), named)).otherwise(f"has not {len(header)} fields")
    return rows.filter(F.col(_RAW).isNull() & _whole(header)).select(*schema.names), _quarantined(rows, header, reason)


def read_json_apart(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """As ``read_csv_apart`` for JSON lines; a record may lack fields, which are null."""
    rows = spark.read.schema(T.StructType([*schema.fields, T.StructField(_RAW, T.StringType())])).options(mode="PERMISSIVE", columnNameOfCorruptRecord=_RAW).json(path)
    wrong = [F.when(F.get_json_object(_RAW, f"$.{c}").isNotNull() & F.col(f"`{c}`").isNull(), F.lit(c)) for c in schema.names]
    named = F.array_join(F.array_compact(F.array(*wrong)), ", ")
    reason = F.when(F.try_parse_json(_RAW).isNull(), "is no JSON").when(named != "", F.concat(F.lit("does not fit: "), named)).otherwise("is no record")
    return rows.filter(F.col(_RAW).isNull() & _whole(schema.names)).select(*schema.names), _quarantined(rows, schema.names, reason)


def _whole(names: Sequence[str]) -> Column:
    """True, by way of all columns: a reader parses, and so judges, only the columns that a query needs."""
    return F.xxhash64(*[F.col(f"`{c}`") for c in names]) >= F.lit(-(2**63))


def _quarantined(rows: DataFrame, names: Sequence[str], reason: Column) -> DataFrame:
    bad = rows.filter(F.col(_RAW).isNotNull() & _whole(names))
    return bad.select(F.col(_RAW).alias("raw"), F.col("_metadata.file_path").alias("file"), reason.alias("reason"), F.struct(*[F.col(f"`{c}`") for c in names]).alias("parsed"))


def _mode(malformed: str) -> str:
    return {"fail": "FAILFAST", "null": "PERMISSIVE"}[malformed]


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_scores(df: DataFrame, path: str, key: str = "rowkey", score: str = "is_risk") -> None:
    """Key and score only, without a header."""
    df.select(key, score).write.mode("overwrite").option("header", False).csv(path)


def write_features(df: DataFrame, store: str, family: str) -> None:
    """One Parquet table per feature family, keyed by ``rowkey``."""
    df.write.mode("overwrite").parquet(f"{store}/{family}")


def assemble(
    spark: SparkSession, store: str, sets: Mapping[str, Sequence[str]], base: DataFrame | None = None, key: str = "rowkey"
) -> DataFrame:
    """Join the chosen columns of several families on the key; only those columns are read."""
    parts = [spark.read.parquet(f"{store}/{family}").select(key, *columns) for family, columns in sets.items()]
    return beside(parts if base is None else [base, *parts], key)


#: Buckets of a stored family, the same for all families of a store; a bucket should hold about 200 MB.
BUCKETS = 64


def _bucketed(spark: SparkSession, store: str, family: str, key: str, buckets: int) -> str:
    """The name under which the session knows a bucketed family; a session that has not written it finds it in the store."""
    name = f"family_{hashlib.md5(f'{store}/{family}'.encode()).hexdigest()}"
    if not spark.catalog.tableExists(name):
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(f"{store}/{family}").schema.fields)
        spark.sql(f"create table {name} ({columns}) using parquet clustered by (`{key}`) sorted by (`{key}`) into {buckets} buckets location '{store}/{family}'")
    return name


def write_bucketed(df: DataFrame, store: str, family: str, key: str = "rowkey", buckets: int = BUCKETS) -> None:
    """One family, dealt to buckets by ``key`` and sorted in each, one file a bucket: the one shuffle its rows ever need."""
    name = f"family_{hashlib.md5(f'{store}/{family}'.encode()).hexdigest()}"
    dealt = df.repartition(buckets, key).write.mode("overwrite").format("parquet")
    dealt.bucketBy(buckets, key).sortBy(key).option("path", f"{store}/{family}").saveAsTable(name)


def assemble_bucketed(
    spark: SparkSession, store: str, sets: Mapping[str, Sequence[str]], key: str = "rowkey", buckets: int = BUCKETS
) -> DataFrame:
    """As ``assemble``, of bucketed families: bucket joins bucket, so no row is exchanged, however many families there are."""
    parts = [spark.table(_bucketed(spark, store, family, key, buckets)).select(key, *columns).hint("merge") for family, columns in sets.items()]
    return beside(parts, key)


def beside(parts: Sequence[DataFrame], key: str = "rowkey") -> DataFrame:
    """Blocks of columns side by side, matched by key and led by the first block."""
    out, *rest = parts
    for part in rest:
        out = out.join(part, key, "left")
    return out


def tag_and_union(train: DataFrame, test: DataFrame, label: str = "is_risk", keep_label: bool = False) -> DataFrame:
    """Both sets in one table with a ``from`` column; the label is dropped unless kept."""
    tagged = [train.withColumn("from", F.lit("train")), test.withColumn("from", F.lit("test"))]
    if not keep_label:
        tagged = [t.drop(label) for t in tagged]
    return tagged[0].unionByName(tagged[1], allowMissingColumns=True)


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that one of the two tables has more often than the other."""
    columns = a.columns
    return a.exceptAll(b.select(columns)).unionByName(b.select(columns).exceptAll(a))


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder for a written table, next to the session's checkpoints."""
    return f"{checkpoint_dir(spark)}/tables/{name}-{uuid.uuid4().hex[:12]}"
