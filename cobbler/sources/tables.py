"""Reading shop tables and request feeds.

A shop is a folder of Parquet tables named as in :data:`schemas.TABLES`.
Reads pass the declared schema, so Parquet column pruning and filter pushdown
apply and nothing is inferred.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import schemas


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One shop table from ``root/name`` (Parquet) with its declared schema."""
    return spark.read.schema(schemas.TABLES[name]).parquet(f"{root}/{name}")


def read_shop(spark: SparkSession, root: str, names=None) -> dict[str, DataFrame]:
    """All (or the named) shop tables under ``root`` as a name → DataFrame mapping."""
    return {n: read_table(spark, root, n) for n in (names or schemas.TABLES)}


def read_requests(spark: SparkSession, path: str, schema: T.StructType,
                  fmt: str = "json") -> DataFrame:
    """A feed of request bodies (JSON lines by default) with an explicit schema."""
    return spark.read.schema(schema).format(fmt).load(path)


#: The column of a request's JSON text.
BODY = "body"


def read_bodies(spark: SparkSession, path: str) -> DataFrame:
    """Request bodies as they came: a row of JSON text (``body``) for each line."""
    return spark.read.text(path).withColumnRenamed("value", BODY)


def parse_bodies(bodies: DataFrame, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(requests of ``schema``, bad bodies) of ``body``.

    A body is bad, with a ``reason``, if it is blank or null (``empty``), is no JSON or holds a value that its field can't
    take (``malformed``), or lacks a field that the schema doesn't let be null (``missing <field>``). ``request_id`` is what can
    still be read of it. Unknown fields are ignored.
    """
    corrupt = "_corrupt"
    read = T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields] + [T.StructField(corrupt, T.StringType(), True)])
    rows = bodies.select(BODY, F.from_json(BODY, read, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": corrupt}).alias("r"))
    reason = F.when(F.trim(F.coalesce(F.col(BODY), F.lit(""))) == "", "empty").when(F.col("r").isNull() | F.col(f"r.{corrupt}").isNotNull(), "malformed")
    for f in schema.fields:
        if not f.nullable:
            reason = reason.when(F.col(f"r.{f.name}").isNull(), f"missing {f.name}")
    rows = rows.withColumn("reason", reason)
    bad = rows.filter("reason IS NOT NULL").select(F.get_json_object(BODY, "$.request_id").try_cast("bigint").alias("request_id"), BODY, "reason")
    return rows.filter("reason IS NULL").select(*[F.col(f"r.{f.name}").alias(f.name) for f in schema.fields]), bad


def empty(spark: SparkSession, schema: T.StructType) -> DataFrame:
    """An empty table of the given schema (a new shop with no rows yet)."""
    return spark.createDataFrame([], schema)


def json_text(col) -> Column:
    """A nested column as JSON text with null fields kept, as the reference's JSON_OBJECT does."""
    return F.to_json(col, {"ignoreNullFields": "false"})


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write a (nested) result as JSON lines, keeping null fields (N3) — the reference's ``res.json``."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)
