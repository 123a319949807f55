"""Sources of relvars: csv, txt, con, sql and odbc (by JDBC), db (kept relvars) and parquet.

Files are read by Spark; the heading is declared or comes from the first line, as name or name:type.
A field that does not fit its type is an error. Empty text stays empty; duplicates go.
"""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relata.expr import quoted
from relata.relation import Relation
from relata.types import DIGITS, SCALE, RelationError

NUMBER = T.DecimalType(DIGITS, SCALE)
TYPES = {"text": T.StringType(), "number": NUMBER, "bool": T.BooleanType(), "time": T.TimestampNTZType(), "date": T.DateType(), "binary": T.BinaryType()}


def header(spark: SparkSession, path: str) -> T.StructType:
    first = spark.read.text(path).limit(1).collect()
    if not first:
        raise RelationError(f"{path} has no header")
    fields = []
    for part in first[0][0].lstrip("﻿").split(","):
        name, _, kind = part.strip().partition(":")
        fields.append(T.StructField(name.strip(), TYPES[kind.strip() or "text"]))
    return T.StructType(fields)


def csv(spark: SparkSession, path: str, heading: T.StructType | None = None) -> Relation:
    """Fields go by position to the heading. Numbers take the largest scale that the file has."""
    heading = heading or header(spark, path)
    plain = T.StructType([T.StructField(f.name, T.StringType()) for f in heading])
    raw = spark.read.csv(path, header=True, schema=plain, enforceSchema=True, mode="FAILFAST", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, nullValue="", emptyValue="")
    numbers = [f.name for f in heading if isinstance(f.dataType, T.DecimalType)]
    scales = {}
    if numbers:
        row = raw.agg(*(F.max(F.length(F.regexp_extract(F.col(quoted(n)), r"\.(\d+)\s*$", 1))).alias(n) for n in numbers)).first()
        scales = {n: min(SCALE, row[n] or 0) for n in numbers}
    made = []
    for f in heading:
        c = F.coalesce(F.col(quoted(f.name)), F.lit(""))
        t = T.DecimalType(DIGITS, scales[f.name]) if f.name in scales else f.dataType
        made.append((c if isinstance(t, T.StringType) else F.trim(c).cast(t)).alias(f.name))
    return Relation.of(raw.select(*made))


def txt(spark: SparkSession, path: str) -> Relation:
    return Relation.of(spark.read.text(path).withColumnRenamed("value", "Line"))


def con(spark: SparkSession, prompt: Callable[[], str] = input) -> Relation:
    return Relation(spark.createDataFrame([(prompt(),)], "line string"))


def jdbc(spark: SparkSession, url: str, table: str, **options: str) -> Relation:
    """Any database with a JDBC driver on the class path; nulls become defaults, duplicates go."""
    return Relation.of(spark.read.jdbc(url, table, properties=options))


def read(spark: SparkSession, origin: str, name: str, folder: str, heading: T.StructType | None, prompt: Callable[[], str]) -> Relation:
    path = f"{folder}/{name}"
    if origin == "csv":
        return csv(spark, f"{path}.csv", heading)
    if origin == "txt":
        return txt(spark, f"{path}.txt")
    if origin == "con":
        return con(spark, prompt)
    if origin in ("sql", "odbc"):
        return jdbc(spark, os.environ.get("RELATA_JDBC_URL", ""), name)
    if origin == "parquet":
        return Relation.from_parquet(spark, f"{path}.parquet")
    if origin == "db":
        return Relation.of(spark.table(name))
    raise RelationError(f"no source {origin}")
