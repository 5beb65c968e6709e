"""Package documents: JSON metadata and XML headers and collections."""

from __future__ import annotations

import json
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratalog.functions import fixed
from stratalog.functions.geo import usable_position


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """hole_id, document, text, top ('object', 'array', ...) of every JSON document one folder below the root."""
    raw = spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").text(folder)
    path = F.split(F.col("_metadata.file_path"), "/")
    text = F.regexp_replace("value", "^﻿", "")
    rows = raw.select(F.element_at(path, -2).alias("hole_id"), F.element_at(path, -1).alias("document"), text.alias("text"))
    first = F.substring(F.ltrim(F.regexp_replace("text", r"^\s+", "")), 1, 1)
    return rows.withColumn("top", F.when(first == "{", "object").when(first == "[", "array").otherwise("other"))


@F.pandas_udf(T.StringType())
def strict_json_problem(text: pd.Series) -> pd.Series:
    """Why a JSON text is refused (syntax, repeated key, NaN or infinity), null if it is fine."""

    def pairs(items):
        if len({k for k, _ in items}) < len(items):
            raise ValueError("repeated key")
        return dict(items)

    def constant(token):
        raise ValueError(f"non-finite token {token}")

    def check(value):
        try:
            json.loads(value, object_pairs_hook=pairs, parse_constant=constant)
        except (ValueError, TypeError) as error:
            return str(error)
        return None

    return text.map(check)


def document_problems(documents: DataFrame, holes: DataFrame) -> DataFrame:
    """Missing documents, wrong top-level types and JSON that is not strict, per hole."""
    wanted = holes.select("hole_id").withColumn(
        "_w", F.explode(F.array(*[F.struct(F.lit(d).alias("document"), F.lit(t).alias("type")) for d, t in fixed.PACKAGE_DOCUMENTS.items()]))
    )
    joined = wanted.select("hole_id", "_w.*").join(documents, ["hole_id", "document"], "left")
    problem = F.when(F.col("text").isNull(), "missing").when(F.col("top") != F.col("type"), "wrong top-level type").otherwise(strict_json_problem("text"))
    return joined.withColumn("problem", problem).where("problem is not null").select("hole_id", "document", "problem")


def records(documents: DataFrame, document: str, schema: str, *, within: str | None = None) -> DataFrame:
    """Records of one document over all holes: hole_id, position and the fields of ``schema``.

    ``within`` names the list inside an object document.
    """
    rows = documents.where(F.col("document") == document)
    listed = f"array<struct<{schema}>>"
    parsed = F.from_json("text", f"struct<{within}:{listed}>")[within] if within else F.from_json("text", listed)
    return rows.select("hole_id", F.posexplode(parsed).alias("position", "_r")).select("hole_id", "position", "_r.*")


def header_fields(df: DataFrame, *, xml: str, fields: Sequence[str]) -> DataFrame:
    """``header`` struct of text fields of an XML header, and ``header_problem``.

    Declarations of document types or entities are refused before parsing, and
    a field that occurs twice is a problem.
    """
    schema = T.StructType([T.StructField(f, T.ArrayType(T.StringType())) for f in fields])
    declared = F.coalesce(F.col(xml).rlike(r"(?i)<!(DOCTYPE|ENTITY)"), F.lit(False))
    blank = F.coalesce(F.trim(xml), F.lit("")) == ""
    safe = F.when(~declared & ~blank, F.col(xml))
    parsed = df.withColumn("_x", F.from_xml(safe, schema, {"mode": "PERMISSIVE"}))
    repeated = F.lit(False)
    for f in fields:
        repeated = repeated | F.coalesce(F.size(f"_x.{f}") > 1, F.lit(False))
    header = F.struct(*[F.get(f"_x.{f}", F.lit(0)).alias(f) for f in fields])
    problem = F.when(declared, "document type or entity declared").when(repeated, "repeated node")
    return parsed.withColumns({"header": header, "header_problem": problem}).drop("_x")


def header_collars(df: DataFrame, *, xml: str = "description") -> DataFrame:
    """Adds latitude and longitude of the header where both are usable."""
    parsed = header_fields(df, xml=xml, fields=["Latitude", "Longitude", "Project", "Datum", "InstrumentName"])
    good = usable_position("header.Latitude", "header.Longitude")
    return parsed.withColumns(
        {
            "latitude": F.when(good, F.col("header.Latitude").try_cast("double")),
            "longitude": F.when(good, F.col("header.Longitude").try_cast("double")),
            "project": F.col("header.Project"), "instrument": F.trim("header.InstrumentName"),
        }
    ).drop("header")


def read_membership(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    """dataset_id, kind, log_id (and file) of dataset-collection XML files.

    With ``multiline=False`` every line is one Dataset element, and large files split over tasks.
    """
    listed = lambda tag, ident: f"struct<{tag}:array<struct<{ident}:string>>>"
    schema = (
        f"DatasetID string, DatasetName string, Logs {listed('Log', 'LogID')}, SpectralLogs {listed('SpectralLog', 'logID')}, "
        f"ProfilometerLogs {listed('ProfLog', 'logID')}, ImageLogs {listed('Log', 'LogID')}"
    )
    raw = spark.read.format("xml").option("rowTag", "Dataset").option("recursiveFileLookup", "true").option("multiLine", str(multiline).lower()).schema(schema).load(path)
    groups = {
        "scalar": "Logs.Log.LogID", "spectral": "SpectralLogs.SpectralLog.logID",
        "profile": "ProfilometerLogs.ProfLog.logID", "image": "ImageLogs.Log.LogID",
    }
    kinds = F.array(*[F.struct(F.lit(kind).alias("kind"), F.col(field).alias("ids")) for kind, field in groups.items()])
    rows = raw.select(
        F.col("_metadata.file_path").alias("path"), F.col("DatasetID").alias("dataset_id"), F.col("DatasetName").alias("dataset_name"), F.explode(kinds).alias("g")
    )
    return rows.select("path", "dataset_id", "dataset_name", "g.kind", F.explode("g.ids").alias("log_id"))


def membership_problems(members: DataFrame) -> DataFrame:
    """Blank or repeated log ids within a dataset, and logs of several datasets (images may be shared)."""
    per_log = members.groupBy("path", "kind", "log_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("dataset_id").alias("datasets"))
    blank = F.coalesce(F.col("log_id"), F.lit("")) == ""
    problem = (
        F.when(blank, "blank log id").when((F.col("datasets") > 1) & (F.col("kind") != "image"), "log of several datasets")
        .when(F.col("n") > F.col("datasets"), "log listed twice")
    )
    return per_log.withColumn("problem", problem).where("problem is not null").select("path", "kind", "log_id", "problem")
