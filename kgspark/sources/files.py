"""File sources: notes with front matter, repositories, ontologies and type definitions."""

from __future__ import annotations

import os
import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StringType

from kgspark import fixed
from kgspark.functions import text as X
from kgspark.operators.code import readable_files

FRONT_MATTER = r"(?s)\A﻿?---\r?\n(.*?)\r?\n---"


@F.pandas_udf(MapType(StringType(), ArrayType(StringType())))
def yaml_fields(text: pd.Series) -> pd.Series:
    """Front matter as field -> values; null when it is not a mapping."""
    import yaml

    def listed(v):
        if v is None:
            return []
        return [str(x).strip() for x in v if x] if isinstance(v, list) else [str(v)]

    def read(t):
        try:
            data = yaml.safe_load(t) if t else None
        except yaml.YAMLError:
            return None
        return {str(k): listed(v) for k, v in data.items()} if isinstance(data, dict) else None

    return text.map(read)


def read_texts(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """Whole files under a folder as (path, content), path relative to the folder.

    Files are listed and read by the executors; large ones are not split.
    """
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    root = (folder if ":/" in folder else os.path.abspath(folder)).rstrip("/") + "/"
    root = re.sub("^file:/*", "/", root)
    full = F.regexp_replace(F.url_decode(F.replace(F.regexp_replace("path", "^file:/*", "/"), F.lit("+"), F.lit("%2B"))), "^/+", "/")
    return df.select(F.substring_index(full, root, -1).alias("path"), F.decode("content", "UTF-8").alias("content"))


def read_notes(spark: SparkSession, folder: str) -> DataFrame:
    """Notes as (path, name, entity_type, entity_uri, fields): type by folder, name by file."""
    raw = read_texts(spark, folder, "*.md")
    name = F.regexp_replace(F.substring_index("path", "/", -1), r"\.md$", "")
    kind = X.folder_type(F.substring_index(F.regexp_extract("path", r"^(.*)/[^/]*$", 1), "/", -1))
    front = F.nullif(F.regexp_extract("content", FRONT_MATTER, 1), F.lit(""))
    return raw.select("path", name.alias("name"), kind.alias("entity_type"), X.entity_uri(name, F.coalesce(kind, F.lit("Concept"))).alias("entity_uri"),
                      yaml_fields(front).alias("fields"))


def read_repository(spark: SparkSession, folder: str, repo: str) -> DataFrame:
    """Readable files of a checked-out repository as (repo, path, content, language)."""
    return readable_files(read_texts(spark, folder, "*").withColumn("repo", F.lit(repo)))


def git_log(lines: DataFrame) -> DataFrame:
    """(path, line) of ``sha|author|date|subject`` log lines as columns; the subject may hold bars."""
    parts = F.split("line", r"\|", 4)
    return lines.select("path", parts[0].alias("sha"), parts[1].alias("author"), parts[2].alias("date"), F.substring(parts[3], 1, 200).alias("message"))


def read_ontology(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a JSON-LD graph as (id, type, label, comment)."""
    text = lambda k: F.coalesce(F.get_json_object("e", f"$['{k}']['@value']"), F.get_json_object("e", f"$['{k}']"))
    raw = spark.read.text(path, wholetext=True)
    each = raw.select(F.explode(F.from_json(F.get_json_object("value", "$['@graph']"), "array<string>")).alias("e"))
    return each.select(text("@id").alias("id"), text("@type").alias("type"), text("rdfs:label").alias("label"), text("rdfs:comment").alias("comment"))


def read_type_definitions(spark: SparkSession, folder: str) -> DataFrame:
    """Entity types from ``schema-*.md`` notes over the built-in ones.

    Key: ``type_key``, else ``label``. A folder claimed by two keys counts for
    neither; built-in types fill the rest.
    """
    raw = read_texts(spark, folder, "schema-*.md").select(yaml_fields(F.regexp_extract("content", FRONT_MATTER, 1)).alias("f")).filter("f IS NOT NULL")
    one = lambda k: F.get(F.element_at("f", k), F.lit(0))
    given = raw.select(F.coalesce(one("type_key"), one("label")).alias("name"), one("folder").alias("folder"),
                       one("similarity_threshold").cast("double").alias("jw"), one("semantic_threshold").cast("double").alias("sem"))
    base = spark.createDataFrame([(t.name, t.folder, t.jw_threshold, t.semantic_threshold) for t in fixed.ENTITY_TYPES], "name string, b_folder string, b_jw double, b_sem double")
    merged = given.filter("name IS NOT NULL").join(F.broadcast(base), "name", "full_outer").select(  # fifteen constant rows
        "name", F.coalesce("folder", "b_folder").alias("folder"), F.coalesce("jw", "b_jw", F.lit(fixed.UNKNOWN_TYPE.jw_threshold)).alias("jw_threshold"),
        F.coalesce("sem", "b_sem", F.lit(fixed.UNKNOWN_TYPE.semantic_threshold)).alias("semantic_threshold")).filter("folder IS NOT NULL")
    clash = merged.groupBy("folder").agg(F.count("*").alias("n")).filter("n > 1")
    return merged.join(clash, "folder", "left_anti")


def table_exists(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(name)
