"""Catalogue, manifest and registry documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

DIFF = "struct<characteristic:string,difficulty:string,nps:double,ne:boolean,me:boolean,chroma:boolean>"
CATALOGUE_SCHEMA = (
    "id string, name string, automapper boolean, declaredAi string, uploaded string, tags array<string>, uploader struct<id:bigint,name:string>, "
    f"stats struct<score:double,upvotes:bigint,downvotes:bigint>, versions array<struct<hash:string,diffs:array<{DIFF}>>>"
)
ENTRY = (
    "struct<category:string,requirements:array<string>,suggestions:array<string>,genre_tags:array<string>,genre:string,downloaded_at:string,"
    "hash:string,name:string,uploaded:string,uploader:string,score:double,ranked:boolean,tags:array<string>>"
)
REGISTRY_SCHEMA = (
    "mappers array<struct<display_name:string,mapper_id:bigint,user_name:string>>, style_buckets array<struct<bucket_id:string,mapper_ids:array<string>>>"
)


def read_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """Fetched result pages (``{"docs": [...]}``), one row per document."""
    page = spark.read.schema(f"docs array<struct<{', '.join(_fields(CATALOGUE_SCHEMA))}>>").option("multiLine", True).json(path)
    return page.select(F.inline("docs"))


def parse_catalogue(docs: DataFrame) -> DataFrame:
    """Catalogue documents held as JSON text, one per row."""
    return docs.select(F.from_json("text", CATALOGUE_SCHEMA).alias("d")).where("d is not null").select("d.*")


def _fields(schema: str) -> list[str]:
    """Top-level fields of a DDL string in struct notation."""
    out, depth, cur = [], 0, ""
    for ch in schema:
        depth += (ch == "<") - (ch == ">")
        if ch == "," and depth == 0:
            out.append(cur)
            cur = ""
        else:
            cur += ch
    return [f.strip().replace(" ", ":", 1) for f in [*out, cur]]


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Manifest files: a JSON object keyed by map id. Missing or broken files give no rows."""
    return parse_manifest(spark.read.option("wholetext", True).option("ignoreMissingFiles", True).text(path).withColumnRenamed("value", "text"))


def parse_manifest(texts: DataFrame) -> DataFrame:
    m = texts.select(F.explode(F.from_json("text", f"map<string,{ENTRY}>")).alias("map_id", "e"))
    return m.where("e is not null").select("map_id", "e.*")


def read_registry(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Mapper registry file: mappers, and (bucket, display name) memberships."""
    r = spark.read.schema(REGISTRY_SCHEMA).option("multiLine", True).json(path)
    b = r.select(F.inline("style_buckets")).select("bucket_id", F.explode("mapper_ids").alias("display_name"))
    return r.select(F.inline("mappers")), b


def optional_table(spark: SparkSession, path: str) -> DataFrame | None:
    """A sidecar table, or None where it does not exist."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":  # no rights, a broken schema: not for us to hide
            raise
        return None
