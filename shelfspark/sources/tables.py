"""Readers for the input tables (parquet; one folder per table)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from shelfspark.functions.urls import url_host
from shelfspark.session import spread

PAGE_SCHEMA = StructType([
    StructField("page_id", LongType()),
    StructField("url", StringType()),
    StructField("html", StringType()),
])


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def read_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``page(page_id, site, url, html, seq)``; ``site`` is the lower-cased
    host of the URL, ``seq`` the observation order (page id)."""
    pages = spread(read_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return pages.select(
        "page_id",
        url_host("url").alias("site"),
        "url",
        "html",
        F.col("page_id").alias("seq"),
    )


def stream_pages(spark: SparkSession, directory: str) -> DataFrame:
    """Pages arriving as parquet files in ``directory`` (Structured Streaming)."""
    raw = spark.readStream.schema(PAGE_SCHEMA).parquet(directory)
    return raw.select("page_id", url_host("url").alias("site"), "url", "html",
                      F.col("page_id").alias("seq"))


def read_site_profiles(spark: SparkSession, path: str) -> DataFrame:
    """Stored site profiles (JSON, one folder per domain) with an explicit schema."""
    schema = ("domain string, site string, entry_url string, platform_hint string, platform_confidence double, "
              "include_patterns array<string>, preferred_sources array<string>, confidence double")
    return spark.read.schema(schema).json(path)


def site_profile_join(sites: DataFrame, profiles: DataFrame) -> DataFrame:
    """Profile of each site by domain (``www.`` stripped); absent -> NULLs.  Of
    several profiles of one domain the one with the smallest ``site`` counts."""
    own = [c for c in profiles.columns if c not in ("domain", "site")]
    one = profiles.groupBy("domain").agg(F.min_by(F.struct(*own), F.struct("site", *own)).alias("p")).select("domain", "p.*")
    keyed = sites.withColumn("domain", F.regexp_replace("site", r"^www\.", ""))
    return keyed.join(one, "domain", "left")


def config_precedence(rows: DataFrame, keys: dict[str, object], sources=("explicit", "config", "profile")) -> DataFrame:
    """Per key: explicit value, else site config, else stored profile, else the
    default -- ``coalesce`` over ``<source>_<key>`` columns (missing sources
    are NULL)."""
    out = rows
    for key, default in keys.items():
        cols = [F.col(f"{src}_{key}") for src in sources if f"{src}_{key}" in rows.columns]
        out = out.withColumn(key, F.coalesce(*cols, F.lit(default)))
    return out
