"""Inputs of one small file: the work that hangs on their rows is spread over all cores."""

import glob

from conftest import SMOKE_DIR
from pyspark.sql import functions as F

from shelfspark.plans import storefront
from shelfspark.session import dealt
from shelfspark.sources.fixtures import listing_links, product_observations, product_pages
from shelfspark.sources.storefronts import storefront_pages
from shelfspark.streaming import pages as SP

ARRIVING = "page_id long, url string, category string, html string"


def tasks(df):
    return df.select(F.spark_partition_id().alias("t")).distinct().count()


def test_rows_are_dealt_evenly(spark):
    rows = dealt(spark.range(2400).coalesce(1)).groupBy(F.spark_partition_id()).count().collect()
    cores = spark.sparkContext.defaultParallelism
    assert len(rows) >= cores and max(r["count"] for r in rows) <= 2 * 2400 / cores


def test_made_inputs_span_the_cores(spark):
    cores = spark.sparkContext.defaultParallelism
    for make in (product_observations, product_pages, listing_links):
        assert tasks(make(spark, SMOKE_DIR)) >= cores, make.__name__
    assert tasks(storefront_pages(spark, SMOKE_DIR).where("page_id >= 100000000")) >= cores


def test_pages_of_one_file_are_extracted_by_many_tasks(spark, tmp_path):
    pages = product_pages(spark, SMOKE_DIR).select("page_id", "url", "category", "html")
    pages.coalesce(1).write.parquet(f"{tmp_path}/in")
    SP.arriving_products(SP.read_arrivals(spark, f"{tmp_path}/in", ARRIVING), f"{tmp_path}/out").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == pages.count()
    assert len(glob.glob(f"{tmp_path}/out/part-*.parquet")) >= spark.sparkContext.defaultParallelism


def test_pages_that_list_whole_shops_are_not_in_one_file(spark):
    entries = storefront._pages(spark, SMOKE_DIR).where("page_id < 1000")
    assert entries.count() > 10 and entries.select(F.input_file_name()).distinct().count() > 3
