"""Pages arriving as a stream: new links, and products as they come in.

``new_links`` emits each link of a site once.  Its keyed state expires: a link is
remembered for `horizon` of event time after it was seen, so that state holds the
links of that span and not of all time.  A link that comes again later is emitted
again; pages that are later than the horizon are left out.

``arriving_products`` is stateless: every page is extracted where it is read, and
its product appended; ``products.merge_products`` or the merge of ``streaming.merge``
folds them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from shelfspark.operators.extract import extract_products
from shelfspark.operators.links import page_links
from shelfspark.session import dealt


def read_arrivals(spark: SparkSession, folder: str, schema: str, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def _append(stream: DataFrame, out: str) -> StreamingQuery:
    return (stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}_checkpoint")
            .trigger(availableNow=True).start())


def new_links(pages: DataFrame, out: str, horizon: str) -> StreamingQuery:
    """``page(page_id, site, url, html, seq, seen_at)`` -> ``(site, url, seen_at)`` below
    `out`, each link once within `horizon`."""
    timed = pages.withWatermark("seen_at", horizon)
    links = page_links(dealt(timed), extra=("seen_at",)).select("site", "seen_at", F.explode("links").alias("l")).select("site", "l.url", "seen_at")
    return _append(links.dropDuplicatesWithinWatermark(["site", "url"]), out)


def arriving_products(pages: DataFrame, out: str) -> StreamingQuery:
    """``page(page_id, url, category, html)`` -> canonical products below `out`."""
    return _append(extract_products(dealt(pages)), out)
