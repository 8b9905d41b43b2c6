import glob
import os
import xml.etree.ElementTree as ET

import __spark_entry__ as entry
from shelfspark.plans import registry as R
from shelfspark.sources import sinks as K
from shelfspark.streaming.merge import fresh_root

from conftest import SMOKE_DIR


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.columns == ["page_id", "rank", "url", "text", "score"]
    assert df.count() >= 0


def test_every_query_has_a_builder_and_most_an_oracle():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 60


def test_catalog_xml_is_well_formed(spark):
    products = R._merged(spark, SMOKE_DIR)
    root = fresh_root(spark, "xml-test")
    out = K.write_b2c(products, root)
    for kind, path in out.items():
        sites = glob.glob(os.path.join(path.replace("file:", ""), "site=*"))
        assert sites, kind
        for site_dir in sites[:3]:
            parts = sorted(glob.glob(os.path.join(site_dir, "part-*")))
            text = "\n".join(open(p, encoding="utf-8").read() for p in parts)
            doc = ET.fromstring(text.encode("utf-8"))
            assert doc.tag.endswith(kind.rstrip("s") if kind != "pricebooks" else "pricebooks")


def test_streaming_merge_equals_batch(spark):
    batch = R.q_merge_products(spark, SMOKE_DIR)
    streamed = R.q_stream_merge_products(spark, SMOKE_DIR)
    assert sorted(batch.collect()) == sorted(streamed.select(*batch.columns).collect())
