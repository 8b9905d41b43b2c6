"""New links of arriving pages: each once, and state that does not grow."""

import datetime

from shelfspark.streaming import pages as SP

SCHEMA = "page_id long, site string, url string, html string, seq long, seen_at timestamp"


def page(n, day, paths):
    html = "".join(f'<a href="{p}">t</a>' for p in paths)
    return (n, "a.test", f"https://a.test/{n}", html, n, datetime.datetime(2024, 1, 1) + datetime.timedelta(days=day))


def arrive(spark, folder, batches):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/f{i}")


def run(spark, root, batches, horizon):
    arrive(spark, f"{root}/in", batches)
    arriving = SP.read_arrivals(spark, f"{root}/in/*", SCHEMA)
    query = SP.new_links(arriving, f"{root}/out", horizon)
    query.awaitTermination()
    return spark.read.parquet(f"{root}/out").collect(), [p.stateOperators[0].numRowsTotal for p in query.recentProgress if p.stateOperators]


def test_each_link_once_whatever_the_order_of_files(spark, tmp_path):
    batches = [[page(3, 5, ["/x", "/y"]), page(4, 6, ["/x#top", "/z?utm_source=q"])], [page(1, 1, ["/y", "/w"])], [page(2, 3, ["/w", "/z", "/x"])]]
    rows, _ = run(spark, str(tmp_path), batches, "30 days")
    assert sorted((r.site, r.url) for r in rows) == [("a.test", f"https://a.test/{p}") for p in "wxyz"]


def test_state_stays_level(spark, tmp_path):
    batches = [[page(d, d, [f"/new{d}-{i}" for i in range(5)] + ["/always"])] for d in range(0, 40, 4)] + [[page(99, 44, ["/new0-0"])]]
    rows, state = run(spark, str(tmp_path), batches, "3 days")
    urls = [r.url for r in rows]
    assert urls.count("https://a.test/new0-0") == 2  # forgotten after the horizon, so new again
    assert len(set(urls)) == 51
    assert max(state) <= 24 and state[-1] <= 24  # of 61 links seen
