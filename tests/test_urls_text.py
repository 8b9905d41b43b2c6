from pyspark.sql import functions as F

from shelfspark.functions import text as T
from shelfspark.functions import urls as U
from shelfspark.operators.products import parse_price


def _resolve(spark, pairs):
    df = spark.createDataFrame(pairs, ["href", "base"])
    df = df.withColumn("b", U.base_parts("base"))
    return [r[0] for r in df.select(U.absolute_url("href", "b")).collect()]


def test_absolute_url_resolution(spark):
    got = _resolve(spark, [
        ("/The", "https://Shop.Example.com/en/25#top"),
        ("/für", "http://a.example.com/x?y=1"),
        ("../p/1", "https://shop.example.com/c/eco?page=2"),
        ("?page=2", "https://shop.example.com/c/eco?page=1"),
        ("//cdn.example.com/i.jpg", "https://shop.example.com/"),
        ("/p/1?utm_source=x&b=c d", "https://shop.example.com/"),
        ("/p/2?utm_source=x", "https://shop.example.com:443/"),
        ("mailto:a@b.c", "https://shop.example.com/"),
        ("./a/./b/../c", "https://shop.example.com/x/y"),
    ])
    assert got == [
        "https://shop.example.com/The",
        "http://a.example.com/f%C3%BCr",
        "https://shop.example.com/p/1",
        "https://shop.example.com/c/eco?page=2",
        "https://cdn.example.com/i.jpg",
        "https://shop.example.com/p/1?b=c+d",
        "https://shop.example.com/p/2",
        "mailto:a@b.c",
        "https://shop.example.com/x/a/c",
    ]


def test_text_functions(spark):
    df = spark.createDataFrame([("  Zapatos de   Mujér  ",), ("Ünïcödé & <b>x</b>",)], ["t"])
    got = df.select(T.normalize_whitespace("t"), T.fold_text("t"), T.slugify("t"),
                    T.strip_html_tags("t")).collect()
    assert got[0][0] == "Zapatos de Mujér"
    assert got[0][1] == "zapatos de mujer"
    assert got[0][2] == "zapatos-de-mujer"
    assert got[1][2] == "unicode-b-x-b"
    assert got[1][3] == "Ünïcödé &  x "


def test_parse_price(spark):
    cases = {"129,99 EUR": "129.99", "$1,299.00": "1299.00", "1.234": "1.23", "1,299": "1.30",
             "Rs. 1,299.00": "0.13", "on request": "", "": "", "1.234,56 EUR": "1234.56"}
    df = spark.createDataFrame([(k,) for k in cases], ["p"])
    got = {r[0]: r[1] for r in df.select("p", parse_price("p")).collect()}
    assert got == cases


def test_clean_url_reserialises_only_when_tracking_removed(spark):
    df = spark.createDataFrame([("https://a.com/p?x=a/b&utm_medium=m",), ("https://a.com/p?x=a/b#f",)], ["u"])
    got = [r[0] for r in df.select(U.clean_url("u")).collect()]
    assert got == ["https://a.com/p?x=a%2Fb", "https://a.com/p?x=a/b"]
