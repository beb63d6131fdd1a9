import html

from pyspark.sql import functions as F

from doclake.functions.entities import unescape

TEXTS = ["R&amp;D", "&amp;lt;", "a & b", "&notit;", "&not it", "&ampfoo", "&#65;&#x41;&#128;&#0;&#13;",
         "&#xD800;&#x110000;&#99999999999999999999;", "&#x1F600; z", "&#1;x&#x7f;&#xfdd0;&#x1ffff;",
         "&AMP;&copy;&copy &middot;&nbsp;&NotEqualTilde;&acE;", "&unknown; &;&&amp", "&#;&#x;", "&#x00041",
         "&#000000000065;", "&quot", "", "&xyzzy&lt", "&hearts;&hearts"]


def test_matches_the_standard_library(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "i int, t string")
    got = [r[0] for r in df.orderBy("i").select(unescape(F.col("t"))).collect()]
    assert got == [html.unescape(t) for t in TEXTS]


def test_every_name(spark):
    from html.entities import html5
    names = [f"x&{n} y" for n in sorted(html5)]
    df = spark.createDataFrame([(n,) for n in names], "t string").repartition(8)
    for row in df.select("t", unescape(F.col("t")).alias("u")).collect():
        assert row.u == html.unescape(row.t), row.t
