"""Character references against the standard library's decoder."""

import html
import random
from html.entities import html5

from pyspark.sql import functions as F

from fieldmark.functions import text
from fieldmark.functions.references import decoded


def test_every_reference(spark):
    rng = random.Random(2)
    names = sorted(html5)
    texts = [f"a&{n} b" for n in names] + [f"&{n}x" for n in names] + [f"&{n};" for n in names]
    texts += [f"x&#{n};y&#{n} &#x{n:x};&#X{n:X}z" for n in [*range(0, 300), 0xD7FF, 0xD800, 0xDFFF, 0xFDD0, 0xFFFD, 0xFFFE, 0xFFFF, 0x1F600, 0x1FFFE, 0x10FFFD, 0x10FFFF, 0x110000, 10**9, 10**20]]
    texts += ["", "&", "&&", "& ;", "&;", "&#;", "&#x;", "&#xg;", "&unknown;", "&notit;", "&notin;", "&eacute", "&eacutex", "&amp;lt;", "&ampamp;", "&#0000000000065;", "no reference", "é & è &eacute; &#8217;s &#x2019;s", None]
    texts += ["".join(rng.choice(["&", "#", "x", "12", "65;", "amp", "lt;", ";", "a", " ", "eacute", "not"]) for _ in range(12)) for _ in range(500)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", decoded(F.col("t")).alias("t"))
    got = {r.i: r.t for r in df.collect()}
    bad = [(t, got[i], html.unescape(t)) for i, t in enumerate(texts) if t is not None and got[i] != html.unescape(t)]
    assert not bad, bad[:10]
    assert got[len(texts) - 501] is None


def test_a_mark_of_byte_order_is_a_character(spark):
    texts = ["a&#65279;b", "&#xFEFF;", "&#xfeff;&#65279;c", "&#65534;&#65280;"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r.u for r in df.select(decoded(F.col("t")).alias("u")).collect()] == [html.unescape(t) for t in texts]


def test_pages_and_quotes(spark):
    df = spark.createDataFrame([("<p>Caf&eacute;&nbsp;&#8211; it&rsquo;s&#x2019; <b>1&middot;5</b> &lt;b&gt; &bogus;</p>",)], "t string")
    assert df.select(text.html_to_text(F.col("t"))).first()[0] == "Café – it’s’ 1·5 <b> &bogus;"
    assert df.select(text.contains(text.html_to_text(F.col("t")), F.lit("cafe - it's' 1.5"))).first()[0]
    assert spark.range(1).select(text.contains(F.lit("Caf&eacute; &amp; more"), F.lit("CAFÉ & more"))).first()[0]
