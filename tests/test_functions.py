from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from attestia.functions import text as T
from attestia.functions import units as U
from attestia.functions import urls
from attestia.functions.fold import make_fold


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'int' if isinstance(v, int) else 'string'}" for k, v in values.items()))
    return df.select(column).first()[0]


def test_fold_equal_looks():
    fold = make_fold()
    assert fold("ｆｕｌｌ　width") == fold("full width")
    assert fold("o​pe­ned") == "opened"
    assert fold("оpеned") == "opened" and fold("ﬁrst") == "first"
    assert fold("café") == "café"
    assert fold("10²") != fold("102") and fold("①") != fold("1") and fold("Straße") != fold("Strasse") and fold("A") != fold("a")


def test_terms(spark):
    assert one(spark, T.terms(F.col("x")), x="The Atlas-900 of 北京大学 and the atlas-900, 3.5% 的") == ["atlas-900", "北京", "京大", "大学", "3.5%"]
    assert one(spark, T.terms(F.lit(None).cast("string")), x="a") == []


def test_utf16(spark):
    assert one(spark, T.utf16_length(F.col("x")), x="😀甲") == 3
    cut = lambda a, b: one(spark, T.utf16_slice(F.col("x"), F.lit(a), F.lit(b)), x="😀甲乙")
    assert cut(2, 3) == "甲" and cut(0, 2) == "😀" and cut(0, 1) is None and cut(1, 3) is None and cut(2, 2) is None and cut(0, 9) is None


def test_markup_doi_year(spark):
    assert one(spark, T.plain("x"), x="## **Bold** [link](http://a) and `code`") == "Bold link and code"
    assert one(spark, T.normal_doi(F.col("x")), x="https://doi.org/10.1234/AbC.5).") == "10.1234/abc.5"
    assert one(spark, T.normal_doi(F.col("x")), x="none") is None
    assert one(spark, T.year_of(F.col("x")), x="c. 1987/88") == 1987
    assert one(spark, T.nfkc("x"), x="ﬁ①") == "fi1"


def test_urls(spark):
    h = urls.host(F.col("x"))
    assert one(spark, h, x="HTTPS://user@News.Example.co.uk:443/a?b#c") == "news.example.co.uk"
    assert one(spark, urls.site(h), x="https://news.example.co.uk/") == "example.co.uk"
    for url, kind in (("https://www.gov.cn/x", "official"), ("https://blog.sciencenet.cn/", "community"), ("https://x.com", "social"), ("https://netflix.com", "unknown"), ("", "unknown")):
        assert one(spark, urls.source_kind(h), x=url) == kind
    for url, ok in (("http://a.example/x", True), ("ftp://a.example", False), ("http://10.0.0.1/", False), ("http://localhost", False), ("http://u:p@a.example", False), ("http://a.example:8080", False), ("http://metadata.azure.com/", False), ("http://100.100.100.200", False), ("http://198.18.0.1/", False), ("http://192.0.2.7", False), ("http://[2606:4700::1111]/", True), ("http://[::1]/", False), ("http://[fe80::1]", False), ("http://a.example./x", True), ("http://a.exa\x07mple", False)):
        assert one(spark, urls.valid_url(F.col("x")), x=url) is ok
    assert one(spark, urls.normal_url(F.col("x")), x="HTTP://A.example#top") == "http://a.example/"


def test_conversions_agree_and_conflicts_are_found():
    ways = U.conversions({"length": "millimetre", "temperature": "degree Celsius"})
    assert ways["mile"][1] == Fraction("1609344") and ways["kelvin"][1:] == (1, Fraction("-273.15"))
    d, f, o = ways["degree Fahrenheit"]
    assert f * 212 + o == 100
    with pytest.raises(ValueError):
        U.conversions({"length": "millimetre"}, U.EDGES + [("mile", "kilometre", "2", "0")])


@pytest.mark.parametrize("text,found", [
    ("It is 9 ft 5 in long.", [("inch", 113)]), ("26–40 knots", [("knot", 26), ("knot", 40)]), ("Die Pumpe verbrauchte 1.234,5 Kilojoule und", [("kilojoule", 1234.5)]),
    ("paid CN¥84.4m for the", [("yuan", 84_400_000)]), ("总投资8,765万元。", [("yuan", 87_650_000)]), ("消耗七百三十七度电", [("kilowatt-hour", 737)]), ("温度为零下12摄氏度", [("degree Celsius", -12)]),
    ("two hundred and fifty-eight kWh", [("kilowatt-hour", 258)]), ("7½ knots", [("knot", 7.5)]), ("Height (m) of the quarry at N: 399.", [("metre", 399)]),
    ("Version 6.0.60 at 4 p.m. in 1990 for 3 men", []), ("", []), (None, []), ("used 3 000 kilоwatt-hours", [("kilowatt-hour", 3000)]),
])
def test_amounts(text, found):
    assert [(u, float(v)) for u, v in U.make_finder()(text)] == [(u, float(v)) for u, v in found]


@pytest.mark.parametrize("text, unit", [("Die Brücke ist sechs Meter lang.", "metre"), ("Der Sack wiegt sieben Kilogramm.", "kilogram"), ("半公斤", "kilogram"), ("Er trank tausend Liter.", "litre"), ("Das Gleis misst 3 Fuß, der Tank fasst tausend Liter.", "litre"), ("A reel of ninе metres", "metre")])
def test_amounts_in_number_words_alone(text, unit):
    assert unit in [u for u, _ in U.make_finder()(text)]


def test_texts_passed_over_have_no_amount():
    names = {"en": ("metres", U._EN, ["two hundred", "one thousand"]), "de": ("Meter", U._DE, ["hundert", "tausend", "zweihundert", "tausendsechs"]), "zh": ("米", U._ZH, [*"十百千万亿半", "三百", "百万"])}
    spelled, maybe, begin, amount, *_ = U._patterns()
    find = U.make_finder()
    for lang, (unit, words, more) in names.items():
        for w in [*words, *more]:
            text = w + ("" if lang == "zh" else " ") + unit
            assert maybe.search(text), text
            assert find(text) or w in ("百", "千", "万", "亿"), text
