"""Case tables of the Column functions; each table is one small Spark job."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import numbers as N
from tessera.functions import text as T
from tessera.functions import wikitext as W

EN = N.abbreviated(N.ENGLISH)


def apply(spark, f, inputs):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string")
    return [r["y"] for r in rows.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


CASES = {
    "amount": (N.amount, {"1 000 000": "+1000000", "-0012.50": "-12.50", "−5": "-5", "1'234": "+1234", "1,5": "+15", ".5": None, "x": None, "٣٤": "+34", "": None}),
    "comma": (lambda c: N.amount(c, decimal_comma=True), {"1.234,5": "+1234.5", "2,40": "+2.40", "7": "+7"}),
    "unit_key": (N.unit_key, {"[[Kilogram|Kg.]]": "kg", " M ": "m", "[[Metre]]": "metre"}),
    "split": (lambda c: F.concat_ws("/", N.split_unit(c)["number"], N.split_unit(c)["unit"]), {"2,4 kg": "2,4/kg", "12": "12", "5 [[m]] high": "5/[[m]] high", "none": "none"}),
    "digits": (T.to_ascii_digits, {"١٩٥٠": "1950", "二〇一五年": "2015年", "１２": "12", "abc 1": "abc 1"}),
    "link": (T.link_target, {"[[A|b]] [[C]]": "A", "none": None, "[[A#s]]": None, "[[ x ]]": "x"}),
    "last": (lambda c: T.link_target(c, last=True), {"[[A|b]] [[C]]": "C"}),
    "file": (T.file_name, {"File:a_b.jpg": "A b.jpg", "[[image: x%20y.png|9px]]": "X y.png", "a+b.svg": "A+b.svg", "100%.jpg": "100%.jpg", "nodot": None}),
    "url": (T.url, {"[https://a.org b c]": "https://a.org", " http://x ": "http://x", "ftp://x": None, "https://a b": None}),
    "archived": (T.archived_original, {"https://web.archive.org/web/2015/http://a.org/b": "http://a.org/b", "http://archive.org/web/20150101id_/a.org": "http://a.org", "https://archive.is/x": None}),
    "is_archived": (T.is_archived, {"https://archive.is/x": True, "https://sub.archive.today/x": True, "https://notarchive.is/x": False, "https://a.org/archive.is": False}),
    "title": (T.title, {"paris_ france ": "Paris france", "école": "École", "": ""}),
    "key": (T.db_key, {" main  page": "Main_page"}),
    "list": (lambda c: F.array_join(T.split_list(c), ";"), {"a| b,,c |": "a;b;c", "": ""}),
    "last dollar": (lambda c: T.transform(c, search="b", replacement="$"), {"abc": "a$c"}),
    "group": (lambda c: T.transform(c, search="([0-9])([a-z])", replacement="$2a"), {"1b": "ba"}),
    "cut": (lambda c: T.transform(c, add_prefix="p", add_suffix="s", cut_prefix="px", cut_suffix="ys"), {"xay": "a", "a": "pas"}),
    "mentions": (lambda c: T.mentions(c, F.lit("Q1")), {"a Q1": True, "Q12": False, "Q12 Q1, x": True, "Q1;": True, "": False}),
    "lead": (W.lead_section, {"a\n== b ==\nc": "a\n", "a = b\nc": "a = b\nc", "=x=\na": "", "plain": "plain"}),
    "clean": (W.clean_value, {"[[P|the city]]": "[[P]]", "''a'' b": "a b", "{{x|y}} z": "z", "a{{!}}b": "a", "{{open z": "open z", "?": "", "  many \n  blanks ": "many blanks", "[[a{{!}}b]]": "[[a]]"}),
    "unwrap": (lambda c: W.clean_value(c, True), {"{{u|a.org}}": "a.org", "{{l|x=1|{{n|J}}}}": "J", "{{f}} y": "y"}),
    "param": (lambda c: W.first_of(W.template_params(c, ["Box x"]), ["a", "1"]), {"{{box_x|a= |v}}": "v", "{{Box  x|<nowiki>|}}</nowiki>}}": "<nowiki>|}}</nowiki>", "{{o|{{box x|a=2}}}}": "2", "{{Box x|a=1|a=3}}": "3", "{{Box x|a=1": None, "{{ {{Box x|{{y|a=b}}}}": "{{y|a=b}}", "x": None, "{{Box x<!-- n -->|a=5<ref>z|</ref>}}": "5"}),
    "date": (lambda c: N.shown_date(N.parse_date(c, EN)["date"]), {"4 July 1976": "1976-07-04", "Sept 3, 2001": "2001", "Sep 3rd, 2001": "2001-09-03", "2001-02-29": None, "29.2.2000": "2000-02-29", "3/XI/1999": "1999-11-03", "1999年5月": "1999-05", "Mar 1911": "1911-03", "in 1950 and 1950": "1950", "1950 1960 1950": None, "77": "77", "1850s?": None, "2001/2/3": "2001-02-03", "circa 1900": None, "12 – 5 – 1980": "1980-05-12"}),
    "error": (lambda c: N.parse_date(c, EN)["error"], {"2001-02-29": "invalid date", "1950 1960 1950": "ambiguous date: several years", "circa 1900": "imprecise date", "x": "could not find a date", "4 July 1976": None}),
    "place": (lambda c: F.concat_ws(" ", *(N.parse_coordinate(c)[k].cast("decimal(12,6)") for k in ("latitude", "longitude", "precision"))), {"48.85 2.35": "48.850000 2.350000 0.010000", "48° 30' N 2° 15' W": "48.500000 -2.250000 0.016667", "2 E 48 N": "48.000000 2.000000 1.000000", "-10.5, 20": "-10.500000 20.000000 0.100000", "91 N 2 E": "", "48 61 N 2 0 E": "", "1 2 3": "", "Nice 5 N 6 E": "5.000000 6.000000 1.000000"}),
}


@pytest.mark.parametrize("name", CASES)
def test_table(spark, name):
    f, table = CASES[name]
    assert dict(zip(table, apply(spark, f, list(table)))) == table


def test_limits_and_months(spark):
    date = lambda y, m, d: F.struct(F.lit(y).alias("year"), F.lit(m).alias("month"), F.lit(d).alias("day"))
    tests = [(N.within_limit(date(1926, 0, 0), (1926, 0, 0), True), True), (N.within_limit(date(1582, 10, 0), (1582, 10, 15), False), False), (N.within_limit(date(1582, 9, 0), (1582, 10, 15), False), True), (N.valid_date(F.lit(1700), F.lit(2), F.lit(29), julian=True).isNotNull(), True), (N.valid_date(F.lit(1700), F.lit(2), F.lit(29)).isNotNull(), False)]
    row = spark.range(1).select(*(c.alias(f"c{i}") for i, (c, _) in enumerate(tests))).first()
    assert list(row) == [want for _, want in tests]
    names = N.month_names(spark, ["de", "fr"])
    assert names["de"]["märz"] == 3 and names["fr"]["août"] == 8 and "jui" not in names["fr"]
    with pytest.raises(ValueError):
        T.check_pattern(r"(a)\1")
