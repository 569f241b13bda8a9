"""Column helpers and tail probabilities."""

import math

import pytest
from pyspark.sql import functions as F

from quadrat.functions import columns as C
from quadrat.functions.special import chi2_tail, erfc, normal_cdf, normal_tail


def test_erfc_matches_the_library(spark):
    xs = [i / 16 for i in range(-112, 113)] + [10.0, 26.0, 30.0]
    rows = spark.createDataFrame([(x,) for x in xs], "x double").select("x", erfc(F.col("x")).alias("y")).collect()
    for x, y in rows:
        assert y == pytest.approx(math.erfc(x), rel=1e-13, abs=1e-300)


def test_normal_tails_add_up(spark):
    rows = spark.createDataFrame([(z / 4,) for z in range(-20, 21)], "z double").select(
        (normal_tail(F.col("z")) + normal_cdf(F.col("z"))).alias("s")).collect()
    assert all(r.s == pytest.approx(1.0, abs=1e-14) for r in rows)


def test_chi_square_tail(spark):
    def brute(h, df, steps=200_000):  # midpoint rule on the density above h
        top = h + 200.0
        w = (top - h) / steps
        c = 1 / (2 ** (df / 2) * math.gamma(df / 2))
        return sum(c * x ** (df / 2 - 1) * math.exp(-x / 2) for x in (h + (i + 0.5) * w for i in range(steps))) * w
    cases = [(3.0, 2), (5.0, 3), (7.5, 4), (2.0, 1), (12.0, 5), (0.5, 6)]
    rows = spark.createDataFrame(cases, "h double, df int").select("h", "df", chi2_tail(F.col("h"), F.col("df")).alias("p")).collect()
    for h, df, p in rows:
        assert p == pytest.approx(brute(h, df), rel=2e-4)
    none = spark.createDataFrame([(None, 2), (1.0, 0)], "h double, df int").select(chi2_tail(F.col("h"), F.col("df"))).collect()
    assert [r[0] for r in none] == [None, None]


def test_levels_lookup_and_days(spark):
    df = spark.createDataFrame([("0dpi",), ("6_months",), ("other",), (None,)], "t string")
    rows = C.ordered_levels(df, "t", ["0dpi", "6_months"], ["start", "end"]).collect()
    assert [(r.t, r.t_ord) for r in rows] == [("start", 1), ("end", 2), (None, None), (None, None)]
    days = [r[0] for r in df.select(C.day_number(F.col("t"))).collect()]
    assert days == [0.0, 180.0, None, None]


def test_terms_blank_cells_and_prefixes(spark):
    df = spark.createDataFrame([("a SusC gene", "x"), ("nothing", None), (None, "susd and SUSC")], "u string, v string")
    found = [r[0] for r in df.select(C.matched_terms(["u", "v"], ["susC", "susD"])).collect()]
    assert found == ["susC", None, "susC, susD"]
    hits = [r[0] for r in df.select(C.any_column_matches(["u", "v"], "susd|gene")).collect()]
    assert hits == [True, False, True]
    tax = spark.createDataFrame([("p__Firm p__x", "")], "phylum string, genus string")
    row = C.label_blank(C.strip_rank_prefixes(tax), ["phylum", "genus"]).head()
    assert (row.phylum, row.genus) == ("Firm p__x", "Unclassified genus")


def test_ratio_and_stars(spark):
    df = spark.createDataFrame([(0.0, 0.0), (1.0, 4.0)], "a double, b double")
    assert [r[0] for r in df.select(C.ratio(F.col("a"), F.col("b"))).collect()] == [None, 0.25]
    ps = spark.createDataFrame([(1e-5,), (1e-3,), (0.01,), (0.05,), (0.06,), (None,)], "p double")
    assert [r[0] for r in ps.select(C.p_symbol(F.col("p"))).collect()] == ["****", "***", "**", "*", "ns", None]


def test_names(spark):
    df = spark.createDataFrame([(1, 2)], "`Bin Id` int, `x%y` int")
    assert C.clean_names(df).columns == ["Bin.Id", "x.y"]
    assert C.columns_containing(df, ["BIN"]) == ["Bin Id"]
