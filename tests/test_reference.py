"""Functions against fixed values, and every query against its SQL on the smallest tables."""

import glob
import os
from difflib import SequenceMatcher

import duckdb
import pytest
from pyspark.sql import functions as F

from offerloom.functions import pricing as P
from offerloom.functions import similarity as M
from offerloom.functions import text as T
from offerloom.operators import filters, joins, ranking
from offerloom.plans import cells, inputs, market, registry, search  # noqa: F401  (they register their queries)
from offerloom.sources import html_tables

SF = "/root/testdata/sf0.001"


def column(spark, values, make, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(make(F.col("x"))).collect()]


def test_name_hash(spark):
    cases = {
        "테스트 상품 123": "af137199ca4c791b", "Test Product ABC": "500adc718571709a", "  공백이   많은   상품  ": "1617dad83d3998c9", "특수문자!@#$%^&*()상품": "9b0441d4ef2918a3",
        "한글과English혼합Product": "5521bb0dc0d63056", "대형 사무용 집게클립": "5acb0fbf5b7af799", "Café Ünï 123": "fb1e807aa8e3b271", "!!!": "", "": "", None: "",
    }
    assert column(spark, list(cases), T.name_hash) == list(cases.values())


def test_file_hash(spark):
    names = ["haereum_1234567890abcdef_12345678.jpg", "kogift_abcdef1234567890.png", "naver_invalidhash.jpg", "1234567890abcdef.jpg", "invalid_filename.jpg", "kogift_ABCDEF1234567890_x.PNG"]
    assert column(spark, names, T.file_hash) == ["1234567890abcdef", "abcdef1234567890", None, "1234567890abcdef", None, "abcdef1234567890"]


def test_text_similarity(spark):
    query = "777쓰리쎄븐 TS-6500C 손톱깎이 13P세트"
    want = {
        "쓰리쎄븐 777 TS-6500C 손톱깎이 세트": (0.724405, 0.666667, 0.807692), "777 쓰리쎄븐 손톱깎이 세트": (0.410417, 0.333333, 0.697674), "쓰리쎄븐 손톱깎이 13P세트": (0.575, 0.333333, 0.714286),
        "TS-6500C 손톱깎이": (0.575, 0.333333, 0.65), "손톱깎이 세트 고급형": (0.14375, 0, 0.368421), "삼성 갤럭시 S22": (0, 0, 0.108108),
    }
    df = spark.createDataFrame([(i, query, c) for i, c in enumerate(want)], "i int, a string, b string")
    a, b = T.clean_text(F.col("a")), T.clean_text(F.col("b"))
    got = df.orderBy("i").select(M.token_similarity(T.name_tokens(F.col("a")), T.name_tokens(F.col("b"))), M.number_score(a, b), M.fuzzy_ratio(a, b)).collect()
    for row, expected in zip(got, want.values()):
        assert list(row) == pytest.approx(expected, abs=1e-6)


def test_percent_and_tax(spark):
    assert column(spark, [5.0, 15.0, 25.0, 35.0, 15593.0], P.with_tax, "double") == [6, 16, 28, 38, 17152]
    rows = [(2970.0, -115.5, -3, -4, -3.9), (17820.0, -968.0, -5, -5, -5.4), (17820.0, -3330.0, -18, -19, -18.7), (1000.0, 45.0, 4, 4, 4.5), (1000.0, -25.0, -2, -2, -2.5)]
    df = spark.createDataFrame([(i, b, b + d) for i, (b, d, *_) in enumerate(rows)], "i int, b double, o double").orderBy("i")
    got = df.select(*[P.percent(F.col("b"), F.col("o"), r) for r in ("trunc", "even", "tenth")]).collect()
    assert [tuple(r) for r in got] == [r[2:] for r in rows]


@pytest.mark.parametrize("mode,want", [("ceil", {100: (200, False), 200: (200, True), 250: (300, False), 600: (500, False)}), ("floor", {100: (200, False), 250: (200, False), 450: (300, False), 600: (500, False)})])
def test_tiers(spark, mode, want):
    t = F.create_map(*[F.lit(x) for x in (200, 100, 300, 90, 500, 80)])
    got = column(spark, list(want), lambda q: P.tier(t, q, mode), "int")
    assert [(r.quantity, r.exact) for r in got] == list(want.values())


def test_image_score(spark):
    rows = {(0.9, 0.8, 0.7, 0.1): 0.94875, (0.7, 0.4, 0.0, 0.0): 0.61985, (0.35, 0.35, 0.2, 0.1): 0.3245, (0.2, 0.15, 0.0, 0.0): 0.1375, (0.05, 0.02, 0.03, 0.0): 0.0352, (0.0, 0.0, 0.0, 0.0): 0.0}
    df = spark.createDataFrame([(i, *k) for i, k in enumerate(rows)], "i int, sift double, akaze double, deep double, orb double")
    got = df.orderBy("i").select(M.image_score(*[F.col(c) for c in ("sift", "akaze", "deep", "orb")])).collect()
    assert [r[0] for r in got] == pytest.approx(list(rows.values()), abs=1e-6)


def test_image_join_by_order(spark):
    products = spark.createDataFrame([(0, "A b"), (1, "a B"), (2, "c")], "ordinal int, product_name string")
    images = spark.createDataFrame([("base", "x.jpg", "a b", 0), ("base", "y.jpg", "c", 1)], "source string, path string, n string, ordinal int")
    images = images.withColumn("product_hash", T.name_hash(F.col("n"))).drop("n")
    assert {(r.ordinal, r.path) for r in joins.one_use_images(products, images).collect()} == {(0, "x.jpg"), (2, "y.jpg")}


def test_best_takes_the_first_of_ties(spark):
    df = spark.createDataFrame([(1, 0.5, 1), (1, 0.9, 3), (1, 0.9, 2), (2, 0.0, 1)], "k int, s double, ordinal int")
    assert [tuple(r) for r in ranking.best(df, ["k"], "s", "ordinal", above=0.0).collect()] == [(1, 0.9, 2)]


def test_filters_on_text_cells(spark):
    rows = [("-", "-", "-", "none found"), ("-115.5", "-3.9", "-", "u"), ("5", "0.2", "-3330", "u")]
    df = spark.createDataFrame(rows, "k_diff string, k_diff_pct string, n_diff string, k_link string").withColumn("n_link", F.lit("v"))
    assert filters.filter_upload(df).count() == 2
    assert [r.k_diff for r in filters.clear_unfavourable(df).collect()] == [None, -115.5, None]
    assert filters.filter_by_difference(df).count() == 2


def test_price_tables():
    page = "<table><tr><th>수량</th><th>단가</th></tr><tr><td>100~199</td><td>1,200원</td></tr><tr><td>200</td><td>1,100</td></tr></table>"
    assert html_tables.tiers_of(page)[0] == {100: 1200, 200: 1100}
    assert html_tables.tiers_of(None)[0] == {}


def test_fuzzy_ratio_query(spark):
    for r in registry.QUERIES["fuzzy_ratio"](spark, SF).collect():
        assert r.ratio == pytest.approx(SequenceMatcher(None, r.a, r.b).ratio())


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    want = con.sql(registry.SQL[name])
    df = registry.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    assert sorted(want.columns) == cols
    text = lambda x: f"{x:.6f}" if isinstance(x, float) else str(x)
    at = [want.columns.index(c) for c in cols]
    assert sorted([text(r[c]) for c in cols] for r in df.collect()) == sorted([text(r[i]) for i in at] for r in want.fetchall())
