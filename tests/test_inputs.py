"""Literal cells, pages, workbooks, files by age, counted and paired writes."""

import ast
import glob
import json
import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from offerloom import schema as S
from offerloom.functions import literals as L
from offerloom.operators import filters, images
from offerloom.plans import inputs, registry
from offerloom.sinks import both_tables, counted_write, read_pair, result_table, upload_table, write_pair
from offerloom.sources import html_tables, readers, tier_function, workbooks

CELLS = [
    "{'url': 'http://a/b', 'n': None, 3: 4.5}", """{"a": "it's", 'b': 'say "hi"'}""", "{'a': 'O\\'Neil', 'b': [1, (2, 3,), {'c': True}],}", "(1,)", "[]", "{}", "'x'", "None", "{'a': .5, 'b': 5., 'c': +7, 'd': -1e5, 'e': -3, 'f': 1.E3}",
    r"{'p': 'c:\\dir\\new', 't': 'a\tb', 'x': '\x41\u00e9', 'l': 'a\nb'}", "{1.5: 'a', True: 'b', None: 2, (1): 3}"[:-8] + "}", "{'None': 'None is True', 'k': 'a: b, {c}, [d]'}", "{'a': '한글 \"인용\"', 'b': ''}", "{'a': '1\t2'}", "  { 'a' :\n 1 }  ".strip(), "{'deep': {'er': {'est': [[], [{}], ()]}}}",
]
BAD = ["{'a': 1", "{1, 2}", "hello world", "{'a' 1}", "b'x'", "", "  ", "{'a': foo}", "{'a': 'x' 'y'}", "http://a.b/c", "{'a': \'\'\'x\'\'\'}", "{'a': 1}}", "{'a': 1} 5", "1, 2", "'open", None]


def plain(v):
    if isinstance(v, dict):
        return {k if isinstance(k, str) else str(k): plain(x) for k, x in v.items()}
    return [plain(x) for x in v] if isinstance(v, (list, tuple)) else v


def test_literals(spark):
    df = spark.createDataFrame(list(enumerate(CELLS + BAD)), "i int, c string")
    got = {r.i: r.j for r in df.select("i", L.literal_json(F.col("c")).alias("j")).collect()}
    for i, c in enumerate(CELLS):
        assert json.loads(got[i]) == plain(ast.literal_eval(c)), c
    assert {got[i] for i in range(len(CELLS), len(CELLS) + len(BAD))} == {None}
    assert spark.range(1).select(L.literal_json(F.lit("{'a': np.float64(1.5), 'b': [np.int64(3)], np.int32(4): nan}"))).first()[0] == '{"a":1.5,"b":[3],"4":null}'
    v = df.filter("i = 2").select(F.try_variant_get(L.literal_variant(F.col("c")), "$.b[1][0]", "int"), L.literal_map(F.col("c"))).first()
    assert tuple(v) == (2, {"a": "O'Neil", "b": '[1,[2,3],{"c":true}]'})


def test_a_cell_is_lexed_once(spark):
    """However many tokens a cell has and however often its parts are asked for; and a long text in it is no deep recursion."""
    long = {str(i): ["x" * 10, i] for i in range(2000)} | {"long": "y\\'" * 30000}
    df = spark.createDataFrame([(repr(long),)], "c string")
    for made in (L.literal_json(F.col("c")), L.literal_map(F.col("c")), images.as_image(F.col("c"), "base")["url"]):
        assert df.select(made.alias("x"))._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1
    assert json.loads(df.select(L.literal_json(F.col("c"))).first()[0]) == long


def test_tiers_of_cells_are_read_once(spark):
    df = inputs.tiers_of_cells(spark, "/root/testdata/sf0.001")
    assert df._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1


def test_per_row_work_is_spread(spark):
    """One small file is read by one task; what is done for each row isn't."""
    for name in ("literal_cells", "tiers_of_cells", "image_cells", "flat_images", "price_tier_rows"):
        df = registry.QUERIES[name](spark, "/root/testdata/sf0.001")
        assert df.select(F.spark_partition_id()).distinct().count() > 1, name


def test_detectors(spark):
    both = "<table><tr><td>a</td><td>b</td></tr><tr><td>130</td><td>900원</td></tr></table><table><tr><th>수량</th><th>단가</th></tr><tr><td>100~199</td><td>1,205원</td></tr></table> 부가세별도"
    pages = spark.createDataFrame([(1, both), (2, "x"), (3, None), (4, "<table><tr><td>수량</table>")], "page_id long, html string")
    assert [tuple(r) for r in tier_function.tier_rows(pages, "page_id").collect()] == [(1, "by_head", True, 0, 100, 1205, 1326)]
    rows = {(r.detector, r.quantity, r.price) for r in tier_function.detected_rows(pages, "page_id").collect()}
    assert rows == {("by_head", 100, 1205), ("by_first_columns", 100, 1205)}  # tables that look more like price tables go first
    assert [d for d, _ in html_tables.all_detectors(both)] == ["by_head", "by_first_columns"]


ODD = [(i, f"이름 <{i}> & \"q\" 'a'\n x\t", i * 1.5 if i % 3 else None, None if i % 4 else f"r\r{i}") for i in range(50)]


def test_workbooks_round_trip(spark, tmp_path):
    workbooks.register(spark)
    path = str(tmp_path / "books")
    df = spark.createDataFrame(ODD, "id long, name string, p double, o string")
    df.repartition(3).write.format("workbook").mode("append").save(path)
    assert len(glob.glob(f"{path}/part-*.xlsx")) == len(os.listdir(path)) == 3
    read = spark.read.format("workbook").load(path)
    assert read.columns == ["id", "name", "p", "o", "_file", "_sheet", "_row"] and read.rdd.getNumPartitions() == 3
    assert sorted((int(r.id), r.name, None if r.p is None else float(r.p), r.o) for r in read.collect()) == ODD
    assert readers.read_xlsx(spark, path).count() == 50
    df.filter("id < 7").coalesce(1).write.format("workbook").mode("overwrite").option("sheet", "a & b").save(path)
    assert len(os.listdir(path)) == 1
    some = spark.read.format("workbook").schema("name string, absent string, _sheet string").load(f"{path}/*.xlsx").collect()
    assert sorted(r.name for r in some) == sorted(x[1] for x in ODD[:7]) and {(r.absent, r._sheet) for r in some} == {(None, "a & b")}
    df.limit(0).write.format("workbook").mode("append").save(str(tmp_path / "none"))


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    workbooks.register(spark)
    path = str(tmp_path / "books")
    df = spark.createDataFrame(ODD, "id long, name string, p double, o string")
    df.coalesce(1).write.format("workbook").mode("append").save(path)
    before = os.listdir(path)
    bad = df.withColumn("name", F.when(F.col("id") == 49, F.raise_error(F.lit("no"))).otherwise(F.col("name"))).repartition(4)
    for mode in ("append", "overwrite"):
        with pytest.raises(Exception, match="no"):
            bad.write.format("workbook").mode(mode).save(path)
        assert os.listdir(path) == before


def test_sheets_are_partitions(spark, tmp_path):
    """A workbook of two sheets, one with shared strings, rows and cells left out."""
    import zipfile

    workbooks.register(spark)
    main, rel = workbooks.MAIN[1:-1], "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(tmp_path / "two.xlsx", "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="One" sheetId="1" r:id="a"/><sheet name="Two" sheetId="2" r:id="b"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="b" Target="/xl/worksheets/x2.xml"/><Relationship Id="a" Target="worksheets/x1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}"><si><t> name </t></si><si><r><t>ri</t></r><r><t>ch</t></r></si></sst>')
        z.writestr("xl/worksheets/x1.xml", f'<worksheet xmlns="{main}"><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>qty</t></is></c></row><row r="2"><c r="A2" t="s"><v>1</v></c></row><row r="9"><c r="C9"><v>7</v></c></row></sheetData></worksheet>')
        z.writestr("xl/worksheets/x2.xml", f'<worksheet xmlns="{main}"><sheetData><row><c t="inlineStr"><is><t>qty</t></is></c></row><row><c><v>8</v></c></row></sheetData></worksheet>')
    (tmp_path / "~$two.xlsx").write_bytes(b"lock")
    first = spark.read.format("workbook").load(str(tmp_path))
    assert [(r.name, r.qty, r._sheet) for r in first.collect()] == [("rich", None, "One"), (None, "7", "One")]
    every = spark.read.format("workbook").option("sheet", "*").load(str(tmp_path))
    assert every.rdd.getNumPartitions() == 2 and sorted((r._sheet, r.qty or "") for r in every.collect()) == [("One", ""), ("One", "7"), ("Two", "8")]
    assert spark.read.format("workbook").option("sheet", "Two").load(str(tmp_path)).select("qty").first()[0] == "8"


def test_search_results(spark, tmp_path):
    workbooks.register(spark)
    items = lambda n, k: [{"title": f"{k}-{i}", "link": "l", "lprice": i} for i in range(n)]
    pages = [{"query": "a", "page": 1, "total": 9, "items": items(3, "a1")}, {"query": "a", "page": 2, "items": items(2, "a2")}, {"query": "a", "page": 3, "items": items(3, "a3")}, {"query": "b", "page": 1, "items": items(3, "b1")}, {"query": "b", "page": 2, "error": "x"}, {"query": "b", "page": 3, "items": items(3, "b3")}]
    (tmp_path / "one.jsonl").write_text("\n".join(map(json.dumps, pages)))
    (tmp_path / "two.jsonl").write_text(json.dumps({"query": "c", "page": 1, "items": items(3, "c1")}) + "\n\n" + json.dumps({"query": "c", "page": 2, "items": items(3, "c2")}))
    df = spark.read.format("search_results").option("pageSize", 3).option("maxItems", 4).load(str(tmp_path))
    got = sorted((r.query, r.ordinal, r.title, r.price) for r in df.collect())
    want = [("a", 0, "a1-0", "0"), ("a", 1, "a1-1", "1"), ("a", 2, "a1-2", "2"), ("a", 3, "a2-0", "0"), ("b", 0, "b1-0", "0"), ("b", 1, "b1-1", "1"), ("b", 2, "b1-2", "2"), *[("c", i, f"c1-{i}", str(i)) for i in range(3)], ("c", 3, "c2-0", "0")]
    assert got == want and df.rdd.getNumPartitions() == 2


def test_old_files_are_not_opened(spark, tmp_path):
    """A broken file fails a scan; one that its age, size or name rules out does not."""
    path = str(tmp_path / "f")
    spark.range(5).coalesce(1).write.parquet(path)
    for name, when in (("old.parquet", 10**9), ("other.parquet", None), ("~$lock.parquet", None)):
        with open(f"{path}/{name}", "wb") as f:
            f.write(b"no parquet at all")
        if when:
            os.utime(f"{path}/{name}", (when, when))
    df = spark.read.schema("id long").parquet(path)
    assert readers.recent(df, after="2010-01-01 00:00:00", name="^part-").count() == 5
    assert readers.last_days(df, 3, least_bytes=100).select("id", "file").filter("file LIKE 'part-%'").count() == 5
    assert readers.recent(df, before="2000-01-01 00:00:00").count() == 0
    with pytest.raises(Exception):
        readers.recent(df, after="2000-01-01 00:00:00").count()
    plan = readers.recent(df, after="2010-01-01 00:00:00")._jdf.queryExecution().executedPlan().toString()
    assert "DataFilters" in plan and "file_modification_time" in plan.split("DataFilters")[1]


def test_counts_of_the_same_pass(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    df = spark.range(100).mapInArrow(count, "id long")
    got = counted_write(df, lambda d: d.write.parquet(str(tmp_path / "x")), {"even": F.col("id") % 2 == 0, "null": F.col("id").isNull(), "low": F.col("id") < 7})
    assert got == {"rows": 100, "even": 50, "null": 0, "low": 7} and seen.value == 100


def test_pair(spark, tmp_path):
    rows = [(f"p{i}", i, 100.0 + i, None if i % 2 else -5.0 * i, "http://k/1" if i % 3 else "") for i in range(9)]
    df = spark.createDataFrame(rows, "product_name string, base_qty int, base_price double, k_diff double, k_link string")
    at = datetime(2024, 1, 2, 3, 4, 5)
    path = write_pair(df, str(tmp_path), "stem-20240101", at, upload=F.col("k_diff") < -1)
    assert path.endswith("stem_pair_20240102_030405")
    with open(f"{path}.manifest.json") as f:
        told = json.load(f)
    assert told["rows"] == {"result": 9, "upload": 4} and told["upload"] == list(S.UPLOAD_COLUMNS.values())
    same = lambda a, b: sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    result, upload = (read_pair(spark, path, t) for t in ("result", "upload"))
    assert result.columns == list(S.RESULT_COLUMNS.values())
    assert same(result, result_table(df)) and same(upload, upload_table(df.filter("k_diff < -1")))
    plan = both_tables(df.join(spark.range(3).toDF("base_qty"), "base_qty"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Range (0, 3") == 1
    bad = df.withColumn("k_link", F.when(F.col("base_qty") == 8, F.raise_error(F.lit("no"))).otherwise("x"))
    with pytest.raises(Exception, match="no"):
        write_pair(bad, str(tmp_path), "bad", at)
    assert not glob.glob(f"{tmp_path}/bad*manifest*")
    with pytest.raises(Exception):
        read_pair(spark, f"{tmp_path}/bad_pair_20240102_030405", "result")


def test_sample_share(spark):
    df = spark.range(20_000).withColumn("k", F.when(F.col("id") % 100 > 0, F.col("id")))
    one = {r.id for r in filters.sample_share(df, "k", 10).collect()}
    assert 1700 < len(one) < 2300 and one == {r.id for r in filters.sample_share(df.repartition(7), "k", 10).collect()}
    assert one < {r.id for r in filters.sample_share(df, "k", 30).collect()} and not [i for i in one if i % 100 == 0]
    assert filters.sample_share(df, "k", 0).count() == 0 and filters.sample_share(df, "k", 100).count() == 19_800
