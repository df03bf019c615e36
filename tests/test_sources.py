"""JSON lines, HTML pages, streams."""

from pyspark.sql import functions as F

from quarry.sources import html, scan
from quarry.streaming import ingest

LISTING = """<div class="company-item box"><h3 class="company-name"><a href="/a-1"> Công  ty A </a></h3>
<p>Mã số thuế: 0101234567</p><p>Địa chỉ: 1 Phố X, Hà Nội Đại diện: B</p></div>
<div class="company-item"><h3 class="company-name"><a href="https://y/z">No code</a></h3>Mã số thuế: 123</div>
<div class="company-item">no head</div>"""
DETAIL = """<span itemprop="founder"><b itemprop="name">Ông  C</b></span><i itemprop="telephone">09</i>
<div class="responsive-table-cell responsive-table-cell-head">Tình trạng hoạt động</div><div class="responsive-table-cell">Đang hoạt động</div>
<div class="responsive-table-cell-head">Ngày cấp</div><div class="responsive-table-cell">2001-02-03</div>
<div class="nnkd-table"><div class="responsive-table-cell responsive-table-cell-head">Mã</div><div class="responsive-table-cell">Tên</div>
<div class="responsive-table-cell responsive-table-cell-head">6201</div><div class="responsive-table-cell">Lập trình</div></div>"""


def test_listing_and_detail(spark):
    df = spark.createDataFrame([(LISTING, DETAIL), (None, "")], "a string, b string")
    got = df.select(html.listing(F.col("a"), F.lit("https://base")).alias("l"), html.detail(F.col("b")).alias("d")).collect()
    assert [r.asDict() for r in got[0].l] == [{"company_name": "Công ty A", "tax_code": "0101234567", "address": "1 Phố X, Hà Nội", "url": "https://base/a-1"}]
    d = got[0].d
    assert (d.representative, d.phone, d.status, d.founded_date) == ("Ông C", "09", "Đang hoạt động", "2001-02-03")
    assert [tuple(x) for x in d.industries_detail] == [("6201", "Lập trình")]
    assert got[1].l == [] and got[1].d.status is None


REVIEWS = """<div class="location" data-location="12+Ph%E1%BB%91+Hu%E1%BA%BF"></div>""" + "".join(
    f"<div class='content-of-review'><h3>Title {i}</h3><p>good {i}</p></div>" for i in range(13)) + "<div class='content-of-review'>none</div>"


def test_review_pages(spark):
    got = spark.createDataFrame([(REVIEWS,), (None,)], "h string").select(html.review_page(F.col("h")).alias("r")).collect()
    assert got[0].r.company_address == "12 Phố Huế" and [x.title for x in got[0].r.reviews] == [f"Title {i}" for i in range(10)]
    assert got[0].r.reviews[0].content == "Title 0good 0" and (got[1].r.company_address, got[1].r.reviews) == ("", [])


def test_rows_are_numbered_in_order(spark, tmp_path):
    spark.range(0, 1000, 1, 7).select(F.col("id").cast("string").alias("value")).write.text(str(tmp_path / "n"))
    got = scan.number_rows(spark.read.text(str(tmp_path / "n"))).collect()
    assert sorted(r.doc_id for r in got) == list(range(1000))
    scan.write_json_lines(spark.createDataFrame([("Hà Nội", 1)], "a string, b int"), str(tmp_path / "j"))
    assert [tuple(r) for r in scan.read_json_lines(spark, str(tmp_path / "j"), "a string, b int")[0].collect()] == [("Hà Nội", 1)]


def test_json_lines(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"company_name": "A", "rating": 1}\n\nnot json\n{"company_name": "B"}\n', encoding="utf-8")
    good, bad = scan.read_json_lines(spark, str(tmp_path / "x.jsonl"))
    assert sorted(r.company_name for r in good.collect()) == ["A", "B"] and bad.count() == 1
    assert [r.doc_id for r in scan.number_rows(good.select("company_name")).orderBy("doc_id").collect()] == [0, 1]
    assert scan.read_or_empty(spark, str(tmp_path / "none"), scan.COMPANY).count() == 0


def test_stream_keeps_its_state(spark, tmp_path):
    put = lambda n, rows: spark.createDataFrame(rows, "a string, b string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run = lambda: ingest.run_once(ingest.dedup_stream(spark.readStream.schema("a string, b string").parquet(str(tmp_path / "in")), ["a", "b"]), str(tmp_path / "out"), str(tmp_path / "cp"))
    put(1, [("x", "1"), (" X", "1"), ("y", None)])
    run()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    put(2, [("x", "1"), ("z", "")])
    run()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


def test_index_blocks(spark, tmp_path):
    docs = spark.createDataFrame([(1, "aa bb"), (2, "bb")], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "docs"))
    ingest.index_blocks(spark.readStream.schema(docs.schema).parquet(str(tmp_path / "docs")), str(tmp_path / "i"), str(tmp_path / "c"))
    merged = ingest.merged_blocks(spark, str(tmp_path / "i"))
    assert {r.term: r.df for r in merged.terms.collect()} == {"aa": 1, "bb": 2} and merged.stats.first().n == 2
