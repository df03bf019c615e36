"""Text functions, case by case."""

import re
import unicodedata

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarry.functions import text as T


def values(spark, xs, f):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x string")
    return [r[0] for r in df.select("i", f(F.col("x")).alias("y")).orderBy("i").select("y").collect()]


def test_tokens(spark):
    got = values(spark, ["công_ty tnhh thương_mại dịch_vụ", "a b công_ty c d", "công_ty ... --- !!!", "mã_số 0123456789 7", "", None], T.tokens)
    assert got == [["công_ty", "tnhh", "thương_mại", "dịch_vụ"], ["công_ty"], ["công_ty"], ["mã_số", "0123456789", "7"], [], []]


def plain_fold(x):
    x = unicodedata.normalize("NFD", (x or "").lower()).encode("ascii", "ignore").decode()
    return " ".join(re.sub(r"[^a-z0-9\s]", " ", x).split())


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(st.sampled_from("aBzé ĐđßÀỡữ9-,.\tÑœ"), max_size=30), min_size=20, max_size=20))
def test_ascii_fold(spark, xs):
    assert values(spark, xs, T.ascii_fold) == [plain_fold(x) for x in xs]


def test_core_name_keeps_inner_spaces(spark):
    assert values(spark, ["Công ty TNHH Alpha", "Alpha TNHH Beta", "Đà Nẵng", None], T.core_name) == ["alpha", "alpha  beta", "a nang", ""]


def test_strip_html_and_case(spark):
    assert values(spark, ["<b>A</b>&nbsp;B  ", None], T.strip_html) == ["A B", ""]
    assert values(spark, ["O'NEIL & SONS", "SHORT", "Mixed Case", "CÔNG TY ÁNH"], T.fix_case) == ["O'Neil & Sons", "SHORT", "Mixed Case", "Công Ty Ánh"]


@pytest.mark.parametrize("address, want", [
    ("1, Tỉnh Hải Dương", "Hải Dương"), ("Thành phố Cần Thơ", "Cần Thơ"), ("x, TP. Huế", "Huế"), ("TP.HCM", "TP.HCM"), ("a, hn", "Hà Nội"),
    ("a, HCM", "Hồ Chí Minh"), ("a,", ""), (None, None), ("", None),
])
def test_province(spark, address, want):
    assert values(spark, [address], T.province) == [want]


def test_region_is_the_first_in_order(spark):
    df = spark.createDataFrame([("1 Đà Nẵng, Hà Nội", ""), (None, "x/Ca Mau"), ("nowhere", None)], "a string, u string")
    assert [r[0] for r in df.select(T.region(F.col("a"), F.col("u"))).collect()] == ["Ha-Noi", "Ca-Mau", None]


def test_percent_and_bands(spark):
    df = spark.createDataFrame([(0.001, 10.0), (6.95, 10.0), (8.6, 10.0), (0.0, 0.0)], "s double, t double")
    p = T.relevance_percent(F.col("s"), F.col("t"))
    assert [tuple(r) for r in df.select(p, T.band(p)).collect()] == [(1, "low"), (70, "mid"), (86, "high"), (0, "low")]


def test_empty_embed_text(spark):
    df = spark.createDataFrame([("A", "x_y", None, "", "on"), (None, None, None, None, None)], "n string, i string, a string, r string, s string")
    got = [r[0] for r in df.select(T.embed_text(*map(F.col, "niars"))).collect()]
    assert got == ["Tên công ty: A. Ngành nghề kinh doanh: x y. Trạng thái hoạt động: on.", "Không có thông tin doanh nghiệp."]
