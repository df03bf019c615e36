"""Index, ranking, vectors, fusion, results and the engine."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from quarry import console
from quarry.operators import bm25, cleaning, evaluate, fusion, index, results, vector
from quarry.plans.engine import SearchEngine

DOCS = [(1, "apple apple banana"), (2, "apple cherry"), (3, "banana"), (4, ""), (5, None), (8, "cherry apple date")]


@pytest.fixture(scope="module")
def built(spark):
    return index.build(spark.createDataFrame(DOCS, "doc_id long, text string")).persist()


def test_postings_and_lengths(built):
    rows = {(r.term, r.doc_id): r.tf for r in built.postings.collect()}
    assert rows[("apple", 1)] == 2 and rows[("cherry", 2)] == 1 and len(rows) == 8
    assert {r.doc_id: r.dl for r in built.doc_stats.collect()} == {1: 3, 2: 2, 3: 1, 4: 0, 5: 0, 8: 3}
    s = built.stats.first()
    assert (s.n, s.total_len, s.vocab) == (6, 9, 4) and s.avgdl == 1.5
    assert built.terms.agg(F.sum("df")).first()[0] == len(rows)


def test_empty_corpus(spark):
    none = index.build(spark.createDataFrame([], "doc_id long, text string"))
    assert none.stats.first().asDict() == {"n": 0, "total_len": 0, "avgdl": 0.0, "vocab": 0}
    assert bm25.score(none, {1: "apple"}).count() == 0


def test_idf_and_tf(spark):
    one = spark.range(1)
    get = lambda c: one.select(c).first()[0]
    idf = lambda df: get(bm25.idf(F.lit(df), F.lit(100)))
    assert abs(idf(10) - math.log(90.5 / 10.5 + 1)) < 1e-9 and idf(1) > idf(99)
    tf = lambda t, dl: get(bm25.tf_part(F.lit(float(t)), F.lit(float(dl)), F.lit(50.0), 1.2, 0.75))
    a, b, c = tf(1, 50), tf(5, 50), tf(100, 50)
    assert a < b < c and c - b < b - a and tf(3, 20) > tf(3, 200)


def test_scores_follow_the_formula(built):
    got = {r.doc_id: r.score for r in bm25.score(built, {0: "apple date"}).collect()}
    n, avg = 6, 1.5
    part = lambda tf, df, dl: math.log((n - df + .5) / (df + .5) + 1) * tf * 2.2 / (tf + 1.2 * (.6 + .4 * dl / avg))
    assert got[1] == pytest.approx(part(2, 3, 3) * 0.5**1.5, abs=1e-6)
    assert got[8] == pytest.approx(part(1, 3, 3) + part(1, 1, 3), abs=1e-6)


def test_common_terms_are_skipped_in_long_queries_only(built):
    some = bm25.Params(common=0.4)
    assert bm25.score(built, {0: "apple cherry"}, some).count() == 3
    assert {r.doc_id for r in bm25.score(built, {0: "apple cherry date"}, some).collect()} == {2, 8}


def test_empty_and_unknown_queries(built):
    assert bm25.score(built, {0: ""}).count() == 0 and bm25.score(built, {0: "xyznonexistent"}).count() == 0
    assert set(bm25.query_tokens("CÔNG_TY ABC!")) == {"công_ty", "abc"}


def test_cap_and_ties(built):
    assert {r.doc_id for r in bm25.score(built, {0: "apple"}, bm25.Params(cap=2)).collect()} == {1, 2}
    assert [r.doc_id for r in bm25.topk(bm25.score(built, {0: "banana"}), 5).collect()] == [3, 1]


def test_merge_is_the_index_of_the_union(spark, built):
    rows = spark.createDataFrame(DOCS, "doc_id long, text string")
    both = index.merge(index.build(rows.where("doc_id < 3")), index.build(rows.where("doc_id >= 3")))
    for name in ("postings", "terms", "doc_stats", "stats"):
        a, b = getattr(both, name), getattr(built, name)
        assert sorted(map(tuple, a.select(*b.columns).collect())) == sorted(map(tuple, b.collect()))


def test_write_and_load(spark, built, tmp_path):
    built.write(str(tmp_path / "i"), 2)
    again = index.Index.load(spark, str(tmp_path / "i"))
    assert sorted(map(tuple, again.postings.collect())) == sorted(map(tuple, built.postings.collect()))
    plan = again.postings.where(F.col("term").isin("apple"))._jdf.queryExecution().toString()
    assert "PushedFilters" in plan and "apple" in plan.split("PushedFilters")[1]


def test_scoring_runs_no_python(built):
    plan = bm25.topk(bm25.score(built, {0: "apple date"}), 3)._jdf.queryExecution().toString()
    assert "BatchEvalPython" not in plan and "TakeOrderedAndProject" in plan


VECTORS = [(i, [math.cos(i), math.sin(i), (i % 3) - 1.0]) for i in range(60)] + [(60, [0.0, 0.0, 0.0])]


def test_vectors(spark):
    v = spark.createDataFrame(VECTORS, "vec_id long, embedding array<float>")
    exact = [(r.doc_id, r.score) for r in vector.topk(v, [1.0, 0.0, 1.0], 5).collect()]
    assert len(exact) == 5 and all(-1 <= s <= 1 for _, s in exact)
    cells = vector.build(v, nlist=4)
    assert [(r.doc_id, r.score) for r in vector.topk_cells(cells, [1.0, 0.0, 1.0], 5, nprobe=4).collect()] == exact
    unit = v.where("vec_id = 60").select(vector.l2_normalize(F.col("embedding"))).first()[0]
    assert unit == [0.0, 0.0, 0.0]


def ranks(spark, ids):
    return spark.createDataFrame([(i + 1, d) for i, d in enumerate(ids)] or [], "rank int, doc_id long")


@pytest.mark.parametrize("a, b", [([1, 2, 3], [3, 2, 1]), ([1, 2], [2, 9]), ([1], [2]), ([], [4])])
def test_rrf_is_symmetric(spark, a, b):
    one = {r.doc_id: r.score for r in fusion.rrf([ranks(spark, a), ranks(spark, b)], [0.65, 0.35]).collect()}
    two = {r.doc_id: r.score for r in fusion.rrf([ranks(spark, b), ranks(spark, a)], [0.35, 0.65]).collect()}
    assert one == two and set(one) == {*a, *b}


def test_boost_ladder(spark):
    rows = [(1, 1.0, "alpha beta", "x"), (2, 2.0, "the alpha beta co", "x"), (3, 3.0, "beta gamma alpha", "x"), (4, 4.0, "other", "alpha beta"), (5, 5.0, "other", "1 alpha beta st"), (6, 6.0, "no", None)]
    h = spark.createDataFrame(rows, "doc_id long, score double, company_name string, address string")
    got = {r.doc_id: r.score for r in results.boost(h, "Alpha Beta").collect()}
    assert got == pytest.approx({1: 12.1, 2: 9.2, 3: 8.1, 4: 11.2, 5: 7.7, 6: 6.0})
    assert {r.doc_id: r.score for r in results.boost(h, "alpha").collect()} == {r[0]: r[1] for r in rows}


COMPANY = "doc_id long, company_name string, tax_code string, address string, representative string, status string, industry string"


@pytest.fixture(scope="module")
def engine(spark):
    rows = [(1, "Apple Trading", "0123456789", "Hà Nội", "A", "NNT đang hoạt động", "fruit"), (2, "Banana Co", "0123456789", "Huế", "B", "Đã giải thể", "fruit"), (8, "Cherry", "9", None, None, None, None)]
    docs = spark.createDataFrame(rows, COMPANY)
    text = docs.select("doc_id", F.concat_ws(" ", "company_name", "address").alias("text"))
    return SearchEngine(index.build(text), docs, spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "vec_id long, embedding array<float>"), lambda q: [0.0, 1.0])


def test_engine_modes(engine):
    assert engine.search("0123456789").first().company_name == "Banana Co" and engine.search("0123456789").first().doc_id == -1
    assert [r.doc_id for r in engine.search("apple", "bm25").collect()] == [1]
    assert [r.doc_id for r in engine.search("apple", "vector", 1).collect()] == [2]
    assert {r.doc_id for r in engine.search("apple", "whatever").collect()} == {1, 2}
    assert engine.search("  ").count() == 0 and engine.search("012-345-6789", "bm25").count() == 0
    assert engine.match_count("apple banana").first().total == 2 and engine.stats().first().total_documents == 3
    for bad in (dict(top_k=0), dict(top_k=2001), dict(alpha=1.5)):
        with pytest.raises(ValueError):
            engine.search("apple", **bad)


def test_filters_and_threshold(spark, engine):
    hits = engine.documents.withColumn("score", F.when(F.col("doc_id") == 1, 100.0).when(F.col("doc_id") == 2, 69.5).otherwise(69.4))
    assert {r.doc_id for r in results.above_threshold(hits).collect()} == {1, 2}
    assert {r.doc_id for r in results.by_status(hits, False).collect()} == {2}
    assert {r.province: r.hits for r in results.province_facet(hits).collect()} == {"Hà Nội": 1, "Huế": 1}


def test_export(engine, tmp_path):
    results.write_csv(engine.documents, str(tmp_path / "csv"))
    text = "".join(p.read_text(encoding="utf-8") for p in sorted((tmp_path / "csv").glob("part*")))
    assert text.startswith('﻿"Tên công ty"') and '"Banana Co","0123456789","Huế"' in text


def test_dedup_and_reviews(spark):
    rows = spark.createDataFrame([(2, " A ", "x"), (1, "a", "X"), (3, None, None), (4, "", "")], "doc_id long, name string, addr string")
    once = cleaning.dedup_first(rows, ["name", "addr"])
    assert sorted(r.doc_id for r in once.collect()) == [1, 3]
    assert cleaning.dedup_first(once, ["name", "addr"]).count() == 2
    rev = spark.createDataFrame([(1, "", "empty"), (2, "a", "one"), (3, "a", "two")], "ord long, k string, title string")
    first, second = (cleaning.review_lists(rev.where(c), F.col("k"), "ord") for c in ("ord <> 2", "ord = 2"))
    got = {r.doc_id: ([x.title for x in r.reviews] if r.reviews else None, r.has_review) for r in cleaning.join_reviews(rows, F.trim(F.lower(F.coalesce("name", F.lit("")))), first, second).collect()}
    assert got == {2: (["two", "one"], True), 1: (["two", "one"], True), 3: (["empty"], True), 4: (["empty"], True)}


def test_winners(spark):
    p = spark.createDataFrame([(1, "bm25", 0.5), (1, "vector", 0.5), (1, "hybrid", 0.5), (2, "bm25", 0.1), (2, "vector", 0.9), (3, "hybrid", 1.0)], "qid int, engine string, precision double")
    got = {r.qid: (r.winner, r.hybrid_ok) for r in evaluate.winners(p).collect()}
    assert got == {1: ("all", True), 2: ("vector", False), 3: ("hybrid", True)}


def test_ivf_topk_holds_recall_for_every_query(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    all_of = {r.vec_id: np.array(r.embedding, float) for r in e.collect()}
    ids = sorted(all_of)
    units = np.array([all_of[i] / (np.linalg.norm(all_of[i]) or 1) for i in ids])
    asked, got = [i for i in ids if i % 50 == 0], {}
    for r in entry.queries()["ivf_topk"](spark, sf_dir).collect():
        got.setdefault(r.query_id, set()).add(r.doc_id)
    assert set(got) == set(asked)
    hits = 0
    for q in asked:
        scores = np.round(units @ units[ids.index(q)], 6)
        hits += len(got[q] & {ids[j] for j in sorted(range(len(ids)), key=lambda j: (-scores[j], ids[j]))[:10]})
    assert hits >= 0.9 * 10 * len(asked)


def test_segmenter_in_documents_and_engine(spark):
    join = lambda t: t.lower().replace("hà nội", "hà_nội") if "!" not in t else 1 / 0
    rows = spark.createDataFrame([(1, "Hà Nội phở"), (2, "Hà Nam nội"), (3, "fails! phở"), (4, None)], "doc_id long, text string")
    built = index.build(rows, segment=join)
    assert {r.term for r in built.terms.collect()} == {"hà_nội", "phở", "hà", "nam", "nội", "fails!"}
    docs = spark.createDataFrame([(i, f"C{i}", str(i), None, None, None, None) for i in (1, 2, 3)], COMPANY)
    segmented = SearchEngine(built, docs, segment=join)
    # a query's words count as they stand, too
    assert {r.doc_id for r in segmented.search("Hà Nội", "bm25").collect()} == {1, 2} and segmented.total("Hà Nội").first().total == 2
    assert set(bm25.query_tokens("Hà Nội", join)) == {"hà_nội", "hà", "nội"} and SearchEngine(built, docs).total("hà_nội").first().total == 1
    assert SearchEngine(built, docs).total("phở").first().total == 2 and segmented.total("x", "vector").first().total == 0


def test_scores_read_no_lengths_of_other_documents(spark, built, tmp_path):
    built.write(str(tmp_path / "i"), 2)
    scored = bm25.score(index.Index.load(spark, str(tmp_path / "i")), {0: "apple date"})
    assert "doc_stats" not in scored._jdf.queryExecution().toString() and scored.count() == 3


def test_vectors_written_encoded_and_chosen(spark, tmp_path):
    v = spark.createDataFrame(VECTORS, "vec_id long, embedding array<float>")
    assert vector.index_for(v) is None and vector.index_for(v, least=10, nlist=3) is not None
    vector.build(v, nlist=3).write(str(tmp_path / "cells"))
    back = spark.read.parquet(str(tmp_path / "cells"))
    assert sorted((r.vec_id, list(r.embedding)) for r in back.collect()) == sorted((r.vec_id, list(r.embedding)) for r in v.collect())
    docs = spark.createDataFrame([(i, "x" * i if i else None) for i in range(300)], "doc_id long, text string")
    encode = lambda texts: np.array([[len(t), len(texts)] for t in texts], dtype=np.float32)
    got = {r.vec_id: list(r.embedding) for r in vector.encoded(docs, encode, batch=64).collect()}
    assert len(got) == 300 and all(x[0] == i and x[1] <= 64 for i, x in got.items())
    assert {r.vec_id for r in vector.encoded(docs, encode, max_docs=5).collect()} == set(range(5))


def test_latency_facets_and_names(spark):
    t = spark.createDataFrame([("bm25", 1.0), ("bm25", 3.0), ("vector", 0.5)], "engine string, seconds double")
    assert {r.engine: tuple(r)[1:] for r in evaluate.latency(t).collect()} == {"bm25": (2.0, 1.0, 3.0), "vector": (0.5, 0.5, 0.5)}
    places = spark.createDataFrame([(f"1, {p}",) for p in ("Hà Nội", "Đà Nẵng", "An Giang", "Cần Thơ", "Hà Nội")], "address string")
    assert [r.province for r in results.facet_names(places).collect()] == ["An Giang", "Cần Thơ", "Đà Nẵng", "Hà Nội"]
    assert results.export_name("apple trading") == "apple trad.csv"


def test_console(engine):
    lines, said = iter(["", ":help", ":top 1", ":top 999", ":stats", "0123456789", ":quit", "never"]), []
    console.run(engine, lambda: next(lines), said.append)
    assert said[1] == said[2] == "top 1" and "total_documents: 3" in said and said[-1].startswith("1. Banana Co") and next(lines) == "never"


def test_split_cells_lose_no_pair(spark, monkeypatch):
    """Small slices and blocks, a third of the vectors alike, repeated queries' vectors: as brute force over everything."""
    monkeypatch.setattr(vector, "SLICE", 7)
    rng = np.random.default_rng(3)
    m = np.round(rng.normal(size=(60, 4)), 3)
    m[:20] = m[0]
    rows = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "vec_id long, embedding array<double>")
    asked = rows.where("vec_id < 30").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    scores = np.round(unit[:30] @ unit.T, 6)
    want = sorted((q, r + 1, int(d)) for q in range(30) for r, d in enumerate(np.argsort(-scores[q], kind="stable")[:5]))
    exact = vector.neighbours(rows, asked, 5).select("query_id", "rank", "doc_id").collect()
    assert sorted(map(tuple, exact)) == want
    none = vector.neighbours(rows.where("false"), asked, 5)
    assert none.count() == 0
    cells = vector.Cells([[1.0, 0.0, 0.0, 0.0], [-1.0, 0.0, 0.0, 0.0]], rows.withColumn("cell", F.when(F.col("embedding")[0] > 0, 0).otherwise(1)))
    probed = vector.neighbours_cells(cells, asked, 5, recall=1.0).select("query_id", "rank", "doc_id").collect()
    assert sorted(map(tuple, probed)) == want
