"""The queries against their SQL, and the pipeline stage by stage."""

import pytest
from fixtures import SMALL
from test_queries import db, same  # noqa: F401

import __spark_entry__ as entry
import corpus_pipeline
from quarry.llm import queries
from quarry.llm.common import cut, table
from test_quality_mixing import counts

NAMES = {f"op{n}_" for n in range(1, 11)}


def test_names():
    assert {n[:n.index("_") + 1] for n in queries.queries()} == NAMES and {"pipeline", *queries.queries()} <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_agrees_with_sql(spark, db, sf_dir, name):  # noqa: F811
    same(spark, db, sf_dir, entry.queries()[name], queries.oracle_sql()[name])


def test_pipeline(spark):
    docs = table(spark, SMALL, "documents")
    names, tables = docs.columns, [docs]
    for _, stage in corpus_pipeline.STAGES:
        tables.append(cut(stage(spark, tables[-1], SMALL)))
    first, judged, single, clean, mixed, last = ([r.asDict() for r in t.collect()] for t in tables)
    assert all(t.columns == names for t in tables[:5])
    ok = {r["doc_id"] for r in first if (c := counts(r["text"]))[0] >= 50 and 100 * c[4] <= 50 * c[0]}
    assert {r["doc_id"] for r in judged} == ok, "no host is bad here"
    assert {r["doc_id"] for r in single} <= ok and len({r["doc_id"] for r in single}) == len(single)
    assert {r["doc_id"] for r in clean} == {r["doc_id"] for r in single} and all(r["n_chars"] == len(r["text"]) for r in clean)
    assert {r["doc_id"] for r in mixed} <= {r["doc_id"] for r in clean} and len(last) == len(mixed)
    assert sorted(r["doc_id"] for r in corpus_pipeline.run(spark, SMALL).collect()) == sorted(r["doc_id"] for r in last)


def test_pipeline_odd(spark, odd, none):
    """Every stage on nulls, empty and long texts, repeated rows, further columns, and on an empty table."""
    for (name, stage), rows in zip(corpus_pipeline.STAGES, (0, 7, 8, None, 8)):  # nearly all rows fail here, and so do their hosts
        assert stage(spark, none, SMALL).count() == 0, name
        out = stage(spark, odd, SMALL)
        assert out.columns == odd.columns or name == "pieces"
        assert rows is None or out.count() == rows, name


def test_pipeline_gives_its_texts(spark, odd):
    """What leaves the last stage are the documents themselves, repeated rows included: ids, text, samples."""
    docs = odd.where("doc_id is not null")
    last = corpus_pipeline.encode_pieces(spark, docs, SMALL).collect()
    assert sorted((r.doc_id, r.decoded) for r in last) == sorted((r.doc_id, r.text or "") for r in docs.collect())
    assert all(len(r.piece_ids) == r.n_pieces and [len(x) for x in r.sample_ids] == r.sample_pieces for r in last)
