"""Every query against its SQL; the few that SQL cannot express have golden cases in test_operators, and here rows that reruns repeat."""

import pytest

from ledgerloom import plans
from ledgerloom.operators import matching

from .compare import rows_of, rows_of_sql
from .conftest import SMALL


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, duck, name):
    df = plans.QUERIES[name](spark, SMALL)
    if name in plans.ORACLES:
        assert rows_of(df) == rows_of_sql(duck, plans.ORACLES[name])
    else:
        found = rows_of(df)
        assert found[1] and found == rows_of(plans.QUERIES[name](spark, SMALL))


def test_chunks_keep_every_word(spark, duck):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    pieces = {}
    for r in matching.chunk_text(docs, "text", 300, "words").collect():
        assert 0 < len(r.piece) <= 300
        pieces.setdefault(r.doc_id, {})[r.part] = r.piece
    for doc, text in duck.execute("select doc_id, text from documents").fetchall():
        got = pieces.get(doc, {})
        assert sorted(got) == list(range(1, len(got) + 1))
        assert "".join("".join(got[k].split()) for k in sorted(got)) == "".join((text or "").split())


def test_oracles_have_queries():
    assert set(plans.ORACLES) <= set(plans.QUERIES)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
