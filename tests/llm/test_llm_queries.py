"""The registered queries against their SQL, and on empty tables."""

import pytest
from conftest import SF, rows_of, sql_rows

from seqloom.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    assert rows_of(QUERIES[name](spark, SF)) == sql_rows(duck, ORACLES[name])


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("empty")
    for t in ("documents", "benchmark", "conversations", "pages"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).coalesce(1).write.parquet(f"{d}/{t}.parquet")
    return str(d)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, empty, name):
    found = QUERIES[name](spark, empty).collect()
    assert len(found) == (1 if name == "op2_chat_formatting" else 0)


def test_large_ids_beside_nulls_stay_whole(spark):
    from cases import DOCS_SCHEMA, docs

    from seqloom.llm import packing, pii, simhash, suffix, tokens, warc

    ids = [2**53 + 1, None, 2**62 + 3, -(2**60) - 1]
    d = spark.createDataFrame(docs(["a text of one", "two", "x" * 500, "x" * 500], ids), DOCS_SCHEMA).coalesce(1)
    want = sorted(map(str, ids))
    for made in (packing.pack(d), pii.pii_report(d), simhash.near_duplicates(d), suffix.suffix_report(d), tokens.count_tokens(d), pii.redact(d)):
        assert sorted(str(r.doc_id) for r in made.collect()) == want
    pages = d.selectExpr("doc_id AS page_id", "'u' AS url", "repeat(text, 80) AS html")
    got = warc.warc_report(pages).collect()
    assert sorted(str(r.page_id) for r in got) == want and {r.refers_to for r in got} == {None, 2**62 + 3}
