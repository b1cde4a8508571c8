import pytest

from tarn.queries import ORACLES, QUERIES
from tests.compare import plain, sql_rows


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, tiny, name):
    if name in ("doc_preview", "doc_vector") and spark.read.parquet(f"{tiny}/documents.parquet").where("doc_id = 7").isEmpty():
        pytest.skip("no document 7")
    assert plain(QUERIES[name](spark, tiny).toPandas()) == plain(sql_rows(ORACLES[name], tiny))


def test_every_query_is_lazy_or_small(spark, tiny):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
