"""Driver contract: entry() and every registered query run at sf0.001."""

import __spark_entry__ as E


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["row_pos", "supplier", "default_payment_method", "invoice_total"]
    assert df.count() > 0


def test_every_query_has_oracle_and_runs(spark):
    q, o = E.queries(), E.oracle_sql()
    q = {k: f for k, f in q.items() if k not in E.LLM_QUERIES}  # those have tests of their own
    assert set(q) == set(o) - set(E.LLM_SQL)
    for name, fn in q.items():
        fn(spark, "/root/testdata/sf0.001").write.format("noop").mode("overwrite").save()
