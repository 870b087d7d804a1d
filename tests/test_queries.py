"""Every registered query against its SQL on the smallest tables, and what SQL can't tell."""

import pytest

from comparing import SMALL, against_sql
from seqlattice.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_against_sql(spark, name):
    against_sql(catalogue.QUERIES[name](spark, SMALL), catalogue.ORACLES[name])


def test_components_explain_all_variance_at_most(spark):
    shares = [r.share for r in catalogue.QUERIES["pca_explained"](spark, SMALL).collect()]
    assert shares == sorted(shares, reverse=True) and 0 < sum(shares) <= 1


def test_entry_without_the_training_data_part():
    import __spark_entry__ as entry

    assert set(catalogue.QUERIES) <= set(entry.queries()) and set(catalogue.ORACLES) <= set(entry.oracle_sql())


def test_kernel_null_runs_the_references_trials(spark, monkeypatch):
    from seqlattice.plans import grids

    seen, real = [], grids.nulls.kernel_null
    monkeypatch.setattr(grids.nulls, "kernel_null", lambda groups, similarity, orders: seen.append(len(orders)) or real(groups, similarity, orders))
    rows = catalogue.QUERIES["layout_kernel_null"](spark, SMALL).collect()
    assert seen == [10_000] and len({(r.layout, r.kind) for r in rows}) == len(rows) == 14
    assert all(abs(r.percentile * 10_000 - round(r.percentile * 10_000)) < 1e-6 for r in rows)


@pytest.mark.parametrize("name", ["normalize_rows", "html_to_markdown", "page_links"])
def test_whole_texts_come_to_python_in_small_batches(spark, name):
    rows, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    for key in (rows, size):
        spark.conf.unset(key)
    catalogue.QUERIES[name](spark, SMALL)
    assert int(spark.conf.get(rows)) <= 1000 and int(spark.conf.get(size)) <= 8 << 20


def test_ascii_is_composed_without_python(spark):
    from seqlattice.functions import text

    rows = spark.createDataFrame([("plain \x00 text\nof (ASCII)",), ("ﾊﾟ é ①",), ("",), (None,)], "t string")
    got = [r.n for r in rows.select(text.nfkc(rows.t).alias("n")).collect()]
    assert got == ["plain \x00 text\nof (ASCII)", "パ é 1", "", None]
    sent = rows.select(text.nfkc(rows.t).alias("n"))._jdf.queryExecution().executedPlan().toString()
    assert "RLIKE" in sent and "ArrowEvalPython" in sent
