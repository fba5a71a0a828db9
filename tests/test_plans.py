"""Shape of the physical plans behind the registered queries."""

import pytest

import __spark_entry__ as contract

QUERIES = contract.queries()
# Scalar, feature, cut and array queries are pure column work.
COLUMN_WORK = sorted(n for n in QUERIES if n[0] in "pef" and n[1].isdigit() or n.startswith(("a1", "a2", "a3", "flagship")))
STATISTICS = sorted(n for n in QUERIES if n.startswith(("g1", "g2", "g3", "g7", "g8", "x1", "u1", "a4", "a5")))


def plan(spark, sf_dir, name):
    return QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", COLUMN_WORK)
def test_column_work_stays_in_the_jvm(spark, sf_dir, name):
    text = plan(spark, sf_dir, name)
    for operator in ("Python", "ArrowEval", "InPandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert operator not in text


@pytest.mark.parametrize("name", STATISTICS)
def test_statistics_never_pair_rows_or_rank_in_one_task(spark, sf_dir, name):
    text = plan(spark, sf_dir, name)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    lines = text.split("\n")
    for i, line in enumerate(lines):
        if "Exchange SinglePartition" in line:
            assert not any("Window [" in above for above in lines[max(0, i - 3) : i])
