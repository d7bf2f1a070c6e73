import re

from vellumspark.llm import line_dedup, quality, sharding, url_filter
from vellumspark.llm.queries import URL_RULES

PYTHON = re.compile(r"Python|Arrow|Pandas")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_native_operators_run_no_python(spark):
    docs = spark.createDataFrame([(1, "a b c", "s")], "doc_id long, text string, source string").coalesce(1)
    pages = spark.createDataFrame([(1, "http://a.org/x")], "page_id long, url string").coalesce(1)
    for df in (quality.judge_quality(docs), quality.keep_quality(docs), line_dedup.dedup_lines(docs), url_filter.filter_urls(pages, URL_RULES)):
        assert not PYTHON.search(plan(df))


def test_placing_rows_needs_no_shuffle(spark):
    rows = spark.range(10).selectExpr("id as doc_id")
    p = plan(sharding.assign_shards(rows, ["doc_id"], ["a", "b"], 101))
    assert "BroadcastHashJoin" in p and "Exchange hashpartitioning" not in p and "SortMergeJoin" not in p
