import re

from pyspark.sql import functions as F

from vellumspark.functions import html
from vellumspark.operators import markdown, plaintext

SHUFFLE, PYTHON = re.compile(r"Exchange|Sort\b|Window"), re.compile(r"Python|Arrow|Pandas")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_conversions_of_a_row_stay_in_the_row(spark, tmp_path):
    spark.createDataFrame([(1, "a", "x", 3)], "id long, body string, path string, other int").write.parquet(f"{tmp_path}/t")
    t = spark.read.parquet(f"{tmp_path}/t")
    for column in (markdown.parse(F.col("body")), html.html_to_markdown(F.col("body"), F.col("path")), plaintext.txt_to_markdown(F.col("body"), F.col("path"))):
        p = plan(t.select("id", column.alias("v")))
        assert not SHUFFLE.search(p) and not PYTHON.search(p) and "other" not in p


def test_a_text_is_split_once(spark):
    p = plan(markdown.documents(spark.createDataFrame([("x",)], "md string").coalesce(1)).select("doc.title", "doc.style", "doc.sections"))
    assert p.count("lambda") and len(re.findall(r"split\(coalesce\(md#", p)) == 1
