"""How the URL filter's counts meet the strings that blocks ask for."""

from pyspark.sql import functions as F

from rentlens.llm import url_filter as U
from rentlens.llm.common import written


def test_the_model_is_not_sent_to_the_driver(spark):
    """As Parquet the counts are a fiftieth of their size in memory, so by its bytes Spark chose to broadcast a model that filled the driver."""
    urls = [(i, f"http://x{i % 7}.example.{'net' if i % 2 else 'com'}/{'en' if i % 2 else 'de'}/{i}") for i in range(60)]
    pages = spark.createDataFrame(urls, "page_id long, url string")
    labelled = U.split_urls(pages, U.RULES).withColumn("judged", F.lit(True))
    model = written(U.model_table(U.gram_counts(labelled.where("ruled is not null"))), "test-model")
    found = U.asked(U.in_blocks(labelled), model)
    assert found.columns == ["key", "block", *U.COUNTS] and found.count() > 100
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
