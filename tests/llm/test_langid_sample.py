"""Every language keeps its rows in the sample, however many the others draw."""

from spanline.llm import langid


def test_rows_are_ranked_within_languages(spark):
    rows = [("big", f"t{i}", i / 1000) for i in range(50)] + [("rare", f"r{i}", 0.5 + i / 1000) for i in range(10)]
    got = langid.ranked(spark.createDataFrame(rows, "lang string, body string, draw double"), 20).groupBy("lang").count().collect()
    assert dict(map(tuple, got)) == {"big": 20, "rare": 10}
