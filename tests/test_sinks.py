import pytest

from routeloom.sources import sinks


def test_markdown_holds_all_rows_or_raises(spark):
    rows = spark.range(1001).toDF("n")
    assert len(sinks.to_markdown(rows, 1001).splitlines()) == 1003
    with pytest.raises(ValueError, match="more than 1000 rows"):
        sinks.to_markdown(rows)
