"""Facet values are cut to the stored width before they are made distinct."""

from pyspark.sql import functions as F

from siltstone.functions import text
from siltstone.queries import scalar


def test_width_and_order(spark):
    long = "x" * 255
    values = ["Land Use", "Land Use Outreach", "Land Use Outreach Surveys", "", "Land Use", long + "a", long + "b", long]
    df = spark.createDataFrame([(values,), (None,)], "v array<string>")
    assert [r.out for r in df.select(text.stored_values(F.col("v")).alias("out")).collect()] == [["Land Use", "Land Use Outreach", "Land Use Outreach Surveys", long], None]


def test_query_keeps_levels(spark, tmp_path):
    path = "Land Use > Land Use Outreach > Land Use Outreach Surveys"
    spark.createDataFrame([("d", path), ("d", path), ("e", None)], "document_id string, theme_path string").write.parquet(f"{tmp_path}/documents_theme.parquet")
    assert [r.out for r in scalar.QUERIES["u03_stored_values"](spark, str(tmp_path)).collect()] == ["Land Use|Land Use Outreach|Land Use Outreach Surveys"]
