"""How finely op5's entries are dealt out, since each destination gathers its own in Python."""

from pyspark.sql import functions as F

from findloom.llm import lm


def test_a_destination_has_a_quarter_of_a_shuffle_partition(spark):
    docs = spark.createDataFrame([(1, "a b a"), (2, "b c"), (3, None)], "doc_id long, text string")
    found = lm.score_documents(docs, F.col("doc_id") == 2)
    assert found.rdd.getNumPartitions() >= 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert found.count() == 3
