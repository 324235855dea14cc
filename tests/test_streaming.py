"""Screening is row-local: on a stream it gives what the batch gives, also with a table of keywords."""

from pyspark.sql import functions as F

from ledgermatch.operators.screening import flag_by_table
from ledgermatch.plans.screening import screen_text


def test_stream_matches_batch(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    words = spark.createDataFrame([(1, "the"), (2, "a"), (3, "of the"), (4, "no such text")], "place int, keyword string")
    src = str(tmp_path / "in")
    docs.repartition(4).write.parquet(src)
    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(src)

    def screened(d):
        return flag_by_table(screen_text(d), words).select("conv_id", "turn", "warning", F.array_join("flagged", "|").alias("flagged"))

    q = (screened(stream).writeStream.format("memory")
         .queryName("screened").option("checkpointLocation", str(tmp_path / "ck")).start())
    q.processAllAvailable()
    q.stop()
    got = sorted(map(tuple, spark.sql("select * from screened").collect()))
    want = sorted(map(tuple, screened(docs).collect()))
    assert got == want and any(r[3] for r in got)
