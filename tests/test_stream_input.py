"""What a stream reads is written by all tasks that have rows."""

from lexlake.plans import registry


def test_input_of_the_expiry_stream_is_not_written_by_one_task(spark, sf_dir):
    out = registry.load()[0]["stream_expiry"](spark, sf_dir).inputFiles()[0]
    folder = out.rsplit("/out/", 1)[0]
    assert len(spark.read.parquet(f"{folder}/in").inputFiles()) >= 3
