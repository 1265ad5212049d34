"""A stream of judgments keeps all cores busy, in two batches at least."""

import pytest

from lexlake.plans import corpus_queries, registry

QUERIES = registry.load()[0]


def test_batches_of_the_annotated_stream(spark, sf_dir, monkeypatch):
    seen = []

    def read(session, path, files_per_batch):
        seen.append((len(session.read.parquet(path).inputFiles()), files_per_batch))
        raise InterruptedError

    monkeypatch.setattr(corpus_queries.A, "read_judgments", read)
    with pytest.raises(InterruptedError):
        QUERIES["stream_annotate"](spark, sf_dir)
    ((files, batch),) = seen
    assert batch >= spark.sparkContext.defaultParallelism and files >= 2 * batch
