"""The corpus that read_corpus lays out: as many files as the size asks for, in order."""

import os

import pytest

from workload import QUERIES, ingest

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")
def test_files_follow_the_size(spark, monkeypatch):
    paths, read = [], ingest.read_corpus
    monkeypatch.setattr(ingest, "read_corpus", lambda s, path, *a, **o: paths.append(path) or read(s, path, *a, **o))
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "16k")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.minPartitionSize", "1k")
        rows = QUERIES["read_corpus"](spark, FOLDER).collect()
    finally:
        spark.conf.set(key, before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.minPartitionSize")
    assert len(spark.read.parquet(paths[0]).inputFiles()) > 4
    assert sorted((r.pos, int(r._id)) for r in rows) == [(i, i) for i in range(len(rows))]
