"""The compact cache: contents, faults, reuse and rebuilding."""

import pytest
from pyspark.sql import functions as F

from millrace.sources import compact as C


@pytest.fixture
def parts(spark, tmp_path):
    rows = spark.createDataFrame([(f"e{i}", [i, i + 1], None) for i in range(6)], "excerpt_id string, input_ids array<int>, note string")
    source = str(tmp_path / "rows")
    rows.coalesce(2).write.parquet(source)
    assigned = spark.createDataFrame([("e0", 1, 0), ("e3", 1, 1), ("e1", 4, 0), ("e4", 4, 1)], "excerpt_id string, repetition int, bucket_base_index int")
    return spark.read.parquet(source), assigned, source, str(tmp_path / "cache")


def test_cache_is_built_reused_and_rebuilt(spark, parts):
    rows, assigned, source, path = parts
    got, built = C.ensure_compact(rows, assigned, path, [source])
    assert built
    assert sorted(map(tuple, got.select("excerpt_id", "input_ids", "note", "repetition_bucket", "replica_count", "replica_index", "bucket_base_index", "unique_eval_compact", "repetition").collect())) == [
        ("e0", [0, 1], None, 1, 1, 0, 0, True, 1), ("e1", [1, 2], None, 4, 4, 0, 0, True, 4), ("e3", [3, 4], None, 1, 1, 0, 1, True, 1), ("e4", [4, 5], None, 4, 4, 0, 1, True, 4),
    ]
    assert not C.ensure_compact(rows, assigned, path, [source])[1]
    assert C.ensure_compact(rows, assigned, path, [source], mode="replicas")[1]
    rows.limit(1).write.mode("append").parquet(source)
    assert C.ensure_compact(rows, assigned, path, [source], mode="replicas")[1]


def test_faults(spark, parts):
    rows, assigned, source, path = parts
    with pytest.raises(ValueError, match="several buckets: e1"):
        C.write_compact(rows, assigned.union(spark.createDataFrame([("e1", 9, 0)], assigned.schema)), path)
    missing = assigned.union(spark.createDataFrame([("zz", 9, 0)], assigned.schema))
    with pytest.raises(RuntimeError, match=r"9 \(0 of 1\)"):
        C.ensure_compact(rows, missing, path, [source])
    assert C.ensure_compact(rows, assigned, path, [source])[1]
    with pytest.raises(RuntimeError):
        C.write_compact(rows.filter(F.lit(False)), assigned, path)


def test_preview_faults(spark, parts):
    assigned = parts[1]
    good = [(1, ["e0", "e3"]), (4, ["e1"]), (7, ["e9"]), (4, [])]
    schema = "repetition int, excerpt_ids_preview array<string>"
    assert C.preview_faults(assigned, spark.createDataFrame(good, schema)).count() == 0
    bad = C.preview_faults(assigned, spark.createDataFrame([(1, ["e3"]), (4, ["e1", "e4", "e5"])], schema))
    assert sorted((r.repetition, r.bucket_base_index, r.expected, r.excerpt_id) for r in bad.collect()) == [(1, 0, "e3", "e0"), (4, 2, "e5", None)]
