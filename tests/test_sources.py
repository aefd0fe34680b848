import gzip

import pytest

from quarry.operators import overlay
from quarry.sources import files


def test_host_tree_and_containers(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "one.gz").write_bytes(gzip.compress(b"hello"))
    (tmp_path / "two.txt").write_bytes(b"plain")
    assert {r.size for r in files.host_tree(spark, str(tmp_path)).select("size").collect()} == {5, len(gzip.compress(b"hello"))}
    assert [bytes(r.body) for r in files.containers(spark, str(tmp_path)).collect()] == [b"hello"]


def test_snapshots(spark, tmp_path):
    root = str(tmp_path / "snap")
    with pytest.raises(ValueError, match="no snapshot"):
        files.read_snapshot(spark, root)
    base = spark.createDataFrame([(1, 1.0), (2, 2.0)], "k long, v double")
    log = spark.createDataFrame([(2, 1, "D", 0.0), (3, 2, "P", 3.0)], "k long, seq long, op string, v double")
    files.commit_snapshot(base, root, 0)
    files.commit_snapshot(overlay.live(files.read_snapshot(spark, root), log), root, 1)
    (tmp_path / "snap" / "version=2").mkdir()  # a write that was never completed
    assert files.current_version(spark, root) == 1
    assert sorted(map(tuple, files.read_snapshot(spark, root).collect())) == [(1, 1.0), (3, 3.0)]
    assert files.read_snapshot(spark, root, 0).count() == 2
    files.write_ordered(base, "k", str(tmp_path / "ordered"))
    assert spark.read.parquet(str(tmp_path / "ordered")).where("k = 2").count() == 1
