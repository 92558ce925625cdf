"""The shared folder, with and without the session's setting."""

from types import SimpleNamespace

import pytest

from loomline import session


def fake(master, setting=None):
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: setting), sparkContext=SimpleNamespace(master=master, applicationId="app-1"))


def test_the_setting_is_used(tmp_path):
    assert session.shared_dir(fake("spark://x", "hdfs://store/dir/")) == "hdfs://store/dir"


def test_a_local_session_without_it_gets_one_folder(tmp_path, monkeypatch):
    monkeypatch.setenv("LOOMLINE_TMP", str(tmp_path))
    monkeypatch.setattr(session, "_MADE", {})
    first = session.shared_dir(fake("local[2]"))
    assert first.startswith(f"file://{tmp_path}/") and session.shared_dir(fake("local[2]")) == first


@pytest.mark.parametrize("master", ["spark://x", "yarn", "local-cluster[2,1,1000]"])
def test_a_cluster_without_it_is_refused(master):
    with pytest.raises(ValueError):
        session.shared_dir(fake(master))


def test_tables_are_written_and_deleted(spark):
    with session.Scratch(spark) as tables:
        kept = tables.written(spark.range(5), "t")
        assert kept.count() == 5
        jvm, at = spark._jvm, tables.paths[0]
        there = lambda: jvm.org.apache.hadoop.fs.Path(at).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jvm.org.apache.hadoop.fs.Path(at))
        assert there()
    assert not there()
