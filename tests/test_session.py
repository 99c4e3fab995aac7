"""Where lineage cuts are written."""

from types import SimpleNamespace

import pytest

from siteloom.session import materialise, scratch_dir


def _session(master, folder=None):
    return SimpleNamespace(
        conf=SimpleNamespace(get=lambda key, default: folder or default),
        sparkContext=SimpleNamespace(master=master, applicationId="app"))


def test_the_session_names_the_folder():
    assert scratch_dir(_session("yarn", "s3a://shared/dir/")) == "s3a://shared/dir"


def test_a_cluster_without_folder_is_an_error():
    with pytest.raises(RuntimeError):
        scratch_dir(_session("spark://h:7077"))


def test_a_local_session_makes_one_folder():
    assert scratch_dir(_session("local[2]")) == scratch_dir(_session("local[2]"))


def test_materialise_reads_back_what_was_written(spark):
    df = spark.range(10).selectExpr("id", "array(id) AS a", "map('k', id) AS m")
    back = materialise(df, "t")
    assert back.dtypes == df.dtypes and back.count() == 10
    assert "Range" not in back._jdf.queryExecution().executedPlan().toString()
    assert materialise(df.where("false"), "none").isEmpty()
