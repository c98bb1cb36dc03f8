import json
from types import SimpleNamespace

import pytest

from watchgrid import session
from watchgrid.sources.results import flatten_results


def fake(master, folder=None, named=None):
    set_to = []
    context = SimpleNamespace(master=master, getCheckpointDir=lambda: folder, setCheckpointDir=set_to.append)
    return SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda key, default: named)), set_to


@pytest.mark.parametrize("master", ["spark://host:7077", "yarn", "local-cluster[3,2,1024]"])
def test_a_cluster_must_name_its_shared_folder(master):
    spark, set_to = fake(master)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(spark)
    spark, set_to = fake(master, named="hdfs://shared")
    assert session.ensure_checkpoint_dir(spark) == "hdfs://shared" and set_to == ["hdfs://shared"]


def test_one_machine_may_leave_it_unset():
    spark, set_to = fake("local[4]")
    assert session.ensure_checkpoint_dir(spark) == set_to[0]
    assert session.ensure_checkpoint_dir(fake("yarn", folder="/set")[0]) == "/set"


def test_result_leaves_of_any_depth(spark):
    deep = {"leaf": 7}
    for i in range(20):
        deep = {f"n{i}": deep} if i % 2 else [deep]
    documents = spark.createDataFrame([("a", json.dumps({"top": 1, "deep": deep})), ("b", "3")], "file string, json string")
    got = {(r.file, r.path.count("|"), r.value) for r in flatten_results(documents).collect()}
    assert got == {("a", 0, "1"), ("a", 21, "7"), ("b", 0, "3")}
