"""Where flows may write: shared places on a cluster, private ones only in local mode."""

from types import SimpleNamespace

import pytest

from planloom.operators.shared_folder import new_folder, new_table


def session(master, checkpoint_dir=None, **settings):
    conf = {key.replace("_", "."): value for key, value in settings.items()}
    if checkpoint_dir:
        conf["spark.checkpoint.dir"] = checkpoint_dir
    made = []
    context = SimpleNamespace(master=master, getCheckpointDir=lambda: made[-1] if made else None,
                              setCheckpointDir=made.append)
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: conf.get(key, default)),
                           sparkContext=context)


def test_the_named_folder_is_used():
    cluster = session("spark://host:7077", "hdfs://shared/ckpt/")
    first, second = new_folder(cluster, "x"), new_folder(cluster, "x")
    assert first.startswith("hdfs://shared/ckpt/planloom/x-") and first != second


def test_local_mode_makes_one_folder():
    local = session("local[4]")
    first, second = new_folder(local, "x"), new_folder(local, "x")
    assert first.rsplit("/", 1)[0] == second.rsplit("/", 1)[0]


@pytest.mark.parametrize("master", ["spark://host:7077", "yarn", "k8s://https://host", "local-cluster[2,1,1024]"])
def test_a_cluster_needs_shared_places(master):
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        new_folder(session(master), "x")
    with pytest.raises(RuntimeError, match="spark.planloom.jdbc.uri"):
        new_table(session(master, "/shared"), "t")


def test_a_configured_database_is_used():
    cluster = session("yarn", spark_planloom_jdbc_uri="jdbc:x://db", spark_planloom_jdbc_user="u")
    uri, table, options = new_table(cluster, "t")
    assert (uri, options) == ("jdbc:x://db", {"user": "u"}) and table.startswith("t_")
