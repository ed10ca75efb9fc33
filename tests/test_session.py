import types

import pytest

from sightline import session
from sightline.operators import counts as ct


def stand_in(master):
    """A session of which only the settings are asked for."""
    none = types.SimpleNamespace(isDefined=lambda: False)
    jsc = types.SimpleNamespace(sc=lambda: types.SimpleNamespace(getCheckpointDir=lambda: none))
    return types.SimpleNamespace(conf=types.SimpleNamespace(get=lambda *a: None),
                                 sparkContext=types.SimpleNamespace(master=master, _jsc=jsc))


@pytest.mark.parametrize("master", ["spark://host:7077", "yarn", "local-cluster[2,1,1024]"])
def test_a_cluster_needs_a_named_folder(master):
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_folder(stand_in(master))


def test_one_machine_has_a_folder_of_its_own():
    assert session.shared_folder(stand_in("local[2]"))


def test_means_of_all_numeric_types(frame):
    df = frame([(1, 2, 3.0)], "a smallint, b tinyint, c double").selectExpr("*", "CAST(4 AS DECIMAL(10, 2)) AS d", "'x' AS e")
    assert ct.numeric_means(df).columns == ["a", "b", "c", "d"]
