import os
from types import SimpleNamespace

import pytest

from furrow.plans import storage


def test_tables_lie_in_one_folder_below_the_shared_one(spark):
    a, b = storage.shared_dir(spark), storage.shared_dir(spark)
    base = spark.conf.get("spark.checkpoint.dir")
    assert a != b and os.path.dirname(a) == os.path.dirname(b) and os.path.dirname(os.path.dirname(a)) == base.rstrip("/")
    assert storage.materialize(spark.range(3)).count() == 3


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "local-cluster[2,1,1024]"])
def test_a_cluster_needs_a_shared_folder(master):
    unset = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: default), sparkContext=SimpleNamespace(master=master))
    with pytest.raises(RuntimeError, match="checkpoint"):
        storage.shared_dir(unset)
