import pytest

from demandloom.plans import storage


class Session:
    """The few settings that the folder is chosen by."""

    def __init__(self, master, checkpoint, warehouse):
        self.conf = {"spark.checkpoint.dir": checkpoint, "spark.sql.warehouse.dir": warehouse}
        self.sparkContext = self
        self.master = master

    def getCheckpointDir(self):
        return None


@pytest.mark.parametrize(
    "master, checkpoint, warehouse, want",
    [
        ("yarn", "hdfs://n/c", "file:/w", "hdfs://n/c"),
        ("yarn", None, "s3a://b/w/", "s3a://b/w/scratch"),
        ("local[4]", None, "file:/w", "file:/w/scratch"),
        ("local[4]", None, "/w", "/w/scratch"),
    ],
)
def test_the_shared_folder(master, checkpoint, warehouse, want):
    assert storage.shared_folder(Session(master, checkpoint, warehouse)) == want


@pytest.mark.parametrize("warehouse", ["/w", "file:/w"])
def test_a_cluster_needs_a_folder_that_is_shared(warehouse):
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        storage.shared_folder(Session("spark://h:7077", None, warehouse))
