import pytest

from vocabmill.session import list_names, make_folder, remove_path, rename_path, scratch_path, scratch_root


class FakeSession:
    def __init__(self, root, master, system):
        class Conf:
            get = staticmethod(lambda name, default: root if name == "spark.checkpoint.dir" else system)

        class Hadoop:
            hadoopConfiguration = staticmethod(lambda: Conf)

        class Context:
            pass

        self.conf = Conf
        self.sparkContext = Context()
        self.sparkContext.master, self.sparkContext.applicationId = master, "app-1"
        self.sparkContext._jsc = Hadoop


def test_scratch_folder_is_the_one_the_cluster_names():
    assert scratch_root(FakeSession("hdfs:///shared/", "yarn", "file:///")) == "hdfs:///shared"
    path = scratch_path(FakeSession("hdfs:///shared", "yarn", "file:///"), "x")
    assert path.startswith("hdfs:///shared/vocabmill/x-")


def test_without_a_name_it_is_on_the_default_file_system():
    assert scratch_root(FakeSession(None, "local[2]", "file:///")) == "/tmp/checkpoints/app-1"
    assert scratch_root(FakeSession(None, "yarn", "hdfs://names")) == "/tmp/checkpoints/app-1"
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch_root(FakeSession(None, "yarn", "file:///"))


def test_folders(spark, tmp_path):
    root = str(tmp_path)
    assert list_names(spark, f"{root}/none") == []
    make_folder(spark, f"{root}/a")
    rename_path(spark, f"{root}/a", f"{root}/b")
    assert list_names(spark, root) == ["b"]
    remove_path(spark, f"{root}/b")
    assert list_names(spark, root) == []
