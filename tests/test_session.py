"""Session helpers: shared checkpoint folder."""

from kpiforge.session import checkpoint_root


def test_checkpoint_root_is_read_from_the_session(spark):
    root = checkpoint_root(spark)
    assert root and root == spark.sparkContext.getCheckpointDir()
    assert checkpoint_root(spark) == root  # stable: never replaced once set
