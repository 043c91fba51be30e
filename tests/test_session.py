"""Session helpers: SQL settings on a caller's session, checkpoint folder, package shipping."""

import zipfile

from cobbler import session


def test_apply_sql_conf_sets_broadcast_policy(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10MB")
    session.apply_sql_conf(spark)
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == "-1"
    assert spark.conf.get("spark.sql.session.timeZone") == "UTC"
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true"


def test_checkpoint_dir_comes_from_the_session(spark):
    configured = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    got = session.ensure_checkpoint_dir(spark)
    assert got == (configured or "/tmp/cobbler-checkpoints")


def test_shipped_zip_holds_every_module(spark, monkeypatch):
    added = []
    monkeypatch.setattr(session, "_SHIPPED", set())
    monkeypatch.setattr(type(spark.sparkContext), "addPyFile", lambda self, path: added.append(path))
    session.ship_package(spark)
    names = set(zipfile.ZipFile(added[0]).namelist())
    for mod in ("cobbler/__init__.py", "cobbler/operators/cart.py", "cobbler/functions/cart_fold.py",
                "cobbler/plans/materialize.py", "cobbler/session.py"):
        assert mod in names
