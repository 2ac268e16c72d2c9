from __future__ import annotations

import os

import pytest

from quarry import session


class Conf(dict):
    def get(self, key, default=None):
        return dict.get(self, key, default)


class Stub:
    def __init__(self, master, **conf):
        self.conf = Conf(conf)
        self.sparkContext = type("Context", (), {"master": master, "applicationId": f"app-{master}"})()


def test_the_sessions_own_folder_comes_first():
    assert session.shared_dir(Stub("yarn", **{"spark.checkpoint.dir": "/shared"})) == "/shared"


def test_only_one_machine_may_leave_it_unset(monkeypatch):
    monkeypatch.delenv("QUARRY_SHARED_DIR", raising=False)
    for master in ("yarn", "spark://h:7077", "local-cluster[3,2,3000]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            session.shared_dir(Stub(master))
    one = Stub("local[2]")
    assert os.path.isdir(session.shared_dir(one)) and session.shared_dir(one) == session.shared_dir(one)


def test_tables_are_written_and_released(spark):
    df = session.materialize(spark.range(10), "numbers")
    assert df.count() == 10
    folder = session._tables(spark).removeprefix("file:")
    assert os.listdir(folder)
    session.release(spark)
    assert not os.path.exists(folder)
