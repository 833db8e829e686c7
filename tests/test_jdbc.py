"""No database is started here: these tests see what Spark is asked to do."""

import pytest

from millrace.fixed_values import ORDERS
from millrace.plans import LoadError, load_files
from millrace.sinks import overwrite_jdbc, staged_jdbc
from millrace.sinks import jdbc as jdbc_sinks
from millrace.sources import read_jdbc_table


class Recorder:
    """Stands for a reader or a writer: notes the options, returns itself."""

    def __init__(self, on_save=lambda: None):
        self.seen = {}
        self.on_save = on_save

    def format(self, name):
        self.seen["format"] = name
        return self

    def options(self, **options):
        self.seen.update(options)
        return self

    def mode(self, mode):
        self.seen["mode"] = mode
        return self

    def save(self):
        self.on_save()
        self.seen["saved"] = True

    def load(self):
        return self.seen


class Frame:
    def __init__(self, writer):
        self.write = writer
        self.sparkSession = None
        self.dealt_to = None

    def repartition(self, partitions):
        self.dealt_to = partitions
        return self


ACCESS = {"url": "jdbc:postgresql://db:5432/dwh", "user": "me", "password": "secret"}


def test_overwrite_options():
    writer = Recorder()
    frame = Frame(writer)
    overwrite_jdbc(**ACCESS, numPartitions="16", batchsize="10000")(frame, "orders_data")
    assert frame.dealt_to == 16  # a shuffle, so reading stays as wide as it is
    assert writer.seen == {
        "format": "jdbc",
        "dbtable": "orders_data",
        "driver": "org.postgresql.Driver",
        "mode": "overwrite",
        "numPartitions": "16",
        "batchsize": "10000",
        "saved": True,
        **ACCESS,
    }


class Observed:
    """A DataFrame whose observed write counts ``n`` rows."""

    def __init__(self, n, writer):
        self.n, self.write, self.sparkSession = n, writer, "session"

    def observe(self, observation, *_):
        observation.get = {"n": self.n}
        return self


@pytest.fixture
def staged(spark, monkeypatch):
    """A staged sink over a database that says it has ``in_database`` rows."""
    monkeypatch.setattr(jdbc_sinks, "Observation", type("Seen", (), {}))

    def sink(in_database, swaps):
        class Count:
            def first(self):
                return (in_database,)

        def read(session, url, query, **_):
            assert query == "(SELECT count(*) AS n FROM orders_data__staging) staged"
            return Count()

        monkeypatch.setattr(jdbc_sinks, "read_jdbc_table", read)
        return staged_jdbc(lambda *names: swaps.append(names), **ACCESS)

    return sink


def test_staged_load_swaps_after_the_counts_agree(staged):
    swaps, writer = [], Recorder()
    staged(7, swaps)(Observed(7, writer), "orders_data")
    assert writer.seen["dbtable"] == "orders_data__staging"
    assert swaps == [("orders_data__staging", "orders_data")]


def test_rows_inserted_twice_keep_the_old_table(staged):
    swaps = []
    with pytest.raises(RuntimeError, match="has 9 rows, 7 were written"):
        staged(9, swaps)(Observed(7, Recorder()), "orders_data")
    assert swaps == []


def test_a_failed_write_keeps_the_old_table(staged):
    def fail():
        raise OSError("connection reset")

    swaps = []
    with pytest.raises(OSError):
        staged(0, swaps)(Observed(7, Recorder(on_save=fail)), "orders_data")
    assert swaps == []


def test_partitioned_read_options():
    session = type("Session", (), {"read": Recorder()})()
    seen = read_jdbc_table(
        session, ACCESS["url"], "orders_data", "id", 0, 1000, 8, user="me", fetchsize="10000"
    )
    assert seen == {
        "format": "jdbc",
        "url": ACCESS["url"],
        "dbtable": "orders_data",
        "user": "me",
        "fetchsize": "10000",
        "partitionColumn": "id",
        "lowerBound": "0",
        "upperBound": "1000",
        "numPartitions": "8",
    }


def test_an_absent_driver_fails_the_load(spark, csv_file):
    path = csv_file(f"{ORDERS}.csv", "order_purchase_timestamp", "2020-01-01")
    with pytest.raises(LoadError) as failure:
        load_files(spark, [path], overwrite_jdbc(**ACCESS))
    assert "org.postgresql.Driver" in str(failure.value.__cause__)


def test_a_table_in_one_task_is_refused():
    with pytest.raises(ValueError, match="partition column"):
        read_jdbc_table(None, "jdbc:x", "orders_data")
