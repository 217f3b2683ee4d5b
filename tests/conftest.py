import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import pytest

from trackloom.session import build_session

SMALL = "/root/testdata/sf0.001"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests", "local[8]",
        spark__sql__streaming__stateStore__providerClass=ROCKSDB,
        spark__sql__shuffle__partitions="4",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture(scope="session")
def readings(spark):
    from trackloom.session import durable
    from trackloom.sources import derived

    return durable(derived.readings(spark, SMALL))


@pytest.fixture(scope="session")
def samples(spark, readings):
    from trackloom.operators import cleaning
    from trackloom.session import durable

    return durable(cleaning.clean_tracks(readings))


def rows(df, *columns):
    """Rows as sorted tuples, for comparing whole results."""
    chosen = df.select(*columns) if columns else df.select(*sorted(df.columns))
    return sorted((tuple(r) for r in chosen.collect()), key=lambda r: tuple((v is None, str(v)) for v in r))
