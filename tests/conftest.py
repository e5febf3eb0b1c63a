import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from ledgerlens.session import checkpoint_dir, get_spark  # noqa: E402

T0 = dt.datetime(2024, 1, 1)
TX_SCHEMA = ("hash string, block_number bigint, tx_index int, from_addr string, to_addr string, "
             "value_eth double, gas bigint, gas_price bigint, nonce int, is_error int, ts timestamp_ntz")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = get_spark("local[2]", app="ledgerlens-tests", shuffle_partitions=4)
    s.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(s, str(tmp_path_factory.mktemp("ckpt")))
    yield s


def tx_rows(spark, rows):
    """rows: dicts with at least from_addr and seconds offset ``t`` (float)."""
    out = []
    for i, r in enumerate(rows):
        out.append((r.get("hash", f"h{i:04d}"), r.get("block", i), r.get("idx", 0), r["from_addr"],
                    r.get("to_addr", f"r{i}"), float(r.get("value", 1.0)), r.get("gas", 21000),
                    r.get("gas_price", 1_000_000_000 + i), r.get("nonce", i), r.get("is_error", 0),
                    T0 + dt.timedelta(seconds=r["t"])))
    return spark.createDataFrame(out, TX_SCHEMA)
