"""What the streams with state of their own share."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor

#: Fixed value: the only provider that holds several named states for a key.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_state(rows: DataFrame, key: str, processor: StatefulProcessor, schema: str, time: str = "none") -> DataFrame:
    """Rows through a processor with typed states for each key; the session's streams use RocksDB from then on."""
    conf = rows.sparkSession.conf
    if conf.get("spark.sql.streaming.stateStore.providerClass", "") != PROVIDER:
        conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    return rows.groupBy(key).transformWithStateInPandas(processor, schema, "append", time)


def together(frames: Iterator[pd.DataFrame]) -> pd.DataFrame:
    """A key's rows of a batch."""
    return pd.concat(list(frames), ignore_index=True)
