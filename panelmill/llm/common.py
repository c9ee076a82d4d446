"""Stored tables and tokens shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import xxhash
from pyspark.sql import DataFrame, SparkSession

from panelmill.runtime import materialize


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: lineage ends here."""
    return materialize(df, label, compression="zstd")


# Spark's own filter of join keys: at most 8 MB, whatever the number of keys; asked of any size of table.
JOIN_FILTER = {
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0",
    "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": str(1 << 40),
    "spark.sql.optimizer.runtime.bloomFilter.expectedNumItems": "4000000",
    "spark.sql.optimizer.runtime.bloomFilter.numBits": str(1 << 26),
}


@contextmanager
def filtered_joins(spark: SparkSession) -> Iterator[None]:
    """Shuffle joins that run inside drop most rows without a partner before their exchange.

    The side that the filter is made from is a stored table behind a comparison.
    """
    before = {name: spark.conf.get(name) for name in JOIN_FILTER}
    for name, value in JOIN_FILTER.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def words(text: str | None) -> list[bytes]:
    """Words of a text: A-Z lower-cased, split at ASCII white space (space, tab to carriage return)."""
    return text.encode("utf-8", "replace").lower().split() if text else []


class WordHashes(dict):
    """64-bit hash of a word, remembered for up to ``limit`` words."""

    def __init__(self, limit: int = 200_000) -> None:
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value
