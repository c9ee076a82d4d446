"""Roll-ups that take in new files only: mergeable partial states and a ledger."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelmill.functions.columns import bucket

# States of one bucket that reading merges before ``compact`` should fold them into one.
BATCHES = 32

Reader = Callable[[list[str]], DataFrame]


def partial_state(value: str) -> Column:
    """Count, mean, centred second moment and extremes of a column, as one mergeable struct; nulls are skipped."""
    n = F.count(value)
    return F.struct(
        n.alias("n"),
        F.avg(value).alias("mean"),
        (F.var_pop(value) * n).alias("m2"),
        F.min(value).alias("low"),
        F.max(value).alias("high"),
    )


def merged(states: Column) -> Column:
    """One state for an array of them: means and centred moments are shifted to the common mean, so nothing cancels."""
    empty = F.struct(
        F.lit(0).cast("long").alias("n"),
        F.lit(None).cast("double").alias("mean"),
        F.lit(None).cast("double").alias("m2"),
        F.lit(None).cast("double").alias("low"),
        F.lit(None).cast("double").alias("high"),
    )

    def both(a: Column, b: Column) -> Column:
        n = a["n"] + b["n"]
        share, apart = b["n"].cast("double") / n, b["mean"] - a["mean"]
        joined = F.struct(
            n.alias("n"),
            (a["mean"] + apart * share).alias("mean"),
            (a["m2"] + b["m2"] + apart * apart * a["n"] * share).alias("m2"),
            F.least(a["low"], b["low"]).alias("low"),
            F.greatest(a["high"], b["high"]).alias("high"),
        )
        return F.when(b["n"] == 0, a).when(a["n"] == 0, b).otherwise(joined)

    return F.aggregate(states, empty, both)


class RollupStore:
    """Partial states per (bucket, keys) in one folder, with the files they came from.

    A batch appends the states of its own buckets, in their order, and then one
    ledger entry per file.  States count only once the ledger names
    their batch, so a batch that died half way is as if it had not been, and its
    files are taken in again.  A file is known by path, length and modification
    time.  One writer at a time.
    """

    def __init__(
        self,
        spark: SparkSession,
        folder: str,
        *,
        measures: Sequence[str],
        keys: Sequence[str] = ("Name", "PTID"),
        ts: str = "timestamp",
        grain: str = "hour",
        label: str | None = None,
    ) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self.measures, self.keys, self.ts, self.grain, self.label = list(measures), list(keys), ts, grain, label
        # An entry-free file, so that a new folder can be read.
        spark.createDataFrame([], self._LEDGER).coalesce(1).write.mode("append").parquet(f"{self.folder}/ledger")

    # --- tables ---

    _LEDGER = "path string, length long, modified timestamp, batch string, replaces array<string>"

    def ledger(self) -> DataFrame:
        """One row per file taken in, and one without a path per compaction."""
        return self.spark.read.schema(self._LEDGER).parquet(f"{self.folder}/ledger")

    def batches(self) -> list[str]:
        """Batches that count: named by the ledger and not replaced by a compaction.  One entry per increment."""
        entries = self.ledger().select("batch", F.explode_outer("replaces").alias("gone")).distinct().collect()
        return sorted({e.batch for e in entries} - {e.gone for e in entries})

    def states(self) -> DataFrame:
        """All states that count: bucket, keys, ``rows``, one struct per measure, ``first`` label, ``batch``."""
        live = self.batches()
        if not live:
            raise ValueError(f"{self.folder} holds no batch yet")
        table = self.spark.read.option("basePath", f"{self.folder}/states")
        return table.parquet(*[f"{self.folder}/states/batch={b}" for b in live])

    # --- writing ---

    def take(self, pattern: str, read: Reader) -> int:
        """Take in the files of a glob that the ledger does not know; returns their number.

        ``read`` turns paths into rows with the timestamp, keys and measures; it
        is handed new files only.
        """
        files = self.spark.read.format("binaryFile").load(pattern).select("path", "length", "modificationTime")
        files = files.withColumnRenamed("modificationTime", "modified")
        new = files.join(self.ledger().where("path IS NOT NULL"), ["path", "length", "modified"], "left_anti")
        # The list of new files, which the reader's own listing holds on the driver as well.
        found = new.collect()
        if not found:
            return 0
        batch = uuid.uuid4().hex
        self._write(self._rolled(read([f.path for f in found])), batch)
        taken = [(f.path, f.length, f.modified, batch, None) for f in found]
        self._commit(taken)
        return len(found)

    def _commit(self, entries: list[tuple]) -> None:
        self.spark.createDataFrame(entries, self._LEDGER).coalesce(1).write.mode("append").parquet(f"{self.folder}/ledger")

    def _rolled(self, rows: DataFrame) -> DataFrame:
        """States of a batch, combined before the shuffle."""
        slot = bucket(F.col(self.ts), self.grain).alias("bucket")
        measures = [partial_state(m).alias(m) for m in self.measures]
        if self.label:
            text = F.col(f"`{self.label}`").alias("label")
            measures.append(F.min(F.struct(F.col(self.ts).alias("at"), text)).alias("first"))
        return rows.groupBy(slot, *self.keys).agg(F.count(F.lit(1)).alias("rows"), *measures)

    def _write(self, states: DataFrame, batch: str) -> None:
        """Files by range of buckets, so that a reader of some hours skips the others."""
        filed = states.repartitionByRange("bucket", *self.keys).sortWithinPartitions("bucket")
        filed.write.mode("overwrite").parquet(f"{self.folder}/states/batch={batch}")

    def compact(self) -> None:
        """Fold all batches that count into one; what it replaces is left for readers that are still at it."""
        old = self.batches()
        if len(old) < 2:
            return
        batch = uuid.uuid4().hex
        self._write(self._folded(), batch)
        self._commit([(None, None, None, batch, old)])

    # --- reading ---

    def _folded(self) -> DataFrame:
        """One state per (bucket, keys): at most one state per batch meets in a group."""
        columns = [F.sum("rows").alias("rows")]
        for m in self.measures:
            # In batch order, so that sums of doubles repeat.
            states = F.array_sort(F.collect_list(F.struct("batch", F.col(m).alias("state"))))
            columns.append(merged(F.transform(states, lambda s: s["state"])).alias(m))
        if self.label:
            columns.append(F.min("first").alias("first"))
        return self.states().groupBy("bucket", *self.keys).agg(*columns)

    def rollup(self) -> DataFrame:
        """Per (bucket, keys): ``rows`` and, per measure, ``_avg``, ``_min``, ``_max``, ``_std`` (sample) and ``_n``.

        A filter on the buckets reaches the scan of the states.
        """
        out = [F.col("bucket").alias(self.ts), *self.keys, "rows"]
        for m in self.measures:
            state = F.col(m)
            spread = F.when(state["n"] > 1, F.sqrt(state["m2"] / (state["n"] - 1)))
            parts = {"avg": state["mean"], "min": state["low"], "max": state["high"], "std": spread, "n": state["n"]}
            out += [column.alias(f"{m}_{name}") for name, column in parts.items()]
        if self.label:
            out.append(F.col("first")["label"].alias(self.label))
        return self._folded().select(*out)
