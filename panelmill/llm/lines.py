"""Line dedup over levelled sorted runs of line hashes."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelmill.llm.common import stored
from panelmill.runtime import scratch_path

# The white space that is stripped and the letters that are folded.
SPACE = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

MIN_CHARS = 20
MIN_DOCS = 3
BATCHES = 4
FANOUT = 3


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(SPACE)), UPPER, LOWER)


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_hashes(docs: DataFrame, min_chars: int) -> DataFrame:
    """``doc_id, text_hash, at, key``: every line long enough to be judged, with the hash of its key."""
    lines = docs.where("doc_id IS NOT NULL").select(
        "doc_id",
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"),
        F.posexplode(split_lines(F.col("text"))).alias("at", "line"),
    )
    # A line may be shorter than the bound only by being stripped, never longer.
    keyed = lines.where(F.char_length("line") >= min_chars).withColumn("folded", line_key(F.col("line")))
    return keyed.where(F.char_length("folded") >= min_chars).select(
        "doc_id", "text_hash", "at", F.unhex(F.md5("folded")).alias("key")
    )


@dataclass(frozen=True)
class Run:
    """A stored run: as a bucketed table, which joins without a shuffle, and as plain files, for unions."""

    table: DataFrame
    files: DataFrame


def _together(runs: list[Run]) -> DataFrame:
    return reduce(DataFrame.union, [run.files for run in runs])


@dataclass
class LineRuns:
    """Which lines were seen in how many documents, as levelled sorted runs.

    A run is a table bucketed and sorted by line hash: ``key, docs, top`` (the
    number of documents and the largest id).  Each batch is aggregated, then
    merge-anti-joined with the runs: keys not seen before become a run of level
    0, keys seen before go to ``repeats``.  ``fanout`` runs of a level are
    merged into one run of the next.  Every key is in exactly one run.
    """

    spark: SparkSession
    fanout: int = FANOUT
    runs: list[list[Run]] = field(default_factory=lambda: [[]])
    repeats: list[Run] = field(default_factory=list)

    def _write(self, df: DataFrame, label: str) -> Run:
        # As many buckets as shuffle partitions: each task writes one file.
        buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        name = f"line_{label}_{uuid.uuid4().hex}"
        writer = df.write.format("parquet").bucketBy(buckets, "key").sortBy("key")
        path = scratch_path(self.spark, name)
        writer.option("path", path).saveAsTable(name)
        return Run(self.spark.table(name), self.spark.read.schema(df.schema).parquet(path))

    def seen(self) -> list[Run]:
        return [run for level in self.runs for run in level]

    def add(self, hashes: DataFrame) -> None:
        """Take in a batch of ``doc_id, key`` rows whose documents no earlier batch held."""
        batch = hashes.select("doc_id", "key").distinct()
        batch = batch.groupBy("key").agg(F.count(F.lit(1)).alias("docs"), F.max("doc_id").alias("top"))
        if not self.seen():
            self._push(0, self._write(batch, "run"))
            return
        batch = self._write(batch, "batch").table
        fresh = reduce(lambda df, run: df.join(run.table, "key", "left_anti"), self.seen(), batch)
        known = [batch.join(run.table, "key", "left_semi") for run in self.seen()]
        self.repeats += [self._write(reduce(DataFrame.union, known), "repeats")]
        self._push(0, self._write(fresh, "run"))

    def _push(self, level: int, run: Run) -> None:
        if len(self.runs) <= level:
            self.runs.append([])
        self.runs[level].append(run)
        if len(self.runs[level]) >= self.fanout:
            merged = _together(self.runs[level])
            self.runs[level] = []
            self._push(level + 1, self._write(merged.repartition("key"), "run"))

    def common(self, min_docs: int) -> DataFrame:
        """``key, top`` of the lines that at least ``min_docs`` documents hold."""
        found = [run.files.where(F.col("docs") >= min_docs) for run in self.seen()]
        if self.repeats:
            repeats = _together(self.repeats).groupBy("key")
            repeats = repeats.agg(F.sum("docs").alias("more"), F.max("top").alias("later"))
            repeats = self._write(repeats, "repeats").table
            total = F.col("docs") + F.coalesce("more", F.lit(0))
            found = [
                run.table.join(repeats, "key", "left")
                .where(total >= min_docs)
                .select("key", F.greatest("top", "later").alias("top"))
                for run in self.seen()
            ]
        if not found:
            return self.spark.createDataFrame([], "key binary, top long")
        return stored(reduce(DataFrame.union, [f.select("key", "top") for f in found]), "common-lines")


def dedup_lines(
    docs: DataFrame,
    min_chars: int = MIN_CHARS,
    min_docs: int = MIN_DOCS,
    batches: int = BATCHES,
    fanout: int = FANOUT,
) -> DataFrame:
    """``docs`` with ``kept`` (the text without dropped lines), ``n_lines`` and ``n_dropped``.

    A line's key is the line stripped of ASCII white space with A-Z lower-cased.
    Keys of at least ``min_chars`` characters that at least ``min_docs``
    documents hold lose all their lines except in the largest ``doc_id`` that
    holds it.  Documents are told apart by ``doc_id``: repeated rows of one id
    are one document and are cut alike; a row without an id keeps its lines and
    counts for none.  A null or empty text is one empty line; a document that
    loses every line keeps an empty text.  An empty table gives no rows.
    Other columns are kept; ones called like the added ones are replaced.
    """
    docs = docs.drop("kept", "n_lines", "n_dropped")
    spark = docs.sparkSession
    hashes = line_hashes(docs, min_chars).withColumn("batch", F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int"))
    path = scratch_path(spark, "line-hashes")
    hashes.write.option("compression", "zstd").partitionBy("batch").parquet(path)
    schema = "doc_id long, text_hash long, at int, key binary, batch int"
    hashes = spark.read.schema(schema).parquet(path)
    runs = LineRuns(spark, fanout)
    for number in range(batches):
        runs.add(hashes.where(F.col("batch") == number))
    common = runs.common(min_docs)
    # A line that a third of the documents hold is one key here: adaptive
    # execution splits its partition, since the other side has one row for it.
    dropped = hashes.join(common, "key").where("doc_id < top")
    drops = dropped.groupBy("doc_id", "text_hash").agg(F.collect_set("at").alias("gone"))
    # The document's own columns travel as one, so that none can clash.
    rows = docs.select(F.col("doc_id").alias("line_doc"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("line_text"), _whole(docs))
    drops = drops.select(F.col("doc_id").alias("line_doc"), F.col("text_hash").alias("line_text"), "gone")
    joined = rows.join(drops, ["line_doc", "line_text"], "left")
    text = F.col("row").getField("text")
    lines = split_lines(text)
    none = F.array().cast("array<int>")
    # Bound to a variable, so that the lines are split once and not for every kept one.
    bound = F.struct(
        lines.alias("lines"),
        F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.coalesce("gone", none)).alias("at"),
    )
    rest = F.transform(F.array(bound), lambda b: F.array_join(F.transform(b["at"], lambda i: F.get(b["lines"], i)), "\n"))
    kept = F.when(F.col("gone").isNull(), F.coalesce(text, F.lit(""))).otherwise(rest[0])
    return joined.select(
        "row.*",
        kept.alias("kept"),
        F.size(lines).cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
    )


def _whole(df: DataFrame) -> Column:
    """All columns of a row as one struct, ``row``."""
    return F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in df.columns]).alias("row")
