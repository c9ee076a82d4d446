"""Secret scans over content-addressed blobs with an incremental ledger."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelmill.llm.common import stored
from panelmill.runtime import attach, release, scratch_path


@dataclass(frozen=True)
class Rule:
    """A kind of secret: what matches, the least length of which group, and the version of this rule."""

    kind: str
    pattern: str
    group: int
    least: int
    version: str = "1"

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


# Kinds in their order.  A run of one character class that must
# have a least length is matched with that length, which finds the same runs.
RULES = (
    Rule(
        "assign",
        r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        12,
    ),
    Rule("access", r"AKIA[A-Z0-9]{14,}", 0, 18),
    Rule("hex", r"[0-9a-f]{16,}", 0, 16),
)
# What an earlier version of the first rule knew; the third rule is younger still.
EARLIER_RULES = (
    Rule("assign", r"""(?i)(password|passwd)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, version="0"),
    RULES[1],
)
HEAVY_BLOBS = 1000
SCANS = "blob string, rule string"
FINDINGS = "blob string, rule string, start long, end long"


def blob_id(text: Column) -> Column:
    return F.sha2(text, 256)


def find_spans(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``blob, rule, start, end`` for each match in ``blob, text, wanted``; code points, end exclusive.

    ``wanted`` lists the keys of the rules to apply to a text; a rule that it
    does not list is not evaluated.  Matches of a rule are leftmost and do not
    overlap; those whose group is too short are dropped afterwards.  Positions
    are running sums over the matches and the pieces between them, one row per
    match.
    """
    per_rule, hit = [], None
    for rule in rules:
        matched = F.array_contains("wanted", rule.key) & F.col("text").rlike(rule.pattern)
        hit = matched if hit is None else hit | matched
        pattern = F.lit(rule.pattern)
        whole = F.regexp_extract_all("text", pattern, F.lit(0))
        group = F.regexp_extract_all("text", pattern, F.lit(rule.group)) if rule.group else whole
        gaps = F.split("text", rule.pattern, -1)
        pieces = F.arrays_zip(
            F.transform(gaps, F.char_length).alias("gap"),
            F.transform(whole, F.char_length).alias("match"),
            F.transform(group, F.char_length).alias("group"),
        )
        found = F.struct(F.lit(rule.key).alias("rule"), F.lit(rule.least).alias("least"), pieces.alias("found"))
        per_rule.append(F.when(F.array_contains("wanted", rule.key), found))
    by_rule = blobs.where(hit).select("blob", F.explode(F.array(*per_rule)).alias("r"))
    rows = by_rule.select("blob", "r.rule", "r.least", F.posexplode("r.found").alias("i", "f"))
    # The last piece has no match behind it.
    rows = rows.where("f.match IS NOT NULL")
    # A text that came in twice is counted once.
    rows = rows.repartition("blob", "rule").dropDuplicates(["blob", "rule", "i"])
    run = Window.partitionBy("blob", "rule").orderBy("i")
    ended = rows.withColumn("end", F.sum(F.col("f.gap") + F.col("f.match")).over(run).cast("long"))
    return ended.where("f.group >= least").select(
        "blob", "rule", (F.col("end") - F.col("f.match")).alias("start"), "end"
    )


class BlobLedger:
    """Which rule versions a blob was scanned by, and what was found.

    ``scans`` (``blob, rule``) and ``findings`` are append-only tables in one
    folder.  Findings are written before the scans that vouch for them; if the
    job fails in between, the next scan finds the pairs unseen again and
    repeated findings are read as one.  A rule is known by its kind and version:
    a new version of one rule does not have the others scan again.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None) -> None:
        self.spark = spark
        self.folder = folder or scratch_path(spark, "blob-ledger")

    def _table(self, name: str, schema: str) -> DataFrame:
        empty = self.spark.createDataFrame([], schema)
        empty.write.mode("append").parquet(f"{self.folder}/{name}")
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}")

    def scans(self) -> DataFrame:
        return self._table("scans", SCANS)

    def findings(self) -> DataFrame:
        return self._table("findings", FINDINGS)

    def scan(self, docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """Scan the pairs of blobs of ``doc_id, text`` and rule versions that the ledger has not seen.

        Returns ``doc_id, blob`` for every row (each version of each path).
        """
        content = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn(
            "blob", blob_id(F.col("text"))
        )
        paths = stored(content.select("doc_id", "blob"), "blob-paths")
        keys = F.array(*[F.lit(r.key) for r in rules])
        # One row stands for each blob; it is found by id and address, so
        # thousands of copies of one text are spread over the shuffle.
        blobs = paths.groupBy("blob").agg(F.min("doc_id").alias("doc_id"))
        done = self.scans().groupBy("blob").agg(F.collect_set("rule").alias("done"))
        none = F.array().cast("array<string>")
        pairs = blobs.join(done, "blob", "left").withColumn("wanted", F.array_except(keys, F.coalesce("done", none)))
        unseen = stored(pairs.where(F.size("wanted") > 0).select("blob", "doc_id", "wanted"), "unseen-blobs")
        wanted = unseen.select(F.col("blob").alias("b"), F.col("doc_id").alias("d"), "wanted")
        same_row = (F.col("blob") == F.col("b")) & F.col("doc_id").eqNullSafe(F.col("d"))
        texts = content.join(wanted, same_row).select("blob", "text", "wanted")
        find_spans(texts, rules).write.mode("append").parquet(f"{self.folder}/findings")
        scans = unseen.select("blob", F.explode("wanted").alias("rule"))
        scans.write.mode("append").parquet(f"{self.folder}/scans")
        return paths

    def spans(self, rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """``blob, spans`` of the blobs in which these rule versions found something, sorted by start, then rule."""
        ranks = F.create_map(*[F.lit(x) for i, r in enumerate(rules) for x in (r.key, i)])
        kinds = F.create_map(*[F.lit(x) for r in rules for x in (r.key, r.kind)])
        mine = self.findings().where(F.col("rule").isin([r.key for r in rules])).distinct()
        span = F.struct("start", ranks[F.col("rule")].alias("rank"), "end", kinds[F.col("rule")].alias("kind"))
        return mine.groupBy("blob").agg(F.sort_array(F.collect_list(span)).alias("spans"))


def scan_documents(
    docs: DataFrame, ledger: BlobLedger | None = None, rules: tuple[Rule, ...] = RULES
) -> DataFrame:
    """``doc_id, blob, spans`` for each row of ``doc_id, text``: spans sorted by start, then kind.

    Rows with equal text share one blob, which is scanned once per version of
    a rule.  A null text is empty; repeated rows stay; a row without findings
    has an empty array; an empty table gives no rows; other columns are not read.
    """
    return scan_versions([(docs, rules)], ledger or BlobLedger(docs.sparkSession))


def scan_versions(batches: Sequence[tuple[DataFrame, tuple[Rule, ...]]], ledger: BlobLedger) -> DataFrame:
    """Historical batches of ``doc_id, text``, each scanned as it comes by the rules of its time, through one ledger.

    The rows of all batches are then joined to what the last batch's rules find
    in them; earlier batches are scanned again by rules that have changed since,
    and by these alone.  Columns and cases are those of ``scan_documents``.
    """
    latest = batches[-1][1]
    paths = None
    for docs, rules in batches:
        own = ledger.scan(docs, rules)
        paths = own if paths is None else paths.unionByName(own)
    for docs, rules in batches[:-1]:
        if {r.key for r in latest} - {r.key for r in rules}:
            release(ledger.scan(docs, latest))
    return attach_spans(paths, stored(ledger.spans(latest), "blob-spans"))


def attach_spans(paths: DataFrame, spans: DataFrame) -> DataFrame:
    """``doc_id, blob, spans`` for each path, an empty array where its blob has none.

    A blob with more than one in ``HEAVY_BLOBS`` of all paths is heavy, so fewer
    than that many are; they are attached without a shuffle of their paths
    where their size allows it, the others by an ordinary join.
    """
    none = F.array().cast("array<struct<start:bigint,rank:int,end:bigint,kind:string>>")
    found = F.coalesce("spans", none)
    counts = paths.groupBy("blob").agg(F.count(F.lit(1)).alias("n"))
    heavy = counts.where(F.col("n") > paths.count() / HEAVY_BLOBS).join(spans, "blob", "left")
    marked = attach(paths, heavy.select("blob", found.alias("heavy_spans")), ["blob"], "left")
    light = marked.where("heavy_spans IS NULL").select("doc_id", "blob").join(spans, "blob", "left")
    return light.select("doc_id", "blob", found.alias("spans")).unionByName(
        marked.where("heavy_spans IS NOT NULL").select("doc_id", "blob", F.col("heavy_spans").alias("spans"))
    )
