"""One query per operator over its whole table, with oracle SQL where SQL can express it."""

from __future__ import annotations

import zlib
from collections.abc import Callable
from functools import wraps
from pathlib import Path

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelmill.llm import (
    conversations,
    decontaminate,
    hilbert,
    jaccard,
    lines,
    lm,
    packing,
    private,
    quality,
    runs,
    secrets,
    token_files,
    topk,
)
from panelmill.llm.common import read_table

Query = Callable[[SparkSession, str], DataFrame]
BATCH_BYTES = 8 << 20
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(fn: Query) -> Query:
    @wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        find_package(spark)
        return fn(spark, sf_dir)

    QUERIES[fn.__name__] = run
    return run


def find_package(spark: SparkSession) -> None:
    """Lets Python workers import this package from where the driver has it, if they do not have it installed.

    Batches that go to workers are bounded by bytes as well, since ten thousand
    long texts make a large one.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.sparkContext.environment.setdefault("PYTHONPATH", str(Path(__file__).resolve().parents[2]))


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def fold(doc_id: str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``."""
    return F.crc32(F.encode(F.col(doc_id).cast("string"), "utf-8")) % parts


@query
def op1_decontamination(spark, sf_dir):
    return decontaminate.find_leaks(*(read_table(spark, sf_dir, n) for n in ("documents", "benchmark")))


@query
def op2_packing(spark, sf_dir):
    packed = packing.pack_documents(read_table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), end_id=0)
    return packed.drop("ids")


@query
def op3_jaccard_join(spark, sf_dir):
    return jaccard.jaccard_components(read_table(spark, sf_dir, "documents"))


# Two elements of one set differ in their number of words or in one of them; words hold no spaces.
ORACLES["op3_jaccard_join"] = r"""
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), listed AS (
  SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM worded
), following AS (
  SELECT doc_id, word || ' ' || lead(word, 1) OVER o || ' ' || lead(word, 2) OVER o || ' ' || lead(word, 3) OVER o AS e
  FROM listed WINDOW o AS (PARTITION BY doc_id ORDER BY i)
), shingles AS (
  SELECT doc_id, e FROM following WHERE e IS NOT NULL
  UNION ALL
  SELECT doc_id, array_to_string(w, ' ') FROM worded WHERE len(w) BETWEEN 1 AND 3
), gathered AS (
  SELECT doc_id, list_sort(list(DISTINCT e)) AS s FROM shingles GROUP BY doc_id
), sets AS (
  SELECT doc_id, coalesce(s, []) AS s FROM documents LEFT JOIN gathered USING (doc_id)
), classes AS (
  SELECT s, len(s) AS n, min(doc_id) AS class_id FROM sets WHERE len(s) > 0 GROUP BY s
), elements AS (
  SELECT class_id, n, unnest(s) AS e FROM classes
), links AS (
  SELECT a.class_id AS x, b.class_id AS y
  FROM elements a JOIN elements b ON a.e = b.e AND a.class_id < b.class_id
   AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY a.class_id, b.class_id, a.n, b.n
  HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), both_ways AS (
  SELECT x, y FROM links UNION ALL SELECT y, x FROM links
), reached AS (
  SELECT class_id AS x, class_id AS y FROM classes
  UNION
  SELECT r.x, b.y FROM reached r JOIN both_ways b ON r.y = b.x
), components AS (
  SELECT x, min(y) AS component_id FROM reached GROUP BY x
), counts AS (
  SELECT x, count(*) AS n_links FROM both_ways GROUP BY x
)
SELECT d.doc_id, CAST(len(d.s) AS BIGINT) AS n_shingles, coalesce(c.class_id, d.doc_id) AS class_id,
       CAST(coalesce(l.n_links, 0) AS BIGINT) AS n_links, coalesce(k.component_id, d.doc_id) AS component_id
FROM sets d LEFT JOIN classes c ON c.s = d.s LEFT JOIN components k ON k.x = c.class_id
LEFT JOIN counts l ON l.x = c.class_id
"""


@query
def op4_line_dedup(spark, sf_dir):
    found = lines.dedup_lines(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


ORACLES["op4_line_dedup"] = r"""
WITH split AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT doc_id, line, pos, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM split
), common AS (
  SELECT key, max(doc_id) AS top FROM keyed WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT k.doc_id, k.line, k.pos, coalesce(k.doc_id < c.top, false) AS gone
  FROM keyed k LEFT JOIN common c ON k.key = c.key
)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


@query
def op5_secret_scan(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    # Each document comes in one of two deliveries; the rules change in between.
    second = F.coalesce(fold("doc_id", 2) == 1, F.lit(False))
    deliveries = [(docs.where(~second), secrets.EARLIER_RULES), (docs.where(second), secrets.RULES)]
    found = secrets.scan_versions(deliveries, secrets.BlobLedger(spark))

    def shown(kept: Column) -> Column:
        return F.array_join(F.transform(kept, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"].isin([r.kind for r in secrets.RULES]))
    return found.select(
        "doc_id",
        *[count(r.kind) for r in secrets.RULES],
        F.sha2(shown(base), 256).alias("base_sha256"),
        shown(F.col("spans")).alias("spans"),
    )


def either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


# The same rules in a syntax where ignoring case would go beyond A-Z; quotes are doubled for SQL.
ORACLES["op5_secret_scan"] = r"""
WITH numbered AS (
  SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents
), cut AS (
  SELECT row, 'assign' AS kind, 0 AS rank, 12 AS least, string_split_regex(text, '{assign}') AS gaps,
         regexp_extract_all(text, '{assign}') AS found, regexp_extract_all(text, '{assign}', 2) AS part FROM numbered
  UNION ALL
  SELECT row, 'access', 1, 18, string_split_regex(text, 'AKIA[A-Z0-9]+'),
         regexp_extract_all(text, 'AKIA[A-Z0-9]+'), regexp_extract_all(text, 'AKIA[A-Z0-9]+') FROM numbered
  UNION ALL
  SELECT row, 'hex', 2, 16, string_split_regex(text, '[0-9a-f]{{16,}}'),
         regexp_extract_all(text, '[0-9a-f]{{16,}}'), regexp_extract_all(text, '[0-9a-f]{{16,}}') FROM numbered
), each AS (
  SELECT row, kind, rank, least, unnest(gaps[1:len(found)]) AS gap, unnest(found) AS found, unnest(part) AS part,
         generate_subscripts(found, 1) AS i
  FROM cut WHERE len(found) > 0
), placed AS (
  SELECT *, CAST(sum(length(gap) + length(found)) OVER (PARTITION BY row, rank ORDER BY i) AS BIGINT) AS stop FROM each
), kept AS (
  SELECT row, kind, rank, stop - length(found) AS start, stop FROM placed WHERE length(part) >= least
), shown AS (
  SELECT row, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
         count(*) FILTER (kind = 'hex') AS n_hex,
         string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS spans
  FROM kept GROUP BY row
)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM numbered LEFT JOIN shown USING (row)
""".format(
    assign="("
    + "|".join(map(either_case, ("password", "passwd", "secret", "token", "api_?key")))
    + r""")["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
)


@query
def op6_top_k(spark, sf_dir):
    vectors = read_table(spark, sf_dir, "embeddings").select(
        "vec_id",
        F.transform("embedding", lambda x: F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(F.floor(x.cast("double") * 64)).cast("double")).alias("vector"),
    )
    return topk.top_k(vectors, F.col("vec_id") % 20 == 0, k=20)


ORACLES["op6_top_k"] = """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS x
  FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, r.vec_id, CAST(list_inner_product(q.x, r.x) AS BIGINT) AS score
  FROM v q, v r WHERE q.vec_id % 20 = 0 AND q.vec_id <> r.vec_id
), ranked AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score
  FROM scored
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 20
"""


@query
def op7_token_files(spark, sf_dir):
    folder = token_files.write_token_files(
        read_table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), end_id=2
    )
    return token_files.read_token_files(spark, folder).drop("ids")


@query
def op8_quality(spark, sf_dir):
    docs, labels = (read_table(spark, sf_dir, n) for n in ("documents", "labels"))
    held_out = F.coalesce(fold("doc_id", 4) == 2, F.lit(False))
    scored = quality.classify(docs, labels, usable=~held_out)
    predicted = F.when(F.col("score") >= 0.7, 1).otherwise(0)
    return scored.select("doc_id", held_out.alias("held_out"), "score", predicted.alias("predicted"))


@query
def op9_hilbert_shards(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents").withColumn(
        "size", (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long")
    )
    positions = {
        "lang": F.col("lang"),
        "source": F.col("source"),
        "size": F.col("size").cast("double"),
    }
    sharded = hilbert.hilbert_shards(docs, positions, 24, key=["doc_id", "size"])
    return sharded.select(
        "doc_id",
        "size",
        F.crc32(F.encode(F.coalesce("text", F.lit("")), "utf-8")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query
def op10_lm_scores(spark, sf_dir):
    held_out = F.coalesce(fold("doc_id", 10) == 0, F.lit(False))
    scored = lm.score_documents(read_table(spark, sf_dir, "documents"), learn=~held_out)
    rest = [c for c in scored.columns if c not in ("doc_id", "learned")]
    return scored.select("doc_id", (~F.col("learned")).alias("held_out"), *rest)


def planted_repeats(doc_id: int, n: int) -> np.ndarray | None:
    """Word order of a document that repeats a stretch up to its end; one document in ten is chosen by its id."""
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    return np.where(at < a, at, a + (at - a) % p)


@query
def op11_periodic_runs(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    found = runs.find_runs(docs, least_words=6, least_periods=4, arrange=planted_repeats)
    # Ratios are compared by cross products; equal ones keep their order.
    best = F.expr(
        """array_sort(runs, (a, b) -> CASE
             WHEN a.length * b.period > b.length * a.period THEN -1
             WHEN a.length * b.period < b.length * a.period THEN 1
             WHEN a.start <> b.start THEN CAST(sign(a.start - b.start) AS INT)
             ELSE CAST(sign(a.period - b.period) AS INT) END)"""
    )
    found = found.withColumn("first", F.get(best, F.lit(0)))
    listed = F.array_join(
        F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), ""
    )
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "first.start",
        "first.length",
        "first.period",
        F.expr("first.length * 1000 DIV first.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def damaged(conversations_table: DataFrame) -> DataFrame:
    """Messages damaged by a checksum of their conversation and turn; a dropped one stays as a row that is not ``present``."""

    def shown(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    kind = F.crc32(F.encode(F.concat(shown("conv_id"), F.lit(":"), shown("turn")), "utf-8")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(shown("text"), ".!?", "")).otherwise(shown("text"))
    rows = conversations_table.select(
        "conv_id",
        "turn",
        F.when(kind == 4, "user").otherwise(shown("role")).alias("role"),
        text.alias("text"),
        (kind != 0).alias("present"),
        F.when(kind == 3, 2).otherwise(1).alias("copies"),
    )
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).drop("copies", "copy")


@query
def op12_conversation_repair(spark, sf_dir):
    rows = damaged(read_table(spark, sf_dir, "conversations"))
    plans = conversations.plan_repairs(rows, present=F.col("present"))
    return conversations.repaired_digests(rows, plans, present=F.col("present"))


def span_digest(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


@query
def op13_personal_data(spark, sf_dir):
    found = private.find_private(read_table(spark, sf_dir, "documents"))

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"].isin(*private.KINDS))
    return found.select(
        "doc_id",
        *[count(k) for k in private.KINDS],
        F.sha2(span_digest(base), 256).alias("base_sha256"),
        span_digest(F.col("spans")).alias("spans"),
    )
