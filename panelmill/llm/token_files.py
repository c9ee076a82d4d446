"""Token-id output: whole texts as Simple-8b files in ascending document order."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelmill.llm.simple8b import ids_in, read_image, split_images, write_image
from panelmill.llm.tokens import Encoder, encoded
from panelmill.runtime import attach, write_once

IMAGE_IDS = 131_072
FILE_IMAGES = 32
NUMBERS = ("part", "file")


def write_token_files(
    docs: DataFrame, tokenizer: str, end_id: int, image_ids: int = IMAGE_IDS, file_images: int = FILE_IMAGES
) -> str:
    """Encode ``doc_id, text`` and write Simple-8b files, in ascending document order; returns their folder.

    Documents are sorted by range, so each task holds a run of them and cuts it
    into images of whole documents (about ``image_ids`` ids; a longer document
    has an image of its own).  A file holds up to ``file_images`` images, a line
    feed behind each; files are ordered by the two numbers in their names.  A
    null or empty text is the end id alone, a null ``doc_id`` sorts first,
    repeated rows stay and follow each other, an empty table gives no image.
    Other columns are not read.

    Spark's text writer copies the bytes of its values as they are, so the
    executors write the files through its commit protocol, which keeps them
    whole when a task is run again.
    """
    narrow = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    run = narrow.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", "text")
    end = np.array([end_id], np.uint32)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer)
        names, lengths, held, size = [], [], [], 0

        def image() -> pa.RecordBatch:
            found = write_image(names, lengths, np.concatenate(held))
            return pa.RecordBatch.from_arrays([pa.array([found], pa.binary())], ["image"])

        for batch in batches:
            texts = encoded(encoder, batch.column("text"))
            for doc_id, found in zip(batch.column("doc_id").to_pylist(), texts, strict=True):
                names.append(doc_id)
                held += [found, end]
                lengths.append(len(found) + 1)
                size += lengths[-1]
                if size >= image_ids:
                    yield image()
                    names, lengths, held, size = [], [], [], 0
        if names:
            yield image()

    images = run.mapInArrow(encode, "image binary").select(F.col("image").cast("string"))
    return write_once(images, "token-files", "text", lineSep="\n", maxRecordsPerFile=str(file_images))


def placed_images(start: int, content: bytes) -> Iterator[tuple[int, memoryview]]:
    """The images of a file that begins with id ``start``, each with the number of its first id."""
    for image in split_images(content):
        yield start, image
        start += ids_in(image)


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of the files in a folder: ``doc_id, start, n_tokens, ids`` and the checksum of the ids.

    ``start`` counts the ids of all documents before it, over all files, by the
    heads of their images; ``ids`` is binary, little-endian unsigned 32-bit.  A
    damaged file is an error.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder)
    files = files.select(
        *[F.regexp_extract("path", r"part-(\d+)-.*-c(\d+)[^/]*$", i + 1).cast("long").alias(n) for i, n in enumerate(NUMBERS)],
        "content",
    )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [sum(map(ids_in, split_images(c.as_py()))) for c in batch.column("content")]
            columns = [*(batch.column(name) for name in NUMBERS), pa.array(n, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [*NUMBERS, "n_ids"])

    # One row per file.
    totals = files.mapInArrow(count, "part long, file long, n_ids long")
    before = Window.orderBy(*NUMBERS).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*NUMBERS, F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("start"))
    placed = attach(files, offsets, NUMBERS).select("start", "content")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files = zip(batch.column("start").to_pylist(), batch.column("content"), strict=True)
            for start, image in (found for at, content in files for found in placed_images(at, content.as_py())):
                names, lengths, ids = read_image(image)
                ends = np.cumsum(lengths)
                flat = ids.astype("<u4")
                parts = [flat[e - n : e].tobytes() for e, n in zip(ends, lengths, strict=True)]
                columns = [
                    pa.array(names, pa.int64()),
                    pa.array(start + ends - lengths, pa.int64()),
                    pa.array(lengths, pa.int64()),
                    pa.array(parts, pa.binary()),
                    pa.array([zlib.crc32(p) for p in parts], pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids", "ids_crc32"])

    return placed.mapInArrow(decode, "doc_id long, start long, n_tokens long, ids binary, ids_crc32 long")
