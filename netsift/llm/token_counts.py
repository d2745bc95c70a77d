"""Token counts through a digest cache: stored counts are joined by digest, only distinct misses are encoded and appended.

A text's key is the SHA-256 of its normalised content, the text with every run of ASCII white space as one space and none
at its ends; the tokenizer's key is the SHA-256 of its vocabulary file and library version, and names a folder of the
cache. The tokenizer drops white space and none of its special strings holds any, so texts of one digest have one count.
For the same reason a count is the sum over a text's white-space separated pieces (which are cut further between letters
or digits and marks such as a comma): a task asks the library for each distinct piece once and keeps a bounded number of answers.

The cache is append-only: every run adds one folder of (digest, n_tokens), complete when its ``_SUCCESS`` is there, so a
run that dies leaves nothing that is read. Two runs at once may store a digest twice, with the same count.

Work: the first pass makes digests only. A text travels once, after each task has cut its repeats, and only where its
digest is missing. Digests that own more than a 256th of all rows (at most 256 of them) are joined by broadcast.

Rows: null and empty texts have 0 bytes and 0 tokens; long texts are counted whole; repeated rows, null ids and ids that
stand for several texts each keep their row; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import re
import uuid
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, store

LIMIT = 2048
ENTRIES = "digest binary, n_tokens long"
HOT = 256  # a digest with more than a HOT-th of all rows is joined by broadcast
MISSES = 200_000  # up to so many missing digests (32 bytes each) are broadcast to leave known texts at home
_PIECES = 400_000  # answers a task keeps
_LONGEST = 64  # longer pieces are asked anew each time
# between a letter or digit and one of these marks the tokenizer always cuts, and no special string holds the marks
_INNER = re.compile(rb"(?<=[A-Za-z0-9])(?=[.,;:!?])|(?<=[.,;:!?])(?=[A-Za-z0-9])")


def digest(text: Column) -> Column:
    """Digest of the normalised content."""
    plain = F.btrim(F.regexp_replace(F.coalesce(text, F.lit("")), "[ \\t-\\r]+", " "), F.lit(" "))
    return F.unhex(F.sha2(plain, 256))


def version(path: str) -> str:
    """Digest that stands for a vocabulary file as this library reads it."""
    import tokenizers

    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + tokenizers.__version__.encode()).hexdigest()


class Counts:
    """Tokens of a text by the library, piece by piece."""

    def __init__(self, file: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the cores
        from tokenizers import Tokenizer

        self._library = Tokenizer.from_buffer(file)
        self._known: dict[bytes, int] = {}

    def _ask(self, pieces: list[bytes]) -> list[int]:
        found = self._library.encode_batch_fast([p.decode("utf-8", "replace") for p in pieces], add_special_tokens=False)
        return [len(x) for x in found]

    def _sum(self, pieces: Counter) -> int:
        """Tokens of all pieces; those not known are asked for and, as far as there is room, remembered."""
        known, total, new = self._known, 0, []
        for piece, n in pieces.items():
            got = known.get(piece)
            if got is None:
                new.append(piece)
            else:
                total += got * n
        if len(known) + len(new) > _PIECES:
            known.clear()
        for at in range(0, len(new), 1000):
            part = new[at : at + 1000]
            for piece, got in zip(part, self._ask(part)):
                if len(piece) <= _LONGEST and len(known) < _PIECES:
                    known[piece] = got
                total += got * pieces[piece]
        return total

    def of(self, text: str) -> int:
        pieces = Counter(text.encode("utf-8", "surrogatepass").split())  # bytes split at ASCII white space only
        fine: Counter = Counter()
        for piece in [p for p in pieces if p not in self._known and _INNER.search(p)]:
            n = pieces.pop(piece)
            for part in _INNER.split(piece):
                fine[part] += n
        for part, n in fine.items():
            pieces[part] += n
        return self._sum(pieces)


def encode(spark: SparkSession, texts: DataFrame, path: str) -> DataFrame:
    """(digest, n_tokens) of every row of ``texts`` (digest, text)."""
    with open(path, "rb") as f:
        file = spark.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = None
        for batch in batches:
            counts = counts or Counts(file.value)
            n = [counts.of(t) if t else 0 for t in column(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.binary()), pa.array(n, pa.int64())], names=["digest", "n_tokens"])

    return texts.select("digest", "text").mapInArrow(run, ENTRIES)


def read_cache(spark: SparkSession, folder: str) -> DataFrame | None:
    """All complete entries of one tokenizer's folder; None before the first."""
    Path = spark._jvm.org.apache.hadoop.fs.Path
    fs = Path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(Path(folder)):
        return None
    parts = [s.getPath().toString() for s in fs.listStatus(Path(folder))]
    parts = [p for p in parts if fs.exists(Path(f"{p}/_SUCCESS"))]
    return spark.read.schema(ENTRIES).parquet(*parts) if parts else None


def _misses(texts: DataFrame, rows: DataFrame, known: DataFrame | None) -> DataFrame | None:
    """One text for each digest that is not stored yet; None where all are."""
    if known is not None:
        missing = store(rows.select("digest").distinct().join(known, "digest", "left_anti"), "missing")
        n = missing.count()
        if n == 0:
            return None
        if n <= MISSES:
            texts = texts.join(F.broadcast(missing), "digest", "left_semi")
    one = texts.groupBy("digest").agg(F.first("text").alias("text"))  # each task sends a digest once
    return one if known is None or n <= MISSES else one.join(known, "digest", "left_anti")


def count(spark: SparkSession, documents: DataFrame, path: str, cache: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit and digest of every row; misses are added to the cache at ``cache``."""
    folder = f"{cache}/{version(path)}"
    texts = documents.select("doc_id", "text", digest(F.col("text")).alias("digest"))
    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    rows = store(texts.select("doc_id", n_bytes.alias("n_bytes"), "digest"), "digests")
    misses = _misses(texts, rows, read_cache(spark, folder))
    if misses is not None:
        encode(spark, misses, path).write.parquet(f"{folder}/{uuid.uuid4().hex}")
    counts = read_cache(spark, folder).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    often = rows.groupBy("digest").agg(F.count("*").alias("_n")).where(F.col("_n") > max(rows.count() // HOT, 1))
    hot = store(counts.join(often, "digest").select("digest", F.col("n_tokens").alias("_hot")), "hot")
    marked = rows.join(F.broadcast(hot), "digest", "left")
    rest = marked.where("_hot is null").join(counts, "digest").select("doc_id", "n_bytes", "n_tokens", "digest")
    all_rows = marked.where("_hot is not null").select("doc_id", "n_bytes", F.col("_hot").alias("n_tokens"), "digest").union(rest)
    return all_rows.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), F.lower(F.hex("digest")).alias("digest"))
