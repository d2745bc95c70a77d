"""Helpers that several text operators share: word hashes, intermediate tables, connected components."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netsift.session import shared_folder

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BLANKS = frozenset(b"\t\n\x0b\x0c\r ")
_STEP = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_CHUNK = 1 << 20  # bytes hashed at a time: bounds the work arrays of one very long text


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _STEP)
_powers: dict[str, np.ndarray] = {}


def _power(base: np.uint64, name: str, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 16), base, np.uint64)
        steps[0] = 1
        have = _powers[name] = np.cumprod(steps, dtype=np.uint64)
    return have[:n]


def _hash_chunk(raw: np.ndarray, prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of every word of a byte array, and of the first characters of words that are longer."""
    inside = np.concatenate(([False], ~_SPACE[raw], [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.empty(0, np.uint64), starts
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[raw] * _power(_STEP, "up", len(raw)), dtype=np.uint64)))
    value = (sums[ends] - sums[starts]) * _power(_BACK, "down", len(raw))[starts]
    hashes = mix(value + (ends - starts).astype(np.uint64))
    if not prefixes:
        return hashes, starts
    chars = np.flatnonzero((raw & 0xC0) != 0x80)
    first, chars = np.searchsorted(chars, starts), np.append(chars, len(raw))
    all_hashes, all_starts = [hashes], [starts]
    for n in prefixes:
        stop = chars[np.minimum(first + n, len(chars) - 1)]
        own = stop < ends
        value = (sums[stop[own]] - sums[starts[own]]) * _power(_BACK, "down", len(raw))[starts[own]]
        all_hashes.append(mix(mix(value + np.uint64(n)) + _STEP))  # never equal to the word of these characters
        all_starts.append(starts[own])
    order = np.argsort(np.concatenate(all_starts), kind="stable")
    return np.concatenate(all_hashes)[order], np.concatenate(all_starts)[order]


def word_hashes(texts: list[str | None], lower: bool = False, table: bytes | None = None, prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words (runs of anything but ASCII white space) of all texts, one after the other,

    and the offsets at which each text's words begin (one more than there are texts). Null counts as empty.
    ``lower`` turns A-Z into a-z first; ``table`` replaces bytes instead (256 of them, as bytes.translate takes them).
    ``prefixes``: numbers of characters; the beginnings of longer words are given out as further hashes.
    """
    parts = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    data = b"\n".join(parts)
    if lower or table:
        data = data.translate(table or LOWER)
    begins = np.concatenate(([0], np.cumsum([len(p) + 1 for p in parts]))) if parts else np.zeros(1, np.int64)
    hashes, starts, at = [], [], 0
    while at < len(data):
        end = min(at + _CHUNK, len(data))
        while end < len(data) and data[end] not in _BLANKS:  # never cut a word
            end += 1
        value, first = _hash_chunk(np.frombuffer(data, np.uint8, end - at, at), prefixes)
        hashes.append(value)
        starts.append(first + at)
        at = end
    if not hashes:
        return np.empty(0, np.uint64), np.zeros(len(begins), np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), begins)


def windows(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` neighbouring words."""
    n = len(words) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = words[:n].copy()
    for k in range(1, width):
        out = mix(out * _STEP + words[k : k + n])
    return out


_left: list[Callable[[], None]] = []


def leave(forget: Callable[[], None]) -> None:
    """Note how to free what this task leaves in its Python worker for the next task of the same operator."""
    _left.append(forget)


def tidy() -> None:
    """Free what an earlier operator's tasks left: Spark uses its workers again, and their memory adds up."""
    if _left:
        while _left:
            _left.pop()()
        gc.collect()
        pa.default_memory_pool().release_unused()


def column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def store(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate table to the shared folder and go on from the written rows."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/llm-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def components(spark: SparkSession, links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b); component is the smallest node reachable.

    Alternating star contraction: each round is two aggregations with joins, no group is ever collected, and a
    round that changes nothing ends it. Rounds are written out, so lineage stays short and lost executors cost
    one round at most.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = store(edges, "edges")
    mark = _mark(edges)
    while mark[0]:
        both = edges.union(edges.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        down = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = store(down.union(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        new = _mark(edges)
        if new == mark:
            break
        mark = new
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots.select("node", F.col("node").alias("component")))


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]
