"""N-gram Jaccard join as a blocked sparse matrix product.

The document by shingle incidence matrix is multiplied with its transpose, block of shingles by block of shingles
(a block is what one task holds of the matrix, sorted by shingle). Size-derived bounds keep the product sparse: two
documents of a and b shingles can only be linked when they share at least ``3 (a + b) / 7`` of them (for 0.75), so a
common shingle stands among the first ``a / 4 + 1`` of the one and the first ``b / 7 + 1`` of the smaller other, under
any fixed order of shingles, and only those entries enter the product. Frequent shingles come last in that order.

An entry without another in its column that these bounds let it meet is left out where the columns are sorted.

What the product proposes must first pass a bound that is exact as well: each set has a parity sketch (every shingle
flips one of as many bits or more as there are shingles), and two sets differ in at least as many shingles as their sketches differ in
bits; of two lengths, the longer one is folded. What is left is verified on the whole sets, so links are exact.

Connected classes are the result, so pairs that verified links already connect are not proposed again: the first
passes multiply near neighbours in the columns of a set's first shingles and verify each set's most similar partners,
the last pass all pairs of documents that are still in different components.

Rows: null or wordless texts have an empty set and link with nothing; a text with fewer words than the width is one
shingle of its whole word sequence; equal sets are one class that enters the product once; repeated rows (also of one
id) are members of their class; a null id gets a row, but its class is named by the smallest id that is not null.
Shingles are 64-bit hashes of the words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import column, components, mix, store, tidy, windows, word_hashes

WIDTH = 5
CENSUS_SLOTS = 1 << 22  # fixed size of the table of frequent shingles that tasks share: 4 MB
_CENSUS_CHUNK = 2_000_000  # shingles that a task counts at a time
_FREQUENT = 2  # occurrences in different classes of one chunk
_BITS = 256  # of the shortest sketch
_FIRST = 8  # columns of a set that the first passes look at
_PASSES = 2  # first passes
_PARTNERS = 3  # that a first pass verifies for each set
_SALT = 400  # members that meet one copy of their block's leader


def shingle_sets(texts: list[str | None], width: int = WIDTH) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; A-Z are lower-cased."""
    words, at = word_hashes(texts, lower=True)
    out = []
    for lo, hi in zip(at[:-1], at[1:]):
        own = words[lo:hi]
        if 0 < len(own) < width:
            whole = np.full(1, len(own), np.uint64)
            for w in own:
                whole = mix(whole * np.uint64(31) + w)
            out.append(whole)
        else:
            out.append(np.unique(windows(own, width)))
    return out


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """Batches in small slices: what a task holds besides a batch stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _class_id(shingles: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)


def _sketch(shingles: np.ndarray) -> list[int]:
    """The bits that an odd number of shingles falls on, as 64-bit numbers; one bit or more a shingle."""
    bits = max(_BITS, 1 << (len(shingles) - 1).bit_length())
    odd = np.bincount((shingles >> np.uint64(20)).astype(np.int64) & (bits - 1), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()


_SETS = "doc_id long, n_shingles long, cls long, sketch array<long>, slot long, seen long"


def _sets_and_census(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("cls", pa.int64()), ("sketch", pa.list_(pa.int64())), ("slot", pa.int64()), ("seen", pa.int64())])
        held: list[np.ndarray] = []
        classes: set[int] = set()
        size = 0

        def census():
            tokens, seen = np.unique(np.concatenate(held), return_counts=True)
            often = seen >= _FREQUENT
            slot = (tokens[often] % np.uint64(CENSUS_SLOTS)).astype(np.int64)
            none = pa.nulls(len(slot), pa.int64())
            return pa.RecordBatch.from_arrays([none, none, none, pa.nulls(len(slot), pa.list_(pa.int64())), pa.array(slot), pa.array(seen[often].astype(np.int64))], schema=schema)

        for batch in _slices(batches):
            ids, n, cls, sketch = column(batch, "doc_id"), [], [], []
            for own in shingle_sets(column(batch, "text"), width):
                n.append(len(own))
                cls.append(_class_id(own) if len(own) else None)
                sketch.append(_sketch(own) if len(own) else None)
                if len(own) and cls[-1] not in classes:
                    classes.add(cls[-1])
                    held.append(own)
                    size += len(own)
                    if size >= _CENSUS_CHUNK:
                        yield census()
                        held, classes, size = [], set(), 0
            none = pa.nulls(len(ids), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(cls, pa.int64()), pa.array(sketch, pa.list_(pa.int64())), none, none], schema=schema)
        if held:
            yield census()

    return run


def _postings(width: int, percent: int, frequency):
    """The entries of the incidence matrix that can take part in the product: token, cls, n, pos."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        level = frequency.value
        done: set[int] = set()
        for batch in _slices(batches):
            tokens, cls, n, pos = [], [], [], []
            for own in shingle_sets(column(batch, "text"), width):
                if not len(own):
                    continue
                key = _class_id(own)
                if key in done:  # copies that other tasks hold fall out after the shuffle
                    continue
                done.add(key)
                size = len(own)
                keep = size - -(-percent * size // 100) + 1
                order = np.argsort((level[own % np.uint64(CENSUS_SLOTS)].astype(np.uint64) << np.uint64(58)) | (own >> np.uint64(6)), kind="stable")[:keep]
                tokens.append(own[order])
                cls.append(np.full(keep, key, np.int64))
                n.append(np.full(keep, size, np.int32))
                pos.append(np.arange(keep, dtype=np.int32))
            if len(done) > 200_000:
                done = set()
            if tokens:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.concatenate(cls)), pa.array(np.concatenate(n)), pa.array(np.concatenate(pos))], names=["token", "cls", "n", "pos"])

    return run


def _shared_columns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of entries sorted by (token, n, cls): those that can meet another one of their token in the product.

    Of two, the first must stand in its index prefix, and the second may be a third longer at most. So an entry needs
    the last index entry before it, which is the longest, or, being one itself, the next entry.
    """
    names = ["token", "cls", "n", "pos"]
    tail: list[np.ndarray] | None = None  # the last entry so far, not given out yet
    longest = 0  # size of the last index entry before it, of the same token

    def given(cols, meets):
        return pa.RecordBatch.from_arrays([pa.array(c[meets]) for c in cols], names=names)

    for batch in batches:
        cols = [batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in names]
        if tail is not None:
            cols = [np.concatenate((t, c)) for t, c in zip(tail, cols)]
        if not len(cols[0]):
            continue
        fresh = np.ones(len(cols[0]), bool)  # a copy of a class has the token, size and class of the row before
        fresh[1:] = (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1])
        cols = [c[fresh] for c in cols]
        token, _, n, pos = cols
        n = n.astype(np.int64)
        at, index = np.arange(len(n)), pos <= n // 7
        start = np.ones(len(n), bool)
        start[1:] = token[1:] != token[:-1]
        first = np.maximum.accumulate(np.where(start, at, 0))
        last = np.concatenate(([-1], np.maximum.accumulate(np.where(index, at, -1))[:-1]))
        before = np.where(last >= first, n[last], np.where(first == 0, longest, 0))
        meets = 3 * n <= 4 * before
        meets[:-1] |= index[:-1] & ~start[1:] & (3 * n[1:] <= 4 * n[:-1])
        end, longest = meets[-1], int(before[-1])
        meets[-1] = False
        if meets.any():
            yield given(cols, meets)
        tail = [c[-1:] for c in cols]
    if tail is not None and end:
        yield given(tail, np.ones(1, bool))


_PAIRS = "a long, b long, shared long, a_n int, b_n int, a_pos int, b_pos int"


def _cross_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Overlap counts of the pairs of classes of different components, over the columns of this block."""
    names = ["token", "n", "cls", "pos", "comp"]
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("shared", pa.int64()), ("a_n", pa.int32()), ("b_n", pa.int32()), ("a_pos", pa.int32()), ("b_pos", pa.int32())])

    def pairs(col):
        """All pairs of one column in slices: the smaller (first in order of size) must stand in its index prefix."""
        _, n, cls, pos, comp = col
        for i in range(len(n) - 1):
            if pos[i] > n[i] // 7:
                continue
            stop = int(np.searchsorted(n, n[i] * 4 // 3, side="right"))
            other = np.arange(i + 1, stop)
            other = other[comp[other] != comp[i]]
            if len(other):
                need = -(-3 * (n[i] + n[other]) // 7)
                other = other[(pos[i] + need <= n[i]) & (pos[other] + need <= n[other])]
            if len(other):
                k = len(other)
                yield [np.full(k, cls[i]), cls[other], np.ones(k, np.int64), np.full(k, n[i]), n[other], np.full(k, pos[i]), pos[other]]

    def total(parts):
        a, b, shared, a_n, b_n, a_pos, b_pos = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((b, a))
        a, b, shared, a_n, b_n, a_pos, b_pos = (x[order] for x in (a, b, shared, a_n, b_n, a_pos, b_pos))
        first = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))))
        return [a[first], b[first], np.add.reduceat(shared, first), a_n[first], b_n[first], np.maximum.reduceat(a_pos, first), np.maximum.reduceat(b_pos, first)]

    rest: list[np.ndarray] | None = None
    out: list[list[np.ndarray]] = []
    held = 0

    def flush():
        return pa.RecordBatch.from_arrays([pa.array(x.astype(t.type.to_pandas_dtype())) for x, t in zip(total(out), schema)], schema=schema)

    def take(cols, cuts):
        nonlocal held
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            for part in pairs([c[lo:hi] for c in cols]):
                out.append(part)
                held += len(part[0])
                if held > 500_000:
                    yield flush()
                    out.clear()
                    held = 0

    for batch in batches:
        cols = [batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in names]
        if rest is not None:
            cols = [np.concatenate((r, c)) for r, c in zip(rest, cols)]
        if not len(cols[0]):
            continue
        cuts = np.concatenate(([0], np.flatnonzero(cols[0][1:] != cols[0][:-1]) + 1))
        yield from take(cols, cuts)
        rest = [c[cuts[-1] :] for c in cols]
    if rest is not None:
        yield from take(rest, np.array([0, len(rest[0])]))
    if out:
        yield flush()


def _verify(width: int, percent: int):
    """Of blocks sorted (a, salt, role): the leader's text, then the members'; gives the pairs that are linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        leader, own = None, np.empty(0, np.uint64)
        for batch in _slices(batches):
            a, b, role = column(batch, "a"), column(batch, "b"), column(batch, "role")
            linked_a, linked_b = [], []
            for x, y, r, theirs in zip(a, b, role, shingle_sets(column(batch, "text"), width)):
                if _class_id(theirs) != (x if r == 0 else y):
                    continue  # another text under a repeated id
                if r == 0:
                    leader, own = x, theirs
                elif x == leader:
                    both = len(np.intersect1d(own, theirs, assume_unique=True))
                    if 100 * both >= percent * (len(own) + len(theirs) - both):
                        linked_a.append(x)
                        linked_b.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(linked_a, pa.int64()), pa.array(linked_b, pa.int64())], names=["a", "b"])

    return run


def _verified(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose whole sets reach the similarity; a's text meets its b's in salted blocks."""
    size = pairs.groupBy("a").agg(F.count("*").alias("members"))
    pairs = pairs.join(size, "a").withColumn("salt", F.pmod(F.xxhash64("b"), F.ceil(F.col("members") / _SALT))).select("a", "b", "salt")
    members = pairs.join(texts.withColumnRenamed("cls", "b"), "b").select("a", "salt", F.lit(1).alias("role"), "b", "text")
    leaders = pairs.select("a", "salt").distinct().join(texts.withColumnRenamed("cls", "a"), "a").select("a", "salt", F.lit(0).alias("role"), F.col("a").alias("b"), "text")
    blocks = members.union(leaders).repartition("a", "salt").sortWithinPartitions("a", "salt", "role")
    return blocks.mapInArrow(_verify(width, percent), "a long, b long")


def _texts(docs: DataFrame, ids: DataFrame, pairs: DataFrame) -> DataFrame:
    """cls, text of the classes in ``pairs``.

    Only texts whose id falls on a wanted slot are shuffled; there are CENSUS_SLOTS slots at most, so the broadcast
    stays small and only thins less when it fills up.
    """
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(CENSUS_SLOTS)).alias("slot")
    wanted = pairs.select(F.col("a").alias("cls")).union(pairs.select(F.col("b").alias("cls"))).distinct().join(ids, "cls")
    thin = docs.where("text is not null").select("doc_id", "text", slot).join(F.broadcast(wanted.select(slot).distinct()), "slot", "left_semi")
    own = thin.select(F.col("doc_id").alias("own"), "text")
    return store(wanted.join(own, F.col("doc_id").eqNullSafe(F.col("own"))).select("cls", "text"), "texts")


def _possible(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """Pairs (a, b) that their sizes and sketches allow, with ``off``: sketch bits that differ, per shingle."""
    first = sketches.select(F.col("cls").alias("a"), F.col("n").alias("a_n"), F.col("sketch").alias("a_sketch"))
    second = sketches.select(F.col("cls").alias("b"), F.col("n").alias("b_n"), F.col("sketch").alias("b_sketch"))
    both = pairs.join(first, "a").join(second, "b").where("3 * a_n <= 4 * b_n and 3 * b_n <= 4 * a_n")  # so one is twice as long at most
    length = F.least(F.size("a_sketch"), F.size("b_sketch"))

    def folded(name: str):
        halves = F.zip_with(F.slice(name, F.lit(1), length), F.slice(name, length + 1, length), lambda x, y: x.bitwiseXOR(y))
        return F.when(F.size(name) > length, halves).otherwise(F.col(name))

    bits = F.aggregate(F.zip_with(folded("a_sketch"), folded("b_sketch"), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    both = both.select("a", "b", "a_n", "b_n", bits.alias("bits")).where("7 * bits <= a_n + b_n")
    return both.select("a", "b", (F.col("bits") / (F.col("a_n") + F.col("b_n"))).alias("off"))


def classes(spark: SparkSession, documents: DataFrame, width: int = WIDTH, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id of every document; ``percent`` of at least 75 is the Jaccard threshold."""
    if percent < 75:
        raise ValueError("the bounds of the product hold for 75 percent and more")
    docs = documents.select("doc_id", "text")
    both = store(docs.mapInArrow(_sets_and_census(width), _SETS), "sets")
    sets = both.where("slot is null").select("doc_id", "n_shingles", "cls")
    level = np.zeros(CENSUS_SLOTS, np.uint8)
    census = both.where("slot is not null").groupBy("slot").agg(F.sum("seen").alias("seen"))  # CENSUS_SLOTS rows at most
    counts = census.toArrow()
    level[counts["slot"].to_numpy()] = np.minimum(63, np.log2(counts["seen"].to_numpy()).astype(np.uint8))
    frequency = spark.sparkContext.broadcast(level)

    entries = docs.mapInArrow(_postings(width, percent, frequency), "token long, cls long, n int, pos int")
    shared = store(entries.repartition("token").sortWithinPartitions("token", "n", "cls").mapInArrow(_shared_columns, "token long, cls long, n int, pos int"), "shared")

    ids = store(sets.where("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("doc_id")), "ids")
    sketches = both.where("cls is not null").select("cls", F.col("n_shingles").alias("n"), "sketch")
    sketches = store(sketches.join(shared.select("cls").distinct(), "cls", "left_semi").dropDuplicates(["cls"]), "sketches")

    # First passes: for each class the partners with the most similar sketches among its neighbours in a few columns.
    joined = spark.createDataFrame([], "node long, component long")
    rank = F.row_number().over(Window.partitionBy("cls").orderBy(F.xxhash64("token"), "token"))
    near = store(shared.select("token", "cls", "n", rank.alias("rank")).where(F.col("rank") <= _FIRST).select("token", "cls", "n"), "near")
    for turn in range(_PASSES):
        known = near.join(joined, F.col("cls") == F.col("node"), "left").select("token", "cls", "n", F.coalesce("component", "cls").alias("comp"))
        column_ = Window.partitionBy("token").orderBy(F.xxhash64("token", "cls", F.lit(turn)), "cls")
        steps = [F.struct(F.lag("cls", k).over(column_).alias("a"), F.lag("comp", k).over(column_).alias("a_comp"), F.lag("n", k).over(column_).alias("a_n")) for k in (1, 2, 4)]
        pairs = known.select("cls", "n", "comp", F.array(*steps).alias("steps")).select("cls", "n", "comp", F.explode("steps").alias("s"))
        pairs = pairs.where("s.a is not null and s.a_comp <> comp and 3 * s.a_n <= 4 * n and 3 * n <= 4 * s.a_n").select(F.least("cls", "s.a").alias("a"), F.greatest("cls", "s.a").alias("b")).distinct()
        likely = _possible(pairs, sketches)
        best = likely.groupBy("b").agg(F.slice(F.array_sort(F.collect_set(F.struct("off", "a"))), 1, _PARTNERS).alias("best"))  # 3 * _FIRST partners at most
        pairs = store(best.select(F.explode("best.a").alias("a"), "b"), "pairs")
        links = _verified(pairs, _texts(docs, ids, pairs), width, percent)
        links = links.union(joined.select(F.col("component").alias("a"), F.col("node").alias("b")))
        joined = store(components(spark, links), "joined")

    # Last pass: every pair that the bounds allow and that is not connected yet.
    known = shared.join(joined, F.col("cls") == F.col("node"), "left").select("token", "cls", "n", "pos", F.coalesce("component", "cls").alias("comp"))
    mixed = known.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("token")
    cross = known.join(mixed, "token").repartition("token").sortWithinPartitions("token", "n", "cls").mapInArrow(_cross_pairs, _PAIRS)
    pairs = cross.groupBy("a", "b").agg(F.sum("shared").alias("shared"), *[F.max(c).alias(c) for c in ("a_n", "b_n", "a_pos", "b_pos")])
    # common entries so far, and at most all that follow the last common one
    pairs = pairs.where("7 * (shared + least(a_n - a_pos, b_n - b_pos) - 1) >= 3 * (a_n + b_n)").select("a", "b")
    pairs = store(_possible(pairs, sketches).select("a", "b"), "pairs")
    more = store(_verified(pairs, _texts(docs, ids, pairs), width, percent), "links")
    joined = components(spark, more.union(joined.select(F.col("component").alias("a"), F.col("node").alias("b"))))

    # Names: the smallest id of all classes of a component.
    group = ids.join(joined, F.col("cls") == F.col("node"), "left").select("cls", F.coalesce("component", "cls").alias("comp"), "doc_id")
    names = group.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    named = group.join(names, "comp").select("cls", "component_id")
    return sets.join(named, "cls", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
