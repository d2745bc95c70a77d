"""Language identification with language-bitmask n-gram filters.

Training counts, for character n-grams inside words (blanks around a word count as characters), in how many training texts
of a language each stands. A language keeps an n-gram when it is common there (``min_share`` of its texts) and not
far more common elsewhere (``ratio`` of the highest share). All languages' Bloom filters have the same size and hashes and
are stored bit-sliced: each slot holds a bitmask of languages, so the AND of a few slots answers for all languages at once.
A text's n-grams are looked up, ones are counted per language, each count is corrected for the filter's false positives
(from its fill), and the language with the largest corrected count wins; ties go to the first language by name.

Rows: null texts and texts without letters are ``und`` with score 0; a text none of whose n-grams is known gets the most
frequent training language with score 0; texts of any length are read whole, in slices; repeated rows get equal answers;
copies of one training text count once; without any training text all texts are ``und``. Languages may be any number.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, mix, store

SAMPLE_PER_LANGUAGE = 1500  # expected number of training texts of a language
MIN_SHARE = 0.01  # of the language's training texts
RATIO = 0.25  # of the share where the n-gram is most common
SIZES = (1, 2, 3, 4)
SLOTS = 1 << 21
HASHES = 3
_SLICE = 400_000  # characters looked up at a time
_STEP = np.uint64(0x9E3779B97F4A7C15)
_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def _codes(text: str) -> np.ndarray:
    """Lower-case letters as numbers, every run of anything else as one 0, with a 0 at both ends."""
    raw = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _is_letter()[raw]
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first character after a letter ends the word
    return np.concatenate(([0], np.where(letter, raw, 0)[keep], [] if len(raw) and not letter[-1] else [0])).astype(np.uint64)


def ngrams(text: str) -> np.ndarray:
    """Hashes of all n-grams of a text that do not cross from one word into another."""
    codes = _codes(text)
    blank = codes == 0
    out = []
    for size in SIZES:
        n = len(codes) - size + 1
        if n <= 0:
            break
        value = np.full(n, size, np.uint64)
        inner = np.zeros(n, bool)
        for k in range(size):
            value = mix(value * _STEP + codes[k : k + n])
            if 0 < k < size - 1:
                inner |= blank[k : k + n]
        if size == 1:
            inner = blank
        out.append(value[~inner])
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def _slots(grams: np.ndarray) -> list[np.ndarray]:
    """The slots of each n-gram, from two halves of its hash."""
    low, high = grams & np.uint64(0xFFFFFFFF), (grams >> np.uint64(32)) | np.uint64(1)
    return [((low + np.uint64(k) * high) % np.uint64(SLOTS)).astype(np.int64) for k in range(HASHES)]


@dataclass
class Filters:
    languages: list[str]
    masks: np.ndarray  # (slots, words of 64 languages)
    wrong: np.ndarray  # chance of a false positive, by language
    usual: str | None

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.languages or not any(map(str.isalpha, text)):
            return "und", 0.0
        seen, counts = 0, np.zeros(len(self.languages))
        at = 0
        while at < len(text):  # cut long texts outside words
            end = min(at + _SLICE, len(text))
            while end < len(text) and text[end].isalpha():
                end += 1
            grams = ngrams(text[at:end])
            at = end
            hit = None
            for slots in _slots(grams):
                hit = self.masks[slots] if hit is None else hit & self.masks[slots]
            seen += len(grams)
            for word in range(self.masks.shape[1]):
                own = hit[:, word]
                for bit in range(min(64, len(self.languages) - 64 * word)):
                    counts[64 * word + bit] += np.count_nonzero(own & np.uint64(1 << bit))
        true = np.maximum(0.0, (counts - seen * self.wrong) / (1 - self.wrong))
        best = int(true.argmax())
        if true[best] <= 0:
            return self.usual, 0.0
        others = np.delete(true, best).max(initial=0.0)
        return self.languages[best], float(true[best] / (true[best] + others))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts that hold each n-gram, by language, as this task saw them."""
    tally: dict[str, list[np.ndarray]] = {}
    held = 0

    def give():
        for lang, parts in tally.items():
            grams, texts = np.unique(np.concatenate(parts), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams.view(np.int64)), pa.array(texts.astype(np.int64))], names=["lang", "gram", "texts"])
        tally.clear()

    for batch in batches:
        for lang, text in zip(column(batch, "lang"), column(batch, "text")):
            own = np.unique(ngrams(text))
            tally.setdefault(lang, []).append(own)
            held += len(own)
            if held > 2_000_000:
                yield from give()
                held = 0
    yield from give()


def fit(spark: SparkSession, training: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> Filters:
    """Filters from about ``per_language`` rows of each language, chosen by a hash of the id; ``training``: doc_id, text, lang."""
    rows = training.where("lang is not null").select("doc_id", "text", "lang")
    sizes = rows.select("lang").groupBy("lang").count().withColumn("share", F.lit(float(per_language)) / F.col("count"))
    known = sizes.select("lang", "count").orderBy("lang").collect()  # one row a language
    if not known:
        return Filters([], np.zeros((SLOTS, 1), np.uint64), np.zeros(0), None)
    unit = F.pmod(F.xxhash64("doc_id", F.lit("language sample")), F.lit(1 << 30)) / float(1 << 30)
    sample = rows.where("text is not null").join(F.broadcast(sizes), "lang").where(unit < F.col("share")).select("lang", "text")
    sample = store(sample.dropDuplicates(["lang", "text"]), "languages")
    total = {r["lang"]: r["count"] for r in sample.groupBy("lang").count().collect()}
    languages = sorted(total)
    share = F.col("texts") / F.create_map(*[x for k, v in total.items() for x in (F.lit(k), F.lit(float(v)))])[F.col("lang")] if total else F.lit(0.0)
    grams = sample.mapInArrow(_counts, "lang string, gram long, texts long").groupBy("lang", "gram").agg(F.sum("texts").alias("texts")).withColumn("share", share)
    common = grams.where(F.col("share") >= MIN_SHARE)  # so a language has at most (n-grams of a text) / MIN_SHARE of them
    top = common.groupBy("gram").agg(F.max("share").alias("top"))
    kept = common.join(top, "gram").where(F.col("share") >= RATIO * F.col("top")).select("lang", "gram").toArrow()
    rows_of = {r["lang"]: r["count"] for r in known}  # of all training rows, not of the sample
    masks = np.zeros((SLOTS, (len(languages) + 63) // 64 or 1), np.uint64)
    lang = np.array(kept["lang"].to_pylist(), object)
    gram = kept["gram"].to_numpy().view(np.uint64)
    wrong = np.zeros(len(languages))
    for k, name in enumerate(languages):
        own = gram[lang == name]
        used = np.zeros(SLOTS, bool)
        for slots in _slots(own):
            used[slots] = True
        masks[used, k // 64] |= np.uint64(1 << (k % 64))
        wrong[k] = used.mean() ** HASHES
    return Filters(languages, masks, wrong, max(languages, key=lambda x: (rows_of[x], x)) if languages else None)


def predict(spark: SparkSession, documents: DataFrame, filters: Filters) -> DataFrame:
    """doc_id, lang_pred, score of every document."""
    shared = spark.sparkContext.broadcast(filters)  # SLOTS masks, whatever the data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [shared.value.predict(t) for t in column(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in out], pa.string()), pa.array([y for _, y in out], pa.float64())], names=["doc_id", "lang_pred", "score"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")
