"""Token counts and spelling variants against plain readings of their contracts."""

import random
import re
import zlib
from collections import Counter

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from netsift.llm import queries, spelling, token_counts

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    "", " ", "\n\t\r\x0b\x0c", "it's <|endoftext|><|startoftext|> x", "<|ENDOFTEXT|> <|endoftext|", "á ́b é", " x y　", "ΑΣ ΟΔΟΣ, Σ",
    "가각 ㄱㅏ", "\x1c\x1d a\x85b", "x" * 5000, "1234567890 3.14 don't we'll", "🎉🎉 👩‍👩‍👧", "İstanbul ǅ ß", "\u0000 a",
]


def strings(n, seed):
    rng = random.Random(seed)
    alphabet = "abcXYZ'sß éÉ́\n\t.,<|>129_ 한글Σς🎉" + " " * 6
    out = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(n)]
    return out + [o.replace("X", "<|endoftext|>") for o in out[: n // 4]]


def test_counts_equal_the_library():
    library = Tokenizer.from_file(PATH)
    with open(PATH, "rb") as f:
        counts = token_counts.Counts(f.read())
    for text in ODD + strings(4000, 5):
        assert counts.of(text) == len(library.encode(text, add_special_tokens=False).ids), repr(text)


def test_only_misses_are_encoded_and_the_cache_grows(spark, tmp_path, monkeypatch):
    library = Tokenizer.from_file(PATH)
    texts = [None, *ODD, *strings(60, 6)]
    rows = [(k % 70, t) for k, t in enumerate(texts * 3)] + [(None, "some  words"), (None, " some\nwords ")] + [(900 + k, "hot text") for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    want = Counter((i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in rows)
    cache = str(tmp_path / "cache")
    asked = []
    encode = token_counts.encode

    def watched(spark, texts, path):
        asked.append(texts.count())
        return encode(spark, texts, path)

    monkeypatch.setattr(token_counts, "encode", watched)
    first = token_counts.count(spark, docs, PATH, cache, limit=20).collect()
    assert Counter((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in first) == want
    assert all(r["over_limit"] == (r["n_tokens"] > 20) for r in first)
    again = token_counts.count(spark, docs, PATH, cache, limit=20).collect()
    assert sorted(map(str, again)) == sorted(map(str, first))
    assert len(asked) == 1 and asked[0] == len({r["digest"] for r in first})
    more = token_counts.count(spark, docs.union(spark.createDataFrame([(5, "entirely new")], "doc_id long, text string")), PATH, cache)
    assert more.count() == len(rows) + 1 and asked[1:] == [1]
    monkeypatch.setattr(token_counts, "MISSES", 0)  # the way for many misses beside a filled cache
    more = token_counts.count(spark, docs.union(spark.createDataFrame([(5, "new once more"), (6, "and again")], "doc_id long, text string")), PATH, cache)
    assert more.count() == len(rows) + 2 and asked[2:] == [2]


def brute_words(rows):
    out = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            out[run] += 1
    return {w: n for w, n in out.items() if len(w) >= 7 and n >= 2}


def brute_near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute_variants(rows):
    words = brute_words(rows)
    near = {w: [v for v in words if brute_near(w, v)] for w in words}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 10 * words[w] else None
    out = set()
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, words[w], len(near[w]), form[w], words[form[w]] if form[w] else None, root))
    return out


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(8)
    stems = ["running", "remember", "grüßenÀ", "naïveté×", "aaaaaaa", "abcabcabc", "translation", "x" * 90]
    rows = []
    for k in range(120):
        words = []
        for _ in range(40):
            w = rng.choice(stems[:3] if rng.random() < 0.7 else stems)
            for _ in range(rng.choice([0, 0, 0, 0, 1, 1, 2])):
                at = rng.randrange(len(w) + 1)
                w = rng.choice([w[:at] + rng.choice("abcÀé") + w[at:], w[:at] + w[at + 1 :], w[:at] + rng.choice("abxß") + w[at + 1 :]])
            words.append(w.upper() if rng.random() < 0.1 else w)
        rows.append((rng.choice([k, k, None]), " ".join(words)))
    return rows + [(1, None), (2, ""), (3, "ab " * 10), *rows[:3]]


@pytest.mark.parametrize("tile", [spelling.TILE, 7])
def test_variants_equal_brute_force(spark, texts, tile):
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    got = [tuple(r) for r in spelling.variants(spark, docs, tile).select("word", "n", "n_near", "form", "form_n", "root").collect()]
    want = brute_variants(texts)
    assert len(got) == len(set(got)) and set(got) == want
    assert any(r[3] for r in want) and any(r[2] > 5 for r in want)


def test_chains_of_forms_lead_to_the_last(spark):
    counts = {"aaaaaaab": 2, "aaaaaaa": 20, "aaaaaac": 200, "aaaaaacd": 2000, "aaaaaacde": 20000, "aaaabbb": 7}
    found = spark.createDataFrame([(w, n) for w, n in counts.items()], "word string, n long")
    pairs = {frozenset((r["a"], r["b"])) for r in spelling.near_words(found).collect()}
    assert pairs == {frozenset((a, b)) for a in counts for b in counts if brute_near(a, b)}
    formed = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("d", "e"), ("e", None), ("f", "c")], "word string, form string")
    assert {tuple(r) for r in spelling._roots(formed).collect()} == {(w, "e") for w in "abcdf"}


@pytest.mark.parametrize("a, b", [("abcdefg", "abcdefg"), ("abcdefg", "abcdegf"), ("abcdefg", "abcdefgh"), ("abcdefg", "xbcdefg"), ("aabbaab", "abaabb"), ("aaaaaaaa", "aaaaaaa")])
def test_one_edit(a, b):
    assert spelling.one_edit(a, b) == spelling.one_edit(b, a) == brute_near(a, b)


def test_registered_queries_equal_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    library = Tokenizer.from_file(PATH)
    got = {tuple(r)[:4] for r in queries.op13_token_counts(spark, folder).select("doc_id", "n_bytes", "n_tokens", "over_limit").collect()}
    want = {(i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in docs}
    assert got == {(*w, w[2] > 2048) for w in want}
    got = {tuple(r) for r in queries.op12_spelling(spark, folder).select("word", "n", "n_near", "form", "form_n", "root").collect()}
    assert got == brute_variants(docs)
