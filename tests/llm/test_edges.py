"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names, for every operator."""

import json
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from netsift.llm import cover_tree, language_id, line_quality, mixing, ngram_join, queries, secret_scan, tool_calls, toxicity

WORDS = "the cat sat on a mat and then it went to see what there was by the old river bank".split()
CLASH = ["size", "cls", "token", "slot", "node", "label", "component", "level", "count", "share", "_id", "_kept"]


def prose(n, seed):
    return " ".join(WORDS[(k * seed + k * k) % len(WORDS)] for k in range(n)) + "."


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    long = prose(30_000, 3)
    docs = [
        (1, prose(80, 5) + "\n" + prose(60, 7), "en", "a"), (2, prose(80, 5) + "\n" + prose(60, 7), "en", "a"), (2, prose(80, 5) + "\n" + prose(60, 7), "en", "a"),
        (3, None, "en", None), (4, "", None, "b"), (None, "no id here", "fr", "b"), (5, "password=abcdef12 1 2 3", "fr", "c"), (6, long, "en", "a"),
        (7, "\n\n \t", "de", None), (8, prose(80, 5) + "\n" + prose(58, 7), "en", "z"), (9, "idiot " + prose(60, 11), "de", "z"), (10, "₤ 1234", "de", "z"),
    ]
    extra = [F.lit(k).alias(c) for k, c in enumerate(CLASH)]
    out = {}
    for name in ("full", "empty"):
        folder = str(tmp_path_factory.mktemp(name))
        few = lambda df: df if name == "full" else df.limit(0)  # noqa: B023, E731
        d = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
        few(d.select("*", *extra)).write.parquet(f"{folder}/documents.parquet")
        labels = spark.createDataFrame([(k, 1, int(k == 9)) for k in range(1, 11)] + [(4, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
        few(labels.select("*", *extra[:4])).write.parquet(f"{folder}/labels.parquet")
        pages = spark.createDataFrame([(1, "u", "<article><p>One two three four five.</p></article>"), (1, "u", "<article><p>One two three four five.</p></article>"), (2, None, None), (None, "v", "")], "page_id long, url string, html string")
        few(pages.select("*", *extra[:4])).write.parquet(f"{folder}/pages.parquet")
        vectors = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], 2), (4, None, 1), (5, [0.0, 0.0], 1), (6, [float("nan"), 1.0], 1), (7, [1.0, None], 1), (8, [1.0], 1), (9, [1.0, 0.0], None), (None, [1.0, 0.0], 1), (10, [1e30, 1e20], 1)]
        few(spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").select("*", *extra[:5])).write.parquet(f"{folder}/embeddings.parquet")
        talk = [(1, 0, "user", "q"), (1, 1, "assistant", "text one"), (1, 1, "assistant", "text one"), (1, 2, "user", "a"), (None, 1, "assistant", "x"), (2, 3, "assistant", None), (2, None, "user", "t"), (3, 1, None, "t"), (2, 5, "assistant", 'say "hi"\n}{')]
        few(spark.createDataFrame(talk, "conv_id long, turn long, role string, text string").select("*", *extra[:5])).write.parquet(f"{folder}/conversations.parquet")
        out[name] = folder
    return out


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_every_query_on_odd_and_empty_tables(spark, tables, name):
    assert queries.QUERIES[name](spark, tables["empty"]).collect() == []
    rows = queries.QUERIES[name](spark, tables["full"]).collect()
    if name in ("op3_html", "op4_cover_tree", "op10_tool_calls"):
        assert len(rows) == {"op3_html": 4, "op4_cover_tree": 12, "op10_tool_calls": 3}[name]
    elif name in ("op11_collocations", "op12_spelling"):
        assert all(None not in (r["lang"], r["phrase"]) if name.startswith("op11") else r["root"] for r in rows)
    else:
        assert len(rows) == 12
    if name == "op13_token_counts":
        assert {(r["n_bytes"], r["n_tokens"]) for r in rows if r["doc_id"] in (3, 4)} == {(0, 0)}
    if name == "op4_cover_tree":
        got = {(r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in rows}
        assert {(1, 4, 1, True), (2, 4, 1, False), (10, 4, 1, False), (None, 4, None, False), (3, 0, 3, True), (5, 0, 5, True), (9, 0, 9, True)} <= got
    if name == "op5_ngram_join":
        got = {(r["doc_id"], r["n_shingles"] > 0, r["component_id"]) for r in rows}
        assert {(1, True, 1), (2, True, 1), (8, True, 1), (3, False, 3), (4, False, 4), (7, False, 7), (6, True, 6)} <= got
    if name == "op2_mixing":
        assert all(r["taken"] <= 2 * r["size"] for r in rows)
    if name == "op1_language":
        assert {r["doc_id"]: r["lang_pred"] for r in rows if r["doc_id"] in (3, 4, 7, 10)} == {3: "und", 4: "und", 7: "und", 10: "und"}
    if name == "op7_bpe":
        assert {r["n_tokens"] for r in rows if r["doc_id"] in (3, 4)} == {0}
    if name == "op9_secrets":
        assert [r["spans"] for r in rows if r["doc_id"] == 5] == ["assign:0:17"]


def test_pipeline_hands_whole_texts_to_python_in_short_batches(spark, tables):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.getAll.get(key)
    docs = spark.read.parquet(f"{tables['full']}/documents.parquet")
    long = spark.range(0, 24, 1, 1).select("id", F.repeat(F.lit("x"), 1 << 20).alias("text"))

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes], pa.int64())], names=["id"])

    try:
        spark.conf.unset(key)
        for _, stage in corpus_pipeline.STAGES:
            spark.conf.unset(key)
            stage(spark, docs, tables["full"])
            assert max(r["id"] for r in long.mapInArrow(sizes, "id long").collect()) < 8 << 20
        spark.conf.set(key, str(64 << 20))  # what a session says stays
        corpus_pipeline.STAGES[0][1](spark, docs, tables["full"])
        assert spark.conf.get(key).rstrip("b") == str(64 << 20)
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def test_pipeline(spark, tables):
    docs = spark.read.parquet(f"{tables['full']}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        new = stage(spark, docs, tables["full"])
        assert new.columns == docs.columns
        docs = spark.createDataFrame(new.collect(), new.schema)
    assert {r["doc_id"] for r in docs.collect()} <= {1, 6, 9}
    assert corpus_pipeline.run(spark, tables["empty"]).collect() == []


def test_near_duplicates_equal_brute_force(spark):
    rows = [(k, prose(40 + k % 7, 3 + k % 11) + " " + prose(k % 5, 2 + k)) for k in range(60)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.classes(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = {}
    for k, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", text.lower())
        sets[k] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    group = {k: k for k in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both) and group[a] != group[b]:
                    group[a] = group[b] = min(group[a], group[b])
                    changed = True
    assert got == {k: (len(sets[k]), group[k]) for k in sets}


def test_cover_tree_with_many_leaves_equals_brute_force(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(cover_tree, "LEAF", 12)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(15, 8))
    v = [(centres[k % 15] + rng.normal(size=8) * (0.02 if k % 3 else 0.3)).tolist() for k in range(150)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in cover_tree.near_duplicates(spark, spark.createDataFrame([(k, x, k % 2) for k, x in enumerate(v)], "vec_id long, embedding array<double>, label int")).collect()}
    unit = np.array(v) / np.linalg.norm(v, axis=1)[:, None]
    near = (unit @ unit.T >= 0.98) & (np.arange(150)[:, None] % 2 == np.arange(150) % 2) & ~np.eye(150, dtype=bool)
    group = list(range(150))
    for _ in range(150):
        new = [min([group[a], *(group[b] for b in np.flatnonzero(near[a]))]) for a in range(150)]
        if new == group:
            break
        group = new
    assert got == {k: (int(near[k].sum()), group[k]) for k in range(150)}


def test_calls_in_a_circle_and_loose_ends(spark):
    calls = spark.createDataFrame(
        [(1, 1, "a", "search", '{"query":"x","after":{"$ref":"b"}}'), (1, 2, "b", "search", '{"query":"x","after":{"$ref":"a"}}'), (1, 3, "d", "nope", "[1]"),
         (1, 5, "e", "search", '{"after":{"$ref":"zz"}}'), (1, 6, "f", "search", '{"query":1.50,"b":2,"a":{"z":1,"y":[1]},"after":{"$ref":"e"}}')],
        "conv_id long, turn long, call_id string, name string, arguments string")
    results = spark.createDataFrame([(1, 7, "e", 'r\n"q"'), (1, 8, "q", "lone")], "conv_id long, turn long, call_id string, content string")
    got = {r["call_id"]: r for r in tool_calls.link(spark, calls, results, tool_calls.schema_table(spark)).collect()}
    assert got["a"]["problems"] == got["b"]["problems"] == "circle" and got["a"]["level"] is None
    assert got["d"]["problems"] == "malformed arguments; unknown tool" and got["q"]["status"] == "orphan"
    assert (got["e"]["level"], got["e"]["status"], got["e"]["problems"]) == (0, "linked", "missing query; unknown reference zz")
    assert got["f"]["level"] == 1 and got["f"]["problems"] == "wrong type query; unexpected a; unexpected b"
    assert got["f"]["json"] == '{"arguments":{"a":{"y":[1],"z":1},"after":{"$ref":"e"},"b":2,"query":1.5},"id":"f","name":"search","result":null}'


def test_calls_hold_whole_texts(spark):
    texts = {1: "one\ntwo\r\n\nthree\n", 3: 'a "b" \\ {"$ref": "c9"}\n}{\t', 5: "\n", 7: "", 9: "ß\u2028日本\n🎉"}
    talk = [(1, k, "assistant", t) for k, t in texts.items()]
    calls, results = tool_calls.calls_of(spark.createDataFrame(talk, "conv_id long, turn long, role string, text string"))
    rows = tool_calls.link(spark, calls, results, tool_calls.schema_table(spark)).collect()
    assert {r["turn"]: json.loads(r["json"])["arguments"]["query"] for r in rows} == texts
    assert not any("malformed" in r["problems"] or "c9" in r["problems"] for r in rows)


def test_general_forms_keep_texts(spark, tables):
    docs = spark.read.parquet(f"{tables['full']}/documents.parquet")
    assert {r["doc_id"]: r["text"] for r in secret_scan.redact(spark, docs).collect()}[5] == "[SECRET] 1 2 3"
    kept = line_quality.clean(docs, min_words=3).collect()
    assert all(r["n_chars"] == len(r["text"]) for r in kept)
    mixed = mixing.mixture(spark, docs)
    assert mixed.columns == docs.columns and mixed.count() > 0
    filters = language_id.fit(spark, docs)
    assert set(filters.languages) == {"de", "en", "fr"}


def test_usual_language_is_that_of_most_rows(spark):
    unit = F.pmod(F.xxhash64("id", F.lit("language sample")), F.lit(1 << 30)) / float(1 << 30)
    sampled = [r["id"] for r in spark.range(2000).where(unit < 0.05).limit(40).collect()]  # the sample has all rows of the rarer language
    rows = [(k, f"bb text {k}", "bb") for k in sampled] + [(5000 + k, f"aa text {k}", "aa") for k in range(60)]
    assert language_id.fit(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string"), 10).usual == "aa"


def test_the_driver_holds_no_toxicity_index(spark, monkeypatch):
    rows = [(k, prose(k, 20) + (" idiot idiot" if k % 3 == 1 else "")) for k in range(300)] + [(300, None), (301, "zzz")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 3 == 1)) for k, _ in rows], "doc_id long, label int")

    def refuse(*_):
        raise AssertionError("the driver builds the index")

    with monkeypatch.context() as m:
        m.setattr(toxicity, "Index", refuse)
        model = toxicity.fit(spark, docs, labels)
        got = {r["doc_id"]: r["score"] for r in toxicity.predict(spark, docs, model).collect()}
    # the same as from the examples at hand
    half = {r["doc_id"]: r["half"] for r in docs.select("doc_id", F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2)).cast("int").alias("half")).collect()}
    bags = toxicity.terms([t for _, t in rows])
    table = pa.table({
        "doc_id": pa.array([k for k, _ in rows], pa.int64()), "label": pa.array([int(k % 3 == 1) for k, _ in rows], pa.int32()), "half": pa.array([half[k] for k, _ in rows], pa.int32()),
        "term": pa.array([x.view("int64").tolist() for x, _ in bags], pa.list_(pa.int64())), "times": pa.array([y.tolist() for _, y in bags], pa.list_(pa.int64()))})
    index = toxicity.build(table, {1: 101, 0: 201})
    assert got == pytest.approx({k: index.score(*bag)[0] for (k, _), bag in zip(rows, bags)}, abs=1e-5)
    assert (model.prior, model.slope, model.shift) == pytest.approx((index.prior, index.slope, index.shift), abs=1e-5)
