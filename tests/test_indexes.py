"""Range covers, pattern index, exact quantiles and day folders against plain readings."""

import fnmatch
import ipaddress
import random

import pytest
from pyspark.sql import functions as F

from netsift.functions import names as N
from netsift.operators import quantiles as Z
from netsift.operators import ranges as R
from netsift.operators import suppress as S
from netsift.sources import lists as L
from netsift.sources import logs as T


def test_range_covers_are_minimal(spark):
    rng = random.Random(1)
    ends = [(0, 2**128 - 1), (0, 0), (2**128 - 1, 2**128 - 1), (5, 5), (1, 2**128 - 2), (2**127, 2**128 - 1), (2**127 - 1, 2**127), (6, 9)]
    for _ in range(60):
        a, b = sorted(rng.randrange(2 ** rng.randrange(1, 129)) for _ in range(2))
        ends.append((a, b))
    six = [(str(ipaddress.IPv6Address(a)), str(ipaddress.IPv6Address(b))) for a, b in ends]
    four = [("0.0.0.0", "255.255.255.255"), ("10.0.0.1", "10.0.3.254"), ("1.2.3.4", "1.2.3.4"), ("::ffff:9.0.0.0", "9.0.0.255")]
    bad = [("9.9.9.9", "1.1.1.1"), ("1.1.1.1", "::5"), ("x", "1.1.1.1"), (None, "1.1.1.1")]
    rows = [(i, a, b) for i, (a, b) in enumerate([*six, *four, *bad])]
    got = {}
    for r in R.address_range_table(spark.createDataFrame(rows, "ord int, lo string, hi string")).collect():
        got.setdefault(r["ord"], set()).add((r["fam"], r["prefix"]))
    for i, a, b in rows[: len(six) + len(four)]:
        lo, hi = (ipaddress.ip_address((x or "").removeprefix("::ffff:") if "." in x else x) for x in (a, b))
        bits = lo.max_prefixlen
        want = {(bits, bin(int(n.network_address) | 1 << bits)[3:][: n.prefixlen]) for n in ipaddress.summarize_address_range(lo, hi)}
        assert got[i] == want, (a, b)
    assert set(got) == set(range(len(six) + len(four)))


def test_mixed_families_look_up_the_narrowest(spark, tmp_path):
    path = tmp_path / "geo.csv"
    path.write_text("lo,hi,cc,city,org\n::,ffff:ffff:ffff:ffff:ffff:ffff:ffff:ffff,,,all six\n2001:db8::5,2001:db8::1:0,,,odd\n2001:db8::9,2001:db8::9,,,one\n10.0.0.3,10.0.1.7,,,four\n")
    ips = ["2001:db8::9", "2001:db8::a", "2001:db8::1:0", "2001:db8::1:1", "10.0.1.7", "10.0.1.8", "::ffff:10.0.0.3", "bad"]
    table = L.address_ranges(spark, str(path))
    got = {r["ip"]: r["org"] for r in R.lookup(spark.createDataFrame([(x,) for x in ips], "ip string"), "ip", table, ["org"]).collect()}
    assert got == {"2001:db8::9": "one", "2001:db8::a": "odd", "2001:db8::1:0": "odd", "2001:db8::1:1": "all six", "10.0.1.7": "four", "::ffff:10.0.0.3": "four"}


def test_many_irregular_globs_match_as_few_do(spark):
    rng = random.Random(6)
    words = ["api", "cdn", "mail", "x1", "edge", "node", "static", "a"]
    tails = ["example.com", "example.org", "net", "co.uk", "b"]
    name = lambda: ".".join([rng.choice(words) + rng.choice(["", "1", "22", "-z"]) for _ in range(rng.randrange(1, 4))] + [rng.choice(tails)])
    values = sorted({name() for _ in range(400)})

    def glob():
        text = list(name())
        for _ in range(rng.randrange(1, 4)):
            at = rng.randrange(len(text))
            text[at] = rng.choice(["*", "?", "[a-f]", "[!a-c]", "*", "[1-3]"])
        return rng.choice(["", "", "*."]) + "".join(text)

    patterns = [glob() for _ in range(700)] + ["?*", "[zq]*", "*.*.[c]om", "api.example.com", "*.uk"]
    first = {}
    for v in values:
        for k, p in enumerate(patterns):
            if fnmatch.fnmatchcase(v, p) or (p.startswith("*.") and v == p[2:]):
                first[v] = k
                break
    for left_out in (set(), {"?*"}):
        chosen = [(k, p) for k, p in enumerate(patterns) if p not in left_out]
        table = spark.createDataFrame(chosen, "ord int, pattern string")
        found = S.glob_lookup(spark.createDataFrame([(v,) for v in values], "v string"), "v", table)
        want = {}
        for v in values:
            hits = [k for k, p in chosen if fnmatch.fnmatchcase(v, p) or (p.startswith("*.") and v == p[2:])]
            want.update({v: hits[0]} if hits else {})
        assert {r["v"]: r["ord"] for r in found.collect()} == want
    few = S.glob_lookup(spark.createDataFrame([(v,) for v in values], "v string"), "v", spark.createDataFrame(list(enumerate(patterns))[:150], "ord int, pattern string"))
    assert {r["v"]: r["ord"] for r in few.collect()} == {v: k for v, k in first.items() if k < 150}
    plan = lambda n: len(S.glob_lookup(spark.createDataFrame([("v",)], "v string"), "v", spark.createDataFrame(list(enumerate(patterns))[:n], "ord int, pattern string"))
                         ._jdf.queryExecution().analyzed().toString().split("\n"))
    assert plan(300) == plan(700)


@pytest.mark.parametrize("pattern, runs", [("a*bc?d", ["a", "bc", "d"]), ("*.x[1-3]y", [".x", "y"]), ("[ab", ["[ab"]), ("*", []), ("[]]z", ["z"])])
def test_glob_literals(pattern, runs):
    assert N.glob_literals(pattern) == runs


def test_quantiles_equal_percentiles(spark):
    rng = random.Random(2)
    rows = [(rng.choice("abc"), rng.choice([None, 1.0, 2.5, rng.random() * 9, -3.0])) for _ in range(500)] + [("one", 4.0), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    shares = {"q02": 0.02, "q50": 0.5, "q75": 0.75, "q98": 0.98, "lowest": 0.0, "highest": 1.0}
    got = {tuple(r) for r in Z.quantiles(Z.value_counts(df, ["k"], F.col("v")), ["k"], "value", shares).collect()}
    want = {tuple(r) for r in df.where("v is not null").groupBy("k").agg(*[F.percentile("v", F.lit(p)).alias(n) for n, p in shares.items()]).collect()}
    assert got == want


def test_only_asked_folders_are_listed(spark, tmp_path):
    for day in ("2024-01-01", "2024-01-02", "2024-01-03", "current"):
        (tmp_path / day).mkdir()
        (tmp_path / day / "conn.00.log").write_text("#fields\tts\tid.orig_h\n1704153600\t10.0.0.1\n")
    (tmp_path / "2024-01-04").mkdir()
    paths = T.day_paths(spark, str(tmp_path), "conn.*log*", "2024-01-04", 3)
    assert [p.split("/")[-2] for p in paths] == ["2024-01-02", "2024-01-03", "current"]
    assert T.sensor_days(spark, str(tmp_path / "nothing"), "conn", "2024-01-02", 1).collect() == []
    files = T.sensor_days(spark, str(tmp_path), "conn", "2024-01-02", 1).inputFiles()
    assert {f.split("/")[-2] for f in files if "conn" in f} == {"2024-01-02", "current"}


def test_an_empty_list_is_refused(spark, tmp_path):
    (tmp_path / "e.json").write_text('[{"serviceArea": "Other", "ips": ["1.1.1.0/24"], "urls": ["a.b"]}]')
    with pytest.raises(L.EmptyList):
        L.service_endpoints(spark, str(tmp_path / "e.json"))
