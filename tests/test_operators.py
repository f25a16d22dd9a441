"""Rules on small inputs, and invariants."""

import random

import pytest
from pyspark.sql import functions as F

from heapscope.functions import paths as P
from heapscope.functions import scalars as S
from heapscope.operators import history as H
from heapscope.operators import ownership as O
from heapscope.operators import search as Q
from heapscope.operators import thinning as TH
from heapscope.operators import views as V
from heapscope.operators.layout import squarified
from heapscope.operators.rollup import labelled, rollup
from heapscope.sources import access_logs as A
from heapscope.sources import deliveries as DL
from heapscope.sources import listing as L
from heapscope.sources import stores


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("name", "want"), [("a//b", "a/b"), ("a/b/", "a/b"), ("/a", "/a"), ("//a//", "/a"), ("", ""), ("a", "a")])
def test_canonical(spark, name, want):
    assert one(spark, P.canonical(F.lit(name))) == want


def test_ancestors(spark):
    assert one(spark, P.ancestors(F.lit("a/b/c"))) == ["", "a", "a/b", "a/b/c"]
    assert one(spark, P.ancestors(F.lit("a/b/c"), own=False, root=False)) == ["a", "a/b"]
    assert one(spark, P.ancestors(F.lit(""))) == [""]
    assert one(spark, P.ancestors(F.lit(""), own=False, root=False)) == []


def test_log2_bins_are_exact(spark):
    for v in (0, 1, 2, 3, 4, 2**40 - 1, 2**40, 2**63 - 1):
        assert one(spark, S.log2_bin(F.lit(v).cast("long"))) == v.bit_length()


def test_rollup_of_a_small_tree(spark):
    f = spark.createDataFrame([("b/x/1", 5, 10), ("b/x/2", 7, 30), ("b/3", 1, 20)], "path string, size long, mtime long")
    got = {r.path: tuple(r)[1:] for r in rollup(f).select("path", "size", "mtime", "n_desc", "n_files", "n_children", "kind", "parent", "depth").collect()}
    assert got["."] == (13, 30, 6, 3, 1, "dir", "", 0)
    assert got["b"] == (13, 30, 5, 3, 2, "dir", ".", 1)
    assert got["b/x"] == (12, 30, 3, 2, 2, "dir", "b", 2)
    assert got["b/3"] == (1, 20, 1, 1, 0, "file", "b", 2)


def test_longest_prefix_wins(spark):
    p = spark.createDataFrame([("a/b/c",), ("a/x",), ("z",)], "path string")
    lab = spark.createDataFrame([("", "all"), ("a/", "one"), ("a/b", "two")], "prefix string, usr string")
    assert {r.path: r.usr for r in labelled(p, lab).collect()} == {"a/b/c": "two", "a/x": "one", "z": "all"}


def test_versions_rebuild_every_scan(spark):
    rng = random.Random(4)
    rows = []
    values = {k: 0 for k in range(30)}
    for scan in range(6):
        for k in values:
            if rng.random() < 0.3:
                values[k] += 1
            if rng.random() > 0.12:
                rows.append((scan, 100 + scan * 10, f"p{k}", values[k]))
    scans = spark.createDataFrame(rows, "scan int, t long, path string, size long")
    v = H.versions(scans, ["path"], ["size"]).persist()
    for scan in range(6):
        got = {(r.path, r.size) for r in H.live(v, 100 + scan * 10).collect()}
        assert got == {(p, s) for n, _, p, s in rows if n == scan}
    # No two versions that touch are equal.
    assert H.coalesced(v, ["path"], ["size"]).count() == v.count()


STATES = [{"a": 1}, {"a": 2}, {"a": 1}, {"a": 1, "b": 1}, {"a": 9, "b": 1}]


def _changes(states):
    return lambda x, y: sum(states[x].get(k) != states[y].get(k) for k in {**states[x], **states[y]})


def test_thinning_by_least_change():
    steps = TH.low_change(range(5), _changes(STATES), 3)
    # Scores are 1 all over; a change that is taken back counts nothing once its scan is gone, and then its neighbour goes.
    assert steps[0] == (1, 0, 2, 1, 1, 0, 1)
    assert [s[0] for s in steps] == [1, 2, 3] and steps[1][-1] == 1 and steps[2] == (3, 0, 4, 1, 1, 2, 1)
    assert TH.low_change(range(5), _changes(STATES), 2, pinned=[1])[0][0] == 2
    with pytest.raises(TH.BadPlan):
        TH.low_change(range(5), _changes(STATES), 4)
    assert TH.manual(range(5), _changes(STATES), [3, 2]) == [(2, 1, 3, 1, 1, 2, 1), (3, 1, 4, 2, 1, 2, 2)]
    for bad in ([0], [7], [2, 2]):
        with pytest.raises(TH.BadPlan):
            TH.manual(range(5), _changes(STATES), bad)
    rows = TH.candidates(range(3), _changes(STATES), pinned=[1])
    assert rows == [(0, None, 1, None, 1, None, True), (1, 0, 2, 1, 1, 1, True), (2, 1, None, 1, None, None, True)]


def test_thinning_by_bands():
    day = 86_400
    days = [0, 1, 5, 9, 12, 14, 15, 16]
    # Ages 16 15 11 7 4 2 1 0: under 2 all; of 2-4 the newest, of 4-8, 8-16 and 16-32 likewise; and the ends.
    assert TH.geometric([d * day for d in days], 2 * day) == [d * day for d in (0, 5, 12, 14, 15, 16)]
    assert TH.geometric([d * day for d in days], 2 * day, samples=2) == [d * day for d in (0, 1, 5, 9, 12, 14, 15, 16)]
    assert TH.geometric([d * day for d in days], 2 * day, pinned=[9 * day]) == [d * day for d in (0, 5, 9, 12, 14, 15, 16)]
    assert TH.geometric([], day) == []


@pytest.mark.parametrize(("text", "path", "hit"), [
    ("abc def", "x/def/abc", True), ("abc|def", "x/def", True), ("abc -def", "abc/def", False), ("*.ext", "a/b.ext", True), ("a*log", "axx/log", False), ("abc*log", "abcxxlog", True),
    ("^abc", "x/abcd", True), ("^abc", "x/yabc", False), ("abc$", "x/yabc/z", True), ("^abc$", "x/abc/z", True), ("^abc$", "x/abcd", False), ('"a b"', "x/a b", True), (r"\^ab", "x^ab", True), ("/x.z$/", "a/xyz", True), ("-abc", "def", True), ("ABC", "xabcx", True),
])
def test_query_syntax(spark, text, path, hit):
    assert one(spark, Q.parse(text).column(F.lit(path))) is hit


@pytest.mark.parametrize(("text", "code"), [("ab cd", "short-term"), ("is:file", "unsupported-kind"), ("/(/", "bad-regex")])
def test_query_errors(text, code):
    with pytest.raises(Q.QueryError) as e:
        Q.parse(text)
    assert e.value.code == code


def test_blank_queries():
    assert Q.parse("") is None and Q.parse("|") is None and Q.parse('""') is None


def test_match_roots_are_outermost(spark):
    r = spark.createDataFrame([("a", 3, 2), ("a/foo", 3, 2), ("a/foo/foo1", 1, 1), ("a/foo/x", 2, 1), ("foo", 1, 1)], "path string, size long, n_files long")
    assert {x.path for x in Q.match_roots(r, Q.parse("foo")).collect()} == {"a/foo", "foo"}
    assert {x.path for x in Q.match_roots(r, Q.parse("foo"), "a/foo").collect()} == {"a/foo"}
    net = {x.path: (x.size, x.n_files) for x in Q.net_totals(r, Q.parse("foo -foo1")).collect()}
    assert net == {"a/foo": (2, 1), "foo": (1, 1)}


def test_hour_files_refuse_odd_versions(spark):
    good = spark.createDataFrame([('{"schema_version":3,"bucket":"b","hour":0,"rows":[["k","GetObject",2,1,5],[null,"ListObjects",1,2,2]]}',)], "value string")
    assert {(r.path, r.op, r.n) for r in A.hours(good).collect()} == {("k", "GET", 2), ("", "LIST", 1)}
    for bad in ('{"schema_version":9,"bucket":"b","hour":0,"rows":[]}', '{"schema_version":4,"bucket":"b","hour":0,"rows":[]}'):
        with pytest.raises(A.BadHours):
            A.hours(good.unionByName(spark.createDataFrame([(bad,)], "value string")))


def test_hour_files_delivered_twice(spark):
    text = '{"schema_version":%d,"bucket":"b","hour":"2026-10-12T11:00:00Z","capture":"%s","rows":[["k","GetObject",%d,1,5],["k","Odd",1,1,2]]}'
    files = lambda *x: spark.createDataFrame([(text % v,) for v in x], "value string")
    once = files((4, "inconsistent", 2))
    got = [(r.hour, r.op, r.n, r.sampled) for r in A.hours(once.unionByName(once)).orderBy("op").collect()]
    assert got == [(1791802800, "GET", 2, True), (1791802800, "OTHER", 1, True)]
    for other in ((4, "inconsistent", 3), (4, "unsampled", 2), (3, "inconsistent", 2)):
        with pytest.raises(A.BadHours):
            A.hours(once.unionByName(files(other)))


def test_inventory_of_least_columns(spark):
    x = spark.createDataFrame([("b1", "a.txt", 100)], "Bucket string, Key string, Size long")
    assert [(r.bucket, r.name, r.size_bytes, r.created, r.storage_class_id) for r in L.normalised(x).collect()] == [("b1", "a.txt", 100, None, 0)]
    y = spark.createDataFrame([("m", "cold/b.tar", 2048, "GLACIER", False, True), ("m", "gone", 1, "STANDARD", True, True), ("m", "old", 9, "STANDARD_IA", False, False), ("m", "a", 1, "STANDARD", None, None)], "Bucket string, Key string, Size long, StorageClass string, IsDeleteMarker boolean, IsLatest boolean")
    assert sorted((r.name, r.storage_class_id) for r in L.normalised(y).collect()) == [("a", 1), ("cold/b.tar", 4)]
    with pytest.raises(ValueError):
        L.normalised(spark.createDataFrame([(1,)], "x int"))


def test_usernames(spark):
    names = ["russell.power@host", "a_b@x", "  A  B ", "--x!!", "é"]
    got = [one(spark, S.username(F.lit(n))) for n in names[:4]]
    assert got == ["russell-power", "a_b", "a-b", "x"]
    with pytest.raises(Exception, match="usable"):
        one(spark, S.username(F.lit("!!!@x")))


def test_plans_of_chunks():
    assert L.pack_chunks([("a", 5), ("b", 3), ("c", 3), ("d", 1)], 2) == [["a", "d"], ["b", "c"]]
    assert DL.planned_chunks([("a", 3), ("b", 3), ("c", 9), ("d", 1)], 6) == [["a", "b"], ["c"], ["d"]]


def test_state_files_refuse(spark):
    for bad in ('{"schema_version":1,"buckets":{}}', '{"schema_version":2,"buckets":{"b":{"legacy_days":{"x":1},"hours":{}}}}'):
        with pytest.raises(DL.BadState):
            DL.state_keys(spark.createDataFrame([(bad,)], "value string"))


def test_formula_absorbs_and_widens():
    sets = Q.formula(Q.parse("ckpt | ckpts | abc*xyz"))
    assert len(sets) == 2 and Q._trigrams("ckpt") in sets and Q._trigrams("abc") | Q._trigrams("xyz") in sets
    assert Q.formula(Q.parse("/x.*y/")) is None and Q.formula(Q.parse("dir/")) is None and Q.formula(Q.parse("-abc")) is None
    assert Q.name_branch(Q.parse("dir/^abc").alts[0][0])[0] == ("^abc",)
    assert Q.name_branch(Q.parse("foo/bar*.x").alts[0][0]) == (("bar", ".x"), True, False)


def test_view_folds_and_hangs_off_the_root(spark):
    rows = [("", "dir", 1000, 9, 3), ("a", "dir", 700, 4, 4), ("b", "file", 200, 1, 0), ("c", "file", 100, 1, 0), ("a/x", "file", 400, 1, 0), ("a/y", "file", 290, 1, 0), ("a/z", "file", 9, 1, 0), ("a/w", "file", 1, 1, 0)]
    df = spark.createDataFrame(rows, "path string, kind string, size long, n_files long, n_children long")
    # 1000 * 12 / 120 = 100 at depth 1, 200 at depth 2.
    got = {r.path: (r.size, r.up, r.folded) for r in V.view(df, "", 12, 10).collect()}
    assert got == {"": (1000, None, None), "a": (700, "", None), "b": (200, "", None), "c": (100, "", None), "a/x": (400, "a", None), "a/y": (290, "a", None)}
    got = {r.path: (r.size, r.up, r.folded) for r in V.view(df, "", 10, 4).collect()}
    # 300 at depth 1, 600 at depth 2; the rest of the root is not over 300.
    assert got == {"": (1000, None, None), "a": (700, "", None)}
    # 240 at depth 1: what 'a' leaves of the root is over that.
    got = {r.path: (r.size, r.up, r.folded) for r in V.view(df, "", 10, 5).collect()}
    assert got == {"": (1000, None, None), "a": (700, "", None), "(other)": (300, "", 2)}


def test_diff_looks_up_the_small_side(spark):
    s = "path string, kind string, size long, n_files long"
    old = spark.createDataFrame([("d", "dir", 1000, 3), ("d/a", "file", 900, 1), ("d/b", "file", 60, 1), ("d/c", "file", 40, 1)], s)
    new = spark.createDataFrame([("d", "dir", 1100, 3), ("d/a", "file", 900, 1), ("d/b", "file", 180, 1), ("d/e", "file", 20, 1)], s)
    # The threshold is 1100 * 12 / 132 = 100.
    got = {r.path: (r.status, r.before, r.after, r.expanded) for r in V.diff(old, new, "d", 12, 11).collect()}
    assert got == {"d": ("changed", 1000, 1100, True), "d/a": ("unchanged", 900, 900, False), "d/b": ("changed", 60, 180, False)}


def test_key_ranges():
    assert L.next_prefix("ab") == "ac" and L.next_prefix("") == ""
    assert "a" < L.key_midpoint("a", "c") < "c"


def test_identity_refuses_both(spark):
    x = spark.createDataFrame([("v", 1)], "version string, generation long")
    with pytest.raises(Exception, match="generation"):
        L.object_identity(x).collect()


def test_stores_round_trip(spark, tmp_path):
    f = spark.createDataFrame([(f"b/d{i % 7}/f{i}", i, 3) for i in range(200)], "path string, size long, depth int")
    stores.write_by_path(f, f"{tmp_path}/a", 3)
    stores.write_by_size(f, f"{tmp_path}/s", 3)
    stores.write_chunked(f, f"{tmp_path}/c", 2)
    assert stores.read_subtree(spark, f"{tmp_path}/a", "b/d3").count() == f.filter("path like 'b/d3/%'").count()
    assert spark.read.parquet(f"{tmp_path}/s").exceptAll(f).isEmpty()
    assert stores.recompressed(spark, f"{tmp_path}/a", f"{tmp_path}/z", "snappy")
    plan = stores.read_subtree(spark, f"{tmp_path}/a", "b/d3")._jdf.queryExecution().toString()
    assert "PushedFilters" in plan


def test_local_listing(spark, tmp_path):
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "f.txt").write_text("hello")
    assert [(r.name, r.size_bytes) for r in L.local_listing(spark, str(tmp_path)).collect()] == [("x/f.txt", 5)]


def test_rectangles_fold_what_is_over_the_limit(spark):
    from heapscope.operators.layout import rectangles

    kids = spark.createDataFrame([("d", f"d/{i}", 10 - i) for i in range(10)], "up string, path string, size long")
    got = {r.path: r.w * r.h for r in rectangles(kids, 55.0, 1.0, most=3).collect()}
    assert {k: round(v, 6) for k, v in got.items()} == {"d/0": 10, "d/1": 9, "d/2": 8, "(other)": 28}


def test_rectangles_fill_the_area():
    r = squarified([6, 6, 4, 3, 2, 2, 1], 6, 4)
    assert sum(w * h for *_, w, h in r) == pytest.approx(24)
    assert all(x >= -1e-9 and y >= -1e-9 and x + w <= 6 + 1e-9 and y + h <= 4 + 1e-9 for x, y, w, h in r)


def test_class_scope_rounds_whole_numbers(spark):
    cases = [(3, 10_000_000, 1_666_666), (3, 10_000_000, 1_666_667), (1, 2, 1), (0, 0, 0), (9_000_001, 3 * 10**18, 10**18 - 1), (7, 4 * 10**18, 4 * 10**18)]
    rows = spark.createDataFrame([(str(i), s, n, k, 0, s - k) for i, (n, s, k) in enumerate(cases)], "path string, size long, n_files long, c1 long, c2 long, c3 long")
    want = {(str(i), k, (2 * n * k + s) // (2 * s) if s else 0) for i, (n, s, k) in enumerate(cases)}
    assert {tuple(r) for r in O.class_scope(rows, [1]).collect()} == want


def halved(names, lo, hi, most):
    own = sorted(n for n in names if lo <= n and (not hi or n < hi))
    mid = L.between(own[0], own[-1]) if len(own) > most and own[0] < own[-1] else None
    return [(lo, hi, len(own))] if mid is None else halved(names, lo, mid, most) + halved(names, mid, hi, most)


@pytest.mark.parametrize("within", [1, 40, 10_000])
def test_ranges_are_the_same_wherever_they_are_cut(spark, within):
    rng = random.Random(3)
    names = ["".join(rng.choice("ab/\u00e9\U0001f600") for _ in range(rng.randrange(1, 12))) for _ in range(400)] + ["same"] * 9 + [""] * 7
    df = spark.createDataFrame([(n,) for n in [*names, None]], "name string").repartition(3)
    assert sorted(tuple(r) for r in L.cut_ranges(df, 5, within).collect()) == halved(names, "", "", 5)
    assert L.split_ranges(df.filter("name = ''"), 5) == [("", "", 7)]
    assert L.split_ranges(df.limit(0), 5) == [("", "", 0)]


def test_many_ranges_take_few_rounds(spark):
    n = spark.range(60_000).select(F.concat(F.lit("c"), F.col("id").cast("string"), F.lit("/o"), F.col("id").cast("string")).alias("name"))
    jobs = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("ranges", "ranges")
    got = L.split_ranges(n, 10)
    ids = jobs.getJobIdsForGroup("ranges")
    spark.sparkContext._jsc.clearJobGroup()
    assert sum(x for *_, x in got) == 60_000 and max(x for *_, x in got) <= 10
    assert got[0][0] == "" == got[-1][1] and all(a[1] == b[0] for a, b in zip(got, got[1:], strict=False))
    assert len(ids) <= 6
