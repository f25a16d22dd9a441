"""Path search: a query text becomes a column predicate; answers are the outermost matches and their totals.

Terms: `a b` both, `a|b` either (looser), `-x` without, `*` any characters within one name, `^x` and `x$` a name's start
and end, quotes for literal text, a backslash before ^, $ or a backslash for the sign itself, `/re/` a regex over the
whole path. A positive term needs three literal characters in a row, unless the query is that one literal.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heapscope.functions.paths import ancestors, child_of, depth, in_subtree, parent
from heapscope.functions.scalars import OPEN, suffixes

MIN_TERM = 3


class QueryError(ValueError):
    """A query that can't be read; code tells why: short-term, unsupported-kind, bad-regex."""

    def __init__(self, text: str, code: str):
        super().__init__(text)
        self.code = code


@dataclass(frozen=True)
class Term:
    """pieces of literal text with any characters of one name between them; or a regex."""

    pieces: tuple[str, ...] = ()
    start: bool = False
    end: bool = False
    regex: str | None = None

    def column(self, path: Column) -> Column:
        if self.regex is not None:
            return path.rlike("(?i)" + self.regex)
        low = F.lower(path)
        if len(self.pieces) == 1 and not self.start and not self.end:
            return low.contains(self.pieces[0])
        body = "[^/]*".join(re.escape(p) for p in self.pieces)
        return low.rlike(("(?:^|/)" if self.start else "") + body + ("(?:/|$)" if self.end else ""))


@dataclass(frozen=True)
class Query:
    """Any of alts (all terms of one), and none of neg."""

    alts: tuple[tuple[Term, ...], ...] = ((),)
    neg: tuple[Term, ...] = field(default=())

    def positive(self, path: Column) -> Column:
        every = [reduce(lambda a, b: a & b, [t.column(path) for t in alt], F.lit(True)) for alt in self.alts]
        return reduce(lambda a, b: a | b, every)

    def negative(self, path: Column) -> Column:
        return reduce(lambda a, b: a | b, [t.column(path) for t in self.neg], F.lit(False))

    def column(self, path: Column) -> Column:
        return self.positive(path) & ~self.negative(path)


#: Escaped sign, quoted text (maybe without its end), star, white space, bar, or one other character.
_TOKEN = re.compile(r'\\(?P<esc>[\^$\\])|"(?P<quoted>[^"]*)"?|(?P<star>\*)|(?P<space>\s+)|(?P<bar>\|)|(?P<char>.)', re.DOTALL)


def _words(text: str) -> list[list[tuple[str, str]] | None]:
    """Tokens of each word; None stands for a bar."""
    words: list[list[tuple[str, str]] | None] = []
    own: list[tuple[str, str]] = []
    for m in _TOKEN.finditer(text):
        if m.lastgroup in ("space", "bar"):
            if own:
                words.append(own)
                own = []
            if m.lastgroup == "bar":
                words.append(None)
        else:
            own.append((m.lastgroup, m[m.lastgroup]))
    return [*words, own] if own else words


def _term(tokens: list[tuple[str, str]]) -> Term:
    start = len(tokens) > 0 and tokens[0] == ("char", "^")
    end = len(tokens) > int(start) and tokens[-1] == ("char", "$")
    inner = tokens[int(start) : len(tokens) - int(end)]
    if not "".join(t for k, t in inner if k != "star") and not any(k == "star" for k, _ in inner):
        return Term(("^" * start + "$" * end,))  # anchors around nothing are the signs themselves
    pieces = [""]
    for kind, text in inner:
        if kind == "star":
            pieces.append("")
        else:
            pieces[-1] += text
    if not any(pieces):
        return Term(tuple(pieces))
    if not start and not end and pieces in (["is:file"], ["is:dir"]) and all(k == "char" for k, _ in inner):
        raise QueryError("a filter by kind isn't built", "unsupported-kind")
    return Term(tuple(pieces), start, end)


def parse(text: str) -> Query | None:
    """The query, or None if there is nothing to filter by."""
    text = text.strip()
    if len(text) > 2 and text[0] == text[-1] == "/":
        try:
            re.compile(text[1:-1])
        except re.error as e:
            raise QueryError(str(e), "bad-regex") from e
        return Query(((Term(regex=text[1:-1]),),))
    alts: list[list[Term] | None] = [None]
    neg: list[Term] = []
    for word in _words(text.lower()):
        if word is None:
            alts.append(None)
            continue
        without = word[0] == ("char", "-") and len(word) > 1
        term = _term(word[1:] if without else word)
        if alts[-1] is None:
            alts[-1] = []
        if term.pieces == ("",):
            continue
        if without:
            neg.append(term)
        else:
            alts[-1].append(term)
    kept = [tuple(a) for a in alts if a is not None]
    short = [t for a in kept for t in a if max(map(len, t.pieces)) < MIN_TERM]
    alone = len(kept) == 1 and len(kept[0]) == 1 and len(kept[0][0].pieces) == 1 and not neg
    if short and not alone:
        raise QueryError(f"type at least {MIN_TERM} characters", "short-term")
    if not neg and not any(kept):
        return None
    return Query(tuple(kept) or ((),), tuple(neg))


def outermost(matches: DataFrame, top: str = "") -> DataFrame:
    """Matches (path) with no other match above them; top itself alone if it matches."""
    if top:
        matches = matches.filter(in_subtree(F.col("path"), top))
    names = matches.select("path").distinct()
    up = matches.select("path").distinct().select("path", F.explode(ancestors(F.col("path"), own=False, root=top == "")).alias("up"))
    inner = up.join(names.withColumnRenamed("path", "up"), "up", "left_semi").select("path").distinct()
    return matches.join(inner, "path", "left_anti")


def match_roots(rows: DataFrame, query: Query, top: str = "") -> DataFrame:
    """Outermost rows of which the positive part holds."""
    under = rows.filter(in_subtree(F.col("path"), top)) if top else rows
    return outermost(under.filter(query.positive(F.col("path"))), top)


def net_totals(rows: DataFrame, query: Query, top: str = "") -> DataFrame:
    """path, size, n_files of every root, less the outermost excluded rows at or below it."""
    roots = match_roots(rows, query, top).select("path", "size", "n_files")
    if not query.neg:
        return roots
    bad = outermost(rows.filter(query.negative(F.col("path"))).select("path", "size", "n_files"))
    own = bad.select(F.explode(ancestors(F.col("path"))).alias("root"), "size", "n_files").join(roots.select(F.col("path").alias("root")), "root", "left_semi")
    minus = own.groupBy("root").agg(F.sum("size").alias("ms"), F.sum("n_files").alias("mn"))
    j = roots.join(minus, roots["path"] == minus["root"], "left")
    # A root under an excluded ancestor is excluded itself.
    above = roots.select("path", F.explode(ancestors(F.col("path"), own=False)).alias("up")).join(bad.select(F.col("path").alias("up")), "up", "left_semi").select("path").distinct()
    net = j.select("path", (F.col("size") - F.coalesce("ms", F.lit(0))).alias("size"), (F.col("n_files") - F.coalesce("mn", F.lit(0))).alias("n_files"))
    return net.join(above, "path", "left_anti").filter("n_files > 0 or size > 0")


def filtered(roots: DataFrame) -> DataFrame:
    """Totals of the roots at or under each of their ancestors, themselves included."""
    up = roots.select(F.explode(ancestors(F.col("path"))).alias("path"), "size", "n_files")
    return up.groupBy("path").agg(F.sum("size").alias("size"), F.sum("n_files").alias("n_files"))


def first_true(rows: DataFrame, query: Query) -> DataFrame:
    """Rows where the positive part holds and that of the parent doesn't."""
    p = F.col("path")
    return rows.filter(query.positive(p) & ~query.positive(parent(p)))


def by_names(rows: DataFrame, needle: str) -> DataFrame:
    """Rows whose last name holds the literal, by way of the distinct names."""
    name = F.lower(F.element_at(F.split("path", "/"), -1))
    names = rows.select(name.alias("_name")).distinct().filter(F.col("_name").contains(needle.lower()))
    return rows.withColumn("_name", name).join(names, "_name", "left_semi").drop("_name")


def segment_search(rows: DataFrame, needle: str) -> DataFrame:
    """Rows one of whose names holds the literal."""
    return rows.filter(F.exists(F.split(F.lower("path"), "/"), lambda s: s.contains(needle.lower())))


def suffix_table(rows: DataFrame) -> DataFrame:
    """s, path: every suffix of three characters or more of a row's last name; sorted by s it answers literals by range."""
    return rows.select(F.explode(suffixes(F.lower(F.element_at(F.split("path", "/"), -1)))).alias("s"), *rows.columns)


def suffix_lookup(table: DataFrame, literal: str) -> DataFrame:
    from heapscope.sources.listing import next_prefix

    q = literal.lower()
    return table.filter((F.col("s") >= q) & (F.col("s") < next_prefix(q))).drop("s").distinct()


def trigram_index(rows: DataFrame) -> DataFrame:
    """tri, path of every row's last name."""
    from heapscope.functions.scalars import trigrams

    return rows.select(F.explode(trigrams(F.element_at(F.split("path", "/"), -1))).alias("tri"), "path")


def _trigrams(text: str) -> frozenset[int]:
    return frozenset(ord(a) * 65536 + ord(b) * 256 + ord(c) for a, b, c in zip(text, text[1:], text[2:], strict=False) if max(map(ord, (a, b, c))) < 128)


def name_branch(term: Term) -> tuple[tuple[str, ...], bool, bool] | None:
    """What the last name must hold where a term becomes true: pieces in order, and whether it starts and ends with them; None for
    a term that says nothing of one name (a regex, or one that ends with a slash)."""
    if term.regex is not None:
        return None
    cut = max((i for i, p in enumerate(term.pieces) if "/" in p), default=None)
    if cut is None:
        return term.pieces, term.start, term.end
    tail = (term.pieces[cut].rsplit("/", 1)[1], *term.pieces[cut + 1 :])
    return None if tail == ("",) else (tail, True, term.end)


def branch_column(branch: tuple[tuple[str, ...], bool, bool], name: Column) -> Column:
    pieces, start, end = branch
    pattern = ("^" if start else "") + "[^/]*".join(re.escape(p) for p in pieces) + ("$" if end else "")
    return F.lower(name).rlike(pattern)


def formula(query: Query) -> list[frozenset[int]] | None:
    """Sets of trigrams, one of which every name where the positive part becomes true holds in full; None if any name may be one.

    A set that holds all of another's adds nothing and goes; of equal ones one stays.
    """
    if any(not alt for alt in query.alts):
        return None
    branches = [name_branch(t) for alt in query.alts for t in alt]
    if any(b is None for b in branches):
        return None
    sets = [frozenset().union(*map(_trigrams, b[0])) for b in branches]
    if any(not s for s in sets):
        return None
    return [s for i, s in enumerate(sets) if not any(j != i and o <= s and (len(o) < len(s) or j < i) for j, o in enumerate(sets))]


def trigram_candidates(index: DataFrame, sets: list[frozenset[int]]) -> DataFrame:
    """Paths whose last name holds all trigrams of one of the sets."""
    wanted = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(len(s)).alias("n"), F.lit(sorted(s)).cast("array<int>").alias("t")) for i, s in enumerate(sets)])
    used = index.filter(F.col("tri").isin(sorted(frozenset().union(*sets))))
    hits = used.select("path", "tri", F.explode(F.filter(wanted, lambda w: F.array_contains(w["t"], F.col("tri")))).alias("w"))
    return hits.groupBy("path", "w.i").agg(F.count_distinct("tri").alias("n"), F.first("w.n").alias("need")).filter("n = need").select("path").distinct()


def trigram_search(rows: DataFrame, index: DataFrame, query: Query) -> DataFrame:
    """Rows where the positive part becomes true, by way of the names that the formula allows."""
    sets = formula(query)
    there = rows if sets is None else rows.join(trigram_candidates(index, sets), "path", "left_semi")
    return first_true(there, query)


def trigram_lookup(index: DataFrame, literal: str) -> DataFrame:
    """Paths whose last name holds the literal, by its trigrams, then by itself."""
    q = literal.lower()
    return trigram_candidates(index, [_trigrams(q)]).filter(F.lower(F.element_at(F.split("path", "/"), -1)).contains(q))


def first_hits(versions: DataFrame, literal: str, times: list[int]) -> DataFrame:
    """bucket, t, n, bytes: files live at each of a few times whose name holds the literal and no name above does, each counted once
    however often the literal stands in it: by the first of its suffixes that begins with it."""
    from heapscope.sources.listing import next_prefix

    q = literal.lower()
    name = F.lower(F.element_at(F.split("path", "/"), -1))
    rows = versions.select("path", "size", "vf", "vt", name.alias("name")).select("*", F.posexplode(suffixes(F.col("name"))).alias("at", "s"))
    hits = rows.filter((F.col("s") >= q) & (F.col("s") < next_prefix(q)))
    first = hits.filter((F.col("at") == F.instr("name", q) - 1) & ~F.lower(parent(F.col("path"))).contains(q))
    at = F.explode(F.filter(F.array(*[F.lit(t).cast("long") for t in times]), lambda t: (F.col("vf") <= t) & (F.col("vt") > t))).alias("t")
    return first.select("path", "size", at).groupBy(F.substring_index("path", "/", 1).alias("bucket"), "t").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))


def catalog(versions: DataFrame, literals: list[str]) -> DataFrame:
    """q, bucket, t, bytes, objects: running totals of the matching versions of each literal."""
    from heapscope.operators.history import running_totals

    hits = versions.select("*", F.explode(F.filter(F.array(*map(F.lit, literals)), lambda q: F.lower("path").contains(q))).alias("q"))
    return running_totals(hits.withColumn("bucket", F.substring_index("path", "/", 1)), ["q", "bucket"])


def name_summary(cells: DataFrame, times: DataFrame) -> DataFrame:
    """q, t, bytes, objects at each of a few times: of every bucket the last cell at or before it."""
    j = cells.withColumnRenamed("t", "ct").join(F.broadcast(times), F.col("ct") <= F.col("t"))
    last = j.groupBy("q", "bucket", "t").agg(F.max_by("bytes", "ct").alias("b"), F.max_by("objects", "ct").alias("o"))
    return last.groupBy("q", "t").agg(F.sum("b").alias("bytes"), F.sum("o").alias("objects"))


def prefix_census(names: DataFrame, least: int, first: int = 3) -> DataFrame:
    """prefix, n: prefixes of `first` characters or more of the suffixes (s) with at least `least` rows, however long.

    Level by level: only suffixes whose prefix was heavy go on to the next, and each level is written, so plans don't grow.
    """
    from heapscope.sources.scratch import scratch

    spark = names.sparkSession
    left, levels, k = names.select("s"), [], first
    while True:
        prefix = F.substring("s", 1, k).alias("prefix")
        own = left.filter(F.length("s") >= k).select("s", prefix)
        heavy = own.groupBy("prefix").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
        path = scratch(spark, "census")
        heavy.write.parquet(f"{path}/heavy")
        heavy = spark.read.schema("prefix string, n long").parquet(f"{path}/heavy")
        levels.append(heavy)
        if heavy.isEmpty():
            return reduce(DataFrame.unionByName, levels)
        own.join(heavy.select("prefix"), "prefix", "left_semi").select("s").write.parquet(f"{path}/left")
        left, k = spark.read.schema("s string").parquet(f"{path}/left"), k + 1


def drill(roots: DataFrame, k: int) -> DataFrame:
    """dir, child, size, n: of every directory above roots the k largest children, and '(rest)'."""
    from heapscope.operators.views import top_with_other

    up = roots.select("path", "size", F.explode(ancestors(F.col("path"), own=False)).alias("dir"))
    kids = up.select("dir", child_of(F.col("path"), F.col("dir")).alias("child"), "size").groupBy("dir", "child").agg(F.sum("size").alias("size"))
    return top_with_other(kids, "size", "child", k, ["dir"])


def cover(objects: DataFrame, roots: DataFrame) -> DataFrame:
    """The fewest prefixes that cover the matches and nothing else: a folder whose matched objects and bytes are all it has."""
    from heapscope.operators.rollup import directories

    m = {"size": (F.col("size"), "sum"), "n_files": (F.lit(1).cast("long"), "sum")}
    total = directories(objects, m).unionByName(objects.select("path", "size", F.lit(1).cast("long").alias("n_files")))
    up = roots.select(F.explode(ancestors(F.col("path"))).alias("path"), "size", "n_files").groupBy("path").agg(F.sum("size").alias("ms"), F.sum("n_files").alias("mn"))
    full = total.join(up, "path").filter("size = ms and n_files = mn").select("path", "size", "n_files")
    return outermost(full)


def truth(roots: DataFrame, segments: int = 2) -> DataFrame:
    """bucket, n, digest, size, n_files: what two engines' answers are compared by.

    Paths are digested in sorted order by their first segments, then those digests by bucket, so no row holds all paths of a bucket.
    """
    part = roots.groupBy(F.substring_index("path", "/", segments).alias("part")).agg(
        F.count("*").alias("n"), F.md5(F.array_join(F.array_sort(F.collect_list("path")), "\n").cast("binary")).alias("d"), F.sum("size").alias("size"), F.sum("n_files").alias("n_files")
    )
    lines = F.transform(F.array_sort(F.collect_list(F.struct("part", "d"))), lambda x: F.concat(x["part"], F.lit(" "), x["d"]))
    own = part.groupBy(F.substring_index("part", "/", 1).alias("bucket"))
    return own.agg(F.sum("n").alias("n"), F.md5(F.array_join(lines, "\n").cast("binary")).alias("digest"), F.sum("size").alias("size"), F.sum("n_files").alias("n_files"))


def verdict(answers: DataFrame, right: DataFrame) -> DataFrame:
    """bucket and verdict. answers: bucket, status, n, digest, size, n_files, partial, approximate, capped.

    error: no answer; refused: no answer, and said so (413); exact: paths and totals are right, exact* if flagged as partial or
    approximate; totals: the count and totals are right, but a capped list of paths can't be verified; flagged: wrong and says so;
    FAIL: wrong and doesn't.
    """
    truths = right.select("bucket", *[F.col(c).alias(f"_{c}") for c in ("n", "digest", "size", "n_files")])
    j = answers.join(truths, "bucket", "left")
    same = lambda *cs: reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in cs])
    flagged = F.coalesce("partial", F.lit(False)) | F.coalesce("approximate", F.lit(False))
    totals, capped = same("n", "size", "n_files"), F.coalesce("capped", F.lit(False))
    right_ = F.when(totals & same("digest") & ~flagged, "exact").when(totals & same("digest"), "exact*")
    found = right_.when(totals & capped & ~flagged, "totals").when(flagged, "flagged").otherwise("FAIL")
    return j.select("bucket", F.when(F.col("status") == 413, "refused").when(F.col("status") != 200, "error").otherwise(found).alias("verdict"))


def depth_band(rows: DataFrame, top: str, levels: int) -> DataFrame:
    d = depth(F.col("path")) - depth(F.lit(top))
    return rows.filter(in_subtree(F.col("path"), top) & d.between(0, levels))


__all__ = ["OPEN", "Query", "QueryError", "Term", "parse"]
