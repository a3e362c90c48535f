import fnmatch
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.functions import paths as P

NAMES = ["photos/2021/cat.jpg", "photos/2021/dog.png", "photos/raw/x1.nef", "docs/plan[v2].md", "docs/a^b.md", "notes", "docs/tab-le.csv", "docs/]end"]


def hit(*parts):
    return {n for n in NAMES if any(p in n for p in parts)}


# Each rule of the globs with a pattern that it lets match and one that it doesn't.
RULES = {
    "a name as a whole": [("notes", hit("notes")), ("note", set())],
    "a component anywhere": [("2021", hit("2021")), ("202", set())],
    "stars cross slashes": [("photos/*.nef", hit("nef")), ("photos/*.gif", set())],
    "a question mark is one character": [("x?.nef", hit("nef")), ("?x1.nef", set())],
    "sets and ranges": [("[c-d]o[f-h].png", hit("dog")), ("[e-g]at.jpg", set())],
    "negation in both spellings": [("[!a-c]og.png", hit("dog")), ("[^c]at.jpg", set())],
    "a closing bracket first in a set": [("[]]end", hit("]end")), ("[]x]nd", set())],
    "a bracket without end is itself": [("plan[[]v2[]].md", hit("plan")), ("plan[v2", set())],
    "a dash at a set's end": [("tab[_-]le.csv", hit("tab-le")), ("tab[-_].csv", set())],
    "a backslash takes what follows": [(r"plan\[v2\].md", hit("plan")), (r"\*.md", set())],
    "a caret elsewhere in a set": [("a[x^]b.md", hit("a^b")), ("a[x]b.md", set())],
    "a directory with all in it": [("photos/raw", hit("raw")), ("photos/ra", set())],
    "a slash and star take the directory too": [("docs/*", hit("docs/")), ("docs/*/x", set())],
    "a leading dot and slash don't count": [("./photos/2021", hit("2021")), ("./2021/cat", set())],
}


@pytest.mark.parametrize("rule", RULES)
def test_globs(spark, rule):
    x = spark.createDataFrame([(n,) for n in NAMES], "name string")
    for pattern, want in RULES[rule]:
        assert {r.name for r in x.where(P.excluded(F.col("name"), [pattern])).collect()} == want, pattern


def matches(p, s):
    """Plain matcher for stars, question marks and sets of single characters."""
    if not p:
        return not s
    if p[0] == "*":
        return any(matches(p[1:], s[i:]) for i in range(len(s) + 1))
    if p[0] == "[" and (end := p.find("]", 2 + (p[1:2] == "!"))) > 0:
        negated = p[1] == "!"
        return bool(s) and (s[0] in p[1 + negated : end]) != negated and matches(p[end + 1 :], s[1:])
    return bool(s) and p[0] in ("?", s[0]) and matches(p[1:], s[1:])


@settings(max_examples=500, deadline=None)
@given(st.lists(st.sampled_from(["*", "?", "a", "b", "/", "[ab]", "[!a]", "[b/]", "."]), max_size=6).map("".join), st.text("ab/.", max_size=7))
def test_glob_regex_equals_a_plain_matcher(pattern, name):
    if not pattern.startswith("./"):
        assert bool(re.match(P.glob_regex(pattern)[4:].join(("(?s)", "")), name)) == matches(pattern, name)


@settings(max_examples=300, deadline=None)
@given(st.text("ab*?/.-", max_size=6), st.text("ab/.-", max_size=8))
def test_glob_regex_is_fnmatch_without_sets(pattern, name):
    if pattern.startswith("./"):
        return
    assert bool(re.match(P.glob_regex(pattern)[4:].join(("(?s)", "")), name)) == fnmatch.fnmatchcase(name, pattern)


def test_names(spark):
    x = spark.createDataFrame([("../escape.txt",), ("/abs/x",), ("a/b/c",), ("a\x1bb",), ("a/../../x",)], "name string")
    n = F.col("name")
    r = x.select(P.unsafe_reason(n).alias("why"), P.sanitised(n).alias("s"), P.strip_components(n, 2).alias("strip"), P.escaped(n).alias("e"), P.without_parent_prefix(n).alias("p")).collect()
    assert [x.why for x in r] == ["Path contains '..'", "Path is absolute", None, None, "Path contains '..'"]
    assert r[1].s == "abs/x" and r[2].strip == "c" and r[3].strip == "" and r[3].e == "a\\033b" and r[0].p == "escape.txt" and r[4].p == "x"


def test_mode(spark):
    r = spark.range(1).select(P.permitted_mode(F.lit(0o4755), 0o027, False).alias("a"), P.permitted_mode(F.lit(0o4755), 0o027, True).alias("b")).first()
    assert (r.a, r.b) == (0o750, 0o4755)
