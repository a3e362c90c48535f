from quern.operators import catalog as C

MEMBER = "ordinal long, name string, typeflag string, linkname string, size long, mtime_ns long"


def log(spark, *rows):
    return spark.createDataFrame([(i, n, t, k, s, m) for i, (n, t, k, s, m) in enumerate(rows)], MEMBER)


def plain(*names):
    return [(n, "0", None, 1, 0) for n in names]


def names(df):
    return sorted(r.name for r in df.collect())


def test_last_copy(spark):
    x = log(spark, ("dup", "0", None, 1, 5), ("dup", "0", None, 2, 1), ("File", "0", None, 3, 0), ("file", "0", None, 4, 0))
    assert {(r.name, r.size) for r in C.last_copy_wins(x).collect()} == {("dup", 2), ("File", 3), ("file", 4)}
    assert [tuple(r) for r in C.case_collisions(x).collect()] == [("file", 2)]
    assert names(C.refused_collisions(x)) == ["file"] and names(C.refused_collisions(x, force=True)) == []
    assert names(C.refused_collisions(x, spark.createDataFrame([("file",)], "name string"))) == []


def test_update_takes_newer_and_absent(spark):
    a = log(spark, ("a", "0", None, 1, 100), ("b", "0", None, 1, 100), ("c", "0", None, 1, 1))
    new = log(spark, ("a", "0", None, 1, 101), ("b", "0", None, 1, 100), ("./c", "0", None, 1, 0), ("d", "0", None, 1, 0))
    assert names(C.newer(a, new)) == ["./c", "a", "d"]
    assert C.append(a, C.newer(a, new)).agg({"ordinal": "max"}).first()[0] == 6


def test_delete_and_select(spark):
    x = log(spark, *plain("a.txt", "sub/", "sub/c.txt", "a.txt", "subway"))
    ask = spark.createDataFrame([("sub",), ("nosuch",)], "name string")
    assert names(C.delete(x, ask)) == ["a.txt", "a.txt", "subway"]
    assert names(C.select_operands(x, ask)) == ["sub/", "sub/c.txt"]
    assert names(C.not_found(x, ask)) == ["nosuch"]


def test_links(spark):
    x = log(spark, ("p", "2", "../..", 0, 0), ("p/x", "0", None, 1, 0), ("h", "1", "p/x", 0, 0), ("h2", "1", "late", 0, 0), ("late", "0", None, 9, 0), ("q", "2", "late", 0, 0), ("p", "6", None, 0, 0))
    assert names(C.through_symlinks(x)) == ["p/x"]
    assert {(r.name, r.target) for r in C.resolve_hard_links(x).collect()} == {("h", 1), ("h2", None)}
    assert {(r.name, r.typeflag, r.size) for r in C.dereference(x).collect() if r.name == "q"} == {("q", "0", 9)}
    assert [r.ordinal for r in C.replaced_directories(x).collect()] == [6]


def test_audit(spark):
    x = log(spark, ("../e", "2", "x", 0, 0), ("good", "0", None, 1, 0), ("dev", "3", None, 0, 0), ("l", "2", "good", 0, 0))
    assert [r.verdict for r in C.audit(x, no_links=True).orderBy("ordinal").collect()] == ["unsafe", "extract", "type", "link"]
    assert tuple(C.skip_counts(C.audit(x)).first()) == (4, 2, 0, 1)


def test_canonical_order(spark):
    from pyspark.sql import functions as F

    x = log(spark, *plain("d.x/f", "d/f", "d.x", "d")).withColumn("archive", F.lit("a"))
    assert [r.name for r in C.canonical(x).collect()] == ["d", "d/f", "d.x", "d.x/f"]
    assert [r.name for r in C.canonical_rank(x).orderBy("place").collect()] == ["d", "d/f", "d.x", "d.x/f"]


def two(spark, *rows):
    """Members of two archives whose ordinals both start at 0."""
    seen = {}
    out = []
    for a, n, t, k in rows:
        out.append((a, seen.setdefault(a, 0), n, t, k, 1, seen[a]))
        seen[a] += 1
    return spark.createDataFrame(out, "archive string, ordinal long, name string, typeflag string, linkname string, size long, mtime_ns long")


def at(df):
    return sorted((r.archive, r.ordinal) for r in df.collect())


def test_archives_are_worlds_of_their_own(spark):
    x = two(spark, ("A", "link", "2", "t"), ("A", "x", "0", None), ("A", "link/f", "0", None), ("A", "h", "1", "x"), ("B", "x", "0", None), ("B", "link/f", "0", None), ("B", "h", "1", "t"), ("B", "q", "2", "x"), ("B", "t", "0", None), ("A", "q", "2", "t"))
    assert at(C.through_symlinks(x)) == [("A", 2)]
    assert {(r.archive, r.ordinal, r.target) for r in C.resolve_hard_links(x).collect()} == {("A", 3, 1), ("B", 2, None)}
    assert {(r.archive, r.typeflag) for r in C.dereference(x).where("name = 'q'").collect()} == {("A", "2"), ("B", "0")}
    assert len(at(C.last_copy_wins(x))) == 10
    y = two(spark, ("A", "d/f", "0", None), ("B", "d", "2", "t"), ("B", "d/f", "0", None), ("A", "d", "2", "t"))
    assert at(C.replaced_directories(y)) == [("A", 1)]
    more = two(spark, ("B", "n", "0", None), ("C", "n", "0", None))
    assert at(C.append(y, more)) == [("A", 0), ("A", 1), ("B", 0), ("B", 1), ("B", 2), ("C", 0)]
    assert at(C.newer(y, two(spark, ("A", "d", "0", None), ("C", "d", "0", None)))) == [("C", 0)]
    up = two(spark, ("A", "F", "0", None), ("B", "f", "0", None), ("A", "f", "0", None))
    assert at(C.refused_collisions(up)) == [("A", 1)] and [r.archive for r in C.case_collisions(up).collect()] == ["A"]


def test_copies_of_a_hard_link_s_target_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(C, "ORDINAL_BLOCK", 3)
    x = log(spark, *[("hot", "0", None, 1, 0) if i % 5 else ("l", "1", "hot", 0, 0) for i in range(30)])
    assert {r.ordinal: r.target for r in C.resolve_hard_links(x).collect()} == {i: i - 1 if i else None for i in range(0, 30, 5)}


def test_many_operands_are_joined(spark, monkeypatch):
    x = log(spark, *plain("a.txt", "sub/", "sub/c.txt", "a.txt", "subway"))
    ask = spark.createDataFrame([("sub",), ("nosuch",)], "name string")
    monkeypatch.setattr(C, "MOST_LISTED", 1)
    assert names(C.delete(x, ask)) == ["a.txt", "a.txt", "subway"] and names(C.select_operands(x, ask)) == ["sub/", "sub/c.txt"]


def test_strip_takes_hard_links_along(spark):
    x = log(spark, ("a/b/f", "0", None, 1, 0), ("a/h", "1", "a/b/f", 0, 0), ("a/s", "2", "a/b", 0, 0), ("a", "5", None, 0, 0))
    assert {(r.name, r.linkname) for r in C.strip_components(x, 1).collect()} == {("b/f", None), ("h", "b/f"), ("s", "a/b")}


def test_unreadable_items_count(spark):
    from pyspark.sql import functions as F

    x = log(spark, *plain("a", "b")).withColumn("error", F.when(F.col("name") == "b", "damaged"))
    assert tuple(C.skip_counts(C.audit(x)).first()) == (2, 0, 1, 1)


def test_single_compressed_files_take_no_codec(spark):
    x = two(spark, ("A", "m.MP4", "0", None), ("B", "m.mp4", "0", None), ("B", "n", "0", None), ("C", "d.zip", "5", None), ("D", "x.zipx", "0", None), ("E", "x.tar", "0", None), ("F", "x.lzfse.apple", "0", None))
    assert {r.archive: r.codec for r in C.skip_compressed(x, "zstd").collect()} == {"A": "none", "B": "zstd", "C": "zstd", "D": "none", "E": "zstd", "F": "none"}


def test_own_archive_is_left_out_by_identity(spark):
    x = spark.createDataFrame([("./out.tar", 7), ("d/alias.tar", 7), ("f", 8), ("g", None)], "name string, file_id long")
    assert names(C.without_archive(x, "out.tar")) == ["f", "g"] and names(C.without_archive(x.drop("file_id"), "out.tar")) == ["d/alias.tar", "f", "g"]
