"""Line dedup (operator 3), DataFrame functions only.

Documents are sequences of line ids (MD5 of a line; blank lines are passed over). The suffix array over these sequences is
built by prefix doubling: sorting the ids gives ranks by one line, sorting pairs (rank of the first 2^(k-1) lines, rank of
the next 2^(k-1)) gives ranks by 2^k lines. A suffix whose prefix occurs nowhere else drops out. Suffixes that are equal over
s lines, 2^k <= s < 2^(k+1), form an interval with a longest common prefix of s lines or more, named by the two ranks of 2^k
lines that cover them; all suffixes of an interval but its first are later copies of a run of s lines.

A run of successive lines goes if it has ``min_words`` words or more and starts earlier too: in a document with a smaller
doc_id, or further up in its own. The words count for the whole run, whatever its number of lines; so the later copy of a
maximal repeated run goes as a whole, or stays if it is shorter than that.

Two depths of the intervals decide, for each line: the fewest lines from it on that have ``min_words`` words, and the
fewest up to it. Any repeated run with that many words is a union of such: where the lines from x to the run's end have
the words, the least run from x on is inside it and covers x, else the one from the run's first line on or the one up to x does. As
a line that isn't blank has a word, doubling ends at ``min_words`` lines.

Joins on ranks stay even when one line makes up a third of all lines, and each level is a table in the shared folder.

Defined results: null text counts as empty; blank lines stay and don't part a run; lines that are only in repeated runs with
fewer words stay; of rows with equal doc_id the one read first is earlier, so repeated rows are later copies; a null doc_id
comes before all others; very long texts are one row here and one row a line in between; an empty table gives no rows;
other columns pass through untouched, also those with names that are added here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import Scratch, even_join, fresh, whole_text

#: Runs with fewer words stay.
MIN_WORDS = 8

#: Columns that dedup_lines adds; a table that has them already gets an underscore more.
ABOUT = ("_n_lines", "_n_removed", "_n_runs")

_PLACE = ("_doc", "_row", "_n")


def _words(line: Column) -> Column:
    return F.regexp_count(line, F.lit(r"\S+")).cast("long")


def _fewest(words: Column, min_words: int) -> Column:
    """How many elements of an array, from its first, sum up to ``min_words``; null if all are too few."""
    start = F.struct(F.lit(0).alias("n"), F.lit(0).cast("long").alias("sum"))
    end = F.aggregate(words, start, lambda a, w: F.when(a["sum"] >= min_words, a).otherwise(F.struct((a["n"] + 1).alias("n"), (a["sum"] + w).alias("sum"))))
    return F.when(end["sum"] >= min_words, end["n"])


def _depths(numbered: Column, min_words: int) -> Column:
    """(lid, least, most) for each line: the windows that start at it and that decide have ``least`` to ``most`` lines; null if none do."""

    def one(x: Column, i: Column) -> Column:
        near = F.transform(F.slice(numbered, i + 1, min_words + 1), lambda y: y["words"])
        ahead = _fewest(near, min_words)
        # Windows of a line more whose other lines fall short: the least ones up to their last line.
        behind = F.aggregate(F.slice(near, 2, min_words), F.struct(F.lit(1).alias("n"), F.lit(0).cast("long").alias("sum")), lambda a, w: F.when(a["sum"] + w >= min_words, F.struct(a["n"], F.lit(min_words).cast("long").alias("sum"))).otherwise(F.struct((a["n"] + 1).alias("n"), (a["sum"] + w).alias("sum"))))["n"]
        return F.struct(x["lid"].alias("lid"), ahead.alias("least"), F.greatest(ahead, behind).alias("most"))

    return F.transform(numbered, one)


def _own_key() -> Column:
    """A key that no other row has, shaped like the others but longer."""
    return F.unhex(F.concat(F.lit("FF"), F.lpad(F.hex("_row"), 16, "0"), F.lpad(F.hex("_n"), 16, "0")))


def _repeated(x: DataFrame, name: str, scratch: Scratch, n_lines: int, ranked: bool = True) -> DataFrame:
    """Rows whose key occurs more than once, with the key's rank (growing along the sorted keys) and its first place; the others drop out."""
    many = x.groupBy("_key").agg(F.count(F.lit(1)).alias("_copies"), F.min(F.struct(*_PLACE)).alias("_first")).where("_copies > 1")
    many = many.orderBy("_key").withColumn("_rank", F.monotonically_increasing_id()) if ranked else many
    many = scratch.save(many, f"ranks_{name}")
    return even_join(x, many, "_key", "_copies", n_lines, _own_key()).where(F.col("_first").isNotNull()).drop("_key", "_copies")


def _name(*ranks: Column) -> Column:
    return F.unhex(F.concat(*[F.lpad(F.hex(r), 16, "0") for r in ranks]))


def later_windows(lines: DataFrame, scratch: Scratch, min_words: int = MIN_WORDS) -> DataFrame:
    """(_row, _n, lines): windows of so many lines from line _n on that are to be removed. lines: _doc, _row, _n, lid (16 bytes), least, most; no blank ones."""
    x = lines.select(*_PLACE, F.col("lid").alias("_key"), "least", "most")
    later, hits, size, n_lines = F.struct(*_PLACE) != F.col("_first"), None, 1, lines.count()
    while True:
        # Ranks of the windows that start 1 .. size lines on, as far as windows of at most min_words lines need them.
        on = list(range(1, min(size, min_words - size) + 1))
        w = Window.partitionBy("_row").orderBy("_n")
        x = _repeated(x, str(size), scratch, n_lines)
        x = x.select(*_PLACE, "least", "most", "_rank", later.alias("_later"), *[F.first("_rank").over(w.rangeBetween(d, d)).alias(f"_on_{d}") for d in on])
        x = scratch.save(x, f"level_{size}")
        here = x.where(F.col("_later") & F.lit(size).between(F.col("least"), F.col("most"))).select("_row", "_n", F.lit(size).alias("lines"))
        hits = here if hits is None else hits.unionByName(here)
        if not on or x.isEmpty():
            return hits
        if size > 1:
            sizes = F.expr(f"sequence(greatest(least, {size + 1}), least(most, {size + min(on[-1], size - 1)}))")
            y = x.where(f"most > {size} and least < {2 * size}").withColumn("lines", F.explode(sizes))
            end = F.coalesce(*[F.when(F.col("lines") == size + d, F.col(f"_on_{d}")) for d in on if d < size])
            y = y.where(end.isNotNull()).select(*_PLACE, "lines", _name(F.col("lines").cast("long"), F.col("_rank"), end).alias("_key"))
            hits = hits.unionByName(_repeated(y, f"below_{2 * size}", scratch, n_lines, ranked=False).where(later).select("_row", "_n", "lines"))
        if 2 * size > min_words:
            return hits
        x = x.where(F.col(f"_on_{size}").isNotNull()).select(*_PLACE, "least", "most", _name(F.col("_rank"), F.col(f"_on_{size}")).alias("_key"))
        size *= 2


def dedup_lines(docs: DataFrame, scratch: Scratch, min_words: int = MIN_WORDS) -> DataFrame:
    """All rows with all columns; text without its removed lines, and _n_lines, _n_removed, _n_runs (maximal runs) about them."""
    own = [c for c in docs.columns if c != "text"]
    rows = docs.select(F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(own)]).alias("own"), F.col("doc_id").cast("long").alias("_doc"), whole_text().alias("text"))
    rows = scratch.save(rows.withColumn("_row", F.monotonically_increasing_id()), "documents")
    split = F.split(F.col("text"), "\n", -1)
    numbered = F.filter(F.transform(split, lambda line: F.struct(F.unhex(F.md5(line)).alias("lid"), _words(line).alias("words"))), lambda x: x["words"] > 0)
    lines = rows.select("_doc", "_row", numbered.alias("numbered")).select("_doc", "_row", F.posexplode(_depths(F.col("numbered"), min_words)).alias("_n", "x"))
    lines = scratch.save(lines.select("_doc", "_row", F.col("_n").cast("long").alias("_n"), "x.lid", "x.least", "x.most"), "lines")
    hits = later_windows(lines, scratch, min_words)
    told = hits.groupBy("_row").agg(F.collect_list(F.sequence("_n", F.col("_n") + F.col("lines") - 1)).alias("_gone"))
    told = told.select("_row", F.array_sort(F.array_distinct(F.flatten("_gone"))).alias("_gone"))
    opens = F.filter("_gone", lambda n, i: (i == 0) | (F.get("_gone", i - 1) != n - 1))
    told = told.select("_row", F.size("_gone").cast("long").alias("_n_removed"), F.size(opens).cast("long").alias("_n_runs"), "_gone")
    # Places of the lines that aren't blank; made below the join, else it would be made again for each removed line.
    at = F.filter(F.transform(split, lambda line, i: F.when(line.rlike(r"\S"), i)), lambda i: i.isNotNull())
    x = rows.withColumn("_at", at).join(scratch.save(told, "told").hint("merge"), "_row", "left").withColumn("_lines", split)
    x = x.withColumn("_gone", F.transform("_gone", lambda n: F.get("_at", n.cast("int"))))
    # Between two removed lines stand the lines from one's place + 1 up to the other's.
    runs = F.concat(F.array(F.lit(-1)), F.col("_gone"), F.array(F.size("_lines")))
    pieces = F.zip_with(F.slice(runs, 1, F.size(runs) - 1), F.slice(runs, 2, F.size(runs) - 1), lambda a, b: F.slice(F.col("_lines"), a + 2, b - a - 1))
    text = F.when(F.col("_gone").isNull(), F.col("text")).otherwise(F.array_join(F.flatten(pieces), "\n"))
    x = x.select("own", text.alias("text"), F.size("_lines").cast("long").alias("_n_lines"), F.coalesce("_n_removed", F.lit(0)).alias("_n_removed"), F.coalesce("_n_runs", F.lit(0)).alias("_n_runs"))
    cols = [F.col("text") if c == "text" else F.col(f"own.c{own.index(c)}").alias(c) for c in docs.columns]
    return x.select(*cols, *[F.col(n).alias(fresh(docs, n)) for n in ABOUT])
