"""Archives as logs of members: (archive, ordinal, name, typeflag, mtime_ns, ...). Order is the ordinal, never the row order.

Ordinals and names belong to their archive: wherever a table has a column ``archive``, members of different archives never
meet. A table without it is one archive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import paths as P
from quern.sources.shared import kept

HARD_LINK, SYMLINK, DIRECTORY, FIFO = "1", "2", "5", "6"
SUPPORTED_TYPES = ["0", HARD_LINK, SYMLINK, DIRECTORY, FIFO]
#: Verdicts that count as skipped. The last four are found while extracting.
SKIPPED = ["unsafe", "type", "directory", "link on disk", "missing target", "not permitted"]


#: Ordinals of a block in which copies of one name are compared at once; a name with more is split.
ORDINAL_BLOCK = 100_000


def scope(*tables: DataFrame) -> list[str]:
    """The column that tells archives apart, if all tables have it."""
    return ["archive"] if all("archive" in t.columns for t in tables) else []


def last_copy_wins(members: DataFrame, keys: tuple[str, ...] | None = None, order: tuple[str, ...] = ("ordinal",)) -> DataFrame:
    """The last copy of each name. A partial aggregate, so a name with very many copies is reduced before the shuffle."""
    keys = (*scope(members), "name") if keys is None else keys
    rest = [c for c in members.columns if c not in keys]
    last = members.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_m"))
    return last.select(*keys, *[F.col(f"_m.{c}").alias(c) for c in rest]).select(*members.columns)


def append(members: DataFrame, added: DataFrame) -> DataFrame:
    """Union without dedup; the added ordinals go on behind their archive's last."""
    by = scope(members, added)
    top = members.groupBy(*by).agg((F.max("ordinal") + 1).alias("_top"))  # a row an archive
    moved = added.join(top, by, "left") if by else added.crossJoin(F.broadcast(top))
    moved = moved.withColumn("ordinal", F.col("ordinal") + F.coalesce("_top", F.lit(0))).select(*added.columns)
    return members.unionByName(moved)


def newer(members: DataFrame, candidates: DataFrame) -> DataFrame:
    """Candidates that an update appends: absent from the archive, or newer than its newest copy of that exact name."""
    by = [*scope(members, candidates), "name"]
    held = members.groupBy(*by).agg(F.max("mtime_ns").alias("_held"))
    x = candidates.join(held, by, "left").where(F.col("_held").isNull() | (F.col("mtime_ns") > F.col("_held")))
    return x.select(*candidates.columns)


def _bare_name(c: Column) -> Column:
    return F.regexp_replace(c, r"/+$", "")


def matched_names(name: Column) -> Column:
    """Each name under which an operand can mean a member: its own and all directories that it is in."""
    own = _bare_name(name)
    return F.array_distinct(F.concat(F.array(own), P.ancestors(own)))


#: Operands that are looked up in a list rather than by a join, at most: a few MB.
MOST_LISTED = 10_000


def _meant(members: DataFrame, names: DataFrame) -> Column | DataFrame:
    """Whether an operand means a member, as a condition where they are few; else names that are meant."""
    wanted = names.select(_bare_name(F.col("name")).alias("_match")).distinct()
    few = [r[0] for r in wanted.limit(MOST_LISTED + 1).collect()]
    if len(few) <= MOST_LISTED:
        return F.arrays_overlap(matched_names(F.col("name")), F.lit(few).cast("array<string>"))
    spelt = members.select("name").distinct().withColumn("_match", F.explode(matched_names(F.col("name"))))
    return spelt.join(wanted, "_match", "left_semi").select("name").distinct()


def delete(members: DataFrame, names: DataFrame) -> DataFrame:
    """Without every copy of the given names (column ``name``, a trailing slash doesn't count) and of all below them."""
    hit = _meant(members, names)
    return members.where(~hit) if isinstance(hit, Column) else members.join(hit, "name", "left_anti")


def select_operands(members: DataFrame, names: DataFrame) -> DataFrame:
    """Members named exactly or by a directory above them."""
    hit = _meant(members, names)
    return members.where(hit) if isinstance(hit, Column) else members.join(hit, "name", "left_semi")


def not_found(members: DataFrame, names: DataFrame) -> DataFrame:
    """Operands that mean no member of any archive."""
    known = members.select(F.explode(matched_names(F.col("name"))).alias("_match")).distinct()
    return names.join(known, _bare_name(F.col("name")) == F.col("_match"), "left_anti")


def case_collisions(members: DataFrame) -> DataFrame:
    """Names of an archive that differ only in case: folded, spellings. On a file system that folds case they would overwrite each other."""
    spelt = members.groupBy(*scope(members), F.lower("name").alias("folded")).agg(F.countDistinct("name").alias("spellings"))
    return spelt.where("spellings > 1")


def refused_collisions(members: DataFrame, on_disk: DataFrame | None = None, force: bool = False) -> DataFrame:
    """Members that a file system that folds case doesn't get: those whose folded name an earlier member spells otherwise.

    ``on_disk`` (column ``name``): files from before, over which a member may write as usual. With ``force`` none is refused.
    """
    if force:
        return members.limit(0)
    by = scope(members)
    x = members.withColumn("_folded", F.lower("name"))
    first = x.groupBy(*by, "_folded").agg(F.min_by("name", "ordinal").alias("_first"), F.min("name").alias("_a"), F.max("name").alias("_z")).where("_a <> _z")
    x = x.join(first.drop("_a", "_z"), [*by, "_folded"]).where(F.col("name") != F.col("_first"))
    return (x.join(on_disk.select("name").distinct(), "name", "left_anti") if on_disk is not None else x).select(*members.columns)


def replaced_directories(members: DataFrame) -> DataFrame:
    """Links and FIFOs whose name is a directory with members in it by then: they are refused."""
    by = scope(members)
    below = members.select(*by, F.explode(P.ancestors(F.col("name"))).alias("name"), F.col("ordinal").alias("_child")).groupBy(*by, "name").agg(F.min("_child").alias("_child"))
    x = members.where(F.col("typeflag").isin(HARD_LINK, SYMLINK, FIFO)).join(below, [*by, "name"]).where(F.col("_child") < F.col("ordinal"))
    return x.select(*members.columns)


def through_symlinks(members: DataFrame) -> DataFrame:
    """Members whose path runs through a symlink that stands earlier in their archive: an equi-join on ancestors, with the order checked."""
    by = scope(members)
    links = members.where(F.col("typeflag") == SYMLINK).groupBy(*by, F.col("name").alias("_link")).agg(F.min("ordinal").alias("_at"))
    x = members.withColumn("_link", F.explode(P.ancestors(F.col("name")))).join(links, [*by, "_link"]).where(F.col("_at") < F.col("ordinal"))
    return members.join(x.select(*by, "ordinal").distinct(), [*by, "ordinal"], "left_semi").select(*members.columns)


def resolve_hard_links(members: DataFrame) -> DataFrame:
    """Hard links with the ordinal of the last earlier member that they name, null if there is none.

    Targets and links meet by name in blocks of ordinals; what earlier blocks hold comes as one number a block. So a name with
    very many copies is neither joined to all of its links nor sorted in one task.
    """
    by = scope(members)
    key = F.when(F.col("typeflag") == HARD_LINK, F.col("linkname")).otherwise(F.col("name"))
    x = members.select(*by, "ordinal", "name", "linkname", key.alias("_key"), F.when(F.col("typeflag") != HARD_LINK, F.col("ordinal")).alias("_target"), F.floor(F.col("ordinal") / ORDINAL_BLOCK).alias("_block"))
    w = Window.partitionBy(*by, "_key").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = x.groupBy(*by, "_key", "_block").agg(F.max("_target").alias("_last")).withColumn("_before", F.max("_last").over(w)).drop("_last")
    near = Window.partitionBy(*by, "_key", "_block").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumn("_near", F.max("_target").over(near)).where(F.col("_target").isNull())
    x = x.join(blocks.where("_before is not null"), [*by, "_key", "_block"], "left")
    return x.select(*by, "ordinal", "name", "linkname", F.coalesce("_near", "_before").alias("target"))


def dereference(members: DataFrame) -> DataFrame:
    """Symlinks take type and size of what they name; those that name nothing stay links."""
    by = scope(members)
    real = last_copy_wins(members.where(F.col("typeflag") != SYMLINK).select(*by, "name", "ordinal", "typeflag", "size"))
    real = real.select(*by, F.col("name").alias("_key"), F.col("typeflag").alias("_type"), F.col("size").alias("_size"))
    is_link = F.col("typeflag") == SYMLINK
    x = members.withColumn("_key", F.when(is_link, F.col("linkname")).otherwise(F.concat(F.lit("/"), F.col("ordinal").cast("string"))))
    x = x.join(real, [*by, "_key"], "left")
    return x.select(*[F.when(is_link & F.col("_type").isNotNull(), F.col(f"_{n}")).otherwise(F.col(c)).alias(c) if (n := {"typeflag": "type", "size": "size"}.get(c)) else F.col(c) for c in members.columns])


def strip_components(members: DataFrame, n: int) -> DataFrame:
    """Names, and with them the targets of hard links, without their first n components; members that have no more go."""
    x = members.withColumn("name", P.strip_components(F.col("name"), n))
    if "linkname" in members.columns:
        x = x.withColumn("linkname", F.when(F.col("typeflag") == HARD_LINK, P.strip_components(F.col("linkname"), n)).otherwise(F.col("linkname")))
    return x.where("name <> ''")


def audit(members: DataFrame, patterns: list[str] | None = None, no_links: bool = False) -> DataFrame:
    """Members with what becomes of each: extract, exclude, link (dropped on request), unsafe, type (not supported), unreadable. An unsafe name counts as such even on a dropped link."""
    c = F.when(F.col("error").isNotNull(), F.lit("unreadable")) if "error" in members.columns else F
    c = c.when(P.excluded(F.col("name"), patterns or []), F.lit("exclude")).when(P.unsafe_reason(F.col("name")).isNotNull(), F.lit("unsafe"))
    if no_links:
        c = c.when(F.col("typeflag").isin(HARD_LINK, SYMLINK), F.lit("link"))
    return members.withColumn("verdict", c.when(~F.col("typeflag").isin(SUPPORTED_TYPES), F.lit("type")).otherwise(F.lit("extract")))


def skip_counts(audited: DataFrame) -> DataFrame:
    """One row: members, skipped ones, unreadable ones, exit status under the strict rule."""
    skipped, unreadable = F.count_if(F.col("verdict").isin(SKIPPED)), F.count_if(F.col("verdict") == "unreadable")
    return audited.agg(F.count(F.lit(1)).alias("members"), skipped.alias("skipped"), unreadable.alias("unreadable"), F.when(skipped + unreadable > 0, 1).otherwise(0).alias("status"))


def canonical(members: DataFrame) -> DataFrame:
    """Sorted for writing: by archive, directories before what is in them, each directory in byte order."""
    return members.orderBy("archive", P.parts(F.col("name")), "ordinal")


def canonical_rank(members: DataFrame) -> DataFrame:
    """Place of each member in its archive's canonical order: a sort by ranges, so no archive has to fit a task, and each range's offset in its archive."""
    order = ["archive", "_parts", "ordinal"]
    x = members.withColumn("_parts", P.parts(F.col("name"))).repartitionByRange(*order).sortWithinPartitions(*order)
    x = kept(x.withColumn("_id", F.monotonically_increasing_id()).drop("_parts"), "canonical")
    ranges = x.groupBy("archive", F.shiftright("_id", 33).alias("_range")).agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_rows"))  # a row for each range of an archive
    before = F.coalesce(F.sum("_rows").over(Window.partitionBy("archive").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = ranges.select("archive", "_range", "_first", before.alias("_before"))
    x = x.withColumn("_range", F.shiftright("_id", 33)).join(ranges, ["archive", "_range"])
    return x.select(*members.columns, (F.col("_id") - F.col("_first") + F.col("_before") + 1).cast("int").alias("place"))


def extract_to_stdout(members: DataFrame) -> DataFrame:
    """Contents of regular files in archive order."""
    return members.where(F.col("typeflag") == "0").orderBy("archive", "ordinal").select("archive", "ordinal", "content")


def touched(members: DataFrame, now_ns: int) -> DataFrame:
    """With the time of extraction instead of the stored one."""
    return members.withColumn("mtime_ns", F.lit(now_ns).cast("long"))


def without_archive(files: DataFrame, archive: str) -> DataFrame:
    """Files to pack, without the archive that is being written: the same file, by whatever name, where the listing has identities (``file_id``), else the same name."""
    plain = lambda c: F.regexp_replace(F.regexp_replace(P.bare(c), r"/(\\./)+", "/"), r"//+", "/")
    own = plain(F.col("name")) == plain(F.lit(archive))
    if "file_id" not in files.columns:
        return files.where(~own)
    ids = [r[0] for r in files.where(own).select("file_id").distinct().collect()]  # of one path
    return files.where(~own & ~F.coalesce(F.col("file_id").isin(ids), F.lit(False))) if ids else files


def checks(members: DataFrame) -> DataFrame:
    """CRC-32, size and SHA-256 of each member's content."""
    c = F.coalesce("content", F.lit(b""))
    return members.select("archive", "ordinal", F.crc32(c).alias("crc32"), F.length(c).cast("long").alias("size"), F.sha2(c, 256).alias("sha256"))


def skip_compressed(members: DataFrame, codec: str) -> DataFrame:
    """Archives with the codec that a writer gives them: none for one that is a single regular file whose name says that it is compressed."""
    one = (F.count(F.lit(1)) == 1) & F.bool_and((F.col("typeflag") == "0") & P.is_compressed(F.col("name")))
    return members.groupBy(*scope(members)).agg(F.when(one, F.lit("none")).otherwise(F.lit(codec)).alias("codec"))


def header_checksum(header: Column) -> Column:
    """Sum of a tar header's bytes, with blanks in the place of the sum itself (bytes 148 to 155); null if it has less than 512.

    The other bytes are read as Latin-1, a character each. Zeros, most of a header, add nothing and go beforehand.
    """
    others = F.decode(F.concat(F.substring(header, 1, 148), F.substring(header, 157, 356)), "ISO-8859-1")
    each = F.split(F.replace(others, F.lit("\0"), F.lit("")), "")
    return F.when(F.length(header) >= 512, F.aggregate(each, F.lit(8 * 32).cast("long"), lambda a, c: a + F.ascii(c)))
