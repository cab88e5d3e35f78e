"""Path operators over listings: globs, extensions, directories as columns and queries.

Names are case-insensitive; both sides of a comparison go through lower().
Order matters where the first of several duplicates wins, so listings carry an
explicit ordinal column.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SEPARATORS = r"\\/:"


def glob_regex(pattern: str) -> str:
    """Anchored, case-insensitive regular expression of a file mask; `*.*` means `*`."""
    body, tail = (pattern[:-2], r"(?:\..*)?") if pattern.endswith(".*") else (pattern, "")
    out = "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in body)
    return f"(?is)^{out}{tail}$"


def matches(name: Column, pattern: str) -> Column:
    return name.rlike(glob_regex(pattern))


def file_name(path: Column) -> Column:
    """What follows the last separator."""
    return F.regexp_extract(path, rf"([^{SEPARATORS}]*)$", 1)


def directory(path: Column) -> Column:
    """What stands before the last separator, without it."""
    return F.regexp_extract(path, rf"^(.*)[{SEPARATORS}][^{SEPARATORS}]*$", 1)


def extension(path: Column) -> Column:
    """Lower-cased extension without the dot; empty if there is none."""
    return F.lower(F.regexp_extract(path, rf"\.([^.{SEPARATORS}]*)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"\.[^.]*$", "")


def has_extension(path: Column, *wanted: str) -> Column:
    """Any of the extensions (a leading dot is ignored)."""
    return extension(path).isin(*[w.lower().lstrip(".") for w in wanted])


def change_file_name(path: Column, name: Column) -> Column:
    return F.concat(F.regexp_extract(path, rf"^(.*[{SEPARATORS}])?", 0), name)


def change_extension(path: Column, ext: Column) -> Column:
    return F.concat(F.regexp_replace(path, rf"\.[^.{SEPARATORS}]*$", ""), F.lit("."), ext)


def is_valid_name(name: Column) -> Column:
    """Not blank and not rooted (a leading separator or a drive)."""
    return (F.trim(name) != "") & ~name.rlike(r"^(?:[\\/]|[A-Za-z]:)")


def safe_target(name: Column) -> Column:
    """A relative path below the destination: root stripped, `.` and `..` resolved without leaving it."""
    parts = F.split(F.regexp_replace(name, r"^(?:[A-Za-z]:)?[\\/]*", ""), r"[\\/]+")
    up = lambda acc, p: F.when(p == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).when(p.isin("", "."), acc).otherwise(F.concat(acc, F.array(p)))
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), up), "/")


def normalise(path: Column) -> Column:
    """Directory path with `/` between parts, `.` and `..` resolved."""
    return safe_target(path)


def subtree(entries: DataFrame, cwd: str, name_col: str = "name") -> DataFrame:
    """All entries below a directory, by case-insensitive prefix; '' is the root."""
    if not cwd:
        return entries
    return entries.filter(F.lower(name_col).startswith(cwd.rstrip("/").lower() + "/"))


def children(entries: DataFrame, cwd: str, name_col: str = "name", ord_col: str = "ord") -> DataFrame:
    """Files of a directory, and each distinct first path segment below it once as a directory.

    Directories are told apart without case; the spelling met first stays. Rows:
    name, kind ('directory' or 'file'), ord (of the first member).
    """
    below = subtree(entries, cwd, name_col)
    skip = len(cwd.rstrip("/")) + 1 if cwd else 0
    rest = F.substring(F.col(name_col), F.lit(skip + 1), F.length(name_col))
    rows = below.select(rest.alias("rest"), F.col(ord_col).alias("ord"))
    files = rows.filter(~F.col("rest").contains("/")).select(F.col("rest").alias("name"), F.lit("file").alias("kind"), "ord")
    segment = F.substring_index("rest", "/", 1)
    dirs = rows.filter(F.col("rest").contains("/")).groupBy(F.lower(segment).alias("k")).agg(F.min_by(segment, "ord").alias("name"), F.min("ord").alias("ord"))
    return dirs.select("name", F.lit("directory").alias("kind"), "ord").unionByName(files)


def files_in(entries: DataFrame, pattern: str, name_col: str = "name") -> DataFrame:
    """Tree listing with a mask: an optional directory prefix and a glob on the file-name part."""
    head, _, mask = pattern.replace("\\", "/").rpartition("/")
    own = F.substring_index(name_col, "/", -1)
    return subtree(entries, head, name_col).filter(matches(own, mask))


def expand_selection(selection: DataFrame, entries: DataFrame, name_col: str = "name") -> DataFrame:
    """Selected files, and the members of selected directories. `..` is skipped; duplicates stay.

    selection: name, is_dir. Instead of a nested loop over prefixes each entry
    offers its ancestor directories, so the join is on equality.
    """
    files = selection.filter(~F.col("is_dir")).select(F.lower("name").alias("k")).join(entries.withColumn("k", F.lower(name_col)), "k").drop("k")
    dirs = selection.filter(F.col("is_dir") & (F.col("name") != "..")).select(F.lower("name").alias("k"))
    parts = F.split(F.lower(name_col), "/")
    ancestors = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    inside = entries.withColumn("k", F.explode(F.when(F.size(parts) > 1, ancestors))).join(dirs, "k").drop("k")
    return files.unionByName(inside)


def find(names: DataFrame, entries: DataFrame, cwd: str = "", name_col: str = "name", ord_col: str = "ord") -> DataFrame:
    """wanted -> found: the exact name, else relative to cwd, else the first entry of that directory; first duplicate wins."""
    base = cwd.rstrip("/") + "/" if cwd else ""
    own = entries.select(F.lower(name_col).alias("k"), F.col(name_col).alias("found"), F.col(ord_col).alias("o"))
    parts = F.split("found", "/")
    dirs = own.filter(F.size(parts) > 1).select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))).alias("d"), "found", "o")
    firsts = dirs.groupBy(F.col("d").alias("k")).agg(F.min_by("found", "o").alias("found"), F.min("o").alias("o"))
    tries = names.select("wanted", F.explode(F.array(F.struct(F.lit(1).alias("r"), F.lower("wanted").alias("k")), F.struct(F.lit(2).alias("r"), F.lower(F.concat(F.lit(base), "wanted")).alias("k")))).alias("t"))
    exact = tries.select("wanted", "t.r", "t.k").join(own, "k").select("wanted", "r", "found", "o")
    inside = names.select("wanted", F.lit(3).alias("r"), F.regexp_replace("wanted", "/+$", "").alias("k")).join(firsts, "k").select("wanted", "r", "found", "o")
    best = exact.unionByName(inside).groupBy("wanted").agg(F.min_by(F.struct("found", "r"), F.struct("r", "o")).alias("b"))
    return names.join(best, "wanted", "left").select("wanted", F.col("b.found").alias("found"), F.col("b.r").alias("how"))


def select_by_mask(entries: DataFrame, selected: DataFrame, pattern: str, name_col: str = "name") -> DataFrame:
    """The selection after adding what the mask matches: already selected rows first, none twice."""
    more = entries.filter(matches(F.col(name_col), pattern)).join(selected.select(name_col), name_col, "left_anti")
    return selected.select(name_col, F.lit(0).alias("added")).unionByName(more.select(name_col, F.lit(1).alias("added")))


def masks(entries: DataFrame, name_col: str = "name") -> DataFrame:
    """Sorted distinct masks (`*.ext`) of a listing."""
    return entries.select(extension(F.col(name_col)).alias("e")).filter("e != ''").distinct().select(F.concat(F.lit("*."), "e").alias("mask")).orderBy("mask")


def dedupe_first(entries: DataFrame, container_cols: list[str], name_col: str = "name", ord_col: str = "ord") -> DataFrame:
    """The first row of each case-insensitive name in each container."""
    w = Window.partitionBy(*container_cols, F.lower(name_col)).orderBy(ord_col)
    return entries.withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")


def rename_duplicates(entries: DataFrame, name_col: str = "name", ord_col: str = "ord", limit: int = 100) -> DataFrame:
    """target: NAME.EXT, then NAME.1.EXT ...; null past `limit` attempts."""
    w = Window.partitionBy(F.lower(name_col)).orderBy(ord_col)
    n = F.row_number().over(w) - 1
    numbered = F.concat(F.regexp_replace(name_col, rf"\.[^.{SEPARATORS}]*$", ""), F.lit("."), n.cast("string"), F.regexp_extract(name_col, rf"\.[^.{SEPARATORS}]*$", 0))
    return entries.withColumn("target", F.when(n == 0, F.col(name_col)).when(n <= limit, numbered))
