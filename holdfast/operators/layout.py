"""Relational layout of containers: offsets, sizes, groups and joins of index rows.

Windows are partitioned by container. A container has fewer than 0x40000
members, so a partition is bounded whatever the number of containers. Interval
joins are equi-joins on bins, so they need no nested loop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from holdfast.operators import staging

#: fixed values of the data model
MAX_MEMBERS = 0x40000
MAX_SIZE = 0xFFFFFFFF


def is_placed(offset: Column, size: Column, end: Column) -> Column:
    """Does a member lie inside its file? An offset of -1 (none) passes."""
    return (offset < end) & (size <= end) & (offset <= end - size)


def is_sane_count(n: Column) -> Column:
    return (n > 0) & (n < MAX_MEMBERS)


def _by(container: list[str], *order) -> Window:
    return Window.partitionBy(*container).orderBy(*order)


def prefix_offsets(df: DataFrame, container: list[str], order: list[str], size: str, out: str = "offset", align: int = 1) -> DataFrame:
    """Offsets as exclusive running sums of sizes, each size padded to `align`."""
    padded = F.ceil(F.col(size) / align) * align if align > 1 else F.col(size)
    w = _by(container, *order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(out, F.coalesce(F.sum(padded).over(w), F.lit(0)).cast("bigint"))


def lead_size(df: DataFrame, container: list[str], order: list[str], offset: str, end: str, out: str = "size") -> DataFrame:
    """Size from the next row's offset in index order; the last reaches to the end."""
    nxt = F.lead(offset).over(_by(container, *order))
    return df.withColumn(out, (F.coalesce(nxt, F.col(end)) - F.col(offset)).cast("bigint"))


def strict_lead_size(df: DataFrame, container: list[str], offset: str, end: str, out: str = "size") -> DataFrame:
    """Size to the next greater offset; rows with equal offsets share it."""
    # from the end backwards the frame grows by each row, so its minimum is kept, not found anew
    w = _by(container, F.desc(offset)).rangeBetween(Window.unboundedPreceding, -1)
    return df.withColumn(out, (F.coalesce(F.min(offset).over(w), F.col(end)) - F.col(offset)).cast("bigint"))


def distinct_lead_size(df: DataFrame, container: list[str], order: str, offset: str, end: str, out: str = "size") -> DataFrame:
    """As strict_lead_size, but of rows with equal offsets only the last by `order` gets a size, the others 0."""
    sized = strict_lead_size(df, container, offset, end, out)
    last = F.max(order).over(Window.partitionBy(*container, offset))
    return sized.withColumn(out, F.when(F.col(order) == last, F.col(out)).otherwise(F.lit(0).cast("bigint")))


def fill_last(df: DataFrame, container: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """The last value that is not null, at or before each row (as-of within a container)."""
    w = _by(container, *order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.last(value, ignorenulls=True).over(w))


def sessionize(df: DataFrame, container: list[str], order: list[str], is_head: Column, out: str = "group_no") -> DataFrame:
    """Consecutive rows in groups: each head opens one; rows before the first head are group 0."""
    w = _by(container, *order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.sum(is_head.cast("int")).over(w).cast("bigint"))


def number_rows(df: DataFrame, container: list[str], order: list[str], pattern: str = "%04d", out: str = "name", start: int = 0) -> DataFrame:
    """Names made of the row's number."""
    return df.withColumn(out, F.format_string(pattern, F.row_number().over(_by(container, *order)) - 1 + start))


def zip_by_ordinal(left: DataFrame, right: DataFrame, container: list[str], left_order: list[str], right_order: list[str]) -> DataFrame:
    """Pairs the rows of two listings by their number in the container."""
    a = left.withColumn("pos", F.row_number().over(_by(container, *left_order)))
    b = right.withColumn("pos", F.row_number().over(_by(container, *right_order)))
    return a.join(b, [*container, "pos"])


def _levels(df: DataFrame, start: str, end: str, width: int) -> Column:
    """By how many powers of two bins must be wider than `width` for [start, end) to meet two at most."""
    return F.greatest(F.lit(0), F.ceil(F.log2((F.col(end) - F.col(start)) / F.lit(width)))).cast("int")


def _dealt(df: DataFrame, start: str, end: str, width: int, levels: list[int]) -> DataFrame:
    """Rows that are not empty with own_, level_ and bin_: two bins at most at their own level and each wider one of `levels`."""
    own = df.filter(F.col(end) > F.col(start)).withColumn("own_", _levels(df, start, end, width))
    at = F.filter(F.array(*[F.lit(x) for x in levels]).cast("array<int>"), lambda x: x >= F.col("own_"))
    own = own.withColumn("level_", F.explode(at))
    span = F.lit(width).cast("bigint") * F.pow(F.lit(2.0), F.col("level_")).cast("bigint")
    return own.withColumn("bin_", F.explode(F.sequence(F.floor(F.col(start) / span), F.floor((F.col(end) - 1) / span)))).withColumn("span_", span)


def _used(frames: list[tuple[DataFrame, str, str]], width: int) -> list[int]:
    """The levels that intervals have: 63 at most."""
    got = set()
    for df, start, end in frames:
        got |= {r[0] for r in df.filter(F.col(end) > F.col(start)).select(_levels(df, start, end, width)).distinct().collect()}
    return sorted(got)


def overlap_join(left: DataFrame, right: DataFrame, on: list[str], a: tuple[str, str], b: tuple[str, str], width: int) -> DataFrame:
    """Pairs whose half-open intervals a = [start, end) and b overlap, each once.

    An interval stands in at most two bins at each level, bins being `width`
    times a power of two wide, from the level of its own width up: a wide
    interval costs as few rows as a short one. A pair meets at the level of the
    wider one and is kept in the bin where the later of the two begins.
    """
    levels = _used([(left, *a), (right, *b)], width)
    x = _dealt(left, *a, width, levels)
    y = _dealt(right, *b, width, levels).withColumnRenamed("own_", "own2_").drop("span_")
    met = x.join(y, [*on, "level_", "bin_"]).filter((F.col(a[0]) < F.col(b[1])) & (F.col(b[0]) < F.col(a[1])))
    once = (F.col("level_") == F.greatest("own_", "own2_")) & (F.col("bin_") == F.floor(F.greatest(a[0], b[0]) / F.col("span_")))
    return met.filter(once).drop("bin_", "level_", "own_", "own2_", "span_")


def contain_join(points: DataFrame, intervals: DataFrame, on: list[str], at: str, span: tuple[str, str], width: int) -> DataFrame:
    """Points with the interval [start, end) that holds them; a point looks once at each level that intervals have."""
    levels = _used([(intervals, *span)], width)
    y = intervals.filter(F.col(span[1]) > F.col(span[0])).withColumn("level_", _levels(intervals, *span, width))
    wide = F.lit(width).cast("bigint") * F.pow(F.lit(2.0), F.col("level_")).cast("bigint")
    y = y.withColumn("bin_", F.explode(F.sequence(F.floor(F.col(span[0]) / wide), F.floor((F.col(span[1]) - 1) / wide))))
    x = points.withColumn("level_", F.explode(F.array(*[F.lit(v) for v in levels]).cast("array<int>"))).withColumn("bin_", F.floor(F.col(at) / wide))
    return x.join(y, [*on, "level_", "bin_"]).filter((F.col(at) >= F.col(span[0])) & (F.col(at) < F.col(span[1]))).drop("bin_", "level_")


def prefix_join(long: DataFrame, short: DataFrame, text: str, prefix: str) -> DataFrame:
    """Rows whose text begins with the other's prefix: equal lengths meet on equality.

    The lengths that prefixes have are read first: at most as many as the longest has characters.
    """
    sizes = sorted(r[0] for r in short.filter(F.col(prefix).isNotNull()).select(F.length(prefix)).distinct().collect())
    fit = F.filter(F.array(*[F.lit(n) for n in sizes]).cast("array<int>"), lambda n: n <= F.length(text))
    cut = long.withColumn("len_", F.explode(fit)).withColumn("cut_", F.substring(F.col(text), F.lit(1), F.col("len_")))
    return cut.join(short, F.col("cut_") == F.col(prefix)).drop("cut_", "len_")


def as_of_join(left: DataFrame, right: DataFrame, on: list[str], at: str, key: str, value: str, out: str) -> DataFrame:
    """For each left row the value of the latest right row with key <= at."""
    a = left.select("*", F.col(at).alias("t_"), F.lit(None).cast(right.schema[value].dataType).alias("v_"), F.lit(1).alias("side_"))
    b = right.select(*on, F.col(key).alias("t_"), F.col(value).alias("v_"), F.lit(0).alias("side_"))
    w = Window.partitionBy(*on).orderBy("t_", "side_").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b, allowMissingColumns=True).withColumn(out, F.last("v_", ignorenulls=True).over(w))
    return both.filter("side_ = 1").drop("t_", "v_", "side_")


def merge_full(left: DataFrame, right: DataFrame, on: str, prefer_right: dict[str, str]) -> DataFrame:
    """Full outer merge of two index tables; for each name: right column wins over left, if it is there."""
    both = left.join(right, on, "full")
    return both.withColumns({out: F.coalesce(r, out) for out, r in prefer_right.items()})


def first_per_kind(rows: DataFrame, key: list[str], kind: str, kinds: list[str], value: str, order: str) -> DataFrame:
    """One row per key with the first value of each kind as a column."""
    return rows.groupBy(*key).agg(*[F.min_by(F.when(F.col(kind) == k, F.col(value)), F.when(F.col(kind) == k, F.col(order))).alias(k) for k in kinds])


def divide(held: DataFrame, key: str, item: str, required: DataFrame) -> DataFrame:
    """Keys that hold every required item (relational division)."""
    need = required.select(F.col(item)).distinct()
    n = need.agg(F.count("*").alias("n_"))
    own = held.select(key, item).distinct().join(need, item, "left_semi").groupBy(key).agg(F.count("*").alias("got_"))
    return own.join(F.broadcast(n), F.col("got_") == F.col("n_")).select(key)


def group_directories(entries: DataFrame, container: list[str], ext: str, order: str, record: int, header: int) -> DataFrame:
    """Directory rows of a container that groups its index by extension: ext, files, where its list begins."""
    groups = entries.groupBy(*container, ext).agg(F.count("*").alias("files"))
    w = Window.partitionBy(*container).orderBy(ext).rowsBetween(Window.unboundedPreceding, -1)
    n = F.count("*").over(Window.partitionBy(*container))
    return groups.withColumn("list_offset", (n * header + F.coalesce(F.sum("files").over(w), F.lit(0)) * record).cast("bigint"))


def tree_paths(spark, nodes: DataFrame, sep: str = "/") -> DataFrame:
    """path and depth of each node (id, parent, name) of a tree: a recursive query from the roots.

    Each level is the join of the nodes with the level above, and is staged, until one is empty. Spark's own recursive
    query ends with an error at a million rows or 100 levels by default; here neither is bounded. As in SQL a node whose parent is
    missing, or that no root leads to, has no row, and repeated ids have a row for each way from a root. Only a circle
    with a repeated id can be met from a root: its ways do not end, so it is an error. The levels are worked out when
    this is called.
    """
    at = staging.folder(spark, "tree")
    rows = staging.stage(nodes.select("id", "parent", "name"), f"{at}/nodes")
    again = rows.filter("id IS NOT NULL").groupBy("id").count().filter("count > 1").select("id", F.lit(True).alias("again_"))
    again = staging.stage(again, f"{at}/again")
    rows = rows.withColumn("again_", F.lit(False)) if again.isEmpty() else rows.join(again, "id", "left").fillna(False, "again_")

    # seen_: the repeated ids on the way
    none, own = F.array().cast(f"array<{dict(rows.dtypes)['id']}>"), F.array("id")
    roots = rows.filter("parent IS NULL")
    level = roots.select("id", F.col("name").alias("path"), F.lit(0).alias("depth"), F.when(F.col("again_"), own).otherwise(none).alias("seen_"))
    paths = [f"{at}/level-0"]
    level = staging.stage(level, paths[0])
    while not level.isEmpty():
        above = level.select(F.col("id").alias("parent"), F.col("path").alias("above_"), F.col("seen_").alias("met_"))
        circle = F.raise_error(F.lit("tree_paths: a circle of nodes can be reached from a root, since ids are repeated"))
        seen = F.when(~F.col("again_"), F.col("met_")).when(F.array_contains("met_", F.col("id")), circle).otherwise(F.concat("met_", own))
        below = rows.join(above, "parent")
        below = below.select("id", F.concat("above_", F.lit(sep), "name").alias("path"), F.lit(len(paths)).alias("depth"), seen.alias("seen_"))
        paths.append(f"{at}/level-{len(paths)}")
        level = staging.stage(below, paths[-1])
    return spark.read.schema(level.schema).parquet(*paths).select("id", "path", "depth")


def history(events: DataFrame, container: list[str], order: list[str], action: str, state: str, limit: int = 50) -> DataFrame:
    """container, events in order with the state after each, and how many steps back and forward there are then.

    action is 'visit' (to `state`), 'undo' or 'redo'. A visit puts the state
    before it on the way back, of which the last `limit` stay, and forgets the
    way forward; undo and redo without a way leave all as it was. One session
    is a container: its events are folded in order, as each depends on all
    before it.
    """
    kind = dict(events.dtypes)[state]
    start = F.struct(
        F.array().cast(f"array<{kind}>").alias("back"), F.array().cast(f"array<{kind}>").alias("ahead"), F.lit(None).cast(kind).alias("now"),
        F.lit(False).alias("any"), F.array().cast(f"array<struct<action: string, now: {kind}, n_back: int, n_ahead: int>>").alias("out"),
    )

    def step(s: Column, e: Column) -> Column:
        none = F.array().cast(f"array<{kind}>")
        undo, redo = (e.action == "undo") & (F.size(s.back) > 0), (e.action == "redo") & (F.size(s.ahead) > 0)
        visit = e.action == "visit"
        longer = F.when(s.any, F.concat(s.back, F.array(s.now))).otherwise(s.back)
        longer = F.slice(longer, F.greatest(F.size(longer) - limit + 1, F.lit(1)), F.lit(limit))
        back = F.when(visit, longer).when(undo, F.slice(s.back, F.lit(1), F.size(s.back) - 1)).when(redo, F.concat(s.back, F.array(s.now))).otherwise(s.back)
        ahead = F.when(visit, none).when(undo, F.concat(s.ahead, F.array(s.now))).when(redo, F.slice(s.ahead, F.lit(1), F.size(s.ahead) - 1)).otherwise(s.ahead)
        now = F.when(visit, e.state).when(undo, F.element_at(s.back, -1)).when(redo, F.element_at(s.ahead, -1)).otherwise(s.now)
        row = F.struct(e.action.alias("action"), now.alias("now"), F.size(back).alias("n_back"), F.size(ahead).alias("n_ahead"))
        return F.struct(back.alias("back"), ahead.alias("ahead"), now.alias("now"), (s.any | visit).alias("any"), F.concat(s.out, F.array(row)).alias("out"))

    rows = events.select(*container, F.struct(*order, F.col(action).alias("action"), F.col(state).alias("state")).alias("e_"))
    folded = rows.groupBy(*container).agg(F.sort_array(F.collect_list("e_")).alias("e_"))
    return folded.select(*container, F.posexplode(F.aggregate("e_", start, step, lambda s: s.out)).alias("step", "r_")).select(*container, "step", "r_.*")
