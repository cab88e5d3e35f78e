"""Paths of trees against a plain walk: their size, depth, and odd nodes."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from holdfast.operators import layout
from holdfast.plans.more_queries import parent_pointers

NODE = "id long, parent long, name string"


def walk(nodes, sep="/"):
    out, level, depth = [], [(i, n) for i, p, n in nodes if p is None], 0
    while level:
        out += [(i, path, depth) for i, path in level]
        level = [(i, None if path is None or n is None else path + sep + n) for up, path in level for i, p, n in nodes if p is not None and p == up]
        depth += 1
    return sorted(out, key=repr)


def paths_of(spark, nodes, **options):
    return sorted((tuple(r) for r in layout.tree_paths(spark, spark.createDataFrame(nodes, NODE), **options).collect()), key=repr)


def thirds(k):
    return (thirds(k // 3) if k > 3 else []) + [k]


def test_parent_pointers_of_more_than_a_million_rows(spark, tmp_path):
    """Spark's recursive query ends with an error at 1,000,000 rows."""
    n = 1_000_100
    spark.range(n).select(F.col("id").alias("p_partkey")).write.parquet(f"{tmp_path}/part.parquet")
    got = parent_pointers(spark, str(tmp_path))
    steps = F.split("path", "/")
    good = (F.element_at(steps, -1) == F.col("id").cast("string")) & (F.size(steps) == F.col("depth") + 1)
    r = got.agg(F.count("*"), F.countDistinct("id"), F.max("depth"), F.count_if(good)).first()
    assert tuple(r) == (n, n, len(thirds(n - 1)) - 1, n)
    assert {x["id"]: x["path"] for x in got.filter("id % 99991 = 8").collect()} == {k: "/".join(map(str, thirds(k))) for k in range(8, n, 99991)}


def test_tree_deeper_than_the_limit_of_recursive_queries(spark):
    nodes = [(i, i - 1 if i else None, f"n{i % 7}") for i in range(9)]
    limit = "spark.sql.cteRecursionLevelLimit"
    spark.conf.set(limit, "5")  # 100 where it is not set
    try:
        assert paths_of(spark, nodes) == walk(nodes)
    finally:
        spark.conf.unset(limit)


def test_odd_nodes(spark):
    nodes = [
        (1, None, "root"), (2, 1, "a"), (3, 2, None), (4, 3, "below a null name"), (None, 2, "no id"), (5, None, ""), (6, 5, "x"),
        (7, 99, "no parent"), (8, 9, "circle"), (9, 8, "circle"), (10, 9, "hangs on it"), (11, 11, "its own parent"),
        (12, 1, "twice"), (12, 5, "twice"), (13, 12, "once a way"), (14, 13, "deeper"), (12, 14, "loose"),
    ]
    assert paths_of(spark, nodes[:-1], sep="'") == walk(nodes[:-1], "'")
    assert paths_of(spark, [(7, 99, "no root")]) == [] == paths_of(spark, [])
    with pytest.raises(PySparkException, match="a circle of nodes"):
        paths_of(spark, nodes)
