"""Every registered query against its SQL on the smallest tables: rows, values and kinds of columns."""

import decimal

import duckdb
import pytest

from holdfast.plans import registry
from tests.conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        return float(v)
    return bytes(v).hex() if isinstance(v, (bytes, bytearray)) else v


def rows_of(rows, order):
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


KIND = {"BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "BOOLEAN": "boolean", "DOUBLE": "double"}


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_equals_its_sql(spark, db, name):
    df = registry.queries()[name](spark, SF)
    got = [tuple(r) for r in df.collect()]
    cur = db.execute(registry.oracle_sql()[name])
    cols, kinds = [d[0] for d in cur.description], [str(d[1]) for d in cur.description]
    want = cur.fetchall()
    assert sorted(df.columns) == sorted(cols)
    order = sorted(cols)
    assert rows_of(got, [df.columns.index(c) for c in order]) == rows_of(want, [cols.index(c) for c in order])
    types = dict(df.dtypes)
    assert {c: types[c] for c in cols} == {c: KIND.get(k, k) for c, k in zip(cols, kinds)}


def test_checksums(spark):
    import zlib

    from holdfast.functions import codecs

    docs = {r["doc_id"]: r["text"].encode() for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    for r in registry.queries()["checksums"](spark, SF).collect():
        b = docs[r["doc_id"]]
        assert (r["crc32"], r["adler32"], r["crc16"], r["crc64"]) == (zlib.crc32(b), zlib.adler32(b), codecs.crc16(b), f"{codecs.crc64(b):016x}")


def test_driver_contract(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(registry.queries()) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    assert {k for k in entry.queries() if k in ("pipeline",) or k.startswith("op")} == set() or "pipeline" in entry.queries()


def test_entry_without_the_optional_parts(tmp_path):
    """__spark_entry__ still imports where the optional subpackage and its pipeline are gone."""
    import shutil
    import subprocess
    import sys

    from tests.conftest import ROOT

    shutil.copytree(f"{ROOT}/holdfast", tmp_path / "holdfast", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not [k for k in q if k.startswith('op')] and 'pipeline' not in q; print(len(q))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
