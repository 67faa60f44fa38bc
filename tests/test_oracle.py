"""Every query that has SQL gives the SQL's rows on the smallest tables."""

import zlib

import duckdb
import pytest

from tagcall.oracle import ORACLE
from tagcall.queries import QUERIES

TYPES = {"BIGINT": "bigint", "VARCHAR": "string", "DOUBLE": "double", "BOOLEAN": "boolean"}


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for t in ("events", "orders", "lineitem"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return con


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_rows_match(spark, data, duck, name):
    df = QUERIES[name](spark, data)
    got = df.toPandas()
    sql = duck.sql(ORACLE[name])
    want, cols = sql.df(), sorted(df.columns)
    assert cols == sorted(want.columns)
    assert {c: TYPES[str(t)] for c, t in zip(sql.columns, sql.types, strict=True)} == dict(df.dtypes)
    rows = lambda d: sorted(map(tuple, d[cols].astype(str).to_numpy().tolist()))
    assert rows(got) == rows(want)


def test_counters(spark, data):
    k = {r["counter"]: r["n"] for r in QUERIES["stats_run"](spark, data).collect()}
    want = {"blocks": 20, "valid_blocks": 20, "tags_before": 282, "leven_total": 2119, "leven_complete": 986, "alleles_after": 99, "reads_after": 846, "positions_tested": 933, "positions_with_variants": 174, "total": 682, "conclusive": 680, "ambiguous": 0, "total_ins": 50, "total_del": 50}
    assert {n: k[n] for n in want} == want
    # the fingerprint: a seed, a thousand zeros and the counters as 64-bit integers, those never kept as 0
    v = [0, 0, k["valid_blocks"], k["reads_in_file"], 0, k["reads_in_valid_blocks"], 0, 282, 99, k["reference_bases"], 933, 174, 986, 2119, 682, 680, 0, k["blocks_after"], 50, k["conclusive_ins"], k["ambiguous_ins"], 50, k["conclusive_del"], k["inconclusive_del"]]
    assert QUERIES["crc"](spark, data).first()[0] == f"0x{zlib.crc32(b''.join(n.to_bytes(8, 'little') for n in [0] * 1000 + v), 0x12345678):08x}"
