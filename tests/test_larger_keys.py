"""Queries beside their SQL on rows that the smallest tables lack."""

import duckdb

from tests.test_queries import plain
from vellumix import catalog


def agree(spark, folder, name, table, schema, *values):
    """Rows of a query that equal its SQL's over one small table."""
    path = f"{folder}/{table}.parquet"
    spark.createDataFrame(list(values), schema).coalesce(1).write.parquet(path)
    df = catalog.queries()[name](spark, str(folder))
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    db = duckdb.connect()
    db.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{path}/*.parquet')")
    want = db.execute(f"SELECT {', '.join(columns)} FROM ({catalog.oracle_sql()[name]})").fetchall()
    assert got == sorted((tuple(map(plain, r)) for r in want), key=repr)
    return got


def test_claims_of_part_keys_over_100000(spark, tmp_path):
    lines = (1, 1, 200_000), (1, 2, 1), (1, 3, 2), (2, 1, 100_011), (2, 2, 5), (3, 1, 0), (3, 2, 300_001), (3, 2, 300_001)
    got = agree(spark, tmp_path, "claim_sequence", "lineitem", "l_orderkey long, l_linenumber int, l_partkey long", *lines)
    assert [r[0] for r in got] == [2, 3]


def test_units_of_large_part_keys(spark, tmp_path):
    lines = [(1, k, k * 1500) for k in range(1, 800)] + [(2, k, k) for k in (0, 11, 12, 1_199_999, 2_000_000_000, None)]
    got = agree(spark, tmp_path, "unit_conversions", "lineitem", "l_orderkey long, l_linenumber int, l_partkey long", *lines)
    assert len(got) == len(lines)


def test_block_ids_of_every_letter(spark, tmp_path):
    letters = [chr(c) for c in range(0x20, 0x110000) if not 0xD800 <= c < 0xE000 and (chr(c).isalpha() or c < 0x3000)]
    odd = (-1, "ßa\nSS\nẞ\nß\nﬁ x\nFI\n\nŉ"), (-2, None), (-3, "")
    got = agree(spark, tmp_path, "doc_block_ids", "documents", "doc_id long, text string, source string, lang string", *((i, x, None, None) for i, x in [*odd, *enumerate(letters)]))
    assert ("ẞ0003", -1, 3) in got and ("S0001", -1, 1) in got
