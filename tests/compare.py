"""Query results against DuckDB on the same files, as the driver compares them."""

import glob
import math
import os

import duckdb

SF = "/root/testdata/sf0.01"


def connect(sf_dir=SF):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        what = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.sql(f"CREATE VIEW {os.path.basename(path).removesuffix('.parquet')} AS SELECT * FROM '{what}'")
    return con


def normal(rows):
    def cell(x):
        if isinstance(x, float):
            return None if math.isnan(x) else round(x, 6)
        return x

    return sorted((tuple(cell(x) for x in r) for r in rows), key=repr)


def assert_same(df, sql, con):
    names = sorted(df.columns)
    rel = con.sql(sql)
    assert sorted(rel.columns) == names
    want = normal(rel.select(", ".join(f'"{n}"' for n in names)).fetchall())
    got = normal(tuple(r) for r in df.select(*names).collect())
    assert len(got) == len(want)
    assert got == want
