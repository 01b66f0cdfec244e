import os

import duckdb
import pandas as pd


def compare(spark, folder, query, statement):
    con = duckdb.connect()
    for f in os.listdir(folder):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{folder}/{f}')")
    a, b = query(spark, folder).toPandas(), con.execute(statement).df()
    assert sorted(a.columns) == sorted(b.columns)
    columns = sorted(a.columns)
    assert _rows(a, columns) == _rows(b, columns)


def _rows(df, columns):
    plain = lambda v: "" if pd.isna(v) else int(v) if isinstance(v, float) and v.is_integer() else v
    return sorted((tuple(plain(v) for v in r) for r in df[columns].astype(object).itertuples(index=False)), key=repr)
