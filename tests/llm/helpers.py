"""Comparison of a registered query with its DuckDB SQL."""

import duckdb


def tables(sf_dir):
    con = duckdb.connect()
    for t in "documents pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def rows_of(df):
    order = sorted(df.columns)
    return sorted(repr(tuple(r[c] for c in order)) for r in df.collect())


def oracle_rows(con, sql):
    r = con.execute(sql)
    names = [d[0] for d in r.description]
    at = [names.index(c) for c in sorted(names)]
    return sorted(repr(tuple(x[i] for i in at)) for x in r.fetchall())
