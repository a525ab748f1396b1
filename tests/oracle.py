"""Holding a Spark result against DuckDB's, whatever the order of rows and columns."""
import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(value):
    if value is None or value != value:
        return "NULL"
    if isinstance(value, (str, bool)):
        return str(value)
    return f"{float(value):.6f}" if hasattr(value, "__float__") else str(value)


def rows(df):
    cols = sorted(df.columns)
    return cols, sorted(tuple(plain(v) for v in r) for r in df[cols].astype(object).itertuples(index=False))


def same(spark_df, con, sql):
    a, b = rows(spark_df.toPandas()), rows(con.execute(sql).df())
    assert a[0] == b[0]
    assert a[1] == b[1]
