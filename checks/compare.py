"""Runs registered queries and their SQL twins side by side: python -m checks.compare SF_DIR [names...]"""

import math
import sys
import time

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _value(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if hasattr(v, "tzinfo") and v.tzinfo is not None:
        return v.replace(tzinfo=None)
    return v


def table_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(_value(r[i]) for i in order) for r in rows), key=repr)


KINDS = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP", "int": "INTEGER"}


def difference(spark_df, con, sql):
    """None if equal, else a short text."""
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    types = {d[0]: str(d[1]) for d in rel.description}
    want = table_of(names, rel.fetchall())
    got = table_of(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    if got[0] != want[0]:
        return f"columns {got[0]} / {want[0]}"
    for n, t in spark_df.dtypes:
        if types[n] not in (KINDS.get(t, t), "NULL", '"NULL"'):
            return f"type of {n}: {t} / {types[n]}"
    if len(got[1]) != len(want[1]):
        return f"rows {len(got[1])} / {len(want[1])}"
    for a, b in zip(got[1], want[1]):
        if a != b:
            return f"first difference\n   {dict(zip(got[0], a))}\n   {dict(zip(got[0], b))}"
    return None


def main(sf_dir, names):
    from pyspark.sql import SparkSession

    from checks.oracle import ORACLES
    from checks.queries import QUERIES

    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    con, bad = duck(sf_dir), 0
    for name, fn in QUERIES.items():
        if names and not any(name == n or name.startswith(n) for n in names):
            continue
        start = time.time()
        try:
            df = fn(spark, sf_dir)
            if name not in ORACLES:
                print(f"{name:34s} rows only {df.count()} {time.time() - start:.1f}s", flush=True)
                continue
            found = difference(df, con, ORACLES[name])
        except Exception as e:  # shown, not hidden
            found = f"{type(e).__name__}: {str(e)[:500]}"
        bad += found is not None
        print(f"{name:34s} {'ok' if found is None else 'DIFFERENT ' + found} {time.time() - start:.1f}s", flush=True)
    print("different:", bad)
    return bad


if __name__ == "__main__":
    sys.path.insert(0, ".")
    sys.exit(1 if main(sys.argv[1], sys.argv[2:]) else 0)
