"""Compare registered queries with their oracle SQL: ``python check.py [folder] [key ...]``."""

from __future__ import annotations

import os
import sys
import time

import duckdb

from sightline.plans import all_queries
from sightline.session import local_session

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def normal(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(row[i] for i in order) for row in rows), key=lambda t: tuple((v is None, str(v)) for v in t))


def compare(spark, con, folder, key, query, sql):
    df = query(spark, folder)
    got = [tuple(row) for row in df.collect()]
    if sql is None:
        return bool(got) , f"rows only: {len(got)}"
    rel = con.sql(sql)
    want = rel.fetchall()
    if sorted(df.columns) != sorted(rel.columns):
        return False, f"columns {sorted(df.columns)} != {sorted(rel.columns)}"
    a, b = normal(got, df.columns), normal(want, rel.columns)
    if a == b:
        types = dict(zip(rel.columns, map(str, rel.types)))
        return True, f"{len(a)} rows " + ("" if all(
            same_type(f.dataType.simpleString(), types[f.name]) for f in df.schema.fields
        ) else "TYPES " + str([(f.name, f.dataType.simpleString(), types[f.name]) for f in df.schema.fields]))
    diff = [(x, y) for x, y in zip(a, b) if x != y]
    return False, f"rows {len(a)} vs {len(b)}; {len(diff)} differ; columns {sorted(df.columns)}; first {diff[:3]}"


def same_type(spark_type, duck_type):
    return {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "date": "DATE",
            "boolean": "BOOLEAN"}.get(spark_type) == duck_type


def main(argv):
    folder = argv[0] if argv else "/root/testdata/sf0.01"
    keys = argv[1:]
    queries, oracles = all_queries()
    spark = local_session(partitions=int(os.environ.get("CHECK_PARTITIONS", "8")))
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    failed = 0
    for key in keys or queries:
        start = time.time()
        try:
            ok, note = compare(spark, con, folder, key, queries[key], oracles.get(key))
        except Exception as e:  # report and go on with the next key
            ok, note = False, f"{type(e).__name__}: {str(e)[:1500]}"
        failed += not ok
        if not ok or "TYPES" in note or keys or time.time() - start > 4:
            print("ok  " if ok else "FAIL", key, f"{time.time() - start:.1f}s", note, flush=True)
    print(f"{len(keys or queries)} run, {failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
