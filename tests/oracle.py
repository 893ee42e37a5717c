"""Compare every registered query with its SQL on DuckDB: names, row counts and values."""

from __future__ import annotations

import datetime
import math
import sys
import time
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        if math.isnan(v):
            return "NaN"
        return 0.0 if v == 0 else v
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, dict):
        return tuple((k, norm(x)) for k, x in v.items())
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return v


def rows_of_spark(df):
    names = sorted(df.columns)
    return names, [tuple(norm(r[n]) for n in names) for r in df.collect()], dict(df.dtypes)


def rows_of_duck(con, sql):
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    types = {d[0]: str(d[1]) for d in cur.description}
    order = sorted(range(len(names)), key=lambda i: names[i])
    rows = [tuple(norm(r[i]) for i in order) for r in cur.fetchall()]
    return [names[i] for i in order], rows, types


def compare(spark, con, name, build, sql, sf_dir):
    t0 = time.time()
    s_names, s_rows, s_types = rows_of_spark(build(spark, sf_dir))
    t1 = time.time()
    if sql is None:
        return True, f"{name}: rows-only {len(s_rows)} rows  spark {t1 - t0:.2f}s"
    d_names, d_rows, d_types = rows_of_duck(con, sql)
    t2 = time.time()
    took = f"spark {t1 - t0:.2f}s duck {t2 - t1:.2f}s"
    if s_names != d_names:
        return False, f"{name}: columns {s_names} != {d_names}"
    odd = [f"{n}:{s_types[n]}/{d_types[n]}" for n in s_names
           if ("DECIMAL" in d_types[n] or "HUGEINT" in d_types[n] or "decimal" in s_types[n]
               or (s_types[n] == "bigint") != (d_types[n] == "BIGINT")
               or (s_types[n] == "double") != (d_types[n] == "DOUBLE"))]
    a, b = Counter(s_rows), Counter(d_rows)
    if a != b:
        only_s, only_d = list((a - b).elements()), list((b - a).elements())
        key = lambda r: tuple(str(x) for x in r)
        return False, (f"{name}: {len(s_rows)} vs {len(d_rows)} rows, {len(only_s)}/{len(only_d)} differ {s_names}\n"
                       f"   spark {sorted(only_s, key=key)[:3]}\n   duck  {sorted(only_d, key=key)[:3]} {odd}")
    if odd:
        return False, f"{name}: types {odd}"
    return True, f"{name}: ok {len(s_rows)} rows  {took}" + ("  EMPTY" if not s_rows else "")


def session(cpus=8, partitions=8):
    from pyspark.sql import SparkSession

    return (
        SparkSession.builder.master(f"local[{cpus}]").appName("pathclear")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g").config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.extraJavaOptions", "-XX:+UseParallelGC").getOrCreate()
    )


if __name__ == "__main__":
    sys.path.insert(0, "/root/repo")
    import __spark_entry__ as entry

    sf_dir = f"/root/testdata/sf{sys.argv[1]}"
    wanted = sys.argv[2:]
    spark, con = session(), duck(sf_dir)
    spark.sparkContext.setLogLevel("ERROR")
    sql = entry.oracle_sql()
    bad = []
    for name, build in entry.queries().items():
        if wanted and not any(w in name for w in wanted):
            continue
        try:
            ok, text = compare(spark, con, name, build, sql.get(name), sf_dir)
        except Exception as e:
            ok, text = False, f"{name}: {type(e).__name__} {str(e)[:700]}"
        print(("   " if ok else "!! ") + text, flush=True)
        if not ok:
            bad.append(name)
    print("failed:", bad)
