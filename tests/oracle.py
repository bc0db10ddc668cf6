"""Holds queries against their SQL, as rows without order: python -m tests.oracle SF_DIR [NAME...]"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb
from pyspark.sql import DataFrame, SparkSession


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p if p.is_file() else f'{p}/*.parquet'}')")
    return con


def _value(x):
    return "nan" if isinstance(x, float) and math.isnan(x) else round(x, 9) if isinstance(x, float) else tuple(map(_value, x)) if isinstance(x, list) else x


def rows(table, columns: list[str]) -> list[tuple]:
    return sorted((tuple(_value(r[c]) for c in columns) for r in table.to_pylist()), key=repr)


def difference(df: DataFrame, con: duckdb.DuckDBPyConnection, sql: str) -> str:
    """Empty if df has the rows of sql."""
    want = con.sql(sql).to_arrow_table()
    got = df.toArrow()
    if sorted(got.column_names) != sorted(want.column_names):
        return f"columns {sorted(got.column_names)} and {sorted(want.column_names)}"
    columns = sorted(got.column_names)
    g, w = rows(got, columns), rows(want, columns)
    if g == w:
        return ""
    a, b = [x for x in g if x not in set(w)][:3], [x for x in w if x not in set(g)][:3]
    return f"{len(g)} and {len(w)} rows; only here {a}; only there {b}; {columns}"


def main(sf_dir: str, *names: str) -> int:
    import __spark_entry__ as e

    spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = connect(sf_dir), 0
    sql = e.oracle_sql()
    for name, f in e.queries().items():
        if names and name not in names:
            continue
        t = time.time()
        try:
            d = difference(f(spark, sf_dir), con, sql[name]) if name in sql else f"no SQL, {f(spark, sf_dir).count()} rows"
        except Exception as x:  # noqa: BLE001
            d = f"{type(x).__name__}: {str(x)[:1500]}"
        bad += bool(d) and not d.startswith("no SQL")
        print(f"{name}: {d or 'same'} ({time.time() - t:.1f} s)", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main(*sys.argv[1:]))
