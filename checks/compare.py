"""Run queries beside their SQL and compare whole results: ``python -m checks.compare [sf] [name ...]``."""

from __future__ import annotations

import sys
import time
from collections import Counter

import duckdb
from pyspark.sql import SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def session(cores: int | str = 8) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _row(values) -> tuple:
    return tuple(0.0 if isinstance(v, float) and v == 0 else v for v in values)


def difference(df, con, sql: str) -> str | None:
    """None when columns and the bag of rows agree, else what differs."""
    names = sorted(df.columns)
    got = Counter(_row(row) for row in df.select(*names).collect())
    result = con.execute(f"SELECT {', '.join(names)} FROM ({sql})")
    expected = Counter(map(_row, result.fetchall()))
    if expected == got:
        return None
    extra, missing = list((got - expected).items())[:2], list((expected - got).items())[:2]
    return f"{sum(got.values())} rows against {sum(expected.values())}; extra {extra}; missing {missing}"


def main() -> None:
    from checks.oracles import oracles
    from checks.queries import QUERIES

    sf_dir = f"/root/testdata/{sys.argv[1] if len(sys.argv) > 1 else 'sf0.01'}"
    names = sys.argv[2:] or list(QUERIES)
    spark, con, sql = session(), database(sf_dir), oracles()
    for name in names:
        started = time.time()
        try:
            df = QUERIES[name](spark, sf_dir)
            if name in sql:
                df = df.cache()
                df.count()
                spent = time.time() - started
                verdict = f"(Spark {spent:.1f}s)  {difference(df, con, sql[name]) or 'same'}"
                df.unpersist()
            else:
                verdict = f"rows {len(df.collect())}"
        except Exception as error:  # noqa: BLE001 - the report goes on with the next query
            verdict = f"FAILED {type(error).__name__}: {str(error)[:1500]}"
        print(f"{name:30s} {time.time() - started:6.1f}s  {verdict[:1800]}", flush=True)


if __name__ == "__main__":
    main()
