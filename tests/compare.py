"""Run registered queries on Spark and their oracle SQL on DuckDB, and compare rows and types."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
WITHOUT_SQL = {
    "op2_lexical_packing", "op3_run_length_index_dedup", "op4_rans_tokens", "op5_disclosure_sanitising", "op7_toxicity", "op8_language_spans",
    "op9_quotation_linking", "op10_posting_list_search", "op12_jump_sharding", "pipeline",
}
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def canon(value):
    if value is None:
        return "<null>"
    if isinstance(value, float) and math.isnan(value):
        return "<nan>"
    if isinstance(value, float):
        return repr(value + 0.0)
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(canon(r[i]) for i in order) for r in rows)


def check(spark, con, sf_dir, name, run, sql):
    df = run(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:  # only what SQL cannot express may go without, and has tests of its own
        return len(got), [] if name in WITHOUT_SQL else ["no SQL"]
    problems = []
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    want = rows_of(columns, result.fetchall())
    if sorted(columns) != sorted(df.columns):
        problems.append(f"columns {sorted(df.columns)} vs {sorted(columns)}")
    duck_types = dict((d[0], str(d[1])) for d in con.execute(f"DESCRIBE {sql}").fetchall())
    for n, t in df.dtypes:
        if TYPES.get(t, t) != duck_types.get(n):
            problems.append(f"type of {n}: {t} vs {duck_types.get(n)}")
    if got != want:
        extra = [r for r in got[:] if r not in set(want)][:3]
        lost = [r for r in want if r not in set(got)][:3]
        problems.append(f"rows {len(got)} vs {len(want)}; only spark {extra}; only oracle {lost}")
    return len(got), problems


def main(sf_dir: str, names: list[str]) -> int:
    import __spark_entry__ as entry
    from wayline.session import local_session

    spark = local_session("compare", 8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    sqls, bad = entry.oracle_sql(), 0
    for name, run in entry.queries().items():
        if names and not any(name == n or (n.endswith("*") and name.startswith(n[:-1])) for n in names):
            continue
        start = time.time()
        try:
            n, problems = check(spark, con, sf_dir, name, run, sqls.get(name))
        except Exception as error:  # noqa: BLE001
            n, problems = -1, [f"{type(error).__name__}: {str(error)[:1500]}"]
        bad += bool(problems)
        print(f"{'BAD ' if problems else 'ok  '} {name:28s} rows={n:<7d} {time.time() - start:5.1f}s {'' if name in sqls else '(rows only)'}", flush=True)
        for p in problems:
            print("      ", p[:1800], flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.path.insert(0, "/root/repo")
    sys.exit(main(sys.argv[1], sys.argv[2:]))
