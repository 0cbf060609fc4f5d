"""Queries beside their SQL on tables whose keys are as large as those of long histories."""

import os

import duckdb

import __spark_entry__ as entry
from compare import check, duck

SF = "/root/testdata/sf0.001"


def shifted(folder, **keys):
    """The tables at ``folder``, each named one with a copy whose keys are larger by the given numbers."""
    for name in os.listdir(SF):
        table = name.removesuffix(".parquet")
        if table in keys:
            moved = ", ".join(f"{k} + {n} AS {k}" for k, n in keys[table].items())
            copy = f"SELECT * FROM '{SF}/{name}' UNION ALL SELECT * REPLACE ({moved}) FROM '{SF}/{name}'"
            duckdb.execute(f"COPY ({copy}) TO '{folder}/{name}' (FORMAT parquet)")
        else:
            os.symlink(f"{SF}/{name}", f"{folder}/{name}")
    return str(folder)


def problems(spark, folder, name):
    return check(spark, duck(folder), folder, name, entry.queries()[name], entry.oracle_sql()[name])[1]


def test_callsigns_of_large_keys_stay_apart(spark, tmp_path):
    folder = shifted(tmp_path, supplier={"s_suppkey": 10_000}, events={"event_id": 1_000_000, "user_id": 10_000})
    assert not problems(spark, folder, "flight_itineraries")


def test_altitudes_of_seven_digits(spark, tmp_path):
    folder = shifted(tmp_path, events={"event_id": 1_234_567_000, "user_id": 10_000})
    assert not problems(spark, folder, "aircraft")


def test_road_cache_audit_of_roads_with_the_same_ends(spark, tmp_path):
    folder = shifted(tmp_path, embeddings={"vec_id": 10_000})
    assert not problems(spark, folder, "road_cache_audit")


def test_road_cache_audit_has_no_error_that_its_sql_does_not_know(spark, tmp_path):
    folder = shifted(tmp_path)
    os.unlink(f"{folder}/embeddings.parquet")
    again = "list_concat(embedding[1:4], embedding[3:4], embedding[7:])::FLOAT[] AS embedding"  # the third point is the second
    repeated = f"SELECT * REPLACE ({again}) FROM '{SF}/embeddings.parquet' WHERE vec_id < 200"
    short = f"SELECT 1000 + 12 * vec_id + n, embedding[:n], label FROM '{SF}/embeddings.parquet', range(12) r(n) WHERE vec_id < 10"
    none = f"SELECT 5040, NULL, 1 UNION ALL SELECT NULL, embedding, label FROM '{SF}/embeddings.parquet' WHERE vec_id = 200"
    duckdb.execute(f"COPY ({repeated} UNION ALL {short} UNION ALL {none}) TO '{folder}/embeddings.parquet' (FORMAT parquet)")
    assert not problems(spark, folder, "road_cache_audit")
