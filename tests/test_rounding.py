"""Queries with rounded vectors against their SQL to the last bit: signs of zeros, halves."""

import struct

import duckdb
import pytest
from oracle import connect
from pyspark.sql import functions as F

from shutterstack.functions.vectors import rounded
from shutterstack.plans import catalogue


def bits(value):
    return tuple(map(bits, value)) if isinstance(value, (list, tuple)) else struct.pack(">d", value) if isinstance(value, float) else value


def same_bits(spark, folder, name):
    cursor = connect(folder).execute(catalogue.SQL[name])
    df = catalogue.QUERIES[name](spark, folder).select(*(d[0] for d in cursor.description))
    expected = sorted(map(bits, cursor.fetchall()))
    assert sorted(bits(tuple(r)) for r in df.collect()) == expected
    return expected


@pytest.mark.parametrize("digits", [4, 6])
def test_rounded(spark, digits):
    values = [0.0, -0.0, 4e-8, -4e-8, 5e-7, -5e-7, 0.00005, -0.00005, 1.0000005, 2.00015, -2.00015, 0.00015, 1.5, 2e15 + 0.5, -1e300, 1e305, float("inf"), float("-inf"), float("nan")]
    values += [s * (k + 0.5) / 10**digits for k in range(2000) for s in (1, -1)]
    rows = spark.createDataFrame(list(enumerate(values)), "i int, x double").select("i", rounded(F.col("x"), digits).alias("y")).collect()
    got = {r["i"]: bits(r["y"]) for r in rows}
    con = duckdb.connect()
    assert [got[i] for i in range(len(values))] == [bits(v[0]) for v in con.execute(f"SELECT round(x, {digits}) FROM (SELECT unnest(?::DOUBLE[]) AS x)", [values]).fetchall()]
    assert spark.range(1).select(rounded(F.lit(None).cast("double"), digits)).first()[0] is None


def test_vec_normalize(spark, sample, tmp_path):
    same_bits(spark, sample, "vec_normalize")
    odd = [(i, [v, -v, 0.0, -0.0, 1.0, -4e-7]) for i, v in enumerate((5e-7, 1e-7, 0.25, 3.0, 1.0000005, 5e-7))]
    spark.createDataFrame(odd, "vec_id long, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    sql = catalogue.SQL["vec_normalize"].removeprefix(catalogue.BASE)
    expected = {r[0]: bits(r[1:]) for r in con.execute(f"SELECT id, norm_before, unit FROM ({sql})").fetchall()}
    got = {r["id"]: bits((r["norm_before"], r["unit"])) for r in catalogue.QUERIES["vec_normalize"](spark, str(tmp_path)).collect()}
    assert got == expected


def test_reembed_merge(spark, sample, tmp_path):
    same_bits(spark, sample, "reembed_merge")
    odd = "list_transform(embedding, lambda x, i: CASE i WHEN 1 THEN -4e-6::FLOAT WHEN 2 THEN '-0.0'::FLOAT WHEN 3 THEN 1 / 64 ELSE x END)"
    duckdb.connect().execute(f"COPY (SELECT * REPLACE ({odd} AS embedding) FROM '{sample}/media.parquet') TO '{tmp_path}/media.parquet'")
    vectors = [r[2][:3] for r in same_bits(spark, str(tmp_path), "reembed_merge") if r[2]]
    assert vectors and set(vectors) == {bits((-0.0, 0.0, 0.0313))}
