"""The inverted file: what it finds of the exact neighbours, and that searches of the catalog use it while it is fresh."""

import os

from shutterstack.app import Catalog
from shutterstack.encoders import HashingEncoder
from shutterstack.operators.knn import fit_centroids, ivf_assign, ivf_join, knn, probes_for
from shutterstack.plans import domain
from shutterstack.session import read_table


def test_probes_grow():
    assert [probes_for(n) for n in (1, 100, 1000, 4096)] == [32, 32, 125, 512]


def test_recall_of_stated_queries(spark):
    """Every hundredth of the vectors against all of them."""
    folder = "/root/testdata/sf0.1"
    if not os.path.isdir(folder):
        return
    rows = read_table(spark, folder, "embeddings").selectExpr("cast(vec_id as string) as id", "embedding")
    asked = rows.where("cast(id as long) % 100 = 0")
    centres = fit_centroids(rows)
    found = {(r["q"], r["n"]) for r in ivf_join(asked, ivf_assign(rows, centres), centres, 20).collect()}
    exact = {(r["q"], r["n"]) for r in knn(asked, rows, 20).collect()}
    assert len(found & exact) >= 0.9 * len(exact)


def test_recall_on_media(spark, sample):
    rows = domain.vectors(spark, sample).select("id", "embedding")
    asked = rows.orderBy("id").limit(40)
    centres = fit_centroids(rows)
    found, exact = ({(r["q"], r["n"]) for r in df.collect()} for df in (ivf_join(asked, ivf_assign(rows, centres), centres, 20), knn(asked, rows, 20)))
    assert len(found & exact) >= 0.9 * len(exact)


def test_no_vectors(spark):
    rows = spark.createDataFrame([], "id string, embedding array<float>")
    centres = fit_centroids(rows)
    assert ivf_join(rows, ivf_assign(rows, centres), centres, 3).count() == 0


def test_catalog_searches_its_index(spark, tmp_path):
    (tmp_path / "files").mkdir()
    for i in range(30):
        (tmp_path / "files" / f"{i}.gif").write_bytes(b"GIF89a" + bytes([i + 1, 0, 9, 0]) + bytes(range(i, i + 200)))
    catalog = Catalog(spark, str(tmp_path / "catalog"), HashingEncoder(16), clock=lambda: "2024-01-01T00:00:00Z")
    assert catalog.build_index() == 0
    catalog.scan(str(tmp_path / "files"))
    catalog.ingest(("embed",))
    exact = [r["id"] for r in catalog.search("some words type:image", 10).collect()]
    assert catalog.build_index() == 5
    plan = catalog.search("some words type:image", 10)
    assert [r["id"] for r in plan.collect()] == exact and len(exact) == 10
    assert all("/index/" in f for f in plan.inputFiles())
    (tmp_path / "files" / "new.gif").write_bytes(b"GIF89a" + bytes([77, 0, 9, 0]))
    catalog.scan(str(tmp_path / "files"))
    catalog.ingest(("embed",))
    assert catalog.search("some words", 40).count() == 31
