"""Recall on notices that no phrase was written for, and what stays when residue is excluded."""

import pytest
from held_out_notices import FRESH, NOTICES, TEXTS
from pyspark.sql import functions as F

from shutterstack.llm.residue import Detector, residue_documents, without_residue
from shutterstack.session import read_table


@pytest.fixture(scope="module")
def detector():
    return Detector()


def test_recall_on_held_out_notices(detector):
    assert len(NOTICES) >= 100 and sum(map(detector.text_cell, NOTICES)) >= 0.8 * len(NOTICES)


def test_recall_on_fresh_notices(detector):
    """About half: what the lists of phrases are worth for notices that nobody had in mind."""
    assert sum(map(detector.text_cell, FRESH)) >= 0.4 * len(FRESH)


@pytest.mark.parametrize("text", TEXTS, ids=lambda t: t[:30])
def test_text_about_the_same_things(detector, text):
    assert not detector.text_cell(text)


def test_single_common_words_are_no_notice(detector):
    for text in ("Es gibt hier keine Fehler mehr.", "What is the error of the second model?", "If the page is not found, the crawler tries the archive.", "See below.", "You may need to restart the kernel after this."):
        assert not detector.text_cell(text)


def test_excluded(spark, sample):
    documents = read_table(spark, sample, "documents")
    found = {r[0] for r in residue_documents(documents).collect()}
    kept = without_residue(documents)
    assert kept.columns == documents.columns
    ids = [r[0] for r in kept.select("doc_id").collect()]
    assert found and sorted(ids) == sorted(r[0] for r in documents.select("doc_id").collect() if r[0] not in found)


def test_rows_without_id_and_repeated_rows_stay(spark):
    cell = "array<struct<kind string, execution_count int, first_char int, n_chars int>>"
    rows = [(None, "Page not found", None, 1), (1, "Page not found", None, 1), (1, "Page not found", None, 2), (2, "The kiln was fired twice.", None, 1), (2, "The kiln was fired twice.", None, 1), (3, None, None, 1)]
    kept = without_residue(spark.createDataFrame(rows, f"doc_id long, text string, cells {cell}, threshold int"))
    assert sorted((r[0] is None, r[0]) for r in kept.select("doc_id").collect()) == [(False, 2), (False, 2), (False, 3), (True, None)]
    assert without_residue(kept.where(F.lit(False))).count() == 0
