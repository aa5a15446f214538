"""Sorted files on machines that do not see them, and names of the caller's columns."""

import dataclasses
import os
import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F

from tenderloom.llm import common, jaccard, mixing, ngram, repeats


@pytest.fixture(scope="module")
def folder(spark):
    return common.sorted_files(spark.range(1000).select("id", (F.col("id") * 2).alias("v")), "id", ["v"], "test-sorted")


def test_sorted_finds_what_was_written(folder):
    which, found = common.Sorted(folder, ["v"], "id").find(np.array([5, 2000, 999]))
    assert which.tolist() == [0, 2] and found["v"].tolist() == [10, 1998]


def test_an_empty_table_is_a_folder_too(spark):
    nothing = common.sorted_files(spark.range(0).select("id", "id"), "id", [], "test-none")
    assert common.Sorted(nothing, [], "id").find(np.array([1]))[0].tolist() == []


def copied(folder, tmp_path):
    there = tmp_path / "copy"
    shutil.copytree(common.local_folder(folder), there)
    return there


def test_a_folder_that_is_not_there_raises(tmp_path):
    with pytest.raises(FileNotFoundError, match="no manifest"):
        common.Sorted(str(tmp_path / "nowhere"), ["v"], "id")


def test_a_lost_or_short_file_raises(folder, tmp_path):
    there = copied(folder, tmp_path)
    name = next(x for x in sorted(os.listdir(there)) if x.endswith(".v.npy"))
    np.save(there / name, np.load(there / name)[:-1])
    with pytest.raises(ValueError, match="were written"):
        common.Sorted(str(there), ["v"], "id")
    os.remove(there / name)
    with pytest.raises(FileNotFoundError):
        common.Sorted(str(there), ["v"], "id")


def test_a_model_whose_files_are_gone_raises(spark, tmp_path):
    docs = spark.createDataFrame([(1, False, "a b c a b d")], "doc_id long, held_out boolean, text string")
    model = ngram.fit(docs, 3)
    assert ngram.score(docs, model).count() == 1
    with pytest.raises(Exception, match="no manifest"):
        ngram.score(docs, dataclasses.replace(model, grams=str(tmp_path / "gone"))).collect()


def test_few_open_parts_score_alike(spark, monkeypatch):
    monkeypatch.setattr(ngram, "PART_TOKENS", 20)
    docs = spark.createDataFrame([(i, i % 5 == 0, " ".join(f"w{(i * 7 + j * j) % 31}" for j in range(40))) for i in range(40)], "doc_id long, held_out boolean, text string")
    model = ngram.fit(docs.where("not held_out"), 3)
    known = common.Sorted.of(model.words, ["n"], "h")
    files = ngram._Files(model, known)
    assert len(files.there) > 60
    many = {r["doc_id"]: r["score"] for r in ngram.score(docs, model).collect()}
    files.OPEN = 2
    rng = np.random.default_rng(0)
    cols = rng.integers(0, model.types, (2, 500)).astype(np.uint32)
    whole = ngram._Files(model, known)
    assert np.array_equal(files.counts(cols), whole.counts(cols)) and len(files.files) <= 2
    assert len(many) == 40


NAMES = ["_times", "_o", "_k", "_n", "_null", "_row", "_order", "_node", "_rows", "given", "empty", "target", "size", "weight", "before", "kept", "key", "n_removed", "node", "sig", "first_id"]


@pytest.mark.parametrize("stage", [mixing.repeated, repeats.without_repeats, jaccard.one_of_each])
@pytest.mark.parametrize("rows", [0, 3])
def test_names_of_other_columns_do_not_matter(spark, stage, rows):
    kind = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in NAMES)
    words = ["one two three four five six", "seven eight nine ten eleven twelve", "alpha beta gamma delta epsilon zeta"]
    docs = spark.createDataFrame([(i, words[i], "en", "s", 1, *NAMES) for i in range(rows)], kind)
    out = stage(docs)
    assert out.columns == docs.columns
    got = {tuple(r)[5:] for r in out.collect()}
    assert got == ({tuple(NAMES)} if rows else set())
    assert {r["doc_id"] for r in out.collect()} == set(range(rows))
