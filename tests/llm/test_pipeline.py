"""Every stage of the corpus pipeline on its own input, against brute force or SQL."""

import hashlib
import os
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tenderloom.llm import queries, tokens

from .test_jaccard import brute as near_brute
from .test_repeats import brute as repeat_brute

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not on this machine")


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Input and output rows of each stage, on documents with repeats of their own added."""
    folder = tmp_path_factory.mktemp("pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first = {r.doc_id: r for r in docs.collect()}
    a, b = sorted(first)[3], sorted(first)[5]
    extra = [tuple(first[a]), (9001, first[a].text, None, "src1", 5), (9002, None, "en", None, None), (9003, first[b].text[:900] + " tail of its own", "en", "src2", 3)]
    rows = docs.union(spark.createDataFrame(extra, docs.schema))
    out = [rows]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, out[-1], SF).write.parquet(f"{folder}/{k}")
        out.append(spark.read.parquet(f"{folder}/{k}"))
    return [x.collect() for x in out], [x.columns for x in out]


def test_columns_stay(stages):
    _, columns = stages
    assert all(x == columns[0] for x in columns[:5])


def duck(spark_rows, columns):
    import pandas as pd

    con = duckdb.connect()
    con.register("documents_table", pd.DataFrame([tuple(r) for r in spark_rows], columns=columns).convert_dtypes())
    con.sql("CREATE VIEW documents AS SELECT * FROM documents_table")
    con.sql(f"CREATE VIEW labels AS SELECT * FROM '{SF}/labels.parquet'")
    return con


def test_quality_stage(stages):
    rows, columns = stages
    kept = Counter(r[0] for r in duck(rows[0], columns[0]).sql(queries.SQL["op3_quality_rules"]).fetchall() if r[-1])
    got = Counter(r.doc_id for r in rows[1])
    assert set(got) == set(kept) and all(r in rows[0] for r in rows[1])


def test_near_duplicate_stage(stages):
    rows, _ = stages
    classes = {d: k for d, k, _ in near_brute([(r.doc_id, r.text) for r in rows[1]])}
    assert sorted(r.doc_id for r in rows[2]) == sorted({k for k in classes.values()})
    assert all(r in rows[1] for r in rows[2])


def test_repeated_passage_stage(stages):
    rows, _ = stages
    want = {d: (removed, sha) for d, _, removed, _, sha in repeat_brute([(r.doc_id, r.text) for r in rows[2]], 400)}
    assert len(rows[3]) == len(rows[2])
    before = {r.doc_id: r for r in rows[2]}
    for r in rows[3]:
        removed, sha = want[r.doc_id]
        assert (r.lang, r.source) == (before[r.doc_id].lang, before[r.doc_id].source)
        if not removed:
            assert r.text == before[r.doc_id].text and hashlib.sha256((r.text or "").encode()).hexdigest() == sha
        else:
            assert len(r.text) < len(before[r.doc_id].text)
        assert r.text is None or r.n_chars == len(r.text)


def test_mix_stage(stages):
    rows, columns = stages
    taken = {r[0]: r[1:] for r in duck(rows[3], columns[3]).sql(f"SELECT doc_id, size, taken, target FROM ({queries.SQL['op9_source_mix']})").fetchall()}
    got = Counter(r.doc_id for r in rows[4])
    for d, (size, n, target) in taken.items():
        assert got[d] == (int(n / size + 0.5) if size else int(target > 0)), d


def test_packing_stage(stages):
    rows, _ = stages
    plain = Tokenizer.from_file(tokens.vocabulary())
    want = Counter()
    for r in rows[4]:
        want[r.doc_id, tuple([*plain.encode(r.text or "", add_special_tokens=False).ids, 1])] += 1
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows[5]:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert sum(r.length for r in rows[5]) == sum(len(ids) * n for (_, ids), n in want.items())
    for (d, ids), n in want.items():
        total = Counter()
        for r in pieces[d]:
            if r.doc_tokens == len(ids):
                assert tuple(np.frombuffer(r.ids, "<u4")) == ids[r.start: r.start + r.length]
                total.update(range(r.start, r.start + r.length))
        assert set(total.values()) == {n} and len(total) == len(ids)
    for s in sequences.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048


def test_run_applies_the_stages(spark, stages):
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == stages[1][5] and got.agg({"length": "sum"}).first()[0] > 0
