"""The five stages, each against a plain version of it on the stage's own input."""

import os
from collections import Counter

import numpy as np
import pytest
from helpers import Union

import corpus_pipeline as P
from regframe.llm.minhash import Sampler, common_words, weighted_jaccard
from regframe.llm.mixing import mix
from regframe.llm.tokens import Codec, vocabulary
from regframe.llm.toxicity import features, fit_lexicon, fold

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="test tables not present")


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    planted = spark.createDataFrame(
        [(100_000, None, "en", "src0", None), (100_001, "", "en", None, 0), (100_002, "one two three", "en", "src0", 13),
         (100_003, "one two three", "en", "src1", 13), (100_004, "word " * 30_000, "en", "src1", 150_000)], docs.schema)
    frames = [docs.unionByName(planted)]
    for k, (_, stage) in enumerate(P.STAGES):
        stage(spark, frames[-1], SF).write.parquet(f"{root}/{k}")
        frames.append(spark.read.parquet(f"{root}/{k}"))
    return frames


def test_stages_are_named_and_keep_the_columns(stages):
    assert [n for n, _ in P.STAGES] == ["toxicity", "line dedup", "MinHash near-dedup",
                                        "mixing sources to target weights", "packing"]
    assert all(f.columns == stages[0].columns for f in stages[:5]) and P.ORACLE_SQL is None


def test_toxic_documents_go_and_clean_ones_stay(spark, stages):
    lexicon = fit_lexicon(stages[0], spark.read.parquet(f"{SF}/labels.parquet"))
    auto, (a, b, c) = lexicon.automaton(), lexicon.curve
    clean = set()
    for r in stages[0].collect():
        x, y = features(fold(r.text or ""), lexicon, auto) if r.text else (0.0, 0.0)
        if 1 / (1 + np.exp(-(a + b * x + c * y))) < 0.3:
            clean.add(r.doc_id)
    assert {r.doc_id for r in stages[1].collect()} == clean
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    lost = [i for i in {r.doc_id for r in stages[0].collect()} - clean if i in labels]
    assert sum(labels[i] == 1 for i in lost) >= 0.9 * len(lost)


def test_line_dedup_keeps_documents_and_first_copies(stages):
    before = {r.doc_id: r.text for r in stages[1].collect()}
    after = {r.doc_id: r for r in stages[2].collect()}
    assert before.keys() == after.keys()
    long_lines = Counter(line for t in before.values() for line in (t or "").split("\n") if len(line.split()) >= 20)
    left = Counter(line for r in after.values() for line in (r.text or "").split("\n") if len(line.split()) >= 20)
    assert set(left) == set(long_lines) and max(left.values(), default=0) <= 1
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in after.values())
    for i, t in before.items():
        if not any(long_lines[line] > 1 for line in (t or "").split("\n")) and after[i].text != t:
            assert len(t.split()) - len(after[i].text.split()) >= 20


def test_one_of_each_near_duplicate_class_stays(spark, stages):
    rows = stages[2].collect()
    sampler = Sampler(*common_words(stages[2].filter("text is not null").select("text")))
    sets = [None if r.text is None else sampler.shingles(r.text) for r in rows]
    u = Union(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] is not None and sets[j] is not None and (
                    rows[i].text == rows[j].text or weighted_jaccard(sets[i], sets[j]) >= 0.8):
                u.join(i, j)
    first = {}
    for i, r in enumerate(rows):
        first[u.top(i)] = min(first.get(u.top(i), r.doc_id), r.doc_id)
    assert sorted(r.doc_id for r in stages[3].collect()) == sorted(first.values())


def test_mix_takes_the_copies(stages):
    want = {r.doc_id: r.copies for r in mix(stages[3]).collect() if r.copies}
    assert Counter(r.doc_id for r in stages[4].collect()) == want


def test_packing_holds_every_id_once(stages):
    own = Codec(vocabulary("word_bpe_49k.json"))
    want = sum(len(own.library(r.text or "")) // 4 + 1 for r in stages[4].collect())
    pieces = stages[5].collect()
    assert sum(p.length for p in pieces) == want
    ends = Counter()
    for p in pieces:
        ends[p.sequence_id] += p.length
    assert max(ends.values()) <= 2048


def test_stages_of_odd_and_empty_tables_with_clashing_names(spark, odd_docs, no_docs):
    """Missing and empty values, ties, repeated rows, names that the operators use themselves."""
    for name, stage in P.STAGES[:-1]:
        assert stage(spark, no_docs, SF).columns == no_docs.columns
        assert stage(spark, no_docs, SF).count() == 0, name
        got = stage(spark, odd_docs, SF)
        assert got.schema == odd_docs.schema, name
        rows, given = Counter(r.doc_id for r in got.collect()), Counter(r.doc_id for r in odd_docs.collect())
        if name in ("toxicity", "line dedup"):
            assert rows == given, name
        assert set(rows) <= set(given), name
    assert P.STAGES[-1][1](spark, no_docs, SF).count() == 0
    packed = P.STAGES[-1][1](spark, odd_docs, SF).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in odd_docs.collect()}


def test_the_whole_pipeline_of_an_empty_table(spark, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0
