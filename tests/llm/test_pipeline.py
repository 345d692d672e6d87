from collections import Counter

import pyarrow as pa
import pytest

import corpus_pipeline
from riskloom.llm import common, sentencepiece_viterbi
from riskloom.llm.common import materialize
from riskloom.llm.toxicity import THRESHOLD, _document, _score, fit
from tests.llm.test_jaccard import brute as near_copies
from tests.llm.test_line_dedup import brute as line_dedup


def test_stages_one_by_one(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "line dedup", "Jaccard join", "mixing", "encoding"]
    given = docs.collect()

    kept = materialize(stages["toxicity"](spark, docs, sf))
    machine = fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    bad = set() if machine is None else {
        r.doc_id for r in given if _score_of(r.text, machine) >= THRESHOLD
    }
    assert kept.columns == columns
    assert Counter(map(tuple, kept.collect())) == Counter(tuple(r) for r in given if r.doc_id not in bad)

    lines = materialize(stages["line dedup"](spark, kept, sf))
    want = {i: text for i, _, _, text in line_dedup([(r.doc_id, r.text) for r in kept.collect()])}
    assert lines.columns == columns
    assert {r.doc_id: r.text for r in lines.collect()} == want
    assert all(r.n_chars == len(r.text) for r in lines.collect())

    once = materialize(stages["Jaccard join"](spark, lines, sf))
    stay = {i for i, _, root in near_copies([(r.doc_id, r.text) for r in lines.collect()]) if i == root}
    assert once.columns == columns and sorted(r.doc_id for r in once.collect()) == sorted(stay)

    mixed = materialize(stages["mixing"](spark, once, sf))
    assert mixed.columns == columns
    size, taken = Counter(), Counter()
    for rows, total in ((once, size), (mixed, taken)):
        for r in rows.collect():
            total[r.source] += len(r.text.split())
    assert abs(sum(taken.values()) - sum(size.values())) <= len(size)
    assert all(taken[s] <= 3 * size[s] for s in size)

    ids = stages["encoding"](spark, mixed, sf).collect()
    encoder = sentencepiece_viterbi.Encoder(sentencepiece_viterbi.PieceModel(sentencepiece_viterbi.read_model()))
    assert all(r.decoded_ok for r in ids)
    want = Counter((r.doc_id, tuple(encoder.encode(r.text))) for r in mixed.collect())
    assert Counter((r.doc_id, tuple(r.ids)) for r in ids) == want


def _score_of(text, machine):
    import numpy as np

    return float(_score(np.array([_document(text, machine.table(), machine)]), machine)[0])


def test_odd_rows(spark, sf, make):
    """Nulls, empty and repeated rows, and an empty table go through all stages."""
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "word " * 80, "en", "a", 400), (3, "word " * 80, "en", "a", 400), (None, "x y z", "en", None, 5), (4, "word " * 80, "en", "b", 400)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for given in (rows, []):
        docs = make(given, schema)
        for _, stage in corpus_pipeline.STAGES:
            docs = materialize(stage(spark, docs, sf))
        ids = {r.doc_id for r in docs.collect()}
        assert 4 not in ids and (not given or ids >= {1, 2, None})


def test_run(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 0


def test_a_task_gives_back_what_it_freed(monkeypatch):
    given = []
    monkeypatch.setattr(common, "give_back", lambda: given.append(True))
    batch = pa.RecordBatch.from_arrays([pa.array([1])], names=["a"])
    assert list(common.lean(lambda batches: (b for b in batches))(iter([batch]))) == [batch] and given == [True]
    with pytest.raises(ZeroDivisionError):
        list(common.lean(lambda batches: (1 // 0 for _ in batches))(iter([batch])))
    assert given == [True, True]
