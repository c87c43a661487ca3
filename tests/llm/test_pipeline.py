"""The pipeline's stages against the operators' own brute-force versions, on one small table."""

import os

import corpus_pipeline
from tests.conftest import DATA
from tests.llm import cases
from tests.llm.test_near_copies import brute as brute_groups
from tests.llm.test_passages import brute as brute_passages
from tests.llm.test_rules_and_chat import counted
from tests.llm.test_tokens import _check

SF_DIR = os.path.join(DATA, "sf0.001")


def resembling(docs, words=50, shingle=5, enough=41):
    """Word positions of each key in windows of which an earlier document, anywhere, has enough shingles
    for a similarity of 0.8. Nothing else may be cut."""
    held, out = [], {}
    for key, text in sorted(docs):
        w = (text or "").encode().lower().split()
        own = [tuple(w[i:i + shingle]) for i in range(len(w) - shingle + 1)]
        for other in held:
            hit = [g in other for g in own]
            for i in range(len(w) - words + 1 if sum(hit) >= enough else 0):
                if sum(hit[i:i + words - shingle + 1]) >= enough:
                    out.setdefault(key, set()).update(range(i, i + words))
        held.append(set(own))
    return out


def inside(few, many):
    """Whether `few` is a subsequence of `many`."""
    rest = iter(many)
    return all(w in rest for w in few)


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns, results = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, SF_DIR)
        made.write.parquet(str(tmp_path / name))
        results.append((docs.collect(), made := spark.read.parquet(str(tmp_path / name))))
        docs = made
    (given, ruled), (passed, classified), (scored, single), (near, cut), (whole, packed) = results
    assert all(made.columns == columns for made in (ruled, classified, single, cut))

    kept = {r.doc_id for r in passed}
    for r in given:
        n, *_, repeats = counted(r.text)
        assert r.doc_id not in kept or (n >= 50 and 100 * repeats <= 50 * n)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").collect()}
    left = {r.doc_id for r in scored}
    good = [r.doc_id in left for r in passed if labels.get(r.doc_id) == 1]
    assert sum(good) >= 0.95 * len(good) and left <= kept
    assert sorted(r.doc_id for r in near) == [i for i, low in brute_groups([(r.doc_id, r.text) for r in scored]) if i == low]
    again = brute_passages([(r.doc_id, r.text) for r in near], 50)
    near_again = resembling([(r.doc_id, r.text) for r in near])
    after = {r.doc_id: r for r in whole}
    for r in near:
        words = r.text.encode().split()
        clean = [w for i, w in enumerate(words) if i not in again.get(r.doc_id, ())]
        now = after[r.doc_id].text.encode().split() if r.doc_id in after else []
        assert inside(now, clean)  # what is repeated word for word is gone
        assert inside([w for i, w in enumerate(words) if i not in near_again.get(r.doc_id, ())], now)
        assert r.doc_id not in after or after[r.doc_id].n_chars == len(after[r.doc_id].text)
    assert not brute_passages([(r.doc_id, r.text) for r in whole], 60)
    _check(packed.collect(), [(r.doc_id, r.text) for r in whole], 2048)


def test_awkward_rows_pass_every_stage(spark, tmp_path):
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        for n, docs in enumerate((cases.clashing(spark, cases.table(spark)), cases.table(spark).limit(0))):
            made = stage(spark, docs, SF_DIR)
            made.write.parquet(str(tmp_path / f"{i}-{n}"))
            assert name == "best_fit_packing" or made.columns == docs.columns
            assert n == 0 or made.count() == 0
