"""The folder's queries against their SQL twins, and the pipeline, on the smallest tables."""

import pytest

import check_oracle
import corpus_pipeline
from threadloom.llm.oracle import ORACLE
from threadloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(ORACLE))
def test_twin(spark, name):
    assert check_oracle.compare(spark, SF, name).startswith("equal")


def test_names():
    assert [n.split("_")[0] for n in QUERIES] == [f"op{i}" for i in range(1, 14)]
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality_rules", "ngram_jaccard", "decontamination", "secret_scan", "source_mixing"]


def test_pipeline_against_brute_force(spark):
    """Every stage's result against what plain Python makes of its own input."""
    from tests.llm.brute import word_hits, linked_groups, folded, fold_items

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = fold_items(spark.read.parquet(f"{SF}/benchmark.parquet").collect())
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r for r in docs.collect()}
        docs = stage(spark, docs, SF)
        rows = docs.collect()
        after = {r["doc_id"]: r for r in rows}
        assert len(rows) == len(after)
        if name == "source_mixing":
            assert set(names) < set(docs.columns) and all(r["taken"] > 0 for r in rows)
            totals = {}
            for r in rows:
                totals.setdefault((r["source"], r["target"]), []).append(r["taken"])
            # documents of which nothing is taken are not in the mix, but count in the target
            assert all(abs(sum(v) - t) <= 1 for (_, t), v in totals.items())
            continue
        assert docs.columns == names
        if name == "quality_rules":
            for i, r in before.items():
                words = (r["text"] or "").split()
                if len(words) < 10:
                    assert i not in after
        if name == "ngram_jaccard":
            groups = linked_groups({i: r["text"] for i, r in before.items()})
            assert set(after) == {min(g) for g in groups}
        if name == "decontamination":
            for i, r in before.items():
                words = folded(r["text"])
                hit, _ = word_hits(words, items)
                assert (i in after) == (not hit or len(hit) <= 0.5 * len(words))
                if i in after and not hit:
                    assert after[i]["text"] == r["text"] and after[i]["n_chars"] == r["n_chars"]
                if i in after and hit:
                    assert len(folded(after[i]["text"])) == len(words) - len(hit)
                    assert after[i]["n_chars"] == len(after[i]["text"])
        if name == "secret_scan":
            from tests.llm.brute import base_spans
            for i, r in before.items():
                assert not base_spans(after[i]["text"])
                assert (after[i]["text"] == r["text"]) == (not base_spans(r["text"]))
        docs = spark.createDataFrame(rows, docs.schema)
