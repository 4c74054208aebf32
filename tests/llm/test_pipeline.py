"""The pipeline's stages keep clean documents and act on the others."""

import random

import pytest

pytest.importorskip("public_tokenizers")
pytest.importorskip("corpus_pipeline")

import corpus_pipeline  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5 and "near-dedup" in names[1]
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    before = docs
    for name, stage in corpus_pipeline.STAGES[:4]:
        after = corpus_pipeline.materialise(stage(spark, before, SF), "stage")
        assert after.columns == docs.columns, name
        if name == "quality classifier":
            kept = {r["doc_id"] for r in after.select("doc_id").collect()}
            assert sum(v == 1 and k in kept for k, v in labels.items()) > 0.95 * sum(labels.values())
            assert sum(v == 0 and k in kept for k, v in labels.items()) < 0.1 * len(labels)
        if name != "source mixing":
            assert after.count() <= before.count()
        before = after
    out = corpus_pipeline.STAGES[4][1](spark, before, SF).orderBy("start").collect()
    assert len(out) == before.count()
    assert all(a["start"] + a["n_tokens"] == b["start"] and a["doc_id"] <= b["doc_id"] for a, b in zip(out, out[1:], strict=False))


def test_stages_on_awkward_rows(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows, clashing names."""
    long = " ".join(f"word{k % 900} and so on" for k in range(30_000))
    texts = [None, "", " \t", "a", long, long + " end", "one short text of seven words here", "one short text of seven words here"]
    rows = [(k, t, "en", f"s{k % 2}", 1, "x", 2, 3, "y", {"k": 1}) for k, t in enumerate(texts)]
    rows += [rows[6], (None, "no id", None, None, None, None, None, None, None, None), (None, "no id either", None, None, None, None, None, None, None, None), (3, "a second text of this id", "en", None, 1, "x", 2, 3, "y", None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, its string, DIRTY int, size long, own_id string, more map<string,int>"
    docs = spark.createDataFrame(rows, schema)
    kept = corpus_pipeline.dedup_stage(spark, docs, SF).collect()
    assert sorted((r["doc_id"], r["text"]) for r in kept if r["doc_id"] is not None) == [(0, None), (3, "a"), (4, long), (6, texts[6])]
    assert sorted(r["text"] for r in kept if r["doc_id"] is None) == ["no id", "no id either"]
    assert corpus_pipeline.decontamination_stage(spark, docs, SF).count() == len(rows)
    mixed = corpus_pipeline.mixing_stage(spark, docs, SF)
    assert mixed.columns == docs.columns and all(r["text"] and r["text"].strip() for r in mixed.collect())
    ids = corpus_pipeline.token_stage(spark, docs, SF).collect()
    assert len(ids) == len(rows) and min(r["doc_id"] for r in ids) == -(2**63)
    good = corpus_pipeline.quality_stage(spark, docs.drop("more"), SF)
    assert good.columns == docs.drop("more").columns
    none = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, SF).count() == 0, name


def test_dedup_stage_leaves_no_pair_alike(spark):
    """Every survivor's five-word Jaccard similarity to every other is below 0.8, and
    whoever went is alike to somebody."""
    rng = random.Random(5)
    rows = []
    for family in range(12):
        words = [f"w{family}x{k}" for k in range(150)]
        for _ in range(8):
            mine = list(words)
            for at in rng.sample(range(150), rng.randint(0, 5)):
                mine[at] = f"r{rng.random()}"
            rows.append((len(rows), " ".join(mine)))
    rows += [(len(rows) + k, f"lone text number {k} with some words") for k in range(5)]
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in rows}
    alike = lambda a, b: 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])
    root = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if a < b and alike(a, b) and root[a] != root[b]:
                lo, hi = sorted((root[a], root[b]))
                root = {i: lo if r == hi else r for i, r in root.items()}
    kept = corpus_pipeline.dedup_stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(root.values()))
    for crowded in (0, 3):
        got = corpus_pipeline.alike_documents(spark.createDataFrame(rows, "doc_id long, text string"), crowded_over=crowded)
        assert {r["doc_id"]: r["component_id"] for r in got.collect()} == root


def test_parities_bound_the_difference():
    import numpy as np

    from claimlab.llm import shingle_dedup

    rng = np.random.default_rng(4)
    for _ in range(300):
        pool = rng.integers(-(2**62), 2**62, 400)
        a, b = (np.unique(pool[rng.random(400) < rng.random()]) for _ in range(2))
        apart = len(np.setxor1d(a, b))
        assert shingle_dedup.least_apart(shingle_dedup.parities(a).tobytes(), shingle_dedup.parities(b).tobytes()) <= apart
        assert shingle_dedup.least_apart(shingle_dedup.parities(a).tobytes(), shingle_dedup.parities(a[::-1]).tobytes()) == 0
        both = len(np.intersect1d(a, b))
        assert shingle_dedup.alike(a, b) == (both * 5 >= 4 * len(np.union1d(a, b)))
