"""The pipeline over a small table, each stage on what the one before kept."""

from __future__ import annotations

import random

from test_llm import SCHEMA

import corpus_pipeline
from chronotally.llm import near_copies


def test_stages(spark, tmp_path):
    rng = random.Random(1)
    made = lambda: " ".join(rng.choices(["the", "of", "and", "winter", "letter", "garden", "river", "slowly", "stone", "bridge", "morning", "paper"], k=90))
    texts = [made() for _ in range(30)]
    texts += [texts[0], texts[1] + " end", "too short", None, texts[2] + " token = 0cab398dc11d1a2a11dc6572c8df8bd228c864f3", "again and again " * 60]
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, SCHEMA)
    columns, seen = docs.columns, {}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = str(tmp_path / str(i))
        stage(spark, docs, "").write.parquet(out)
        docs = spark.read.parquet(out)
        seen[name] = docs.collect()
        if name != "packing":
            assert docs.columns == columns
    ids = lambda name: [r["doc_id"] for r in seen[name]]
    assert set(ids("quality_rules")) == set(range(30)) | {30, 31, 34}
    assert 0 in ids("near_duplicates") and 30 not in ids("near_duplicates") and len(set(ids("near_duplicates"))) == len(ids("near_duplicates"))
    assert sorted(ids("secret_scans")) == sorted(ids("near_duplicates"))
    for r in seen["secret_scans"]:
        assert "0cab398d" not in r["text"] and r["n_chars"] == len(r["text"])
    assert set(ids("source_mixing")) <= set(ids("secret_scans"))
    assert sum(r["length"] for r in seen["packing"]) == sum(len(r["text"].split()) + 1 for r in seen["source_mixing"])


def test_run_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_edited_copies_go(spark):
    rng = random.Random(4)
    own = [f"w{rng.randrange(1000)}" for _ in range(200)]
    edited = [f"new{i}" if i % 50 == 20 else w for i, w in enumerate(own)]  # four words of 200: a similarity of 0.81
    docs = spark.createDataFrame([(1, " ".join(own), "en", "s", 0), (2, " ".join(edited), "en", "s", 0)], SCHEMA)
    assert [r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()] == [1]


def test_near_copies_meet_their_keys_once(spark, monkeypatch):
    """A group of near copies is settled by one round of stars, and its keys' rows meet lists of keys twice at most."""
    rng = random.Random(7)
    own = [f"w{rng.randrange(1000)}" for _ in range(200)]
    texts = [" ".join(f"new{k}" if i == k * 5 else w for i, w in enumerate(own)) for k in range(12)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate([*texts, "something else altogether"])], SCHEMA)
    rounds, listed, components, cut = [], [], near_copies.components, near_copies.cut

    def counted(df):
        out = cut(df)
        if {"key", "node"} <= set(out.columns):
            listed.append(out.count())
        return out

    monkeypatch.setattr(near_copies, "components", lambda edges: rounds.append(1) or components(edges))
    monkeypatch.setattr(near_copies, "cut", counted)
    assert sorted(r["doc_id"] for r in near_copies.dedupe(docs).collect()) == [0, 12]
    assert len(rounds) == 2 and len(listed) == 3 and listed[0] <= 72 * 12 and listed[1:] == [0, 0]
