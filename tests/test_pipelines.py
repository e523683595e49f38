"""The engine from raw pages to an evaluation report, in one workspace."""

import json

import pytest

from sparkscribe.__main__ import main
from sparkscribe.plans import pipelines as run
from sparkscribe.sources import files, schemas


def test_end_to_end(spark, tmp_path, capsys):
    w = str(tmp_path / "w")
    text = ["Convolution\n\n", "An image is filtered by convolution with a kernel. " * 16, "\n\n", "CT and MRI show the body; ultrasound does too. " * 20]
    pages = spark.createDataFrame([(s, n, "".join(text) + f"\n\nPage {n} of {s}.\n{n}\n") for s in ("a.pdf", "b.pdf") for n in range(9, 15)], schemas.RAW_PAGE)
    made = run.process_pages(pages, w)
    assert made["pages"] == 8 and made["chunks"] >= 8
    first = run.build_vector_store(spark, w, dim=32)
    again = run.build_vector_store(spark, w, dim=32)
    assert first["recomputed"] == made["chunks"] == again["skipped"] and again["recomputed"] == 0 and again["store_version"] == 2
    total = run.extract_concepts(spark, w)
    assert total["log_errors"] == 0 and total["chunks_processed"] == made["chunks"] and total["concepts_total"] >= 6
    stats = run.ingest_graph(spark, w)
    assert stats == run.ingest_graph(spark, w)
    assert stats["relations"] == total["relations_total"] and stats["next_edges"] == made["chunks"] - 2
    assert run.link_vector_graph(spark, w)["linked"] == made["chunks"]
    hits = run.payload(run.retrieve(spark, w, ["What is CT?", "convolution"], k=3))
    assert [(h["query_id"], h["rank"]) for h in hits] == [(q, r) for q in (0, 1) for r in (1, 2, 3)] and any(h["graph"]["mentions"] for h in hits)
    assert run.simulate(spark, w, rounds=30, k=4)["events"] == 30
    info = run.train(spark, w)
    assert info["trained"] == 30 and run.train(spark, w, reset=True)["trained"] == 30
    report = run.evaluate(spark, w)
    assert set(report["policies"]) == {"retrieval", "random", "linucb"} and run.read_document(spark, f"{w}/bandit/report")["target_epsilon"] == 0.05
    assert run.simulate(spark, w, rounds=20, k=4, policy="linucb_epsilon")["events"] == 20
    with pytest.raises(ValueError):
        run.simulate(spark, w, policy="other")
    capsys.readouterr()
    main(["retrieve", w, "--query", "What is MRI?", "--k", "2"])
    assert len(json.loads(capsys.readouterr().out)) == 2
    broken = run.read_document(spark, f"{w}/vector/manifest") | {"index_size": 1}
    run.write_document(spark, broken, f"{w}/vector/manifest")
    with pytest.raises(ValueError):
        run.load_index(spark, w)


def test_model_backends(spark, tmp_path):
    w = str(tmp_path / "w")
    files.write_jsonl(spark.createDataFrame([("c1", "s", 1, 1, "good", 4, 1, None, None, 1), ("c2", "s", 2, 2, "bad", 3, 1, None, None, 2)], schemas.CHUNK + ", chunk_no INT"), f"{w}/chunks")

    def reply(texts):
        return ['note {"concepts": [{"name": "Idea", "type": "method", "confidence": 0.9}]}' if t == "good" else "{" for t in texts]

    total = run.extract_concepts(spark, w, backend="model", reply=reply)
    assert (total["concepts_total"], total["log_errors"]) == (1, 1)
    from sparkscribe.sources.store import embedder

    encode = embedder("model", model=lambda texts: [[float(len(t)), 1.0] for t in texts])
    assert run.build_vector_store(spark, w, backend="model", model="length", dim=2, encode=encode)["recomputed"] == 2
    with pytest.raises(ValueError):
        embedder("none")
