"""Held-out accuracy, the label model, and odd inputs."""

import zlib

import numpy as np

from bandwright.llm import queries, toxicity


def frame(spark, rows):
    return spark.createDataFrame(
        [(i, t, "a", 2.0) for i, t in rows], "doc_id long, text string, lang string, score double"
    )


def test_label_model_learns_who_is_right():
    random = np.random.default_rng(2)
    truth = random.random(4000) < 0.3
    accuracy = [0.95, 0.9, 0.6]
    cast = np.stack(
        [np.where(random.random(4000) < a, truth, ~truth) * 2 for a in accuracy], axis=1
    ).astype(np.int8)
    # A voter that repeats the weakest one.
    cast = np.append(cast, cast[:, 2:], axis=1)
    noisy = np.where(random.random(4000) < 0.9, truth, ~truth).astype(int)
    posterior, estimated, correlation = toxicity.fit_label_model(cast, noisy)
    assert ((posterior > 0.5) == truth).mean() > 0.97
    assert np.allclose(estimated[:3], accuracy, atol=0.05)
    assert correlation[2, 3] > 0.9 and abs(correlation[0, 1]) < 0.2


def test_linear_model_follows_marks(spark):
    insults = ["vexo", "grumbol"]
    rows = [(i, f"some plain words number {i} {insults[i % 2] if i % 3 == 0 else ''}") for i in range(300)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)], "doc_id long, toxic int")
    model = toxicity.train(frame(spark, rows), labels)
    odd = [(1, None), (2, ""), (None, "VEXO and grumbol"), (4, "plain"), (4, "plain"), (5, "vexo " * 50_000)]
    found = toxicity.scored(frame(spark, odd), model).orderBy("doc_id").collect()
    by_text = {r["text"]: r for r in found}
    assert len(found) == 6
    assert all(0 <= r["score"] <= 1 for r in found)
    assert by_text["VEXO and grumbol"]["predicted"] == 1 and not by_text["VEXO and grumbol"]["held_out"]
    assert by_text["plain"]["predicted"] == by_text[None]["predicted"] == by_text[""]["predicted"] == 0
    assert found[0]["lang"] == "a"


def test_no_labels_and_no_documents(spark):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.train(frame(spark, [(1, "x")]), labels)
    assert toxicity.scored(frame(spark, [(1, "x")]), model).first()["predicted"] == 0
    assert toxicity.scored(frame(spark, []), model).count() == 0


def test_held_out_fold_is_not_learned_from(spark, star_folder):
    folder = star_folder("0.1")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rows = queries.op3_toxicity(spark, folder).join(labels, "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r["held_out"]]
    toxic = [r["predicted"] for r in held if r["toxic"]]
    clean = [r["predicted"] for r in held if not r["toxic"]]
    assert np.mean(toxic) > 0.85 and np.mean(clean) < 0.01
