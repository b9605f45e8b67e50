import numpy as np
import pytest
from pyspark.sql import functions as F

from geoping.llm import language_id, quality_grade, toxicity

DATA = "/root/testdata/sf0.01"
MIXED = [(1, None), (2, ""), (3, " \n"), (4, "123 !!"), (5, "a"), (None, "text without id"), (5, "a"), (6, "long " * 40_000)]


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{DATA}/labels.parquet")


def test_language_held_out_accuracy(spark):
    out = language_id.op4_language_id(spark, DATA)
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang")
    assert out.count() == docs.count()
    held = out.where("held_out").join(docs, "doc_id")
    assert held.count() > 200 and held.where("lang = lang_pred").count() >= 0.97 * held.count()
    assert out.where("score < 0 or score > 1").count() == 0


def test_language_edge_cases(spark, frame):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = language_id.train(docs.select(F.col("doc_id").alias("id"), "text", "lang").limit(300))
    got = {(r.row.doc_id, r.row.row): r for r in language_id.identify(frame(MIXED), model, ["doc_id", "row", "label"]).collect()}
    assert [got[(i, "r")].lang_pred for i in (1, 2, 3, 4)] == ["und"] * 4
    assert got[(5, "r")].lang_pred != "und" and len(got) == 7
    assert language_id.identify(frame([]), model, ["doc_id"]).collect() == []
    assert {r.lang_pred for r in language_id.identify(frame(MIXED), language_id.train(frame([]).withColumnRenamed("id", "x").withColumn("id", F.col("doc_id"))), ["doc_id"]).collect()} == {"und"}


def test_language_rejects_what_is_far(spark, frame):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select(F.col("doc_id").alias("id"), "text", "lang")
    model = language_id.train(docs)
    out = language_id.identify(frame([(1, "жэюя щъыь " * 30), (2, docs.first().text)]), model, ["doc_id"]).collect()
    assert {r.row.doc_id: r.rejected for r in out} == {1: True, 2: False}


def test_gradients_of_the_network(monkeypatch):
    for name, value in (("HIDDEN", 3), ("WIDTH", 2), ("EMBEDDINGS", 16)):
        monkeypatch.setattr(toxicity, name, value)
    net = toxicity.Network()
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    rng = np.random.default_rng(0)
    index = np.array([[0, 1, 2, -1], [3, 4, -1, -1]])
    x, y = rng.standard_normal((5, 7)), np.array([1.0, 0.0])

    def loss():
        z = net.forward(x, index)
        return float(np.mean(np.logaddexp(0, z) - y * z))

    g, _ = net.gradients(x, index, y)
    for k, slope in g.items():
        flat, slope = net.p[k].reshape(-1), np.asarray(slope).reshape(-1)
        for i in rng.choice(len(flat), min(5, len(flat)), replace=False):
            old = flat[i]
            flat[i] = old + 1e-4
            up = loss()
            flat[i] = old - 1e-4
            down = loss()
            flat[i] = old
            assert abs((up - down) / 2e-4 - slope[i]) < 2e-4


def test_toxicity_held_out_accuracy(spark):
    data = "/root/testdata/sf0.1"
    out = toxicity.op5_toxicity(spark, data)
    held = out.where("held_out").join(spark.read.parquet(f"{data}/labels.parquet"), "doc_id").toPandas()
    assert (held.predicted == held.toxic).mean() > 0.95 and held.predicted[held.toxic == 1].mean() > 0.8


def test_toxicity_windows_cover_all_words():
    text = " ".join(f"w{i}" for i in range(1000)).encode()
    batch = toxicity.Batch(np.array([0, 0, len(text), len(text) + 1]), np.frombuffer(text + b".", np.uint8))
    assert set(batch.doc.tolist()) == {1}
    assert {int(i) for i in batch.index.ravel() if i >= 0} == set(range(1000)) and len(batch.index) == 31


def test_toxicity_edge_cases(spark, frame, labels):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select(F.col("doc_id").alias("id"), "text")
    rated = docs.join(labels.select(F.col("doc_id").alias("id"), "toxic"), "id")
    model = toxicity.train(rated, 30)
    got = toxicity.score(frame(MIXED), model, ["doc_id", "row", "label"]).collect()
    assert len(got) == len(MIXED) and all(0 <= r.score <= 1 for r in got)
    assert {r.score for r in got if r.row.doc_id in (1, 2, 3)} == {model[2]}
    assert toxicity.score(frame([]), model, ["doc_id"]).collect() == []
    assert {r.score for r in toxicity.score(frame(MIXED), toxicity.train(rated.where("toxic = 0")), ["doc_id"]).collect()} == {0.0}


def test_ordinal_slopes():
    model = quality_grade.CumulativeLink(4)
    model.free = np.array([-1.0, 0.2, -0.3])
    z, y = np.array([0.3, -1, 2.0]), np.array([0, 2, 3])
    loss = lambda v: -np.log(model.probabilities(v)[np.arange(3), y])
    assert np.allclose(model.slopes(z, y)[0], (loss(z + 1e-5) - loss(z - 1e-5)) / 2e-5, atol=1e-6)
    assert (np.diff(model.thresholds()) > 0).all()


def test_quality_grades(spark, frame, labels):
    data = "/root/testdata/sf0.1"
    out = quality_grade.op7_quality_classifier(spark, data)
    rated = spark.read.parquet(f"{data}/labels.parquet").withColumn("grade", quality_grade.rating(F.col("quality"), F.col("toxic")))
    held = out.where("held_out").join(rated, "doc_id").toPandas()
    assert (held.grade == held.grade_pred).mean() > 0.85
    means = held.groupby("grade").expected_grade.mean()
    assert means[0] < means[1] < means[2] and held.selected[held.grade == 0].mean() < 0.02


def test_quality_edge_cases(frame):
    rated = frame(MIXED + [(50, "good text here"), (51, "bad")]).select(F.col("doc_id").alias("id"), "text", F.when(F.col("doc_id") == 51, 0).otherwise(1).alias("grade"))
    model = quality_grade.train(rated)
    got = quality_grade.grade(frame(MIXED), model, ["doc_id", "row", "label"]).collect()
    assert len(got) == len(MIXED) and all(r.expected_grade == 0 and not r.selected for r in got if r.row.doc_id in (1, 2, 3))
    assert quality_grade.grade(frame([]), model, ["doc_id"]).collect() == []
    assert quality_grade.train(rated.where("grade = 1")) == 1 and quality_grade.train(rated.where("false")) == 0
