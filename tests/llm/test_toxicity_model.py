from pyspark import cloudpickle
from pyspark.sql import functions as F

from gridspark.llm import toxicity
from gridspark.llm.common import documents

SF = "/root/testdata/sf0.01"


def test_weights_do_not_pass_the_driver(spark, monkeypatch):
    docs = documents(spark, SF)
    sent = []
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, value: sent.append(value))
    model = toxicity.corpus_model(spark, docs, SF)
    scored = toxicity.classify(docs, model).select("doc_id", "score", "toxic")
    assert not sent and len(cloudpickle.dumps(model)) < 10_000
    monkeypatch.undo()
    whole = model.open().to_bytes()
    assert len(whole) > 1 << 24 and toxicity.TextCNN.settings(whole) == model.settings
    other = toxicity.classify(docs, whole).select("doc_id", "score", "toxic")
    assert scored.exceptAll(other).isEmpty() and scored.count() == docs.count()


def test_nothing_to_learn_from(spark):
    labels = spark.createDataFrame([], "doc_id long, toxic long")
    docs = documents(spark, SF).limit(5)
    model = toxicity.train_stored(docs, labels, lambda k: F.lit(True))
    assert model.path is None
    assert toxicity.classify(docs, model).where("score between 0 and 1").count() == 5
