import public_tokenizers as tokenizers
from pyspark.sql import functions as F

from gridspark.llm import attention_lm, lm_scoring


def test_weights_learn_from_every_training_document(spark, monkeypatch):
    met, moved = [], attention_lm.AttentionLM.moved
    monkeypatch.setattr(attention_lm.AttentionLM, "moved", lambda model, total: (met.append(total[0]), moved(model, total))[1])
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("north wind "), F.col("id") % 9).alias("text"))
    scored = lm_scoring.score_texts(docs, lambda k: k % 4 != 1, tokenizers.path("word_bpe_49k.json"), 49407, pack_bytes=20_000)
    assert scored.count() == 4000
    assert met == [3000] * attention_lm.ROUNDS  # short documents, a window each
