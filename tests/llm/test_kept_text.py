"""Language ID passes a kept text to its tasks once."""

import public_tokenizers
from pyspark.sql import functions as F

from cohortlens.llm import language_id


def test_kept_text_goes_to_tasks_once(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    docs = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate(
        [("the cat and the dog", "en"), ("le chat et le chien", "fr"), (None, "en"), ("12 34", "fr"), ("x" * 70, None)] * 8)],
        "doc_id long, text string, lang string")
    model = language_id.train(docs, path)
    plain = {r["doc_id"]: r for r in language_id.identify(docs, path, model).collect()}
    found = language_id.identify(docs, path, model, ("text", "lang"))
    assert "text" not in found._jdf.queryExecution().analyzed().children().head().output().mkString(" ").replace("__text", "").replace("text_key", "")
    for r in found.withColumn("doc", F.col("doc_id")).collect():
        assert all(r[c] == plain[r["doc"]][c] for c in ("text_key", "lang_pred", "score", "word_chars", "per_char"))
    texts = {r["doc_id"]: (r["__text"], r["__lang"]) for r in found.collect()}
    assert texts == {r["doc_id"]: (r["text"], r["lang"]) for r in docs.collect()}
    binary = docs.withColumn("text", F.col("text").cast("binary"))
    as_bytes = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.identify(binary, path, model, ("text",)).collect()}
    assert as_bytes == {k: (r["lang_pred"], r["score"]) for k, r in plain.items()}
