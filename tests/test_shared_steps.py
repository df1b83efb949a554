from pyspark.sql import functions as F

from millrace.operators import chunking, dense


def test_words_are_counted_once_for_numbered_chunks(spark):
    docs = spark.createDataFrame([(i, "word " * (300 * i + 1)) for i in range(5)], "doc_id long, text string")
    chunks = chunking.chunk_documents(docs, numbered=True)
    # What is left to do in Python is the cut; counts are read where they were staged.
    assert chunks._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    plain = chunking.number_chunks(chunking.chunk_documents(docs), "doc_id")
    assert sorted((r["chunk_id"], r["doc_id"], r["seq"], r["text"]) for r in chunks.collect()) == sorted((r["chunk_id"], r["doc_id"], r["seq"], r["text"]) for r in plain.collect())


def test_buckets_of_words_are_looked_up_without_a_call_each(spark, monkeypatch):
    monkeypatch.setattr(dense, "REMEMBERED", 3)
    words = ["one", "two,", ".", "thrée?", "four", "one", "five", "two,", "..one"] * 3
    for dim in (256, 100):
        expected = spark.range(1).select(dense.hash_buckets(F.lit(" ".join(words)), dim)).first()[0]
        known = dense._Buckets(dim)
        assert [*map(known.__getitem__, words)] == expected and len(known) <= 4
