import random
import zlib

from pyspark.sql import functions as F
from tests.llm.helpers import documents, edge_rows

from loomline.llm import toxicity
from loomline.llm.common import fold


def corpus(n=1200):
    rnd = random.Random(1)
    words = ["".join(rnd.choice("thenaisor") for _ in range(rnd.randrange(2, 8))) for _ in range(300)]
    rows = []
    for k in range(n):
        text = [rnd.choice(words) for _ in range(rnd.choice([4, 30, 400]))]
        bad = k % 4 == 0
        if bad:
            text.insert(rnd.randrange(len(text)), rnd.choice(["gruffle", "snarkle", "blorped"]))
        rows.append((1000 + k, " ".join(text), "a", int(bad)))
    return rows


def test_held_out_accuracy_and_misspellings(spark):
    rows = corpus()
    docs = documents(spark, [r[:3] for r in rows] + edge_rows() + [(1, "the gruffles sat", "a"), (2, "the hen sat", "a")])
    labels = spark.createDataFrame([(i, x) for i, _, _, x in rows] + [(None, 1), (77, None), (1000, 0)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    got = {r.doc_id: r for r in toxicity.score_texts(docs, model).collect()}
    held = [(i, x) for i, _, _, x in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(got[i].predicted == x for i, x in held) >= 0.97 * len(held)
    assert model.scorer()("the gruffles sat") >= 0.5 > model.scorer()("the hen sat")
    assert all(0 <= r.score <= 1 for r in got.values()) and got[5].score == got[3].score


def test_labels_of_the_fold_are_never_read(spark):
    rows = corpus(120)
    docs = documents(spark, [r[:3] for r in rows])
    labels = spark.createDataFrame([(i, x) for i, _, _, x in rows], "doc_id long, toxic int")
    other = labels.withColumn("toxic", F.when(fold() == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (toxicity.train(docs, x).scorer()("gruffle or not") for x in (labels, other))
    assert a == b


def test_without_two_classes(spark):
    docs = documents(spark, edge_rows())
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in toxicity.score_texts(docs, toxicity.train(docs, none)).collect()} == {0.0}
    assert toxicity.score_texts(documents(spark, []), toxicity.train(docs, none)).count() == 0


def test_query_with_null_and_repeated_ids(spark, tmp_path):
    documents(spark, edge_rows()).withColumnRenamed("key", "score").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, 1, 1), (3, 1, 0), (None, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = toxicity.op6_toxicity(spark, str(tmp_path)).collect()
    assert len(got) == len(edge_rows()) and all(isinstance(r.held_out, bool) and 0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id == 7}) == 1
