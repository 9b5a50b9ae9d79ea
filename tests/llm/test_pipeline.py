"""The corpus pipeline: every stage's decisions take effect, on all that the stage before kept."""

from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from ledgerspark.llm import quality, toxicity
from ledgerspark.llm.common import cut
from tests.conftest import SMALL
from tests.llm.test_operators import classes


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    kept = [docs]
    for _, stage in pipeline.STAGES:
        kept.append(cut(stage(spark, kept[-1], SMALL)))
    ids = [sorted(r["doc_id"] for r in k.select("doc_id").collect()) for k in kept]
    assert all(k.columns == docs.columns for k in kept[:-1])
    toxic = toxicity.judge(kept[0], toxicity.fit(kept[0], labels)).where("toxicity.score >= 0.5")
    assert sorted(set(ids[0]) - set(ids[1])) == sorted(r["doc_id"] for r in toxic.select("doc_id").collect())
    poor = quality.judge(kept[1].select("doc_id", "text"), quality.fit(kept[1], labels)).where("not kept")
    assert sorted(set(ids[1]) - set(ids[2])) == sorted(r["doc_id"] for r in poor.select("doc_id").collect())
    assert ids[3] == sorted(set(classes({r["doc_id"]: r["text"] for r in kept[2].collect()}).values()))
    assert set(ids[4]) <= set(ids[3]) and ids[5] == ids[4]
    assert kept[5].where("piece_text = text").count() == len(ids[5])


def test_odd_and_empty_tables(spark, tmp_path):
    """Null and repeated ids, null, empty and long texts, and clashing columns: rows of words stay that no rule rejects."""
    words = lambda n, k: " ".join(f"{k}word{i}" for i in range(n)) + "."
    rows = [(1, words(40, "a")), (1, words(40, "b")), (None, words(40, "c")), (None, words(40, "d")), (2, None), (3, ""), (4, words(40, "a")), (5, words(30_000, "e"))]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for c in ("score", "kept", "component", "r1", "mix_r1"):
        docs = docs.withColumn(c, F.lit(1))
    odd, none = str(tmp_path / "odd"), str(tmp_path / "none")
    docs.write.parquet(f"{odd}/documents.parquet")
    docs.limit(0).write.parquet(f"{none}/documents.parquet")
    labels = spark.createDataFrame([(1, 1, 0), (None, 0, 1)], "doc_id long, quality int, toxic int")
    for folder in (odd, none):
        labels.write.parquet(f"{folder}/labels.parquet")
    assert pipeline.run(spark, none).count() == 0
    got = pipeline.run(spark, odd).select("doc_id", "text", "piece_text").collect()
    assert all(r["text"] == r["piece_text"] for r in got)
    stems = {(r["doc_id"], w[0]) for r in got for w in r["text"].split()}
    assert {("a" if i == 4 else k) for i, k in stems} == set("abcde") and all(len({w[0] for w in r["text"].split()}) == 1 for r in got)
    assert {(i, k) for i, k in stems if k != "a"} == {(1, "b"), (None, "c"), (None, "d"), (5, "e")} and len({i for i, k in stems if k == "a"}) == 1


def test_no_hidden_settings(spark):
    """Running the stages leaves the session's settings as they were."""
    before = dict(spark.conf.getAll)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for _, stage in pipeline.STAGES:
        stage(spark, docs, SMALL).schema
    assert dict(spark.conf.getAll) == before
