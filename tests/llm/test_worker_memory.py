"""What a Python worker takes: batches of rows, and gates of words."""

import numpy as np

from lodestone.llm import toxicity


def test_pipeline_sends_small_batches(spark):
    import corpus_pipeline

    before = spark.conf.get(corpus_pipeline.BATCH_SETTING, None)
    spark.conf.unset(corpus_pipeline.BATCH_SETTING)
    try:
        docs = spark.range(3000, numPartitions=1).selectExpr("id as doc_id", "repeat('abcdefg ', 600) as text")
        seen = corpus_pipeline.STAGES[3][1](spark, docs, "").mapInArrow(lambda parts: (p.select([0]).slice(0, 1) for p in parts), "doc_id long")
        assert seen.count() > 3
        spark.conf.set(corpus_pipeline.BATCH_SETTING, "9m")
        corpus_pipeline.STAGES[3][1](spark, docs, "")
        assert spark.conf.get(corpus_pipeline.BATCH_SETTING) == "9m"
    finally:
        spark.conf.set(corpus_pipeline.BATCH_SETTING, before) if before else spark.conf.unset(corpus_pipeline.BATCH_SETTING)


def test_gates_are_not_copied_as_words_come():
    net = toxicity.Network()
    scorer = toxicity.Scorer(net)
    table = scorer.gates
    scorer.scores([" ".join(f"w{k}x{i}" for i in range(500)) for k in range(40)])
    assert len(scorer.number) == 20_000 and scorer.gates is table
    few = toxicity.Scorer(net)
    few.gates = few.gates[:10]  # more words than there is room for
    text = ["one two three four five six seven eight nine ten eleven twelve"]
    assert np.allclose(few.scores(text), toxicity.Scorer(net).scores(text))
