import corpus_pipeline
from conftest import SMALL
from trackloom.llm.common import table


def test_stages_keep_the_columns_of_documents_and_the_last_packs(spark):
    docs = table(spark, SMALL, "documents")
    columns, counts = docs.columns, [docs.count()]
    from trackloom.llm.common import stored

    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, SMALL))
        assert docs.columns == columns, name
        counts.append(docs.count())
    assert counts[0] >= counts[1] >= counts[2] == counts[3] > 0 and counts[4] > 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).toPandas()
    assert packed.groupby("sequence_id")["length"].sum().max() <= 2048
    assert packed[packed["start"] == 0].shape[0] == counts[4]


def test_empty_documents(spark):
    docs = table(spark, SMALL, "documents").where("false")
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SMALL)
        assert out.count() == 0
