import corpus_pipeline
from llm_helpers import prose, table

from corpusloom.llm.registry import ORACLE_SQL, QUERIES


def test_names():
    assert [n.split("_")[0] for n in QUERIES] == [f"op{i}" for i in range(1, 11)]
    assert set(ORACLE_SQL) <= set(QUERIES)


def test_stages_in_order(spark, tmp_path):
    shared, passage = "A licence line that every document of this table carries along", prose(7, 60)
    rows = [(i, f"{prose(100 + i, 40)}\n{shared}\n{prose(300 + i, 9)} {passage}" + (" grumble" if i % 5 == 0 else "")) for i in range(40)]
    rows += [(100, rows[3][1]), (101, None), (102, "")]
    table(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        docs = stage(spark, before, str(tmp_path))
        docs.write.parquet(str(tmp_path / f"out{k}"))
        docs = spark.read.parquet(str(tmp_path / f"out{k}"))
        if k < 4:
            assert docs.columns == columns
    cut = spark.read.parquet(str(tmp_path / "out3"))
    holding = [x.doc_id for x in cut.collect() if x.text and passage in x.text]
    assert len(holding) == 1
    assert {x.doc_id for x in docs.collect()} == {x.doc_id for x in cut.collect()}
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == docs.count()
