import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillstream.llm import mixing, queries, quality_classifier, quality_rules, simhash
from quillstream.llm.support import materialise, read_table
from quillstream.session import ship

from .common import ODD, frame

SF = "/root/testdata/sf0.01"


@pytest.fixture(autouse=True, scope="module")
def shipped(spark):
    ship(spark)


def test_stages_one_by_one(spark):
    """Each stage against what its operator says of the stage's own input."""
    docs = read_table(spark, SF, "documents")
    columns = docs.columns
    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}

    ruled = materialise(corpus_pipeline.apply_rules(spark, docs, SF), "t1")
    assert ruled.columns == columns
    assert ids(ruled) == {r["doc_id"] for r in queries.op9_quality_rules(spark, SF).collect() if r["kept"]}

    classed = materialise(corpus_pipeline.classify(spark, ruled, SF), "t2")
    assert classed.columns == columns
    good = {r["doc_id"] for r in queries.op10_quality_classifier(spark, SF).collect() if r["predicted"]}
    assert ids(classed) == ids(ruled) & good

    single = materialise(corpus_pipeline.drop_near_duplicates(spark, classed, SF), "t3")
    assert single.columns == columns and single.count() == len(ids(single)) < classed.count()
    texts = [r["text"] for r in single.collect()]
    assert len(set(texts)) == len(texts)

    mixed = materialise(corpus_pipeline.mix(spark, single, SF), "t4")
    assert mixed.columns == columns and ids(mixed) == ids(single) and mixed.count() == single.count()

    coded = corpus_pipeline.tokenise(spark, mixed, SF)
    assert coded.where("round_trip").count() == mixed.count() and ids(coded) == ids(mixed)
    assert ids(corpus_pipeline.run(spark, SF)) == ids(coded)


def test_order_of_the_mix_is_in_the_result(spark):
    got = corpus_pipeline.run(spark, SF).select("doc_id", "source", "position").toPandas().sort_values("position")
    assert list(got.position) == list(range(len(got)))
    plan = mixing.positions(spark.createDataFrame(got[["doc_id", "source"]])).toPandas().sort_values("position")
    assert list(got.doc_id) == list(plan.id)
    first = plan[plan.phase == 0]
    served = got.source.iloc[: len(first)]
    for s, w in first.groupby("source").weight.first().items():
        assert abs((served == s).sum() - w * len(first)) <= 2 * 16


def odd_tables(spark, folder, rows):
    frame(spark, rows).withColumn("id", F.lit("x")).withColumn("row", F.lit(7)).write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_odd_rows_go_through_all_stages(spark, tmp_path):
    """Nulls, empty and very long texts, repeated rows, a null id, an empty table, columns whose names the stages use too."""
    good = [r["text"] for r in corpus_pipeline.run(spark, SF).select("text").limit(40).collect()]
    rows = [*ODD, *[(100 + i, t) for i, t in enumerate(good)], (100, good[0]), (None, good[1]), (500, good[2])]
    got = corpus_pipeline.run(spark, odd_tables(spark, tmp_path / "a", rows)).toPandas()
    assert not got.doc_id.isin([1, 2, 3, 4, 5, 7, 9]).any()
    assert got.doc_id.dropna().is_unique and sorted(got.position) == list(range(len(got))) and (got.id == "x").all() and got.round_trip.all()
    assert set(got.doc_id.dropna()) <= {8, *range(100, 140)}
    assert corpus_pipeline.run(spark, odd_tables(spark, tmp_path / "b", [])).count() == 0


def test_registered_names():
    assert [f"op{n}_" for n in range(1, 11)] == [f"{q.split('_')[0]}_" for q in queries.QUERIES]
    assert len(corpus_pipeline.STAGES) == 5
    assert quality_rules and quality_classifier and simhash
