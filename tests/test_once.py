"""Each document is walked once, by as many tasks as the session asks for."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lavra.functions import labels as L
from lavra.functions.arrow import values
from lavra.operators import articulation, bundles, corpus, parts, profiles
from lavra.plans import queries as plans
from lavra.plans.corpus import legal_blocks


@pytest.mark.parametrize("name", ["segment_words", "document_confidence", "section_tree"])
def test_filters_do_not_repeat_the_walk(spark, sf, name):
    plan = plans.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


@pytest.mark.parametrize(("name", "walks"), [("xml_published", 2), ("region_runs", 0)])
def test_a_text_is_made_once_for_each_reading(spark, sf, name, walks):
    """Filters on the text were pushed below what makes it, which wrote it out at each mention; published documents were analysed twice, runs located twice."""
    query = plans.QUERIES[name](spark, sf)._jdf.queryExecution()
    assert query.optimizedPlan().toString().count("Texto do artigo citado") <= 2
    assert query.executedPlan().toString().count("ArrowEvalPython") == walks


def test_has_text_is_what_stripping_leaves(spark):
    texts = ["", " ", "\t\n\x0b\f\r ", "a", " a", "\xa0", "\u2028", "\x00", "\n\né", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", L.has_text(F.col("t")).alias("has"), (L.stripped(F.col("t")) != "").alias("left")).collect()
    assert [r["has"] for r in rows] == [r["left"] for r in rows] == [None if t is None else t.strip(L.BLANKS) != "" for t in texts]


def test_items_count_from_the_last_article_or_paragraph(spark):
    lines = ["Art. 1º Fica", "I - um;", "§ 1º Um", "I - dois;", "II - três;", "Art. 2º Fim", "I - quatro;", "mais"]
    rows = spark.createDataFrame([(1, i, t) for i, t in enumerate(lines)], "doc_id long, idx long, text string").withColumn("label", L.parse_label(F.col("text")))
    units = articulation.marked(rows).groupBy("doc_id").agg(*articulation.gathered(F.lit(True))).select(articulation.read(F.col("units"), F.col("ahead")).alias("u")).head()["u"]
    assert [u["id"] for u in units] == ["art1", "art1_cpt_inc1", "art1_par1", "art1_par1_inc1", "art1_par1_inc2", "art2", "art2_cpt_inc1", None]
    assert [u["rest"] for u in units][-2:] == ["quatro;", "mais"] and units[-1]["parent"] == "art2_cpt"
    none = articulation.marked(rows.where("idx > 0")).groupBy("doc_id").agg(*articulation.gathered(F.lit(True))).select(articulation.read(F.col("units"), F.col("ahead")).alias("u")).head()["u"]
    assert none is None


def test_units_come_with_the_tree_of_a_body(spark, sf):
    blocks = legal_blocks(spark, sf).where("doc_id < 400")
    docs = corpus.kept(parts.located(blocks, profiles.identity(blocks)))
    assert docs.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))  # few bytes, much work: not merged
    whole = bundles.routed(bundles.assembled(docs)).where("route = 'norma'").select("doc_id", "units").collect()
    apart = {r["doc_id"]: r["units"] for r in bundles.statutes(docs).collect()}
    assert whole and {r["doc_id"]: r["units"] for r in whole} == {r["doc_id"]: apart.get(r["doc_id"]) for r in whole}


def test_few_bytes_do_not_make_few_tasks(spark, sf):
    blocks = legal_blocks(spark, sf)
    blocks.count()
    assert blocks.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_values_are_those_of_to_pylist():
    kind = pa.list_(pa.struct([("a", pa.int32()), ("v", pa.list_(pa.int32())), ("s", pa.struct([("x", pa.string())]))]))
    data = [[{"a": 1, "v": [1, 2], "s": {"x": "q"}}, {"a": None, "v": None, "s": None}], None, [], [None, {"a": 3, "v": [], "s": {"x": None}}]]
    array = pa.array(data, kind)
    assert values(array) == data and values(array[1:]) == data[1:] and values(array[:0]) == []


def test_stripped_takes_the_blanks_it_names_and_no_others(spark):
    texts = ["", " ", "a", " a", "a\t", "\x0ba\f", "\na b\r\n", "\xa0a\xa0", "é ", "\x00 a", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", L.stripped(F.col("t")).alias("s")).collect()
    assert [r["s"] for r in rows] == [None if r["t"] is None else r["t"].strip(L.BLANKS) for r in rows]
