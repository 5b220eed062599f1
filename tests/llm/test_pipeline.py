import corpus_pipeline as p

from . import test_decontaminate, test_exact_dedup, test_shingles, test_simhash


def test_stages_against_brute_force(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = docs.columns
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == names
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        after = {r["doc_id"]: r["text"] for r in docs.collect()}
        if name == "exact_dedup":
            assert set(after) == {d for d, _, _, kept, _ in test_exact_dedup.brute(rows.items()) if kept}
        if name == "near_dedup":
            first = {d for d, _, root in test_simhash.brute(rows.items()) if d == root}
            assert set(after) == first - set(test_shingles.brute((d, rows[d]) for d in first))
        if name == "decontamination":
            items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
            assert set(after) == {d for d, hits in test_decontaminate.brute(rows.items(), items) if not hits}
        assert all(rows[d] == t for d, t in after.items())
        rows = after
    last = p.STAGES[-1][1](spark, docs, sf).collect()
    assert {r["doc_id"] for r in last} == set(rows) and all(r["round_trip"] for r in last)
    assert {(r["doc_id"], tuple(r["ids"])) for r in p.run(spark, sf).collect()} == {(r["doc_id"], tuple(r["ids"])) for r in last}


def test_awkward_tables(spark, docs, empty, sf):
    for table in (docs, empty):
        now = table
        for name, stage in p.STAGES:
            out = stage(spark, now, sf)
            out.count()
            if name != p.STAGES[-1][0]:
                now = out
    kept = {r["doc_id"] for r in p.one_of_each_text(spark, docs, sf).collect()}
    assert 6 in kept or 8 in kept
    assert p.one_of_each_text(spark, docs, sf).where("doc_id = 6 or doc_id = 7 or doc_id = 8").count() == 1


def test_a_run_leaves_the_tables_of_others(spark, sf):
    """A result that isn't stored yet when the pipeline runs can still be read."""
    from lavra.llm import common, exact_dedup

    others = exact_dedup.exact_dedup(spark.read.parquet(f"{sf}/documents.parquet"))
    before = common.written()
    p.run(spark, sf)
    assert before <= common.written()
    assert others.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    common.release(spark)
    assert not common.written()


def test_encoding_draws_without_replacement(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("length(text) > 200").limit(20)
    rows = p.encoded(spark, docs, sf).collect()
    assert len(rows) == 40 and len({(r["doc_id"], tuple(r["ids"])) for r in rows}) == 40
    assert all(r["round_trip"] and 0 <= r["inclusion"] <= 1 for r in rows)


def test_only_rows_that_go_or_repeat_are_looked_up(spark, docs):
    """Of 4,000 rows 40 go and some repeat: those are shuffled, with few others, and repeated ones stay once."""
    from pyspark.sql import functions as F

    from lavra.llm.common import flagged

    rows = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    rows = rows.union(rows.where("doc_id < 30"))
    fate = p._keyed(rows).select(p.ROW, (F.col("doc_id") % 100 != 7).alias("stays"))
    out = p._settled(rows, fate)
    assert sorted(r["doc_id"] for r in out.collect()) == [i for i in range(4000) if i % 100 != 7]
    gone = p._keyed(rows.where("doc_id % 100 = 7")).select(F.xxhash64(p.ROW).alias("k"))
    marked = flagged(p._keyed(rows), F.xxhash64(p.ROW), gone, gone.count())
    assert marked.where("doc_id % 100 = 7 and not lavra_flagged").count() == 0
    assert marked.where("lavra_flagged").count() < 80
    assert p._settled(docs, p._keyed(docs).select(p.ROW, F.lit(True).alias("stays"))).count() == docs.distinct().count()
