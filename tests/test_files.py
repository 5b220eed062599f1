"""Folders as a data source, the text parser and the names of published files."""

import pytest
from pyspark.sql import functions as F

from lavra.sources import files, readers


def test_every_file_is_a_row(spark, tmp_path):
    (tmp_path / "a b").mkdir()
    contents = {"x.txt": b"um", "vazio": b"", "a b/ç.TXT": "á".encode(), "a b/semponto": b"2", ".oculto.html": b"<p>3</p>"}
    for name, data in contents.items():
        (tmp_path / name).write_bytes(data)
    got = {r["path"]: r for r in files.read_files(spark, str(tmp_path), str(tmp_path / "x.txt")).collect()}
    assert {p.removeprefix(f"{tmp_path}/"): bytes(r["content"]) for p, r in got.items()} == contents  # once each, also if named twice
    assert {p.rpartition("/")[2]: r["suffix"] for p, r in got.items()} == {"x.txt": "txt", "vazio": "", "ç.TXT": "txt", "semponto": "", ".oculto.html": "html"}
    assert all(r["size"] == len(r["content"]) and r["error"] is None for r in got.values())
    ids = {r["path"]: r["i"] for r in spark.createDataFrame([(p,) for p in got], "path string").select("path", F.xxhash64("path").alias("i")).collect()}
    assert {p: r["doc_id"] for p, r in got.items()} == ids
    first = [r["path"] for r in files.read_files(spark, str(tmp_path), limit=2).collect()]
    assert sorted(first) == sorted(got)[:2]
    with pytest.raises(Exception, match="nowhere"):
        files.read_files(spark, str(tmp_path / "nowhere")).collect()


def test_partitions_by_size(tmp_path, monkeypatch):
    for i in range(7):
        (tmp_path / f"{i}.txt").write_bytes(b"x" * (i * 100))
    monkeypatch.setattr(files, "OPEN_COST", 0)
    monkeypatch.setattr(files, "PART_BYTES", 700)
    reader = files.FilesReader({"paths": f'["{tmp_path}"]'})
    parts = reader.partitions()
    assert [[s for _, s, _ in p.files] for p in parts] == [[0, 100, 200, 300], [400], [500], [600]]
    monkeypatch.setattr(files, "BATCH_BYTES", 250)
    assert sum(b.num_rows for p in parts for b in reader.read(p)) == 7
    assert [p.files for p in files.FilesReader({"paths": "[]"}).partitions()] == [[]]


def test_a_file_gone_or_with_the_id_of_another_is_reported(tmp_path):
    reader = files.FilesReader({"paths": f'["{tmp_path}"]'})
    rows = [r for b in reader.read(files.Part([(f"{tmp_path}/gone.txt", 1, False), (f"{tmp_path}/two.txt", 1, True)])) for r in b.to_pylist()]
    assert [r["content"] for r in rows] == [None, None] and "gone.txt" in rows[0]["error"] and rows[1]["error"] == "another file has the same id"


def test_texts_are_parsed_alike_by_columns_and_by_bytes(spark):
    texts = ["", "\n\n", "um\n\ndois", "  a\r\n b\r\n \t \r\n\n   c\t d \n e", "\n\n\tx\n\n \x0b\n y ", "só uma linha", "a\n \n b", " x y\n\nz"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    names = ("idx", "text", "indent_direct", "indent_effective")
    got: dict = {i: [] for i in range(len(texts))}
    for r in readers.txt_blocks(df).orderBy("doc_id", "idx").collect():
        got[r["doc_id"]].append(tuple(r[c] for c in names))
    for i, t in enumerate(texts):
        assert [(n, x["text"], x["indent_direct"], x["indent_effective"]) for n, x in enumerate(readers.txt_items(t.encode()))] == got[i], t


def test_names_of_documents_that_share_one(spark):
    """Most documents have one name; none of the tasks that number them sees more than a share."""
    rows = spark.range(20_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 == 0, F.concat(F.lit("urn:lex:br:federal:lei:1990;"), F.col("id").cast("string"))).otherwise(F.lit("urn:lex:br:federal:documento:0000;0")).alias("base"))
    rows = rows.select("doc_id", F.explode(F.when(F.col("doc_id") < 50, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("fragment"), "base")
    docs = rows.withColumn("urn", F.when(F.col("fragment") > 0, F.concat("base", F.lit("!anexo1"))).otherwise(F.col("base"))).drop("base")
    got = readers.file_names(docs).collect()
    assert len({r["file"] for r in got}) == len(got) == 20_050
    of = {(r["doc_id"], r["fragment"]): r["file"] for r in got}
    assert all(of[i, 1] == of[i, 0].removesuffix(".xml") + ".anexo1.xml" for i in range(50)) and of[10, 0] == "br-federal-lei-1990-10.xml"
    shared = sorted(int(f.removesuffix(".xml").partition("_")[2] or 1) for (i, n), f in of.items() if i % 10 and not n)
    assert shared == list(range(1, 18_001))
    share = F.pmod(F.xxhash64(F.lit("share"), "doc_id"), F.lit(readers.SHARES))
    assert docs.where("doc_id % 10 > 0").groupBy(share).count().agg(F.max("count")).head()[0] < 150
