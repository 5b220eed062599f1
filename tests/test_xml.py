"""Renderings read back, corpus runs over real files, and the seams."""

import io
import subprocess
import sys
import zipfile
from xml.etree import ElementTree

from pyspark.sql import functions as F

from lavra.functions import text as T
from lavra.operators import corpus, hierarchy, quotation, seams, segments, xml
from lavra.sources import readers

from .conftest import ROOT

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def _blocks(spark, docs):
    rows = [(d, i, "para", t, s, None, None, None, None, 0) for d, lines in docs.items() for i, (t, s) in enumerate(lines)]
    return spark.createDataFrame(rows, "doc_id long, idx long, kind string, text string, style string, outline_level int, num_id string, ilvl int, indent_direct int, indent_effective int")


TREE = [("Abertura & fecho", None), ("1. DOS FATOS", None), ("Texto um", None), ("1.1 Detalhe longo que se lê como prosa, não como título de seção nenhuma.", None),
        ("2. DO DIREITO", None), ("a) primeira", None), ("b) segunda", None), ("3. CONCLUSÃO", None), ("fim <já>", None)]


def test_tree_rows_and_both_renderings_agree(spark):
    outlined = hierarchy.outlines(quotation.analyse(_blocks(spark, {1: TREE, 2: [("só texto", None)], 3: [("", None)]})))
    rows = segments.segments(outlined, F.lit("urn:x")).orderBy("doc_id", "order").collect()
    one = [(r["id"], r["kind"], r["level"], r["label"], r["heading"], r["text"]) for r in rows if r["doc_id"] == 1]
    assert one == [
        ("pp1_agr1", "texto", 0, None, None, "Abertura & fecho"),
        ("pp1_agr2", "secao", 1, "1.", "DOS FATOS", "Texto um"),
        ("pp1_agr2_agr1", "subsecao", 2, "1.1", None, "Detalhe longo que se lê como prosa, não como título de seção nenhuma."),
        ("pp1_agr3", "secao", 1, "2.", "DO DIREITO", ""),
        ("pp1_agr3_agr1", "alinea", 2, "a)", "primeira", ""), ("pp1_agr3_agr2", "alinea", 2, "b)", "segunda", ""),
        ("pp1_agr4", "secao", 1, "3.", "CONCLUSÃO", "fim <já>"),
    ]
    assert [(r["id"], r["text"]) for r in rows if r["doc_id"] == 2] == [("pp1_agr1", "só texto")]
    for emitter in ("generico", "generico-aninhado"):
        laid = segments.laid_out(outlined, emitter)
        got = xml.segments_of(xml.rendered(laid, F.lit("urn:x"), emitter)).orderBy("doc_id", "order").collect()
        want = segments.segments(outlined, F.lit("urn:x"), emitter).orderBy("doc_id", "order").collect()
        fields = ("doc_id", "id", "kind", "level", "label", "heading", "breadcrumb", "text", "path")
        assert [tuple(r[f] for f in fields) for r in got] == [tuple(r[f] for f in fields) for r in want]
        ids = xml.rendered(laid, F.lit("u"), emitter).select(F.explode(xml.ids(F.col("xml"))).alias("i"), "doc_id")
        assert ids.groupBy("doc_id", "i").count().where("count > 1").isEmpty() and ids.where(~segments.is_legal_id(F.col("i"))).isEmpty()


def test_statute(spark):
    units = [
        {"role": "artigo", "id": "art1", "parent": None, "label": "Art. 1º", "rest": "Fica"}, {"role": "inciso", "id": "art1_cpt_inc1", "parent": "art1_cpt", "label": "I -", "rest": "um"},
        {"role": "paragrafo", "id": "art1_par1u", "parent": "art1", "label": "Parágrafo único.", "rest": "Sim"}, {"role": "texto", "id": None, "parent": "art1_par1u", "label": None, "rest": "mais"},
    ]
    out = xml.norma("urn:x", units)
    assert "<Caput id=\"art1_cpt\"><Rotulo>Art. 1º</Rotulo><p>Fica</p><Inciso id=\"art1_cpt_inc1\">" in out
    assert [(r["kind"], r["text"]) for r in xml.read(out)] == [("artigo", ""), ("caput", "Fica"), ("inciso", "um"), ("paragrafo", "Sim mais")]
    assert xml._words(out) == "Art. 1º Fica I - um Parágrafo único. Sim mais".split()
    assert xml.norma("u", units[1:2]) == "" and xml.read(xml.flat("u", [])) == []


def test_annex_is_a_document_of_its_own():
    row = {"id": "anexo2_pp_agr1", "kind": "tituloAnexo", "level": 0, "label": None, "heading": None, "breadcrumb": [], "paras": [{"text": "ANEXO II", "quoted": False}], "path": []}
    section = row | {"id": "anexo2_pp_agr2", "kind": "secao", "level": 1, "label": "1.", "heading": "TABELA", "paras": [{"text": "x", "quoted": True}], "path": [1]}
    for emitter in ("generico", "generico-aninhado"):
        out = xml.annex("urn:x", 2, [row, section], emitter)
        assert 'URN="urn:x!anexo2"' in out and 'id="anexo2_pp_agr2"' in out and '<p class="quote">x</p>' in out
        assert [(r["id"], r["text"]) for r in xml.read(out)] == [("anexo2_pp_agr1", "ANEXO II"), ("anexo2_pp_agr2", "x")]


def _docx(*paragraphs):
    body = "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs)
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("word/document.xml", f"<w:document {W}><w:body>{body}</w:body></w:document>")
    return data.getvalue()


def _folder(tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "portaria_1.txt").write_bytes("PORTARIA nº 1\n\nArt. 1º Fica.\n\nArt. 2º Não.\n\nArt. 3º Fim.".encode())
    (tmp_path / "latin.txt").write_bytes("acórdão nº 2".encode("latin-1"))
    (tmp_path / "sub" / "pagina.html").write_text("<h1>1. UM</h1><p>texto</p><h1>2. DOIS</h1><p>fim</p>")
    (tmp_path / "parecer_3.docx").write_bytes(_docx("PARECER nº 3", "corpo do parecer"))
    (tmp_path / "quebrado.docx").write_bytes(b"not a zip")
    (tmp_path / "foto.png").write_bytes(b"\x89PNG")
    (tmp_path / "vazio.txt").write_bytes(b"\n")
    (tmp_path / "nada.txt").write_bytes(b"")
    return str(tmp_path)


def test_corpus_of_all_kinds_of_files(spark, tmp_path):
    path = _folder(tmp_path)
    outcomes, documents = corpus.run(spark, path)
    by = {r["source"]: r for r in outcomes.collect()}
    assert len(by) == 8
    assert {s for s, r in by.items() if not r["ok"]} == {"quebrado.docx", "foto.png"}
    assert by["foto.png"]["error"] == "unsupported format: png" and "BadZipFile" in by["quebrado.docx"]["error"]
    act = by["portaria_1.txt"]
    assert (act["route"], act["emitter"], act["profile"], act["genre"], act["gate"]) == ("norma", "norma", "portaria", "portaria", [])
    for name in ("vazio.txt", "nada.txt"):
        assert by[name]["n_blocks"] == 0 and by[name]["flat"] and by[name]["emitter"] == "generico" and by[name]["flat_cause"] == "empty_body_span"
    text = {r["doc_id"]: r["w"] for r in documents.select("doc_id", xml.words(F.col("xml")).alias("w")).collect()}
    assert text[by["latin.txt"]["doc_id"]] == ["acórdão", "nº", "2"]
    assert text[by["parecer_3.docx"]["doc_id"]] == "PARECER nº 3 corpo do parecer".split()
    totals = corpus.report(outcomes)["totals"].collect()[0]
    assert (totals["total"], totals["succeeded"], totals["failed"], totals["balanced"]) == (8, 6, 2, True)
    urns = {r["doc_id"]: r["urn"] for r in outcomes.collect() if r["ok"]}
    written = readers.write_xml(documents, str(tmp_path / "out")).collect()
    assert len(written) == len({r["file"] for r in written}) == documents.count() == 6
    for r in written:  # each file on disk names its document
        root = ElementTree.fromstring((tmp_path / "out" / r["file"]).read_text())
        assert root.find(f".//{{{xml.LEXML}}}Identificacao").get("URN") == urns[r["doc_id"]]
    assert act["urn"].endswith(";1") and "portaria" in act["urn"]


def test_texts_as_a_stream(spark, tmp_path):
    from lavra.streaming import blocks

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_bytes("Art. 1º á".encode("latin-1"))
    q = blocks.route_batches(blocks.read_texts(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination()
    assert [r["route"] for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["generico"]


def test_profiles_command():
    out = subprocess.run([sys.executable, "-m", "lavra", "profiles"], cwd=ROOT, check=True, capture_output=True, text=True).stdout
    assert '"parecer"' in out and len(out.splitlines()) == 7


def test_a_cause_for_every_flat_document(spark):
    docs = {
        1: [("prosa simples que segue.", None), ("mais prosa.", None)], 2: [("texto", None), ("b) solta", None), ("fim", None)], 3: [("1. DOS FATOS", None), ("texto", None), ("fim.", None)],
        4: TREE, 5: [('"1. CITADO', None), ("texto", None)],
    }
    got = {r["doc_id"]: (r["flat_cause"], r["flat"], len(r["hs"]), r["rejected"]) for r in hierarchy.outlines(quotation.analyse(_blocks(spark, docs))).collect()}
    assert got[1] == ("no_candidate", True, 0, []) and got[4][:2] == ("", False) and got[5] == ("no_candidate", True, 0, [])
    assert got[2] == ("all_rejected", True, 0, [1]) and got[3][0] in ("all_rejected", "too_few_sections") and got[3][1]
    assert all((cause == "") == (not flat) for cause, flat, _, _ in got.values())


def test_validation_of_files(spark, tmp_path):
    """Valid, invalid, broken, blank and null XML against a small schema."""
    schema = tmp_path / "a.xsd"
    schema.write_text('<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema"><xs:element name="a"><xs:complexType><xs:sequence><xs:element name="b" type="xs:int"/></xs:sequence></xs:complexType></xs:element></xs:schema>')
    (tmp_path / "in").mkdir()
    for name, text in {"um": "<a><b>1</b></a>", "dois": "<a><b>x</b></a>", "tres": "<a><b>1</b>", "vazio": ""}.items():
        (tmp_path / "in" / f"{name}.xml").write_text(text)
    found = readers.read_xml(spark, str(tmp_path / "in"))
    got = {r["path"].rpartition("/")[2]: r["ok"] for r in xml.validate(found, {"a": str(schema)}).join(found, "doc_id").collect()}
    assert got == {"um.xml": True, "dois.xml": False, "tres.xml": False, "vazio.xml": False}
    null = spark.createDataFrame([(1, None)], "doc_id long, xml string")
    assert [r["ok"] for r in xml.validate(null, {"a": str(schema)}).collect()] == [False] and not xml.validate(null, {}).head()["ok"]


def test_seams(spark):
    run = "array<struct<text:string,bold:boolean,italic:boolean,sup:boolean,sub:boolean,href:string>>"
    r = lambda t, b=False: (t, b, False, False, False, None)
    df = spark.createDataFrame([([r(" a "), r(""), r(" b"), r("c", True), r("d ", True)],), ([],)], f"runs {run}")
    got = [[(x["text"], x["bold"]) for x in row["m"]] for row in df.select(seams.merged_runs(F.col("runs")).alias("m")).collect()]
    assert got == [[("a b", False), ("cd", True)], []]
    cut = df.select(seams.split_runs(F.col("runs"), F.lit(4)).alias("m")).collect()[0]["m"]
    assert "".join(x["text"] for x in cut) == " a  bcd "[4:]
    p = spark.range(1).select(seams.prompt("Q {excerpt} | {ctx} | {next}", F.lit("x" * 1300), F.lit(None).cast("string"), F.lit("b")).alias("p")).collect()[0]["p"]
    assert p == "Q " + "x" * 1199 + "… | (nenhum) | b"
    assert spark.range(1).select(F.lit("a").alias("key")).transform(lambda d: seams.verdicts(d, None)).collect()[0]["verdict"] is None


def test_fold_of_any_text(spark):
    import unicodedata

    texts = ["Ação nº 1…", "Aﬁ㎡ ½ ǅ ‼", "日本 Ⅷ", "", None]
    want = [None if t is None else unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode().lower() for t in texts]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", T.fold_any(F.col("t")).alias("f")).collect()
    assert [r["f"] for r in sorted(rows)] == want
