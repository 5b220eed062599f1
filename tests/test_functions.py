"""Literal cases of the label grammar, dates, names and readers."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from lavra.functions import labels as L
from lavra.functions import text as T
from lavra.operators import hierarchy, segments
from lavra.sources import readers

LABELS = {
    "1. x": ("numeric", [1]), "2.1 - y": ("numeric", [2, 1]), "2.3.1 - z": ("numeric", [2, 3, 1]), "4.1.": ("numeric", [4, 1]), "7 DECORRÊNCIA": ("numeric", [7]),
    "111 - NATUREZA JURÍDICA DO BENEFÍCIO ESPECIAL": ("numeric", [111]), "a)": ("alpha", [1]), "b)": ("alpha", [2]), "z)": ("alpha", [26]), "a) Serviços": ("alpha", [1]),
    "c. 1) coisa": ("compound", [3, 1]), "a. 2) outra coisa": ("compound", [1, 2]), "c) texto": ("roman", [100]), "IV - disposto": ("roman", [4]), "Art. 5º Todos": ("artigo", [5]),
    "“Art. 6º citado": ("artigo", [6]), "§ 2º O prazo": ("paragrafo", [2]), "Parágrafo único. O": ("paragrafo", [1]), "CAPÍTULO III DO PRAZO": ("capitulo", [3]),
    "Título único Das normas": ("titulo", [1]), "Lei nº 8.112": None, "12/05/2001": None, "123/2001 foi": None, "01. x": None, "1.234 reais": None, "2º critério": ("ordinal", [2]), "texto": None, "": None, "   ": None,
}


def test_labels(spark):
    rows = spark.createDataFrame([(t,) for t in LABELS], "t string").select("t", L.parse_label(F.col("t")).alias("l")).collect()
    assert {r["t"]: (r["l"]["kind"], r["l"]["value"]) if r["l"] else None for r in rows} == LABELS


def test_fold_matches_the_exact_one(spark):
    texts = ["São Paulo, 1º de março – art. 5ª…", "ÀÉÎÕÜ ç ñ ß", "½ ½", "plain", "", None]
    for r in spark.createDataFrame([(t,) for t in texts], "t string").select(T.fold(F.col("t")).alias("a"), T.fold_exact("t").alias("b")).collect():
        assert r["a"] == r["b"]


@pytest.mark.parametrize("text, want", [
    ("Brasília, 7 de junho de 2018", (2018, 6, 7)), ("em 31/12/1999.", (1999, 12, 31)), ("2001-02-03", (2001, 2, 3)), ("Lei de 1990", (1990, None, None)), ("1 de foo de 2001", (2001, None, None)), ("nada", None),
])
def test_dates(spark, text, want):
    d = spark.createDataFrame([(text,)], "t string").select(T.pt_date(F.col("t")).alias("d")).first()["d"]
    assert (tuple(d) if d else None) == want


def test_urn(spark):
    row = spark.range(1).select(T.build_urn(F.lit("br"), F.lit("ministerio.fazenda"), F.lit("portaria"), F.struct(F.lit(2018).alias("year"), F.lit(6).alias("month"), F.lit(7).alias("day")), F.lit("277")).alias("u")).select("u", T.parse_urn(F.col("u")).alias("p")).first()
    assert row["u"] == "urn:lex:br:ministerio.fazenda:portaria:2018-06-07;277" and row["p"]["number"] == "277"


def test_html_walk():
    items = readers.html_items('<html><head><title>t</title></head><body><h2>Head</h2><p style="margin-left:36pt">one<br>two <del>gone</del></p><ul><li>a<li>b</ul><table><tr><td>x</td><td>y</td></tr></table><p></p>')
    assert [(x["kind"], x["text"], x["outline_level"], x["ilvl"]) for x in items] == [
        ("para", "Head", 1, None), ("para", "one", None, None), ("para", "two", None, None), ("para", "a", None, 0), ("para", "b", None, 0), ("table", "x y", None, None), ("para", "", None, None),
    ]
    assert items[1]["indent_effective"] == 720 and readers.html_items("") == []


def docx(body, styles=""):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
        z.writestr("word/styles.xml", f"<w:styles {w}>{styles}</w:styles>")
    return out.getvalue()


def test_docx_and_errors(spark):
    good = docx(
        '<w:p><w:pPr><w:pStyle w:val="B"/></w:pPr><w:r><w:t>one</w:t><w:br/><w:t>two</w:t></w:r><w:r><w:rPr><w:strike/></w:rPr><w:t>struck</w:t></w:r></w:p>'
        "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>x</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>y</w:t></w:r></w:p></w:tc></w:tr></w:tbl>",
        '<w:style w:styleId="A"><w:name w:val="heading 1"/><w:basedOn w:val="B"/><w:pPr><w:ind w:left="300"/><w:outlineLvl w:val="0"/></w:pPr></w:style><w:style w:styleId="B"><w:name w:val="mine"/><w:basedOn w:val="A"/></w:style>',
    )
    rows = readers.docx_blocks(spark.createDataFrame([(1, bytearray(good)), (2, bytearray(b"junk")), (3, bytearray(good[:80]))], "doc_id long, content binary")).collect()
    got = [(r["text"], r["style"], r["indent_effective"], r["outline_level"]) for r in rows if r["doc_id"] == 1]
    assert got == [("one", "mine", 300, 0), ("two", "mine", 300, 0), ("x", None, 0, None), ("y", None, 0, None)]
    assert all(r["error"] for r in rows if r["doc_id"] != 1) and {r["doc_id"] for r in rows} == {1, 2, 3}


def test_txt_blocks_and_json_round_trip(spark):
    docs = spark.createDataFrame([(1, "  a\nb\r\n\r\n\tc\n \n"), (2, ""), (3, None)], "doc_id long, text string")
    blocks = readers.txt_blocks(docs)
    assert [(r["doc_id"], r["idx"], r["text"], r["indent_effective"]) for r in blocks.orderBy("doc_id", "idx").collect()] == [(1, 0, "a b", 360), (1, 1, "c", 720)]
    back = readers.from_styled_json(readers.styled_json(blocks))
    assert sorted(map(str, back.select("doc_id", "idx", "text", "indent_direct").collect())) == sorted(map(str, blocks.select("doc_id", "idx", "text", "indent_direct").collect()))


def row(idx, kind=None, value=(), level=None, text="x", rest=""):
    form = "style" if level is not None else ("top" if len(value) == 1 else "sub") if kind == "numeric" else "series"
    heading = text if form == "style" else None
    return {"pos": idx, "idx": idx, "form": form, "kind": kind, "series": kind, "value": list(value), "level": level, "heading": heading, "rest": rest, "label": None, "numbered": any(c.isdigit() for c in text)}


def test_unify_levels():
    tree = hierarchy.unify([row(0, "numeric", [1]), row(1, "numeric", [2]), row(2, "numeric", [2, 1]), row(3, "roman", [1]), row(4, "roman", [2]), row(5, "numeric", [3]), row(6, "numeric", [9, 1]), row(7, "alpha", [1])])
    assert [(r["idx"], r["depth"]) for r in tree] == [(0, 1), (1, 1), (2, 2), (3, 3), (4, 3), (5, 1)]  # an orphan and a solitary label go
    assert hierarchy.unify([row(0, "numeric", [1])]) == []  # one number is no series
    styled = hierarchy.unify([row(0, level=3, text="1 a"), row(1, level=5, text="b"), row(2, level=3, text="2 c")])
    assert [r["depth"] for r in styled] == [1, 2, 1]
    run = hierarchy.unify([row(i, level=0, text=t) for i, t in enumerate(("1 a", "b", "2 c", "3 d"))])
    assert [r["depth"] for r in run] == [1, 2, 1, 1]


def test_references_keep_the_first_of_overlapping(spark):
    refs = [(5, 9, "u1"), (0, 6, "u2"), (0, 3, "u3"), (6, 8, "u4"), (9, 99, "u5"), (3, 3, "u6"), (1, 2, "")]
    df = spark.createDataFrame([(refs,)], "r array<struct<start:int,end:int,urn:string>>")
    assert [tuple(x) for x in df.select(segments.usable_references(F.col("r"), F.lit(20)).alias("k")).first()["k"]] == [(0, 6, "u2"), (6, 8, "u4")]
