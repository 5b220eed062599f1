"""Literal cases of marked-up text with references."""

from pyspark.sql import functions as F

from lavra.functions import text as T
from lavra.operators import rendering

RUNS = "array<struct<text:string,bold:boolean,italic:boolean,sup:boolean,sub:boolean,href:string>>"
REFS = "array<struct<start:int,end:int,urn:string>>"


def _run(text, bold=False, italic=False, href=None):
    return (text, bold, italic, False, False, href)


def test_render_inlines(spark):
    cases = [
        ([_run("a & b"), _run("c<d", True, True)], [], "a &amp; b<b><i>c&lt;d</i></b>"),
        ([_run("Lei 1, art. 2")], [(0, 5, "u:1"), (3, 9, "u:2")], '<Remissao xlink:href="u:1">Lei 1</Remissao>, art. 2'),
        ([_run("ver "), _run("Lei", True), _run(" 1 fim")], [(4, 9, "u")], 'ver <Remissao xlink:href="u"><b>Lei</b> 1</Remissao> fim'),
        ([_run("Lei", href="h"), _run(" 1")], [(0, 5, "u")], '<a xlink:href="h"><Remissao xlink:href="u">Lei</Remissao></a><Remissao xlink:href="u"> 1</Remissao>'),
        ([_run("x", href='q"')], [], '<a xlink:href="q&quot;">x</a>'),
        ([_run("")], [(0, 3, "u")], ""),
        ([], [], ""),
    ]
    df = spark.createDataFrame([(i, r, f) for i, (r, f, _) in enumerate(cases)], f"i int, runs {RUNS}, refs {REFS}")
    got = {r["i"]: r["x"] for r in df.select("i", rendering.render_inlines(F.col("runs"), F.col("refs")).alias("x")).collect()}
    assert [got[i] for i in range(len(cases))] == [want for _, _, want in cases]


def test_truncated_cuts_exactly(spark):
    rows = spark.createDataFrame([("ab  cd ef",), ("ab",)], "t string").select(T.truncated(F.col("t"), 4).alias("t")).collect()
    assert [r["t"] for r in rows] == ["ab …", "ab"]


def _docx(body: str) -> bytes:
    import io
    import zipfile

    space = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {space}><w:body>{body}</w:body></w:document>")
        z.writestr("word/_rels/document.xml.rels", '<Relationships><Relationship Id="r1" Target="http://x/?a&amp;b"/></Relationships>')
    return out.getvalue()


def test_runs_of_docx_and_html(spark):
    from lavra.sources import readers

    def run(text, marks=""):
        return f'<w:r><w:rPr>{marks}</w:rPr><w:t xml:space="preserve">{text}</w:t></w:r>'

    body = (
        "<w:p>" + run("Lei ", "<w:b/>") + run(" nº", "<w:b w:val='1'/>") + run(" 1", "<w:b w:val='0'/><w:i/>") + run("gone", "<w:strike/>") + run("a", '<w:vertAlign w:val="superscript"/>') + "</w:p>"
        + '<w:p><w:hyperlink r:id="r1">' + run("link") + '</w:hyperlink><w:hyperlink w:anchor="n1">' + run("note") + "</w:hyperlink><w:r><w:br/><w:t>next</w:t></w:r></w:p>"
        + "<w:tbl><w:tr><w:tc><w:p>" + run("cell") + "</w:p></w:tc></w:tr><w:tr/></w:tbl>"
    )
    files = spark.createDataFrame([(1, bytearray(_docx(body))), (2, bytearray(b"no archive"))], "doc_id long, content binary")
    got = {(r["doc_id"], r["idx"]): r["xml"] for r in readers.docx_runs(files).select("doc_id", "idx", rendering.render_inlines(F.col("runs")).alias("xml")).collect()}
    assert got == {
        (1, 0): "<b>Lei nº</b><i> 1</i><sup>a</sup>", (1, 1): '<a xlink:href="http://x/?a&amp;b">link</a><a xlink:href="#n1">note</a>', (1, 2): "next",
    }
    html = "<body><p>A <b>bold <i>both</i></b> x<sup>2</sup></p><p><a href='#n'>see</a><s>gone</s></p><table><tr><td><b>t</b></td></tr></table><h1>H<script>no</script></h1></body>"
    pages = spark.createDataFrame([(7, html)], "doc_id long, content string")
    got = [r["xml"] for r in readers.html_runs(pages).orderBy("idx").select(rendering.render_inlines(F.col("runs")).alias("xml")).collect()]
    assert got == ["A <b>bold </b><b><i>both</i></b> x<sup>2</sup>", '<a xlink:href="#n">see</a>', "H"]


def test_runs_hold_the_text_of_their_blocks(spark, sf):
    from lavra.sources import readers

    pages = spark.read.parquet(f"{sf}/pages.parquet").select(F.col("page_id").alias("doc_id"), F.col("html").alias("content"))
    blocks = {(r["doc_id"], r["idx"]): r["text"] for r in readers.html_blocks(pages).where("kind = 'para' and text <> ''").collect()}
    runs = {(r["doc_id"], r["idx"]): readers.clean("".join(x["text"] for x in r["runs"])) for r in readers.html_runs(pages).collect()}
    assert blocks and {k: v for k, v in runs.items() if v} == blocks


def test_runs_are_handed_over_as_they_come():
    """A batch of many files makes many small frames, not one of all their paragraphs; files that can't be read have none."""
    from lavra.sources import readers

    def parse(n):
        return [{"runs": [n]}] * n + [{}]

    frames = list(readers.run_frames([(i, 1000) for i in range(30)] + [(99, None)], parse))
    assert max(map(len, frames)) < readers.FRAME + 1000 and sum(map(len, frames)) == 30_000
