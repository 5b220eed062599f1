"""Documents in: plain text, HTML and DOCX to one table of blocks, and the sinks.

Blocks: doc_id, idx, kind (para / table), text, style, outline_level, num_id, ilvl, indent_direct,
indent_effective. Plain text is read by columns alone; HTML and DOCX by one Arrow pass each.
A file that can't be read becomes a row with ``error``, not an exception.
"""

from __future__ import annotations

import html.parser
import io
import re
import unicodedata
import zipfile
from collections.abc import Iterable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.seams import merged_runs
from .files import read_files

BLOCK = "kind string, text string, style string, outline_level int, num_id string, ilvl int, indent_direct int, indent_effective int"
TWIPS_PER_BLANK, TAB = 180, 4
LAYOUT_WINDOW = 12
FRAME = 2048  # paragraphs with runs handed over at once
SUFFIXES = ("docx", "html", "htm", "txt")
ITEM = {"kind": "para", "text": "", "style": None, "outline_level": None, "num_id": None, "ilvl": None, "indent_direct": None, "indent_effective": 0}


def clean(text: str) -> str:
    """NFC, blanks of every kind to one space."""
    return re.sub(r"\s+", " ", unicodedata.normalize("NFC", text)).strip()


@F.pandas_udf(T.StringType())
def decoded(content: pd.Series) -> pd.Series:
    """The text of a file's bytes; whatever they are, there is one."""
    return content.map(lambda data: None if data is None else decode(bytes(data)))


def txt_blocks(docs: DataFrame) -> DataFrame:
    """doc_id, text to blocks: paragraphs are parted by blank lines, their lines joined by a space."""
    lines = F.regexp_replace("text", "\r\n?", "\n")
    paras = docs.select("doc_id", F.posexplode(F.filter(F.split(lines, r"\n(?:[ \t\x0B\f]*\n)+"), lambda p: F.trim(F.regexp_replace(p, r"\s+", " ")) != "")).alias("idx", "raw"))
    first = F.regexp_replace(F.regexp_replace("raw", "^\n+", ""), "\t", " " * TAB)
    indent = F.length(F.regexp_extract(first, "^( *)", 1)) * TWIPS_PER_BLANK
    none = F.lit(None)
    return paras.select(
        "doc_id", F.col("idx").cast("long").alias("idx"), F.lit("para").alias("kind"), F.trim(F.regexp_replace("raw", r"(?U)\s+", " ")).alias("text"),
        none.cast("string").alias("style"), none.cast("int").alias("outline_level"), none.cast("string").alias("num_id"), none.cast("int").alias("ilvl"),
        F.nullif(indent, F.lit(0)).alias("indent_direct"), indent.alias("indent_effective"),
    )


_UNITS = {"pt": 20.0, "": 20.0, "pc": 240.0, "in": 1440.0, "cm": 1440 / 2.54, "mm": 144 / 2.54, "px": 15.0, "q": 36 / 2.54}
_HIDDEN = {"script", "style", "head", "noscript", "template", "title"}
_BLOCKS = {"p", "div", "section", "article", "header", "footer", "main", "nav", "aside", "blockquote", "pre", "address", "figure", "figcaption", "dl", "dt", "dd", "body", "html", "center", "form", "fieldset"}
_VOID = {"br", "hr", "img", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr"}
# The mark an inline element sets.
_INLINE = {"b": "bold", "strong": "bold", "i": "italic", "em": "italic", "cite": "italic", "dfn": "italic", "var": "italic", "sup": "sup", "sub": "sub", "a": "href"}
MARKS = ("bold", "italic", "sup", "sub")
RUNS = "array<struct<text:string,bold:boolean,italic:boolean,sup:boolean,sub:boolean,href:string>>"


def css_indent(style: str | None) -> int | None:
    total, found = 0.0, False
    for name, value in re.findall(r"([\w-]+)\s*:\s*([^;]+)", style or ""):
        m = re.fullmatch(r"(-?[0-9]*\.?[0-9]+)\s*([a-z]*)", value.strip().lower())
        if name.lower() in ("margin-left", "padding-left", "text-indent") and m and m[2] in _UNITS:
            total, found = total + float(m[1]) * _UNITS[m[2]], True
    return round(total) if found else None


class _Html(html.parser.HTMLParser):
    """One walk: block tags end a paragraph, headings carry their level, lists their number and depth, a table is one block."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.text, self.lists, self.n_lists = [], [], [], 0
        self.hidden = self.struck = self.table = 0
        self.now: dict = {}
        self.empty_ok = False

    def flush(self):
        text = clean("".join(self.text))
        if text or self.empty_ok:
            self.out.append({**ITEM, **self.now, "text": text})
        self.text, self.empty_ok = [], False

    def handle_starttag(self, tag, attrs):
        if tag in _HIDDEN:
            self.hidden += 1
        elif self.hidden:
            return
        elif tag in ("s", "strike", "del"):
            self.struck += 1
        elif tag == "table":
            if not self.table:
                self.flush()
            self.table += 1
        elif self.table:
            if tag in ("tr", "td", "th", "p", "br"):
                self.text.append(" ")
        elif tag == "br":
            self.flush()
        elif tag in ("ol", "ul"):
            self.flush()
            self.n_lists += 1
            self.lists.append(f"{tag}{self.n_lists}")
        elif tag in _BLOCKS or tag == "li" or re.fullmatch("h[1-6]", tag):
            self.flush()
            indent = css_indent(dict(attrs).get("style"))
            self.now = {"indent_direct": indent, "indent_effective": indent or 0}
            if tag[0] == "h" and tag[1:].isdigit():
                self.now |= {"style": f"Heading {tag[1]}", "outline_level": int(tag[1]) - 1}
            if self.lists and tag in ("li", "p"):
                self.now |= {"num_id": self.lists[-1], "ilvl": len(self.lists) - 1}
            self.empty_ok = tag in ("p", "li")

    def handle_endtag(self, tag):
        if tag in _HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        elif self.hidden:
            return
        elif tag in ("s", "strike", "del"):
            self.struck = max(0, self.struck - 1)
        elif tag == "table" and self.table:
            self.table -= 1
            if not self.table:
                self.out.append({**ITEM, "kind": "table", "text": clean("".join(self.text))})
                self.text, self.empty_ok = [], False
        elif not self.table and (tag in _BLOCKS or tag in ("li", "ol", "ul") or re.fullmatch("h[1-6]", tag)):
            self.flush()
            self.now = {}
            if tag in ("ol", "ul") and self.lists:
                self.lists.pop()

    def handle_data(self, data):
        if not self.hidden and not self.struck:
            self.text.append(data)


class _MarkedHtml(_Html):
    """The same walk, each paragraph with its runs: what its text looked like, piece by piece."""

    def __init__(self):
        super().__init__()
        self.inline: list[tuple[str, str | None]] = []
        self.pieces: list[dict] = []

    def flush(self):
        pieces, self.pieces, n = self.pieces, [], len(self.out)
        super().flush()
        if len(self.out) > n:
            self.out[-1]["runs"] = pieces

    def handle_starttag(self, tag, attrs):
        super().handle_starttag(tag, attrs)
        if tag in _INLINE:
            self.inline.append((tag, dict(attrs).get("href")))

    def handle_endtag(self, tag):
        super().handle_endtag(tag)
        at = next((i for i in reversed(range(len(self.inline))) if self.inline[i][0] == tag), None)
        if at is not None:
            del self.inline[at]

    def handle_data(self, data):
        n = len(self.text)
        super().handle_data(data)
        if len(self.text) > n and not self.table:
            marks = {_INLINE[t] for t, _ in self.inline}
            href = next((h for t, h in reversed(self.inline) if t == "a" and h), None)
            self.pieces.append({"text": unicodedata.normalize("NFC", data), **{m: m in marks for m in MARKS}, "href": href})


def html_items(markup: str | bytes | None, walk: type[_Html] = _Html) -> list[dict]:
    parser = walk()
    parser.feed(decode(markup) if isinstance(markup, bytes) else markup or "")
    parser.close()
    parser.flush()
    return parser.out


def decode(data: bytes) -> str:
    """By the charset declared in the first 4,096 bytes, else UTF-8, else Latin-1."""
    m = re.search(rb"""charset\s*=\s*["']?([\w.:-]+)|encoding\s*=\s*["']([\w.:-]+)""", data[:4096], re.I)
    for name in ((m[1] or m[2]).decode("ascii", "ignore") if m else "utf-8", "utf-8"):
        try:
            return data.decode(name)
        except (LookupError, UnicodeDecodeError):
            continue
    return data.decode("latin-1")


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def _value(element, path: str, name: str = "val") -> str | None:
    found = element.find(path.replace("w:", _W)) if element is not None else None
    return None if found is None else found.get(_W + name)


def _number(x: str | None) -> int | None:
    return int(x) if x is not None and re.fullmatch(r"-?\d+", x) else None


def _indent(ppr) -> int | None:
    return next((n for k in ("left", "start") if (n := _number(_value(ppr, "w:ind", k))) is not None), None)


class _Styles:
    """Indent and outline level by style, along ``basedOn`` (each style once, so that cycles end); names aren't inherited."""

    def __init__(self, root):
        self.by = {s.get(_W + "styleId"): s for s in root.iter(_W + "style")} if root is not None else {}
        defaults = root.find(f"{_W}docDefaults/{_W}pPrDefault/{_W}pPr") if root is not None else None
        self.base = _indent(defaults)

    def name(self, style_id: str | None) -> str | None:
        return _value(self.by.get(style_id), "w:name")

    def inherited(self, style_id: str | None, read):
        seen = set()
        while style_id in self.by and style_id not in seen:
            seen.add(style_id)
            style = self.by[style_id]
            found = read(style.find(_W + "pPr"))
            if found is not None:
                return found
            style_id = _value(style, "w:basedOn")
        return None


def _on(props, *names: str) -> bool:
    return props is not None and any((e := props.find(_W + k)) is not None and e.get(_W + "val") not in ("0", "false", "off") for k in names)


def _character(x) -> str:
    """What an element of a run adds to its text."""
    tag = x.tag.removeprefix(_W)
    if tag == "t":
        return x.text or ""
    if tag == "sym" and x.get(_W + "char"):
        return chr(int(x.get(_W + "char"), 16))
    return {"tab": " ", "noBreakHyphen": "-"}.get(tag, "")


def _run_lines(paragraph, targets: dict[str, str]) -> list[list[dict]]:
    """The runs of a paragraph, parted at line breaks; struck and deleted runs go. ``targets``: links by relationship."""
    links = {run: targets.get(h.get(_R + "id")) or (f"#{h.get(_W + 'anchor')}" if h.get(_W + "anchor") else None) for h in paragraph.iter(_W + "hyperlink") for run in h.iter(_W + "r")}
    lines: list[list[dict]] = [[]]
    for run in paragraph.iter(_W + "r"):
        props = run.find(_W + "rPr")
        if _on(props, "strike", "dstrike"):
            continue
        raised = _value(props, "w:vertAlign")
        marks = {"bold": _on(props, "b"), "italic": _on(props, "i"), "sup": raised == "superscript", "sub": raised == "subscript", "href": links.get(run)}
        text = ""
        for x in run:
            text += _character(x)
            if x.tag == _W + "cr" or (x.tag == _W + "br" and x.get(_W + "type") in (None, "textWrapping")):
                lines[-1].append({"text": text, **marks})
                lines.append([])
                text = ""
        lines[-1].append({"text": text, **marks})
    return [[{**r, "text": unicodedata.normalize("NFC", r["text"])} for r in line if r["text"]] for line in lines]


def _line(runs: list[dict]) -> str:
    return clean("".join(r["text"] for r in runs))


def _lines(paragraph) -> list[str]:
    return [_line(runs) for runs in _run_lines(paragraph, {})]


def _targets(archive: zipfile.ZipFile) -> dict[str, str]:
    name = "word/_rels/document.xml.rels"
    return {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(archive.read(name))} if name in archive.namelist() else {}


def docx_items(data: bytes) -> list[dict]:
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        body = ElementTree.fromstring(archive.read("word/document.xml")).find(_W + "body")
        styles = _Styles(ElementTree.fromstring(archive.read("word/styles.xml")) if "word/styles.xml" in archive.namelist() else None)
        targets = _targets(archive)
    out = []
    for element in body if body is not None else ():
        if element.tag == _W + "tbl":
            cells = [" ".join(t for p in c.iter(_W + "p") for t in _lines(p) if t) for c in element.iter(_W + "tc")]
            out.append({**ITEM, "kind": "table", "text": " ".join(c for c in cells if c), "rows": len(element.findall(_W + "tr")), "cells": cells})
        elif element.tag in (_W + "p", _W + "sdt"):
            for p in [element] if element.tag == _W + "p" else element.iter(_W + "p"):
                ppr = p.find(_W + "pPr")
                style = _value(ppr, "w:pStyle")
                direct, outline = _indent(ppr), _number(_value(ppr, "w:outlineLvl"))
                inherited = styles.inherited(style, _indent)
                outline = outline if outline is not None else styles.inherited(style, lambda e: _number(_value(e, "w:outlineLvl")))
                effective = next((x for x in (direct, inherited, styles.base) if x is not None), 0)
                for runs in _run_lines(p, targets):
                    out.append({
                        **ITEM, "text": _line(runs), "runs": runs, "style": styles.name(style), "outline_level": outline if outline is not None and outline < 9 else None,
                        "num_id": _value(ppr, "w:numPr/w:numId"), "ilvl": _number(_value(ppr, "w:numPr/w:ilvl")), "indent_direct": direct, "indent_effective": effective,
                    })
    return out


def unwrap_layout(items: list[dict], window: int = LAYOUT_WINDOW) -> list[dict]:
    """Tables of one row among the first blocks are layout: a paragraph for each cell that isn't empty."""
    out = []
    for i, x in enumerate(items):
        if i < window and x["kind"] == "table" and x.get("rows") == 1:
            out += [{**ITEM, "text": c} for c in x["cells"] if c]
        else:
            out.append(x)
    return out


def _read_by(kind: str, parse):
    schema = f"doc_id long, idx long, {BLOCK}, error string"
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc, content in zip(pdf["doc_id"], pdf["content"], strict=True):
                try:
                    items = parse(content)
                    rows += [{"doc_id": doc, "idx": i, "error": None, **{k: v for k, v in x.items() if k in names}} for i, x in enumerate(items)]
                except Exception as error:  # any malformed file; it is reported, the run goes on
                    rows.append({"doc_id": doc, "idx": None, "error": f"{kind}: {type(error).__name__}: {error}"})
            frame = pd.DataFrame(rows, columns=names)
            for c in ("doc_id", "idx", "outline_level", "ilvl", "indent_direct", "indent_effective"):
                frame[c] = frame[c].astype("Int64")
            for c in ("kind", "text", "style", "num_id", "error"):
                frame[c] = frame[c].astype(object).where(frame[c].notna(), None)
            yield frame

    return lambda df: df.mapInPandas(run, schema)


def html_blocks(pages: DataFrame) -> DataFrame:
    """doc_id, content (text or bytes) to blocks with an error column."""
    return _read_by("html", html_items)(pages.select("doc_id", "content"))


def docx_blocks(files: DataFrame) -> DataFrame:
    """doc_id, content (bytes) to blocks with an error column; layout tables are unwrapped."""
    return _read_by("docx", lambda data: unwrap_layout(docx_items(bytes(data))))(files.select("doc_id", "content"))


def run_frames(files: Iterable[tuple], parse) -> Iterator[pd.DataFrame]:
    """doc_id, idx, runs of (doc_id, content), a frame whenever FRAME paragraphs have come together, not one of all files."""
    rows = []
    for doc, content in files:
        try:
            rows += [(doc, i, x["runs"]) for i, x in enumerate(parse(content)) if x.get("runs")]
        except Exception:  # reported by the blocks of the same file
            continue
        if len(rows) >= FRAME:
            yield pd.DataFrame(rows, columns=["doc_id", "idx", "runs"])
            rows = []
    yield pd.DataFrame(rows, columns=["doc_id", "idx", "runs"])


def _runs_by(kind: str, parse):
    """doc_id, idx, runs of the paragraphs parsed, runs of one formatting merged; a file that can't be read has none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield from run_frames(zip(pdf["doc_id"], pdf["content"], strict=True), parse)

    return lambda df: df.mapInPandas(run, f"doc_id long, idx long, runs {RUNS}").withColumn("runs", merged_runs(F.col("runs")))


def html_runs(pages: DataFrame) -> DataFrame:
    """The runs of :func:`html_blocks`, by doc_id and idx; tables have none."""
    return _runs_by("html", lambda x: html_items(x, _MarkedHtml))(pages.select("doc_id", "content"))


def docx_runs(files: DataFrame) -> DataFrame:
    """The runs of :func:`docx_blocks`, by doc_id and idx; tables have none."""
    return _runs_by("docx", lambda data: unwrap_layout(docx_items(bytes(data))))(files.select("doc_id", "content"))


def txt_items(data: bytes) -> list[dict]:
    """The blocks :func:`txt_blocks` gives, of a file's bytes."""
    out = []
    for raw in re.split(r"\n(?:[ \t\x0B\f]*\n)+", re.sub("\r\n?", "\n", decode(data))):
        if text := " ".join(raw.split()):
            indent = len(re.match(" *", raw.lstrip("\n").replace("\t", " " * TAB))[0]) * TWIPS_PER_BLANK
            out.append({**ITEM, "text": text, "indent_direct": indent or None, "indent_effective": indent})
    return out


PARSERS = {"txt": txt_items, "html": html_items, "htm": html_items, "docx": lambda data: unwrap_layout(docx_items(data))}


def corpus_files(spark: SparkSession, *paths: str, limit: int | None = None) -> DataFrame:
    """doc_id, path, suffix, content, error of every file below the paths, once each; those of no bytes too.

    The id is a hash of the path; should two paths ever share one, both are rows with an error rather than one document.
    """
    rows = read_files(spark, *paths, limit=limit)
    error = F.coalesce("error", F.when(~F.col("suffix").isin(*SUFFIXES), F.concat(F.lit("unsupported format: "), F.col("suffix"))))
    return rows.withColumn("error", error).select("doc_id", "path", "suffix", "content", "error")


def read_corpus(spark: SparkSession, *paths: str, limit: int | None = None) -> DataFrame:
    """The blocks of all files, each parsed once, and one row without ``idx`` for every file, with its ``path`` and ``error`` if any."""
    names = [c.split()[0] for c in BLOCK.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc, path, suffix, content, error in zip(pdf["doc_id"], pdf["path"], pdf["suffix"], pdf["content"], pdf["error"], strict=True):
                items = []
                if error is None:
                    try:
                        items = PARSERS[suffix](bytes(content))
                    except Exception as problem:  # any malformed file; it is reported, the run goes on
                        error = f"{suffix}: {type(problem).__name__}: {problem}"
                rows.append({"doc_id": doc, "path": path, "error": error})
                rows += [{"doc_id": doc, "idx": i, **{k: v for k, v in x.items() if k in names}} for i, x in enumerate(items)]
            frame = pd.DataFrame(rows, columns=["doc_id", "idx", *names, "path", "error"])
            for c in ("doc_id", "idx", "outline_level", "ilvl", "indent_direct", "indent_effective"):
                frame[c] = frame[c].astype("Int64")
            for c in ("kind", "text", "style", "num_id", "path", "error"):
                frame[c] = frame[c].astype(object).where(frame[c].notna(), None)
            yield frame

    return corpus_files(spark, *paths, limit=limit).mapInPandas(run, f"doc_id long, idx long, {BLOCK}, path string, error string")


def read_xml(spark: SparkSession, *paths: str, limit: int | None = None) -> DataFrame:
    """doc_id, path, xml of the files below the paths; one that can't be read has none."""
    return read_files(spark, *paths, limit=limit).select("doc_id", "path", F.col("content").cast("string").alias("xml"))


def styled_json(blocks: DataFrame) -> DataFrame:
    """doc_id, json: a document's blocks in order, absent fields left out."""
    item = F.struct("idx", *[F.col(c.split()[0]) for c in BLOCK.split(", ")])
    packed = blocks.groupBy("doc_id").agg(F.array_sort(F.collect_list(item)).alias("blocks"))
    return packed.select("doc_id", F.to_json(F.struct("blocks"), {"ignoreNullFields": "true"}).alias("json"))


def from_styled_json(rows: DataFrame) -> DataFrame:
    """The inverse of :func:`styled_json`."""
    schema = f"blocks array<struct<idx:long,{','.join(':'.join(c.split()) for c in BLOCK.split(', '))}>>"
    return rows.select("doc_id", F.explode(F.from_json("json", schema)["blocks"]).alias("b")).select("doc_id", "b.*")


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.option("header", True).option("escape", '"').csv(path)


def write_jsonl(rows: DataFrame, path: str) -> None:
    rows.write.json(path)


def write_xml(documents: DataFrame, path: str) -> DataFrame:
    """Writes doc_id, fragment, urn, xml as one text file each, in the task that holds it; gives doc_id, fragment, file.

    ``path`` is a folder all executors share. Files are replaced whole, so a task that is repeated does no harm.
    """
    import os

    def run(batches):
        os.makedirs(path, exist_ok=True)
        for pdf in batches:
            for name, xml in zip(pdf["file"], pdf["xml"], strict=True):
                part = os.path.join(path, f".{name}.{os.getpid()}")
                with open(part, "w", encoding="utf-8") as out:
                    out.write(xml + "\n")
                os.replace(part, os.path.join(path, name))
            yield pdf[["doc_id", "fragment", "file"]]

    return file_names(documents).select("doc_id", "fragment", "file", "xml").mapInPandas(run, "doc_id long, fragment int, file string")


SHARES = 256  # parts that the documents of one name are dealt to


def file_names(documents: DataFrame) -> DataFrame:
    """Adds ``file``: the name's slug, and ``_2``, ``_3`` ... where documents share one; annexes are named with their document.

    A name may be that of most documents, so each name's documents are dealt to shares by a hash of their id, counted by share
    and numbered within it: a task sees a share of a name, or the counts of one.
    """
    rows = documents if "fragment" in documents.columns else documents.withColumn("fragment", F.lit(0))
    slug = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_replace("urn", "!anexo[0-9]+$", "")), "^urn:lex:", ""), "[^a-z0-9]+", "-")
    rows = rows.withColumn("slug", slug).withColumn("share", F.pmod(F.xxhash64(F.lit("share"), "doc_id"), F.lit(SHARES)))
    counts = rows.where("fragment = 0").groupBy("slug", "share").agg(F.count("*").alias("n"))
    before = Window.partitionBy("slug").orderBy("share").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("slug", "share", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    n = F.col("before") + F.dense_rank().over(Window.partitionBy("slug", "share").orderBy("doc_id"))
    rows = rows.join(counts, ["slug", "share"]).withColumn("n", n)
    annex = F.when(F.col("fragment") > 0, F.concat(F.lit(".anexo"), F.col("fragment").cast("string"))).otherwise("")
    return rows.withColumn("file", F.concat("slug", F.when(F.col("n") > 1, F.concat(F.lit("_"), F.col("n").cast("string"))).otherwise(""), annex, F.lit(".xml"))).drop("slug", "share", "before", "n")
