"""Every registered query beside its SQL twin, and those without one against invariants."""

import importlib
import subprocess
import sys
from collections import Counter

import pytest

from lavra.plans import queries as plans
from lavra.plans.corpus import legal_blocks

from .compare import connect, differences
from .conftest import ROOT


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_against_sql(spark, con, sf, name):
    assert differences(spark, con, sf, plans.QUERIES[name], plans.ORACLES[name]) is None


def test_section_tree_invariants(spark, sf):
    rows = plans.section_tree(spark, sf).collect()
    assert rows
    by = {(r["doc_id"], r["idx"]): r for r in rows}
    assert len({(r["doc_id"], r["path"]) for r in rows}) == len(rows)  # paths are unique
    for r in rows:
        if r["parent_idx"] is None:
            assert "." not in r["path"]
        else:
            up = by[r["doc_id"], r["parent_idx"]]
            assert r["path"].rsplit(".", 1)[0] == up["path"] and up["depth"] < r["depth"] and up["idx"] < r["idx"]


def test_segments_conserve_text_and_name_each_row_once(spark, sf):
    rows = plans.segment_rows(spark, sf).collect()
    assert len({r["urn"] for r in rows}) == len(rows)
    assert all(r["id"].startswith("pp1_agr") for r in rows)
    words = {}
    for r in rows:
        words.setdefault(r["doc_id"], Counter()).update(" ".join(filter(None, (r["label"], r["heading"], r["text"]))).split())
    want = {}
    for b in legal_blocks(spark, sf).select("doc_id", "text").collect():
        want.setdefault(b["doc_id"], Counter()).update(b["text"].split())
    assert words == want


def test_html_blocks_have_no_errors(spark, sf):
    rows = plans.html_blocks(spark, sf).collect()
    assert rows and all(r["error"] is None for r in rows)
    assert any(r["outline_level"] == 0 for r in rows)


def test_the_rest_needs_no_corpus_operators():
    """As if their folders were gone: the entry still imports and offers the other queries."""
    code = (
        "import sys\n"
        "class Gone:\n"
        "    def find_spec(self, name, *a):\n"
        "        if name in ('corpus_pipeline', 'lavra.llm'): raise ModuleNotFoundError(name, name=name)\n"
        "sys.meta_path.insert(0, Gone())\n"
        "import __spark_entry__ as e\n"
        "assert 'route_counts' in e.queries() and not any(n.startswith('op') for n in e.queries())\n"
        "assert set(e.oracle_sql()) <= set(e.queries())\n"
    )
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_entry_imports_without_a_session():
    subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; e.queries(); e.oracle_sql()"], cwd=ROOT, check=True)


def test_entry(spark):
    entry = importlib.import_module("__spark_entry__")
    assert {r["route"] for r in entry.entry(spark).collect()} == {"norma", "generico"}
