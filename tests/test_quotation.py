"""Quotations cut where the next norm is named."""

from pyspark.sql import functions as F

from lavra.operators import quotation

LINES = [
    ("Transcrevem-se a Lei nº 7.713, de 1988, e outras:", False, None), ("a", True, "Lei 1"), ("b", True, None), ("c", True, "Lei 2"), ("d", True, None), ("e", True, "Lei 3"), ("f", True, "Lei 4"), ("g", True, None),
    ("prosa", False, None), ("h", True, None), ("i", True, "Lei 5"), ("prosa", False, "Lei 6"), ("j", True, None),
]


def test_quotations_by_hand(spark):
    rows = [(1, i, t, q, n) for i, (t, q, n) in enumerate(LINES)] + [(2, 0, "x", True, "Lei 7"), (2, 1, "y", True, None), (3, 0, "z", False, None)]
    df = spark.createDataFrame(rows, "doc_id long, idx long, text string, quoted boolean, norm string")
    got = [tuple(r) for r in quotation.islands(df).orderBy("doc_id", "run").collect()]
    assert got == [
        (1, 1, 1, 2, 2, 0, "Lei 1"), (1, 2, 3, 4, 2, 0, "Lei 2"), (1, 3, 5, 5, 1, 0, None), (1, 4, 6, 7, 2, 0, "Lei 4"),  # a head alone is a run without a norm
        (1, 5, 9, 9, 1, None, None), (1, 6, 10, 10, 1, None, None), (1, 7, 12, 12, 1, None, None), (2, 1, 0, 1, 2, None, "Lei 7"),
    ]
    held = quotation.numbered_runs(df).where(F.col("run").isNotNull() != F.col("quoted"))
    assert held.isEmpty()  # every quoted block has a run and no other has


def test_blocks_are_dealt_once(spark, sf):
    """From lines to routes the rows are keyed by document all along: two exchanges, one for the blocks and one for the bands' side."""
    from lavra.plans.queries import QUERIES

    plan = QUERIES["coverage_gate"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 2


ODD = ["", " ", "(...)", "[…]", " ( .. ) ", ". . . .", "·.…....", "a......", "a ......\x85", "a… ", "b(…)", "x)", "Lei 1:", "art. 3 -\x85", "diz “ art. 5", '"Art. 2º', "«art 9", " Lei 2, art. 3", "ſúmula 7, art. 1", "ſeção I x", "Seção I x", "S⁠eção II y", "Parte", "p", "Lei nº 8, de 1990, art. 2", "decreto-lei.", "a) b", "I - c", "Ato. 3"]


def test_first_characters_rule_out_no_match(spark):
    """What the first and last characters rule out, the patterns alone don't find either."""
    from lavra.functions import labels as L

    t = L.stripped(F.col("text"))
    alone = {
        "bracketed": (L.is_omissis(F.col("text")), (t != "") & (t.rlike(L.OMISSIS_BRACKETED) | t.rlike(L.OMISSIS))), "carries": (L.carries_omissis(F.col("text")), (t != "") & t.rlike(L.OMISSIS_TRAILING)),
        "number": (L.article_number(F.col("text")), F.nullif(F.regexp_extract(t, L.ARTICLE, 1), F.lit("")).try_cast("int")), "head": (L.quotation_head(F.col("text")), L._norm_head(t)),
        "names": (L.names_norm(F.col("text")), (t.rlike("[:–—-]$") | t.rlike("(?i)[\"“]\\s*art")) & (t.rlike(L.ARTICLE_REFERENCE) | L.fold(t).rlike(L.NORM))),
        "division": (F.coalesce(L.parse_label(F.col("text"))["kind"].isin(*L.DIVISIONS), F.lit(False)), F.coalesce(L._division(t, L.fold(t), F.lit(False)).isNotNull(), F.lit(False))),
    }
    df = spark.createDataFrame([(x,) for x in ODD], "text string")
    for name, (ours, plain) in alone.items():
        assert df.where(~ours.eqNullSafe(plain)).collect() == [], name
