import random

from pyspark.sql import functions as F

from lavra.operators import parts, profiles

DOCS = {
    1: ("portaria", 1, ["28/12/2018", "PORTARIA MF nº 12", "Aprova o anexo.", "O MINISTRO DE ESTADO DA FAZENDA, no uso de suas atribuições,", "RESOLVE:", "Art. 1º Fica aprovado.",
                        "Brasília, 3 de maio de 2010.", "JOÃO DA SILVA", "Ministro da Fazenda", "Nota final", "ANEXO ÚNICO", "tabela", "ANEXO II", "outra"]),
    2: ("parecer", 0, ["PARECER nº 1", "Ementa: IMPOSTO.", "segue a ementa", "Assunto: consulta", "texto", "mais texto"]),
    3: ("ato_declaratorio", 0, ["ATO DECLARATÓRIO nº 3", "O ato não possui ementa. Ver íntegra", "Declara extinto.", "texto"]),
    4: ("servico", None, ["Declaração (DOI)", "Ementa: não", "Brasília, 3 de maio de 2010."]),
    5: ("portaria", 0, ["PORTARIA nº 5", "Vide outra", "Ementa: " + "a", *"bcdefghi", "O Procurador decide"]),
    6: ("generic", None, ["", "", ""]),
    7: ("jurisprudencia_generico", 0, ["SÚMULA nº 7", "EMENTA", "texto", "ANEXO I", "Brasília (DF), 3 de maio de 1990 (data do julgamento)."]),
    8: ("generic", None, ["primeira linha, sem rótulo", "ANEXO I", "x"]),
}


def test_parts_by_hand(spark):
    blocks = spark.createDataFrame([(d, i, t) for d, (_, _, ts) in DOCS.items() for i, t in enumerate(ts)], "doc_id long, idx long, text string")
    genres = spark.createDataFrame([(d, g) for d, (g, _, _) in DOCS.items()], "doc_id long, profile string")
    epigraphs = spark.createDataFrame([(d, e) for d, (_, e, _) in DOCS.items()], "doc_id long, epigraph_idx long")
    got: dict = {}
    for r in parts.parts(blocks, genres, epigraphs).collect():
        got.setdefault(r["doc_id"], {})[r["part"], r["ord"]] = (r["first_idx"], r["last_idx"])
    one = lambda d: {p: s for (p, n), s in got[d].items() if n == 1}
    assert got[1] == {
        ("front", 1): (0, 4), ("epigraph", 1): (1, 1), ("ementa", 1): (2, 2), ("preamble", 1): (3, 3), ("enacting", 1): (4, 4), ("body", 1): (5, 5), ("back", 1): (6, 9),
        ("signature", 1): (6, 8), ("trailing", 1): (9, 9), ("annex", 1): (10, 11), ("annex", 2): (12, 13),
    }
    assert one(2) == {"front": (0, 2), "epigraph": (0, 0), "ementa": (1, 2), "body": (3, 5)}
    assert one(3) == {"front": (0, 2), "epigraph": (0, 0), "enacting": (2, 2), "body": (3, 3)}  # the notice is no summary
    assert one(4) == {"body": (0, 2)}  # neither summaries nor closing lines in this genre
    assert one(5) == {"front": (0, 11), "epigraph": (0, 0), "ementa": (2, 9), "preamble": (11, 11)}  # eight blocks at most
    assert one(6) == {"body": (0, 2)}
    assert one(7) == {"front": (0, 0), "epigraph": (0, 0), "body": (1, 4)}  # a bare heading, no annexes here, a reported date
    assert one(8) == {"front": (0, 0), "ementa": (0, 0), "annex": (1, 2)}


def test_absorbed_against_sets(spark):
    rng, cases = random.Random(3), []
    for n in range(300):
        last = rng.randint(0, 12)
        spans = [tuple(sorted((rng.randint(0, last), rng.randint(0, last)))) for _ in range(rng.randint(0, 3))]
        free = set(range(last + 1)) - {i for a, b in spans for i in range(a, b + 1)}
        at = rng.choice([None, *sorted(free)])
        cases.append((n, None if at is None else (at, at), spans, 0, last, free))
    span = "struct<first_idx:long,last_idx:long>"
    rows = spark.createDataFrame([c[:5] for c in cases], f"n long, body {span}, claimed array<{span}>, first long, last long")
    got = {r["n"]: r["b"] and tuple(r["b"]) for r in rows.select("n", parts.absorbed(*map(F.col, ("body", "claimed", "first", "last"))).alias("b")).collect()}
    for n, body, _, _, _, free in cases:
        a = b = body[0] if body else min(free, default=None)
        while a is not None and body and a - 1 in free:
            a -= 1
        while b is not None and b + 1 in free:
            b += 1
        assert got[n] == (None if a is None else (a, b)), cases[n]


def test_court_cover_and_service(spark):
    texts = {
        1: ["Supremo Tribunal Federal", "06/06/2022 PLENÁRIO", "AÇÃO DIRETA DE INCONSTITUCIONALIDADE 5.422 DISTRITO FEDERAL", "RELATOR: X", "A C Ó R D Ã O", "texto"],
        2: ["06/06/2022 PRIMEIRA TURMA", "RECURSO EXTRAORDINÁRIO COM AGRAVO 12 RIO", "voto"],  # neither a court nor a decision
        3: ["06/06/2022 ASSEMBLEIA", "RECURSO ESPECIAL 9 SP", "voto"],  # not a deciding body
        4: ["SÚMULA nº 7", "RECURSO ESPECIAL 9 SP", "06/06/2022 PLENÁRIO"],  # the stamp comes first on a cover
        5: ["Sistema de Recolhimento Mensal Obrigatório (Carnê-Leão)", "texto"],
    }
    blocks = spark.createDataFrame([(d, i, t) for d, ts in texts.items() for i, t in enumerate(ts)], "doc_id long, idx int, text string")
    by = {r["doc_id"]: r for r in profiles.identity(blocks).collect()}
    assert by[1]["urn"] == "urn:lex:br:supremo.tribunal.federal;plenario:acordao;adi:2022-06-06;5422"
    assert (by[1]["authority_source"], by[1]["number_source"], by[1]["date_source"], by[1]["epigraph_idx"]) == ("cover", "cover", "cover", 2)
    assert (by[2]["doc_type"], by[2]["number"], by[2]["authority"], by[2]["date_source"]) == ("recurso.extraordinario", "12", None, "cover")
    assert by[3]["number_source"] != "cover" and by[4]["number"] == "7" and by[4]["number_source"] == "epigraph"
    assert (by[5]["profile"], by[5]["number"], by[5]["number_source"]) == ("servico", "carne.leao", "service-name")


def test_bodies_and_annexes_have_trees_of_their_own(spark, sf):
    from lavra.operators import hierarchy
    from lavra.plans import queries

    texts = {
        1: ("portaria", ["PORTARIA nº 1", "1. RELATÓRIO", "texto", "2. FUNDAMENTOS", "texto", "3. CONCLUSÃO", "ANEXO I", "1. ALFA", "x", "2. BETA", "y", "ANEXO II", "sem título"]),
        2: ("solucao_consulta", ["Relatório", "texto", "Fundamentos", "texto", "Conclusão", "texto"]),
        3: ("parecer", ["Relatório", "texto", "Fundamentos", "texto", "Conclusão", "texto"]),  # names that only the other genre declares
    }
    none = "null as style, cast(null as int) as outline_level, cast(null as int) as indent_direct, 0 as indent_effective"
    blocks = spark.createDataFrame([(d, i, t) for d, (_, ts) in texts.items() for i, t in enumerate(ts)], "doc_id long, idx long, text string").selectExpr("*", *none.split(", "))
    spans = {1: ((0, 0), (1, 5), [(6, 10), (11, 12)]), 2: (None, (0, 5), []), 3: (None, (0, 5), [])}
    span = "struct<first_idx:long,last_idx:long>"
    docs = spark.createDataFrame([(d, g, front, None, body, annexes) for d, (g, _) in texts.items() for front, body, annexes in [spans[d]]], f"doc_id long, profile string, front {span}, back {span}, body {span}, annexes array<{span}>")
    packed = blocks.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(*[c for c in blocks.columns if c != "doc_id"]))).alias("blocks"))
    docs = docs.join(packed, "doc_id")
    got = {(r["doc_id"], r["annex"]): ([b["idx"] for b in r["blocks"]], [h["heading"] for h in r["hs"]]) for r in hierarchy.forest(docs).collect()}
    assert got == {
        (1, 0): ([1, 2, 3, 4, 5], ["RELATÓRIO", "FUNDAMENTOS", "CONCLUSÃO"]), (1, 1): ([7, 8, 9, 10], ["ALFA", "BETA"]), (1, 2): ([12], []),
        (2, 0): ([0, 1, 2, 3, 4, 5], ["Relatório", "Fundamentos", "Conclusão"]), (3, 0): ([0, 1, 2, 3, 4, 5], []),
    }
    rows = queries.region_trees(spark, sf).collect()
    assert len({(r["doc_id"], r["annex"]) for r in rows}) == len(rows) and any(r["annex"] for r in rows)


def test_prose_headers_need_an_answer(spark):
    from lavra.operators import hierarchy, quotation, seams

    texts = ["abertura do texto", "DOS FATOS", "corpo do texto", "DO DIREITO", "mais texto", "1. NUMERADO"]
    none = "null as style, cast(null as int) as outline_level, cast(null as int) as indent_direct, 0 as indent_effective"
    blocks = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "doc_id long, idx long, text string").selectExpr("*", *none.split(", "))
    asked = [("abertura do texto", "", "DOS FATOS", "secao", 0.9), ("DOS FATOS", "abertura do texto", "corpo do texto", "secao", 0.9),
             ("DO DIREITO", "corpo do texto", "mais texto", "secao", 0.3), ("1. NUMERADO", "mais texto", "", "secao", 0.9)]
    filed = spark.createDataFrame(asked, "e string, b string, a string, verdict string, confidence double")
    answers = filed.select(seams.question_key(*map(F.lit, ("m", "heading")), F.col("e"), F.col("b"), F.col("a")).alias("key"), "verdict", "confidence")
    analysed = quotation.analyse(blocks)
    declared = lambda a: [r["idx"] for r in hierarchy.prose_headers(analysed, a, "m").where("declared").collect()]
    assert declared(answers.union(answers)) == [1]  # prose is never asked about, an unsure answer doesn't count, a label is none
    assert declared(None) == []
    assert [h["heading"] for h in hierarchy.headers(hierarchy.outlines(hierarchy.prose_headers(analysed, answers, "m"))).collect()] == ["DOS FATOS"]


def test_trees_and_bundles_work_out_parts_once(spark, sf):
    """What is read twice is kept: no plan goes back to the table, let alone on both sides of a join."""
    from lavra.plans import queries as plans

    for query in (plans.region_trees, plans.bundle_segments):
        plan = query(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
        assert "l_orderkey" not in plan and "RDD" in plan


def test_tests_of_a_line_run_once(spark):
    """The folded text of a line is worked out once for all that is searched in it."""
    blocks = spark.createDataFrame([(1, 0, "texto")], "doc_id long, idx long, text string")
    genres = spark.createDataFrame([(1, "generic", 0)], "doc_id long, profile string, epigraph_idx long")
    plan = parts.located(blocks, genres)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("translate(") < 15  # 30 when each test folded it again
