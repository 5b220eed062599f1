"""A legal-shaped corpus derived from lineitem, in SQL both engines run as it stands.

One document per order, one block per line; every label kind, quotation cue, closing line and
annex marker occurs. Line keys aren't unique, so blocks are ordered by all four columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ROMAN = "CASE l_linenumber WHEN 1 THEN 'I' WHEN 2 THEN 'II' WHEN 3 THEN 'III' WHEN 4 THEN 'IV' WHEN 5 THEN 'V' WHEN 6 THEN 'VI' ELSE 'VII' END"
FORMS = (
    "'Art. ' || (l_suppkey % 9 + 1) || ' Texto do artigo citado'",
    "(idx + 1) || '. RELATÓRIO'",
    "'\"Art. ' || l_linenumber || ' citado.'",
    "'Lei nº ' || l_partkey || ', de 1990:'",
    "'. . . . . .'",
    "'Trata-se de processo em que se discute a matéria de fato e de direito.'",
    f"{ROMAN} || ' - primeira hipótese'",
    "substr('abcdefg', l_linenumber, 1) || ') alínea do caso'",
    "'§ ' || l_linenumber || 'º O disposto neste artigo não se aplica.'",
    f"'Capítulo ' || {ROMAN} || ' Disposições gerais'",
    "(idx + 1) || '.' || l_linenumber || ' DECORRÊNCIA'",
    f"'ANEXO ' || {ROMAN}",
    "'Brasília, ' || (1 + l_suppkey % 28) || ' de março de ' || (1990 + l_partkey % 30) || '.'",
    "'JOÃO DA SILVA'",
    "'Procurador-Geral da Fazenda Nacional'",
    "'PARECER PGFN/CRJ/Nº ' || l_partkey || '/2001'",
    "'Item nº ' || l_linenumber",
    "(l_suppkey % 9 + 1) || 'º critério de apuração'",
    "'Ementa: IMPOSTO SOBRE A RENDA. ISENÇÃO.'",
    "'Lei nº 7.713/1988, art. 6º, dispõe sobre o caso'",
)
TEXT = "CASE WHEN doc_id % 4 = 0 THEN 'Art. ' || (idx + 1) || 'º Fica aprovado o item ' || l_partkey || '.' " + " ".join(
    f"WHEN (l_partkey + l_linenumber) % {len(FORMS)} = {i} THEN {f}" for i, f in enumerate(FORMS)
) + " END"
INDENT = "CASE WHEN l_quantity > 40 AND doc_id % 4 <> 0 THEN 720 ELSE 0 END"
PLACED = """SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS idx,
  l_linenumber, l_partkey, l_suppkey, l_quantity FROM lineitem"""
LEGAL = f"SELECT doc_id, CAST(idx AS BIGINT) AS idx, {INDENT} AS indent, {TEXT} AS text FROM ({PLACED}) placed"


def legal_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus as blocks: LEGAL, but keyed by doc_id from the start, so that what is dealt by it isn't dealt again."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").withColumnRenamed("l_orderkey", "doc_id")
    # by number, so that few bytes a line don't make few tasks: what follows costs far more than reading them
    lines = lines.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id")
    order = Window.partitionBy("doc_id").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    placed = lines.withColumn("idx", F.row_number().over(order) - 1)
    rows = placed.selectExpr("doc_id", "CAST(idx AS BIGINT) AS idx", f"{INDENT} AS indent", f"{TEXT} AS text")
    none = F.lit(None)
    return rows.select(
        "doc_id", "idx", F.lit("para").alias("kind"), "text", none.cast("string").alias("style"), none.cast("int").alias("outline_level"), none.cast("string").alias("num_id"),
        none.cast("int").alias("ilvl"), F.nullif("indent", F.lit(0)).alias("indent_direct"), F.col("indent").alias("indent_effective"),
    )


def page_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.readers import html_blocks

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return html_blocks(pages.select(F.col("page_id").alias("doc_id"), F.col("html").alias("content")))
