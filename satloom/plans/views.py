"""Sequence relations derived from the supplied tables, in Spark and in SQL alike."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.tables import spread

LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
BASES = ("ACGT" * 7)[:26] * 2


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _parts(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Key and columns of parts, from which arrays and records grow."""
    return spread(_table(spark, sf_dir, "part").select("p_partkey", *columns), "p_partkey")


def _fold(text):
    return F.regexp_replace(F.translate(text, LETTERS, BASES), "[^ACGT]", "")


def _once(value: Column, of: Callable[[Column], Column]) -> Column:
    """``of`` of a value that lambdas in it use: as a column its whole expression would be computed for every element."""
    return F.transform(F.array(value), of)[0]


def dna_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with letters folded onto four bases."""
    return _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("array_ord"), _fold(F.coalesce("text", F.lit(""))).alias("seq"))


def dna_tandem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeats of a unit from the part's name and brand, a third of them with one inserted base."""
    unit = _fold(F.concat("p_name", "p_brand"))
    base = _parts(spark, sf_dir, "p_name", "p_brand").select("p_partkey", unit.alias("unit"))
    a = F.repeat("unit", (4 + F.col("p_partkey") % 40).cast("int"))
    k = (F.length("unit") * 3 + F.col("p_partkey") % 7).cast("int")
    parts = base.select("p_partkey", a.alias("a"), k.alias("k"))
    seq = F.concat(F.substring("a", F.lit(1), F.col("k")), F.when(F.col("p_partkey") % 3 == 0, "G").otherwise(""), F.substring("a", F.col("k") + 1, F.length("a")))
    return parts.select(F.col("p_partkey").alias("array_ord"), seq.alias("seq"))


def tandem_monomers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of a unit as monomers.  Brands share letters and all units a tail of T, so a start k-mer exists."""
    unit = F.concat(_fold(F.concat("p_name", "p_brand")), F.lit("TTTTTTTT"))
    copies = lambda u: F.transform(F.sequence(F.lit(0), (3 + F.col("k") % 40).cast("int")), lambda i: F.when((i == 1) & (F.col("k") % 3 == 0), F.concat(u, F.lit("G"))).otherwise(u))
    base = _parts(spark, sf_dir, "p_name", "p_brand").select(F.col("p_partkey").alias("k"), unit.alias("unit"))
    return base.select(F.col("k").alias("array_ord"), _once(F.col("unit"), copies).alias("pieces"))


def dna_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types of a user in the order of time, as bases; errors are N."""
    code = F.when(F.col("event_type") == "click", "A").when(F.col("event_type") == "view", "C").when(F.col("event_type") == "purchase", "G").when(F.col("event_type") == "signup", "T").otherwise("N")
    rows = _table(spark, sf_dir, "events").select("user_id", F.struct("ts", "event_id", code.alias("c")).alias("e"))
    return rows.groupBy(F.col("user_id").alias("array_ord")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("e")), lambda x: x["c"]), "").alias("seq"))


def monomer_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of documents as monomers."""
    pieces = F.filter(F.split(F.coalesce("text", F.lit("")), "[ \t\r\n]+"), lambda x: x != "")
    return _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("array_ord"), pieces.alias("pieces"))


def tandem_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tandem arrays cut into pieces of eleven bases, as a plain stand-in for monomers."""
    pieces = lambda s: F.transform(F.sequence(F.lit(0), F.ceil(F.length(s) / 11).cast("int") - 1), lambda i: F.substring(s, i * 11 + 1, F.lit(11)))
    return dna_tandem(spark, sf_dir).select("array_ord", _once(F.col("seq"), pieces).alias("pieces"))


def heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FASTA headers of many forms, by the part's key."""
    key, name = F.col("p_partkey").cast("string"), F.col("p_name")
    forms = [
        F.concat(F.lit("gi|"), key, F.lit("|ref|NW_"), key, F.lit(".1|Mm "), name, F.lit(" chromosome "), "p_size", F.lit(", x")), F.concat(F.lit(">probe|misat|ref|CAAA"), key, F.lit("|start|991|end|1019")), F.concat(F.lit("lcl|Hma_"), key, F.lit(" "), name, F.lit(" chr"), "p_size", F.lit(" y")),
        F.concat(F.lit(">"), key, F.lit("\tx"), name), F.concat(F.lit(">"), key, F.lit("-99 mitochondrial mitochondrion z")), F.concat(F.lit(">"), key), F.concat(F.lit("gi|"), key, F.lit("|gb|AAAB"), key, F.lit(".2| chromosome "), "p_size"), F.concat(F.lit(">gnl|ti|"), key, F.lit(" "), name),
    ]
    return _parts(spark, sf_dir, "p_name", "p_size").select(F.col("p_partkey").alias("record_ord"), "p_size", "p_name", F.get(F.array(*forms), (F.col("p_partkey") % 9).cast("int")).alias("h")).withColumn("head", F.coalesce("h", F.lit("plain words"))).drop("h")


_fold_sql = f"regexp_replace(translate({{}}, '{LETTERS}', '{BASES}'), '[^ACGT]', '', 'g')"
SQL = {
    "dna_documents": f"dna_documents AS (SELECT doc_id AS array_ord, {_fold_sql.format("coalesce(text, '')")} AS seq FROM documents)",
    "dna_tandem": f"""tandem_unit AS (SELECT p_partkey, {_fold_sql.format("concat(p_name, p_brand)")} AS unit FROM part),
tandem_part AS (SELECT p_partkey, repeat(unit, CAST(4 + p_partkey % 40 AS INT)) AS a, CAST(length(unit) * 3 + p_partkey % 7 AS INT) AS k FROM tandem_unit),
dna_tandem AS (SELECT p_partkey AS array_ord, concat(substring(a, 1, k), CASE WHEN p_partkey % 3 = 0 THEN 'G' ELSE '' END, substring(a, k + 1)) AS seq FROM tandem_part)""",
    "dna_events": "dna_events AS (SELECT user_id AS array_ord, string_agg(CASE event_type WHEN 'click' THEN 'A' WHEN 'view' THEN 'C' WHEN 'purchase' THEN 'G' WHEN 'signup' THEN 'T' ELSE 'N' END, '' ORDER BY ts, event_id) AS seq FROM events GROUP BY user_id)",
    "monomer_docs": "monomer_docs AS (SELECT doc_id AS array_ord, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t\\r\\n]+'), lambda x: x <> '') AS pieces FROM documents)",
    "heads": """heads AS (SELECT p_partkey AS record_ord, p_size, p_name, CASE p_partkey % 9
 WHEN 0 THEN concat('gi|', p_partkey, '|ref|NW_', p_partkey, '.1|Mm ', p_name, ' chromosome ', p_size, ', x') WHEN 1 THEN concat('>probe|misat|ref|CAAA', p_partkey, '|start|991|end|1019')
 WHEN 2 THEN concat('lcl|Hma_', p_partkey, ' ', p_name, ' chr', p_size, ' y') WHEN 3 THEN concat('>', p_partkey, chr(9), 'x', p_name) WHEN 4 THEN concat('>', p_partkey, '-99 mitochondrial mitochondrion z')
 WHEN 5 THEN concat('>', p_partkey) WHEN 6 THEN concat('gi|', p_partkey, '|gb|AAAB', p_partkey, '.2| chromosome ', p_size) WHEN 7 THEN concat('>gnl|ti|', p_partkey, ' ', p_name) ELSE 'plain words' END AS head FROM part)""",
}
SQL["tandem_units"] = SQL["dna_tandem"] + ",\ntandem_units AS (SELECT array_ord, list_transform(range(0, CAST(ceil(length(seq) / 11.0) AS BIGINT)), lambda i: substring(seq, i * 11 + 1, 11)) AS pieces FROM dna_tandem)"
SQL["tandem_monomers"] = f"monomer_unit AS (SELECT p_partkey, concat({_fold_sql.format('concat(p_name, p_brand)')}, 'TTTTTTTT') AS unit FROM part),\ntandem_monomers AS (SELECT p_partkey AS array_ord, list_transform(range(0, CAST(4 + p_partkey % 40 AS BIGINT)), lambda i: CASE WHEN i = 1 AND p_partkey % 3 = 0 THEN concat(unit, 'G') ELSE unit END) AS pieces FROM monomer_unit)"
