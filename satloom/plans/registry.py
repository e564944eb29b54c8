"""Queries over the supplied tables, and the SQL that each is checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sequence as S
from ..operators import decompose as D
from ..operators import extract as E
from ..operators import kmers as K
from ..operators import records as R
from ..operators import rotate as O
from . import views as V

QUERIES: dict = {}
SQL: dict[str, str] = {}
DEPTH, CUTOFF, START = 6, 3, "ACGTA"
_counts = {b: f"(length(seq) - length(replace(seq, '{b}', '')))" for b in "ACGT"}
_top_sql = f"CASE greatest({_counts['A']}, {_counts['C']}, {_counts['T']}, {_counts['G']}) WHEN {_counts['A']} THEN 'A' WHEN {_counts['C']} THEN 'C' WHEN {_counts['T']} THEN 'T' ELSE 'G' END"


def _rc(x: str) -> str:
    return f"translate(regexp_replace(reverse({x}), '[^ATCGNatcgn~\\[\\] ]', '', 'g'), 'ATCGNatcgn~[] ', 'TAGCNtagcn~][ ')"


def query(name: str, sql: str | None = None, *views: str):
    """Register a query and its SQL; ``views`` are the relations that the SQL begins with."""

    def add(fn):
        QUERIES[name] = fn
        if sql:
            ctes, rest = ",\n".join(V.SQL[v] for v in views), sql
            glue = ",\n" if rest.startswith("WITH ") else "\n"
            SQL[name] = (f"WITH {ctes}{glue}{rest.removeprefix('WITH ')}" if ctes else rest)
        return fn

    return add


@query("monomer_table", "WITH e AS (SELECT array_ord, unnest(pieces) AS monomer, generate_subscripts(pieces, 1) - 1 AS i FROM monomer_docs), f AS (SELECT monomer, count(*) AS n, min(struct_pack(a := array_ord, i := i)) AS f FROM e GROUP BY monomer) SELECT n, length(monomer)::INT AS length, monomer, f.a AS first_ord, f.i::INT AS first_pos FROM f", "monomer_docs")
def monomer_table(spark: SparkSession, d: str) -> DataFrame:
    return E.monomer_table(V.monomer_docs(spark, d))


@query("monomer_totals", "WITH e AS (SELECT unnest(pieces) AS m FROM monomer_docs) SELECT (SELECT count(DISTINCT m) FROM e) AS n_distinct, (SELECT count(*) FROM e) AS n_monomers, (SELECT count(*) FROM monomer_docs) AS n_arrays", "monomer_docs")
def monomer_totals(spark: SparkSession, d: str) -> DataFrame:
    return E.totals(V.monomer_docs(spark, d))


@query("base_composition", "SELECT array_ord, " + ", ".join(f"{c}::BIGINT AS n_{b}" for b, c in _counts.items()) + f", {_top_sql} AS top FROM dna_documents", "dna_documents")
def base_composition(spark: SparkSession, d: str) -> DataFrame:
    return V.dna_documents(spark, d).select("array_ord", *[S.base_count(F.col("seq"), b).alias(f"n_{b}") for b in "ACGT"], S.top_base(F.col("seq")).alias("top"))


@query("start_positions", f"WITH t AS (SELECT array_ord, seq, {_top_sql} AS top FROM dna_events) SELECT array_ord, list_filter(range(0, length(seq)), lambda p: substring(seq, p + 1, 1) = top)::INT[] AS starts FROM t", "dna_events")
def start_positions(spark: SparkSession, d: str) -> DataFrame:
    return V.dna_events(spark, d).select("array_ord", S.start_positions(F.col("seq")).alias("starts"))


@query("literal_split", "SELECT array_ord, string_split(seq, 'CA') AS pieces FROM dna_events", "dna_events")
def literal_split(spark: SparkSession, d: str) -> DataFrame:
    return V.dna_events(spark, d).select("array_ord", S.literal_split(F.col("seq"), F.lit("CA")).alias("pieces"))


@query("gc_content", "SELECT array_ord, CASE WHEN length(seq) = 0 THEN 0.0 ELSE length(regexp_replace(seq, '[^cgCG]', '', 'g')) / length(seq) END::DOUBLE AS gc FROM dna_documents", "dna_documents")
def gc_content(spark: SparkSession, d: str) -> DataFrame:
    return V.dna_documents(spark, d).select("array_ord", S.gc_fraction(F.col("seq")).alias("gc"))


@query("clear_sequence", "SELECT doc_id AS array_ord, upper(regexp_replace(coalesce(text, ''), '[^actgnuwsmkrybdhvACTGNUWSMKRYBDHV-]', '', 'g')) AS seq FROM documents")
def clear_sequence(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("array_ord"), S.clear_sequence(F.coalesce("text", F.lit(""))).alias("seq"))


@query("reverse_complement", f"SELECT doc_id AS array_ord, {_rc('coalesce(text, chr(32))')} AS rc FROM documents")
def reverse_complement(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("array_ord"), S.reverse_complement(F.coalesce("text", F.lit(" "))).alias("rc"))


@query("orient_auto", f"SELECT array_ord, CASE WHEN {_counts['A']} < {_counts['T']} THEN seq ELSE {_rc('seq')} END AS seq FROM dna_documents", "dna_documents")
def orient_auto(spark: SparkSession, d: str) -> DataFrame:
    return V.dna_documents(spark, d).select("array_ord", S.orient_by_bases(F.col("seq")).alias("seq"))


@query("orient_kmer", f"SELECT array_ord, CASE WHEN (length(seq) - length(replace(seq, {_rc("'CAT'")}, ''))) < (length(seq) - length(replace(seq, 'CAT', ''))) THEN seq ELSE {_rc('seq')} END AS seq FROM dna_documents", "dna_documents")
def orient_kmer(spark: SparkSession, d: str) -> DataFrame:
    return V.dna_documents(spark, d).select("array_ord", S.orient_by_kmer(F.col("seq"), F.lit("CAT")).alias("seq"))


@query("length_cutoffs", "WITH c AS (SELECT array_ord, length(seq) AS n FROM dna_documents) SELECT array_ord, (CASE WHEN n > 1000000 THEN 1000 WHEN n > 100000 THEN 250 WHEN n > 10000 THEN 10 ELSE 3 END)::INT AS own, (SELECT CASE WHEN n > 1000000 THEN 1000 WHEN n > 100000 THEN 250 WHEN n > 10000 THEN 10 ELSE 3 END FROM c ORDER BY array_ord LIMIT 1)::INT AS sticky FROM c", "dna_documents")
def length_cutoffs(spark: SparkSession, d: str) -> DataFrame:
    arrays = V.dna_documents(spark, d)
    return D.with_cutoff(arrays).select("array_ord", S.length_cutoff(F.length("seq")).alias("own"), F.col("cutoff").alias("sticky"))


_tree = f"""b AS (SELECT array_ord, seq, {_top_sql} AS top FROM {{0}}),
st AS (SELECT array_ord, seq, p FROM (SELECT array_ord, seq, top, unnest(range(0, length(seq))) AS p FROM b) WHERE substring(seq, p + 1, 1) = top),
km AS (SELECT array_ord, length, substring(seq, p + 1, length) AS kmer, p FROM (SELECT array_ord, seq, p, unnest(range(2, {DEPTH + 1})) AS length FROM st) WHERE p + length <= length(seq) AND regexp_full_match(substring(seq, p + 1, length), '[ACGT]+')),
tree AS (SELECT array_ord, length::INT AS length, kmer, count(*) AS n, min(p)::INT AS first_pos FROM km GROUP BY ALL HAVING count(*) > {CUTOFF})"""
_hints = """hint AS (SELECT array_ord, length, kmer, n FROM (SELECT t.*, row_number() OVER (PARTITION BY t.array_ord, t.length ORDER BY t.n DESC, coalesce(q.first_pos, 0), instr('ACGT', right(t.kmer, 1))) AS r
 FROM tree t LEFT JOIN tree q ON q.array_ord = t.array_ord AND q.length = t.length - 1 AND q.kmer = left(t.kmer, t.length - 1)) WHERE r = 1)"""
_periods = """pc AS (SELECT array_ord, length, kmer, unnest(p) AS piece, generate_subscripts(p, 1) AS i FROM (SELECT array_ord, length, kmer, string_split(seq, kmer) AS p FROM hint JOIN dna_tandem USING (array_ord))),
sz AS (SELECT array_ord, length, kmer, (length(piece) + length)::INT AS period, count(*) AS n, min(i) AS f FROM pc GROUP BY ALL),
per AS (SELECT array_ord, length, kmer, period, n / total AS score FROM (SELECT *, sum(n) OVER w AS total, row_number() OVER (PARTITION BY array_ord, length ORDER BY n DESC, f) AS r FROM sz WINDOW w AS (PARTITION BY array_ord, length)) WHERE r = 1)"""
_cuts = """vote AS (SELECT array_ord, period, count(*) AS v, min(length) AS f FROM per GROUP BY ALL),
won AS (SELECT array_ord, period FROM (SELECT *, row_number() OVER (PARTITION BY array_ord ORDER BY v DESC, f) AS r FROM vote) WHERE r = 1),
cut AS (SELECT d.array_ord, coalesce(c.kmer, d.seq) AS cut, coalesce(c.score, 0)::DOUBLE AS score, coalesce(c.period, length(d.seq))::INT AS period FROM dna_tandem d LEFT JOIN
 (SELECT * FROM (SELECT p.*, row_number() OVER (PARTITION BY p.array_ord ORDER BY p.score DESC, p.length) AS r FROM per p JOIN won USING (array_ord, period)) WHERE r = 1) c USING (array_ord))"""
_first = """led AS (SELECT array_ord, cut, score, period, list_transform(string_split(seq, cut), lambda x, i: CASE WHEN i > 1 THEN concat(cut, x) WHEN x = '' THEN cut ELSE x END) AS p FROM cut JOIN dna_tandem USING (array_ord)),
pass1 AS (SELECT array_ord, cut, score, period, flatten(list_transform(p, lambda x: CASE WHEN length(x) > 0 AND length(x) % period = 0 THEN list_transform(range(0, length(x) // period), lambda k: substring(x, k * period + 1, period)) ELSE [x] END)) AS pieces FROM led)"""
_mono = """mono AS (SELECT array_ord, monomer, count(*) AS n, min(i)::INT AS first_ord FROM (SELECT array_ord, unnest(pieces) AS monomer, generate_subscripts(pieces, 1) - 1 AS i FROM pass1) GROUP BY ALL)"""
_ref_capped = """ref AS (SELECT array_ord, monomer AS reference, n FROM (SELECT m.*, row_number() OVER (PARTITION BY array_ord ORDER BY rank) AS r FROM
 (SELECT *, row_number() OVER (PARTITION BY array_ord ORDER BY n DESC, first_ord) AS rank FROM mono) m JOIN pass1 p USING (array_ord) WHERE rank <= 1000 AND length(monomer) = p.period) WHERE r = 1)"""
_ref = _ref_capped.replace("rank <= 1000 AND ", "")


@query("kmer_tree", f"WITH {_tree.format('dna_tandem')} SELECT * FROM tree", "dna_tandem")
def kmer_tree(spark: SparkSession, d: str) -> DataFrame:
    return K.kmer_tree(V.dna_tandem(spark, d), DEPTH, CUTOFF)


@query("kmer_tree_events", f"WITH {_tree.format('dna_events')} SELECT * FROM tree", "dna_events")
def kmer_tree_events(spark: SparkSession, d: str) -> DataFrame:
    return K.kmer_tree(V.dna_events(spark, d), DEPTH, CUTOFF)


@query("kmer_tree_deep", f"WITH {_tree.format('dna_tandem').replace(f'range(2, {DEPTH + 1})', 'range(2, 41)')} SELECT * FROM tree", "dna_tandem")
def kmer_tree_deep(spark: SparkSession, d: str) -> DataFrame:
    return K.kmer_tree(V.dna_tandem(spark, d), 40, CUTOFF)


@query("hints", f"WITH {_tree.format('dna_tandem')}, {_hints} SELECT * FROM hint", "dna_tandem")
def hints(spark: SparkSession, d: str) -> DataFrame:
    return K.hints(V.dna_tandem(spark, d), DEPTH, CUTOFF)


@query("hint_periods", f"WITH {_tree.format('dna_tandem')}, {_hints}, {_periods} SELECT * FROM per", "dna_tandem")
def hint_periods(spark: SparkSession, d: str) -> DataFrame:
    return K.hint_periods(V.dna_tandem(spark, d), DEPTH, CUTOFF)


def _cut(spark: SparkSession, d: str) -> DataFrame:
    return K.best_cut(V.dna_tandem(spark, d), DEPTH, CUTOFF)


@query("best_cut", f"WITH {_tree.format('dna_tandem')}, {_hints}, {_periods}, {_cuts} SELECT * FROM cut", "dna_tandem")
def best_cut(spark: SparkSession, d: str) -> DataFrame:
    return _cut(spark, d).drop("seq")


_upto = f"WITH {_tree.format('dna_tandem')}, {_hints}, {_periods}, {_cuts}, {_first}"


@query("first_pass", f"{_upto} SELECT * FROM pass1", "dna_tandem")
def first_pass(spark: SparkSession, d: str) -> DataFrame:
    return D.first_pass(_cut(spark, d))


@query("monomer_counts", f"{_upto}, {_mono} SELECT * FROM mono", "dna_tandem")
def monomer_counts(spark: SparkSession, d: str) -> DataFrame:
    return D.monomer_counts(D.first_pass(_cut(spark, d)))


@query("reference_monomer", f"{_upto}, {_mono}, {_ref} SELECT * FROM ref", "dna_tandem")
def reference_monomer(spark: SparkSession, d: str) -> DataFrame:
    return D.reference_monomers(D.first_pass(_cut(spark, d)))


@query(
    "second_pass_once",
    f"""{_upto}, {_mono}, {_ref_capped},
pp AS (SELECT p.array_ord, p.period, r.reference, unnest(p.pieces) AS x, generate_subscripts(p.pieces, 1) AS i FROM pass1 p LEFT JOIN ref r USING (array_ord)),
cand AS (SELECT array_ord, i, x, reference, unnest(list_concat(range(0, least(length(x) - length(reference) + 1, 5)), range(greatest(0, length(x) - length(reference) - 4), length(x) - length(reference) + 1))) AS pos FROM pp WHERE reference IS NOT NULL AND length(x) / period > 1.3),
dist AS (SELECT DISTINCT array_ord, i, pos, CASE WHEN pos < least(length(x) - length(reference) + 1, 5) THEN 0 ELSE 1 END AS late, levenshtein(reference, substring(x, pos + 1, length(reference))) AS d, length(reference) AS n FROM cand),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY array_ord, i ORDER BY d, late, pos) AS r FROM dist) WHERE r = 1 AND 2 * d < n),
cutp AS (SELECT pp.array_ord, pp.i, CASE WHEN b.pos IS NULL THEN [x] ELSE list_filter([substring(x, 1, CASE WHEN b.pos = 0 THEN b.n ELSE b.pos END), substring(x, CASE WHEN b.pos = 0 THEN b.n ELSE b.pos END + 1)], lambda y: y <> '') END AS parts FROM pp LEFT JOIN best b USING (array_ord, i)),
fin AS (SELECT array_ord, flatten(list(parts ORDER BY i)) AS pieces FROM cutp GROUP BY array_ord)
SELECT p.array_ord, p.cut, p.score, p.period, f.pieces, len(f.pieces) <> len(p.pieces) AS changed FROM pass1 p JOIN fin f USING (array_ord)""",
    "dna_tandem",
)
def second_pass_once(spark: SparkSession, d: str) -> DataFrame:
    return D.second_pass_round(D.first_pass(_cut(spark, d)), candidates=D.CANDIDATES)


@query("decompose_native")
def decompose_native(spark: SparkSession, d: str) -> DataFrame:
    return D.decompose_native(V.dna_tandem(spark, d), depth=24)


@query("decompose_full")
def decompose_full(spark: SparkSession, d: str) -> DataFrame:
    return D.decompose(V.dna_tandem(spark, d), check=True).select("array_ord", "cut", "score", "period", "pieces", "problem")


@query("decompose_strict")
def decompose_strict(spark: SparkSession, d: str) -> DataFrame:
    return D.decompose(V.dna_tandem(spark, d), compat=False).select("array_ord", "cut", "score", "period", "pieces")


@query("diagnostics", f"""{_upto}, {_mono}, {_ref}, e AS (SELECT array_ord, unnest(pieces) AS monomer, (generate_subscripts(pieces, 1) - 1)::INT AS i FROM pass1)
SELECT e.array_ord, e.i, length(e.monomer)::INT AS length, count(*) OVER (PARTITION BY e.array_ord, left(e.monomer, 5)) AS n_head, e.monomer, levenshtein(e.monomer, ref.reference)::INT AS distance FROM e JOIN ref USING (array_ord)""", "dna_tandem")
def diagnostics(spark: SparkSession, d: str) -> DataFrame:
    pieces = D.first_pass(_cut(spark, d))
    return E.diagnostics(pieces.withColumn("reference", D.reference_monomer(F.col("pieces"), F.col("period"))["reference"]))


_turned = f"""sp AS (SELECT array_ord, array_to_string(pieces, ' ') AS seq FROM tandem_units),
tu AS (SELECT array_ord, list_filter(string_split(CASE WHEN {_counts['A']} < {_counts['T']} THEN seq ELSE {_rc('seq')} END, ' '), lambda x: x <> '') AS pieces FROM sp)"""
_census = """jo AS (SELECT array_ord, array_to_string(pieces, '') AS s FROM tu),
cs AS (SELECT substring(s, p + 1, 5) AS kmer, count(*) AS n, min(struct_pack(a := array_ord, p := p)) AS f FROM (SELECT array_ord, s, unnest(range(0, length(s) - 4)) AS p FROM jo) WHERE p = 0 OR substring(s, p + 1, 5) <> substring(s, p, 5) GROUP BY 1)"""
_starts = """tp AS (SELECT kmer, row_number() OVER (ORDER BY n DESC, f.a, f.p) AS rank FROM cs QUALIFY rank <= 100),
mn AS (SELECT m, count(*) AS n FROM (SELECT unnest(pieces) AS m FROM tu) GROUP BY m),
cp AS (SELECT kmer, rank, n, (length(m) - length(replace(m, kmer, ''))) / 5 AS c FROM mn CROSS JOIN tp),
sc AS (SELECT kmer, rank::INT AS rank, sum(CASE WHEN c > 0 THEN n ELSE 0 END) / sum(n) AS r, sum(CASE WHEN c = 1 THEN n ELSE 0 END) / sum(n) AS p FROM cp GROUP BY ALL),
f1 AS (SELECT *, CASE WHEN r + p > 0 THEN 2 * r * p / (r + p) ELSE 0.0 END::DOUBLE AS f1 FROM sc)"""


@query("kmer_census", f"WITH {_turned}, {_census} SELECT kmer, n, f.a AS first_ord, f.p::INT AS first_pos FROM cs", "tandem_units")
def kmer_census(spark: SparkSession, d: str) -> DataFrame:
    return O.kmer_census(O.oriented(V.tandem_units(spark, d)))


@query("start_kmers", f"WITH {_turned}, {_census}, {_starts} SELECT * FROM f1", "tandem_units")
def start_kmers(spark: SparkSession, d: str) -> DataFrame:
    turned = O.oriented(V.tandem_units(spark, d))
    return O.start_kmers(turned, O.kmer_census(turned))


@query("start_kmer", f"WITH {_turned}, {_census}, {_starts} SELECT * FROM f1 WHERE f1 >= 0.5 ORDER BY f1 DESC, rank LIMIT 1", "tandem_units")
def start_kmer(spark: SparkSession, d: str) -> DataFrame:
    return O.start_kmer(O.oriented(V.tandem_units(spark, d)))


@query(
    "rotate_given",
    f"""WITH sp AS (SELECT array_ord, array_to_string(pieces, ' ') AS seq FROM tandem_units),
tu AS (SELECT array_ord, CASE WHEN (length(seq) - length(replace(seq, {_rc(f"'{START}'")}, ''))) < (length(seq) - length(replace(seq, '{START}', ''))) THEN seq ELSE {_rc('seq')} END AS t, seq FROM sp),
jo AS (SELECT array_ord, replace(t, ' ', '') AS s, t <> seq AS reversed FROM tu),
ps AS (SELECT array_ord, s, reversed, list_concat([0], list_filter(range(1, length(s)), lambda p: substring(s, p + 1, {len(START)}) = '{START}')) AS p FROM jo)
SELECT array_ord, list_transform(p, lambda x, i: substring(s, x + 1, coalesce(p[i + 1], length(s)) - x)) AS pieces, reversed FROM ps""",
    "tandem_units",
)
def rotate_given(spark: SparkSession, d: str) -> DataFrame:
    return O.rotate(V.tandem_units(spark, d), START)


_of_monomers = lambda x: x.replace("tandem_units", "tandem_monomers")
_best_start = "st AS (SELECT * FROM f1 WHERE f1 >= 0.5 ORDER BY f1 DESC, rank LIMIT 1)"


@query("start_kmer_monomers", f"WITH {_of_monomers(_turned)}, {_census}, {_starts}, {_best_start} SELECT * FROM st", "tandem_monomers")
def start_kmer_monomers(spark: SparkSession, d: str) -> DataFrame:
    return O.start_kmer(O.oriented(V.tandem_monomers(spark, d)))


@query(
    "rotate_auto",
    f"""WITH {_of_monomers(_turned)}, {_census}, {_starts}, {_best_start},
ro AS (SELECT array_ord, CASE WHEN {_counts['A']} < {_counts['T']} THEN seq ELSE {_rc('seq')} END AS t, seq FROM sp),
jj AS (SELECT array_ord, replace(t, ' ', '') AS s, t <> seq AS reversed, (SELECT kmer FROM st) AS k FROM ro),
ps AS (SELECT array_ord, s, reversed, list_concat([0], list_filter(range(1, length(s)), lambda p: substring(s, p + 1, 5) = k)) AS p FROM jj)
SELECT array_ord, list_transform(p, lambda x, i: substring(s, x + 1, coalesce(p[i + 1], length(s)) - x)) AS pieces, reversed FROM ps""",
    "tandem_monomers",
)
def rotate_auto(spark: SparkSession, d: str) -> DataFrame:
    return O.rotate(V.tandem_monomers(spark, d))


@query("rotate_auto_uncut")
def rotate_auto_uncut(spark: SparkSession, d: str) -> DataFrame:
    """Pieces of eleven bases have no start k-mer: oriented and left as they are."""
    return O.rotate(V.tandem_units(spark, d))


_g = lambda p, i: f"regexp_extract(head, '{p}', {i})"
_forms = [
    (r"^>?gi\|(\d+)\|(?:ref|dbj)\|([\w.]+)\|(.*)", [1, 2, 3]), (r"^>probe\|(.*?)\|ref\|(.*?)\|start\|(\d*?)\|end\|(\d*)", None), (r"^>?lcl\|(.*?) (.*)", [1, 1, 2]), (r"^>?psu\|(.*?) (.*)", [1, 1, 2]), (r"^>(\d+)\t(\S+)", [1, 2, 0]), (r"^>(\d+)-(\d+)", [1, 2, 0]),
    (r"^>(\d+)", [1, 0, 0]), (r"^>?gi\|(\d+)\|\w+?\|([\w.]+)\|(.*)", [1, 2, 3]), (r"^>gnl\|ti\|(\d+) (.*)", [1, 2, 2]),
]


def _form(p: str, at: list | None) -> str:
    if at is None:
        one = f"concat_ws('_', {_g(p, 2)}, {_g(p, 3)}, {_g(p, 4)})"
        return f"[{one}, 'None', concat_ws('_', {one}, {_g(p, 1)})]"
    return "[" + ", ".join(_g(p, i) if i else "'Unknown'" for i in at) + "]"


_head_sql = "CASE " + " ".join(f"WHEN regexp_matches(head, '{p}') THEN {_form(p, at)}" for p, at in _forms) + " ELSE ['Unknown', 'Unknown', 'Unknown'] END"
_chrom_sql = "coalesce(" + ", ".join(f"nullif(regexp_extract(head, '{p}', 1), '')" for p in (r"chromosome ([^, ]+)", r"chromosome (\S+?),", r"chromosome (\S+?),?", r"chr(\S+?) ")) + r", CASE WHEN regexp_matches(head, ' (mitochon\S+?) ') THEN 'MT' END, '?')"


@query("fasta_heads", f"SELECT record_ord, {_head_sql} AS parts, {_chrom_sql} AS chrom, coalesce(nullif(regexp_extract(head, '([A-Z]+)', 1), ''), 'UNKN') AS ref_prefix, coalesce(nullif(regexp_extract(head, 'ref.([A-Z]{{4,}})', 1), ''), nullif(regexp_extract(head, 'gb.([A-Z]{{4,}})', 1), '')) AS wgs_prefix, concat('AGT', lpad(((record_ord + 1) * 100)::VARCHAR, 13, '0')) AS id FROM heads", "heads")
def fasta_heads(spark: SparkSession, d: str) -> DataFrame:
    h = F.col("head")
    return V.heads(spark, d).select("record_ord", S.fasta_head(h).alias("parts"), S.chromosome_name(h).alias("chrom"), S.wgs_prefix_of_ref(h).alias("ref_prefix"), S.wgs_prefix_of_head(h).alias("wgs_prefix"), S.record_id(F.col("record_ord")).alias("id"))


def _lines(spark: SparkSession, d: str) -> DataFrame:
    """Finder lines: the ends change sides for some records, and some lines are short of a field."""
    k = F.col("record_ord")
    n = (k % 50 + 1).cast("int")
    left = F.when(k % 5 == 0, 500 + k).otherwise(k)
    cells = [left, 250 + k, F.lit(4), n, F.lit(4), 50 + k % 51, F.lit(0), F.lit(48), *[F.lit(25)] * 4, F.lit("2.00"), F.lit("AcGT")]
    line = F.concat_ws(" ", *[c.cast("string") for c in cells], F.when(k % 11 != 0, F.repeat(F.lit("ACGTn"), n)))
    return V.heads(spark, d).select("record_ord", F.regexp_replace("head", "^>", "").alias("head"), line.alias("line"))


_trf = f"""rec AS (SELECT record_ord, regexp_replace(head, '^>', '') AS head, record_ord % 11 <> 0 AS ok, (record_ord % 50 + 1)::INT AS n, CASE WHEN record_ord % 5 = 0 THEN 500 + record_ord ELSE record_ord END AS l FROM heads),
trf AS (SELECT record_ord, head AS trf_head, ({_head_sql})[1] AS trf_gi, {_chrom_sql} AS trf_chr, (CASE WHEN ok THEN l ELSE 0 END)::INT AS trf_l_ind, (CASE WHEN ok THEN 250 + record_ord ELSE 0 END)::INT AS trf_r_ind, (CASE WHEN ok THEN 4 ELSE 0 END)::INT AS trf_period,
 (CASE WHEN ok THEN n ELSE 0 END)::DOUBLE AS trf_n_copy, (CASE WHEN ok THEN 50 + record_ord % 51 ELSE 0 END)::DOUBLE AS trf_pmatch, CASE WHEN ok THEN upper(repeat('ACGTn', n)) ELSE '' END AS trf_array, ok FROM rec)"""


@query("tr_records", f"WITH {_trf} SELECT record_ord, trf_head, trf_gi, trf_chr, trf_l_ind, trf_r_ind, trf_period, trf_n_copy, trf_pmatch, (100 - trf_pmatch)::INT AS trf_pvar, trf_array, (CASE WHEN ok THEN 0.4 ELSE 0 END)::DOUBLE AS trf_array_gc, length(trf_array)::INT AS trf_array_length, concat_ws('_', string_split(trf_head, ' ')[1], trf_l_ind, trf_r_ind) AS trf_id, NOT ok AS bad FROM (SELECT * REPLACE (trf_head AS trf_head) FROM trf WHERE trf_head NOT LIKE '%' || chr(9) || '%')", "heads")
def tr_records(spark: SparkSession, d: str) -> DataFrame:
    rows = R.from_lines(_lines(spark, d).where(~F.col("head").contains("\t")))
    return rows.select("record_ord", "trf_head", "trf_gi", "trf_chr", "trf_l_ind", "trf_r_ind", "trf_period", "trf_n_copy", "trf_pmatch", "trf_pvar", "trf_array", "trf_array_gc", "trf_array_length", "trf_id", "bad")


@query("gff3", f"WITH {_trf} SELECT concat_ws(chr(9), CASE WHEN trf_chr <> '?' THEN trf_chr WHEN trf_gi <> 'Unknown' THEN trf_gi ELSE trf_head END, 'PySatDNA', 'complex_tandem_repeat', least(trf_l_ind, trf_r_ind), greatest(trf_l_ind, trf_r_ind), 1000, CASE WHEN trf_l_ind < trf_r_ind THEN '+' ELSE '-' END, '.', concat('period=', trf_period)) AS value FROM trf", "heads")
def gff3(spark: SparkSession, d: str) -> DataFrame:
    return R.gff3(R.from_lines(_lines(spark, d)), properties={"period": "trf_period"})


@query("bed", f"WITH {_trf} SELECT concat_ws(chr(9), trf_head, least(trf_l_ind, trf_r_ind), greatest(trf_l_ind, trf_r_ind)) AS value FROM trf", "heads")
def bed(spark: SparkSession, d: str) -> DataFrame:
    return R.bed(R.from_lines(_lines(spark, d)))
