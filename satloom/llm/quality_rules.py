"""Quality rules as a bitmask ledger (operator 9): built-in functions only.

Every rule is evaluated once a document.  The ledger keeps the measurements and one bit a failed rule;
a policy is a versioned mask of the rules in force, so that verdicts of another version and ablations
are bit operations on the ledger and read no text.

A null text has no words and fails the base rule, as does an empty one.  Repeated rows are judged one
by one, and an empty table gives an empty ledger.  Columns of the input that have the name of a column of the
ledger give way to it in ``ledger``; the stage ``keep_good`` carries all columns of the input through untouched.
A text, however long, is one row's work: its windows are hashed, sorted and compared inside the row, so a
frequent window, line or source makes no large group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Bits of a packed window that hold its place; texts with more words take the wider form.
PLACE_BITS = 24

#: name -> condition of failure, over the measurements.  The order fixes the bits; new rules go last.
RULES: dict[str, str] = {
    "few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > 4 * n_words",
    "repeated_lines": "n_lines >= 4 AND 10 * n_dup_lines > 6 * n_lines",
    "word_length": "word_chars > 15 * n_words OR word_chars < 2 * n_words",
    "capitals": "2 * n_capitals > word_chars",
    "exclamations": "2 * n_exclamations > n_words",
}
BIT = {name: 1 << i for i, name in enumerate(RULES)}
BASE = BIT["few_words"] | BIT["repeated_words"]
#: version -> mask of the rules in force.
POLICIES = {1: BASE, 2: sum(BIT.values())}
POLICY = 2


def words(text: Column) -> Column:
    """Words between ASCII white space; none for a null or blank text."""
    inner = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\f\r"))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, common.SPACE + "+"))


def repeated_words(w: Column, size: int = 3, place_bits: int = PLACE_BITS, hash_bits: int = 64) -> Column:
    """Words that stand in a window of ``size`` words found twice or more in the array.

    Windows are packed as (hash, place) into one long, sorted, and compared with their neighbours, by
    the words themselves where the hashes agree.  Where hashes agree and words don't, equal windows need not be
    neighbours; such a text, and one with more words than the place has bits for, is sorted by the words as well.
    """
    low = (1 << place_bits) - 1
    n = F.size(w)
    places = F.sequence(F.lit(0), n - size)

    def window_hash(i: Column) -> Column:
        h = F.xxhash64(*[F.get(w, i + k) for k in range(size)])
        return h if hash_bits == 64 else h.bitwiseAND(F.lit((1 << hash_bits) - 1))

    def same_words(a: Column, b: Column) -> Column:
        out = F.get(w, a) == F.get(w, b)
        for k in range(1, size):
            out = out & (F.get(w, a + k) == F.get(w, b + k))
        return out

    def covered(starts: Column) -> Column:
        gaps = F.transform(starts, lambda x, i: F.least(F.lit(size), F.coalesce(F.get(starts, i + 1) - x, F.lit(size)).cast("int")))
        return F.aggregate(gaps, F.lit(0).cast("bigint"), lambda a, x: a + x)

    def narrow() -> Column:
        key = lambda x: F.shiftright(x, place_bits)
        place = lambda x: x.bitwiseAND(F.lit(low)).cast("int")
        packed = F.transform(places, lambda i: F.shiftleft(window_hash(i), place_bits).bitwiseOR(i.cast("bigint")))
        twin = lambda x, y: F.coalesce((key(x) == key(y)) & same_words(place(x), place(y)), F.lit(False))
        found = lambda s: F.filter(s, lambda x, i: twin(x, F.get(s, i - 1)) | twin(x, F.get(s, i + 1)))
        clash = lambda s: F.exists(F.transform(s, lambda x, i: F.coalesce((key(x) == key(F.get(s, i - 1))) & ~same_words(place(x), place(F.get(s, i - 1))), F.lit(False))), lambda x: x)
        return common.let(F.sort_array(packed), lambda s: F.when(clash(s), wide()).otherwise(common.let(F.sort_array(F.transform(found(s), place)), covered)))

    def wide() -> Column:
        rows = F.transform(places, lambda i: F.struct(window_hash(i).alias("h"), *[F.get(w, i + k).alias(f"w{k}") for k in range(size)], i.alias("i")))
        twin = lambda x, y: F.coalesce(same_words(x["i"], y["i"]), F.lit(False))
        found = lambda s: F.filter(s, lambda x, i: twin(x, F.get(s, i - 1)) | twin(x, F.get(s, i + 1)))
        return common.let(F.array_sort(rows), lambda s: common.let(F.sort_array(F.transform(found(s), lambda x: x["i"])), covered))

    return F.when(n < size, F.lit(0).cast("bigint")).when(n <= low, narrow()).otherwise(wide())


def measured(docs: DataFrame, column: str = "text") -> DataFrame:
    """The input with the measurements as a struct ``m``."""
    text = F.coalesce(F.col(column), F.lit(""))

    def of_words(w: Column) -> Column:
        # What is left without lower-case letters is short; the counts of signs run over that.
        signs = F.regexp_replace(F.array_join(w, ""), "[a-z\\x{80}-\\x{10FFFF}]+", "")
        count = lambda s, kept: F.length(F.regexp_replace(s, kept, "")).cast("bigint")
        return common.let(signs, lambda s: F.struct(
            F.size(w).cast("bigint").alias("n_words"),
            F.length(F.array_join(w, "")).cast("bigint").alias("word_chars"),
            count(s, "[^#*$%&|<>]").alias("n_symbols"),
            count(s, "[^A-Z]").alias("n_capitals"),
            count(s, "[^!]").alias("n_exclamations"),
            repeated_words(w).alias("n_repeat_words"),
        ))

    def of_lines(x: Column) -> Column:
        return F.struct(F.size(x).cast("bigint").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"))

    with_word = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^ \\t-\\r]"))
    return docs.withColumn("m", F.struct(common.let(words(F.col(column)), of_words).alias("w"), common.let(with_word, of_lines).alias("l")))


def ledger(docs: DataFrame, column: str = "text") -> DataFrame:
    """The input's columns, the measurements and ``failed``: one bit a failed rule."""
    names = [c for c in docs.columns if c not in ("n_lines", "n_words", "word_chars", "n_symbols", "n_capitals", "n_exclamations", "n_repeat_words", "n_dup_lines", "failed", "m")]
    rows = measured(docs.select(*[F.col(f"`{c}`") for c in names]), column)
    rows = rows.select(*[f"`{c}`" for c in names], "m.w.*", "m.l.*")
    failed = F.lit(0).cast("bigint")
    for name, rule in RULES.items():
        failed = failed.bitwiseOR(F.when(F.expr(rule), F.lit(BIT[name])).otherwise(F.lit(0)).cast("bigint"))
    return rows.withColumn("failed", failed)


def verdict(policy: int = POLICY) -> Column:
    """Kept under a policy: none of its rules failed."""
    return F.col("failed").bitwiseAND(F.lit(POLICIES[policy])) == 0


def ablation(rows: DataFrame, policy: int = POLICY) -> DataFrame:
    """Per rule of a policy: documents that fail it, that fail it alone, and that would be kept without it.

    The ledger is first counted by mask: at most two to the number of rules rows, whatever its size.
    """
    mask = POLICIES[policy]
    by_mask = rows.groupBy(F.col("failed").bitwiseAND(F.lit(mask)).alias("failed")).agg(F.count("*").alias("n"))
    rules = F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), F.lit(b).cast("bigint").alias("bit")) for k, b in BIT.items() if b & mask]))
    each = by_mask.select("failed", "n", rules.alias("r")).select("failed", "n", "r.rule", "r.bit")
    hit, alone, kept = F.col("failed").bitwiseAND(F.col("bit")) != 0, F.col("failed") == F.col("bit"), F.col("failed") == 0
    total = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    return each.groupBy("rule").agg(total(hit).alias("n_failed"), total(alone).alias("n_alone"), total(alone | kept).alias("n_kept_without"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of operator 9 over all documents; also the ledger's mask and the policy's version."""
    rows = ledger(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    base_failed = F.col("failed").bitwiseAND(F.lit(BASE)) != 0
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed.alias("base_failed"), verdict().alias("kept"), "failed", F.lit(POLICY).alias("policy"))


def rule_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of the policy in force does over all documents."""
    return ablation(ledger(common.table(spark, sf_dir, "documents").select("doc_id", "text")))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that the policy keeps, with their columns."""
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text")
    return ledger(whole).where(verdict()).select(*[F.col("row")[c].alias(c) for c in docs.columns])


_LEDGER_SQL = r"""
t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM {source}),
w AS (SELECT rid, doc_id, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM t),
win AS (SELECT rid, i, w[i] || ' ' || w[i+1] || ' ' || w[i+2] AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i+1, i+2]) AS p FROM twice) GROUP BY rid),
ln AS (SELECT rid, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM t),
m AS (SELECT w.rid, w.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, length(regexp_replace(text, '[^A-Z]', '', 'g'))::BIGINT AS n_capitals,
  length(regexp_replace(text, '[^!]', '', 'g'))::BIGINT AS n_exclamations, coalesce(cov.n, 0)::BIGINT AS n_repeat_words,
  len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines
  FROM w JOIN ln USING (rid) LEFT JOIN cov USING (rid)),
ledger AS (SELECT *, ({mask})::BIGINT AS failed FROM m)
"""


def ledger_sql(source: str = "documents") -> str:
    """CTEs that end in ``ledger``, for DuckDB."""
    mask = " + ".join(f"CASE WHEN {rule} THEN {BIT[name]} ELSE 0 END" for name, rule in RULES.items())
    return _LEDGER_SQL.replace("{source}", source).replace("{mask}", mask)


QUERIES = {"op9_quality_rules": op9_quality_rules, "quality_rule_ablation": rule_ablation}
SQL = {
    "op9_quality_rules": f"WITH {ledger_sql()} SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed & {BASE}) <> 0 AS base_failed, (failed & {POLICIES[POLICY]}) = 0 AS kept, failed, {POLICY}::INT AS policy FROM ledger",
    "quality_rule_ablation": f"WITH {ledger_sql()}, r AS (SELECT * FROM (VALUES {', '.join(f'({k!r}, {b})' for k, b in BIT.items() if b & POLICIES[POLICY])}) v(rule, bit)) "
    f"SELECT rule, sum(CASE WHEN failed & bit <> 0 THEN 1 ELSE 0 END)::BIGINT AS n_failed, sum(CASE WHEN failed & {POLICIES[POLICY]} = bit THEN 1 ELSE 0 END)::BIGINT AS n_alone, "
    f"sum(CASE WHEN failed & {POLICIES[POLICY]} IN (0, bit) THEN 1 ELSE 0 END)::BIGINT AS n_kept_without FROM ledger CROSS JOIN r GROUP BY rule",
}
