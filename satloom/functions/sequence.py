"""Column functions on sequences, headers and record identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Order in which ties between bases are decided.
TIE_ORDER = "ACTG"
COMPLEMENT = ("ATCGNatcgn~[] ", "TAGCNtagcn~][ ")
#: Longer than -> smallest count that a frequent k-mer must exceed.
CUTOFFS = [(1_000_000, 1000), (100_000, 250), (10_000, 10)]
LEAST_CUTOFF = 3


def quoted(text: Column) -> Column:
    """A regular expression for the literal text; the quote's own end is escaped."""
    return F.concat(F.lit("\\Q"), F.replace(text, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def occurrences(text: Column, part: Column) -> Column:
    """Non-overlapping occurrences of a non-empty literal, from the left."""
    return ((F.length(text) - F.length(F.replace(text, part, F.lit("")))) / F.length(part)).cast("bigint")


def base_count(seq: Column, base: str) -> Column:
    return (F.length(seq) - F.length(F.replace(seq, F.lit(base), F.lit("")))).cast("bigint")


def top_base(seq: Column) -> Column:
    """Most frequent of A, C, T, G; equal counts go by that order."""
    ranked = F.array(*[F.struct(base_count(seq, b).alias("n"), F.lit(-i).alias("o"), F.lit(b).alias("b")) for i, b in enumerate(TIE_ORDER)])
    return F.array_max(ranked)["b"]


def start_positions(seq: Column) -> Column:
    """0-based places of the top base."""
    n = F.length(seq)
    places = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    top = top_base(seq)
    return F.transform(F.array(top), lambda t: F.filter(places, lambda p: F.substring(seq, p + 1, F.lit(1)) == t))[0]


def literal_split(text: Column, cut: Column) -> Column:
    """Pieces between occurrences of a literal, empty ones included."""
    return F.split(text, quoted(cut), -1)


def whitespace_split(text: Column) -> Column:
    return F.filter(F.split(text, "\\s+"), lambda x: x != "")


def reverse_complement(seq: Column) -> Column:
    """Reversed and mapped; characters outside the alphabet are dropped, case is kept."""
    return F.translate(F.regexp_replace(F.reverse(seq), "[^ATCGNatcgn~\\[\\] ]", ""), *COMPLEMENT)


def orient_by_bases(seq: Column) -> Column:
    """Keep the strand with fewer A than T."""
    return F.when(base_count(seq, "A") < base_count(seq, "T"), seq).otherwise(reverse_complement(seq))


def orient_by_kmer(seq: Column, kmer: Column) -> Column:
    """Keep the strand that holds the k-mer more often than its reverse complement; ties are reversed."""
    return F.when(occurrences(seq, reverse_complement(kmer)) < occurrences(seq, kmer), seq).otherwise(reverse_complement(seq))


def even_parts(piece: Column, period: Column) -> Column:
    """Equal parts of a piece whose length is a multiple of the period; otherwise the piece."""
    n = F.length(piece)
    parts = F.transform(F.sequence(F.lit(0), F.floor(n / period).cast("int") - 1), lambda i: F.substring(piece, i * period + 1, period))
    return F.when((period > 0) & (n > 0) & (n % F.greatest(period, F.lit(1)) == 0), parts).otherwise(F.array(piece))


def gc_fraction(seq: Column) -> Column:
    n = F.length(seq)
    return F.when(n == 0, F.lit(0.0)).otherwise(F.length(F.regexp_replace(seq, "[^cgCG]", "")) / n)


def clear_sequence(seq: Column) -> Column:
    """Upper-case letters of the nucleotide alphabet and gaps; all else is dropped."""
    return F.upper(F.regexp_replace(seq, "[^actgnuwsmkrybdhvACTGNUWSMKRYBDHV-]", ""))


def length_cutoff(length: Column) -> Column:
    out = F.lit(LEAST_CUTOFF)
    for longer, cutoff in reversed(CUTOFFS):
        out = F.when(length > longer, cutoff).otherwise(out)
    return out


def chromosome_name(head: Column) -> Column:
    found = lambda p: F.nullif(F.regexp_extract(head, p, 1), F.lit(""))
    return F.coalesce(found("chromosome ([^, ]+)"), found("chromosome (\\S+?),"), found("chromosome (\\S+?),?"), found("chr(\\S+?) "), F.when(head.rlike(" (mitochon\\S+?) "), F.lit("MT")), F.lit("?"))


def fasta_head(head: Column) -> Column:
    """Three identifying parts of a FASTA header, by the first of the known forms that it has."""
    unknown = F.lit("Unknown")

    def form(pattern: str, *parts) -> Column:
        groups = [F.regexp_extract(head, pattern, i) for i in range(1, 5) if f"({i})" in groups_of(pattern)]
        return F.when(head.rlike(pattern), F.array(*[p(groups) if callable(p) else p for p in parts]))

    def groups_of(pattern: str) -> str:
        n = sum(1 for i, c in enumerate(pattern) if c == "(" and pattern[i + 1] != "?" and (i == 0 or pattern[i - 1] != "\\"))
        return "".join(f"({i + 1})" for i in range(n))

    g = lambda i: (lambda groups: groups[i])
    joined = lambda *at: (lambda groups: F.concat_ws("_", *[groups[i] for i in at]))
    return F.coalesce(
        form("^>?gi\\|(\\d+)\\|(?:ref|dbj)\\|([\\w.]+)\\|(.*)", g(0), g(1), g(2)),
        form("^>probe\\|(.*?)\\|ref\\|(.*?)\\|start\\|(\\d*?)\\|end\\|(\\d*)", joined(1, 2, 3), F.lit("None"), joined(1, 2, 3, 0)),
        form("^>?lcl\\|(.*?) (.*)", g(0), g(0), g(1)),
        form("^>?psu\\|(.*?) (.*)", g(0), g(0), g(1)),
        form("^>(\\d+)\t(\\S+)", g(0), g(1), unknown),
        form("^>(\\d+)-(\\d+)", g(0), g(1), unknown),
        form("^>(\\d+)", g(0), unknown, unknown),
        form("^>?gi\\|(\\d+)\\|\\w+?\\|([\\w.]+)\\|(.*)", g(0), g(1), g(2)),
        form("^>gnl\\|ti\\|(\\d+) (.*)", g(0), g(1), g(1)),
        F.array(unknown, unknown, unknown),
    )


def wgs_prefix_of_ref(ref: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(ref, "([A-Z]+)", 1), F.lit("")), F.lit("UNKN"))


def wgs_prefix_of_head(head: Column) -> Column:
    found = lambda p: F.nullif(F.regexp_extract(head, p, 1), F.lit(""))
    return F.coalesce(found("ref.([A-Z]{4,})"), found("gb.([A-Z]{4,})"))


def record_id(index: Column) -> Column:
    """``AGT`` and thirteen digits for a 0-based index."""
    return F.concat(F.lit("AGT"), F.lpad(((index + 1) * 100).cast("string"), 13, "0"))


def repeat_id(head: Column, left: Column, right: Column) -> Column:
    """First word of the head, and the ends of the array."""
    return F.concat_ws("_", F.coalesce(F.get(whitespace_split(head), F.lit(0)), F.lit("")), left, right)


def trf_parameters(text: Column) -> Column:
    return F.when(text.rlike("Parameters: ([\\d ]*)"), F.regexp_extract(text, "Parameters: ([\\d ]*)", 1)).otherwise("Unknown")


def trf_head(text: Column) -> Column:
    """What follows ``Sequence: `` on its line; null where there is none."""
    return F.when(text.contains("Sequence: "), F.regexp_extract(text, "Sequence: ([^\\n]*)", 1))
