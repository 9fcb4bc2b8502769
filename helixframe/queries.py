"""Queries over reads that are derived from the documents, and the same in SQL.

Reads are made of all letters of all documents; names, qualities, mates and adapters follow from ids and letters alone, so
both engines see the same reads.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe import oracles
from helixframe.functions import dna
from helixframe.operators import adapters as ad
from helixframe.operators import colours, detect, error, filters, modifiers, pairs, qc
from helixframe.plans.trim import TrimOptions, TrimPlan, pair_summary, summary
from helixframe.sources import records, sinks
from helixframe.storage import fresh, spread

ADAPTER1, ADAPTER2 = "AGATCGGAAGAGCACACGTC", "AGATCGGAAGAGCGTCGTGT"
#: Short sequences that many reads hold.
MOTIFS = (("m1", "ACGT"), ("m2", "GATTA"), ("m3", "CCA"), ("m4", "TTAGC"))

_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "ACGTACGTACGTANGTACGTACGTAC"


def _pieces_sql(size: str) -> str:
    """src3: read_idx, name, sequence and 128 qualities of all pieces of a size of all texts."""
    return f"""src0 AS (SELECT doc_id, {size} AS size, translate(upper(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g')), '{_LETTERS[0]}', '{_LETTERS[1]}') AS letters FROM documents),
src1 AS (SELECT *, unnest(range(0, greatest(1, (length(letters) + size - 1) // size))) AS piece FROM src0),
src2 AS (SELECT doc_id * 33554432 + piece AS read_idx, concat('R:1:FC:1:', cast(1101 + doc_id % 4 AS varchar), ':', cast(doc_id AS varchar), ':', cast(piece AS varchar)) AS name, substr(letters, piece * size + 1, size) AS sequence, doc_id * 7 + piece AS v FROM src1),
src3 AS (SELECT *, translate(concat(md5(sequence), md5(name), md5(concat(name, sequence)), md5(concat(sequence, name))), '0123456789abcdef', '#$&+/38<@BCDEFGH') AS quals FROM src2)"""


_READS = _pieces_sql("100") + ",\nreads AS (SELECT read_idx, name, sequence, substr(quals, 1, length(sequence)) AS qualities FROM src3)"

Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, source: Callable[[SparkSession, str], DataFrame] | None = None, tables: str = _READS):
    """Register a function of reads, or of another source, as a query; sql is what follows the common table expressions."""
    made = source or reads

    def register(f):
        name = f.__name__
        Q[name] = lambda spark, sf_dir, f=f: f(made(spark, sf_dir))
        if sql is not None:
            text = sql.strip()
            SQL[name] = f"WITH RECURSIVE {tables}{',' if text[:5].upper() != 'SELEC' else ''}\n{text}"
        return f

    return register


def _pieces(spark: SparkSession, sf_dir: str, size: Column, named: bool = True) -> DataFrame:
    """read_idx, name, sequence, quals (128 of them), v: all letters of each text in consecutive pieces, the last one
    shorter; a text that is null or without letters is one empty read. read_idx is doc_id * 2^25 + the piece's number, for
    which no string is too long. Each piece is made once, inside the row, whatever is made of it later. Unless named, only
    read_idx and sequence: four digests a piece are left out."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    letters = F.translate(F.upper(F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z]", "")), *_LETTERS)
    cut = dna.let(letters, lambda x: F.when(x == "", F.array(F.lit(""))).otherwise(F.regexp_extract_all(x, F.concat(F.lit(".{1,"), size.cast("string"), F.lit("}")), F.lit(0))))
    head = F.concat(F.lit("R:1:FC:1:"), (F.lit(1101) + F.col("doc_id") % 4).cast("string"), F.lit(":"), F.col("doc_id").cast("string"), F.lit(":"))
    md = lambda *c: F.md5(F.concat(*c).cast("binary"))
    quals = lambda s, n: F.translate(F.concat(md(s), md(n), md(n, s), md(s, n)), "0123456789abcdef", "#$&+/38<@BCDEFGH")
    one = lambda s, i: dna.let(F.concat(head, i.cast("string")), lambda n: F.struct(i.cast("bigint").alias("piece"), n.alias("name"), s.alias("sequence"), quals(s, n).alias("quals")))
    ident = F.col("doc_id").cast("bigint")
    if not named:
        return docs.select("doc_id", F.posexplode(cut).alias("piece", "sequence")).select((F.shiftleft(ident, 25) + F.col("piece")).alias("read_idx"), "sequence")
    rows = docs.select("doc_id", F.explode(F.transform(cut, one)).alias("x")).select("doc_id", "x.*")
    return rows.select((F.shiftleft(ident, 25) + F.col("piece")).alias("read_idx"), "name", "sequence", "quals", (ident * 7 + F.col("piece")).alias("v"))


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts as reads of 100 bases."""
    return _pieces(spark, sf_dir, F.lit(100)).select("read_idx", "name", "sequence", F.substring("quals", F.lit(1), F.length("sequence")).alias("qualities"))


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """read_idx and sequence of the same reads."""
    return _pieces(spark, sf_dir, F.lit(100), named=False)


def _swapped(text: Column, at: Column) -> Column:
    """text with another base at a place."""
    return F.concat(F.substring(text, F.lit(1), at - 1), F.translate(F.substring(text, at, F.lit(1)), "ACGT", "CATG"), F.substring(text, at + 1, F.length(text)))


def pair_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts as pairs with inserts of 40 to 79 bases. Both mates run into an adapter and are 80 bases long at most; three
    of four have a base or two read wrongly, and in one of seven the mates don't overlap."""
    p = _pieces(spark, sf_dir, F.lit(40) + F.pmod("doc_id", F.lit(40)))
    v, ins = F.col("v"), F.col("sequence")
    ends = p.withColumns({"s1": F.substring(F.concat(ins, F.lit(ADAPTER1)), 1, 80), "s2": F.substring(F.concat(F.when(v % 7 == 0, F.reverse(ins)).otherwise(dna.reverse_complement(ins)), F.lit(ADAPTER2)), 1, 80)})
    ends = ends.withColumns({"s1": F.when(v % 2 == 1, _swapped(F.col("s1"), (v % 37 + 1).cast("int"))).otherwise(F.col("s1")), "s2": F.when(v % 4 >= 2, _swapped(F.col("s2"), (v % 31 + 1).cast("int"))).otherwise(F.col("s2"))})
    ends = ends.withColumns({"q1": F.substring("quals", F.lit(1), F.length("s1")), "q2": F.substring(F.reverse("quals"), F.lit(1), F.length("s2"))})
    return ends.select("read_idx", pairs.read_struct(F.concat("name", F.lit("/1")), F.col("s1"), F.col("q1")).alias("r1"), pairs.read_struct(F.concat("name", F.lit("/2")), F.col("s2"), F.col("q2")).alias("r2"))


def _pairs_sql() -> str:
    swap = lambda s, at: f"concat(substr({s}, 1, {at} - 1), translate(substr({s}, {at}, 1), 'ACGT', 'CATG'), substr({s}, {at} + 1))"
    return f"""{_pieces_sql("40 + doc_id % 40")},
src4 AS (SELECT *, substr(concat(sequence, '{ADAPTER1}'), 1, 80) AS s1, substr(concat(CASE WHEN v % 7 = 0 THEN reverse(sequence) ELSE {oracles.complement('sequence')} END, '{ADAPTER2}'), 1, 80) AS s2 FROM src3),
src5 AS (SELECT read_idx, name, quals, CASE WHEN v % 2 = 1 THEN {swap('s1', '(v % 37 + 1)')} ELSE s1 END AS s1, CASE WHEN v % 4 >= 2 THEN {swap('s2', '(v % 31 + 1)')} ELSE s2 END AS s2 FROM src4),
pairs AS (SELECT read_idx, name, s1, s2, substr(quals, 1, length(s1)) AS q1, substr(reverse(quals), 1, length(s2)) AS q2 FROM src5)"""


_PAIRS = _pairs_sql()


def pair_query(sql: str | None = None):
    return query(sql, pair_reads, _PAIRS)


def _shown(r: DataFrame) -> DataFrame:
    return r.select("read_idx", "name", "sequence", "qualities")


# Cutters and trims


@query("SELECT read_idx, name, substr(sequence, 6) AS sequence, substr(qualities, 6) AS qualities FROM reads")
def cut_front(r):
    return _shown(modifiers.cutter([5])(modifiers.prepared(r)))


@query("SELECT read_idx, name, substr(sequence, 1, greatest(length(sequence) - 7, 0)) AS sequence, substr(qualities, 1, greatest(length(sequence) - 7, 0)) AS qualities FROM reads")
def cut_back(r):
    return _shown(modifiers.cutter([-7])(modifiers.prepared(r)))


@query("SELECT read_idx, name, substr(sequence, 6, greatest(length(sequence) - 12, 0)) AS sequence, substr(qualities, 6, greatest(length(sequence) - 12, 0)) AS qualities FROM reads")
def cut_both(r):
    return _shown(modifiers.cutter([5, -7])(modifiers.prepared(r)))


@query("SELECT read_idx, substr(sequence, 9, greatest(length(sequence) - 12, 0)) AS sequence, least(8, length(sequence)) + least(4, greatest(length(sequence) - 8, 0)) AS cut FROM reads")
def min_cut(r):
    """A cut of 3 and 4 first, so that only the shortfall to 8 and 4 is left."""
    out = modifiers.min_cutter([8, -4])(modifiers.cutter([3, -4])(modifiers.prepared(r)))
    return out.select("read_idx", "sequence", F.aggregate("clipped", F.lit(0), lambda a, x: a + x).alias("cut"))


_N_READS = "n AS (SELECT read_idx, concat('NNN', substr(sequence, 1, 20), repeat('N', cast(read_idx % 3 AS int))) AS sequence FROM reads)"


@query(f"{_N_READS} SELECT read_idx, regexp_replace(regexp_replace(sequence, '^N+', ''), 'N+$', '') AS sequence FROM n")
def n_end_trim(r):
    s = F.concat(F.lit("NNN"), F.substring("sequence", 1, 20), F.repeat(F.lit("N"), (F.col("read_idx") % 3).cast("int")))
    r = r.withColumns({"sequence": s, "qualities": F.repeat(F.lit("I"), F.length(s))})
    return modifiers.n_end_trimmer()(modifiers.prepared(r)).select("read_idx", "sequence")


def _bwa(step_back: str, step_front: str | None) -> str:
    """Trims by windows: the running sum from an end, its first fall below 0, its first maximum before that."""
    one = lambda name, order, step: f"""
{name}s AS (SELECT read_idx, i, sum({step}) OVER (PARTITION BY read_idx ORDER BY i {order} ROWS UNBOUNDED PRECEDING) AS s FROM pos),
{name}f AS (SELECT read_idx, {'max' if order == 'DESC' else 'min'}(i) AS stop FROM {name}s WHERE s < 0 GROUP BY read_idx),
{name}m AS (SELECT x.read_idx, x.i, row_number() OVER (PARTITION BY x.read_idx ORDER BY x.s DESC, x.i {order}) AS k FROM {name}s x LEFT JOIN {name}f f ON x.read_idx = f.read_idx WHERE x.s > 0 AND (f.stop IS NULL OR x.i {'>' if order == 'DESC' else '<'} f.stop)),
{name}c AS (SELECT read_idx, i FROM {name}m WHERE k = 1)"""
    text = "pos AS (SELECT read_idx, i, substr(sequence, i, 1) AS c, ascii(substr(qualities, i, 1)) - 33 AS q FROM (SELECT *, unnest(range(1, length(sequence) + 1)) AS i FROM reads)),"
    text += one("b", "DESC", step_back)
    if step_front:
        text += "," + one("f", "ASC", step_front)
        start, join = "coalesce(fc.i, 0)", "LEFT JOIN fc ON fc.read_idx = r.read_idx"
    else:
        start, join = "0", ""
    return text + f""", e AS (SELECT r.*, {start} AS a, coalesce(bc.i - 1, length(sequence)) AS z FROM reads r LEFT JOIN bc ON bc.read_idx = r.read_idx {join})
SELECT read_idx, CASE WHEN a >= z THEN '' ELSE substr(sequence, a + 1, z - a) END AS sequence, CASE WHEN a >= z THEN '' ELSE substr(qualities, a + 1, z - a) END AS qualities FROM e"""


@query(_bwa("20 - q", "15 - q"))
def quality_trim(r):
    return modifiers.quality_trimmer(15, 20)(modifiers.prepared(r)).select("read_idx", "sequence", "qualities")


@query(_bwa("CASE WHEN c = 'G' THEN 1 ELSE 20 - q END", None))
def nextseq_trim(r):
    return modifiers.nextseq_trimmer(20)(modifiers.prepared(r)).select("read_idx", "sequence", "qualities")


# Names, encodings, functions


@query("SELECT read_idx, regexp_replace(concat(name, ' length=7 x'), '\\blength=[0-9]*\\b', concat('length=', cast(length(sequence) AS varchar)), 'g') AS name FROM reads")
def length_tag(r):
    r = r.withColumn("name", F.concat("name", F.lit(" length=7 x")))
    return modifiers.length_tagger("length=")(r).select("read_idx", "name")


@query("t AS (SELECT read_idx, CASE WHEN ends_with(name, '1') THEN substr(name, 1, length(name) - 1) ELSE name END AS name FROM reads) SELECT read_idx, CASE WHEN ends_with(name, '33') THEN substr(name, 1, length(name) - 2) ELSE name END AS name FROM t")
def strip_suffix(r):
    return modifiers.suffix_remover(["1", "33"])(r).select("read_idx", "name")


@query("SELECT read_idx, concat('pre_', CASE WHEN strpos(sequence, 'GATTA') > 0 THEN 'm2' ELSE 'no_adapter' END, '_', name, '_end') AS name FROM reads")
def prefix_suffix(r):
    return modifiers.prefix_suffix_adder("pre_{name}_", "_end")(ad.cut_exact(r, ad.Adapter("m2", "GATTA"))).select("read_idx", "name")


@query("SELECT read_idx, translate(translate(sequence, 'ACGTN', '0123.'), '0123.', 'ACGTN') AS sequence FROM reads")
def double_encode(r):
    r = r.withColumn("sequence", F.translate("sequence", "ACGTN", "0123."))
    return modifiers.double_encoder()(r).select("read_idx", "sequence")


@query("SELECT read_idx, translate(qualities, '#$&', '+++') AS qualities FROM reads")
def zero_cap(r):
    """With base 43 (+), lower qualities than + become +; of these the reads hold #, $ and &."""
    return modifiers.zero_capper(43)(r).select("read_idx", "qualities")


@query("SELECT read_idx, reverse(translate(sequence, 'ACGT', 'TGCA')) AS sequence FROM reads")
def reverse_complement(r):
    return r.select("read_idx", dna.reverse_complement(F.col("sequence")).alias("sequence"))


@query("SELECT read_idx, cast(round_even(length(regexp_replace(sequence, '[^GC]', '', 'g')) * 100.0::DOUBLE / length(sequence), 0) AS int) AS gc FROM reads WHERE length(sequence) > 0")
def gc_pct(r):
    return r.where(F.length("sequence") > 0).select("read_idx", dna.gc_percent(F.col("sequence")).alias("gc"))


_F = lambda b: f"length(regexp_replace(sequence, '[^{b}]', '', 'g'))::DOUBLE / length(sequence)"


@query("f AS (SELECT read_idx, " + ", ".join(f"{_F(b)} AS f{b}" for b in "ACGT") + " FROM reads WHERE length(sequence) > 0) SELECT read_idx, cast(round(10000 * (0 " + " ".join(f"- CASE WHEN f{b} > 0 THEN f{b} * log2(f{b}) ELSE 0 END" for b in "ACGT") + ") - 0.25) AS bigint) AS bits FROM f")
def complexity(r):
    """In ten-thousandths of a bit, off the rounding ties."""
    return r.where(F.length("sequence") > 0).select("read_idx", F.round(dna.complexity(F.col("sequence")) * 10000 - 0.25).cast("bigint").alias("bits"))


_COLOUR = "CASE p " + " ".join(f"WHEN '{c[:2]}' THEN '{c[2]}'" for c in dna.COLOURS) + " ELSE '.' END"


@query(f"c AS (SELECT read_idx, i, substr(sequence, i, 2) AS p FROM (SELECT *, unnest(range(1, length(sequence))) AS i FROM reads WHERE length(sequence) > 1)), e AS (SELECT read_idx, string_agg({_COLOUR}, '' ORDER BY i) AS s FROM c GROUP BY read_idx) SELECT r.read_idx, concat(substr(r.sequence, 1, 1), coalesce(e.s, '')) AS colours FROM reads r LEFT JOIN e ON e.read_idx = r.read_idx")
def colour_encode(r):
    return r.select("read_idx", dna.colour_encode(F.col("sequence")).alias("colours"))


@query("SELECT read_idx, sequence FROM reads WHERE strpos(sequence, 'N') = 0")
def colour_round_trip(r):
    s = r.where(~F.col("sequence").contains("N"))
    return s.select("read_idx", dna.colour_decode(dna.colour_encode(F.col("sequence"))).alias("sequence"))


def _in_colours(r: DataFrame) -> DataFrame:
    """The reads in colour space: the first base is the primer."""
    c = dna.colour_encode(F.col("sequence"))
    return r.withColumns({"primer": F.substring("sequence", 1, 1), "sequence": F.substring(c, F.lit(2), F.length("sequence")), "qualities": F.substring("qualities", F.lit(2), F.length("sequence"))})


def _colours_sql(table: str) -> str:
    """e: the colours of a table's sequences, of those that have any."""
    return f"c AS (SELECT read_idx, i, substr(sequence, i, 2) AS p FROM (SELECT *, unnest(range(1, length(sequence))) AS i FROM {table} WHERE length(sequence) > 1)), e AS (SELECT read_idx, string_agg({_COLOUR}, '' ORDER BY i) AS s FROM c GROUP BY read_idx)"


_CP = "strpos(s, '23031')"


@query(f"{_colours_sql('reads')}, a AS (SELECT r.read_idx, coalesce(e.s, '') AS s FROM reads r LEFT JOIN e ON e.read_idx = r.read_idx) SELECT read_idx, CASE WHEN {_CP} > 0 THEN substr(s, 1, greatest({_CP} - 2, 0)) ELSE s END AS colours, {_CP} > 0 AS trimmed FROM a")
def colour_adapter_back(r):
    out = colours.cut_colour_adapter(_in_colours(r), ad.Adapter("x", "GATTAC", max_error_rate=0.0, min_overlap=5))
    return out.select("read_idx", F.col("sequence").alias("colours"), F.col("adapter_name").isNotNull().alias("trimmed"))


@query(f"v AS (SELECT read_idx, hit AS trimmed, CASE WHEN hit THEN concat(substr(sequence, 1, 1), substr(sequence, 4)) ELSE sequence END AS sequence FROM (SELECT *, substr(sequence, 1, 1) <> 'N' AND substr(sequence, 2, 2) = 'AC' AS hit FROM reads)), {_colours_sql('v')} SELECT v.read_idx, coalesce(e.s, '') AS colours, trimmed FROM v LEFT JOIN e ON e.read_idx = v.read_idx")
def colour_adapter_prefix(r):
    """Cutting an anchored adapter and coding the first colour anew is the same as cutting its bases and encoding."""
    out = colours.cut_colour_adapter(_in_colours(r), ad.Adapter("x", "AC", "prefix", max_error_rate=0.0))
    return out.select("read_idx", F.col("sequence").alias("colours"), F.col("adapter_name").isNotNull().alias("trimmed"))


# Filters and routing


@query("SELECT read_idx FROM reads WHERE NOT length(sequence) < 100")
def filter_short(r):
    return r.where(~filters.single(filters.too_short(100))).select("read_idx")


@query("SELECT read_idx FROM reads WHERE NOT length(sequence) > 60")
def filter_long(r):
    return r.where(~filters.single(filters.too_long(60))).select("read_idx")


@query("SELECT read_idx FROM reads WHERE NOT length(regexp_replace(sequence, '[^nN]', '', 'g'))::DOUBLE / length(sequence) > 0.1 OR length(sequence) = 0")
def filter_max_n(r):
    return r.where(~filters.single(filters.n_content(0.1))).select("read_idx")


def _pair_filter(affected: int):
    return lambda r: r.where(filters.paired(filters.too_short(75), affected)).select("read_idx")


for _name, _affected, _test in (("pair_any", 1, "length(s1) < 75 OR length(s2) < 75"), ("pair_both", 2, "length(s1) < 75 AND length(s2) < 75"), ("pair_first", 0, "length(s1) < 75")):
    _f = _pair_filter(_affected)
    _f.__name__ = _name
    pair_query(f"SELECT read_idx FROM pairs WHERE {_test}")(_f)


@query("q AS (SELECT *, CASE WHEN length(sequence) < 60 THEN 'too_short' WHEN length(sequence) > 99 AND read_idx % 2 = 0 THEN 'too_long' WHEN length(regexp_replace(sequence, '[^nN]', '', 'g')) > 7 THEN 'max_n' ELSE 'main' END AS dest FROM reads) SELECT dest, count(*) AS records, cast(sum(length(sequence)) AS bigint) AS bp FROM q GROUP BY dest")
def route_dest(r):
    rules = [("too_short", filters.single(filters.too_short(60))), ("too_long", filters.single(filters.too_long(99)) & (F.col("read_idx") % 2 == 0)), ("max_n", filters.single(filters.n_content(7)))]
    return qc.totals(filters.route(r, rules), "dest").select("dest", "records", "bp")


# Adapters, exact path


def _exact(where: str, seq: str, keep: str):
    def f(r):
        return ad.cut_exact(r, ad.Adapter("x", seq, where)).select("read_idx", "sequence", F.col("adapter_name").isNotNull().alias("trimmed"))

    f.__name__ = f"adapter_exact_{where}"
    hit = {"prefix": f"starts_with(sequence, '{seq}')", "suffix": f"ends_with(sequence, '{seq}')"}.get(where, f"strpos(sequence, '{seq}') > 0")
    query(f"SELECT read_idx, CASE WHEN {hit} THEN {keep} ELSE sequence END AS sequence, {hit} AS trimmed FROM reads")(f)


_exact("back", "GATTA", "substr(sequence, 1, strpos(sequence, 'GATTA') - 1)")
_exact("front", "GATTA", "substr(sequence, strpos(sequence, 'GATTA') + 5)")
_exact("prefix", "TAC", "substr(sequence, 4)")
_exact("suffix", "AC", "substr(sequence, 1, length(sequence) - 2)")
_exact("anywhere", "TACG", "CASE WHEN strpos(sequence, 'TACG') = 1 THEN substr(sequence, 5) ELSE substr(sequence, 1, strpos(sequence, 'TACG') - 1) END")


_BEST = "CASE " + " ".join(f"WHEN strpos(sequence, '{s}') > 0 THEN '{n}'" for n, s in sorted(MOTIFS, key=lambda m: -len(m[1]))) + " ELSE 'unknown' END"


@query(f"SELECT {_BEST} AS dest, count(*) AS records, cast(sum(length(sequence)) AS bigint) AS bp FROM reads GROUP BY 1")
def demux_exact(r):
    best = ad.best_exact([ad.Adapter(n, s) for n, s in MOTIFS], F.col("sequence"))
    return qc.totals(sinks.demultiplexed(r.withColumns({"dest": F.lit("main"), "adapter_name": best})), "dest").select("dest", "records", "bp")


@query("SELECT read_idx, concat(substr(sequence, strpos(sequence, 'GATTA') + 5), ' ', name) AS value FROM reads WHERE strpos(sequence, 'GATTA') > 0 AND strpos(sequence, 'GATTA') + 5 <= length(sequence)")
def rest_file(r):
    return sinks.rest_lines(ad.rest(ad.cut_exact(r, ad.Adapter("x", "GATTA"))))


_P = "strpos(sequence, 'GATTA')"


@query(f"SELECT read_idx, CASE WHEN {_P} = 0 THEN concat_ws(chr(9), name, '-1', sequence, qualities) ELSE concat_ws(chr(9), name, '0', cast({_P} - 1 AS varchar), cast({_P} + 4 AS varchar), substr(sequence, 1, {_P} - 1), 'GATTA', substr(sequence, {_P} + 5), 'x', substr(qualities, 1, {_P} - 1), substr(qualities, {_P}, 5), substr(qualities, {_P} + 5)) END AS value FROM reads")
def info_file(r):
    return sinks.info_lines(ad.info(ad.cut_exact(r, ad.Adapter("x", "GATTA"))))


@query(f"SELECT 'x' AS adapter, 'back' AS \"end\", length(sequence) - {_P} + 1 AS length, 0 AS errors, count(*) AS n FROM reads WHERE {_P} > 0 GROUP BY 3")
def adapter_len_error_hist(r):
    return ad.length_error_histogram(ad.cut_exact(r, ad.Adapter("x", "GATTA")))


@query("SELECT read_idx, concat('@', name, chr(10), sequence, chr(10), '+', chr(10), qualities) AS fastq, concat('>', name, chr(10), sequence) AS fasta FROM reads")
def record_formats(r):
    c = F.col
    return r.select("read_idx", sinks.fastq(c("name"), c("sequence"), c("qualities")).alias("fastq"), sinks.fasta(c("name"), c("sequence")).alias("fasta"))


# Pairs


@pair_query(f"""
x AS (SELECT *, length(s1) >= 10 AND length(s2) >= 10 AS ok, {' + '.join(f'(ascii(substr(q1, {i}, 1)) - 33)' for i in range(1, 11))} AS m1, {' + '.join(f'(ascii(substr(q2, {i}, 1)) - 33)' for i in range(1, 11))} AS m2 FROM pairs)
SELECT read_idx, CASE WHEN ok AND m1 < 200 AND m2 >= 220 THEN reverse(translate(s2, 'ACGT', 'TGCA')) ELSE s1 END AS s1, CASE WHEN ok AND m2 < 200 AND m1 >= 220 THEN reverse(translate(s1, 'ACGT', 'TGCA')) ELSE s2 END AS s2 FROM x""")
def overwrite_low_quality(r):
    out = pairs.overwrite_low_quality(r, 20, 22, 10)
    return out.select("read_idx", F.col("r1.sequence").alias("s1"), F.col("r2.sequence").alias("s2"))


@pair_query("SELECT count(*) AS n_pairs, cast(sum(length(s1)) AS bigint) AS read1_bp, cast(sum(length(s2)) AS bigint) AS read2_bp FROM pairs")
def paired_totals(r):
    return r.agg(F.count(F.lit(1)).alias("n_pairs"), F.sum(F.length("r1.sequence")).alias("read1_bp"), F.sum(F.length("r2.sequence")).alias("read2_bp"))


@pair_query("d AS (SELECT *, CASE WHEN length(s1) < 75 OR length(s2) < 75 THEN 'too_short' ELSE 'main' END AS dest FROM pairs), t AS (SELECT dest, count(*) AS n_pairs, cast(sum(length(s1)) AS bigint) AS read1_bp, cast(sum(length(s2)) AS bigint) AS read2_bp FROM d GROUP BY 1) SELECT *, n_pairs::DOUBLE / sum(n_pairs) OVER () AS fraction_n_pairs, read1_bp::DOUBLE / sum(read1_bp) OVER () AS fraction_read1_bp, read2_bp::DOUBLE / sum(read2_bp) OVER () AS fraction_read2_bp FROM t")
def paired_fractions(r):
    out = pair_summary(TrimPlan.of(TrimOptions(minimum_length=75)).run_pairs(r))
    return out.select("dest", "n_pairs", "read1_bp", "read2_bp", "fraction_n_pairs", "fraction_read1_bp", "fraction_read2_bp")


# Statistics


@query("SELECT length(sequence) AS read_length, count(*) AS n FROM reads GROUP BY 1")
def qc_length_hist(r):
    return qc.length_histogram(r)


@query("SELECT cast(round_even(length(regexp_replace(sequence, '[^GC]', '', 'g')) * 100.0::DOUBLE / length(sequence), 0) AS int) AS gc, count(*) AS n FROM reads WHERE length(sequence) > 0 GROUP BY 1")
def qc_gc_hist(r):
    return qc.gc_histogram(r)


_POS = "pos AS (SELECT read_idx, name, i, substr(sequence, i, 1) AS c, ascii(substr(qualities, i, 1)) - 33 AS q FROM (SELECT *, unnest(range(1, length(sequence) + 1)) AS i FROM reads))"


@query(f"{_POS}, m AS (SELECT read_idx, cast(round_even(sum(q) * 1.0::DOUBLE / count(*), 0) AS int) AS mean_quality FROM pos GROUP BY 1) SELECT mean_quality, count(*) AS n FROM m GROUP BY 1")
def qc_meanqual_hist(r):
    return qc.quality_histogram(r)


@query(f"{_POS} SELECT i AS position, c AS base, count(*) AS n FROM pos GROUP BY 1, 2")
def qc_pos_base(r):
    return qc.position_bases(r)


@query(f"{_POS} SELECT i AS position, q AS quality, count(*) AS n FROM pos GROUP BY 1, 2")
def qc_pos_qual(r):
    return qc.position_qualities(r)


@query(f"{_POS}, m AS (SELECT read_idx, split_part(name, ':', 5) AS tile, cast(round_even(sum(q) * 1.0::DOUBLE / count(*), 0) AS int) AS mean_quality FROM pos GROUP BY 1, 2) SELECT tile, mean_quality, count(*) AS n FROM m GROUP BY 1, 2")
def qc_tile(r):
    return qc.tile_qualities(r)


@query(f"{_POS} SELECT i AS position, split_part(name, ':', 5) AS tile, q AS quality, count(*) AS n FROM pos GROUP BY 1, 2, 3")
def qc_pos_tile(r):
    return qc.position_tile_qualities(r)


@query("SELECT cast(sum(length(sequence)) AS bigint) * 1.0::DOUBLE / count(*) AS mean, median(length(sequence)) AS median FROM reads")
def qc_length_summary(r):
    return qc.summary(qc.length_histogram(r), "read_length").select("mean", "median")


# Error rates and contaminants


@query(f"{_POS} SELECT cast(count(*) AS bigint) AS bases, cast(round(sum(pow(10.0::DOUBLE, -q / 10.0::DOUBLE)) * 1000) AS bigint) AS errors FROM pos")
def error_rate_quality(r):
    return error.quality_error_rate(r).select("bases", F.round(F.col("errors") * 1000).cast("bigint").alias("errors"))


_K = lambda k: f"k AS (SELECT DISTINCT sequence FROM reads), km AS (SELECT sequence, substr(sequence, i, {k}) AS kmer FROM (SELECT *, unnest(range(1, length(sequence) - {k} + 2)) AS i FROM k WHERE length(sequence) >= {k}))"


@query(f"{_K(8)} SELECT kmer, count(*) AS n FROM km GROUP BY 1")
def kmer_count(r):
    return detect.kmer_counts(r.select("sequence").distinct(), 8)


_KNOWN = (("k1", "TACGTACGTACGAAGT"), ("k2", "GCCATTAGGACGTTAC"))


def _known_sql() -> str:
    rows = []
    for name, seq in _KNOWN:
        for strand, s in (("+", seq), ("-", seq.translate(str.maketrans("ACGT", "TGCA"))[::-1])):
            own = sorted({s[i : i + 4] for i in range(len(s) - 3)})
            rows += [f"('{name}', '{strand}', '{x}', {len(own)})" for x in own]
    return f"""{_K(4)}, d AS (SELECT DISTINCT sequence, kmer FROM km), m AS (SELECT sequence, count(*) AS m FROM d GROUP BY 1),
known(name, strand, kmer, known) AS (VALUES {', '.join(rows)}),
h AS (SELECT d.sequence, name, strand, count(*) AS c, max(known) AS known FROM d JOIN known ON d.kmer = known.kmer GROUP BY 1, 2, 3),
best AS (SELECT h.sequence, name, max(c * 1.0::DOUBLE / m.m) AS f, max(c * 1.0::DOUBLE / known) AS kf FROM h JOIN m ON m.sequence = h.sequence GROUP BY 1, 2)
SELECT name, count(*) AS reads, max(kf) AS kmer_fraction FROM best WHERE f > 0.05 GROUP BY 1"""


@query(_known_sql())
def kmer_known_frac(r):
    return detect.known_fractions(r, list(_KNOWN), 4, 0.05)


@query("u AS (SELECT DISTINCT sequence FROM reads) " + " UNION ALL ".join(f"SELECT '{s}' AS candidate, cast(count(*) AS bigint) AS n FROM u WHERE strpos(sequence, '{s}') > 0" for _, s in MOTIFS))
def abundance(r):
    return detect.abundance(r, [s for _, s in MOTIFS])


@query("SELECT sequence, count(*) AS n FROM reads WHERE length(sequence) > 0 AND strpos(sequence, 'N') = 0 AND sequence <> repeat(substr(sequence, 1, 1), length(sequence)) GROUP BY 1")
def read_counts(r):
    return error.usable_read_counts(r)


# Whole plans


@query(_bwa("10 - q", None).replace("\nSELECT read_idx, CASE", "\n, t AS (SELECT read_idx, CASE", 1) + ") SELECT CASE WHEN length(sequence) < 20 THEN 'too_short' ELSE 'main' END AS dest, count(*) AS records, cast(sum(length(sequence)) AS bigint) AS bp FROM t GROUP BY 1")
def trim_quality_minlen(r):
    plan = TrimPlan.of(TrimOptions(quality_cutoff=[10], minimum_length=20))
    return summary(plan.run(r)).select("dest", "records", "bp")


_S = "z AS (SELECT read_idx, sequence AS s, qualities AS q FROM reads), "


def _match_query(name: str, adapters: list[ad.Adapter], times: int = 1, action: str = "trim"):
    def f(r):
        out = ad.cut_adapters(r, adapters, times=times, action=action)
        return out.select("read_idx", "sequence", "qualities", "adapter_name", F.size("matches").alias("n_matches"))

    f.__name__ = name
    shown = "s AS sequence, q AS qualities" if action == "trim" else "concat(repeat('N', front), s, repeat('N', back)) AS sequence, r.qualities"
    query(f"{_S}{oracles.rounds('z', 'w', adapters, times)} SELECT w.read_idx, {shown}, w.name AS adapter_name, n AS n_matches FROM w" + ("" if action == "trim" else " JOIN reads r ON r.read_idx = w.read_idx"))(f)


_match_query("adapter_dp_back", [ad.parse("x=TACGTACGTACGAAGT", max_error_rate=0.2)])
_match_query("adapter_dp_front", [ad.parse("x=GATTACAGG", "front", max_error_rate=0.25)])
_match_query("adapter_dp_prefix", [ad.parse("x=^TACGTAC", "front", max_error_rate=0.3)])
_match_query("adapter_dp_suffix", [ad.parse("x=GCATGCA$", max_error_rate=0.3)])
_match_query("adapter_dp_anywhere_times", ad.parse_all([("anywhere", "a=GATTACAGG"), ("back", "b=CCATTNGGA")], max_error_rate=0.2), times=2)
_match_query("adapter_indel_cost", [ad.parse("x=CCATTAGGAC", max_error_rate=0.3, indel_cost=2)])
_match_query("adapter_mask", [ad.parse("x=ACGTNACGT")], action="mask")
# Anchored adapters without gaps: the reads' ends are compared, no matrix.
_match_query("adapter_hamming_prefix", [ad.parse("x=^TACGTACG", "front", max_error_rate=0.4, indels=False)])
_match_query("adapter_hamming_suffix", [ad.parse("x=GCATGCAT$", max_error_rate=0.4, indels=False)])

_LINKED = ad.parse("x=TA...GATTACA", max_error_rate=0.2)


@query(f"""{_S}{oracles.align('z', 'f', replace(_LINKED, where='prefix', back=None))}, y AS (SELECT z.read_idx, substr(s, rstop + 1) AS s, substr(q, rstop + 1) AS q FROM z JOIN f ON f.read_idx = z.read_idx), {oracles.align('y', 'g', _LINKED.back)}
SELECT z.read_idx, CASE WHEN y.s IS NULL THEN z.s WHEN g.k IS NULL THEN y.s ELSE substr(y.s, 1, g.rstart) END AS sequence, CASE WHEN y.s IS NULL THEN z.q WHEN g.k IS NULL THEN y.q ELSE substr(y.q, 1, g.rstart) END AS qualities,
CASE WHEN y.s IS NOT NULL THEN 'x' END AS adapter_name, (y.s IS NOT NULL)::INT + (g.k IS NOT NULL)::INT AS n_matches FROM z LEFT JOIN y ON y.read_idx = z.read_idx LEFT JOIN g ON g.read_idx = z.read_idx""")
def linked(r):
    out = ad.cut_adapters(r, [_LINKED])
    return out.select("read_idx", "sequence", "qualities", "adapter_name", F.size("matches").alias("n_matches"))


_A1, _A2 = (ad.Adapter(n, s, adapter_wildcards=False) for n, s in (("a1", ADAPTER1), ("a2", ADAPTER2)))
_CUT = oracles.inserts(_A1, _A2)
_END = lambda t, k: f"substr({t}{k}, 1, coalesce(r{k}, length(s{k})))"


@pair_query(f"{_CUT} SELECT read_idx, {_END('s', 1)} AS s1, {_END('s', 2)} AS s2, r1 IS NOT NULL AS a1, r2 IS NOT NULL AS a2, overlap FROM cut")
def insert_adapters(r):
    out = pairs.cut_insert_adapters(r, _A1, _A2)
    c = F.col
    return out.select("read_idx", c("r1.sequence").alias("s1"), c("r2.sequence").alias("s2"), c("r1.adapter_name").isNotNull().alias("a1"), c("r2.adapter_name").isNotNull().alias("a2"), c("r1.insert_overlap").alias("overlap"))


@pair_query(f"{_CUT}, {oracles.corrected()} SELECT read_idx, {_END('s', 1)} AS s1, {_END('q', 1)} AS q1, {_END('s', 2)} AS s2, {_END('q', 2)} AS q2, c1::INT AS corrected1, c2::INT AS corrected2 FROM fixed")
def correct_mismatches(r):
    out = pairs.cut_insert_adapters(r, _A1, _A2, correct="liberal")
    return out.select("read_idx", *[F.col(f"r{k}.{n}").alias(a) for k in "12" for n, a in (("sequence", f"s{k}"), ("qualities", f"q{k}"), ("corrected", f"corrected{k}"))])


@query(source=pair_reads)
def merge_overlap(r):
    out = pairs.merge_overlapping(pairs.cut_insert_adapters(r, _A1, _A2))
    return out.select("read_idx", F.col("r1.sequence").alias("sequence"), F.col("r1.qualities").alias("qualities"), F.col("r1.merged").alias("merged"))


_PLAN = TrimPlan.of(TrimOptions(adapters=[("back", ADAPTER1)], adapters2=[("back", ADAPTER2)], aligner="insert", quality_cutoff=[10], minimum_length=25, op_order="GACQW"))


def _trim_paired_sql() -> str:
    """Insert adapters, then the 3' trims of both mates by windows, then the length filter."""
    trims = ""
    for k in (1, 2):
        trims += f""", t{k} AS (SELECT read_idx, {_END('s', k)} AS s, {_END('q', k)} AS q FROM cut),
t{k}p AS (SELECT read_idx, i, 10 - (ascii(substr(q, i, 1)) - 33) AS x FROM (SELECT *, unnest(range(1, length(s) + 1)) AS i FROM t{k})),
t{k}s AS (SELECT read_idx, i, sum(x) OVER (PARTITION BY read_idx ORDER BY i DESC ROWS UNBOUNDED PRECEDING) AS x FROM t{k}p),
t{k}f AS (SELECT read_idx, max(i) AS stop FROM t{k}s WHERE x < 0 GROUP BY 1),
t{k}m AS (SELECT a.read_idx, arg_max(a.i, (a.x, a.i)) AS i FROM t{k}s a LEFT JOIN t{k}f b ON b.read_idx = a.read_idx WHERE a.x > 0 AND (b.stop IS NULL OR a.i > b.stop) GROUP BY 1),
t{k}n AS (SELECT t{k}.read_idx, coalesce(m.i - 1, length(s)) AS n FROM t{k} LEFT JOIN t{k}m m ON m.read_idx = t{k}.read_idx)"""
    return f"{oracles.inserts(_PLAN.adapters1[0], _PLAN.adapters2[0])}{trims} SELECT CASE WHEN a.n < 25 OR b.n < 25 THEN 'too_short' ELSE 'main' END AS dest, count(*) AS n_pairs, sum(a.n)::BIGINT AS read1_bp, sum(b.n)::BIGINT AS read2_bp FROM t1n a JOIN t2n b ON b.read_idx = a.read_idx GROUP BY 1"


@pair_query(_trim_paired_sql())
def trim_paired(r):
    return _PLAN.run_pairs(r).groupBy("dest").agg(F.count(F.lit(1)).alias("n_pairs"), F.sum(F.length("r1.sequence")).alias("read1_bp"), F.sum(F.length("r2.sequence")).alias("read2_bp"))


# Files


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reads written as FASTQ files and scanned again, in parts that break records."""
    path = fresh(spark, "fastq")
    sinks.write(sinks.records(reads(spark, sf_dir), "fastq"), path, ordered=True)
    return records.read_fastq(spark, path, split=1_000_003)


@query("SELECT row_number() OVER (ORDER BY read_idx) AS read_idx, name, sequence, qualities FROM reads", _files)
def scan_fastq(r):
    return _shown(r)


# Detection


@query(source=sequences)
def detect_heuristic(r):
    found = detect.detect(r, list(_KNOWN), max_reads=None)
    return r.sparkSession.createDataFrame([(c.sequence, c.count, ",".join(c.known)) for c in found], "sequence string, n bigint, known string")


@query("""u AS (SELECT sequence, count(*)::DOUBLE AS n, length(sequence) AS l FROM reads WHERE sequence <> '' AND strpos(sequence, 'N') = 0 AND sequence <> repeat(substr(sequence, 1, 1), length(sequence)) GROUP BY 1),
m AS (SELECT l, i, concat(substr(sequence, 1, i - 1), '*', substr(sequence, i + 1)) AS s, n FROM (SELECT *, unnest(range(1, l + 1)) AS i FROM u)),
g AS (SELECT sum(n) AS s, sum(n * n) AS q FROM m GROUP BY l, i, m.s), p AS (SELECT coalesce(sum(s * s - q), 0) AS products FROM g),
w AS (SELECT sum(l)::BIGINT AS bases, avg(l) AS l, sum(n * n) AS squares FROM u)
SELECT bases, round(products / squares * 1e9)::BIGINT AS slope, round((1 - pow(1 / (1 + products / squares), 1 / l)) * 1e12)::BIGINT AS error_rate FROM w, p""")
def shadow_regression(r):
    """Slope and rate in steps of 10 ** -9 and 10 ** -12."""
    out = error.shadow_error_rate(r)
    return out.select("bases", F.round(F.col("slope") * 1e9).cast("bigint").alias("slope"), F.round(F.col("error_rate") * 1e12).cast("bigint").alias("error_rate"))
