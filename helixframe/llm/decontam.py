"""Benchmark decontamination by template windows, with DataFrame functions only.

Texts become tokens; numbers, names and units become typed placeholders, so a question asked again with other values has
the same template. A name is a word with a capital that is no common word, or a few capitals that don't stand beside other
words in capitals: what stands before a word, or that it opens a sentence, makes no difference. Windows of the template are hashed and joined. The slots of windows that meet on one alignment must be
consistent: a value of the item stands for one and the same value wherever it returns in the document. An item leaks into
a document if the consistent alignments cover enough of its windows.

Null and empty texts have no windows and match nothing. A very long text is one row of tokens; only windows that hit leave
it. An empty table of either kind gives no row. A short item, below a window's length, is one window of its own
length. An item without a window of enough literals is one window as a whole; if it holds too few literals even so, that
window matches only tokens that are all equal. Items with equal texts all match. Documents are told apart by id and text: rows that agree in both are one, texts of one id
are judged each for itself, and so are texts without an id. Ties don't arise. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import stored

#: Template tokens in a window; how many of these at least are no placeholders; the share of windows that makes a leak.
WINDOW, LITERALS, COVERED = 8, 4, 0.5
#: The benchmark's windows are broadcast only up to this count (of about 60 bytes each); beyond it the join shuffles, and
#: windows that very many documents share are split by the engine.
BROADCAST_ROWS = 500_000

#: Words that count as units. A parameter.
UNITS = (
    "mm cm m km in ft yd mi mg g kg t lb lbs oz ml cl l s sec min h hr hrs ms hz khz mhz ghz kb mb gb tb v kv w kw kwh j kj cal kcal"
    " inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers kilometre kilometres gram grams kilogram"
    " kilograms pound pounds ounce ounces liter liters litre litres second seconds minute minutes hour hours day days week weeks month"
    " months year years dollar dollars euro euros cent cents percent degree degrees"
).split()

#: Words that are no names when they have a capital. A parameter.
COMMON = (
    "a an the what which who when where why how if it is are was were does do did can could will would should in on at for from to of and or but"
    " not this that these those there they he she we you his her their its our my your then now after before each every all some one two i"
    " der die das den dem ein eine einen wie wer wo wann warum wenn ist sind und oder aber im am auf für von zu mit nach es er sie wir ihr"
    " le la les un une des du de et ou mais qui que quel quelle comment pourquoi quand si il elle nous vous ils dans sur pour"
    " el los las una y o pero qué quién cuál cómo cuándo dónde por para en del"
).split()

#: Marks before a name, a number and a word in capitals, and how many of these are a name at most.
_NAME, _NUMBER, _CAPITALS = "\u0002", "\u0003", "\u0004"
ACRONYM = 5


def tokens(text: Column) -> Column:
    """Words and numbers in order, in lower case; numbers and names are marked."""
    plain = F.translate(F.coalesce(text, F.lit("")), _NAME + _NUMBER + _CAPITALS, "   ")
    # The capital comes first: the look behind it is only taken where there is one.
    named = F.regexp_replace(plain, r"\p{Lu}(?<![\p{L}\p{M}]\p{Lu})\p{Ll}", f"{_NAME}$0")
    capital = F.regexp_replace(named, r"\p{Lu}(?<![\p{L}\p{M}]\p{Lu})\p{Lu}++(?![\p{L}\p{M}])", f"{_CAPITALS}$0")
    counted = F.regexp_replace(capital, r"\p{N}+(?:[.,:/]\p{N}+)*", f" {_NUMBER}$0 ")
    raw = F.regexp_extract_all(F.lower(counted), F.lit(f"[{_NAME}{_CAPITALS}]?[\\p{{L}}\\p{{M}}]+|{_NUMBER}[^ ]+"), F.lit(0))

    def settled(all_: Column) -> Column:
        beside = lambda i: F.coalesce(F.get(all_, i).startswith(_CAPITALS), F.lit(False))

        def one(t: Column, i: Column) -> Column:
            bare = F.substring(t, F.lit(2), F.length(t))
            short = (F.length(t) <= ACRONYM + 1) & ~beside(i - 1) & ~beside(i + 1) & ~bare.isin(*COMMON)
            return F.when(t.startswith(_NAME), F.when(bare.isin(*COMMON), bare).otherwise(t)).when(t.startswith(_CAPITALS), F.when(short, F.concat(F.lit(_NAME), bare)).otherwise(bare)).otherwise(t)

        return F.transform(all_, one)

    return _let(raw, settled)


def canonical(token: Column) -> Column:
    """The token in the template."""
    return F.when(token.startswith(_NAME), F.lit("<name>")).when(token.startswith(_NUMBER), F.lit("<num>")).when(token.isin(UNITS), F.lit("<unit>")).otherwise(token)


def _let(value: Column, use) -> Column:
    """use(value) with the value computed once: an expression inside a lambda would be computed for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _hashed(h: Column, size: int) -> Column:
    """Hashes of runs of size elements of h, from pairs of shorter runs; the last size - 1 have no meaning."""
    if size == 1:
        return h
    k = size // 2
    pair = lambda a, b: F.xxhash64(a, b)
    if 2 * k == size:
        return _let(_hashed(h, k), lambda v: F.zip_with(v, F.slice(v, k + 1, F.size(v)), pair))
    return F.zip_with(_hashed(h, k), F.slice(_hashed(h, size - k), k + 1, F.size(h)), pair)


def _windows(toks: Column, size: int, exact: bool = False) -> Column:
    """Hashes of all windows of a size over tokens, of the template or of the tokens, by position; none if they are fewer."""
    return _let(_token_hashes(toks, exact), lambda h: _runs(h, size))


def _token_hashes(toks: Column, exact: bool) -> Column:
    return F.transform(toks, lambda t: F.xxhash64(t if exact else canonical(t)))


def _runs(h: Column, size: int) -> Column:
    """Hashes of all runs of a size."""
    n = F.size(h) - size + 1
    return F.when(n > 0, F.slice(_hashed(h, size), 1, F.greatest(n, F.lit(0)))).otherwise(F.array().cast("array<bigint>"))


def _all_windows(toks: Column, sizes: list[tuple[int, bool]]) -> Column:
    """struct(size, exact, p, h) of the windows of all sizes; the tokens are hashed once for each kind."""
    parts = []
    for kind in (False, True):
        own = [size for size, exact in sizes if exact == kind]
        if own:
            spot = lambda size: lambda h, p: F.struct(F.lit(size).alias("size"), F.lit(kind).alias("exact"), p.alias("p"), h.alias("h"))  # noqa: B023, E731
            parts.append(_let(_token_hashes(toks, kind), lambda h: F.concat(*[F.transform(_runs(h, size), spot(size)) for size in own])))  # noqa: B023
    return F.concat(*parts)


def _slots(at: Column, size: Column) -> Column:
    """Values of the placeholders in a window; null for literals."""
    return F.transform(F.slice("toks", at, size), lambda t: F.when(canonical(t).startswith("<"), t))


def benchmark_windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW, literals: int = LITERALS) -> DataFrame:
    """h, item_id, ipos, size, exact, item_windows, item_slots: windows with enough literal tokens, else whole items.

    exact: h is of the tokens themselves, not of the template."""
    items = stored(benchmark.select(benchmark[id_col].alias("item_id"), tokens(benchmark[text_col]).alias("toks")).where(F.size("toks") > 0), "bench-tokens")
    items = items.withColumn("size", F.least(F.size("toks"), F.lit(window)))
    rows = None
    for (size,) in items.select("size").distinct().orderBy("size").collect():
        part = items.where(F.col("size") == size).select("item_id", "toks", "size", F.posexplode(_windows(F.col("toks"), size)).alias("p", "h")).withColumn("ipos", F.col("p") + 1)
        rows = part if rows is None else rows.unionByName(part)
    if rows is None:
        rows = items.select("item_id", "toks", "size", F.lit(0).alias("p"), F.lit(0).cast("bigint").alias("h"), F.lit(1).alias("ipos"))
    rows = rows.withColumn("item_slots", _slots(F.col("ipos"), F.col("size")))
    spoken = F.size(F.filter("item_slots", lambda v: v.isNull()))
    rows = rows.where(spoken >= F.least(F.lit(literals), F.col("size"))).select("h", "item_id", "ipos", "size", F.lit(False).alias("exact"), "item_slots")
    poor = items.join(rows.select("item_id").distinct(), "item_id", "left_anti").select("item_id", "toks", F.size("toks").alias("size"))
    poor = poor.withColumn("exact", F.size(F.filter("toks", lambda t: ~canonical(t).startswith("<"))) < literals)
    for size, exact in sorted(map(tuple, poor.select("size", "exact").distinct().collect())):
        part = poor.where((F.col("size") == size) & (F.col("exact") == exact))
        h = F.get(_windows(F.col("toks"), size, exact), F.lit(0)).alias("h")
        rows = rows.unionByName(part.select(h, "item_id", F.lit(1).alias("ipos"), "size", "exact", _slots(F.lit(1), F.col("size")).alias("item_slots")))
    total = rows.groupBy("item_id").agg(F.countDistinct("ipos").cast("int").alias("item_windows"))
    return rows.join(total, "item_id").distinct()


def matches(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    literals: int = LITERALS,
    covered: float = COVERED,
) -> DataFrame:
    """id, item_id, matched_windows, item_windows, coverage, reparameterised: the items that leak into each document.

    reparameterised: a slot's value differs from the item's. Documents without a leak have no row.
    """
    bench = stored(benchmark_windows(benchmark, "item_id", "text", window, literals), "bench-windows")
    sizes, n = [], 0
    # The sizes: window at most, and the lengths of whole items.
    for size, exact, count in bench.groupBy("size", "exact").count().orderBy("size", "exact").collect():
        sizes.append((size, exact))
        n += count
    if n <= BROADCAST_ROWS:
        bench = F.broadcast(bench)
    texts = docs.select(docs[id_col].alias("id"), F.xxhash64(docs[text_col]).alias("same"), tokens(docs[text_col]).alias("toks"))
    # Windows of all sizes in one pass. The join's look at the hash runs inside the scan's stage: only windows that hit leave it.
    sizes = sizes or [(window, False)]
    if len(sizes) == 1:
        size, exact = sizes[0]
        each = texts.select("id", "same", "toks", F.posexplode(_windows(F.col("toks"), size, exact)).alias("p", "dh"), F.lit(size).alias("dsize"), F.lit(exact).alias("dexact")).withColumn("dpos", F.col("p") + 1)
    else:
        each = texts.select("id", "same", "toks", F.explode(_all_windows(F.col("toks"), sizes)).alias("w"))
        each = each.select("id", "same", "toks", F.col("w.h").alias("dh"), F.col("w.size").alias("dsize"), F.col("w.exact").alias("dexact"), (F.col("w.p") + 1).alias("dpos"))
    hit = each.join(bench, (F.col("dh") == F.col("h")) & (F.col("dsize") == F.col("size")) & (F.col("dexact") == F.col("exact")))
    out = hit.select("id", "same", "item_id", "ipos", "item_windows", (F.col("dpos") - F.col("ipos")).alias("shift"), "item_slots", _slots(F.col("dpos"), F.col("size")).alias("doc_slots"))
    pairs = F.filter(F.arrays_zip(F.col("item_slots").alias("i"), F.col("doc_slots").alias("d")), lambda p: p["i"].isNotNull())
    lines = out.withColumn("pairs", pairs).groupBy("id", "same", "item_id", "shift").agg(
        F.collect_set("ipos").alias("at"),
        F.max("item_windows").alias("item_windows"),
        F.array_distinct(F.flatten(F.collect_set("pairs"))).alias("pairs"),
    )
    lines = lines.where(F.size(F.array_distinct(F.transform("pairs", lambda p: p["i"]))) == F.size("pairs"))
    by = lines.groupBy("id", "same", "item_id").agg(
        F.size(F.array_distinct(F.flatten(F.collect_set("at")))).alias("matched_windows"),
        F.max("item_windows").alias("item_windows"),
        F.max(F.exists("pairs", lambda p: ~p["i"].eqNullSafe(p["d"]))).alias("reparameterised"),
    )
    by = by.withColumn("coverage", F.col("matched_windows") / F.col("item_windows")).where(F.col("coverage") >= covered)
    return by.select(F.col("id").alias(id_col), "item_id", "matched_windows", "item_windows", "coverage", "reparameterised")


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """The documents into which no item leaks. Rows of one id go if any of its texts holds a leak; a row whose id is null is
    kept, so give a column that has none (a hash of the text) for id_col where ids may be missing."""
    return docs.join(matches(docs, benchmark, id_col, **how).select(id_col).distinct(), id_col, "left_anti")


def query(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document and item that leaks into it."""
    return matches(docs, benchmark)
