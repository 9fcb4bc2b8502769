"""The ten operators as queries over the corpus tables: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from helixframe.llm import decontam, html_text, langid, licenses, media, mixing, neardup, quality, toxicity, url_filter
from helixframe.llm.common import read_table


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.query(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_digest(read_table(spark, sf_dir, "documents"))


def op3_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.query(read_table(spark, sf_dir, "documents"))


def op4_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op5_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.query(read_table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.query(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.query(read_table(spark, sf_dir, "pages"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.query(read_table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.query(read_table(spark, sf_dir, "documents"))


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(read_table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_benchmark_decontamination,
        op2_media_columns,
        op3_license_scans,
        op4_mixing_sources,
        op5_minhash_neardup,
        op6_toxicity,
        op7_html_extraction,
        op8_quality_classifier,
        op9_language_id,
        op10_url_filters,
    )
}

_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def _url_sql() -> str:
    """The rules, longest first, as CASE; then the listed hosts."""
    fits = lambda h: f"(host = '{h}' OR ends_with(host, '.{h}'))"
    rules = sorted(url_filter.RULES, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r[1]))
    case = lambda pick: " ".join(f"WHEN {fits(h)} AND starts_with(path, '{p}') THEN '{pick(v, h, p)}'" for v, h, p in rules)
    listed = " OR ".join(fits(h) for h in url_filter.BLOCKED_HOSTS)
    return f"""WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), {_LOWER}) AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u)
SELECT page_id, host, path, CASE {case(lambda v, h, p: h + p)} ELSE NULL END AS rule,
CASE {case(lambda v, h, p: v)} WHEN {listed} THEN 'block' ELSE 'allow' END AS verdict, ({listed}) AS listed FROM h"""


def _tokens_sql(text: str) -> str:
    """Tokens of a text as (lower case, class); classes are told from the tokens themselves, not from marks in the text."""
    raw = rf"regexp_extract_all(coalesce({text}, ''), '\p{{N}}+(?:[.,:/]\p{{N}}+)*|[\p{{L}}\p{{M}}]+')"
    common, units = (", ".join(f"'{x}'" for x in words) for words in (decontam.COMMON, decontam.UNITS))
    capitals = lambda x: rf"regexp_full_match(coalesce({x}, ''), '\p{{Lu}}{{2,}}')"
    return rf"""[{{'t': lower(x), 'c': CASE WHEN regexp_matches(x, '^\p{{N}}') THEN '<num>' WHEN lower(x) IN ({common}) AND lower(x) IN ({units}) THEN '<unit>' WHEN lower(x) IN ({common}) THEN lower(x) WHEN regexp_matches(x, '^\p{{Lu}}\p{{Ll}}') THEN '<name>'
  WHEN {capitals('x')} AND length(x) <= {decontam.ACRONYM} AND NOT {capitals('raw[i - 1]')} AND NOT {capitals('raw[i + 1]')} THEN '<name>' WHEN lower(x) IN ({units}) THEN '<unit>' ELSE lower(x) END}} for x, i in raw] AS tc FROM (SELECT *, {raw} AS raw FROM """


def _leaks_sql() -> str:
    return f"""WITH b0 AS (SELECT item_id, {_tokens_sql('text')} benchmark)),
b1 AS (SELECT item_id, [x.t for x in tc] AS toks, [x.c for x in tc] AS can, least(len(tc), {decontam.WINDOW}) AS size FROM b0 WHERE len(tc) > 0),
b2 AS (SELECT *, unnest(range(1, len(toks) - size + 2)) AS ipos FROM b1),
b3 AS (SELECT DISTINCT item_id, size, ipos, can[ipos:ipos + size - 1] AS can, toks[ipos:ipos + size - 1] AS toks FROM b2),
b4 AS (SELECT * FROM b3 WHERE len([c for c in can if NOT starts_with(c, '<')]) >= least({decontam.LITERALS}, size)),
n AS (SELECT item_id, count(DISTINCT ipos) AS item_windows FROM b4 GROUP BY 1),
d0 AS (SELECT doc_id, {_tokens_sql('text')} documents)),
d1 AS (SELECT doc_id, [x.t for x in tc] AS toks, [x.c for x in tc] AS can FROM d0),
d2 AS (SELECT *, unnest(range(1, len(toks) - size + 2)) AS dpos FROM d1, (SELECT DISTINCT size FROM b4) WHERE len(toks) >= size),
d3 AS (SELECT doc_id, size, dpos, can[dpos:dpos + size - 1] AS can, toks[dpos:dpos + size - 1] AS toks FROM d2),
m AS (SELECT doc_id, item_id, ipos, dpos - ipos AS shift, d3.can AS can, b4.toks AS i, d3.toks AS d FROM d3 JOIN b4 ON d3.size = b4.size AND d3.can = b4.can),
v AS (SELECT doc_id, item_id, shift, unnest(can) AS c, unnest(i) AS i, unnest(d) AS d FROM m),
s AS (SELECT doc_id, item_id, shift, count(DISTINCT i) <> count(DISTINCT (i, d)) AS clash, bool_or(i <> d) AS other FROM v WHERE starts_with(c, '<') GROUP BY 1, 2, 3),
k AS (SELECT m.doc_id, m.item_id, m.ipos, coalesce(s.other, false) AS other FROM m LEFT JOIN s ON m.doc_id = s.doc_id AND m.item_id = s.item_id AND m.shift = s.shift WHERE NOT coalesce(s.clash, false)),
r AS (SELECT k.doc_id, k.item_id, cast(count(DISTINCT ipos) AS int) AS matched_windows, cast(max(item_windows) AS int) AS item_windows, bool_or(other) AS reparameterised FROM k JOIN n ON k.item_id = n.item_id GROUP BY 1, 2)
SELECT doc_id, item_id, matched_windows, item_windows, matched_windows::DOUBLE / item_windows AS coverage, reparameterised FROM r WHERE matched_windows::DOUBLE / item_windows >= {decontam.COVERED}"""


def _licenses_sql() -> str:
    """All lines, paragraphs and sentences of all texts against all templates: the anchors and the bound on other words, which
    spare the query most of them, are left out."""
    idf, vectors, other = licenses._model(licenses.TEMPLATES)
    terms = ", ".join(f"('{w}', {x:.17e})" for w, x in sorted(idf.items()))
    weights = ", ".join(f"({i}, '{licenses.TEMPLATES[i][0]}', {licenses.rank(licenses.TEMPLATES[i])}, '{w}', {x:.17e})" for i, v in enumerate(vectors) for w, x in v.items())
    stop = ", ".join(f"'{w}'" for w in licenses.STOP)
    end = r"(?:\r\n|[\n\x0B\f\r\x{85}\x{2028}\x{2029}])"
    split = lambda by: f"string_split_regex(t, '{by}')"
    return rf"""WITH idf(term, idf) AS (VALUES {terms}), tpl(template, license, rank, term, weight) AS (VALUES {weights}),
f AS (SELECT doc_id, regexp_replace(lower(coalesce(text, '')), '(?m){licenses.COMMENT}', '', 'g') AS t, coalesce(source, 'none') AS src, concat(coalesce(source, 'none'), '/', coalesce(lang, 'none'), '/', cast(cast(floor(doc_id / 100) AS bigint) AS varchar)) AS folder FROM documents),
paths AS (SELECT doc_id, CASE WHEN doc_id % 1000 = 0 THEN src ELSE folder END AS dir,
  CASE WHEN doc_id % 1000 = 0 THEN 'LICENSE' WHEN doc_id % 10 = 0 THEN concat('LICENSE-', cast(doc_id % 100 AS varchar), '.txt') ELSE concat(cast(doc_id AS varchar), '.txt') END AS file FROM f),
long AS (SELECT doc_id, list_concat({split(end)}, {split(end + r"[ \t\n\x0B\f\r]*" + end)}) AS us FROM f),
spoken AS (SELECT doc_id, unnest(us) AS unit FROM long),
sentences AS (SELECT doc_id, unnest(string_split(regexp_replace(unit, '{licenses.SENTENCE}', '\1' || chr(1), 'g'), chr(1))) AS unit FROM spoken),
units AS (SELECT doc_id, unit FROM spoken UNION SELECT doc_id, unit FROM sentences),
u AS (SELECT doc_id, row_number() OVER () AS u, unit FROM units),
w AS (SELECT doc_id, u, unnest(regexp_extract_all(unit, '{licenses._TERM}')) AS term FROM u),
tf AS (SELECT doc_id, u, w.term, count(*) * coalesce(any_value(idf), {other:.17e}) AS x FROM w LEFT JOIN idf ON idf.term = w.term WHERE w.term NOT IN ({stop}) GROUP BY 1, 2, 3),
norm AS (SELECT u, sqrt(sum(x * x)) AS norm, CASE count(*) WHEN 1 THEN 2 WHEN 2 THEN {licenses.LEAST_OF_TWO} ELSE {licenses.LEAST} END AS bar FROM tf GROUP BY 1),
dot AS (SELECT doc_id, u, template, license, rank, sum(weight * x) AS dot FROM tf JOIN tpl ON tpl.term = tf.term GROUP BY 1, 2, 3, 4, 5),
scored AS (SELECT doc_id, license, rank, round(dot / norm, 6) AS score, bar FROM dot JOIN norm ON norm.u = dot.u),
own AS (SELECT doc_id, license, score FROM scored WHERE score >= bar QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY rank DESC, score DESC, license) = 1),
held AS (SELECT dir, license, score FROM paths JOIN own ON own.doc_id = paths.doc_id WHERE regexp_matches(file, '{licenses.LICENSE_FILE}') QUALIFY row_number() OVER (PARTITION BY dir ORDER BY score DESC, file) = 1),
near AS (SELECT d.dir, h.dir AS up, h.license, h.score FROM (SELECT DISTINCT dir FROM paths) d JOIN held h ON d.dir = h.dir OR starts_with(d.dir, concat(h.dir, '/')) QUALIFY row_number() OVER (PARTITION BY d.dir ORDER BY length(h.dir) DESC) = 1)
SELECT p.doc_id, concat(p.dir, '/', p.file) AS path, coalesce(o.license, n.license) AS license, coalesce(o.score, n.score) AS score,
CASE WHEN o.license IS NOT NULL THEN 'header' WHEN n.license IS NOT NULL THEN 'inherited' END AS origin, CASE WHEN o.license IS NULL THEN n.up END AS license_dir
FROM paths p LEFT JOIN own o ON o.doc_id = p.doc_id LEFT JOIN near n ON n.dir = p.dir"""


ORACLES: dict[str, str] = {
    "op3_license_scans": _licenses_sql(),
    "op1_benchmark_decontamination": _leaks_sql(),
    "op10_url_filters": _url_sql(),
    "op5_minhash_neardup": rf"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct([array_to_string(w[i:i+4], ' ') for i in range(1, len(w) - 3)]) END AS sh FROM d),
n AS (SELECT doc_id, len(sh) AS n FROM s), e AS (SELECT doc_id, unnest(sh) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
g AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS id, doc_id AS far FROM documents UNION SELECT r.id, g.b FROM r JOIN g ON g.a = r.far)
SELECT n.doc_id, n.n AS n_shingles, m.component_id, n.doc_id = m.component_id AS kept FROM n JOIN (SELECT id, min(far) AS component_id FROM r GROUP BY 1) m ON m.id = n.doc_id""",
}
