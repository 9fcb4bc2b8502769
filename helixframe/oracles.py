"""SQL of alignments, for the queries over reads: the matrix column by column in a recursive table, cells as columns.

The SQL shares nothing with the kernels but the recurrence: at equal characters the diagonal is forced; otherwise mismatch,
then insertion, then deletion is taken at equal cost. Of the cells at which an alignment may end the one with most matches
wins, then the lowest cost, then the first.
"""

from __future__ import annotations

from collections.abc import Sequence

from helixframe.functions.probability import random_match
from helixframe.operators.adapters import Adapter

#: Which ends are free: adapter's start, read's start, adapter's stop, read's stop.
_FREE = {"back": (0, 1, 1, 1), "front": (1, 1, 0, 1), "prefix": (0, 0, 0, 1), "suffix": (0, 1, 0, 0), "anywhere": (1, 1, 1, 1)}
_CODES = {"R": "AG", "Y": "CT", "S": "CG", "W": "AT", "K": "GT", "M": "AC", "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT"}


def align(src: str, out: str, a: Adapter) -> str:
    """Tables up to out (read_idx, astart, astop, rstart, rstop, k, c): the adapter's match in each s of src (read_idx, s),
    after acceptance; no row without one. Needs WITH RECURSIVE, and chance() for a bound on the chance of a match."""
    if not a.indels and a.where in ("prefix", "suffix"):
        return _anchored(src, out, a)
    free_a, free_r, stop_a, stop_r = _FREE[a.where]
    m, g = len(a.sequence), a.indel_cost if a.indels else 100_000
    exact = {"prefix": f"CASE WHEN starts_with(s, '{a.sequence}') THEN 1 ELSE 0 END", "suffix": f"CASE WHEN ends_with(s, '{a.sequence}') THEN length(s) - {m} + 1 ELSE 0 END"}.get(a.where, f"strpos(s, '{a.sequence}')")
    if a.wild:
        exact = "0"
    cells = [f"{x}{i}" for i in range(m + 1) for x in "cok"]
    start = ", ".join(f"{0 if free_a else i * g} AS c{i}, {-i if free_a else 0} AS o{i}, 0 AS k{i}" for i in range(m + 1))
    step = f"(SELECT *, substr(s, j + 1, 1) AS ch, {'0' if free_r else f'(j + 1) * {g}'} AS d0, {'j + 1' if free_r else '0'} AS p0, 0 AS q0 FROM {out}_d WHERE j < n)"
    for i, letter in enumerate(a.sequence, 1):
        hit = f"ch IN ({', '.join(repr(x) for x in _CODES[letter])})" if a.wild and letter in _CODES else f"ch = '{letter}'"
        diagonal, insertion = f"c{i - 1} + 1 <= d{i - 1} + {g} AND c{i - 1} + 1 <= c{i} + {g}", f"d{i - 1} <= c{i}"
        pick = lambda h, d, u, e: f"CASE WHEN {hit} THEN {h} WHEN {diagonal} THEN {d} WHEN {insertion} THEN {u} ELSE {e} END"  # noqa: B023, E731
        step = (
            f"(SELECT *, {pick(f'c{i - 1}', f'c{i - 1} + 1', f'd{i - 1} + {g}', f'c{i} + {g}')} AS d{i}, {pick(f'o{i - 1}', f'o{i - 1}', f'p{i - 1}', f'o{i}')} AS p{i},"
            f" {pick(f'k{i - 1} + 1', f'k{i - 1}', f'q{i - 1}', f'k{i}')} AS q{i} FROM {step})"
        )
    moved = ", ".join(f"{x}{i}" for i in range(m + 1) for x in "dpq")
    ends = [f"SELECT read_idx, j, 0 AS turn, {m} AS i, c{m} AS c, o{m} AS o, k{m} AS k FROM {out}_d WHERE j > 0"] if stop_r else []
    ends += [f"SELECT read_idx, j, {i + 1}, {i}, c{i}, o{i}, k{i} FROM {out}_d WHERE j = n" for i in (range(m + 1) if stop_a else (m,))]
    size = "(i + least(o, 0))"
    likely = "" if a.max_rmp is None else f" AND (SELECT p FROM chance x WHERE x.n = {size} AND x.k = {out}_b.k) <= {a.max_rmp}::DOUBLE"
    fits = f"{size} >= {a.overlap} AND c <= {size} * {a.max_error_rate}::DOUBLE"
    return f"""{out}_s AS (SELECT read_idx, s, {exact} AS found_at FROM {src} WHERE s <> ''),
{out}_d(read_idx, s, n, j, {', '.join(cells)}) AS (SELECT read_idx, s, length(s), 0, {start} FROM {out}_s WHERE found_at = 0
  UNION ALL SELECT read_idx, s, n, j + 1, {moved} FROM {step}),
{out}_e(read_idx, j, turn, i, c, o, k) AS ({' UNION ALL '.join(ends)}),
{out}_b AS (SELECT * FROM {out}_e WHERE {fits} QUALIFY row_number() OVER (PARTITION BY read_idx ORDER BY k DESC, c, j, turn) = 1),
{out} AS (SELECT read_idx, 0 AS astart, {m} AS astop, found_at - 1 AS rstart, found_at - 1 + {m} AS rstop, {m} AS k, 0 AS c FROM {out}_s WHERE found_at > 0
  UNION ALL SELECT read_idx, greatest(-o, 0), i, greatest(o, 0), j, k, c FROM {out}_b WHERE k > 0 AND c::DOUBLE / {size} <= {a.max_error_rate}::DOUBLE{likely})"""


def _anchored(src: str, out: str, a: Adapter) -> str:
    """An anchored adapter without gaps: the read's end against the adapter's, over the shorter length."""
    m, front = len(a.sequence), a.where == "prefix"
    read, want = ("substr(s, 1, n)", f"substr('{a.sequence}', 1, n)") if front else ("right(s, n)", f"right('{a.sequence}', n)")
    at = "0, n, 0, n" if front else f"{m} - n, {m}, length(s) - n, length(s)"
    return f"""{out}_s AS (SELECT *, least({m}, length(s)) AS n FROM {src} WHERE s <> ''), {out}_h AS (SELECT *, hamming({read}, {want}) AS c FROM {out}_s),
{out}(read_idx, astart, astop, rstart, rstop, k, c) AS (SELECT read_idx, {at}, n - c, c FROM {out}_h WHERE n > c AND n >= {a.overlap} AND c::DOUBLE / n <= {a.max_error_rate}::DOUBLE)"""


def rounds(src: str, out: str, adapters: Sequence[Adapter], times: int = 1) -> str:
    """Tables up to out (read_idx, s, q, name, n, front, back): each round removes the adapter with most matches, the first
    of equals, from the reads that the round before trimmed. front and back: bases gone."""
    text = f"{out}0 AS (SELECT read_idx, s, q, NULL::VARCHAR AS name, 0 AS n, 0 AS front, 0 AS back, true AS live FROM {src})"
    for t in range(times):
        here, after = f"{out}{t}", f"{out}{t + 1}"
        best = []
        text += f", {here}l AS (SELECT read_idx, s FROM {here} WHERE live)"
        for i, a in enumerate(adapters):
            text += ", " + align(f"{here}l", f"{here}a{i}", a)
            front = {"front": "true", "prefix": "true", "anywhere": "rstart = 0"}.get(a.where, "false")
            best.append(f"SELECT *, {i} AS turn, '{a.name}' AS adapter, {front} AS at_front FROM {here}a{i}")
        text += f""", {here}b AS (SELECT * FROM ({' UNION ALL '.join(best)}) QUALIFY row_number() OVER (PARTITION BY read_idx ORDER BY k DESC, turn) = 1),
{after} AS (SELECT w.read_idx, CASE WHEN b.k IS NULL THEN w.s WHEN at_front THEN substr(w.s, rstop + 1) ELSE substr(w.s, 1, rstart) END AS s,
  CASE WHEN b.k IS NULL THEN q WHEN at_front THEN substr(q, rstop + 1) ELSE substr(q, 1, rstart) END AS q, coalesce(adapter, name) AS name, n + (b.k IS NOT NULL)::INT AS n,
  front + CASE WHEN at_front THEN rstop ELSE 0 END AS front, back + CASE WHEN at_front OR b.k IS NULL THEN 0 ELSE length(w.s) - rstart END AS back, b.k IS NOT NULL AS live
  FROM {here} w LEFT JOIN {here}b b ON b.read_idx = w.read_idx)"""
    return text + f", {out} AS (SELECT * FROM {out}{times})"


def complement(text: str) -> str:
    return f"reverse(translate({text}, 'ACGT', 'TGCA'))"


def _chances(longest: int) -> str:
    rows = ", ".join(f"({n}, {k}, {random_match(k, n):.17e}::DOUBLE)" for n in range(longest + 1) for k in range(n + 1))
    return f"chance(n, k, p) AS (VALUES {rows})"


def inserts(adapter1: Adapter, adapter2: Adapter, longest: int = 80) -> str:
    """Tables up to cut (read_idx, s1, s2, q1, q2, size, wrong, r1, r2, n): pairs with the insert size (null: none) and its
    mismatches, where each mate's adapter starts (null: none) and, for a copied or common start without an insert match,
    how far the mates overlap (n)."""
    a1, a2 = adapter1.sequence, adapter2.sequence
    over = [f"least(over, {len(a)})" for a in (a1, a2)]
    return f"""{_chances(longest)},
pl AS (SELECT *, least(length(s1), length(s2)) AS common FROM pairs),
pc AS (SELECT read_idx, s1, s2, common, unnest(range(1, common + 1)) AS size FROM pl),
ph AS (SELECT *, hamming(substr(s1, 1, size), {complement('substr(s2, 1, size)')}) AS wrong, common - size AS over FROM pc),
pp AS (SELECT ph.*, p FROM ph JOIN chance ON chance.n = size AND chance.k = size - wrong WHERE wrong <= size * 0.2::DOUBLE AND p <= 1e-6::DOUBLE),
po AS (SELECT *, {over[0]} AS l1, {over[1]} AS l2, CASE WHEN over < 1 THEN 0 ELSE hamming(substr(s1, size + 1, {over[0]}), substr('{a1}', 1, {over[0]})) END AS e1,
  CASE WHEN over < 1 THEN 0 ELSE hamming(substr(s2, size + 1, {over[1]}), substr('{a2}', 1, {over[1]})) END AS e2 FROM pp),
pg AS (SELECT po.* FROM po JOIN chance x ON x.n = greatest(l1, 0) AND x.k = greatest(l1, 0) - e1 JOIN chance y ON y.n = greatest(l2, 0) AND y.k = greatest(l2, 0) - e2
  WHERE over < 1 OR (e1 <= round_even(l1 * 0.2::DOUBLE, 0) OR e2 <= round_even(l2 * 0.2::DOUBLE, 0)) AND (least(l1, l2) <= 9 OR x.p * y.p <= 1e-3::DOUBLE)),
hit AS (SELECT * FROM pg QUALIFY row_number() OVER (PARTITION BY read_idx ORDER BY p, size) = 1),
alone AS (SELECT p.* FROM pairs p ANTI JOIN hit ON hit.read_idx = p.read_idx),
alone1 AS (SELECT read_idx, s1 AS s FROM alone), alone2 AS (SELECT read_idx, s2 AS s FROM alone),
{align('alone1', 'm1', adapter1)}, {align('alone2', 'm2', adapter2)},
found AS (SELECT p.read_idx, p.s1, p.s2, p.q1, p.q2, hit.size, hit.wrong, hit.read_idx IS NOT NULL AS overlap,
  CASE WHEN over >= 1 AND least(l1, length(p.s1) - hit.size) > least(e1, e2) THEN hit.size ELSE m1.rstart END AS x1,
  CASE WHEN over >= 1 AND least(l2, length(p.s2) - hit.size) > least(e1, e2) THEN hit.size ELSE m2.rstart END AS x2
  FROM pairs p LEFT JOIN hit ON hit.read_idx = p.read_idx LEFT JOIN m1 ON m1.read_idx = p.read_idx LEFT JOIN m2 ON m2.read_idx = p.read_idx),
cut AS (SELECT read_idx, s1, s2, q1, q2, size, wrong, overlap, coalesce(x1, CASE WHEN x2 <= length(s1) THEN x2 END) AS r1, coalesce(x2, CASE WHEN x1 <= length(s2) THEN x1 END) AS r2,
  CASE WHEN overlap THEN CASE WHEN wrong > 0 THEN size END WHEN x1 = x2 THEN x1 WHEN x1 IS NULL AND x2 <= length(s1) THEN x2 WHEN x2 IS NULL AND x1 <= length(s2) THEN x1 END AS n FROM found)"""


def corrected() -> str:
    """Tables up to fixed (as cut, sequences and qualities settled, c1, c2): the better base counts; at equal qualities that
    of the mate whose overlap is better by more than one on average."""
    return f"""cp AS (SELECT *, unnest(range(1, least(n, length(s1), length(s2)) + 1)) AS i FROM cut WHERE n > 0),
cb AS (SELECT read_idx, i, n + 1 - i AS j, substr(s1, i, 1) AS a, {complement('substr(s2, n + 1 - i, 1)')} AS b, ascii(substr(q1, i, 1)) AS qa, ascii(substr(q2, n + 1 - i, 1)) AS qb FROM cp WHERE n + 1 - i <= length(s2)),
ct AS (SELECT *, CASE WHEN a = b THEN 0 WHEN a = 'N' THEN 2 WHEN b = 'N' THEN 1 WHEN qa > qb THEN 1 WHEN qa < qb THEN 2 ELSE 3 END AS take FROM cb),
cm AS (SELECT read_idx, avg(CASE take WHEN 2 THEN qb ELSE qa END) - avg(CASE take WHEN 1 THEN qa ELSE qb END) AS better FROM ct GROUP BY 1),
cd AS (SELECT ct.*, CASE WHEN take < 3 THEN take WHEN better > 1 THEN 1 WHEN better < -1 THEN 2 ELSE 0 END AS final FROM ct JOIN cm ON cm.read_idx = ct.read_idx),
c1 AS (SELECT read_idx, string_agg(CASE final WHEN 2 THEN b ELSE a END, '' ORDER BY i) AS s, string_agg(chr(CASE final WHEN 2 THEN qb ELSE qa END), '' ORDER BY i) AS q, count(*) FILTER (final = 2) AS c, max(i) AS last FROM cd GROUP BY 1),
c2 AS (SELECT read_idx, string_agg(translate(CASE final WHEN 1 THEN a ELSE b END, 'ACGT', 'TGCA'), '' ORDER BY j) AS s, string_agg(chr(CASE final WHEN 1 THEN qa ELSE qb END), '' ORDER BY j) AS q, count(*) FILTER (final = 1) AS c, max(j) AS last, min(j) AS first FROM cd GROUP BY 1),
fixed AS (SELECT cut.read_idx, size, wrong, overlap, r1, r2, n,
  CASE WHEN c1.c > 0 THEN concat(c1.s, substr(s1, c1.last + 1)) ELSE s1 END AS s1, CASE WHEN c1.c > 0 THEN concat(c1.q, substr(q1, c1.last + 1)) ELSE q1 END AS q1,
  CASE WHEN c2.c > 0 THEN concat(substr(s2, 1, first - 1), c2.s, substr(s2, c2.last + 1)) ELSE s2 END AS s2, CASE WHEN c2.c > 0 THEN concat(substr(q2, 1, first - 1), c2.q, substr(q2, c2.last + 1)) ELSE q2 END AS q2,
  coalesce(c1.c, 0) AS c1, coalesce(c2.c, 0) AS c2 FROM cut LEFT JOIN c1 ON c1.read_idx = cut.read_idx LEFT JOIN c2 ON c2.read_idx = cut.read_idx)"""
