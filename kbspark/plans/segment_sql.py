"""DuckDB SQL of the segment rules: greedy packing, paragraphs, markdown sections and the places of chunks."""

from __future__ import annotations

from kbspark.operators.chunking import OVERLAP, SEPARATORS, SIZE

NL = "chr(10)"
_EMPTY = "[]::VARCHAR[]"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def packed(x: str) -> str:
    """The list of packed chunks of the text ``x``: a fold over its units, closed by a unit that is null."""
    units = f"[{x}]"
    for sep in SEPARATORS:
        mark = "".join(f"[{c}]" for c in sep)
        units = f"flatten(list_transform({units}, lambda u: CASE WHEN length(u) <= {SIZE} THEN [u] ELSE regexp_extract_all(u, '(?s).*?{mark}|.+\\z') END))"
    slices = f"list_transform(range(0, ceil((length(y.b) - {SIZE}) / {SIZE - OVERLAP}.0)::BIGINT + 1), lambda i: substring(y.b, i * {SIZE - OVERLAP} + 1, {SIZE}))"
    fold = f"""list_reduce(list_transform(list_concat([''], {units}, [NULL]), lambda u: {{'o': {_EMPTY}, 'b': u}}), lambda s, y: CASE
      WHEN y.b IS NULL THEN {{'o': list_append(s.o, s.b), 'b': ''}}
      WHEN length(y.b) > {SIZE} THEN {{'o': list_concat(s.o, [s.b], {slices}), 'b': ''}}
      WHEN s.b <> '' AND length(s.b) + length(y.b) > {SIZE} THEN {{'o': list_append(s.o, s.b), 'b': right(s.b, {OVERLAP}) || y.b}}
      ELSE {{'o': s.o, 'b': s.b || y.b}} END)"""
    return f"list_filter(list_transform({fold}.o, lambda c: {strip('c')}), lambda c: c <> '')"


def fixed(source: str) -> str:
    """CTE ``cut(doc_id, t, cs)`` of ``source(doc_id, t)``: chunks of the fixed mode."""
    return f"cut AS (SELECT doc_id, t, {packed('t')} AS cs FROM {source} WHERE t <> '')"


def paragraphs(source: str) -> str:
    """CTE ``cut`` of the paragraph mode: each part packed by itself."""
    return f"""part AS (SELECT doc_id, t, n, {strip('a[n]')} AS p FROM (SELECT doc_id, t, a, unnest(range(1, len(a) + 1)) AS n FROM (SELECT doc_id, t, string_split_regex(t, {NL} || '\\s*' || {NL}) AS a FROM {source} WHERE t <> '') AS x) AS y),
cut AS (SELECT doc_id, any_value(t) AS t, flatten(list(cs ORDER BY n)) AS cs FROM (SELECT doc_id, t, n, {packed('p')} AS cs FROM part WHERE p <> '') AS x GROUP BY doc_id)"""


#: Rows of ``cut``: each chunk is sought behind the last start found, then anywhere.
_FOUND = "CASE WHEN contains(substring(t, s.behind + 1), y.c) THEN s.behind + instr(substring(t, s.behind + 1), y.c) - 1 WHEN contains(t, y.c) THEN instr(t, y.c) - 1 ELSE s.behind END"
PLACED = f"""placed AS (SELECT doc_id, t, cs, list_reduce(list_transform(list_prepend('', cs), lambda c: {{'c': c, 'p': []::BIGINT[], 'behind': 0::BIGINT}}), lambda s, y: {{'c': '', 'p': list_append(s.p, ({_FOUND})::BIGINT), 'behind': (CASE WHEN contains(t, y.c) THEN {_FOUND} + 1 ELSE s.behind END)::BIGINT}}).p AS p FROM cut),
chunk_rows AS (SELECT doc_id, (i - 1)::INT AS chunk_index, cs[i] AS content, length(cs[i])::INT AS char_count, p[i]::INT AS start, (p[i] + length(cs[i]))::INT AS "end" FROM (SELECT doc_id, cs, p, unnest(range(1, len(cs) + 1)) AS i FROM placed) AS x)"""
CHUNKS = 'SELECT doc_id, chunk_index, sha256(content) AS content_hash, char_count, start, "end" FROM chunk_rows'


def normal(source: str) -> str:
    """CTEs up to ``nk(doc_id, x, a, b, k)``: lines of ``source(doc_id, x)`` as they are, without repeated blank ones, and without repeats."""
    return f"""nl AS (SELECT doc_id, x, list_transform(string_split(replace(replace(x, chr(13) || {NL}, {NL}), chr(13), {NL}), {NL}), lambda s: regexp_replace(s, '\\s+$', '')) AS a FROM {source}),
nc AS (SELECT doc_id, x, a, list_filter(a, lambda s, i: NOT (s = '' AND i > 1 AND a[i - 1] = '')) AS b FROM nl),
ns AS (SELECT doc_id, x, a, list_transform(b, lambda s: CASE WHEN regexp_matches(s, '^#{{1,6}}\\s') THEN s ELSE regexp_replace(s, '[ \\t]{{2,}}', ' ', 'g') END) AS b FROM nc),
nk AS (SELECT doc_id, x, a, b, list_filter(b, lambda s, i: s = '' OR i = 1 OR b[i - 1] <> s) AS k FROM ns)"""


NORMAL_TEXT = f"CASE WHEN {strip(f'array_to_string(k, {NL})')} = '' THEN '' ELSE {strip(f'array_to_string(k, {NL})')} || {NL} END"


def markdown(source: str) -> str:
    """CTEs up to ``md(doc_id, section, level, trail, cs)`` of ``source(doc_id, x)``, for texts without fences.

    A heading leads until the next of its level or above; blocks parted by blank lines fill chunks,
    and one over the size is packed by itself.
    """
    return f"""ml AS (SELECT doc_id, i, a[i] AS line FROM (SELECT doc_id, a, unnest(range(1, len(a) + 1)) AS i FROM (SELECT doc_id, string_split(x, {NL}) AS a FROM {source}) AS x) AS y),
mh AS (SELECT *, CASE WHEN regexp_matches(line, '^#{{1,6}}\\s') THEN length(regexp_extract(line, '^(#+)', 1)) END AS level FROM ml),
ms AS (SELECT *, count(level) OVER w AS section, count(*) FILTER (WHERE NOT regexp_matches(line, '\\S')) OVER w AS gap FROM mh WINDOW w AS (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING)),
head AS (SELECT doc_id, section, level, {strip("regexp_extract(line, '^#{1,6}\\s+(.*)$', 1)")} AS name FROM ms WHERE level IS NOT NULL),
reign AS (SELECT h.doc_id, h.section, any_value(h.name) AS name, coalesce(min(n.section), 1000000000) AS until FROM head AS h LEFT JOIN head AS n ON n.doc_id = h.doc_id AND n.section > h.section AND n.level <= h.level GROUP BY h.doc_id, h.section),
trail AS (SELECT h.doc_id, h.section, any_value(h.level)::INT AS level, nullif(string_agg(r.name, ' > ' ORDER BY r.section), '') AS trail FROM head AS h JOIN reign AS r ON r.doc_id = h.doc_id AND r.section <= h.section AND h.section < r.until GROUP BY h.doc_id, h.section),
blk AS (SELECT doc_id, section, gap, string_agg(line, {NL} ORDER BY i) AS b FROM ms WHERE regexp_matches(line, '\\S') GROUP BY doc_id, section, gap),
bp AS (SELECT doc_id, section, gap, {{'o': CASE WHEN length(b) > {SIZE} THEN {packed('b')} ELSE {_EMPTY} END, 'b': b}} AS e FROM blk),
bl AS (SELECT doc_id, section, list_concat([{{'o': {_EMPTY}, 'b': ''}}], list(e ORDER BY gap), [{{'o': {_EMPTY}, 'b': NULL::VARCHAR}}]) AS es FROM bp GROUP BY doc_id, section),
md AS (SELECT bl.doc_id, bl.section, trail.level, trail.trail, list_filter(list_reduce(es, lambda s, y: CASE
    WHEN y.b IS NULL THEN {{'o': list_append(s.o, s.b), 'b': ''}}
    WHEN length(y.b) > {SIZE} THEN {{'o': list_concat(s.o, [s.b], y.o), 'b': ''}}
    WHEN s.b <> '' AND length(s.b) + 2 + length(y.b) > {SIZE} THEN {{'o': list_append(s.o, s.b), 'b': y.b}}
    WHEN s.b <> '' THEN {{'o': s.o, 'b': s.b || {NL} || {NL} || y.b}}
    ELSE {{'o': s.o, 'b': y.b}} END).o, lambda c: c <> '') AS cs FROM bl LEFT JOIN trail ON trail.doc_id = bl.doc_id AND trail.section = bl.section)"""
