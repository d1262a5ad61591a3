"""SQL (DuckDB) that tokenizes, lexes and plans blocks on its own, for comparison with the queries.

Texts are cut at byte pairs that stand in no surface; each distinct segment is solved by a recursive
query over its hexadecimal digits, and what the segments hold is added up.
"""

from __future__ import annotations

from .kernels.vocab import BASE_PIECES, BYTE_COST, DETECTOR_PROFILES, LANGUAGE_DELTAS, RAW_BPE_PIECES

#: What the planted inputs put behind a text, by its number modulo eight; fixed values.
PLANTED = (
    " hello world tokenizer",
    " नमस्ते दुनिया hello",
    " こんにちは世界",
    " नमस्ते दुनिया hello world tokenizer こんにちは世界",
    " A\u0416\u202e\u042f\u200bb \u1112\u1161\u11ab \ud55c",
    " e\u0301 a\u0301\u0323 \U0001f468\u200d\U0001f469\u200d\U0001f467 \U0001f1e9\U0001f1ea\U0001f1eb \ufb01 \uff21\u00ad \u1e9e",
    " deserializeHTTP2Response->_id 0x1f 12.5e-2 'it' // #x \"y\" hello",
    "",
)


def planted_sql(table: str, key: str, columns: str, column: str = "text") -> str:
    """columns and the planted text (as ``text``) of a table."""
    rows = ", ".join("'" + p.replace("'", "''") + "'" for p in PLANTED)
    return f"SELECT {columns}, coalesce({column}, '') || ([{rows}])[1 + ({key}) % 8] AS text FROM {table}"


_PIECES = [(i, c, s.encode()) for i, c, s in BASE_PIECES]
BPE_PIECES = [(i, i, s.encode()) for i, s in RAW_BPE_PIECES]


def segments_sql(source: str, key: str, pieces=_PIECES) -> str:
    """CTEs ``src``, ``cuts`` and ``segs``: (key, seg, n), how often a text has each segment (in hex)."""
    pairs = sorted({s[k : k + 2].hex().upper() for _, _, s in pieces for k in range(len(s) - 1)})
    known = ", ".join(f"'{p}'" for p in pairs)
    return f"""src AS ({source}),
hexed AS (SELECT {key}, regexp_extract_all(hex(encode(text)), '..') AS h FROM src WHERE text <> ''),
bytes AS (
  SELECT {key}, unnest(range(1, len(h) + 1)) AS p, unnest(h) AS b, unnest(list_prepend('', h)) AS before, unnest(h[2:]) AS after FROM hexed),
cuts AS (
  SELECT {key}, p, b, before || b NOT IN ({known}) AS f, coalesce(b || after NOT IN ({known}), true) AS l FROM bytes WHERE p IS NOT NULL),
longer AS (SELECT {key}, p, b, sum(f::INT) OVER (PARTITION BY {key} ORDER BY p) AS g FROM cuts WHERE NOT (f AND l)),
joined AS (SELECT {key}, g, min(p) AS p, string_agg(b, '' ORDER BY p) AS seg FROM longer GROUP BY {key}, g),
placed AS (SELECT {key}, p, seg FROM joined UNION ALL SELECT {key}, p, b FROM cuts WHERE f AND l),
segs AS (SELECT {key}, seg, count(*) AS n FROM placed GROUP BY {key}, seg)"""


_BYTE = "(instr('0123456789ABCDEF', {0}[1]) - 1) * 16 + instr('0123456789ABCDEF', {0}[2]) - 1"


def _list(pieces, tag: str | None) -> str:
    deltas = {s: d for t in (tag or "").split(",") if t for s, d in LANGUAGE_DELTAS[t]}
    rows = (f"{{'s': '{s.hex().upper()}', 'c': {c + deltas.get(s.decode(), 0)}, 'b': {c}, 'i': {i}, 'l': {len(s)}}}" for i, c, s in pieces)
    return f"[{', '.join(rows)}]"


def viterbi_sql(name: str = "solved", segs: str = "SELECT DISTINCT seg FROM segs", tag: str | None = None) -> str:
    """CTEs (to be used in WITH RECURSIVE) that end in ``name``: (seg, ids, lens, cost).

    Least cost, then fewest tokens, then the longer token first, then the smaller id, from the end
    of a segment to its start; cost is the vocabulary's own.
    """
    byte = _BYTE.format("substr(seg, 2 * pos - 1, 2)")
    return f"""{name}_r AS (
  SELECT seg, length(seg) // 2 AS pos, [{{'c': 0, 'n': 0, 'l': 0, 'i': 0, 'b': 0, 'ids': []::BIGINT[], 'lens': []::BIGINT[]}}] AS best FROM ({segs})
  UNION ALL
  SELECT seg, pos - 1, list_prepend(list_sort(list_concat(
      [{{'c': {BYTE_COST} + best[1].c, 'n': 1 + best[1].n, 'l': -1, 'i': {byte}, 'b': {BYTE_COST} + best[1].b,
        'ids': list_prepend(({byte})::BIGINT, best[1].ids), 'lens': list_prepend(1::BIGINT, best[1].lens)}}],
      list_transform(list_filter({_list(_PIECES, tag)}, lambda v: starts_with(substr(seg, 2 * pos - 1), v.s)),
        lambda v: {{'c': v.c + best[v.l].c, 'n': 1 + best[v.l].n, 'l': -v.l, 'i': v.i, 'b': v.b + best[v.l].b,
          'ids': list_prepend(v.i::BIGINT, best[v.l].ids), 'lens': list_prepend(v.l::BIGINT, best[v.l].lens)}})))[1], best)
  FROM {name}_r WHERE pos > 0),
{name} AS (SELECT seg, best[1].ids AS ids, best[1].lens AS lens, best[1].b AS cost FROM {name}_r WHERE pos = 0)"""


def bpe_sql(name: str = "solved") -> str:
    """As viterbi_sql, for the merges of the raw byte vocabulary: the least rank, the leftmost first."""
    table = f"[{', '.join(f'{{s: {chr(39)}{s.hex().upper()}{chr(39)}, r: {r}}}' for r, _, s in BPE_PIECES)}]"
    known = f"list_filter({table}, lambda v: v.s = p[k] || p[k + 1])"
    return f"""{name}_r AS (
  SELECT seg, regexp_extract_all(seg, '..') AS p, false AS done FROM (SELECT DISTINCT seg FROM segs)
  UNION ALL
  SELECT seg, CASE WHEN m IS NULL THEN p ELSE list_concat(list_concat(p[:m.k - 1], [p[m.k] || p[m.k + 1]]), p[m.k + 2:]) END, m IS NULL
  FROM (SELECT seg, p, list_sort(list_transform(list_filter(range(1, len(p)), lambda k: len({known}) > 0), lambda k: {{'r': {known}[1].r, 'k': k}}))[1] AS m
    FROM {name}_r WHERE NOT done)),
{name} AS (
  SELECT seg, list_transform(p, lambda x: CASE WHEN length(x) = 2 THEN {_BYTE.format("x")} ELSE list_filter({table}, lambda v: v.s = x)[1].r END) AS ids
  FROM {name}_r WHERE done)"""


def tokens_sql(source: str, key: str, select: str, tag: str | None = None) -> str:
    """``select`` over ``segs`` and ``solved`` of a source."""
    return f"WITH RECURSIVE {segments_sql(source, key)}, {viterbi_sql(tag=tag)} {select}"


def score_sql(text: str = "text") -> str:
    """Columns en, hi and ja: the detector's scores, no feature of which can overlap itself."""
    out = []
    for tag, (_, features) in DETECTOR_PROFILES.items():
        terms = (f"{w} * ((length({text}) - length(replace({text}, '{f}', ''))) // {len(f)})" for f, w in features)
        out.append(f"({' + '.join(terms)})::BIGINT AS {tag}")
    return ", ".join(out)


#: Of columns en, hi and ja: the best score, its margin and, if it is clear enough, its language.
BEST = "greatest(en, hi, ja) AS score, 2 * greatest(en, hi, ja) + least(en, hi, ja) - en - hi - ja AS margin"
LANGUAGE = "CASE WHEN score >= 100 AND margin >= 20 THEN CASE score WHEN en THEN 'en' WHEN hi THEN 'hi' ELSE 'ja' END END"


def auto_sql(source: str, spans: str | None) -> str:
    """(conv_id, turn, status, n_tokens, matched, language): each text, or each of its spans, by its own language.

    source has conv_id, turn and text; spans is a pattern whose matches are encoded on their own.
    """
    part = f"unnest(regexp_extract_all(text, '{spans}'))" if spans else "text"
    tags = ("", *LANGUAGE_DELTAS)
    detected = f"SELECT *, {LANGUAGE} AS language FROM (SELECT *, {BEST} FROM (SELECT *, {score_sql()} FROM {{}}))"
    solved = ", ".join(viterbi_sql(f"solved{k}", f"SELECT DISTINCT seg FROM segs JOIN parts USING (k) WHERE tag = '{t}'", t) for k, t in enumerate(tags))
    union = " UNION ALL ".join(f"SELECT '{t}' AS tag, seg, len(ids) AS m FROM solved{k}" for k, t in enumerate(tags))
    return f"""WITH RECURSIVE whole AS ({detected.format(f"({source})")}),
cut AS (SELECT conv_id, turn, part AS text, row_number() OVER () AS k FROM (SELECT conv_id, turn, {part} AS part FROM whole)),
parts AS (SELECT conv_id, turn, k, coalesce(language, '') AS tag FROM ({detected.format("cut")})),
{segments_sql("SELECT k, text FROM cut", "k")}, {solved}, found AS ({union}),
total AS (SELECT conv_id, turn, sum(n * m)::INT AS n FROM segs JOIN parts USING (k) JOIN found USING (tag, seg) GROUP BY ALL)
SELECT conv_id, turn, 0 AS status, coalesce(n, 0)::INT AS n_tokens, language IS NOT NULL AS matched, language
FROM whole LEFT JOIN total USING (conv_id, turn)"""


def beam_sql(source: str, key: str) -> str:
    """(key, beam_cost, least_cost, n_tokens): of equally cheap paths to a place the one whose last piece starts first."""
    byte = _BYTE.format("substr(seg, 2 * pos + 1, 2)")
    return f"""WITH RECURSIVE {segments_sql(source, key)}, {viterbi_sql()},
ahead AS (
  SELECT seg, 0 AS pos, [{{'c': 0, 'l': 0, 'o': 0, 'n': 0}}] AS best FROM (SELECT DISTINCT seg FROM segs)
  UNION ALL
  SELECT seg, pos + 1, list_prepend(list_sort(list_concat(
      [{{'c': {BYTE_COST} + best[1].c, 'l': -1, 'o': {byte}, 'n': 1 + best[1].n}}],
      list_transform(list_filter({_list(_PIECES, None)}, lambda v: v.l <= pos + 1 AND substr(seg, 2 * (pos + 1 - v.l) + 1, 2 * v.l) = v.s),
        lambda v: {{'c': v.c + best[v.l].c, 'l': -v.l, 'o': v.i, 'n': 1 + best[v.l].n}})))[1], best)
  FROM ahead WHERE pos < length(seg) // 2),
ends AS (SELECT seg, best[1].c AS c, best[1].n AS m FROM ahead WHERE 2 * pos = length(seg)),
total AS (SELECT {key}, sum(n * c)::BIGINT AS beam_cost, sum(n * cost)::BIGINT AS least_cost, sum(n * m)::INT AS n_tokens FROM segs JOIN solved USING (seg) JOIN ends USING (seg) GROUP BY {key})
SELECT {key}, coalesce(beam_cost, 0) AS beam_cost, coalesce(least_cost, 0) AS least_cost, coalesce(n_tokens, 0) AS n_tokens FROM src LEFT JOIN total USING ({key})"""


def blocks_sql(source: str, key: str, policy, select: str) -> str:
    """``select`` over ``src`` and ``plan``: (key, begin, n, macros, total, last) of each block, in the order of their starts."""
    return f"""WITH RECURSIVE {segments_sql(source, key)}, {viterbi_sql()},
stops AS (
  SELECT {key}, list(p ORDER BY p) AS stops FROM (
    SELECT {key}, p + unnest(list_transform(range(1, len(lens) + 1), lambda k: list_sum(lens[:k])))::BIGINT - 1 AS p FROM placed JOIN solved USING (seg)) GROUP BY {key}),
chain AS (
  SELECT {key}, stops, 0::BIGINT AS begin, 0::BIGINT AS n, 0::BIGINT AS macros, 0::BIGINT AS total FROM stops
  UNION ALL
  SELECT {key}, list_filter(stops, lambda e: e > begin + n), begin, n, macros + (total + n >= {policy.macroblock})::BIGINT, CASE WHEN total + n >= {policy.macroblock} THEN 0 ELSE total + n END
  FROM (
    SELECT {key}, stops, begin + n AS begin, macros, total, coalesce(list_sort(list_transform(
      list_filter(stops[:{policy.maximum}], lambda e: e - begin - n BETWEEN {policy.minimum} AND {policy.maximum}),
      lambda e: {{'off': abs(e - begin - n - {policy.preferred}), 'less': -(e - begin - n)}}))[1].less * -1, stops[1] - begin - n) AS n
    FROM chain WHERE len(stops) > 0)),
plan AS (SELECT {key}, begin, n, macros, total FROM chain WHERE n > 0)
{select}"""
