"""SQL that finds, resolves and replaces entities in whole documents, for engines whose patterns look neither behind nor ahead.

Digit runs are marked first: chr(2) before and chr(3) after each. "Not beside a digit" then is a mark, and within a run there
is none. An opening bracket or a plus sign right after a digit becomes chr(4) or chr(5), so that these tell what is before them.
"""

from __future__ import annotations

from ..functions.fixed import DETECTOR_ORDER, NORMAL_FROM, NORMAL_TO

_D, _S, _A, _Z = r"\p{Nd}", r"[\s\x0b\x{85}\p{Z}]", "\x02", "\x03"
_SD = r"[\s\x0b\x{85}\p{Z}-]"


def _join(between: str) -> str:
    """Two groups of digits in one run, or apart by what stands between runs."""
    return f"(?:{_Z}{between}{_A})?"


def _n(k: int) -> str:
    return f"{_D}{{{k}}}"


_KEYED = rf"(?:{_S}|:|№)*?{_A}"
#: (type, pattern over marked text, group that is the value).
PATTERNS = [
    ("PHONE", rf"(?:(?:\+{_A}7|{_A}[78])(?:{_Z}{_S}*[(\x04]?{_A})?{_n(3)}{_join(rf'\)?{_SD}*')}{_n(3)}{_join(f'{_SD}*')}{_n(2)}{_join(f'{_SD}*')}{_n(2)}|\(?{_A}{_n(3)}{_join(rf'\)?{_SD}*')}{_n(2)}{_join(f'{_SD}*')}{_n(2)}{_join(f'{_SD}*')}{_n(2)}{_Z})", 0),
    ("CARD", rf"{_A}(?:{_n(4)}{_join(_SD)}){{3}}{_n(4)}{_Z}", 0),
    ("ACCOUNT", rf"(?i)(?:сч[её]т|р/с|к/с){_KEYED}({_n(20)}){_Z}", 1),
    ("ACCOUNT", rf"{_A}{_n(20)}{_Z}", 0),
    ("INN", rf"(?i)ИНН{_KEYED}({_n(12)}|{_n(10)}){_Z}", 1),
    ("INN", rf"{_A}{_n(12)}{_Z}", 0),
    ("SNILS", rf"{_A}{_n(3)}{_Z}-{_A}{_n(3)}{_Z}-{_A}{_n(3)}{_Z}{_S}{_A}{_n(2)}{_Z}", 0),
    ("SNILS", rf"(?i)СНИЛС{_KEYED}({_n(11)}){_Z}", 1),
    ("PASSPORT", rf"{_A}{_n(4)}{_Z}{_S}{_A}{_n(6)}{_Z}", 0),
    ("PASSPORT", rf"(?i)(?:серия|паспорт)(?:{_S}|:|№)*{_A}{_n(2)}{_join(_S)}{_n(2)}{_join(f'{_S}*(?:номер{_S}*)?')}{_n(6)}{_Z}", 0),
]
#: Over text whose runs of Latin letters and digits are each followed by chr(6).
EMAIL = r"[A-Za-z0-9._%+\x06-]+@[A-Za-z0-9.\x06-]+\.[A-Za-z]{2,}\x06"


def _quoted(p: str) -> str:
    return "'" + p.replace("'", "''").replace(_A, r"\x02").replace(_Z, r"\x03") + "'"


def _spans(kind: str, pattern: str, group: int, text: str) -> str:
    p = _quoted(pattern)
    plain = lambda x: f"translate({x}, chr(2) || chr(3) || chr(6), '')"
    size = lambda x: f"length({plain(x)})"
    ends = f"coalesce(list_sum(list_transform(g[1:i], lambda x: {size('x')})), 0) + list_sum(list_transform(m[1:i], lambda x: {size('x')}))"
    return f"""SELECT doc_id, '{kind}' AS type, {DETECTOR_ORDER.index(kind)} AS ord, replace(replace({plain('v[i]')}, chr(4), '('), chr(5), '+') AS value, CAST({ends} AS BIGINT) AS end_at
      FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all({text}, {p}) AS m, regexp_extract_all({text}, {p}, {group}) AS v, string_split_regex({text}, {p}) AS g FROM marked))"""


_UNION = "\n  UNION ALL ".join([_spans("EMAIL", EMAIL, 0, "runs"), *(_spans(k, p, g, "marks") for k, p, g in PATTERNS)])
_FROM = " || ".join(f"chr({ord(c)})" for c in NORMAL_FROM)
_RUNS = rf"regexp_replace(text, '({_D}+)', chr(2) || '\1' || chr(3), 'g')"

def kept_of(source: str) -> str:
    """The tables of KEPT for texts (doc_id, source, text) of another table or query."""
    return KEPT.replace("FROM documents)", f"FROM {source})", 1)


#: cleaned (doc_id, source, text) and kept (doc_id, type, value, start_at, end_at): spans without overlaps, the longest first,
#: then the leftmost, then by detector. The tables hold no Cyrillic, so dictionaries, names and addresses find nothing there.
KEPT = f"""cleaned AS (SELECT doc_id, source, translate(text, {_FROM}, '{NORMAL_TO}') AS text FROM documents),
marked AS (SELECT doc_id, text, replace(replace({_RUNS}, chr(3) || '(', chr(3) || chr(4)), chr(3) || '+', chr(3) || chr(5)) AS marks,
  regexp_replace(text, '([A-Za-z0-9]+)', '\\1' || chr(6), 'g') AS runs FROM cleaned),
every AS ({_UNION}),
placed AS (SELECT *, end_at - length(value) AS start_at FROM every),
lists AS (SELECT doc_id, list([{{'type': type, 'value': value, 's': start_at, 'e': end_at}}] ORDER BY length(value) DESC, start_at, ord) AS l FROM placed GROUP BY doc_id),
greedy AS (SELECT doc_id, unnest(list_reduce(l, lambda acc, x: CASE WHEN len(list_filter(acc, lambda o: x[1].s < o.e AND x[1].e > o.s)) = 0 THEN list_concat(acc, x) ELSE acc END)) AS k FROM lists),
kept AS (SELECT doc_id, k.type AS type, k.value AS value, k.s AS start_at, k.e AS end_at FROM greedy)"""

#: after (doc_id, text): documents with pseudonyms, numbered by the first document, from its end.
AFTER = f"""{KEPT},
numbered AS (SELECT type, original, row_number() OVER (PARTITION BY type ORDER BY k) AS n FROM (SELECT type, trim(value) AS original, min((doc_id, -start_at)) AS k FROM kept GROUP BY ALL)),
named AS (SELECT kept.doc_id, start_at, end_at, kept.type || '_' || lpad(CAST(n AS VARCHAR), greatest(4, length(CAST(n AS VARCHAR)))::INTEGER, '0') AS token,
  coalesce(lag(end_at) OVER (PARTITION BY kept.doc_id ORDER BY start_at), 0) AS before FROM kept JOIN numbered ON kept.type = numbered.type AND trim(value) = original),
heads AS (SELECT c.doc_id, string_agg(substr(c.text, before + 1, start_at - before) || token, '' ORDER BY start_at) AS head, max(end_at) AS upto FROM named JOIN cleaned c USING (doc_id) GROUP BY c.doc_id),
after AS (SELECT c.doc_id, coalesce(head, '') || substr(c.text, coalesce(upto, 0) + 1) AS text FROM cleaned c LEFT JOIN heads USING (doc_id))"""
