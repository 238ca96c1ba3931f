"""DuckDB SQL of the registered queries' results, independent of how Spark computes them.

Findings: the engine has no look-around, so a step takes the first match that
stands behind a text start or a character that may precede it, and the next step
begins at that match's last character.
"""

from __future__ import annotations

W = r"\p{L}\p{N}_"
GAP = r"[\s\x{1c}-\x{1f}\x{85}\x{0b}\p{Z}]*"
#: kind -> (characters that may not precede, body, characters that may not follow)
KINDS = {
    "email": (rf"[^{W}.+\-]", r"[A-Za-z0-9._%+\-]{1,64}@[A-Za-z0-9.\-]{1,190}\.[A-Za-z]{2,30}", rf"[^{W}.\-]"),
    "cnic": (r"[^\p{Nd}]", r"\p{Nd}{5}-\p{Nd}{7}-\p{Nd}", r"[^\p{Nd}]"),
    "card": (r"[^\p{Nd}]", r"(?:\p{Nd}[ \-]?){12,18}\p{Nd}", r"[^\p{Nd}]"),
    "ipv4": (r"[^\p{Nd}.]", r"(?:\p{Nd}{1,3}\.){3}\p{Nd}{1,3}", r"[^\p{Nd}.]"),
    "phone": (rf"[^{W}]", r"\+?\p{Nd}[\p{Nd} ()+.\-]{6,24}\p{Nd}", rf"[^{W}]"),
    "iban": (rf"[^{W}]", r"[A-Z]{2}\p{Nd}{2}(?: ?[A-Z0-9]){11,30}", rf"[^{W}]"),
    "name": (rf"\n", r"[^\r\n]{2,120}", r"(?s:.)"),
    "address": (rf"\n", r"[^\r\n]{5,200}", r"(?s:.)"),
}
LEAD = {"name": rf"(?i:full name|name|patient|customer){GAP}:{GAP}", "address": rf"(?i:home address|postal address|address){GAP}:{GAP}"}
PRIORITY = {"custom": 0, "address": 1, "name": 2, "email": 3, "iban": 4, "card": 5, "cnic": 6, "ipv4": 7, "phone": 8}
DIGITS = "regexp_replace(v, '[^0-9]', '', 'g')"
LUHN = f"""(len({DIGITS}) BETWEEN 13 AND 19 AND len(list_distinct(string_split({DIGITS}, ''))) >= 2 AND
  list_sum(list_transform(range(1, len({DIGITS}) + 1), lambda i: CASE WHEN (len({DIGITS}) - i) % 2 = 0 THEN substr({DIGITS}, i, 1)::INT
    ELSE (substr({DIGITS}, i, 1)::INT * 2) // 10 + (substr({DIGITS}, i, 1)::INT * 2) % 10 END)) % 10 = 0)"""
PLAIN = "replace(v, ' ', '')"
IBAN = f"""(len({PLAIN}) BETWEEN 15 AND 34 AND list_reduce(list_prepend(0::BIGINT, list_transform(string_split(substr({PLAIN}, 5) || substr({PLAIN}, 1, 4), ''),
  lambda c: CASE WHEN c >= 'A' THEN (ascii(c) - 55)::BIGINT ELSE c::BIGINT END)), lambda a, x: CASE WHEN x > 9 THEN (a * 100 + x) % 97 ELSE (a * 10 + x) % 97 END) = 1)"""
IPV4 = "list_bool_and(list_transform(string_split(v, '.'), lambda o: regexp_full_match(o, '25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9]')))"
PHONE = r"(len(regexp_replace(v, '[^\p{Nd}]', '', 'g')) BETWEEN 9 AND 15 AND NOT regexp_full_match(v, '\p{Nd}{4}[.\-]\p{Nd}{2}[.\-]\p{Nd}{2}'))"
CHECKS = {"card": LUHN, "iban": IBAN, "ipv4": IPV4, "phone": PHONE}


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def walk(name: str, src: str, before: str, lead: str, body: str, after: str, first: str = "^|") -> str:
    """CTEs `name`: (doc_id, s, v) of all matches over src (doc_id, text)."""
    pat = lambda start: quoted(rf"(?s)^(.*?)({start}{before})({lead})({body})(?:{after}|$)")
    groups = "['p', 'b', 'l', 'v']"
    return f"""{name}_w AS (
  SELECT doc_id, text AS rest, 0 AS off, regexp_extract(text, {pat(first)}, {groups}) AS m FROM {src}
  UNION ALL
  SELECT doc_id, rest, off, regexp_extract(rest, {pat('')}, {groups}) AS m FROM (
    SELECT doc_id, substr(rest, len(m.p) + len(m.b) + len(m.l) + len(m.v)) AS rest, off + len(m.p) + len(m.b) + len(m.l) + len(m.v) - 1 AS off
    FROM {name}_w WHERE m.v <> '')),
{name} AS (SELECT doc_id, off + len(m.p) + len(m.b) + len(m.l) AS s, m.v AS v FROM {name}_w WHERE m.v <> '')"""


def literal_walk(name: str, src: str, literal: str) -> str:
    import re

    body = "(?i:" + re.sub(r"([^A-Za-z0-9])", lambda m: rf"\x{{{ord(m[1]):x}}}", literal) + ")"
    pat = quoted(rf"(?s)^(.*?)({body})")
    return f"""{name}_w AS (
  SELECT doc_id, text AS rest, 0 AS off, regexp_extract(text, {pat}, ['p', 'v']) AS m FROM {src}
  UNION ALL
  SELECT doc_id, rest, off, regexp_extract(rest, {pat}, ['p', 'v']) AS m FROM (
    SELECT doc_id, substr(rest, len(m.p) + len(m.v) + 1) AS rest, off + len(m.p) + len(m.v) AS off FROM {name}_w WHERE m.v <> '')),
{name} AS (SELECT doc_id, off + len(m.p) AS s, m.v AS v FROM {name}_w WHERE m.v <> '')"""


def candidates(src: str, kinds: list[str], literals: tuple[str, ...] = ()) -> str:
    """CTEs ending in c (doc_id, kind, s, v): candidates of the kinds that pass their checks."""
    parts, union = [], []
    for k in kinds:
        before, body, after = KINDS[k]
        parts.append(walk(f"w_{k}", src, before, LEAD.get(k, ""), body, after))
        union.append(f"SELECT doc_id, '{k}' AS kind, s, v FROM w_{k}" + (f" WHERE {CHECKS[k]}" if k in CHECKS else ""))
    for n, lit in enumerate(literals):
        parts.append(literal_walk(f"w_lit{n}", src, lit))
        union.append(f"SELECT doc_id, 'custom' AS kind, s, v FROM w_lit{n}")
    return ",\n".join([*parts, "c AS (" + " UNION ALL ".join(union) + ")"])


def accepted(src: str, kinds: list[str], literals: tuple[str, ...] = ()) -> str:
    """CTEs ending in a (doc_id, kind, s, e, v): what stays of the candidates."""
    order = " ".join(f"WHEN '{k}' THEN {p}" for k, p in PRIORITY.items())
    return (
        candidates(src, kinds, literals)
        + f""",
g AS (SELECT doc_id, list_sort(list({{'p': CASE kind {order} END, 'n': -len(v), 's': s, 'e': s + len(v), 'kind': kind, 'v': v}})) AS l FROM c GROUP BY doc_id),
f AS (SELECT doc_id, unnest(list_reduce(list_transform(l, lambda x: [x]), lambda acc, m:
  CASE WHEN len(list_filter(acc, lambda q: m[1].s < q.e AND q.s < m[1].e)) > 0 THEN acc ELSE list_concat(acc, m) END)) AS m FROM g),
a AS (SELECT doc_id, m.kind AS kind, m.s AS s, m.e AS e, m.v AS v FROM f)"""
    )


def redacted(src: str, kinds: list[str], literals: tuple[str, ...] = (), blocks: bool = False) -> str:
    """CTEs ending in t (doc_id, n, redacted)."""
    label = "'[REDACTED]'" if blocks else "'[' || upper(kind) || '_' || num || ']'"
    return (
        accepted(src, kinds, literals)
        + f""",
k1 AS (SELECT *, min(s) OVER (PARTITION BY doc_id, kind, lower(upper(v))) AS first_s FROM a),
k2 AS (SELECT *, dense_rank() OVER (PARTITION BY doc_id, kind ORDER BY first_s) AS num, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS prev FROM k1),
k3 AS (SELECT d.doc_id, count(*) AS n, max(e) AS last, string_agg(substr(d.text, prev + 1, s - prev) || {label}, '' ORDER BY s) AS head FROM k2 JOIN {src} d ON d.doc_id = k2.doc_id GROUP BY d.doc_id),
t AS (SELECT d.doc_id, coalesce(n, 0) AS n, CASE WHEN n IS NULL THEN coalesce(d.text, '') ELSE head || substr(d.text, last + 1) END AS redacted FROM {src} d LEFT JOIN k3 ON d.doc_id = k3.doc_id)"""
    )


DATA_KINDS = ["email", "card", "ipv4", "phone"]
ALL_KINDS = list(KINDS)

#: Texts with labelled names, addresses, identity numbers and account numbers, made from customers.
CONTACTS = """
  SELECT c_custkey AS doc_id, 'Name: ' || c_name || chr(10) || 'home address : ' || c_custkey || ' ' || c_mktsegment || ' Street' || chr(10)
    || 'ID ' || lpad(CAST(c_custkey AS VARCHAR), 5, '0') || '-' || lpad(CAST(c_custkey * 7 AS VARCHAR), 7, '0') || '-' || CAST(c_custkey % 10 AS VARCHAR)
    || ' IBAN DE' || lpad(CAST(98 - (c_custkey * 1000000 + 131400) % 97 - CASE WHEN c_custkey % 5 = 0 THEN 1 ELSE 0 END AS VARCHAR), 2, '0') || lpad(CAST(c_custkey AS VARCHAR), 18, '0')
    || '. Mail c' || CAST(c_custkey % 3 AS VARCHAR) || '@example.org, C' || CAST(c_custkey % 3 AS VARCHAR) || '@example.org' AS text
  FROM customer"""

#: Positioned words, made from the words of documents: eight to a line, three lines to a page; every eleventh is native.
WORDS = """
  SELECT doc_id, CAST(1 + CAST(FLOOR(pos / 24.0) AS INT) AS INT) AS page, CAST(pos AS INT) AS word_no, text, CAST(FLOOR(pos / 8.0) AS INT) AS line,
    (pos % 8) * 90.0e0 AS x0, (pos % 8) * 90.0e0 + 8.0e0 * length(text) AS x1, FLOOR(pos / 8.0e0) * 30.0e0 AS y0, FLOOR(pos / 8.0e0) * 30.0e0 + 20.0e0 AS y1,
    pos % 11 <> 5 AS is_ocr, CASE WHEN pos % 11 <> 5 THEN CAST((doc_id * 7 + pos * 13) % 101 AS DOUBLE) END AS confidence
  FROM base_words"""
BASE_WORDS = """
  SELECT doc_id, CAST(i - 1 AS INT) AS pos, w[i] AS text FROM (
    SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM (
      SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents))"""


def with_words(sql: str, pages: bool = False) -> str:
    """SQL after CTEs base_words, words, and o: words with their offsets."""
    return f"""WITH RECURSIVE base_words AS ({BASE_WORDS}), words AS ({WORDS}),
o AS (SELECT *, CAST(coalesce(sum(length(text)) OVER (PARTITION BY doc_id ORDER BY word_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
   + row_number() OVER (PARTITION BY doc_id ORDER BY word_no) - 1 + (page - 1) AS BIGINT) AS s FROM words),
txt AS (SELECT doc_id, string_agg(CASE WHEN word_no = 0 THEN '' WHEN pw IS NULL OR pl <> line OR pw <> page THEN chr(10) ELSE ' ' END || text
     || CASE WHEN nw IS NULL OR nw <> page THEN chr(10) ELSE '' END, '' ORDER BY word_no) AS text
   FROM (SELECT *, lag(page) OVER w AS pw, lag(line) OVER w AS pl, lead(page) OVER w AS nw FROM words WINDOW w AS (PARTITION BY doc_id ORDER BY word_no)) GROUP BY doc_id)
{sql}"""
