"""SQL of operators whose statement is long: built level by level or kind by kind."""

from __future__ import annotations

#: CRC-32 of a list of byte values ``{bytes}`` by a table made in the same statement.
CRC_TABLE = """crc_table AS (SELECT list(v ORDER BY b) AS crc FROM (SELECT b, list_reduce(list_prepend(b, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) t(b)))"""
CRC = "xor(list_reduce(list_prepend(4294967295, {bytes}), lambda c, b: xor(c >> 8, crc[xor(c & 255, b) + 1])), 4294967295)"


def _levels(name: str, leaves: str, most: int) -> str:
    """Levels of the trees of ``leaves`` (g, pos, h, n), and ``{name}_path``: a walk of every
    leaf (with its ``cur``) to the root of its tree."""
    out = []
    before = leaves
    for k in range(most):
        side = lambda frame: f"coalesce(string_agg(h, '') OVER (PARTITION BY g, pos // 16 ORDER BY pos ROWS BETWEEN {frame}), '')"
        out.append(f"{name}_r{k} AS (SELECT g, pos, h, n, pos // 16 AS run, {side('UNBOUNDED PRECEDING AND 1 PRECEDING')} AS a, {side('1 FOLLOWING AND UNBOUNDED FOLLOWING')} AS z FROM {before})")
        out.append(f"{name}_l{k + 1} AS (SELECT g, run AS pos, CASE WHEN any_value(n) > 1 THEN sha256(string_agg(h, '' ORDER BY pos)) ELSE any_value(h) END AS h, (any_value(n) + 15) // 16 AS n FROM {name}_r{k} GROUP BY g, run)")
        before = f"{name}_l{k + 1}"
    walk, before = [], f"{name}_start"
    for k in range(most):
        walk.append(f"{name}_p{k} AS (SELECT id, p.g, p.pos // 16 AS pos, sib || a || z AS sib, CASE WHEN n > 1 THEN sha256(a || cur || z) ELSE cur END AS cur FROM {before} p JOIN {name}_r{k} r ON p.g = r.g AND p.pos = r.pos)")
        before = f"{name}_p{k}"
    return ",\n".join(out), ",\n".join(walk)


_OWN, _OWN_WALK = _levels("d", "leaf", 6)
_TOP, _TOP_WALK = _levels("s", "top", 5)
_FIELD = "coalesce(octet_length(encode({c}::VARCHAR))::VARCHAR || ':' || {c}::VARCHAR, '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c=c) for c in ("doc_id", "source", "lang", "n_chars")) + " || {t})"

#: Up to 16^6 documents a source and 16^5 sources.
MERKLE = f"""
    WITH {CRC_TABLE},
    told AS (SELECT *, CASE WHEN {CRC.format(bytes="list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)")} % 5 = 0
            THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS changed FROM documents, crc_table),
    hashed AS (SELECT doc_id, coalesce('s' || source, '') AS g, {_LEAF.format(t=_FIELD.format(c="text"))} AS h, {_LEAF.format(t=_FIELD.format(c="changed"))} AS claimed FROM told),
    leaf AS (SELECT row_number() OVER () AS id, doc_id, g, h, claimed, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n FROM hashed),
    {_OWN},
    sub AS (SELECT g AS grp, h AS subroot FROM d_l6),
    top AS (SELECT '' AS g, grp, row_number() OVER (ORDER BY grp) - 1 AS pos, subroot AS h, count(*) OVER () AS n FROM sub),
    {_TOP},
    d_start AS (SELECT id, g, pos, '' AS sib, claimed AS cur FROM leaf),
    {_OWN_WALK},
    s_start AS (SELECT id, '' AS g, top.pos, sib, cur FROM d_p5 JOIN top ON grp = d_p5.g),
    {_TOP_WALK}
    SELECT leaf.doc_id, leaf.h AS leaf, subroot, s_l5.h AS root, sha256(sib) AS proof_sha256, cur AS folded_root, cur = s_l5.h AS verified
    FROM leaf JOIN s_p4 USING (id) JOIN sub ON grp = leaf.g CROSS JOIN s_l5"""

_LUHN = "list_sum(list_transform(range(length({d})), lambda k: CASE WHEN k % 2 = 0 THEN {d}[length({d}) - k]::INT WHEN {d}[length({d}) - k]::INT > 4 THEN {d}[length({d}) - k]::INT * 2 - 9 ELSE {d}[length({d}) - k]::INT * 2 END)) % 10 = 0"
_DIGITS = "translate(p, ' +().-', '')"
_IBAN = "replace(p, ' ', '')"
_MOD = f"""list_reduce(list_prepend(0, list_transform(string_split(substr({_IBAN}, 5) || substr({_IBAN}, 1, 4), ''), lambda c: CASE WHEN ascii(c) >= 65 THEN ascii(c) - 55 ELSE ascii(c) - 48 END)),
    lambda rest, d: (rest * CASE WHEN d > 9 THEN 100 ELSE 10 END + d) % 97) = 1"""
_APART = "NOT (before = '' AND i > 2) AND NOT (after = '' AND i < n - 1) AND NOT regexp_matches(right(before, 1), '{c}') AND NOT regexp_matches(left(after, 1), '{c}')"
#: Kind, whether it is base, pattern, what confirms it, score, words for and against it.
_PII = (
    ("email", True, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true", 0.9, "mail|email|contact|write|address", "example"),
    ("ip", True, r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "len(list_filter(string_split(p, '.'), lambda x: CAST(x AS DOUBLE) > 255)) = 0", 0.6, "ip|server|host|address|client|login", "version|section|chapter"),
    ("card", True, r"[0-9]([\x20-]?[0-9])+", f"CASE WHEN length({_DIGITS}) BETWEEN 12 AND 19 THEN {_LUHN.format(d=_DIGITS)} ELSE false END", 0.6, "card|visa|mastercard|amex|credit|debit|cvv|karte|carte|tarjeta", "order|invoice|tracking|isbn|serial|version|item|sku"),
    ("phone", True, r"\+[0-9][\x20().0-9-]+[0-9]", f"length({_DIGITS}) BETWEEN 9 AND 15", 0.7, "phone|tel|telephone|call|mobile|cell|fax|telefon|anruf|portable|llame", "order|invoice|tracking|isbn|serial|version|item|sku"),
    ("iban", False, r"[A-Z]{2}[0-9]{2}((\x20[A-Z0-9]{4}){2,7}(\x20[A-Z0-9]{1,3})?|[A-Z0-9]{11,30})", f"{_APART.format(c='[A-Za-z0-9]')} AND {_MOD}", 0.8, "iban|account|bank|konto|compte|cuenta", "order|invoice|tracking|isbn|serial|version|item|sku"),
    ("pan", False, r"([0-9]{4}([\x20-][0-9]{4}){3}|[0-9]{12,19})", f"{_APART.format(c='[0-9]')} AND {_LUHN.format(d=_DIGITS)}", 0.6, "card|visa|mastercard|amex|credit|debit|cvv|karte|carte|tarjeta", "order|invoice|tracking|isbn|serial|version|item|sku"),
    ("tel", False, r"(\([0-9]{2,4}\)|0[0-9]{2,4})[\x20.-]?[0-9]{3,4}[\x20.-][0-9]{3,4}", _APART.format(c="[0-9]"), 0.3, "phone|tel|telephone|call|mobile|cell|fax|telefon|anruf|portable|llame", "order|invoice|tracking|isbn|serial|version|item|sku"),
)


def _kind(rank: int, name: str, base: bool, pattern: str, valid: str, score: float, words: str, against: str) -> str:
    near = "translate(right(before, 40) || ' ' || left(after, 40), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    has = lambda w: f"CASE WHEN regexp_matches({near}, '(^|[^a-z])({w})($|[^a-z])') THEN 0.3 ELSE 0 END"
    return f"""{name}_piece AS (SELECT id, unnest(ps) AS p, generate_subscripts(ps, 1) AS i FROM (SELECT id, string_split(regexp_replace(t, '{pattern}', chr(1) || '\\0' || chr(1), 'g'), chr(1)) AS ps FROM told)),
    {name}_at AS (SELECT id, p, i, count(*) OVER (PARTITION BY id) AS n, sum(length(p)) OVER w AS stop, coalesce(lag(p) OVER w, '') AS before, coalesce(lead(p) OVER w, '') AS after FROM {name}_piece WINDOW w AS (PARTITION BY id ORDER BY i)),
    {name}_span AS (SELECT id, stop - length(p) AS start, {rank} AS rank, '{name}' AS kind, stop, least(1, greatest(0, {score} + {has(words)} - {has(against)})) AS score, {str(base).lower()} AS base
        FROM {name}_at WHERE CASE WHEN i % 2 = 0 THEN {valid} ELSE false END)"""


PII = """
    WITH told AS (SELECT row_number() OVER () AS id, doc_id, replace(coalesce(text, ''), chr(1), chr(2)) AS t FROM documents),
    """ + ",\n    ".join(_kind(n, *k) for n, k in enumerate(_PII)) + """,
    spans AS (""" + " UNION ALL ".join(f"SELECT * FROM {k[0]}_span" for k in _PII) + """),
    kept AS (SELECT * FROM spans s WHERE base OR (score >= 0.5 AND NOT EXISTS (SELECT 1 FROM spans b WHERE b.base AND b.id = s.id AND b.start < s.stop AND s.start < b.stop)))
    SELECT doc_id, count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip, count(*) FILTER (kind = 'card') AS n_card, count(*) FILTER (kind = 'phone') AS n_phone,
        sha256(coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) FILTER (base), '')) AS base_sha256,
        coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) FILTER (kind IS NOT NULL), '') AS spans
    FROM told LEFT JOIN kept USING (id) GROUP BY id, doc_id"""


_BYTES = "list_transform(range(octet_length(encode({s}))), lambda i: ('0x' || substr(hex({s}), 2 * i + 1, 2))::BIGINT)"
SPELLING = f"""
    WITH RECURSIVE {CRC_TABLE},
    runs AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\u00c0-\u00ff]{{7,}}')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
    seen AS (SELECT doc_id, run, count(*) AS k FROM runs GROUP BY doc_id, run),
    slip AS (SELECT *, {CRC.format(bytes=_BYTES.format(s="(doc_id::VARCHAR || ':' || run)"))} AS h FROM seen, crc_table),
    made AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, k FROM slip),
    words AS (SELECT word, sum(k)::BIGINT AS n FROM made WHERE length(word) >= 7 GROUP BY word HAVING sum(k) >= 2),
    cut AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(length(word)))::INT AS i FROM words)),
    pair AS (SELECT a.word, a.n, b.word AS near, b.n AS m FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
        UNION SELECT a.word, a.n, b.word, b.n FROM cut a JOIN words b ON a.rest = b.word
        UNION SELECT b.word, b.n, a.word, a.n FROM cut a JOIN words b ON a.rest = b.word),
    best AS (SELECT word, any_value(n) AS n, count(*) AS n_near, max(m) AS m, arg_min(near, struct_pack(a := -m, b := near)) AS near FROM pair GROUP BY word),
    form AS (SELECT word, near AS form, m AS form_n FROM best WHERE m >= 10 * n),
    walk AS (SELECT word, word AS root FROM words UNION ALL SELECT walk.word, form.form FROM walk JOIN form ON walk.root = form.word),
    ends AS (SELECT word, root FROM walk ANTI JOIN form ON walk.root = form.word)
    SELECT words.word, words.n, coalesce(n_near, 0) AS n_near, form, form_n, root FROM words LEFT JOIN best USING (word) LEFT JOIN form USING (word) JOIN ends USING (word)"""
