"""SQL for DuckDB that says what the queries say: pattern matches with offsets, check digits, folds."""

from __future__ import annotations

from veilspan.functions import patterns as P
from veilspan.functions.checks import CNPJ_WEIGHTS, DNI_LETTERS
from veilspan.functions.dimensions import LANGUAGES, STOPWORDS, field_labels

DIGITS = "regexp_replace({v}, '[^0-9]', '', 'g')"


def quoted(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _weighted(d: str, weights) -> str:
    return " + ".join(f"coalesce(try_cast(substr({d}, {i}, 1) AS INT), 0) * {w}" for i, w in enumerate(weights, 1))


def _same(d: str) -> str:
    return f"{d} = repeat(substr({d}, 1, 1), length({d}))"


def cpf(v: str) -> str:
    d = DIGITS.format(v=v)
    checks = [f"(({_weighted(d, range(n + 1, 1, -1))}) * 10 % 11 % 10) = try_cast(substr({d}, {n + 1}, 1) AS INT)" for n in (9, 10)]
    return f"coalesce(length({d}) = 11 AND NOT {_same(d)} AND {' AND '.join(checks)}, false)"


def cnpj(v: str) -> str:
    d = DIGITS.format(v=v)
    checks = []
    for n in (12, 13):
        rest = f"(({_weighted(d, CNPJ_WEIGHTS[-n:])}) % 11)"
        checks.append(f"(CASE WHEN {rest} < 2 THEN 0 ELSE 11 - {rest} END) = try_cast(substr({d}, {n + 1}, 1) AS INT)")
    return f"coalesce(length({d}) = 14 AND NOT {_same(d)} AND {' AND '.join(checks)}, false)"


def card(v: str) -> str:
    d = DIGITS.format(v=v)
    digit = f"try_cast(substr({d}, length({d}) - CAST(i AS INT), 1) AS INT)"
    doubled = f"CASE WHEN i % 2 = 0 THEN {digit} WHEN {digit} > 4 THEN {digit} * 2 - 9 ELSE {digit} * 2 END"
    return f"coalesce(length({d}) BETWEEN 13 AND 19 AND list_sum(list_transform(range(length({d})), lambda i: {doubled})) % 10 = 0, false)"


def iban(v: str) -> str:
    c = f"upper(regexp_replace({v}, '\\s', '', 'g'))"
    turned = f"(substr({c}, 5) || substr({c}, 1, 4))"
    step = "CASE WHEN regexp_full_match(c, '[0-9]') THEN (CAST(a AS INT) * 10 + ascii(c) - 48) % 97 ELSE (CAST(a AS INT) * 100 + ascii(c) - 55) % 97 END"
    return f"coalesce(CAST(list_reduce(list_prepend('0', regexp_extract_all({turned}, '.')), lambda a, c: CAST({step} AS VARCHAR)) AS INT) = 1, false)"


def dni(v: str) -> str:
    c = f"upper(regexp_replace({v}, '[\\s.-]', '', 'g'))"
    rx = "'^([XYZ]?)([0-9]{7,8})([A-Z])$'"
    number = f"try_cast(translate(regexp_extract({c}, {rx}, 1), 'XYZ', '012') || regexp_extract({c}, {rx}, 2) AS BIGINT)"
    return f"coalesce(regexp_matches({c}, {rx}) AND substr('{DNI_LETTERS}', CAST({number} % 23 + 1 AS BIGINT), 1) = regexp_extract({c}, {rx}, 3), false)"


def phone_b(v: str) -> str:
    return f"NOT regexp_matches({v}, '^(?:19|20)[0-9]{{2}}[\\s-]')"


def phone_a(v: str) -> str:
    return f"NOT regexp_matches({v}, '^(?:19|20)[0-9]{{2}}-(?:19|20)[0-9]{{2}}$') AND {phone_b(v)}"


VERIFY = {"cpf": cpf, "cnpj": cnpj, "card": card, "iban": iban, "dni": dni, "phone_a": phone_a, "phone_b": phone_b}


def matches(table: str, key: str, text: str, names) -> str:
    """A SELECT of (key, start, end, label, score, value) of verified matches, not yet absorbed."""
    out = []
    for name in names:
        p = P.by_id(name)
        rx = P.re2(p)
        if p.value:
            at = rx.index("(", rx.index(r"\s?"))
            rx, put = f"({rx[:at]}){rx[at:]}", r"\1' || chr(1) || '\2' || chr(1) || '"
        else:
            put = r"' || chr(1) || '\0' || chr(1) || '"
        pieces = f"SELECT {key}, string_split(regexp_replace({text}, {quoted(rx)}, '{put}', 'g'), chr(1)) AS p FROM {table} WHERE {text} IS NOT NULL"
        each = f"SELECT {key}, p, unnest(range(2, len(p) + 1, 2)) AS i FROM ({pieces})"
        spans = f"SELECT {key}, CAST(coalesce(list_sum(list_transform(p[1:i-1], lambda x: length(x))), 0) AS BIGINT) AS s, p[i] AS value FROM ({each})"
        check = f" WHERE {VERIFY[p.verify]('value')}" if p.verify else ""
        out.append(f"SELECT {key}, s AS start, s + length(value) AS \"end\", '{p.label}' AS label, CAST(1.0 AS DOUBLE) AS score, value FROM ({spans}){check}")
    return "\nUNION ALL\n".join(out)


def absorbed(spans: str, keys: str) -> str:
    """Nested spans of a label folded into their container."""
    return f"""SELECT {keys}, label, min(start) AS start, max("end") AS "end", max(score) AS score FROM (
      SELECT *, sum(fresh) OVER (PARTITION BY {keys}, label ORDER BY start, "end" DESC, fresh DESC ROWS UNBOUNDED PRECEDING) AS grp FROM (
        SELECT *, CASE WHEN "end" <= max("end") OVER (PARTITION BY {keys}, label ORDER BY start, "end" DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM ({spans}) q0) q1) q2
    GROUP BY {keys}, label, grp"""


def islands(spans: str, keys: str, touching: bool, more: str = "") -> str:
    """Ranges united; ``touching`` ones too, or overlapping ones only."""
    op = ">" if touching else ">="
    return f"""SELECT {keys}, min(start) AS start, max("end") AS "end"{more} FROM (
      SELECT *, sum(fresh) OVER (PARTITION BY {keys} ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS grp FROM (
        SELECT *, CASE WHEN coalesce(start {op} max("end") OVER (PARTITION BY {keys} ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) THEN 1 ELSE 0 END AS fresh FROM ({spans}) q0) q1) q2
    GROUP BY {keys}, grp"""


def masked(texts: str, ranges: str) -> str:
    """(doc_id, text) of ``texts`` with the ranges of each document covered."""
    return f"""SELECT t.doc_id, CASE WHEN r.rs IS NULL THEN t.text ELSE
      array_to_string(list_transform(range(1, len(r.rs) + 1), lambda i: substr(t.text, CASE WHEN i = 1 THEN 1 ELSE r.rs[i - 1].e + 1 END, r.rs[i].s - CASE WHEN i = 1 THEN 0 ELSE r.rs[i - 1].e END)
        || repeat('█', length_grapheme(substr(t.text, r.rs[i].s + 1, r.rs[i].e - r.rs[i].s)))), '') || substr(t.text, r.rs[len(r.rs)].e + 1) END AS text
    FROM ({texts}) t LEFT JOIN (SELECT doc_id, list({{'s': start, 'e': "end"}} ORDER BY start) AS rs FROM ({ranges}) q GROUP BY doc_id) r USING (doc_id)"""


def stopwords() -> str:
    return "(VALUES " + ", ".join(f"('{w}', '{lang}')" for lang, own in STOPWORDS.items() for w in own) + ") AS sw(token, language)"


def field_values() -> str:
    return "(VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in sorted(field_labels().items())) + ") AS fl(field, label)"


def votes(table: str, key: str, text: str) -> str:
    hits = ", ".join(f"count(*) FILTER (WHERE language = '{x}') AS hits_{x}" for x in LANGUAGES)
    tokens = f"SELECT {key}, unnest(regexp_extract_all(lower(strip_accents({text})), '[\\p{{L}}'']+')) AS token FROM {table}"
    h = f"SELECT {key}, {hits} FROM ({tokens}) w JOIN {stopwords()} USING (token) GROUP BY {key}"
    return f"SELECT k.{key}, " + ", ".join(f"coalesce(hits_{x}, 0) AS hits_{x}" for x in LANGUAGES) + f" FROM (SELECT DISTINCT {key} FROM {table}) k LEFT JOIN ({h}) h USING ({key})"


def languages(table: str, key: str, text: str) -> str:
    cols = [f"hits_{x}" for x in LANGUAGES]
    total = " + ".join(cols)
    ranked = f"list_reverse_sort([{', '.join(cols)}])"
    named = "CASE " + " ".join(f"WHEN hits_{x} = {ranked}[1] THEN '{x}'" for x in LANGUAGES) + " END"
    return f"SELECT *, CASE WHEN {ranked}[1] > {ranked}[2] AND {ranked}[1] / greatest({total}, 1) * least(1.0, ({total}) / 5) >= 0.5 THEN {named} END AS language FROM ({votes(table, key, text)})"
