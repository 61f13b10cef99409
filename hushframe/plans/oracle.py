"""SQL that DuckDB runs, equal in meaning to the engine's expressions."""

from __future__ import annotations

from collections.abc import Sequence

from hushframe.functions.patterns import BY_NAME, SPACE_RE2


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def digits(value: str) -> str:
    return f"regexp_replace({value}, '[^0-9]', '', 'g')"


def luhn(value: str) -> str:
    d = digits(value)
    return f"(list_sum(list_transform(range(1, length({d}) + 1), lambda i: CASE WHEN (length({d}) - i) % 2 = 0 THEN CAST(substr({d}, i, 1) AS INT) ELSE (2 * CAST(substr({d}, i, 1) AS INT)) // 10 + (2 * CAST(substr({d}, i, 1) AS INT)) % 10 END)) % 10 = 0)"


def iban(value: str) -> str:
    plain = f"upper(regexp_replace({value}, '[{SPACE_RE2}]', '', 'g'))"
    turned = f"substr({plain}, 5) || substr({plain}, 1, 4)"
    numbers = f"list_prepend(0, list_transform(string_split({turned}, ''), lambda c: instr('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', c) - 1))"
    return f"(regexp_full_match({plain}, '[A-Z]{{2}}[0-9]{{2}}[A-Z0-9]{{11,30}}') AND list_reduce({numbers}, lambda r, v: CASE WHEN v < 10 THEN (r * 10 + v) % 97 ELSE (r * 100 + v) % 97 END) = 1)"


def my_number(value: str) -> str:
    d = digits(value)
    total = " + ".join(f"{w} * CAST(substr({d}, {k + 1}, 1) AS INT)" for k, w in enumerate((6, 5, 4, 3, 2, 7, 6, 5, 4, 3, 2)))
    return f"(length({d}) = 12 AND CAST(substr({d}, 12, 1) AS INT) = CASE WHEN ({total}) % 11 <= 1 THEN 0 ELSE 11 - ({total}) % 11 END)"


def phone(value: str) -> str:
    return f"length(regexp_replace({value}, '[-{SPACE_RE2}]', '', 'g')) >= 10"


CHECKS = {"luhn": luhn, "iban": iban, "my_number": my_number, "phone": phone}
# RE2 looks neither ahead nor behind: what those would refuse is taken out afterwards.
WITHOUT_LOOKING = {
    "P13": (rf"\b[0-9]{{3}}[-{SPACE_RE2}]?[0-9]{{2}}[-{SPACE_RE2}]?[0-9]{{4}}\b", f"substr({digits('g')}, 1, 3) NOT IN ('000', '666') AND substr(g, 1, 1) <> '9' AND substr({digits('g')}, 4, 2) <> '00' AND substr({digits('g')}, 6, 4) <> '0000'"),
    "P17": (r"\b[0-9]{3}-[0-9]{4}", "NOT regexp_matches(substr(t, s + length(g) + 1, 1), '[0-9]')"),
}


def matches(base: str, source: str, group: int = 0, keep: str = "true", keys: Sequence[str] = ("id",), text: str = "text") -> str:
    """``keys, t, m, g, s``: matches of an RE2 pattern, their groups and offsets."""
    own, p = ", ".join(keys), quoted(source)
    return f"""SELECT * FROM (SELECT {own}, t, ms[i] AS m, gs[i] AS g, CAST(coalesce(list_sum(list_transform(ps[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS INT) AS s
FROM (SELECT {own}, {text} AS t, regexp_extract_all({text}, {p}, 0) AS ms, regexp_extract_all({text}, {p}, {group}) AS gs, string_split_regex({text}, {p}) AS ps, unnest(range(1, len(regexp_extract_all({text}, {p}, 0)) + 1)) AS i FROM ({base}))) WHERE {keep}"""


def pattern_spans(base: str, name: str, keys: Sequence[str] = ("id",), text: str = "text") -> str:
    """``keys, value, category, start_at, end_at`` of one of the engine's patterns."""
    p = BY_NAME[name]
    source, keep = WITHOUT_LOOKING.get(name, (p.re2, "true"))
    if p.check:
        keep += f" AND {CHECKS[p.check]('g')}"
    start = "s + instr(m, g) - 1" if p.group else "s"
    return f"SELECT {', '.join(keys)}, g AS value, '{p.category}' AS category, CAST({start} AS INT) AS start_at, CAST({start} + length(g) AS INT) AS end_at FROM ({matches(base, source, p.group, keep, keys, text)})"


def resolved(spans: str, key: str = "id") -> str:
    """Winners of ``key, value, category, start_at, end_at, ord``: one step of the recursion a span."""
    return f"""WITH RECURSIVE ranked AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY start_at, end_at DESC, ord) AS n FROM ({spans})),
walk AS (SELECT {key}, value, category, start_at, end_at, n, true AS kept, end_at AS last FROM ranked WHERE n = 1
UNION ALL SELECT r.{key}, r.value, r.category, r.start_at, r.end_at, r.n, r.start_at >= w.last, CASE WHEN r.start_at >= w.last THEN r.end_at ELSE w.last END FROM walk w JOIN ranked r ON r.{key} = w.{key} AND r.n = w.n + 1)
SELECT {key}, value, category, start_at, end_at FROM walk WHERE kept"""
