"""SQL for the keyword queries: the tokenizer written once more, in regular expressions, for DuckDB."""

from __future__ import annotations


def _sounds(x: str) -> str:
    """A word with each y as a vowel (i) or a consonant (b)."""
    out = f"regexp_replace({x}, '^y', 'b')"
    for _ in range(2):
        out = f"regexp_replace(regexp_replace({out}, '([^aeiouy])y', '\\1i', 'g'), '([aeiou])y', '\\1b', 'g')"
    return out


def _measure(x: str) -> str:
    return f"len(regexp_extract_all({_sounds(x)}, '[aeiou][^aeiou]'))"


def _vowel(x: str) -> str:
    return f"regexp_matches({_sounds(x)}, '[aeiou]')"


def _short(x: str) -> str:
    return f"(regexp_matches({_sounds(x)}, '[^aeiou][aeiou][^aeiou]$') AND right({x}, 1) NOT IN ('w', 'x', 'y'))"


def _cut(x: str, n: int) -> str:
    return f"substr({x}, 1, length({x}) - {n})"


def _ends(x: str, end: str) -> str:
    return f"(length({x}) > {len(end)} AND ends_with({x}, '{end}'))"


_TWO = "ational>ate ization>ize iveness>ive fulness>ful ousness>ous tional>tion biliti>ble entli>ent ousli>ous ation>ate alism>al aliti>al iviti>ive enci>ence anci>ance izer>ize logi>log alli>al ator>ate bli>ble eli>e"
_THREE = "icate>ic ative> alize>al iciti>ic ical>ic ness> ful>"
_FOUR = "ement ance ence able ible ment ant ent ion ism ate iti ous ive ize al er ic ou"


def _swap(x: str, pairs: str) -> str:
    whens = "".join(f" WHEN {_ends(x, a)} THEN CASE WHEN {_measure(_cut(x, len(a)))} > 0 THEN {_cut(x, len(a))} || '{b}' ELSE {x} END" for a, b in (p.split(">") for p in pairs.split()))
    return f"CASE{whens} ELSE {x} END"


def _drop(x: str) -> str:
    whens = ""
    for end in _FOUR.split():
        more = f" AND right({_cut(x, 3)}, 1) IN ('s', 't')" if end == "ion" else ""
        whens += f" WHEN {_ends(x, end)} THEN CASE WHEN {_measure(_cut(x, len(end)))} > 1{more} THEN {_cut(x, len(end))} ELSE {x} END"
    return f"CASE{whens} ELSE {x} END"


def stems(words: str, to: str = "stemmed", p: str = "p") -> str:
    """CTEs, named by `p`, from a table `words` (w) to one of (w, token)."""
    s = "CASE WHEN (length(x) > 4 AND ends_with(x, 'sses')) OR (length(x) > 3 AND ends_with(x, 'ies')) THEN " + _cut("x", 2) + " WHEN ends_with(x, 'ss') OR NOT ends_with(x, 's') THEN x ELSE " + _cut("x", 1) + " END"
    past = f"CASE WHEN {_ends('x', 'eed')} THEN 'eed' WHEN {_ends('x', 'ing')} AND {_vowel(_cut('x', 3))} THEN 'ing' WHEN {_ends('x', 'ed')} AND NOT {_ends('x', 'eed')} AND {_vowel(_cut('x', 2))} THEN 'ed' ELSE '' END"
    mended = (
        f"CASE WHEN e = '' THEN x WHEN e = 'eed' THEN CASE WHEN {_measure(_cut('x', 3))} > 0 THEN {_cut('x', 1)} ELSE x END"
        f" WHEN length(b) > 2 AND right(b, 2) IN ('at', 'bl', 'iz') THEN b || 'e'"
        f" WHEN length(b) > 1 AND right(b, 1) = substr(b, length(b) - 1, 1) AND right(b, 1) NOT IN ('a', 'e', 'i', 'o', 'u', 'l', 's', 'z') THEN {_cut('b', 1)}"
        f" WHEN {_measure('b')} = 1 AND {_short('b')} THEN b || 'e' ELSE b END"
    )
    y = f"CASE WHEN ends_with(x, 'y') AND {_vowel(_cut('x', 1))} THEN {_cut('x', 1)} || 'i' ELSE x END"
    e = f"CASE WHEN ends_with(x, 'e') AND ({_measure(_cut('x', 1))} > 1 OR ({_measure(_cut('x', 1))} = 1 AND NOT {_short(_cut('x', 1))})) THEN {_cut('x', 1)} ELSE x END"
    ll = f"CASE WHEN length(x) > 1 AND ends_with(x, 'll') AND {_measure(_cut('x', 1))} > 1 THEN {_cut('x', 1)} ELSE x END"
    out = f"""{p}0 AS (SELECT w, strip_accents(lower(w)) AS f FROM {words}), {p}1 AS (SELECT w, f, f AS x FROM {p}0 WHERE length(f) >= 3),
{p}2 AS (SELECT w, f, {s} AS x FROM {p}1), {p}3 AS (SELECT w, f, x, {past} AS e FROM {p}2), {p}4 AS (SELECT *, substr(x, 1, length(x) - length(e)) AS b FROM {p}3), {p}5 AS (SELECT w, f, {mended} AS x FROM {p}4)"""
    for k, step in enumerate((y, _swap("x", _TWO), _swap("x", _THREE), _drop("x"), e, ll), 6):
        out += f", {p}{k} AS (SELECT w, f, {step} AS x FROM {p}{k - 1})"
    return out + f", {to} AS (SELECT w, CASE WHEN strlen(f) > 64 THEN f ELSE x END AS token FROM {p}11 UNION ALL SELECT w, f FROM {p}0 WHERE length(f) < 3)"


def cut(column: str) -> str:
    """The words of a column, as they are written."""
    return f"list_filter(regexp_split_to_array(coalesce({column}, ''), '[^\\p{{L}}\\p{{M}}\\p{{N}}\\p{{Co}}]+'), lambda w: w <> '')"


def postings(rows: str) -> str:
    """CTEs from a table of rows (rowid, file, name, body) to `uses` (rowid, file, token, un, ub) and `sizes` (rowid, file, length)."""
    return f"""cuts AS (SELECT rowid, file, {cut('name')} AS n, {cut('body')} AS b FROM {rows}),
each AS (SELECT rowid, file, unnest(n) AS w, 1 AS un, 0 AS ub FROM cuts UNION ALL SELECT rowid, file, unnest(b), 0, 1 FROM cuts),
vocab AS (SELECT DISTINCT w FROM each), {stems('vocab')},
uses AS (SELECT rowid, file, token, sum(un) AS un, sum(ub) AS ub FROM each JOIN stemmed USING (w) GROUP BY 1, 2, 3),
sizes AS (SELECT rowid, file, len(n) + len(b) AS length FROM cuts)"""
