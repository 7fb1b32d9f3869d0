"""Format-preserving pseudonyms for personal numbers and dates, in SQL functions only.

Values are found by one pattern, validated (check digits, calendar, octets,
number ranges) and permuted within their format by a keyed Feistel network, so
that equal values get equal pseudonyms in every document, different values
different ones, and a card number stays a card number. What doesn't validate
is left alone. A value is a row of symbols, each with its own base: digits,
letters, octets, or the two factors of a day number. Half of the symbols at a
time is shifted by a hash of key, kind and the other half.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROUNDS = 10
#: The lengths are those that mail and domain names may have; without bounds a run of labels would overflow the matcher's stack.
_EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@(?:[A-Za-z0-9-]{1,63}+\.){1,127}[A-Za-z]{2,}"
_ISO_DATE = r"(?<![A-Za-z0-9-])\d{4}-\d{2}-\d{2}(?![A-Za-z0-9-])"
_DATE = r"(?<![A-Za-z0-9./])(?:\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4})(?![A-Za-z0-9])"
_IP = r"(?<![A-Za-z0-9.])\d{1,3}(?:\.\d{1,3}){3}(?!\.?[A-Za-z0-9])"
_SSN = r"(?<![A-Za-z0-9-])\d{3}-\d{2}-\d{4}(?![A-Za-z0-9-])"
_PHONE = r"(?<![A-Za-z0-9+])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}|(?:\(\d{3}\) ?|\d{3}[.-])\d{3}[.-]\d{4})(?![A-Za-z0-9])"
_CARD = r"(?<![A-Za-z0-9])(?:\d{13,19}|\d{4}(?: \d{4}){2} \d{1,7}|\d{4}(?:-\d{4}){2}-\d{1,7}|\d{4} \d{6} \d{5}|\d{4}-\d{6}-\d{5})(?![A-Za-z0-9])"
PATTERN = "|".join([_EMAIL, _ISO_DATE, _DATE, _IP, _SSN, _PHONE, _CARD])
#: Days from FIRST_DAY on that dates are permuted among: 400 years, 189 * 773 days.
FIRST_DAY, DAY_BASES = "1800-01-01", (189, 773)


def _text(value: str) -> str:
    """A SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _let(name: str, value: str, body: str) -> str:
    """SQL: body with a name for a value that is computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def feistel(symbols: str, bases: str, kind: str, key: str) -> str:
    """SQL: array<int> of symbols, each below its base, permuted; key is the name of a column."""
    other = "if(r % 2 = 1, slice(s, n div 2 + 1, n), slice(s, 1, n div 2))"
    digest = f"sha2(concat_ws('|', {key}, {_text(kind)}, n, r, array_join(CAST({other} AS ARRAY<STRING>), ',')), 512)"
    shift = "CAST(conv(substr(k, 1 + 4 * (i % 32), 4), 16, 10) AS INT)"
    turn = _let("k", digest, f"transform(s, (x, i) -> if((r % 2 = 1) = (i < n div 2), CAST(pmod(x + {shift}, bases[i]) AS INT), x))")
    return _let("bases", bases, _let("n", f"size({symbols})", f"aggregate(sequence(1, {ROUNDS}), {symbols}, (s, r) -> {turn})"))


def _string(value: str, first: str, last: str, kind: str, key: str) -> str:
    """SQL: a string with its ASCII letters and digits from place first to before last permuted, each within its class."""
    code = "ascii(x) - CASE WHEN x BETWEEN '0' AND '9' THEN 48 WHEN x BETWEEN 'a' AND 'z' THEN 97 ELSE 65 END"
    base = "if(x BETWEEN '0' AND '9', 10, 26)"
    picked = f"filter(c, (x, i) -> i >= {first} AND i < {last} AND x rlike '^[0-9A-Za-z]$')"
    fill = f"""aggregate(sequence(0, size(c) - 1), named_struct('t', '', 'j', 0), (a, i) ->
        if(i >= {first} AND i < {last} AND c[i] rlike '^[0-9A-Za-z]$',
           named_struct('t', concat(a.t, chr(f[a.j] + CASE WHEN c[i] BETWEEN '0' AND '9' THEN 48 WHEN c[i] BETWEEN 'a' AND 'z' THEN 97 ELSE 65 END)), 'j', a.j + 1),
           named_struct('t', concat(a.t, c[i]), 'j', a.j)), a -> a.t)"""
    body = _let("p", picked, _let("y", f"transform(p, x -> {code})", _let("f", feistel("y", f"transform(p, x -> {base})", kind, key), fill)))
    return _let("c", f"split({value}, '')", body)


def _luhn(digits: str, doubled: int) -> str:
    """SQL: the Luhn sum of a string of digits; doubled: 1 if the last digit is the check digit, else 0."""
    return f"aggregate(transform(reverse(split({digits}, '')), (x, i) -> if(i % 2 = {doubled}, CAST(x AS INT) * 2 - if(CAST(x AS INT) > 4, 9, 0), CAST(x AS INT))), 0, (a, x) -> a + x)"


def _refill(value: str, digits: str) -> str:
    """SQL: the value with its digits replaced in order."""
    return f"""aggregate(split({value}, ''), named_struct('t', '', 'j', 1), (a, x) -> if(x BETWEEN '0' AND '9',
        named_struct('t', concat(a.t, substr({digits}, a.j, 1)), 'j', a.j + 1), named_struct('t', concat(a.t, x), 'j', a.j)), a -> a.t)"""


def _card(m: str, key: str) -> str:
    body = _let("e", _string("substr(d, 1, length(d) - 1)", "0", "length(d) - 1", "card", key), _let("z", f"concat(e, CAST((10 - {_luhn('e', 0)} % 10) % 10 AS STRING))", _refill(m, "z")))
    return _let("d", f"regexp_replace({m}, '[^0-9]', '')", f"if({_luhn('d', 1)} % 10 = 0, {body}, {m})")


def _day(valid_date: str, fmt: str, m: str, key: str) -> str:
    days = _let("v", f"datediff({valid_date}, DATE'{FIRST_DAY}')", f"if(v BETWEEN 0 AND {DAY_BASES[0] * DAY_BASES[1] - 1}, array(v div {DAY_BASES[1]}, v % {DAY_BASES[1]}), array())")
    moved = _let("g", feistel("w", f"array({DAY_BASES[0]}, {DAY_BASES[1]})", "date", key), f"date_format(date_add(DATE'{FIRST_DAY}', g[0] * {DAY_BASES[1]} + g[1]), {fmt})")
    return _let("w", f"transform({days}, x -> CAST(x AS INT))", f"if(size(w) = 0, {m}, {moved})")


def _date(m: str, key: str) -> str:
    """Years, months and days as they stand; of a slashed or dotted date the first number is the day unless only the other can be."""
    iso = f"{m} rlike '^[0-9]{{4}}-'"
    parts = _let("q", f"transform(split({m}, '[-/.]'), x -> CAST(x AS INT))", f"if({iso}, named_struct('y', q[0], 'm', q[1], 'd', q[2], 'f', 'yyyy-MM-dd'), if(q[1] <= 12, named_struct('y', q[2], 'm', q[1], 'd', q[0], 'f', if(contains({m}, '/'), 'dd/MM/yyyy', 'dd.MM.yyyy')), named_struct('y', q[2], 'm', q[0], 'd', q[1], 'f', if(contains({m}, '/'), 'MM/dd/yyyy', 'MM.dd.yyyy'))))")
    valid = "u.y BETWEEN 1 AND 9999 AND u.m BETWEEN 1 AND 12 AND u.d >= 1 AND u.d <= CASE WHEN u.m IN (4, 6, 9, 11) THEN 30 WHEN u.m <> 2 THEN 31 WHEN u.y % 4 = 0 AND (u.y % 100 <> 0 OR u.y % 400 = 0) THEN 29 ELSE 28 END"
    return _let("u", parts, f"if({valid}, {_day('make_date(u.y, u.m, u.d)', 'u.f', m, key)}, {m})")


def _ip(m: str, key: str) -> str:
    body = f"array_join(CAST({feistel('o', 'array(256, 256, 256, 256)', 'ip', key)} AS ARRAY<STRING>), '.')"
    return f"if({m} rlike '(^|[.])0[0-9]', {m}, {_let('o', f'''transform(split({m}, '[.]'), x -> CAST(x AS INT))''', f'if(array_max(o) > 255, {m}, {body})')})"


def _ssn(m: str, key: str) -> str:
    symbols = "array(q[0] - if(q[0] > 666, 2, 1), q[1] - 1, q[2] - 1)"
    back = "concat(lpad(CAST(f[0] + if(f[0] >= 665, 2, 1) AS STRING), 3, '0'), '-', lpad(CAST(f[1] + 1 AS STRING), 2, '0'), '-', lpad(CAST(f[2] + 1 AS STRING), 4, '0'))"
    body = _let("y", symbols, _let("f", feistel("y", "array(898, 99, 9999)", "ssn", key), back))
    return _let("q", f"transform(split({m}, '-'), x -> CAST(x AS INT))", f"if(q[0] IN (0, 666) OR q[0] >= 900 OR q[1] = 0 OR q[2] = 0, {m}, {body})")


def _phone(m: str, key: str) -> str:
    country = f"length(regexp_extract({m}, '^[+][0-9]{{1,3}}(?=[ .(-])|^[+][0-9]{{1,2}}', 0))"
    return _let("h", country, _string(m, "h", f"length({m})", "phone", key))


def kind_of(m: str) -> str:
    """SQL: what a match looks like."""
    return f"""CASE WHEN contains({m}, '@') THEN 'email' WHEN {m} rlike '^([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}|[0-9]{{1,2}}([/.])[0-9]{{1,2}}[/.][0-9]{{4}})$' THEN 'date'
        WHEN {m} rlike '^[0-9]{{1,3}}([.][0-9]{{1,3}}){{3}}$' THEN 'ip' WHEN {m} rlike '^[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}$' THEN 'ssn'
        WHEN {m} rlike '^[0-9][0-9 -]*$' AND length(regexp_replace({m}, '[^0-9]', '')) >= 13 THEN 'card' ELSE 'phone' END"""


def pseudonym(m: str, key: str) -> str:
    """SQL: the pseudonym of a match, or the match itself where it isn't valid."""
    return f"""CASE {kind_of(m)} WHEN 'email' THEN {_string(m, "0", f"instr({m}, '@') - 1", "email", key)} WHEN 'date' THEN {_date(m, key)}
        WHEN 'ip' THEN {_ip(m, key)} WHEN 'ssn' THEN {_ssn(m, key)} WHEN 'card' THEN {_card(m, key)} ELSE {_phone(m, key)} END"""


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """The documents with pseudonyms in their texts, and ``pii`` beside: a map of kinds to numbers of values.

    E-mail addresses (their local part; the domain stays), card numbers that
    pass the Luhn check, calendar dates from 1800 to 2199, IPv4 addresses,
    telephone numbers (their country code stays) and social security numbers.
    An address has a local part of at most 64 characters and at most 128 labels
    of at most 63. Null and empty texts stay as they are, with an empty map; so
    does all other text and every other column, whatever its name. Texts of any
    length are searched whole, in one pass; equal values, also in repeated rows,
    get equal pseudonyms, as far as they are spelled alike: mail addresses that
    differ in case and telephone numbers that differ in their separators are
    different values. An empty table gives no rows.
    """
    names = docs.columns
    at = names.index(text_col)
    flat = docs.toDF(*[f"_{i}" for i in range(len(names))])
    text = F.col(f"_{at}").cast("string")
    found = F.when(text.rlike("[0-9@]"), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)))
    flat = flat.withColumn("_found", F.coalesce(found, F.array().cast("array<string>")))
    # A table of one row, so that plans, which are logged and shown, name the key and don't hold it.
    flat = flat.withColumn("_secret", docs.sparkSession.sql("SELECT secret FROM VALUES (:key) AS t(secret)", args={"key": key}).scalar())
    flat = flat.withColumn("_new", F.expr(f"transform(_found, m -> {pseudonym('m', '_secret')})"))
    pieces = F.split(text, PATTERN, -1)
    joined = F.concat_ws("", F.transform(pieces, lambda p, i: F.concat(p, F.coalesce(F.get("_new", i), F.lit("")))))
    flat = flat.withColumn("_text", F.when(F.size("_found") > 0, joined).otherwise(text))
    flat = flat.withColumn("_kinds", F.expr(f"transform(filter(arrays_zip(_found, _new), z -> z._found <> z._new), z -> {kind_of('z._found')})"))
    flat = flat.withColumn("_pii", F.expr("map_from_arrays(array_distinct(_kinds), transform(array_distinct(_kinds), k -> size(filter(_kinds, x -> x = k))))"))
    kept = [F.col("_text" if i == at else f"_{i}").alias(name) for i, name in enumerate(names)]
    return flat.select(*kept, F.col("_pii").alias("pii"))
