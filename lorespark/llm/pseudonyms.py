"""Format-preserving Feistel pseudonyms for personal data, in Spark SQL expressions only.

One pattern finds candidates of all kinds; each is validated (Luhn, mod 97, octets, calendar, number ranges, ...), and a
valid one is replaced by a keyed permutation of itself within its format; everything else stays as it is. A stretch that
is no card or IBAN as a whole is searched for those between its spaces and hyphens. The
permutation depends on the key, the kind and the canonical value alone, so equal values get equal pseudonyms in all
documents, and different ones different pseudonyms.

* Strings of digits and letters: the characters become numbers below their radix (10 or 26); a Feistel network adds, to
  each half in turn, a key stream from SHA-512 of the other half. Separators and letter case stay.
  cards (13 to 19 digits, Luhn): the first six stay, the middle is permuted, the check digit is set anew.
  IBANs (mod 97): the country stays, the account is permuted, both check digits are set anew.
  phones: all digits behind the country code (7 to 14 of them). e-mail: letters and digits before the @.
* Numbers: a Feistel network on a * b values. IPv4: 65536 * 65536. Dates from 1900 to 2099 (yyyy-mm-dd, dd.mm.yyyy,
  dd/mm/yyyy, or mm/dd/yyyy where that is no date): 17 * 4297 days. US social security numbers: 898 areas * (99 * 9999).

There is no shuffle, no join and no Python: the expression is evaluated row by row in the JVM. Texts without a digit
and without an @ are passed on at once.

Defined results: a null text stays null, an empty one empty, both without finds; repeated rows are treated alike; an
empty table gives an empty result; other columns are passed on, whatever their names. Text of any length is handled whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import numbered, pick

ROUNDS = 8
#: A public key for tests; values hidden with it can be computed by anybody
TEST_KEY = "lorespark"
KINDS = ("email", "iban", "date", "ssn", "phone", "ip", "card")

CARD = r"[0-9](?:[ -]?[0-9]){12,18}"
IBAN = r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?"
# What a stretch of cards or IBANs must not take from a date, number or address behind a space
_NO_DIGITS = r"(?! (?:[0-9]{1,3}[./][0-9]|[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9])|[0-9]{3}-[0-9]{2,3}-[0-9]{4}(?![0-9])))"
_NO_LETTERS = r"(?! (?:[A-Z0-9]{1,4}[./-][0-9]|[A-Za-z0-9._%+-]{1,64}@))"
# One group for each kind, in the order of KINDS. For cards and IBANs it finds the stretch that may hold some, with what
# stands beside them, of any length: repetition without a bound is possessive, so that it needs no stack. An IBAN's
# stretch is runs of a multiple of four characters, each whole, and at most one other run behind them.
_FOURS = r"(?:[A-Z0-9]{4})"
_RUN_ENDS = r"(?![A-Za-z0-9])"
PATTERN = (
    r"(?<![A-Za-z0-9._%+-])([A-Za-z0-9._%+-]{1,64}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24})"
    rf"|(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}}(?:{_NO_LETTERS} ?[A-Z0-9]{{4}}){{2}})([A-Z]{{2}}[0-9]{{2}}{_FOURS}*+"
    rf"(?:[A-Z0-9]{{1,3}}{_RUN_ENDS}|{_RUN_ENDS}(?:{_NO_LETTERS} {_FOURS}++{_RUN_ENDS})*+(?:{_NO_LETTERS} {_FOURS}*+[A-Z0-9]{{1,3}}{_RUN_ENDS})?))"
    r"|(?<![0-9./-])([0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}[./][0-9]{2}[./][0-9]{4})(?![0-9]|[./-][0-9])"
    r"|(?<![0-9-])([0-9]{3}-[0-9]{2}-[0-9]{4})(?![0-9]|-[0-9])"
    r"|(\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ .-]?[0-9]{2,4}){2,4}(?![0-9])|(?<![0-9(])\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}(?![0-9])|(?<![0-9.-])[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![0-9]|[.-][0-9]))"
    r"|(?<![0-9.])([0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3})(?![0-9]|\.[0-9])"
    rf"|(?<![0-9])(?<![0-9]-)([0-9](?:{_NO_DIGITS}[ -]?[0-9]){{12,}}+)"
)
#: The same without groups that differ, for split and the list of whole matches.
DAYS_FROM, DAYS_A, DAYS_B = "1900-01-01", 17, 4297
SSN_A, SSN_B = 898, 99 * 9999


def _let(name: str, value: str, body: str) -> str:
    """body with the lambda variable `name` bound to value, so that value is evaluated once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _int_hash(key: str, kind: str, rnd: str, x: str) -> str:
    """A keyed number of 52 bits from SHA-256."""
    return f"cast(conv(substring(sha2(concat('{key}:{kind}:', {rnd}, ':', {x}), 256), 1, 13), 16, 10) as bigint)"


def _feistel_number(key: str, kind: str, a: int, b: int, x: str) -> str:
    """A permutation of 0 .. a*b-1: the quotient and the remainder by b are moved in turn by a hash of the other."""
    step = (
        f"if(i % 2 = 0, struct((s.l + {_int_hash(key, kind, 'i', 's.r')}) % {a} as l, s.r as r), "
        f"struct(s.l as l, (s.r + {_int_hash(key, kind, 'i', 's.l')}) % {b} as r))"
    )
    return f"aggregate(sequence(0, {ROUNDS - 1}), struct(cast(({x}) div {b} as bigint) as l, cast(({x}) % {b} as bigint) as r), (s, i) -> {step}, s -> s.l * {b} + s.r)"


def _stream(key: str, kind: str, rnd: str, half: str, n: str) -> str:
    """n numbers below 2**32 from SHA-512 of the other half, 16 for each block."""
    block = f"sha2(concat('{key}:{kind}:', {rnd}, ':', {n}, ':', q, ':', array_join({half}, ',')), 512)"
    blocks = f"array_join(transform(sequence(0, ({n}) div 16), q -> {block}), '')"
    return _let("h", blocks, f"transform(sequence(0, {n}), j -> cast(conv(substring(h, 8 * j + 1, 8), 16, 10) as bigint))")


def _feistel_symbols(key: str, kind: str, symbols: str) -> str:
    """A permutation of arrays of structs (v, m): values v below their radix m; the radixes stay where they are."""
    move = lambda own, other: _let("ks", _stream(key, kind, "i", f"transform(s.{other}, z -> z.v)", f"size(s.{own})"), f"transform(s.{own}, (z, k) -> struct((z.v + ks[k]) % z.m as v, z.m as m))")
    step = f"if(i % 2 = 0, struct({move('a', 'b')} as a, s.b as b), struct(s.a as a, {move('b', 'a')} as b))"
    start = f"struct(slice(y, 1, size(y) div 2) as a, slice(y, size(y) div 2 + 1, size(y)) as b)"
    run = f"aggregate(sequence(0, {ROUNDS - 1}), {start}, (s, i) -> {step}, s -> concat(s.a, s.b))"
    return _let("y", symbols, run)


_CHARS = "filter(split({x}, ''), c -> c != '')"


def _symbol(c: str) -> str:
    """A digit or ASCII letter as a number and its radix."""
    return (
        f"struct(cast(case when {c} between '0' and '9' then ascii({c}) - 48 when {c} between 'A' and 'Z' then ascii({c}) - 65 "
        f"else ascii({c}) - 97 end as bigint) as v, cast(if({c} between '0' and '9', 10, 26) as bigint) as m)"
    )


def _spell(values: str, like: str) -> str:
    """The string `like` with its digits and letters replaced by the values in turn; case and other characters stay."""
    chars = _CHARS.format(x=like)
    at = "aggregate(slice(cs, 1, p), 0, (n, c) -> n + if(c rlike '[0-9A-Za-z]', 1, 0))"
    one = (
        f"case when c between '0' and '9' then chr(48 + vs[{at}].v) when c between 'A' and 'Z' then chr(65 + vs[{at}].v) "
        f"when c between 'a' and 'z' then chr(97 + vs[{at}].v) else c end"
    )
    return _let("vs", values, _let("cs", chars, f"array_join(transform(cs, (c, p) -> {one}), '')"))


def _permute(key: str, kind: str, x: str) -> str:
    """x with its digits and ASCII letters permuted. The key stream depends on them alone, not on case or separators."""
    symbols = f"transform(filter(split({x}, ''), c -> c rlike '[0-9A-Za-z]'), c -> {_symbol('c')})"
    return _spell(_feistel_symbols(key, kind, symbols), x)


def _luhn(digits: str) -> str:
    """The Luhn sum of a string of digits."""
    d = "cast(substring(ds, length(ds) - k, 1) as int)"
    return _let("ds", digits, f"aggregate(sequence(0, length(ds) - 1), 0, (n, k) -> n + if(k % 2 = 0, {d}, if({d} > 4, 2 * {d} - 9, 2 * {d})))")


def _digits(x: str) -> str:
    return f"regexp_replace({x}, '[^0-9]', '')"


def _respace(digits: str, like: str) -> str:
    """The digits in the places of like's digits."""
    at = "length(regexp_replace(substring(lk, 1, p), '[^0-9]', ''))"
    return _let("nd", digits, _let("lk", like, f"array_join(transform({_CHARS.format(x='lk')}, (c, p) -> if(c between '0' and '9', substring(nd, {at} + 1, 1), c)), '')"))


def _mod97(x: str) -> str:
    return f"aggregate({_CHARS.format(x=x)}, 0L, (n, c) -> if(c between '0' and '9', (n * 10 + ascii(c) - 48) % 97, (n * 100 + ascii(c) - 55) % 97))"


def _card(key: str) -> tuple[str, str]:
    d = _digits("m")
    valid = f"m rlike '^{CARD}$' and {_luhn(d)} % 10 = 0 and not {d} rlike '^(.)\\\\1*$'"
    body = f"concat(substring(d, 1, 6), {_permute(key, 'card', 'substring(d, 7, length(d) - 7)')})"
    fresh = _let("d", d, _let("body", body, f"concat(body, cast((10 - {_luhn(chr(99) + 'oncat(body, ' + chr(39) + '0' + chr(39) + ')')} % 10) % 10 as string))"))
    return valid, _respace(fresh, "m")


def _iban(key: str) -> tuple[str, str]:
    plain = "replace(m, ' ', '')"
    valid = f"m rlike '^{IBAN}$' and length({plain}) between 15 and 34 and {_mod97(f'concat(substring({plain}, 5), substring({plain}, 1, 4))')} = 1"
    fresh = _let("b", plain, _let("acc", _permute(key, "iban", "substring(b, 5)"), f"concat(substring(b, 1, 2), lpad(cast(98 - {_mod97(chr(99) + 'oncat(acc, substring(b, 1, 2), ' + chr(39) + '00' + chr(39) + ')')} as string), 2, '0'), acc)"))
    spaced = _let("nd", fresh, f"array_join(transform({_CHARS.format(x='m')}, (c, p) -> if(c = ' ', c, substring(nd, p + 1 - length(regexp_replace(substring(m, 1, p), '[^ ]', '')), 1))), '')")
    return valid, spaced


def _date(key: str) -> tuple[str, str]:
    """With slashes the day may come second, where the other order is no date; the order stays."""
    first, second, year = "substring(m, 1, 2)", "substring(m, 4, 2)", "substring(m, 7, 4)"
    us = f"(substring(m, 3, 1) = '/' and try_cast(concat({year}, '-', {second}, '-', {first}) as date) is null)"
    iso = f"if(substring(m, 5, 1) = '-', m, if({us}, concat({year}, '-', {first}, '-', {second}), concat({year}, '-', {second}, '-', {first})))"
    day = f"datediff(try_cast({iso} as date), date'{DAYS_FROM}')"
    valid = f"coalesce({day} between 0 and {DAYS_A * DAYS_B - 1}, false) and (substring(m, 5, 1) = '-' or substring(m, 3, 1) = substring(m, 6, 1))"
    moved = f"date_add(date'{DAYS_FROM}', cast({_feistel_number(key, 'date', DAYS_A, DAYS_B, day)} as int))"
    return valid, _let("t", f"cast({moved} as string)", f"if(substring(m, 5, 1) = '-', t, concat(if({us}, substring(t, 6, 2), substring(t, 9, 2)), substring(m, 3, 1), if({us}, substring(t, 9, 2), substring(t, 6, 2)), substring(m, 6, 1), substring(t, 1, 4)))")


def _ssn(key: str) -> tuple[str, str]:
    a, g, s = "cast(substring(m, 1, 3) as bigint)", "cast(substring(m, 5, 2) as bigint)", "cast(substring(m, 8, 4) as bigint)"
    valid = f"{a} between 1 and 899 and {a} != 666 and {g} > 0 and {s} > 0"
    number = f"({a} - 1 - if({a} > 666, 1, 0)) * {SSN_B} + ({g} - 1) * 9999 + {s} - 1"
    area, rest = f"(n div {SSN_B} + 1)", f"(n % {SSN_B})"
    spelled = f"concat(lpad(cast({area} + if({area} >= 666, 1, 0) as string), 3, '0'), '-', lpad(cast({rest} div 9999 + 1 as string), 2, '0'), '-', lpad(cast({rest} % 9999 + 1 as string), 4, '0'))"
    return valid, _let("n", _feistel_number(key, "ssn", SSN_A, SSN_B, number), spelled)


def _ip(key: str) -> tuple[str, str]:
    valid = "forall(split(m, '[.]'), o -> cast(o as int) < 256 and (o = '0' or not startswith(o, '0')))"
    number = "aggregate(split(m, '[.]'), 0L, (n, o) -> n * 256 + cast(o as bigint))"
    return valid, _let("n", _feistel_number(key, "ip", 65536, 65536, number), "concat_ws('.', n div 16777216, n div 65536 % 256, n div 256 % 256, n % 256)")


def _phone(key: str) -> tuple[str, str]:
    code = "regexp_extract(m, '^([+][0-9]{1,3}(?=[^0-9])|[+][0-9])', 1)"
    rest = f"substring(m, length({code}) + 1)"
    valid = f"length({_digits(rest)}) between 7 and 14"
    return valid, f"concat({code}, {_respace(_permute(key, 'phone', _digits(rest)), rest)})"


def _email(key: str) -> tuple[str, str]:
    local = "substring_index(m, '@', 1)"
    valid = f"{local} rlike '[0-9A-Za-z]' and not {local} rlike '^[.]|[.]$|[.][.]'"
    return valid, f"concat({_permute(key, 'email', local)}, '@', substring_index(m, '@', -1))"


def _kind() -> str:
    """The kind of a match, by its form alone; the pattern's alternatives can be told apart."""
    return (
        "case when contains(m, '@') then 'email' when m rlike '^[A-Z]' then 'iban' "
        "when m rlike '^[0-9]{4}-[0-9]{2}-[0-9]{2}$' or m rlike '^[0-9]{2}[./][0-9]{2}[./][0-9]{4}$' then 'date' "
        "when m rlike '^[0-9]{3}-[0-9]{2}-[0-9]{4}$' then 'ssn' "
        "when m rlike '^[+(]' or m rlike '^[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}$' then 'phone' "
        "when m rlike '^[0-9]{1,3}([.][0-9]{1,3}){3}$' then 'ip' else 'card' end"
    )


#: Tokens of a value of 46 characters, each of one character and a separator, at most
_TOKENS = 23


def _carved(card: tuple[str, str], iban: tuple[str, str]) -> str:
    """SQL of a struct (kinds, new) for a stretch w: from the left, the longest valid card or IBAN between separators.

    The stretch is read as tokens, each with the separator before it; a value is of at most 46 characters, so of at most
    23 tokens, and the work grows with the stretch alone.
    """
    valid = f"case when m rlike '^[A-Z]' then {iban[0]} else {card[0]} end"
    piece = f"if(m rlike '^[A-Z]', struct('iban' as kind, {iban[1]} as new), struct('card' as kind, {card[1]} as new))"
    one = _let("m", "regexp_replace(array_join(slice(ts, i, k), ''), '^[ -]', '')", f"if(length(m) between 13 and 46 and {valid}, struct(k as k, m as m), null)")
    found = f"try_element_at(filter(transform(sequence(least({_TOKENS}, size(ts) - i + 1), 1, -1), k -> {one}), c -> c is not null), 1)"
    made = _let("m", "c.m", piece)
    # a find: its first token, the token behind it, the separator before it, its kind and what replaces it
    with_it = f"struct(i + c.k as pos, concat(s.finds, array({_let('x', made, 'struct(i as a, i + c.k as z, regexp_extract(ts[i - 1], chr(94) || chr(91) || chr(32) || chr(45) || chr(93), 0) as sep, x.kind as kind, x.new as new)')})) as finds)"
    step = f"if(i < s.pos, s, {_let('c', found, f'if(c is null, s, {with_it})')})"
    start = "struct(1 as pos, cast(array() as array<struct<a: int, z: int, sep: string, kind: string, new: string>>) as finds)"
    between = lambda a, z: f"array_join(slice(ts, {a}, {z} - {a}), '')"
    spelled = f"array_join(transform(s.finds, (f, j) -> concat({between('if(j = 0, 1, s.finds[greatest(j - 1, 0)].z)', 'f.a')}, f.sep, f.new)), '')"
    rest = between("if(size(s.finds) = 0, 1, s.finds[greatest(size(s.finds) - 1, 0)].z)", "(size(ts) + 1)")
    ended = f"struct(transform(s.finds, f -> f.kind) as kinds, concat({spelled}, {rest}) as new)"
    return _let("ts", "regexp_extract_all(w, '[ -]?[0-9A-Z]+', 0)", f"aggregate(sequence(1, size(ts)), {start}, (s, i) -> {step}, s -> {ended})")


def _forms(key: str) -> dict[str, tuple[str, str]]:
    """SQL of each kind's validation and replacement of a match m."""
    if not key.isalnum():
        raise ValueError("the key must be letters and digits")
    return dict(zip(KINDS, (_email(key), _iban(key), _date(key), _ssn(key), _phone(key), _ip(key), _card(key)), strict=True))


def replacement(key: str) -> str:
    """SQL of a struct (kinds, new) for a match m: the kinds replaced in it; none, and new is m, where m fails its validation."""
    forms = _forms(key)
    cases = " ".join(f"when k = '{k}' and ({v}) then struct(array(k) as kinds, {new} as new)" for k, (v, new) in forms.items())
    carved = _let("w", "m", _carved(forms["card"], forms["iban"]))
    return _let("k", _kind(), f"case {cases} when k in ('card', 'iban') then {carved} else struct(cast(array() as array<string>) as kinds, m as new) end")


#: What is known of a match m: its kind k by its form, the kinds replaced in it, and what stands in its place
_MATCH = "m: string, k: string, kinds: array<string>, new: string"


def _steps(key: str) -> list[str]:
    """replacement(key) as SQL lambdas that are applied to a struct of _MATCH in turn: the kinds, then stretches of cards or IBANs.

    They are parsed one by one: what Spark's parser keeps in the driver, for as long as that lives, grows with the nesting
    of the largest expression (71 MB for all kinds in one).
    """
    forms, kept = _forms(key), "x.m as m, x.k as k"
    steps = [f"x -> if(x.k = '{k}', {_let('m', 'x.m', f'if({valid}, struct({kept}, array(x.k) as kinds, {new} as new), x)')}, x)" for k, (valid, new) in forms.items()]
    carved = _let("c", _let("w", "x.m", _carved(forms["card"], forms["iban"])), f"struct({kept}, c.kinds as kinds, c.new as new)")
    return [*steps, f"x -> if(x.k in ('card', 'iban') and size(x.kinds) = 0, {carved}, x)"]


def session_key(spark: SparkSession) -> str:
    """The pseudonym key, letters and digits: the session's spark.lorespark.pii.key; where that is unset, as in tests, TEST_KEY.

    It is part of the expressions, so it stands in query plans and event logs, which have to be kept as safe as it.
    """
    return spark.conf.get("spark.lorespark.pii.key", TEST_KEY)


def pseudonymise(docs: DataFrame, key: str = TEST_KEY, kinds: str | None = "pii") -> DataFrame:
    """docs with pseudonyms in `text` and, if it is named, a last column of the kinds found, in order; null where text is."""
    literal = PATTERN.replace("\\", "\\\\").replace("'", "\\'")
    d = numbered(docs, "text")
    found = F.expr(f"if(text rlike '[0-9@]', transform(regexp_extract_all(text, '{literal}', 0), m -> struct(m as m, {_kind()} as k, cast(array() as array<string>) as kinds, m as new)), cast(array() as array<struct<{_MATCH}>>))")
    parts = d.withColumn("_pii_found", found)
    for step in _steps(key):
        parts = parts.withColumn("_pii_found", F.expr(f"transform(_pii_found, {step})"))
    parts = parts.withColumn("_pii_parts", F.expr(f"if(size(_pii_found) > 0, split(text, '{literal}', -1), array(text))"))
    text = F.expr("if(size(_pii_found) > 0, array_join(flatten(transform(_pii_parts, (p, i) -> if(i < size(_pii_found), array(p, _pii_found[i].new), array(p)))), ''), text)")
    said = F.expr("if(text is null, null, flatten(transform(_pii_found, f -> f.kinds)))")
    out = [text.alias(c) if c == "text" else F.col(c) for c in d.columns]
    return parts.select(*out, *([said] if kinds else [])).toDF(*docs.columns, *([kinds] if kinds else []))


def scrub(docs: DataFrame, key: str = TEST_KEY) -> DataFrame:
    """doc_id, the text with pseudonyms and n_<kind>, the values replaced of each kind, for every document."""
    out = pseudonymise(pick(docs, "doc_id", "text"), key)
    count = lambda k: F.size(F.filter(F.coalesce("pii", F.array().cast("array<string>")), lambda x: x == k)).cast("long")
    return out.select("doc_id", "text", *[count(k).alias(f"n_{k}") for k in KINDS])
