"""Private data replaced by format-preserving Feistel pseudonyms, in DataFrame functions alone.

One pattern finds e-mail addresses, IPv4 and IPv6 addresses, card numbers, IBANs, social security numbers,
telephone numbers, dates and credentials. A finding counts only if it is valid as what it looks like
(Luhn's check for cards, modulus 97 for IBANs, ranges for addresses, dates and area numbers). What
is valid is permuted, keyed, within its own format, and what is only form doesn't count, so that a value that is
written in several ways gets one pseudonym, written in each of them:

* characters: an unbalanced Feistel network over the positions. Each has an alphabet (digits, lower
  or upper case letters, hexadecimal digits); in each round the positions of one half are shifted,
  modulo their alphabets' sizes, by a keyed hash of the other half. Every round can be undone, so equal values
  get equal pseudonyms in all documents and different values different ones.
* e-mail addresses: the local part, in lower case; capitals are put back where they were, the domain stays.
* IPv4 and IPv6 addresses: the same network over four numbers modulo 256, or eight modulo 65,536 (written in full).
* telephone numbers: the digits behind the country's calling code (calling codes are free of prefixes, so the code
  is known without a separator), whatever separates them; a trunk zero in brackets stays. Numbers without a code are
  the same digits without one.
* cards: all digits but the last are permuted and the last is Luhn's check digit again; IBANs keep
  their country and get new check digits. Spaces and hyphens are put back.
* dates: a network over the 73,049 = 319 x 229 days of 1900 to 2099 (days of a leap cycle fit no
  power), written in the format found: yyyy-MM-dd, dd.MM.yyyy, MM/dd/yyyy or, where that is no
  date, dd/MM/yyyy; each also with a day or month of one digit, then written without leading zeros.

A text is split at its findings and joined again around the pseudonyms, so whole texts of any
length are handled, and those without a digit, an at sign or a credential's word are left at once.

The key isn't part of the plan: what is derived from it is the value of a scalar subquery over a table of one row, so
neither explanations nor event logs show it.

Edge cases: null texts stay null; invalid findings stay as they are; a finding next to a letter or
digit is part of something else and stays; repeated rows get the same pseudonyms; an empty table gives
no row; all other columns, whatever their names, are kept.
"""

from __future__ import annotations

import hashlib
import hmac

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import free_name

ROUNDS = 8

#: Tried in this order at each place.
PATTERNS = {
    "email": r"[A-Za-z0-9](?:[A-Za-z0-9._%+\-]{0,63})@(?:[A-Za-z0-9](?:[A-Za-z0-9\-]{0,62})\.){1,8}[A-Za-z]{2,24}",
    "secret": r"AKIA[0-9A-Z]{16}(?![0-9A-Za-z])|gh[pousr]_[0-9A-Za-z]{36,255}(?![0-9A-Za-z])|github_pat_[0-9A-Za-z_]{22,255}(?![0-9A-Za-z])|glpat-[0-9A-Za-z_\-]{20,64}(?![0-9A-Za-z])|xox[abprs]-[0-9A-Za-z\-]{10,250}(?![0-9A-Za-z])|AIza[0-9A-Za-z_\-]{35}(?![0-9A-Za-z])|[sr]k_(?:live|test)_[0-9A-Za-z]{16,128}(?![0-9A-Za-z])|sk-[0-9A-Za-z_\-]{20,200}(?![0-9A-Za-z])|(?<=(?:token|secret|api_key|apikey) = \")[0-9A-Za-z]{16,128}(?=\")|(?<=(?:password|passwd|token|secret|api_key|apikey)=)[0-9A-Za-z]{8,128}",
    "ip6": r"(?<!:)(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])|(?<!:)(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6}(?![0-9A-Za-z:])",
    "iban": r"[A-Z]{2}[0-9]{2}[0-9A-Z]{11,30}(?![0-9A-Za-z])|[A-Z]{2}[0-9]{2}(?: [0-9A-Z]{4}){2,7}(?: [0-9A-Z]{1,3})?(?![0-9A-Za-z])",
    "ip": r"(?<![0-9]\.)(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])",
    "date": r"[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9-])|[0-9]{2}\.[0-9]{2}\.[0-9]{4}(?![0-9])|[0-9]{2}/[0-9]{2}/[0-9]{4}(?![0-9/])|[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}(?![0-9-])|(?<![0-9]\.)[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}(?![0-9]|\.[0-9])|(?<![0-9]/)[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}(?![0-9/])",
    "card": r"[0-9]{13,19}(?![0-9])|[0-9]{4}(?: [0-9]{4}){2} [0-9]{1,7}(?![0-9])|[0-9]{4}(?:-[0-9]{4}){2}-[0-9]{1,7}(?![0-9])|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}(?![0-9])",
    "ssn": r"(?<![0-9]-)[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": r"\+[0-9]{1,3}[ .-]?\([0-9]{1,4}\)[ .-]?[0-9]{3,4}[ .-][0-9]{3,4}(?![0-9])|\+[0-9]{1,3}[ .-]?\(0\)[ .-]?[0-9]{1,4}(?:[ .-][0-9]{2,4}){1,4}(?![0-9])|\+[0-9]{7,15}(?![0-9])|\+[0-9]{1,3}[ .-][0-9]{1,4}(?:[ .-][0-9]{2,4}){1,4}(?![0-9])|\+[0-9]{1,3}[ .-](?:[0-9]{2,4}[ .-])?[0-9]{5,12}(?![0-9])|\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,4}(?![0-9])|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}(?![0-9])|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![0-9.-])",
}
_ANY = "(?<![0-9A-Za-z])(?:" + "|".join(PATTERNS.values()) + ")"
_DIGITS, _LOWERS, _UPPERS, _HEX = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789abcdef"
_FIRST, _LAST, _A, _B = "1900-01-01", "2099-12-31", 319, 229


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _hash(key: str, *parts: str) -> str:
    """A keyed number of 48 bits, as a SQL expression; key is one, too."""
    return f"cast(conv(substr(sha2(concat_ws('|', {key}, {', '.join(parts)}), 256), 1, 12), 16, 10) as bigint)"


def derived(key: str) -> str:
    """What the networks are keyed by."""
    return hmac.new(key.encode(), b"pseudonyms", hashlib.sha256).hexdigest()


def _feistel(values: str, radices: str, key: str, kind: str) -> str:
    """A permutation of arrays of bigint whose i-th number is below the i-th radix.

    Even rounds shift the first half by the rest, odd ones the rest by the first half.
    """
    shift = f"pmod(x + {_hash(key, _quoted(kind), 'acc.n', 'r', 'i', 'acc.told')}, element_at(acc.radices, i + 1))"
    told = "array_join(if({r} % 2 = 0, slice({v}, {n} div 2 + 1, {n}), slice({v}, 1, {n} div 2)), ',')"
    moved = f"transform(acc.v, (x, i) -> if((i < acc.n div 2) = (r % 2 = 0), {shift}, x))"
    state = lambda v, radices, n, r: f"named_struct('v', {v}, 'radices', {radices}, 'n', {n}, 'told', {told.format(v=v, n=n, r=r)})"
    # The array moves on first, in a lambda of its own, so that no expression is written out twice.
    step = f"aggregate(array({moved}), acc, (old, w) -> {state('w', 'old.radices', 'old.n', '(r + 1)')})"
    start = f"aggregate(array(named_struct('v', {values}, 'radices', {radices})), {state('cast(array() as array<bigint>)', 'cast(array() as array<bigint>)', '0', '0')}, (none, a) -> {state('a.v', 'a.radices', 'cast(size(a.v) as int)', '0')})"
    return f"aggregate(sequence(0, {ROUNDS - 1}), {start}, (acc, r) -> {step}, acc -> acc.v)"


def _alphabet(c: str, hexadecimal: str) -> str:
    return f"case when {hexadecimal} and {c} rlike '^[0-9a-f]$' then '{_HEX}' when {c} rlike '^[0-9]$' then '{_DIGITS}' when {c} rlike '^[a-z]$' then '{_LOWERS}' when {c} rlike '^[A-Z]$' then '{_UPPERS}' else {c} end"


def _let(name: str, value: str, body: str) -> str:
    """value once, under a name in body, which may use it often."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _characters(value: str, key: str, kind: str, hexadecimal: str = "false") -> str:
    """Each letter or digit becomes one of its own alphabet; other characters, alone in theirs, stay."""
    alphabets = f"transform(filter(split({value}, ''), c -> c != ''), c -> named_struct('c', c, 'a', {_alphabet('c', hexadecimal)}))"
    numbers = _feistel("transform(al, t -> cast(locate(t.c, t.a) - 1 as bigint))", "transform(al, t -> cast(length(t.a) as bigint))", key, kind)
    return _let("al", alphabets, f"array_join(zip_with({numbers}, al, (v, t) -> substr(t.a, cast(v as int) + 1, 1)), '')")


def _luhn_sum(digits: str, odd: str) -> str:
    """Luhn's sum of a string of digits; every second one, beginning at ``odd`` from the right, doubles."""
    double = "cast(c as int) * 2 - if(cast(c as int) > 4, 9, 0)"
    return f"aggregate(transform(filter(split(reverse({digits}), ''), c -> c != ''), (c, i) -> if(i % 2 = {odd}, {double}, cast(c as int))), 0, (s, v) -> s + v)"


def _shaped(made: str, value: str) -> str:
    """The digits or capitals of made, with what else value has at its places."""
    return _let("q", made, f"array_join(transform(filter(split({value}, ''), c -> c != ''), (c, i) -> if(c rlike '[0-9A-Z]', substr(q, length(regexp_replace(substr({value}, 1, i + 1), '[^0-9A-Z]', '')), 1), c)), '')")


def _card(value: str, key: str) -> str:
    inner = _characters("substr(d, 1, length(d) - 1)", key, "card")
    full = _let("p", inner, f"concat(p, cast(pmod(-({_luhn_sum('p', '0')}), 10) as string))")
    return _let("d", f"regexp_replace({value}, '[ -]', '')", f"if(length(d) between 13 and 19 and {_luhn_sum('d', '1')} % 10 = 0, {_shaped(full, value)}, {value})")


def _mod97(text: str) -> str:
    """The remainder by 97 of letters and digits read as numbers (A is 10)."""
    ones = f"filter(split({text}, ''), c -> c != '')"
    value = "if(c rlike '[0-9]', cast(c as int), ascii(c) - 55)"
    return f"aggregate(transform({ones}, c -> {value}), 0, (r, v) -> (r * if(v > 9, 100, 10) + v) % 97)"


def _iban(value: str, key: str) -> str:
    inner = _characters("substr(d, 5)", key, "iban")
    made = _let("b", inner, f"concat(substr(d, 1, 2), lpad(cast(98 - {_mod97(f'concat(b, substr(d, 1, 2), {_quoted("00")})')} as string), 2, '0'), b)")
    return _let("d", f"replace({value}, ' ', '')", f"if({_mod97('concat(substr(d, 5), substr(d, 1, 4))')} = 1, {_shaped(made, value)}, {value})")


def _ip(value: str, key: str) -> str:
    octets = f"transform(split({value}, '[.]'), o -> cast(o as bigint))"
    return _let("o4", octets, f"if(forall(o4, o -> o < 256), array_join({_feistel('o4', 'transform(o4, o -> 256L)', key, 'ip')}, '.'), {value})")


def _date(value: str, key: str) -> str:
    """Slashes are read as MM/dd, and as dd/MM where that is no date; the pseudonym has the order found."""
    tried = lambda y, m, d: f"try_cast(concat_ws('-', dp[{y}], dp[{m}], dp[{d}]) as date)"
    days = f"case when {value} like '%-%' then array({tried(0, 1, 2)}) when {value} like '%.%' then array({tried(2, 1, 0)}) else array({tried(2, 0, 1)}, {tried(2, 1, 0)}) end"
    form = f"case when {value} like '%-%' then 'yyyy-MM-dd' when {value} like '%.%' then 'dd.MM.yyyy' when ds[0] is not null then 'MM/dd/yyyy' else 'dd/MM/yyyy' end"
    # A part of one digit: neither day nor month has leading zeros.
    form = f"if(exists(dp, x -> length(x) = 1), replace(replace({form}, 'MM', 'M'), 'dd', 'd'), {form})"
    made = _let("m", _feistel(f"array(dn div {_B}, dn % {_B})", f"array({_A}L, {_B}L)", key, "date"), f"date_format(date_add(date{_quoted(_FIRST)}, cast(m[0] * {_B} + m[1] as int)), {form})")
    moved = _let("dn", f"cast(datediff(coalesce(ds[0], get(ds, 1)), date'{_FIRST}') as bigint)", f"if(dn between 0 and {_A * _B - 1}, {made}, {value})")
    return _let("dp", f"split({value}, '[-./]')", _let("ds", days, moved))


def _ip6(value: str, key: str) -> str:
    """The groups that :: stands for are zeros."""
    halves = "split({0}, '::', -1)"
    groups = lambda h: f"filter(split({h}, ':'), g -> g != '')"
    full = _let("hs", halves.format(value), f"if(size(hs) = 1, {groups('hs[0]')}, concat({groups('hs[0]')}, array_repeat('0', 8 - size({groups('hs[0]')}) - size({groups('hs[1]')})), {groups('hs[1]')}))")
    numbers = _feistel("transform(g8, g -> cast(conv(g, 16, 10) as bigint))", "transform(g8, g -> 65536L)", key, "ip6")
    return _let("g8", full, f"if(size(g8) = 8 and {value} rlike '[0-9]', array_join(transform({numbers}, n -> lower(hex(n))), ':'), {value})")


def _email(value: str, key: str) -> str:
    local = f"substr({value}, 1, at - 1)"
    cased = _let("low", _characters(f"lower({local})", key, "email"), f"array_join(zip_with(filter(split(low, ''), c -> c != ''), filter(split({local}, ''), c -> c != ''), (n, o) -> if(o rlike '[A-Z]', upper(n), n)), '')")
    return _let("at", f"instr({value}, '@')", f"concat({cased}, substr({value}, at))")


def _ssn(value: str, key: str) -> str:
    valid = f"substr({value}, 1, 3) not in ('000', '666') and substr({value}, 1, 1) != '9' and substr({value}, 5, 2) != '00' and substr({value}, 8) != '0000'"
    return f"if({valid}, {_characters(value, key, 'ssn')}, {value})"


#: Calling codes of one and two digits; all others have three.
_CODES = "1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]"


def _phone(value: str, key: str) -> str:
    """Digits behind the calling code are permuted; seven to fifteen in all are a telephone number."""
    plain = f"replace({value}, '(0)', '(\u0001)')"
    code = f"if({value} like '+%', coalesce(nullif(regexp_extract(pd, '^({_CODES})', 1), ''), substr(pd, 1, 3)), '')"
    made = f"concat(cc, {_characters('substr(pd, length(cc) + 1)', key, 'phone')})"
    shaped = _let("pv", plain, f"replace({_shaped('pn', 'pv')}, '(\u0001)', '(0)')")
    body = _let("cc", code, _let("pn", made, shaped))
    return _let("pd", f"regexp_replace(replace({value}, '(0)', ''), '[^0-9]', '')", f"if(length(pd) between 7 and 15, {body}, {value})")


def _secret(value: str, key: str) -> str:
    """A known kind's first letters stay."""
    head = f"regexp_extract({value}, '^(AKIA(?=.{{16}}$)|gh[pousr]_|github_pat_|glpat-|xox[abprs]-|AIza|[sr]k_(?:live|test)_|sk-)?', 0)"
    body = f"substr({value}, length(sh) + 1)"
    return _let("sh", head, f"concat(sh, {_characters(body, key, 'secret', f'not {body} rlike {_quoted("[^0-9a-f]")}')})")


def _pseudonym(value: str, key: str) -> str:
    """The pseudonym of one finding, or the finding where it isn't valid."""
    whole = lambda kind: f"{value} rlike {_quoted('^(?:' + _SHAPES[kind] + ')$')}"
    made = {"email": _email, "iban": _iban, "ip": _ip, "ip6": _ip6, "date": _date, "ssn": _ssn, "phone": _phone, "card": _card}
    cases = " ".join(f"when {whole(kind)} then {made[kind](value, key)}" for kind in _SHAPES)
    return f"case {cases} else {_secret(value, key)} end"


#: What a finding is, told from itself alone; what fits none is a credential.
_SHAPES = {
    "email": ".*@.*",
    "ip": "(?:[0-9]{1,3}[.]){3}[0-9]{1,3}",
    "ip6": "[0-9A-Fa-f:]*:[0-9A-Fa-f:]*",
    "date": "[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}|[0-9]{1,2}[.][0-9]{1,2}[.][0-9]{4}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}",
    "ssn": "[0-9]{3}-[0-9]{2}-[0-9]{4}",
    "card": "[0-9](?:[ -]?[0-9]){12,18}",
    "phone": "[+(].*|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}",
    "iban": "[A-Z]{2}[0-9]{2}[0-9A-Z ]{11,37}",
}


def pseudonymize(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """docs, with all their columns, and the private data of text_col replaced."""
    text, any_, own = f"`{text_col}`", _quoted(_ANY), free_name(docs, "own_key")
    made = f"transform(regexp_extract_all({text}, {any_}, 0), v -> {_pseudonym('v', f'`{own}`')})"
    joined = f"array_join(zip_with(split({text}, {any_}, -1), {made}, (s, v) -> concat(s, coalesce(v, ''))), '')"
    one = docs.sparkSession.createDataFrame(pa.table({"own_key": [derived(key)]}))  # rows instead of Arrow would start Python workers, which stay
    keyed = docs.withColumn(own, one.scalar())
    told = F.expr(f"if({text} rlike '[0-9@]|::|(?i:password|passwd|token|secret|api_?key|sk-|xox|gh[pousr]_)', {joined}, {text})")
    return keyed.withColumn(text_col, told).drop(own)
