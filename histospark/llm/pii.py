"""Format-preserving pseudonyms for personal numbers and dates, in SQL functions only.

A value is found by one pattern, of which every text is searched, told apart by its form, and validated: check digits of cards (Luhn) and
IBANs (mod 97), ranges of addresses, social security numbers and dates, digit counts of telephone numbers. A valid one becomes a vector of small
integers, each with its own modulus: digits mod 10, letters mod 26, octets mod 256, groups of long addresses mod 65536, the three fields of a
social security number, the day count of a date as two factors. A keyed Feistel network permutes the vectors of a format among themselves: in odd rounds each
element of the left half moves by a keyed hash of the right half, in even rounds the other way round. Check digits are
then worked out anew and the value written as it was written before. So each pseudonym is a valid value of the same
format, different values stay different, and equal values are equal in all documents, whichever separators they have. IPv6 addresses are written
out in eight groups, so that all ways of writing one stay linked. A telephone number with its country code and one without are two values, but for
those of ten digits in groups of three, three and four.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROUNDS = 8
#: Days from 1900-01-01 to 2099-12-31 are 319 * 229.
FIRST_DAY, DAY_FACTORS = "1900-01-01", (319, 229)

#: Lengths of IBANs by country. Of these countries the length says where an IBAN ends and the next word begins.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL SD FK", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


def _iban_form() -> str:
    """An IBAN of its country's length; else whatever looks like one."""
    of = lambda n: f"(?: ?[A-Z0-9]{{4}}){{{n // 4 - 1}}}" + (f" ?[A-Z0-9]{{{n % 4}}}" if n % 4 else "")
    known = "|".join(f"(?:{c.replace(' ', '|')})[0-9]{{2}}{of(n)}(?![\\p{{L}}\\p{{N}}])" for n, c in IBAN_LENGTHS.items())
    return r"(?<![\p{L}\p{N}])(?=[A-Z]{2}[0-9]{2})(?:" + known + r"|[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}]))"


#: Telephone country codes of one and of two digits; all others have three.
SHORT_CODES = "1 7", "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98"

#: Fixed forms of what is looked for.
FORMS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+",
    "hex": r"(?<![\p{L}\p{N}])[0-9a-f]{32,64}(?![\p{L}\p{N}])",
    "iban": _iban_form() + r"|(?<![\p{L}\p{N}])[a-z]{2}[0-9]{2}[a-z0-9]{11,30}(?![\p{L}\p{N}])",
    "ip6": r"(?<![\p{L}\p{N}:.])(?=[0-9A-Fa-f:]*[0-9])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|[0-9A-Fa-f]{3,4}(?::[0-9A-Fa-f]{1,4}){0,5}::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,4})?)(?![\p{L}\p{N}:])",
    "ymd": r"(?<![0-9])(?:19|20)[0-9]{2}([-/.])[01][0-9]\{n}[0-3][0-9](?![0-9])",
    "dmy": r"(?<![0-9])[0-3][0-9]([-/.])[01][0-9]\{n}(?:19|20)[0-9]{2}(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "ip": r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])",
    "phone": r"(?<![\p{N}+])(?:\+?[0-9]{1,3}[ .-])?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])",
    "abroad": r"(?<![\p{L}\p{N}+])\+[1-9](?:[ ./()-]{0,2}[0-9]){7,14}(?![0-9])",
    "trunk": r"(?<![\p{L}\p{N}+./-])0[1-9][0-9]{1,4}(?:/|[ ][/-]?[ ]?|-)[0-9]{5,9}(?![0-9]|[./-][0-9])",
    "card": r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9])",
}


def _form(kind: str, group: int = 1) -> str:
    return FORMS[kind].replace("{n}", str(group))


#: ymd and dmy each have one group, which the second sees as group 2.
#: A form begins with a digit, + or (, or it doesn't follow a letter; saying so once keeps the places within words cheap.
PATTERN = r"(?:(?<!\p{L})|(?=[0-9+(]))(?:" + "|".join(_form(k, 2 if k == "dmy" else 1) for k in FORMS) + ")"


def _text(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _let(value: str, name: str, body: str) -> str:
    return f"transform(array({value}), {name} -> {body})[0]"


KEY_MARK = "pseudonym-key:"


def _key_literal(key: str) -> str:
    """The key as it stands in the plan: in hexadecimal behind a mark, by which ``hide_key`` knows it."""
    return KEY_MARK + key.encode().hex()


def hide_key(spark: SparkSession) -> None:
    """Have Spark redact keys where it prints plans, unless the session has a pattern of its own for that."""
    name = "spark.sql.redaction.string.regex"
    if not spark.conf.get(name, None):
        spark.conf.set(name, KEY_MARK + "[0-9a-f]*")


def _feistel(kind: str, key: str, vals: str, mods: str) -> str:
    """SQL for the permuted vector of ``vals``, an array of int with moduli ``mods``; a vector of one element has an empty half
    and moves by a constant."""
    half = "(size(fa) div 2)"
    other = f"if(fr % 2 = 1, slice(fa, {half} + 1, size(fa)), slice(fa, 1, {half}))"
    moved = f"cast(conv(substr(sha2(concat_ws('|', '{_key_literal(key)}', '{kind}', fr, fj, array_join(transform({other}, fx -> cast(fx as string)), ',')), 256), 1, 12), 16, 10) as bigint)"
    step = f"transform(fa, (fv, fj) -> if((fj < {half}) = (fr % 2 = 1), cast(pmod(fv + {moved}, element_at(fm, cast(fj as int) + 1)) as int), fv))"
    return _let(mods, "fm", f"aggregate(sequence(1, {ROUNDS}), {vals}, (fa, fr) -> {step})")


def _digits(m: str) -> str:
    return f"transform(split(regexp_replace({m}, '[^0-9]', ''), ''), dc -> cast(dc as int))"


def _refill(m: str, digits: str) -> str:
    """``m`` with its digits, in order, replaced by those of the array."""
    took = "named_struct('s', concat(ra.s, if(rc between '0' and '9', cast(element_at(rd, ra.i) as string), rc)), 'i', if(rc between '0' and '9', ra.i + 1, ra.i))"
    return _let(digits, "rd", f"aggregate(split({m}, ''), named_struct('s', '', 'i', 1), (ra, rc) -> {took}, ra -> ra.s)")


def _classes(body: str, kind: str, key: str, hexadecimal: bool = False) -> str:
    """``body`` with ASCII letters and digits permuted, each within its class; other characters stay."""
    if hexadecimal:
        val, mod = "cast(conv(cc, 16, 10) as int)", "16"
        back = "lower(conv(cast(cv as string), 10, 16))"
    else:
        val = "case when cc between '0' and '9' then ascii(cc) - 48 when cc between 'a' and 'z' then ascii(cc) - 97 when cc between 'A' and 'Z' then ascii(cc) - 65 else 0 end"
        mod = "case when cc between '0' and '9' then 10 when cc between 'a' and 'z' or cc between 'A' and 'Z' then 26 else 1 end"
        back = "case when cc between '0' and '9' then char(48 + cv) when cc between 'a' and 'z' then char(97 + cv) when cc between 'A' and 'Z' then char(65 + cv) else cc end"
    moved = _feistel(kind, key, f"transform(ch, cc -> {val})", f"transform(ch, cc -> {mod})")
    return _let(f"split({body}, '')", "ch", f"array_join(zip_with(ch, {moved}, (cc, cv) -> {back}), '')")


def _luhn(digits: str) -> str:
    """The Luhn sum of an array of digits, of which the last is the check digit."""
    one = "element_at(ld, li) * if((size(ld) - li) % 2 = 1, 2, 1)"
    return _let(digits, "ld", f"aggregate(sequence(1, size(ld)), 0, (ls, li) -> ls + if({one} > 9, {one} - 9, {one}))")


def _mod97(compact: str) -> str:
    """Of an IBAN's letters and digits, already in the order of the check."""
    digit = "if(mc between '0' and '9', ascii(mc) - 48, ascii(mc) - 55)"
    return f"aggregate(split(upper({compact}), ''), 0, (ms, mc) -> (ms * if(mc between '0' and '9', 10, 100) + {digit}) % 97)"


def _card(key: str) -> str:
    moved = _feistel("card", key, "slice(cd, 2, size(cd) - 2)", "transform(slice(cd, 2, size(cd) - 2), zx -> 10)")
    payload = f"concat(array(cd[0]), {moved})"
    checked = _let(payload, "cp", f"concat(cp, array(pmod(10 - {_luhn('concat(cp, array(0))')} % 10, 10)))")
    return _let(_digits("m"), "cd", f"if({_luhn('cd')} % 10 = 0, {_refill('m', checked)}, m)")


def _iban(key: str) -> str:
    body = _classes("substr(ib, 5)", "iban", key)
    made = _let(body, "ibn", f"concat(substr(ib, 1, 2), lpad(cast(98 - {_mod97("concat(ibn, substr(ib, 1, 2), '00')")} as string), 2, '0'), ibn)")
    took = "named_struct('s', concat(ja.s, if(jc = ' ', ' ', substr(jn, ja.i, 1))), 'i', if(jc = ' ', ja.i, ja.i + 1))"
    spaced = _let(made, "jn", f"aggregate(split(m, ''), named_struct('s', '', 'i', 1), (ja, jc) -> {took}, ja -> ja.s)")
    return _let("replace(m, ' ', '')", "ib", f"if({_mod97('concat(substr(ib, 5), substr(ib, 1, 4))')} = 1, {spaced}, m)")


def _ssn(key: str) -> str:
    fields = "transform(split(m, '-'), sx -> cast(sx as int))"
    vals = "array(if(sf[0] > 666, sf[0] - 2, sf[0] - 1), sf[1] - 1, sf[2] - 1)"
    moved = _feistel("ssn", key, vals, "array(898, 99, 9999)")
    area = "lpad(cast(if(sn[0] + 1 >= 666, sn[0] + 2, sn[0] + 1) as string), 3, '0')"
    made = f"concat_ws('-', {area}, lpad(cast(sn[1] + 1 as string), 2, '0'), lpad(cast(sn[2] + 1 as string), 4, '0'))"
    valid = "sf[0] between 1 and 899 and sf[0] != 666 and sf[1] > 0 and sf[2] > 0"
    return _let(fields, "sf", f"if({valid}, {_let(moved, 'sn', made)}, m)")


def _ip(key: str) -> str:
    moved = _feistel("ip", key, "pf", "array(256, 256, 256, 256)")
    made = f"array_join(transform({moved}, px -> cast(px as string)), '.')"
    return _let("transform(split(m, '[.]'), px -> cast(px as int))", "pf", f"if(forall(pf, px -> px < 256), {made}, m)")


def _ip6(key: str) -> str:
    """All eight groups move; the pseudonym has them all, in capital letters if the value had some."""
    groups = "if(size(qh) = 2, concat(filter(split(qh[0], ':'), qg -> qg != ''), array_repeat('0', 8 - size(filter(split(m, ':'), qg -> qg != ''))), filter(split(qh[1], ':'), qg -> qg != '')), split(m, ':'))"
    moved = _feistel("ip6", key, "transform(qf, qg -> cast(conv(qg, 16, 10) as int))", "array_repeat(65536, 8)")
    made = f"array_join(transform({moved}, qv -> if(m rlike '[A-F]', conv(cast(qv as string), 10, 16), lower(conv(cast(qv as string), 10, 16)))), ':')"
    return _let("split(m, '::', -1)", "qh", _let(groups, "qf", f"if(size(qf) = 8, {made}, m)"))


def _code_length(digits: str) -> str:
    """How many digits of a number written with its country code are that code."""
    one, two = (", ".join(codes.split()) for codes in SHORT_CODES)
    return f"case when {digits}[0] in ({one}) then 1 when {digits}[0] * 10 + {digits}[1] in ({two}) then 2 else 3 end"


def _abroad(key: str) -> str:
    """The digits after the country code move; those of ten digits as they do without the code."""
    own = "slice(ad, an + 1, size(ad) - an)"
    like = f"if(size(ad) - an = 10, {_feistel('phone', key, own, 'array_repeat(10, 10)')}, {_feistel('abroad', key, own, 'array_repeat(10, size(ad) - an)')})"
    made = _refill("m", f"concat(slice(ad, 1, an), {like})")
    return _let(_digits("m"), "ad", f"if(size(ad) between 8 and 15, {_let(_code_length('ad'), 'an', made)}, m)")


def _trunk(key: str) -> str:
    """The digits after the first zero move."""
    own = "slice(td, 2, size(td) - 1)"
    made = _refill("m", f"concat(array(0), {_feistel('trunk', key, own, 'array_repeat(10, size(td) - 1)')})")
    return _let(_digits("m"), "td", f"if(size(td) between 9 and 13, {made}, m)")


def _phone(key: str) -> str:
    """The last ten digits move; a country code stays."""
    own = "slice(pd, size(pd) - 9, 10)"
    moved = _feistel("phone", key, own, "array_repeat(10, 10)")
    return _let(_digits("m"), "pd", _refill("m", f"concat(slice(pd, 1, size(pd) - 10), {moved})"))


def _date(key: str, year_first: bool) -> str:
    at = (1, 6, 9) if year_first else (7, 4, 1)
    iso = f"concat_ws('-', substr(m, {at[0]}, 4), substr(m, {at[1]}, 2), substr(m, {at[2]}, 2))"
    a, b = DAY_FACTORS
    moved = _feistel("date", key, f"array(dd div {b}, dd % {b})", f"array({a}, {b})")
    day = _let(moved, "dn", f"date_add(date'{FIRST_DAY}', cast(dn[0] * {b} + dn[1] as int))")
    sep = f"substr(m, {5 if year_first else 3}, 1)"
    order = "'yyyy', 'MM', 'dd'" if year_first else "'dd', 'MM', 'yyyy'"
    made = _let(day, "dt", f"array_join(transform(array({order}), df -> lpad(cast(case df when 'yyyy' then year(dt) when 'MM' then month(dt) else day(dt) end as string), length(df), '0')), {sep})")
    number = f"datediff(try_to_timestamp({iso}, 'yyyy-MM-dd'), date'{FIRST_DAY}')"
    return _let(f"cast({number} as int)", "dd", f"if(dd is not null, {made}, m)")


def pseudonym_sql(key: str) -> str:
    """SQL for what stands in the place of the match ``m``: its pseudonym, or itself where it isn't valid."""
    is_a = lambda kind: f"m rlike {_text('^(?:' + _form(kind) + ')$')}"
    email = f"concat({_classes('substring_index(m, ' + _text('@') + ', 1)', 'email', key)}, '@', substring_index(m, '@', -1))"
    cases = [
        ("email", email), ("hex", _classes("m", "hex", key, hexadecimal=True)), ("ymd", _date(key, True)), ("dmy", _date(key, False)),
        ("ssn", _ssn(key)), ("ip", _ip(key)), ("ip6", _ip6(key)), ("card", _card(key)), ("phone", _phone(key)), ("abroad", _abroad(key)), ("trunk", _trunk(key)), ("iban", _iban(key)),
    ]
    return "case " + " ".join(f"when {is_a(k)} then {sql}" for k, sql in cases) + " else m end"


def pseudonymised(text: str, key: str) -> tuple[Column, Column]:
    """For the column named ``text``: the text with pseudonyms, and the array of the values that were replaced."""
    found = f"regexp_extract_all({text}, {_text(PATTERN)}, 0)"
    parts = f"split({text}, {_text(PATTERN)}, -1)"
    made = f"transform({found}, m -> {pseudonym_sql(key)})"
    joined = _let(parts, "tp", f"concat(tp[0], array_join(zip_with({made}, slice(tp, 2, size(tp)), (n, p) -> concat(n, p)), ''))")
    return F.expr(f"if({text} rlike {_text(PATTERN)}, {joined}, {text})"), F.expr(found)


def pseudonymise(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with its texts pseudonymised under ``key``; all columns stay, in their order.

    A null text stays null, an empty one empty, and so does an empty table. Values that don't pass validation stay as they are. Rows that repeat an
    id are rows like any other. Every text is searched whole; a very long one is one row's work. No shuffle.
    """
    hide_key(docs.sparkSession)
    name = f"`{text_col}`"
    made, _ = pseudonymised(name, key)
    return docs.withColumn(text_col, made)


def pii_report(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, text (pseudonymised), n_found (values of a known form), n_replaced (those that validated) per document.

    Null texts stay null, with 0 found. Rows that repeat an id are rows like any other. An empty table gives an empty result, and every text is
    searched whole, however long. Other columns are not read.
    """
    hide_key(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    found = f"regexp_extract_all(_text, {_text(PATTERN)}, 0)"
    some = rows.withColumn("_found", F.expr(found))
    made = some.withColumn("_made", F.expr(f"transform(_found, m -> {pseudonym_sql(key)})"))
    parts = _let(f"split(_text, {_text(PATTERN)}, -1)", "tp", "concat(tp[0], array_join(zip_with(_made, slice(tp, 2, size(tp)), (n, p) -> concat(n, p)), ''))")
    changed = "size(filter(arrays_zip(_found, _made), z -> z._found != z._made))"
    return made.select(
        F.col("_id").alias(id_col),
        F.expr(f"if(size(_found) > 0, {parts}, _text)").alias("text"),
        F.expr("cast(greatest(size(_found), 0) as long)").alias("n_found"),
        F.expr(f"cast(greatest(coalesce({changed}, 0), 0) as long)").alias("n_replaced"),
    )
