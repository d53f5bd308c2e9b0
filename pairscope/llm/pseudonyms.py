"""Operator 8, PII: format-preserving Feistel pseudonyms. DataFrame functions only; one projection, nothing is shuffled.

Personal numbers and dates are found, validated, and permuted by a keyed Feistel network inside the set of valid values of
their own format, so equal values get equal pseudonyms in all documents and different ones of a format different ones:

=======  ======================================  =========================================================
kind     valid                                   permuted set
=======  ======================================  =========================================================
card     13 to 19 digits, Luhn sum 0             all but the last digit, which is computed anew
phone    with area code or country code (+, 00)  the last 10 digits (7 after a country code other than 1)
iban     letters and digits, sum 1 modulo 97     its last digits (18 at most); the check digits are computed anew
ssn      3-2-4 digits, no part that is not given all valid numbers
ip       four octets up to 255                   all addresses
date     Y-m-d, Y/m/d, d.m.Y, m/d/Y (d/m/Y if    the days of 1900 to 2099 that are written with as many
         that alone exists), 1900 to 2099        digits for day and month
email    by its form                             letters and digits of the local part become a keyed digest
=======  ======================================  =========================================================

Signs between digits stay as they are. An e-mail address is no number: its pseudonym is one-way. A d/m/Y date is permuted
by its day like the others, so its pseudonym may also be read as m/d/Y.

Defined cases: a null text stays null (no values); text without values comes back unchanged; an invalid number (wrong Luhn
sum, octet 256, 30 February) stays; repeated rows are answered each; a null doc_id is kept; an empty table gives an empty
result; ``pseudonymize`` keeps other columns under any name (one named like ``found`` gives way to it); a very long text is
searched whole, in its row. The key is the caller's secret: who has it can undo the permutations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairscope.llm.store import documents, numbered

ROUNDS = 10
DAYS = 73049  # of 1900 to 2099, 17 * 4297
TEST_KEY = "not a secret: for tests and checks"

# fixed values: the forms of values
EMAIL = r"(?<![0-9A-Za-z._%+-])[0-9A-Za-z._%+-]{1,64}@(?:[0-9A-Za-z-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![0-9A-Za-z-])"
OCTETS = r"(?<![0-9A-Za-z.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9A-Za-z]|\.[0-9])"
DATE = r"(?<![0-9A-Za-z./-])(?:(?:19|20)[0-9]{2}-[01][0-9]-[0-3][0-9]|(?:19|20)[0-9]{2}/[01][0-9]/[0-3][0-9]|[0-3]?[0-9]\.[01]?[0-9]\.(?:19|20)[0-9]{2}|[0-3]?[0-9]/[0-3]?[0-9]/(?:19|20)[0-9]{2})(?![0-9A-Za-z/-]|\.[0-9])"
SSN = r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])"
CARD = r"(?<![0-9A-Za-z.-])(?:[0-9]{13,19}|[0-9]{4}(?: [0-9]{4}){2} [0-9]{1,7}|[0-9]{4}(?:-[0-9]{4}){2}-[0-9]{1,7}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9A-Za-z-])"
PHONE = r"(?:(?<![0-9A-Za-z+])\+1[ .-]?|(?<![0-9A-Za-z+.-]))(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-]?[0-9]{4}(?![0-9A-Za-z-])|(?<![0-9A-Za-z+])\+[0-9]{9,15}(?![0-9A-Za-z-])"
# after a country code: 8 to 15 digits in groups of any size; a lone digit ends a number only after "-", and a number with a decimal point is none
ABROAD = r"(?<![0-9A-Za-z+])\+(?=[2-9][0-9]{0,2}(?:[ -]|[ .-]?\(|\.[0-9]{1,5}[.-][0-9(]|\.[0-9]{2,5} [0-9(]))[2-9](?:[ .-]?\(?[0-9]\)?){7,14}(?<![ .][0-9])(?![0-9A-Za-z-])"
PHONE = f"{PHONE}|{ABROAD}"
MAYBE = r"[0-9]{4}|[0-9]\.[0-9]|@|\+[0-9]"  # in every text with a match of ANY: each form has one of these
AWAY = r"(?<![0-9A-Za-z+.-])00(?=[2-9][0-9]{0,2}[ -])[2-9](?:[ .-]?\(?[0-9]\)?){7,14}(?<![ .][0-9])(?![0-9A-Za-z-])"
PHONE = f"{PHONE}|{AWAY}"
STATES = "AD|AE|AL|AT|AZ|BA|BE|BG|BH|BR|CH|CR|CY|CZ|DE|DK|DO|EE|ES|FI|FO|FR|GB|GE|GI|GL|GR|GT|HR|HU|IE|IL|IS|IT|JO|KW|KZ|LB|LI|LT|LU|LV|MC|MD|ME|MK|MR|MT|MU|NL|NO|PK|PL|PT|QA|RO|RS|SA|SE|SI|SK|SM|TN|TR|UA|VG|XK"
IBAN = rf"(?<![0-9A-Za-z])(?:{STATES})[0-9]{{2}}(?:[0-9A-Z]{{11,30}}|(?: [0-9A-Z]{{4}}){{2,7}}(?: [0-9A-Z]{{1,3}})?)(?![0-9A-Za-z])"
FORMS = [("iban", IBAN), ("email", EMAIL), ("ip", OCTETS), ("date", DATE), ("ssn", SSN), ("card", CARD), ("phone", PHONE)]
ANY = "|".join(p for _, p in FORMS)


def _digest(key: str, kind: str, place: Column, value: Column) -> Column:
    """48 bits of a keyed digest, as a number."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), place.cast("string"), value.cast("string")), 256), 1, 12), 16, 10).cast("long")


def permuted(x: Column, a: int | Column, b: int | Column, key: str, kind: str) -> Column:
    """A keyed permutation of 0 .. a * b - 1: halves modulo a and b, each in turn moved on by a digest of the other."""
    a, b = (F.lit(v).cast("long") if isinstance(v, int) else v for v in (a, b))
    start = F.struct(F.expr("0L").alias("l"), F.expr("0L").alias("r")).withField("l", F.floor(x / b).cast("long")).withField("r", F.pmod(x, b))

    def turn(s: Column, i: Column) -> Column:
        left = F.pmod(s["l"] + _digest(key, kind, i, s["r"]), a)
        right = F.pmod(s["r"] + _digest(key, kind, i, s["l"]), b)
        return F.struct(F.when(i % 2 == 0, left).otherwise(s["l"]).alias("l"), F.when(i % 2 == 0, s["r"]).otherwise(right).alias("r"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn, lambda s: s["l"] * b + s["r"])


def _let(value: Column, use) -> Column:
    """``use`` of a value that is computed once, wherever it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _luhn(digits: Column, double_first: bool) -> Column:
    """Luhn sum of the digits from the last one on; double_first: the last is already doubled."""
    even = lambda i: (i % 2 == 0) != F.lit(double_first)
    each = lambda s, d, i: s + F.when(even(i), _doubled(d)).otherwise(d)
    return _let(F.reverse(digits), lambda r: F.aggregate(F.sequence(F.lit(1), F.length(r)), F.lit(0), lambda s, i: each(s, F.substring(r, i, F.lit(1)).cast("int"), i)))


def _doubled(d: Column) -> Column:
    return d * 2 - F.when(d > 4, 9).otherwise(0)


def _filled(form: Column, digits: Column) -> Column:
    """``form`` with its digits replaced in order."""
    sign = lambda i: F.substring(form, i, F.lit(1))
    put = lambda d, i: F.substring(d, F.length(_digits(F.substring(form, F.lit(1), i))), F.lit(1))
    places = F.sequence(F.lit(1), F.length(form))
    return _let(digits, lambda d: F.array_join(F.transform(places, lambda i: F.when(sign(i).rlike("[0-9]"), put(d, i)).otherwise(sign(i))), ""))


def _ten(n: Column) -> Column:
    return F.pow(F.lit(10), n).cast("long")


def _padded(x: Column, n: Column) -> Column:
    return F.lpad(x.cast("string"), n, F.lit("0"))


def _long_number(digits: Column, key: str, kind: str) -> Column:
    """Digits of any number (up to 18) permuted among those of the same number of digits."""
    n = F.length(digits)
    low = F.floor((n + 1) / 2).cast("int")
    return _padded(permuted(digits.cast("long"), _ten(n - low), _ten(low), key, kind), n)


def _card(s: Column, key: str) -> Column:
    digits = _digits(s)
    body = _long_number(F.substring(digits, F.lit(1), F.length(digits) - 1), key, "card")
    whole = _let(body, lambda b: F.concat(b, F.pmod(10 - _luhn(b, True) % 10, F.lit(10)).cast("string")))
    return F.when(_luhn(digits, False) % 10 == 0, _filled(s, whole))


def _phone(s: Column, key: str) -> Column:
    digits = _digits(s)
    home = ~(s.startswith("+") | s.startswith("00")) | s.startswith("+1")
    n = F.when(home, F.least(F.lit(10), F.length(digits))).otherwise(7)
    tail = _long_number(F.right(digits, n), key, "phone")
    return F.when((F.length(digits) - F.when(s.startswith("00"), 2).otherwise(0)).between(8, 15), _filled(s, F.concat(F.left(digits, F.length(digits) - n), tail)))


def _ssn(s: Column, key: str) -> Column:
    area, group, serial = (F.substring(s, a, n).cast("long") for a, n in ((1, 3), (5, 2), (8, 4)))
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    x = ((area - F.when(area > 666, 2).otherwise(1)) * 99 + group - 1) * 9999 + serial - 1

    def shown(y: Column) -> Column:
        area, rest = F.floor(y / (99 * 9999)), y % (99 * 9999)
        area = area + F.when(area >= 665, 2).otherwise(1)
        return F.concat_ws("-", _padded(area, F.lit(3)), _padded(F.floor(rest / 9999) + 1, F.lit(2)), _padded(rest % 9999 + 1, F.lit(4)))

    return F.when(valid, _let(permuted(x, 898, 99 * 9999, key, "ssn"), shown))


def _ip(s: Column, key: str) -> Column:
    part = lambda k: F.split_part(s, F.lit("."), F.lit(k)).cast("long")
    valid = (part(1) < 256) & (part(2) < 256) & (part(3) < 256) & (part(4) < 256)
    x = ((part(1) * 256 + part(2)) * 256 + part(3)) * 256 + part(4)
    shown = lambda y: F.concat_ws(".", *((F.shiftright(y, k) % 256).cast("string") for k in (24, 16, 8, 0)))
    return F.when(valid, _let(permuted(x, 65536, 65536, key, "ip"), shown))


SHORT = 54649  # days of January to September in 1900 to 2099, 211 * 259


def _year_start(year: Column) -> Column:
    """Days of January to September before a year."""
    return F.datediff(F.make_date(year, F.lit(1), F.lit(1)), F.lit("1900-01-01").cast("date")) - 92 * (year - 1900)


def _date(s: Column, key: str) -> Column:
    """A day among those that are written alike: with one digit, days (months) are 1 to 9; with two, all of them."""
    as_date = lambda form: F.try_to_timestamp(s, F.lit(form)).cast("date")
    iso, dotted = s.rlike("^[0-9]{4}"), s.contains(".")
    slashed = as_date("M/d/yyyy")
    day_first = dotted | slashed.isNull()
    date = F.when(s.rlike("^[0-9]{4}-"), as_date("yyyy-MM-dd")).when(iso, as_date("yyyy/MM/dd")).when(dotted, as_date("d.M.yyyy")).otherwise(F.coalesce(slashed, as_date("d/M/yyyy")))
    one, two = (F.length(F.split_part(F.translate(s, ".", "/"), F.lit("/"), F.lit(k))) for k in (1, 2))
    short_day, short_month = (~iso & (F.when(day_first, x).otherwise(y) == 1) for x, y in ((one, two), (two, one)))

    def moved(d: Column) -> Column:
        year, month, day = F.year(d), F.month(d), F.day(d)
        days = F.datediff(d, F.lit("1900-01-01").cast("date"))
        months = F.when(short_month, 9).otherwise(12)
        place = F.when(short_day, ((year - 1900) * months + month - 1) * 9 + day - 1).when(short_month, days - 92 * (year - 1900)).otherwise(days).cast("long")
        a = F.when(short_day, 200).when(short_month, 211).otherwise(17).cast("long")
        b = F.when(short_day, months * 9).when(short_month, SHORT // 211).otherwise(DAYS // 17).cast("long")
        near = lambda y: (1900 + F.floor(y / 273.25)).cast("int")
        own = lambda y: near(y) - F.when(y < _year_start(near(y)), 1).otherwise(0) + F.when(y >= _year_start(near(y) + 1), 1).otherwise(0)
        in_short_days = lambda y: F.make_date((1900 + F.floor(y / (9 * months))).cast("int"), (F.floor(y / 9) % months + 1).cast("int"), (y % 9 + 1).cast("int"))
        in_short_months = lambda y: F.date_add(F.make_date(own(y), F.lit(1), F.lit(1)), (y - _year_start(own(y))).cast("int"))
        to = lambda y: F.when(short_day, in_short_days(y)).when(short_month, in_short_months(y)).otherwise(F.date_add(F.lit("1900-01-01").cast("date"), y.cast("int")))
        return F.when(days.between(0, DAYS - 1), _let(permuted(place, a, b, key, "date"), to))

    def shown(d: Column) -> Column:
        day, month = (_padded(x, F.when(short, 1).otherwise(2)) for x, short in ((F.day(d), short_day), (F.month(d), short_month)))
        day, month = (F.when(short, x.cast("string")).otherwise(y) for x, y, short in ((F.day(d), day, short_day), (F.month(d), month, short_month)))
        sign = F.when(dotted, ".").otherwise("/")
        other = F.concat(F.when(day_first, day).otherwise(month), sign, F.when(day_first, month).otherwise(day), sign, F.year(d).cast("string"))
        return F.when(s.rlike("^[0-9]{4}-"), F.date_format(d, "yyyy-MM-dd")).when(iso, F.date_format(d, "yyyy/MM/dd")).otherwise(other)

    return _let(_let(date, moved), shown)


def _mod_97(s: Column) -> Column:
    """Of digits and capital letters, which count as 10 to 35."""
    value = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    signs = F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: value(F.substring(s, i, F.lit(1))))
    return F.aggregate(signs, F.lit(0), lambda r, v: (r * F.when(v > 9, 100).otherwise(10) + v) % 97)


def _iban(s: Column, key: str) -> Column:
    plain = F.replace(s, F.lit(" "), F.lit(""))

    def made(p: Column) -> Column:
        state, body = F.substring(p, 1, 2), F.substring(p, 5, 40)
        tail = F.regexp_extract(body, "[0-9]{1,18}$", 0)
        new = F.concat(F.left(body, F.length(body) - F.length(tail)), _long_number(tail, key, "iban"))
        whole = _let(new, lambda b: F.concat(state, _padded(98 - _mod_97(F.concat(b, state, F.lit("00"))), F.lit(2)), b))
        ok = F.length(p).between(15, 34) & (F.length(tail) >= 6) & (_mod_97(F.concat(body, state, F.substring(p, 3, 2))) == 1)
        # the spaces stay where they are
        sign = lambda i: F.substring(s, i, F.lit(1))
        put = lambda w, i: F.when(sign(i) == " ", F.lit(" ")).otherwise(F.substring(w, F.length(F.replace(F.substring(s, F.lit(1), i), F.lit(" "), F.lit(""))), F.lit(1)))
        return F.when(ok, _let(whole, lambda w: F.array_join(F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: put(w, i)), "")))

    return _let(plain, made)


def _email(s: Column, key: str) -> Column:
    host = F.substring_index(s, "@", -1)
    return F.concat(F.lit("u"), F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit("email"), F.lower(s)), 256), 1, 14), F.lit("@"), host)


MAKERS = {"iban": _iban, "email": _email, "ip": _ip, "date": _date, "ssn": _ssn, "card": _card, "phone": _phone}


def kind_of(s: Column) -> Column:
    """Of a match of ``ANY``: the form that fits it as a whole, in the order of the alternatives."""
    out = F.lit(None).cast("string")
    for kind, pattern in reversed(FORMS):
        out = F.when(s.rlike(f"^(?:{pattern})$"), F.lit(kind)).otherwise(out)
    return out


def pseudonymize(docs: DataFrame, key: str, text: str = "text", found: str = "found__") -> DataFrame:
    """All columns, with pseudonyms in ``text``; ``found``: kind and pseudonym of each value in order."""
    if not key:
        raise ValueError("a key is needed: without one anybody can undo the pseudonyms")
    own, names = numbered(docs.select(*(F.col(f"`{c}`") for c in docs.columns if c.lower() != found.lower())))
    spot = F.col(own.columns[names.index(text)])

    def made(s: Column, kind: Column) -> Column:
        out = F.lit(None).cast("string")
        for k, make in MAKERS.items():
            out = F.when(kind == k, make(s, key)).otherwise(out)
        return F.struct(kind.alias("kind"), s.alias("old"), out.alias("new"))

    def replaced(s: Column) -> Column:
        return _let(kind_of(s), lambda kind: made(s, kind))

    maybe = spot.rlike(MAYBE)
    matches = F.when(maybe, F.regexp_extract_all(spot, F.lit(ANY), 0)).otherwise(F.array().cast("array<string>"))
    step = own.withColumn("matches", matches).withColumn("values", F.transform("matches", replaced))
    pieces = F.split(spot, ANY, -1)
    joined = F.array_join(F.flatten(F.zip_with(pieces, "values", lambda p, r: F.array(p, F.coalesce(r["new"], r["old"], F.lit(""))))), "")
    some = F.exists("values", lambda r: r["new"].isNotNull())
    values = F.transform(F.filter("values", lambda r: r["new"].isNotNull()), lambda r: F.struct(r["kind"].alias("kind"), r["new"].alias("pseudonym")))
    out = [F.when(some, joined).otherwise(spot) if n == text else F.col(c) for c, n in zip(own.columns, names)]
    return step.select(*out, values).toDF(*names, found)


def op8_pii_pseudonyms(spark: SparkSession, sf_dir: str, key: str = TEST_KEY) -> DataFrame:
    """doc_id, text (with pseudonyms), n_values, kinds of each document."""
    done = pseudonymize(documents(spark, sf_dir).select("doc_id", "text"), key)
    kinds = F.array_join(F.array_sort(F.array_distinct(F.transform("found__", lambda f: f["kind"]))), ",")
    return done.select("doc_id", "text", F.size("found__").cast("long").alias("n_values"), kinds.alias("kinds"))
