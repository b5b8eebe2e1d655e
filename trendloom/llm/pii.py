"""Format-preserving Feistel pseudonyms for personal numbers, dates and addresses, in SQL functions alone.

One pattern finds candidates; each is validated by its kind (Luhn's sum, mod 97, octets, calendar, numbering
plan). A validated value is written as a pair of numbers (a, b) below moduli (ma, mb) that just cover its
format, and a keyed Feistel network permutes the pairs: a += F(b) mod ma, b += F(a) mod mb, in turns. So the
pseudonym is a valid value of the same format, different values get different pseudonyms, and equal values
stay linked across documents, whatever their separators. Each row is treated on its own: no shuffle.

Kinds: email (the local part, in blocks of 26 letters and digits, each under the ones before), iban (all after the
country's code, letters too), ip, date (1901 to 2099, among the dates that are written alike: same separator, same
widths; 29 February among those of leap years), ssn, phone, card. Of a card's candidate, any groups of digits that are valid together count, the first and longest ones; an
IBAN ends at its country's length. Candidates that fail validation stay as they are.

Defined results: a null text stays null with no findings; an empty one stays empty; equal texts get equal
results; extra columns are kept, but for those named like the results, which are replaced. Without the key
the pseudonyms can't be undone; a caller must pass a secret one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trendloom.llm.common import unique_name

ROUNDS = 8
KINDS = ("email", "iban", "ip", "date", "ssn", "phone", "card")
_EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,6}\.[A-Za-z]{2,24}(?![A-Za-z0-9])"
#: Signs of a country's IBAN.
_IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


def _iban_of(n: int, countries: str) -> str:
    rest = rf" ?[A-Z0-9]{{{n % 4}}}" if n % 4 else ""
    return rf"(?:{countries.replace(' ', '|')})\d{{2}}(?: ?[A-Z0-9]{{4}}){{{n // 4 - 1}}}{rest}"


_IBAN = (
    rf"(?<![A-Za-z0-9])(?:{'|'.join(_iban_of(n, c) for n, c in sorted(_IBAN_LENGTHS.items(), reverse=True))}"
    r"|[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)(?![A-Za-z0-9])"
)
_IP = r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\.?\d)"
_DATE = r"(?<![\d/.-])(?:\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4})(?![\d/-]|\.\d)"
_SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
_PHONE = r"(?<![\w+])\+\d{1,3}[ .-]?\(?\d{1,4}\)?(?:[ .-]?\d{2,4}){2,4}(?!\d)|(?<![\w(])\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|(?<![\d.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d-]|\.\d)"
_CARD = r"(?<!\d)(?:\d[ -]?){12,18}\d(?!\d)"
PATTERN = "|".join((_EMAIL, _IBAN, _IP, _DATE, _SSN, _PHONE, _CARD))
#: First year, step and number of the years that dates have, and of those that a 29 February has.
_YEARS, _LEAP_YEARS = (1901, 1, 199), (1904, 4, 49)


def _days_written() -> dict[str, list[str]]:
    """By form, all ways to write a day and a month in it: separator and widths of the two numbers, and + for
    29 February. Slashes may have either number first."""
    lasts = (31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)
    plain = [(d, m) for m, last in enumerate(lasts, 1) for d in range(1, last + 1)]
    out = {}
    for more, days in (("", plain), ("+", [(29, 2)])):
        out[f"-22{more}"] = [f"{m:02d}-{d:02d}" for d, m in days]
        for w1 in (1, 2):
            for w2 in (1, 2):
                both = {"." : days, "/": days + [(m, d) for d, m in days]}
                for sign, pairs in both.items():
                    fit = {f"{x:0{w1}d}{sign}{y:0{w2}d}" for x, y in pairs if x < 10**w1 and y < 10**w2}
                    if fit:
                        out[f"{sign}{w1}{w2}{more}"] = sorted(fit)
    return out


_WRITTEN = _days_written()


def _long(x: Column) -> Column:
    return x.try_cast("long")


def feistel(key: str, tag: Column | str, a: Column, b: Column, ma: Column | int, mb: Column | int, undo: bool = False) -> Column:
    """struct(a, b), permuted within [0, ma) x [0, mb) under the key; tag keeps the kinds apart."""
    ma, mb = (F.lit(m).cast("long") if isinstance(m, int) else _long(m) for m in (ma, mb))
    tag = F.lit(tag) if isinstance(tag, str) else tag

    def mask(i: Column, half: Column, m: Column) -> Column:
        return _long(F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(key), tag, i.cast("string"), half.cast("string")), 256), 1, 15), 16, 10)) % m

    def step(s: Column, i: Column) -> Column:
        sign = -1 if undo else 1
        left = F.when(i % 2 == 0, F.pmod(s["a"] + sign * mask(i, s["b"], ma), ma)).otherwise(s["a"])
        right = F.when(i % 2 == 1, F.pmod(s["b"] + sign * mask(i, s["a"], mb), mb)).otherwise(s["b"])
        return F.struct(left.alias("a"), right.alias("b"))

    rounds = F.sequence(F.lit(ROUNDS - 1), F.lit(0), F.lit(-1)) if undo else F.sequence(F.lit(0), F.lit(ROUNDS - 1))
    return F.aggregate(rounds, F.struct(_long(a).alias("a"), _long(b).alias("b")), step)


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _with(x: Column, use) -> Column:
    """use(x) with x evaluated once."""
    return F.element_at(F.transform(F.array(x), use), 1)


def _pad(x: Column, n: Column | int) -> Column:
    return F.lpad(x.cast("string"), F.lit(n) if isinstance(n, int) else n, F.lit("0"))


def _permute_digits(key: str, tag: str, digits: Column) -> Column:
    """A string of up to 36 digits, permuted within its length."""

    def use(d: Column) -> Column:
        n = F.length(d)
        u = (n / 2).cast("int")
        v = n - u
        a, b = F.coalesce(_long(F.substring(d, F.lit(1), u)), F.lit(0)), _long(F.substring(d, u + 1, v))
        tagged = F.concat(F.lit(tag), n.cast("string"))
        return _with(feistel(key, tagged, a, b, _long(F.rint(F.pow(F.lit(10.0), u))), _long(F.rint(F.pow(F.lit(10.0), v)))), lambda s: F.when(u > 0, F.concat(_pad(s["a"], u), _pad(s["b"], v))).otherwise(_pad(s["b"], v)))

    return _with(digits, use)


def _refill(shape: Column, fresh: Column) -> Column:
    """shape with its digits replaced by those of fresh, one by one."""
    place = F.transform(F.sequence(F.lit(1), F.length(shape)), lambda i: F.when(F.substring(shape, i, F.lit(1)).rlike("[0-9]"), F.substring(fresh, F.length(_digits(F.substring(shape, F.lit(1), i))), F.lit(1))).otherwise(F.substring(shape, i, F.lit(1))))
    return F.array_join(place, "")


def luhn_sum(digits: Column, shift: int = 0) -> Column:
    """Luhn's sum; shift 1 is for digits that still lack their check digit."""

    def term(total: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i + 1, F.lit(1)).try_cast("int")
        twice = d * 2
        return total + F.when((i + shift) % 2 == 0, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), term)


def mod97(text: Column) -> Column:
    """The remainder of digits and letters (A is 10, ..., Z is 35)."""

    def term(rest: Column, i: Column) -> Column:
        c = F.substring(text, i, F.lit(1))
        return F.when(c.rlike("[0-9]"), (rest * 10 + c.cast("int")) % 97).otherwise((rest * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(text)), F.lit(0), term)


def _valid_card(m: Column) -> Column:
    d = _digits(m)
    # a whole run of zeros has a valid sum, but no issuer
    return F.length(d).between(13, 19) & (luhn_sum(d) % 10 == 0) & d.rlike("[1-9]")


def _card(key: str, m: Column) -> tuple[Column, Column]:
    places = F.sequence(F.lit(1), F.length(m))
    digit = lambda i: F.substring(m, i, F.lit(1)).rlike("[0-9]")
    starts = F.filter(places, lambda i: digit(i) & ((i == 1) | ~digit(i - 1)))
    ends = F.reverse(F.filter(places, lambda i: digit(i) & ((i == F.length(m)) | ~digit(i + 1))))
    parts = F.flatten(F.transform(starts, lambda a: F.transform(F.filter(ends, lambda b: b - a >= 12), lambda b: F.struct(a.alias("a"), F.substring(m, a, b - a + 1).alias("part")))))
    found = F.filter(parts, lambda p: _valid_card(p["part"]))

    def fresh(x: Column) -> Column:
        return F.concat(x, ((10 - luhn_sum(x, 1) % 10) % 10).cast("string"))

    def whole(p: Column) -> Column:
        d = _digits(p["part"])
        new = _with(_permute_digits(key, "card", F.substring(d, F.lit(1), F.length(d) - 1)), fresh)
        return F.concat(F.substring(m, F.lit(1), p["a"] - 1), _refill(p["part"], new), F.substring(m, p["a"] + F.length(p["part"]), F.length(m)))

    return F.size(found) > 0, F.get(F.transform(F.slice(found, 1, 1), whole), F.lit(0))


def _iban(key: str, m: Column) -> tuple[Column, Column]:
    plain = F.regexp_replace(m, " ", "")
    valid = F.length(plain).between(15, 34) & (mod97(F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4))) == 1)
    bare = F.substring(m, F.lit(5), F.length(m))

    def whole(body: Column) -> Column:
        check = 98 - mod97(F.concat(F.regexp_replace(body, " ", ""), F.substring(m, 1, 2), F.lit("00")))
        return F.concat(F.substring(m, 1, 2), _pad(check, 2), body)

    return valid, _with(_permute_signs(key, F.concat(F.lit("iban:"), F.substring(m, 1, 2), _shape(F.regexp_replace(bare, " ", ""))), bare), whole)


def _ip(key: str, m: Column) -> tuple[Column, Column]:
    octets = F.transform(F.split(m, r"\."), lambda x: x.try_cast("int"))
    valid = F.forall(octets, lambda x: x < 256) & ~m.rlike(r"(^|\.)0\d")

    def use(o: Column) -> Column:
        host = F.element_at(o, 1).between(1, 223)  # unicast stays unicast
        a = F.when(host, F.element_at(o, 1) * 256 - 256 + F.element_at(o, 2)).otherwise(F.element_at(o, 1) * 256 + F.element_at(o, 2))
        # the other first octets, 0 and 224 to 255, are permuted among themselves
        a = F.when(host, a).when(F.element_at(o, 1) == 0, F.element_at(o, 2)).otherwise((F.element_at(o, 1) - 223) * 256 + F.element_at(o, 2))
        b = F.element_at(o, 3) * 256 + F.element_at(o, 4)
        s = feistel(key, F.when(host, F.lit("ip")).otherwise(F.lit("ip+")), a, b, F.when(host, F.lit(223 * 256)).otherwise(F.lit(33 * 256)), 65536)

        def text(p: Column) -> Column:
            high = F.shiftright(p["a"], 8)
            first = F.when(host, high + 1).when(high == 0, F.lit(0)).otherwise(high + 223)
            return F.concat_ws(".", *(x.cast("string") for x in (first, p["a"] % 256, F.shiftright(p["b"], 8), p["b"] % 256)))

        return _with(s, text)

    return valid, _with(octets, use)


def _date(key: str, m: Column) -> tuple[Column, Column]:
    """A date among those written alike: day and month among all pairs of the form, and the year."""
    iso = m.rlike("^[0-9]{4}-")
    year = F.when(iso, F.substring(m, 1, 4)).otherwise(F.substring(m, -4, 4)).try_cast("int")
    pair = F.when(iso, F.substring(m, 6, 5)).otherwise(F.substring(m, F.lit(1), F.length(m) - 5))
    parts = F.split(pair, "[-/.]")
    leap = pair.rlike("^(0?2/29|29[/.]0?2|02-29)$")
    form = F.concat(F.regexp_extract(pair, "[-/.]", 0), F.length(F.element_at(parts, 1)).cast("string"), F.length(F.element_at(parts, 2)).cast("string"), F.when(leap, F.lit("+")).otherwise(F.lit("")))
    written = F.create_map(*(x for k, v in _WRITTEN.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    first, step, n = (F.when(leap, F.lit(b)).otherwise(F.lit(a)) for a, b in zip(_YEARS, _LEAP_YEARS, strict=True))
    nth = (year - first) / step
    valid = F.coalesce((F.array_position(F.element_at(written, form), pair) > 0) & nth.between(0, n - 1) & (nth == F.floor(nth)), F.lit(False))

    def fresh(pairs: Column) -> Column:
        done = feistel(key, F.concat(F.lit("date"), form), F.array_position(pairs, pair) - 1, F.floor(nth), F.size(pairs), n)

        def text(p: Column) -> Column:
            own, other = F.element_at(pairs, (p["a"] + 1).cast("int")), (p["b"] * step + first).cast("string")
            return F.when(iso, F.concat_ws("-", other, own)).otherwise(F.concat(own, F.substring(m, -5, 1), other))

        return _with(done, text)

    return valid, _with(F.element_at(written, form), fresh)


def _ssn(key: str, m: Column) -> tuple[Column, Column]:
    area, group, serial = F.substring(m, 1, 3).try_cast("int"), F.substring(m, 5, 2).try_cast("int"), F.substring(m, 8, 4).try_cast("int")
    valid = (area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0)
    s = feistel(key, "ssn", F.when(area > 666, area - 2).otherwise(area - 1), (group - 1) * 9999 + serial - 1, 898, 99 * 9999)

    def text(p: Column) -> Column:
        return F.concat_ws("-", _pad(F.when(p["a"] >= 665, p["a"] + 2).otherwise(p["a"] + 1), 3), _pad(F.floor(p["b"] / 9999) + 1, 2), _pad(p["b"] % 9999 + 1, 4))

    return valid, _with(s, text)


def _phone(key: str, m: Column) -> tuple[Column, Column]:
    d = _digits(m)
    country = F.regexp_extract(m, r"^\+(\d{1,3}?)(?=[ .(-])", 1)  # the country's code stays
    own = F.substring(d, F.length(country) + 1, F.length(d))
    planned = (F.length(own) == 10) & (country.isin("", "1")) & own.rlike("^[2-9][0-9]{2}[2-9]")

    ten = (F.length(own) == 10) & country.isin("", "1")

    def unplanned(n: Column) -> Column:
        """Ten digits outside the plan, permuted by their place in order: first those that begin with 0 or 1, then those
        whose fourth digit is one of these. There are 60,000 squared."""
        low = F.substring(n, 1, 1).isin("0", "1")
        place = F.when(low, _long(n)).otherwise(F.lit(2_000_000_000).cast("long") + (_long(F.substring(n, 1, 3)) - 200) * 2_000_000 + _long(F.substring(n, 4, 7)))
        s = feistel(key, "phone-", F.floor(place / 60_000), place % 60_000, 60_000, 60_000)

        def spell(q: Column) -> Column:
            rest = q - 2_000_000_000
            return F.when(rest < 0, _pad(q, 10)).otherwise(F.concat((F.floor(rest / 2_000_000) + 200).cast("string"), _pad(rest % 2_000_000, 7)))

        return _with(_with(s, lambda p: p["a"] * 60_000 + p["b"]), spell)

    def use(n: Column) -> Column:
        s = feistel(key, "phone", F.substring(n, 1, 3).try_cast("int") - 200, _long(F.substring(n, 4, 7)) - 2_000_000, 800, 8_000_000)
        in_plan = _with(s, lambda p: F.concat((p["a"] + 200).cast("string"), (p["b"] + 2_000_000).cast("string")))
        return F.when(planned, in_plan).when(ten, unplanned(n)).otherwise(_permute_digits(key, "phone", n))

    return F.length(d).between(7, 15) & (F.length(own) >= 4), _refill(m, F.concat(country, _with(own, use)))


def _permute_signs(key: str, tag: Column, text: Column) -> Column:
    """text with its letters and digits permuted, in blocks of 26, each under the ones before; letters stay
    letters of their case, digits digits, and other signs as they are."""
    signs = F.regexp_extract_all(text, F.lit("([A-Za-z0-9])"), 1)
    radix = lambda c: F.when(c.rlike("[0-9]"), F.lit(10)).otherwise(F.lit(26))
    digit = lambda c: F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(F.lower(c)) - 97)
    one = lambda: F.lit(1).cast("long")

    def size(part: Column) -> Column:
        return F.aggregate(part, one(), lambda x, c: x * radix(c))

    def value(part: Column) -> Column:
        return F.aggregate(part, F.lit(0).cast("long"), lambda x, c: x * radix(c) + digit(c))

    def spell(number: Column, part: Column) -> Column:
        """The number in the part's mixed radix, with the part's cases, the first sign first."""
        start = F.struct(number.alias("n"), F.lit("").alias("t"))

        def add(s: Column, c: Column) -> Column:
            d = (s["n"] % radix(c)).cast("int")
            sign = F.char(F.when(c.rlike("[0-9]"), d + 48).when(c.rlike("[A-Z]"), d + 65).otherwise(d + 97))
            return F.struct(F.floor(s["n"] / radix(c)).alias("n"), F.concat(sign, s["t"]).alias("t"))

        return F.aggregate(F.reverse(part), start, add, lambda s: s["t"])

    def block(done: Column, p: Column) -> Column:
        """done, the new signs so far, and those of block p."""
        u = (F.size(p) / 2).cast("int")
        left, right = F.slice(p, F.lit(1), u), F.slice(p, u + 1, F.size(p))
        tagged = F.concat(tag, F.when(done == "", "").otherwise(F.concat(F.lit(":"), done)))
        s = feistel(key, tagged, value(left), value(right), size(left), size(right))
        return _with(s, lambda q: F.concat(done, spell(q["a"], left), spell(q["b"], right)))

    def use(p: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(p) - 1) / 26).cast("int")), lambda i: F.slice(p, i * 26 + 1, F.lit(26)))
        return F.aggregate(blocks, F.lit(""), block)

    def refill(fresh: Column) -> Column:
        place = F.transform(
            F.sequence(F.lit(1), F.length(text)),
            lambda i: _with(
                F.length(F.regexp_replace(F.substring(text, F.lit(1), i), "[^A-Za-z0-9]", "")),
                lambda k: F.when(F.substring(text, i, F.lit(1)).rlike("[A-Za-z0-9]") & (k <= F.length(fresh)), F.substring(fresh, k, F.lit(1))).otherwise(F.substring(text, i, F.lit(1))),
            ),
        )
        return F.array_join(place, "")

    return _with(_with(signs, use), refill)


def _shape(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, "[0-9]", "9"), "[A-Za-z]", "a")


def _email(key: str, m: Column) -> tuple[Column, Column]:
    local = F.substring_index(m, "@", 1)
    fresh = _permute_signs(key, F.concat(F.lit("email:"), _shape(local)), local)
    return local.rlike("[A-Za-z0-9]"), F.concat(fresh, F.substring(m, F.length(local) + 1, F.length(m)))


_RULES = {"email": (_EMAIL, _email), "iban": (_IBAN, _iban), "ip": (_IP, _ip), "date": (_DATE, _date), "ssn": (_SSN, _ssn), "phone": (_PHONE, _phone), "card": (_CARD, _card)}


def findings(text: Column, key: str) -> Column:
    """array<struct<raw, kind, fresh>> of the candidates in order; kind is null where validation fails."""

    def one(m: Column) -> Column:
        whole = [(kind, m.rlike(f"^(?:{pattern})$"), *rule(key, m)) for kind, (pattern, rule) in _RULES.items()]
        kind = F.lit(None).cast("string")
        fresh = m
        for name, looks, valid, new in reversed(whole):
            kind = F.when(looks & valid, F.lit(name)).otherwise(kind)
            fresh = F.when(looks & valid, new).otherwise(fresh)
        return F.struct(m.alias("raw"), kind.alias("kind"), fresh.alias("fresh"))

    return F.transform(F.regexp_extract_all(text, F.lit(f"({PATTERN})"), 1), one)


def pseudonymise(df: DataFrame, key: str) -> DataFrame:
    """df with its text replaced, and n_<kind> for each kind, in place of columns of these names; others are kept."""
    names = [f"n_{k}" for k in KINDS]
    df, mine = df.drop(*names), unique_name(df.columns, "findings_")
    df = df.withColumn(mine, findings(F.col("text"), key))
    rest = F.split("text", PATTERN, -1)
    fresh = F.concat(F.transform(mine, lambda f: f["fresh"]), F.array(F.lit("")))
    done = F.when(F.exists(mine, lambda f: f["kind"].isNotNull()), F.array_join(F.zip_with(rest, fresh, lambda a, b: F.concat(a, b)), "")).otherwise(F.col("text"))
    is_kind = lambda k: lambda f: f["kind"] == k
    counts = {n: F.coalesce(F.size(F.filter(mine, is_kind(k))), F.lit(0)) for n, k in zip(names, KINDS, strict=True)}
    counts = {n: F.greatest(c, F.lit(0)) for n, c in counts.items()}
    return df.withColumns(counts | {"text": done}).drop(mine)


def pii_digest(df: DataFrame, key: str) -> DataFrame:
    """doc_id, n_found, n_<kind>, and the whole pseudonymised text."""
    names = [f"n_{k}" for k in KINDS]
    done = pseudonymise(df.select("doc_id", "text"), key)
    return done.select("doc_id", reduce(lambda a, b: a + b, map(F.col, names)).alias("n_found"), *names, "text")
