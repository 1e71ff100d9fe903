"""Personal data replaced by format-preserving pseudonyms.

Native: built-in column functions only, row by row, no shuffle. Emails, IBANs of the length of their country and cards in a usual
layout are told first, at every place where one can start and in every extent; one regular expression finds candidates in what is left. Each
kind is validated (check digits, calendar, number ranges), and what is valid is written as a vector of digits with a radix for each
position. A keyed Feistel network permutes that vector, so that the pseudonym has the same format, is valid again, and equal
values get equal pseudonyms in every document. Whoever holds the key can invert it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doclake.functions.frames import computed, let

ROUNDS = 8
#: Hex digits of the round function's output that make one key-stream number, and such numbers in one hash.
HEX, PER_HASH = 8, 16

_WORD = r"\p{L}\p{N}._%+-"
#: Candidates, in order of precedence. Look-behinds let a run be tried once only, so the search stays linear.
PATTERNS = {
    "email": rf"(?<![{_WORD}])[{_WORD}]++@[\p{{L}}\p{{N}}-]++(?:\.[\p{{L}}\p{{N}}-]++)*+(?<=\.\p{{L}}{{2,24}})",
    "secret": r"(?<![0-9A-Za-z])[0-9a-f]{32,64}(?![0-9A-Za-z])",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])",
    "ip": r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?!\.?[0-9])",
    "date": r"(?<![0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?![./-]?[0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?!-?[0-9])",
    "phone": r"(?<![0-9])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\) ?|(?<=[ .-])[0-9]{2,4}[ .-]|(?<![0-9 .-])[0-9]{3}[.-])[0-9]{3}[ .-][0-9]{4}(?![0-9])",
    "card": r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])",
}
KINDS = list(PATTERNS)
_ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: Groups of a card number that has one separator throughout, the longest first.
LAYOUTS = ((4, 4, 4, 4, 3), (6, 13), (19,), (18,), (17,), (4, 4, 4, 4), (8, 8), (16,), (4, 6, 5), (15,), (4, 6, 4), (14,), (4, 4, 5), (4, 3, 3, 3), (13,))
#: Characters of an IBAN by country.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL SD FK", 19: "MK SI", 20: "AT BA EE KZ LT LU XK MN", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC", 33: "RU",
}
#: What every candidate holds; a text without it is not searched.
_GATE = r"@|[0-9]{2}|[0-9]\.[0-9]"


def _feistel(values: Column, radices: Column, kind: str, key: str) -> Column:
    """Keyed permutation of vectors with given radices: halves are shifted in turn by a hash of the other half."""

    def stream(other: Column, number: Column, size: Column, length: Column) -> Column:
        seed = F.concat_ws("|", F.lit(key), F.lit(kind), number.cast("string"), size.cast("string"),
                           F.array_join(other.cast("array<string>"), ","))
        last = F.floor(F.greatest(length - 1, F.lit(0)) / PER_HASH).cast("int")
        return let(seed, lambda s: F.array_join(F.transform(
            F.sequence(F.lit(0), last), lambda b: F.sha2(F.concat(s, F.lit("|"), b.cast("string")).cast("binary"), 512)), ""))

    def shifted(own: Column, rad: Column, other: Column, number: Column, size: Column) -> Column:
        return let(stream(other, number, size, F.size(own)), lambda s: F.transform(own, lambda v, j: F.pmod(
            v + F.conv(F.substring(s, j * HEX + 1, F.lit(HEX)), 16, 10).cast("bigint"), F.get(rad, j))))

    def halves(array: Column) -> Column:
        half = F.floor((F.size(array) + 1) / 2).cast("int")
        return F.struct(F.slice(array, F.lit(1), half).alias("l"), F.slice(array, half + 1, F.size(array) - half).alias("r"))

    def rounds(start: Column, rad: Column) -> Column:
        size = F.size(start["l"]) + F.size(start["r"])
        return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, lambda a, n: F.when(
            n % 2 == 0, F.struct(shifted(a["l"], rad["l"], a["r"], n, size).alias("l"), a["r"].alias("r"))
        ).otherwise(F.struct(a["l"].alias("l"), shifted(a["r"], rad["r"], a["l"], n, size).alias("r"))))

    return let(halves(values), lambda start: let(halves(radices), lambda rad: let(
        rounds(start, rad), lambda done: F.concat(done["l"], done["r"]))))


def _chars(s: Column) -> Column:
    return F.regexp_extract_all(s, F.lit(r"(?s)."), F.lit(0))


#: First character and size of each alphabet inside which a character is permuted.
ALPHABETS = (("0", 10), ("a", 26), ("A", 26), ("à", 23), ("À", 23))


def _permuted_text(s: Column, kind: str, key: str) -> Column:
    """Digits become digits, letters letters of the same case; everything else stays."""
    def of(code: Column, pick) -> Column:
        out = pick(None)
        for first, size in ALPHABETS:
            out = F.when(code.between(ord(first), ord(first) + size - 1), F.lit(pick((ord(first), size)))).otherwise(out)
        return out

    def by_chars(chars: Column) -> Column:
        return let(F.transform(chars, lambda c: F.ascii(c)), lambda codes: by_codes(chars, codes))

    def by_codes(chars: Column, codes: Column) -> Column:
        radix = F.transform(codes, lambda c: of(c, lambda a: F.lit(1) if a is None else a[1]).cast("bigint"))
        value = F.transform(codes, lambda c: (c - of(c, lambda a: c if a is None else a[0])).cast("bigint"))
        return F.array_join(F.zip_with(chars, _feistel(value, radix, kind, key), lambda c, v: let(
            F.ascii(c), lambda code: F.when(of(code, lambda a: F.lit(0) if a is None else a[0]) == 0, c).otherwise(
                F.chr((of(code, lambda a: F.lit(0) if a is None else a[0]) + v).cast("bigint"))))), "")

    return let(_chars(s), by_chars)


def _digits(s: Column) -> Column:
    return F.transform(_chars(F.regexp_replace(s, "[^0-9]", "")), lambda d: d.cast("bigint"))


def _number(s: Column, position: int, length: int) -> Column:
    return F.substring(s, position, length).cast("bigint")


def _luhn_sum(digits: Column) -> Column:
    """Luhn sum of digits whose last one is not doubled."""
    return F.aggregate(F.reverse(digits), F.struct(F.lit(0).cast("bigint").alias("sum"), F.lit(False).alias("twice")), lambda a, d: F.struct(
        (a["sum"] + F.when(a["twice"], F.when(d > 4, d * 2 - 9).otherwise(d * 2)).otherwise(d)).alias("sum"), (~a["twice"]).alias("twice"),
    ))["sum"]


def _card(m: Column, key: str) -> Column:
    body = F.regexp_replace(m, "[0-9]$", "")
    new = _permuted_text(body, "card", key)
    whole = let(new, lambda n: F.concat(n, F.pmod(-_luhn_sum(F.concat(_digits(n), F.array(F.lit(0).cast("bigint")))), F.lit(10)).cast("string")))
    return F.when(_luhn_sum(_digits(m)) % 10 == 0, whole)


def _mod97(s: Column) -> Column:
    return F.aggregate(_chars(s), F.lit(0).cast("bigint"), lambda a, c: F.when(
        c.between("0", "9"), (a * 10 + c.try_cast("bigint")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97))


def _iban(m: Column, key: str) -> Column:
    bare = lambda s: F.translate(s, " ", "")
    country, rest = F.substring(m, 1, 2), F.substring(m, 5, 1000)
    check = lambda r: F.lpad((F.lit(98) - _mod97(F.concat(bare(r), country, F.lit("00")))).cast("string"), 2, "0")
    valid = _mod97(F.concat(bare(rest), F.substring(m, 1, 4))) == 1
    return F.when(valid, let(_permuted_text(rest, "iban", key), lambda r: F.concat(country, check(r), r)))


def _ip(m: Column, key: str) -> Column:
    parts = F.transform(F.split(m, r"\."), lambda p: p.cast("bigint"))
    new = _feistel(parts, F.array_repeat(F.lit(256).cast("bigint"), 4), "ip", key)
    return F.when(F.forall(parts, lambda p: p < 256), F.array_join(new.cast("array<string>"), "."))


#: Days of a block inside which a date is permuted: 250 x 292, about 200 years from 1900-01-01 on.
DATE_RADICES = (250, 292)


def _date(m: Column, key: str) -> Column:
    iso = F.substring(m, 5, 1) == "-"
    y = F.when(iso, _number(m, 1, 4)).otherwise(_number(m, 7, 4))
    a = F.when(iso, _number(m, 6, 2)).otherwise(_number(m, 4, 2))  # month, or the day of a month-first date
    b = F.when(iso, _number(m, 9, 2)).otherwise(_number(m, 1, 2))
    leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
    length = lambda month: F.when(month == 2, F.when(leap, 29).otherwise(28)).when(month.isin(4, 6, 9, 11), 30).otherwise(31)
    valid = lambda month, day: month.between(1, 12) & (day >= 1) & (day <= length(month)) & y.between(1700, 2299)
    per_block = DATE_RADICES[0] * DATE_RADICES[1]

    def moved(month: Column, day: Column, pattern) -> Column:
        number = F.datediff(F.make_date(y.cast("int"), month.cast("int"), day.cast("int")), F.lit("1900-01-01").cast("date"))
        block, offset = F.floor(number / per_block), F.pmod(number, F.lit(per_block))
        vector = F.array(F.floor(offset / DATE_RADICES[1]), (offset % DATE_RADICES[1]).cast("bigint"))
        new = _feistel(vector, F.array(*[F.lit(r).cast("bigint") for r in DATE_RADICES]), "date", key)
        return let(new, lambda v: F.date_format(F.date_add(
            F.lit("1900-01-01").cast("date"), (block * per_block + v[0] * DATE_RADICES[1] + v[1]).cast("int")), pattern))

    sep = F.substring(m, 3, 1)
    day_first = F.when(sep == "/", moved(a, b, "dd/MM/yyyy")).otherwise(moved(a, b, "dd.MM.yyyy"))
    return (F.when(iso & valid(a, b), moved(a, b, "yyyy-MM-dd")).when(~iso & valid(a, b), day_first)
            .when((sep == "/") & valid(b, a), moved(b, a, "MM/dd/yyyy")))


#: Valid area numbers are 1 to 899 without 666, groups 1 to 99, serials 1 to 9999.
SSN_RADICES = (898, 99 * 9999)


def _ssn(m: Column, key: str) -> Column:
    area, group, serial = _number(m, 1, 3), _number(m, 5, 2), _number(m, 8, 4)
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    vector = F.array(area - F.when(area > 666, 2).otherwise(1), (group - 1) * 9999 + serial - 1)
    new = _feistel(vector, F.array(*[F.lit(r).cast("bigint") for r in SSN_RADICES]), "ssn", key)
    pad = lambda c, n: F.lpad(c.cast("bigint").cast("string"), n, "0")
    return F.when(valid, let(new, lambda v: F.concat_ws(
        "-", pad(v[0] + F.when(v[0] >= 665, 2).otherwise(1), 3), pad(F.floor(v[1] / 9999) + 1, 2), pad(v[1] % 9999 + 1, 4))))


def _phone(m: Column, key: str) -> Column:
    country = F.regexp_extract(m, r"^\+[0-9]{1,3}(?=[ .(-])", 0)
    return F.concat(country, _permuted_text(F.substr(m, F.length(country) + 1), "phone", key))


def _email(m: Column, key: str) -> Column:
    """The name and the domain without its last label."""
    return F.concat(_permuted_text(F.regexp_extract(m, r"^(.*)\.[^.]+$", 1), "email", key), F.regexp_extract(m, r"\.[^.]+$", 0))


def _secret(m: Column, key: str) -> Column:
    digits = F.transform(_chars(m), lambda c: (F.instr(F.lit("0123456789abcdef"), c) - 1).cast("bigint"))
    new = _feistel(digits, F.transform(digits, lambda d: F.lit(16).cast("bigint")), "secret", key)
    return F.array_join(F.transform(new, lambda v: F.substr(F.lit("0123456789abcdef"), (v + 1).cast("int"), F.lit(1))), "")


_MAKERS = {"email": _email, "secret": _secret, "iban": _iban, "ip": _ip, "date": _date, "ssn": _ssn, "phone": _phone, "card": _card}


def _replacement(m: Column, key: str) -> Column:
    """struct<kind, new> of a candidate; kind is null where no rule finds it valid.

    Candidates are told apart by their own shape, so a value is read the same way wherever it stands."""
    shapes = {
        "email": F.contains(m, F.lit("@")),
        "secret": F.regexp_like(m, F.lit("^[0-9a-f]{32,64}$")),
        "iban": F.regexp_like(m, F.lit("^[A-Z]{2}[0-9]{2}")),
        "ip": F.regexp_like(m, F.lit(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$")),
        "date": F.regexp_like(m, F.lit(r"^([0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}([/.])[0-9]{2}\2[0-9]{4})$")),
        "ssn": F.regexp_like(m, F.lit(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$")),
        "card": F.regexp_like(m, F.lit(r"^[0-9](?:[ -]?[0-9]){12,18}$")),
    }
    kind = reduce(lambda rest, k: F.when(shapes[k], F.lit(k)).otherwise(rest), reversed(list(shapes)), F.lit("phone"))

    def made(k: Column) -> Column:
        out = F.lit(None).cast("string")
        for name, make in _MAKERS.items():
            out = F.when(k == name, make(m, key)).otherwise(out)
        return out

    return let(kind, lambda k: let(made(k), lambda new: F.struct(F.when(new.isNotNull(), k).alias("kind"), F.coalesce(new, m).alias("new"))))


def _pieces(gaps: Column, values: Column) -> Column:
    """Array of struct<s, v>: gaps (v is false) and the values between them, in order."""
    piece = lambda s, v: F.struct(s.alias("s"), F.lit(v).alias("v"))
    return F.flatten(F.zip_with(gaps, values, lambda g, m: F.when(m.isNull(), F.array(piece(g, False))).otherwise(
        F.array(piece(g, False), piece(m, True)))))


def _cut(s: Column, pattern: Column) -> Column:
    return _pieces(F.split(s, pattern, -1), F.regexp_extract_all(s, pattern, F.lit(0)))


def _layout(groups: tuple[int, ...]) -> str:
    """A card number from its start on; ``~`` stands for the number of the group that holds its separator."""
    first, *rest = [f"[0-9]{{{n}}}" for n in groups]
    return first + (rf"([ -]){rest[0]}" + "".join(rf"\~{r}" for r in rest[1:]) if rest else "") + "(?![0-9])"


def _extents(s: Column, pattern: str, valid) -> Column:
    """The valid ones of all places where ``pattern`` can stand, overlapping ones too."""
    return F.filter(F.regexp_extract_all(s, F.lit(pattern), F.lit(1)), lambda m: valid(m))


def _cards(s: Column) -> Column:
    """Every valid card number in a usual layout, wherever it starts and ends in a run of digits."""
    found = [_extents(s, rf"(?<![0-9])(?=({_layout(g).replace('~', '2')}))", lambda m: _luhn_sum(_digits(m)) % 10 == 0) for g in LAYOUTS]
    return F.array_distinct(F.concat(*found))


def _ibans(s: Column) -> Column:
    """Every valid IBAN of the length of its country."""
    bare = lambda m: F.translate(m, " ", "")
    valid = lambda m: let(bare(m), lambda b: _mod97(F.concat(F.substring(b, 5, 1000), F.substring(b, 1, 4))) == 1)
    found = [_extents(s, rf"(?<![0-9A-Za-z])(?=((?:{'|'.join(names.split())})[0-9]{{2}}(?: ?[A-Z0-9]){{{n - 4}}}(?![0-9A-Za-z])))", valid)
             for n, names in IBAN_LENGTHS.items()]
    return F.array_distinct(F.concat(*found))


def _told(pieces: Column, gate: str, values, edge: str) -> Column:
    """``pieces`` with the ``values`` of their gaps cut out; the values hold nothing that a regular expression reads otherwise."""
    whole = lambda x: F.array(F.struct(x["s"].alias("s"), x["v"].alias("v")))

    def cut(x: Column) -> Column:
        return let(values(x["s"]), lambda found: F.when(F.size(found) == 0, whole(x)).otherwise(_cut(x["s"], F.concat(
            F.lit(f"(?<!{edge})(?:"), F.array_join(found, "|"), F.lit(f")(?!{edge})")))))

    return F.flatten(F.transform(pieces, lambda x: F.when(~x["v"] & F.regexp_like(x["s"], F.lit(gate)), cut(x)).otherwise(whole(x))))


def pseudonymise(docs: DataFrame, key: str, text_column: str = "text") -> DataFrame:
    """``docs`` with rewritten texts and ``pii``, an array of the kinds found, in text order.

    Null texts stay null with no finds; texts without valid finds stay as they are, byte for byte; other columns pass through
    (an own column ``pii`` is replaced). Dates are read as ISO or day first, month first only where that is the one valid
    reading. Numbers that fail their check digit, calendar or range in every extent are not personal data and stay.
    """
    text = F.col(text_column)
    kept = [c for c in docs.columns if c != "pii"]
    gated = F.regexp_like(text, F.lit(_GATE))
    emails = computed(docs.select(*kept), {"__e": F.when(gated, _cut(text, F.lit(PATTERNS["email"])))})
    ibans = computed(emails, {"__i": _told(F.col("__e"), r"[A-Z]{2}[0-9]{2} ?[A-Z0-9]", _ibans, "[0-9A-Za-z]")})
    cards = computed(ibans, {"__c": _told(F.col("__i"), r"[0-9](?:[ -]?[0-9]){12}", _cards, "[0-9]")})
    rest = computed(cards, {"__p": F.flatten(F.transform("__c", lambda x: F.when(x["v"], F.array(x)).otherwise(_cut(x["s"], F.lit(_ANY)))))})
    unmade = lambda x: F.struct(F.lit(None).cast("string").alias("kind"), x["s"].alias("new"))
    swaps = computed(rest, {"__s": F.when(F.exists("__p", lambda x: x["v"]), F.transform(
        "__p", lambda x: F.when(x["v"], _replacement(x["s"], key)).otherwise(unmade(x))))})
    new = F.array_join(F.transform("__s", lambda x: x["new"]), "")
    kinds = F.coalesce(F.filter(F.transform("__s", lambda s: s["kind"]), lambda k: k.isNotNull()), F.array().cast("array<string>"))
    return swaps.select(
        *[F.when(F.col("__s").isNotNull(), new).otherwise(text).alias(c) if c == text_column else F.col(c) for c in kept],
        kinds.alias("pii"))


def report(docs: DataFrame, key: str) -> DataFrame:
    """doc_id, the rewritten text, and how many values of each kind were replaced."""
    out = pseudonymise(docs.select("doc_id", "text"), key)
    count = lambda kind: F.size(F.filter("pii", lambda k: k == kind)).cast("bigint").alias(f"n_{kind}")
    return out.select("doc_id", "text", F.size("pii").cast("bigint").alias("n_pii"), *[count(kind) for kind in KINDS])
