"""Format-preserving pseudonyms for personal data.  DataFrame functions only.

Candidates are found by one pattern, validated (Luhn sum, octet range, calendar date, number
plan), and turned into an array of small integers, one per free position, each with its own
radix.  An alternating Feistel network adds keyed pseudo-random values to one half at a time,
each modulo its radix, so the map is a permutation of the format: a card stays a Luhn-valid
card of its length and separators, a date stays a date, an address stays an address.  The map
depends on the value and key alone, so equal values get equal pseudonyms in all documents,
and :func:`pseudonymise` with ``reverse=True`` and the key restores them.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, functions as F

from .shared import free_name, table

#: The session's setting that holds the key.
KEY_SETTING = "spark.isobar.pseudonymKey"
ROUNDS = 10
#: Values of seven hexadecimal digits that one keyed digest gives.
PAD_VALUES = 18

#: Character classes of free positions; a character keeps its class.
CLASSES = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ", "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ")

#: Dates from 1900-01-01 to 2099-12-31 number 73,049 = 17 x 4297.
DATE_RADIX = (17, 4297)

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_LOCAL, _HOST = r"[\p{L}\p{N}._%+-]", r"@(?:[A-Za-z0-9-]{1,63}\.){1,126}[A-Za-z]{2,63}"
#: E-mail names and secrets of any length are taken in pieces of 512 characters, each with a pseudonym: \\G goes on where a full piece ended.
PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G(?<={_LOCAL}{{512}}))(?={_LOCAL}++{_HOST}){_LOCAL}{{1,512}}+(?:{_HOST})?",
    "ip": rf"(?<![0-9.])(?:{_OCTET}\.){{3}}{_OCTET}(?![0-9]|\.[0-9])",
    "date": r"(?<![0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}|[0-9]{2}/[0-9]{2}/[0-9]{4})(?![0-9/-]|\.[0-9])",
    "phone": r"(?<![0-9A-Za-z+])(?:\+[0-9]{1,3}[ .-]?)?\([0-9]{3}\)[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9])|(?<![0-9A-Za-z+.-])(?:\+[0-9]{1,3}[ .-])?[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9]|[.-][0-9])|(?<![0-9A-Za-z+])\+[0-9]{8,15}(?![0-9])|(?<![0-9A-Za-z+])\+(?=(?:[ .-]?[0-9]){8,15}(?![0-9]|[ .-][0-9]))[0-9]{1,3}(?:[ .-][0-9]{1,12}){1,14}(?![0-9]|[ .-][0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]|-[0-9])",
    "card": r"(?<![0-9A-Za-z])(?:[0-9]{4}[ -]){4}[0-9]{1,3}(?![0-9A-Za-z])|(?<![0-9A-Za-z])(?:[0-9]{4}[ -]){3}[0-9]{1,7}(?![0-9A-Za-z])|(?<![0-9A-Za-z])[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}(?![0-9A-Za-z])|(?<![0-9A-Za-z])[0-9]{13,19}(?![0-9A-Za-z])",
    "secret": r"(?<![0-9A-Za-z+/.:])(?=[A-Za-z0-9]*+[+/])(?=[A-Za-z+/]*+[0-9])(?=[a-z0-9+/]*+[A-Z])(?=[A-Z0-9+/]*+[a-z])(?=[0-9A-Za-z+/]{40,}+={0,2}(?![0-9A-Za-z+/=]))[0-9A-Za-z+/]{1,512}+"
    r"|(?<![0-9A-Za-z])(?=[A-Za-z]*+[0-9])(?=[0-9]*+[A-Za-z])(?=[0-9A-Za-z]{24,}+(?![0-9A-Za-z]))[0-9A-Za-z]{1,512}+"
    r"|\G(?<=[0-9A-Za-z+/]{512})[0-9A-Za-z+/]{1,512}+",
}
ANY = "|".join(PATTERNS.values())
KINDS = tuple(PATTERNS)


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.transform(F.array(value), body)[0]


def _luhn_sum(digits: Column) -> Column:
    """Luhn sum of an array of digits, the last being the check digit."""
    n = F.size(digits)
    doubled = F.transform(digits, lambda d, i: F.when((n - i) % 2 == 0, F.element_at(F.array(*[F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), (d + 1).cast("int"))).otherwise(d))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x)


def _ints(text: Column) -> Column:
    """The digits of a text as an array of ints."""
    return F.transform(F.filter(F.split(F.regexp_replace(text, "[^0-9]", ""), ""), lambda c: c != ""), lambda c: c.cast("int"))


def _date(m: Column) -> Column:
    """The calendar date that a candidate means, null if none; ambiguous slashes are month first."""
    iso = F.regexp_replace(m, "/", "-")
    fmt = (
        F.when(m.rlike(r"^[0-9]{4}"), iso)
        .when(F.contains(m, F.lit(".")), F.concat_ws("-", F.substring(m, 7, 4), F.substring(m, 4, 2), F.substring(m, 1, 2)))
        .otherwise(F.concat_ws("-", F.substring(m, 7, 4), F.substring(m, 1, 2), F.substring(m, 4, 2)))
    )
    day = F.try_to_date(fmt, "yyyy-MM-dd")
    return F.when((day >= F.lit("1900-01-01").cast("date")) & (day <= F.lit("2099-12-31").cast("date")), day)


def kind_of(m: Column) -> Column:
    """The kind of a candidate, null if it is none after validation."""
    return _let(_ints(m), lambda digits: _kind(m, digits))


def _kind(m: Column, digits: Column) -> Column:
    area, group, serial = (m.substr(F.lit(a), F.lit(n)) for a, n in ((1, 3), (5, 2), (8, 4)))
    return (
        F.when(F.contains(m, F.lit("@")), F.lit("email"))
        .when(m.rlike(r"^(?:[0-9]{1,3}\.){3}[0-9]{1,3}$"), F.lit("ip"))
        .when(m.rlike(r"^(?:[0-9]{4}[-/][0-9]{2}[-/][0-9]{2}|[0-9]{2}[./][0-9]{2}[./][0-9]{4})$"), F.when(_date(m).isNotNull(), F.lit("date")))
        .when(m.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), F.when(~area.isin("000", "666") & (area < "900") & (group != "00") & (serial != "0000"), F.lit("ssn")))
        .when(m.rlike(r"[A-Za-z]"), F.lit("secret"))
        .when(m.rlike(r"^\+|\(") | m.rlike(r"^[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}$"), F.lit("phone"))
        .when(F.size(digits).between(13, 19), F.when(_luhn_sum(digits) % 10 == 0, F.lit("card")))
    )


def _class_of(c: Column) -> Column:
    """Struct (v, r) of a character: its place in its class and the class size; radix 1 if fixed."""
    out = F.struct(F.lit(0).alias("v"), F.lit(1).alias("r"))
    for letters in reversed(CLASSES):
        out = F.when(F.instr(F.lit(letters), c) > 0, F.struct((F.instr(F.lit(letters), c) - 1).alias("v"), F.lit(len(letters)).alias("r"))).otherwise(out)
    return out


def _pair(value: Column, radix: Column | int) -> Column:
    return F.struct(value.cast("int").alias("v"), (F.lit(radix) if isinstance(radix, int) else radix).cast("int").alias("r"))


def _template(m: Column, kind: Column) -> Column:
    """What of a candidate varies, as text: the local part, the digits after the country code, and so on."""
    return (
        F.when(kind == "email", F.substring_index(m, "@", 1))
        .when(kind == "phone", F.regexp_replace(m, r"^\+[0-9]{1,3}(?=[ .(-])", ""))
        .otherwise(m)
    )


def _numbers(m: Column, kind: Column) -> Column:
    """The free positions of a candidate, each a struct (v, r)."""
    octets = F.transform(F.split(m, r"\."), lambda o: _pair(o, 256))
    days = F.datediff(_date(m), F.lit("1900-01-01").cast("date"))
    date = F.array(_pair(F.floor(days / DATE_RADIX[1]), DATE_RADIX[0]), _pair(days % DATE_RADIX[1], DATE_RADIX[1]))
    area = F.substring(m, 1, 3).cast("int")
    ssn = F.array(_pair(area - 1 - (area > 666).cast("int"), 898), _pair(F.substring(m, 5, 2).cast("int") - 1, 99), _pair(F.substring(m, 8, 4).cast("int") - 1, 9999))
    chars = F.filter(F.transform(F.split(_template(m, kind), ""), lambda c: F.when(c == "", F.struct(F.lit(0).alias("v"), F.lit(1).alias("r"))).otherwise(_class_of(c))), lambda x: x["r"] > 1)
    return (
        F.when(kind == "ip", octets)
        .when(kind == "date", date)
        .when(kind == "ssn", ssn)
        .when(kind == "card", F.slice(chars, 1, F.size(chars) - 1))
        .otherwise(chars)
    )


def _feistel(numbers: Column, kind: Column, key: str, reverse: bool) -> Column:
    """The permuted values.  A value with one free position is one half on its own."""
    return _let(numbers, lambda bound: _rounds(bound, kind, key, reverse))


def _keyed(text: Column, key: str) -> Column:
    """HMAC with SHA-512 of a text, as hexadecimal digits."""
    raw = key.encode() if len(key.encode()) <= 128 else hashlib.sha512(key.encode()).digest()
    inner, outer = (F.lit(bytes(b ^ c for b in raw.ljust(128, b"\0"))) for c in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(text, "UTF-8")), 512))), 512)


def _rounds(numbers: Column, kind: Column, key: str, reverse: bool) -> Column:
    n = F.size(numbers)
    cut = F.floor((n + 1) / 2).cast("int")
    left, right = F.slice(numbers, 1, cut), F.slice(numbers, cut + 1, n - cut)
    sign = -1 if reverse else 1

    def turned(half: Column, other: Column, r: Column) -> Column:
        said = F.concat_ws("|", kind, n.cast("string"), r.cast("string"), F.concat_ws(",", F.transform(other, lambda x: x["v"].cast("string"))))
        parts = F.sequence(F.lit(0), F.floor((F.size(half) - 1) / PAD_VALUES).cast("int"))
        pad = F.array_join(F.transform(parts, lambda part: _keyed(F.concat_ws("|", part.cast("string"), said), key)), "")
        shift = lambda x, i, p: F.pmod(x["v"] + sign * F.conv(F.substr(p, i * 7 + 1, F.lit(7)), 16, 10).cast("long"), x["r"]).cast("int")
        return _let(pad, lambda p: F.transform(half, lambda x, i: F.struct(shift(x, i, p).alias("v"), x["r"].alias("r"))))

    order = F.reverse(F.sequence(F.lit(0), F.lit(ROUNDS - 1))) if reverse else F.sequence(F.lit(0), F.lit(ROUNDS - 1))
    step = lambda s, r: F.struct(
        F.when(r % 2 == 0, turned(s["a"], s["b"], r)).otherwise(s["a"]).alias("a"), F.when(r % 2 == 1, turned(s["b"], s["a"], r)).otherwise(s["b"]).alias("b")
    )
    return F.aggregate(order, F.struct(left.alias("a"), right.alias("b")), step, lambda s: F.transform(F.concat(s["a"], s["b"]), lambda x: x["v"]))


def _written(m: Column, kind: Column, v: Column) -> Column:
    """The candidate with its free positions set to ``v``."""
    ip = F.concat_ws(".", F.transform(v, lambda x: x.cast("string")))
    day = F.date_add(F.lit("1900-01-01").cast("date"), v[0] * DATE_RADIX[1] + v[1])
    pattern = F.when(m.rlike("^[0-9]{4}-"), "yyyy-MM-dd").when(m.rlike("^[0-9]{4}/"), "yyyy/MM/dd").when(F.contains(m, F.lit(".")), "dd.MM.yyyy").otherwise("MM/dd/yyyy")
    date = F.when(pattern == "yyyy-MM-dd", F.date_format(day, "yyyy-MM-dd")).when(pattern == "yyyy/MM/dd", F.date_format(day, "yyyy/MM/dd")).when(pattern == "dd.MM.yyyy", F.date_format(day, "dd.MM.yyyy")).otherwise(F.date_format(day, "MM/dd/yyyy"))
    area = v[0] + 1
    ssn = F.format_string("%03d-%02d-%04d", area + (area > 665).cast("int"), v[1] + 1, v[2] + 1)
    check = (F.lit(10) - _luhn_sum(F.concat(v, F.array(F.lit(0)))) % 10) % 10
    v = F.when(kind == "card", F.concat(v, F.array(check))).otherwise(v)
    template = _template(m, kind)

    def put(s: Column, c: Column) -> Column:
        value = v[s["k"]]
        out = c
        for letters in reversed(CLASSES):
            out = F.when(F.instr(F.lit(letters), c) > 0, F.substr(F.lit(letters), value + 1, F.lit(1))).otherwise(out)
        free = F.lit(False)
        for letters in CLASSES:
            free = free | (F.instr(F.lit(letters), c) > 0)
        return F.struct(F.concat(s["out"], out).alias("out"), (s["k"] + free.cast("int")).alias("k"))

    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("k"))
    chars = F.aggregate(F.filter(F.split(template, ""), lambda c: c != ""), start, put, lambda s: s["out"])
    whole = (
        F.when(kind == "email", F.concat(chars, m.substr(F.length(template) + 1, F.length(m))))
        .when(kind == "phone", F.concat(m.substr(F.lit(1), F.length(m) - F.length(template)), chars))
        .otherwise(chars)
    )
    return F.when(kind == "ip", ip).when(kind == "date", date).when(kind == "ssn", ssn).otherwise(whole)


def pseudonym(m: Column, key: str, reverse: bool = False) -> Column:
    """Struct (kind, text) of one candidate; the text is unchanged and the kind null if it isn't valid."""

    def changed(kind: Column) -> Column:
        values = _feistel(_numbers(m, kind), kind, key, reverse)
        return F.struct(kind.alias("kind"), F.when(kind.isNull(), m).otherwise(_let(values, lambda v: _written(m, kind, v))).alias("text"))

    return _let(kind_of(m), changed)


def _is(kind: str):
    return lambda k: k == kind


def pseudonymise(docs: DataFrame, key: str, text: str = "text", counts: bool = False, reverse: bool = False) -> DataFrame:
    """``docs`` with every valid candidate in ``text`` replaced by its pseudonym; all else unchanged.

    Null and empty texts stay as they are, texts of any length are read whole, and repeated
    rows get equal results.  An empty table stays empty; other columns pass through, whatever
    their names.  ``counts`` adds ``n_<kind>``, the number of values of each kind, replacing
    columns of those names.
    """
    taken = {c.lower() for c in docs.columns}
    source, hits, made = (free_name(x, taken) for x in ("__text", "__hits", "__done"))
    whole = F.col(source)
    plain = docs.withColumn(source, F.col(text)).withColumn(hits, F.regexp_extract_all(whole, F.lit(ANY), F.lit(0)))
    done = plain.withColumn(made, F.when(F.size(hits) > 0, F.transform(hits, lambda m: pseudonym(m, key, reverse))))
    pieces = F.split(whole, ANY, -1)
    joined = F.concat_ws("", F.zip_with(pieces, F.transform(made, lambda d: d["text"]), lambda p, m: F.concat(p, F.coalesce(m, F.lit("")))))
    out = done.withColumn(text, F.when(F.size(hits) > 0, joined).otherwise(whole))
    if counts:
        for kind in KINDS:
            out = out.withColumn(f"n_{kind}", F.coalesce(F.size(F.filter(F.transform(made, lambda d: d["kind"]), _is(kind))), F.lit(0)))
    return out.drop(source, hits, made)


def configured_key(spark) -> str:
    """The key of the session's setting KEY_SETTING; a demonstration key where it is unset."""
    return spark.conf.get(KEY_SETTING, None) or "isobar-demo-key"


def op4_feistel_pseudonyms(spark, sf_dir: str) -> DataFrame:
    """Every document with its pseudonymised text and the number of values of each kind; cases as in :func:`pseudonymise`."""
    return pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), configured_key(spark), counts=True)
