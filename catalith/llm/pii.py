r"""Format-preserving Feistel pseudonyms for personal data, as SQL expressions.

Every recognised and validated value is replaced by another valid value of its own
format, chosen by a keyed permutation of that format.  Equal values become equal
pseudonyms in every document (links survive), different ones stay different, and whoever
holds the key can undo it.

==========  =============================  ============================================
kind        recognised when                permuted
==========  =============================  ============================================
card        13-19 digits, Luhn valid       digits between the first and the check digit;
                                           the check digit is computed anew
phone       +1 (ddd) ddd-dddd and the      all digits after the country code
            like; + and 8-15 digits; ddd-ddd-dddd
ssn         ddd-dd-dddd, valid ranges      area, group and serial within valid ranges
ip          four numbers of 0-255          all 32 bits
date        yyyy-mm-dd, yyyy/mm/dd,        the day in that range
            mm/dd/yyyy, dd.mm.yyyy, a real
            day in 1900-01-01..2100-01-01
email       name@domain                    letters and digits of the name by class
token       hex secret after the name of   all hex digits; with capitals: capitals, small
            one and = or :                 letters and digits each among themselves
==========  =============================  ============================================

Strings use a Feistel network of ``ROUNDS`` rounds on two halves whose characters move
within their class (digit, small, capital, ...); numbers use an unbalanced network on
(value div b, value mod b) with additions modulo the two sizes, so no value ever leaves
its range.  Round functions are SHA-256 of key, kind, round and the other half.

Validation decides before anything changes: a 16-digit number that fails its checksum, or
2023-02-30, stays as it is.

Numbers side by side are taken as one run of groups of digits, which ends before any other
value.  Cards in a run are looked for at all borders of groups, in this order: a group of its
own, the usual groupings, the whole run, the lengths of an issuer by any grouping (14 to 16
digits, then others); what then remains is tested in pieces of up to 19 digits.

Only documents that hold a match pay more than one scan; there is no shuffle.

Defined results: null text stays null; texts without a match are returned unchanged;
texts are searched whole, however long; repeated rows are treated alike; an empty table gives
an empty result; input columns named like an output column are replaced.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalith.llm.names import sheltered

ROUNDS = 8
CARD = r"(?<![\d.])\d(?:[ -]?\d){12,18}(?![\d])"
PHONE_US = r"(?<![\w+])\+1[ .-]?(?:\(\d{3}\)|\d{3})[ .-]?\d{3}[ .-]?\d{4}(?!\d)"
PHONE_ABROAD = r"(?<![\w+])\+(?=[2-9](?:[ .()-]{0,2}\d){7,14}(?!\d))\d{1,15}+(?:[ .-]?(?:\(\d{1,4}\)|\d{1,12}+))*+(?!\d)"
PHONE_LOCAL = r"(?<![\w+.-])(?:\(\d{3}\) ?\d{3}[ .-]|\d{3}(?:-\d{3}-|\.\d{3}\.| \d{3}-))\d{4}(?![\d-]|\.\d)"
#: Three groups of digits between spaces are a phone only where no other number stands beside them.
PHONE_SPACED = r"(?<![\w+.-])(?<!\d )\d{3} \d{3} \d{4}(?![ .-]?\d)"
PHONE = f"{PHONE_US}|{PHONE_ABROAD}|{PHONE_LOCAL}|{PHONE_SPACED}"
SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
IP = r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?![\d]|\.\d)"
DATE = (
    r"(?<![\d-])(?:19|20|21)\d\d-\d\d-\d\d(?![\d-])|(?<![\d/])(?:19|20|21)\d\d/\d\d/\d\d(?![\d/])"
    r"|(?<![\d/])\d{1,2}/\d{1,2}/(?:19|20|21)\d\d(?![\d/])|(?<![\d.])\d{1,2}\.\d{1,2}\.(?:19|20|21)\d\d(?!\d|\.\d)"
)
EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
SECRET = "token|secret|passw(?:or)?d|api[ _-]?key|access[ _-]?key|secret[ _-]?key|private[ _-]?key"
TOKEN = rf"""(?i)(?<![0-9a-z])(?=[0-9a-f]{{16}})(?<=(?:{SECRET})["']?\s{{0,3}}[=:]\s{{0,3}}["']?)[0-9a-f]{{16,}}+(?![0-9a-z])"""
#: Groups of digits side by side, 13 digits at least unless another value ends them earlier.
RUN = rf"(?<![\d.])(?=\d(?:[ -]?\d){{12}})\d{{1,19}}+(?!\d)(?:(?: (?!{EMAIL}|{PHONE_LOCAL}|{DATE}|{SSN})|-)(?!{IP})\d{{1,19}}+(?!\d))*+"
#: First match wins from left to right; at one place the first alternative does.
ANY = "|".join(f"(?:{p})" for p in (EMAIL, PHONE, DATE, SSN, IP, TOKEN, RUN))
#: A cheap test that holds wherever ``ANY`` can match.
HINT = r"@|\d\d\d|\d\.\d{1,3}\.\d|\d[ -]\d|\d[./]\d|(?i:token|secret|passw|key)"
#: Groupings that cards are printed in, and numbers that an issuer could give: of 14 to 16 digits, of others.
GROUPED = r"^(?:\d{4}([ -])\d{4}\1\d{4}\1\d{4}|\d{4}([ -])\d{6}\2\d{4,5})$"
ISSUED = r"^(?:(?:4|5[1-5]|2[2-7]|35|6)(?=\d{14,15}$)\d*(?<=^\d{16})|3[47]\d{13}|3[0689]\d{12})$"
ISSUED_RARE = r"^(?:4\d{12}|(?:4|6)\d{18}|62\d{15,16})$"
KINDS = ["email", "phone", "date", "ssn", "ip", "card", "token"]

#: Character classes as (first code point, size): digits, small, capital, Latin-1 small and capital letters.
CLASSES = [(48, 10), (97, 26), (65, 26), (0xE0, 23), (0xC0, 23)]
HEX = "0123456789abcdef"
#: Classes of a token that holds capital letters: its capitals, small letters and digits stay where they are.
HEX_CLASSES = [(48, 10), (97, 6), (65, 6)]


def _letter_runs() -> list[tuple[int, int]]:
    """Runs of neighbouring letters and numerals outside ``CLASSES``, as (first code point, size)."""
    known = {c for first, size in CLASSES for c in range(first, first + size)}
    runs: list[tuple[int, int]] = []
    for c in range(128, 0x32400):
        if unicodedata.category(chr(c))[0] in "LN" and c not in known:
            if runs and sum(runs[-1]) == c:
                runs[-1] = (runs[-1][0], runs[-1][1] + 1)
            else:
                runs.append((c, 1))
    return runs


#: ``_letter_runs`` as two lists of numbers; Spark folds them to literals.
RUN_FIRST, RUN_SIZE = (",".join(map(str, x)) for x in zip(*_letter_runs(), strict=True))
#: Country codes of one and two digits; the others have three.
COUNTRY = r"^(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
DAYS, DAY_LEFT, DAY_RIGHT = 73050, 150, 487
EPOCH = "1900-01-01"


def _hash(key: str, kind: str, n: Column, other: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), n.cast("string"), other.cast("string")), 256)


def _number(digest: Column, at: int = 1, digits: int = 12) -> Column:
    return F.conv(F.substring(digest, at, digits), 16, 10).cast("long")


def permute_pair(key: str, kind: str, left: Column, right: Column, a: int, b: int) -> Column:
    """Keyed permutation of (left, right) in [0, a) x [0, b), as a struct (l, r)."""
    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))
    turn = lambda s, i: F.when(
        i % 2 == 0, F.struct(((s["l"] + _number(_hash(key, kind, i, s["r"]))) % a).alias("l"), s["r"].alias("r"))
    ).otherwise(F.struct(s["l"].alias("l"), ((s["r"] + _number(_hash(key, kind, i, s["l"]))) % b).alias("r")))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn)


def _shift_class(ch: Column, by: Column, classes: list[tuple[int, int]] | None) -> Column:
    """A character moved within its class; without ``classes`` the hexadecimal digits are one."""
    if classes is None:
        place = F.instr(F.lit(HEX), ch) - 1
        return F.when(ch.rlike("[a-f0-9]"), F.substring(F.lit(HEX), ((place + by) % 16 + 1).cast("int"), F.lit(1))).otherwise(ch)
    code = F.ascii(ch)
    out = F.when(code >= 128, _shift_letter(ch, by)).otherwise(ch)
    for first, size in reversed(classes):
        out = F.when((code >= first) & (code < first + size), _char((code - first + by) % size + first)).otherwise(out)
    return out


def _shift_letter(ch: Column, by: Column) -> Column:
    """A letter of ``_letter_runs`` moved within its run; any other character stays."""
    code = F.conv(F.hex(F.encode(ch, "UTF-32")), 16, 10).cast("int")
    numbers = lambda x: F.split(F.lit(x), ",").cast("array<int>")
    runs = F.arrays_zip(numbers(RUN_FIRST).alias("first"), numbers(RUN_SIZE).alias("size"))
    own = F.get(F.filter(runs, lambda r: (r["first"] <= code) & (code < r["first"] + r["size"])), F.lit(0))
    moved = F.decode(F.unhex(F.lpad(F.hex(((code - own["first"] + by) % own["size"] + own["first"]).cast("long")), 8, "0")), "UTF-32")
    return F.coalesce(moved, ch)


def _char(code: Column) -> Column:
    # chr() reaches 255, which covers the classes above
    return F.char(code.cast("long"))


def _stream(key: str, kind: str, half: Column, i: Column, other: Column, classes: list[tuple[int, int]] | None) -> Column:
    """``half`` with each character moved by a key stream made from ``other``."""
    chars = F.filter(F.split(half, ""), lambda x: x != "")
    seed = _hash(key, kind, i, other)
    moved = F.transform(chars, lambda ch, j: _shift_class(ch, _number(F.sha2(F.concat(seed, j.cast("string")), 256), 1, 8), classes))
    return F.array_join(moved, "")


def permute_string(key: str, kind: str, value: Column, classes: list[tuple[int, int]] | None = CLASSES) -> Column:
    """Keyed permutation of the strings with ``value``'s character classes."""
    cut = F.floor(F.length(value) / 2).cast("int")
    start = F.struct(F.substring(value, F.lit(1), cut).alias("l"), F.substring(value, cut + 1, F.length(value)).alias("r"))
    turn = lambda s, i: F.when(
        i % 2 == 0, F.struct(_stream(key, kind, s["l"], i, s["r"], classes).alias("l"), s["r"].alias("r"))
    ).otherwise(F.struct(s["l"].alias("l"), _stream(key, kind, s["r"], i, s["l"], classes).alias("r")))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn, lambda s: F.concat(s["l"], s["r"]))


def _luhn_sum(digits: Column, shift: int) -> Column:
    """Luhn sum of a digit string; ``shift`` 0 if its last digit is the check digit, 1 if that is to come."""
    chars = F.filter(F.split(F.reverse(digits), ""), lambda x: x != "")
    one = lambda ch, i: F.when((i + shift) % 2 == 1, ch.cast("int") * 2 - F.when(ch.cast("int") > 4, 9).otherwise(0)).otherwise(ch.cast("int"))
    return F.aggregate(F.transform(chars, one), F.lit(0), lambda a, x: a + x)


def luhn_valid(digits: Column) -> Column:
    return _luhn_sum(digits, 0) % 10 == 0


def _refill(shape: Column, digits: Column) -> Column:
    """The digits of ``shape`` replaced in order by ``digits``; separators stay."""
    chars = F.filter(F.split(shape, ""), lambda x: x != "")
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))
    turn = lambda s, ch: F.when(
        ch.rlike("[0-9]"), F.struct(F.concat(s["out"], F.substring(digits, s["at"], F.lit(1))).alias("out"), (s["at"] + 1).alias("at"))
    ).otherwise(F.struct(F.concat(s["out"], ch).alias("out"), s["at"].alias("at")))
    return F.aggregate(chars, start, turn, lambda s: s["out"])


def _only_digits(v: Column) -> Column:
    return F.regexp_replace(v, r"[^0-9]+", "")


def _card(key: str, v: Column) -> Column:
    d = _only_digits(v)
    body = F.concat(F.substring(d, 1, 1), permute_string(key, "card", F.substring(d, F.lit(2), F.length(d) - 2)))
    return _refill(v, F.concat(body, ((10 - _luhn_sum(body, 1) % 10) % 10).cast("string")))


def _phone(key: str, v: Column) -> Column:
    d = _only_digits(v)
    fixed = F.when(v.startswith("+"), F.length(F.regexp_extract(d, COUNTRY, 0))).otherwise(0)
    return _refill(v, F.concat(F.substring(d, F.lit(1), fixed), permute_string(key, "phone", F.substring(d, fixed + 1, F.length(d)))))


def _ip(key: str, v: Column) -> Column:
    o = F.split(v, r"\.")
    n = lambda i: F.get(o, F.lit(i)).cast("long")
    p = permute_pair(key, "ip", n(0) * 256 + n(1), n(2) * 256 + n(3), 65536, 65536)
    octets = lambda x: F.concat_ws(".", F.floor(x / 256).cast("string"), (x % 256).cast("string"))
    return F.concat_ws(".", octets(p["l"]), octets(p["r"]))


def _ssn(key: str, v: Column) -> Column:
    part = F.split(v, "-")
    area, group, serial = (F.get(part, F.lit(i)).cast("long") for i in range(3))
    area = area - F.when(area > 666, 2).otherwise(1)
    p = permute_pair(key, "ssn", area * 99 + group - 1, serial - 1, 898 * 99, 9999)
    new = F.floor(p["l"] / 99)
    new = new + F.when(new >= 665, 2).otherwise(1)
    return F.format_string("%03d-%02d-%04d", new, p["l"] % 99 + 1, p["r"] + 1)


def _day(v: Column) -> Column:
    """Days from ``EPOCH`` to a match of ``DATE``; null if there is no such day."""
    part = F.split(v, "[./-]")
    two = lambda i: F.lpad(F.get(part, F.lit(i)), 2, "0")
    iso = F.when(v.rlike(r"^\d{4}"), F.translate(v, "/", "-")).when(v.contains("."), F.concat_ws("-", F.get(part, F.lit(2)), two(1), two(0)))
    iso = iso.otherwise(F.concat_ws("-", F.get(part, F.lit(2)), two(0), two(1)))
    return F.datediff(F.try_to_timestamp(iso, F.lit("yyyy-MM-dd")).cast("date"), F.lit(EPOCH).cast("date"))


def _date(key: str, v: Column) -> Column:
    n = _day(v)
    p = permute_pair(key, "date", F.floor(n / DAY_RIGHT), n % DAY_RIGHT, DAY_LEFT, DAY_RIGHT)
    day = F.date_add(F.lit(EPOCH).cast("date"), (p["l"] * DAY_RIGHT + p["r"]).cast("int"))
    short = v.rlike(r"(?:^|[./])\d[./]")
    return (
        F.when(v.contains("-"), F.date_format(day, "yyyy-MM-dd"))
        .when(v.rlike(r"^\d{4}"), F.date_format(day, "yyyy/MM/dd"))
        .when(v.contains("."), F.when(short, F.date_format(day, "d.M.yyyy")).otherwise(F.date_format(day, "dd.MM.yyyy")))
        .otherwise(F.when(short, F.date_format(day, "M/d/yyyy")).otherwise(F.date_format(day, "MM/dd/yyyy")))
    )


def _email(key: str, v: Column) -> Column:
    return F.concat(permute_string(key, "email", F.substring_index(v, "@", 1)), F.lit("@"), F.substring_index(v, "@", -1))


def classify(v: Column) -> Column:
    """The kind of a match of ``ANY`` that is valid in its format; null if it isn't."""
    octets = F.split(v, r"\.")
    whole = lambda p: v.rlike(f"^(?:{p})$")
    area = F.substring(v, 1, 3)
    return (
        F.when(v.contains("@"), F.lit("email"))
        .when(v.startswith("+") | whole(f"{PHONE_LOCAL}|{PHONE_SPACED}"), F.lit("phone"))
        .when(whole(DATE), F.when(_day(v).between(0, DAYS - 1), F.lit("date")))
        .when(whole(r"\d{3}-\d{2}-\d{4}"), F.when(~area.isin("000", "666") & (area < "900") & (F.substring(v, 5, 2) != "00") & (F.substring(v, 8, 4) != "0000"), F.lit("ssn")))
        .when(whole(r"(?:\d{1,3}\.){3}\d{1,3}"), F.when(F.forall(octets, lambda o: o.cast("int") <= 255), F.lit("ip")))
        .when(whole(r"[0-9A-Fa-f]{16,}"), F.lit("token"))
    )


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _piece(kind: Column, original: Column) -> Column:
    return F.struct(kind.cast("string").alias("kind"), original.alias("original"))


def _bare(span: Column) -> Column:
    return F.regexp_replace(span, "^[ -]", "")


def _card_spans(g: Column) -> Column:
    """Valid cards that don't overlap among the groups ``g``, as (rank, i, n): groups i to i + n - 1, from 0."""

    def rank(span: Column, whole: Column) -> Column:
        d = _only_digits(span)
        form = (
            F.when(span.rlike(r"^\d+$"), 0)
            .when(span.rlike(GROUPED), 1)
            .when(whole, 2)
            .when(d.rlike(ISSUED), 3)
            .when(d.rlike(ISSUED_RARE), 4)
        )
        return F.when(F.length(d).between(13, 19) & form.isNotNull(), F.when(luhn_valid(d), form))

    def at(i: Column) -> Column:
        upto = lambda n: _bare(F.array_join(F.slice(g, i + 1, n), ""))
        one = lambda n: F.struct(rank(upto(n), n == F.size(g)).alias("rank"), i.alias("i"), n.alias("n"))
        return F.transform(F.sequence(F.lit(1), F.least(F.lit(19), F.size(g) - i)), one)

    spans = F.flatten(F.transform(F.sequence(F.lit(0), F.size(g) - 1), at))
    valid = F.array_sort(F.filter(spans, lambda s: s["rank"].isNotNull()))
    none = F.array().cast("array<struct<rank:int,i:int,n:int>>")
    taken = lambda chosen, s: F.exists(chosen, lambda c: (s["i"] < c["i"] + c["n"]) & (c["i"] < s["i"] + s["n"]))
    return F.aggregate(valid, none, lambda chosen, s: F.when(taken(chosen, s), chosen).otherwise(F.concat(chosen, F.array(s))))


def _remainder(v: Column) -> Column:
    """Pieces of ``v``, each 13 to 19 digits tested once from left to right."""
    gaps, found = F.split(v, CARD, -1), F.regexp_extract_all(v, F.lit(CARD), F.lit(0))
    card = lambda x: _piece(F.when(luhn_valid(_only_digits(x)), F.lit("card")), x)
    both = lambda gap, x: F.when(x.isNull(), F.array(_piece(F.lit(None), gap))).otherwise(F.array(_piece(F.lit(None), gap), card(x)))
    return F.flatten(F.zip_with(gaps, found, both))


def cards(run: Column) -> Column:
    """A run of digits cut into (kind, original): cards, and what lies between them without a kind."""
    groups = F.regexp_extract_all(run, F.lit(r"[ -]?\d+"), F.lit(0))

    def cut(g: Column, chosen: Column) -> Column:
        text = lambda i, n: F.array_join(F.slice(g, i + 1, n), "")
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<kind:string,original:string>>").alias("out"))

        def turn(s: Column, c: Column) -> Column:
            span = text(c["i"], c["n"])
            ahead = F.concat(text(s["at"], c["i"] - s["at"]), F.regexp_extract(span, "^[ -]?", 0))
            return F.struct((c["i"] + c["n"]).alias("at"), F.concat(s["out"], F.array(_piece(F.lit(None), ahead), _piece(F.lit("card"), _bare(span)))).alias("out"))

        rest = lambda s: F.concat(s["out"], F.array(_piece(F.lit(None), text(s["at"], F.size(g) - s["at"]))))
        by_place = F.array_sort(F.transform(chosen, lambda c: F.struct(c["i"].alias("i"), c["n"].alias("n"))))
        return F.aggregate(by_place, start, turn, rest)

    pieces = _let(groups, lambda g: cut(g, _card_spans(g)))
    return F.flatten(F.transform(pieces, lambda x: F.when(x["kind"].isNull(), _remainder(x["original"])).otherwise(F.array(x))))


def parts(v: Column) -> Column:
    """A match of ``ANY`` as an array of (kind, original); only a run of digits has more than one."""
    kind = classify(v)
    run = v.rlike(r"^\d[\d -]*$") & ~v.rlike(rf"^(?:{DATE}|{SSN}|{PHONE_LOCAL}|{PHONE_SPACED}|\d{{20,}})$")
    return F.when(run, cards(v)).otherwise(F.array(_piece(kind, v)))


def pseudonym(kind: Column, v: Column, key: str) -> Column:
    """The pseudonym of a value of ``kind``; values of no kind stay."""
    token = F.when(v.rlike("[A-F]"), permute_string(key, "token", v, HEX_CLASSES)).otherwise(permute_string(key, "token", v, None))
    return (
        F.when(kind == "email", _email(key, v))
        .when(kind == "phone", _phone(key, v))
        .when(kind == "date", _date(key, v))
        .when(kind == "ssn", _ssn(key, v))
        .when(kind == "ip", _ip(key, v))
        .when(kind == "card", _card(key, v))
        .when(kind == "token", token)
        .otherwise(v)
    )


def pseudonymise(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``df`` with ``text`` pseudonymised and ``pii``, an array of (kind, original, pseudonym).

    The originals in ``pii`` are for auditing and for those who may see them; drop the
    column before publishing.  Input columns named ``pii``, or with a name that begins with an
    underscore, may be replaced; :func:`pseudonymise_documents` keeps all.
    """
    found = df.withColumn("_found", F.when(F.col(text).rlike(HINT), F.regexp_extract_all(F.col(text), F.lit(ANY), F.lit(0))))
    hit = F.size(F.coalesce("_found", F.array().cast("array<string>"))) > 0
    found = found.withColumn("_kinds", F.when(hit, F.transform("_found", parts)))
    named = lambda x: F.struct(x["kind"].alias("kind"), x["original"].alias("original"), pseudonym(x["kind"], x["original"], key).alias("pseudonym"))
    found = found.withColumn("_named", F.when(hit, F.transform("_kinds", lambda xs: F.transform(xs, named))))
    gaps = F.split(F.col(text), ANY, -1)
    joined = F.concat(F.array_join(F.zip_with(gaps, "_named", lambda g, xs: F.concat(g, F.coalesce(F.array_join(xs["pseudonym"], ""), F.lit("")))), ""))
    out = found.withColumn("_new", F.when(hit, joined).otherwise(F.col(text)))
    valid = F.filter(F.coalesce(F.flatten("_named"), F.array().cast("array<struct<kind:string,original:string,pseudonym:string>>")), lambda x: x["kind"].isNotNull())
    return out.withColumn("pii", valid).withColumn(text, F.col("_new")).drop("_found", "_kinds", "_named", "_new")


def pseudonymise_documents(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``df`` with ``text`` pseudonymised and nothing else changed, whatever its columns are called."""
    return sheltered(df, lambda d, name: pseudonymise(d, key, name(text)))
