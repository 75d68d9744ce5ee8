"""Surrogates for personal data, with DataFrame functions only.

E-mail addresses, national and international phone numbers, IPv4 and IPv6
addresses, card, account (IBAN) and social security numbers, and names after a
title or with a listed given name are found by one pattern, whose matches have a
bounded length, so that time is linear in a text of any length.  What is replaced
is not the string but what it names, in one form for all its spellings: an address
in lower case, the digits of a number, each part of a name without title and case.
Every such part gets one keyed replacement of its own kind: digits for digits,
letters of the same script and kind, given names of the same gender, an address of
a reserved range or example domain; country codes and check digits stay right.  So
'Mr. John Smith', 'Mr John Smith' and 'MR Smith' share a surname, before and after.
Two parts with one replacement, or a replacement that is a part found in the
corpus, are tried again until none is left; after ``TRIES`` attempts a replacement
grows longer than what it stands for.
"""

from __future__ import annotations

import hashlib
import itertools

from pyspark.sql import Column, DataFrame, functions as F

from .common import checkpoint, release, text_or_empty

_TITLES = "Mr|Mrs|Ms|Miss|Mx|Dr|Prof|Professor|Sir|Lady|Herr|Frau|Doktor|Monsieur|Madame|Mme|Mlle|Señor|Señora|Señorita|Sr|Sra|Srta|Signor|Signora|Dott"
_NAME = r"\p{Lu}[\p{L}\p{M}]{0,40}+(?![\p{L}\p{M}])(?:['’-]\p{L}[\p{L}\p{M}]{0,40}+(?![\p{L}\p{M}])){0,4}+"
_PHONES = (
    r"\+[0-9]{1,3} ?\([0-9]{2,4}\) ?[0-9]{3}[ -][0-9]{4}",
    r"(?<![\p{L}0-9])\+1[ .-]?(?:\([0-9]{3}\)|[0-9]{3})[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9])",
    r"(?<![\p{L}0-9])\+[1-9](?=(?:[ ./()-]{0,2}[0-9]){6,14}(?![0-9]))[0-9]{0,14}+(?:[ ./-]?(?:\([0-9]{1,5}\)|[0-9]{1,14}+(?![0-9]))){0,6}+",
    r"(?<![0-9.-])(?:1[ .-])?(?:\([2-9][0-9]{2}\) ?|[2-9][0-9]{2}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])",
    r"(?<![\p{L}0-9.-])0[1-9](?:[ .-][0-9]{2}){4}(?![0-9])",
    r"(?<![\p{L}0-9.-])(?:\(0[1-9][0-9]{0,3}\) ?|0[1-9][0-9]{0,3}[ /-])(?=(?:[ -]?[0-9]){6,9}(?![0-9]))[0-9]{3,8}+(?:[ -][0-9]{2,5}+){0,3}+",
    r"(?<![\p{L}\p{M}])(?i:phone|tel|call|mobile|cell|fax)[.:]? ?[2-9][0-9]{9}(?![0-9])",  # ten digits after a word that says so
)
_GROUP = "[0-9A-Fa-f]{1,4}"
#: Countries whose account numbers are looked for, and the length of these; fixed values, ISO 13616.
IBAN = {"AT": 20, "BE": 16, "CH": 21, "CZ": 24, "DE": 22, "DK": 18, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27, "HU": 28, "IE": 22, "IT": 27, "LU": 20, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SE": 24, "SK": 24, "TR": 26}
_ACCOUNTS = [rf"{c}[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{{n // 4 - 1}}}" + (rf" ?[A-Z0-9]{{{n % 4}}}" if n % 4 else "") for c, n in IBAN.items()]
#: Given names by gender and script, in lower case; each is replaced by the next of its list in a keyed order.
GIVEN = {
    "f": "anna alice amy carmen caroline claire clara elena emily emma eva grace hannah helen ingrid isabel jane julia karen laura lea lucia maria marie mary nina olivia patricia petra rosa sarah sofia sophie susan ursula".split(),
    "m": "adam alan alexander andrew anton carlos charles daniel david dieter erik felix francis frank george hans henry james jean john jorge karl klaus luis marco mark martin michael paul peter pierre robert simon thomas victor walter".split(),
    "f-el": "αννα ελένη ιωάννα κατερίνα μαρία σοφία".split(),
    "m-el": "γιάννης γιώργος δημήτρης κώστας νίκος παύλος".split(),
    "f-ru": "анна елена ирина мария ольга татьяна".split(),
    "m-ru": "алексей андрей иван михаил николай сергей".split(),
}
#: Listed given names that are common words too; without a title they are no names.
WORDS_TOO = frozenset("grace jean mark".split())
_LISTED = "|".join(n.capitalize() for k, names in GIVEN.items() for n in names if n not in WORDS_TOO)
_SURNAME = rf"(?: \p{{Lu}}\.)?(?: (?:von|van|der|den|de|del|della|di|da|la|le|ter|zu)\b){{0,3}}"
#: Java patterns, in the order in which they are tried at a place.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]{1,63}+(?:\.[A-Za-z0-9-]{1,63}+){1,40}+",
    "phone": rf"(?:(?=[+(0-9])(?:{'|'.join(_PHONES[:-1])})|(?=[CFMPTcfmpt]){_PHONES[-1]})",  # looking at one character first is cheap
    "ip": r"(?=[0-9])(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9])(?!\.[0-9])",
    "card": r"(?=[0-9])(?<![0-9])(?:[0-9]{4}(?:[ -]?[0-9]{4}){3}(?:[ -][0-9]{3})?|[1-9][0-9]{12,18}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{4,5}|[0-9]{4}(?:[ -][0-9]{4}){2}[ -][0-9]{1,3})(?![0-9])",
    "ssn": r"(?=[0-9])(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])",
    "iban": rf"(?=[A-Z])(?<![\p{{L}}0-9])(?={'|'.join(IBAN)})(?:{'|'.join(_ACCOUNTS)})(?![\p{{L}}0-9])",
    "ipv6": rf"(?=[0-9A-Fa-f])(?<![\p{{L}}0-9:.])(?:(?:{_GROUP}:){{7}}{_GROUP}|(?=[0-9A-Fa-f]{{0,3}}[0-9])[0-9A-Fa-f]{{3,4}}(?::{_GROUP}){{0,5}}::(?:{_GROUP}(?::{_GROUP}){{0,5}})?)(?![\p{{L}}0-9:])",
    "name": rf"(?=\p{{Lu}})(?<![\p{{L}}])(?:(?:{_TITLES})\.? {_NAME}{_SURNAME}(?: {_NAME})?|(?:{_LISTED}){_SURNAME} {_NAME})",
}
#: Card numbers of this shape count as they are; those of other lengths need the right check digit.
FOUR_BY_FOUR = r"^[0-9]{4}(?:[ -]?[0-9]{4}){3}(?:[ -][0-9]{3})?$"
ENTITY = "(?:" + "|".join(PATTERNS.values()) + ")"
#: Titles that tell the gender of a given name that is in no list.
_FEMALE, _MALE = "Mrs|Ms|Miss|Lady|Frau|Madame|Mme|Mlle|Señora|Señorita|Sra|Srta|Signora", "Mr|Sir|Herr|Monsieur|Señor|Sr|Signor|Dott"
KINDS = ("0123456789", "aeiou", "bcdfghjklmnpqrstvwxyz", "AEIOU", "BCDFGHJKLMNPQRSTVWXYZ", "äöüáàâéèêëíîïóôúù", "çñß", "ÄÖÜÁÀÂÉÈÊËÍÎÏÓÔÚÙ", "αεηιουω", "βγδζθκλμνξπρστφχψ", "аеиоуыэюя", "бвгджзклмнпрстфхцчшщ")
#: For letters outside ``KINDS``: a class of letters, and what replaces them; the last takes every other letter.
CLASSES = (
    (r"[\p{IsLatin}&&\p{Lu}]", "ĀĂĄĆČĎĐĒĘĚĞĢĪĮŁŃŇŌŐŘŚŞŠŤŪŮŰŹŻŽ"), (r"\p{IsLatin}", "āăąćčďđēęěğģīįłńňōőřśşšťūůűźżž"),
    (r"[\p{IsGreek}&&\p{Lu}]", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ"), (r"\p{IsGreek}", "αβγδεζηθικλμνξοπρστυφχψω"),
    (r"[\p{IsCyrillic}&&\p{Lu}]", "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЩЭЮЯ"), (r"\p{IsCyrillic}", "абвгдежзиклмнопрстуфхцчшщэюя"),
    (r"\p{IsHan}", "王李张刘陈杨黄赵吴周徐孙马朱胡林郭何高罗"), (r"\p{IsArabic}", "ابتجحخدرزسشصعغفقكلمنهوي"), (r"\p{IsHebrew}", "אבגדהוזחטיכלמנסעפצקרשת"),
    (r"\p{Lu}", "BCDFGHJKLMNPQRSTVWXYZ"), (r"\p{L}", "bcdfghjklmnpqrstvwxyz"),
)
TRIES = 12
_TOKEN = r"\p{Lu}[\p{L}\p{M}]*+"
_TITLE = rf"^(?:{_TITLES})\.? "
_ALNUM = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _given(key: str) -> dict[str, str]:
    """A keyed cycle through each list."""
    out = {}
    for names in GIVEN.values():
        order = sorted(names, key=lambda n: hashlib.sha256(f"{key}:{n}".encode()).digest())
        out |= dict(zip(order, order[1:] + order[:1], strict=True))
    return out


def _masked(value: Column, digest: Column) -> Column:
    """Every letter and digit of ``value`` replaced by another of its kind, by the bytes of a hex digest."""
    def change(c: Column, i: Column) -> Column:
        byte = F.conv(F.substring(digest, F.pmod(i, F.lit(60)) * 2 + 1, F.lit(4)), 16, 10).cast("int")
        other = lambda kind: F.substring(F.replace(F.lit(kind), c, F.lit("")), F.pmod(byte, F.lit(len(kind) - 1)) + 1, F.lit(1))
        out = F.when(F.lit(False), c)
        for kind in KINDS:
            out = out.when(F.instr(F.lit(kind), c) > 0, other(kind))
        for letters, kind in CLASSES:
            out = out.when(c.rlike(letters), other(kind))
        return out.otherwise(c)

    return F.when(value == "", "").otherwise(F.array_join(F.transform(F.split(value, ""), change), ""))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def kind_of(value: Column) -> Column:
    out = F.when(F.instr(value, "@") > 0, "email")
    for kind in ("phone", "ip", "card", "ssn", "iban", "ipv6"):
        out = out.when(value.rlike(f"^{PATTERNS[kind]}$"), kind)
    out = out.otherwise("name")
    right = value.rlike(FOUR_BY_FOUR) | F.call_function("luhn_check", _digits(value))
    account = F.replace(value, F.lit(" "), F.lit(""))
    genuine = _mod97(F.concat(F.substring(account, 5, 40), F.substring(account, 1, 4))) == 1
    return F.when((out == "card") & ~right, "none").when((out == "iban") & ~genuine, "none").otherwise(out)


def _mod97(text: Column) -> Column:
    """Digits and capitals (A is 10, Z is 35) read as one number, modulo 97."""
    values = F.transform(F.split(text, ""), lambda c: F.instr(F.lit(_ALNUM), c) - 1)
    return F.aggregate(values, F.lit(0), lambda s, v: F.pmod(s * F.when(v < 10, 10).otherwise(100) + v, F.lit(97)))


def _parts(value: Column, kind: Column) -> Column:
    """What is replaced of an entity: an array of kind, part, gender (null: not told)."""
    one = lambda part: F.array(F.struct(kind.alias("kind"), part.alias("part"), F.lit(None).cast("string").alias("gender")))
    title = F.regexp_extract(value, r"^(\p{L}+)", 1)
    gender = F.when(title.rlike(f"^(?:{_FEMALE})$"), "f").when(title.rlike(f"^(?:{_MALE})$"), "m")
    tokens = F.regexp_extract_all(F.regexp_replace(value, _TITLE, ""), F.lit(f"({_TOKEN})"), F.lit(1))
    named = F.transform(tokens, lambda t, i: F.struct(F.lit("word").alias("kind"), F.lower(t).alias("part"), F.when((i == 0) & (F.size(tokens) > 1), gender).alias("gender")))
    return F.when(kind.isin("email", "ipv6"), one(F.lower(value))).when(kind.isin("phone", "card", "ssn"), one(_digits(value))).when(kind == "iban", one(F.replace(value, F.lit(" "), F.lit("")))).when(kind == "name", named).otherwise(one(value))


def _luhn(digits: Column) -> Column:
    """The check digit that belongs after these digits."""
    double = lambda c, i: F.when(i % 2 == 0, F.pmod(c * 2, F.lit(10)) + (c * 2 / 10).cast("int")).otherwise(c)
    values = F.transform(F.split(F.reverse(digits), ""), lambda c, i: double(c.cast("int"), i))
    return F.pmod(-F.aggregate(values, F.lit(0), lambda s, x: s + x), F.lit(10)).cast("string")


def _replaced(kind: Column, part: Column, gender: Column, attempt: Column, key: str) -> Column:
    """The replacement of a part at an attempt; later ones take more room."""
    digest = F.sha2(F.concat_ws(":", F.lit(key), kind, part, attempt.cast("string")), 512)
    more = F.when(attempt > 2, attempt.cast("string")).otherwise("")
    email = F.concat(_masked(F.substring_index(part, "@", 1), digest), more, F.lit("@"), F.substring(digest, 1, 6), F.lit(".example.org"))
    masked = _masked(part, digest)
    body = F.expr("substring(part, 1, length(part) - 1)")
    card = F.when(F.call_function("luhn_check", part), F.concat(_masked(body, digest), _luhn(_masked(body, digest)))).otherwise(masked)
    byte = lambda i, n: F.pmod(F.conv(F.substring(digest, 8 * i + 1, 6), 16, 10).cast("int"), F.lit(n))
    first = F.when(attempt < 4, F.lit(10)).when(attempt < 8, byte(3, 15) + 240).otherwise(byte(3, 223) + 1)  # private, reserved, then any
    ip = F.concat_ws(".", first.cast("string"), *[(byte(i, 254) + 1).cast("string") for i in range(3)])
    # a given name in no list ends as names of its gender do
    ends = lambda latin, greek, russian: F.when(part.rlike(r"\p{IsGreek}$"), greek).when(part.rlike(r"\p{IsCyrillic}$"), russian).otherwise(latin)
    last = F.when(gender == "f", ends("a", "α", "а")).when(gender == "m", ends("n", "ς", "н"))
    grown = F.concat(masked, F.when(attempt > 5, _masked(F.lit("ab"), digest)).otherwise(""))
    word = F.transform(F.array(grown), lambda g: F.when(last.isNotNull() & (F.length(part) > 2) & part.rlike(r"[\p{IsLatin}\p{IsGreek}\p{IsCyrillic}]$"), F.concat(F.substring(g, F.lit(1), F.length(g) - 1), last)).otherwise(g))[0]
    ssn = F.concat(F.lit("9"), F.substring(masked, 2, 8))  # no number that is given out starts so
    account, country = _masked(F.substring(part, 5, 40), digest), F.substring(part, 1, 2)
    check = F.lpad((98 - _mod97(F.concat(account, country, F.lit("00")))).cast("string"), 2, "0")
    ipv6 = F.concat_ws(":", F.lit("2001:db8"), *[F.substring(digest, 4 * i + 1, 4) for i in range(6)])
    made = F.when(kind == "email", email).when(kind == "phone", masked).when(kind == "ip", ip).when(kind == "card", card)
    made = made.when(kind == "ssn", ssn).when(kind == "iban", F.concat(country, check, account)).when(kind == "ipv6", ipv6).otherwise(word)
    tail = F.when(kind == "word", F.translate(F.substring(digest, 1, 12), "0123456789", "ghijklmnop")).otherwise(F.conv(F.substring(digest, 1, 14), 16, 10))
    return F.when(attempt < TRIES, made).otherwise(F.concat(made, tail))


def _part_surrogates(parts: DataFrame, key: str) -> DataFrame:
    """kind, part, sub of distinct parts (kind, part, gender).

    Names in the lists take each other's places.  Of other parts of one kind that
    share a replacement the first keeps it; the others, and those whose
    replacement is itself a part or a listed name, are tried again.  From
    attempt ``TRIES`` on a replacement is lengthened by a digest, so this ends.
    """
    names = _given(key)
    listed = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    known = parts.where(F.col("kind") == "none").select("kind", "part", F.col("part").alias("sub"))
    cycled = parts.where((F.col("kind") == "word") & F.col("part").isin(list(names))).select("kind", "part", listed[F.col("part")].alias("sub"))
    done = checkpoint(known.unionByName(cycled))
    todo = parts.where((F.col("kind") != "none") & ~((F.col("kind") == "word") & F.col("part").isin(list(names))))
    real = parts.select("kind", F.col("part").alias("sub"))
    for attempt in itertools.count():
        tried = todo.withColumn("sub", _replaced(F.col("kind"), F.col("part"), F.col("gender"), F.lit(attempt), key))
        first = tried.groupBy("kind", "sub").agg(F.min("part").alias("part"))
        good = first.join(real, ["kind", "sub"], "left_anti").where(~((F.col("kind") == "word") & F.col("sub").isin(list(names))))
        good = good.join(done.select("kind", "sub"), ["kind", "sub"], "left_anti")
        got = checkpoint(good.select("kind", "part", "sub"))
        done = checkpoint(done.unionByName(got))
        todo = checkpoint(todo.join(got.select("kind", "part"), ["kind", "part"], "left_anti"))
        if todo.isEmpty():
            return done


def _rendered(value: Column, kind: Column, subs: Column) -> Column:
    """The entity with its parts replaced, in its own format."""
    sub = F.get(subs, F.lit(0))

    def pour(kept: str) -> Column:
        """``sub`` in the places of the characters that are not ``kept``; what is left of it comes last."""
        place = lambda i: F.length(F.regexp_replace(F.substring(value, F.lit(1), i), kept, ""))  # noqa: E731  before the i-th character
        each = F.transform(F.split(value, ""), lambda c, i: F.when(c.rlike(kept), c).otherwise(F.substring(sub, place(i) + 1, F.lit(1))))
        return F.concat(F.array_join(each, ""), F.substring(sub, place(F.length(value)) + 1, F.length(sub)))

    poured = pour("[^0-9]")
    country = F.regexp_extract(value, r"^(\+[0-9]{1,3} ?)", 1)
    phone = F.transform(F.array(poured), lambda p: F.concat(country, F.substring(p, F.length(country) + 1, F.length(p))))[0]
    title = F.regexp_extract(value, f"({_TITLE})", 1)
    rest = F.regexp_replace(value, _TITLE, "")
    tokens = F.regexp_extract_all(rest, F.lit(f"({_TOKEN})"), F.lit(1))

    def cased(token: Column, new: Column) -> Column:
        each = F.array_join(F.zip_with(F.split(token, ""), F.split(new, ""), lambda t, n: F.when(F.upper(t) == t, F.upper(n)).otherwise(n)), "")
        same = (F.length(token) == F.length(new)) & (F.length(F.upper(new)) == F.length(new))
        whole = F.when((F.upper(token) == token) & (F.length(token) > 1), F.upper(new)).otherwise(F.concat(F.upper(F.substring(new, 1, 1)), F.substring(new, 2, 1 << 20)))
        return F.when(same, each).otherwise(whole)

    gaps = F.split(rest, _TOKEN, -1)
    name = F.array_join(F.zip_with(gaps, F.zip_with(tokens, subs, cased), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    return F.when(kind == "phone", phone).when(kind.isin("card", "ssn"), poured).when(kind == "iban", pour("[^A-Z0-9]")).when(kind == "name", F.concat(title, name)).otherwise(sub)


def surrogates(entities: DataFrame, key: str) -> DataFrame:
    """value, kind, surrogate of each distinct entity (column value).

    What only looks like a card or account number is of kind 'none' and stays.  Entities that
    name the same, in another spelling, have the same replacement in that spelling.
    """
    kinds = checkpoint(entities.select("value").distinct().withColumn("kind", kind_of(F.col("value"))))
    pieces = kinds.select("value", F.col("kind").alias("of"), F.posexplode(_parts(F.col("value"), F.col("kind"))).alias("at", "p")).select("value", "of", "at", "p.*")
    pieces = checkpoint(pieces)
    told = pieces.groupBy("kind", "part").agg(F.min("gender").alias("lo"), F.max("gender").alias("hi"))
    parts = checkpoint(told.select("kind", "part", F.when(F.col("lo") == F.col("hi"), F.col("lo")).alias("gender")))
    subs = _part_surrogates(parts, key)
    lists = pieces.select("value", "of", "at", "kind", "part").join(subs, ["kind", "part"]).groupBy("value", "of").agg(F.array_sort(F.collect_list(F.struct("at", "sub"))).alias("s"))
    out = checkpoint(lists.select("value", F.col("of").alias("kind"), _rendered(F.col("value"), F.col("of"), F.col("s.sub")).alias("surrogate")))
    release(pieces, parts)
    return out


def with_surrogates(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, text (replaced), n_entities, and n_<kind> for each kind of ``PATTERNS``.

    ``key`` is a secret of the caller: who has it can make the same replacements.
    A null text becomes empty; a null id stays null; repeated rows are replaced
    alike; other columns are not looked at; an empty table gives an empty result.
    A very long text is replaced whole, in linear time.  Where patterns overlap the
    leftmost match counts, and of those at one place the first of ``PATTERNS``.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    found = rows.select("text", F.regexp_extract_all("text", F.lit(f"({ENTITY})"), F.lit(1)).alias("found")).where(F.size("found") > 0)
    entities = checkpoint(found.select(F.sha2("text", 256).alias("sha"), "found").dropDuplicates(["sha"]))
    flat = entities.select("sha", F.posexplode("found").alias("at", "value"))
    mapped = flat.join(surrogates(flat, key), "value")
    # written before the join, so that a text with many copies is split there
    lists = checkpoint(mapped.groupBy("sha").agg(F.array_sort(F.collect_list(F.struct("at", "surrogate", "kind"))).alias("e")))
    # always merged: a broadcast of few lists would make a small table's plan another one than a large table's
    joined = rows.withColumn("sha", F.sha2("text", 256)).join(lists.hint("merge"), "sha", "left")
    gaps = F.split("text", ENTITY, -1)
    new = F.array_join(F.zip_with(gaps, F.col("e.surrogate"), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    count = lambda k: F.coalesce(F.size(F.filter("e", lambda x: x["kind"] == k)), F.lit(0)).cast("long")
    has = F.col("e").isNotNull()
    return joined.select(
        "doc_id",
        F.when(has, new).otherwise(F.col("text")).alias("text"),
        F.when(has, F.size(F.filter("e", lambda x: x["kind"] != "none"))).otherwise(0).cast("long").alias("n_entities"),
        *[F.when(has, count(k)).otherwise(F.lit(0).cast("long")).alias(f"n_{k}") for k in PATTERNS],
    )
