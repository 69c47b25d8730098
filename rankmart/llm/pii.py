"""Surrogates for personal data and secrets, all in native column expressions.

Entities (e-mail addresses, telephone and card numbers, social security numbers, IPv4 and IPv6 addresses, IBANs, access
keys, assigned secrets, names after a title or by a known given name) are found by one regular expression. Telephone
numbers are North American ones (3-3-4 with separators, or 10 digits, with or without 1) or begin with + and have 7-15
digits (where the country's length is not listed, digits close behind count to it); other national formats are not found. A secret is any value behind a keyword and = or :, so a
plain word there goes, too. Names are found by the titles and given names of a ``Names`` table, which can be replaced. Each has a
type and a core: the part that makes it the same entity in any spelling (a telephone number's digits, an
address in lower case, each part of a name). A core's surrogate follows from a keyed hash of (type, core, attempt), so
every mention in any document gets the same one. It keeps the type's form: digits stay digits and letters letters of
their case, telephone numbers keep the country and the mention's punctuation, valid card numbers stay valid,
IBANs keep the country and are valid, names keep gender, script, number of words and capitals.

Collision checks run over the distinct cores of the whole table: a surrogate that is a real core of its type, or that
two cores share, is drawn again with the next attempt (the smallest core keeps it) until none is left. Attempts
other than 0 are exceptions; they go to all tasks as one row of small maps, so texts stay where they are, up to
``BROADCAST_EXCEPTIONS``; beyond, the documents are joined with their exceptions.

Null text stays null and has no entities; null or repeated keys and repeated rows keep their rows; an empty table gives
an empty result. Columns of the input keep their names; the measures are in one struct column.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankmart.llm.common import free_name, stored, temporary, whole_text

MAX_ROUNDS = 24
BROADCAST_EXCEPTIONS = 500_000  # some 40 bytes each
PER_MAP = 4
WIDER = 4  # from this attempt on, surrogates leave their reserved range for a wider one
# fixed lists: titles by gender, given names by gender and script, syllables of invented surnames by script
TITLES = {"f": ("Mrs", "Ms", "Miss", "Frau", "Mme", "Mlle", "Señora", "Señorita", "Sra", "Srta", "Madame", "г-жа"),
          "m": ("Mr", "Herr", "Monsieur", "Señor", "Sr", "Sir", "г-н"), "u": ("Dr", "Prof")}
GIVEN = {("f", "latin"): ("Anna", "Maria", "Laura", "Emma", "Julia", "Sofia", "Clara", "Elena", "Alice", "Sarah", "Lucia", "Nina",
                          "Marta", "Eva", "Irene", "Paula", "Mary", "Patricia", "Jennifer", "Linda", "Elizabeth", "Barbara", "Susan",
                          "Jessica", "Karen", "Lisa", "Nancy", "Sandra", "Ashley", "Emily", "Kimberly", "Margaret", "Donna", "Michelle",
                          "Carol", "Amanda", "Melissa", "Deborah", "Stephanie", "Rebecca", "Sharon", "Cynthia", "Kathleen", "Amy",
                          "Angela", "Olivia", "Isabella", "Charlotte", "Sophie", "Camille", "Chloe", "Carmen", "Isabel", "Ingrid",
                          "Katharina", "Giulia", "Francesca", "Chiara"),
         ("m", "latin"): ("John", "Peter", "Paul", "David", "Thomas", "Martin", "Daniel", "Lucas", "Simon", "Victor", "Hugo", "Oscar",
                          "Felix", "Robert", "Michael", "Albert", "James", "William", "Richard", "Joseph", "Charles", "Christopher",
                          "Matthew", "Anthony", "Steven", "Andrew", "Kenneth", "Joshua", "Kevin", "Brian", "George", "Timothy", "Ronald",
                          "Edward", "Jason", "Jeffrey", "Ryan", "Jacob", "Nicholas", "Eric", "Jonathan", "Stephen", "Benjamin", "Samuel",
                          "Alexander", "Patrick", "Henry", "Pierre", "Jean", "Carlos", "Miguel", "Antonio", "Hans", "Klaus", "Stefan",
                          "Giovanni", "Marco", "Mohammed"),
         ("f", "cyrillic"): ("Анна", "Мария", "Елена", "Ольга", "Ирина", "Вера", "Нина", "Дарья"),
         ("m", "cyrillic"): ("Иван", "Пётр", "Олег", "Игорь", "Борис", "Антон", "Павел", "Роман")}
SYLLABLES = {"latin": "ba be bo da de do fa fe ka ke ko la le lo ma me mo na ne no pa pe ra re ro sa se ta te to va ve".split(),
             "cyrillic": "ба бе бо да де до ка ке ко ла ле ло ма ме мо на не но ра ре ро са се та те то ва ве".split()}

class Names(NamedTuple):
    """Titles by gender (f, m, u for either), given names by gender and script (latin, cyrillic): what names are found by,
    and what given names' surrogates are taken from."""

    titles: dict[str, tuple[str, ...]] = TITLES
    given: dict[tuple[str, str], tuple[str, ...]] = GIVEN


def names_table(rows) -> Names:
    """``Names`` from rows (kind, gender, script, word), kind being title or given; all four genders and scripts of given names are needed."""
    titles, given = {g: [] for g in "fmu"}, {k: [] for k in GIVEN}
    for kind, gender, script, word in rows:
        (titles[gender] if kind == "title" else given[gender, script]).append(word)
    if not all(given.values()):
        raise ValueError("given names are needed for both genders in both scripts: surrogates are taken from them")
    return Names({k: tuple(v) for k, v in titles.items()}, {k: tuple(v) for k, v in given.items()})


def _any(words) -> str:
    """Any of the words, by first letter, so that few are tried."""
    first: dict[str, list[str]] = {}
    for w in sorted(words, key=len, reverse=True):
        first.setdefault(w[0], []).append(re.escape(w[1:]))
    return "(?:" + "|".join(re.escape(k) + "(?:" + "|".join(v) + ")" for k, v in first.items()) + ")" if first else "(?!)"


_START = r"(?<![\p{L}\p{N}._%+\-@])"
_WORD = r"\p{Lu}\p{L}+"
_KEYWORD = r"(?i:password|passwd|passphrase|pwd|(?:secret|access|private|api)[_\- ]?key|secret|token)"
_ASSIGN = r"\s{0,3}(?:=>|:=|==?|:)\s{0,3}"
_VALUE = (r"(?:\"(?:\\.|[^\"\\\n]){1,400}(?=\")|'(?:\\.|[^'\\\n]){1,400}(?=')"
          r"|\\?[\"']?[^\s\"'\\](?:\S*[^\s.,;:!?\"'()\[\]{}<>\\])?)")
_D = r"(?:[ \u00a0\u2011.\-/]?\(?\d\)?)"
_TRUNK = r"(?:[ \u00a0]?\(0\))?"
_V4 = r"(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)"
_H = "[0-9A-Fa-f]{1,4}"
# lengths of IBANs by country
IBAN = {15: "NO", 16: "BE", 18: "DK FI FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH CR HR LI LV",
        22: "BG BH DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ DZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
        26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE",
        31: "MT SC", 32: "LC", 33: "RU"}


def pattern(names: Names) -> str:
    digits = "|".join([
        r"(?<![\p{N}+])\+?(?:\d{1,3}[ .\-])?\(\d{3}\)[ .\-]?\d{3}[ .\-]?\d{4}(?!\d)",
        r"(?<![\p{N}+.\-])(?:\+\d{1,3}[ .\-]|1[ .\-])?\d{3}[ .\-]\d{3}[ .\-]\d{4}(?![\d\-])",
        # countries with one length first, so that a number behind is not taken for more digits
        rf"(?<![\p{{L}}\p{{N}}+])\+(?:(?:[17]|44|52|91){_TRUNK}{_D}{{10}}|(?:3[134]|4[18]|61){_TRUNK}{_D}{{9}}|4[57]{_D}{{8}}|86{_D}{{11}})(?!\d)",
        rf"(?<![\p{{L}}\p{{N}}+])\+\(?\d{_D}{{6,14}}(?!\d)",
        r"(?<![\p{N}.\-])\d{3}-\d{2}-\d{4}(?![\d\-])",
        rf"(?<![\p{{N}}.]){_V4}(?![\p{{N}}]|\.\d)",
        r"(?<![\p{L}\p{N}])\d(?:[ \-]?\d){12,18}(?![\p{L}\p{N}])",
        r"(?<![\p{L}\p{N}_.+/=\-])1?[2-9]\d{2}[2-9]\d{6}(?![\p{L}\p{N}_/=\-]|\.\d)",
    ])
    v6 = "|".join([rf"(?:{_H}:){{7}}{_H}", rf"(?:{_H}:){{6}}{_V4}", rf"(?:{_H}:){{1,7}}:(?:{_H}:){{0,5}}(?:{_V4}|{_H})",
                   rf"::(?:{_H}:){{0,6}}(?:{_V4}|{_H})", rf"(?:{_H}:){{1,7}}:"])
    iban = "|".join(rf"(?:{c.replace(' ', '|')})\d{{2}}(?:[ \u00a0\-]?[A-Z0-9]){{{n - 4}}}" for n, c in IBAN.items())
    return "|".join([
        _START + r"[\p{L}\p{N}._%+\-]+@[\p{L}\p{N}\-]+(?:\.[\p{L}\p{N}\-]+)+",
        rf"(?=[pPsStTaA]){_KEYWORD}\\?[\"']?{_ASSIGN}{_VALUE}",
        r"\bAKIA[0-9A-Z]{16}\b",
        rf"(?=[0-9A-Fa-f]{{0,4}}:[0-9A-Fa-f:]*\d)(?<![\p{{L}}\p{{N}}:.])(?:{v6})(?![\p{{L}}\p{{N}}:]|\.\d)",
        rf"(?=[A-Z]{{2}}\d{{2}})(?<![\p{{L}}\p{{N}}])(?:{iban})(?![\p{{L}}\p{{N}}])",
        rf"(?=[\d+(])(?:{digits})",
        r"(?<!\p{L})" + _any(t for g in names.titles.values() for t in g) + r"\.? " + _WORD + "(?: " + _WORD + ")?",
        r"(?<!\p{L})" + _any(n for g in names.given.values() for n in g) + " " + _WORD,
    ])


NAMES = Names()
PATTERN = pattern(NAMES)
DIGIT_TYPES = ("phone", "card", "ssn")


def mentions(text: Column, names: Names = NAMES) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern(names)), F.lit(0))


def _type(m: Column) -> Column:
    return (F.when(m.rlike("^[0-9A-Fa-f:.]*:[0-9A-Fa-f:.]*$"), "ip6").when(m.rlike("[=:]"), "secret").when(m.contains("@"), "email").when(m.rlike("^AKIA[0-9A-Z]{16}$"), "key")
            .when(m.rlike(r"^\d{1,3}(?:\.\d{1,3}){3}$"), "ip").when(m.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn")
            .when(m.rlike(r"^[A-Z]{2}\d{2}"), "iban").when(m.rlike(r"\p{L}"), "name").when(m.rlike(r"^\d(?:[ \-]?\d){12,18}$"), "card").otherwise("phone"))


_SECRET_HEAD = r"^[^=:]*(?:=>|:=|==?|:)\s{0,3}\\?[\"']?"


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, r"\D+", "")


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body refers to it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _groups(m: Column) -> Column:
    """An IPv6 address with all its groups, in small letters and without leading zeros."""
    ends = F.transform(F.split(F.lower(m), "::"), lambda x: F.filter(F.split(x, ":"), lambda g: g != ""))
    left, right = F.get(ends, F.lit(0)), F.coalesce(F.get(ends, F.lit(1)), F.array().cast("array<string>"))
    zeros = F.array_repeat(F.lit("0"), F.when(m.contains("::"), F.greatest(8 - F.size(left) - F.size(right), F.lit(0))).otherwise(0))
    return F.array_join(F.transform(F.concat(left, zeros, right), lambda g: F.regexp_replace(g, "^0+(?=.)", "")), ":")


def parsed(text: Column, names: Names = NAMES) -> Column:
    """The text's mentions: array of (m, type, title, words, gender, parts), parts being (type, core) entries: one
    entry, or one for each part of a name. Built layer by layer, so that no expression is repeated."""
    def typed(m):
        return F.struct(m.alias("m"), _type(m).alias("type"))

    def titled(e):
        title = F.when(e["type"] == "name", F.regexp_extract(e["m"], rf"^({_any(t for g in names.titles.values() for t in g)}\.? )", 1))
        return F.struct(e["m"].alias("m"), e["type"].alias("type"), title.alias("title"))

    def worded(e):
        words = F.when(e["type"] == "name", F.split(F.substring(e["m"], F.length(e["title"]) + 1, F.length(e["m"])), " "))
        return F.struct(e["m"].alias("m"), e["type"].alias("type"), e["title"].alias("title"), words.alias("words"),
                        F.regexp_replace(e["title"], r"\.? $", "").alias("bare"))

    def gendered(e):
        known = lambda g: F.lower(F.get(e["words"], F.lit(0))).isin([n.lower() for s in SYLLABLES for n in names.given[(g, s)]])
        gender = (F.when(e["bare"].isin(list(names.titles["f"])), "f").when(e["bare"].isin(list(names.titles["m"])), "m").when(known("f"), "f")
                  .when(known("m"), "m").otherwise("u"))
        return F.struct(e["m"].alias("m"), e["type"].alias("type"), e["title"].alias("title"), e["words"].alias("words"), gender.alias("gender"))

    def parts(e):
        entry = lambda kind, core: F.struct(kind.alias("type"), core.alias("core"))
        given, surname = F.concat(F.lit("given_"), e["gender"]), F.lit("surname")
        word = lambda i: F.lower(F.get(e["words"], F.lit(i)))
        name = F.when(F.size(e["words"]) > 1, F.array(entry(given, word(0)), entry(surname, word(1)))).otherwise(F.array(entry(surname, word(0))))
        core = (F.when(e["type"] == "email", F.lower(e["m"])).when(e["type"] == "secret", F.regexp_replace(e["m"], _SECRET_HEAD, ""))
                .when(e["type"].isin(*DIGIT_TYPES), _digits(e["m"])).when(e["type"] == "ip6", _groups(e["m"]))
                .when(e["type"] == "iban", F.regexp_replace(e["m"], "[^A-Z0-9]+", "")).otherwise(e["m"]))
        # numbers of other countries have other lengths, and keep another country
        home = F.regexp_replace(e["m"], "[^0-9+]+", "").rlike(r"^(?:\+?1)?\d{10}$")
        kind = F.when((e["type"] == "phone") & ~home, "intl").otherwise(e["type"])
        return F.struct(e["m"].alias("m"), e["type"].alias("type"), e["title"].alias("title"), e["words"].alias("words"),
                        F.when(e["type"] == "name", name).otherwise(F.array(entry(kind, core))).alias("parts"))

    out = mentions(text, names)
    for layer in (typed, titled, worded, gendered, parts):
        out = F.transform(out, layer)
    return out


# ---------------------------------------------------------------- surrogates of cores
def _pick(seed: Column, i, alphabet: str) -> Column:
    return F.substring(F.lit(alphabet), (F.pmod(F.xxhash64(seed, i), F.lit(len(alphabet))) + 1).cast("int"), F.lit(1))


def shaped(core: Column, seed: Column) -> Column:
    """Every digit another digit, every letter another one of its case, the rest as it is."""
    return F.array_join(F.transform(F.split(core, ""), lambda c, i: F.when(c.rlike("[0-9]"), _pick(seed, i, "0123456789"))
                                    .when(c.rlike("[a-f]"), _pick(seed, i, "abcdef")).when(c.rlike("[a-z]"), _pick(seed, i, "abcdefghijklmnopqrstuvwxyz"))
                                    .when(c.rlike(r"\p{Lu}"), _pick(seed, i, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
                                    .when(c.rlike(r"[\p{L}\p{N}]"), _pick(seed, i, "abcdefghijklmnopqrstuvwxyz")).otherwise(c)), "")


def _luhn_sum(digits: Column, shift: int) -> Column:
    """Luhn sum with every second digit doubled, counted from the right; ``shift`` 1: as if one more digit followed."""
    reverse = F.split(F.reverse(digits), "")
    value = lambda c, i: F.when((i + shift) % 2 == 1, F.when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)).otherwise(
        c.cast("int"))
    return F.aggregate(F.transform(reverse, value), F.lit(0), lambda a, x: a + x)


def _from_list(seed: Column, items) -> Column:
    return F.array(*[F.lit(x) for x in items])[F.pmod(F.xxhash64(seed), F.lit(len(items))).cast("int")]


def _mod97(s: Column) -> Column:
    """Remainder of the number that digits, and letters as 10 to 35, make up."""
    step = lambda a, c: F.when(c.rlike("[0-9]"), (a * 10 + F.try_to_number(c, F.lit("9")).cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(F.split(s, ""), F.lit(0), step)


def surrogate(kind: Column, core: Column, attempt: Column, key: str, names: Names = NAMES) -> Column:
    """The surrogate's core."""
    keyed = F.sha2(F.concat_ws("|", F.lit(key), kind, core, attempt.cast("string")), 256)
    return _let(keyed, lambda seed: _from_seed(seed, kind, core, attempt >= WIDER, attempt > 0, key, names))


def _from_seed(seed: Column, kind: Column, core: Column, wide: Column, again: Column, key: str, names: Names) -> Column:
    n = F.length(core)
    digit, high = "0123456789", "23456789"
    exchange = F.when(wide, F.concat(_pick(seed, F.lit(-4), high), _pick(seed, F.lit(-5), digit), _pick(seed, F.lit(-6), digit))).otherwise("555")
    phone = F.concat(F.substring(core, F.lit(1), F.greatest(n - 10, F.lit(0))), _pick(seed, F.lit(-1), high), _pick(seed, F.lit(-2), digit),
                     _pick(seed, F.lit(-3), digit), exchange, *[_pick(seed, F.lit(-7 - i), digit) for i in range(4)])
    check = lambda body: F.pmod(F.lit(10) - F.pmod(_luhn_sum(body, 1), F.lit(10)), F.lit(10)).cast("string")
    card = _let(F.concat(F.substring(core, 1, 1), shaped(F.substring(core, F.lit(2), n - 2), seed)), lambda body: F.concat(
        body, F.when(_luhn_sum(core, 0) % 10 == 0, check(body)).otherwise(_pick(seed, F.lit(-1), digit))))
    octet = lambda i: (F.pmod(F.xxhash64(seed, F.lit(i)), F.lit(254)) + 1).cast("string")
    ip = F.concat_ws(".", F.when(wide, octet(0)).otherwise("10"), octet(1), octet(2), octet(3))
    domain = F.sha2(F.concat_ws("|", F.lit(key), F.lit("domain"), F.regexp_replace(core, "^.*@", "")), 256)
    email = F.concat(F.lit("u"), F.substring(seed, 1, 12), F.lit("@d"), F.substring(domain, 1, 8), F.lit(".example.org"))
    ssn = F.when(wide, shaped(core, seed)).otherwise(F.concat(F.lit("9"), shaped(F.substring(core, 2, 8), seed)))
    country = F.regexp_extract(core, r"^([17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})", 1)
    intl = F.concat(country, shaped(F.substring(core, F.length(country) + 1, n), seed))
    group = lambda i: F.regexp_replace(F.substring(seed, 1 + 4 * i, 4), "^0+(?=.)", "")
    ip6 = F.concat_ws(":", F.lit("2001:db8"), *[group(i) for i in range(6)])
    iban = _let(F.regexp_replace(shaped(F.upper(F.substring(core, F.lit(5), n)), seed), "[^A-Z0-9]", "0"), lambda body: F.concat(
        F.substring(core, 1, 2), F.lpad((98 - _mod97(F.concat(body, F.substring(core, 1, 2), F.lit("00")))).cast("string"), 2, "0"), body))
    # too little to draw from: longer
    few = F.length(F.regexp_replace(core, r"[^\p{L}\p{N}]+", "")) < 8
    hidden = F.concat(shaped(core, seed), F.when(wide | few, F.substring(seed, 1, 8)).otherwise(""))
    return (F.when(kind == "email", email).when(kind == "intl", intl).when(kind == "ip6", ip6).when(kind == "iban", iban)
            .when(kind == "phone", phone).when(kind == "card", card).when(kind == "ssn", ssn).when(kind == "ip", ip)
            .when(kind == "key", F.concat(F.lit("AKIA"), shaped(F.substring(core, 5, 16), seed))).when(kind == "secret", hidden)
            .when(core.rlike(r"\p{IsCyrillic}"), _name(seed, kind, wide, again, "cyrillic", "на", "н", names))
            .otherwise(_name(seed, kind, wide, again, "latin", "na", "n", names)))


def _name(seed: Column, kind: Column, wide: Column, again: Column, script: str, f_end: str, m_end: str, names: Names) -> Column:
    """A surname of invented syllables; a given name from the list of its gender, or an invented one after a collision."""
    syllable = lambda i: _from_list(F.concat(seed, F.lit(str(i))), SYLLABLES[script])
    made = F.concat(syllable(0), syllable(1), syllable(2), F.when(wide, F.concat(syllable(3), syllable(4))).otherwise(""))
    f, m = names.given[("f", script)], names.given[("m", script)]
    listed = F.when(kind == "given_f", _from_list(seed, f)).when(kind == "given_m", _from_list(seed, m)).otherwise(_from_list(seed, f + m))
    return F.when(kind == "surname", made).when(again, F.concat(made, F.when(kind == "given_f", f_end).otherwise(m_end))).otherwise(F.lower(listed))


def _filled(mention: Column, digits: Column, kind: str = "[0-9]") -> Column:
    """The mention with its digits (characters of ``kind``) replaced in order."""
    start = F.struct(F.lit("").alias("o"), F.lit(1).alias("k"))
    step = lambda a, c: F.when(c.rlike(kind), F.struct(F.concat(a["o"], F.substring(digits, a["k"], F.lit(1))).alias("o"), (a["k"] + 1).alias("k"))
                               ).otherwise(F.struct(F.concat(a["o"], c).alias("o"), a["k"].alias("k")))
    return F.aggregate(F.split(mention, ""), start, step, lambda a: a["o"])


def _cased(like: Column, word: Column) -> Column:
    return F.when(like == F.upper(like), F.upper(word)).otherwise(F.concat(F.upper(F.substring(word, 1, 1)), F.substring(word, F.lit(2), F.length(word))))


def _bucket(k: Column, n: Column) -> Column:
    return F.pmod(F.xxhash64(k), n).cast("int")


def exception_maps(odd: DataFrame) -> DataFrame | None:
    """One row: all exceptions as an array of small maps, about ``PER_MAP`` entries each, so that a look-up inside an
    expression takes a few comparisons. None if there are more than ``BROADCAST_EXCEPTIONS``."""
    n = odd.count()
    if n > BROADCAST_EXCEPTIONS:
        return None
    size = F.lit(n // PER_MAP + 1)
    told = odd.select(F.concat_ws("|", "type", "core").alias("k"), F.col("attempt"))
    maps = told.groupBy(_bucket(F.col("k"), size).cast("long").alias("b")).agg(F.collect_list(F.struct("k", "attempt")).alias("m"))
    every = odd.sparkSession.range(n // PER_MAP + 1).join(maps, F.col("id") == F.col("b"), "left")
    return every.agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "m"))), lambda x: F.map_from_entries(x["m"])).alias("_attempts"))


def drawn(e: Column, attempts: Column, key: str, names: Names = NAMES) -> Column:
    """A parsed mention with the surrogates of its parts; ``attempts``: array of maps from "type|core" to attempt, exceptions
    alone, each in the map that its hash names."""
    def attempt(x):
        return _let(F.concat_ws("|", x["type"], x["core"]), lambda k: F.coalesce(F.try_element_at(F.get(attempts, _bucket(k, F.size(attempts))), k), F.lit(0)))

    new = F.transform(e["parts"], lambda x: _let(attempt(x), lambda n: surrogate(x["type"], x["core"], n, key, names)))
    return F.struct(e["m"].alias("m"), e["type"].alias("type"), e["title"].alias("title"), e["words"].alias("words"), new.alias("new"))


def written(e: Column) -> Column:
    """What stands for a mention with drawn surrogates: (type, s)."""
    name = F.concat(e["title"], F.array_join(F.zip_with(e["words"], e["new"], _cased), " "))
    first = F.get(e["new"], F.lit(0))
    s = (F.when(e["type"] == "name", name).when(e["type"] == "secret", F.concat(F.regexp_extract(e["m"], f"({_SECRET_HEAD})", 1), first))
         .when(e["type"].isin(*DIGIT_TYPES), _filled(e["m"], first)).when(e["type"] == "iban", _filled(e["m"], first, "[0-9A-Z]")).otherwise(first))
    return F.struct(e["type"].alias("type"), s.alias("s"))


def exceptions(found: DataFrame, key: str, names: Names = NAMES) -> DataFrame:
    """(type, core, attempt > 0) for the distinct (type, core) rows of ``found`` whose surrogate collided."""
    c = F.col
    state = stored(found.withColumn("attempt", F.lit(0)).withColumn("s", surrogate(c("type"), c("core"), c("attempt"), key, names)), "surrogates")
    for _ in range(MAX_ROUNDS):
        real = found.select(c("type").alias("rt"), c("core").alias("rc"))
        used = state.groupBy("type", "s").agg(F.min(F.struct(-c("attempt"), "core")).alias("o"), F.count("*").alias("n")).where("n > 1")
        used = used.select(c("type").alias("ut"), c("s").alias("us"), c("o.core").alias("owner"))
        redo = state.join(real, (c("type") == c("rt")) & (c("s") == c("rc")), "left").join(used, (c("type") == c("ut")) & (c("s") == c("us")), "left")
        redo = redo.withColumn("again", c("rc").isNotNull() | (c("owner").isNotNull() & (c("owner") != c("core"))))
        marked = stored(redo.select("type", "core", "attempt", "s", "again"), "surrogates")
        if marked.where("again").isEmpty():
            return marked.where("attempt > 0").select("type", "core", "attempt")
        again = marked.where("again").withColumn("attempt", c("attempt") + 1)
        again = again.withColumn("s", surrogate(c("type"), c("core"), c("attempt"), key, names))
        state = stored(marked.where("NOT again").unionByName(again).select("type", "core", "attempt", "s"), "surrogates")
    raise RuntimeError(f"surrogates still collide after {MAX_ROUNDS} attempts: widen their ranges")


def replace_entities(docs: DataFrame, secret_key: str, key: str = "doc_id", text: str = "text", names: Names = NAMES) -> DataFrame:
    """``docs`` with the entities of ``text`` replaced, and a struct column ``pii`` (``_pii`` beside a column of that name): n_entities and spans (type, start and
    length in the new text, 0-based code points). ``secret_key`` keys all surrogates, ``names`` are the lists to find names by."""
    c = F.col
    with temporary(docs.sparkSession):
        all_cores = docs.select(F.explode(parsed(whole_text(text), names)).alias("m")).select(F.explode("m.parts").alias("e"))
        odd = exceptions(stored(all_cores.select("e.type", "e.core").distinct(), "entities"), secret_key, names)
        odd = stored(odd, "exceptions", keep=True)
    row = F.struct(*[docs[f"`{x}`"] for x in docs.columns]).alias("_row")
    rows = docs.select(row, docs[f"`{key}`"].alias("_key"), docs[f"`{text}`"].cast("string").alias("_text"))
    rows = rows.withColumn("_m", parsed(c("_text"), names))
    maps = exception_maps(odd)
    if maps is not None:  # texts don't move: every task has the exceptions
        rows = rows.crossJoin(F.broadcast(maps))  # one row
    else:
        told = odd.select(F.concat_ws("|", "type", "core").alias("ek"), "attempt")
        inside = rows.where(F.size("_m") > 0).select("_key", F.md5("_text").alias("_h"), F.explode("_m").alias("m"))
        inside = inside.select("_key", "_h", F.explode("m.parts").alias("e")).select("_key", "_h", F.concat_ws("|", "e.type", "e.core").alias("k")).distinct()
        per = inside.join(told, c("k") == c("ek")).groupBy("_key", "_h").agg(F.array(F.map_from_entries(F.collect_list(F.struct("k", "attempt")))).alias("_attempts"))
        per = per.select(c("_key").alias("_pk"), c("_h").alias("_ph"), "_attempts")
        rows = rows.withColumn("_h", F.md5("_text")).join(per, (c("_h") == c("_ph")) & c("_key").eqNullSafe(c("_pk")), "left")
    rows = rows.withColumn("_new", F.when(F.size("_m") > 0, F.transform(
        F.transform("_m", lambda e: drawn(e, c("_attempts"), secret_key, names)), written)))
    rows = rows.withColumn("_gaps", F.when(c("_new").isNotNull(), F.split("_text", pattern(names), -1)))
    begin = F.struct(F.get("_gaps", F.lit(0)).alias("o"), F.lit(1).alias("k"),
                     F.array().cast("array<struct<type:string,start:int,length:int>>").alias("spans"))
    step = lambda a, e: F.struct(F.concat(a["o"], e["s"], F.get(c("_gaps"), a["k"])).alias("o"), (a["k"] + 1).alias("k"),
                                 F.concat(a["spans"], F.array(F.struct(e["type"].alias("type"), F.length(a["o"]).alias("start"),
                                                                       F.length(e["s"]).alias("length")))).alias("spans"))
    rows = rows.withColumn("_done", F.when(c("_new").isNotNull(), F.aggregate("_new", begin, step)))
    rows = rows.withColumn("_out", F.coalesce(c("_done")["o"], c("_text")))
    pii = F.struct(F.coalesce(F.size(c("_done")["spans"]), F.lit(0)).cast("long").alias("n_entities"), c("_done")["spans"].alias("spans")).alias(free_name("pii", docs.columns))
    back = [c("_out").alias(x) if x == text else c("_row")[x].alias(x) for x in docs.columns]
    return rows.select(*back, pii)
