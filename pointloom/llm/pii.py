"""Surrogates for personal data: keyed, of the same type, gender, script and format, distinct, and the same everywhere.

One pattern finds all types; the text is the pieces between the matches with each match replaced. Every match has
canonical entities (an address in lower case, the digits of a number, each word of a name) and each entity one
surrogate in the whole table, so all spellings and mentions of an entity agree: "Mrs Anna Schmidt", "Frau
Schmidt" and "Dr Anna Schmidt" keep one surname and one given name.

A surrogate is a keyed permutation of the entity's format class, so different entities of a class differ by
construction, also where a class is full: letters stay letters of their script, kind (vowel or consonant) and
case, digits stay digits, hex stays hex, separators stay. The permutation is a Feistel network over the
characters; sha256(key, type, attempt, round, other half) gives the shifts. Given names of the lists go to names of
the same list, that is of the same gender and script; other words of names keep their last letter, which carries
gender in many languages. Domains are permuted likewise below a reserved ending; addresses keep valid octets; card
numbers their first digit and IBANs their country, both with valid check digits if the original has valid ones; phone
numbers keep their country code. Names without title are found behind a given name of the lists. Particles (von, de la) and
prefixes with an apostrophe (O', d') stay; initials are replaced like words. The permutation can be undone by whoever has the
key, which therefore has no default.

Collision check: the distinct entities of the whole table form a table of their own. Where two share a surrogate, or
a surrogate is an original entity of its type, all but the first go on with the next attempt, until none is
left: after a few attempts each further one makes the format a character longer, so a full class cannot hold it up.
Attempts above 0 are few and are joined back to the texts that hold their entities.

Defined results: null text stays null; a null doc_id is kept as null; repeated rows are changed alike; an empty
table gives no rows; all other columns stay as they are, whatever their names.
"""

from __future__ import annotations

import hashlib
import random
import secrets
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import written
from ._text import let

# Titles by gender, given names by script and gender, particles, country codes, letters by script and kind.
TITLES = {
    "m": ["Mr", "Herr", "Monsieur", "Señor", "Signor", "Господин"],
    "f": ["Mrs", "Ms", "Miss", "Frau", "Madame", "Señora", "Signora", "Госпожа"],
    "n": ["Dr", "Prof", "Доктор"],
}
GIVEN = {
    ("latin", "m"): "Adam Alan Andrew Anthony Boris Brian Carl Carlos Charles Daniel David Diego Edward Erik Felix Fernando George Giovanni Hans Henri Henry Ivan Jacques James Jean John Jonas Jorge Joseph José Juan Jürgen Karl Kevin Klaus Leon Luca Luis Marco Martin Matthew Michael Miguel Nils Oscar Otto Paolo Paul Pedro Peter Philipp Pierre Ralph Richard Robert Simon Stefan Steven Thomas Tobias Victor Walter Werner William Wolfgang".split(),
    ("latin", "f"): "Alice Amélie Anna Barbara Berta Birgit Carmen Catherine Chiara Claire Clara Diana Elena Elisabeth Elizabeth Ella Emma Flora Giulia Greta Hannah Heidi Helen Inés Irene Isabel Jennifer Jessica Julia Karen Katharina Laura Linda Lucía Margaret Maria Marie Mary Monika Nancy Nora Olga Patricia Paula Petra Rosa Sabine Sandra Sara Sarah Sofia Sophie Susan Susanne Teresa Tina Ursula Vera Wilma".split(),
    ("latin", "n"): "Alex Andrea Chris Dana Dominique Gabriel Jamie Kim Lee Robin Sam Sascha Taylor Toni".split(),
    ("cyrillic", "m"): "Александр Алексей Андрей Антон Борис Виктор Владимир Глеб Денис Дмитрий Егор Иван Кирилл Максим Михаил Николай Олег Павел Роман Сергей".split(),
    ("cyrillic", "f"): "Алла Анна Вера Галина Дарья Екатерина Елена Ирина Мария Наталья Нина Ольга Полина Светлана Татьяна Юлия".split(),
    ("cyrillic", "n"): "Валя Женя Паша Саша Слава Шура".split(),
}
PARTICLES = "von van de der den la le del della di da du dos das el al bin ibn zu zum zur ter ten af av".split()
#: Country codes of one and of two digits; all others have three.
CODES = r"[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]"
LETTERS = ["aeiouy", "bcdfghjklmnpqrstvwxz", "àáâãäåæèéêëìíîïòóôõöøùúûüý", "çñšžčćďłńňřśťź", "аеёиоуыэюя", "бвгджзйклмнпрстфхцчшщ", "αεηιουω", "άέήίόύώ", "βγδζθκλμνξπρστφχψ"]
DIGITS, LOWER, UPPER, HEX, MARKS = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789abcdef", "!#$%&()*+-./:<=>?@[]^_`{|}~"
CYRILLIC = "абвгдежзиклмнопрстуфхцчшэюя"

#: The setting that holds the key.
SECRET = "spark.pointloom.pii.secret"
#: Attempts in the format of the original; each further one makes it a character longer.
SAME_FORMAT = 4
ROUNDS = 4

_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
_TITLE = "(?:" + "|".join(sorted({x for ts in TITLES.values() for t in ts for x in (t, t.upper())}, key=lambda x: (-len(x), x))) + ")"
_PARTICLE = "(?:" + "|".join(PARTICLES) + ")"
# A word of a name: a capital and more letters, each with its marks, perhaps behind O' or d'; and what may stand in front of one.
_NAME = r"(?:\p{L}{1,4}['’])?\p{Lu}\p{M}*[\p{L}\p{M}]+"
_BEFORE = rf"(?:{_PARTICLE} |\p{{Lu}}\. ?)*"
# Words that are replaced: not the particles, nor what stands before an apostrophe.
_WORD = rf"(?<![\p{{L}}\p{{M}}])(?!{_PARTICLE}(?![\p{{L}}\p{{M}}])|\p{{L}}{{1,4}}['’]\p{{Lu}})[\p{{L}}\p{{M}}]+"
_FIRST = "".join(sorted({t[0] for ts in TITLES.values() for t in ts}))


def _by_initial(names: list[str]) -> str:
    """A pattern of these names that tries only those of the same first letter."""
    groups: dict[str, list[str]] = {}
    for x in sorted(names, key=lambda x: (-len(x), x)):
        groups.setdefault(x[0], []).append(x[1:])
    return "(?:" + "|".join(f"{a}(?:{'|'.join(rest)})" for a, rest in sorted(groups.items())) + ")"


_GIVEN = _by_initial([x for xs in GIVEN.values() for x in xs])
PATTERNS = {
    "name": rf"(?<!\p{{L}})(?=\p{{Lu}}\p{{L}})(?:{_TITLE}\.? {_BEFORE}{_NAME}(?:[ -]{_BEFORE}{_NAME}){{0,2}}|{_GIVEN}(?![\p{{L}}\p{{M}}])(?:[ -]{_BEFORE}{_NAME}){{1,2}})",
    "email": r"[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "access_key": r"AKIA[0-9A-Z]{16}(?![0-9A-Za-z])",
    "iban": r"[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}| [A-Z0-9]{4}(?: (?=[A-Z]{0,3}\d)[A-Z0-9]{4}){2,6}(?: \d[A-Z0-9]{0,2})?)(?![0-9A-Za-z])",
    "ip": rf"(?<!\.){_OCTET}(?:\.{_OCTET}){{3}}(?![0-9]|\.[0-9])",
    "ssn": r"(?<![-])\d{3}-\d{2}-\d{4}(?![0-9A-Za-z-])",
    "phone": r"\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}(?!\d)|\(\d{3}\) ?\d{3}[.-]\d{4}(?![0-9A-Za-z]|[.-]\d)|(?<![.-])\d{3}(?:-\d{3}-|\.\d{3}\.)\d{4}(?![0-9A-Za-z]|[.-]\d)",
    "card": r"(?<![.+])(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3})(?![0-9A-Za-z])",
    "secret": r"(?i:token|password|passwd|secret|api[_-]?key)[\x22']?\s{0,2}[=:]\s{0,2}[\x22']?[^\s\x22',;]{8,}",
    "hex": r"[0-9a-f]{32,128}(?![0-9A-Za-z])",
}
#: Nothing begins inside a word, which the first test tells at most places.
PATTERN = "(?<![0-9A-Za-z])(?:" + "|".join(f"(?:{p})" for p in PATTERNS.values()) + ")"
#: What a text must hold for any of the patterns to match; cheap to test.
GATE = rf"[0-9@=:]|AKIA|[a-f]{{32}}|(?=[{_FIRST}]){_TITLE}\.? \p{{L}}|(?<!\p{{L}})(?=\p{{Lu}}\p{{L}}){_GIVEN}[ -]\p{{L}}"


def found(text: Column) -> Column:
    return F.when(text.rlike(GATE), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))).otherwise(F.expr("cast(array() as array<string>)"))


def kind(m: Column) -> Column:
    tests = {"email": "^[^@ ]+@[^@ ]+$", "access_key": "^AKIA[0-9A-Z]{16}$", "ip": rf"^{_OCTET}(?:\.{_OCTET}){{3}}$", "ssn": r"^\d{3}-\d{2}-\d{4}$", "phone": r"^(?:\+|\(\d{3}\)|\d{3}[.-]\d{3}[.-])[0-9 ().-]*$", "card": r"^[0-9 -]{13,19}$", "iban": r"^[A-Z]{2}\d{2} ?[A-Z0-9][A-Z0-9 ]{10,40}$", "name": r"^\p{Lu}[\p{L}\p{M}]*\.?[ -][\p{L}\p{M}.'’ -]*$"}
    out = F.when(m.rlike(tests.pop("email")), "email")
    for name, test in tests.items():
        out = out.when(m.rlike(test), name)
    return out.otherwise("secret")


# ---- entities of a match ------------------------------------------------------------------------


def _label(m: Column) -> Column:
    """What stands before the value of a named secret; empty for other matches."""
    return F.regexp_extract(m, r"^(?i:token|password|passwd|secret|api[_-]?key)[\x22']?\s{0,2}[=:]\s{0,2}[\x22']?", 0)


def _title(m: Column) -> Column:
    return F.regexp_extract(m, rf"^{_TITLE}\.? ", 0)


def _words(m: Column) -> Column:
    """The words of a name behind its title."""
    return F.regexp_extract_all(F.substring(m, F.length(_title(m)) + 1, F.length(m)), F.lit(_WORD), F.lit(0))


def canonical(m: Column, k: Column) -> Column:
    """One text for all spellings of the entity of a match that is no name."""
    digits = F.regexp_replace(m, r"[ ().-]", "")
    octets = F.array_join(F.transform(F.split(m, r"\."), lambda x: x.cast("int").cast("string")), ".")
    return F.when(k == "email", F.lower(m)).when((k == "phone") & ~m.startswith("+"), F.concat(F.lit("+1"), digits)).when(k.isin("phone", "card", "iban"), digits).when(k == "ip", octets).otherwise(F.substring(m, F.length(_label(m)) + 1, F.length(m)))


def entities_of(m: Column, k: Column) -> Column:
    """The canonical entities of a match: the words of a name in lower case, else one."""
    return F.when(k == "name", F.transform(_words(m), F.lower)).otherwise(F.array(canonical(m, k)))


# ---- permutations of format classes -------------------------------------------------------------


def _shifted(c: Column, by: Column, alphabets: Column) -> Column:
    """The character ``by`` places on in its alphabet, around its end; any other character as it is."""
    own = F.get(F.filter(alphabets, lambda a: F.call_function("instr", a, c) > 0), F.lit(0))
    return let(own, lambda a: F.when(a.isNull(), c).otherwise(F.substring(a, (F.pmod(F.call_function("instr", a, c) - 1 + by, F.length(a)) + 1).cast("int"), F.lit(1))))


def _mixed(part: Column, other: Column, seed: Column, alphabets: Column) -> Column:
    """Each character of a half shifted in its alphabet by what the seed and the other half tell."""
    chars = F.transform(F.sequence(F.lit(1), F.length(part)), lambda i: F.struct(F.substring(part, i, F.lit(1)).alias("c"), i.alias("i")))
    one = lambda h: F.array_join(F.transform(chars, lambda x: _shifted(x["c"], F.pmod(F.xxhash64(h, x["i"]), F.lit(1 << 30)).cast("int"), alphabets)), "")
    return F.when(part == "", part).otherwise(let(F.sha2(F.concat_ws("|", seed, other), 256), one))


def permuted(value: Column, seed: Column, alphabets: Column) -> Column:
    """A keyed permutation of all texts with the same kinds of characters (of an array of alphabets) at the same places: ``ROUNDS`` rounds of a Feistel network; an even number puts the halves back in place."""

    def run(v: Column) -> Column:
        half = F.floor(F.length(v) / 2).cast("int")
        start = F.struct(F.substring(v, F.lit(1), half).alias("a"), F.substring(v, half + 1, F.length(v)).alias("b"))
        turn = lambda s, r: F.struct(s["b"].alias("a"), _mixed(s["a"], s["b"], F.concat_ws("|", seed, r.cast("string")), alphabets).alias("b"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn, lambda s: F.concat(s["a"], s["b"]))

    return let(value, run)


def _drawn(alphabet: str, seed: Column, at: Column) -> Column:
    return F.substring(F.lit(alphabet), (F.pmod(F.xxhash64(seed, at), F.lit(len(alphabet))) + 1).cast("int"), F.lit(1))


def _luhn(digits: Column) -> Column:
    """Check sum modulo 10 of a digit string, its last digit being the check digit."""
    n = F.length(digits)

    def value(i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        double = 2 * d
        return F.when((n - i) % 2 == 1, F.when(double > 9, double - 9).otherwise(double)).otherwise(d)

    return F.pmod(F.aggregate(F.transform(F.sequence(F.lit(1), n), value), F.lit(0), lambda a, x: a + x), F.lit(10))


def _card(digits: Column, new: Column) -> Column:
    """First digit kept, the new body, and a check digit as far from the right one as the original's."""
    right = lambda b: F.pmod(10 - _luhn(F.concat(b, F.lit("0"))), F.lit(10))
    last = F.substring(digits, -1, 1).cast("int")
    return let(F.concat(F.substring(digits, F.lit(1), F.lit(1)), new), lambda b: F.concat(b, F.pmod(last - right(F.substring(digits, F.lit(1), F.length(digits) - 1)) + right(b), F.lit(10)).cast("int").cast("string")))


def _mod97(text: Column) -> Column:
    """The number that letters (A is 10) and digits make, modulo 97."""
    value = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    chars = F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: value(F.substring(text, i, F.lit(1))))
    return F.aggregate(chars, F.lit(0), lambda a, v: ((a * F.when(v > 9, 100).otherwise(10) + v) % 97).cast("int"))


def _iban(x: Column, new: Column) -> Column:
    """Country kept, the new account, and check digits as far from the right ones as the original's."""
    country, check, account = F.substring(x, F.lit(1), F.lit(2)), F.substring(x, F.lit(3), F.lit(2)).cast("int"), F.substring(x, F.lit(5), F.length(x))
    right = lambda a: 98 - _mod97(F.concat(a, country, F.lit("00")))
    return let(new, lambda a: F.concat(country, F.lpad(F.pmod(check - right(account) + right(a), F.lit(100)).cast("int").cast("string"), 2, "0"), a))


def _is_hex(v: Column) -> Column:
    return v.rlike("^[0-9a-f]+$") & v.rlike("[a-f]")


def _given(key: str) -> dict[str, str]:
    """Each given name of the lists, in lower case, to another of its list: a keyed cycle through it."""
    out: dict[str, str] = {}
    for (script, gender), names in GIVEN.items():
        order = [x.lower() for x in names]
        random.Random(hashlib.sha256(f"{key}|{script}|{gender}".encode()).hexdigest()).shuffle(order)
        out.update(zip(order, [*order[1:], order[0]], strict=True))
    return out


_GIVEN_WORDS = {x.lower() for xs in GIVEN.values() for x in xs}


def is_given(word: Column) -> Column:
    return word.isin(sorted(_GIVEN_WORDS))


def twin(x: Column, k: Column, attempt: Column, key: str) -> Column:
    """The surrogate of a canonical entity, itself canonical. What is to be permuted is laid out by kind first, so that the permutation is one expression for all kinds."""
    pairs = F.create_map(*[F.lit(v) for pair in sorted(_given(key).items()) for v in pair])
    sets = lambda *a: F.array(*map(F.lit, a))
    behind = lambda v, n: F.substring(v, n + 1 if isinstance(n, Column) else F.lit(n + 1), F.length(v))
    length = F.length(x)
    code = F.length(F.regexp_extract(x, rf"^\+(?:{CODES}|\d{{1,3}})", 0))
    domain = F.substring_index(x, "@", -1)
    # Domains lie below a reserved ending that tells all the rest, so that different domains differ.
    reserved, top = F.regexp_extract(domain, r"\.example\.(?:com|net|org)$", 0), F.substring_index(domain, ".", -1)
    label = F.when(reserved != "", F.substring(domain, F.lit(1), F.length(domain) - F.length(reserved))).otherwise(F.substring(domain, F.lit(1), F.length(domain) - F.length(top) - 1))
    end = F.when(reserved != "", reserved).otherwise(F.concat(F.lit("."), top, F.lit(".example")))
    bytes_ = F.array_join(F.transform(F.split(x, r"\."), lambda o: F.lower(F.lpad(F.hex(o.cast("int")), 2, "0"))), "")
    cut = F.when(length > 3, length - 1).otherwise(length)
    body = (
        F.when(k == "email", F.substring_index(x, "@", 1)).when(k == "name", F.substring(x, F.lit(1), cut)).when(k == "ip", F.when(k == "ip", bytes_)).when(k == "card", F.substring(x, F.lit(2), length - 2))
        .when(k.isin("iban", "access_key"), behind(x, 4)).when(k == "phone", behind(x, code)).otherwise(x)
    )
    alphabets = (
        F.when(k == "email", sets(DIGITS, LOWER)).when(k == "name", sets(*LETTERS)).when((k == "ip") | ((k == "secret") & _is_hex(x)), sets(HEX)).when(k.isin("iban", "access_key"), sets(DIGITS, UPPER))
        .when(k == "secret", sets(DIGITS, LOWER, UPPER, MARKS)).otherwise(sets(DIGITS))
    )

    def of(seed: Column) -> Column:
        more = F.greatest(F.lit(0), attempt - (SAME_FORMAT - 1)).cast("int")
        mine = F.when(k == "email", F.concat_ws("|", seed, domain)).otherwise(seed)
        part = lambda v, s, a: F.struct(v.alias("v"), s.alias("s"), a.alias("a"))
        parts = F.when(k == "email", F.array(part(body, mine, alphabets), part(label, F.lit(f"{key}|domain"), alphabets))).otherwise(F.array(part(body, mine, alphabets)))
        # Hex walks on while it has lost its letters, so that hex goes to hex one to one.
        walks = (k == "secret") & _is_hex(x)
        done = F.transform(parts, lambda p: F.aggregate(F.sequence(F.lit(1), F.lit(9)), p["v"], lambda v, i: F.when((i == 1) | (walks & ~_is_hex(v)), permuted(v, p["s"], p["a"])).otherwise(v)))

        def finished(r: Column) -> Column:
            first = F.get(r, F.lit(0))
            # Letters without an alphabet here are drawn, and the collision check parts what meets.
            drawn = lambda v, all_of: F.array_join(F.transform(F.sequence(F.lit(1), F.length(v)), lambda i: F.when(F.substring(v, i, F.lit(1)).rlike(r"\p{IsCyrillic}"), _drawn(CYRILLIC, F.concat_ws("|", seed, x), i)).when(all_of | F.substring(v, i, F.lit(1)).rlike(r"[^\x00-\x7F]"), _drawn(LOWER, F.concat_ws("|", seed, x), i)).otherwise(F.substring(v, i, F.lit(1)))), "")
            known = "[" + "".join(LETTERS) + "]"
            foreign = ((k == "name") & ~x.rlike(known)) | ((k == "secret") & x.rlike(r"[^\x00-\x7F]"))
            word = F.when(foreign, drawn(F.when(k == "name", x).otherwise(first), k == "name")).when((k == "name") & (length > 3), F.concat(first, F.substring(x, -1, 1))).otherwise(first)
            letters = F.when((k == "name") & x.rlike(r"\p{IsCyrillic}"), CYRILLIC).when(k.isin("name", "email"), LOWER).when(k == "access_key", UPPER).when(k.isin("ip", "secret"), HEX).otherwise(DIGITS)
            tail = F.array_join(F.transform(F.sequence(F.lit(1), F.when(k == "ip", 2 * more).otherwise(more)), lambda i: F.substring(letters, (F.pmod(F.xxhash64(F.concat_ws("|", mine, word), i), F.length(letters)) + 1).cast("int"), F.lit(1))), "")
            new = F.when(more > 0, F.concat(word, tail)).otherwise(word)
            octets = lambda h: F.array_join(F.transform(F.sequence(F.lit(1), F.length(h), F.lit(2)), lambda i: F.conv(F.substring(h, i, F.lit(2)), 16, 10)), ".")
            return let(new, lambda n: (
                F.when(k == "email", F.concat(n, F.lit("@"), F.get(r, F.lit(1)), end)).when((k == "name") & is_given(x), F.element_at(pairs, x)).when(k == "ip", octets(n)).when(k == "card", _card(x, n))
                .when(k == "iban", _iban(x, n)).when(k == "phone", F.concat(F.substring(x, F.lit(1), code), n)).when(k == "access_key", F.concat(F.substring(x, F.lit(1), F.lit(4)), n)).otherwise(n)
            ))

        return let(done, finished)

    return let(F.concat_ws("|", F.lit(key), k, attempt.cast("string")), of)


# ---- spelling -----------------------------------------------------------------------------------


def _cased(new: Column, like: Column) -> Column:
    """``new`` with capitals where ``like`` has them; behind its end as all of ``like`` is."""
    upper = let(F.upper(like) == like, lambda whole: F.array_join(F.transform(F.split(new, ""), lambda c, i: F.when(F.when(i < F.length(like), F.substring(like, i + 1, F.lit(1)).rlike(r"\p{Lu}")).otherwise(whole & (F.length(like) > 1)), F.upper(c)).otherwise(c)), ""))
    return F.when(F.lower(like) == like, new).otherwise(upper)


def _spaced(new: Column, like: Column, missing: Column) -> Column:
    """The letters and digits of ``new`` behind the first ``missing`` of them, at the places of those of ``like``; what is left over follows."""

    def run(compact: Column) -> Column:
        count = lambda i: F.length(F.regexp_replace(F.substring(like, F.lit(1), i), "[^0-9A-Za-z]", ""))
        one = lambda i: let(F.substring(like, i, F.lit(1)), lambda c: F.when(c.rlike("[0-9A-Za-z]"), F.substring(compact, (count(i) + missing).cast("int"), F.lit(1))).otherwise(c))
        rest = F.substring(compact, (count(F.length(like)) + missing + 1).cast("int"), F.length(compact))
        return F.concat(F.array_join(F.transform(F.sequence(F.lit(1), F.length(like)), one), ""), rest)

    return let(F.regexp_replace(new, "[^0-9A-Za-z]", ""), run)


def spelled(m: Column, k: Column, twins: Column) -> Column:
    """The surrogates of a match's entities in the spelling of the match."""
    first = F.get(twins, F.lit(0))
    national = F.when((k == "phone") & ~m.startswith("+"), 1).otherwise(0)
    behind = F.substring(m, F.length(_title(m)) + 1, F.length(m))
    names = F.zip_with(F.zip_with(_words(m), twins, lambda w, t: _cased(t, w)), F.split(behind, _WORD, -1), lambda a, b: F.concat(b, F.coalesce(a, F.lit(""))))
    # The text before the first word is empty, so piece j stands before word j.
    return (
        F.when(k == "name", F.concat(_title(m), F.array_join(names, ""))).when(k == "email", F.concat(_cased(F.substring_index(first, "@", 1), F.substring_index(m, "@", 1)), F.lit("@"), F.substring_index(first, "@", -1)))
        .when(k.isin("phone", "card", "iban"), _spaced(first, m, national)).when(k.isin("ip", "ssn", "access_key"), first).otherwise(F.concat(_label(m), first))
    )


# ---- the whole table ----------------------------------------------------------------------------

Draw = Callable[[Column, Column, Column], Column]


def mentions(docs: DataFrame) -> DataFrame:
    """h (of the text), m: each match of each different text once."""
    each = docs.select(F.xxhash64("text").alias("h"), found(F.col("text")).alias("ms")).where(F.size("ms") > 0)
    return each.select("h", F.explode(F.array_distinct("ms")).alias("m")).distinct()


def entities(mentioned: DataFrame) -> DataFrame:
    """kind, entity (canonical): each once, over the whole table, but for the given names of the lists, whose surrogates are fixed."""
    each = mentioned.select("m").distinct().withColumn("kind", kind(F.col("m")))
    out = each.select("kind", F.explode(entities_of(F.col("m"), F.col("kind"))).alias("entity")).distinct()
    return out.where(~((F.col("kind") == "name") & is_given(F.col("entity"))))


def resolve(known: DataFrame, draw: Draw) -> DataFrame:
    """kind, entity, attempt, surrogate: surrogates of a kind are distinct and none is an entity of it or, of a name, a given name of the lists."""
    accepted: DataFrame | None = None
    pending, attempt = known, 0
    originals = known.select("kind", F.col("entity").alias("surrogate"))
    while True:
        drawn = written(pending.withColumn("surrogate", draw(F.col("entity"), F.col("kind"), F.lit(attempt))), "surrogates")
        first = drawn.groupBy("kind", "surrogate").agg(F.min("entity").alias("entity")).where(~((F.col("kind") == "name") & is_given(F.col("surrogate"))))
        free = first.join(originals, ["kind", "surrogate"], "left_anti")
        if accepted is not None:
            free = free.join(accepted, ["kind", "surrogate"], "left_anti")
        won = written(free.select("kind", "entity", F.lit(attempt).alias("attempt"), "surrogate"), "accepted")
        accepted = won if accepted is None else accepted.unionByName(won)
        pending = drawn.select("kind", "entity").join(won, ["kind", "entity"], "left_anti")
        attempt += 1
        if pending.isEmpty():
            return accepted


def key_of(spark: SparkSession) -> str:
    """The secret of the configuration (``spark.pointloom.pii.secret``), or else one drawn for this session, with which nothing can be undone or repeated later."""
    context = spark.sparkContext
    given = spark.conf.get(SECRET, None)
    if not given:
        given = context.__dict__.setdefault("_pointloom_pii_key", secrets.token_hex(32))
    return given


def pseudonymise(docs: DataFrame, key: str, draw: Draw | None = None, count: str | None = "n_entities") -> DataFrame:
    """docs with the entities in ``text`` replaced; other columns stay. The number of matches goes to a column ``count`` (with ``_`` behind it as often as it is taken); none if that is None."""
    if not key:
        raise ValueError("surrogates need a secret key")
    draw = draw or (lambda x, k, attempt: twin(x, k, attempt, key))
    taken = {c.lower() for c in docs.columns}
    while count and count.lower() in taken:
        count += "_"
    mentioned = written(mentions(docs.select("text")), "mentions")
    again = resolve(entities(mentioned), draw).where("attempt > 0").select("kind", "entity", "attempt")
    rows = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), F.col("text"), found(F.col("text")).alias("matches"))
    tag = lambda k, x: F.concat(k, F.lit(":"), x)
    attempt_of = lambda k, x: F.lit(0)
    if not again.isEmpty():
        each = mentioned.withColumn("kind", kind(F.col("m"))).select("h", "kind", F.explode(entities_of(F.col("m"), F.col("kind"))).alias("entity"))
        # One small map for each text that holds an entity with a further attempt.
        of_text = each.join(again, ["kind", "entity"]).groupBy("h").agg(F.map_from_entries(F.collect_set(F.struct(tag(F.col("kind"), F.col("entity")), "attempt"))).alias("attempts"))
        rows = rows.withColumn("h", F.when(F.size("matches") > 0, F.xxhash64("text"))).join(of_text, "h", "left")
        attempt_of = lambda k, x: F.coalesce(F.try_element_at(F.col("attempts"), tag(k, x)), F.lit(0))
    twins = lambda m, k: F.transform(entities_of(m, k), lambda x: draw(x, k, attempt_of(k, x)))
    new = F.transform("matches", lambda m: let(kind(m), lambda k: let(twins(m, k), lambda t: spelled(m, k, t))))
    parts = F.zip_with(F.split("text", PATTERN, -1), new, lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))
    text = F.when(F.size("matches") > 0, F.array_join(F.flatten(parts), "")).otherwise(F.col("text"))
    done = rows.select("row", text.alias("changed"), F.size("matches").cast("long").alias("count"))
    return done.select(*[(F.col("changed") if c.lower() == "text" else F.col(f"row.`{c}`")).alias(c) for c in docs.columns], *([F.col("count").alias(count)] if count else []))
