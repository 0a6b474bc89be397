"""Replacement of personal data by keyed surrogates, from SQL functions alone.

Detected: e-mail addresses, phone, card, social-security and bank account
numbers, IPv4 addresses, and names after a title. The same entity gets the
same surrogate everywhere, whatever its spelling (case, separators, country
code); different entities get different ones. Digit strings pass a keyed
Feistel network, which is one to one; cards keep their first digit and
whether their check digit is right; letters and names come from a keyed hash,
and a global check for collisions over all distinct entities, which sends
only counts to the driver, widens them until there is none, or fails. A bank
account number keeps its country, its letters and whether its check digits are
right. Separators, country code, title, gender, script, top-level domain and
words all in capitals stay as they are.

A person is named by a title (as listed or in capitals), initials if any, and
one or two words, and then, in the same text, by any of these words without the
title: "Mr. John Smith", "John Smith", "Mr. Smith" and "Smith" get one surname.
A word that the text has in small letters, too, is left where it stands alone
at the beginning of a sentence. A domain has up to 127 labels. Surnames are keyed by themselves, given
names by themselves and the gender that a title in the text tells for them. A
word that stands alone after a title somewhere in the text counts as a
surname there.

Texts are rewritten in the row; only distinct entities are shuffled, and
those are combined first.

Edge cases: a null text stays null; texts without entities are unchanged to
the byte; repeated rows get equal results; an empty table gives no rows; all
columns are kept whatever their names, but for an n_entities of the caller. A
text is searched for each word of its own names wherever a capital starts a
word; a capitalised word that follows a name by chance counts as part of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.common import cut

# Titles by gender, and names to choose from.
FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Mme", "Madame", "Mlle", "Sra", "Señora")
MALE = ("Mr", "Herr", "Monsieur", "Sr", "Señor")
NEUTRAL = ("Dr", "Prof")
FEMALE_NAMES = ("Ada", "Clara", "Elena", "Greta", "Irene", "Julia", "Laura", "Marta", "Nora", "Olga", "Petra", "Rosa", "Sofia", "Vera", "Wilma", "Zoe")
MALE_NAMES = ("Adam", "Bruno", "Carl", "Emil", "Felix", "Georg", "Hugo", "Ivan", "Jonas", "Karl", "Leo", "Max", "Otto", "Paul", "Rolf", "Tom")
NEUTRAL_NAMES = ("Alex", "Andrea", "Chris", "Dominique", "Eli", "Jules", "Kim", "Lou", "Luca", "Maxime", "Noa", "Robin", "Sam", "Sascha", "Toni", "Yael")
SYLLABLES = ("ba", "den", "dor", "fel", "gan", "har", "kel", "lan", "len", "mar", "mon", "nor", "ran", "ros", "tal", "vin")
CYRILLIC_SYLLABLES = ("ба", "ден", "дор", "фел", "ган", "хар", "кел", "лан", "лен", "мар", "мон", "нор", "ран", "рос", "тал", "вин")

_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
#: A word of a name, without the ending of a genitive.
#: Repeated groups are possessive or bounded throughout: the engine keeps a place on its stack for each round of others.
_WORD = r"\p{Lu}(?:\p{L}++|['’-](?!s(?!\p{L}))(?=\p{L}))++"
_INITIALS = r"(?:(?:\p{Lu}\.){1,4}\x20){0,3}"
_TITLES = "|".join(x for t in FEMALE + MALE + NEUTRAL for x in (t, t.upper()))
# Patterns by kind; the first that matches at a place counts.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++){0,126}\.[A-Za-z]{2,}",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![0-9A-Za-z])",
    "card": r"(?<![0-9A-Za-z.+-])(?:[0-9]{4}(?:[\x20-]?[0-9]{4}){3}|[0-9]{4}[\x20-]?[0-9]{6}[\x20-]?[0-9]{5})(?![0-9A-Za-z])",
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "ip": rf"(?<![0-9.])(?:{_OCTET}\.){{3}}{_OCTET}(?![0-9]|\.[0-9])",
    "phone": r"(?<![0-9A-Za-z])\+[0-9]{1,3}(?:[\x20.-]?\(?[0-9]{2,4}\)?){2,5}(?![0-9A-Za-z])|(?<![0-9A-Za-z.+-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z])",
    "name": rf"(?<!\p{{L}})(?:{_TITLES})\.?\x20{_INITIALS}{_WORD}(?:\x20{_WORD})?",
}
ANY = "|".join(PATTERNS.values())
TITLED = rf"(?<!\p{{L}})(?:{_TITLES})\.?\x20\p{{Lu}}"
#: A text without any of these has no entity.
HINT = r"@|[0-9][0-9\x20().-]{5}|[0-9]\.[0-9]|[A-Z]{2}[0-9]{2}|" + TITLED
ROUNDS = 6
#: Surrogates are made longer up to so many times, as far as a hash has digits; an error follows.
MOST_WIDE = 14


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _number(seed: Column, digits: int) -> Column:
    """A keyed number of so many hexadecimal digits."""
    return F.conv(F.substring(F.sha2(seed, 256), 1, digits), 16, 10).cast("bigint")


def _feistel(key: str, tweak: str, digits: Column) -> Column:
    """A keyed permutation of the digit strings of each length."""
    # Halves may differ in length: they change in turn, without being swapped.
    half = F.floor(F.length(digits) / 2).cast("int")

    def modulus(n: Column) -> Column:
        return F.pow(F.lit(10.0), n).cast("bigint")

    def rounds(n: Column) -> Column:
        m = F.length(digits) - n
        start = F.struct(F.substring(digits, F.lit(1), n).alias("a"), F.substring(digits, n + 1, m).alias("b"))

        def step(acc: Column, i: Column) -> Column:
            from_a = _number(F.concat(F.lit(f"{key}|{tweak}|"), F.length(digits).cast("string"), F.lit("|"), i.cast("string"), F.lit("|"), F.when(i % 2 == 0, acc["a"]).otherwise(acc["b"])), 13)
            new_b = F.lpad(F.pmod(acc["b"].cast("bigint") + from_a, modulus(m)).cast("string"), m, "0")
            new_a = F.lpad(F.pmod(acc["a"].cast("bigint") + from_a, modulus(n)).cast("string"), n, "0")
            return F.struct(F.when(i % 2 == 0, acc["a"]).otherwise(new_a).alias("a"), F.when(i % 2 == 0, new_b).otherwise(acc["b"]).alias("b"))

        return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda acc: F.concat(acc["a"], acc["b"]))

    return F.when(F.length(digits) > 1, _let(half, rounds)).otherwise(digits)


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _fill(form: Column, digits: Column) -> Column:
    """form with its digits replaced, in order, by others."""
    seen = lambda i: F.length(_digits(F.substring(form, F.lit(1), i)))
    char = lambda i: F.substring(form, i, F.lit(1))
    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(form)), lambda i: F.when(char(i).rlike("[0-9]"), F.substring(digits, seen(i), F.lit(1))).otherwise(char(i))), "")


def _check_digit(body: Column) -> Column:
    """The digit that makes a card number right."""
    def value(i: Column) -> Column:
        d = F.substring(body, i, F.lit(1)).cast("int")
        twice = d * 2
        return F.when((F.length(body) - i) % 2 == 0, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)

    total = F.aggregate(F.sequence(F.lit(1), F.length(body)), F.lit(0), lambda acc, i: acc + value(i))
    return F.pmod(-total, F.lit(10))


def _check97(body: Column, country: Column) -> Column:
    """The two digits that make a bank account number right; letters count as 10 to 35."""
    def step(acc: Column, i: Column) -> Column:
        c = F.substring(F.concat(body, country, F.lit("00")), i, F.lit(1))
        return F.when(c.rlike("[0-9]"), acc * 10 + c.try_cast("int")).otherwise(acc * 100 + F.ascii(c) - 55) % 97

    return F.lit(98) - F.aggregate(F.sequence(F.lit(1), F.length(body) + 4), F.lit(0), lambda acc, i: step(acc, i).cast("int"))


def _letters(seed: Column, n: int) -> Column:
    return F.translate(F.substring(F.sha2(seed, 256), 1, min(64, n)), "0123456789abcdef", "bcdfghjkmnpqrstv")


def _syllables(seed: Column, n: int, of: tuple[str, ...]) -> Column:
    hexes = F.substring(F.sha2(seed, 256), 1, min(64, n))
    table = F.array(*map(F.lit, of))
    return F.initcap(F.array_join(F.transform(F.sequence(F.lit(1), F.lit(min(64, n))), lambda i: F.element_at(table, F.conv(F.substring(hexes, i, F.lit(1)), 16, 10).cast("int") + 1)), ""))


def kind_of(m: Column) -> Column:
    """The kind of a match, by its own form."""
    title = rf"^(?:{_TITLES})\.?\x20"
    return (
        F.when(F.contains(m, F.lit("@")), "email")
        .when(m.rlike(title), "name")
        .when(m.rlike(r"^\p{Lu}[\p{L}'’\x20-]+$"), "bare")
        .when(m.rlike(r"^[A-Z]{2}[0-9]{2}"), "iban")
        .when(m.rlike(r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}$"), "ip")
        .when(m.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), "ssn")
        .when(m.rlike(r"^[+(]") | (F.length(_digits(m)) < 13), "phone")
        .otherwise("card")
    )


def canonical(m: Column, kind: Column) -> Column:
    """Equal for the same entity."""
    d = _digits(m)
    return (
        F.when(kind == "email", F.lower(m))
        .when(kind == "phone", F.when(F.length(d) > 10, F.substring(d, -10, 10)).otherwise(d))
        .when(kind == "iban", F.regexp_replace(m, r"\x20", ""))
        .when(kind == "ip", m)
        .otherwise(d)
    )


def replaced(m: Column, kind: Column, key: str, widen: int) -> Column:
    """The surrogate, in the form of the match."""
    d = _digits(m)

    def phone() -> Column:
        tail = F.least(F.length(d), F.lit(10))
        return _fill(m, F.concat(F.substring(d, F.lit(1), F.length(d) - tail), _feistel(key, "phone", F.substring(d, F.length(d) - tail + 1, tail))))

    def card() -> Column:
        n = F.length(d)
        old = F.substring(d, F.lit(1), n - 1)

        def body(new: Column) -> Column:
            check = F.pmod(F.substring(d, n, F.lit(1)).cast("int") - _check_digit(old) + _check_digit(new), F.lit(10))
            return F.concat(new, check.cast("string"))

        return _fill(m, _let(F.concat(F.substring(d, 1, 1), _feistel(key, "card", F.substring(d, F.lit(2), n - 2))), body))

    def ip() -> Column:
        octets = F.transform(F.split(m, r"\."), lambda o: o.cast("bigint"))
        start = F.struct((octets[0] * 256 + octets[1]).alias("a"), (octets[2] * 256 + octets[3]).alias("b"))
        f = lambda acc, i: _number(F.concat(F.lit(f"{key}|ip|"), i.cast("string"), F.lit("|"), F.when(i % 2 == 0, acc["a"]).otherwise(acc["b"]).cast("string")), 4)
        step = lambda acc, i: F.struct(F.when(i % 2 == 0, acc["a"]).otherwise(F.pmod(acc["a"] + f(acc, i), F.lit(65536))).alias("a"), F.when(i % 2 == 0, F.pmod(acc["b"] + f(acc, i), F.lit(65536))).otherwise(acc["b"]).alias("b"))
        part = lambda v: F.concat(F.floor(v / 256).cast("string"), F.lit("."), F.pmod(v, F.lit(256)).cast("string"))
        return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda acc: F.concat(part(acc["a"]), F.lit("."), part(acc["b"])))

    def email() -> Column:
        low = F.lower(m)
        local, domain = F.substring_index(low, "@", 1), F.substring_index(low, "@", -1)
        name = _letters(F.concat(F.lit(f"{key}|local|"), low), 8 + 4 * widen)
        numbered = F.when(local.rlike(r"\.[0-9]+$"), F.concat(F.lit("."), F.lpad(F.pmod(_number(F.concat(F.lit(f"{key}|tail|"), low), 8), F.lit(100)).cast("string"), 2, "0"))).otherwise("")
        made = F.concat(name, numbered, F.lit("@"), _letters(F.concat(F.lit(f"{key}|domain|"), domain), 6 + 2 * widen), F.lit(".example."), F.substring_index(domain, ".", -1))
        return F.when(m == F.upper(m), F.upper(made)).otherwise(made)

    def iban() -> Column:
        def filled(flat: Column) -> Column:
            country, told, old = F.substring(flat, 1, 2), F.substring(flat, 3, 2).cast("int"), F.substring(flat, F.lit(5), F.length(flat))
            rest = _let(_fill(old, _feistel(key, "iban", _digits(old))), lambda new: F.concat(F.lpad(F.pmod(told - _check97(old, country) + _check97(new, country), F.lit(100)).cast("string"), 2, "0"), _digits(new)))
            return _fill(m, rest)

        return _let(F.regexp_replace(m, r"\x20", ""), filled)

    return F.when(kind == "email", email()).when(kind == "iban", iban()).when(kind == "ip", ip()).when(kind == "phone", phone()).when(kind == "ssn", _fill(m, _feistel(key, "ssn", d))).otherwise(card())


def _rest(m: Column) -> Column:
    return F.regexp_extract(m, r"\x20(.*)$", 1)


def _gender(m: Column) -> Column:
    """f, m or n, by the title."""
    title = F.upper(F.regexp_extract(m, r"^([^\x20.]+)", 1))
    return F.when(title.isin(*map(str.upper, FEMALE)), "f").when(title.isin(*map(str.upper, MALE)), "m").otherwise("n")


def _is_initials(w: Column) -> Column:
    return F.endswith(w, F.lit("."))


def _people(df: DataFrame, t: Column) -> DataFrame:
    """With the names after titles in each text, and their words by place and gender, as columns _pii_*."""
    found = F.when(t.rlike(TITLED), F.regexp_extract_all(t, F.lit(PATTERNS["name"]), F.lit(0))).otherwise(F.array().cast("array<string>"))
    words = lambda m: F.filter(F.split(_rest(m), r"\x20"), lambda w: ~_is_initials(w))
    df = df.withColumn("_pii_named", F.transform(found, lambda m: F.struct(_gender(m).alias("gender"), words(m).alias("words"))))

    def first(test) -> Column:
        return F.array_distinct(F.transform(F.filter("_pii_named", test), lambda x: F.lower(x["words"][0])))

    return df.withColumns(
        {
            "_pii_words": F.array_distinct(F.flatten(F.transform("_pii_named", lambda x: x["words"]))),
            "_pii_alone": first(lambda x: F.size(x["words"]) == 1),
            "_pii_given": first(lambda x: F.size(x["words"]) > 1),
            "_pii_f": first(lambda x: x["gender"] == "f"),
            "_pii_m": first(lambda x: x["gender"] == "m"),
        }
    )


def _role(word: Column, gender: Column) -> Column:
    """What a word of a name is in its text; gender: what its own title tells."""
    low = F.lower(word)
    surname = F.array_contains("_pii_alone", low) | ~F.array_contains("_pii_given", low)
    told = F.when(gender != "n", gender).when(F.array_contains("_pii_f", low), "f").when(F.array_contains("_pii_m", low), "m").otherwise("n")
    return F.when(surname, "surname").otherwise(F.concat(F.lit("given_"), told))


def _roles(words: Column, gender: Column) -> Column:
    """(kind, entity, m) for each word after a title; the last is a surname."""
    def one(w: Column, i: Column) -> Column:
        kind = F.when(_is_initials(w), "initials").when(i == F.size(words) - 1, "surname").otherwise(_role(w, gender))
        return F.struct(kind.alias("kind"), F.lower(w).alias("entity"), w.alias("m"))

    return F.transform(words, one)


def _bare_roles(words: Column) -> Column:
    return F.transform(words, lambda w: F.struct(_role(w, F.lit("n")).alias("kind"), F.lower(w).alias("entity"), w.alias("m")))


def _word(w: Column, kind: Column, key: str, widen: int) -> Column:
    """The surrogate of a word of a name."""
    low, cyrillic = F.lower(w), w.rlike(r"\p{IsCyrillic}")

    def syllables(seed: Column, n: int) -> Column:
        return F.when(cyrillic, _syllables(seed, n, CYRILLIC_SYLLABLES)).otherwise(_syllables(seed, n, SYLLABLES))

    def pick(names: tuple[str, ...]) -> Column:
        return F.element_at(F.array(*map(F.lit, names)), F.pmod(_number(F.concat(F.lit(f"{key}|first|"), low), 8), F.lit(len(names))).cast("int") + 1)

    given = F.when(cyrillic, _syllables(F.concat(F.lit(f"{key}|first|"), kind, low), 2, CYRILLIC_SYLLABLES)).when(kind == "given_f", pick(FEMALE_NAMES)).when(kind == "given_m", pick(MALE_NAMES)).otherwise(pick(NEUTRAL_NAMES))
    if widen:  # there are few given names to choose from
        given = F.concat(given, F.lit("-"), syllables(F.concat(F.lit(f"{key}|second|"), kind, F.lit("|"), low), 2 * widen))
    letter = lambda x, of: F.substring(F.lit(of), F.pmod(_number(F.concat(F.lit(f"{key}|initial|"), x), 8), F.lit(len(of))).cast("int") + 1, F.lit(1))
    initials = F.array_join(F.transform(F.filter(F.split(w, r"\."), lambda x: x != ""), lambda x: F.concat(F.when(cyrillic, letter(x, "АБВГДЕЖЗИКЛМНОП")).otherwise(letter(x, "ABCDEFGHIJKLMNOP")), F.lit("."))), "")
    made = F.when(kind == "initials", initials).when(kind == "surname", syllables(F.concat(F.lit(f"{key}|last|"), low), 4 + 2 * widen)).otherwise(given)
    return F.when(w == F.upper(w), F.upper(made)).otherwise(made)


def _pattern(t: Column) -> Column:
    """All kinds, and the words of the names in the text where they stand without a title.

    A word that the text also has in small letters may begin a sentence as an
    ordinary word ("Will he come?"): it counts inside a sentence or next to
    another word of a name only.
    """
    ordinary = F.filter("_pii_words", lambda w: F.contains(t, F.lower(w)) & F.regexp_like(t, F.concat(F.lit(r"(?<!\p{L})"), F.lower(w), F.lit(r"(?!\p{L})"))))

    def any_of(words: Column) -> Column:
        forms = F.array_distinct(F.flatten(F.transform(words, lambda w: F.array(w, F.upper(w), F.when(w == F.upper(w), F.initcap(w)).otherwise(w)))))
        return F.concat(F.lit("(?:"), F.array_join(forms, "|"), F.lit(r")(?!\p{L})"))

    def whole(x: Column) -> Column:
        free, word = F.array_except("_pii_words", x), any_of(F.col("_pii_words"))
        several = F.concat(F.lit(ANY + r"|(?<!\p{L})"), word, F.lit(r"(?:\x20"), word, F.lit("){1,3}"))
        one = F.when(F.size(free) > 0, F.concat(F.lit(r"|(?<!\p{L})"), any_of(free))).otherwise("")
        inside = F.when(F.size(x) > 0, F.concat(F.lit(r"|(?<=[\p{L}\p{N},;:]\x20)"), any_of(x))).otherwise("")
        return F.concat(several, one, inside)

    return F.when(F.size("_pii_words") > 0, _let(ordinary, whole)).otherwise(F.lit(ANY))


def entities(documents: DataFrame) -> DataFrame:
    """kind, entity and a form of it, each entity once, over all documents."""
    t = F.col("text")
    df = _people(documents.select("text").where(t.rlike(HINT)), t)
    matches = F.filter(F.regexp_extract_all(t, F.lit(ANY), F.lit(0)), lambda m: kind_of(m) != "name")
    plain = F.transform(matches, lambda m: _let(kind_of(m), lambda k: F.struct(k.alias("kind"), canonical(m, k).alias("entity"), m.alias("m"))))
    named = F.flatten(F.transform("_pii_named", lambda x: _roles(x["words"], x["gender"])))  # initials are no entities
    found = df.select(F.explode(F.concat(plain, named, _bare_roles(F.col("_pii_words")))).alias("x")).select("x.*")
    return found.groupBy("kind", "entity").agg(F.min("m").alias("m"))


def collisions(known: DataFrame, key: str, widen: int) -> int:
    """How many surrogates stand for more than one of the entities."""
    kind, m = F.col("kind"), F.col("m")
    # Surrogates cost far more than their few bytes tell: dealt to as many tasks as a shuffle has.
    n = int(known.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    of_name = (kind == "surname") | F.startswith(kind, F.lit("given"))
    surrogate = F.when(of_name, F.lower(_word(m, kind, key, widen))).otherwise(canonical(replaced(m, kind, key, widen), kind))
    return known.repartition(n, "entity").select("kind", surrogate.alias("surrogate")).groupBy("kind", "surrogate").count().where("count > 1").count()


def pseudonymise(documents: DataFrame, key: str, text: str = "text") -> DataFrame:
    """All columns, the text with surrogates for personal data, and n_entities."""
    documents = documents.drop("n_entities")
    # The whole row, so that no name clashes with those of the work.
    rows, t = documents.select(F.struct(*documents.columns).alias("_row"), F.col(text).alias("text")), F.col("text")
    known, widen = cut(entities(rows.select("text"))), 0
    while collisions(known, key, widen):
        widen += 1
        if widen > MOST_WIDE:
            raise ValueError("surrogates of different entities stay equal under this key; choose another")
    has = F.coalesce(t.rlike(HINT), F.lit(False))
    df = _people(rows, t).withColumn("_pii_pattern", _pattern(t))
    df = df.withColumns({"_pii_matches": F.when(has, F.regexp_extract_all(t, F.col("_pii_pattern"), F.lit(0))), "_pii_gaps": F.when(has, F.split(t, F.col("_pii_pattern"), -1))})

    def spoken(roles: Column) -> Column:
        return F.array_join(F.transform(roles, lambda r: _word(r["m"], r["kind"], key, widen)), " ")

    def new(m: Column, kind: Column) -> Column:
        titled = F.concat(F.regexp_extract(m, r"^([^\x20]+\x20)", 1), spoken(_roles(F.split(_rest(m), r"\x20"), _gender(m))))
        return F.when(kind == "name", titled).when(kind == "bare", spoken(_bare_roles(F.split(m, r"\x20")))).otherwise(replaced(m, kind, key, widen))

    made = F.transform("_pii_matches", lambda m: _let(kind_of(m), lambda k: new(m, k)))
    joined = F.array_join(F.zip_with("_pii_gaps", F.concat(made, F.array(F.lit(""))), lambda g, s: F.concat(g, s)), "")
    out = F.when(F.size("_pii_matches") > 0, joined).otherwise(t)
    n_entities = F.coalesce(F.when(has, F.size("_pii_matches")), F.lit(0)).cast("bigint")
    return df.select(*(out.alias(c) if c == text else F.col("_row")[c].alias(c) for c in documents.columns), n_entities.alias("n_entities"))
