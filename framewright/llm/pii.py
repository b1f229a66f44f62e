"""Personal data replaced by keyed surrogates (native DataFrame functions only).

1. One pattern finds the entities of a text; an entity has a kind and a
   canonical form (lower-case address, digits of a number, name), so different
   spellings of one entity are one entity.
2. The table of distinct entities gets surrogates from a keyed SHA-256: an
   address for an address, valid octets for an IP, digits for digits (a card's
   end in its Luhn digit, an account's check digits fit modulo 97), a name of the
   same gender and script for a name, hex of the same length and case for a
   secret.
3. Collision checks: two entities must not share a surrogate, and no surrogate
   may equal an entity of the corpus.  Losers (all but the smallest entity) draw
   again with the next counter, from a wider form after a few, until none is
   left.  A surname is an entity of its own (with its script): its surrogate is
   unique and no surname of the corpus, and full names are a drawn given name
   before it, so 'Mr. John Smith' and 'Mr. Smith' keep one surname and 'Mr. John
   Smith' and 'Mr. James Smith' stay two people.
4. A text with entities is cut at them and joined again with the surrogates,
   written in the form (separators, case, title) of each occurrence.  Between
   them, the full names and surnames that the text has with a title are replaced
   without one too, as whole words of the same case.

Texts without entities are never moved.  Texts with entities are written once
with what was found and joined on the hash of the text, so copies share one list
of surrogates; frequent entities and texts of many copies are dealt to several
tasks (:func:`salted_join`).

Names are found by a title; a name that no title introduces in its text stays.
Account numbers are those of digits after the country.

Defined results: null stays null, empty stays empty, texts of any length are
searched whole, repeated rows get equal results, an empty table gives no rows.
Of entities that tie for a surrogate the smallest has it.  The surrogate of an
entity depends on the key, the entity and, only after a collision, on the
corpus.  Other columns are carried along unchanged; names that begin with
``_fw_`` are reserved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.llm.common import salted_join, table, written

#: The session's setting that holds the secret key.
KEY_SETTING = "spark.framewright.pii.key"
#: What the registered queries use where the session has no key: their tables hold no real persons.
TEST_KEY = "key of the test tables"

# Titles before names, by gender.
MALE_TITLES = r"Mr\.?|Herrn?|Monsieur|Señor|Sr\.|г-н|господин"
NEUTRAL_TITLES = r"Dr\.?|Prof\.?|Professor|Doctor|Doktor|Доктор|доктор|Профессор|профессор"
FEMALE_TITLES = r"Mrs\.?|Ms\.?|Miss|Frau|Madame|Mme|Señora|Sra\.|г-жа|госпожа"

# One of these stands in every title above.
TITLE_STEMS = ("Mr", "Ms", "Miss", "Mme", "Madame", "Monsieur", "Herr", "Frau", "Señor", "Sr", "Sra", "г-", "господин", "госпожа", "Dr", "Prof", "Do", "октор", "рофессор")

EMAIL = r"[A-Za-z0-9_%+-]+(?:\.[A-Za-z0-9_%+-]+)*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
SECRET = r"(?<![A-Za-z0-9])(?:[0-9a-f]{32,128}|[0-9A-F]{32,128})(?![A-Za-z0-9])"
IP = r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d)"
IBAN = r"\b[A-Z]{2}\d{2}(?: ?\d{4}){3,7}(?: ?\d{1,3})?\b"
SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
CARD = r"(?<!\d)\d{4}[ -]?\d{4}[ -]?\d{4}[ -]?\d{1,7}(?!\d)"
PHONE = r"(?<![\d.])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{3}[ .-])\d{3,4}[ .-]\d{4}(?!\d)"
TITLES = f"{MALE_TITLES}|{FEMALE_TITLES}|{NEUTRAL_TITLES}"
PERSON = r"\p{Lu}[\p{L}'’]*\p{Ll}(?:-\p{Lu}\p{L}*\p{Ll})*"
NAME = rf"(?<![\p{{L}}\p{{N}}])(?:(?:{TITLES}) )+{PERSON}(?: {PERSON})?"
KINDS = {"email": EMAIL, "secret": SECRET, "ip": IP, "iban": IBAN, "ssn": SSN, "card": CARD, "phone": PHONE, "name": NAME}
PATTERN = "|".join(f"(?:{p})" for p in KINDS.values())

# Given names and syllables of surnames.
GIVEN = {
    ("m", "latin"): "Adam Boris Carlo David Emil Felix Georg Hugo Ivan Jonas Karl Leon Mario Noel Oscar Paul",
    ("f", "latin"): "Anna Berta Clara Diana Elena Frida Greta Helena Irma Julia Karin Laura Maria Nora Olga Paula",
    ("n", "latin"): "Alex Andrea Chris Dominique Eden Francis Gale Jean Kim Lee Morgan Nicola Quinn Robin Sascha Toni",
    ("n", "cyrillic"): "Валя Витя Володя Гена Ждан Женя Жора Лёня Леся Мина Паша Саня Саша Сима Слава Шура",
    ("m", "cyrillic"): "Антон Борис Вадим Глеб Денис Егор Иван Кирилл Лев Максим Никита Олег Павел Роман Сергей Тимур",
    ("f", "cyrillic"): "Анна Белла Вера Галина Дарья Елена Жанна Зоя Ирина Ксения Лидия Мария Нина Ольга Полина Раиса",
}
SYLLABLES = {
    "latin": "ba be bo da de do fa fe ka ke ko la le lo ma me mo na ne no pa pe ra re ro sa se so ta te to va",
    "cyrillic": "ба бе бо да де до фа фе ка ке ко ла ле ло ма ме мо на не но па пе ра ре ро са се со та те то ва",
}


def _has_entity(text: Column) -> Column:
    """Whether ``PATTERN`` is in a text, by cheap tests first.

    Every kind but names and secrets of letters alone needs a digit or ``@``,
    and a name needs a title; most texts have none of them.
    """
    titled = F.lit(False)
    for title in TITLE_STEMS:
        titled = titled | text.contains(title)
    hint = text.rlike("[0-9@]") | titled | text.rlike("[a-f]{32}|[A-F]{32}")
    return F.coalesce(F.when(hint, text.rlike(PATTERN)).otherwise(False), F.lit(False))


def _kind(value: Column) -> Column:
    out = F.lit(None).cast("string")
    for kind, pattern in reversed(KINDS.items()):
        out = F.when(value.rlike(rf"^(?:{pattern})$"), kind).otherwise(out)
    return out


def _bare_name(value: Column) -> Column:
    return F.regexp_replace(value, rf"^(?:(?:{TITLES}) )+", "")


def _canonical(kind: Column, value: Column) -> Column:
    """What makes two occurrences one entity; a name carries gender and script."""
    titled = lambda titles: value.rlike(rf"^(?:(?:{TITLES}) )*(?:{titles}) ")
    gender = F.when(titled(FEMALE_TITLES), "f").when(titled(MALE_TITLES), "m").otherwise("n")
    script = F.when(value.rlike(r"\p{IsCyrillic}"), "cyrillic").otherwise("latin")
    digits = F.regexp_replace(value, r"\D", "")
    return (
        F.when(kind.isin("email", "secret"), F.lower(value))
        .when(kind == "name", F.concat_ws("/", gender, script, _bare_name(value)))
        .when(kind == "ip", value)
        .when(kind == "iban", F.regexp_replace(value, " ", ""))
        .when(kind == "phone", F.right(digits, F.lit(10)))
        .otherwise(digits)
    )


def _number(digest: Column, at: int, size: int = 4) -> Column:
    return F.conv(F.substring(digest, at, size), 16, 10).cast("int")


def _syllables(digest: Column, script: str, n: int) -> Column:
    syllables = F.split(F.lit(SYLLABLES[script]), " ")
    return F.concat(*[F.get(syllables, _number(digest, 5 + 4 * k) % 32) for k in range(n)])


def _luhn(payload: Column) -> Column:
    """The check digit of a card's digits before it."""
    at = lambda i: payload.substr(F.length(payload) + 1 - i, F.lit(1)).cast("int")
    twice = lambda x: 2 * x - F.when(x > 4, 9).otherwise(0)
    total = F.aggregate(F.sequence(F.lit(1), F.length(payload)), F.lit(0), lambda s, i: s + F.when(i % 2 == 1, twice(at(i))).otherwise(at(i)))
    return ((10 - total % 10) % 10).cast("string")


def _account(country: Column, digits: Column) -> Column:
    """An account number with check digits that fit modulo 97; at most 31 digits after the country."""
    letter = lambda k: (F.ascii(country.substr(k, 1)) - 55).cast("string")
    rest = F.concat(digits, letter(1), letter(2), F.lit("00")).try_cast("decimal(38,0)") % 97
    return F.concat(country, F.lpad((98 - rest).cast("int").cast("string"), 2, "0"), digits)


def _surrogate(kind: Column, canonical: Column, attempt: Column, key: str) -> Column:
    """The canonical surrogate: for numbers its digits, for names the given name, for the rest its text."""
    digest = F.sha2(F.concat_ws("|", F.lit(key), kind, canonical, attempt.cast("string")), 256)
    more = F.concat(digest, F.sha2(digest, 256))
    numerals = F.translate(more, "abcdef", "830617")
    n = F.length(canonical)
    octets = F.concat_ws(".", _number(digest, 1) % 223 + 1, _number(digest, 5) % 256, _number(digest, 9) % 256, _number(digest, 13) % 254 + 1)
    # A number keeps its first digit (a card's network) and a phone gets the fictitious exchange 555 in the first draws.
    lead = F.when(attempt < 4, F.left(canonical, F.lit(1))).otherwise(F.substring(numerals, 60, 1))
    number = F.concat(lead, F.substring(numerals, F.lit(1), n - 1))
    payload = F.concat(F.left(canonical, F.lit(1)), F.substring(numerals, F.lit(1), n - 2))
    card = F.concat(payload, _luhn(payload))
    exchange = F.when(attempt < 4, F.lit("555")).otherwise(F.substring(numerals, 8, 3))
    phone = F.concat(F.substring(canonical, F.lit(1), n - 10), F.substring(numerals, 1, 3), exchange, F.substring(numerals, 4, 4))
    iban = _account(F.left(canonical, F.lit(2)), F.substring(numerals, F.lit(1), n - 4))
    name = F.lit(None).cast("string")
    for (gender, script), names in GIVEN.items():
        given = F.get(F.split(F.lit(names), " "), _number(digest, 1) % 16)
        # The given names of the list are few: later draws lengthen them.
        drawn = F.concat(given, F.when(attempt == 0, "").when(attempt < 4, _syllables(digest, script, 2)).otherwise(_syllables(digest, script, 6)))
        name = F.when(canonical.startswith(f"{gender}/{script}/"), drawn).otherwise(name)
    surname = F.lit(None).cast("string")
    for script in SYLLABLES:
        drawn = F.initcap(F.when(attempt < 4, _syllables(digest, script, 4)).otherwise(_syllables(digest, script, 8)))
        surname = F.when(canonical.startswith(f"{script}/"), drawn).otherwise(surname)
    address = F.concat(F.lit("user"), F.substring(digest, 1, 16), F.lit("@mail"), _number(digest, 60) % 10, F.lit(".example.org"))
    return (
        F.when(kind == "email", address)
        .when(kind == "secret", F.substring(more, F.lit(1), n))
        .when(kind == "ip", octets)
        .when(kind == "name", name)
        .when(kind == "surname", surname)
        .when(kind == "iban", iban)
        .when(kind == "card", card)
        .when((kind == "phone") & (n >= 10), phone)
        .otherwise(number)
    )


def _dressed(kind: Column, value: Column, surrogate: Column) -> Column:
    """A canonical surrogate in the form of one occurrence: its separators, case or title."""
    first = F.when(kind == "iban", 3).otherwise(1)
    tail = F.substring(value, first, F.length(value))
    own_digits, new_digits = F.regexp_replace(tail, r"\D", ""), F.regexp_replace(surrogate, r"\D", "")
    code = F.left(own_digits, F.greatest(F.length(own_digits) - F.length(new_digits), F.lit(0)))  # a phone's country code stays
    digits = F.split(F.concat(code, new_digits), "")
    gaps = F.split(tail, r"\d", -1)
    woven = F.array_join(F.zip_with(gaps, digits, lambda g, d: F.concat(F.coalesce(g, F.lit("")), F.coalesce(d, F.lit("")))), "")
    filled = F.concat(F.when(kind == "iban", F.left(value, F.lit(2))).otherwise(""), woven)
    title = F.regexp_extract(value, rf"^(?:(?:{TITLES}) )+", 0)
    return (
        F.when(kind.isin("email", "ip"), surrogate)
        .when((kind == "secret") & (value == F.upper(value)), F.upper(surrogate))
        .when(kind == "secret", surrogate)
        .when(kind == "name", F.concat(title, surrogate))
        .otherwise(filled)
    )


def _bare(kind: Column, canonical: Column) -> Column:
    """A canonical form as its surrogate would be written: names without gender and script."""
    return F.when(kind.isin("name", "surname"), F.substring_index(canonical, "/", -1)).otherwise(canonical)


def _distinct(entities: DataFrame, key: str, attempts: int) -> DataFrame:
    """``(kind, canonical, surrogate)`` of ``(kind, canonical, tail)``: a draw and its tail, by the rules of :func:`surrogates`."""
    open_ = written(entities)
    known = open_.select(F.col("kind"), _bare(F.col("kind"), F.col("canonical")).alias("surrogate")).distinct()
    done: DataFrame | None = None
    for attempt in range(attempts):
        drawn = open_.withColumn("surrogate", F.concat(_surrogate(F.col("kind"), F.col("canonical"), F.lit(attempt), key), "tail"))
        drawn = drawn.join(known, ["kind", "surrogate"], "left_anti")
        if done is not None:
            drawn = drawn.join(done.select("kind", "surrogate"), ["kind", "surrogate"], "left_anti")
        won = written(drawn.groupBy("kind", "surrogate").agg(F.min("canonical").alias("canonical")).select("kind", "canonical", "surrogate"))
        done = won if done is None else done.unionByName(won)
        open_ = written(open_.join(won, ["kind", "canonical"], "left_anti"))
        if open_.isEmpty():
            return done
    raise RuntimeError("more entities than surrogates of their form")


def surrogates(entities: DataFrame, key: str, attempts: int = 32) -> DataFrame:
    """``(kind, canonical)`` with a ``surrogate`` that no other entity has and that is no entity.

    Of entities that draw the same surrogate the smallest keeps it; the others,
    and those that hit an entity of the corpus, draw again.  Names of one word
    are surnames, and their surrogate is the surname's; two words are a given
    name and a surname.
    """
    every = written(entities.select("kind", "canonical").distinct())
    bare = F.substring_index("canonical", "/", -1)
    script = F.substring_index(F.substring_index("canonical", "/", 2), "/", -1)
    names = every.where("kind = 'name'").withColumn("surname", F.concat_ws("/", script, F.substring_index(bare, " ", -1)))
    surnames = names.select(F.lit("surname").alias("kind"), F.col("surname").alias("canonical")).distinct()
    single = _distinct(every.where("kind <> 'name'").unionByName(surnames).withColumn("tail", F.lit("")), key, attempts)
    drawn = single.where("kind = 'surname'").select(F.col("canonical").alias("surname"), "surrogate")
    names = written(salted_join(names, drawn, ["surname"], ["canonical"]).select("kind", "canonical", "surrogate"))
    whole = _distinct(names.where(bare.contains(" ")).select("kind", "canonical", F.concat(F.lit(" "), "surrogate").alias("tail")), key, attempts)
    return single.where("kind <> 'surname'").unionByName(names.where(~bare.contains(" "))).unionByName(whole)


def query_key(spark: SparkSession) -> str:
    """The session's key, or that of the test tables: for the registered queries alone."""
    return spark.conf.get(KEY_SETTING, None) or TEST_KEY


#: A word's edge in any script.
_EDGES = (r"(?<![\p{L}\p{N}])(?:", r")(?![\p{L}\p{N}])")


def _untitled(gap: Column, names: Column) -> Column:
    """A stretch between entities as pieces: its mentions of ``names`` (name, new) replaced, in one pass."""
    pattern = F.concat(F.lit(_EDGES[0]), F.array_join(F.transform(names, lambda p: F.concat(F.lit(r"\Q"), p["name"], F.lit(r"\E"))), "|"), F.lit(_EDGES[1]))
    found = F.transform(F.regexp_extract_all(gap, pattern, F.lit(0)), lambda m: F.get(F.filter(names, lambda p: p["name"] == m), F.lit(0))["new"])
    return F.zip_with(F.split(gap, pattern, -1), found, lambda g, n: F.concat(g, F.coalesce(n, F.lit(""))))


def replace_entities(docs: DataFrame, key: str | None = None, text: str = "text", count: str | None = None) -> DataFrame:
    """``docs`` with every entity of ``text`` replaced; ``count`` names a column for the number of entities found by the pattern.

    ``key`` is secret: who has it can recompute surrogates.  Without one the
    session's ``spark.framewright.pii.key`` is taken; it is an error if that is not set either.
    """
    key = key or docs.sparkSession.conf.get(KEY_SETTING, None)
    if not key:
        raise ValueError(f"a key is needed: pass one or set {KEY_SETTING}")
    columns = docs.columns if count is None else [c for c in docs.columns if c != count]
    has = _has_entity(F.col(text))
    plain = docs.where(~has)
    values = F.regexp_extract_all(F.col(text), F.lit(PATTERN), F.lit(0))
    some = written(docs.where(has).withColumn("_fw_key", F.sha2(F.col(text).cast("binary"), 256)).withColumn("_fw_values", values))
    found = some.groupBy("_fw_key").agg(F.any_value("_fw_values").alias("_values"))
    each = found.select("_fw_key", F.posexplode("_values").alias("_at", "_value")).withColumn("kind", _kind(F.col("_value")))
    each = written(each.withColumn("canonical", _canonical(F.col("kind"), F.col("_value"))))
    drawn = salted_join(each, written(surrogates(each, key)), ["kind", "canonical"], ["_fw_key", "_at"])
    bare, is_name = _bare(F.col("kind"), F.col("canonical")), F.col("kind") == "name"
    last = lambda c: F.substring_index(c, " ", -1)
    pair = lambda name, new: F.struct((-F.length(name)).alias("short"), name.alias("name"), new.alias("new"))
    both = F.when(is_name, F.array(pair(bare, F.col("surrogate")), pair(last(bare), last(F.col("surrogate")))))
    dressed = drawn.select("_fw_key", F.struct("_at", _dressed(F.col("kind"), F.col("_value"), F.col("surrogate")).alias("s")).alias("x"), both.alias("names"))
    # The longest name of those that begin alike comes first in the pattern.
    lists = dressed.groupBy("_fw_key").agg(F.array_sort(F.collect_list("x")).alias("_fw_list"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("names")))).alias("_fw_names"))
    row = [f.name for f in docs.schema.fields if f.name != text and f.dataType.typeName() != "map"]
    joined = salted_join(some, lists, ["_fw_key"], [f"`{c}`" for c in row])
    gaps = F.split(F.col(text), PATTERN, -1)
    gaps = F.when(F.size("_fw_names") > 0, F.transform(gaps, lambda g: F.array_join(_untitled(g, F.col("_fw_names")), ""))).otherwise(gaps)
    rebuilt = F.array_join(F.zip_with(gaps, F.transform("_fw_list", lambda x: x["s"]), lambda g, s: F.concat(g, F.coalesce(s, F.lit("")))), "")
    extra = [] if count is None else [F.size("_fw_list").cast("long").alias(count)]
    new = joined.select(*[rebuilt.alias(c) if c == text else F.col(f"`{c}`") for c in columns], *extra)
    return plain.select(*[f"`{c}`" for c in columns], *([] if count is None else [F.lit(0).cast("long").alias(count)])).unionByName(new)


def op6_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents``: doc_id, number of entities replaced and the whole new text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return replace_entities(docs, query_key(spark), count="n_entities").select("doc_id", "n_entities", "text")
