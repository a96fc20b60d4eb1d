"""PII: detected entities get keyed surrogates of the same type and format.

Kinds: email addresses, phone numbers, IPv4 and IPv6 addresses, payment card numbers, IBANs, long
hexadecimal secrets, access tokens with known prefixes, US social security numbers, and person names.
A name is found after a title: any of its capitalised words, with initials, inner capitals, hyphens and
particles. Its words are then found again wherever the same text has them, titled or not. Scripts without
capitals have no names found.

An entity's canonical form (digits of a number, lower case of an address, a name's word in lower case)
decides its surrogate, so that all its spellings get one, each in its own layout: a person's full name,
surname alone and untitled mentions stay the same person. The surrogate is drawn from an HMAC: digits for
digits and letters for letters, a country code kept, check digits of cards and IBANs valid if they were,
addresses of one domain in one domain, octets in range, a name in the script of the original and, where
titles agree on one, of its gender. All canonical forms of the corpus are checked together: one whose
surrogate another one has, or that is itself found in the corpus, draws again until all are distinct;
names draw longer ones in time. Initials are letters and are not held apart.

Texts are read once into pieces of plain text and entities, which are written; the entities alone are
joined with the surrogates, and only texts that hold some are put together anew.

Defined results: a null text stays null; an empty text stays empty; repeated rows are rewritten alike;
an empty table gives no rows; ``surrogates`` passes the other columns on, whatever their names.
"""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafspark.llm.common import broadcast_up_to, staged, table

#: The key of the query; a caller has a secret one.
KEY = "example-key"
#: Between pieces, and the escape of both in a text that holds them.
CUT, ESCAPE = "\ue000", "\ue001"

FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Mme", "Madame", "Mlle", "Señora", "Sra", "Doña", "госпожа")
MALE = ("Mr", "Herr", "Monsieur", "Señor", "Sr", "господин")
OTHER = ("Dr", "Prof")
_TITLE = rf"(?:{'|'.join(FEMALE + MALE + OTHER)})\.?[ \xA0]"
_WORD = r"\p{Lu}(?:\.|[\p{L}\p{M}]*(?:[\-'’]\p{Lu}[\p{L}\p{M}]*)*)"
_NAME = rf"{_WORD}(?:[ \xA0](?:(?:van|von|de|der|den|del|di|da|la|le)[ \xA0]){{0,3}}{_WORD}){{0,4}}"
_TITLED = rf"(?<!\p{{L}}){_TITLE}{_NAME}"
_HEX = r"[0-9A-Fa-f]{1,4}"

#: In order of precedence; none matches another's whole text. What none matches is a name's word.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]{1,64}@(?:[A-Za-z0-9][A-Za-z0-9\-]{0,62}\.){1,6}[A-Za-z]{2,24}(?![A-Za-z0-9\-])",
    "ip": r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\.?\d)",
    "ip6": rf"(?<![\w:])(?:(?:{_HEX}:){{7}}{_HEX}|(?:{_HEX}:){{2,6}}(?::{_HEX}){{1,5}})(?![\w:])",
    "phone": r"(?<![\w+])\+\d{1,3}[ .\-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .\-]?\d{2,4}){2,4}(?!\d)|(?<![\w(])\(\d{3}\)[ ]?\d{3}[\-. ]\d{4}(?!\d)|(?<![\w\-.])\d{3}[\-.]\d{3}[\-.]\d{4}(?![\w\-])",
    "ssn": r"(?<![\w\-])\d{3}-\d{2}-\d{4}(?![\w\-])",
    "card": r"(?<![\w\-.])\d(?:[ \-]?\d){12,18}(?![\w])",
    "iban": r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)",
    "token": r"(?<!\w)(?:sk-(?:[a-z]+-)?[A-Za-z0-9_]{20,128}|AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{30,128}|xox[abprs]-[A-Za-z0-9\-]{10,128}|AIza[A-Za-z0-9_\-]{35})(?!\w)",
    "secret": r"(?<![0-9A-Za-z])[0-9a-f]{32,128}(?![0-9A-Za-z])",
}
#: The same behind a look at the first character, which most places in a text fail at once.
_BY_START = (("[0-9+(]", ("ip", "phone", "ssn", "card")), ("[0-9A-Fa-f]", ("ip6", "secret")), ("[A-Zgsx]", ("iban", "token")))
_ANY = "|".join([PATTERNS["email"], *(f"(?={start})(?:{'|'.join(PATTERNS[k] for k in kinds)})" for start, kinds in _BY_START)])
#: What of a token or a phone number is kept.
_PREFIX = r"^(?:sk-(?:[a-z]+-)?|AKIA|gh[pousr]_|xox[abprs]-|AIza)"
_COUNTRY = r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"

#: Syllables a script's names are made of, with the endings of female, male and other first names.
SCRIPTS = {
    "cyrillic": (r"\p{IsCyrillic}", "ба ве ги до жу за ки лу ма не по ра се ти фо ха", ("на", "н", "й")),
    "greek": (r"\p{IsGreek}", "βα γε δι θο κα λε μι νο πα ρε σι το φα χε ζι ξα", ("να", "νος", "ν")),
    "latin": (r"\p{L}", "ba ve gi do ju za ki lu ma ne po ra se ti fo ha", ("na", "n", "l")),
}


def kind_of(entity: Column) -> Column:
    case = F.when(F.length(entity) == 1, F.lit("initial")).otherwise(F.lit("name"))
    for kind, pattern in reversed(PATTERNS.items()):
        case = F.when(F.regexp_like(entity, F.lit(f"^(?:{pattern})$")), F.lit(kind)).otherwise(case)
    return case


def canonical(kind: Column, entity: Column) -> Column:
    return (
        F.when(kind.isin("phone", "card", "ssn"), F.concat(F.regexp_extract(entity, r"^\+", 0), F.regexp_replace(entity, r"\D", "")))
        .when(kind == "iban", F.replace(entity, F.lit(" "), F.lit("")))
        .when(kind == "token", entity)
        .otherwise(F.lower(entity))
    )


def gender(entity: Column) -> Column:
    titled = lambda names: F.regexp_like(entity, F.lit(rf"^(?:{'|'.join(names)})\.?[ \xA0]"))
    return F.when(titled(FEMALE), F.lit("f")).when(titled(MALE), F.lit("m"))


def _luhn(digits: Column) -> Column:
    """The weighted digit sum modulo ten; zero for a valid number."""
    last = F.length(digits)

    def weigh(d: Column, i: Column) -> Column:
        twice = (last - i) % 2 == 0
        return F.when(twice & (d * 2 > 9), d * 2 - 9).when(twice, d * 2).otherwise(d)

    values = F.transform(F.split(digits, ""), lambda d: d.cast("int"))
    return F.aggregate(F.transform(values, weigh), F.lit(0), lambda a, d: a + d) % 10


def _iban_rest(iban: Column) -> Column:
    """The number an IBAN stands for, its check digits last, modulo 97; one for a valid one."""
    turned = F.concat(F.substring(iban, F.lit(5), F.length(iban)), F.substring(iban, 1, 4))
    add = lambda a, c: F.when((c >= "0") & (c <= "9"), (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(F.split(turned, ""), F.lit(0), add)


def hmac(key: str, message: Column) -> Column:
    """HMAC-SHA512 in hexadecimal."""
    raw = key.encode()
    raw = (hashlib.sha512(raw).digest() if len(raw) > 128 else raw).ljust(128, b"\0")
    inner, outer = (F.lit(bytes(b ^ pad for b in raw)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(message, "UTF-8")), 512))), 512)


def with_alias(entities: DataFrame, key: str) -> DataFrame:
    """``entities(kind, form, sex, attempt)`` with ``alias``, the canonical form that stands for ``form``:
    a function of the key and the attempt."""
    kind, form, sex, attempt = (F.col(c) for c in ("kind", "form", "sex", "attempt"))

    def stream(seed: Column) -> Column:
        return F.concat(hmac(key, F.concat(F.lit("0|"), seed)), hmac(key, F.concat(F.lit("1|"), seed)))

    def draws(name: str):
        return lambda i: F.conv(F.substring(name, 2 * (i % 128) + 1, F.lit(2)), 16, 10).cast("int")

    draw = draws("_stream")
    pick = lambda letters, n: F.substring(F.lit(letters), n % len(letters) + 1, F.lit(1))
    of = lambda letters, i: pick(letters, draw(i))
    digits, letters = "0123456789", "abcdefghijklmnopqrstuvwxyz"

    def shaped(text: Column, source=draw) -> Column:
        drawn = F.transform(
            F.split(text, ""),
            lambda c, i: F.when((c >= "0") & (c <= "9"), pick(digits, source(i)))
            .when((c >= "a") & (c <= "z"), pick(letters, source(i)))
            .when((c >= "A") & (c <= "Z"), pick(letters.upper(), source(i)))
            .otherwise(c),
        )
        return F.array_join(drawn, "")

    after = lambda x, n: F.substring(x, n + 1, F.length(x))
    # A domain is drawn from itself alone, so that its addresses keep one.
    domain = F.regexp_extract("form", r"@(.*)\.[a-z]+$", 1)
    email = F.concat(shaped(F.substring_index(form, "@", 1)), F.lit("@"), shaped(domain, draws("_domain_stream")), F.regexp_extract(form, r"\.[a-z]+$", 0))
    ip = F.array_join(F.transform(F.split(form, r"\."), lambda _, i: (draw(i) % 254 + 1).cast("string")), ".")
    hexed = F.array_join(F.transform(F.split(form, ""), lambda c, i: F.when(c == ":", c).otherwise(of("0123456789abcdef", i))), "")
    prefix = F.regexp_extract(form, _PREFIX, 0)
    token = F.concat(prefix, shaped(after(form, F.length(prefix))))
    number = F.concat(F.substring(form, 1, 1), shaped(after(form, F.lit(1))))
    code = F.regexp_extract(form, _COUNTRY, 0)
    phone = F.when(code == "", number).otherwise(F.concat(code, shaped(after(form, F.length(code)))))
    # The last digit is the one that gives the number the original's check sum.
    most = F.substring(number, F.lit(1), F.length(number) - 1)
    card = F.concat(most, ((_luhn(form) - _luhn(F.concat(most, F.lit("0"))) + 10) % 10).cast("string"))
    account, country = shaped(after(form, F.lit(4))), F.substring(form, 1, 2)
    check = F.pmod(_iban_rest(form) - _iban_rest(F.concat(country, F.lit("00"), account)), F.lit(97))
    iban = F.concat(country, F.lpad(check.cast("string"), 2, "0"), account)

    def named(syllables: str, endings: tuple[str, str, str]) -> Column:
        parts = F.split(F.lit(syllables), " ")
        word = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(2) + (attempt / 4).cast("int")), lambda i: F.get(parts, draw(i) % F.size(parts))), "")
        end = F.when(sex == "f", F.lit(endings[0])).when(sex == "m", F.lit(endings[1])).otherwise(F.lit(endings[2]))
        return F.when(kind == "initial", F.substring(word, 1, 1)).otherwise(F.concat(word, end))

    name = F.lit("")
    for pattern, syllables, endings in reversed(SCRIPTS.values()):
        name = F.when(F.regexp_like(form, F.lit(pattern)), named(syllables, endings)).otherwise(name)
    cases = {"email": email, "ip": ip, "ip6": hexed, "secret": hexed, "token": token, "card": card, "iban": iban, "phone": phone, "ssn": number}
    alias = reduce(lambda c, kv: F.when(kind == kv[0], kv[1]).otherwise(c), cases.items(), name)
    # The streams are columns of their own, so that a row's many draws share them.
    seeded = entities.withColumn("_stream", stream(F.concat_ws("|", kind, attempt.cast("string"), form)))
    seeded = seeded.withColumn("_domain_stream", F.when(kind == "email", stream(F.concat(F.lit("domain|"), domain))))
    return seeded.withColumn("alias", alias).drop("_stream", "_domain_stream")


def rendered(kind: Column, entity: Column, form: Column) -> Column:
    """``form`` in the layout of the entity: its separators and its capitals."""

    def laid_out(keep, symbols: Column) -> Column:
        step = lambda s, c: F.when(
            keep(c), F.struct(s["n"].alias("n"), F.concat(s["out"], F.array(c)).alias("out"))
        ).otherwise(F.struct((s["n"] + 1).alias("n"), F.concat(s["out"], F.array(F.substring(symbols, s["n"] + 1, F.lit(1)))).alias("out")))
        start = F.struct(F.lit(0).alias("n"), F.array().cast("array<string>").alias("out"))
        return F.array_join(F.aggregate(F.split(entity, ""), start, step, lambda s: s["out"]), "")

    cased = F.array_join(
        F.transform(F.split(entity, ""), lambda c, i: F.when((c >= "A") & (c <= "Z"), F.upper(F.substring(form, i + 1, F.lit(1)))).otherwise(F.substring(form, i + 1, F.lit(1)))), ""
    )
    return (
        F.when(kind.isin("phone", "card", "ssn"), laid_out(lambda c: (c < "0") | (c > "9"), F.replace(form, F.lit("+"), F.lit(""))))
        .when(kind == "iban", laid_out(lambda c: c == " ", form))
        .when(kind.isin("name", "initial"), F.when(entity == F.upper(entity), F.upper(form)).otherwise(F.initcap(form)))
        .when(kind.isin("email", "ip6"), cased)
        .otherwise(form)
    )


def distinct_surrogates(entities: DataFrame, key: str, rounds: int = 40) -> DataFrame:
    """``entities(kind, form, sex)``, each form once, with ``alias``: no two of a kind alike, and none
    that is itself a form of that kind. Initials may be alike."""
    forms = entities.filter("kind <> 'initial'").select("kind", F.col("form").alias("alias"), F.lit(True).alias("real"))
    drawn = entities.withColumn("attempt", F.lit(0))
    # Drawing is work by the row, not by the byte.
    tasks = 4 * entities.sparkSession.sparkContext.defaultParallelism
    for _ in range(rounds):
        drawn = with_alias(drawn.repartition(tasks, "kind", "form"), key)
        # The earliest attempt keeps a contested alias, so that settled ones stay.
        owner = Window.partitionBy("kind", "alias").orderBy("attempt", "form")
        again = ((F.col("rank") > 1) & (F.col("kind") != "initial")) | F.col("real").isNotNull()
        checked = staged(drawn.withColumn("rank", F.row_number().over(owner)).join(forms, ["kind", "alias"], "left").withColumn("again", again).drop("rank", "real"), "surrogates")
        if not checked.filter("again").limit(1).count():
            return checked.select("kind", "form", "alias")
        drawn = checked.withColumn("attempt", F.col("attempt") + F.col("again").cast("int")).drop("again", "alias")
    raise RuntimeError("no distinct surrogates: a kind has more entities than surrogates")


def _pieces(text: Column, words: Column) -> Column:
    """A text to pieces, entities at the odd places: those of the patterns, and the given words of names."""
    alone = r"(?<![\p{L}\p{M}])"
    long, short = F.filter(words, lambda w: F.length(w) > 1), F.filter(words, lambda w: F.length(w) == 1)
    # A longer word goes before its beginning.
    both = F.array_sort(F.array_union(long, F.transform(long, F.upper)), lambda a, b: F.length(b) - F.length(a))
    names = F.array_compact(F.array(
        F.when(F.size(long) > 0, F.concat(F.lit(alone + "(?:"), F.array_join(both, "|"), F.lit(r")(?![\p{L}\p{M}])"))),
        F.when(F.size(short) > 0, F.concat(F.lit(alone + "["), F.array_join(short, ""), F.lit(r"](?=\.)"))),
    ))
    mark = lambda pattern: F.regexp_replace(text, pattern, F.lit(f"{CUT}$1{CUT}"))
    some = mark(F.concat(F.lit(f"({_ANY}|"), F.array_join(names, "|"), F.lit(")")))
    return F.split(F.when(F.size(words) > 0, some).otherwise(mark(F.lit(f"({_ANY})"))), CUT)


def surrogates(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """``docs`` with the text rewritten, and ``n_entities``, how many entities it held."""
    escaped = F.replace(F.replace(F.col(text_col), F.lit(ESCAPE), F.lit(ESCAPE + "b")), F.lit(CUT), F.lit(ESCAPE + "a"))
    rest = [c for c in docs.columns if c != text_col]
    parts = lambda name: F.filter(F.regexp_extract_all(F.regexp_replace(name, f"^{_TITLE}", ""), F.lit(r"[\p{L}\p{M}]+"), F.lit(0)), lambda w: F.regexp_like(w, F.lit(r"^\p{Lu}")))
    # All but a name's last word are given names, of the title's gender.
    sexed = lambda name: F.transform(parts(name), lambda w, i: F.struct(w.alias("word"), F.when(i < F.size(parts(name)) - 1, gender(name)).alias("sex")))
    found = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in rest)).alias("rest") if rest else F.lit(None).cast("struct<_:int>").alias("rest"),
        escaped.alias("text"),
        F.regexp_extract_all(escaped, F.lit(_TITLED), F.lit(0)).alias("titled"),
    )
    found = found.withColumn("names", F.when(F.size("titled") > 0, F.flatten(F.transform("titled", sexed))))
    words = F.coalesce(F.array_distinct(F.transform("names", lambda n: n["word"])), F.array().cast("array<string>"))
    read = staged(
        found.select("rest", "names", _pieces(F.col("text"), words).alias("pieces"))
        .withColumn("found", F.filter("pieces", lambda _, i: i % 2 == 1))
        .withColumn("row", F.monotonically_increasing_id()),
        "pieces",
    )
    seen = read.filter(F.size("found") > 0).select("row", F.posexplode("found").alias("place", "entity"))
    seen = staged(seen.withColumn("kind", kind_of(F.col("entity"))).withColumn("form", canonical(F.col("kind"), F.col("entity"))), "entities")
    named = read.filter("names is not null").select(F.inline("names")).filter("sex is not null")
    sexes = named.groupBy(F.lower("word").alias("form")).agg(F.min("sex").alias("least"), F.max("sex").alias("most"))
    sexes = sexes.select(F.lit("name").alias("kind"), "form", F.when(F.col("least") == F.col("most"), F.col("most")).alias("sex"))
    entities = seen.select("kind", "form").distinct().join(sexes, ["kind", "form"], "left")
    aliases = broadcast_up_to(distinct_surrogates(entities, key), 100_000)
    new = seen.join(aliases, ["kind", "form"]).withColumn("new", rendered(F.col("kind"), F.col("entity"), F.col("alias")))
    rows = new.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("place", "new"))).alias("new"))
    mixed = F.transform("pieces", lambda p, i: F.when(i % 2 == 1, F.get(F.col("new"), ((i - 1) / 2).cast("int"))["new"]).otherwise(p))
    back = lambda x: F.replace(F.replace(x, F.lit(ESCAPE + "a"), F.lit(CUT)), F.lit(ESCAPE + "b"), F.lit(ESCAPE))
    own = [F.col(f"rest.`{c}`").alias(c) for c in rest]
    with_some = read.filter(F.size("found") > 0).join(rows, "row").select(
        *own, back(F.array_join(mixed, "")).alias(text_col), F.size("found").cast("long").alias("n_entities")
    )
    plain = read.filter(F.coalesce(F.size("found"), F.lit(0)) <= 0).select(*own, back(F.get("pieces", F.lit(0))).alias(text_col), F.lit(0).cast("long").alias("n_entities"))
    return with_some.union(plain)


def op8_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return surrogates(docs, KEY)


QUERIES = {"op8_surrogates": op8_surrogates}
SQL: dict[str, str] = {}
