"""Personal data replaced by surrogates, in DataFrame functions only.

Entities (e-mail, phone, IP of both versions, social security and account numbers, cards with a right check digit,
credentials, persons after a title) are found by pattern. All distinct entities of the corpus form a table; each gets a
surrogate of its own type, keyed by a secret: letters stay letters of their script and case, digits digits, hex stays hex,
punctuation stays, cards keep their first digit and a valid check digit, account numbers their country and valid check
digits, phone numbers their dialling code, given names gender and script, addresses end in the reserved top-level domain
`example`.

A person has up to four parts after the title, with hyphens, apostrophes and inner capitals; the last is the family name,
the others are given names, and initials and particles between them stay. Names wholly in capitals are the same names and
stay in capitals. One entity has one surrogate in all documents and notations (coreference). In a text that names a person
after a title, the same given or family name standing alone, or as a part of a hyphenated name, gets the same surrogate. A surrogate that another entity has, or that
is itself an entity of the corpus, is drawn anew until there is none (distinctness); the rounds run on the entity table
alone. Texts without any candidate character never leave their partition.

Defined cases: null and empty texts are returned as they are; texts of any length are searched as a whole, also without a
space or with thousands of parts in an address; equal texts get equal results; repeated rows and null ids are kept; an empty table gives an empty result; all columns of the input are kept, only text (and n_chars, where there
is such a column) changes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, materialize

KEY = "motecraft-surrogates-1"

#: Titles with the gender they tell (n: none).
TITLES = {"Mr": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Dr": "n", "Prof": "n", "Herr": "m", "Frau": "f", "Monsieur": "m", "Madame": "f", "Mme": "f", "Señor": "m", "Señora": "f", "Г-н": "m", "Г-жа": "f"}
#: Words in lower case between the parts of a name.
PARTICLES = ["al", "bin", "da", "de", "del", "den", "der", "di", "dos", "du", "el", "la", "le", "van", "von", "zu"]
#: Given names that stand in, by gender and script (l: Latin, c: Cyrillic, g: Greek); others are coined.
GIVEN = {
    "ml": ["Adam", "Bruno", "Carl", "David", "Emil", "Felix", "Georg", "Hugo", "Ivan", "Jonas", "Leo", "Martin", "Oscar", "Paul", "Simon", "Victor"],
    "fl": ["Alma", "Berta", "Clara", "Dora", "Elena", "Flora", "Greta", "Helen", "Irma", "Julia", "Laura", "Maria", "Nora", "Paula", "Sofia", "Vera"],
    "nl": ["Alex", "Andrea", "Charlie", "Dominique", "Eden", "Francis", "Jamie", "Kim", "Lee", "Morgan", "Noel", "Robin", "Sam", "Sascha", "Taylor", "Toni"],
    "mc": ["Антон", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Иван", "Кирилл", "Лев", "Максим", "Никита", "Олег", "Павел", "Роман", "Семён", "Тимур"],
    "fc": ["Анна", "Вера", "Галина", "Дарья", "Елена", "Жанна", "Зоя", "Ирина", "Лариса", "Мария", "Нина", "Ольга", "Полина", "Раиса", "Софья", "Таисия"],
    "mg": ["Αλέξης", "Ανδρέας", "Γιάννης", "Γιώργος", "Δημήτρης", "Ηλίας", "Θανάσης", "Κώστας", "Λεωνίδας", "Μάριος", "Νίκος", "Ορέστης", "Πέτρος", "Σπύρος", "Στέφανος", "Φώτης"],
    "fg": ["Άννα", "Γεωργία", "Δήμητρα", "Ειρήνη", "Ελένη", "Ζωή", "Ιωάννα", "Καλλιόπη", "Κατερίνα", "Λίνα", "Μαρία", "Νίκη", "Ξένια", "Ρένα", "Σοφία", "Χριστίνα"],
    "nc": ["Валя", "Женя", "Саша", "Слава", "Шура", "Вася", "Лёня", "Миша", "Паша", "Рома", "Сева", "Тоня", "Юля", "Яна", "Ника", "Лена"],
}
#: What a name is made of. Repetition of groups is bounded, as the expression engine recurs there.
_SPACE = r"[ \u00A0]{1,3}"
NAME = r"\p{Lu}(?:['’]\p{Lu})?[\p{L}\p{M}]++(?:['’-](?![sS](?!\p{L}))\p{L}[\p{L}\p{M}]*+){0,4}+"
#: Titles as they are written; short ones in capitals only with their point, as they are words of other kinds too.
TITLE = "|".join(t + (r"\." if t.isupper() and len(t) <= 3 else r"\.?") for t in sorted({w for t in TITLES for w in (t, t.upper())}, key=lambda t: (-len(t), t)))
_HEX = "[0-9A-Fa-f]{1,4}"
#: Fixed patterns, the more specific ones first. Addresses have the lengths that mail allows, 64 characters before the sign
#: and 127 parts of 63 after it; that, and not going back, keeps the time in proportion to the text.
PATTERNS = {
    "secret": r"(?i:password|passwd|pwd|token|secret|api_key|apikey)\s{0,3}[=:]\s{0,3}[\"']?[A-Za-z0-9+/_-]{8,}",
    "aws": r"(?<![A-Za-z0-9])AKIA[A-Z0-9]{16}(?![A-Za-z0-9])",
    "email": r"[\p{L}\p{N}_%+-][\p{L}\p{N}._%+-]{0,63}+@[\p{L}\p{N}-]{1,63}+(?:\.[\p{L}\p{N}-]{1,63}+){1,126}+",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?![\d]|\.\d)",
    "ipsix": rf"(?<![\p{{L}}\d:.])(?:(?:{_HEX}:){{7}}{_HEX}|(?:{_HEX}:){{2,6}}(?::{_HEX}){{1,5}}|(?:2[0-9A-Fa-f]{{3}}|(?i:fe80|f[cd][0-9a-f]{{2}})):(?::{_HEX}){{1,6}})(?![\p{{L}}\d:])",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}(?!\d)|\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|(?<![\d-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d-])",
    "card": r"(?<![\d.-])(?:\d{13,19}|\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{1,7}|\d{4}[ -]\d{6}[ -]\d{5})(?![\d-])",
    "person": rf"(?<![\p{{L}}])(?:{TITLE}){_SPACE}(?:(?:{NAME}|\p{{Lu}}\.|{'|'.join(PARTICLES)}){_SPACE}){{0,3}}{NAME}",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: What every match holds, found in one cheap pass: most characters are told by two sets.
HINT = r"[0-9@=:]|(?=[" + "".join(sorted({t[0] for t in TITLES} | {"A"})) + rf"])(?:AKIA|(?:{TITLE}){_SPACE}\p{{L}})"

#: Dialling codes have one, two or three digits.
DIALLING = r"^\+(?:1|7|2[07]|3[0123469]|4[013456789]|5[1-8]|6[0-6]|8[1246]|9[0123458]|\d{3})"
#: The letters that stand in for these in names of other scripts.
_COINED = "abdefgiklmnoprstuvz"
_SCRIPTS = {"c": ("Cyrillic", "абдефгиклмнопрстувз"), "g": ("Greek", "αβδεφγικλμνοπρστυχζ"), "a": ("Armenian", "աբդեֆգիկլմնօպրստըվզ")}
#: Letters of scripts without capitals, which stand in for letters of theirs.
_CASELESS = {
    "Arabic": "ابتجدرسعفقلمنهوي",
    "Hebrew": "אבגדהוזחטיכלמנסע",
    "Han": "人口土山川心手日月木水火田目耳金",
    "Hiragana": "あいうえおかきくけこさしすせそた",
    "Katakana": "アイウエオカキクケコサシスセソタ",
    "Hangul": "가나다라마바사아자차카타파하고노",
    "Devanagari": "अआइईउकखगघचजटडतदन",
    "Thai": "กขคงจชซดตถทนบปผพ",
}
_CONSONANTS, _VOWELS = "bdfgklmnprstvz", "aeiou"
_CHARS = r"(?s)."


def _kind(mention: Column) -> Column:
    found = F.lit("person")
    for name, pattern in reversed(PATTERNS.items()):
        if name != "person":
            found = F.when(mention.rlike(f"^(?:{pattern})$"), _valid_card(mention) if name == "card" else F.lit(name)).otherwise(found)
    return found


def _valid_card(mention: Column) -> Column:
    """`card` if the check digit is right; other long numbers are not personal."""
    digits = _bare(mention)
    return F.when(_check_digit(F.substring(digits, F.lit(1), F.length(digits) - 1)) == F.right(digits, F.lit(1)), "card").otherwise("none")


def _script(name: Column) -> Column:
    found = F.lit("l")
    for letter, (script, _) in _SCRIPTS.items():
        found = F.when(name.rlike(rf"^\p{{Is{script}}}"), letter).otherwise(found)
    return found


def _bare(mention: Column) -> Column:
    return F.regexp_replace(mention, r"[ .()-]", "")


def _secret_start(mention: Column) -> Column:
    return F.regexp_extract(mention, r"^[A-Za-z_]+\s*[=:]\s*[\"']?", 0)


def _person(mention: Column) -> tuple[Column, Column, Column]:
    """Title with what follows it up to the name, gender, and pieces: names, and what stands between them; the last is a name."""
    start = F.regexp_extract(mention, rf"^(?:{TITLE}){_SPACE}", 0)
    gender = F.create_map(*[F.lit(x) for t, g in TITLES.items() for x in (t.lower(), g)])[F.lower(F.regexp_replace(start, r"\.?[ \u00A0]+$", ""))]
    pieces = F.regexp_extract_all(F.substring(mention, F.length(start) + 1, F.length(mention)), F.lit(rf"{NAME}|\p{{Lu}}|\P{{Lu}}++"), F.lit(0))
    return start, gender, pieces


def _is_name(piece: Column) -> Column:
    return piece.rlike(rf"^{NAME}$")


def _capitals(name: Column) -> Column:
    """Whether a name is wholly in capitals."""
    return name.rlike(r"^[\p{Lu}\p{M}'’-]{2,}$")


def _canonical(name: Column) -> Column:
    """A name in capitals as it is else written."""
    parts = F.regexp_extract_all(name, F.lit(r"[\p{L}\p{M}]++|[^\p{L}\p{M}]++"), F.lit(0))
    small = F.array_join(F.transform(parts, lambda x: F.concat(F.substring(x, 1, 1), F.lower(F.substring(x, F.lit(2), F.length(x))))), "")
    return F.when(_capitals(name), small).otherwise(name)


def _name_key(name: Column, gender: Column, is_family: Column) -> Column:
    group = F.when(is_family, F.lit("family_")).otherwise(F.concat(F.lit("given_"), gender))
    return let(_canonical(name), lambda plain: F.concat(group, _script(plain), F.lit(":"), plain))


def _of_names(mention: Column, made) -> Column:
    """`made(piece, key)` of each piece of a person, where the key is null for what isn't a name."""
    _, gender, pieces = _person(mention)
    one = lambda x, key: let(key, lambda key: made(x, key))
    return let(pieces, lambda all_: F.transform(all_, lambda x, i: one(x, F.when(_is_name(x), _name_key(x, gender, i == F.size(all_) - 1)))))


def _value_key(mention: Column, kind: Column) -> Column:
    """The entity that a mention of any kind but persons and none names."""
    value = F.when(kind.isin("phone", "card", "ssn", "iban"), _bare(mention)).when(kind.isin("email", "ipsix"), F.lower(mention)).when(kind == "secret", F.regexp_replace(mention, r"^[A-Za-z_]+\s*[=:]\s*[\"']?", "")).otherwise(mention)
    return F.concat(kind, F.lit(":"), value)


def entity_keys(mention: Column) -> Column:
    """The entities a mention names, as `type:canonical form`: one, or given names and family name of a person."""
    names = F.filter(_of_names(mention, lambda _, key: key), lambda x: x.isNotNull())
    return let(_kind(mention), lambda kind: F.when(kind == "person", names).when(kind == "none", F.array().cast("array<string>")).otherwise(F.array(_value_key(mention, kind))))


def _byte(stream: Column, i) -> Column:
    return F.conv(F.substring(stream, (F.lit(2) * (i % 128) + 1).cast("int"), F.lit(2)), 16, 10).cast("int")


def _like(value: Column, stream: Column, hexed: Column | None = None) -> Column:
    """A string of the same format: digit for digit, letter for letter of the same case and script.

    Where `hexed`, a value of hexadecimal digits stays one.
    """
    digits = F.when(value.rlike("^[0-9a-f:]+$"), "0123456789abcdef").when(value.rlike("^[0-9A-F]+$"), "0123456789ABCDEF")

    def of(digits: Column) -> Column:
        def one(c: Column, i: Column) -> Column:
            letters = F.coalesce(F.when(c != ":", digits), _standing_in(c))
            return F.coalesce(let(letters, lambda a: F.substring(F.when(c.rlike(r"\p{Lu}"), F.upper(a)).otherwise(a), _byte(stream, i) % F.length(a) + 1, F.lit(1))), c)

        return F.array_join(F.transform(F.regexp_extract_all(value, F.lit(_CHARS), F.lit(0)), one), "")

    return let(F.lit(None).cast("string") if hexed is None else F.when(hexed, digits), of)


def _standing_in(c: Column) -> Column:
    """The characters that can stand in for one, in small letters; null for what stays."""
    found = F.when(c.rlike("[0-9]"), "123456789").when(c.rlike("[A-Za-z]"), "abcdefghijklmnopqrstuvwxyz")
    for script, letters in [*_SCRIPTS.values(), *_CASELESS.items()]:
        found = found.when(c.rlike(rf"[\p{{L}}&&\p{{Is{script}}}]"), letters)
    return found.when(c.rlike(r"\p{L}"), "abcdefghijklmnopqrstuvwxyz")


def _check_digit(start: Column) -> Column:
    """The digit that makes a card number valid after the digits `start`."""
    digits = F.reverse(F.regexp_extract_all(start, F.lit(r"\d"), F.lit(0)))
    doubled = lambda d: F.when(d > 4, d * 2 - 9).otherwise(d * 2)
    values = F.transform(digits, lambda c, i: F.when(i % 2 == 0, doubled(c.cast("int"))).otherwise(c.cast("int")))
    total = F.aggregate(values, F.lit(0), lambda a, x: a + x)
    return (F.pmod(10 - total % 10, F.lit(10))).cast("string")


def _account_digits(rest: Column) -> Column:
    """The two digits that make an account number valid, from its body followed by its country."""
    add = lambda a, c: F.when(c.rlike("[0-9]"), a * 10 + c.cast("int")).otherwise(a * 100 + F.ascii(c) - 55) % 97
    left = F.aggregate(F.regexp_extract_all(F.concat(rest, F.lit("00")), F.lit("[0-9A-Z]"), F.lit(0)), F.lit(0), add)
    return F.lpad((98 - left).cast("string"), 2, "0")


def _syllables(stream: Column, n: Column) -> Column:
    one = lambda i: F.concat(F.substring(F.lit(_CONSONANTS), _byte(stream, 2 * i) % len(_CONSONANTS) + 1, F.lit(1)), F.substring(F.lit(_VOWELS), _byte(stream, 2 * i + 1) % len(_VOWELS) + 1, F.lit(1)))
    return F.initcap(F.array_join(F.transform(F.sequence(F.lit(1), n), one), ""))


def surrogate(kind: Column, value: Column, attempt: Column, key: str = KEY) -> Column:
    """The surrogate of an entity in its canonical form, at one attempt."""

    dialling, country = F.regexp_extract(value, DIALLING, 0), F.substring(value, 1, 2)
    is_family, is_given, dialled = kind.startswith("family"), kind.startswith("given"), (kind == "phone") & value.startswith("+")
    # what is imitated character for character; null where nothing is
    body = F.when(is_family | is_given | (kind == "ip"), None).when(kind == "email", F.regexp_extract(value, "^[^@]*", 0)).when(kind == "card", F.substring(value, F.lit(2), F.length(value) - 2))
    body = body.when(dialled, F.substring(value, F.length(dialling) + 1, F.length(value))).when(kind.isin("aws", "iban"), F.substring(value, F.lit(5), F.length(value))).otherwise(value)

    def by_stream(stream: Column) -> Column:
        return let(let(body, lambda x: _like(x, stream, kind.isin("secret", "ipsix"))), lambda like: by_body(stream, like))

    def by_body(stream: Column, like: Column) -> Column:
        domain = F.regexp_extract(value, r"@(.*)$", 1)
        domain_stream = F.concat(*[F.sha2(F.concat_ws("|", F.lit(key), F.lit("domain"), domain, F.lit(k)), 256) for k in range(4)])
        email = F.concat(like, F.lit("@"), let(domain_stream, lambda own: _like(F.regexp_replace(domain, r"\.[^.]*$", ""), own)), F.lit(".example"))
        made = F.when(kind == "email", email).when(kind == "ip", F.concat_ws(".", *[(_byte(stream, F.lit(k)) * 7 + _byte(stream, F.lit(k + 4))) % 254 + 1 for k in range(4)]))
        made = made.when(kind == "card", let(F.concat(F.substring(value, 1, 1), like), lambda card: F.concat(card, _check_digit(card))))
        made = made.when(dialled, F.concat(dialling, like)).when(kind == "aws", F.concat(F.lit("AKIA"), like))
        made = made.when(kind == "iban", F.concat(country, _account_digits(F.concat(like, country)), like))
        return made.when(is_family | is_given, let(family(stream), lambda coined: F.when(is_family, coined).otherwise(given(stream, coined)))).otherwise(like)

    def family(stream: Column) -> Column:
        def written(latin: Column) -> Column:
            found = latin
            for letter, (_, letters) in _SCRIPTS.items():
                found = F.when(F.right(kind, F.lit(1)) == letter, F.initcap(F.translate(F.lower(latin), _COINED, letters))).otherwise(found)
            return found

        return let(_syllables(stream, (3 + attempt / 2).cast("int")), written)

    def given(stream: Column, coined: Column) -> Column:
        names = F.create_map(*[x for group, names in GIVEN.items() for x in (F.lit(f"given_{group}"), F.array(*map(F.lit, names)))])[kind]
        name = lambda names, k: F.get(names, _byte(stream, F.lit(k)) % F.size(names))
        more = lambda names: F.when(attempt > 3, F.concat(F.lit("-"), coined)).when(attempt > 0, F.concat(F.lit("-"), name(names, 9))).otherwise("")
        return let(names, lambda names: F.when(names.isNull(), coined).otherwise(F.concat(name(names, 8), more(names))))

    stream = F.concat(*[F.sha2(F.concat_ws("|", F.lit(key), kind, value, attempt.cast("string"), F.lit(k)), 256) for k in range(4)])
    return let(stream, by_stream)


def assign(entities: DataFrame, key: str = KEY) -> DataFrame:
    """`entity` and `surrogate` for the distinct `entity` strings; no two of a type get the same one, and none an entity's own."""
    kind, value = F.split_part("entity", F.lit(":"), F.lit(1)), F.regexp_extract("entity", r"(?s)^[^:]*:(.*)$", 1)
    family = F.regexp_replace("kind", "_.*", "")
    drawn = materialize(entities.select("entity", kind.alias("kind"), value.alias("value"), F.lit(0).alias("attempt")))
    own = drawn.select(family.alias("of"), F.col("value").alias("surrogate"), F.lit(True).alias("taken")).distinct()
    while True:
        made = drawn.withColumn("surrogate", surrogate(F.col("kind"), F.col("value"), F.col("attempt"), key)).withColumn("of", family)
        order = Window.partitionBy("of", "surrogate").orderBy("attempt", "kind", "value")
        ranked = made.withColumn("rank", F.row_number().over(order)).join(own, ["of", "surrogate"], "left")
        ranked = materialize(ranked.withColumn("again", (F.col("rank") > 1) | F.coalesce("taken", F.lit(False))))
        if ranked.where("again").isEmpty():
            return ranked.select("entity", "surrogate")
        drawn = ranked.select("entity", "kind", "value", (F.col("attempt") + F.col("again").cast("int")).alias("attempt"))


def _written(mention: Column, known: Column) -> Column:
    """The surrogate of a mention, in the mention's own notation."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("i"))

    def spaced(made: Column) -> Column:
        def step(acc: Column, c: Column) -> Column:
            skip = c.rlike(r"[ .()-]")
            return F.struct(F.concat(acc["out"], F.when(skip, c).otherwise(F.substring(made, acc["i"], F.lit(1)))).alias("out"), (acc["i"] + F.when(skip, 0).otherwise(1)).alias("i"))

        return F.aggregate(F.regexp_extract_all(mention, F.lit(_CHARS), F.lit(0)), start, step, lambda acc: acc["out"])

    named = lambda x, key: F.when(key.isNull(), x).when(_capitals(x), F.upper(known[key])).otherwise(known[key])
    names = F.concat(_person(mention)[0], F.array_join(_of_names(mention, named), ""))
    value = lambda made, kind: F.when(kind.isin("phone", "card", "ssn", "iban"), spaced(made)).when(kind == "secret", F.concat(_secret_start(mention), made)).otherwise(made)
    return let(_kind(mention), lambda kind: F.when(kind == "none", mention).when(kind == "person", names).otherwise(let(known[_value_key(mention, kind)], lambda made: value(made, kind))))


def _bare_names(known: Column) -> Column:
    """The names of a text's persons and their surrogates; where a name is both a family's and a given one, the family's."""
    name = lambda e: F.split_part(e["key"], F.lit(":"), F.lit(2))
    pairs = F.array_sort(F.filter(F.map_entries(known), lambda e: e["key"].rlike("^(?:family|given)_")))

    def mapped(pairs: Column) -> Column:
        words = F.array_distinct(F.transform(pairs, name))
        return F.map_from_arrays(words, F.transform(words, lambda w: F.filter(pairs, lambda e: name(e) == w)[0]["value"]))

    return let(pairs, mapped)


def _without_names(gap: Column, names: Column) -> Column:
    """What stands between mentions, with the surrogates of bare names."""
    letters = r"[\p{L}\p{M}]++|[^\p{L}\p{M}]++"
    of = lambda w: F.when(_capitals(w), F.upper(names[_canonical(w)])).otherwise(names[w])
    parts = lambda w: F.array_join(F.transform(F.regexp_extract_all(w, F.lit(letters), F.lit(0)), lambda x: F.coalesce(of(x), x)), "")
    words = F.regexp_extract_all(gap, F.lit(f"{NAME}|{letters}"), F.lit(0))
    return F.when(F.size(names) > 0, F.array_join(F.transform(words, lambda w: F.coalesce(of(w), F.when(w.rlike("['’-]"), parts(w)), w)), "")).otherwise(gap)


def replace(docs: DataFrame, text: str = "text", key: str = KEY, count: str | None = None) -> DataFrame:
    """`docs` with surrogates in `text`; `count` names a column for the number of mentions replaced."""
    columns = docs.columns
    hinted = F.coalesce(F.col(text).rlike(HINT), F.lit(False))
    zero = {count: F.lit(0).cast("long")} if count else {}
    plain = docs.where(~hinted).select(*[F.col(f"`{c}`") for c in columns], *[v.alias(k) for k, v in zero.items()])
    row = F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row")
    found = docs.where(hinted).select(row, F.md5(text).alias("text_md5"), F.regexp_extract_all(text, F.lit(ANY), F.lit(0)).alias("mentions"))
    named = materialize(found.where(F.size("mentions") > 0).select("text_md5", F.explode(F.array_distinct(F.flatten(F.transform("mentions", entity_keys)))).alias("entity")).distinct())
    table = assign(named.select("entity").distinct(), key)
    known = named.join(table, "entity").groupBy("text_md5").agg(F.map_from_entries(F.collect_list(F.struct("entity", "surrogate"))).alias("known"))
    changed = found.join(known, "text_md5", "left").withColumn("known", F.coalesce("known", F.create_map().cast("map<string,string>")))
    changed = changed.withColumn("names", _bare_names(F.col("known")))
    gaps = F.split(F.col(f"row.{text}"), ANY, -1)
    made = F.array_join(F.zip_with(gaps, F.transform("mentions", lambda m: _written(m, F.col("known"))), lambda gap, new: F.concat(_without_names(gap, F.col("names")), F.coalesce(new, F.lit("")))), "")
    new = F.when(F.size("mentions") > 0, made).otherwise(F.col(f"row.{text}"))
    values = {c: F.col(f"row.`{c}`") for c in columns} | {text: F.col("new")} | ({"n_chars": F.length("new").cast("long")} if "n_chars" in columns else {})
    changed = changed.withColumn("new", new).select(*[values[c].alias(c) for c in columns], *([F.size(F.filter("mentions", lambda m: _kind(m) != "none")).cast("long").alias(count)] if count else []))
    return plain.unionByName(changed)
