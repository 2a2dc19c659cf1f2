"""Personal data replaced by surrogates, in DataFrame functions only.

Detected entities are replaced by keyed values of the same type and format. The replacement depends on the key, the
type and the entity's canonical form alone (an e-mail in lower case, a phone number with its country code unless that is
the home country's, the digits of a card, an IBAN without spaces, one name of a person in lower case), so that every
mention of an entity, however written, gets the same surrogate: coreference holds in the whole corpus. Digits replace
digits, letters replace letters of the same case and script, punctuation and prefixes stay. A card number that passes
the Luhn check has a surrogate that does, and the surrogate of an IBAN has valid check digits. A person is a name after
a title, or a known given name with a family name; given and family names are entities by themselves, so that
`Mr. John Smith` and `Mr. Smith` keep one family name. A given name keeps its gender, a name its script.

Distinctness is checked on the distinct entities: if two would get the same surrogate, or a surrogate is an entity of
the corpus, all but the smallest entity are keyed again with a higher attempt, until no clash is left. Later attempts
widen names, mailboxes and secrets; a type whose values are used up ends in an error after ROUNDS rounds. Given names
may be reused for each other, since they tell nobody apart alone, but two of them never get the same one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace, column_name, let

# Given names by gender and script, syllables of surnames by script, alphabets by script, titles.
GIVEN = {
    ("male", "Latin"): ["James", "John", "Robert", "Michael", "William", "David", "Richard", "Thomas", "Daniel", "Paul", "Peter", "Martin", "Hans", "Klaus", "Jürgen", "Stefan", "Jean", "Pierre", "Jacques", "Luc", "José", "Juan", "Carlos", "Luis"],
    ("female", "Latin"): ["Mary", "Patricia", "Jennifer", "Linda", "Elizabeth", "Susan", "Sarah", "Karen", "Anna", "Maria", "Emma", "Laura", "Ursula", "Petra", "Sabine", "Monika", "Marie", "Sophie", "Isabelle", "Camille", "Carmen", "Ana", "Lucía", "Elena"],
    ("male", "Cyrillic"): ["Антон", "Борис", "Виктор", "Григорий", "Денис", "Егор", "Иван", "Кирилл", "Лев", "Максим", "Никита", "Олег", "Павел", "Роман", "Сергей", "Тимур"],
    ("female", "Cyrillic"): ["Анна", "Вера", "Галина", "Дарья", "Елена", "Жанна", "Зоя", "Ирина", "Ксения", "Лидия", "Мария", "Нина", "Ольга", "Полина", "Раиса", "София"],
    ("male", "Greek"): ["Αλέξης", "Βασίλης", "Γιώργος", "Δημήτρης", "Ηλίας", "Θάνος", "Κώστας", "Λευτέρης", "Μάνος", "Νίκος", "Παύλος", "Πέτρος", "Σπύρος", "Τάσος", "Φώτης", "Χρήστος"],
    ("female", "Greek"): ["Άννα", "Βάσω", "Γεωργία", "Δήμητρα", "Ελένη", "Ζωή", "Ηρώ", "Θάλεια", "Ιωάννα", "Κατερίνα", "Λίνα", "Μαρία", "Νίκη", "Όλγα", "Σοφία", "Χριστίνα"],
}
SYLLABLES = {
    "Latin": ["ba", "bel", "bor", "can", "cor", "dal", "den", "dor", "fal", "fen", "gar", "gel", "hal", "hen", "kal", "kes", "lan", "lem", "lor", "mar", "mel", "mor", "nar", "nel", "par", "pel", "ran", "ros", "sal", "sen", "tal", "ver"],
    "Cyrillic": ["ба", "бел", "бор", "ван", "вер", "гал", "гор", "дан", "дор", "жар", "зан", "зор", "кал", "кор", "лан", "лес", "мар", "мел", "мор", "нар", "нел", "пар", "пет", "ран", "рос", "сал", "сен", "тал", "тор", "фал", "хор", "чер"],
    "Greek": ["βα", "βελ", "βορ", "γα", "γελ", "δα", "δελ", "δορ", "ζα", "θα", "θελ", "κα", "καλ", "κορ", "λα", "λεν", "μα", "μαρ", "μελ", "να", "νελ", "πα", "παλ", "πετ", "ρα", "ροδ", "σα", "σελ", "τα", "ταλ", "φα", "χα"],
}
ALPHABETS = {"Latin": "abcdefghijklmnopqrstuvwxyz", "Cyrillic": "абвгдежзиклмнопрстуфхцчшэюя", "Greek": "αβγδεζηθικλμνξοπρστυφχψω"}
_MALE, _FEMALE = r"Mr|Herrn?|Monsieur|Señor|Sr|Г-н|Господин|Κύριος", r"Mrs|Ms|Miss|Frau|Madame|Mme|Mademoiselle|Señora|Señorita|Sra|Srta|Г-жа|Госпожа|Κυρία"
_EITHER = r"Dr|Prof|Doctor|Professor|Doktor"
_COUNTRY = r"1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3}"

_EMAIL = r"(?<![\p{L}\p{N}._%+\-])[\p{L}\p{N}._%+\-]++@(?:[\p{L}\p{N}\-]+\.)+\p{L}{2,}"
_SECRET = r"AKIA[0-9A-Z]{16}|(?i:password|passwd|secret|token|api[_-]?key)\s?[=:]\s?[\"']?[A-Za-z0-9+/_\-]{8,}"
_IBAN = r"(?<![\p{L}\p{N}])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])"
_CARD = r"(?<![\p{N}.\-])[0-9]{4}(?:[ \-]?[0-9]{4}){2}[ \-]?[0-9]{1,7}(?![\p{N}\-])"
_IP = r"(?<![\p{N}.])(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}(?![\p{N}]|\.[0-9])"
_SSN = r"(?<![\p{N}\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\p{N}\-])"
_PHONE = r"(?:\+[0-9]{1,3}[ .\-]?)?(?:\([0-9]{2,4}\)|(?<![\p{N}])[0-9]{3})[ .\-]?[0-9]{3}[ .\-][0-9]{4}(?![\p{N}])|\+[0-9]{1,3}(?:[ .\-]?[0-9]{2,4}){2,5}(?![\p{N}])"
_TITLE = rf"(?:(?:{_MALE}|{_FEMALE}|{_EITHER})\.? )+"
_NAME = r"\p{Lu}[\p{L}'’\-]+"
_KNOWN = "|".join(n for table in GIVEN.values() for n in table)
_PERSON = rf"(?<![\p{{L}}\p{{N}}])(?=\p{{Lu}})(?:{_TITLE}{_NAME}(?: {_NAME})?|(?:{_KNOWN}) {_NAME})"
#: Order decides: the first type that matches at a place has it.
TYPES = {"email": _EMAIL, "secret": _SECRET, "person": _PERSON, "iban": _IBAN, "card": _CARD, "ip": _IP, "ssn": _SSN, "phone": _PHONE}
_ALL = "|".join(f"(?:{p})" for p in TYPES.values())
#: A text without any of these has no entity.
_HINT = rf"[0-9@]|(?i:password|passwd|secret|token|api[_-]?key)|{_PERSON}"
#: Attempts after which values are widened, and rounds after which the search for distinct values gives up.
WIDEN, ROUNDS = 3, 64


def _draws(key: str, kind: Column, canonical: Column, attempt: Column, n: int) -> Column:
    """n numbers from 0 to 65535 that the key, type, entity and attempt decide."""
    seed = F.concat_ws("\x1f", F.lit(key), kind, canonical, attempt.cast("string"))
    digests = F.concat(*[F.sha2(F.concat(seed, F.lit(f"\x1f{i}")), 256) for i in range(-(-n // 16))])
    return let(digests, lambda h: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.conv(F.substring(h, i * 4 + 1, F.lit(4)), 16, 10).cast("int")))


def _at(draws: Column, i: Column, n: int) -> Column:
    return F.get(draws, F.pmod(i, F.lit(n)).cast("int"))


def _reshape(value: Column, draws: Column, n: int, letters: bool, digits_from_right: int | None = None, hexadecimal: Column | None = None) -> Column:
    """value with digits (and letters) replaced by drawn ones of the same kind; other characters stay."""
    chars = F.split(value, "")
    hexadecimal = F.lit(False) if hexadecimal is None else hexadecimal

    def one(c: Column, i: Column) -> Column:
        return let(_at(draws, i, n), lambda d: replaced(c, d))

    def replaced(c: Column, d: Column) -> Column:
        out = F.when(hexadecimal & c.rlike("[0-9a-f]"), F.substring(F.lit("0123456789abcdef"), (d % 16 + 1).cast("int"), F.lit(1))).when(c.rlike("[0-9]"), (d % 10).cast("string"))
        if letters:
            for script, alphabet in ALPHABETS.items():
                test = rf"\p{{Is{script}}}"
                low = F.substring(F.lit(alphabet), (d % len(alphabet) + 1).cast("int"), F.lit(1))
                out = out.when(c.rlike(test) & c.rlike(r"\p{Lu}"), F.upper(low)).when(c.rlike(test), low)
        return out.otherwise(c)

    return F.array_join(F.transform(chars, one), "")


def _luhn(digits: Column) -> Column:
    """Luhn sum of a string of digits, modulo 10."""
    d = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 1, F.when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)).otherwise(c.cast("int")))
    return F.aggregate(d, F.lit(0), lambda a, b: a + b) % 10


def _mod97(value: Column) -> Column:
    """Remainder by 97 of a string of digits and capital letters, a letter counting 10 to 35."""
    step = lambda a, c: F.when(c.rlike("[0-9]"), a * 10 + c.cast("int")).otherwise(a * 100 + F.ascii(c) - 55) % 97
    return F.aggregate(F.split(value, ""), F.lit(0), step)


def _canonical(kind: Column, value: Column, home: str) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    abroad = F.when(value.startswith("+"), F.when(digits.rlike(f"^{home}[0-9]{{10}}$"), F.right(digits, F.lit(10))).otherwise(F.concat(F.lit("+"), digits)))
    return (
        F.when(kind == "phone", F.coalesce(abroad, digits))
        .when(kind.isin("card", "ssn"), digits)
        .when(kind == "iban", F.regexp_replace(value, " ", ""))
        .when(kind == "secret", F.regexp_extract(value, r"([A-Za-z0-9+/_\-]{8,})$", 1))
        .when(kind == "ip", value)
        .otherwise(F.lower(value))
    )


def _script(value: Column) -> Column:
    return F.when(value.rlike(r"\p{IsCyrillic}"), "Cyrillic").when(value.rlike(r"\p{IsGreek}"), "Greek").otherwise("Latin")


def _fill_digits(value: Column, digits: Column) -> Column:
    """value with its last digits replaced, from the right, by those of `digits`; earlier digits stay."""
    n = F.length(F.regexp_replace(value, "[^0-9]", ""))
    return _pour(value, digits, "[0-9]", n - F.length(digits))


def _pour(value: Column, chars: Column, where: str, skip: Column) -> Column:
    """value with its characters that match `where`, but for the first `skip` of them, replaced by those of chars in turn."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("seen"))

    def step(acc: Column, c: Column) -> Column:
        mine = c.rlike(where)
        k = acc["seen"] + 1 - skip
        return F.struct(F.concat(acc["out"], F.when(mine & (k >= 1), F.substring(chars, k, F.lit(1))).otherwise(c)).alias("out"), (acc["seen"] + mine.cast("int")).alias("seen"))

    return F.aggregate(F.split(value, ""), start, step, lambda acc: acc["out"])


def _surrogate(key: str, kind: Column, value: Column, canonical: Column, attempt: Column) -> Column:
    """The replacement of an entity as written. Attempt, draws and digits are computed once."""

    def drawn(a: Column) -> Column:
        return let(_draws(key, kind, canonical, a, 48), lambda draws: let(_reshape(canonical, draws, 48, letters=False), lambda digits: _replacement(kind, value, canonical, draws, digits, a)))

    return let(attempt, drawn)


def _replacement(kind: Column, value: Column, canonical: Column, draws: Column, digits: Column, attempt: Column) -> Column:
    wider = F.greatest(attempt - WIDEN, F.lit(0))
    more = F.array_join(F.transform(F.slice(draws, F.lit(9), F.least(wider, F.lit(40))), lambda d: F.substring(F.lit(ALPHABETS["Latin"]), (d % 26 + 1).cast("int"), F.lit(1))), "")
    # the leading digit of a card tells its issuer; the last one is its check digit
    body = F.concat(F.substring(canonical, 1, 1), F.substring(digits, F.lit(2), F.length(digits) - 2))
    card = let(body, lambda b: F.concat(b, F.when(_luhn(canonical) == 0, F.pmod(F.lit(10) - _luhn(F.concat(b, F.lit("0"))), F.lit(10)).cast("string")).otherwise(F.right(digits, F.lit(1)))))
    # a country code and the national number's length stay, and that does not begin with 0 or 1
    code = F.when(canonical.startswith("+"), F.length(F.regexp_extract(canonical, rf"^\+({_COUNTRY})", 1)) + 1).otherwise(F.lit(0))
    national = F.concat((F.get(draws, F.lit(40)) % 8 + 2).cast("string"), F.substring(digits, code + 2, F.length(digits)))
    ip = F.array_join(F.transform(F.slice(draws, 1, 4), lambda d: (d % 254 + 1).cast("string")), ".")
    as_written = F.when(F.length(canonical) == F.length(value), value).otherwise(canonical)
    domain = F.regexp_extract(as_written, r"(\.\p{L}{2,})$", 1)
    email = let(domain, lambda end: F.concat(more, _reshape(F.substring(as_written, F.lit(1), F.length(as_written) - F.length(end)), draws, 48, letters=True), end))
    body_of_secret = _reshape(canonical, draws, 48, letters=True, hexadecimal=canonical.rlike("^[0-9a-f]+$"))
    secret = let(body_of_secret, lambda b: F.when(canonical.rlike("^AKIA[0-9A-Z]{16}$"), F.concat(F.lit("AKIA"), F.substring(b, F.lit(5), F.length(canonical)))).otherwise(F.concat(b, more)))
    secret = F.concat(F.substring(value, F.lit(1), F.length(value) - F.length(canonical)), secret)
    account = _reshape(F.substring(canonical, F.lit(5), F.length(canonical)), draws, 48, letters=True)
    iban = let(account, lambda a: let(F.lit(98) - _mod97(F.concat(a, F.substring(canonical, 1, 2), F.lit("00"))), lambda n: F.concat(F.substring(canonical, 1, 2), F.lpad(n.cast("string"), 2, "0"), a)))
    return (
        F.when(kind == "email", email)
        .when(kind == "phone", let(national, lambda d: _fill_digits(value, d)))
        .when(kind == "card", let(card, lambda d: _fill_digits(value, d)))
        .when(kind == "ssn", _fill_digits(value, digits))
        .when(kind == "ip", ip)
        .when(kind == "secret", secret)
        .when(kind == "iban", let(iban, lambda x: _pour(value, x, "[A-Z0-9]", F.lit(0))))
        .otherwise(_name(kind, value, draws, attempt))
    )


def _listed(values: list[str]) -> Column:
    """An array literal of values without spaces, made by one call."""
    return F.split(F.lit(" ".join(values)), " ")


def _syllables(table: list[str], draws: Column, n: Column) -> Column:
    return F.array_join(F.transform(F.slice(draws, F.lit(2), F.least(n, F.lit(40))), lambda d: F.get(_listed(table), d % len(table))), "")


def _name(kind: Column, value: Column, draws: Column, attempt: Column) -> Column:
    """A given or family name of the value's script; capitals stay capitals."""

    def of_script(script: Column) -> Column:
        made = listed = F.lit(None).cast("string")
        for s, syllables in SYLLABLES.items():
            made = F.when(script == s, _syllables(syllables, draws, F.lit(4) + F.floor(attempt / WIDEN).cast("int"))).otherwise(made)
            for g, names in (("given_male", GIVEN["male", s]), ("given_female", GIVEN["female", s]), ("given_either", GIVEN["male", s] + GIVEN["female", s])):
                listed = F.when((kind == g) & (script == s), F.get(_listed(names), F.get(draws, F.lit(0)) % len(names))).otherwise(listed)
        return F.when((kind != "family") & (attempt < WIDEN), listed).otherwise(F.initcap(made))

    return let(let(_script(value), of_script), lambda name: F.when((value == F.upper(value)) & (F.length(value) > 1), F.upper(name)).otherwise(name))


def _kind(value: Column) -> Column:
    out = None
    for name, pattern in TYPES.items():
        test = value.rlike(rf"^(?:{pattern})$")
        out = F.when(test, name) if out is None else out.when(test, name)
    return F.coalesce(out, F.lit("phone"))


def _title(value: Column) -> Column:
    return F.regexp_extract(value, rf"^({_TITLE})", 1)


def _parts(kind: Column, value: Column, home: str) -> Column:
    """The entities of a mention: the names of a person, or the mention itself; array of (kind, value, canonical)."""
    gender = F.when(value.rlike(rf"^(?:{_MALE})\.? "), "given_male").when(value.rlike(rf"^(?:{_FEMALE})\.? "), "given_female").otherwise("given_either")
    known = {g: _listed([n.lower() for (sex, _), table in GIVEN.items() if sex == g for n in table]) for g in ("male", "female")}

    def role(token: Column) -> Column:
        low = F.lower(token)
        return F.when(F.array_contains(known["male"], low), "given_male").when(F.array_contains(known["female"], low), "given_female").otherwise(gender)

    def part(k: Column, v: Column) -> Column:
        return F.struct(k.alias("kind"), v.alias("value"), _canonical(k, v, home).alias("canonical"))

    names = F.split(F.substring(value, F.length(_title(value)) + 1, F.length(value)), " ")
    person = let(names, lambda ns: F.transform(ns, lambda n, i: part(F.when(i == F.size(ns) - 1, "family").otherwise(role(n)), n)))
    return F.when(kind == "person", person).otherwise(F.array(part(kind, value)))


def _entities(text: Column, home: str = "1") -> Column:
    """Mentions of a text in order: array of (kind, value, parts)."""
    found = F.when(text.rlike(_HINT), F.regexp_extract_all(text, F.lit(_ALL), F.lit(0))).otherwise(F.array().cast("array<string>"))
    typed = F.transform(found, lambda v: F.struct(_kind(v).alias("kind"), v.alias("value")))
    return F.transform(typed, lambda e: F.struct(e["kind"].alias("kind"), e["value"].alias("value"), _parts(e["kind"], e["value"], home).alias("parts")))


def attempts(ws: Workspace, entities: DataFrame, key: str, home: str = "1") -> DataFrame:
    """(kind, canonical, attempt) of the entities that had to be keyed again; entities: (kind, canonical, value), repeats allowed.

    One spelling stands for all, because the canonical form of a surrogate depends on that of its entity alone.
    """
    table = ws.write(entities.groupBy("kind", "canonical").agg(F.min("value").alias("value")).withColumn("attempt", F.lit(0)), "entities")
    space = F.substring_index("kind", "_", 1)  # given names of either gender are told apart too
    taken = table.where("kind not like 'given%'").select(space.alias("space"), F.col("canonical").alias("made"))
    draw = let(_surrogate(key, F.col("kind"), F.col("value"), F.col("canonical"), F.col("attempt")), lambda x: _canonical(F.col("kind"), x, home))
    owner = F.struct("canonical", "kind")
    for _ in range(ROUNDS):
        made = ws.write(table.withColumn("space", space).withColumn("made", draw), "made")
        first = made.groupBy("space", "made").agg(F.min(owner).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
        real = made.join(taken, ["space", "made"], "left_semi").select("kind", "canonical")
        clash = ws.write(made.join(first, ["space", "made"]).where(owner != F.col("first")).select("kind", "canonical").union(real).distinct(), "clashes")
        if clash.isEmpty():
            return made.where("attempt > 0").select("kind", "canonical", "attempt")
        table = made.drop("made", "space").join(clash.withColumn("again", F.lit(1)), ["kind", "canonical"], "left").select("kind", "canonical", "value", (F.col("attempt") + F.coalesce("again", F.lit(0))).alias("attempt"))
    left = [tuple(r) for r in clash.groupBy("kind").count().orderBy("kind").collect()]  # one row for each type
    raise RuntimeError(f"no distinct surrogates after {ROUNDS} rounds (type, entities): {left}")


def pseudonymise(docs: DataFrame, key: str, *, text_col: str = "text", home: str = "1") -> DataFrame:
    """docs with personal data in the text replaced, and n_entities and kinds (sorted, distinct) added.

    A null text stays null and has no entities. Equal texts get equal results, whatever their ids. Columns that clash
    with the two added ones keep their names; the added ones then end in an underscore. Working columns never meet those
    of docs. An empty table gives an empty result. home: the country code that a national phone number stands for. The
    search for clashes runs when this is called.
    """
    ws = Workspace(docs.sparkSession, "surrogates")
    d = docs.select(F.struct("*").alias("row"), F.col(text_col).cast("string").alias("text"))
    d = d.withColumn("found", _entities(F.col("text"), home))
    text_key = F.xxhash64("text")  # texts that share one get more entries than they need, never fewer
    mentioned = d.where(F.col("text").rlike(_HINT)).select(text_key.alias("at"), F.explode(F.flatten(F.transform("found", lambda e: e["parts"]))).alias("e"))
    mentions = ws.write(mentioned.select("at", "e.kind", "e.canonical", "e.value"), "mentions")
    again = ws.write(attempts(ws, mentions.select("kind", "canonical", "value"), key, home), "again")
    number: Callable[[Column], Column] = lambda e: F.lit(0)
    if not again.isEmpty():
        # the texts that mention such an entity, each with its few entries
        pairs = mentions.join(again, ["kind", "canonical"]).select("at", F.struct(F.concat_ws("\x1f", "kind", "canonical").alias("k"), F.col("attempt").alias("v")).alias("x")).distinct()
        maps = ws.write(pairs.groupBy("at").agg(F.map_from_entries(F.collect_list("x")).alias("again")), "again_by_text")
        d = d.withColumn("at", text_key).join(maps, "at", "left")
        number = lambda e: F.coalesce(F.try_element_at(F.col("again"), F.concat_ws("\x1f", e["kind"], e["canonical"])), F.lit(0))
    pieces = F.split("text", _ALL, -1)

    def replaced(e: Column) -> Column:
        title = F.when(e["kind"] == "person", _title(e["value"])).otherwise(F.lit(""))
        return F.concat(title, F.array_join(F.transform(e["parts"], lambda p: _surrogate(key, p["kind"], p["value"], p["canonical"], number(p))), " "))

    made = F.transform("found", replaced)
    # pieces and surrogates alternate; there is one piece more than surrogates
    whole = F.array_join(F.transform(F.arrays_zip(pieces.alias("p"), made.alias("s")), lambda z: F.concat(z["p"], F.coalesce(z["s"], F.lit("")))), "")
    changed = F.when(F.size("found") > 0, whole).otherwise(F.col("text"))
    n, kinds = column_name(docs, "n_entities"), column_name(docs, "kinds")
    columns = [changed.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns]
    return d.select(*columns, F.size("found").cast("long").alias(n), F.array_sort(F.array_distinct(F.transform("found", lambda e: e["kind"]))).alias(kinds))
