"""Personal data replaced by keyed surrogates of the same kind, in built-in functions only."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace

#: Titles by gender; "" is for titles that say none. Fixed values.
TITLES = {
    "m": ("Mr", "Mister", "Herr", "Herrn", "Monsieur", "Señor", "Sr", "Signor", "г-н", "господин", "κύριος", "κ"),
    "f": ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mlle", "Señora", "Sra", "Srta", "Signora", "г-жа", "госпожа", "κυρία", "κα"),
    "": ("Dr", "Prof", "Professor", "Doctor", "Pr", "др", "проф"),
}
_NAME = r"\p{Lu}[\p{L}\p{M}'’-]++"
_TITLE = "|".join(sorted((t for ts in TITLES.values() for t in ts), key=len, reverse=True))
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
_SECRET_KEY = r"(?:token|password|passwd|pwd|secret|api[_-]?key|access[_-]?key)"
_SECRET_HEAD = rf"(?i:{_SECRET_KEY})[\"']?\s{{0,2}}[=:]\s{{0,2}}[\"']?"
_BIRTH_HEAD = r"\b(?i:born(?: on)?|d\.?o\.?b|date of birth|birth ?date|geboren(?: am)?|née? le|nacid[oa] el)[:.]?\s{1,3}"
_DATE = r"(?:[0-9]{1,2}[./-][0-9]{1,2}[./-][0-9]{4}|[0-9]{4}-[0-9]{2}-[0-9]{2})"
#: Kinds with their patterns (Java), in order of precedence. Repeated groups are bounded, since Java's matcher recurses in them, and what may start at every
#: letter of a long word is guarded on its left or bounded, so that a text takes time in proportion to its length.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}+@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z])",
    "secret": rf"{_SECRET_HEAD}[A-Za-z0-9+/_=-]{{6,}}+|\b(?:AKIA[0-9A-Z]{{16}}|gh[pousr]_[A-Za-z0-9]{{20,}}+|sk-[A-Za-z0-9]{{20,}}+)\b|(?<![0-9A-Za-z])(?=[a-fA-F]{{0,127}}[0-9])(?:[0-9a-f]{{32,128}}+|[0-9A-F]{{32,128}}+)(?![0-9A-Za-z])",
    "birth": rf"{_BIRTH_HEAD}{_DATE}(?![0-9])",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,3})?(?![0-9A-Za-z])",
    "ipv6": r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])",
    "ipv4": rf"(?<![0-9.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\.?[0-9])",
    "phone": r"(?<![0-9A-Za-z])\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ .-]?[0-9]{2,4}){2,4}(?![0-9])|(?<![0-9A-Za-z])(?:\([0-9]{3}\) ?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "card": r"(?<![0-9A-Za-z])[0-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z])",
    "person": rf"(?<![\p{{L}}\p{{N}}])(?:{_TITLE})\.? {_NAME}(?: {_NAME}){{0,2}}",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: A cheap test that every match passes.
MAYBE = rf"[0-9@]|(?i:{_SECRET_KEY})|(?:{_TITLE})\.? \p{{Lu}}|AKIA|gh[pousr]_|sk-|(?:[A-Fa-f]{{1,4}}:){{3}}"
#: Syllables of surrogate names by script, and their endings by gender; "" is a family name. Fixed values.
SYLLABLES = {
    "latin": (("ba", "ber", "co", "da", "del", "fa", "gar", "ha", "jo", "ka", "len", "ma", "mir", "no", "pe", "ral", "sa", "tor", "ve", "win"), {"m": ("ton", "ric", "vin", "nard"), "f": ("lia", "nia", "rina", "sella"), "": ("man", "well", "ford", "sen")}),
    "cyrillic": (("ба", "бер", "ко", "да", "дел", "фа", "гар", "ха", "ло", "ка", "лен", "ма", "мир", "но", "пе", "рал", "са", "тор", "ве", "вин"), {"m": ("тон", "рик", "вин", "мир"), "f": ("лия", "ния", "рина", "села"), "": ("ко", "ман", "юк", "ич")}),
    "greek": (("βα", "βερ", "κο", "δα", "δελ", "φα", "γαρ", "χα", "λο", "κα", "λεν", "μα", "μιρ", "νο", "πε", "ραλ", "σα", "τορ", "βε", "βιν"), {"m": ("τος", "ρης", "νος", "δης"), "f": ("λία", "νία", "ρίνα", "σέλα"), "": ("ίδης", "άκης", "όπουλος", "άτος")}),
}


def kind_of(match: Column) -> Column:
    """The kind of a match; "name" is a name without its title."""
    out = None
    for kind, pattern in PATTERNS.items():
        test = match.rlike(f"^(?:{pattern})$")
        out = F.when(test, kind) if out is None else out.when(test, kind)
    return out.otherwise("name")


def script_of(word: Column) -> Column:
    return F.when(word.rlike(r"\p{IsCyrillic}"), "cyrillic").when(word.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")


def gender_of(title: Column) -> Column:
    return F.when(title.isin(*TITLES["m"]), "m").when(title.isin(*TITLES["f"]), "f").otherwise("")


def piece(kind: Column, value: Column) -> Column:
    return F.struct(kind.cast("string").alias("kind"), value.alias("value"))


def person_names(match: Column) -> Column:
    """The names of a titled person as pieces; the gender of the title goes to all but the last."""
    words = F.split(match, " ")
    title, names = F.regexp_replace(words[0], r"\.$", ""), F.slice(words, 2, 9)
    return F.transform(names, lambda w, i: piece(F.concat(F.lit("name:"), F.when(i == F.size(names) - 1, "").otherwise(gender_of(title)), F.lit(":"), script_of(w)), w))


def parts_of(kind: Column, match: Column, known: Column) -> Column:
    """A match as (kind, value) pieces in order; kind "" stays as it is. A person's names are pieces of their own, so that each keeps its surrogate
    with other titles and in other combinations; so are the sides of an address at @. known: the names of the text's titled persons."""
    apart = lambda names: F.flatten(F.transform(names, lambda p, i: F.when(i == 0, F.array(p)).otherwise(F.array(piece(F.lit(""), F.lit(" ")), p))))
    person = F.concat(F.array(piece(F.lit(""), F.concat(F.substring_index(match, " ", 1), F.lit(" ")))), apart(person_names(match)))
    name = apart(F.transform(F.split(match, " "), lambda w: F.coalesce(F.try_element_at(F.filter(known, lambda k: k["value"] == w), F.lit(1)), piece(F.lit(""), w))))
    at = F.array(piece(F.lit("mailbox"), F.substring_index(match, "@", 1)), piece(F.lit(""), F.lit("@")), piece(F.lit("domain"), F.substring_index(match, "@", -1)))
    after = lambda head, of: F.array(piece(F.lit(""), F.regexp_extract(match, f"^(?:{head})", 0)), piece(of, F.regexp_replace(match, f"^(?:{head})", "")))
    out = F.when(kind == "person", person).when(kind == "name", name).when(kind == "email", at)
    return out.when(kind == "secret", after(_SECRET_HEAD, kind)).when(kind == "birth", after(_BIRTH_HEAD, kind)).otherwise(F.array(piece(kind, match)))


LETTERS = "abcdefghijklmnopqrstuvwxyz"


def keyed_digest(key: str, *parts: Column) -> Column:
    """HMAC with SHA-512, in hex."""
    raw = key.encode()
    raw = (hashlib.sha512(raw).digest() if len(raw) > 128 else raw).ljust(128, b"\0")
    inner, outer = (F.lit(bytearray(x ^ pad for x in raw)) for pad in (0x36, 0x5C))
    message = F.encode(F.concat_ws("\0", *parts), "UTF-8")
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message), 512))), 512)


def once(value: Column, body) -> Column:
    """body(value), with the value computed once, also where body uses it for every letter of a text."""
    return F.transform(F.array(value), body)[0]


def nibbles(digest: Column, i: Column, n: int) -> Column:
    """A number from 0 to n - 1 from place i of a hex digest of 128 digits."""
    at = (F.pmod(i * 2, F.lit(124)) + 1).cast("int")
    return F.pmod(F.conv(digest.substr(at, F.lit(4)), 16, 10).cast("int") + i.cast("int"), F.lit(n))


def redrawn(value: Column, digest: Column, keep: int = 0) -> Column:
    """Each letter and digit by another of its class, hex by hex where the whole is hex; the first ``keep`` characters and all others stay."""
    letter = lambda letters, i: F.element_at(F.array(*map(F.lit, letters)), nibbles(digest, i, len(letters)) + 1)

    def plain(c: Column, i: Column) -> Column:
        drawn = F.when(c.rlike("^[0-9]$"), nibbles(digest, i, 10).cast("string")).when(c.rlike("^[a-z]$"), letter(LETTERS, i)).when(c.rlike("^[A-Z]$"), F.upper(letter(LETTERS, i)))
        return F.when(i < keep, c).otherwise(F.coalesce(drawn, c))

    chars = F.filter(F.split(value, ""), lambda c: c != "")
    hexed = F.transform(chars, lambda c, i: F.when(i < keep, c).otherwise(letter("0123456789abcdef", i)))
    hexed = F.array_join(hexed, "")
    return F.when(value.rlike("^(?=[a-f]*[0-9])[0-9a-f]{12,}+$"), hexed).when(value.rlike("^(?=[A-F]*[0-9])[0-9A-F]{12,}+$"), F.upper(hexed)).otherwise(F.array_join(F.transform(chars, plain), ""))


def surrogate(kind: Column, value: Column, digest: Column, draw: Column) -> Column:
    given = F.struct(longer(kind, value, F.greatest(draw - 11, F.lit(0))).alias("value"), digest.alias("digest"))
    return once(given, lambda x: drawn_from(kind, x["value"], x["digest"], draw))


def drawn_from(kind: Column, value: Column, digest: Column, draw: Column) -> Column:
    """A stand-in of the same kind and form for a value, drawn from a keyed digest. Names get a syllable more every third draw, so that any number of them
    finds enough; other forms have as many strings as they have, and get a character more from the twelfth draw on."""
    octet = lambda i: (nibbles(digest, F.lit(i), 254) + 1).cast("string")
    ipv4 = F.concat_ws(".", octet(0), octet(1), octet(2), octet(3))
    domain = F.concat(redrawn(F.regexp_replace(value, r"\.[^.]*$", ""), digest), F.regexp_extract(value, r"\.[^.]*$", 0))
    drawn = redrawn(value, digest)
    digits = F.regexp_replace(value, "[^0-9]", "")
    head = drawn.substr(F.lit(1), F.length(value) - 1)  # a card number ends with a digit
    last = F.filter(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda d: F.pmod(d + nibbles(digest, F.lit(50), 10), F.lit(10)).cast("string")), lambda d: F.call_function("luhn_check", F.concat(F.regexp_replace(head, "[^0-9]", ""), d)) == F.call_function("luhn_check", digits))
    country = r"^\+[0-9]{1,3}(?=[ .(-])|^\+"
    phone = F.when(value.startswith("+"), F.concat(F.regexp_extract(value, country, 0), redrawn(F.regexp_replace(value, country, ""), digest))).otherwise(drawn)
    name = None
    for script, (syllables, endings) in SYLLABLES.items():
        for gender, ends in endings.items():
            pick = lambda words, i: F.element_at(F.array(*map(F.lit, words)), nibbles(digest, i, len(words)) + 1)
            middle = F.array_join(F.transform(F.sequence(F.lit(1), (F.lit(3) + F.floor(draw / 3)).cast("int")), lambda j: pick(syllables, 4 * j)), "")  # noqa: B023
            made = F.initcap(F.concat(middle, pick(ends, F.lit(2))))
            made = F.when((F.length(value) > 2) & (F.upper(value) == value), F.upper(made)).otherwise(made)
            name = F.when(kind == f"name:{gender}:{script}", made) if name is None else name.when(kind == f"name:{gender}:{script}", made)
    return name.when(kind == "ipv4", ipv4).when(kind == "birth", some_date(value, digest, draw)).when(kind == "domain", domain).when(kind == "card", F.concat(head, last[0])).when(kind == "phone", phone).when(kind == "iban", redrawn(value, digest, 2)).otherwise(drawn)


def longer(kind: Column, value: Column, n: Column) -> Column:
    """A value with n more characters: digits, before the top-level domain of a domain and else at the end. Names, IPv4 addresses and dates stay."""
    n = F.when(kind.startswith("name:") | kind.isin("ipv4", "birth"), 0).otherwise(n)
    more = F.repeat(F.lit("0"), n.cast("int"))
    return F.when(n == 0, value).when(kind == "domain", F.concat(F.regexp_replace(value, r"\.[^.]*$", ""), more, F.regexp_extract(value, r"\.[^.]*$", 0))).otherwise(F.concat(value, more))


def some_date(value: Column, digest: Column, draw: Column) -> Column:
    """A date of the same form: days and months from 1 to 12 or, of one digit, from 1 to 9, years of 4 digits from 1930 to 1999. Each draw has twice as many years as the
    one before, at most 9,000, the earliest 1000; from the twelfth draw on, which only more than a million dates of one form reach, years have a digit more a draw."""
    fields, marks = F.regexp_extract_all(value, F.lit("[0-9]+"), F.lit(0)), F.regexp_extract_all(value, F.lit("[^0-9]"), F.lit(0))
    years = F.least(F.lit(9000), F.lit(70) * F.pow(F.lit(2), F.least(draw, F.lit(8)))).cast("int")
    first = F.greatest(F.lit(1000), F.lit(2000) - years)
    more = F.array_join(F.transform(F.filter(F.sequence(F.lit(0), F.greatest(draw - 11, F.lit(0)).cast("int")), lambda j: j > 0), lambda j: nibbles(digest, j * 5 + 1, 10).cast("string")), "")

    def field(c: Column, i: Column) -> Column:
        year, two, one = first + nibbles(digest, i * 7, years), nibbles(digest, i * 7, 12) + 1, nibbles(digest, i * 7, 9) + 1
        return F.when(F.length(c) == 4, F.concat(year.cast("string"), more)).when(F.length(c) == 2, F.lpad(two.cast("string"), 2, "0")).otherwise(one.cast("string"))

    return F.array_join(F.zip_with(F.transform(fields, field), marks, lambda f, m: F.concat(f, F.coalesce(m, F.lit("")))), "")


def surrogates(work: Workspace, entities: DataFrame, key: str) -> DataFrame:
    """From distinct (kind, value) rows (kind, value, stand_in). No two values of a kind share a stand-in, and none is a value of that kind that occurs.

    Every round draws for those left from the key, the kind, the value without case and the round; a stand-in that is taken, or that
    a smaller value draws too, is drawn again. Later draws have more strings to choose from (see drawn_from and some_date), so that the rounds end.
    """
    norm = F.lower("value")
    left = work.save(entities.select("kind", norm.alias("norm")).distinct(), "left0")
    originals, taken, n = left, None, 0
    while not left.isEmpty():
        digest = keyed_digest(key, F.col("kind"), F.col("norm"), F.lit(str(n)))
        drawn = left.withColumn("stand_in", F.lower(surrogate(F.col("kind"), F.col("norm"), digest, F.lit(n))))
        first = drawn.groupBy("kind", "stand_in").agg(F.min("norm").alias("norm"))
        used = originals.select("kind", F.col("norm").alias("stand_in"))
        used = used if taken is None else used.unionByName(taken.select("kind", "stand_in"))
        good = first.join(used, ["kind", "stand_in"], "left_anti")
        good = work.save(good.withColumn("draw", F.lit(n)), f"good{n}")
        taken = good if taken is None else taken.unionByName(good)
        n += 1
        left = work.save(left.join(good, ["kind", "norm"], "left_anti"), f"left{n}")
    if taken is None:
        return entities.select("kind", "value", F.col("value").alias("stand_in"))
    every = entities.withColumn("norm", norm).join(taken.select("kind", "norm", "draw"), ["kind", "norm"])
    digest = keyed_digest(key, F.col("kind"), F.col("norm"), F.col("draw").cast("string"))
    return every.select("kind", "value", surrogate(F.col("kind"), F.col("value"), digest, F.col("draw")).alias("stand_in"))


def replace_personal_data(spark: SparkSession, docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, text with every detected entity replaced, n_entities, and kinds (how many of each kind, as a map).

    Detected: email and IP addresses, phone, card, social security and bank account numbers, birth dates, keys and passwords, persons with a title, and in the
    same text their names without it ("name"). A value gets the same stand-in everywhere under one ``key``, whatever its case; see surrogates for
    distinctness and surrogate for the form: separators, letter case, alphabet, country code, top-level domain and Luhn validity stay, names keep
    gender and script. ``key`` must be secret: without it a stand-in does not tell the value (HMAC).

    Two passes over the texts find the entities: one over all, whose result is written, and one over those with persons. Only texts with a match pass the
    shuffles. A null text stays null and has no entities; an empty one stays empty. Very long texts and words are searched whole, in time in
    proportion to their length. Repeated rows return each. An empty table gives an empty result. Other columns are ignored.
    """
    if not key:
        raise ValueError("a key is needed")
    work = Workspace(spark, "pii")
    kind = docs.schema[id_col].dataType
    none = F.array().cast("array<string>")
    rows = docs.select(docs[id_col].alias("_id"), docs[text_col].alias("_text"))
    found = F.when(F.col("_text").rlike(MAYBE), F.regexp_extract_all("_text", F.lit(ANY), F.lit(0))).otherwise(none)
    rows = work.save(rows.withColumn("_found", F.coalesce(found, none)).withColumn("_row", F.monotonically_increasing_id()), "rows")

    titled = F.filter("_found", lambda m: m.rlike(f"^(?:{PATTERNS['person']})$"))
    hits = rows.where(F.size("_found") > 0).withColumn("_titled", titled)
    known = F.array_sort(F.array_distinct(F.flatten(F.transform("_titled", person_names))))
    full = F.transform("_titled", lambda m: F.array_join(F.slice(F.split(m, " "), 2, 9), " "))
    mentions = F.array_sort(F.array_distinct(F.concat(full, F.filter(F.transform(known, lambda k: k["value"]), lambda w: F.length(w) > 2))), lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0))
    pattern = F.concat(F.lit(ANY + r"|(?<![\p{L}\p{N}])(?:"), F.array_join(mentions, "|"), F.lit(r")(?![\p{L}\p{N}])"))
    hits = hits.withColumn("_known", known).withColumn("_pattern", F.when(F.size("_titled") > 0, pattern).otherwise(ANY)).drop("_titled")
    hits = hits.withColumn("_found", F.when(F.size("_known") > 0, F.regexp_extract_all("_text", F.col("_pattern"), F.lit(0))).otherwise(F.col("_found")))
    hits = work.save(hits, "hits")

    matches = hits.select("_row", "_known", F.posexplode("_found").alias("_at", "_match")).withColumn("_kind", kind_of(F.col("_match")))
    pieces = matches.select("_row", "_at", "_kind", F.posexplode(parts_of(F.col("_kind"), F.col("_match"), F.col("_known"))).alias("_part", "_piece"))
    pieces = work.save(pieces.select("_row", "_at", "_part", "_kind", F.col("_piece.kind").alias("kind"), F.col("_piece.value").alias("value")), "pieces")
    made = work.save(surrogates(work, pieces.where("kind <> ''").select("kind", "value").distinct(), key), "made")
    put = pieces.join(made, ["kind", "value"], "left").select("_row", "_kind", "_at", F.struct("_part", F.coalesce("stand_in", "value").alias("s")).alias("_p"))
    entity = put.groupBy("_row", "_at").agg(F.any_value("_kind").alias("_kind"), F.array_join(F.transform(F.array_sort(F.collect_list("_p")), lambda p: p["s"]), "").alias("_s"))
    per_row = entity.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("_at", "_s"))).alias("_parts"), F.collect_list("_kind").alias("_kinds"))
    joined = F.transform("_parts", lambda p: p["_s"])
    between = F.split("_text", F.col("_pattern"), -1)
    text = F.concat(F.array_join(F.zip_with(F.slice(between, 1, F.size("_found")), joined, lambda a, b: F.concat(a, b)), ""), F.element_at(between, -1))
    kinds = F.map_from_entries(F.transform(F.array_sort(F.array_distinct("_kinds")), lambda k: F.struct(k, F.size(F.filter("_kinds", lambda x: x == k)).cast("bigint"))))
    changed = hits.join(per_row, "_row").select(F.col("_id").cast(kind).alias(id_col), text.alias("text"), F.size("_found").cast("bigint").alias("n_entities"), kinds.alias("kinds"))
    plain = rows.where(F.size("_found") == 0)
    same = plain.select(F.col("_id").alias(id_col), F.col("_text").alias("text"), F.lit(0).cast("bigint").alias("n_entities"), F.map_from_arrays(none, F.array().cast("array<bigint>")).alias("kinds"))
    return same.unionByName(changed)
