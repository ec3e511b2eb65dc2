"""Personal data replaced by keyed surrogates of the same kind and format, in built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlog.llm.common import discard, salted_lookup, staged

_NAME = r"\p{Lu}(?:['’]\p{Lu})?\p{Ll}+(?:-\p{Lu}\p{Ll}+)?"
_MALE = r"Mr|Herrn?|Sr|Señor|Don|Monsieur|M|Господин|Κύριος"
_FEMALE = r"Mrs|Ms|Miss|Frau|Sra|Señora|Doña|Madame|Mme|Mlle|Госпожа|Κυρία"
_EITHER = r"Dr|Prof|Professor"

#: Kinds in the order in which they are tried, each with its pattern.
KINDS: dict[str, str] = {
    "secret": r"""\b(?i:password|passwd|pwd|secret|token|api_?key)\s{0,3}[:=]\s{0,3}["']?[^\s"',;]{6,}""",
    "email": r"(?<![\w.%+-])[\w.%+-]++@(?:[\p{L}\d-]+\.)+\p{L}{2,}",
    "key": r"\b(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,})\b",
    "iban": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b",
    "card": r"(?<![\d.+-])[3-6]\d{3}(?:[ -]?\d{4}){2}[ -]?\d{1,7}(?![\d])",
    "phone": r"(?<![\w+])(?:\+\d{1,3}[ .-]?\(?\d{1,4}\)?(?:[ .-]?\d{2,4}){2,4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?!\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\d)",
    "person": rf"\b(?:{_MALE}|{_FEMALE}|{_EITHER})\b\.?[ \xA0]{_NAME}(?:[ \xA0]{_NAME}){{0,2}}",
}
ANY = "|".join(f"(?:{pattern})" for pattern in KINDS.values())

_CONSONANTS, _VOWELS = "bcdfghjklmnpqrstvwxz", "aeiouy"
#: Alphabets a character is replaced within, by the class of the character.
ALPHABETS: list[tuple[str, str]] = [
    ("[0-9]", "0123456789"),
    (f"[{_VOWELS}]", _VOWELS),
    (f"[{_CONSONANTS}]", _CONSONANTS),
    (f"[{_VOWELS.upper()}]", _VOWELS.upper()),
    (f"[{_CONSONANTS.upper()}]", _CONSONANTS.upper()),
    ("[аеиоуыэюя]", "аеиоуыэюя"),
    (r"[\p{Ll}&&\p{IsCyrillic}]", "бвгджзклмнпрстфхцчш"),
    ("[АЕИОУЫЭЮЯ]", "АЕИОУЫЭЮЯ"),
    (r"[\p{Lu}&&\p{IsCyrillic}]", "БВГДЖЗКЛМНПРСТФХЦЧШ"),
    (r"[\p{Ll}&&\p{IsGreek}]", "αβγδεζηθικλμνξοπρστυφχψω"),
    (r"[\p{Lu}&&\p{IsGreek}]", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ"),
    (r"\p{IsHan}", "王李张刘陈杨赵黄周吴徐孙胡朱高林何郭马罗"),
    (r"\p{Ll}", _VOWELS),
    (r"\p{Lu}", _VOWELS.upper()),
]


#: Every entity has one of these characters or words in it; texts without any are not searched.
MARKS = "[0-9@=:]"
_TITLES = [title for title in f"{_MALE}|{_FEMALE}|{_EITHER}".replace("Herrn?", "Herr").split("|") if title != "M"]
WORDS = [*_TITLES, "M.", "M ", "M\xa0", "AKIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "sk-"]


def _quoted(text: str) -> str:
    return "r'" + text + "'" if "'" not in text else "r\"" + text.replace('"', r"\x22") + '"'


def find_entities(text: str = "text") -> Column:
    """array<struct(kind, raw)> of the entities in a text, in order."""
    kinds = " ".join(f"WHEN e RLIKE {_quoted(f'^(?:{p})$')} THEN '{kind}'" for kind, p in KINDS.items())
    words = " OR ".join(f"contains({text}, '{word}')" for word in WORDS)
    found = f"regexp_extract_all({text}, {_quoted(ANY)}, 0)"
    entities = f"transform({found}, e -> named_struct('kind', CASE {kinds} ELSE 'person' END, 'raw', e))"
    none = "cast(array() AS array<struct<kind:string,raw:string>>)"
    return F.expr(f"CASE WHEN {text} RLIKE '{MARKS}' OR {words} THEN {entities} ELSE {none} END")


def _value() -> Column:
    """The part of the entity that is replaced: without the name of a secret or a title."""
    secret = F.regexp_extract("raw", r"""[:=]\s{0,3}["']?(.+)$""", 1)
    person = F.regexp_extract("raw", rf"^(?:{_MALE}|{_FEMALE}|{_EITHER})\.?[ \xA0](.+)$", 1)
    return F.when(F.col("kind") == "secret", secret).when(F.col("kind") == "person", person).otherwise(F.col("raw"))


def _canonical() -> Column:
    """What two mentions of one entity share: characters without layout, mail in lower case."""
    plain = F.regexp_replace("value", r"[^0-9\p{L}]", "")
    return (
        F.when(F.col("kind").isin("card", "phone", "ssn", "iban"), plain)
        .when(F.col("kind") == "email", F.lower("value"))
        .when(F.col("kind") == "person", F.regexp_replace(F.initcap("value"), " ", " "))
        .otherwise(F.col("value"))
    )


def _gender() -> Column:
    title = F.regexp_extract("raw", r"^[\p{L}]+", 0)
    return (
        F.when(F.col("kind") != "person", "")
        .when(title.rlike(f"^(?:{_MALE})$"), "m")
        .when(title.rlike(f"^(?:{_FEMALE})$"), "f")
        .otherwise("")
    )


def _stream(length: str, seed: str) -> str:
    return f"array_join(transform(sequence(0, (3 * {length}) div 64), b -> sha2(concat({seed}, '#', b), 256)), '')"


def _spelled(value: str, stream: str) -> str:
    """SQL: every character of ``value`` replaced within its alphabet by the key stream."""
    at = f"cast(conv(substring({stream}, 3 * i + 1, 3), 16, 10) AS INT)"
    cases = " ".join(f"WHEN c RLIKE {_quoted(p)} THEN substring('{a}', 1 + {at} % {len(a)}, 1)" for p, a in ALPHABETS)
    hexes = f"IF(kind = 'secret' AND {value} RLIKE '^[0-9a-f]*$', substring('0123456789abcdef', 1 + {at} % 16, 1), CASE {cases} ELSE c END)"
    return f"array_join(transform(filter(split({value}, ''), x -> x <> ''), (c, i) -> {hexes}), '')"


def _luhn(value: str) -> str:
    """SQL: the Luhn sum of a string of digits, modulo 10."""
    doubled = "IF((n - i) % 2 = 0, IF(2 * d > 9, 2 * d - 9, 2 * d), d)"
    digits = f"transform(filter(split({value}, ''), x -> x <> ''), (x, i) -> named_struct('d', coalesce(try_cast(x AS INT), 0), 'i', i))"
    body = doubled.replace("(n - i)", f"(length({value}) - x.i)").replace("2 * d", "2 * x.d").replace(", d)", ", x.d)")
    return f"aggregate({digits}, 0, (t, x) -> t + {body}, t -> t % 10)"


def surrogates(entities: DataFrame, key: str) -> DataFrame:
    """``entities`` (kind, gender, canonical, attempt) with ``surrogate``.

    Characters stay in their class and script.  A mail address keeps its last domain part, a phone
    number what precedes its last ten digits, a card its first digit and its Luhn sum, an IBAN its
    country (with new check digits), a key its prefix, an address four parts from 1 to 254.  The
    parts of a person's name are replaced one by one, so that a shared surname stays shared; the
    first ends in a for women and in o for men where it is Latin and there are two parts.
    """
    seeded = entities.withColumn(
        "seed", F.sha2(F.concat_ws("|", F.lit(key), "kind", "canonical", F.col("attempt").cast("string")), 256)
    ).withColumn("stream", F.expr(_stream("length(canonical)", "seed")))
    spelled = seeded.withColumn("spelled", F.expr(_spelled("canonical", "stream")))

    def kept(n: str) -> Column:
        return F.expr(f"concat(left(canonical, {n}), substring(spelled, 1 + {n}))")

    card = "concat(left(canonical, 1), substring(spelled, 2, length(canonical) - 2))"
    fixed = F.expr(
        f"concat({card}, (cast({_luhn('canonical')} AS INT) - {_luhn(f'concat({card}, 0)')} + 10) % 10)"
    )
    ip = F.expr(
        "array_join(transform(sequence(0, 3), i -> cast(1 + cast(conv(substring(seed, 1 + 4 * i, 4), 16, 10) AS INT) % 254 AS STRING)), '.')"
    )
    account = "concat(substring(spelled, 5), left(canonical, 2), '00')"
    rest = f"aggregate(split({account}, ''), 0L, (t, c) -> CASE WHEN c RLIKE '[0-9]' THEN (t * 10 + coalesce(try_cast(c AS INT), 0)) % 97 WHEN c RLIKE '[A-Z]' THEN (t * 100 + ascii(c) - 55) % 97 ELSE t END)"
    iban = F.expr(f"concat(left(canonical, 2), lpad(98 - {rest}, 2, '0'), substring(spelled, 5))")
    part_stream = _stream("length(p)", "sha2(concat_ws('|', {key}, 'part', p, cast(attempt AS STRING)), 256)").replace("{key}", _quoted(key))
    parts = F.expr(f"transform(split(canonical, ' '), p -> {_spelled('p', part_stream)})")
    ending = F.when(F.col("gender") == "f", "a").when(F.col("gender") == "m", "o")
    latin = F.col("parts")[0].rlike(r"^[A-Za-z'\-]+$") & (F.size("parts") > 1) & ending.isNotNull()
    first = F.when(latin, F.concat(F.expr("left(parts[0], length(parts[0]) - 1)"), ending)).otherwise(F.col("parts")[0])
    person = F.concat_ws(" ", first, F.array_join(F.expr("slice(parts, 2, 9)"), " "))
    return (
        spelled.withColumn("parts", F.when(F.col("kind") == "person", parts))
        .withColumn(
            "surrogate",
            F.when(F.col("kind") == "email", F.expr("concat(left(spelled, length(canonical) - instr(reverse(canonical), '.')), substring(canonical, 1 + length(canonical) - instr(reverse(canonical), '.')))"))
            .when(F.col("kind") == "phone", kept("greatest(length(canonical) - 10, 0)"))
            .when(F.col("kind") == "card", fixed)
            .when(F.col("kind") == "iban", iban)
            .when(F.col("kind") == "key", kept("IF(canonical LIKE 'sk-%', 3, 4)"))
            .when(F.col("kind") == "ip", ip)
            .when(F.col("kind") == "person", F.trim(person))
            .otherwise(F.col("spelled")),
        )
        .drop("seed", "stream", "spelled", "parts")
    )


def assign(entities: DataFrame, key: str) -> DataFrame:
    """(kind, canonical, surrogate) for distinct ``entities`` (kind, gender, canonical), all distinct.

    A surrogate that another entity of its kind has too, or that is itself an entity of the text,
    is drawn again with the next attempt; of equal ones the smallest entity keeps its draw.  An
    entity that cannot be told apart after ``ATTEMPTS`` draws, as in a format with fewer strings
    than entities, is an error, never a silent merge.
    """
    drawn = staged(surrogates(entities.withColumn("attempt", F.lit(0)), key), "surrogates")
    for _ in range(ATTEMPTS):
        owners = drawn.groupBy("kind", "surrogate").agg(F.min("canonical").alias("owner"))
        real = drawn.select("kind", F.col("canonical").alias("surrogate"), F.lit(True).alias("real"))
        checked = drawn.join(owners, ["kind", "surrogate"]).join(real, ["kind", "surrogate"], "left")
        clash = F.coalesce("real", F.lit(False)) | (F.col("owner") != F.col("canonical"))
        marked = staged(checked.withColumn("clash", clash).drop("owner", "real"), "checked")
        if marked.filter("clash").isEmpty():
            discard(marked)
            return drawn.select("kind", "canonical", "surrogate")
        again = surrogates(
            marked.filter("clash").select("kind", "gender", "canonical", (F.col("attempt") + 1).alias("attempt")), key
        )
        following = staged(marked.filter("NOT clash").drop("clash").unionByName(again), "surrogates")
        discard(marked)
        discard(drawn)
        drawn = following
    raise ValueError("a kind of entity has too few surrogates to stay distinct")


ATTEMPTS = 20


def _rendered() -> Column:
    """The surrogate in the layout of the mention."""
    laid = F.expr(
        "aggregate(split(value, ''), named_struct('out', '', 'at', 1), (s, c) -> IF(c RLIKE '[0-9\\\\p{L}]',"
        " named_struct('out', concat(s.out, substring(surrogate, s.at, 1)), 'at', s.at + 1),"
        " named_struct('out', concat(s.out, c), 'at', s.at)), s -> s.out)"
    )
    shout = (F.upper("value") == F.col("value")) & (F.lower("value") != F.col("value"))
    body = (
        F.when(F.col("kind").isin("card", "phone", "ssn", "iban"), laid)
        .when(F.col("kind").isin("email", "person") & shout, F.upper("surrogate"))
        .otherwise(F.col("surrogate"))
    )
    return F.concat(F.expr("left(raw, length(raw) - length(value))"), body)


def replace_entities(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` (all columns) with surrogates in ``text`` and ``entities``: array of (kind, raw, surrogate).

    Kinds: mail, phone, IPv4, card, IBAN, social security number, access key, assigned secret, and
    names after a title.  The same entity gets the same surrogate in every row, different ones of
    a kind get different ones, and none is itself an entity of the corpus.  Rows without entities
    pass through unshuffled, null texts as null with no entities.  A column named ``entities`` is
    replaced.
    """
    marked = docs.select(F.struct("*").alias("_row"), F.col("text").alias("_text")).withColumn("_found", find_entities("_text"))
    plain = marked.filter("size(_found) = 0 OR _text IS NULL")
    numbered = marked.filter("size(_found) > 0").withColumn("_rid", F.monotonically_increasing_id())
    held = staged(numbered, "private-rows")
    mentions = (
        held.select("_rid", F.posexplode("_found").alias("at", "e"))
        .select("_rid", "at", "e.kind", "e.raw")
        .withColumn("value", _value())
        .withColumn("canonical", _canonical())
        .withColumn("gender", _gender())
    )
    entities = mentions.groupBy("kind", "canonical").agg(F.max("gender").alias("gender"))
    chosen = assign(entities, key)
    told = salted_lookup(mentions, chosen, ["kind", "canonical"], ["_rid", "at"]).withColumn("surrogate", _rendered())
    by_row = told.groupBy("_rid").agg(
        F.array_sort(F.collect_list(F.struct("at", "kind", "raw", "surrogate"))).alias("_told")
    )
    gaps = f"split(_text, {_quoted(ANY)}, -1)"
    woven = F.expr(f"array_join(zip_with({gaps}, _told, (g, t) -> concat(g, coalesce(t.surrogate, ''))), '')")
    done = held.join(by_row, "_rid").select(
        "_row", woven.alias("_new"), F.expr("transform(_told, t -> named_struct('kind', t.kind, 'raw', t.raw, 'surrogate', t.surrogate))").alias("_entities")
    )
    empty = "cast(array() AS array<struct<kind:string,raw:string,surrogate:string>>)"
    left = plain.select("_row", F.col("_text").alias("_new"), F.expr(empty).alias("_entities"))
    others = [F.col("_row")[name].alias(name) for name in docs.columns if name not in ("text", "entities")]
    return done.unionByName(left).select(*others, F.col("_new").alias("text"), F.col("_entities").alias("entities"))
