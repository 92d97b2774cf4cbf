"""Surrogates for personal data and secrets, by built-in functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wicketworks.llm.common import cut

#: Titles that name a person, by gender.
FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Doña", "г-жа", "госпожа", "Κυρία")
MALE = ("Mr", "Herr", "Monsieur", "Señor", "Sr", "г-н", "господин", "Κύριος")
#: Invented persons by gender and script; given names, then family names.
NAMES = {
    "female Latin": ("Anna", "Clara", "Elena", "Emma", "Julia", "Laura", "Maria", "Nora", "Sara", "Vera"),
    "male Latin": ("Adam", "Bruno", "David", "Erik", "Felix", "Jonas", "Lukas", "Martin", "Oscar", "Paul"),
    "female Cyrillic": ("Анна", "Вера", "Елена", "Ирина", "Мария", "Нина", "Ольга", "Софья"),
    "male Cyrillic": ("Антон", "Борис", "Виктор", "Иван", "Михаил", "Павел", "Пётр", "Юрий"),
    "female Greek": ("Άννα", "Ελένη", "Μαρία", "Σοφία", "Ζωή", "Ειρήνη"),
    "male Greek": ("Αλέξης", "Γιώργος", "Κώστας", "Νίκος", "Πέτρος", "Σταύρος"),
    "family Latin": ("Albers", "Brandt", "Cortes", "Duval", "Engel", "Fabre", "Garner", "Holm", "Ivers", "Jansen"),
    "family Cyrillic": ("Волков", "Зайцев", "Лебедев", "Морозов", "Орлов", "Соколов"),
    "family Greek": ("Βλάχος", "Δήμου", "Καρράς", "Μάρκου", "Παππάς", "Ρήγας"),
}
_initials = "".join(sorted({title[0] for title in FEMALE + MALE}))
#: What an entity of each type looks like. The first that matches at a place counts. Each starts with
#: a test of one character, as most places of a text are inside words; \G is where the last mention ended.
#: Groups repeat a bounded number of times (a domain has 126 labels at most), since Java's stack grows with each.
TYPES = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9-]{1,63}+\.){1,126}[A-Za-z]{2,63}",
    "secret": r"(?<=[=:\s\"'])(?<=\b(?:token|password|passwd|secret|api_key|apikey)\s{0,3}[=:]\s{0,3}[\"']?)[^\s\"'=:,;]{8,}",
    "key": r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b",
    "card": r"(?=[0-9])(?<![0-9.-])(?:[0-9]{4}[ -]?){3}[0-9]{4}(?![0-9-])",
    "ip": r"(?=[0-9])(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![0-9]|\.[0-9])",
    "ssn": r"(?=[0-9])(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": r"(?=[0-9+(])(?:\+[0-9]{1,3}[ .-]?)?(?<![0-9])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])",
    "name": rf"(?=[{_initials}])\b(?:{'|'.join(FEMALE + MALE)})\.?\s\p{{Lu}}\p{{Ll}}+(?:\s\p{{Lu}}\p{{Ll}}+)?",
}
#: After a letter only what starts with a digit, + or ( can start, or what follows the last mention.
PATTERN = r"(?:(?<![A-Za-z])|(?=[0-9+(])|\G)(?:" + "|".join(f"(?:{p})" for p in TYPES.values()) + ")"
HEX = "0123456789abcdef"
#: Attempts after which addresses are drawn from all there are, and after which a type has no surrogates left.
WIDER, MOST = 4, 200


def entity_type(mention: Column) -> Column:
    """Type of a matched string. A secret is known by what precedes it, so it is what no other pattern fits."""
    kind = F.lit("secret")
    for name, pattern in reversed([x for x in TYPES.items() if x[0] != "secret"]):
        kind = F.when(F.regexp_extract(mention, f"^(?:{pattern})$", 0) != "", F.lit(name)).otherwise(kind)
    return kind


def entity(kind: Column, mention: Column) -> Column:
    """What mentions of one entity have in common: marks and case that only format it are left out."""
    name = F.lower(F.regexp_replace(mention, r"^(\S+?)\.?\s+", "$1 "))
    digits = F.regexp_replace(mention, r"[ ().-]", "")
    return (
        F.when(kind == "email", F.lower(mention))
        .when(kind.isin("card", "phone", "ssn", "iban"), digits)
        .when(kind == "name", name)
        .otherwise(mention)
    )


def surrogate(kind: Column, mention: Column, who: Column, attempt: Column, key: str) -> Column:
    """A replacement of the same type and format, chosen by a keyed hash of the entity."""
    digest = F.sha2(F.concat_ws("\x1f", F.lit(key), kind, who, attempt.cast("string"), F.lit(key)), 256)
    digits = F.translate(digest, HEX, "0123456789" + "246813")
    letters = F.translate(digest, HEX, "bcdfghjklmnpqrst")

    def stream(source: Column, i: Column) -> Column:
        return F.substring(source, i % 64 + 1, F.lit(1))

    def swapped(text: Column, hexadecimal: Column | None = None) -> Column:
        """Each digit by a digit and each letter by one of its case; marks stay."""

        def one(c: Column, i: Column) -> Column:
            is_hex = F.lit(False) if hexadecimal is None else hexadecimal
            return (
                F.when(is_hex & c.rlike("[0-9a-f]"), stream(digest, i))
                .when(c.rlike("[0-9]"), stream(digits, i))
                .when(c.rlike(r"\p{Lu}"), F.upper(stream(letters, i)))
                .when(c.rlike(r"\p{L}"), stream(letters, i))
                .otherwise(c)
            )

        return F.array_join(F.transform(F.split(text, ""), one), "")

    def numbered(text: Column, keep: str) -> Column:
        """Digits by digits, numbered without the marks between them, so all formats get the same ones.

        A digit before which ``keep`` matches the text so far stays.
        """
        chars = F.split(text, "")
        head = F.length(F.regexp_extract(text, keep, 0))
        place = lambda i: F.length(F.regexp_replace(F.substring(text, F.lit(1), i), "[^0-9A-Z]", ""))
        return F.array_join(
            F.transform(
                chars,
                lambda c, i: F.when(i < head, c)
                .when(c.rlike("[0-9]"), stream(digits, place(i)))
                .when(c.rlike("[A-Z]"), F.upper(stream(letters, place(i))))
                .otherwise(c),
            ),
            "",
        )

    domain = F.regexp_extract(mention, "@(.*)$", 1)
    tld = F.regexp_extract(domain, r"\.[A-Za-z]+$", 0)
    email = F.concat(swapped(F.regexp_extract(mention, "^[^@]+", 0)), F.lit("@"), F.lit("mail-"), F.substring(letters, 40, 6), F.lit(".example"), tld)
    octet = lambda n: F.conv(F.substring(digest, 2 * n + 1, 2), 16, 10)
    # Private addresses, as long as they last.
    ip = F.concat_ws(".", F.when(attempt < WIDER, "10").otherwise(octet(0)), octet(1), octet(2), octet(3))
    number = numbered(mention, "^[0-9]")
    card = F.when(luhn(mention), with_luhn(number)).otherwise(number)
    title = F.regexp_extract(mention, r"^(\S+\s)", 1)
    script = F.when(mention.rlike(r"\p{IsCyrillic}"), "Cyrillic").when(mention.rlike(r"\p{IsGreek}"), "Greek").otherwise("Latin")
    bare = F.regexp_replace(F.trim(title), r"\.$", "")
    turn = F.conv(F.substring(digest, 20, 6), 16, 10).cast("int")
    gender = F.when(bare.isin(*FEMALE), "female").when(bare.isin(*MALE), "male").otherwise(F.lit("male"))
    names = F.create_map(*[x for k, v in NAMES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    given, family = names[F.concat_ws(" ", gender, script)], names[F.concat_ws(" ", F.lit("family"), script)]
    pick = lambda list_, n: F.element_at(list_, F.pmod(n, F.size(list_)).cast("int") + 1)
    endings = {"Cyrillic": "бвгджзклмнпрстфх", "Greek": "βγδζθκλμνξπρστφχ"}
    # The lists alone would run out; with five letters more, and another for each attempt, there is a name for every entity.
    more = F.least(attempt + 5, F.lit(30))
    suffix = F.substring(letters, F.lit(30), more)
    for other, consonants in endings.items():
        suffix = F.when(script == other, F.translate(F.substring(digest, F.lit(30), more), HEX, consonants)).otherwise(suffix)
    invented = F.concat(pick(family, F.floor(turn / 16)), suffix)
    two = mention.rlike(r"^\S+\s\S+\s\S+$")
    name = F.concat(title, F.when(two, F.concat(pick(given, turn), F.lit(" "), invented)).otherwise(invented))
    return (
        F.when(kind == "email", email)
        .when(kind == "ip", ip)
        .when(kind == "card", card)
        .when(kind == "iban", numbered(mention, "^[A-Z]{2}"))
        .when(kind == "phone", numbered(mention, r"^\+[0-9]{1,3}(?=[ .(-])|^"))
        .when(kind == "ssn", numbered(mention, "^"))
        .when(kind == "key", F.concat(F.substring(mention, 1, 4), F.upper(swapped(F.substring(mention, 5, 16)))))
        .when(kind == "name", name)
        .otherwise(swapped(mention, mention.rlike("^[0-9a-f]+$")))
    )


def _luhn_sum(number: Column) -> Column:
    digits = F.transform(F.split(F.reverse(F.regexp_replace(number, "[^0-9]", "")), ""), lambda c: F.coalesce(c.try_cast("int"), F.lit(0)))
    doubled = F.transform(digits, lambda d, i: F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d)


def luhn(number: Column) -> Column:
    return _luhn_sum(number) % 10 == 0


def with_luhn(number: Column) -> Column:
    """The number with its last digit set so that the check holds."""
    head = F.substring(number, F.lit(1), F.length(number) - 1)
    return F.concat(head, F.pmod(-_luhn_sum(F.concat(head, F.lit("0"))), F.lit(10)).cast("string"))


def replace_pii(docs: DataFrame, key: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(row, replaced, types): texts with personal data and secrets replaced by surrogates.

    Mentions of one entity get the same surrogate in all texts, each in its own format; entities differ in
    their surrogates. A surrogate is a keyed hash of type, entity and attempt, shaped like the mention: digits
    by digits, letters by letters of their case, valid octets, a card number with a good check digit if it had one,
    names of the title's gender in the script they are written in. All entities' surrogates are compared with
    each other and with the entities that occur, as entities, so that no two differ in marks or case only; those that clash, but
    for the first, are drawn anew, until none does. Names get longer and addresses less private with each attempt; a type with
    more entities than its format has surrogates ends in an error. ``types`` lists the types found, in order.

    ``key`` is a secret of the caller: with it, and with the entities, surrogates can be told again.

    Only entities, not texts, are grouped and joined; a hot entity is one row there. The text meets its own
    surrogates once. DataFrame functions only.

    ``row`` holds all columns of the input, whatever their names. Null or empty texts stay as they are, with no
    types. Rows of one id and one text are treated alike; null ids are fine. An empty table gives no rows.
    """
    base = docs.select(
        F.struct("*").alias("row"), F.col(doc_id).alias("id"), F.xxhash64(text).alias("text_id"), F.col(text).alias("text")
    )
    matches = F.regexp_extract_all("text", F.lit(PATTERN), 0)
    mentions = (
        base.select("id", "text_id", F.posexplode(matches).alias("i", "mention"))
        .distinct()
        .withColumn("kind", entity_type(F.col("mention")))
        .withColumn("who", entity(F.col("kind"), F.col("mention")))
    )
    mentions = cut(mentions)
    known = mentions.groupBy("kind", "who").agg(F.min("mention").alias("form")).withColumn("attempt", F.lit(0))
    real = mentions.select("kind", F.col("who").alias("new_who")).distinct().withColumn("is_real", F.lit(True))
    parts = F.col("kind"), F.col("form"), F.col("who"), F.col("attempt")
    turn = Window.partitionBy("kind", "new_who").orderBy("who")
    for attempt in range(MOST + 1):
        drawn = known.withColumn("new_who", entity(F.col("kind"), surrogate(*parts, key)))
        drawn = drawn.join(real, ["kind", "new_who"], "left")
        drawn = cut(drawn.withColumn("clash", (F.row_number().over(turn) > 1) | F.coalesce("is_real", F.lit(False))))
        known = drawn.select("kind", "who", "form", (F.col("attempt") + F.col("clash").cast("int")).alias("attempt"))
        left = drawn.where("clash").groupBy("kind").count().collect()
        if not left:
            break
        if attempt == MOST:
            raise ValueError(f"types with fewer surrogates than entities: {', '.join(sorted(r['kind'] for r in left))}")
    new = surrogate(F.col("kind"), F.col("mention"), F.col("who"), F.col("attempt"), key)
    replacements = (
        mentions.join(known, ["kind", "who"])
        .groupBy(F.col("id").alias("of"), F.col("text_id").alias("of_text"))
        .agg(F.array_sort(F.collect_list(F.struct("i", "kind", new.alias("new")))).alias("found"))
    )
    on = F.col("id").eqNullSafe(F.col("of")) & (F.col("text_id") == F.col("of_text"))
    between = F.split("text", PATTERN, -1)
    news = F.concat(F.transform("found", lambda x: x["new"]), F.array(F.lit("")))
    whole = F.array_join(F.zip_with(between, news, lambda a, b: F.concat(a, b)), "")
    return base.join(replacements, on, "left").select(
        "row",
        F.when(F.col("found").isNull(), F.col("text")).otherwise(whole).alias("replaced"),
        F.coalesce(F.transform("found", lambda x: x["kind"]), F.array().cast("array<string>")).alias("types"),
    )
