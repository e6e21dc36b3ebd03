"""Personal data and secrets replaced by surrogates, with DataFrame and SQL functions only.

Each entity is replaced by another of its type, made from a keyed hash of the entity: characters keep
their class (digit, lower, upper), e-mail addresses their suffix, phone numbers their country code,
card numbers their first digit and check digit, account numbers their country and check digits, hosts
their being private, loopback, multicast or public, names their script. One entity has one surrogate
wherever it is mentioned, whatever the mention's format. Surrogates are checked against each other and
against all entities of the corpus; those that collide are made anew with the next attempt number, so
distinct entities stay distinct.

Names are found by their titles. Given and family name have a surrogate each, so a person keeps both
with any title or none; a given name's gender is that of most of its titles in the corpus. A full name
with a title anywhere in the corpus is also replaced where it stands without one, and so is, in a
document with the full name or the titled family name, the family name alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.tables import free, settle

#: Attempts to find a free surrogate.
ATTEMPTS = 24
#: Attempts within a private block before others of them are used.
OWN_BLOCK = 6
TITLES = {"m": r"Mr\.|Mister|Herr|Monsieur|Señor", "f": r"Mrs\.|Ms\.|Miss|Frau|Mme|Madame|Señora", "n": r"Dr\.|Prof\."}
NAME = r"\p{Lu}(?:\p{Ll}+|['’]\p{Lu}\p{Ll}+)(?:[-'’]?\p{Lu}\p{Ll}+)*"
#: Names side by side, which may be a full name without a title.
SIDE_BY_SIDE = rf"(?<!\p{{L}}){NAME}(?: {NAME})+"
#: The country code of a phone number's digits; fixed values of the numbering plan.
COUNTRY_CODE = r"^(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
_TITLED = "|".join(TITLES.values())
# What stands before a secret; it is matched with it and written back.
_KEYWORD = r"(?i:token|password|passwd|secret|api_key|apikey)\s{0,3}[=:]\s{0,3}[\"']?"
#: Type -> pattern, in order of precedence at one place.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]+@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,}",
    "key": r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])",
    "secret": rf"{_KEYWORD}(?!AKIA[0-9A-Z]{{16}}(?![A-Za-z0-9]))[A-Za-z0-9_/+\-]{{8,}}+(?![A-Za-z0-9._%+\-]*@)",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d)",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "phone": r"(?<![\d+])\+\d{1,3}(?:[ .\-]?\(\d{2,4}\))?(?:[ .\-]?\d{2,4}){2,4}(?!\d)|(?<![\d(])\(\d{3}\) ?\d{3}[ .\-]\d{4}(?!\d)",
    "card": r"(?<![\d+])(?:\d{4}[ \-]){3}\d{4}(?!\d)|(?<![\d+])\d{13,19}(?!\d)",
    "ssn": r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])",
    "name": rf"(?<!\p{{L}})(?:{_TITLED}) {NAME}(?: {NAME})?",
}
#: What each text with an entity has somewhere, cheap to look for: most texts are never searched.
SIGNS = (
    r"[0-9](?:\.[0-9]{1,3}\.|[0-9]{2}-[0-9]{2}-|[0-9]{3}[ \-][0-9]{4}|[0-9]{12})|\+[0-9]|\([0-9]{3}\)|[A-Z]{2}[0-9]{2}[ A-Z0-9]",
    r"[MHFSDP](?:rs?\.|s\.|ister|iss|me|adame|onsieur|err|rau|eñora?|rof\.) \p{Lu}",
    r"[tTpPsSaA](?i:oken|assword|asswd|ecret|pi_key|pikey)\s{0,3}[=:]",
)
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
# Surrogates of names are spelled from syllables; a given name's last tells its gender.
GIVEN_ENDS = {"latin": {"m": ["no", "rt", "ld", "us"], "f": ["na", "ra", "lia", "tta"], "n": ["ni", "ry", "lle", "xis"]}, "cyrillic": {"m": ["мир", "слав", "ан", "ор"], "f": ["на", "ра", "лия", "тта"], "n": ["ни", "ри", "ле", "ки"]}, "greek": {"m": ["νος", "ρης", "λας", "τος"], "f": ["να", "ρα", "λια", "τα"], "n": ["νι", "ρι", "λε", "κι"]}}
SYLLABLES = {"latin": ["ba", "do", "fe", "gi", "ka", "lu", "ma", "ne", "po", "ri", "sa", "ti", "vo", "wi", "ze", "ro"], "cyrillic": ["ба", "до", "фе", "ги", "ка", "лу", "ма", "не", "по", "ри", "са", "ти", "во", "ви", "зе", "ро"], "greek": ["βα", "δο", "φε", "γι", "κα", "λυ", "μα", "νε", "πο", "ρι", "σα", "τι", "βο", "ξι", "ζε", "ρο"]}


def searched(text: Column) -> Column:
    """Whether ``text`` may have an entity."""
    out = text.contains("@") | text.contains("AKIA")
    for sign in SIGNS:
        out |= text.rlike(sign)
    return out


def kind_of(mention: Column) -> Column:
    """The type of a mention: the first pattern that it matches as a whole; secrets have none."""
    out = F.lit("secret")
    for kind in reversed([k for k in PATTERNS if k != "secret"]):
        out = F.when(mention.rlike(rf"^(?:{PATTERNS[kind]})$"), kind).otherwise(out)
    return out


def gender_of(mention: Column) -> Column:
    out = F.lit("n")
    for g in ("m", "f"):
        out = F.when(mention.rlike(rf"^(?:{TITLES[g]}) "), g).otherwise(out)
    return out


def name_part(mention: Column) -> Column:
    return F.regexp_replace(mention, rf"^(?:{_TITLED}) ", "")


def given_of(mention: Column) -> Column:
    """The given name of a titled name of two words, in lower case; else null."""
    return F.when(name_part(mention).contains(" "), F.lower(F.substring_index(name_part(mention), " ", 1)))


def entity_of(kind: Column, mention: Column) -> Column:
    """What a mention stands for, whatever its format: its identity within its type; of a name, the
    family name. A phone number without a country code is one of ten digits of the code 1."""
    digits = F.regexp_replace(mention, r"\D", "")
    return (
        F.when((kind == "phone") & ~mention.startswith("+"), F.concat(F.lit("1"), digits))
        .when(kind.isin("phone", "card", "ssn"), digits)
        .when(kind == "iban", F.regexp_replace(mention, " ", ""))
        .when(kind == "email", F.lower(mention))
        .when(kind == "name", F.lower(F.substring_index(name_part(mention), " ", -1)))
        .when(kind == "secret", F.regexp_replace(mention, f"^{_KEYWORD}", ""))
        .otherwise(mention)
    )


def draw(hexed: Column, i: Column, n: int) -> Column:
    """A number below ``n`` from four hexadecimal digits of ``hexed``, at a place that follows i."""
    return F.conv(F.substring(hexed, F.pmod(i * 4, F.lit(252)) + 1, F.lit(4)), 16, 10).cast("int") % n


def spelled(hexed: Column, chars: Column, hex_only: Column) -> Column:
    """``chars`` (an array) with each letter and digit replaced by one of its class."""

    def one(c: Column, i: Column) -> Column:
        lower = F.when(hex_only, F.substring(F.lit("abcdef"), draw(hexed, i, 6) + 1, F.lit(1))).otherwise(F.char(draw(hexed, i, 26) + 97))
        upper = F.when(hex_only, F.substring(F.lit("ABCDEF"), draw(hexed, i, 6) + 1, F.lit(1))).otherwise(F.char(draw(hexed, i, 26) + 65))
        return F.when(c.rlike("[0-9]"), draw(hexed, i, 10).cast("string")).when(c.rlike("[a-z]"), lower).when(c.rlike("[A-Z]"), upper).otherwise(c)

    return F.array_join(F.transform(chars, one), "")


def with_check_digit(number: Column) -> Column:
    """``number`` with its last digit set so that the card checksum holds."""
    body = F.reverse(F.split(F.substring(number, F.lit(1), F.length(number) - 1), ""))
    double = lambda d: F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)
    summed = F.aggregate(F.transform(body, lambda c, i: F.when(i % 2 == 0, double(c.cast("int"))).otherwise(c.cast("int"))), F.lit(0), lambda s, x: s + x)
    return F.concat(F.substring(number, F.lit(1), F.length(number) - 1), F.pmod(F.lit(10) - F.pmod(summed, F.lit(10)), F.lit(10)).cast("string"))


def with_account_check(country: Column, body: Column) -> Column:
    """An account number with the two check digits (remainders of 97) that its country and body need."""
    add = lambda r, c: F.when(c.rlike("[0-9]"), (r * 10 + c.try_cast("int")) % 97).otherwise((r * 100 + F.ascii(c) - 55) % 97)
    rest = F.aggregate(F.split(F.concat(body, country, F.lit("00")), ""), F.lit(0), add)
    return F.concat(country, F.lpad((98 - rest).cast("string"), 2, "0"), body)


def phone_number(entity: Column, plain: Column, hexed: Column) -> Column:
    """Digits with the same country code. Area and exchange of the code 1 begin with 2 to 9, others
    with 1 to 9."""
    code = F.regexp_extract(entity, COUNTRY_CODE, 0)
    own = F.substring(plain, F.length(code) + 1, F.length(plain))
    first = F.when(code == "1", draw(hexed, F.lit(40), 8) + 2).otherwise(draw(hexed, F.lit(40), 9) + 1).cast("string")
    exchange = F.when((code == "1") & (F.length(own) == 10), (draw(hexed, F.lit(41), 8) + 2).cast("string")).otherwise(F.substring(own, 4, 1))
    return F.concat(code, first, F.substring(own, 2, 2), exchange, F.substring(own, F.lit(5), F.length(own)))


def host(entity: Column, hexed: Column, attempt: int) -> Column:
    """A host of the same kind: private (of the same block first), loopback, link-local, multicast and
    above, zero, or public."""
    octet = [F.split(entity, r"\.")[i].cast("int") for i in range(2)]
    new = [draw(hexed, F.lit(i), 254) + 1 for i in range(4)]
    public = F.get(F.array(*(F.lit(i) for i in range(1, 224) if i not in (10, 100, 127, 169, 172, 192, 198, 203))), draw(hexed, F.lit(0), 215))
    ten = F.array(F.lit(10), *new[1:])
    private = {"10": ten, "172": F.array(F.lit(172), draw(hexed, F.lit(1), 16) + 16, *new[2:]), "192": F.array(F.lit(192), F.lit(168), *new[2:])} if attempt < OWN_BLOCK else dict.fromkeys(("10", "172", "192"), ten)
    made = (
        F.when(octet[0] == 10, private["10"])
        .when((octet[0] == 172) & octet[1].between(16, 31), private["172"])
        .when((octet[0] == 192) & (octet[1] == 168), private["192"])
        .when((octet[0] == 169) & (octet[1] == 254), F.array(F.lit(169), F.lit(254), *new[2:]))
        .when(octet[0].isin(0, 127), F.array(octet[0], *new[1:]))
        .when(octet[0] >= 240, F.array(draw(hexed, F.lit(0), 16) + 240, *new[1:]))
        .when(octet[0] >= 224, F.array(draw(hexed, F.lit(0), 16) + 224, *new[1:]))
        .otherwise(F.array(public, *new[1:]))
    )
    return F.array_join(made.cast("array<string>"), ".")


def name_word(kind: Column, entity: Column, hexed: Column, attempt: int) -> Column:
    """A family name of syllables, or a given name (``entity``: gender, "|", name) that ends by its
    gender, in the entity's script; later attempts are longer."""
    made = F.lit(None).cast("string")
    for script, syllables in SYLLABLES.items():
        syllable = lambda i: F.get(F.array(*map(F.lit, syllables)), draw(hexed, F.lit(i), len(syllables)))  # noqa: B023, E731
        end = F.lit("")
        for g, ends in GIVEN_ENDS[script].items():
            end = F.when((kind == "given") & (F.substring(entity, 1, 1) == g), F.get(F.array(*map(F.lit, ends)), draw(hexed, F.lit(0), len(ends)))).otherwise(end)
        stem = F.concat(*(syllable(i) for i in range(1, 4 + attempt // 2)), F.when(kind == "family", syllable(63)).otherwise(""))
        named = F.initcap(F.concat(stem, end))
        made = named if script == "latin" else F.when(entity.rlike(rf"\p{{Is{script.capitalize()}}}"), named).otherwise(made)
    return made


def with_surrogate(df: DataFrame, key: str, attempt: int) -> DataFrame:
    """``df`` (kind, entity) with surrogate, in the entity's own form; ``attempt`` gives another one.

    The hash and the plain respelling are columns of their own, so that the plan names them once.
    """
    kind, entity = F.col("kind"), F.col("entity")
    salted = [F.sha2(F.concat_ws("\x1f", F.lit(key), kind, entity, F.lit(str(attempt)), F.lit(str(i))), 256) for i in range(4)]
    df = df.withColumn("hexed", F.concat(*salted))
    hexed, plain = F.col("hexed"), F.col("plain")
    df = df.withColumn("hex_only", entity.rlike(r"^(?i)[0-9a-f]+$") & (kind == "secret"))
    df = df.withColumn("plain", spelled(hexed, F.split(entity, ""), F.col("hex_only")))
    first = F.concat(F.substring(entity, 1, 1), F.substring(plain, F.lit(2), F.length(plain)))
    suffix = F.regexp_extract(entity, r"(\.[^.]+)$", 1)
    email = F.concat(F.substring(plain, F.lit(1), F.length(plain) - F.length(suffix)), suffix)
    keeps_prefix = F.concat(F.substring(entity, 1, 4), F.substring(plain, F.lit(5), F.length(plain)))
    # no part is all zeros, and areas lie below those that are never given out
    social = F.concat(*(F.lpad((draw(hexed, F.lit(i), n) + 1).cast("string"), width, "0") for i, (n, width) in enumerate(((665, 3), (99, 2), (9999, 4)))))
    made = (
        F.when(kind == "email", email)
        .when(kind == "ip", host(entity, hexed, attempt))
        .when(kind == "card", with_check_digit(first))
        .when(kind == "phone", phone_number(entity, plain, hexed))
        .when(kind == "ssn", social)
        .when(kind == "key", keeps_prefix)
        .when(kind == "iban", with_account_check(F.substring(entity, 1, 2), F.substring(plain, F.lit(5), F.length(plain))))
        .when(kind.isin("given", "family"), name_word(kind, entity, hexed, attempt))
        .otherwise(plain)
    )
    return df.withColumn("surrogate", made).select("kind", "entity", "surrogate")


def assign(entities: DataFrame, key: str) -> DataFrame:
    """(kind, entity, surrogate) of distinct ``entities`` (kind, entity); surrogates are distinct
    within a kind (given and family names are one) and none is an entity.

    Raises if some still collide after all attempts: short numbers may have too few surrogates.
    """
    within = F.when(F.col("kind").isin("given", "family"), "name").otherwise(F.col("kind")).alias("within")
    bare = F.lower(F.when(F.col("kind") == "given", F.substring("entity", 3, 1 << 20)).otherwise(F.col("entity")))
    pending, done = settle(entities, "entities"), None
    everything = pending.select(within, bare.alias("cand")).distinct()
    for attempt in range(ATTEMPTS):
        tried = settle(with_surrogate(pending, key, attempt).select("kind", "entity", "surrogate", within, F.lower("surrogate").alias("cand")), "tried")
        first = tried.groupBy("within", "cand").agg(F.min(F.struct("kind", "entity")).alias("own"))
        first = first.join(everything, ["within", "cand"], "left_anti")
        if done is not None:
            first = first.join(done.select(within, F.lower("surrogate").alias("cand")), ["within", "cand"], "left_anti")
        first = first.select("own.*")
        good = settle(tried.join(first, ["kind", "entity"], "left_semi").select("kind", "entity", "surrogate"), "surrogates")
        done = good if done is None else done.union(good)
        pending = settle(tried.join(good, ["kind", "entity"], "left_anti").select("kind", "entity"), "entities")
        if not pending.take(1):
            return done
    raise ValueError("some entities have no surrogate that is free; their formats have too few values")


def fitted(kind: Column, mention: Column, value: Column, given: Column) -> Column:
    """A surrogate in the format of a mention: its separators, its upper case, its title and whether
    it has a given name."""
    value = F.when((kind == "phone") & ~mention.startswith("+"), F.substring(value, F.lit(2), F.length(value))).otherwise(value)
    chars = F.split(mention, "")
    place = lambda i: F.size(F.filter(F.slice(chars, F.lit(1), i), lambda c: c.rlike(r"\d")))
    digits = F.array_join(F.transform(chars, lambda c, i: F.when(c.rlike(r"\d"), F.substring(value, place(i) + 1, F.lit(1))).otherwise(c)), "")
    cased = F.array_join(F.transform(chars, lambda c, i: F.when(c.rlike(r"\p{Lu}"), F.upper(F.substring(value, i + 1, F.lit(1)))).otherwise(F.substring(value, i + 1, F.lit(1)))), "")
    title = F.regexp_extract(mention, rf"^((?:{_TITLED}) )", 1)
    spaced = F.array_join(F.transform(chars, lambda c, i: F.when(c == " ", c).otherwise(F.substring(value, i + 1 - F.size(F.filter(F.slice(chars, F.lit(1), i), lambda x: x == " ")), F.lit(1)))), "")
    return (
        F.when(kind.isin("phone", "card", "ssn"), digits)
        .when(kind == "email", cased)
        .when(kind == "iban", spaced)
        .when(kind == "family", F.concat(title, F.concat_ws(" ", given, value)))
        .when(kind == "secret", F.concat(F.regexp_extract(mention, f"^({_KEYWORD})", 1), value))
        .otherwise(value)
    )


def with_surrogates(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with n_entities and redacted: the text with its entities replaced.

    Null texts stay null with 0 entities; texts without entities stay as they are. Equal entities
    get equal surrogates in all documents, different ones different surrogates. Ids should tell texts
    apart; rows that repeat an id with its text get the same result, and a row with a null id goes by
    a hash of its text. Other columns are kept; those named like a result give way to it.
    """
    text, own, new, swap = F.col(text_col), free(docs, "own"), free(docs, "new"), free(docs, "swap")
    named = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("null "), F.xxhash64(text).cast("string")))
    found = docs.filter(searched(text)).select(named.alias("own"), F.regexp_extract_all(text, F.lit(ANY), F.lit(0)).alias("m")).filter(F.size("m") > 0)
    mentions = found.dropDuplicates(["own"]).select("own", F.posexplode("m").alias("pos", "mention"))
    mentions = mentions.withColumn("kind", kind_of(F.col("mention"))).withColumn("entity", entity_of(F.col("kind"), F.col("mention")))
    mentions = mentions.withColumn("given", F.when(F.col("kind") == "name", given_of(F.col("mention"))))
    mentions = settle(mentions.withColumn("kind", F.when(F.col("kind") == "name", "family").otherwise(F.col("kind"))), "mentions")
    # a given name's gender: that of most of its titles
    of = lambda g: F.count_if(gender_of(F.col("mention")) == g)
    genders = mentions.filter("given is not null").groupBy("given").agg((of("m") - of("f")).alias("most"))
    genders = genders.select("given", F.concat(F.when(F.col("most") > 0, "m|").when(F.col("most") < 0, "f|").otherwise("n|"), F.col("given")).alias("entity"))
    surrogates = assign(mentions.select("kind", "entity").distinct().union(genders.select(F.lit("given"), "entity")), key)
    givens = surrogates.filter("kind = 'given'").select(F.substring("entity", 3, 1 << 20).alias("given"), F.col("surrogate").alias("new_given"))
    placed = settle(mentions.join(surrogates, ["kind", "entity"]).join(givens, "given", "left"), "placed")
    swaps = without_titles(docs.select(named.alias("own"), text.alias("text")), placed.filter("kind = 'family'"))
    spot = F.struct("pos", fitted(F.col("kind"), F.col("mention"), F.col("surrogate"), F.col("new_given")).alias("new"))
    parts = placed.select("own", spot.alias("spot"), F.lit(None).cast("struct<place:int,old:string,new:string>").alias("swap"))
    parts = parts.union(swaps.select("own", F.lit(None).cast("struct<pos:int,new:string>"), F.struct("place", "old", "new")))
    by_doc = parts.groupBy(F.col("own").alias(own)).agg(F.transform(F.array_sort(F.collect_list("spot")), lambda x: x["new"]).alias(new), F.array_sort(F.collect_set("swap")).alias(swap))
    out = docs.join(by_doc, named == F.col(own), "left")
    bounded = lambda x: F.concat(F.lit(r"(?<!\p{L})"), x, F.lit(r"(?!\p{L})"))
    pieces = F.split(text, ANY, -1)
    swapped = F.transform(pieces, lambda p: F.aggregate(F.col(swap), p, lambda t, x: F.regexp_replace(t, bounded(x["old"]), x["new"])))
    any_old = bounded(F.concat(F.lit("(?:"), F.array_join(F.transform(F.col(swap), lambda x: x["old"]), "|"), F.lit(")")))
    more = F.when(F.size(swap) > 0, F.aggregate(pieces, F.lit(0), lambda n, p: n + F.regexp_count(p, any_old))).otherwise(0)
    woven = F.array_join(F.flatten(F.zip_with(swapped, F.col(new), lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))), "")
    results = {"n_entities": F.when(F.col(new).isNull(), 0).otherwise(F.size(new) + more).cast("long"), "redacted": F.when(F.col(new).isNull(), text).otherwise(woven)}
    return out.select(*(c for c in docs.columns if c.lower() not in results), *(c.alias(n) for n, c in results.items()))


def without_titles(docs: DataFrame, names: DataFrame) -> DataFrame:
    """(own, place, old, new): the names of ``names`` (own, mention, given, entity and their surrogates)
    that documents (own, text) may hold without a title; full names come before family names."""
    part = name_part(F.col("mention"))
    family = F.substring_index(part, " ", -1)
    whole = names.filter("given is not null").select(part.alias("old"), F.concat_ws(" ", "new_given", "surrogate").alias("new"), family.alias("family"), F.col("surrogate").alias("new_family"))
    whole = settle(whole.distinct(), "full-names")
    runs = F.regexp_extract_all("text", F.lit(SIDE_BY_SIDE), F.lit(0))
    two = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - 2), lambda i: F.concat_ws(" ", F.get(w, i), F.get(w, i + 1)))
    pairs = docs.filter(F.col("text").rlike(SIDE_BY_SIDE)).select("own", F.explode(F.array_distinct(F.flatten(F.transform(runs, lambda r: two(F.split(r, " ")))))).alias("old"))
    held = settle(pairs.join(whole, "old"), "untitled")
    out = held.select("own", F.lit(0).alias("place"), "old", "new").union(held.select("own", F.lit(1), "family", "new_family"))
    return out.union(names.select("own", F.lit(1), family, "surrogate")).distinct()
