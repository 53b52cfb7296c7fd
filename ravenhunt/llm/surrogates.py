"""Operator 5, PII: surrogate generation with DataFrame functions only.

Detected entities (``PATTERNS``) are replaced by surrogates of the same type:

- keyed: every choice comes from SHA-256 over the key, the type, the entity's
  canonical form and an attempt number;
- format: letters become letters and digits digits, separators stay; a
  payment card keeps its first digit and its Luhn validity, an IP address its
  octets' lengths and range, a phone number its country prefix, an e-mail
  address its shape and top-level domain, a hexadecimal secret its case;
- script: ASCII, accented Latin, Greek and Cyrillic letters are replaced by
  letters of their own kind; other letters stay as they are;
- gender: a name after a title keeps the title, and its words are built from
  syllables of its script with the ending of the title's gender;
- coreference: an entity has one canonical form (case of e-mail addresses and
  separators of numbers do not matter), so all mentions everywhere get
  surrogates that correspond;
- distinctness: two entities never share a surrogate, and no surrogate is a
  canonical form that occurs in the corpus. The table of canonical forms is
  checked against itself; all but the first of those that clash, and those that
  hit a real entity, try again with the next attempt. Where a format has too
  few values, attempts from ``WIDE`` on leave its lengths, so that an unused
  surrogate is found: IP addresses the octets' lengths, names get one more
  syllable a word with each attempt, the local part of e-mail addresses one more
  letter.

Only texts that hold an entity are joined, by the text's SHA-256, so copies
are replaced once and a text's key is never larger than its copies (which
adaptive execution splits). The entity table is deduplicated before it is
joined; an entity in a third of all documents is one row of it.

Defined results: null texts stay null, empty ones empty; entities may be of any
length; repeated rows are replaced alike; all columns of the table are kept as
they are, whatever their names, apart from the text and one that has the name
of the count; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ravenhunt.session import drop_scratch, scratch_table

ATTEMPTS, WIDE = 60, 6

# Titles with the gender they tell; fixed values.
MALE = ["Mr", "Herr", "Señor", "Sr", "Monsieur", "господин", "Κύριος"]
FEMALE = ["Mrs", "Ms", "Miss", "Frau", "Señora", "Sra", "Madame", "Mme", "госпожа", "Κυρία"]

_EDGE, _END = r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
#: type -> pattern, in the order in which they are tried at a place
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@(?:[\p{L}\p{N}-]{1,63}+\.){1,8}\p{L}{2,24}+",
    "secret": _EDGE + r"(?=[0-9a-fA-F]*[0-9])(?=[0-9a-fA-F]*[a-fA-F])[0-9a-fA-F]{32,}+" + _END,
    "iban": _EDGE + r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?" + _END,
    "card": _EDGE + r"(?<![.+-])\d(?:[ -]?\d){12,18}" + _END,
    "ip": r"(?<![\p{L}\p{N}.])" + rf"(?:{_OCTET}\.){{3}}{_OCTET}" + r"(?![\p{L}\p{N}]|\.\d)",
    "ssn": _EDGE + r"(?<!-)\d{3}-\d{2}-\d{4}" + _END,
    "phone": r"(?<![\p{L}\p{N}+])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})" + _END,
    "name": _EDGE + rf"(?:{'|'.join(sorted(MALE + FEMALE, key=len, reverse=True))})\.? \p{{Lu}}\p{{Ll}}{{1,30}}+(?:[ -]\p{{Lu}}\p{{Ll}}{{1,30}}+){{0,2}}",
}
ENTITY = "|".join(f"(?:{p})" for p in PATTERNS.values())

# Letters of a kind, and syllables of a script: fixed values.
ACCENTED = "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþß"
GREEK = "αβγδεζηθικλμνξοπρστυφχψω"
CYRILLIC = "абвгдежзиклмнопрстуфхцчшэюя"
SYLLABLES = {
    "latin": "ba be bi bo da de di do fa fe ga go ha he ja jo ka ke ki la le li lo ma me mi mo na ne ni no pa pe po ra re ri ro sa se si so ta te ti to va ve vi za ze zo".split(),
    "greek": "βα γα δε ζω θε κα κο λα λε λι μα με μι να νε νι πα πε πο ρα ρε ρι σα σε σι τα τε τι φα χα".split(),
    "cyrillic": "ба бо ва ве га го да де жа за зе ка ки ко ла ле ли ма ме ми на не ни па пе по ра ре ри са се си та те ти фа".split(),
}
ENDINGS = {"latin": ("n", "na"), "greek": ("ος", "η"), "cyrillic": ("в", "ва")}


def may_hold(text: Column) -> Column:
    """Cheaper than the patterns, and true for every text that one of them
    matches: all entities have a digit or an @, but for names, which have a title."""
    out = text.rlike("[0-9@]")
    for title in MALE + FEMALE:
        out = out | text.contains(title + " ") | text.contains(title + ". ")
    return out


def kind_of(entity: Column) -> Column:
    """The type of a matched entity: the first whose pattern matches it whole."""
    out = F.lit(None).cast("string")
    for name, pattern in reversed(PATTERNS.items()):
        out = F.when(entity.rlike(f"^(?:{pattern})$"), name).otherwise(out)
    return out


def _country(entity: Column) -> Column:
    """The country prefix of a phone number; it stays."""
    return F.regexp_extract(entity, r"^(\+\d{1,3})(?=[ .(:-])", 1)


def canonical(kind: Column, entity: Column) -> Column:
    """What all mentions of an entity have in common."""
    digits = F.regexp_replace(entity, r"[^\d]", "")
    local = F.regexp_replace(F.substr(entity, F.length(_country(entity)) + 1, F.length(entity)), r"[^\d]", "")
    return (F.when(kind.isin("email", "secret"), F.lower(entity))
            .when(kind.isin("card", "ssn"), digits)
            .when(kind == "phone", F.concat(_country(entity), F.lit(":"), local))
            .when(kind == "iban", F.regexp_replace(entity, " ", ""))
            .when(kind == "name", F.regexp_replace(entity, r"\. ", " "))
            .otherwise(entity))


def _bytes(key: str, kind: Column, canon: Column, attempt: Column) -> Column:
    """As many pseudo-random numbers 0..255 as any place of the entity may need."""
    blocks = F.sequence(F.lit(0), F.floor(F.length(canon) / 32).cast("int"))
    digest = F.array_join(F.transform(blocks, lambda b: F.sha2(F.concat_ws("\x1f", F.lit(key), kind, canon, attempt.cast("string"), b.cast("string")), 256)), "")
    # the digest is worked out once, not for each of its bytes
    return F.transform(F.regexp_extract_all(digest, F.lit(".."), F.lit(0)), lambda h: F.conv(h, 16, 10).cast("int"))


def _pick(letters: str, n: Column) -> Column:
    return F.substr(F.lit(letters), n % len(letters) + 1, F.lit(1))


def _letter(c: Column, n: Column) -> Column:
    """Another letter or digit of the same kind and case; anything else stays."""
    low = F.lower(c)
    new = (F.when(c.rlike("^[0-9]$"), (n % 10).cast("string"))
           .when(low.rlike("^[a-z]$"), _pick("abcdefghijklmnopqrstuvwxyz", n))
           .when(F.instr(F.lit(ACCENTED), low) > 0, _pick(ACCENTED, n))
           .when(F.instr(F.lit(GREEK + "ςάέήίόύώ"), low) > 0, _pick(GREEK, n))
           .when(F.instr(F.lit(CYRILLIC + "ёйщъыь"), low) > 0, _pick(CYRILLIC, n)))
    return F.coalesce(F.when((c != low) & (new != "ß"), F.upper(new)).otherwise(new), c)


def _chars(s: Column) -> Column:
    return F.filter(F.split(s, ""), lambda c: c != "")


def _same_kind(s: Column, numbers: Column) -> Column:
    return F.array_join(F.transform(_chars(s), lambda c, i: _letter(c, F.get(numbers, i))), "")


def _luhn(digits: Column) -> Column:
    """Sum of a digit string after Luhn, from the right."""
    back = F.transform(_chars(F.reverse(digits)), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(back, F.lit(0), lambda a, b: a + b)


def new_canonical(kind: Column, canon: Column, attempt: Column, key: str) -> Column:
    """The canonical form of the surrogate."""
    n = _bytes(key, kind, canon, attempt)
    plain = _same_kind(canon, n)
    domain_end = F.regexp_extract(canon, r"(\.[^.@]+)$", 1)
    email = F.concat(_same_kind(F.substr(canon, F.lit(1), F.length(canon) - F.length(domain_end)), n), domain_end)
    local = F.length(F.substring_index(canon, "@", 1))
    head = F.concat(F.substr(canon, F.lit(1), F.lit(1)), F.substr(plain, F.lit(2), F.length(canon) - 2))
    check = F.when(_luhn(canon) % 10 == 0, ((10 - _luhn(F.concat(head, F.lit("0"))) % 10) % 10).cast("string")).otherwise(F.substr(plain, F.length(canon), F.lit(1)))
    card = F.concat(head, check)
    wide = attempt >= WIDE
    more = F.greatest(F.lit(0), attempt - WIDE + 1)

    # letters from numbers of their own
    own = _bytes(key, kind, F.concat(canon, F.lit("\x1fmore")), attempt)
    added = F.when(wide, F.array_join(F.transform(F.slice(own, 1, F.least(more, F.size(own))), lambda x: _pick("abcdefghijklmnopqrstuvwxyz", x)), "")).otherwise("")

    def octet(o: Column, i: Column) -> Column:
        a = F.get(n, i * 2) * 256 + F.get(n, i * 2 + 1)
        return (F.when(wide, a % 256).when(F.length(o) == 1, a % 9 + 1).when(F.length(o) == 2, a % 90 + 10).otherwise(a % 156 + 100)).cast("string")

    ip = F.array_join(F.transform(F.split(canon, r"\."), octet), ".")
    secret = F.array_join(F.transform(_chars(canon), lambda c, i: F.substr(F.lit("0123456789abcdef"), F.get(n, i) % 16 + 1, F.lit(1))), "")
    phone = F.concat(_country(canon), F.substr(plain, F.length(_country(canon)) + 1, F.length(canon)))
    email = F.concat(F.substr(email, F.lit(1), local), added, F.substr(email, local + 1, F.length(email)))
    iban = F.concat(F.substr(canon, F.lit(1), F.lit(2)), F.substr(plain, F.lit(3), F.length(canon)))
    return (F.when(kind == "email", email).when(kind == "card", card).when(kind == "ip", ip).when(kind == "secret", secret)
            .when(kind == "iban", iban).when(kind == "phone", phone).when(kind == "name", _name(canon, n, more)).otherwise(plain))


def _name(canon: Column, n: Column, more: Column) -> Column:
    """Title and new name words: as many syllables as the word's length suggests and ``more``, the gender's ending."""
    title = F.element_at(F.split(canon, r"\.? "), 1)
    female = title.isin(*FEMALE)
    rest = F.substr(canon, F.length(title) + 2, F.length(canon))
    script = F.when(rest.rlike(r"^\p{IsCyrillic}"), "cyrillic").when(rest.rlike(r"^\p{IsGreek}"), "greek").otherwise("latin")

    def word(w: Column, i: Column) -> Column:
        count = F.greatest(F.lit(2), F.floor(F.length(w) / 2).cast("int")) + more
        out = F.lit(None).cast("string")
        for name, syllables in SYLLABLES.items():
            table = F.array(*map(F.lit, syllables))
            built = F.array_join(F.transform(F.sequence(F.lit(1), count), lambda j: F.get(table, F.get(n, (i * 11 + j) % F.size(n)) % len(syllables))), "")
            male, fem = ENDINGS[name]
            out = F.when(script == name, F.concat(built, F.when(female, fem).otherwise(male))).otherwise(out)
        return F.concat(F.upper(F.substr(out, F.lit(1), F.lit(1))), F.substr(out, F.lit(2), F.length(out)))

    words = F.split(rest, "(?<=[ -])")  # separators stay with the word before them
    new = F.transform(words, lambda w, i: F.concat(word(w, i), F.regexp_extract(w, "([ -]?)$", 1)))
    return F.concat(title, F.lit(" "), F.array_join(new, ""))


def rendered(kind: Column, entity: Column, new: Column) -> Column:
    """The surrogate in the form of this mention: its separators and case."""
    def weave(pattern: str, new: Column = new) -> Column:
        """The entity's characters that match, replaced in order by the surrogate's."""
        chars = _chars(entity)
        place = F.transform(chars, lambda c, i: F.size(F.filter(F.slice(chars, 1, i + 1), lambda x: x.rlike(pattern))))
        return F.array_join(F.transform(chars, lambda c, i: F.when(c.rlike(pattern), F.substr(new, F.get(place, i), F.lit(1))).otherwise(c)), "")

    prefix = _country(entity)
    digits = F.concat(F.regexp_replace(prefix, r"\+", ""), F.regexp_replace(new, "^.*:", ""))
    phone = weave(r"\d", digits)
    cased = F.when(entity == F.upper(entity), F.upper(new)).otherwise(new)
    # letters that were added stand at the local part's end and have the case of its last one
    local, extra = F.length(F.substring_index(entity, "@", 1)), F.length(new) - F.length(entity)

    def like(i: Column) -> Column:
        return F.substr(entity, F.when(i < local, i + 1).when(i < local + extra, local).otherwise(i + 1 - extra), F.lit(1))

    email = F.array_join(F.transform(_chars(new), lambda c, i: F.when(like(i) != F.lower(like(i)), F.upper(c)).otherwise(c)), "")
    dotted = F.when(entity.rlike(r"^\p{L}+\. "), F.regexp_replace(new, "^([^ ]+) ", "$1. ")).otherwise(new)
    return (F.when(kind == "phone", phone).when(kind.isin("card", "ssn"), weave(r"\d")).when(kind == "iban", weave(r"[A-Z0-9]"))
            .when(kind == "secret", cased).when(kind == "email", email).when(kind == "name", dotted).otherwise(new))


def surrogate_table(entities: DataFrame, key: str) -> DataFrame:
    """(kind, entity, surrogate) of distinct entities, without clashes."""
    kind = kind_of(F.col("entity"))
    mentions = entities.select("entity", kind.alias("kind")).filter("kind is not null")
    mentions = scratch_table(mentions.withColumn("canon", canonical(F.col("kind"), F.col("entity"))), "mentions")
    forms = mentions.select("kind", "canon").distinct()
    real = mentions.select("kind", F.col("canon").alias("new")).distinct().withColumn("real", F.lit(True))
    table = scratch_table(forms.withColumn("attempt", F.lit(0)).withColumn("new", new_canonical(F.col("kind"), F.col("canon"), F.col("attempt"), key)), "surrogates")
    for _ in range(ATTEMPTS):
        # one that is settled goes before one that tries again
        first = F.row_number().over(Window.partitionBy("kind", "new").orderBy("attempt", "canon"))
        checked = table.join(real, ["kind", "new"], "left").withColumn("clash", (first > 1) | F.col("real").isNotNull())
        checked = scratch_table(checked.drop("real"), "checked")
        if checked.filter("clash").isEmpty():
            break
        again = checked.filter("clash").select("kind", "canon", (F.col("attempt") + 1).alias("attempt"))
        again = again.withColumn("new", new_canonical(F.col("kind"), F.col("canon"), F.col("attempt"), key))
        after = scratch_table(checked.filter("not clash").select("kind", "canon", "attempt", "new").unionByName(again), "surrogates")
        drop_scratch(checked, table)
        table = after
    else:
        raise ValueError(f"no distinct surrogates after {ATTEMPTS} attempts: a format has fewer values than the corpus has entities")
    named = mentions.join(table.select("kind", "canon", "new"), ["kind", "canon"])
    return named.select("kind", "entity", rendered(F.col("kind"), F.col("entity"), F.col("new")).alias("surrogate"))


def anonymised(docs: DataFrame, key: str, count: str = "n_entities") -> DataFrame:
    """``docs`` with the entities in ``text`` replaced, and their number as
    ``count`` (a column of that name gives way to it; all others stay)."""
    found = F.regexp_extract_all(F.col("text"), F.lit(ENTITY), F.lit(0))
    none = F.array().cast("array<string>")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("text").alias("_text"),
                       F.when(may_hold(F.col("text")), found).otherwise(none).alias("_found"))
    with_some = rows.filter(F.size("_found") > 0).withColumn("_key", F.sha2(F.col("_text").cast("binary"), 256))
    mentions = scratch_table(with_some.select("_key", F.explode(F.array_distinct("_found")).alias("entity")).distinct(), "entities")
    table = surrogate_table(mentions.select("entity").distinct(), key)
    by_text = mentions.join(table, "entity").groupBy("_key").agg(
        F.map_from_entries(F.collect_list(F.struct("entity", "surrogate"))).alias("_map"))
    gaps = F.split(F.col("_text"), ENTITY, -1)
    new = F.array_join(F.transform(gaps, lambda g, i: F.concat(g, F.coalesce(F.try_element_at(F.col("_map"), F.get(F.col("_found"), i)), F.get(F.col("_found"), i), F.lit("")))), "")
    replaced = with_some.join(by_text, "_key", "left").withColumn("_new", new).withColumn("_n", F.size("_found"))
    untouched = rows.filter(F.size(F.coalesce("_found", none)) <= 0).withColumn("_new", F.col("_text")).withColumn("_n", F.lit(0))
    columns = [F.col("_new").alias("text") if c == "text" else F.col("_row").getField(c).alias(c) for c in docs.columns if c != count]
    return reduce(DataFrame.unionByName, [x.select(*columns, F.col("_n").alias(count)) for x in (untouched, replaced)])
