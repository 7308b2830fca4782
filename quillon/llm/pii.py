"""Surrogates for personal data and secrets, keyed and consistent, as DataFrame expressions.

Entities are found by one pattern. Their replacements keep type and format:

* e-mail addresses, telephone and card numbers, identity numbers and secrets go through a keyed
  permutation of their letters and digits: four Feistel rounds in which each half shifts the
  other's characters within their own alphabet, a step to the next letter or digit, and the four
  rounds undone. A permutation never maps two entities to one, so distinctness holds without
  looking at the corpus, and as the step moves every character, none maps an entity to itself; case,
  separators, top-level domain, country code and a card's checksum are kept;
* IPv4 addresses are permuted in the same way as 32-bit numbers;
* names after a form of address become pronounceable names of the same gender and script; the
  form of address stays. A word always becomes the same word, so ``Mr Ada Byron`` and
  ``Mr Byron`` still refer to one person, and where the name's words stand alone elsewhere in the
  text, they are replaced by the same words. Here two words could meet, so the corpus's distinct
  words are checked, and all names get a syllable more until no two share a surrogate and none
  is a word that occurs.

Equal entities (without regard to case) get equal surrogates everywhere, under the same key.

Defined results: null text stays null; a text without entities is unchanged, an empty one too; null
keys and repeated rows are kept, equal texts stay equal; very long texts are searched whole; an empty
table gives no rows; other columns pass through, but none may begin with ``__q_``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import PRIVATE

#: Forms of address by script and gender.
ADDRESS = {
    ("latin", "f"): ("Mrs", "Ms", "Miss", "Madame", "Mme", "Frau", "Señora", "Sra", "Signora"),
    ("latin", "m"): ("Mr", "Monsieur", "Herr", "Señor", "Sr", "Signor"),
    ("cyrillic", "f"): ("г-жа", "госпожа"),
    ("cyrillic", "m"): ("г-н", "господин"),
    ("greek", "f"): ("κυρία",),
    ("greek", "m"): ("κύριος",),
}
#: Consonants and vowels that names are built from, and endings of given names, by script.
SOUNDS = {
    "latin": ("bdfglmnprstvz", "aeiou", {"f": "a", "m": "o"}),
    "cyrillic": ("бвгдзклмнпрст", "аеиоу", {"f": "а", "m": "ов"}),
    "greek": ("βγδζκλμνπρστφ", "αεηιο", {"f": "α", "m": "ος"}),
}
_OCTET = r"(?:25[0-5]|2[0-4]\d|[01]?\d?\d)"
_FORMS = "|".join(sorted((f for forms in ADDRESS.values() for f in forms), key=lambda f: (-len(f), f)))
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*\.[A-Za-z]{2,}(?![A-Za-z0-9-])",
    "secret": r"(?<!\w)(?:(?=[0-9a-f]*\d)[0-9a-f]{32,128}|(?=[0-9A-F]*\d)[0-9A-F]{32,128}|(?:AKIA|ASIA)[0-9A-Z]{16}|(?:ghp|gho|sk|pk|xox[bp])[_-][0-9A-Za-z_-]{16,})(?![\w-])",
    "ip": rf"(?<![\w.]){_OCTET}(?:\.{_OCTET}){{3}}(?![\w]|\.\d)",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "card": r"(?<![\w-])(?:\d{4}(?:[ -]\d{4}){3}|\d{13,19})(?![\w-])",
    "phone": r"(?<![\w+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\)|\d{3})[ .-]?\d{3}[ .-]\d{4}(?![\w-])|(?<![\w+])\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?![\w-])",
    "name": rf"(?<![\p{{L}}\p{{N}}])(?:{_FORMS})\.?[ \t]\p{{Lu}}\p{{L}}+(?:[ \t]\p{{Lu}}\p{{L}}+)?",
}
PATTERN = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: What every entity holds; texts without it are left alone at once.
HINT = rf"[@0-9]|(?<![\p{{L}}\p{{N}}])(?:{_FORMS})\.?[ \t]\p{{Lu}}|(?:AKIA|ASIA)[A-Z]{{16}}|(?:ghp|gho|sk|pk|xox[bp])[_-][0-9A-Za-z_-]{{16}}"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def _shift(half: Column, other: Column, turn: Column, sign: Column, key: str, kind: str, letters: str) -> Column:
    """Move each letter and digit of ``half`` within its alphabet, as ``other`` and the key say, on or back."""
    secret = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), turn.cast("string"), other), 256)

    def moved(ch: Column, by: Column, alphabet: str) -> Column:
        return F.substr(F.lit(alphabet), F.pmod(F.instr(F.lit(alphabet), ch) - 1 + by, F.lit(len(alphabet))).cast("int") + 1, F.lit(1))

    def one(ch: Column, h: Column, j: Column) -> Column:
        by = sign * F.pmod(F.xxhash64(h, j), F.lit(1 << 40))
        return F.when(ch.rlike("^[0-9]$"), moved(ch, by, "0123456789")).when(ch.rlike(f"^[{letters}]$"), moved(ch, by, letters)).otherwise(ch)

    return _let(secret, lambda h: F.array_join(F.transform(F.split(half, ""), lambda ch, j: one(ch, h, j)), ""))


#: Steps of a permutation: four rounds, the step that moves everything, the four rounds undone.
_STEPS, _MIDDLE = 9, 4


def _round(i: Column) -> tuple[Column, Column]:
    """The round of a step and its sign."""
    return F.when(i < _MIDDLE, i).otherwise(_STEPS - 1 - i), F.when(i < _MIDDLE, 1).otherwise(-1)


def permuted(part: Column, key: str, kind: str, letters: str = "abcdefghijklmnopqrstuvwxyz") -> Column:
    """A keyed permutation of strings of one format that leaves none where it was; upper case stays
    in its places."""
    low = F.lower(part)
    half = F.floor(F.length(low) / 2).cast("int")
    start = F.struct(F.substr(low, F.lit(1), half).alias("l"), F.substr(low, half + 1).alias("r"))
    after = lambda c: F.translate(c, "0123456789" + letters, "1234567890" + letters[1:] + letters[0])

    def turn(s: Column, i: Column) -> Column:
        n, sign = _round(i)
        even = F.struct(s["l"].alias("l"), _shift(s["r"], s["l"], n, sign, key, kind, letters).alias("r"))
        odd = F.struct(_shift(s["l"], s["r"], n, sign, key, kind, letters).alias("l"), s["r"].alias("r"))
        moved = F.struct(after(s["l"]).alias("l"), after(s["r"]).alias("r"))
        return F.when(i == _MIDDLE, moved).when(n % 2 == 0, even).otherwise(odd)

    end = F.aggregate(F.sequence(F.lit(0), F.lit(_STEPS - 1)), start, turn, lambda s: F.concat(s["l"], s["r"]))
    cased = F.zip_with(F.split(part, ""), F.split(end, ""), lambda a, b: F.when(a.rlike("^[A-Z]$"), F.upper(b)).otherwise(b))
    return F.array_join(cased, "")


def _check_digit(digits: Column) -> Column:
    """Luhn's digit for the digits before it."""
    values = F.transform(F.reverse(F.split(digits, "")), lambda d, i: _let(F.try_to_number(d, F.lit("9")).cast("int") * F.when(i % 2 == 0, 2).otherwise(1), lambda x: F.when(x > 9, x - 9).otherwise(x)))
    total = F.aggregate(values, F.lit(0), lambda a, v: a + v)
    return F.pmod(-total, F.lit(10))


def _card(entity: Column, key: str) -> Column:
    bare = F.regexp_replace(entity, "[^0-9]", "")
    n = F.length(bare)
    head, last = F.substr(bare, F.lit(1), n - 1), F.substr(bare, n).cast("int")

    def build(pair: Column) -> Column:
        digits = F.concat(pair["new"], F.pmod(_check_digit(pair["new"]) + pair["last"] - _check_digit(pair["head"]), F.lit(10)).cast("string"))
        # the separators are those of the entity: groups of four
        return F.when(entity.rlike("^[0-9]+$"), digits).otherwise(F.concat(F.substr(digits, F.lit(1), F.lit(4)), F.substr(entity, F.lit(5), F.lit(1)), F.substr(digits, F.lit(5), F.lit(4)), F.substr(entity, F.lit(10), F.lit(1)), F.substr(digits, F.lit(9), F.lit(4)), F.substr(entity, F.lit(15), F.lit(1)), F.substr(digits, F.lit(13))))

    return _let(F.struct(head.alias("head"), last.alias("last"), permuted(head, key, "card").alias("new")), build)


def _ip(entity: Column, key: str) -> Column:
    o = F.transform(F.split(entity, r"\."), lambda x: x.cast("int"))
    start = _let(o, lambda v: F.struct((v[0] * 256 + v[1]).cast("long").alias("l"), (v[2] * 256 + v[3]).cast("long").alias("r")))
    mix = lambda i, other: F.pmod(F.xxhash64(F.sha2(F.concat_ws("|", F.lit(key), F.lit("ip"), i.cast("string"), other.cast("string")), 256)), F.lit(65536))

    def turn(s: Column, i: Column) -> Column:
        n, _ = _round(i)  # a round undoes itself
        even = F.struct(s["l"].alias("l"), s["r"].bitwiseXOR(mix(n, s["l"])).alias("r"))
        odd = F.struct(s["l"].bitwiseXOR(mix(n, s["r"])).alias("l"), s["r"].alias("r"))
        moved = F.struct(s["l"].alias("l"), F.pmod(s["r"] + 1, F.lit(65536)).alias("r"))
        return F.when(i == _MIDDLE, moved).when(n % 2 == 0, even).otherwise(odd)

    octets = lambda s: F.concat_ws(".", *[F.floor(x / 256).cast("int").cast("string") if high else F.pmod(x, F.lit(256)).cast("int").cast("string") for x in (s["l"], s["r"]) for high in (True, False)])
    return F.aggregate(F.sequence(F.lit(0), F.lit(_STEPS - 1)), start, turn, octets)


def _name_word(word: Column, role: Column, gender: Column, script: Column, key: str, syllables: int) -> Column:
    """A name for a name: ``syllables`` consonant-vowel pairs; a given name ends by its gender."""
    secret = F.sha2(F.concat_ws("|", F.lit(key), F.lit("name"), role, F.when(role == "given", gender).otherwise(""), script, F.lower(word)), 256)

    def built(h: Column, consonants: str, vowels: str, ends: dict[str, str]) -> Column:
        pick = lambda s, j: F.substr(F.lit(s), F.pmod(F.xxhash64(h, j), F.lit(len(s))).cast("int") + 1, F.lit(1))
        body = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(syllables - 1)), lambda j: F.concat(pick(consonants, 2 * j), pick(vowels, 2 * j + 1))), "")
        end = F.when((role == "given") & (gender == "f"), ends["f"]).when(role == "given", ends["m"]).otherwise(pick(consonants, F.lit(2 * syllables)))
        return F.initcap(F.concat(body, end))

    def chosen(h: Column) -> Column:
        out = None
        for s, (c, v, e) in SOUNDS.items():
            out = F.when(script == s, built(h, c, v, e)) if out is None else out.when(script == s, built(h, c, v, e))
        return out

    return _let(secret, chosen)


def _words(entity: Column) -> Column:
    """A name's words with role, gender and script."""
    parts = F.split(entity, r"[ \t]")
    form = F.regexp_replace(parts[0], r"\.$", "")
    has = lambda k: form.isin(*ADDRESS[k])
    gender = F.when(has(("latin", "f")) | has(("cyrillic", "f")) | has(("greek", "f")), "f").otherwise("m")
    script = lambda w: F.when(w.rlike(r"\p{IsCyrillic}"), "cyrillic").when(w.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")
    role = lambda i: F.when((F.size(parts) == 3) & (i == 0), "given").otherwise("family")
    return F.transform(F.slice(parts, F.lit(2), F.size(parts) - 1), lambda w, i: F.struct(w.alias("word"), role(i).alias("role"), gender.alias("gender"), script(w).alias("script")))


def named_words(found: Column) -> Column:
    """The words, with role, gender and script, of all names among a text's entities."""
    return F.flatten(F.transform(F.filter(found, lambda e: e.rlike(f"^(?:{PATTERNS['name']})$")), _words))


def _alone(entity: Column, known: Column, key: str, syllables: int) -> Column:
    """The surrogate of a name's word that stands alone: as in the name it was first seen in."""
    first = F.element_at(F.filter(known, lambda w: w["word"] == entity), 1)
    return _let(first, lambda w: _name_word(w["word"], w["role"], w["gender"], w["script"], key, syllables))


def _name(entity: Column, key: str, syllables: int) -> Column:
    named = F.transform(_words(entity), lambda w: _name_word(w["word"], w["role"], w["gender"], w["script"], key, syllables))
    return F.concat(F.regexp_extract(entity, r"^[^ \t]+[ \t]", 0), F.array_join(named, " "))


def kind(entity: Column) -> Column:
    """The type of an entity that :data:`PATTERN` found: the first whose own pattern it fits; null
    for a word of a name that stands alone."""
    out = None
    for name, p in PATTERNS.items():
        fits = entity.rlike(f"^(?:{p})$")
        out = F.when(fits, name) if out is None else out.when(fits, name)
    return out


def surrogate(entity: Column, known: Column, key: str, syllables: int) -> Column:
    """The replacement of an entity of a text whose names have the words ``known``."""
    dot = F.regexp_extract(entity, r"^(.*)(\.[^.]*)$", 1)
    country = F.regexp_extract(entity, r"^(\+\d{1,3})?", 0)
    email = F.concat(permuted(dot, key, "email"), F.regexp_extract(entity, r"(\.[^.]*)$", 1))
    phone = F.concat(country, permuted(F.substr(entity, F.length(country) + 1), key, "phone"))
    prefix = F.regexp_extract(entity, r"^(?:AKIA|ASIA|(?:ghp|gho|sk|pk|xox[bp])[_-])?", 0)
    rest = F.substr(entity, F.length(prefix) + 1)
    secret = F.when(F.length(prefix) > 0, F.concat(prefix, permuted(rest, key, "secret"))).otherwise(permuted(rest, key, "hex", "abcdef"))
    by = lambda k: F.when(k == "email", email).when(k == "secret", secret).when(k == "ip", _ip(entity, key)).when(k == "ssn", permuted(entity, key, "ssn")).when(k == "card", _card(entity, key)).when(k == "phone", phone).when(k == "name", _name(entity, key, syllables)).otherwise(_alone(entity, known, key, syllables))
    return _let(kind(entity), by)


def _meetings(words: DataFrame, key: str, syllables: int) -> DataFrame:
    """Surrogates that two words share, or that are words of the corpus themselves."""
    made = words.select(_name_word(F.col("word"), F.col("role"), F.col("gender"), F.col("script"), key, syllables).alias("s"), F.lit(1).alias("n"), F.lit(0).alias("own"))
    own = words.select(F.initcap("word").alias("s"), F.lit(0).alias("n"), F.lit(1).alias("own"))
    return made.unionByName(own).groupBy("s").agg(F.sum("n").alias("n"), F.max("own").alias("own")).filter("n > 1 or (n = 1 and own = 1)")


def syllables_needed(docs: DataFrame, key: str, text: str = "text", start: int = 3) -> int:
    """The least number of syllables with which the corpus's name words keep apart."""
    found = docs.filter(F.col(text).rlike(PATTERNS["name"])).select(F.explode(F.regexp_extract_all(F.col(text), F.lit(PATTERNS["name"]), F.lit(0))).alias("e"))
    each = found.select(F.explode(_words(F.col("e"))).alias("w")).select(F.lower("w.word").alias("word"), "w.role", F.when(F.col("w.role") == "given", F.col("w.gender")).otherwise("").alias("gender"), "w.script").distinct()
    each = each.cache()
    try:
        n = start
        while not (each.isEmpty() or _meetings(each, key, n).isEmpty()):
            n += 1
        return n
    finally:
        each.unpersist()


def replace(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``docs`` with every entity in ``text`` replaced, and ``__q_kinds``, the replaced entities'
    types in order (null text: null)."""
    if clash := [c for c in docs.columns if c.startswith(PRIVATE)]:
        raise ValueError(f"columns may not begin with {PRIVATE}: {', '.join(clash)}")
    n = syllables_needed(docs, key, text)
    t = F.col(f"`{text}`")
    has = F.coalesce(t.rlike(HINT), F.lit(False))
    none = F.expr("cast(array() as array<string>)")
    found = docs.withColumn("__q_found", F.when(has, F.regexp_extract_all(t, F.lit(PATTERN), F.lit(0))).otherwise(none))
    # words of names are looked for alone too: longer ones first, after everything else
    known = found.withColumn("__q_known", named_words(F.col("__q_found")))
    words = F.array_sort(F.array_distinct(F.transform("__q_known", lambda w: w["word"])), lambda a, b: F.length(b) - F.length(a))
    also = F.concat(F.lit(PATTERN + r"|(?<![\p{L}\p{N}])(?:"), F.array_join(words, "|"), F.lit(r")(?![\p{L}\p{N}])"))
    known = known.withColumn("__q_pattern", F.when(F.size("__q_known") > 0, also).otherwise(F.lit(PATTERN)))
    some = F.size("__q_found") > 0
    again = known.withColumn("__q_all", F.when(F.size("__q_known") > 0, F.regexp_extract_all(t, F.col("__q_pattern"), F.lit(0))).otherwise(F.col("__q_found")))
    made = again.withColumn("__q_made", F.when(some, F.transform("__q_all", lambda e: surrogate(e, F.col("__q_known"), key, n))))
    pieces = F.split(t, F.col("__q_pattern"), -1)
    joined = F.array_join(F.zip_with(pieces, F.col("__q_made"), lambda p, s: F.concat(p, F.coalesce(s, F.lit("")))), "")
    kinds = F.transform("__q_all", lambda e: F.coalesce(kind(e), F.lit("name")))
    out = made.withColumn("__q_text", F.when(some, joined).otherwise(t)).withColumn("__q_kinds", F.when(t.isNotNull(), kinds))
    return out.select(*[F.col("__q_text").alias(text) if c == text else F.col(f"`{c}`") for c in docs.columns], "__q_kinds")
