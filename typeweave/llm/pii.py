"""Surrogates for personal data, with DataFrame functions only.

A text is split at its entities; each is replaced by a surrogate of its own type
and format, derived from a secret key and the entity's canonical form, and the
pieces are joined again.  So equal entities get equal surrogates wherever they
are (coreference), and no text is shuffled.  Distinctness is checked over
the whole corpus: the distinct entities (not the texts) are grouped by their
surrogates, and an entity whose surrogate is taken, or is itself an entity of
the corpus, is derived again with a higher attempt number.  Surrogates of short
forms grow with that number, so there is always a free one.  A name that occurs
with titles of one gender and with neutral ones is one person's, and has one
surrogate.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from typeweave.llm.common import free_name
from typeweave.operators.fixpoint import written

# The titles that introduce a name, by gender; and the syllables of surrogate names by script.
MALE = ["Mr", "Herr", "Herrn", "Monsieur", "Señor", "Sr", "господин", "κύριος"]
FEMALE = ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mademoiselle", "Mlle", "Señora", "Sra", "Señorita", "Srta", "госпожа", "κυρία"]
NEUTRAL = ["Dr", "Prof", "Mx"]
SYLLABLES = {
    "latin": ["ba", "be", "bo", "da", "de", "do", "fa", "fe", "ga", "ka", "ke", "ko", "la", "le", "lo", "ma", "me", "mo", "na", "ne", "no", "ra", "re", "ro", "sa", "se", "so", "ta", "te", "to", "va", "ve"],
    "cyrillic": ["ба", "бе", "бо", "ва", "ве", "во", "га", "го", "да", "де", "до", "за", "ка", "ко", "ла", "ле", "ло", "ма", "ми", "мо", "на", "не", "но", "ра", "ре", "ро", "са", "со", "та", "те", "то", "фа"],
    "greek": ["βα", "βε", "γα", "γο", "δα", "δε", "δο", "ζα", "θα", "θε", "κα", "κο", "λα", "λε", "λο", "μα", "με", "μο", "να", "νε", "νο", "πα", "πε", "πο", "ρα", "ρε", "ρο", "σα", "σε", "τα", "το", "φα"],
}
ALPHABETS = {"latin": "abcdefghijklmnopqrstuvwxyz", "cyrillic": "абвгдежзийклмнопрстуфхцчшщъыьэюя", "greek": "αβγδεζηθικλμνξοπρστυφχψω"}
GIVEN_ENDINGS = {"latin": ("n", "na", "l"), "cyrillic": ("н", "на", "ль"), "greek": ("ς", "α", "ι")}

_TITLES = "|".join(MALE + FEMALE + NEUTRAL)
_WORD, _NEXT = r"\p{Lu}[\p{L}'’-]*+", r" (?:\p{Lu}[\p{Ll}'’-]++|\p{Lu}{3,}+(?![\p{L}-]))"
_MAIL = r"\p{L}\p{N}._%+-"
_ASSIGNED = r"(?i:password|passwd|pwd|token|secret|api[_-]?key)[\x20\t]{0,3}[=:][\x20\t]{0,3}[\"']?"
#: In order of precedence.
PATTERNS = [
    rf"(?<![\p{{L}}\p{{N}}]){_ASSIGNED}[A-Za-z0-9_+/=.~-]{{6,}}+",
    rf"(?<![{_MAIL}])[{_MAIL}]++@[\p{{L}}\p{{N}}-]++(?:\.[\p{{L}}\p{{N}}-]++)+",
    r"(?<![A-Za-z0-9])(?:(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}+|sk-[A-Za-z0-9-]{20,}+|(?=[a-f]*+[0-9])[0-9a-f]{20,}+|(?=[0-9]*+[a-f])(?=[a-f]*+[0-9])[0-9a-f]{16,}+)(?![A-Za-z0-9])",
    r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?!\.?[0-9])",
    r"(?<![0-9A-Za-z])[0-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z])",
    r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    r"(?<![0-9A-Za-z])\+[0-9]{1,3}(?:[ .-]?\(?[0-9]{2,4}\)?){2,5}(?![0-9A-Za-z])",
    r"(?<![0-9A-Za-z])\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z])",
    r"(?<![0-9A-Za-z-])[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z-])",
    rf"(?<![\p{{L}}\p{{N}}])(?:{_TITLES})\.? {_WORD}(?:{_NEXT}){{0,2}}",
]
ENTITY = "|".join(PATTERNS)
#: Calling codes: of one digit, of two, and all others of three.
_CALLING = r"[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3}"
#: What each pattern that a text without digits can match needs, besides '@', ':', '=' and titles.
_KEY_HEADS = ["AKIA", "ASIA", "sk-", "ghp_", "gho_", "ghu_", "ghs_", "ghr_"]
#: Entities with a later attempt or another gender than their form's are looked up in a literal map up to this number, and by a join beyond it, with equal results.
MAP_LIMIT = 1000
#: Attempts after which short forms grow, and any form.
SHORT, LONG = 1, 12


def kind_of(x: Column) -> Column:
    return (
        F.when(x.rlike("^" + _ASSIGNED), "key")
        .when(x.contains("@"), "email")
        .when(x.rlike(r"^(?:AKIA|ASIA|gh[pousr]_|sk-)|^(?=[0-9]*[a-f])[0-9a-f]{16,}$|^[0-9]{20,}$"), "key")
        .when(x.rlike("^[A-Z]{2}[0-9]{2}"), "iban")
        .when(x.rlike(r"^(?:[0-9]{1,3}\.){3}[0-9]{1,3}$"), "ip")
        .when(x.rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), "ssn")
        .when(x.rlike("^[0-9](?:[ -]?[0-9]){12,18}$"), "card")
        .when(x.rlike(r"^[+(0-9]"), "phone")
        .otherwise("name")
    )


def _named(x: Column) -> tuple[Column, Column]:
    """Title and name of an entity of kind name."""
    return F.regexp_extract(x, rf"^(?:{_TITLES})\.? ", 0), F.regexp_replace(x, rf"^(?:{_TITLES})\.? ", "")


def canonical(kind: Column, x: Column) -> Column:
    """What equal entities have in common, whatever their format."""
    return (
        F.when(kind.isin("ssn", "card"), F.regexp_replace(x, "[^0-9]", ""))
        .when(kind == "phone", F.regexp_replace(x, "[^0-9+]", ""))
        .when(kind == "iban", F.regexp_replace(x, " ", ""))
        .when(kind == "email", F.lower(x))
        .when(kind == "key", F.regexp_replace(x, "^" + _ASSIGNED, ""))
        .when(kind == "name", _named(x)[1])
        .otherwise(x)
    )


def variant(kind: Column, x: Column) -> Column:
    """What of an entity's form, besides its canonical form, changes the canonical form of its surrogate."""
    return F.when(kind == "name", _gender(_named(x)[0])).otherwise("")


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _stream(key: str, *parts: Column) -> Column:
    """128 hexadecimal digits that depend on the key and the parts."""
    whole = F.concat_ws("|", F.lit(key), *[p.cast("string") for p in parts])
    return F.concat(F.sha2(whole, 256), F.sha2(F.concat(whole, F.lit("|2")), 256))


def _byte(stream: Column, i: Column) -> Column:
    return F.conv(F.substring(stream, ((i - 1) % 64) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _letter(c: Column, b: Column) -> Column:
    """A letter of c's script and case; letters of scripts without an alphabet here move among their sixteen neighbours."""
    low = F.lower(c)
    plain = F.when(c.rlike(r"\p{IsLatin}"), F.regexp_replace(low, "[^a-z]", "e")).otherwise(low)

    def in_alphabet(script: str) -> Column:
        letters = F.lit(ALPHABETS[script])
        return F.substring(letters, F.pmod(F.position(plain, letters) + b, F.lit(len(ALPHABETS[script]))) + 1, F.lit(1))

    code = F.conv(F.hex(F.encode(c, "UTF-16BE")), 16, 10).cast("int")
    beside = F.decode(F.unhex(F.lpad(F.hex((code - code % 16 + (code + b) % 16).cast("long")), 4, "0")), "UTF-16BE")
    made = F.when(c.rlike(r"\p{IsLatin}"), in_alphabet("latin")).when(c.rlike(r"\p{IsCyrillic}"), in_alphabet("cyrillic")).when(c.rlike(r"\p{IsGreek}"), in_alphabet("greek"))
    made = made.when(code < 0xD800, beside).otherwise(F.lit("x"))
    return F.when(c.rlike(r"\p{Lu}"), F.upper(made)).otherwise(made)


def _chars(x: Column, stream: Column, *, spaced: bool = False) -> Column:
    """Letters and digits replaced by ones of their class, at their place (if spaced, spaces don't count); everything else stays."""

    def one(s: Column, i: Column) -> Column:
        nth = F.greatest(F.length(F.regexp_replace(F.substring(x, F.lit(1), i), " ", "")), F.lit(1)) if spaced else i
        c, b = F.substring(x, i, F.lit(1)), _byte(s, nth)
        plain = F.when(c.rlike("[0-9]"), F.char(48 + (F.ascii(c) - 48 + b) % 10)).when(c.rlike("[A-Z]"), F.char(65 + (F.ascii(c) - 65 + b) % 26)).when(c.rlike("[a-z]"), F.char(97 + (F.ascii(c) - 97 + b) % 26))
        return plain.when(c.rlike(r"\p{L}"), _letter(c, b)).otherwise(c)

    return F.when(F.length(x) < 1, x).otherwise(_let(stream, lambda s: F.array_join(F.transform(F.sequence(F.lit(1), F.length(x)), lambda i: one(s, i)), "")))


def _digits(x: Column, stream: Column, keep: Column) -> Column:
    """The digits of x replaced after the first `keep`, by their number among the digits; punctuation stays."""

    def one(s: Column, i: Column) -> Column:
        c, nth = F.substring(x, i, F.lit(1)), F.length(F.regexp_replace(F.substring(x, F.lit(1), i), "[^0-9]", ""))
        return F.when(c.rlike("[0-9]") & (nth > keep), F.char(48 + (F.ascii(c) - 48 + _byte(s, nth)) % 10)).otherwise(c)

    return _let(stream, lambda s: F.array_join(F.transform(F.sequence(F.lit(1), F.length(x)), lambda i: one(s, i)), ""))


def _luhn(digits: Column, skip_last: bool) -> Column:
    """The Luhn sum modulo 10; without the last digit if skip_last."""
    back = F.reverse(F.split(digits, ""))
    sums = F.transform(back, lambda d, i: _doubled(d.cast("int"), i))
    return F.aggregate(F.slice(sums, 2, 40) if skip_last else sums, F.lit(0), lambda a, v: a + v) % 10


def _doubled(d: Column, i: Column) -> Column:
    twice = d * 2
    return F.when(i % 2 == 0, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))


def _card(x: Column, stream: Column) -> Column:
    """As many digits; a valid check digit if the entity has one."""

    def fixed(y: Column) -> Column:
        check = (10 - _luhn(F.regexp_replace(y, "[^0-9]", ""), True)) % 10
        valid = _luhn(F.regexp_replace(x, "[^0-9]", ""), False) == 0
        return F.when(valid, F.concat(F.substring(y, F.lit(1), F.length(y) - 1), check.cast("string"))).otherwise(y)

    return _let(_digits(x, stream, F.lit(0)), fixed)


def _mod97(x: Column) -> Column:
    def step(a: Column, c: Column) -> Column:
        return F.when(c.rlike("[0-9]"), (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(F.filter(F.split(x, ""), lambda c: c != ""), F.lit(0), step)


def _iban(x: Column, stream: Column) -> Column:
    """Country and grouping stay; the check digits fit the new account."""

    def fixed(y: Column) -> Column:
        plain = F.regexp_replace(y, " ", "")
        check = F.lpad((98 - _mod97(F.concat(F.substring(plain, 5, 40), F.substring(plain, 1, 2), F.lit("00")))).cast("string"), 2, "0")
        return F.concat(F.substring(y, 1, 2), check, F.substring(y, 5, 60))

    return _let(F.concat(F.substring(x, 1, 4), _chars(F.substring(x, 5, 60), stream, spaced=True)), fixed)


def _script(word: Column) -> Column:
    return F.when(word.rlike(r"\p{IsCyrillic}"), "cyrillic").when(word.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")


def _name_word(key: str, word: Column, role: Column, attempt: Column) -> Column:
    """A name of three syllables or more in the word's script; given names end by gender; initials stay initials, while they are enough."""

    def made_of(s: Column, script: str) -> Column:
        parts = F.array(*map(F.lit, SYLLABLES[script]))
        male, female, neutral = GIVEN_ENDINGS[script]
        body = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(3) + F.least(attempt, F.lit(5))), lambda i: F.element_at(parts, _byte(s, i) % 32 + 1)), "")
        ending = F.when(role == "male", male).when(role == "female", female).when(role == "neutral", neutral).otherwise("")
        return F.initcap(F.concat(body, ending))

    def by_script(s: Column) -> Column:
        return F.coalesce(*[F.when(_script(word) == script, made_of(s, script)) for script in SYLLABLES])

    def initial(s: Column) -> Column:
        letters = F.coalesce(*[F.when(_script(word) == script, F.lit(ALPHABETS[script])) for script in ALPHABETS])
        return F.upper(F.substring(letters, _byte(s, F.lit(9)) % F.length(letters) + 1, F.lit(1)))

    def made(s: Column) -> Column:
        short = (F.length(word) == 1) & (attempt <= SHORT)
        return F.when(short, initial(s)).otherwise(_let(by_script(s), lambda n: F.when((F.upper(word) == word) & (F.length(word) > 1), F.upper(n)).otherwise(n)))

    return _let(_stream(key, F.lit("name"), role, F.lower(word), attempt), made)


def surrogate(key: str, kind: Column, x: Column, attempt: Column) -> Column:
    """The replacement of entity x: same type and format, the same for equal canonical forms."""
    return _let(canonical(kind, x), lambda c: _let(_stream(key, kind, c, attempt), lambda s: _surrogate(key, kind, x, c, s, attempt)))


def _surrogate(key: str, kind: Column, x: Column, canon: Column, s: Column, attempt: Column) -> Column:
    user, domain = F.substring_index(x, "@", 1), F.lower(F.substring_index(x, "@", -1))
    labels = F.substring(domain, F.lit(1), F.length(domain) - F.length(F.substring_index(domain, ".", -1)) - 1)
    longer = F.when((attempt > SHORT) & (F.length(user) < 6), F.translate(F.substring(s, F.lit(40), F.least(attempt, F.lit(40))), "0123456789", "ghijklmnop")).otherwise("")
    email = F.concat(_chars(user, s), longer, F.lit("@"), _chars(labels, _stream(key, F.lit("domain"), domain)), F.lit(".example"))
    ip = F.array_join(F.transform(F.array(*map(F.lit, range(1, 5))), lambda i: (_byte(s, i) % 254 + 1).cast("string")), ".")
    head = F.regexp_extract(x, rf"^(?:{_ASSIGNED})?(?:AKIA|ASIA|sk-|gh[pousr]_)?", 0)
    hexed = lambda v: F.substring(F.repeat(s, 8), F.lit(1), F.length(v))
    opaque = lambda v: F.when(v.rlike("^[0-9a-f]{1,1024}$"), hexed(v)).otherwise(_chars(v, s))
    hidden = _let(head, lambda h: F.concat(h, _let(F.substring(x, F.length(h) + 1, F.length(x)), opaque)))
    by_role = lambda words, own: F.transform(words, lambda w, i: _name_word(key, w, F.when(i == F.size(words) - 1, F.lit("family")).otherwise(own), attempt))
    named = lambda title: F.concat(title, F.array_join(_let(F.struct(F.split(canon, " ").alias("words"), _gender(title).alias("own")), lambda n: by_role(n["words"], n["own"])), " "))
    country = F.greatest(F.length(F.regexp_extract(canon, rf"^\+(?:{_CALLING})", 0)) - 1, F.lit(0))
    made = (
        F.when(kind == "key", hidden)
        .when(kind == "email", email)
        .when(kind == "iban", _iban(x, s))
        .when(kind == "ip", ip)
        .when(kind == "card", _card(x, s))
        .when(kind == "ssn", _digits(x, s, F.lit(0)))
        .when(kind == "phone", _digits(x, s, country))
        .otherwise(_let(F.substring(x, F.lit(1), F.length(x) - F.length(canon)), named))
    )
    more = F.translate(F.substring(s, F.lit(80), attempt - LONG), "abcdef", "012345")
    return F.when(attempt > LONG, F.concat(made, more)).otherwise(made)


def _gender(title: Column) -> Column:
    bare = F.regexp_replace(title, r"\.? $", "")
    return F.when(bare.isin(*MALE), "male").when(bare.isin(*FEMALE), "female").otherwise("neutral")


def _genders(found: DataFrame) -> DataFrame:
    """found with `gender`, which is not null for names with neutral titles that also have titles of one gender; their sample gets such a title."""
    has = lambda v: F.max(F.col("variant") == v)
    titles = found.where("kind = 'name'").groupBy("kind", "canon").agg(has("male").alias("male"), has("female").alias("female"))
    one = titles.where("male <> female").select("kind", "canon", F.when(F.col("male"), "male").otherwise("female").alias("only"))
    both = found.join(one, ["kind", "canon"], "left").withColumn("gender", F.when(F.col("variant") == "neutral", F.col("only"))).drop("only")
    return both.withColumn("sample", F.when(F.col("gender").isNull(), F.col("sample")).otherwise(_titled(F.col("gender"), F.col("canon"))))


def _titled(gender: Column, name: Column) -> Column:
    return F.concat(F.when(gender == "male", MALE[0]).otherwise(FEMALE[0]), F.lit(" "), name)


def _replaced(key: str, x: Column, kind: Column, attempt: Column, gender: Column) -> Column:
    """The surrogate of x; a name whose gender is given stays behind its own title."""

    def with_title(name: Column) -> Column:
        made = surrogate(key, kind, F.when(gender.isNull(), x).otherwise(_titled(gender, name)), attempt)
        return _let(made, lambda y: F.when(gender.isNull(), y).otherwise(F.concat(F.substring(x, F.lit(1), F.length(x) - F.length(name)), _named(y)[1])))

    return _let(canonical(kind, x), with_title)


def entities(text: Column) -> Column:
    """The entities of a text in their order; most texts without any fail a cheaper condition, which every match implies."""
    maybe = reduce(lambda a, t: a | text.contains(t), MALE + FEMALE + NEUTRAL + _KEY_HEADS, text.rlike("[0-9@=:]"))
    return F.when(maybe, F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0)))


def attempts(found: DataFrame, key: str) -> DataFrame:
    """(kind, canon, variant, attempt, gender) for the entities of (kind, canon, variant, sample) that need an attempt above 0, or another gender than their title's.

    sample is one form of the entity; each variant has a row of its own.  In each round, of the entities
    with the same surrogate the first keeps it, unless an earlier round gave it
    away or an entity of the corpus has that form.  An entity keeps its attempt
    if it keeps the surrogates of all its variants; the others try again.  Surrogates grow with
    attempts, so every entity finds one.
    """
    if "variant" not in found.columns:
        found = found.withColumn("variant", F.lit(""))
    every = written(_genders(found), "entities")
    real = every.select("kind", F.col("canon").alias("made"), F.lit(True).alias("is_real")).distinct()
    pending, kept, moved = every.withColumn("attempt", F.lit(0)), None, None
    own = _let(surrogate(key, F.col("kind"), F.col("sample"), F.col("attempt")), lambda y: canonical(F.col("kind"), y))
    while True:
        made = pending.withColumn("made", own).join(real, ["kind", "made"], "left")
        if kept is not None:
            made = made.join(kept.withColumn("is_given", F.lit(True)), ["kind", "made"], "left")
        else:
            made = made.withColumn("is_given", F.lit(None).cast("boolean"))
        place = F.rank().over(Window.partitionBy("kind", "made").orderBy("canon"))  # variants of one entity may share a surrogate
        made = made.withColumn("ok", (place == 1) & F.col("is_real").isNull() & F.col("is_given").isNull())
        made = written(made.withColumn("ok", F.min("ok").over(Window.partitionBy("kind", "canon"))), "attempts")
        good = made.where("ok")
        late = good.where("attempt > 0 or gender is not null").select("kind", "canon", "variant", "attempt", "gender")
        moved = late if moved is None else moved.unionByName(late)
        given = good.select("kind", "made").distinct()
        pending = made.where("not ok").select(*every.columns, (F.col("attempt") + 1).alias("attempt"))
        if pending.isEmpty():
            return moved
        kept = written(given if kept is None else kept.unionByName(given), "given")


def replace_entities(docs: DataFrame, *, key: str, text: str = "text", map_limit: int = MAP_LIMIT) -> DataFrame:
    """docs with the personal data of its text column replaced; other columns and rows stay.

    Null and empty texts stay; texts without entities stay byte for byte.
    Repeated rows are replaced alike.  A table without rows, or without entities, stays as it is.
    """
    hits = entities(F.col(text))
    one = docs.select(F.explode(hits).alias("x")).select(kind_of(F.col("x")).alias("kind"), "x")
    found = one.select("kind", canonical(F.col("kind"), F.col("x")).alias("canon"), variant(F.col("kind"), F.col("x")).alias("variant"), "x").groupBy("kind", "canon", "variant").agg(F.min("x").alias("sample"))
    moved = written(attempts(found, key), "moved")
    if moved.limit(map_limit + 1).count() > map_limit:
        return _replaced_by_join(docs, moved, key, text)
    again = [(F.lit(f"{r.kind}|{r.variant}|{r.canon}"), F.struct(F.lit(r.attempt).alias("attempt"), F.lit(r.gender).cast("string").alias("gender"))) for r in moved.toLocalIterator()]
    table = F.create_map(*[c for pair in again for c in pair]) if again else None
    own = free_name("hits", docs.columns)

    def swapped(x: Column) -> Column:
        if not again:
            return _let(kind_of(x), lambda k: surrogate(key, k, x, F.lit(0)))
        entry = lambda k: F.element_at(table, F.concat_ws("|", k, variant(k, x), canonical(k, x)))
        return _let(kind_of(x), lambda k: _let(entry(k), lambda e: _replaced(key, x, k, F.coalesce(e["attempt"], F.lit(0)), e["gender"])))

    return docs.withColumn(own, hits).withColumn(text, _joined(F.col(text), F.col(own), F.transform(own, swapped))).select(docs.columns)


def _joined(text: Column, hits: Column, swapped: Column) -> Column:
    pieces = F.split(text, ENTITY, -1)
    return F.when(F.size(hits) > 0, F.array_join(F.zip_with(pieces, swapped, lambda p, s: F.concat(p, F.coalesce(s, F.lit("")))), "")).otherwise(text)


def _replaced_by_join(docs: DataFrame, moved: DataFrame, key: str, text: str) -> DataFrame:
    """For crowded formats, where many entities need another attempt: attempts come by a join instead of a map."""
    own, other, tries = (free_name(n, docs.columns) for n in ("row_id", "row_of", "tries"))
    kept = written(docs.withColumn(own, F.monotonically_increasing_id()), "texts")
    hit = kept.select(F.col(own).alias("row"), F.posexplode(entities(F.col(text))).alias("pos", "x")).withColumn("kind", kind_of(F.col("x")))
    hit = hit.select("row", "pos", "kind", canonical(F.col("kind"), F.col("x")).alias("canon"), variant(F.col("kind"), F.col("x")).alias("variant")).join(moved, ["kind", "canon", "variant"])
    found = hit.groupBy(F.col("row").alias(other)).agg(F.map_from_entries(F.collect_list(F.struct("pos", F.struct("attempt", "gender")))).alias(tries))
    both = kept.join(found, F.col(own) == F.col(other), "left")
    hits = entities(F.col(text))

    def swapped(x: Column, i: Column) -> Column:
        return _let(F.struct(kind_of(x).alias("kind"), F.element_at(F.col(tries), i).alias("e")), lambda v: _replaced(key, x, v["kind"], F.coalesce(v["e"]["attempt"], F.lit(0)), v["e"]["gender"]))

    return both.withColumn(text, _joined(F.col(text), hits, F.transform(hits, swapped))).select(docs.columns)
