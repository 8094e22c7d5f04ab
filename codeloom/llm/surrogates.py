"""Surrogates for personal data, in DataFrame functions only.

Entities found in texts are replaced by keyed surrogates of the same kind and
format: a digit stands for a digit, separators stay, card numbers keep their
check-sum property, account numbers get valid check digits, addresses keep
their shape and top domain, names keep script, case, gender and number of
words. One entity has one surrogate in all documents; different entities of a
kind never share one, and no surrogate is itself an entity of the corpus.

A name is replaced word by word, so that a person keeps one surrogate under
any title, with or without the first name, and where the name stands without a
title in a document that also has it with one. A name word has the gender of
its titles over all documents: of both kinds of titles, or of titles that say
nothing, it is neutral.

The first surrogate of an entity follows from the key and the document alone,
so rows need no look-up; only entities that collided, and name words whose
gender differs between documents, carry an exception.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm.common import checkpointed, meet, table, text_or_empty, tidy

KEY = "codeloom"
#: Rounds of new tries for colliding entities before the space of a kind counts as exhausted.
ROUNDS = 40

#: Titles that announce a name, by gender.
MALE = ("Mr", "Herr", "Monsieur", "Señor", "Sr", "Господин", "г-н", "Κύριος")
FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mlle", "Señora", "Señorita", "Sra", "Госпожа", "г-жа", "Κυρία")
NEUTRAL = ("Dr", "Prof")

#: Exceptions that travel inside the plan as a map; more are joined to the documents that hold them.
PLAN_EXCEPTIONS = 500

_TITLES = "|".join(sorted((*MALE, *FEMALE, *NEUTRAL), key=len, reverse=True))
_HEX = "[0-9A-Fa-f]{1,4}"
_NAME_WORD = r"\p{Lu}[\p{L}'’-]+"
_PATTERNS = (
    r"[\p{L}\p{N}._%+-]+@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)+",
    r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])",
    rf"(?<![0-9A-Za-z:.])(?=[0-9A-Fa-f:]*[0-9])(?:(?:{_HEX}:){{7}}{_HEX}|(?:{_HEX}(?::{_HEX}){{0,5}})?::(?:{_HEX}(?::{_HEX}){{0,5}})?)(?![0-9A-Za-z:])",
    r"(?<![0-9.])(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})(?:\.(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})){3}(?!\.?[0-9])",
    r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    r"(?<![0-9A-Za-z])[0-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z])",
    r"(?<![0-9A-Za-z+])(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{1,4}(?:[ .-]?[0-9]{2,4}){1,4}|(?:[0-9][ .-])?\([0-9]{2,4}\)[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}|[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}|0[1-9](?:[ .-][0-9]{2}){4}|0[1-9][0-9]{1,3}[ /-][0-9]{5,8}|(?<![0-9] |[0-9]-|[.,])[2-9][0-9]{2}-[0-9]{4}(?!-))(?![0-9A-Za-z]|\.[0-9])",
    rf"(?<![\p{{L}}\p{{N}}])(?:{_TITLES})\.? {_NAME_WORD}(?: {_NAME_WORD})?",
)
ENTITY = "|".join(f"(?:{p})" for p in _PATTERNS)
KINDS = ("email", "iban", "ip", "ip6", "ssn", "card", "phone", "name")


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often it is named."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _kind(m: Column) -> Column:
    return (
        F.when(m.contains("@"), "email")
        .when(m.rlike(r"^[A-Z]{2}[0-9]{2}"), "iban")
        .when(m.rlike(r"^[0-9A-Fa-f:]+$") & m.contains(":"), "ip6")
        .when(m.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$"), "ip")
        .when(m.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), "ssn")
        .when(m.rlike(r"^[0-9](?:[ -]?[0-9]){12,18}$"), "card")
        .when(m.rlike(r"^[+(0-9]"), "phone")
        .otherwise("name")
    )


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _country(m: Column) -> Column:
    """A phone number's country code with its plus sign, or the zero of a national number."""
    return F.regexp_extract(m, r"^(\+[0-9]{1,3}(?=[ .(-])|0(?=[1-9]))", 1)


def _title(m: Column) -> Column:
    return F.regexp_extract(m, rf"^((?:{_TITLES})\.? )", 1)


def _name_words(m: Column) -> Column:
    """The words of a name, its title left out."""
    return F.split(F.regexp_replace(m, rf"^(?:{_TITLES})\.? ", ""), " ")


def _gender(m: Column) -> Column:
    """What the title of a name says: m, f or n."""
    title = F.regexp_extract(m, rf"^({_TITLES})", 1)
    return F.when(title.isin(*MALE), "m").when(title.isin(*FEMALE), "f").otherwise("n")


def _domain(address: Column) -> Column:
    return F.substring_index(address, "@", -1)


def _canonical(kind: Column, m: Column) -> Column:
    """What spellings of one entity have in common; a phone number keeps its country code in front. Names are taken word by word instead."""
    return (
        F.when(kind.isin("email", "ip6"), F.lower(m))
        .when(kind == "ip", m)
        .when(kind == "iban", F.regexp_replace(m, " ", ""))
        .when(kind == "phone", F.concat(_country(m), F.lit(":"), _digits(F.substring(m, F.length(_country(m)) + 1, F.length(m)))))
        .otherwise(_digits(m))
    )


def _digest(key: str, kind: Column, value: Column, tries: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", F.lit(key), kind, value, tries.cast("string")).cast("binary"), 256)


def _as_digits(hexes: Column) -> Column:
    return F.translate(hexes, "abcdef", "172839")


def _as_letters(hexes: Column) -> Column:
    return F.translate(hexes, "0123456789abcdef", "bcdfghjklmnpqrst")


def _luhn(digits: Column) -> Column:
    """The Luhn sum of a string of digits."""
    def part(c: Column, i: Column) -> Column:
        x = c.cast("int")
        return F.when(i % 2 == 1, F.when(x > 4, 2 * x - 9).otherwise(2 * x)).otherwise(x)

    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), part), F.lit(0), lambda s, x: s + x)


def _laid_out(form: Column, digits: Column, letters: Column) -> Column:
    """``form`` with its k-th character replaced by the k-th digit or letter, by what it is; other characters stay."""
    def one(c: Column, i: Column) -> Column:
        k = F.pmod(i, F.lit(64)) + 1
        d, x = F.substring(digits, k, F.lit(1)), F.substring(letters, k, F.lit(1))
        return F.when(c.rlike("[0-9]"), d).when(c.rlike(r"\p{Lu}"), F.upper(x)).when(c.rlike(r"\p{L}"), x).otherwise(c)

    return F.array_join(F.transform(F.split(form, ""), one), "")


def _remainder_97(spelt: Column) -> Column:
    """An account number in digits, A standing for 10, divided by 97."""
    def step(r: Column, c: Column) -> Column:
        return F.when(c.rlike("[0-9]"), (r * 10 + c.cast("int")) % 97).otherwise((r * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(F.filter(F.split(spelt, ""), lambda c: c != ""), F.lit(0), step)


def _account(country: Column, body: Column) -> Column:
    """An account number with the check digits that make its remainder 1."""
    return F.concat(country, F.lpad((F.lit(98) - _remainder_97(F.concat(body, country, F.lit("00")))).cast("string"), 2, "0"), body)


#: Syllables of made-up names by script, and their endings by gender.
_SYLLABLES = {
    "latin": "ba be bo da de di do fa fe ga go ka ke ki ko la le li lo lu ma me mi mo na ne ni no pa pe po ra re ri ro ru sa se si so ta te ti to va ve vi vo za zo".split(),
    "cyrillic": "ба бе бо ва ве ви во га го да де ди до за зо ка ке ки ко ла ле ли ло лу ма ме ми мо на не ни но па пе по ра ре ри ро ру са се си со та те ти то фа фе".split(),
    "greek": "βα βε βο γα γο δα δε δι δο ζα ζο κα κε κι κο λα λε λι λο λυ μα με μι μο να νε νι νο πα πε πο ρα ρε ρι ρο ρυ σα σε σι σο τα τε τι το φα φε φι φο χα χο".split(),
}
_ENDINGS = {"latin": ("n", "na", "l"), "cyrillic": ("н", "на", "ль"), "greek": ("ς", "να", "ρ")}


def _made_up(word: Column, digest: Column, gender: Column) -> Column:
    """A name word in the script of ``word``: four syllables and an ending."""
    def build(script: str) -> Column:
        table_ = F.array(*[F.lit(s) for s in _SYLLABLES[script]])
        parts = [F.element_at(table_, F.pmod(F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long"), F.lit(len(_SYLLABLES[script]))).cast("int") + 1) for k in range(4)]
        m, f, n = _ENDINGS[script]
        return F.concat(*parts, F.when(gender == "m", m).when(gender == "f", f).otherwise(n))

    return F.when(word.rlike(r"^\p{IsCyrillic}"), build("cyrillic")).when(word.rlike(r"^\p{IsGreek}"), build("greek")).otherwise(build("latin"))


def surrogate(kind: Column, value: Column, gender: Column, tries: Column, key: str = KEY) -> Column:
    """The surrogate of an entity in canonical form: of a domain, of an address with its own domain, of one word of a name."""
    given = F.struct(kind.alias("kind"), value.alias("value"), gender.alias("gender"), tries.alias("tries"), _digest(key, kind, value, tries).alias("h"))

    def spelt(x: Column) -> Column:
        more = F.struct(*[x[n].alias(n) for n in ("kind", "value", "gender", "tries", "h")], _as_digits(x["h"]).alias("digits"), _as_letters(x["h"]).alias("letters"))
        return _let(more, _by_kind)

    return _let(given, spelt)


#: Tries of one length, after which the names of addresses and domains become a letter longer.
SAME_LENGTH = 4


def _by_kind(y: Column) -> Column:
    kind, value, h, digits, letters = (y[n] for n in ("kind", "value", "h", "digits", "letters"))
    size = F.length(value)
    number = lambda k: F.conv(F.substring(h, 1 + 8 * k, 8), 16, 10).cast("long")
    longer = F.substring(letters, F.lit(40), F.floor(y["tries"] / SAME_LENGTH).cast("int"))
    local = F.concat(_laid_out(F.substring_index(value, "@", 1), digits, letters), longer)
    top = F.concat(F.lit("."), F.substring_index(value, ".", -1))
    below = F.substring(value, F.lit(1), size - F.length(top))
    octets = [F.pmod(number(0), F.lit(223)) + 1, *[F.pmod(number(k), F.lit(256)) for k in (1, 2, 3)]]
    hexes = F.transform(F.split(value, ""), lambda c, i: F.when(c.rlike("[0-9a-f]"), F.substring(h, F.pmod(i, F.lit(64)) + 1, F.lit(1))).otherwise(c))
    body = F.substring(digits, F.lit(1), size - 1)
    card = _let(body, lambda d: F.concat(d, F.pmod(_luhn(value) - _luhn(F.concat(d, F.lit("0"))), F.lit(10)).cast("string")))
    return (
        F.when(kind == "email", F.concat(local, F.lit("@"), _domain(value)))
        .when(kind == "domain", F.concat(_laid_out(below, digits, letters), longer, top))
        .when(kind == "ip", F.concat_ws(".", *[o.cast("string") for o in octets]))
        .when(kind == "ip6", F.array_join(hexes, ""))
        .when(kind == "iban", _account(F.substring(value, 1, 2), _laid_out(F.substring(value, F.lit(5), size), digits, letters)))
        .when(kind == "ssn", F.concat(F.lit("9"), F.substring(digits, F.lit(1), size - 1)))
        .when(kind == "card", card)
        .when(kind == "phone", F.concat_ws(":", F.substring_index(value, ":", 1), F.substring(digits, F.lit(1), F.length(F.substring_index(value, ":", -1)))))
        .otherwise(_made_up(value, h, y["gender"]))
    )


def _placed(kind: Column, m: Column, made: Column) -> Column:
    """A surrogate in canonical form, in the format of the spelling ``m``; addresses and names are put together elsewhere."""
    def at(pattern: str, m: Column = m, made: Column = made) -> Column:
        chars = F.split(m, "")
        nth = lambda i: F.length(F.regexp_replace(F.substring(m, F.lit(1), i + 1), f"[^{pattern}]", ""))
        return F.array_join(F.transform(chars, lambda c, i: F.when(c.rlike(f"[{pattern}]"), F.substring(made, nth(i), F.lit(1))).otherwise(c)), "")

    own = F.substring(m, F.length(_country(m)) + 1, F.length(m))
    return (
        F.when(kind.isin("ip", "ip6"), made)
        .when(kind == "iban", at("A-Z0-9"))
        .when(kind == "phone", F.concat(_country(m), at("0-9", own, F.substring_index(made, ":", -1))))
        .otherwise(at("0-9"))
    )


def _gate(text: Column) -> Column:
    """Whether an entity can be there; searches for fixed strings are much faster than a pattern of all titles."""
    held = F.lit(False)
    for t in (*MALE, *FEMALE, *NEUTRAL):
        if not any(t != o and t.startswith(o) for o in (*MALE, *FEMALE, *NEUTRAL)):
            held = held | text.contains(t)
    return text.contains("@") | text.rlike("[0-9]") | (held & text.rlike(rf"(?:{_TITLES})\.? \p{{Lu}}"))


_NO_TEXTS = "cast(array() as array<string>)"


def with_matches(docs: DataFrame) -> DataFrame:
    """(doc_id, text, pattern, found, genders) of every row.

    found has the entities of the text as they are spelt, in order; names that
    stand with a title are found without it as well. pattern is what finds
    them; genders maps the words of names, in lower case, to what the titles of
    this document say.
    """
    rows = docs.select("doc_id", text_or_empty().alias("text"))
    titled = F.when(_gate(F.col("text")), F.regexp_extract_all("text", F.lit(ENTITY), F.lit(0)))
    rows = rows.select("doc_id", "text", F.coalesce(titled, F.expr(_NO_TEXTS)).alias("titled"))
    names = F.filter("titled", lambda m: _kind(m) == "name")
    said = F.array_distinct(F.flatten(F.transform(names, lambda m: F.transform(_name_words(m), lambda w: F.struct(w.alias("spelt"), F.lower(w).alias("word"), _gender(m).alias("gender"))))))
    rows = rows.select("*", said.alias("said"))
    words = F.array_distinct(F.transform("said", lambda x: x["word"]))

    def resolved(word: Column) -> Column:
        has = lambda g: F.exists("said", lambda x: (x["word"] == word) & (x["gender"] == g))
        return F.struct(word, F.when(has("m") & ~has("f"), "m").when(has("f") & ~has("m"), "f").otherwise("n"))

    # Longer words first, so that none is cut short by its own beginning.
    spelt = F.array_distinct(F.concat(F.transform("said", lambda x: x["spelt"]), F.transform("said", lambda x: F.upper(x["spelt"]))))
    any_word = F.concat(F.lit("(?:"), F.array_join(F.transform(F.sort_array(F.transform(spelt, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))), asc=False), lambda x: x["w"]), "|"), F.lit(r")(?![\p{L}\p{N}])"))
    bare = F.concat(F.lit(ENTITY + r"|(?<![\p{L}\p{N}])(?=\p{Lu})"), any_word, F.lit("(?: "), any_word, F.lit(")*"))
    rows = rows.select("doc_id", "text", "titled", F.when(F.size("said") > 0, bare).alias("pattern"), F.map_from_entries(F.transform(words, resolved)).alias("genders"))
    found = F.when(F.col("pattern").isNotNull(), F.regexp_extract_all("text", F.col("pattern"), F.lit(0))).otherwise(F.col("titled"))
    return rows.select("doc_id", "text", "pattern", found.alias("found"), "genders")


def _members(matches: DataFrame) -> DataFrame:
    """(doc_id, kind, value, gender): what each document holds, once; the gender of all but name words is n."""
    plain = F.filter("found", lambda m: _kind(m) != "name")
    one = lambda kind, value, gender: F.struct(kind.alias("kind"), value.alias("value"), gender.alias("gender"))
    whole = F.transform(plain, lambda m: one(_kind(m), _canonical(_kind(m), m), F.lit("n")))
    domains = F.transform(F.filter("found", lambda m: m.contains("@")), lambda m: one(F.lit("domain"), _domain(F.lower(m)), F.lit("n")))
    words = F.transform(F.map_entries("genders"), lambda e: one(F.lit("name"), e["key"], e["value"]))
    return matches.select("doc_id", F.explode(F.array_distinct(F.concat(whole, domains, words))).alias("e")).select("doc_id", "e.*")


def entities(matches: DataFrame) -> DataFrame:
    """(kind, value, gender, mixed) of each distinct entity; mixed: documents differ in what they say of its gender."""
    sexes = _members(matches).groupBy("kind", "value").agg(F.bool_or(F.col("gender") == "m").alias("m"), F.bool_or(F.col("gender") == "f").alias("f"), (F.min("gender") != F.max("gender")).alias("mixed"))
    return sexes.select("kind", "value", F.when(F.col("m") & ~F.col("f"), "m").when(F.col("f") & ~F.col("m"), "f").otherwise("n").alias("gender"), "mixed")


def resolve(found: DataFrame, key: str = KEY, rounds: int = ROUNDS) -> DataFrame:
    """``found`` (kind, value, gender, ...) with tries, raised until all surrogates of a kind differ from each other and from every real entity.

    Of entities that share a surrogate the one of fewest tries keeps it, of
    equal ones that of the smallest value, so the outcome does not depend on
    the order of rows. Addresses are told apart within their domain; as domains
    are, too, whole addresses are.
    """
    with tidy(found.sparkSession) as keep:
        names = found.columns
        state = checkpointed(found.withColumn("tries", F.lit(0)))
        real = state.select("kind", F.col("value").alias("made")).withColumn("taken", F.lit(True))
        for _ in range(rounds):
            made = state.withColumn("made", surrogate(F.col("kind"), F.col("value"), F.col("gender"), F.col("tries"), key))
            held = made.groupBy("kind", "made").agg(F.min(F.struct("tries", "value")).alias("first"), F.count("*").alias("n"))
            bad = held.join(real, ["kind", "made"], "left").where("n > 1 or taken")
            checked = checkpointed(made.join(bad.select("kind", "made", "first", "taken"), ["kind", "made"], "left"))
            lost = F.col("first").isNotNull() & (F.coalesce("taken", F.lit(False)) | (F.col("first.value") != F.col("value")))
            if checked.where(lost).isEmpty():
                return keep(state)
            state = checkpointed(checked.select(*names, (F.col("tries") + F.when(lost, 1).otherwise(0)).alias("tries")))
        raise ValueError("a kind of entity has more members than surrogates of its format")


def replace_entities(docs: DataFrame, key: str = KEY) -> DataFrame:
    """(doc_id, text, n_entities, kinds) of every row, entities replaced by their surrogates.

    n_entities counts the places; kinds lists the distinct kinds, sorted and
    comma-joined. A null text becomes empty; rows, repeated ones and those with
    a null doc_id included, stay, and equal texts become equal texts; texts of
    any length are replaced as a whole; other columns are ignored; an empty
    table gives an empty result.
    """
    matches = with_matches(docs)
    odd = checkpointed(resolve(entities(matches), key).where("tries > 0 or mixed").select("kind", "value", "gender", "tries"))
    few = odd.limit(PLAN_EXCEPTIONS + 1).collect()
    if len(few) <= PLAN_EXCEPTIONS:
        known = F.create_map(*[x for r in sorted(few) for x in (F.lit(f"{r['kind']}\x1f{r['value']}"), F.struct(F.lit(r["gender"]).alias("gender"), F.lit(r["tries"]).alias("tries")))]) if few else F.expr("cast(map() as map<string,struct<gender:string,tries:int>>)")
        rows, exception = matches, lambda k: F.try_element_at(known, k)
    else:
        held = meet(_members(matches).select("doc_id", "kind", "value"), odd, ["kind", "value"], odd.count(), "doc_id")
        own = held.groupBy(F.col("doc_id").alias("__id")).agg(F.map_from_entries(F.collect_set(F.struct(F.concat_ws("\x1f", "kind", "value"), F.struct("gender", "tries")))).alias("odd"))
        rows, exception = matches.join(own, F.col("doc_id").eqNullSafe(F.col("__id")), "left").drop("__id"), lambda k: F.try_element_at("odd", k)

    def made(kind: Column, value: Column, gender: Column | None = None) -> Column:
        own = F.lit("n") if gender is None else gender
        about = F.struct(kind.alias("kind"), value.alias("value"), own.alias("gender"), exception(F.concat_ws("\x1f", kind, value)).alias("odd"))
        return _let(about, lambda x: surrogate(x["kind"], x["value"], F.coalesce(x["odd"]["gender"], x["gender"]), F.coalesce(x["odd"]["tries"], F.lit(0)), key))

    def renamed(m: Column) -> Column:
        def word(w: Column) -> Column:
            low = F.lower(w)
            new = made(F.lit("name"), low, F.coalesce(F.try_element_at("genders", low), F.lit("n")))
            return F.when((w == F.upper(w)) & (F.length(w) > 1), F.upper(new)).otherwise(F.initcap(new))

        return F.concat(_title(m), F.array_join(F.transform(_name_words(m), word), " "))

    def readdressed(m: Column) -> Column:
        return F.concat(F.substring_index(made(F.lit("email"), F.lower(m)), "@", 1), F.lit("@"), made(F.lit("domain"), _domain(F.lower(m))))

    def changed(m: Column) -> Column:
        def by_kind(x: Column) -> Column:
            plain = _placed(x["kind"], x["m"], made(x["kind"], _canonical(x["kind"], x["m"])))
            return F.when(x["kind"] == "name", renamed(x["m"])).when(x["kind"] == "email", readdressed(x["m"])).otherwise(plain)

        return _let(F.struct(m.alias("m"), _kind(m).alias("kind")), by_kind)

    some = F.size("found") > 0
    rows = rows.withColumn("new", F.when(some, F.transform("found", changed)))
    # Gaps and entities alternate, gaps first.
    gaps = F.when(F.col("pattern").isNotNull(), F.split("text", F.col("pattern"), -1)).otherwise(F.split("text", ENTITY, -1))
    pieces = F.zip_with(gaps, F.col("new"), lambda gap, e: F.concat(gap, F.coalesce(e, F.lit(""))))
    kinds = F.array_join(F.array_sort(F.array_distinct(F.transform("found", _kind))), ",")
    return rows.select("doc_id", F.when(some, F.array_join(pieces, "")).otherwise(F.col("text")).alias("text"), F.size("found").cast("long").alias("n_entities"), kinds.alias("kinds"))


def op2_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text, n_entities, kinds) of every document, personal data replaced; rules for odd rows as in ``replace_entities``."""
    return replace_entities(table(spark, sf_dir, "documents"))
