"""PII surrogates: detected entities get keyed, type-consistent replacements; DataFrame operations only.

Found are e-mail addresses, phone numbers, payment card numbers, IPv4 addresses and persons with a form of
address and up to three names. A text is split at its entities, every entity becomes its surrogate, and the parts
are joined again, within the row. A surrogate depends on the key, the type, the entity's canonical form and an
attempt number alone, so an entity has one surrogate wherever and however it is written:

* phone: country code and punctuation stay; the other digits go through a keyed Feistel permutation;
* card: issuer digit, grouping and (in)validity of the check digit stay; the digits between are permuted;
* IPv4: the 32 bits are permuted, again until the address is an ordinary public one;
* e-mail: letters and digits are replaced by the same kind of the same script; the domain gets a surrogate
  of its own, so that colleagues stay colleagues; top-level domain and reserved example domains stay;
* person: form of address and gender stay; each name has a surrogate of its own, so "Mr. John Smith" and a later
  "Mr. Smith" stay one person; given names come from a list of that gender, if the script is Latin, and other
  names are letters of the same script and case. Where a document names a person of two names or more with a form of
  address, the same names without one are replaced in it too.

Collisions are checked on the table of distinct entities and names: a surrogate that equals a real one or that
of another one moves to its next attempt, until none does. Later attempts have more room (given names leave the
list, letters and digits are added), so this ends however many short entities there are. Almost always
nothing moves; those that do are joined back to their documents, by a broadcast where a measured size
allows it, else by a shuffle. A text is searched once: what is found and what stands between is written,
and all later steps read that.

Edge cases: a null text stays null with no entities; a text without entities is unchanged; repeated rows
are treated alike, rows without an id too; extra columns are ignored; lengths are unbounded. A surname alone, without
a form of address, stays. Letters outside Latin, Cyrillic and Greek become Latin ones.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from refloom.llm.common import discard, materialize, small

ROUNDS = 6
ROOM = 3  #: attempts from which on surrogates have more room
KINDS = ("email", "phone", "card", "ip", "person")

# Forms of address by gender, given names that surrogates are taken from.
MALE = ("Mr", "Sir", "Herr", "Señor", "Monsieur", "Don")
FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Señora", "Madame", "Doña")
MALE_NAMES = ("Adam", "Bruno", "Carl", "David", "Erik", "Felix", "Georg", "Hugo", "Ivan", "Jonas", "Karl", "Leon", "Marco", "Nils", "Oscar", "Paul")
FEMALE_NAMES = ("Anna", "Berta", "Clara", "Diana", "Elena", "Frida", "Greta", "Hanna", "Irene", "Julia", "Karin", "Laura", "Maria", "Nora", "Olga", "Paula")
# The patterns.
EMAIL = r"(?<![\w.+%-])[\w.+%-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+"
PHONE = r"(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?!\w)|(?<![\w(])\(\d{3}\) ?\d{3}-\d{4}(?!\w)|(?<![\w.-])\d{3}-\d{3}-\d{4}(?![\w-])"
CARD = r"(?<![\w.+-])\d{4}(?:[ -]?\d{4}){3}(?![\w-])|(?<![\w.+-])\d{13,19}(?!\w)"
IP = r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?!\w|\.\d)"
TITLE = "|".join(MALE + FEMALE)
PERSON = rf"(?<!\w)(?:{TITLE})\.? \p{{Lu}}[\p{{L}}'-]+(?: \p{{Lu}}[\p{{L}}'-]+){{0,2}}"
ENTITY = f"{EMAIL}|{PHONE}|{CARD}|{IP}|{PERSON}"
MAYBE = rf"[0-9@]|(?:{TITLE})\.? "


def let(value: Column, body) -> Column:
    """body(value), with value worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def digits(e: Column) -> Column:
    return F.regexp_replace(e, r"\D", "")


def kind_of(e: Column) -> Column:
    return F.when(e.contains("@"), "email").when(e.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), "ip").when(e.rlike(r"^[+(]|^\d{3}-\d{3}-\d{4}$"), "phone").when(e.rlike(r"^\d"), "card").otherwise("person")


def _country(e: Column) -> Column:
    """Digits of the country code of a phone number, if it is written."""
    return F.regexp_extract(e, r"^\+(\d{1,3})(?=[ .(-])", 1)


def canonical(kind: Column, e: Column) -> Column:
    return (
        F.when(kind == "email", F.lower(e)).when(kind == "card", digits(e)).when(kind == "phone", F.substring(digits(e), F.length(_country(e)) + 1, F.lit(32)))
        .otherwise(e)
    )


def names_of(e: Column) -> Column:
    """Names of a person: (kind, canon), given names by gender, the last one or a single one as `name`."""
    names, male = F.slice(F.split(e, " "), F.lit(2), F.size(F.split(e, " "))), F.regexp_extract(e, r"^\p{L}+", 0).isin(*MALE)
    kind = lambda i: F.when(i == F.size(names) - 1, "name").when(male, "male").otherwise("female")
    return F.transform(names, lambda n, i: F.struct(kind(i).alias("kind"), F.lower(n).alias("canon"), n.alias("written")))


def wholes_of(e: Column) -> Column:
    """(kind, canon) of what has a surrogate of its own: the entity, or the names of a person."""
    one = let(kind_of(e), lambda kind: F.struct(kind.alias("kind"), canonical(kind, e).alias("canon"), e.alias("written")))
    return F.when(kind_of(e) == "person", names_of(e)).otherwise(F.array(one))


def _noise(seed: Column, *more: Column) -> Column:
    """A keyed number from 0 to 2^60 - 1."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", seed, *[m.cast("string") for m in more]), 256), 1, 15), 16, 10).cast("long")


def permute(d: Column, seed: Column) -> Column:
    """A keyed permutation of the digit strings of each length from 2 to 36: an alternating Feistel network
    on the halves, in base 10."""
    left, n = F.floor(F.length(d) / 2).cast("int"), F.length(d)
    power = lambda k: F.rpad(F.lit("1"), k + 1, "0").cast("long")

    def turn(a, i):
        half = F.when(i % 2 == 0, left).otherwise(n - left)
        new = lambda mine, other: F.lpad(F.pmod(mine.cast("long") + F.pmod(_noise(seed, i, other, n), power(half)), power(half)).cast("string"), half, "0")
        return F.when(i % 2 == 0, F.struct(new(a["l"], a["r"]).alias("l"), a["r"].alias("r"))).otherwise(F.struct(a["l"].alias("l"), new(a["r"], a["l"]).alias("r")))

    first = F.struct(F.substring(d, F.lit(1), left).alias("l"), F.substring(d, left + 1, n).alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), first, turn, lambda a: F.concat(a["l"], a["r"]))


def walk(x: Column, step, good) -> Column:
    """step(x), again while the result isn't good: still one to one on the good ones."""
    return F.aggregate(F.sequence(F.lit(1), F.lit(40)), F.struct(x.alias("v"), F.lit(False).alias("done")), lambda a, _: F.when(a["done"], a).otherwise(let(step(a["v"]), lambda y: F.struct(y.alias("v"), good(y).alias("done")))), lambda a: a["v"])


def spread(pattern: Column, new: Column) -> Column:
    """pattern with its digits replaced by those of new, in order; what is left of new comes behind it."""
    chars = F.split(pattern, "")
    return F.aggregate(chars, F.struct(F.lit("").alias("s"), F.lit(1).alias("at")), lambda a, c: F.when(c.rlike(r"^\d$"), F.struct(F.concat(a["s"], F.substring(new, a["at"], F.lit(1))).alias("s"), (a["at"] + 1).alias("at"))).otherwise(F.struct(F.concat(a["s"], c).alias("s"), a["at"].alias("at"))), lambda a: F.concat(a["s"], F.substring(new, a["at"], F.length(new))))


def wider(s: Column, attempt: Column, more: Column) -> Column:
    """s with more of the same kind behind it, from attempt ROOM on."""
    return F.concat(s, F.repeat(more, F.greatest(attempt - (ROOM - 1), F.lit(0))))


def shape(s: Column, seed: Column) -> Column:
    """Letters become letters of the same script and case, digits become digits."""

    def one(c, i):
        h = F.pmod(F.xxhash64(seed, i), F.lit(1 << 30)).cast("int")
        pick = lambda letters: F.substring(F.lit(letters), F.pmod(h, F.lit(len(letters))) + 1, F.lit(1))
        return (
            F.when(c.rlike("^[0-9]$"), pick("0123456789")).when(c.rlike("^[a-zß-öø-ÿ]$"), pick("abcdefghijklmnopqrstuvwxyz")).when(c.rlike("^[A-ZÀ-ÖØ-Þ]$"), pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
            .when(c.rlike("^[а-яё]$"), pick("абвгдежзиклмнопрстуфхцчшэюя")).when(c.rlike("^[А-ЯЁ]$"), pick("АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЭЮЯ"))
            .when(c.rlike("^[α-ω]$"), pick("αβγδεζηθικλμνξοπρστυφχψω")).when(c.rlike("^[Α-Ω]$"), pick("ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ"))
            .when(c.rlike(r"^\p{Lu}$"), pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ")).when(c.rlike(r"^\p{L}$"), pick("abcdefghijklmnopqrstuvwxyz")).otherwise(c)
        )

    return F.array_join(F.transform(F.split(s, ""), one), "")


def luhn(d: Column) -> Column:
    """The check digit that follows the digits d."""
    n = F.length(d)
    weigh = lambda c, i: let(c.cast("int") * F.when((n - i) % 2 == 1, 2).otherwise(1), lambda v: F.when(v > 9, v - 9).otherwise(v))
    return F.pmod(F.lit(10) - F.pmod(F.aggregate(F.transform(F.filter(F.split(d, ""), lambda c: c != ""), weigh), F.lit(0), lambda a, x: a + x), F.lit(10)), F.lit(10))


def _card(d: Column, seed: Column) -> Column:
    n = F.length(d)
    body = F.concat(F.substring(d, 1, 1), permute(F.substring(d, F.lit(2), n - 2), F.concat(seed, F.substring(d, 1, 1))))
    off = F.pmod(F.substring(d, n, F.lit(1)).cast("int") - luhn(F.substring(d, F.lit(1), n - 1)), F.lit(10))
    return let(body, lambda b: F.concat(b, F.pmod(luhn(b) + off, F.lit(10)).cast("string")))


def _phone(c: Column, seed: Column, attempt: Column) -> Column:
    """A first digit of 2 or more stays one, as it does in numbers that can be dialled; the exchange 555 of a
    number of ten digits stays, until attempts need more room; then there are more digits in the end."""
    plain = lambda x: walk(x, lambda v: permute(v, seed), lambda y: (F.substring(y, 1, 1) >= "2") | (F.substring(x, 1, 1) < "2"))
    fictional = (F.length(c) == 10) & (F.substring(c, 4, 3) == "555") & (attempt < ROOM)
    d = wider(c, attempt - ROOM, F.lit("0"))
    return F.when(fictional, let(plain(F.concat(F.substring(c, 1, 3), F.substring(c, 7, 4))), lambda y: F.concat(F.substring(y, 1, 3), F.lit("555"), F.substring(y, 4, 4)))).otherwise(plain(d))


def _ip(e: Column, seed: Column) -> Column:
    part = F.split(e, r"\.")
    octet = lambda k: F.get(part, F.lit(k)).cast("int")
    start = F.struct((octet(0) * 256 + octet(1)).alias("l"), (octet(2) * 256 + octet(3)).alias("r"))

    def turn(a, i):
        mixed = F.when(i % 2 == 0, a["r"]).otherwise(a["l"])
        noise = F.pmod(_noise(seed, i, mixed), F.lit(65536)).cast("int")
        return F.when(i % 2 == 0, F.struct(a["l"].bitwiseXOR(noise).alias("l"), a["r"].alias("r"))).otherwise(F.struct(a["l"].alias("l"), a["r"].bitwiseXOR(noise).alias("r")))

    step = lambda v: F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), v, turn)
    public = lambda y: let(F.floor(y["l"] / 256), lambda o: (o >= 1) & (o <= 223) & ~o.isin(10, 127, 169, 172, 192))
    return let(walk(start, step, public), lambda y: F.concat_ws(".", F.floor(y["l"] / 256), y["l"] % 256, F.floor(y["r"] / 256), y["r"] % 256))


def _email(c: Column, key: Column, seed: Column, attempt: Column) -> Column:
    local, domain = wider(F.substring_index(c, "@", 1), attempt, F.lit("a")), F.substring_index(c, "@", -1)
    reserved = domain.rlike(r"(^|\.)(example\.(com|org|net)|test|example|invalid)$")
    head, top = F.regexp_replace(domain, r"\.[^.]+$", ""), F.regexp_extract(domain, r"\.[^.]+$", 0)
    return F.concat(shape(local, seed), F.lit("@"), F.when(reserved, domain).otherwise(F.concat(shape(head, F.concat_ws("|", key, F.lit("domain"), domain)), top)))


def _name(kind: Column, c: Column, seed: Column, attempt: Column) -> Column:
    """Given names in Latin script are taken from the list, in the first attempts."""
    h, low = F.pmod(F.xxhash64(seed), F.lit(16)).cast("int"), lambda names: F.array(*[F.lit(n.lower()) for n in names])
    listed = (kind != "name") & c.rlike(r"^[a-zß-öø-ÿ'-]+$") & (attempt < ROOM)
    return F.when(listed, F.get(F.when(kind == "male", low(MALE_NAMES)).otherwise(low(FEMALE_NAMES)), h)).otherwise(shape(wider(c, attempt, F.substring(c, 1, 1)), seed))


def surrogate(kind: Column, canon: Column, key: str, attempt: Column) -> Column:
    """The canonical form of an entity's replacement."""
    k = F.sha2(F.lit(key), 256)
    seed = lambda t: F.sha2(F.concat_ws("|", k, t, attempt.cast("string")), 256)
    own = F.sha2(F.concat_ws("|", seed(kind), canon), 256)
    return F.when(kind == "phone", _phone(canon, seed(F.lit("phone")), attempt)).when(kind == "card", _card(canon, seed(F.lit("card")))).when(kind == "ip", _ip(canon, seed(F.lit("ip")))).when(kind == "email", _email(canon, k, own, attempt)).otherwise(_name(kind, canon, own, attempt))


def _case(written: Column, new: Column) -> Column:
    """A name in capitals if it was written so, else with one capital."""
    return F.when((F.length(written) > 1) & (F.upper(written) == written), F.upper(new)).otherwise(F.concat(F.upper(F.substring(new, 1, 1)), F.substring(new, F.lit(2), F.length(new))))


def dressed(kind: Column, e: Column, new: Column) -> Column:
    """The replacement in the format in which the entity is written."""
    code = _country(e)
    phone = F.when(F.length(code) > 0, F.concat(F.lit("+"), code, spread(F.substring(e, F.length(code) + 2, F.length(e)), new))).otherwise(spread(e, new))
    upper = (F.upper(e) == e) & e.rlike(r"\p{Lu}")
    return F.when(kind == "phone", phone).when(kind == "card", spread(e, new)).when((kind == "email") & upper, F.upper(new)).when(kind.isin("name", "male", "female"), _case(e, new)).otherwise(new)


def entities_of(text: Column) -> Column:
    none = F.array().cast("array<string>")
    return F.when(text.isNull() | ~text.rlike(MAYBE), none).otherwise(F.regexp_extract_all(text, F.lit(ENTITY), F.lit(0)))


def overrides(distinct: DataFrame, key: str) -> DataFrame:
    """distinct (kind, canon) -> (kind, canon, attempt) of those whose attempt isn't 0. Attempts get more room from ROOM
    on, so the loop ends."""
    # the attempt is a column of a written table, so that all rounds are one and the same code
    named = lambda df: df.withColumn("new", surrogate(F.col("kind"), F.col("canon"), key, F.col("attempt")))
    state = materialize(named(materialize(distinct.withColumn("attempt", F.lit(0)), "attempts")), "surrogates")
    real = distinct.select("kind", F.col("canon").alias("new"))
    for n in count(1):
        # of entities with one surrogate the one with the lowest attempt and form keeps it
        twice = state.groupBy("kind", "new").agg(F.min(F.struct("attempt", "canon")).alias("first"), F.count("*").alias("c")).where("c > 1").drop("c")
        later = state.join(twice, ["kind", "new"]).where("struct(attempt, canon) != first").select("kind", "canon")
        bad = materialize(state.join(real, ["kind", "new"], "left_semi").select("kind", "canon").unionAll(later).distinct().withColumn("attempt", F.lit(n)), "collisions")
        if not bad.limit(1).count():
            return state.where("attempt > 0").select("kind", "canon", "attempt")
        before, state = state, materialize(state.join(bad, ["kind", "canon"], "left_anti").unionByName(named(bad)), "surrogates")
        discard(before, bad)


def replace_entities(docs: DataFrame, key: str, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, text, n_entities, n_email, n_phone, n_card, n_ip, n_person), one row for each input row. The same key
    gives the same surrogates; it is to be kept like a password."""
    d = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text}`").alias("text")).withColumn("e", entities_of(F.col("text")))
    some = F.size("e") > 0
    d = materialize(d.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.when(~some, F.col("text")).alias("text"), F.when(some, F.split("text", ENTITY, -1)).alias("parts"), "e"), "found")
    found = d.where(F.size("e") > 0).select(F.explode_outer("e").alias("e")).where("e IS NOT NULL").distinct()
    distinct = materialize(found.select(F.explode_outer(wholes_of(F.col("e"))).alias("w")).select("w.kind", "w.canon").where("canon IS NOT NULL").distinct(), "entities")
    moved = materialize(overrides(distinct, key), "moved")
    if moved.limit(1).count():
        each = d.where(F.size("e") > 0).select("row", F.explode_outer("e").alias("e")).where("e IS NOT NULL").select("row", F.explode_outer(wholes_of(F.col("e"))).alias("w"))
        fixes = each.select("row", "w.kind", "w.canon").distinct().join(small(moved), ["kind", "canon"])
        fixes = fixes.groupBy("row").agg(F.map_from_entries(F.collect_set(F.struct(F.concat_ws("|", "kind", "canon"), "attempt"))).alias("fix"))
        d = d.join(small(materialize(fixes, "fixes")), "row", "left")
    else:
        d = d.withColumn("fix", F.lit(None).cast("map<string,int>"))

    def new(w):
        tried = F.coalesce(F.try_element_at(F.col("fix"), F.concat_ws("|", w["kind"], w["canon"])), F.lit(0))
        return dressed(w["kind"], w["written"], surrogate(w["kind"], w["canon"], key, tried))

    def replaced(e):
        title = F.regexp_extract(e, r"^\p{L}+\.? ", 0)
        made = lambda words: F.struct(kind_of(e).alias("kind"), F.when(kind_of(e) == "person", F.concat(title, words)).otherwise(words).alias("new"), F.regexp_replace(e, r"^\p{L}+\.? ", "").alias("names"), words.alias("words"))
        return let(F.array_join(F.transform(wholes_of(e), new), " "), made)

    d = d.withColumn("r", F.when(F.size("e") > 0, F.transform("e", replaced)))
    known = F.array_distinct(F.transform(F.filter("r", lambda x: (x["kind"] == "person") & x["names"].contains(" ")), lambda x: F.struct(x["names"].alias("names"), x["words"].alias("words"))))
    d = d.withColumn("known", F.when(F.size("e") > 0, known))
    without_title = lambda p: F.aggregate("known", p, lambda s, x: F.regexp_replace(s, F.concat(F.lit(r"(?<![\p{L}\d])\Q"), x["names"], F.lit(r"\E(?![\p{L}\d])")), x["words"]))
    parts = F.when(F.size("known") > 0, F.transform("parts", without_title)).otherwise(F.col("parts"))
    joined = F.array_join(F.flatten(F.zip_with(parts, "r", lambda p, r: F.array(p, F.coalesce(r["new"], F.lit(""))))), "")
    n = lambda k: F.coalesce(F.size(F.filter("r", lambda x: x["kind"] == k)), F.lit(0)).cast("long")
    return d.select("doc_id", F.when(F.col("r").isNull(), F.col("text")).otherwise(joined).alias("text"), F.size("e").cast("long").alias("n_entities"), *[F.when(F.col("r").isNull(), F.lit(0).cast("long")).otherwise(n(k)).alias(f"n_{k}") for k in KINDS])
