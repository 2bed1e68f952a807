"""PII surrogates, with DataFrame operations only: what is found in the texts is replaced
by keyed values of the same type, gender, script and format.

A found entity is taken apart into units (a phone number's digits, a mailbox, a domain, a
given name, a surname), each with a canonical form; every unit of the corpus gets one
surrogate, so what refers to the same thing still does. A name is one unit whatever title
it follows; its gender is settled over the corpus. Candidates come from a keyed hash and
are checked: two units of a kind never share one, and none is a unit that was found."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from channelweave.llm.shared import drop_table, write_table

#: Candidates tried for a unit; the spaces of all kinds are wide.
ATTEMPTS = 40
KEY = "surrogate-key"

# The titles that tell a gender, and names in two scripts.
FEMALE_TITLES = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Госпожа")
MALE_TITLES = ("Mr", "Herr", "Monsieur", "Señor", "Господин")
OTHER_TITLES = ("Dr", "Prof")
GIVEN = {
    "given_f_latin": ("Anna", "Clara", "Elena", "Greta", "Helen", "Irene", "Julia", "Laura", "Maria", "Nora", "Paula", "Rosa", "Sara", "Teresa", "Vera", "Diana"),
    "given_m_latin": ("Adam", "Bruno", "Carl", "David", "Emil", "Felix", "Hugo", "Ivan", "Jonas", "Lucas", "Martin", "Oscar", "Paul", "Robert", "Simon", "Victor"),
    "given_u_latin": ("Alex", "Andrea", "Chris", "Dominique", "Jamie", "Kim", "Lou", "Robin", "Sam", "Sasha", "Toni", "Val"),
    "given_f_cyrillic": ("Анна", "Вера", "Дарья", "Елена", "Ирина", "Мария", "Нина", "Ольга"),
    "given_m_cyrillic": ("Антон", "Борис", "Виктор", "Иван", "Максим", "Олег", "Павел", "Юрий"),
    "given_u_cyrillic": ("Валя", "Женя", "Саша", "Шура"),
    "surname_latin": ("Adler", "Bauer", "Castro", "Duval", "Ekman", "Fischer", "Garcia", "Holm", "Keller", "Lambert", "Moreno", "Novak", "Olsen", "Petit", "Quinn", "Rossi"),
    "surname_cyrillic": ("Белов", "Волков", "Громов", "Захаров", "Иванов", "Козлов", "Морозов", "Орлов"),
}
#: Syllables of names beyond these lists are a consonant and a vowel.
LETTERS = {"latin": ("bdfgklmnprstvz", "aeiou"), "cyrillic": ("бвгдзклмнпрст", "аеиоу")}

_TITLE = "|".join((*FEMALE_TITLES, *MALE_TITLES, *OTHER_TITLES))
#: One or more titles, and a word of a name, which is no title.
_TITLES = rf"(?:(?:{_TITLE})\.? ){{1,4}}"
_WORD = rf"(?!(?:{_TITLE})(?![\p{{L}}\d'’-]))\p{{Lu}}[\p{{L}}'’-]{{1,40}}"
_LABEL = r"(?i:password|passwd|secret|token|api[_-]?key)(?:[_-][A-Za-z0-9_-]{1,40}+)?[\"']? {0,2}[=:] {0,2}[\"']?"
#: Kind of entity -> its pattern (of the whole); the first that matches counts. Each
#: starts with what its first character may be, which is cheap to look at.
KINDS = {
    "email": r"(?=[A-Za-z0-9._%+-])(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}",
    "ip": r"(?=\d)(?<![\d.])(?<!(?i:section|chapter|version|release) )(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\d)",
    "ssn": r"(?=\d)(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"(?=[+(\d])(?:(?<![\d.])\+1[ .-]?\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4}(?!\d)|(?<![\d.])\+(?:[ .-]?\(?\d\)?){7,15}(?!\.?\d)|(?<![\d+])\(\d{3}\) ?\d{3}-\d{4}(?!\d)|(?<![\d.-])\d{3}[ .-]\d{3}[ .-]\d{4}(?![\d-]))",
    "card": r"(?=\d)(?<![\d.,A-Za-z-])(?:\d{13,19}|\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{1,7}|\d{4}[ -]\d{6}[ -]\d{5})(?![\dA-Za-z])",
    "iban": r"(?=[A-Z][A-Z]\d)(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "secret": rf"(?=[AaPpSsTt])(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{{16}}(?![A-Za-z0-9])|{_LABEL}(?:(?<=\")[^\"\r\n]+(?=\"|$)|(?<=')[^'\r\n]+(?='|$)|\S+))",
    "name": rf"(?=[{''.join(sorted({t[0] for t in (*FEMALE_TITLES, *MALE_TITLES, *OTHER_TITLES)}))}])(?<![\p{{L}}\d]){_TITLES}(?:{_WORD} ){{0,2}}{_WORD}",
}
PATTERN = "|".join(f"(?:{p})" for p in KINDS.values())
#: What a text must have for any of them: most texts have none of it and are read once.
HINT = r"[@0-9]|AKIA|(?=[AaPpSsTt])" + _LABEL + "|" + KINDS["name"]


def byte(digest: Column, i: Column | int) -> Column:
    """A number below 65536 from the digest, another for each i."""
    at = (F.lit(i) if isinstance(i, int) else i) % 60 + 1
    return F.conv(F.substr(digest, at.cast("int"), F.lit(4)), 16, 10).cast("int")


def pick(text: str | tuple[str, ...], n: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, text)), (n % len(text) + 1).cast("int"))


def scramble(c: Column, digest: Column) -> Column:
    """Each ASCII digit by a digit, each letter by a letter of its case, at random."""

    def one(x: Column, i: Column) -> Column:
        b = byte(digest, i)
        letter = lambda base: F.chr(F.lit(base) + b % 26)
        return F.when(x.between("0", "9"), (b % 10).cast("string")).when(x.between("a", "z"), letter(97)).when(x.between("A", "Z"), letter(65)).otherwise(x)

    return F.array_join(F.transform(F.split(c, ""), one), "")


def digits(c: Column, digest: Column) -> Column:
    """As many digits as c has, the first of them not zero."""
    return F.array_join(F.transform(F.sequence(F.lit(0), F.length(c) - 1), lambda i: F.when(i == 0, byte(digest, i) % 9 + 1).otherwise(byte(digest, i) % 10).cast("string")), "")


def luhn(c: Column) -> Column:
    """The Luhn sum of a string of digits, modulo 10."""
    n = F.length(c)

    def value(x: Column, i: Column) -> Column:
        twice = x.cast("int") * (F.lit(1) + (n - i + 1) % 2)
        return F.when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.transform(F.split(c, ""), value), F.lit(0), lambda a, x: a + x) % 10


def iban_rest(c: Column) -> Column:
    """The number of an IBAN modulo 97; letters count from 10, the first four go last."""
    turned = F.split(F.concat(F.substr(c, F.lit(5)), F.substr(c, F.lit(1), F.lit(4))), "")
    step = lambda a, x: F.when(x.between("0", "9"), (a * 10 + F.ascii(x) - 48) % 97).otherwise((a * 100 + F.ascii(x) - 55) % 97)
    return F.aggregate(turned, F.lit(0), step)


def candidate(key: str) -> Column:
    """A surrogate of (kind, canon) for the attempt, in canonical form; ``pool`` is the
    kind with a name's gender."""
    canon, kind, pool, attempt = F.col("canon"), F.col("kind"), F.col("pool"), F.col("attempt")
    hashed = lambda *c: F.sha2(F.concat_ws("\x01", F.lit(key), *c), 256)
    d = hashed(kind, canon, attempt.cast("string"))
    card = digits(canon, d)
    body = F.substr(card, F.lit(1), F.length(card) - 1)
    check = ((10 - luhn(F.concat(body, F.lit("0")))) % 10).cast("string")
    card = F.when(luhn(canon) == 0, F.concat(body, check)).otherwise(card)
    part = lambda i: byte(d, 4 * i)
    # reserved addresses first, any others once those are dense
    ip = F.concat_ws(".", (F.when(attempt < 8, part(0) % 16 + 240).otherwise(part(0) % 223 + 1)).cast("string"), *((part(i) % 256).cast("string") for i in (1, 2, 3)))
    iban = F.concat(F.substr(canon, F.lit(1), F.lit(2)), F.lit("00"), scramble(F.substr(canon, F.lit(5)), d))
    iban = F.concat(F.substr(iban, F.lit(1), F.lit(2)), F.lpad((98 - iban_rest(iban)).cast("string"), 2, "0"), F.substr(iban, F.lit(5)))
    domain = F.substring_index(canon, "@", -1)
    labels = F.slice(F.split(domain, r"\."), 1, F.greatest(F.size(F.split(domain, r"\.")) - 1, F.lit(1)))
    more = F.substr(hashed(F.lit("more"), kind, canon, attempt.cast("string")), F.lit(1), F.lit(8))
    # where the space is small, or nothing could be scrambled, it gets longer
    longer = lambda was: F.when((attempt < 4) & (scramble(was, d) != was), scramble(was, d)).otherwise(F.concat(scramble(was, d), more))
    box, host = longer(F.substring_index(canon, "@", 1)), F.concat(longer(F.array_join(labels, ".")), F.lit(".example"))
    out = F.when(kind == "mailbox", box).when(kind == "domain", host).when(kind == "ip", ip).when(kind == "card", card).when(kind.isin("phone", "ssn"), digits(canon, d)).when(kind == "iban", iban)
    # a short secret's space could be full, and one without letters has none: those get longer
    ascii_ = F.regexp_replace(canon, r"[^\x00-\x7F]", "x")
    plain = scramble(ascii_, d)
    plain = F.when(F.length(F.regexp_replace(canon, "[^0-9A-Za-z]", "")) < 8, F.concat(plain, F.substr(hashed(F.lit("longer"), kind, canon, attempt.cast("string")), F.lit(1), F.lit(12)))).otherwise(plain)
    hexed = F.translate(plain, "ghijklmnopqrstuvwxyz", "abcdefabcdefabcdefab")
    out = out.when(kind == "secret", F.when(canon.rlike("^[0-9a-f]+$"), hexed).otherwise(plain))
    for name, listed in GIVEN.items():
        consonants, vowels = LETTERS[name.rpartition("_")[2]]
        made = lambda n, c=consonants, v=vowels: F.initcap(F.concat(*(x for i in range(n) for x in (pick(c, part(i)), pick(v, part(i) / len(c))))))
        female = [name.replace("surname", "surname_f")] if "surname" in name else []
        whole = F.when(attempt < 2, pick(listed, part(0))).when(attempt < 8, made(3)).otherwise(made(6))
        whole = F.lower(whole)
        out = out.when(pool == name, whole)
        for f in female:  # Slavic surnames of women end in a vowel
            out = out.when(pool == f, F.concat(whole, F.lit("а")) if "cyrillic" in f else whole)
    return out


def parts_of(entity: Column) -> Column:
    """The entity's units: structs of pre (text before it, kept), kind, canon, part (the
    text to replace) and gender (of a name, by its title). A card or IBAN whose check
    digits are wrong is none: its only unit has the kind null."""
    kind = reduce(lambda c, k: c.when(entity.rlike(rf"^(?:{KINDS[k]})$"), k), KINDS, F.when(F.lit(False), ""))
    unit = lambda pre, kind, canon, part, gender=F.lit("u"): F.struct(pre.alias("pre"), kind.alias("kind"), canon.alias("canon"), part.alias("part"), gender.alias("gender"))
    only = lambda c, keep: F.regexp_replace(c, f"[^{keep}]", "")
    none = F.lit("")
    country = F.regexp_extract(entity, r"^\+(?:\d{1,3}(?=[ .(-])|[17]|\d\d)", 0)
    rest = F.substr(entity, F.length(country) + 1)
    label = F.regexp_extract(entity, rf"^(?:{_LABEL}|AKIA)", 0)
    value = F.substr(entity, F.length(label) + 1)
    head = F.regexp_extract(entity, f"^{_TITLES}", 0)
    words, titles = F.split(F.substr(entity, F.length(head) + 1), " "), F.split(F.regexp_replace(head, r"\.? ", " "), " ")
    said = lambda listed: F.arrays_overlap(titles, F.array(*map(F.lit, listed)))
    gender = F.when(said(FEMALE_TITLES), "f").when(said(MALE_TITLES), "m").otherwise("u")

    def name_unit(w: Column, i: Column) -> Column:
        script = F.when(w.rlike(r"^\p{IsCyrillic}"), "cyrillic").otherwise("latin")
        last = i == F.size(words) - 1
        pre = F.when(i == 0, head).otherwise(" ")
        return unit(pre, F.concat(F.when(last, "surname_").otherwise("given_"), script), F.lower(w), w, gender)

    names = F.transform(words, name_unit)
    numbers, bank = only(entity, "0-9"), only(entity, "A-Z0-9")
    valid = F.when(kind == "card", luhn(numbers) == 0).when(kind == "iban", iban_rest(bank) == 1).otherwise(True)
    domain = F.substring_index(entity, "@", -1)
    mail = F.array(unit(none, F.lit("mailbox"), F.lower(entity), F.substring_index(entity, "@", 1)), unit(F.lit("@"), F.lit("domain"), F.lower(domain), domain))
    one = F.array(
        F.when(~valid, unit(none, F.lit(None).cast("string"), entity, entity))
        .when(kind == "phone", unit(country, kind, only(rest, "0-9"), rest))
        .when(kind == "secret", unit(label, kind, value, value))
        .when(kind.isin("card", "ssn"), unit(none, kind, numbers, entity))
        .when(kind == "iban", unit(none, kind, bank, entity))
        .otherwise(unit(none, F.coalesce(kind, F.lit("secret")), F.lower(entity), entity))
    )
    return F.when(kind == "name", names).when(kind == "email", mail).otherwise(one)


def in_format(part: Column, kind: Column, new: Column) -> Column:
    """The surrogate written as the part was: its separators, or its case."""
    filled = F.array_join(
        F.transform(
            F.split(part, ""),
            lambda c, i: F.when(c.rlike("[A-Za-z0-9]"), F.substr(new, F.length(F.regexp_replace(F.substr(part, F.lit(1), i + 1), "[^A-Za-z0-9]", "")), F.lit(1))).otherwise(c),
        ),
        "",
    )
    name = kind.startswith("given_") | kind.startswith("surname_")
    cased = F.when((part == F.upper(part)) & (part != F.lower(part)), F.upper(new)).when(name, F.initcap(new)).otherwise(new)
    return F.when(kind.isin("phone", "card", "ssn", "iban"), filled).when(kind == "secret", new).otherwise(cased)


def surrogates(units: DataFrame, key: str = KEY) -> DataFrame:
    """kind, canon, new for all distinct (kind, canon): distinct within a space, and none
    a canon of it. A space is a kind, but given and family names of a script are one, so
    that nobody's surrogate is another's name. Units that collide try again, the least
    canon keeps the surrogate.

    A name's gender is that of its titles in the whole corpus, if they agree: names of
    both genders and of none are one kind, so they are kept distinct as well."""
    told = units.groupBy("kind", "canon").agg(F.bool_or(F.col("gender") == "f").alias("f"), F.bool_or(F.col("gender") == "m").alias("m"))
    gender = F.when(F.col("f") & ~F.col("m"), "f").when(F.col("m") & ~F.col("f"), "m").otherwise("u")
    script, given = F.substring_index("kind", "_", -1), F.col("kind").startswith("given_")
    pool = F.when(given, F.concat(F.lit("given_"), gender, F.lit("_"), script))
    pool = pool.when((F.col("kind") == "surname_cyrillic") & (gender == "f"), "surname_f_cyrillic").otherwise(F.col("kind"))
    space = F.when(given | F.col("kind").startswith("surname_"), F.concat(F.lit("name_"), script)).otherwise(F.col("kind"))
    units = write_table(told.select("kind", "canon", pool.alias("pool"), space.alias("space")), "pii-units")
    pending, done = units, None
    for attempt in range(ATTEMPTS):
        tried = pending.withColumn("attempt", F.lit(attempt)).withColumn("new", candidate(key)).drop("attempt")
        tried = tried.join(units.select("space", F.col("canon").alias("new")), ["space", "new"], "left_anti")
        if done is not None:
            tried = tried.join(done.select("space", "new"), ["space", "new"], "left_anti")
        won = tried.groupBy("space", "new").agg(F.min(F.struct("canon", "kind")).alias("won"))
        won = write_table(won.select("space", "won.kind", "won.canon", "new"), "pii-new")
        done = won if done is None else done.unionByName(won)
        last, pending = pending, write_table(pending.join(won, ["kind", "canon"], "left_anti"), "pii-left")
        if attempt:
            drop_table(last)
        if pending.isEmpty():
            return done.drop("space")
    raise ValueError(f"no free surrogates after {ATTEMPTS} attempts for kinds {[r[0] for r in pending.select('kind').distinct().limit(20).collect()]}")


def replace_pii(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", key: str = KEY) -> DataFrame:
    """docs with personal data in the text replaced, and ``entities``, how many were.

    Kinds: email, IPv4 address, US social security number, phone and card number, IBAN,
    passwords and access keys (all up to the quote or white space behind them, of any
    length), names after a title, and in the same text the words of such names without
    one. Cards and IBANs are replaced only if their check digits are right, and then
    those of the surrogate are; emails end in a reserved domain and keep one domain for
    one; names keep gender, script and case. The same key gives the same surrogates.

    Null and empty texts stay and have 0 entities; null ids are allowed; repeated rows
    are treated alike. A column ``entities`` is replaced, all others stay."""
    has = F.when(F.col(text).rlike(HINT), F.col(text).rlike(PATTERN)).otherwise(False)
    found = docs.where(has).select(F.col(doc_id).alias("id"), F.xxhash64(text).alias("th"), F.posexplode(F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))).alias("pos", "entity"))
    found = write_table(found, "pii-found")
    parts = found.select("entity").distinct().select("entity", F.posexplode(parts_of(F.col("entity"))).alias("i", "u")).select("entity", "i", "u.*")
    parts = write_table(parts, "pii-parts")
    named = parts.join(surrogates(parts.where("kind IS NOT NULL"), key), ["kind", "canon"], "left")
    new = F.when(F.col("kind").isNull(), F.col("part")).otherwise(in_format(F.col("part"), F.col("kind"), F.col("new")))
    word = F.col("kind").startswith("given_") | F.col("kind").startswith("surname_")
    named = named.select("entity", "i", "pre", new.alias("new"), F.col("kind").isNotNull().alias("real"), F.when(word, F.col("part")).alias("name"))
    # an entity has at most a few units
    named = named.groupBy("entity").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", F.concat("pre", "new").alias("new")))), lambda x: x["new"]), "").alias("new"),
        F.bool_and("real").alias("real"), F.collect_list(F.when(F.col("name").isNotNull(), F.struct("name", "new"))).alias("names"),
    )
    # no more rows than the text has entities
    told = found.join(named, "entity").groupBy("id", "th").agg(
        F.sort_array(F.collect_set(F.struct("pos", "new", "real"))).alias("at"), F.array_distinct(F.flatten(F.collect_set("names"))).alias("names")
    )
    rest = [c for c in docs.columns if c != "entities"]
    dirty = docs.where(has).alias("d").join(told.alias("t"), F.col(f"d.{doc_id}").eqNullSafe(F.col("t.id")) & (F.xxhash64(f"d.{text}") == F.col("t.th")))
    pieces = F.split(F.col(f"d.{text}"), PATTERN, -1)
    # between the entities, the words of names that the text has with a title, and those in
    # capitals; no surrogate is a name of the corpus, so none is replaced again
    forms = lambda x: F.array(x, F.struct(F.upper(x["name"]).alias("name"), F.upper(x["new"]).alias("new")))
    mention = lambda s, x: F.regexp_replace(s, F.concat(F.lit(r"(?<![\p{L}\d@._-])\Q"), x["name"], F.lit(r"\E(?![\p{L}\d@_-])")), x["new"])
    plain = lambda p: F.aggregate(F.array_distinct(F.flatten(F.transform("t.names", forms))), p, mention)
    joined = F.array_join(F.flatten(F.zip_with(pieces, F.col("t.at"), lambda p, n: F.array(plain(p), F.coalesce(n["new"], F.lit(""))))), "")
    real = F.size(F.filter("t.at", lambda x: x["real"])).cast("long")
    dirty = dirty.select(*(joined.alias(c) if c == text else F.col(f"d.{c}") for c in rest), real.alias("entities"))
    return docs.where(~has).select(*rest, F.lit(0).cast("long").alias("entities")).unionByName(dirty)


def op1_pii_surrogates(spark, sf_dir: str) -> DataFrame:
    """Every document with its personal data replaced, and how many entities there were."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return replace_pii(docs)
