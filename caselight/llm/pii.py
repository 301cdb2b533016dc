"""Personal data: detected entities get keyed surrogates of the same type and format, distinct for distinct values."""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lookup, stored

#: Given names by gender and script, which tell names without any other sign and the gender of their bearers.
NAMES = {
    ("f", "latin"): "Emma Anna Maria Laura Julia Sarah Sophie Marie Claire Lucía Carmen Elena Katharina Johanna Alice Emily Olivia Jane Mary Linda Ann Anne Lena Lisa Sofia Isabel Giulia Susan Karen Nancy Eva Clara Nina Petra".split(),
    ("m", "latin"): "John James Robert Michael David Peter Thomas Paul Pierre Jean Luis Carlos José Miguel Hans Karl Jürgen Stefan Daniel Andrew Giovanni Marco Henry Jack Tom George William Richard Pablo Juan Jorge Jacques Louis Klaus Wolfgang Martin Walter".split(),
    ("f", "cyrillic"): "Анна Мария Елена Ольга Наталья Ирина Татьяна Светлана Екатерина Юлия".split(),
    ("m", "cyrillic"): "Иван Пётр Алексей Сергей Дмитрий Николай Андрей Михаил Владимир Олег".split(),
}
#: What stands before a name, as a title or as a label.
TITLES = "Mr Mrs Ms Miss Dr Prof Herr Frau Señor Señora Sr Sra Don Doña Monsieur Madame Mme Mlle Господин Госпожа".split()
LABELS = ("name is ", "Name is ", "name: ", "Name: ", "Ich heiße ", "ich heiße ", "e llamo ", "m'appelle ", "еня зовут ")
#: Capitalised words that follow a name without being part of it.
NO_SURNAMES = "And Or But The A An In On At Is Was He She It They We You I Und Oder Der Die Das Ein Eine Ist War Er Sie Et Ou Le La Les Un Une Est El Los Las Y Es И В На Он Она".split()
#: The syllables of invented names, and the ends of given names (by gender) and of surnames.
SYLLABLES = {
    "latin": "ba be bi bo da de di do fa fe fi ga ge go ka ke ki ko la le li lo ma me mi mo na ne ni no pa pe ra re ri ro sa se si ta te ti to va ve vi za".split(),
    "cyrillic": "ба бе би бо да де ди до га го ка ки ко ла ле ли ло ма ме ми мо на не ни но па пе ра ре ри ро са се си та те ти то ва ве ви за".split(),
}
ENDINGS = {("f", "latin"): "na", ("m", "latin"): "n", ("f", "cyrillic"): "на", ("m", "cyrillic"): "н", ("s", "latin"): "ler", ("sf", "cyrillic"): "рова", ("s", "cyrillic"): "ров"}
#: What is found, in the order in which alternatives are tried.
_B, _E = r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])"
_CAP = r"(?:\p{Lu}[\p{Ll}'’]+(?:-\p{Lu}\p{Ll}+)?|\p{Lu}{2,})"
_MORE = rf"(?: (?!(?:{'|'.join(NO_SURNAMES)}){_E}){_CAP})"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
_GIVEN = "|".join(form for names in NAMES.values() for n in names for form in (n, n.upper()))
_DATE = r"(?:\d{4}-\d{2}-\d{2}|\d{1,2}[./]\d{1,2}[./]\d{4})"
PATTERNS = (
    ("email", r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]+@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)+"),
    ("iban", rf"{_B}[A-Z]{{2}}\d{{2}}(?: ?[A-Z0-9]{{4}}){{3,7}}(?: ?[A-Z0-9]{{1,3}})?{_E}"),
    ("card", rf"{_B}\d{{4}}(?:[ -]?\d{{4}}){{3}}{_E}"),
    ("ip", rf"(?<![\p{{L}}\p{{N}}.]){_OCTET}(?:\.{_OCTET}){{3}}(?![\p{{L}}\p{{N}}]|\.\d)"),
    ("ssn", r"(?<![\p{L}\p{N}-])\d{3}-\d{2}-\d{4}(?![\p{L}\p{N}-])"),
    ("date", rf"(?<=(?:[Bb]orn|DOB|dob|of birth|geboren|eburtsdatum|nacid[oa]|naissance|née?|родил(?:ся|ась)).{{0,12}}){_B}{_DATE}{_E}"),
    ("address", rf"{_B}\d{{1,5}},? (?:{_CAP} ){{1,2}}(?:Street|St|Road|Rd|Avenue|Ave|Lane|Drive|Boulevard|Blvd){_E}|{_B}\d{{1,4}},? (?:rue|avenue|boulevard|place) (?:de |du |des |de la )?{_CAP}{_E}"),
    ("street", rf"{_B}\p{{Lu}}\p{{Ll}}++(?<=straße|strasse|gasse|weg|platz) \d{{1,4}}[a-z]?{_E}|{_B}(?:Calle|Avenida|Plaza) (?:de |del |de la )?{_CAP},? \d{{1,4}}{_E}"),
    ("phone", rf"(?<![\p{{L}}\p{{N}}+])(?:\+?\d{{1,3}}[ .-]?\(?\d{{2,4}}\)?[ .-]\d{{3,4}}[ .-]?\d{{3,4}}|\+\d{{9,14}}|0\d(?:[ .]\d{{2}}){{4}}){_E}"),
    ("name", rf"{_B}(?:{_GIVEN}){_MORE}?{_E}|(?<={_B}(?:{'|'.join(TITLES)})\.? ){_CAP}{_MORE}{{0,2}}{_E}|(?<=(?:{'|'.join(LABELS)})){_CAP}{_MORE}{{0,2}}{_E}"),
)
#: Which kinds can begin with a capital, and which with a digit or a sign: a look at one character spares most places the others.
_STARTS = ((r"(?=\p{Lu})", ("iban", "street", "name")), (r"(?=[0-9+])", ("card", "ip", "ssn", "date", "address", "phone")))
_BY_KIND = dict(PATTERNS)
ANY = "|".join([_BY_KIND["email"], *(f"{look}(?:{'|'.join(_BY_KIND[k] for k in kinds)})" for look, kinds in _STARTS)])
SIEVE = rf"[0-9@]|(?=\p{{Lu}}){_B}(?:{_GIVEN}|{'|'.join(TITLES)}){_E}"
#: Stands on both sides of an entity while a text is cut; texts that have this character themselves are cut in another way.
MARK = "\ue0ff"
#: Rounds of the permutations of digits, days and addresses.
ROUNDS = 8
#: Days from 1900 on that birth dates are permuted among, as two coordinates.
DAYS = (233, 235)


def kind_of(value: Column) -> Column:
    """The first pattern that the whole value fulfils; dates and names are told by what stands before them, so names are the rest."""
    tests = [("address" if kind == "street" else kind, _DATE if kind == "date" else p) for kind, p in PATTERNS[:-1]]
    return F.coalesce(*[F.when(value.rlike(f"^(?:{p})$"), kind) for kind, p in tests], F.lit("name"))


def _keyed(key: str, *parts: Column) -> Column:
    """60 bits of the MD5 of the key and some values, as a long."""
    text = F.concat_ws("\x1f", F.lit(key), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def _permuted(left: Column, right: Column, a: Column, b: Column, key: str, kind: Column) -> Column:
    """A keyed permutation of the pairs (left < a, right < b), as a struct: distinct pairs stay distinct."""

    def step(s: Column, i: Column) -> Column:
        first = F.struct(F.pmod(s["l"] + _keyed(key, kind, i, a, b, s["r"]), a).alias("l"), s["r"].alias("r"))
        second = F.struct(s["l"].alias("l"), F.pmod(s["r"] + _keyed(key, kind, i, a, b, s["l"]), b).alias("r"))
        return F.when(i % 2 == 0, first).otherwise(second)

    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step)


def _power(n: Column) -> Column:
    return F.rpad(F.lit("1"), n + 1, F.lit("0")).cast("long")


def _digits(digits: Column, key: str, kind: Column) -> Column:
    """A keyed permutation of the strings of up to 36 digits of one length."""
    n = F.length(digits)
    half = F.floor(n / 2).cast("int")
    left = F.when(half == 0, F.lit(0)).otherwise(F.substring(digits, F.lit(1), half).cast("long"))
    made = _permuted(left, F.substring(digits, half + 1, n), _power(half), _power(n - half), key, kind)
    return F.concat(F.when(half == 0, "").otherwise(F.lpad(made["l"].cast("string"), half, F.lit("0"))), F.lpad(made["r"].cast("string"), n - half, F.lit("0")))


def _filled(surface: Column, made: Column, pattern: str) -> Column:
    """The characters of surface that fulfil the pattern become those of made, in order; all others stay."""
    start = F.struct(F.lit(0).alias("i"), F.lit("").alias("out"))

    def step(s: Column, c: Column) -> Column:
        own = c.rlike(pattern)
        return F.struct((s["i"] + own.cast("int")).alias("i"), F.concat(s["out"], F.when(own, F.substring(made, s["i"] + 1, F.lit(1))).otherwise(c)).alias("out"))

    return F.aggregate(F.split(surface, ""), start, step, lambda s: s["out"])


def _luhn(digits: Column) -> Column:
    """The sum of Luhn's formula over a string of digits, the last of which isn't doubled."""

    def worth(c: Column, i: Column) -> Column:
        d = c.cast("int") * (1 + (i % 2))
        return d - F.when(d > 9, 9).otherwise(0)

    return F.aggregate(F.transform(F.reverse(F.split(digits, "")), worth), F.lit(0), lambda a, b: a + b)


def _mod97(code: Column) -> Column:
    """The rest by 97 of an account number without its check digits, with its country and 00 at the end, as the standard has it."""
    turned = F.concat(F.substring(code, F.lit(5), F.length(code)), F.substring(code, 1, 2), F.lit("00"))
    worth = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.split(turned, ""), F.lit(0), lambda s, c: F.pmod(s * F.when(worth(c) > 9, 100).otherwise(10) + worth(c), F.lit(97)))


def _shaped(value: Column, digest: Column, more: Column) -> Column:
    """Digits become digits and letters letters of the same script; `more` letters are added."""

    def one(c: Column, i: Column) -> Column:
        n = F.conv(F.substring(digest, i % 61 + 1, F.lit(4)), 16, 10).cast("int") + i
        pick = lambda alphabet: F.substring(F.lit(alphabet), n % len(alphabet) + 1, F.lit(1))
        made = F.when(c.rlike("^[0-9]$"), pick("0123456789")).when(c.rlike("^[A-Z]$"), pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
        made = made.when(c.rlike(r"^\p{IsCyrillic}$"), pick("абвгдежзийклмнопрстуфхцчшэюя")).when(c.rlike(r"^\p{L}$"), pick("abcdefghijklmnopqrstuvwxyz"))
        return F.coalesce(made, c)

    return F.array_join(F.transform(F.split(F.concat(value, F.repeat(F.lit("a"), more)), ""), one), "")


def _invented(word: Column, digest: Column, more: Column) -> Column:
    """A name word's surrogate: of its gender and script, of three syllables and `more`."""
    cyrillic = word.rlike(r"\p{IsCyrillic}")
    script = F.when(cyrillic, "cyrillic").otherwise("latin")
    gender = F.when(F.substring(word, 1, 1) == "=", F.when(cyrillic & word.rlike("[ая]$"), "sf").otherwise("s"))
    for (g, _), names in NAMES.items():
        gender = F.coalesce(gender, F.when(word.isin(*[n.lower() for n in names]), g))
    gender = F.coalesce(gender, F.when(word.rlike("[aая]$"), "f").otherwise("m"))
    table = lambda s: F.array(*[F.lit(x) for x in SYLLABLES[s]])
    syllables = F.when(cyrillic, table("cyrillic")).otherwise(table("latin"))
    pick = lambda i: F.element_at(syllables, (F.conv(F.substring(digest, i * 5 % 59 + 1, F.lit(5)), 16, 10).cast("int") % F.size(syllables) + 1).cast("int"))
    body = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(2) + more), pick), "")
    end = F.coalesce(*[F.when((script == s) & (gender == g), e) for (g, s), e in ENDINGS.items()], F.lit("ler"))
    return F.concat(body, end)


def atoms_of(kind: Column, value: Column) -> Column:
    """What of a value gets a surrogate of its own, in canonical form: an address's local part with its domain, and the domain; the words of a
    name (surnames with a = before them); the digits or letters of all else."""
    low = F.lower(value)
    email = F.array(low, F.regexp_extract(low, "@(.*)$", 1))
    words = F.split(low, " ")
    given = F.array(*[F.lit(n.lower()) for names in NAMES.values() for n in names])
    name = F.transform(words, lambda w, i: F.when(F.array_contains(given, w) | (i == 0) & (F.size(words) > 1), w).otherwise(F.concat(F.lit("="), w)))
    bare = F.upper(F.regexp_replace(value, r"[^\p{L}\p{N}]", ""))
    return F.when(kind == "email", email).when(kind == "name", name).when(kind.isin("ip", "date", "address"), F.array(low)).otherwise(F.array(bare))


def made_by_hash(atoms: DataFrame, key: str) -> DataFrame:
    """Adds made to (kind, atom, attempt) of kinds without a permutation; each attempt has more letters to choose from."""
    kind, atom, digest = F.col("kind"), F.col("atom"), F.col("digest")
    df = atoms.withColumn("digest", F.sha2(F.concat_ws("\x1f", F.lit(key), kind, atom, F.col("attempt").cast("string")).cast("binary"), 256))
    local = F.regexp_replace(atom, "@.*$", "")
    domain = F.regexp_replace(atom, r"\.[^.]*$", "")
    made = F.when(kind == "email", _shaped(local, digest, F.col("attempt"))).when(kind == "domain", F.concat(_shaped(domain, digest, F.col("attempt")), F.regexp_extract(atom, r"(\.[^.]*)$", 1)))
    made = made.when(kind == "iban", F.concat(F.substring(atom, 1, 2), F.lit("00"), _shaped(F.substring(atom, F.lit(5), F.length(atom)), digest, F.lit(0))))
    return df.withColumn("made", made.otherwise(_invented(atom, digest, F.col("attempt")))).drop("digest")


def _space(kind: Column, made: Column, atom: Column) -> Column:
    """Surrogates of different spaces can't be taken for each other: those of addresses count with their real domain."""
    return F.when(kind == "email", F.concat(made, F.regexp_extract(atom, "(@.*)$", 1))).otherwise(F.concat(kind, F.lit(":"), made))


def hashed_surrogates(atoms: DataFrame, key: str) -> DataFrame:
    """Distinct (kind, atom, n) to (kind, atom, n, made): no two atoms share a surrogate, and no invented name is a found one.

    Of atoms that meet in a surrogate the smallest keeps it, the others are made anew with more letters, so that their space grows
    with each round and no number of values uses it up.
    """
    columns = ["kind", "atom", "n", "attempt", "made"]
    named = lambda df: made_by_hash(df, key).select(*columns)
    now = stored(named(atoms.withColumn("attempt", F.lit(0))), "surrogates")
    real = atoms.where("kind = 'name'").select(F.concat(F.lit("name:"), F.regexp_replace("atom", "^=", "")).alias("space")).distinct().withColumn("real", F.lit(True))
    for _ in count():
        spaced = now.withColumn("space", _space(F.col("kind"), F.col("made"), F.col("atom")))
        first = spaced.groupBy("space").agg(F.min(F.struct("attempt", "kind", "atom")).alias("first"), F.count("*").alias("sharers"))
        first = first.join(real, "space", "left").where("sharers > 1 or real")
        clash = spaced.join(first, "space").where(F.col("real") | (F.col("first.atom") != F.col("atom")) | (F.col("first.kind") != F.col("kind")))
        clash = stored(clash.select("kind", "atom"), "clashes")
        if not clash.limit(1).count():
            return now.select("kind", "atom", "n", "made")
        moved = now.join(clash, ["kind", "atom"], "left_semi").withColumn("attempt", F.col("attempt") + 1)
        now = stored(now.join(clash, ["kind", "atom"], "left_anti").select(*columns).unionByName(named(moved)), "surrogates")


def permuted_surrogates(atoms: DataFrame, key: str) -> DataFrame:
    """(kind, atom, n) of digits, addresses of hosts and dates to (kind, atom, n, made), by permutations of their whole spaces."""
    kind, atom = F.col("kind"), F.col("atom")
    octets = F.split(atom, r"\.")
    two = lambda i: F.element_at(octets, i).cast("long") * 256 + F.element_at(octets, i + 1).cast("long")
    big = F.lit(65_536).cast("long")
    df = atoms.withColumn("host", F.when(kind == "ip", _permuted(two(1), two(3), big, big, key, kind)))
    host = F.concat_ws(".", *[x for h in ("l", "r") for x in (F.floor(F.col("host")[h] / 256), F.col("host")[h] % 256)])
    parts = F.split(atom, "[-./]")
    y, m, d = ((F.element_at(parts, F.when(atom.rlike(r"^\d{4}-"), i).otherwise(4 - i))).cast("int") for i in (1, 2, 3))
    born = F.coalesce(F.make_date(F.when((y > 1899) & (y < 2050), y), F.when((m < 13) & (m > 0), m), F.when((d > 0) & (d < 29), d)), F.make_date(F.when((y > 1899) & (y < 2050), y), F.lit(1), F.lit(1)), F.to_date(F.lit("1950-01-01")))
    day = F.pmod(F.datediff(born, F.to_date(F.lit("1900-01-01"))), F.lit(DAYS[0] * DAYS[1]))
    rows, columns = (F.lit(x).cast("long") for x in DAYS)
    df = df.withColumn("day", F.when(kind == "date", _permuted(F.floor(day / DAYS[1]), day % DAYS[1], rows, columns, key, kind)))
    new = F.date_add(F.to_date(F.lit("1900-01-01")), (F.col("day")["l"] * DAYS[1] + F.col("day")["r"]).cast("int"))
    date = F.when(atom.rlike(r"^\d{4}-"), F.date_format(new, "yyyy-MM-dd")).when(atom.contains("/"), F.date_format(new, "dd/MM/yyyy")).otherwise(F.date_format(new, "dd.MM.yyyy"))
    keep = F.when(kind.isin("card", "phone"), 1).otherwise(0)
    inner = F.substring(atom, keep + 1, F.length(atom) - keep - F.when(kind == "card", 1).otherwise(0))
    number = F.when(kind.isin("card", "phone", "ssn"), F.concat(F.substring(atom, F.lit(1), keep), _digits(inner, key, kind)))
    df = df.withColumn("number", number)
    old = (10 - _luhn(F.concat(F.substring(atom, 1, 15), F.lit("0"))) % 10) % 10
    now = (10 - _luhn(F.concat(F.col("number"), F.lit("0"))) % 10) % 10
    check = F.when(kind == "card", F.pmod(F.substring(atom, 16, 1).cast("int") - old + now, F.lit(10)).cast("string"))
    df = df.withColumn("check", check)
    made = F.when(kind == "ip", host).when(kind == "date", date).when(kind == "card", F.concat("number", "check")).otherwise(F.col("number"))
    return df.select("kind", "atom", "n", made.alias("made"))


def _cased(surface: Column, made: Column) -> Column:
    return F.when((surface == F.upper(surface)) & (F.length(surface) > 1), F.upper(made)).when(F.substring(surface, 1, 1) == F.upper(F.substring(surface, 1, 1)), F.initcap(made)).otherwise(made)


def composed(kind: Column, value: Column, made: Column, key: str) -> Column:
    """A value's surrogate from those of its atoms, in the format of the value."""
    email = F.concat(F.element_at(made, 1), F.lit("@"), F.element_at(made, 2))
    email = F.when(value == F.upper(value), F.upper(email)).otherwise(email)
    name = F.array_join(F.zip_with(F.split(value, " "), made, _cased), " ")
    first = F.element_at(made, 1)
    account = F.concat(F.substring(first, 1, 2), F.lit("00"), F.substring(first, F.lit(5), F.length(first)))
    own = F.upper(F.regexp_replace(value, " ", ""))
    offset = F.substring(own, 3, 2).cast("int") - (98 - _mod97(own))
    check = F.pmod(98 - _mod97(account) + offset, F.lit(97))  # valid if the value is, else as far off
    iban = F.concat(F.substring(first, 1, 2), F.lpad(F.when(check < 2, check + 97).otherwise(check).cast("string"), 2, "0"), F.substring(first, F.lit(5), F.length(first)))
    street = F.regexp_extract(value, r"(\p{Lu}\p{L}*?)(?= (?:Street|St|Road|Rd|Avenue|Ave|Lane|Drive|Boulevard|Blvd)$|straße|strasse|gasse|weg|platz|,? \d+$|$)", 1)
    house = F.regexp_extract(value, r"(\d+)", 1)
    number = _keyed(key, F.lower(value))
    address = F.regexp_replace(F.replace(value, street, F.initcap(first)), r"\d+", F.greatest(F.lit(1), F.pmod(number, _power(F.length(house)))).cast("string"))
    return (
        F.when(kind == "email", email).when(kind == "name", name).when(kind.isin("ip", "date"), first).when(kind == "address", address)
        .when(kind == "iban", _filled(value, iban, "[A-Z0-9]")).otherwise(_filled(value, first, "[0-9]"))
    )


def surrogates(values: DataFrame, key: str) -> DataFrame:
    """Distinct (kind, value, n) to (value, n, surrogate). The spellings of one value get the surrogates of one value."""
    each = values.select("kind", "value", "n", F.posexplode(atoms_of(F.col("kind"), F.col("value"))).alias("at", "atom"))
    each = stored(each.withColumn("own", F.when((F.col("kind") == "email") & (F.col("at") == 1), "domain").otherwise(F.col("kind"))), "atoms")
    atoms = stored(each.groupBy(F.col("own").alias("kind"), "atom").agg(F.count("*").alias("n")), "distinct-atoms")
    fixed = F.col("kind").isin("ip", "date", "card", "phone", "ssn")
    made = permuted_surrogates(atoms.where(fixed), key).unionByName(hashed_surrogates(atoms.where(~fixed), key))
    made = stored(made.select(F.concat_ws(":", "kind", "atom").alias("id"), "made", F.col("n").alias("uses")), "made-atoms")
    named = lookup(each.withColumn("id", F.concat_ws(":", "own", "atom")), made, "id", "uses", each.count())
    lists = named.groupBy("kind", "value", "n").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "made"))), lambda x: x["made"]).alias("made"))
    return lists.select("value", "n", composed(F.col("kind"), F.col("value"), F.col("made"), key).alias("surrogate"))


def anonymise(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, n_entities) of every row: entities are replaced, the same value by the same surrogate everywhere.

    E-mail addresses, IBANs, card numbers, IPv4 addresses, social security numbers, birth dates, street addresses, phone numbers and
    names are found: names by a listed given name, a title or a label before them, and surnames so found wherever they stand in the
    same text. Spellings that differ in case or separators are one value. Cards and accounts stay valid (or not) by their check
    digits, domains are replaced alike in all addresses, names keep gender and script, all else its format. Distinct values keep
    distinct surrogates: numbers, hosts and dates by a permutation of their space, others by checks for clashes.

    Null text stays null with no entities; empty texts stay. Null ids and repeated rows stay. Other columns are ignored. Empty
    table: no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    labelled = [F.contains("text", F.lit(label)) for label in LABELS]
    doubtful = F.coalesce(F.col("text").rlike(SIEVE) | reduce(Column.__or__, labelled), F.lit(False))

    def cut(pattern: Column) -> tuple[Column, Column]:
        """(gaps, found): one scan of the text puts marks around entities, by which it is split."""
        parts = F.split(F.regexp_replace("text", F.concat(F.lit("(?s)(?:"), pattern, F.lit(")")), F.lit(f"{MARK}$0{MARK}")), MARK, -1)
        own = lambda k: F.transform(F.filter(F.transform(parts, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda s: s["i"] % 2 == k), lambda s: s["x"])
        # \G: after the last match no other start is tried
        group = lambda k: F.regexp_extract_all("text", F.concat(F.lit(r"(?s)\G(.*?)("), pattern, F.lit(")")), F.lit(k))
        marked = F.contains("text", F.lit(MARK))
        even = own(0)
        gaps = F.when(marked, group(1)).otherwise(F.slice(even, 1, F.greatest(F.size(even) - 1, F.lit(0))))
        return gaps.alias("gaps"), F.when(marked, group(2)).otherwise(own(1)).alias("found")

    first = stored(rows.where(doubtful).select("doc_id", "text", *cut(F.lit(ANY))), "first-entities")
    given = F.array(*[F.lit(form) for names in NAMES.values() for n in names for form in (n, n.upper())])
    multi = F.filter("found", lambda v: v.rlike(rf"^{_CAP}(?: {_CAP})*$"))
    surnames = F.array_distinct(F.filter(F.flatten(F.transform(multi, lambda v: F.split(v, " "))), lambda w: ~F.array_contains(given, w)))
    again = first.withColumn("surnames", surnames)
    quoted = F.array_join(F.transform("surnames", lambda w: F.concat(F.lit(r"\Q"), w, F.lit(r"\E"))), "|")
    wider = F.concat(F.lit(ANY + rf"|{_B}(?:"), quoted, F.lit(rf"){_E}"))
    more = again.where(F.size("surnames") > 0).select("doc_id", "text", *cut(wider))
    parts = again.where(F.size("surnames") == 0).select("doc_id", "text", "gaps", "found").unionByName(more)
    parts = stored(parts.withColumn("row", F.monotonically_increasing_id()), "entities")  # stored: the numbers stay as they are
    each = parts.select("row", F.posexplode("found").alias("at", "value"))
    values = each.groupBy("value").agg(F.count("*").alias("n")).withColumn("kind", kind_of(F.col("value")))
    made = stored(surrogates(values.select("kind", "value", "n"), key), "made")
    named = lookup(each, made, "value", "n", each.count())
    lists = named.groupBy("row").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "surrogate"))), lambda x: x["surrogate"]).alias("made"))
    joined = parts.join(lists, "row", "left")
    length = F.aggregate(F.concat("gaps", "found"), F.lit(0), lambda n, x: n + F.length(x))
    tail = F.expr("substring(text, used + 1)")
    woven = F.concat(F.array_join(F.zip_with("gaps", "made", lambda g, m: F.concat(g, m)), ""), tail)
    changed = joined.withColumn("used", length).select("doc_id", F.when(F.col("made").isNull(), F.col("text")).otherwise(woven).alias("text"), F.size("found").cast("long").alias("n_entities"))
    return changed.unionByName(rows.where(~doubtful).select("doc_id", "text", F.lit(0).cast("long").alias("n_entities")))
