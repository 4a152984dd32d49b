"""Surrogates for personal data, in DataFrame operations only.

Mentions are found by one pattern. What they denote is their canonical form (digits of a number, lower-cased
address or name), so all mentions of one entity get one surrogate, each in the mention's own format. A
surrogate is made of keyed digests and is of the entity's type: numbers keep their length, punctuation,
country and exchange digits and a valid check digit; addresses keep their shape and top-level domain; names
keep gender, script and case. A given or family name that stands alone, or behind a title, in a text that has
the full name follows the full name's surrogate.

Distinct entities get distinct surrogates, none of which occurs as a real entity: what collides is drawn
again, names from a longer and longer supply of syllables. Where a kind of entity is so crowded that draws
fail (most numbers of its shape are real), its entities that are left exchange their values in keyed cycles:
still distinct, never their own, and always possible.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Given names by script and gender. The names that are recognised and handed out.
NAMES = {
    ("latin", "f"): "Alice Anna Beatrice Carla Charlotte Clara Claire Elena Elisa Emma Greta Helena Irene Isabel "
    "Julia Laura Lucia Maria Marie Martha Monica Nadia Nora Olivia Paula Rosa Sara Sophie Teresa Vera",
    ("latin", "m"): "Adam Albert Andreas Anton Bruno Carlos Daniel David Edgar Felix Frank George Henry Hugo Ivan "
    "Jacob James John Jonas Karl Leon Lucas Martin Michael Oscar Paul Peter Robert Thomas Victor",
    ("cyrillic", "f"): "Анна Вера Галина Дарья Елена Ирина Ксения Лидия Мария Наталья Ольга Светлана Татьяна Юлия",
    ("cyrillic", "m"): "Алексей Борис Виктор Григорий Дмитрий Иван Кирилл Михаил Николай Олег Павел Сергей Фёдор Юрий",
    ("greek", "f"): "Αθηνά Άννα Γεωργία Δήμητρα Ειρήνη Ελένη Κατερίνα Μαρία Σοφία Χριστίνα",
    ("greek", "m"): "Αλέξανδρος Ανδρέας Γιώργος Δημήτρης Θανάσης Ιωάννης Κώστας Νίκος Παύλος Πέτρος",
}
#: Family names by script that are handed out; any word of the script after a given name is recognised.
FAMILIES = {
    "latin": "Adler Baker Becker Carter Costa Dubois Fischer Garcia Hansen Keller Lambert Lopez Marino Meyer Moreau "
    "Moreno Novak Olsen Parker Rossi Schmidt Silva Sommer Taylor Turner Vidal Wagner Walker Weber Young",
    "cyrillic": "Бондаренко Гончаренко Коваленко Кравченко Лысенко Мельниченко Павленко Романенко Ткаченко Шевченко",
    "greek": "Αλεξίου Βλάχου Γεωργίου Δημητρίου Ιωάννου Κωνσταντίνου Νικολάου Παπαδάκη Πέτρου Στεφάνου",
}
#: Syllables of generated family names are a consonant and a vowel of the script.
SOUNDS = {
    "latin": ("bdfgklmnprstvwzh", "aeiou"), "cyrillic": ("бвгдзклмнпрстфхш", "аеиоу"), "greek": ("βγδζθκλμνπρστφχ", "αειου"),
}
#: A word behind one of these is a family name, unless it is a known given name.
TITLES = "Mr Mrs Ms Miss Dr Prof Herr Frau".split()
WORD = {"latin": r"[A-Z](?:[’'][A-Z])?[\p{IsLatin}-]+", "cyrillic": r"\p{IsCyrillic}+", "greek": r"\p{IsGreek}+"}


#: Not inside a word or a number: what stands before and behind a mention.
START, END = r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])"


def _trie(names: list[str]) -> str:
    """One pattern for the names that reads every character once."""
    tails: dict[str, list[str]] = {}
    for n in sorted(set(names)):
        tails.setdefault(n[:1], []).append(n[1:])
    alternatives = [c + (_trie(rest) if rest != [""] else "") for c, rest in tails.items() if c]
    return f"(?:{'|'.join(alternatives)})" + "?" * ("" in tails)


def _given(script: str) -> str:
    return _trie([x for (s, _), ns in NAMES.items() if s == script for n in ns.split() for x in (n, n.upper())])


#: Types in the order in which they are tried at a place. A name is a given name and a family name. All but
#: addresses start where no word or number goes on, which is looked at once for all of them.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]{1,64}+@[A-Za-z0-9.-]{1,190}\.[A-Za-z]{2,24}",
    "key": r"AKIA[0-9A-Z]{16}",
    "secret": r"(?=[0-9a-fA-F]{32})(?=[0-9]*+[a-fA-F])(?=[a-fA-F]*+[0-9])[0-9a-fA-F]{32,64}+",
    "iban": r"[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){3,7}(?: ?[0-9A-Z]{1,3})?",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
    "ip": r"(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])",
    "card": r"[0-9]{4}(?:[ -]?[0-9]{4}){2}[ -]?[0-9]{1,7}|3[47][0-9]{2}[ -][0-9]{6}[ -][0-9]{5}",
    "phone": r"\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ .-]?[0-9]{2,4}){2,4}|\([0-9]{3}\) ?[0-9]{3}[.-][0-9]{4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}",
    "title": f"(?:{'|'.join(TITLES)})\\.?[ \u00a0](?!{_given('latin')}[ \u00a0])(?:{WORD['latin']})",
    **{f"name_{s}": _given(s) + "[ \u00a0](?:" + WORD[s] + ")" for s in FAMILIES},
}
_OTHERS = "|".join(f"(?:{p})" for t, p in PATTERNS.items() if t != "email")
EVERY = f"{PATTERNS['email']}|{START}(?:{_OTHERS}){END}"
#: A text that has neither of these has no mention: cheap to tell.
HINTS = ("[0-9@]", START + "(?:" + "|".join([*(_given(s) for s in FAMILIES), f"(?:{'|'.join(TITLES)})\\.?"]) + ")[ \u00a0]")
DIGIT_TYPES = ("ssn", "card", "phone")
#: Draws of an entity before its kind counts as crowded.
DRAWS = 8


def kind(mention: Column) -> Column:
    """The type of a mention: the first pattern that it matches as a whole."""
    first, *rest = PATTERNS.items()
    out = F.when(mention.rlike(f"^(?:{first[1]})$"), first[0])
    for name, pattern in rest:
        out = out.when(mention.rlike(f"^(?:{pattern})$"), name)
    return out.otherwise("secret")


def canonical(type_: Column, mention: Column) -> Column:
    """What is equal for all mentions of an entity."""
    digits = F.regexp_replace(mention, "[^0-9]", "")
    # With and without its country code a North American number is one number.
    digits = F.when((type_ == "phone") & (F.length(digits) == 11) & digits.startswith("1"), F.substr(digits, F.lit(2), F.lit(10))).otherwise(digits)
    plain = F.upper(F.regexp_replace(mention, " ", ""))
    return (
        F.when(type_.isin(*DIGIT_TYPES), digits)
        .when(type_.isin("iban", "key"), plain)
        .when(type_ == "title", F.lower(F.regexp_extract(mention, "[^ \u00a0]+$", 0)))
        .otherwise(F.lower(F.regexp_replace(mention, "\u00a0", " ")))
    )


def _noise(key: str, type_: Column, entity: Column, attempt: Column, block: int) -> Column:
    return F.sha2(F.concat_ws("\x1f", F.lit(key), type_, entity, attempt.cast("string"), F.lit(str(block))), 256)


def _number(noise: Column, i: Column) -> Column:
    """The i-th keyed number (0 to 65535) of a digest string; digests of 256 characters repeat after 64."""
    return F.conv(F.substr(noise, F.pmod(i * 4, F.lit(256)) + 1, F.lit(4)), 16, 10).cast("int")


def _letters(text: Column, noise: Column, hexadecimal: bool = False) -> Column:
    """Each digit replaced by a digit and each letter by a letter of its alphabet and case."""

    def put(c: Column, i: Column) -> Column:
        n = _number(noise, i)
        small = F.substr(F.lit("abcdef" if hexadecimal else "abcdefghijklmnopqrstuvwxyz"), n % (6 if hexadecimal else 26) + 1, F.lit(1))
        return (
            F.when(c.rlike("[0-9]"), (n % 10).cast("string"))
            .when(c.rlike(r"\p{Lu}"), F.upper(small))
            .when(c.rlike(r"\p{L}"), small)
            .otherwise(c)
        )

    return F.array_join(F.transform(F.split(text, ""), put), "")


def _luhn_sum(digits: Column) -> Column:
    """The Luhn sum of digits to which a check digit will be appended."""
    n = F.length(digits)
    chars = F.split(digits, "")

    def weigh(c: Column, i: Column) -> Column:
        d = c.cast("int") * F.when((n - i) % 2 == 1, 2).otherwise(1)
        return F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.transform(chars, weigh), F.lit(0), lambda a, x: a + x)


def surrogate(key: str, type_: Column, entity: Column, attempt: Column) -> Column:
    """A candidate in canonical form."""
    noise = F.concat(*(_noise(key, type_, entity, attempt, b) for b in range(4)))
    drawn = _letters(entity, noise)
    n = F.length(entity)
    body = F.concat(F.substr(entity, F.lit(1), F.lit(1)), F.substr(drawn, F.lit(2), n - 2))
    valid = (_luhn_sum(F.substr(entity, F.lit(1), n - 1)) + F.substr(entity, n, F.lit(1)).cast("int")) % 10 == 0
    card = F.when(valid, F.concat(body, ((10 - _luhn_sum(body) % 10) % 10).cast("string"))).otherwise(F.concat(F.substr(entity, F.lit(1), F.lit(1)), F.substr(drawn, F.lit(2), n - 1)))
    # A telephone number keeps the digits before the last seven but three: country and exchange stay formal.
    keep = F.when(n > 9, 1).otherwise(0)
    phone = F.concat(F.substr(entity, F.lit(1), keep), F.substr(drawn, keep + 1, n - keep))
    ip = F.array_join(
        F.transform(
            F.split(entity, r"\."),
            lambda o, i: F.when(F.length(o) == 3, 100 + _number(noise, i) % 156).when(F.length(o) == 2, 10 + _number(noise, i) % 90).otherwise(_number(noise, i) % 10).cast("string"),
        ),
        ".",
    )
    at = F.length(entity) - F.length(F.substring_index(entity, ".", -1))
    email = F.concat(F.substr(drawn, F.lit(1), at), F.substring_index(entity, ".", -1))
    # An address without a letter or digit to replace, or of a crowded kind, is drawn longer and longer.
    alone = ~F.substr(entity, F.lit(1), at).rlike(r"[0-9\p{L}]") | (attempt >= DRAWS)
    email = F.when(alone, F.concat(F.substr(noise, F.lit(1), F.least(attempt, F.lit(40)) + 4), email)).otherwise(email)
    iban_body = F.concat(F.substr(entity, F.lit(1), F.lit(2)), F.lit("00"), F.substr(drawn, F.lit(5), n - 4))
    iban = F.concat(F.substr(entity, F.lit(1), F.lit(2)), F.lpad((98 - _mod97(iban_body)).cast("string"), 2, "0"), F.substr(iban_body, F.lit(5), n - 4))
    out = (
        F.when(type_ == "email", email)
        .when(type_ == "card", card)
        .when(type_ == "phone", phone)
        .when(type_ == "ip", ip)
        .when(type_ == "iban", iban)
        .when(type_ == "key", F.concat(F.lit("AKIA"), F.substr(drawn, F.lit(5), n)))
        .when(type_ == "secret", _letters(entity, noise, hexadecimal=True))
    )
    out = out.when(type_ == "title", _family("latin", noise, attempt))
    for script in FAMILIES:
        for gender in "fm":
            pool = NAMES[script, gender].lower().split()
            ours = (type_ == f"name_{script}") & F.substring_index(entity, " ", 1).isin(*pool)
            given = F.get(F.array(*map(F.lit, pool)), _number(noise, F.lit(0)) % len(pool))
            out = out.when(ours, F.concat_ws(" ", given, _family(script, noise, attempt)))
    return out.otherwise(drawn)


def _family(script: str, noise: Column, attempt: Column) -> Column:
    """A family name: of the list in the first two attempts, then of two syllables, three, four and so on."""
    listed = FAMILIES[script].lower().split()
    from_list = F.get(F.array(*map(F.lit, listed)), _number(noise, F.lit(1)) % len(listed))
    hard, soft = SOUNDS[script]
    sound = lambda letters, i: F.substr(F.lit(letters), _number(noise, i) % len(letters) + 1, F.lit(1))
    made = F.transform(F.sequence(F.lit(1), F.floor(attempt / 2).cast("int") + 1), lambda i: F.concat(sound(hard, 2 * i), sound(soft, 2 * i + 1)))
    return F.when(attempt < 2, from_list).otherwise(F.array_join(made, ""))


def _mod97(text: Column) -> Column:
    """The IBAN with its first four characters moved to the end, letters as numbers, modulo 97."""
    turned = F.concat(F.substr(text, F.lit(5), F.length(text)), F.substr(text, F.lit(1), F.lit(4)))

    def step(acc: Column, c: Column) -> Column:
        letter = F.ascii(c) - 55
        return F.when(c.rlike("[0-9]"), (acc * 10 + F.ascii(c) - 48) % 97).otherwise((acc * 100 + letter) % 97)

    return F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), step)


def dress(type_: Column, mention: Column, new: Column) -> Column:
    """The canonical surrogate in the mention's format: its punctuation, spacing and case."""
    spaced = type_.isin(*DIGIT_TYPES, "iban")
    chars = F.split(mention, "")
    coded = (type_ == "phone") & (F.length(F.regexp_replace(mention, "[^0-9]", "")) == F.length(new) + 1)
    new = F.when(coded, F.concat(F.lit("1"), new)).otherwise(new)

    def fill(acc: Column, c: Column) -> Column:
        own = c.rlike("[0-9A-Za-z]")
        return F.struct(
            F.concat(acc["s"], F.when(own, F.substr(new, acc["i"], F.lit(1))).otherwise(c)).alias("s"),
            (acc["i"] + own.cast("int")).alias("i"),
        )

    start = F.struct(F.lit("").alias("s"), F.lit(1).alias("i"))
    filled = F.aggregate(chars, start, fill, lambda acc: acc["s"])
    shown = F.when(mention == F.upper(mention), F.upper(new)).when(mention == F.lower(mention), new)
    name = _cased(mention, new)
    titled = F.concat(F.regexp_extract(mention, "^.*[ \u00a0]", 0), _cased(F.regexp_extract(mention, "[^ \u00a0]+$", 0), new))
    # Mixed case, as in addresses: capitals stay where they are.
    mixed = F.array_join(
        F.transform(F.split(new, ""), lambda c, i: F.when(F.get(chars, i).rlike(r"\p{Lu}"), F.upper(c)).otherwise(c)), ""
    )
    return F.when(spaced, filled).when(type_ == "title", titled).when(type_.startswith("name_"), name).otherwise(F.coalesce(shown, mixed))


def _cased(like: Column, name: Column) -> Column:
    """The name in capitals if ``like`` is, otherwise with a capital at the start of each part."""
    parts = F.regexp_replace(F.initcap(F.regexp_replace(name, "-", "- ")), "- ", "-")
    return F.when((like == F.upper(like)) & (F.length(like) > 1), F.upper(name)).otherwise(parts)


def likeness(type_: Column, entity: Column) -> Column:
    """Entities with equal likeness can stand for one another: equal in shape, in what their surrogates keep
    and in whether a card's check digit holds."""
    shape = F.regexp_replace(F.regexp_replace(entity, "[0-9]", "0"), r"\p{L}", "a")
    n = F.length(entity)
    check = (_luhn_sum(F.substr(entity, F.lit(1), n - 1)) + F.substr(entity, n, F.lit(1)).cast("int")) % 10 == 0
    kept = (
        F.when(type_ == "email", F.substring_index(entity, ".", -1))
        .when(type_ == "iban", F.substr(entity, F.lit(1), F.lit(2)))
        .when(type_ == "phone", F.substr(entity, F.lit(1), F.lit(1)))
        .when(type_ == "card", F.concat(F.substr(entity, F.lit(1), F.lit(1)), check.cast("string")))
        .otherwise("")
    )
    return F.when(type_.startswith("name_") | (type_ == "title"), "").otherwise(F.concat_ws("|", shape, kept))


def exchanged(left: DataFrame, key: str, most: int = 5000) -> DataFrame:
    """(type, entity, new) for (type, entity): in groups of about ``most`` entities of one likeness each takes the
    value of the next in a keyed order, the last that of the first. Groups of one are left out."""
    alike = left.select("type", "entity").withColumn("like", likeness(F.col("type"), F.col("entity")))
    sizes = alike.groupBy("type", "like").agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias("groups"))
    dealt = common.salted_join(alike, sizes, ["type", "like"], "entity").withColumn("group", F.pmod(F.xxhash64("entity"), F.col("groups")))
    group = Window.partitionBy("type", "like", "group").orderBy(F.sha2(F.concat_ws("\x1f", F.lit(key), "entity"), 256))
    taken = F.coalesce(F.lead("entity").over(group), F.first("entity").over(group))
    return dealt.withColumn("new", taken).filter("new <> entity").select("type", "entity", "new")


def mapping(entities: DataFrame, key: str, draws: int = DRAWS, rounds: int = 40) -> DataFrame:
    """(type, entity, new) for distinct (type, entity): new is unique within its type and not the entity itself.
    Up to ``draws`` times it is drawn so that it is no real entity either; numbers and addresses that found none
    exchange their values, names and addresses go on with longer ones. What is left after all ``rounds`` takes
    letters and digits of a keyed digest, so no entity stops a job."""
    entities = common.materialise(entities.distinct(), "pii-entities")
    open_ = entities.withColumn("attempt", F.lit(0))
    done = None
    for number in range(rounds):
        # Drawing is the costly part: once for each entity, dealt over all tasks however small the table.
        drawn = open_.repartition(common.partitions(entities), "entity")
        drawn = drawn.withColumn("new", surrogate(key, F.col("type"), F.col("entity"), F.col("attempt")))
        drawn = common.materialise(drawn, "pii-candidates")
        taken = entities.select("type", F.col("entity").alias("new"))
        if done is not None:
            taken = taken.unionByName(done.select("type", "new"))
        drawn = drawn.join(taken.distinct().withColumn("taken", F.lit(True)), ["type", "new"], "left")
        first = drawn.groupBy("type", "new").agg(F.min("entity").alias("first"))
        drawn = drawn.join(first, ["type", "new"])
        drawn = drawn.withColumn("ok", F.col("taken").isNull() & (F.col("entity") == F.col("first")))
        drawn = common.materialise(drawn.select("type", "entity", "attempt", "new", "ok"), "pii-drawn")
        good = drawn.filter("ok").select("type", "entity", "new")
        done = good if done is None else done.unionByName(good)
        open_ = drawn.filter("not ok").select("type", "entity", (F.col("attempt") + 1).alias("attempt"))
        if not open_.limit(1).count():
            return done
        if number == draws - 1:
            crowded = ~F.col("type").startswith("name_") & (F.col("type") != "title")
            swapped = common.materialise(exchanged(open_.filter(crowded), key), "pii-exchanged")
            done = done.unionByName(swapped)
            open_ = common.materialise(open_.join(swapped.select("type", "entity"), ["type", "entity"], "left_anti"), "pii-open")
            if not open_.limit(1).count():
                return done
    digest = F.sha2(F.concat_ws("\x1f", F.lit(key), "type", "entity"), 256)
    last = F.substr(digest, F.lit(1), F.greatest(F.length("entity"), F.lit(24)))
    return done.unionByName(open_.select("type", "entity", last.alias("new")))


def _people(put: Column) -> Column:
    """The given and family names of a text's full names, each with that of its surrogate; the first one counts."""
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    add = lambda m, k, v: F.when(F.map_contains_key(m, k), m).otherwise(F.map_concat(m, F.create_map(k, v)))
    given = lambda c: F.substring_index(c, " ", 1)
    family = lambda c: F.substring_index(c, " ", -1)

    def step(m: Column, x: Column) -> Column:
        return add(add(m, family(x["entity"]), family(x["new"])), given(x["entity"]), given(x["new"]))

    return F.aggregate(F.filter(put, lambda x: x["type"].startswith("name_")), none, step)


def _renamed(piece: Column, people: Column) -> Column:
    """Text between mentions, with known names that stand alone and begin with a capital replaced."""
    words = F.split(piece, r"(?<![\p{L}-])(?<!\p{L}[’'])(?=\p{L})|(?<=\p{L})(?![\p{L}-]|[’']\p{Lu})")
    put = lambda w: F.when(w.rlike(r"^\p{Lu}"), _cased(w, F.try_element_at(people, F.lower(w)))).otherwise(F.lit(None))
    return F.array_join(F.transform(words, lambda w: F.coalesce(put(w), w)), "")


def replace(df: DataFrame, key: str, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """The rows of df, all columns, with surrogates in the text, and mentions: how many were replaced, not
    counting names that stand alone.

    Null and empty texts stay as they are with 0 mentions; so do texts without mentions. Rows with a null id
    and rows that repeat an id or a text are replaced like any other, equal mentions alike. An empty table
    gives an empty result. A mention without a letter or digit to replace (an address of signs alone) gets a
    longer surrogate. If df has a column mentions, the new one gets a leading underscore."""
    (mentions,) = common.fresh(df, "mentions")
    row, link, put, people = common.fresh(df, "pii_row_", "pii_link_", "pii_put_", "pii_people_")
    body = F.coalesce(F.col(text), F.lit(""))
    keyed = df.withColumn(row, F.concat_ws(":", F.xxhash64(F.col(text)).cast("string"), F.length(text).cast("string"), F.col(row_id).cast("string")))
    hinted = body.rlike(HINTS[0]) | body.rlike(HINTS[1])
    each = keyed.filter(hinted).select(F.col(row).alias("row"), F.posexplode(F.regexp_extract_all(body, F.lit(EVERY), F.lit(0))).alias("at", "mention"))
    each = each.withColumn("type", kind(F.col("mention")))
    each = common.materialise(each.withColumn("entity", canonical(F.col("type"), F.col("mention"))), "pii-mentions")
    table = mapping(each.select("type", "entity"), key)
    # An address that a third of all mentions name is dealt to several tasks.
    new = common.salted_join(each, table, ["type", "entity"], "row")
    new = new.withColumn("shown", dress(F.col("type"), F.col("mention"), F.col("new")))
    new = new.groupBy(F.col("row").alias(link)).agg(F.array_sort(F.collect_set(F.struct("at", "type", "mention", "entity", "new", "shown"))).alias(put))
    new = new.withColumn(people, F.when(F.exists(put, lambda x: x["type"].startswith("name_")), _people(F.col(put))))
    joined = keyed.join(new, F.col(row) == F.col(link), "left")
    pieces = F.split(F.col(text), EVERY, -1)
    known = F.col(people)
    titled = lambda p: F.when(p["type"] == "title", dress(p["type"], p["mention"], F.try_element_at(known, p["entity"])))
    plain = F.zip_with(pieces, F.col(put), lambda piece, p: F.concat(piece, F.coalesce(p["shown"], F.lit(""))))
    followed = F.zip_with(pieces, F.col(put), lambda piece, p: F.concat(_renamed(piece, known), F.coalesce(titled(p), p["shown"], F.lit(""))))
    changed = F.when(F.col(put).isNull(), F.col(text)).when(known.isNull(), F.array_join(plain, "")).otherwise(F.array_join(followed, ""))
    return joined.select(
        *[changed.alias(c) if c == text else F.col(c) for c in df.columns], F.coalesce(F.size(put), F.lit(0)).alias(mentions)
    )
