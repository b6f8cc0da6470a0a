"""Surrogates for personal data: keyed, of the same type and format, distinct wherever the originals are."""

import hashlib
from functools import partial, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forecourt.llm.support import Work, carried, small, unpacked

#: Given names by script and gender; a surrogate comes from the same list.
GIVEN = {
    "latin female": "Alice Anna Carmen Clara Elena Emma Greta Helen Ingrid Julia Laura Lucia Maria Marta Nina Olivia Paula Rosa Sarah Sofia".split(),
    "latin male": "Adam Albert Bruno Carlos Daniel David Erik Felix Georg Henry Hugo James Jan John Louis Lukas Martin Oscar Paul Thomas".split(),
    "cyrillic female": "Анна Вера Дарья Елена Ирина Мария Надежда Ольга Светлана Татьяна".split(),
    "cyrillic male": "Алексей Борис Виктор Дмитрий Иван Михаил Николай Олег Павел Сергей".split(),
    "greek female": "Άννα Ελένη Ειρήνη Κατερίνα Μαρία Σοφία".split(),
    "greek male": "Αλέξης Γιώργος Δημήτρης Κώστας Νίκος Πέτρος".split(),
}
#: Syllables of made-up surnames, by script.
SYLLABLES = {
    "latin": "ba del fen gor hal jin kar lem mon nor pel ris sal tor ver win".split(),
    "cyrillic": "ба вол гор дан жел кор лан мир нов пав рос сол тар чер шан яр".split(),
    "greek": "βα γελ δαν κορ λαμ μαν νικ παπ ρος σαλ ταρ φιλ χαρ".split(),
}
TITLES = ("Mr", "Mrs", "Ms", "Dr", "Prof", "Herr", "Frau", "Señor", "Señora", "Madame", "Monsieur")
#: Characters that take each other's place.
ALPHABETS = (
    "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "àâäçéèêëîïñóôöùúûüßíá",
    "абвгдежзийклмнопрстуфхцчшщыьэюя", "αβγδεζηθικλμνξοπρστυφχψω",
)

_NAMES = [n for names in GIVEN.values() for n in names]
_ONE_NAME = "|".join(sorted(_NAMES, key=len, reverse=True))
_EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]{1,64}+@(?:[\p{L}\p{N}-]{1,63}\.){1,8}[\p{L}]{2,24}"
_IP = r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\d|\.\d)"
_GROUP = "[0-9A-Fa-f]{1,4}"
#: Eight groups, or fewer around or before two colons; a group that is not zero tells it from an empty address.
_IP6 = rf"(?=[0-9A-Fa-f]{{0,4}}:)(?<![\p{{L}}\d:._])(?=[0:]*[1-9A-Fa-f])(?=[A-Fa-f:]*\d)(?:(?:{_GROUP}:){{7}}{_GROUP}|(?:{_GROUP}:){{1,6}}(?::{_GROUP}){{1,6}}|(?:{_GROUP}:){{2,7}}:|:(?::{_GROUP}){{1,7}})(?![\p{{L}}\d:_])"
_IBAN = r"(?<![\p{L}\d])(?=[A-Z]{2}\d{2}(?:[ A-Z]*\d){8})[A-Z]{2}\d{2}(?:(?: [0-9A-Z]{4}){2,7}(?: [0-9A-Z]{1,3})?|[0-9A-Z]{11,30})(?![\p{L}\d])"
_NATIONAL = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
_PHONE = (
    r"(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\) ?\d{3,4}[ .-]\d{3,4}(?!\d)|(?<![\d+])\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?!\d)|(?<!\d)\d{3}[-.]\d{3}[-.]\d{4}(?!\d)"
    # By blanks; with a zero or the one of a long-distance call first, by any marks or none.
    r"|(?<![\d.,-])(?<!\d )\d{3} \d{3} \d{4}(?![ .,-]?\d)|(?<![\d.,-])(?<!\d )0\d{2,4}[ /-]\d{3,4}[ -]?\d{3,4}(?![ .,-]?\d)|(?<![\d.,-])(?<!\d )(?:0[1-9]\d{8,9}|1[2-9]\d\d[2-9]\d{6})(?![ .,-]?\d)"
)
_CARD = r"(?<!\d)(?<!\d[ -])\d(?:[ -]?\d){12,18}(?![ -]?\d)"
_JWT = r"(?<![0-9A-Za-z_.-])eyJ[0-9A-Za-z_-]{8,}\.[0-9A-Za-z_-]{8,}\.[0-9A-Za-z_-]{8,}"
_QUOTED = r"""(?<=["'])(?:[0-9A-Za-z+/_-]{20,}={0,2}|[0-9A-Za-z_-]{8,}\.[0-9A-Za-z_-]{8,}\.[0-9A-Za-z_-]{8,})(?=["'])"""
#: Without quotes, a run with a digit that is assigned to a word for a secret.
_ASSIGNED = r"(?<=[=: ])(?=[0-9A-Za-z+/_.-]{12})(?<=(?i:key|token|secret|password|passwd) ?[=:] ?)(?=[A-Za-z+/_.-]*\d)[0-9A-Za-z+/_.-]{11,}[0-9A-Za-z+/_-]={0,2}"
_SECRET = f"{_QUOTED}|{_JWT}|{_ASSIGNED}"
_GIVEN = rf"(?<!\p{{L}})(?=\p{{Lu}})(?:{_ONE_NAME})(?!\p{{L}})"
_SURNAME = rf"(?<!\p{{L}})(?=\p{{Lu}}\p{{Ll}})(?<=(?:{_ONE_NAME}|(?:{'|'.join(TITLES)})\.?) )\p{{Lu}}\p{{Ll}}{{1,40}}(?!\p{{L}})"
_WORD = r"\p{Lu}\p{Ll}{1,40}"
_CUE = rf"(?:(?:{'|'.join(TITLES)})\.?|[Nn]amed|[Nn]ame is|[Nn]ame:|Dear|I am|I'm|[Cc]ontact|[Ss]igned|[Ss]incerely,|[Rr]egards,|[Aa]uthor:?|[Pp]atient:?|[Cc]ustomer:?|[Ee]mployee:?)"
#: Two capitalised words after a cue.
_PERSON = rf"(?<!\p{{L}})(?=\p{{Lu}}\p{{Ll}})(?:(?<=(?<!\p{{L}}){_CUE} ){_WORD}(?= {_WORD}(?!\p{{L}}))|(?<=(?<!\p{{L}}){_CUE} {_WORD} ){_WORD}(?!\p{{L}}))"
#: Every entity is one match of this; its kind is told from the match alone.
#: Most places of a text are within words, where only numbers may begin; the other parts are not tried there.
PATTERN = (
    rf"(?:(?=[\d(+])|(?<!\p{{L}}))(?:{_SECRET}|{_EMAIL}|{_IP6}"
    rf"|(?=[\d(+])(?:{_IP}|{_CARD}|{_NATIONAL}|{_PHONE})|(?=\p{{Lu}})(?:{_IBAN}|{_GIVEN}|{_SURNAME}|{_PERSON}))"
)
_MARK = "\x01"  # set around entities to cut a text in one search; texts that hold it are searched twice
WIDEN = 8  # attempts after which a surrogate takes a further character or syllable

OUTPUT = ("doc_id", "surrogate_text", "entities")
NUMBERS = ("phone", "card", "national")


def kind_of(entity: Column) -> Column:
    digits = F.length(F.regexp_replace(entity, r"\D", ""))
    return (
        F.when(entity.contains("@"), "email")
        .when(entity.rlike(r"^(?:\d{1,3}\.){3}\d{1,3}$"), "ip")
        .when(entity.rlike(_IP6), "ip6")
        .when(entity.rlike(rf"^(?:{_IBAN})$"), "iban")
        .when(entity.rlike(r"^\d[\d -]*$") & digits.between(13, 19), "card")
        .when(entity.rlike(r"^\d{3}-\d{2}-\d{4}$"), "national")
        .when(entity.rlike(r"^[+(\d][\d ()./-]*$") & (digits <= 22) & (entity.rlike(r"[ ()./+-]") | (digits <= 11)), "phone")
        .when(entity.isin(_NAMES), "given")
        .when(entity.rlike(r"^\p{Lu}\p{Ll}{1,40}$") & (F.length(entity) < 20), "surname")
        .otherwise("secret")
    )


def _groups(address: Column) -> Column:
    """The eight groups of an address, in lower case without leading zeros, those left out between two colons included."""
    part = lambda i: F.filter(F.split(F.substring_index(F.lower(address), "::", i), ":"), lambda g: g != "")
    left, right = part(1), F.when(address.contains("::"), part(-1)).otherwise(F.array().cast("array<string>"))
    zeros = F.array_repeat(F.lit("0"), F.greatest(8 - F.size(left) - F.size(right), F.lit(0)))
    return F.transform(F.concat(left, zeros, right), lambda g: F.regexp_replace(g, "^0+(?=.)", ""))


def normal_form(entity: Column, kind: Column) -> Column:
    """What two mentions of one entity share: digits of numbers, lower case and all groups of addresses."""
    return (
        F.when(kind.isin(*NUMBERS), F.regexp_replace(entity, r"\D", ""))
        .when(kind == "email", F.lower(entity))
        .when(kind == "ip6", F.array_join(_groups(entity), ":"))
        .when(kind == "iban", F.replace(entity, F.lit(" "), F.lit("")))
        .otherwise(entity)
    )


def _at(values: list[str], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), index.cast("int") + 1)


def _draw(seed: Column, place: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(seed, place), F.lit(n))


def _syllable(syllables: list[str], seed: Column, place: Column) -> Column:
    return _at(syllables, _draw(seed, place, len(syllables)))


def _characters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def _replaced(text: Column, seed: Column) -> Column:
    """Each letter and digit by one of its alphabet; other characters stay."""

    def one(c, i):
        out = c
        for alphabet in ALPHABETS:
            out = F.when(F.instr(F.lit(alphabet), c) > 0, F.substring(F.lit(alphabet), (_draw(seed, i, len(alphabet)) + 1).cast("int"), F.lit(1))).otherwise(out)
        return out

    return F.array_join(F.transform(_characters(text), one), "")


def _luhn(digits: Column) -> Column:
    """The sum that is divisible by 10 for a valid number; the last digit is not doubled."""
    places = F.reverse(_characters(digits))
    value = lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0))
    return F.aggregate(F.transform(places, value), F.lit(0), lambda a, x: a + x)


def _script(name: Column) -> Column:
    return F.when(name.rlike(r"^\p{IsCyrillic}"), "cyrillic").when(name.rlike(r"^\p{IsGreek}"), "greek").otherwise("latin")


def _with(items: Column, **fields) -> Column:
    """An array of structs with further fields, each a function of the struct. Later calls see the fields as
    values, so that no expression is written out twice."""

    def one(x):
        for name, f in fields.items():
            x = x.withField(name, f(x))
        return x

    return F.transform(items, one)


def _given(name: Column, key: str) -> Column:
    """The next name of the list, in an order that depends on the key and every name."""
    pairs = []
    for group, names in GIVEN.items():
        order = sorted(names, key=lambda n: hashlib.sha256(f"{key}|{group}|{n}".encode()).hexdigest())
        pairs += [F.lit(n) for pair in zip(order, order[1:] + order[:1]) for n in pair]
    return F.try_element_at(F.create_map(*pairs), name)


def _surname(x: Column) -> Column:
    many, out = F.sequence(F.lit(1), (3 + x["wider"]).cast("int")), F.lit("")
    for script, syllables in SYLLABLES.items():
        made = F.initcap(F.array_join(F.transform(many, partial(_syllable, syllables, x["seed"])), ""))
        out = F.when(x["script"] == script, made).otherwise(out)
    return out


def _hexed(x: Column) -> Column:
    one = lambda c, i: F.substring(F.lit("0123456789abcdef"), (_draw(x["seed"], i, 16) + 1).cast("int"), F.lit(1))
    return F.array_join(F.transform(_characters(x["longer"]), one), "")


def _mod97(text: Column) -> Column:
    """Remainder of the number that digits and capitals (10 to 35) spell."""
    step = lambda rest, c: F.when(c.rlike("[0-9]"), rest * 10 + F.ascii(c) - 48).otherwise(rest * 100 + F.ascii(c) - 55)
    return F.aggregate(_characters(text), F.lit(0), lambda rest, c: F.pmod(step(rest, c), F.lit(97)).cast("int"))


def _checked(x: Column) -> Column:
    """An account number of the same country; its check digits are valid if the original's are."""
    country, body = F.left(x["normal"], F.lit(2)), F.substring(x["moved"], F.lit(3), F.length(x["moved"]))
    whole = lambda account: F.concat(F.substring(account, F.lit(5), F.length(account)), F.left(account, F.lit(4)))
    check = F.lpad((98 - _mod97(F.concat(body, country, F.lit("00")))).cast("string"), 2, "0")
    return F.concat(country, F.when(_mod97(whole(x["normal"])) == 1, check).otherwise(F.left(x["moved"], F.lit(2))), body)


def _address(x: Column) -> Column:
    """Another figure for each group that is not zero, of its length; late attempts lengthen groups, then fill further ones."""
    hexed = lambda i, j: F.substring(F.lit("123456789abcdef"), (_draw(x["seed"], i * 8 + j, 15) + 1).cast("int"), F.lit(1))
    many = lambda g: F.least(F.length(g) + x["wider"], F.lit(4))
    one = lambda g, i: F.array_join(F.transform(F.sequence(F.lit(1), many(g)), lambda j: hexed(i, j)), "")
    return F.array_join(F.transform(F.split(x["normal"], ":"), lambda g, i: F.when((g != "0") | (i >= 11 - x["wider"]), one(g, i)).otherwise(g)), ":")


def _poured_address(x: Column) -> Column:
    """The figures in the layout of the mention, or in full if there are more of them."""
    filled = lambda groups: F.filter(groups, lambda g: g.rlike("[1-9A-Fa-f]"))
    made, groups = filled(F.split(x["made"], ":")), F.split(x["entity"], ":", -1)
    nth = lambda i: F.get(made, F.size(filled(F.slice(groups, F.lit(1), i))))
    padded = lambda g, i: F.lpad(nth(i), F.greatest(F.length(g), F.length(nth(i))), "0")
    poured = F.array_join(F.transform(groups, lambda g, i: F.when(g.rlike("[1-9A-Fa-f]"), padded(g, i)).otherwise(g)), ":")
    out = F.when(F.size(made) == F.size(filled(groups)), poured).otherwise(x["made"])
    return F.when(x["entity"].rlike("[A-F]"), F.upper(out)).otherwise(out)


def surrogates(items: Column, key: str) -> Column:
    """Structs of kind, normal and attempt, with the entity's surrogate as ``made``; another one for each attempt.

    Numbers keep length, first digit and, for cards, a valid check digit; addresses of both kinds their
    layout and an e-mail address its last label; account numbers their country and valid check digits; secrets
    their alphabets. A given name becomes the next one of its list of the same script and gender in a keyed
    order, a surname is made of syllables of its script.
    """
    is_number = lambda x: x["kind"].isin(*NUMBERS)
    items = _with(
        items,
        seed=lambda x: F.sha2(F.concat_ws("|", F.lit(key), x["kind"], x["normal"], x["attempt"].cast("string")), 256),
        wider=lambda x: F.floor(x["attempt"] / WIDEN).cast("int"),
        label=lambda x: F.regexp_extract(x["normal"], r"\.[^.]*$", 0),
        script=lambda x: _script(x["normal"]),
    )
    items = _with(items, longer=lambda x: F.concat(x["normal"], F.repeat(F.lit("0"), x["wider"])))
    items = _with(items, rest=lambda x: F.when(is_number(x), F.substring(x["longer"], F.lit(2), F.length(x["longer"]))).when(
        x["kind"] == "email", F.left(x["normal"], F.length(x["normal"]) - F.length(x["label"]))).when(
        x["kind"] == "iban", F.substring(x["longer"], F.lit(3), F.length(x["longer"]))).otherwise(x["longer"]))
    items = _with(items, moved=lambda x: _replaced(x["rest"], x["seed"]))
    items = _with(items, number=lambda x: F.concat(F.left(x["normal"], F.lit(1)), x["moved"]))
    items = _with(items, body=lambda x: F.left(x["number"], F.length(x["number"]) - 1))
    check = lambda x: F.pmod(10 - F.pmod(_luhn(F.concat(x["body"], F.lit("0"))), F.lit(10)), F.lit(10)).cast("string")
    octets = lambda x: F.transform(F.split(x["normal"], r"\."), lambda _, i: (_draw(x["seed"], i, 254) + 1).cast("string"))
    return _with(items, made=lambda x: (
        F.when((x["kind"] == "card") & (F.pmod(_luhn(x["normal"]), F.lit(10)) == 0), F.concat(x["body"], check(x)))
        .when(is_number(x), x["number"])
        .when(x["kind"] == "ip", F.array_join(octets(x), "."))
        .when(x["kind"] == "ip6", _address(x))
        .when(x["kind"] == "iban", _checked(x))
        .when(x["kind"] == "email", F.concat(F.repeat(F.lit("x"), x["wider"]), x["moved"], x["label"]))
        .when(x["kind"] == "given", _given(x["normal"], key))
        .when(x["kind"] == "surname", _surname(x))
        .when(x["longer"].rlike("^[0-9]*[a-f][0-9a-f]*$"), _hexed(x)).otherwise(x["moved"])
    ))


def rendered(x: Column) -> Column:
    """A surrogate in the layout of one mention: digits between its marks, capitals where it has them."""
    mark = F.when(x["kind"] == "iban", " ").otherwise(r"\D")
    place = lambda i: F.length(F.regexp_replace(F.left(x["entity"], i), mark, F.lit(""))) + 1
    sign = lambda c, i: F.when(F.regexp_replace(c, mark, F.lit("")) != "", F.substring(x["made"], place(i), F.lit(1))).otherwise(c)
    poured = F.array_join(F.transform(_characters(x["entity"]), sign), "")
    rest = F.substring(x["made"], F.length(x["normal"]) + 1, F.length(x["made"]))
    capital = lambda c, i: F.when(F.substring(x["entity"], i + 1, F.lit(1)).rlike(r"\p{Lu}"), F.upper(c)).otherwise(c)
    cased = F.array_join(F.transform(_characters(x["made"]), capital), "")
    same = F.length(x["made"]) == F.length(x["entity"])
    return (
        F.when(x["kind"].isin(*NUMBERS, "iban"), F.concat(poured, rest))
        .when(x["kind"] == "ip6", _poured_address(x))
        .when((x["kind"] == "email") & same, cased)
        .otherwise(x["made"])
    )


def _attempts(work: Work, entities: DataFrame, key: str) -> DataFrame:
    """(kind, normal, attempt) of the entities whose first surrogate is not theirs alone.

    A surrogate that several entities of a kind got stays with the smallest; one that is itself an
    entity of the data, or was given before, goes to none. Only those without one try again, until all differ. Given
    names go round in their lists, so they differ anyway.
    """
    state = work.store(entities.filter("kind <> 'given'").select("kind", "normal", F.lit(0).alias("attempt")))
    taken = state.select("kind", F.col("normal").alias("made"))
    settled = []
    while True:
        one = surrogates(F.array(F.struct("kind", "normal", "attempt")), key)
        made = work.store(state.select("kind", "normal", "attempt", F.element_at(one, 1)["made"].alias("made")))
        gone = taken.join(small(made.select("kind", "made")), ["kind", "made"], "left_semi").distinct().withColumn("gone", F.lit(True))
        first = made.groupBy("kind", "made").agg(F.min("normal").alias("first"))
        judged = made.join(first, ["kind", "made"]).join(gone, ["kind", "made"], "left")
        again = F.col("gone").isNotNull() | (F.col("first") != F.col("normal"))
        judged = work.store(judged.select("kind", "normal", "attempt", "made", again.alias("again")))
        done = judged.filter("NOT again")
        settled.append(done.filter("attempt > 0").select("kind", "normal", "attempt"))
        state = judged.filter("again").select("kind", "normal", (F.col("attempt") + 1).alias("attempt"))
        if state.isEmpty():
            return reduce(DataFrame.unionByName, settled)
        taken = taken.unionByName(done.select("kind", "made"))


def _pieces(text: Column) -> Column:
    """A text cut at its entities: what stands between them, and they themselves at every second place."""
    cut = F.split(F.regexp_replace(text, PATTERN, f"{_MARK}$0{_MARK}"), _MARK, -1)
    entities = F.concat(F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)), F.array(F.lit("")))
    twice = F.flatten(F.zip_with(F.split(text, PATTERN, -1), entities, lambda gap, entity: F.array(gap, entity)))
    return F.when(F.instr(text, _MARK) == 0, cut).otherwise(F.slice(twice, F.lit(1), F.size(twice) - 1))


def replace_entities(docs: DataFrame, key: str = "surrogate", carry: tuple[str, ...] = ()) -> DataFrame:
    """Every document's text with a surrogate for each detected entity, and the number of entities.

    Detected are e-mail and IP addresses (both versions), phone, card and account numbers (IBAN), national numbers of nine digits by
    3-2-4, quoted secrets of any length, web tokens, secrets assigned without quotes, given names of the lists, the surname
    after one or after a title, and two capitalised words after a title or another cue. A surrogate depends on the key, the kind and the normal form
    only, so mentions of one entity agree throughout the corpus, whatever their layout. A first pass
    gathers the distinct entities and settles collisions: no two entities of a kind share a surrogate and, but for
    given names, which change places within their lists, no surrogate is an entity of its kind that occurs. Only entities that needed another attempt are joined to the texts
    that hold them; all others are replaced where they stand, without a shuffle of texts.

    A null text stays null with 0 entities, an empty one empty. Null and repeated ids are documents like others;
    an empty table gives no rows. Returns the ``OUTPUT`` columns and those in ``carry`` not named like one.
    """
    work = Work(docs.sparkSession)
    texts = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), "text", carried(docs, carry, OUTPUT).alias("carried"),
        F.md5("text").alias("digest"), _pieces(F.col("text")).alias("pieces"),
    )
    found = F.filter("pieces", lambda _, i: i % 2 == 1)
    told = lambda items: _with(_with(items, kind=lambda x: kind_of(x["entity"])), normal=lambda x: normal_form(x["entity"], x["kind"]))
    # The outer form keeps Spark from searching the texts once more to see which hold something.
    each = texts.select("digest", F.explode_outer(found).alias("entity")).filter("entity IS NOT NULL")
    distinct = work.store(each.distinct())
    alone = F.element_at(told(F.array(F.struct("entity"))), 1).alias("x")
    mentions = work.store(distinct.select("digest", alone).select("digest", "x.kind", "x.normal").distinct())
    told = told(F.transform(found, lambda e: F.struct(e.alias("entity"))))
    entities = mentions.select("kind", "normal").distinct()
    retried = work.store(_attempts(work, entities, key))
    extra = (
        mentions.join(small(retried), ["kind", "normal"])
        .groupBy("digest").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("|", "kind", "normal"), "attempt"))).alias("attempts"))
    )
    extra = work.store(extra)

    tried = lambda x: F.coalesce(F.try_element_at("attempts", F.concat_ws("|", x["kind"], x["normal"])), F.lit(0))
    new = F.transform(surrogates(_with(told, attempt=tried), key), rendered)
    gaps = F.filter("pieces", lambda _, i: i % 2 == 0)
    whole = F.array_join(F.zip_with(gaps, new, lambda gap, made: F.concat(gap, F.coalesce(made, F.lit("")))), "")
    number = F.coalesce(F.floor(F.size("pieces") / 2).cast("int"), F.lit(0))
    return texts.join(small(extra), "digest", "left").select(
        "doc_id", F.when(F.size("pieces") > 1, whole).otherwise(F.col("text")).alias("surrogate_text"),
        F.when(F.col("text").isNull(), 0).otherwise(number).alias("entities"), *unpacked(carry, OUTPUT),
    )
