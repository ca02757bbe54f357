"""Operator 2, PII: entities are found by pattern and replaced by keyed surrogates of the same type and form. Built-in functions only.

A surrogate is a function of a secret key, the entity's type and its canonical value, so the same entity gets the same surrogate
everywhere (a number however it is punctuated, a name token alone or with another). It keeps the form: digits stay digits, letters keep case and
script, hexadecimal stays hexadecimal, punctuation stays, a card number that passes the Luhn check still does, an account number has valid
check digits, given names keep the gender their title shows; after a title that shows none, the gender shown elsewhere in the corpus.

Collision check: over all distinct entities, a surrogate that two entities share, or that is itself an entity of the corpus, is drawn again
with the next attempt number until none is left. Where so many entities share a short form that draws keep colliding, surrogates get
longer (or leave a private range of addresses), so this ends. Those few later attempts are looked up by entity; all others are recomputed in place.

The key is the setting `KEY`. Without one each session draws a key of its own, so nobody can recompute surrogates, but other sessions get others.
Names are found by their titles only.
"""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from toolspark.llm.common import free, read, refuse, row_key, written

#: The setting that holds the secret key.
KEY = "spark.toolspark.private.key"
#: Later attempts up to which they are a map in the plan; beyond, a join.
IN_PLAN = 500
#: From this attempt on a surrogate gets one more digit with each attempt, at most MOST_WIDER.
WIDER, MOST_WIDER = 8, 12

#: fixed values: titles by gender
TITLES = {"m": ["Mr", "Herr", "Herrn", "Monsieur", "Señor", "Sr", "г-н", "господин"], "f": ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mlle", "Señora", "Sra", "г-жа", "госпожа"], "n": ["Dr", "Prof", "Doktor", "Профессор"]}
_title = "|".join(t for ts in TITLES.values() for t in ts)
_no_word = r"(?<![\p{L}\p{N}_])"
_end = r"(?![\p{L}\p{N}_])"
_octet = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_secret_head = r"(?i:[\"']?(?:access[_-]?token|auth[_-]?token|token|client[_-]?secret|secret|passwd|password|pwd|api[_-]?key|access[_-]?key|private[_-]?key)[\"']?\s{0,3}[:=]\s{0,3}[\"']?)"
# what stands in quotes needs no digit, but a letter or digit
_quoted = "|".join(rf"(?<={q})(?=[^{q}\s\p{{L}}\p{{N}}]*+[\p{{L}}\p{{N}}])[^{q}\s]{{8,}}+(?={q})" for q in "\"'")
_secret_value = rf"(?:{_quoted}|(?=[A-Za-z_+/.~-]*+\d)[A-Za-z0-9_+/.~-]{{8,}}+)"
_name = r"\p{Lu}[\p{L}'’-]++"
#: Patterns by type, in the order in which they are tried at a place.
PATTERNS = {
    "secret": rf"{_no_word}{_secret_head}{_secret_value}|{_no_word}(?:AKIA[0-9A-Z]{{16}}|gh[pousr]_[A-Za-z0-9]{{30,}}+|sk-[A-Za-z0-9]{{20,}}+|xox[abprs]-[A-Za-z0-9-]{{10,}}|(?=[a-f]*\d)(?=\d*[a-f])[0-9a-f]{{32,}}+|(?=[A-F]*\d)(?=\d*[A-F])[0-9A-F]{{32,}}+){_end}",
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}_%+-][\p{L}\p{N}._%+-]{0,63}+@(?:[\p{L}\p{N}](?:[\p{L}\p{N}-]{0,62}))(?:\.[\p{L}\p{N}-]{1,63}){0,8}\.\p{L}{2,24}" + _end,
    "iban": rf"{_no_word}[A-Z]{{2}}\d{{2}}(?: ?[A-Z0-9]{{4}}){{2,7}}(?: ?[A-Z0-9]{{1,4}})?{_end}",
    "ip": rf"{_no_word}(?<!\d\.){_octet}(?:\.{_octet}){{3}}(?!\.?\d){_end}",
    "phone": rf"(?<![\p{{L}}\p{{N}}_+])(?:\+\d{{1,3}}[ .-]?(?:\(\d{{1,4}}\)[ .-]?)?\d{{2,4}}(?:[ .-]?\d{{2,4}}){{1,4}}|\(\d{{3}}\)[ .-]?\d{{3}}[ .-]\d{{4}}|\d{{3}}[ .-]\d{{3}}[ .-]\d{{4}}){_end}",
    "ssn": rf"{_no_word}\d{{3}}-\d{{2}}-\d{{4}}{_end}",
    "card": rf"{_no_word}(?:\d{{4}}([ -])\d{{4}}\1\d{{4}}\1\d{{1,7}}|\d{{13,19}}){_end}",
    "name": rf"{_no_word}(?:{_title})\.? {{1,2}}{_name}(?: {_name})*+",
}
PATTERN = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: What every entity has: a digit, an @, a title, the head of a bare key or a label before a quote.
HINT = rf"[0-9@]|(?=[DFHMPSгП])(?:{_title})\.? |(?=[gsx])(?:gh[pousr]_|sk-|xox[abprs]-)|AKIA|[:=]\s{{0,3}}[\"']"

#: fixed values: syllables and endings of names, by script
SYLLABLES = {"latin": "ba be bo da de do fa fe ga go ha he ja jo ka ke la le lo ma me mi na ne no pa pe ra re ri ro sa se so ta te to va vi wa".split(), "cyrillic": "ба бе бо ва ве во га го да де до жа за зо ка ке ко ла ле ло ма ме ми на не но па по ра ре ри ро са се со та те то фа".split()}
ENDINGS = {"latin": {"m": "ron vin den mas rik ton".split(), "f": "lia ra nia tta sa line".split(), "n": "rin len ris mar dan sol".split(), "s": "man son ner berg well ton ler stein".split()}, "cyrillic": {"m": "мир слав дан рим вид тон".split(), "f": "лия ра ния сана лина вета".split(), "n": "рин лен рис мар дан сол".split(), "s": "нов рин ский ленко тов дин".split()}}


def let(value: Column, fn) -> Column:
    """fn(value) with the value computed once: a name for it, which plans of nested expressions need to stay small."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def _digest(*parts: Column) -> Column:
    """128 hexadecimal digits."""
    return F.sha2(F.concat_ws("|", *parts), 512)


def _number(h: Column, i: Column) -> Column:
    """The i-th (from 1, in turn) of 64 numbers below 256. With 26 or fewer letters the first are a little more likely."""
    return F.conv(F.substr(h, F.pmod(i - 1, F.lit(64)) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _each(v: Column, fn) -> Column:
    """fn(character, its place from 1) over a string."""
    return F.when(F.length(v) > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.length(v)), lambda i: fn(F.substr(v, i, F.lit(1)), i)), "")).otherwise("")


def _pick(letters: str, n: Column) -> Column:
    return F.substr(F.lit(letters), n % len(letters) + 1, F.lit(1))


def scramble(v: Column, h: Column) -> Column:
    """Same kind of character at every place; a string of hexadecimal digits stays one. Letters that are neither Latin nor Cyrillic become Latin."""
    plain, low, high = F.lit(0), F.lit(1), F.lit(2)
    mode = F.when(v.rlike("^[0-9a-f]+$") & v.rlike("[a-f]"), low).when(v.rlike("^[0-9A-F]+$") & v.rlike("[A-F]"), high).otherwise(plain)

    def one(c: Column, n: Column, m: Column) -> Column:
        return (
            F.when(m == low, _pick("0123456789abcdef", n))
            .when(m == high, _pick("0123456789ABCDEF", n))
            .when(c.rlike("[0-9]"), _pick("0123456789", n))
            .when(c.rlike(r"\p{IsCyrillic}"), F.when(c.rlike(r"\p{Lu}"), _pick("АБВГДЕЖЗИКЛМНОПРСТУФ", n)).otherwise(_pick("абвгдежзиклмнопрстуф", n)))
            .when(c.rlike(r"\p{Lu}"), _pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ", n))
            .when(c.rlike(r"\p{L}"), _pick("abcdefghijklmnopqrstuvwxyz", n))
            .otherwise(c)
        )

    return let(F.struct(mode.alias("m"), v.alias("v"), h.alias("h")), lambda s: _each(s["v"], lambda c, i: let(_number(s["h"], i), lambda n: one(c, n, s["m"]))))


def refill(shape: Column, fill: Column) -> Column:
    """shape with its i-th letter or digit replaced by the i-th character of fill; what is left of fill comes last."""
    plain = lambda s: F.regexp_replace(s, "[^A-Za-z0-9]", "")
    filled = lambda s: _each(s["shape"], lambda c, i: F.when(c.rlike("[A-Za-z0-9]"), F.substr(s["fill"], F.length(plain(F.substr(s["shape"], F.lit(1), i))), F.lit(1))).otherwise(c))
    return let(F.struct(shape.alias("shape"), fill.alias("fill")), lambda s: F.concat(filled(s), F.substr(s["fill"], F.length(plain(s["shape"])) + 1, F.length(s["fill"]))))


def luhn_sum(digits: Column, odd: int) -> Column:
    """Sum in which each second digit from the right (starting with the last if odd is 0) is doubled."""

    def added(i: Column, d: Column) -> Column:
        return let(F.substr(d, i, F.lit(1)).cast("int"), lambda x: F.when((F.length(d) - i) % 2 == odd, x * 2 - F.when(x > 4, 9).otherwise(0)).otherwise(x))

    return let(digits, lambda d: F.aggregate(F.transform(F.sequence(F.lit(1), F.greatest(F.length(d), F.lit(1))), lambda i: added(i, d)), F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))))


def iban_check(country: Column, rest: Column) -> Column:
    """The two check digits of an account number."""

    def values(m: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.length(m)), lambda i: let(F.substr(m, i, F.lit(1)), lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)))

    left = let(F.concat(rest, country, F.lit("00")), lambda m: F.aggregate(values(m), F.lit(0), lambda a, x: (a * F.when(x > 9, 100).otherwise(10) + F.coalesce(x, F.lit(0))) % 97))
    return F.lpad((98 - left).cast("string"), 2, "0")


def entity(e: Column) -> Column:
    """What a match is: struct(kind, head, units array<struct(kind, shown, value)>); head stays, units are replaced."""
    is_ = lambda p: e.rlike(p)
    bare = is_("^(?:AKIA[0-9A-Z]{16}|gh[pousr]_|sk-[A-Za-z0-9]{20}|xox[abprs]-|[0-9a-f]{32,}$|[0-9A-F]{32,}$)") & is_("[A-Za-z]")
    kind = (
        F.when(is_(f"^(?:{_title})\\.? "), "name").when(bare, "bare").when(is_(f"^{_secret_head}"), "secret").when(F.contains(e, F.lit("@")), "email").when(is_(r"^[A-Z]{2}\d{2}"), "iban")
        .when(is_(rf"^{_octet}(?:\.{_octet}){{3}}$"), "ip").when(is_(r"^\d{3}-\d{2}-\d{4}$"), "ssn").when(is_(r"^(?:\d{13,19}|\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{1,7})$"), "card").otherwise("phone")
    )
    heads = lambda k: F.when(k == "name", F.regexp_extract(e, rf"^((?:{_title})\.? {{1,2}})", 1)).when(k == "phone", F.regexp_extract(e, r"^(\+\d{1,3})(?=[ .(-])", 1)).when(k == "secret", F.regexp_extract(e, f"^({_secret_head})", 1)).otherwise("")

    def named(k: Column, head: Column) -> Column:
        shown = F.substr(e, F.length(head) + 1, F.length(e))
        return let(F.struct(shown.alias("shown"), k.alias("k"), head.alias("head")), lambda s: F.struct(F.when(s["k"] == "bare", "secret").otherwise(s["k"]).alias("kind"), s["head"].alias("head"), units(s).alias("units")))

    def units(s: Column) -> Column:
        k, shown = s["k"], s["shown"]
        unit = lambda kind, shown, value: F.struct(kind.alias("kind"), shown.alias("shown"), value.alias("value"))
        gender = F.when(s["head"].rlike(f"^(?:{'|'.join(TITLES['m'])})[. ]"), "m").when(s["head"].rlike(f"^(?:{'|'.join(TITLES['f'])})[. ]"), "f").otherwise("n")
        last = F.regexp_extract(shown, "([^ ]*)$", 1)
        surname = unit(F.lit("surname"), last, F.lower(last))
        given = F.regexp_extract(shown, "^(.*) ", 1)
        value = F.when(k == "email", F.lower(shown)).when(k.isin("phone", "card", "ssn", "iban"), F.regexp_replace(shown, "[^A-Za-z0-9]", "")).otherwise(shown)
        return (
            F.when((k == "name") & F.contains(shown, F.lit(" ")), F.concat(F.transform(F.split(given, " "), lambda w: unit(F.concat(F.lit("given_"), gender), w, F.lower(w))), F.array(surname)))
            .when(k == "name", F.array(surname))
            .otherwise(F.array(unit(F.when(k == "bare", "secret").otherwise(k), shown, value)))
        )

    return let(kind, lambda k: let(F.struct(k.alias("k"), heads(k).alias("h")), lambda s: named(s["k"], s["h"])))


def secret_key(spark: SparkSession) -> str:
    """The session's key; drawn at random where none is set."""
    key = spark.conf.get(KEY, None)
    if not key:
        key = secrets.token_hex(32)
        spark.conf.set(KEY, key)
    return key


def surrogate(kind: Column, value: Column, attempt: Column, key: str) -> Column:
    """The canonical surrogate of a canonical value."""
    bound = F.struct(kind.alias("k"), value.alias("v"), attempt.cast("int").alias("n"), _digest(F.lit(key), kind, value, attempt.cast("string")).alias("h"))
    return let(bound, lambda s: _surrogate(s["k"], s["v"], s["n"], s["h"], key))


def _surrogate(kind: Column, value: Column, attempt: Column, h: Column, key: str) -> Column:
    n = lambda i: _number(h, F.lit(i))
    hidden = lambda d: F.concat(let(_digest(F.lit(key), F.lit("domain"), d), lambda g: F.concat(*[_pick("abcdefghijklmnopqrstuvwxyz", _number(g, F.lit(i))) for i in range(1, 9)])), F.when(d.rlike(r"\.org$"), ".example.org").when(d.rlike(r"\.net$"), ".example.net").otherwise(".example.com"))
    wider = F.when(attempt >= WIDER, F.substr(F.regexp_replace(_digest(h), "[^0-9]", ""), F.lit(1), F.least(attempt - WIDER + 1, F.lit(MOST_WIDER)))).otherwise("")
    email = F.concat(scramble(F.regexp_extract(value, "^(.*)@", 1), h), wider, F.lit("@"), let(F.regexp_extract(value, "@(.*)$", 1), hidden))
    first_octet = let((n(1) % 222 + 1).cast("string"), lambda o: F.when(o.isin("10", "127", "172", "192"), "11").otherwise(o))
    tail = [n(2).cast("string"), n(3).cast("string"), (n(4) % 254 + 1).cast("string")]
    ip = let(F.regexp_extract(value, r"^(10|127|192\.168|172\.(?:1[6-9]|2\d|3[01]))\.", 1), lambda own: F.when((own == "") | (attempt >= WIDER), F.concat_ws(".", first_octet, *tail)).when(F.contains(own, F.lit(".")), F.concat_ws(".", own, *tail[1:])).otherwise(F.concat_ws(".", own, *tail)))
    head = lambda v, k: F.substr(v, F.lit(1), F.lit(k))
    rest = lambda v, k: F.substr(v, F.lit(k), F.length(v))
    plain = lambda then: let(scramble(value, h), then)
    checked = lambda stem: F.concat(stem, ((10 - luhn_sum(stem, 0) % 10) % 10).cast("string"))
    card = plain(lambda d: F.when(luhn_sum(value, 1) % 10 == 0, let(F.concat(head(value, 1), F.substr(d, F.lit(2), F.length(d) - 2)), checked)).otherwise(F.concat(head(value, 1), rest(d, 2))))
    ssn = plain(lambda d: F.concat(F.lit("9"), rest(d, 2), wider))
    iban = let(scramble(rest(value, 5), h), lambda d: F.concat(head(value, 2), iban_check(head(value, 2), d), d))

    def name(script: str, ending: str) -> Column:
        s, e = F.array(*map(F.lit, SYLLABLES[script])), F.array(*map(F.lit, ENDINGS[script][ending]))
        at = lambda a, i: F.element_at(a, _number(h, i) % F.size(a) + 1)
        more = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(2) + attempt), lambda i: at(s, i)), "")
        return F.concat(more, at(e, F.lit(60)))

    out = F.when(kind == "email", email).when(kind == "ip", ip).when(kind == "card", card).when(kind == "ssn", ssn).when(kind == "iban", iban)
    out = out.when(kind == "secret", let(F.regexp_extract(value, "^(AKIA|gh[pousr]_|sk-|xox[abprs]-)", 1), lambda p: F.concat(p, scramble(F.substr(value, F.length(p) + 1, F.length(value)), h), wider)))
    for k in ("given_m", "given_f", "given_n", "surname"):
        out = out.when(kind == k, F.when(value.rlike(r"\p{IsCyrillic}"), name("cyrillic", k[-1] if k != "surname" else "s")).otherwise(name("latin", k[-1] if k != "surname" else "s")))
    return out.otherwise(F.concat(scramble(value, h), wider))


def rendered(kind: Column, shown: Column, made: Column) -> Column:
    """The surrogate in the form in which the entity stands in the text."""
    bound = F.struct(kind.alias("k"), shown.alias("s"), made.alias("m"))

    def form(b: Column) -> Column:
        k, s, m = b["k"], b["s"], b["m"]
        named = F.when(s.rlike(r"^[^\p{Ll}]+$") & (F.length(s) > 1), F.upper(m)).when(s.rlike(r"^[^\p{Lu}]+$"), m).otherwise(F.concat(F.upper(F.substr(m, F.lit(1), F.lit(1))), F.substr(m, F.lit(2), F.length(m))))
        mail = _each(m, lambda c, i: F.when(F.substr(s, i, F.lit(1)).rlike(r"\p{Lu}") & (i <= F.instr(s, "@")), F.upper(c)).otherwise(c))
        return F.when(k.startswith("given_") | (k == "surname"), named).when(k == "email", mail).when(k.isin("phone", "card", "ssn", "iban"), refill(s, m)).otherwise(m)

    return let(bound, form)


def entities(text: Column) -> Column:
    """All matches of a text, in order, as `entity` structs; none for null."""
    found = F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))).otherwise(F.array().cast("array<string>"))
    return F.transform(found, entity)


def later_attempts(docs: DataFrame, key: str, text_col: str = "text", most: int = 64) -> DataFrame:
    """(kind, value, as_kind, attempt) of the entities whose first surrogate is another entity or another entity's surrogate, and of the given names
    that stand after a title without gender here and after one with gender elsewhere, which makes them names of that gender."""
    units = docs.select(F.explode(F.flatten(F.transform(entities(F.col(text_col)), lambda e: e["units"]))).alias("u")).select("u.kind", "u.value").distinct()
    units = written(units, "units")
    shown = units.where(F.col("kind").isin("given_m", "given_f")).groupBy("value").agg(F.min("kind").alias("shown"))
    units = written(units.join(shown, "value", "left").select("kind", "value", F.when((F.col("kind") == "given_n") & F.col("shown").isNotNull(), F.col("shown")).otherwise(F.col("kind")).alias("as_kind")), "units")
    group = F.when(F.col("as_kind").startswith("given_"), "given").otherwise(F.col("as_kind"))
    todo, out = units.select("as_kind", "value").distinct().withColumn("attempt", F.lit(0)), None
    taken = todo.select(group.alias("group"), F.col("value").alias("made"))
    for _ in range(most):
        made = todo.withColumns({"made": surrogate(F.col("as_kind"), F.col("value"), F.col("attempt"), key), "group": group})
        best = made.groupBy("group", "made").agg(F.min(F.struct("value", "as_kind")).alias("best"))
        made = made.join(best, ["group", "made"]).join(taken.withColumn("used", F.lit(True)).distinct(), ["group", "made"], "left")
        made = written(made.withColumn("bad", F.col("used").isNotNull() | (F.struct("value", "as_kind") != F.col("best"))), "surrogates")
        good = made.where("not bad")
        later = good.where("attempt > 0").select("as_kind", "value", "attempt")
        out = later if out is None else out.union(later)
        todo = made.where("bad").select("as_kind", "value", (F.col("attempt") + 1).alias("attempt"))
        if todo.isEmpty():
            return units.join(out, ["as_kind", "value"], "left").where("attempt is not null or kind <> as_kind").select("kind", "value", "as_kind", F.coalesce("attempt", F.lit(0)).alias("attempt"))
        taken = taken.union(good.select("group", "made"))
    raise RuntimeError(f"surrogates still collide after {most} attempts")


def replaced(docs: DataFrame, key: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the text's entities replaced, and a column ``private_``: array of struct(kind, found, surrogate).

    Null text stays null and empty text empty, with no entities. Texts are read whole. Other columns pass through unchanged, a column named ``private_`` is
    refused. Equal entities have equal surrogates in all rows, so repeated rows stay alike; an empty table gives an empty result. No key: `secret_key`."""
    refuse(docs, "private_")
    key = key or secret_key(docs.sparkSession)
    later = written(later_attempts(docs, key, text_col), "later")
    some = later.limit(IN_PLAN + 1).collect()
    name = lambda u: F.concat_ws("|", u["kind"], u["value"])
    shown = F.concat_ws("|", "as_kind", "attempt")
    told, rows = None, docs
    if 0 < len(some) <= IN_PLAN:
        told = F.create_map(*[F.lit(x) for r in some for x in (f"{r.kind}|{r.value}", f"{r.as_kind}|{r.attempt}")])
    elif some:
        rid, rid2, own = (free(docs, n) for n in ("rid", "rid2", "later"))
        rows = docs.withColumn(rid, row_key(id_col, text_col)[0])
        units = rows.select(rid, F.explode(F.flatten(F.transform(entities(F.col(text_col)), lambda e: e["units"]))).alias("u")).select(rid, "u.kind", "u.value").distinct()
        by_row = units.join(later, ["kind", "value"]).groupBy(F.col(rid).alias(rid2)).agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("|", "kind", "value"), shown))).alias(own))
        rows = rows.join(by_row, F.col(rid) == F.col(rid2), "left")
        told = F.col(own)

    def made(u: Column) -> Column:
        if told is None:
            return surrogate(u["kind"], u["value"], F.lit(0), key)
        found = lambda t: F.struct(F.coalesce(F.substring_index(t, "|", 1), u["kind"]).alias("k"), F.coalesce(F.substring_index(t, "|", -1).cast("int"), F.lit(0)).alias("n"))
        return let(F.element_at(told, name(u)), lambda t: let(found(t), lambda x: surrogate(x["k"], u["value"], x["n"], key)))

    def unit(u: Column) -> Column:
        return rendered(u["kind"], u["shown"], made(u))

    def whole(e: Column) -> Column:
        return F.struct(e["kind"].alias("kind"), F.concat(e["head"], F.array_join(F.transform(e["units"], lambda u: u["shown"]), " ")).alias("found"), F.concat(e["head"], F.array_join(F.transform(e["units"], unit), " ")).alias("surrogate"))

    text = F.col(text_col)
    rows = rows.withColumn("private_", F.transform(entities(text), whole))
    joined = F.array_join(F.zip_with(F.split(text, PATTERN, -1), F.transform("private_", lambda e: e["surrogate"]), lambda p, s: F.concat(p, F.coalesce(s, F.lit("")))), "")
    rows = rows.withColumn(text_col, F.when(F.size("private_") > 0, joined).otherwise(text))
    return rows.select(*docs.columns, "private_")


def op2_private(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = replaced(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.size("private_").cast("long").alias("n_entities"), F.transform("private_", lambda e: e["kind"]).alias("kinds"), F.transform("private_", lambda e: e["surrogate"]).alias("surrogates"), "text")
