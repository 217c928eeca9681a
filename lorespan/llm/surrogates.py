"""Surrogates for personal data, in DataFrame functions only.

Texts are searched once. E-mail addresses, phones, IP addresses, cards, social security numbers and
IBANs are found by their form. Names are found among words in capitals that follow each other: after a
form of address, after phrases that introduce a name, and after common given names; then, without any
of these, wherever else the text has them, and wherever another text has the same given and family
name together.

A surrogate depends on a key (by HMAC), the kind and the entity's canonical form, so that all mentions
of an entity in all documents get the same one, and is written in the form of the mention: digits take
the places of digits, case follows case, a given name keeps its gender, a name its script, a phone its
country code, an address its private or public range, a card number or IBAN its check digits. Over the
distinct entities of the corpus, rounds of a join assign surrogates that are neither taken nor the
canonical form of a real entity; who loses tries the next one. Private IPv4 addresses, of which a
corpus may have all, are permuted inside their range instead, which keeps them apart by itself.

Of a text without entities nothing moves; the others are shuffled once, to meet their replacements.
"""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorespan.llm.blob_ledger import in_parts
from lorespan.llm.common import Scratch, cut, perhaps, plain, shared_checkpoints

# Forms of address by gender, in the languages that are known here.
MALE = ("Mr", "Mister", "Sir", "Herr", "Herrn", "Señor", "Sr", "Don", "Monsieur", "M", "Signor", "г-н", "господин", "κύριος")
FEMALE = ("Mrs", "Ms", "Miss", "Madam", "Frau", "Señora", "Señorita", "Sra", "Srta", "Doña", "Madame", "Mme", "Mademoiselle", "Mlle", "Signora", "г-жа", "госпожа", "κυρία")
NEUTRAL = ("Dr", "Prof", "Doctor", "Professor", "Doktor", "Docteur", "Professeur", "Profesor", "Mx", "др", "д-р", "проф", "доктор", "профессор", "δρ", "καθ")
# Common given names by gender.
GIVEN_MALE = (
    "John James Robert Michael William David Richard Joseph Thomas Charles Daniel Matthew Anthony Mark Paul Steven Andrew George Edward Peter"
    " Hans Klaus Jürgen Wolfgang Stefan Andreas Heinrich Karl Pierre Jacques François Henri José Juan Carlos Miguel Luis Pedro Pablo Javier Antonio"
    " Francisco Giovanni Marco Paolo Ahmed Mohammed Omar Иван Сергей Алексей Дмитрий Владимир Γιώργος Νίκος Δημήτρης"
).split()
GIVEN_FEMALE = (
    "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Nancy Lisa Anna Emily Laura Julia Emma Alice Helen Margaret"
    " Ursula Petra Sabine Monika Claudia Ingrid Marie Sophie Camille Isabelle Nathalie Catherine María Carmen Isabel Lucía Elena Sofía Marta"
    " Francesca Giulia Chiara Fatima Aisha Анна Мария Елена Ольга Наталья Μαρία Ελένη Κατερίνα"
).split()
# Phrases that introduce a name.
CUES = (r"[Mm]y\x20name\x20is", r"[Mm]ein\x20Name\x20ist", r"[Jj]e\x20m['’]appelle", r"[Mm]e\x20llamo", r"[Mm]i\x20nombre\x20es", r"[Мм]еня\x20зовут")
#: Scripts: how a letter is told, and the syllables of surrogate names. The first three have endings of given names by gender.
SCRIPTS = {
    "cyrillic": (r"\p{IsCyrillic}", "ба до фе га ки ло ма ни по ра се ти ву зо ли ре".split()),
    "greek": (r"\p{IsGreek}", "βα δο φε γα κι λο μα νι πο ρα σε τι ζο λι ρε θε".split()),
    "latin": (r"\p{IsLatin}", "ba do fe ga hi jo ka li mo na pe ro sa ti vo wi".split()),
    "han": (r"\p{IsHan}", "安 白 成 东 方 国 海 建 康 林 明 宁 平 青 文 远".split()),
    "hangul": (r"\p{IsHangul}", "가 나 도 라 미 보 서 아 영 우 은 재 지 하 현 호".split()),
    "kana": (r"[\p{IsHiragana}\p{IsKatakana}]", "あ か さ た な は ま や ら わ き し ち に み り".split()),
    "arabic": (r"\p{IsArabic}", "با دا فا كا لا ما نا را سا تا وا يا جا حا شا ها".split()),
    "hebrew": (r"\p{IsHebrew}", "בא גא דא הא זא חא טא יא כא לא מא נא סא פא רא שא".split()),
    "devanagari": (r"\p{IsDevanagari}", "का खा गा चा जा ता दा ना पा बा मा या रा ला सा हा".split()),
    "thai": (r"\p{IsThai}", "กา ขา คา จา ชา ดา ตา ทา นา บา ปา มา ยา รา ลา สา".split()),
}
ENDINGS = {"latin": ("n", "ra", "s"), "cyrillic": ("н", "на", "с"), "greek": ("ς", "να", "ν")}
#: Country codes of phones by the plan of their first digits: one, two, else three digits.
COUNTRY = r"(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
#: Private and special IPv4 ranges, and their bits that are free.
PRIVATE = {r"^10\.": 24, r"^127\.": 24, r"^192\.168\.": 16, r"^169\.254\.": 16, r"^172\.(?:1[6-9]|2\d|3[01])\.": 20, r"^100\.(?:6[4-9]|[7-9]\d|1[01]\d|12[0-7])\.": 22}

_CAP = r"\p{Lu}[\p{L}\p{M}'’-]*+"
_UNCASED = r"[\p{IsHan}\p{IsHangul}\p{IsHiragana}\p{IsKatakana}\p{IsArabic}\p{IsHebrew}\p{IsDevanagari}\p{IsThai}\p{M}]{1,12}+"
_SMALL = "|".join(x for x in (*MALE, *FEMALE, *NEUTRAL) if x[0].islower())
#: Words in capitals that follow each other, with a form of address in small letters before them or a word of a script without capitals after them.
_RUN = rf"(?<![\p{{L}}\p{{N}}])(?:{_CAP}(?:(?:\.?\x20{_CAP})++(?:\.?\x20{_UNCASED})?+|\.?\x20{_UNCASED})|(?:{_SMALL})\.?\x20{_CAP}(?:\.?\x20{_CAP})*+)"
_CUE = rf"(?:{'|'.join(CUES)})\x20"
_INTRODUCED = rf"(?<![\p{{L}}\p{{N}}]){_CUE}{_CAP}(?:\x20{_CAP})?+"
#: Numbers without a country code: with the area in brackets, as 3-3-4 digits, or after a 0 in groups or in pairs.
_NATIONAL = (
    r"(?<![\w+.-])(?:(?:1[\x20.-]?)?\(\d{2,5}\)[\x20.-]?\d{3,4}[\x20.-]?\d{3,4}|(?:1[\x20.-])?\d{3}([\x20.-])\d{3}\1\d{4}"
    r"|0\d{1,4}[\x20/-]\d{3,4}[\x20-]?\d{3,5}|0\d(?:[\x20.-]\d{2}){4})(?![\w]|[.-]\d)"
)
_LETTER = r"[\p{L}\p{M}\p{N}"
#: Kinds and forms, by precedence where spans begin together. Runs are matched whole (possessively), so time is linear in the text.
FORMS = (
    ("email", rf"(?<!{_LETTER}._%+-]){_LETTER}._%+-]++@{_LETTER}-]++(?:\.{_LETTER}-]++)+"),
    ("phone", r"(?<![\w+])\+\d{1,3}[\x20.-]?\(?\d{1,4}+\)?(?:[\x20.-]?\(?\d{2,12}+\)?){1,6}+(?!\d)"),
    ("ip", r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\w]|\.\d)"),
    ("card", r"(?<![\w.+-])(?:\d{4}[\x20-]\d{4}[\x20-]\d{4}[\x20-]\d{4}|\d{4}[\x20-]\d{6}[\x20-]\d{4,5}|\d{13,19})(?![\w-])"),
    ("ssn", r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"),
    ("iban", r"(?<![\w])[A-Z]{2}\d{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![\w])"),
    ("phone", _NATIONAL),
    ("ipv6", r"(?<![\w:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?=[^:\s]*:(?:[^:\s]*:)*?:)(?:[0-9A-Fa-f]{1,4}:){1,7}(?::[0-9A-Fa-f]{1,4}){0,6}|::(?:[0-9A-Fa-f]{1,4}:){0,6}[0-9A-Fa-f]{1,4})(?![\w:])"),
)
#: What a text has that has any of these: an at sign, a run of digits and their separators, or colons around a group.
_HINT = r"@|\d[\d\x20()./-]{5,}\d|:[0-9A-Fa-f]{0,4}:"
#: Rounds in which a surrogate must not be a real entity's form; rounds at all, after which it is an error if some entity has none.
STRICT, ROUNDS = 24, 64
_MENTION = "struct<start:long,end:long,kind:string,gender:string,canon:string,surface:string>"
_PAIR = "struct<at:long,given:string,next:long,family:string>"


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def _none(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def folded(items: Column, start: Column, add, kind: str) -> Column:
    """What a fold over items puts out: add(at, x) is (the next at, what x puts out: an array of kind). start, at: long.

    A fold that appends to one array copies it at each step; this one appends part by part.
    """
    empty, whole = _none(kind), F.array().cast(f"array<array<{kind}>>")

    def step(acc, x):
        at, out = add(acc["at"], x)
        return F.struct(at.cast("long").alias("at"), F.concat(acc["out"], out.cast(f"array<{kind}>")).alias("out"))

    def part(acc, rows):
        done = F.aggregate(rows, F.struct(acc["at"].alias("at"), empty.alias("out")), step)
        return _let(done, lambda d: F.struct(d["at"].alias("at"), F.concat(acc["out"], F.array(d["out"])).alias("out")))

    return F.flatten(F.aggregate(in_parts(items), F.struct(start.cast("long").alias("at"), whole.alias("out")), part)["out"])


def located(text: Column, pattern: str | Column) -> Column:
    """array<struct<start, end, surface>> of the matches of pattern."""
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    kind = "struct<start:long,end:long,surface:string>"

    def add(at, x):
        start = at + F.length(x["gap"])
        end = start + F.length(x["whole"])
        return end, F.array(F.struct(start.alias("start"), end.alias("end"), x["whole"].alias("surface")))

    def placed(whole):
        steps = F.arrays_zip(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(whole)).alias("gap"), whole.alias("whole"))
        return F.when(F.size(whole) == 0, _none(kind)).otherwise(folded(steps, F.lit(0), add, kind))

    return _let(F.regexp_extract_all(text, pattern, F.lit(0)), placed)


def _script(word: Column) -> Column:
    out = F.lit("latin")
    for name, (letter, _) in reversed(SCRIPTS.items()):
        out = F.when(word.rlike(letter), name).otherwise(out)
    return out


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, r"\D", "")


def _canonical(kind: str, surface: Column) -> Column:
    if kind in ("email", "ipv6"):
        return F.lower(surface)
    if kind == "phone":
        return F.concat(F.when(surface.startswith("+"), "+").otherwise(""), _digits(surface))
    if kind in ("card", "ssn"):
        return _digits(surface)
    return F.upper(F.regexp_replace(surface, r"\x20", "")) if kind == "iban" else surface


def _mention(start, end, kind, gender, canon, surface) -> Column:
    return F.struct(start.alias("start"), end.alias("end"), kind.alias("kind"), gender.alias("gender"), canon.alias("canon"), surface.alias("surface"))


def formed(text: Column) -> Column:
    """Mentions of all kinds but names, in order; of overlapping ones the first, then the longest stays."""
    numbered = lambda no: lambda x: F.struct(x["start"].alias("start"), (-x["end"]).alias("back"), F.lit(no).alias("no"), x["surface"].alias("surface"))
    every = [F.transform(located(text, pattern), numbered(no)) for no, (_, pattern) in enumerate(FORMS)]
    kept = "struct<start:long,back:long,no:int,surface:string>"

    def keep(at, x):
        free = x["start"] >= at
        return F.when(free, -x["back"]).otherwise(at), F.when(free, F.array(x)).otherwise(_none(kept))

    def mention(x):
        kind, canon = F.lit(None).cast("string"), F.lit(None).cast("string")
        for no, (name, _) in enumerate(FORMS):
            kind, canon = F.when(x["no"] == no, name).otherwise(kind), F.when(x["no"] == no, _canonical(name, x["surface"])).otherwise(canon)
        private = reduce(Column.__or__, (x["surface"].rlike(p) for p in PRIVATE))
        return _mention(x["start"], -x["back"], F.when((kind == "ip") & private, "ip_private").otherwise(kind), F.lit(""), canon, x["surface"])

    # a phone has 8 to 15 digits; an abbreviated IPv6 address has a digit and at most seven groups
    real = lambda x: F.when(x["no"] == 1, F.length(_digits(x["surface"])).between(8, 15)).when(x["no"] == 7, x["surface"].rlike(r"\d") & (F.size(F.filter(F.split(x["surface"], ":"), lambda g: g != "")) <= 8)).otherwise(True)
    found = F.transform(folded(F.array_sort(F.filter(F.concat(*every), real)), F.lit(0), keep, kept), mention)
    return F.when(text.rlike(_HINT), found).otherwise(_none(_MENTION))


def _bare(word: Column) -> Column:
    """A word of a run without a full stop or a genitive."""
    return F.regexp_replace(word, r"(?:['’][sS]?)?\.?$", "")


def _one_of(words) -> Column:
    return F.array(*map(F.lit, words))


def runs(text: Column) -> Column:
    """array<struct<introduced, words: array<struct<at, word, title, dot, gender>>>>: words in capitals that follow each other. gender: that of a form of address or a common given name, n of other titles, else null."""
    kind = "struct<at:long,word:string,title:boolean,dot:boolean,gender:string>"

    def word(at, w):
        bare = _bare(w)
        title = F.array_contains(_one_of((*MALE, *FEMALE, *NEUTRAL)), bare)
        gender = F.when(F.array_contains(_one_of((*FEMALE, *GIVEN_FEMALE)), bare), "f").when(F.array_contains(_one_of((*MALE, *GIVEN_MALE)), bare), "m").when(title, "n")
        return F.struct(at.alias("at"), bare.alias("word"), title.alias("title"), w.endswith(".").alias("dot"), gender.alias("gender"))

    add = lambda at, w: (at + F.length(w) + 1, F.array(word(at, w)))
    words = lambda x: folded(F.split(x["surface"], " "), x["start"], add, kind)
    plain_ = F.transform(located(text, _RUN), lambda x: F.struct(F.lit(False).alias("introduced"), words(x).alias("words")))

    def after(x):
        rest = F.regexp_replace(x["surface"], "^" + _CUE, "")
        return F.struct(F.lit(True).alias("introduced"), words(F.struct((x["end"] - F.length(rest)).alias("start"), rest.alias("surface"))).alias("words"))

    return F.when(text.rlike(_CUE), F.concat(plain_, F.transform(located(text, _INTRODUCED), after))).otherwise(plain_)


def _word(words: Column, i: Column) -> Column:
    return F.try_element_at(words, F.greatest(i + 1, F.lit(1)).cast("int"))


def people(run: Column) -> Column:
    """array of names (arrays of mentions, the given name first if it is known) in a run: after a form of address or an introduction, or from a common given name on."""
    words = run["words"]

    def starts(x, i):
        titled = F.when(i == 0, run["introduced"]).otherwise(F.coalesce(_word(words, i - 1)["title"], F.lit(False)))
        common = x["gender"].isNotNull() & ~x["dot"] & F.coalesce(~_word(words, i + 1)["title"], F.lit(False))
        return ~x["title"] & (titled | common)

    flags = F.transform(words, starts)

    def name(x, i):
        second, third = _word(words, i + 1), _word(words, i + 2)
        follows = F.coalesce(~x["dot"] & ~second["title"], F.lit(False))
        initial = F.coalesce(second["dot"] & (F.length(second["word"]) == 1), F.lit(False))
        more = F.coalesce(~third["title"] & (initial | ~second["dot"]) & (initial | (F.size(words) == i + 3)), F.lit(False))
        before = F.when((i > 0) & _word(words, i - 1)["title"], _word(words, i - 1)["gender"])
        gender = F.coalesce(F.when(before != "n", before), x["gender"], F.lit("n"))
        one = lambda w, kind, g: _mention(w["at"], w["at"] + F.length(w["word"]), F.concat_ws("_", F.lit(kind), _script(w["word"])), g, F.lower(w["word"]), w["word"])
        family = lambda w: F.array(one(w, "family", F.lit("")))
        both = F.concat(F.array(one(x, "given", gender)), F.when(initial & more, _none(_MENTION)).otherwise(family(second)), F.when(more, family(third)).otherwise(_none(_MENTION)))
        # a name that began at the word before has this one already
        taken = F.coalesce(F.when(i > 0, F.element_at(flags, F.greatest(i, F.lit(1)))), F.lit(False)) & ~F.coalesce(_word(words, i - 1)["dot"], F.lit(False))
        return F.when(F.element_at(flags, i + 1) & ~taken, F.when(follows, both).otherwise(family(x)))

    return F.filter(F.transform(words, name), lambda n: n.isNotNull())


def pairs(run: Column) -> Column:
    """Neighbours in a run that could be given and family name."""
    made = lambda x, i: F.when(~x["title"] & ~x["dot"] & ~_word(run["words"], i + 1)["title"], F.struct(x["at"].alias("at"), x["word"].alias("given"), _word(run["words"], i + 1)["at"].alias("next"), _word(run["words"], i + 1)["word"].alias("family")))
    return F.filter(F.transform(run["words"], made), lambda p: p.isNotNull()).cast(f"array<{_PAIR}>")


def extracted(text: Column) -> Column:
    """struct<found: mentions in order, pairs: neighbours in capitals>, from one search of the text."""
    clear = lambda start, end, others: ~F.exists(others, lambda m: (m["start"] < end) & (start < m["end"]))

    def made(x):
        names = F.flatten(F.flatten(F.transform(x["runs"], people))).cast(f"array<{_MENTION}>")
        names = F.array_distinct(F.filter(names, lambda m: (m["canon"] != "") & clear(m["start"], m["end"], x["formed"])))
        free = F.filter(F.flatten(F.transform(x["runs"], pairs)), lambda p: clear(p["at"], p["next"] + F.length(p["family"]), x["formed"]))
        return _let(names, lambda n: F.struct(_with_bare(text, F.concat(x["formed"], n), n).alias("found"), free.alias("pairs")))

    return _let(F.struct(formed(text).alias("formed"), runs(text).alias("runs")), made)


def _with_bare(text: Column, found: Column, names: Column) -> Column:
    """found, in order, and, where the text has its names without a form of address, these mentions too."""

    def every(known):
        forms = F.array_distinct(F.flatten(F.transform(known, lambda m: F.array(m["surface"], F.upper(m["surface"]), F.initcap(m["surface"])))))
        longest = F.transform(F.array_sort(F.transform(forms, lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w")))), lambda x: x["w"])
        pattern = F.concat(F.lit(r"(?<![\p{L}\p{N}])(?:"), F.array_join(longest, "|"), F.lit(r")(?![\p{L}\p{M}\p{N}])"))

        def mention(x):
            one = F.array_min(F.transform(F.filter(known, lambda m: m["canon"] == F.lower(x["surface"])), lambda m: F.struct(m["kind"].alias("kind"), m["gender"].alias("gender"))))
            return _mention(x["start"], x["end"], F.coalesce(one["kind"], F.lit("")), F.coalesce(one["gender"], F.lit("")), F.lower(x["surface"]), x["surface"])

        more = F.filter(F.transform(located(text, pattern), mention), lambda m: (m["kind"] != "") & ~F.exists(found, lambda o: (o["start"] < m["end"]) & (m["start"] < o["end"])))
        return F.array_sort(F.concat(found, more))

    return F.when(F.size(names) == 0, F.array_sort(found)).otherwise(_let(names, every))


def _hmac(key: str, message: Column) -> Column:
    """HMAC-SHA256 as hexadecimal digits."""
    raw = key.encode()
    raw = (hashlib.sha256(raw).digest() if len(raw) > 64 else raw).ljust(64, b"\0")
    inner, outer = (F.lit(bytearray(b ^ x for b in raw)) for x in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(message, "UTF-8")), 256))), 256)


def _luhn(digits: Column) -> Column:
    """The sum that is a multiple of 10 for a valid card number."""
    figures = F.transform(F.split(F.reverse(digits), ""), lambda d: F.coalesce(d.try_cast("int"), F.lit(0)))
    doubled = F.transform(figures, lambda d, i: F.when(i % 2 == 0, d).when(d > 4, d * 2 - 9).otherwise(d * 2))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d)


def _mod97(iban: Column) -> Column:
    """1 for a valid IBAN: its first four characters at the end, letters as two digits, modulo 97."""
    turned = F.concat(F.substring(iban, F.lit(5), F.length(iban)), F.substring(iban, 1, 4))
    value = lambda c: F.coalesce(c.try_cast("int"), F.ascii(c) - 55)
    return F.aggregate(F.split(turned, ""), F.lit(0), lambda a, c: (a * F.when(c.rlike(r"\d"), 10).otherwise(100) + value(c)) % 97)


def _shaped(form: Column, letters: Column, figures: Column) -> Column:
    """form with its letters (each in its script, as far as known) and digits replaced, place by place, by those of two streams."""

    def one(ch, i):
        letter = F.substring(letters, i % 60 + 1, F.lit(1))
        other = F.when(ch.rlike(r"\p{IsCyrillic}"), F.translate(letter, "ghjklmnprs", "гхжклмнпрс")).when(ch.rlike(r"\p{IsGreek}"), F.translate(letter, "ghjklmnprs", "γχξκλμνπρσ")).otherwise(letter)
        return F.when(ch.rlike(r"^\p{Lu}$"), F.upper(other)).when(ch.rlike(r"^\p{L}$"), other).when(ch.rlike(r"^\d$"), F.substring(figures, i % 60 + 1, F.lit(1))).otherwise(ch)

    return F.array_join(F.transform(F.split(form, ""), one), "")


def _permuted(key: str, address: Column, bits: int) -> Column:
    """A private address with its last `bits` bits permuted (four Feistel steps with halves of as many bits)."""
    octets = F.split(address, r"\.")
    whole = F.aggregate(octets, F.lit(0).cast("long"), lambda a, o: a * 256 + o.cast("long"))
    half = 1 << bits // 2
    left, right = F.floor(whole / half) % half, whole % half

    # xor of numbers below half stays below it
    def feistel(state, i):
        mixed = F.conv(F.substring(_hmac(key, F.concat_ws("\x1f", F.lit("ip_private"), F.lit(str(bits)), i.cast("string"), state["r"].cast("string"))), 1, 8), 16, 10).cast("long") % half
        return F.struct(state["r"].alias("l"), state["l"].bitwiseXOR(mixed).alias("r"))

    end = F.aggregate(F.sequence(F.lit(1), F.lit(4)), F.struct(left.cast("long").alias("l"), right.cast("long").alias("r")), feistel)
    new = F.floor(whole / (1 << bits)).cast("long") * (1 << bits) + end["l"] * half + end["r"]
    return F.concat_ws(".", *((F.floor(new / (1 << s)) % 256).cast("long").cast("string") for s in (24, 16, 8, 0)))


def surrogate(key: str, kind: Column, canon: Column, attempt: int) -> Column:
    """The canonical form of an entity's surrogate: of the form of its own."""
    h = _hmac(key, F.concat_ws("\x1f", kind, canon, F.lit(str(attempt))))
    figures, letters = F.translate(h, "abcdef", "246813"), F.translate(h, "0123456789abcdef", "ghjklmnprsghjklm")
    number = lambda at, n=4: F.conv(F.substring(h, at, n), 16, 10).cast("int")
    nonzero = lambda figure: F.translate(figure, "0", "7")
    # e-mail: the local part by shape (longer if that gives no free one), the domain by its own hash, the last label kept
    local, domain = F.split_part(canon, F.lit("@"), F.lit(1)), F.split_part(canon, F.lit("@"), F.lit(2))
    d = F.translate(_hmac(key, F.concat_ws("\x1f", F.lit("domain"), domain)), "0123456789", "ghjklmnprs")
    tail = F.substring(letters, 50, attempt // 4)
    email = F.concat(_shaped(local, letters, figures), tail, F.lit("@"), F.substring(d, 1, 10), F.lit(".example."), F.regexp_extract(domain, r"([^.]+)$", 1))
    # phone: a country code, or a 0 or 1 before the area, is kept; the digit after it isn't 0
    head = F.when(canon.startswith("+"), F.regexp_extract(canon, r"^\+" + COUNTRY, 0)).otherwise(F.regexp_extract(canon, r"^(?:0|1(?=\d{10}$))?", 0))
    rest = F.length(canon) - F.length(head)
    phone = F.concat(head, nonzero(F.substring(figures, 1, 1)), F.substring(figures, F.lit(2), rest - 1))
    # address: public ones stay public, as their first octet is of a public range
    octets = [(number(1 + 4 * i) % 254 + 1).cast("string") for i in range(4)]
    ip = F.concat_ws(".", (number(1) % 89 + 11).cast("string"), *octets[1:])
    private = F.lit(None).cast("string")
    for pattern, bits in PRIVATE.items():
        private = F.when(canon.rlike(pattern), _permuted(key, canon, bits)).otherwise(private)
    # IPv6: the first group (the range) and the places of the others stay; the last one has as many digits as it takes
    first, others = F.regexp_extract(canon, "^[0-9a-f]*", 0), F.regexp_replace(canon, "^[0-9a-f]*", "")
    hexes = F.array_join(F.transform(F.split(others, ""), lambda ch, i: F.when(ch == ":", ":").when(ch == "", "").otherwise(F.substring(h, i % 60 + 1, F.lit(1)))), "")
    last = F.when(F.length(F.regexp_extract(others, "([0-9a-f]*)$", 1)) > 0, F.concat(F.regexp_replace(hexes, "[0-9a-f]+$", ""), F.regexp_replace(F.substring(h, 50, min(4, 1 + attempt)), "^0", "1"))).otherwise(hexes)
    ipv6 = F.concat(first, F.when(F.lit(attempt > 2) & (F.length(others) < 12), last).otherwise(hexes))
    # card: first digit kept; a valid number gets a valid one
    body = F.concat(F.substring(canon, 1, 1), F.substring(figures, F.lit(2), F.length(canon) - 2))
    check = (F.lit(10) - _luhn(F.concat(body, F.lit("0"))) % 10) % 10
    card = F.concat(body, F.when(_luhn(canon) % 10 == 0, check).otherwise((check + 1 + number(40) % 9) % 10).cast("string"))
    # IBAN: country kept; a valid number gets a valid one
    account = _shaped(F.substring(canon, F.lit(5), F.length(canon)), letters, figures)
    account = F.upper(account)
    right = F.lpad((F.lit(98) - _mod97(F.concat(F.substring(canon, 1, 2), F.lit("00"), account))).cast("string"), 2, "0")
    iban = F.concat(F.substring(canon, 1, 2), F.when(_mod97(canon) == 1, right).otherwise(F.substring(figures, 59, 2)), account)
    script = F.element_at(F.split(kind, "_"), -1)
    name = F.lit("")
    for s, (_, syllables) in SCRIPTS.items():
        pool = _one_of(syllables)
        n = (3 if s in ENDINGS else 2) + attempt // 3
        made = F.concat(*(F.element_at(pool, number(1 + 3 * i, 3) % len(syllables) + 1) for i in range(min(n, 18))))
        man, woman, family = ENDINGS.get(s, ("", "", ""))
        name = F.when(script == s, F.concat(made, F.when(kind.startswith("given_m"), man).when(kind.startswith("given_f"), woman).otherwise(family))).otherwise(name)
    return (
        F.when(kind == "email", email).when(kind == "phone", phone).when(kind == "ip", ip).when(kind == "ip_private", private).when(kind == "ipv6", ipv6)
        .when(kind == "card", card).when(kind == "ssn", F.concat(nonzero(F.substring(figures, 1, 1)), F.substring(figures, F.lit(2), F.length(canon) - 1))).when(kind == "iban", iban).otherwise(name)
    )


def assign(entities: DataFrame, key: str, scratch: Scratch) -> DataFrame:
    """kind, canon, surrogate of distinct entities (kind, canon): no two of a kind alike, none of them a real entity's form (private addresses aside, and what has tried STRICT times: of a form that nearly all real ones take up). An error if ROUNDS rounds leave some without."""
    permuted = entities.where("kind = 'ip_private'").withColumn("surrogate", surrogate(key, F.col("kind"), F.col("canon"), 0))
    pending, done = scratch.cut(entities.where("kind != 'ip_private'")), [permuted]
    real = pending.select("kind", F.col("canon").alias("surrogate"))
    for attempt in range(ROUNDS):
        if pending.isEmpty():
            return reduce(DataFrame.unionByName, done)
        tried = pending.withColumn("surrogate", surrogate(key, F.col("kind"), F.col("canon"), attempt)).where("surrogate != canon")
        taken = reduce(DataFrame.unionByName, (*([real] if attempt < STRICT else []), *(x.select("kind", "surrogate") for x in done[1:])), real.limit(0))
        won = scratch.cut(tried.join(taken, ["kind", "surrogate"], "left_anti").groupBy("kind", "surrogate").agg(F.min("canon").alias("canon")).select("kind", "canon", "surrogate"))
        done.append(won)
        pending = scratch.cut(pending.join(won, ["kind", "canon"], "left_anti"))
    if pending.isEmpty():
        return reduce(DataFrame.unionByName, done)
    raise ArithmeticError(f"no free surrogates after {ROUNDS} rounds for {pending.count()} entities")


def written(kind: Column, surface: Column, surrogate_: Column) -> Column:
    """The surrogate in the form of the mention."""
    new = F.regexp_replace(surrogate_, r"^\+", "")
    figures = F.transform(F.split(surface, ""), lambda ch, i: F.when(ch.rlike(r"^[0-9]$"), F.substring(new, F.length(_digits(F.substring(surface, F.lit(1), i + 1))), F.lit(1))).otherwise(ch))
    places = F.transform(F.split(surface, ""), lambda ch, i: F.when(ch == " ", " ").otherwise(F.substring(surrogate_, F.length(F.regexp_replace(F.substring(surface, F.lit(1), i + 1), " ", "")), F.lit(1))))
    loud = (surface == F.upper(surface)) & (surface != F.lower(surface))
    cased = F.when(loud & (F.length(surface) > 1), F.upper(surrogate_)).otherwise(F.initcap(surrogate_))
    return (
        F.when(kind.isin("phone", "card", "ssn"), F.array_join(figures, "")).when(kind == "iban", F.array_join(places, "")).when(kind.isin("ip", "ip_private"), surrogate_)
        .when(kind.isin("email", "ipv6"), F.when(loud, F.upper(surrogate_)).otherwise(surrogate_)).otherwise(cased)
    )


def replace(text: Column, edits: Column) -> Column:
    """The text with spans of edits (array<struct<start, end, new>>, in order, apart) replaced."""

    def shown(rows):
        """The pieces of text before the edits of a part, and what replaces these; cut out of the part's own text, so that no piece is looked for from the text's start."""
        first, last = rows[0]["at"], F.element_at(rows, -1)["start"]
        piece = lambda own, x: F.concat(F.substring(own, (x["at"] - first + 1).cast("int"), (x["start"] - x["at"]).cast("int")), x["new"])
        return _let(F.substring(text, (first + 1).cast("int"), (last - first).cast("int")), lambda own: F.array_join(F.transform(rows, lambda x: piece(own, x)), ""))

    def made(x):
        end = lambda i: F.coalesce(F.get(x, i)["end"], F.lit(0)).cast("long")
        steps = F.transform(x, lambda e, i: F.struct(end(i - 1).alias("at"), e["start"].alias("start"), e["new"].alias("new")))
        return F.concat(F.array_join(F.transform(in_parts(steps), shown), ""), F.substring(text, (end(F.size(x) - 1) + 1).cast("int"), F.length(text)))

    return _let(edits, made)


_NAME_ROW = ("doc_id", "hash", "start", "end", "kind", "gender", "canon", "surface")


def _repeated(seen: DataFrame, scratch: Scratch) -> DataFrame:
    """Mentions of full names that stand alone in one text and were found as names in another."""
    full = lambda found: F.filter(F.zip_with(found, F.slice(found, F.lit(2), F.greatest(F.size(found) - 1, F.lit(0))), lambda a, b: F.when(a["kind"].startswith("given_") & b["kind"].startswith("family_") & (b["start"] == a["end"] + 1), F.concat_ws(" ", a["canon"], b["canon"]))), lambda x: x.isNotNull())
    known = scratch.cut(seen.select(F.explode(full(F.col("found"))).alias("name")).distinct())
    rows = seen.select("doc_id", "hash", "found", F.explode("pairs").alias("p"))
    rows = rows.where(~F.exists("found", lambda m: (m["start"] == F.col("p.at")) | (m["start"] == F.col("p.next"))))
    rows = rows.select("doc_id", "hash", "p", F.concat_ws(" ", F.lower("p.given"), F.lower("p.family")).alias("name"))
    rows = perhaps(known, rows, "name").where("_perhaps").join(known, "name", "left_semi")
    one = lambda kind, at, word: _mention(F.col(at), F.col(at) + F.length(word), F.concat_ws("_", F.lit(kind), _script(F.col(word))), F.lit("n" if kind == "given" else ""), F.lower(word), F.col(word))
    both = F.array(one("given", "p.at", "p.given"), one("family", "p.next", "p.family"))
    return rows.distinct().select("doc_id", "hash", F.explode(both).alias("m")).select("doc_id", "hash", "m.*").select(*_NAME_ROW)


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """doc_id, text with surrogates, entities (array<struct<start, end, kind, new>> in offsets of the original) of each row of docs (doc_id, text).

    A null text is an empty one; texts may be of any length, doc_id of any type. Repeated rows come
    back as often, and alike. A row without doc_id is treated like others. A given name has the gender
    that most of its mentions tell, f of equals. Other columns are left aside; an empty table gives an
    empty one.
    """
    spark = docs.sparkSession
    shared_checkpoints(spark)
    docs = plain(docs, "doc_id", "text").withColumn("hash", F.xxhash64("text"))
    with Scratch(spark) as scratch:
        # exploded, and not filtered after, since a filter would be moved before the search and do it once more
        any_ = F.filter(F.array(extracted(F.col("text"))), lambda x: (F.size(x["found"]) > 0) | (F.size(x["pairs"]) > 0))
        seen = scratch.keep(docs.select("doc_id", "hash", F.explode(any_).alias("x")).select("doc_id", "hash", "x.*"))
        found = seen.select("doc_id", "hash", F.explode("found").alias("m")).select("doc_id", "hash", "m.*").select(*_NAME_ROW)
        found = scratch.cut(found.unionByName(_repeated(seen, scratch)))
        told = lambda g: F.count_if(F.col("gender") == g)
        gender = F.when((told("f") == 0) & (told("m") == 0), "n").when(told("f") >= told("m"), "f").otherwise("m")
        entities = found.groupBy("kind", "canon").agg(gender.alias("told"))
        entities = scratch.cut(entities.select(F.col("kind").alias("raw"), F.when(F.col("kind").startswith("given_"), F.concat(F.lit("given_"), F.col("told"), F.regexp_replace("kind", "^given", ""))).otherwise(F.col("kind")).alias("kind"), "canon"))
        named = assign(entities.select("kind", "canon"), key, scratch).join(entities, ["kind", "canon"]).select(F.col("raw").alias("_raw"), F.col("kind").alias("_kind"), F.col("canon").alias("_canon"), "surrogate")
        edits = found.join(named, (F.col("kind") == F.col("_raw")) & (F.col("canon") == F.col("_canon")))
        edits = edits.select("doc_id", "hash", F.struct("start", "end", F.col("_kind").alias("kind"), written(F.col("_kind"), F.col("surface"), F.col("surrogate")).alias("new")).alias("edit"))
        edits = cut(edits.groupBy("doc_id", "hash").agg(F.array_sort(F.collect_set("edit")).alias("entities")))
    none = _none("struct<start:long,end:long,kind:string,new:string>")
    flagged = perhaps(edits, docs, "hash")
    by_text = edits.select(F.col("doc_id").alias("_id"), F.col("hash").alias("_hash"), "entities")
    hits = flagged.where("_perhaps").join(by_text, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("hash") == F.col("_hash")), "left").select("doc_id", "text", F.coalesce("entities", none).alias("entities"))
    return hits.select("doc_id", replace(F.col("text"), F.col("entities")).alias("text"), "entities").unionByName(flagged.where("not _perhaps").select("doc_id", "text", none.alias("entities")))
