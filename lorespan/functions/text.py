"""Column functions on text: tokens, sentences, cleaning, estimates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no topic. The shorter list is used for reuse of earlier results.
STOP_REUSE = "a an the and or of for to in on at is are do does i we you it that this what how want need know me my get tell give with about".split()
STOP = [*STOP_REUSE, "whats"]
# Openings of spoken requests that carry no content.
LEADS = ("hey", "hi", "hello", "okay", "ok", "so", "um", "uh", "well", "please", "could you", "can you", "i need", "i want", "i'd like", "tell me", "show me", "find me", "give me", "what about", "how about")
# White space as Unicode has it.
SPACE = r"(?U)\s+"
WHITE = "".join(map(chr, [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
SENTENCE = r"(?<=[.!?])\s+"


def let(value: Column, body) -> Column:
    """body(value), with the value computed and written into the plan once, however often body uses it."""
    return F.transform(F.array(value), body)[0]


def tokens(text: Column) -> Column:
    """Lower-cased runs of a-z and 0-9; none of null."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def singular(token: Column) -> Column:
    """A token with a common English plural ending taken off."""
    n = F.length(token)
    plain = token.endswith("s") & ~token.endswith("ss") & ~token.endswith("us")
    return F.when((n > 5) & token.endswith("ies"), F.concat(F.substring(token, F.lit(1), n - 3), F.lit("y"))).when((n > 4) & plain, F.substring(token, F.lit(1), n - 1)).otherwise(token)


def index_tokens(text: Column) -> Column:
    return F.transform(tokens(text), singular)


def term_set(text: Column) -> Column:
    return F.array_distinct(tokens(text))


def content_terms(text: Column, stop=STOP) -> Column:
    return F.array_except(tokens(text), F.array(*map(F.lit, stop)))


def strip(text: Column) -> Column:
    """Without white space at the ends; a search for it would look at all that lies between."""
    return F.btrim(text, F.lit(WHITE))


def squeeze(text: Column) -> Column:
    """White space as single spaces, none at the ends; null as empty."""
    return F.btrim(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " "))


def word_list(text: Column) -> Column:
    """Words between white space."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def n_words(squeezed: Column) -> Column:
    """How many words a squeezed text has: one more than spaces."""
    return F.when(squeezed == "", F.lit(0)).otherwise(F.length(squeezed) - F.length(F.replace(squeezed, F.lit(" "), F.lit(""))) + 1)


def clean(text: Column) -> Column:
    """Squeezed, without openings (one pass with a repeated group reaches the fixed point) and without , . ; or spaces at the ends."""
    leads = "(?i)^(?:(?:" + "|".join(LEADS) + r")\s+)+"
    return F.btrim(strip(F.regexp_replace(squeeze(text), leads, "")), F.lit(" ,.;"))


def sentences(text: Column) -> Column:
    """Sentences, trimmed, none empty."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), SENTENCE), strip), lambda s: s != "")


def ended(sentence: Column) -> Column:
    return F.when(sentence.rlike(r"[.!?]$"), sentence).otherwise(F.concat(sentence, F.lit(".")))


def estimated_tokens(text: Column) -> Column:
    """A quarter of the characters, 1 at least; 0 of an empty text."""
    n = F.length(F.coalesce(text, F.lit("")))
    return F.when(n == 0, F.lit(0)).otherwise(F.greatest(F.lit(1), F.floor(n / 4))).cast("long")


def whole_numbers(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\d+"), F.lit(0)), lambda n: n.try_cast("long"))


def display_tokens(text: Column) -> Column:
    """Words with the white space after them; a text without words as a whole; nothing of an empty one."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?U)\S+\s*"), F.lit(0))
    return let(found, lambda f: F.when(F.size(f) > 0, f).when(F.length(text) > 0, F.array(text)).otherwise(F.array().cast("array<string>")))


def ordered_distinct(items: Column) -> Column:
    """Trimmed, not empty, each at its first place."""
    return F.array_distinct(F.filter(F.transform(items, lambda s: strip(F.coalesce(s, F.lit("")))), lambda s: s != ""))


def json_text(text: Column) -> Column:
    """The JSON in a model's answer, as text: without code fences, or else from the first to the last brace or bracket; null if none parses."""
    bare = strip(F.regexp_replace(F.regexp_replace(strip(text), r"^```(?:json)?", ""), r"```$", ""))
    parses = lambda x: F.when(F.try_parse_json(F.nullif(x, F.lit(""))).isNotNull(), x)
    return let(bare, lambda b: F.coalesce(parses(b), let(F.regexp_extract(b, r"(?s)(\{.*\})", 1), parses), let(F.regexp_extract(b, r"(?s)(\[.*\])", 1), parses)))


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, with whole at least 1."""
    return part / F.greatest(whole, F.lit(1))


def overlap(a: Column, b: Column) -> Column:
    """Share of a's terms (sets) that b has; 0 of none."""
    return let(a, lambda x: F.when(F.size(x) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(x, b)) / F.greatest(F.size(x), F.lit(1))))
