"""Column functions on spoken requests: entities, kinds of request, clauses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lorespan.functions.text import STOP, clean, content_terms, let, overlap, squeeze, strip, tokens, word_list
from lorespan.settings import DEFAULT, Settings

# Capitalised words that are no names, and words that fill a slot of a request.
NO_NAMES = (
    "The This That What When Where How Why Who Can Could Would Should Please Also And But For Actually Okay Hey Hi Hello Give Show Tell Make Need Want Let"
    " Are Does Did Have Has Book Find Our Their There"
).split()
SLOTS = "people person guests attendees seats capacity budget days day week weeks month months hours hour night nights am pm quarter percent %".split()
# Cities, kinds of place in order of precedence, and known places.
CITIES = ("pune", "bangalore", "mumbai", "delhi", "hyderabad", "chennai", "kolkata")
ALL_CITIES = ("pune", "bangalore", "bengaluru", "mumbai", "delhi", "hyderabad", "chennai", "kolkata")
PLACES = ("venue", "hotel", "restaurant", "event", "booking")
KNOWN_PLACES = ("orchid hall", "sahyadri conference centre", "indiranagar loft", "whitefield pavilion", "riverside studio", "koramangala studio", "baner annexe")
CAPACITY_WORDS = ("accommodate", "capacity", "people", "headcount", "seat")
# Patterns of presentation requests in order, of requests for something new, and of corrections.
PRESENTATION = (
    ("presentation_shorten", r"\b(shorter|shorten|summari[sz]e|summary|tl;?dr|condense|brief(?:er)?|cut it down|trim (?:that|it|this))\b"),
    ("presentation_restructure", r"\b(bullet(?:s| point.*)?|numbered list|as a list|as a table|format|reformat|restructure|rewrite)\b"),
    ("presentation_translate", r"\b(translate|in (?:hindi|spanish|french|german|punjabi|japanese|chinese|tamil|marathi))\b"),
    ("presentation_tone", r"\b(formal|simpler|simplify|plain english|casual|professional tone|explain it like)\b"),
    ("presentation_repeat", r"^\s*(say that again|repeat that|read it back|show (?:that|it) again)\b"),
)
NEW_INFORMATION = r"\b(what|which|when|where|who|why|how much|how many|cost|price|policy|deadline|capacity|rule|available|instead of|add\b.*\b(info|detail|section))\b"
CORRECTION = r"\b(actually|instead|make (?:that|it)|change (?:that|it)|wait|sorry|scratch that|correction|rather|no,|update that|also make|and make (?:that|it)|i meant)\b"
ELLIPSIS = r"^(?:and|but|also|plus|with|without|for|in|at|on|make|change|add|remove)\b"
NOT_TOPICAL = "what when where which this that with from about make need want know".split()
# How decisions on turns are accounted for.
WHY = {
    "no_form": "no_transform_intent_detected",
    "new": "transform_verb_present_but_new_information_requested",
    "empty": "empty_utterance",
    "no_answer": "no_prior_answer_to_transform",
    "no_state": "no_prior_state",
    "correction": "correction_marker_detected",
    "ellipsis": "ellipsis+topic",
    "topic": "new_topic",
}
# What separates clauses.
CLAUSE = r"\s*(?:,\s*and\s+|\s+and\s+also\s+|\s+and\s+|;\s*|\s+also\s+|\s+plus\s+|\s+as\s+well\s+as\s+|\?\s*)"
SECOND_INTENT = r"(?:retrieve|tell me|give me|show me|get|find)\s+(?:the\s+)?cancellation\s+policy\b"


def _lower(text: Column) -> Column:
    return F.lower(F.coalesce(text, F.lit("")))


def _any(text: Column, words) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | F.contains(text, F.lit(w))
    return found


def entities(text: Column) -> Column:
    """Sorted set of money:, num:, ent: and slot: entries."""
    t = F.coalesce(text, F.lit(""))
    money = F.transform(F.regexp_extract_all(t, F.lit(r"[$₹€£](?U)\s?\d[\d,]*(?:\.\d+)?"), F.lit(0)), lambda m: F.concat(F.lit("money:"), F.regexp_replace(m, SPACES, "")))
    numbers = F.transform(F.regexp_extract_all(t, F.lit(r"(?U)\b\d+(?:[.,]\d+)?\b"), F.lit(0)), lambda n: F.concat(F.lit("num:"), n))
    proper = F.array_except(F.regexp_extract_all(t, F.lit(r"(?U)\b[A-Z][a-zA-Z]{2,}\b"), F.lit(0)), F.array(*map(F.lit, NO_NAMES)))
    names = F.transform(proper, lambda w: F.concat(F.lit("ent:"), F.lower(w)))
    low = F.lower(t)
    # no slot is a part of another one's words, so one search meets them all
    slots = F.transform(F.regexp_extract_all(low, F.lit(rf"(?U)\b(?:{'|'.join(SLOTS)})\b"), F.lit(0)), lambda w: F.concat(F.lit("slot:"), w))
    return F.array_sort(F.array_distinct(F.concat(money, numbers, names, slots)))


SPACES = r"(?U)\s+"


def ends(text: Column, silence: Column, settings: Settings = DEFAULT) -> Column:
    """End of an utterance: silence or a closing mark."""
    return (F.coalesce(silence, F.lit(0.0)) >= settings.silence_s) | strip(F.coalesce(text, F.lit(""))).rlike(r"[.?!]$")


def is_capacity(text: Column) -> Column:
    q = _lower(text)
    return F.contains(q, F.lit("venue")) & _any(q, CAPACITY_WORDS)


def is_cancellation(text: Column) -> Column:
    return F.contains(_lower(text), F.lit("cancel"))


def known_places(text: Column) -> Column:
    return F.filter(F.array(*map(F.lit, KNOWN_PLACES)), lambda n: F.contains(_lower(text), n))


def presentation(text: Column, has_state: Column) -> Column:
    """struct<suppressed, reason, transform>: whether a turn only asks for another form of the answer."""
    return let(strip(F.coalesce(text, F.lit(""))), lambda t: _presentation(t, has_state))


def _presentation(t: Column, has_state: Column) -> Column:
    made = lambda yes, reason, kind: F.struct(F.lit(yes).alias("suppressed"), reason.alias("reason"), kind.alias("transform"))
    out = made(False, F.lit(WHY["no_form"]), F.lit(""))
    for kind, pattern in reversed(PRESENTATION):
        found = F.lower(F.regexp_extract(t, "(?i)" + pattern, 0))
        out = F.when(t.rlike("(?i)" + pattern), made(True, F.concat(F.lit(f"{kind}: matched '"), found, F.lit("'")), F.lit(kind))).otherwise(out)
    new = made(False, F.lit(WHY["new"]), F.lit(""))
    out = let(out, lambda o: F.when(o["suppressed"] & t.rlike("(?i)" + NEW_INFORMATION), new).otherwise(o))
    return F.when(t == "", made(False, F.lit(WHY["empty"]), F.lit(""))).when(~F.coalesce(has_state, F.lit(False)), made(False, F.lit(WHY["no_answer"]), F.lit(""))).otherwise(out)


def is_correction(text: Column) -> Column:
    return strip(F.coalesce(text, F.lit(""))).rlike("(?i)" + CORRECTION)


def topical_terms(text: Column) -> Column:
    return F.array_distinct(F.filter(F.array_except(tokens(text), F.array(*map(F.lit, NOT_TOPICAL))), lambda t: F.length(t) >= 4))


def refines(text: Column, prior: Column, claims: Column, topic: Column) -> Column:
    """struct<refine, reason>: a correction of the answer, or an ellipsis on its topic. topic: the best cosine with a claim or the prior utterance."""
    t = strip(F.coalesce(text, F.lit("")))
    old = F.array_union(topical_terms(prior), F.flatten(F.transform(claims, topical_terms)))
    lexical = let(topical_terms(t), lambda new: F.size(F.array_intersect(new, old)) / F.greatest(F.size(new), F.lit(1)))
    same = t.rlike("(?i)" + ELLIPSIS) & (topic > 0.20) & (lexical >= 0.25)
    made = lambda yes, reason: F.struct(yes.alias("refine"), reason.alias("reason"))
    topical = let(same, lambda x: made(x, F.when(x, WHY["ellipsis"]).otherwise(WHY["topic"])))
    return F.when((t == "") | (F.size(claims) <= 0) | claims.isNull(), made(F.lit(False), F.lit(WHY["no_state"]))).when(is_correction(t), made(F.lit(True), F.lit(WHY["correction"]))).otherwise(topical)


def clauses(text: Column, most: int = DEFAULT.max_sub_queries) -> Column:
    """The independent requests of an utterance; later ones get the place and city of the first, where they lack them."""
    return let(clean(text), lambda whole: F.when(whole == "", F.array().cast("array<string>")).otherwise(let(_parts(whole, most), lambda kept: F.when(F.size(kept) <= 1, kept).otherwise(_in_context(whole, kept)))))


def _parts(whole: Column, most: int) -> Column:
    """Clauses of a cleaned utterance; those under three words go on with the one before."""
    parts = F.filter(F.transform(F.split(whole, "(?i)" + CLAUSE), lambda p: F.btrim(p, F.lit(" ,.;"))), lambda p: p != "")

    def add(acc, p):
        last = F.concat(F.try_element_at(acc, F.lit(-1)), F.lit(" "), p)
        short = (F.size(acc) > 0) & (F.size(word_list(p)) < 3)
        return F.when(short, F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.array(last))).otherwise(F.concat(acc, F.array(p)))

    joined = F.aggregate(parts, F.array().cast("array<string>"), add, lambda acc: F.when(F.size(acc) == 0, F.array(whole)).otherwise(acc))
    return F.transform(F.slice(joined, 1, most), lambda p: F.coalesce(F.nullif(clean(p), F.lit("")), p))


def _in_context(whole: Column, kept: Column) -> Column:
    """Clauses after the first with its kind of place and the cities of the utterance, where they lack one."""
    bare = F.transform(word_list(whole), lambda w: F.regexp_replace(w, "[^A-Za-z0-9%.-]", ""))
    cities = F.filter(bare, lambda w: F.lower(w).isin(*CITIES))
    place = let(F.lower(F.try_element_at(kept, F.lit(1))), lambda first: F.coalesce(*(F.when(F.contains(first, F.lit(p)), F.lit(p)) for p in PLACES)))

    def with_context(c):
        suffix = F.array_join(F.concat(F.filter(F.array(c["place"]), lambda p: p.isNotNull()), c["cities"]), " ")
        return let(suffix, lambda x: F.transform(kept, lambda part, i: F.when((i == 0) | (x == ""), part).otherwise(complete(part, c, x))))

    def complete(part, c, suffix):
        said = F.regexp_extract_all(F.lower(part), F.lit(r"(?U)\w+"), F.lit(0))

        def lacks(words):
            named = F.coalesce(F.array_contains(words, c["place"]), F.lit(False))
            placed = (F.size(c["cities"]) == 0) | F.exists(c["cities"], lambda city: F.array_contains(words, F.regexp_replace(F.lower(city), "[^a-z0-9]", "")))
            return ~named | ~placed

        more = F.when(let(said, lacks), F.concat(part, F.lit(" "), suffix)).otherwise(part)
        return let(more, lambda m: F.coalesce(F.nullif(clean(m), F.lit("")), m))

    return let(F.struct(place.alias("place"), cities.alias("cities")), with_context)


def repaired(text: Column, sub_queries: Column, most: int = DEFAULT.max_sub_queries) -> Column:
    """A single sub-query into which a second intent was glued, split again along the utterance or, failing that, before that intent."""
    glued = "(?i)" + SECOND_INTENT

    def fixed(x):
        wrong = (F.size(sub_queries) == 1) & (x["said"] != "") & (x["one"] != "") & x["said"].rlike(r"(?i)\b(?:and\s+)?" + SECOND_INTENT) & x["one"].rlike(glued)
        return F.when(wrong, let(clauses(x["said"], most), lambda again: F.when(F.size(again) >= 2, again).otherwise(halves(x["one"])))).otherwise(sub_queries)

    def halves(one):
        cut_ = let(F.regexp_instr(one, F.lit(glued)), lambda at: F.struct(clean(F.substring(one, F.lit(1), at - 1)).alias("a"), clean(F.substring(one, at, F.length(one))).alias("b")))
        return let(cut_, lambda h: F.when((h["a"] != "") & (h["b"] != ""), F.array(h["a"], h["b"])).otherwise(sub_queries))

    return let(F.struct(clean(text).alias("said"), clean(F.try_element_at(sub_queries, F.lit(1))).alias("one")), fixed)


def contextualised(text: Column, sub_queries: Column) -> Column:
    """Sub-queries with the place and cities of the utterance; a later one on cancellation of a venue is put in standard words, others lose head counts."""
    low = _lower(text)
    bare = F.transform(word_list(text), lambda w: F.regexp_replace(F.lower(w), "[^a-z0-9]", ""))
    cities = F.array_distinct(F.filter(bare, lambda w: w.isin(*ALL_CITIES)))
    place = F.coalesce(*(F.when(low.rlike(rf"\b{p}\b"), F.lit(p)) for p in PLACES))
    context = let(cities, lambda c: F.struct(place.alias("place"), c.alias("cities"), F.when(F.size(c) > 0, F.concat(F.lit(" in "), F.array_join(c, " and "))).otherwise("").alias("where")))

    def later(q, c):
        ql = F.lower(q)
        standard = F.concat(F.lit("retrieve the cancellation policy for the venue"), c["where"])
        less = strip(F.regexp_replace(strip(F.regexp_replace(q, r"(?i)\b(?:for|of|with)\s+\d+\s+people\b", "")), r"(?i)\b\d+\s+people\b", ""))
        lacks = c["place"].isNotNull() & ~F.coalesce(F.array_contains(F.split(ql, r"\W+"), F.coalesce(c["place"], F.lit(""))), F.lit(False))
        far = (F.size(c["cities"]) > 0) & ~F.exists(c["cities"], lambda city: F.contains(ql, city))
        more = F.concat(less, F.when(lacks, F.concat(F.lit(" "), c["place"])).otherwise(""), F.when(far, c["where"]).otherwise(""))
        return F.when(F.contains(ql, F.lit("cancellation")) & F.coalesce(c["place"] == "venue", F.lit(False)), standard).otherwise(more)

    return let(context, lambda c: F.transform(sub_queries, lambda q, i: squeeze(let(strip(q), lambda s: F.when(i == 0, s).otherwise(later(s, c))))))


def responsive(claim: Column, sub_query: Column, cosine: Column) -> Column:
    """Whether a drafted claim speaks to a sub-query, rate comparisons aside where no rates are asked for."""
    wanted, said = content_terms(sub_query, STOP), content_terms(claim, STOP)
    near = (cosine >= 0.35) | (overlap(wanted, said) >= 0.40)
    c, q = _lower(claim), _lower(sub_query)
    rates = c.rlike(r"\brates?\b") | F.contains(c, F.lit("percent higher")) | F.contains(c, F.lit("provisional booking"))
    asked = q.rlike(r"\brates?\b") | _any(q, ("cost", "price", "provisional"))
    return near & (~rates | asked)
