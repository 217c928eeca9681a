"""Column functions that hold claims against evidence: support, relevance, and claims read off chunks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lorespan.functions.requests import ALL_CITIES, is_cancellation, is_capacity, known_places
from lorespan.functions.text import content_terms, ended, let, overlap, sentences, strip, term_set, word_list
from lorespan.functions.vectors import dot
from lorespan.settings import DEFAULT, Settings

# Signs of a cancellation rule, and words of policies in general.
RULE_SIGNS = (
    "cancellations made", "cancellations between", "cancellations inside", "incur no charge", "percent of the venue fee", "full venue fee", "cancellation inside",
    "reschedule, not a cancellation", "one free reschedule", "applicable cancellation tier", "must be authorised",
)
POLICY_WORDS = ("policy", "rules", "fee", "charge", "notice")
POLICY_FOCUS = "policy policies cancellation cancel venue rules fee fees charge charges notice standard event events reschedule".split()
_SEATS = r"(?i)([A-Z][A-Za-z0-9&' -]+?)\s+(?:seats|accommodates?)\s+(\d+)(\s+people\b)?([^.]*\.)"
# The same matches as of ([A-Z][A-Za-z0-9&' -]+?)\s+(?:seats|accommodates?)\s+(\d+)..., each looked for once in a run of
# the characters of names: if none begins at the run's first letter, none does at a later one. White space
# is never given back, since what follows it begins with none.
_NAMED = r"(?i)(?:(?<![A-Za-z0-9&' -])|\G)[0-9&' -]*+([A-Z](?:[A-Za-z0-9&' -]|[A-Za-z0-9&' -]+?(?<! )))\s++(?:seats|accommodates?)\s++"
_SEATS_ONCE, _SEATS_OPEN = _NAMED + r"(\d++)(\s++people\b)?+([^.]*+\.)", _NAMED + r"(\d++)(?:\s++people\b)?+"


def _has_any(text: Column, words) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | F.contains(text, F.lit(w))
    return found


def _names_city(city: Column, text: Column) -> Column:
    return F.contains(text, city) | ((city == "bengaluru") & F.contains(text, F.lit("bangalore")))


def claim_overlap(claim: Column, text: Column) -> Column:
    return overlap(term_set(claim), term_set(text))


def entails(lexical: Column, semantic: Column, settings: Settings = DEFAULT) -> Column:
    return (lexical >= settings.entail_lexical) | (semantic >= settings.entail_semantic)


def support(lexical: Column, semantic: Column, settings: Settings = DEFAULT) -> Column:
    """How well a chunk supports a claim; null if it doesn't."""
    good = (lexical >= settings.min_support) & entails(lexical, semantic, settings)
    return F.when(good, 0.7 * lexical + 0.3 * F.greatest(semantic, F.lit(0.0)))


def relevant(query: Column, text: Column, score: Column, settings: Settings = DEFAULT) -> Column:
    """Whether a retrieved chunk may answer a query: its cities, named places, policy topic and rules, then its score or overlap."""
    bare = F.transform(word_list(query), lambda w: F.lower(F.regexp_replace(w, "[^A-Za-z0-9%.-]", "")))
    asked = F.struct(
        F.lower(F.coalesce(query, F.lit(""))).alias("q"),
        F.lower(F.coalesce(text, F.lit(""))).alias("c"),
        F.array_distinct(content_terms(query)).alias("wanted"),
        F.array_distinct(content_terms(text)).alias("held"),
        F.array_distinct(F.filter(bare, lambda w: w.isin(*ALL_CITIES))).alias("cities"),
        known_places(query).alias("places"),
        is_cancellation(query).alias("cancels"),
        is_capacity(query).alias("seats"),
    )

    def fits(x):
        policy = x["cancels"] | _has_any(x["q"], POLICY_WORDS)
        topic = F.array_except(F.array_except(x["wanted"], F.array(*map(F.lit, POLICY_FOCUS))), x["cities"])
        there = F.forall(x["cities"], lambda city: _names_city(city, x["c"]))
        named = (F.size(x["places"]) == 0) | F.exists(x["places"], lambda p: F.contains(x["c"], p))
        topical = ~policy | x["cancels"] | strip(x["q"]).isin("policy", "the policy") | let(topic, lambda t: (F.size(t) == 0) | F.arrays_overlap(t, x["held"]))
        ruled = ~(policy & F.contains(x["q"], F.lit("venue"))) | _has_any(x["c"], RULE_SIGNS)
        share = F.size(F.array_intersect(x["wanted"], x["held"])) / F.greatest(F.size(x["wanted"]), F.lit(1))
        enough = let(share, lambda s: (score >= settings.min_relevance) | (s >= settings.min_query_overlap) | (x["seats"] & (s >= 0.20)))
        return there & named & topical & ruled & enough

    return let(asked, fits)


def _first_of_equals(items: Column) -> Column:
    """Items without those that equal an earlier one but for case."""
    return let(items, lambda a: let(F.transform(a, lambda s: F.lower(s)), lambda low: F.filter(a, lambda s, i: F.array_position(low, F.lower(s)) == i + 1)))


def capacity_sentences(text: Column, required: Column) -> Column:
    """Statements that a place seats the number required, or more."""
    whole = F.regexp_extract_all(text, F.lit(_SEATS_ONCE), F.lit(0))
    found = F.transform(whole, lambda m: F.struct(*(F.regexp_extract(m, _SEATS_ONCE, g).alias(n) for g, n in enumerate(("name", "seats", "people", "tail"), 1))))
    kept = F.filter(found, lambda x: F.coalesce(x["seats"].try_cast("long") >= required, F.lit(False)))
    return F.transform(kept, lambda x: F.concat(strip(x["name"]), F.lit(" seats "), x["seats"].try_cast("long").cast("string"), F.when(x["people"] != "", " people").otherwise(""), x["tail"]))


def required_people(query: Column) -> Column:
    return F.nullif(F.regexp_extract(F.lower(query), r"\b(\d+)\s+people\b", 1), F.lit("")).try_cast("long")


def capacity_claim(query: Column, evidence: Column) -> Column:
    """struct<text, ids> of all places in the evidence (array of chunk_id, text) that seat enough; null if the query doesn't ask for it or none does."""
    made = let(required_people(query), lambda n: _claim(evidence, lambda text: capacity_sentences(text, n), lambda found: F.array_join(found, " ")))
    return F.when(is_capacity(query) & required_people(query).isNotNull(), made)


def _claim(evidence: Column, read, join) -> Column:
    """struct<text, ids> of what is read off the evidence, each statement once; null if there is none."""
    each = F.transform(evidence, lambda e: F.struct(e["chunk_id"].alias("chunk_id"), read(e["text"]).alias("found")))
    text = lambda good: join(_first_of_equals(F.flatten(F.transform(good, lambda e: e["found"]))))
    return let(F.filter(each, lambda e: F.size(e["found"]) > 0), lambda good: F.when(F.size(good) > 0, F.struct(text(good).alias("text"), F.slice(F.transform(good, lambda e: e["chunk_id"]), 1, 5).alias("ids"))))


def place_names(query: Column, evidence: Column, city_documents: dict[str, tuple[str, ...]] | None = None) -> Column:
    """Names of places that seat enough, from chunks (doc_id, text) of the city asked for or of documents known to be of it (city_documents: their ids in small letters by city)."""
    q = F.lower(query)
    city = F.coalesce(*(F.when(F.contains(q, F.lit(c)), F.lit(c)) for c in ALL_CITIES))
    hint = F.create_map(*(x for c, docs in city_documents.items() for x in (F.lit(c), F.array(*map(F.lit, docs))))) if city_documents else F.lit(None).cast("map<string,array<string>>")
    of_city = lambda e: city.isNull() | _names_city(city, F.lower(e["text"])) | F.coalesce(F.array_contains(F.try_element_at(hint, city), F.lower(e["doc_id"])), F.lit(False))

    def names(e):
        found = F.arrays_zip(F.regexp_extract_all(e["text"], F.lit(_SEATS_OPEN), F.lit(1)).alias("name"), F.regexp_extract_all(e["text"], F.lit(_SEATS_OPEN), F.lit(2)).alias("seats"))
        return F.transform(F.filter(found, lambda x: F.coalesce(x["seats"].try_cast("long") >= F.coalesce(required_people(query), F.lit(0)), F.lit(False))), lambda x: strip(x["name"]))

    every = F.flatten(F.transform(F.filter(evidence, of_city), names))
    return F.when(is_capacity(query), _first_of_equals(F.filter(every, lambda n: n != ""))).otherwise(F.array().cast("array<string>"))


def cancellation_claim(query: Column, evidence: Column) -> Column:
    """struct<text, ids>: the rule sentences of the evidence that fits the cities asked for; null if the query isn't on cancellation or there are none."""
    q = F.lower(query)
    cities = F.filter(F.array(*map(F.lit, ALL_CITIES)), lambda c: F.contains(q, c))
    fits = F.filter(evidence, lambda e: (F.size(cities) == 0) | F.exists(cities, lambda c: _names_city(c, F.lower(e["text"]))))
    rules = lambda text: F.filter(sentences(text), lambda s: _has_any(F.lower(s), RULE_SIGNS))
    return F.when(is_cancellation(query), _claim(fits, rules, lambda found: F.array_join(F.transform(found, ended), " ")))


def long_sentences(text: Column) -> Column:
    return F.filter(sentences(text), lambda s: F.length(s) > 25)


def best_sentence(text: Column, query_terms: Column, query_vec: Column, vecs: Column) -> Column:
    """The sentence of a text that answers a query best (vecs: the vectors of its long_sentences); the first of equals, the whole text if it has no long one."""
    found = long_sentences(text)

    def score(s, v):
        lexical = F.size(F.array_intersect(query_terms, term_set(s))) / F.greatest(F.size(query_terms), F.lit(1))
        return 0.55 * lexical + 0.45 * F.greatest(dot(query_vec, v), F.lit(0.0))

    best = let(F.zip_with(found, vecs, score), lambda scores: F.try_element_at(found, F.array_position(scores, F.array_max(scores)).cast("int")))
    return F.when(F.size(vecs) == 0, strip(text)).otherwise(let(best, ended))


def draft_key(text: Column) -> Column:
    from lorespan.functions.text import tokens

    return F.substring(F.array_join(F.array_sort(tokens(text)), " "), 1, 240)
