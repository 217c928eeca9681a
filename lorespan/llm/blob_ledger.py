"""Secret scans with an incremental blob ledger, in DataFrame functions only.

Every version of every file is a blob, named by the SHA-256 of its text. The ledger has one row for
each blob and rule version that was scanned, with the spans found. A scan looks up which rule
versions the ledger lacks for each blob, takes the text of the blob's least path, and runs only those;
spans are then joined back to all paths. A rule with a new version is scanned anew, others are not.
Texts of blobs that the ledger knows stay where they are.

Spans are code points, end exclusive. They come from the matches and from the pieces between them:
lengths of pieces and matches add up to offsets.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorespan.functions.text import let
from lorespan.llm.common import cut, perhaps, plain, shared_checkpoints

_SPANS = "array<struct<start:long,end:long>>"


@dataclass(frozen=True)
class Rule:
    """Matches of pattern, leftmost and not overlapping, whose group has at least `least` characters. hint: a pattern that every kept match fits, to skip texts by."""

    kind: str
    version: int
    pattern: str
    hint: str
    group: int = 0
    least: int = 0

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


_KEYS = "[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]"
_ASSIGN = f"({_KEYS})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
RULES = (
    Rule("assign", 1, _ASSIGN, _ASSIGN.removesuffix("+)") + "{12})", group=2, least=12),
    Rule("access", 1, "AKIA[A-Z0-9]{14,}", "AKIA[A-Z0-9]{14}"),
    Rule("hex", 1, "[0-9a-f]{16,}", "[0-9a-f]{16}"),
)


def in_parts(items: Column) -> Column:
    """Items of an array in order, as an array of about as many arrays as each has items.

    A fold that appends to an array copies it at each step; done part by part, it takes time in
    proportion to the items and the root of their number, not to their square.
    """
    root = lambda x: F.greatest(F.ceil(F.sqrt(F.size(x))).cast("int"), F.lit(1))
    starts = lambda x, n: F.when(F.size(x) > 0, F.sequence(F.lit(0), F.size(x) - 1, n)).otherwise(F.array().cast("array<int>"))
    return let(items, lambda x: let(root(x), lambda n: F.transform(starts(x, n), lambda i: F.slice(x, i + 1, n))))


def before_parts(parts: Column, of_part, join) -> Column:
    """For each part, join of of_part (a long) of those before it; 0 for the first."""
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<long>").alias("out"))
    return F.aggregate(F.transform(parts, of_part), zero, lambda acc, x: F.struct(join(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")))["out"]


def spans(text: Column, rule: Rule) -> Column:
    """array<struct<start, end>> of the rule's matches in text."""
    whole = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    part = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else whole
    gaps = F.transform(F.split(text, rule.pattern, -1), lambda p: F.length(p))
    found = let(whole, lambda w: F.zip_with(gaps, F.transform(F.arrays_zip(w.alias("w"), (part if rule.group else w).alias("p")), lambda m: F.struct(F.length(m["w"]).alias("n"), (F.length(m["p"]) >= rule.least).alias("kept"))), lambda gap, m: F.struct(gap.alias("gap"), m["n"].alias("n"), m["kept"].alias("kept"))))
    steps = F.filter(found, lambda x: x["n"].isNotNull())  # the piece after the last match is no gap

    def located(rows: Column, start: Column) -> Column:
        def add(acc, x):
            begin = acc["at"] + x["gap"]
            end = begin + x["n"]
            return F.struct(end.alias("at"), F.when(x["kept"], F.concat(acc["out"], F.array(F.struct(begin.alias("start"), end.alias("end"))))).otherwise(acc["out"]).alias("out"))

        return F.aggregate(rows, F.struct(start.alias("at"), F.array().cast(_SPANS).alias("out")), add)["out"]

    length = lambda rows: F.aggregate(rows, F.lit(0).cast("long"), lambda n, x: n + x["gap"] + x["n"])
    every = let(in_parts(steps), lambda parts: F.flatten(F.zip_with(parts, before_parts(parts, length, lambda a, b: a + b), located)))
    return F.when(text.rlike(rule.hint), every).otherwise(F.array().cast(_SPANS))


def blob(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def scan(versions: DataFrame, rules=RULES, ledger: DataFrame | None = None) -> DataFrame:
    """New ledger rows (blob, rule, found) for the blobs of versions (path, text) and the rules that the ledger lacks.

    found has the spans, mostly none. What the ledger lacks is settled on hashes and paths alone; texts
    move only if their blob is among that (or, rarely, seems so to `perhaps`). Equal rows of one path and
    blob are scanned once, since one of them stays.
    """
    versions = plain(versions, "path", "text")
    wanted = F.array(*(F.lit(r.name) for r in rules))
    named = versions.withColumn("blob", blob(F.col("text")))
    todo = named.groupBy("blob").agg(F.min("path").alias("path"))
    if ledger is not None:
        seen = ledger.where(F.col("rule").isin([r.name for r in rules])).groupBy("blob").agg(F.collect_set("rule").alias("seen"))
        todo = todo.join(seen, "blob", "left").withColumn("todo", F.array_except(wanted, F.coalesce("seen", F.array().cast("array<string>")))).where(F.size("todo") > 0)
        todo = cut(todo.select("blob", "path", "todo"))
        named = perhaps(todo, named, "blob").where("_perhaps")
    else:
        todo = todo.withColumn("todo", wanted)
    todo = todo.select(F.struct("blob", "path").alias("key"), "todo")
    texts = named.join(todo.hint("shuffle_hash"), (F.col("blob") == F.col("key.blob")) & F.col("path").eqNullSafe(F.col("key.path")))
    each = F.array(*(F.struct(F.lit(r.name).alias("rule"), F.when(F.array_contains("todo", r.name), spans(F.col("text"), r)).alias("found")) for r in rules))
    rows = texts.select("blob", F.filter(each, lambda x: x["found"].isNotNull()).alias("rows"))
    return rows.groupBy("blob").agg(F.first("rows").alias("rows")).select("blob", F.explode("rows").alias("x")).select("blob", "x.rule", "x.found")


def findings(versions: DataFrame, rules=RULES, ledger: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(the ledger's new rows, (blob, spans) of the blobs with findings); spans: array<struct<start, kind number, end, kind>>, sorted.

    Both are kept in the shared folder. Spans of rows that the old ledger has are among them.
    """
    shared_checkpoints(versions.sparkSession)
    new = cut(scan(versions, rules, ledger))
    every = new if ledger is None else new.unionByName(ledger.select("blob", "rule", "found"))
    number = F.coalesce(*(F.when(F.col("rule") == r.name, F.lit(i)) for i, r in enumerate(rules)))
    kind = F.split("rule", "@")[0]
    named = every.where(F.col("rule").isin([r.name for r in rules])).where(F.size("found") > 0).select("blob", number.alias("no"), kind.alias("kind"), "found")
    named = named.select("blob", F.transform("found", lambda x: F.struct(x["start"].alias("start"), F.col("no").alias("no"), x["end"].alias("end"), F.col("kind").alias("kind"))).alias("spans"))
    # equal ones follow each other in order; array_distinct would compare each with all
    once = lambda x: F.filter(x, lambda y, i: (i == 0) | (y != F.get(x, i - 1)))
    return new, cut(named.groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans")).select("blob", let(F.col("spans"), once).alias("spans")))


def scan_paths(versions: DataFrame, rules=RULES, ledger: DataFrame | None = None) -> DataFrame:
    """path, blob, spans of each row of versions (path, text).

    A null text is an empty one, with no spans. Repeated rows come back as often. A null path is a
    path like others. Texts may be of any length, and hold any number of matches. Columns beside path and text are left aside. An
    empty table gives an empty one.
    """
    _, found = findings(versions, rules, ledger)
    paths = plain(versions, "path", "text").select("path", blob(F.col("text")).alias("blob"))
    none = F.array().cast("array<struct<start:long,no:int,end:long,kind:string>>")
    return paths.join(found, "blob", "left").select("path", "blob", F.coalesce("spans", none).alias("spans"))


def listed(spans_: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans_, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def redacted(text: Column, spans_: Column) -> Column:
    """The text with each span (overlapping ones together) replaced by [kind]. Spans are sorted."""
    kept = "array<struct<at:long,start:long,kind:string>>"

    def apart(rows: Column, start: Column) -> Column:
        """Of a part of the spans those that don't begin inside what comes before, with the end of that."""

        def add(acc, x):
            fresh = F.concat(acc["out"], F.array(F.struct(acc["at"].alias("at"), x["start"].alias("start"), x["kind"].alias("kind"))))
            return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), F.when(x["start"] >= acc["at"], fresh).otherwise(acc["out"]).alias("out"))

        return F.aggregate(rows, F.struct(start.alias("at"), F.array().cast(kept).alias("out")), add)["out"]

    def shown(rows: Column) -> Column:
        """The pieces of text before the spans of a part, and what stands for these; cut out of the part's own text, so that no piece is looked for from the text's start."""
        first, last = rows[0]["at"], F.element_at(rows, -1)["start"]
        piece = lambda own, x: F.concat(F.substring(own, (x["at"] - first + 1).cast("int"), (x["start"] - x["at"]).cast("int")), F.lit("["), x["kind"], F.lit("]"))
        return let(F.substring(text, (first + 1).cast("int"), (last - first).cast("int")), lambda own: F.array_join(F.transform(rows, lambda x: piece(own, x)), ""))

    most = lambda rows: F.array_max(F.transform(rows, lambda x: x["end"]))
    alone = let(in_parts(spans_), lambda parts: F.flatten(F.zip_with(parts, before_parts(parts, most, F.greatest), apart)))
    tail = F.substring(text, (F.coalesce(most(spans_), F.lit(0)) + 1).cast("int"), F.length(text))
    return F.concat(let(in_parts(alone), lambda parts: F.array_join(F.transform(parts, shown), "")), tail)


def redact(docs: DataFrame, rules=RULES) -> DataFrame:
    """docs, in all their columns, with the secrets of text replaced and n_chars following where a text changed. Texts without findings aren't shuffled for that."""
    _, found = findings(docs.select(F.col("doc_id").alias("path"), "text"), rules)
    rows = perhaps(found, docs.select(F.struct(*docs.columns).alias("_doc"), blob(F.coalesce("text", F.lit(""))).alias("blob")), "blob")
    text = F.col("_doc.text")
    hits = rows.where("_perhaps").join(found, "blob", "left").select("_doc", F.col("spans").isNotNull().alias("_hit"), F.when(F.col("spans").isNotNull(), redacted(text, F.col("spans"))).otherwise(text).alias("_text"))
    every = hits.unionByName(rows.where("not _perhaps").select("_doc", F.lit(False).alias("_hit"), text.alias("_text")))
    new = {"text": F.col("_text"), "n_chars": F.when(F.col("_hit"), F.length("_text")).otherwise(F.col("_doc.n_chars") if "n_chars" in docs.columns else F.lit(0)).cast("long")}
    return every.select(*(new.get(c, F.col("_doc")[c]).alias(c) for c in docs.columns))
