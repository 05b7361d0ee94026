"""Information-theoretic sanitisation of personal data (operator 13), in DataFrame functions only.

Protected entities are what four patterns find: e-mail addresses, IP numbers, payment cards
(16 to 19 digits that pass Luhn's check) and phone numbers (8 to 15 digits). Masking them
is not enough where the words around still tell who is meant, so the corpus is asked how
strongly they do. The context of an entity in a document are the terms of at most
``REACH`` characters before and behind it. With N documents, n(e) and n(t) of them with entity
and term, and n(t, e) with the term in the entity's context, a term tells

    PMI(t; e) = log2(n(t, e) N / (n(t) n(e)))  of the  IC(e) = log2(N / n(e))  bits

that the entity holds. A term that tells at least ``BITS`` bits and the share ``GENERALISE``
of them, in at least ``CONTEXTS`` different contexts (so copies are one witness), is
generalised to its shape in the documents where it stands by the entity; from the share
``REMOVE`` on it is removed. Entities that more than N / 2^BITS documents have are no
secret and have no such terms. Documents without an entity are left alone.

A pattern's matches are found leftmost and without overlap; those that fail their check are
dropped. Quantifiers are possessive and matches begin at a run's first character
(or where the last match ended), which changes no match, takes time in proportion to the text and
needs no deep recursion. Places come from the lengths of matches and of the texts between
them, added up in chunks, so that many matches in a text stay cheap.

Contexts are bounded, so pairs of terms and entities grow with the mentions; equal ones
combine before they are shuffled. Nothing is broadcast by hand and no Python runs.

Defined results: null and empty texts have no spans; repeated documents and null ids have
their own rows; places are code points, ends exclusive; spans of different kinds may overlap; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .workspace import Workspace

KINDS = ("email", "ip", "card", "phone")
GENERALISED, REMOVED = "generalised", "removed"
#: Characters of a context on each side, least letters of a term, and the thresholds of disclosure.
REACH, LETTERS, CONTEXTS, BITS, GENERALISE, REMOVE = 160, 3, 3, 4.0, 0.75, 0.95

PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for its pattern to match at all.
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"(?:[0-9][\x20-]?){15}[0-9]", "phone": r"\+[0-9]"}
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
APART = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Lengths that are added up at once; sums over chunks come first.
CHUNK = 128


def _lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once: inside a lambda, what does not depend on it is worked out for each element."""
    return F.get(F.transform(F.array(value), use), 0)


def _running(numbers: Column, before: Column) -> Column:
    """Sums before each number, from ``before`` on."""
    start = F.struct(before.cast("long").alias("sum"), F.array().cast("array<long>").alias("out"))
    return F.aggregate(numbers, start, lambda a, x: F.struct((a["sum"] + x).alias("sum"), F.array_append(a["out"], a["sum"]).alias("out")), lambda a: a["out"])


def sums_before(numbers: Column) -> Column:
    """For an array of numbers the sum of those before each. An array that grows is copied, so it grows by chunks."""
    none = F.array().cast("array<array<long>>")

    def cut(all: Column) -> Column:
        return F.when(F.size(all) > 0, F.transform(F.sequence(F.lit(1), F.size(all), F.lit(CHUNK)), lambda k: F.slice(all, k, F.lit(CHUNK)))).otherwise(none)

    def summed(chunks: Column) -> Column:
        whole = F.transform(chunks, lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x))
        return F.flatten(F.zip_with(chunks, _running(whole, F.lit(0)), _running))

    return _let(_let(numbers, cut), summed)


def placed(text: Column, pattern: str) -> Column:
    """The matches ``m`` of a pattern, each with its place ``at``, the text before it (``g``, from the last match on) and behind it (``h``)."""

    def zipped(both: Column) -> Column:
        matches, gaps = both["m"], both["g"]
        before = F.slice(gaps, F.lit(1), F.size(matches))
        steps = F.zip_with(matches, before, lambda m, g: (F.length(m) + F.length(g)).cast("long"))
        parts = F.arrays_zip(matches.alias("m"), before.alias("g"), F.slice(gaps, F.lit(2), F.size(matches)).alias("h"), sums_before(steps).alias("s"))
        return F.transform(parts, lambda p: F.struct(p["m"].alias("m"), p["g"].alias("g"), p["h"].alias("h"), (p["s"] + F.length(p["g"])).alias("at")))

    return _let(F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("g")), zipped)


def _digits(c: Column) -> Column:
    return F.translate(c, " -().+", "")


def luhn(digits: Column) -> Column:
    """Luhn's check of 16 to 19 digits; a longer or shorter text fails."""
    n = F.length(digits)

    def value(k: Column) -> Column:
        v = F.substr(digits, n - k, F.lit(1)).cast("int") * (1 + k % 2)
        return v - F.when(v > 9, 9).otherwise(0)

    total = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda a, k: a + value(k))
    return F.when(n.between(16, 19), total % 10 == 0).otherwise(False)


def _octets(c: Column) -> Column:
    """Every part of a match is at most 255; parts may begin with zeros."""

    def small(part: Column) -> Column:
        bare = F.ltrim(part, F.lit("0"))
        return (F.length(bare) < 3) | ((F.length(bare) == 3) & (bare <= "255"))

    return F.forall(F.split(c, r"\."), small)


CHECKS = {"email": lambda c: F.lit(True), "ip": _octets, "card": lambda c: luhn(_digits(c)), "phone": lambda c: F.length(_digits(c)).between(8, 15)}
SPAN = "array<struct<kind:string,start:long,end:long,value:string,terms:array<string>>>"


def _terms(context: Column) -> Column:
    """Distinct terms of a context, lower-cased; the context's edges are cut off with the term they cut."""
    return F.array_distinct(F.filter(F.split(_lower(context), APART), lambda w: F.length(w) >= LETTERS))


def _before(gap: Column) -> Column:
    """The end of the text before a match, without a term that begins earlier."""
    return F.when(F.length(gap) > REACH, F.regexp_replace(F.right(gap, F.lit(REACH)), f"^{TERM}", "")).otherwise(gap)


def _behind(gap: Column) -> Column:
    return F.when(F.length(gap) > REACH, F.regexp_replace(F.left(gap, F.lit(REACH)), f"{TERM}$", "")).otherwise(gap)


def found(text: Column, kind: str) -> Column:
    """The valid matches of a kind with their places and the terms around them."""
    check = CHECKS[kind]

    def span(p: Column) -> Column:
        terms = F.array_union(_terms(_before(p["g"])), _terms(_behind(p["h"])))
        return F.struct(F.lit(kind).alias("kind"), p["at"].alias("start"), (p["at"] + F.length(p["m"])).alias("end"), p["m"].alias("value"), terms.alias("terms"))

    # the check comes first, so that only valid matches get a context
    valid = F.transform(F.filter(placed(text, PATTERNS[kind]), lambda p: check(p["m"])), span)
    return F.when(F.regexp_like(text, F.lit(HINTS[kind])), valid).otherwise(F.array().cast(SPAN))


def value_of(kind: Column, value: Column) -> Column:
    """One writing of an entity: letters lowered, digits only."""
    return F.when(kind.isin("card", "phone"), _digits(value)).otherwise(_lower(value))


def _shape(word: Column) -> Column:
    return F.when(F.regexp_like(word, F.lit("^[A-Z]")), "[name]").otherwise("[word]")


def _term_spans(text: Column, hits: Column) -> Column:
    """All places of the terms of ``hits`` (a map from term to action) in a text."""

    def span(p: Column) -> Column:
        return F.struct(hits[_lower(p["m"])].alias("kind"), p["at"].alias("start"), (p["at"] + F.length(p["m"])).alias("end"))

    return F.transform(F.filter(placed(text, TERM), lambda p: F.map_contains_key(hits, _lower(p["m"]))), span)


def detect(docs: DataFrame, ws: Workspace) -> DataFrame:
    """(row, doc_id, text, base): every document with its entities; written. ``text`` is null where there is none."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    read = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    spans = read.select("row", "doc_id", "text", F.concat(*(found(F.col("text"), kind) for kind in KINDS)).alias("base"))
    return ws.save(spans.select("row", "doc_id", F.when(F.size("base") > 0, F.col("text")).alias("text"), "base"), "base")


def disclosing(docs: DataFrame, base: DataFrame, ws: Workspace) -> tuple[DataFrame, DataFrame]:
    """(pairs, told): the terms around each entity by row, and how much a term tells of an entity."""
    mentions = base.where("text is not null").select("row", F.explode("base").alias("s")).select("row", "s.kind", value_of(F.col("s.kind"), F.col("s.value")).alias("value"), "s.terms")
    # an entity's mentions in one document are one context
    contexts = mentions.groupBy("row", "kind", "value").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("terms")))).alias("terms"))
    contexts = ws.save(contexts.withColumn("context", F.xxhash64("terms")), "contexts")
    pairs = contexts.select("row", "kind", "value", "context", F.explode("terms").alias("term"))
    together = pairs.groupBy("kind", "value", "term").agg(F.count("*").alias("n_both"), F.count_distinct("context").alias("n_contexts")).where(F.col("n_contexts") >= CONTEXTS)
    entities = contexts.groupBy("kind", "value").agg(F.count("*").alias("n_entity"))
    asked = together.join(entities, ["kind", "value"])
    each = docs.select(F.explode(F.array_distinct(F.filter(F.split(_lower(F.col("text").cast("string")), APART), lambda w: F.length(w) >= LETTERS))).alias("term"))
    everywhere = each.groupBy("term").agg(F.count("*").alias("n_term"))
    n = base.agg(F.count("*").alias("n")).first()["n"]
    told = asked.join(everywhere, "term").withColumns({"bits": F.log2(F.col("n_both") * n / (F.col("n_term") * F.col("n_entity"))), "secret": F.log2(F.lit(n) / F.col("n_entity"))})
    return pairs, told.withColumn("share", F.col("bits") / F.col("secret"))


def scan(docs: DataFrame, ws: Workspace) -> DataFrame:
    """(row, doc_id, text, base, added): every document with its entities and the spans of terms that disclose them."""
    base = detect(docs, ws)
    pairs, told = disclosing(docs, base, ws)
    action = F.when(F.col("share") >= REMOVE, REMOVED).otherwise(GENERALISED)
    strong = told.where((F.col("bits") >= BITS) & (F.col("share") >= GENERALISE)).select("kind", "value", "term", action.alias("action"))
    # "removed" is the greater name
    hits = pairs.join(strong, ["kind", "value", "term"]).groupBy("row", "term").agg(F.max("action").alias("action")).groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("term", "action"))).alias("hits"))
    hits = ws.save(hits, "hits")
    joined = base.join(hits, "row", "left")
    added = F.when(F.col("hits").isNotNull(), _term_spans(F.col("text"), F.col("hits"))).otherwise(F.array().cast("array<struct<kind:string,start:long,end:long>>"))
    return joined.select("row", "doc_id", "text", F.transform("base", lambda s: F.struct(s["kind"], s["start"], s["end"])).alias("base"), added.alias("added"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digests(spans: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans): counts and the lists of spans by kind and start."""
    counts = (F.aggregate("base", F.lit(0).cast("long"), lambda n, s: n + (s["kind"] == kind).cast("long")).alias(f"n_{kind}") for kind in KINDS)  # noqa: B023
    # "generalised" comes before "removed", and starts are in order within a kind
    return spans.select("doc_id", *counts, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.concat("base", F.array_sort("added"))).alias("spans"))


def sanitised(docs: DataFrame, ws: Workspace) -> DataFrame:
    """(row, doc_id, text): the texts of documents that hold entities, each piece of text in a span replaced.

    Entities become their kind in brackets, generalised terms their shape, removed ones
    nothing; spans that overlap are one, under the first one's replacement. Texts are cut at
    the edges of spans, a row for each piece, and joined again.
    """
    from pyspark.sql import Window

    whole = scan(docs, ws).where("text is not null")
    every = whole.select("row", F.explode(F.concat("base", "added")).alias("s")).select("row", "s.kind", "s.start", "s.end")
    order = Window.partitionBy("row").orderBy("start", F.desc("end"), "kind")
    reach = every.withColumn("reach", F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    runs = reach.withColumn("run", F.count_if(F.coalesce(F.col("start") >= F.col("reach"), F.lit(True))).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    merged = runs.groupBy("row", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("kind", F.struct("start", -F.col("end"), "kind")).alias("kind"))
    cuts = merged.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "end", "kind"))).alias("cuts"))

    def kept(text: Column, cuts: Column) -> Column:
        ends = F.concat(F.array(F.lit(0).cast("long")), F.transform(cuts, lambda c: c["end"]))
        starts = F.concat(F.transform(cuts, lambda c: c["start"]), F.array(F.length(text).cast("long")))
        return F.zip_with(ends, starts, lambda a, b: F.substr(text, (a + 1).cast("int"), (b - a).cast("int")))

    def put(text: Column, c: Column) -> Column:
        own = F.substr(text, (c["start"] + 1).cast("int"), (c["end"] - c["start"]).cast("int"))
        return F.when(c["kind"] == REMOVED, "").when(c["kind"] == GENERALISED, _shape(own)).otherwise(F.concat(F.lit("["), c["kind"], F.lit("]")))

    joined = whole.join(cuts, "row")
    masks = F.concat(F.transform("cuts", lambda c: put(F.col("text"), c)), F.array(F.lit("")))
    out = F.array_join(F.flatten(F.zip_with(kept(F.col("text"), F.col("cuts")), masks, lambda a, b: F.array(a, b))), "")
    return joined.select("row", "doc_id", out.alias("text"))
