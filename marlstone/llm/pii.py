"""Operator 4 (DataFrame functions only): personal data and the terms that give it away.

Base spans are e-mail addresses, IPv4 addresses, card numbers and phone numbers by pattern and checksum. The method adds
spans. Each base span protects entities from narrow to wide: the value itself, what it has in common with its like (an
address's domain, an IPv4 address's first two parts, a card's first six digits, a phone number without its last four)
and its kind. A term (a word of a document with a protected entity) discloses the entity as strongly as knowing the term
makes the entity likelier, PMI(term; entity) = ln(n_both * N / (n_term * n_entity)), relative to the entity's own
information IC(entity) = ln(N / n_entity). All are numbers of whole documents of the corpus. A term whose ratio PMI / IC
reaches ``disclosure`` is generalised wherever it stands in documents with the entity, if at least ``least_texts``
different texts hold both (one text, or copies of one, are no evidence of a link).

Edge cases: null text counts as empty and has no span; repeated rows get the same spans; a null ``doc_id`` is kept; an
empty table gives no row; further columns are ignored. Offsets count code points, ends are exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import sized, written

KINDS = ("email", "ip", "card", "phone")
TERM = "term"
#: The contract's patterns. Runs are possessive and begin where no character of the run precedes (or where the last
#: match ended, \\G), which finds the same matches and keeps the time linear on long runs.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to be tried.
HINTS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
WORD = r"\p{L}{3,}"
SPAN = "array<struct<kind:int,start:int,end:int,value:string>>"


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits has a sound check digit."""
    n = F.length(digits)

    def add(total, i):
        d = F.substring(digits, n - i + 1, F.lit(1)).cast("int")
        twice = d * 2
        return total + F.when(i % 2 == 0, twice - F.when(twice > 9, 9).otherwise(0)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def _valid(kind: str, v: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(v, r"\."), lambda x: F.coalesce(x.try_cast("int") <= 255, F.lit(False)))
    if kind == "card":
        d = _digits(v)
        return F.when(F.length(d).between(16, 19), luhn(d)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(_digits(v)).between(8, 15)
    return F.lit(True)


def located(text: Column, pattern: str, kind: int) -> Column:
    """Matches with their places.

    The pieces between matches come from a split by the same pattern; running lengths give the offsets.
    """
    found, pieces = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    zipped = F.zip_with(pieces, found, lambda p, v: F.struct(v.alias("v"), p.alias("p")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))

    def step(acc, x):
        at = acc["at"] + F.length(x["p"])
        end = at + F.coalesce(F.length(x["v"]), F.lit(0))
        one = F.array(F.struct(F.lit(kind).alias("kind"), at.alias("start"), end.alias("end"), x["v"].alias("value")))
        return F.struct(end.alias("at"), F.when(x["v"].isNotNull(), F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    return F.aggregate(zipped, start, step, lambda acc: acc["out"])


def _keeps(kind: str):
    return lambda s: _valid(kind, s["value"])


def base_spans(text: Column) -> Column:
    """All valid base spans, by kind as listed and then start."""
    found = []
    for k, kind in enumerate(KINDS):
        hit = located(text, PATTERNS[kind], k)
        hint = HINTS[kind]
        some = F.contains(text, F.lit(hint)) if hint else text.rlike("[0-9][0-9 -]{14}")
        kept = F.filter(hit, _keeps(kind))
        found.append(F.when(some, kept).otherwise(F.array().cast(SPAN)))
    return F.concat(*found)


def span_text(spans: Column) -> Column:
    """``kind:start:end`` of (kind name, start, end) structs, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["name"], s["start"], s["end"])), ",")


def _named(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in (*KINDS, TERM)])
    return F.transform(spans, lambda s: F.struct(names[s["kind"]].alias("name"), s["start"].alias("start"), s["end"].alias("end")))


def _terms(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.lower))


def occurrences(texts: DataFrame) -> DataFrame:
    """(key, term, start, end, spans) of every word of texts (key, text, spans), one row a text; running sums give the places."""
    parts = F.arrays_zip(F.split("text", WORD, -1).alias("p"), F.regexp_extract_all("text", F.lit(WORD), F.lit(0)).alias("v"))
    rows = texts.select("key", F.posexplode(parts).alias("at", "x")).select("key", "at", "x.p", "x.v")
    end = F.sum(F.length("p") + F.coalesce(F.length("v"), F.lit(0))).over(Window.partitionBy("key").orderBy("at")).cast("int")
    rows = rows.withColumn("end", end).where("v is not null")
    return rows.select("key", F.lower("v").alias("term"), (F.col("end") - F.length("v")).alias("start"), "end").join(texts.select("key", "spans"), "key")


def entities(span: Column) -> Column:
    """What a base span protects, from narrow to wide, as three strings."""
    value, kind = F.lower(span["value"]), span["kind"]
    digits = _digits(value)
    whole = F.when(kind < 2, value).otherwise(digits)
    like = (
        F.when(kind == 0, F.substring_index(value, "@", -1)).when(kind == 1, F.substring_index(value, ".", 2))
        .when(kind == 2, F.substring(digits, 1, 6)).otherwise(F.substring(digits, F.lit(1), F.length(digits) - 4))
    )
    return F.array(F.concat_ws("=", kind, whole), F.concat_ws("~", kind, like), kind.cast("string"))


def disclosing_terms(found: DataFrame, docs: DataFrame, disclosure: float, least_texts: int) -> DataFrame:
    """(key, start, end) of the terms that disclose a protected entity of their text.

    ``found``: key (of a distinct text), copies (its documents), text, spans. Entities that fewer than ``least_texts``
    texts hold have no pair that counts, so words are paired with the other ones only.
    """
    value = F.flatten(F.transform("spans", entities))
    held = written(found.select("key", "copies", F.explode(F.array_distinct(value)).alias("value")), "values-held")
    values = held.groupBy("value").agg(F.sum("copies").alias("n_value"), F.count(F.lit(1)).alias("texts")).where(F.col("texts") >= least_texts)
    values = written(values.select("value", "n_value"), "values")
    shared = written(held.join(sized(values.select("value")), "value", "left_semi"), "shared")
    known = found.join(shared.select("key").distinct(), "key", "left_semi")
    pairs = shared.join(known.select("key", F.explode(_terms(F.col("text"))).alias("term")), "key")
    both = pairs.groupBy("value", "term").agg(F.sum("copies").alias("n_both"), F.count(F.lit(1)).alias("texts")).where(F.col("texts") >= least_texts)
    both = written(both, "pairs")
    if not both.limit(1).count():
        return found.select("key", F.lit(0).alias("start"), F.lit(0).alias("end")).where("false")
    terms = sized(both.select("term").distinct())
    words = _terms(F.coalesce("text", F.lit("")))
    n_term = docs.select(F.explode(words).alias("term")).join(terms, "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("n_term"))
    scored = both.join(values, "value").join(n_term, "term")
    total = docs.count()
    pmi = F.ln(F.col("n_both") * F.lit(float(total)) / F.col("n_term") / F.col("n_value"))
    ic = F.ln(F.lit(float(total)) / F.col("n_value"))
    strong = written(scored.where((ic > 0) & (pmi >= F.lit(disclosure) * ic)).select("value", "term"), "strong")
    marked = written(pairs.join(sized(strong), ["value", "term"], "left_semi").select("key", "term").distinct(), "marked")
    texts = known.join(marked.select("key").distinct(), "key", "left_semi").select("key", "text", "spans")
    spots = occurrences(texts).join(marked, ["key", "term"], "left_semi")
    clear = ~F.exists("spans", lambda b: (b["start"] < F.col("end")) & (b["end"] > F.col("start")))
    return spots.where(clear).select("key", "start", "end").distinct()


def text_spans(docs: DataFrame, disclosure: float = 0.9, least_texts: int = 2) -> DataFrame:
    """One row per row of ``docs``: doc_id, base and spans (arrays of kind name, start, end)."""
    text = F.coalesce("text", F.lit(""))
    first = docs.select("doc_id", F.sha2(text, 256).alias("key"), base_spans(text).alias("spans"), text.alias("text"))
    first = written(first.withColumn("text", F.when(F.size("spans") > 0, F.col("text"))), "spans")
    some = first.where(F.size("spans") > 0)
    found = written(some.groupBy("key").agg(F.count(F.lit(1)).alias("copies"), F.first("spans").alias("spans"), F.first("text").alias("text")), "found")
    extra = disclosing_terms(found, docs, disclosure, least_texts)
    extra = extra.groupBy("key").agg(F.sort_array(F.collect_set(F.struct(F.lit(TERM).alias("name"), "start", "end"))).alias("terms"))
    extra = written(extra, "terms")
    base = _named(F.col("spans"))
    return first.join(sized(extra), "key", "left").select(
        "doc_id", "key", base.alias("base"), F.when(F.col("terms").isNull(), base).otherwise(F.concat(base, "terms")).alias("spans")
    )


def sanitised(text: Column, spans: Column) -> Column:
    """``text`` with every span generalised to its kind in brackets; overlapping spans become the first one's kind."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["name"].alias("name"))))

    def step(acc, s):
        put = F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit("["), F.upper(s["name"]), F.lit("]"))
        inside = s["start"] < acc["at"]
        return F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"), F.when(inside, acc["out"]).otherwise(put).alias("out")
        )

    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    return F.aggregate(ordered, begin, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))


def span_digest(docs: DataFrame, **how) -> DataFrame:
    """doc_id, counts by kind, base_sha256 and the written spans of every document."""
    s = text_spans(docs, **how)
    count = lambda kind: F.size(F.filter("base", lambda x: x["name"] == kind)).cast("long").alias(f"n_{kind}")
    return s.select("doc_id", *[count(k) for k in KINDS], F.sha2(span_text(F.col("base")), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans"))
