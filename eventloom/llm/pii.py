"""Personal data: base patterns, and terms found by information-theoretic sanitisation.

Base spans are the leftmost non-overlapping matches of four patterns.  Positions come
from splitting the text at the matches and summing the lengths of pieces and matches.

The base values (one address, one number) are the entities to protect.  A term is a candidate for an
entity if it stands, whole, within ``CONTEXT`` characters of it in at least ``min_texts`` different texts,
whatever else stands between.  Corpus co-occurrence then estimates how strongly the term reveals the entity:

    risk(term, entity) = PMI / IC = ln(n_both * N / (n_entity * n_term)) / ln(N / n_entity)

over numbers of documents (rows), n_both of which have term and entity anywhere.  1 means that whoever
reads the term knows the entity; common words are near 0 or below.  Of a pair whose risk reaches
``generalise_at``, every occurrence of the term in a document of the entity is a ``term`` span, unless it touches a base
span; at ``remove_at`` and above sanitising removes it, below it leaves only its kind (word, name or number).

Only DataFrame operations are used.  All counts cover the whole corpus.  Term frequencies are looked
up for candidate terms alone: a Bloom filter of bounded size passes them, a join then takes the terms.
The window bounds the candidates by the text around the entities; without it a document would give all pairs of
its entities and its terms.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.llm._common import bound, cut, passing

KINDS = ("email", "ip", "card", "phone", "term")
#: The contract's patterns; possessive loops and look-behind change no match, only the work on long runs.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must contain for a pattern to match.
HINTS = {"email": r"@[A-Za-z0-9-]", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){13}", "phone": r"\+[0-9]"}
TERM = r"(?<![\p{L}\p{N}])\p{L}[\p{L}\p{N}]{3,}(?![\p{L}\p{N}])|(?<![\p{L}\p{N}])[\p{N}]{4,}(?![\p{L}\p{N}])"
CONTEXT = 64
REMOVE_AT = 0.95


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    from_right = F.reverse(digits)

    def share(i: Column) -> Column:
        d = F.substring(from_right, i, F.lit(1)).cast("int")
        doubled = d * 2
        return F.when(i % 2 == 1, d).otherwise(F.when(doubled > 9, doubled - 9).otherwise(doubled))

    total = F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda acc, i: acc + share(i))
    return total % 10 == 0


def _valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        part = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
        return match.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        n = F.length(_digits(match))
        return F.when(n.between(14, 19), _luhn(_digits(match))).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(_digits(match)).between(10, 15)
    return F.lit(True)


def _matches(text: Column, kind: str, context: int) -> Column:
    """All matches of a kind with the lengths that positions are summed from, and context + 1 characters on both sides."""
    pattern, wide = PATTERNS[kind], context + 1
    empty = F.array().cast("array<struct<kind:string,i:int,value:string,gap:int,before:string,after:string>>")
    # Every match has two characters or more, so this many neighbours reach past the context.
    reach = wide // 2 + 1

    def rows(both: Column) -> Column:
        found, pieces = both["found"], both["pieces"]

        def row(m: Column, i: Column) -> Column:
            gap, first = F.get(pieces, i), F.greatest(i - reach, F.lit(0))
            earlier = F.zip_with(F.slice(pieces, first + 1, i - first), F.slice(found, first + 1, i - first), lambda p, v: F.concat(F.right(p, F.lit(wide)), v))
            later = F.zip_with(F.slice(found, i + 2, F.lit(reach)), F.slice(pieces, i + 3, F.lit(reach)), lambda v, p: F.concat(v, F.left(F.coalesce(p, F.lit("")), F.lit(wide))))
            return F.struct(
                F.lit(kind).alias("kind"),
                i.alias("i"),
                m.alias("value"),
                F.length(gap).alias("gap"),
                F.right(F.concat(F.array_join(earlier, ""), F.right(gap, F.lit(wide))), F.lit(wide)).alias("before"),
                F.left(F.concat(F.left(F.get(pieces, i + 1), F.lit(wide)), F.array_join(later, "")), F.lit(wide)).alias("after"),
            )

        return F.transform(found, row)

    both = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("pieces"))
    return F.when(text.rlike(HINTS[kind]), bound(both, rows)).otherwise(empty)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("body"), text.alias("text"))


def base_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", context: int = CONTEXT) -> DataFrame:
    """id, body, kind, value, start, end, before, after, copies of each valid base match.

    body is a hash of the text: rows that repeat an id with the same text are one document of that many copies.
    before and after are the text around the match, one character more than the context.
    """
    every = F.concat(*[_matches(F.col("text"), k, context) for k in PATTERNS])
    rows = _keyed(docs, id_col, text_col).select("id", "body", F.explode(every).alias("m")).select("id", "body", "m.*")
    rows = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("copies"))
    order = Window.partitionBy("id", "body", "kind").orderBy("i")
    length = F.length("value")
    placed = rows.withColumn("end", F.sum(F.col("gap") + length).over(order)).withColumn("start", F.col("end") - length)
    valid = F.lit(False)
    for k in PATTERNS:
        valid = valid | ((F.col("kind") == k) & _valid(k, F.col("value")))
    return placed.where(valid).select("id", "body", "kind", "value", "start", "end", "before", "after", "copies")


def _entity() -> Column:
    """What a base match names: addresses in lower case, numbers by their digits."""
    return F.when(F.col("kind") == "email", F.lower("value")).when(F.col("kind") == "ip", F.col("value")).otherwise(_digits(F.col("value")))


def _terms(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), F.lower)


def term_places(texts: DataFrame) -> DataFrame:
    """id, body, term, start, end of every term of texts (id, body, text)."""
    found, pieces = F.regexp_extract_all("text", F.lit(TERM), F.lit(0)), F.split("text", TERM, -1)
    rows = texts.select("id", "body", found.alias("m"), pieces.alias("p")).select("id", "body", F.posexplode(F.arrays_zip("m", "p")).alias("i", "t"))
    rows = rows.where("t.m is not null").select("id", "body", "i", F.lower("t.m").alias("term"), F.length("t.m").alias("n"), F.length("t.p").alias("gap"))
    upto = F.sum(F.col("gap") + F.col("n")).over(Window.partitionBy("id", "body").orderBy("i"))
    return rows.withColumn("end", upto).select("id", "body", "term", (F.col("end") - F.col("n")).alias("start"), "end")


def disclosing_terms(
    docs: DataFrame,
    spans: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    generalise_at: float = 0.8,
    min_texts: int = 1,
    context: int = CONTEXT,
) -> DataFrame:
    """id, body, start, end, term, risk of each term span; spans: what base_spans gave."""
    # A word that the context cuts, or that goes on past it, isn't near: such ends are dropped.
    before = F.when(F.length("before") > context, F.regexp_replace("before", r"^[\p{L}\p{N}]+", "")).otherwise(F.col("before"))
    after = F.when(F.length("after") > context, F.regexp_replace("after", r"[\p{L}\p{N}]+$", "")).otherwise(F.col("after"))
    own = spans.select("id", "body", "copies", _entity().alias("entity"), F.explode(F.array_union(_terms(before), _terms(after))).alias("term"))
    met = cut(own.distinct(), "met")

    none = "id {}, body bigint, start bigint, end bigint, term string, risk double".format(spans.schema["id"].dataType.simpleString())
    n_docs = docs.count()
    total = F.lit(float(n_docs))

    def risk(n_both: Column, n_term: Column) -> Column:
        pmi = F.ln(n_both * total / (F.col("n_entity") * n_term))
        return F.when(F.col("n_entity") < n_docs, pmi / F.ln(total / F.col("n_entity")))

    # n_both is n_entity at most, and a term stands in at least as many documents as have it near any entity: what
    # that already rules out needs no look at the corpus, so common words are no candidates.
    near_any = met.select("id", "body", "copies", "term").distinct().groupBy("term").agg(F.sum("copies").alias("n_near"))
    owners = cut(spans.select("id", "body", "copies", _entity().alias("entity")).distinct(), "owners")
    entities = owners.groupBy("entity").agg(F.sum("copies").alias("n_entity"))
    pairs = met.groupBy("entity", "term").agg(F.count_distinct("body").alias("texts")).where(F.col("texts") >= min_texts)
    pairs = pairs.join(entities, "entity").join(near_any, "term")
    pairs = cut(pairs.where(risk(F.col("n_entity"), F.col("n_near")) >= generalise_at).select("entity", "term", "n_entity"), "pairs")
    if pairs.isEmpty():
        return docs.sparkSession.createDataFrame([], none)

    # Document frequencies of the candidate terms over the whole corpus.
    words = _keyed(docs, id_col, text_col).select(F.explode(F.array_distinct(_terms(F.col("text")))).alias("term"))
    words = passing(words, F.col("term"), pairs, "term")
    # Counted before they meet the candidates, so that a task sends a term once.
    terms = words.groupBy("term").agg(F.count(F.lit(1)).alias("n_term"))
    pairs = pairs.join(terms, "term").where(risk(F.col("n_entity"), F.col("n_term")) >= generalise_at)
    pairs = cut(pairs, "rare")

    # Where the terms that are left stand in the documents of their entities, and how many these are.
    wanted = cut(owners.join(pairs, "entity").select("id", "body", "copies", "entity", "term", "n_entity", "n_term"), "wanted")
    keys = wanted.select(F.col("id").alias("_id"), F.col("body").alias("_body")).distinct()
    same = F.col("id").eqNullSafe(F.col("_id")) & (F.col("body") == F.col("_body"))
    texts = passing(_keyed(docs, id_col, text_col), F.col("body"), wanted, "body").join(keys, same, "left_semi").dropDuplicates(["id", "body"])
    here = wanted.select(F.col("id").alias("_id"), F.col("body").alias("_body"), F.col("term").alias("_term")).distinct()
    places = cut(term_places(texts).join(here, same & (F.col("term") == F.col("_term")), "left_semi"), "places")
    held = places.select(F.col("id").alias("_id"), F.col("body").alias("_body"), F.col("term").alias("_term")).distinct()
    shared = cut(wanted.join(held, same & (F.col("term") == F.col("_term"))).drop("_id", "_body", "_term"), "shared")
    both = shared.groupBy("entity", "term").agg(F.sum("copies").alias("n_both"), F.first("n_entity").alias("n_entity"), F.first("n_term").alias("n_term"))
    risky = both.select("entity", "term", risk(F.col("n_both"), F.col("n_term")).alias("risk")).where(F.col("risk") >= generalise_at)
    worst = shared.join(risky, ["entity", "term"]).groupBy("id", "body", "term").agg(F.max("risk").alias("risk"))
    worst = worst.select(F.col("id").alias("_id"), F.col("body").alias("_body"), F.col("term").alias("_term"), "risk")
    marked = places.join(worst, same & (F.col("term") == F.col("_term"))).select("id", "body", "start", "end", "term", "risk")
    base = spans.select(F.col("id").alias("_id"), F.col("body").alias("_body"), F.col("start").alias("_start"), F.col("end").alias("_end"))
    over = same & (F.col("start") < F.col("_end")) & (F.col("_start") < F.col("end"))
    return marked.join(base, over, "left_anti").select("id", "body", "start", "end", "term", "risk")


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options: object) -> DataFrame:
    """id, body, spans: per document that has any, its spans (start, rank, end, kind, value, risk) in order."""
    base = cut(base_spans(docs, id_col, text_col), "base")
    added = disclosing_terms(docs, base, id_col, text_col, **options)
    rank = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    every = base.select("id", "body", "start", "end", "kind", "value", F.lit(None).cast("double").alias("risk")).union(
        added.select("id", "body", "start", "end", F.lit("term"), "term", "risk")
    )
    one = F.struct("start", rank.alias("rank"), "end", "kind", "value", "risk")
    return every.groupBy("id", "body").agg(F.array_sort(F.collect_list(one)).alias("spans"))


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", remove_at: float = REMOVE_AT, **options: object) -> DataFrame:
    """id, n_email, n_ip, n_card, n_phone, n_term, n_removed, base_sha256, spans, detail of each row.

    n_removed: the term spans of a risk of remove_at or more; the others are generalised.

    spans: kind:start:end, comma-joined, by start, then kind as in KINDS; code points, end exclusive.
    Null texts are empty: no spans.  Rows that repeat an id with the same text give a row each with
    the same result; null ids work as any other.  An empty table gives no rows; other columns are ignored.
    """
    found = cut(find_spans(docs, id_col, text_col, **options), "spans").select(
        F.col("id").alias("_id"), F.col("body").alias("_body"), F.col("spans").alias("detail")
    )
    rows = _keyed(docs, id_col, text_col).select("id", "body")
    out = rows.join(found, F.col("id").eqNullSafe(F.col("_id")) & (F.col("body") == F.col("_body")), "left")
    detail = F.coalesce("detail", F.array().cast(found.schema["detail"].dataType))
    joined = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter(detail, lambda s: s["kind"] == k))
    counts = [count(k).cast("bigint").alias(f"n_{k}") for k in KINDS]
    return out.select(
        F.col("id").alias(id_col),
        *counts,
        F.size(F.filter(detail, lambda s: (s["kind"] == "term") & (s["risk"] >= remove_at))).cast("bigint").alias("n_removed"),
        F.sha2(joined(F.filter(detail, lambda s: s["kind"] != "term")).cast("binary"), 256).alias("base_sha256"),
        joined(detail).alias("spans"),
        detail.alias("detail"),
    )


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", remove_at: float = REMOVE_AT, **options: object) -> DataFrame:
    """The rows of docs with spans taken out of the text.

    Base spans become [EMAIL], [IP], [CARD] or [PHONE]; terms of a risk of remove_at or more become
    [REMOVED], other term spans their kind, [NUMBER], [NAME] (capitalised) or [WORD].  A span that starts
    inside an earlier one is dropped with it.  Null texts stay null; other columns, whatever their names, are kept.
    """
    found = find_spans(docs, id_col, text_col, **options).select(F.col("id").alias("_id"), F.col("body").alias("_body"), F.col("spans").alias("_spans"))
    body = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    rows = docs.select(F.struct(*docs.columns).alias("_row"), F.col(id_col).alias("_key"), body.alias("_text_body"), F.col(text_col).alias("_text"))
    joined = rows.join(found, F.col("_key").eqNullSafe(F.col("_id")) & (F.col("_text_body") == F.col("_body")), "left")
    text = F.col("_text")

    def mark(s: Column) -> Column:
        first = F.substring(text, s["start"].cast("int") + 1, F.lit(1))
        kind = F.when(first.rlike(r"\p{N}"), "[NUMBER]").when(first.rlike(r"\p{Lu}"), "[NAME]").otherwise("[WORD]")
        term = F.when(s["risk"] >= remove_at, F.lit("[REMOVED]")).otherwise(kind)
        return F.when(s["kind"] == "term", term).otherwise(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))

    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(text, acc["at"].cast("int") + 1, (s["start"] - acc["at"]).cast("int"))
        inside = s["start"] < acc["at"]
        return F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(inside, acc["out"]).otherwise(F.concat(acc["out"], gap, mark(s))).alias("out"),
        )

    end = F.aggregate("_spans", start, step)
    clean = F.concat(end["out"], F.substring(text, end["at"].cast("int") + 1, F.length(text)))
    out = {c: F.col("_row")[c] for c in docs.columns} | {text_col: F.when(F.col("_spans").isNull(), text).otherwise(clean)}
    return joined.select(*[v.alias(k) for k, v in out.items()])


def risk_of(n_docs: int, n_entity: int, n_both: int, n_term: int) -> float:
    """The risk formula on plain numbers, for tests and for choosing thresholds."""
    return math.log(n_both * n_docs / (n_entity * n_term)) / math.log(n_docs / n_entity)
