"""Personal data: base patterns, and terms that give away protected entities.

Everything is DataFrame expressions.  Base spans come from one pass of each pattern
over the whole text: matches are put between marks, the text is split at the marks, and
running lengths of the pieces are the offsets (code points).  The patterns are written
so that a search takes time in proportion to the text: a run of one class is entered at
its start only (or where the last match ended), and loops are possessive.

Information-theoretic sanitisation then asks which terms reveal a protected entity.  An
entity is a value (a normalised address or number that the base has found, or a secret: a
run of at least ``SECRET`` ASCII letters and digits with both among them, which carries
more bits than any word) or a whole kind of values, so that values of a single text are
protected too.  Counts are of distinct texts, and whole texts count, however far a term
stands from the entity.  With p(t) the share of texts
that hold a term, the disclosure of an entity e by a term t is

    PMI(t, e) / IC(e),  PMI = log2(p(t | e) / p(t)),  IC = log2(1 / p(e))

Terms that reach ``GENERALISE`` become spans of kind ``term`` (to be generalised), those
that reach ``REMOVE`` of kind ``drop`` (to be removed), at all their places in the texts
that hold the entity.  Secrets are spans of the method, too.  Terms are words of any length; those inside an email address and
those of ASCII digits alone are not terms.

Support: e and t must share at least ``SUPPORT`` distinct texts, and t must be in at
least the share ``COVER`` of e's texts.  A value of a single text counts with its kind
only: every rare word of that text would disclose it, and copies of one text prove nothing.

Counts of terms cover all texts and are aggregated on the map side before they are
shuffled; only texts with an entity of enough texts are read again, each once.

Defined cases: a null text is empty and has no spans; rows with the same id and text get
the same spans; spans of different kinds may overlap; very long texts are searched whole;
other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meshlark.llm._store import materialise, small

KINDS = ("email", "ip", "card", "phone", "secret", "term", "drop")
#: Kinds of the base, which come first; characters of a secret.
BASE, SECRET = 4, 32
#: Distinct texts that an entity and a term must share; below two nothing occurs together repeatedly.
SUPPORT = 2
GENERALISE, REMOVE = 0.6, 0.9
#: A term must be in at least this share of the texts that hold an entity.
COVER = 0.5

#: The base patterns, each with what the text must hold for it.
PATTERNS = {
    "email": (r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    "ip": (r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "."),
    "card": (r"[0-9](?:[\x20-]?[0-9])++", ""),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "+"),
    "secret": (rf"(?<![0-9A-Za-z])(?=[A-Za-z]*+[0-9])(?=[0-9]*+[A-Za-z])[0-9A-Za-z]{{{SECRET},}}+", ""),
}
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]++"
NO_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_MARK, _OTHER = "\ue000", "\ue001"
#: Pieces whose offsets are summed together; even, as every second piece is a match.
_PART = 512


def pieces(text: Column, pattern: str, needs: str = "") -> Column:
    """The text cut into no match, match, no match, ...; a text without matches is one piece."""
    plain = F.translate(text, _MARK, _OTHER)
    cut = F.split(F.regexp_replace(plain, pattern, f"{_MARK}$0{_MARK}"), _MARK, -1)
    return F.when(F.instr(text, needs) > 0, cut).otherwise(F.array(text)) if needs else cut


def spans(name: str) -> Column:
    """Start, end and text of the matches among the pieces in a column."""
    return F.expr(
        f"""CASE WHEN size({name}) <= 1 THEN CAST(array() AS array<struct<start:bigint,end:bigint,value:string>>) ELSE
        flatten(flatten(transform(
          array(transform(sequence(0, CAST(ceil(size({name}) / {_PART}) AS int) - 1), part -> aggregate(slice({name}, part * {_PART} + 1, {_PART}), 0L, (n, x) -> n + length(x)))),
          sums -> transform(sequence(0, size(sums) - 1), part ->
          aggregate(slice({name}, part * {_PART} + 1, {_PART}),
            struct(aggregate(slice(sums, 1, part), 0L, (n, x) -> n + x) AS at, 0 AS i, CAST(array() AS array<struct<start:bigint,end:bigint,value:string>>) AS found),
            (a, x) -> struct(a.at + length(x) AS at, a.i + 1 AS i,
                             CASE WHEN a.i % 2 = 1 THEN concat(a.found, array(struct(a.at AS start, a.at + length(x) AS end, x AS value))) ELSE a.found END AS found),
            a -> a.found))))) END"""
    )


_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
_GOOD = {
    "email": "true",
    "ip": f"x.value RLIKE '^{_BYTE}([.]{_BYTE}){{3}}$'",
    "card": """length(regexp_replace(x.value, '[^0-9]', '')) BETWEEN 14 AND 19 AND
        aggregate(transform(split(reverse(regexp_replace(x.value, '[^0-9]', '')), ''), (d, i) -> CASE WHEN i % 2 = 0 THEN CAST(d AS int) WHEN CAST(d AS int) > 4 THEN 2 * CAST(d AS int) - 9 ELSE 2 * CAST(d AS int) END), 0, (n, d) -> n + d) % 10 = 0""",
    "phone": "length(regexp_replace(x.value, '[^0-9]', '')) BETWEEN 10 AND 15",
    "secret": "true",
}


def base_spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, key (hash of the text), found (array of start, kind number, end, value; secrets among them)."""
    rows = docs.select(F.col(id_col).alias("id"), *_keyed(text_col))
    rows = rows.select("id", "key", *[pieces(F.col("text"), p, needs).alias(kind) for kind, (p, needs) in PATTERNS.items()])
    found = [F.expr(f"transform(filter(x_{kind}, x -> {_GOOD[kind]}), x -> struct(x.start AS start, {i} AS kind, x.end AS end, x.value AS value))") for i, kind in enumerate(PATTERNS)]
    rows = rows.select("id", "key", *[spans(kind).alias(f"x_{kind}") for kind in PATTERNS])
    return rows.select("id", "key", F.array_sort(F.concat(*found)).alias("found"))


def _keyed(text_col: str) -> tuple[Column, Column]:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return F.unhex(F.md5(text.cast("binary"))).alias("key"), text.alias("text")


def _terms(text: Column) -> Column:
    """Distinct terms of a text, each to be checked by _TERM."""
    email, needs = PATTERNS["email"]
    plain = F.when(F.instr(text, needs) > 0, F.regexp_replace(text, email, " ")).otherwise(text)
    return F.array_distinct(F.transform(F.split(plain, NO_WORD), F.lower))


_TERM = "NOT term RLIKE '^[0-9]*$'"


def entities(base: DataFrame) -> DataFrame:
    """Distinct pairs (key, entity) of texts and the normalised values, and the kinds of values, in them."""
    kind = F.col("x.kind").cast("string")
    value = F.when(F.col("x.kind").isin(2, 3), F.regexp_replace("x.value", "[^0-9]", "")).otherwise(F.lower("x.value"))
    one = base.where("size(found) > 0").select("key", F.explode("found").alias("x"))
    return one.select("key", F.explode(F.array(F.concat(kind, F.lit(":"), value), kind)).alias("entity")).distinct()


def disclosing(together: DataFrame, terms: DataFrame, n: DataFrame) -> DataFrame:
    """Pairs (entity, term, disclosure) that reach the threshold.

    ``together`` has a row (entity, n_e, term) for each text of both, ``terms`` the texts
    n_t of each term, and ``n``, one row, the number of texts.
    """
    pairs = together.groupBy("entity", "n_e", "term").agg(F.count("*").alias("n_te")).where((F.col("n_te") >= SUPPORT) & (F.col("n_te") >= COVER * F.col("n_e")))
    scored = pairs.join(terms, "term").join(F.broadcast(n), F.lit(True))
    pmi = F.log2((F.col("n_te") / F.col("n_e")) / (F.col("n_t") / F.col("n")))
    return scored.select("entity", "term", F.least(F.lit(1.0), pmi / F.greatest(F.lit(1.0), F.log2(F.col("n") / F.col("n_e")))).alias("disclosure")).where(F.col("disclosure") >= GENERALISE)


def find(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, base (array of start, kind number, end), spans (the same with those of the method)."""
    base = materialise(base_spans(docs, id_col=id_col, text_col=text_col), "pii")
    copies = materialise(base.groupBy("key").agg(F.count("*").alias("copies")).where("copies > 1"), "pii-copies")
    n = base.agg(F.count("*").alias("rows")).join(copies.agg(F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("more")), F.lit(True)).select((F.col("rows") - F.col("more")).alias("n"))  # one row
    every = docs.select(*_keyed(text_col))
    # a text of m copies counts as m times 1/m
    named = every.join(small(copies), "key", "left").select(F.explode(_terms(F.col("text"))).alias("term"), (1 / F.coalesce("copies", F.lit(1))).alias("part"))
    terms = named.where(_TERM).groupBy("term").agg(F.round(F.sum("part")).alias("n_t"))

    own = materialise(entities(base), "pii-entities")
    own = own.join(own.groupBy("entity").agg(F.count("*").alias("n_e")).where(F.col("n_e") >= SUPPORT), "entity")
    # the entities of a text in one row, so that a text meets them once; a text holds no more of them than it has values
    held = materialise(own.groupBy("key").agg(F.collect_list(F.struct("entity", "n_e")).alias("entities")), "pii-often")
    texts = materialise(every.join(small(held), "key").dropDuplicates(["key"]), "pii-texts")
    each = texts.select("key", "entities", F.explode(_terms(F.col("text"))).alias("term")).where(_TERM)
    together = each.select("key", "term", F.explode("entities").alias("e")).select("key", "term", "e.entity", "e.n_e")
    told = materialise(disclosing(together.select("entity", "n_e", "term"), terms, n), "pii-told")
    marked = together.join(small(told), ["entity", "term"]).groupBy("key", "term").agg(F.max("disclosure").alias("d"))

    # the telling terms of a text in one row, and its words looked up there
    told_of = marked.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("term", "d"))).alias("told"))
    cover = base.where("size(found) > 0").dropDuplicates(["key"]).select("key", F.expr("transform(found, x -> struct(x.start AS start, x.end AS end))").alias("cover"))
    words = texts.select("key", "text").join(told_of, "key").join(cover, "key").select("key", "told", "cover", pieces(F.col("text"), WORD).alias("p")).select("key", "told", "cover", spans("p").alias("w"))
    # words inside a base span are covered by it
    extra = words.select("key", F.expr(f"""transform(filter(w, x -> map_contains_key(told, lower(x.value)) AND NOT exists(cover, c -> c.start <= x.start AND x.end <= c.end)),
        x -> struct(x.start AS start, CASE WHEN told[lower(x.value)] >= {REMOVE} THEN {BASE + 2} ELSE {BASE + 1} END AS kind, x.end AS end))""").alias("extra"))
    extra = small(materialise(extra, "pii-extra"))
    own = base.select("id", "key", F.expr("transform(found, x -> struct(x.start AS start, x.kind AS kind, x.end AS end))").alias("found"))
    both = F.when(F.col("extra").isNull(), F.col("found")).otherwise(F.array_sort(F.concat("found", "extra")))
    return own.join(extra, "key", "left").select(F.col("id").alias(id_col), "key", F.expr(f"filter(found, x -> x.kind < {BASE})").alias("base"), both.alias("spans"))


def listed(name: str) -> Column:
    """kind:start:end of the spans in a column, comma-joined."""
    kinds = ", ".join(f"'{k}'" for k in KINDS)
    return F.expr(f"array_join(transform({name}, x -> concat(element_at(array({kinds}), x.kind + 1), ':', x.start, ':', x.end)), ',')")


def sanitised(text: Column, name: str) -> Column:
    """The text with the spans in a column replaced: base spans by their kind, terms by ``[term]`` or nothing."""
    built = F.aggregate(
        F.col(name),
        F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out")),
        lambda a, x: F.struct(F.greatest(a["at"], x["end"]).alias("at"), F.when(x["start"] < a["at"], a["out"]).otherwise(F.concat(a["out"], F.substr(text, (a["at"] + 1).cast("int"), (x["start"] - a["at"]).cast("int")), _put(x["kind"]))).alias("out")),
        lambda a: F.concat(a["out"], F.substr(text, (a["at"] + 1).cast("int"))),
    )
    return F.when(text.isNull(), text).otherwise(built)


def _put(kind: Column) -> Column:
    out = F.when(kind == 0, "[email]")
    for i, said in enumerate(("[ip]", "[card]", "[phone]", "[secret]", "[term]"), 1):
        out = out.when(kind == i, said)
    return out.otherwise("")
