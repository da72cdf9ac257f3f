r"""Personal data: base patterns, and information-theoretic sanitisation.

DataFrame functions only. Base spans come from four patterns and their checks.
The patterns below accept the same strings as the plain ones in the contract,
written so that Java's matcher needs neither deep recursion nor more than one
start in each run of characters:

    email  [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    ip     [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)         parts at most 255
    card   [0-9]([\x20-]?[0-9])+                        14-19 digits, Luhn
    phone  \+[0-9][\x20().0-9-]+[0-9]                   10-15 digits

Sanitisation: a protected entity is a kind, or one value of it. A term (a word
that no base span touches) discloses an entity when the pointwise mutual
information PMI = log2(p(t, e) / (p(t) p(e))) reaches ``alpha`` times the
entity's information -log2 p(e), that is, when seeing the term tells nearly as
much as seeing the entity. Probabilities are shares of all documents, and terms
and entities meet anywhere in a document; a term needs ``support`` documents
with the entity. Every occurrence of a disclosing term, in whatever document,
gets a span of kind ``term`` and is generalised in the sanitised text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, ascii_lower, checked, cut, shared_dir

KINDS = ("email", "ip", "card", "phone")
GAP = r"[\x20\x09-\x0D]+"
#: U+E000 stands for a dot that no label follows; texts' own U+E000 become U+E001 first.
_DOT, _OTHER = "", ""
PATTERNS = {
    "email": rf"(?:(?<![A-Za-z0-9._%+{_DOT}-])|\G)[A-Za-z0-9._%+{_DOT}-]++@[A-Za-z0-9-]++\.[A-Za-z0-9.-]*+",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_SPAN = "array<struct<start:int,rank:int,kind:string,end:int,value:string>>"


def _digits(v):
    return F.regexp_replace(v, "[^0-9]", "")


def _luhn(digits):
    backwards = F.filter(F.split(F.reverse(digits), ""), lambda c: c != "")
    value = F.transform(backwards, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise((c.cast("int") * 2 % 10 + F.floor(c.cast("int") / 5)).cast("int")))
    return F.aggregate(value, F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: str, v):
    if kind == "ip":
        bare = lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "")
        return F.forall(F.split(v, r"\."), lambda p: (F.length(bare(p)) <= 3) & (F.coalesce(F.substring(bare(p), 1, 3).cast("int"), F.lit(0)) <= 255))
    n = F.length(_digits(v))
    if kind == "card":
        return n.between(14, 19) & _luhn(_digits(v))
    return n.between(10, 15) if kind == "phone" else F.lit(True)


#: Numbers that are summed one by one; longer arrays go by sums of runs of so many.
RUN = 256


def _let(value, f):
    """f of a value that is computed once, however often f's result uses it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _total(numbers):
    return F.aggregate(numbers, F.lit(0), lambda a, x: a + x)


def _run_sums(numbers):
    runs = F.sequence(F.lit(0), F.floor(F.size(numbers) / RUN).cast("int"))
    return F.transform(runs, lambda k: _total(F.slice(numbers, k * RUN + 1, F.lit(RUN))))


def _sum_to(numbers, sums, i):
    """Sum of an array's entries up to place i, both included: whole runs, then the rest."""
    run = F.floor(i / RUN).cast("int")
    return _total(F.slice(sums, F.lit(1), run)) + _total(F.slice(numbers, run * RUN + 1, i - run * RUN + 1))


def _kind_spans(text, kind: str):
    """Spans of one kind: what lies between the matches gives their places."""
    seen = text
    if kind == "email":
        seen = F.regexp_replace(F.translate(text, _DOT, _OTHER), r"\.(?![A-Za-z0-9-])", _DOT)
    there = {"email": F.contains(text, F.lit("@")), "phone": F.contains(text, F.lit("+"))}.get(kind, F.regexp_like(text, F.lit("[0-9]")))
    pattern = PATTERNS[kind]
    found = F.regexp_extract_all(seen, F.lit(pattern), 0)
    gaps = F.split(seen, pattern, -1)

    def span(p, end):
        return F.struct((end - F.length(p["hit"])).alias("start"), F.lit(KINDS.index(kind)).alias("rank"), F.lit(kind).alias("kind"), end.alias("end"), p["hit"].alias("value"))

    def placed(pairs):
        moves = F.transform(pairs, lambda p: F.length(p["gap"]) + F.length(p["hit"]))
        return _let(moves, lambda m: _let(_run_sums(m), lambda sums: F.transform(pairs, lambda p, i: span(p, _sum_to(m, sums, i)))))

    pairs = F.filter(F.arrays_zip(gaps.alias("gap"), found.alias("hit")), lambda p: p["hit"].isNotNull())
    spans = _let(pairs, placed).cast(_SPAN)
    return F.when(there, F.filter(spans, lambda s: _valid(kind, s["value"]))).otherwise(F.array().cast(_SPAN))


def base_spans(text):
    """Valid base spans of a text column, by start, then kind as listed."""
    return F.array_sort(F.concat(*[_kind_spans(text, k) for k in KINDS]))


def joined(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _free_parts(text, base):
    """The stretches of a text between its base spans, without what is left of
    words that a span touches."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<from:int,to:int>>").alias("out"))
    stretches = F.aggregate(
        F.concat(base, F.array(F.struct(F.length(text).alias("start"), F.lit(0).alias("rank"), F.lit("").alias("kind"), F.length(text).alias("end"), F.lit("").alias("value")))),
        start,
        lambda acc, s: F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(s["start"] > acc["at"], F.concat(acc["out"], F.array(F.struct(acc["at"].alias("from"), s["start"].alias("to"))))).otherwise(acc["out"]).alias("out"),
        ),
        lambda acc: acc["out"],
    )

    def free(p):
        part = F.substring(text, p["from"] + 1, p["to"] - p["from"])
        part = F.when(p["from"] > 0, F.regexp_replace(part, rf"\A{WORD}", "")).otherwise(part)
        return F.when(p["to"] < F.length(text), F.regexp_replace(part, rf"(?<![^\x20\x09-\x0D]){WORD}+\z", "")).otherwise(part)

    return F.transform(stretches, free)


def _terms(text, base):
    """A text's distinct words that no base span touches."""
    parts = F.when(F.size(base) > 0, F.array_join(_free_parts(text, base), " ")).otherwise(text)
    return F.filter(F.array_distinct(F.split(ascii_lower(parts), GAP)), lambda w: w != "")


def _occurrences(text, base, told):
    """Spans of the words in ``told``, wherever no base span touches them."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("out"))

    def add(acc, p):
        at, term = acc["at"] + F.length(p["gap"]), ascii_lower(p["word"])
        end = at + F.length(p["word"])
        span = F.struct(at.alias("start"), F.lit(len(KINDS)).alias("rank"), F.lit("term").alias("kind"), end.alias("end"), term.alias("value"))
        return F.struct(end.alias("at"), F.when(F.array_contains(told, term), F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    pairs = F.arrays_zip(F.split(text, WORD, -1).alias("gap"), F.regexp_extract_all(text, F.lit(WORD), 0).alias("word"))
    spans = F.aggregate(F.filter(pairs, lambda p: p["word"].isNotNull()), start, add, lambda acc: acc["out"])
    return F.filter(spans, lambda w: ~F.exists(base, lambda s: (s["start"] < w["end"]) & (w["start"] < s["end"])))


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", alpha: float = 0.95, support: int = 5) -> DataFrame:
    """One row a document: id, base (spans), terms (spans of disclosing terms).

    A null or empty text has no spans. Rows that repeat an id, or have none,
    count as documents of their own. Other columns are ignored; an empty table
    gives no rows.
    """
    spark, work = docs.sparkSession, shared_dir(docs.sparkSession)
    texts = docs.select(F.col(id_col).alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    # Written with the text, as rows need a number that is the same in every later step.
    base = cut(texts.select("doc", "t", base_spans(F.col("t")).alias("base")).withColumn("row", F.monotonically_increasing_id()), f"{work}/base")
    names = F.array_distinct(F.flatten(F.transform("base", lambda s: F.array(s["kind"], F.concat_ws(":", s["kind"], F.lower(s["value"]))))))
    of_kind = cut(base.select(F.explode(names).alias("entity")).groupBy("entity").agg(F.count("*").alias("de")).filter(F.col("de") >= support), f"{work}/entities")
    # Entities in fewer documents than ``support`` can't meet a term often enough.
    held = base.filter(F.size("base") > 0).select("row", F.explode(names).alias("entity")).join(checked(of_kind), "entity", "left_semi")
    held = cut(held.groupBy("row").agg(F.collect_list("entity").alias("entities")), f"{work}/held")
    words = base.filter(F.size("base") > 0).join(held, "row").select("entities", F.explode(_terms(F.col("t"), F.col("base"))).alias("term"))
    pairs = words.select(F.explode("entities").alias("entity"), "term").groupBy("entity", "term").agg(F.count("*").alias("co")).filter(F.col("co") >= support)
    pairs = cut(pairs, f"{work}/pairs")
    known = cut(pairs.select("term").distinct(), f"{work}/known")
    # A text's words once each, so that counts combine where they are read.
    seen = base.select("row", F.explode(_terms(F.col("t"), F.col("base"))).alias("term"))
    counts = seen.join(checked(known), "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))
    total = base.select(F.count("*").alias("all"))
    told = pairs.join(counts, "term").join(checked(of_kind), "entity").crossJoin(F.broadcast(total))  # one row
    pmi = F.log2(F.col("co") * F.col("all") / (F.col("df") * F.col("de")))
    told = told.filter((pmi >= alpha * F.log2(F.col("all") / F.col("de"))) & (F.col("de") < F.col("all"))).select("term").distinct()
    told = cut(told, f"{work}/told")
    hits = cut(seen.join(checked(told), "term", "left_semi").groupBy("row").agg(F.collect_list("term").alias("told")), f"{work}/hits")
    terms = F.when(F.col("told").isNotNull(), _occurrences(F.col("t"), F.col("base"), F.col("told"))).otherwise(F.array().cast(_SPAN))
    return base.join(hits, "row", "left").select(F.col("doc").alias(id_col), "base", terms.alias("terms"))


def sanitised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with a column ``sanitised``: each span gives way to its kind in
    square brackets. Where spans overlap, the earlier one covers the later."""
    spans = personal_data(docs, id_col, text_col, **options).select(id_col, F.array_sort(F.concat("base", "terms")).alias("_spans")).dropDuplicates([id_col])
    both = docs.join(spans, id_col, "left").withColumn("_t", F.coalesce(F.col(text_col), F.lit("")))
    step = F.aggregate(
        F.coalesce("_spans", F.array().cast(_SPAN)),
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when(s["start"] < acc["at"], acc["out"]).otherwise(F.concat(acc["out"], F.substring(F.col("_t"), acc["at"] + 1, s["start"] - acc["at"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))).alias("out"),
        ),
        lambda acc: F.concat(acc["out"], F.substring(F.col("_t"), acc["at"] + 1, F.length(F.col("_t")))),
    )
    return both.withColumn("sanitised", step).drop("_spans", "_t")


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The contract's columns from ``personal_data``."""

    def of(kind):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(id_col, *map(of, KINDS), F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), joined(F.array_sort(F.concat("base", "terms"))).alias("spans"))
