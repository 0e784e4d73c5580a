"""Checks of papers: figures with an origin, references and their quotes, and how figures are written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldmark.functions.text import contains, squash
from fieldmark.operators.citations import surname
from fieldmark.operators.evidence import DOI, MIN_QUOTE_CHARS, MIN_QUOTE_WORDS, _blank, is_preprint, problems

# What a reference is cited for.
ROLES = ("claim", "method", "dataset")


# --- where figures come from ------------------------------------------------------------------------------------------------------


def stands_for(literal: Column, x: Column) -> Column:
    """Whether a stored value is the number typed: rounded to its decimals; with a sign, or for a share without one, as a percentage."""
    digits = F.replace(F.rtrim(literal, F.lit("%")), F.lit(","), F.lit(""))
    places = F.when(digits.contains("."), F.length(F.split_part(digits, F.lit("."), F.lit(2)))).otherwise(0)
    scale = F.pow(F.lit(10.0), places)
    same = lambda v: F.bround(v * scale) == F.bround(digits.cast("double") * scale)
    return F.when(literal.endswith("%"), same(x * 100)).otherwise(same(x) | ((x > 0) & (x <= 1) & same(x * 100)))


def number_problems(literals: DataFrame, registry: DataFrame) -> DataFrame:
    """Numbers without a registered origin, numbers that no value of theirs stands for, and registered ones that are typed nowhere.

    ``registry``: (literal, values), the values that its origin holds.
    """
    df = literals.join(registry, "literal", "left")
    kept = F.exists("values", lambda v: stands_for(F.col("literal"), v))
    reason = F.when(F.col("values").isNull(), "no recorded origin").when(~kept, "not a value of its origin")
    gone = registry.join(literals, "literal", "left_anti").select(F.lit(None).cast(literals.schema["doc"].dataType).alias("doc"), "literal", F.lit("registered but not typed").alias("problem"))
    return df.select("doc", "literal", reason.alias("problem")).filter("problem IS NOT NULL").unionByName(gone)


# --- references -------------------------------------------------------------------------------------------------------------------


def reference_problems(articles: DataFrame, evidence_dois: DataFrame, claim_min_year: int = 2016) -> DataFrame:
    """What is wrong with references (key, doi, title, authors, year, journal, role, quotes): gaps, odd or shared DOIs, preprints, works
    that the evidence base has, unknown roles, and claims that are old or have no sound quotes; other roles have none."""
    q = F.coalesce("quotes", F.array().cast("array<string>"))
    claim = F.col("role") == "claim"
    short = F.exists(q, lambda x: (F.length(F.trim(x)) < MIN_QUOTE_CHARS) | (F.size(F.split(F.trim(x), r"\s+")) < MIN_QUOTE_WORDS))
    rules = [(f"missing {c}", _blank(c)) for c in ("doi", "title", "authors", "year", "journal", "role")]
    rules += [
        ("malformed doi", ~_blank("doi") & ~F.col("doi").rlike(DOI)),
        ("a preprint", is_preprint(F.col("doi"), F.col("journal"))),
        ("unknown role", ~_blank("role") & ~F.col("role").isin(*ROLES)),
        ("claim too old", claim & (F.col("year") < claim_min_year)),
        ("claim without quote", claim & (F.size(q) == 0)),
        ("quote too short", claim & short),
        ("same quote twice", claim & (F.size(F.array_distinct(F.transform(q, squash))) < F.size(q))),
        ("quotes of no claim", ~F.coalesce(claim, F.lit(False)) & (F.size(q) > 0)),
    ]
    one = problems(articles, F.col("key"), rules)
    first = articles.filter(~_blank("doi")).groupBy(F.lower("doi").alias("d")).agg(F.min("key").alias("first"))
    shared = articles.join(first, F.lower("doi") == F.col("d")).filter("key != first").select(F.col("key").alias("place"), F.lit("doi of another article").alias("problem"))
    known = articles.join(evidence_dois.select(F.lower("doi").alias("d")).distinct(), F.lower("doi") == F.col("d"), "left_semi").select(F.col("key").alias("place"), F.lit("in the evidence base").alias("problem"))
    return one.unionByName(shared).unionByName(known)


def reference_quote_problems(articles: DataFrame, abstracts: DataFrame) -> DataFrame:
    """Quotes of claims that no abstract of theirs (key, text) has, and claims without an abstract."""
    texts = abstracts.groupBy("key").agg(F.collect_list("text").alias("texts"))
    df = articles.filter("role = 'claim'").join(texts, "key", "left")
    missing = F.exists("quotes", lambda q: ~F.exists("texts", lambda t: contains(t, q)))
    return problems(df, F.col("key"), [("no abstract", F.col("texts").isNull()), ("quote not found", missing)])


def reference_list(articles: DataFrame) -> DataFrame:
    """The references as one text, by surname and year; they are those of one paper, so they are few."""
    shown = F.concat("authors", F.lit(" ("), "year", F.lit(") "), "title", F.lit(". "), "journal", F.lit(". https://doi.org/"), "doi")
    rows = F.array_sort(F.collect_list(F.struct(surname(F.col("authors")).alias("a"), "year", "key", shown.alias("shown"))))
    return articles.agg(F.array_join(F.transform(rows, lambda r: r["shown"]), "\n\n").alias("references"))


# --- how figures are written --------------------------------------------------------------------------------------------------------


def count_text(n: Column) -> Column:
    """1234567 as 1,234,567."""
    return F.format_number(n, 0)


def percent_text(part: Column, whole: Column, places: int = 1) -> Column:
    """A share in percent; a dash without a whole."""
    return F.coalesce(F.concat(F.format_number(F.try_divide(100.0 * part, whole), places), F.lit("%")), F.lit("-"))


def p_text(p: Column) -> Column:
    return F.when(p < 0.001, "p < 0.001").otherwise(F.concat(F.lit("p = "), F.format_number(p, 3)))


def listing(items: Column) -> Column:
    """a; a and b; a, b and c."""
    n = F.size(items)
    return F.when(n < 2, F.array_join(items, "")).otherwise(F.concat(F.array_join(F.slice(items, 1, F.greatest(n - 1, F.lit(0))), ", "), F.lit(" and "), F.element_at(items, -1)))
