"""Checks of cited evidence: rows of papers and of statements that quote them become rows of problems (place, problem).

Each set of rules is one array expression over a row, so a table is read once however many rules there are.
"""

from __future__ import annotations

import re

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldmark.functions.text import alnum, contains, numbers_in, squash

# What a citation may not be, and how long a quote must be.
DOI = r"^10\.\d{4,9}/\S+$"
PREPRINT_PREFIXES = "10.48550/ 10.1101/ 10.2139/ 10.5281/ 10.21203/ 10.31219/ 10.20944/ 10.22541/ 10.32942/ 10.31234/ 10.31235/ 10.31224/ 10.32388/ 10.36227/".split()
PREPRINT_WORDS = "arxiv biorxiv medrxiv ssrn preprints researchsquare zenodo authorea ecoevorxiv osfpreprints preprint".split()
RETRACTIONS = ("retraction", "withdrawal", "removal", "expression_of_concern", "expression-of-concern")
MIN_QUOTE_CHARS, MIN_QUOTE_WORDS = 25, 6

PAPERS = "paper string, doi string, title string, authors string, year int, journal string"
STATEMENTS = "place string, paper string, quotes array<string>, summary string, affected string, region string, design string"
REGISTRY = "doi string, title string, journal string, years array<int>, kind string, issn string, first_author string, notices array<string>, abstract string"


def is_preprint(doi: Column, venue: Column) -> Column:
    low, name = F.lower(F.coalesce(doi, F.lit(""))), alnum(F.coalesce(venue, F.lit("")))
    out = F.lit(False)
    for p in PREPRINT_PREFIXES:
        out = out | low.startswith(p)
    for w in PREPRINT_WORDS:
        out = out | name.contains(w)
    return out


def same_title(a: Column, b: Column) -> Column:
    """Equal but for signs and case; one may end with up to two characters more."""
    return alike(alnum(F.coalesce(a, F.lit(""))), alnum(F.coalesce(b, F.lit(""))))


def alike(x: Column, y: Column) -> Column:
    longer = (F.least(F.length(x), F.length(y)) > 0) & (F.abs(F.length(x) - F.length(y)) <= 2) & (x.startswith(y) | y.startswith(x))
    return (x == y) | longer


def problems(df: DataFrame, place: Column, rules: list[tuple[str, Column]]) -> DataFrame:
    """(place, problem) for each rule whose condition holds; a condition that is null doesn't."""
    found = F.filter(F.array(*[F.when(broken, F.lit(name)) for name, broken in rules]), lambda x: x.isNotNull())
    return df.select(place.alias("place"), F.explode(found).alias("problem"))


def _blank(c: str) -> Column:
    return F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == ""


def paper_problems(papers: DataFrame, statements: DataFrame, min_year: int = 2016, blocked: tuple[str, ...] = ()) -> DataFrame:
    """What is wrong with the papers as cited: missing fields, odd or shared DOIs, age, venues, and papers that nothing cites."""
    venue = alnum(F.coalesce("journal", F.lit("")))
    rules = [(f"missing {c}", _blank(c)) for c in ("doi", "title", "authors", "year", "journal")]
    rules += [
        ("malformed doi", ~_blank("doi") & ~F.col("doi").rlike(DOI)),
        ("too old", F.col("year") < min_year),
        ("not a research journal", venue.isin(*blocked) if blocked else F.lit(False)),
        ("a preprint", is_preprint(F.col("doi"), F.col("journal"))),
    ]
    one = problems(papers, F.col("paper"), rules)
    first = papers.filter(~_blank("doi")).groupBy(F.lower("doi").alias("d")).agg(F.min("paper").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = papers.join(first, F.lower("doi") == F.col("d")).filter("paper != first").select(F.col("paper").alias("place"), F.lit("doi of another paper").alias("problem"))
    unused = papers.join(statements, "paper", "left_anti").select(F.col("paper").alias("place"), F.lit("cited by nothing").alias("problem"))
    return one.unionByName(shared).unionByName(unused)


def statement_problems(statements: DataFrame, papers: DataFrame, designs: tuple[str, ...] = ("experimental", "observational", "review", "modelled")) -> DataFrame:
    """What is wrong with statements by themselves: unknown papers, quotes that are absent, short or repeated, figures no quote has, gaps."""
    q = F.coalesce("quotes", F.array().cast("array<string>"))
    short = F.exists(q, lambda x: (F.length(F.trim(x)) < MIN_QUOTE_CHARS) | (F.size(F.split(F.trim(x), r"\s+")) < MIN_QUOTE_WORDS))
    said = numbers_in(F.coalesce("summary", F.lit("")))
    rules = [
        ("no quotes", F.size(q) == 0),
        ("quote too short", short),
        ("same quote twice", F.size(F.array_distinct(F.transform(q, squash))) < F.size(q)),
        ("figure without quote", F.size(F.array_except(said, numbers_in(F.array_join(q, " "), words=True))) > 0),
        ("empty summary", _blank("summary")),
        ("no affected", _blank("affected")),
        ("no region", _blank("region")),
        ("unknown design", ~F.coalesce(F.col("design").isin(*designs), F.lit(False))),
    ]
    unknown = statements.join(papers, "paper", "left_anti").select("place", F.lit("unknown paper").alias("problem"))
    key = ["paper", "summary", "affected", "region"]
    twice = statements.groupBy(*key).agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    on = [statements[c].eqNullSafe(twice[c]) for c in key]
    again = statements.join(twice, on).filter(statements["place"] != F.col("first")).select(statements["place"], F.lit("entry twice").alias("problem"))
    return problems(statements, F.col("place"), rules).unionByName(unknown).unionByName(again)


def registry_problems(papers: DataFrame, records: DataFrame, allowed: tuple[str, ...] = ("journal-article",), min_year: int = 2016) -> DataFrame:
    """Where a registry's record of the DOI differs from the citation, or says that it is no sound paper."""
    r = records.select(F.lower("doi").alias("r_doi"), *[F.col(c).alias(f"r_{c}") for c in ("title", "journal", "years", "kind", "issn", "first_author", "notices")])
    df = papers.join(r, F.lower("doi") == F.col("r_doi"), "left")
    stated = alnum(F.split_part(F.coalesce("authors", F.lit("")), F.lit(","), F.lit(1)))
    first = alnum(F.coalesce("r_first_author", F.lit("")))
    known = F.col("r_doi").isNotNull()
    rules = [
        ("no record", ~known),
        ("not a journal article", known & ~F.coalesce(F.col("r_kind").isin(*allowed), F.lit(False))),
        ("no issn", known & F.col("r_issn").isNull()),
        ("title differs", known & ~same_title(F.col("r_title"), F.col("title"))),
        ("journal differs", alnum(F.col("r_journal")) != alnum(F.coalesce("journal", F.lit("")))),
        ("year differs", known & ~F.coalesce(F.array_contains("r_years", F.col("year")), F.lit(False))),
        ("too old on record", F.array_min("r_years") < min_year),
        ("first author differs", (first != "") & (stated != "") & ~first.contains(stated) & ~stated.contains(first)),
        ("retracted", F.arrays_overlap(F.transform("r_notices", F.lower), F.array(*[F.lit(x) for x in RETRACTIONS]))),
    ]
    return problems(df, F.col("paper"), rules)


def abstract_from_positions(positions: Column) -> Column:
    """Text of a map from words to their places, in the order of places."""
    pairs = F.flatten(F.transform(F.map_entries(positions), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.array_join(F.transform(F.array_sort(pairs), lambda x: x["w"]), " ")


def quote_problems(statements: DataFrame, abstracts: DataFrame) -> DataFrame:
    """Quotes that no abstract of their paper has, and figures of a statement that its paper's abstracts don't have.

    ``abstracts``: (paper, text), some for a paper; they are gathered by paper and met once for each statement.
    """
    texts = abstracts.filter(F.trim("text") != "").groupBy("paper").agg(F.collect_list("text").alias("texts"))
    df = statements.join(texts, "paper", "left")
    have = F.transform(F.coalesce("texts", F.array().cast("array<string>")), lambda t: t)
    missing = F.filter("quotes", lambda q: ~F.exists(have, lambda t: contains(t, q)))
    seen = numbers_in(F.array_join(have, " "), words=True)
    rules = [("no abstract", F.size(have) == 0), ("quote not found", (F.size(have) > 0) & (F.size(missing) > 0))]
    rules += [(f"figure of {c} not found", (F.size(have) > 0) & (F.size(F.array_except(numbers_in(F.coalesce(c, F.lit(""))), seen)) > 0)) for c in ("summary", "affected", "region")]
    return problems(df, F.col("place"), rules)


def citation(papers: DataFrame) -> DataFrame:
    """Each paper as a reference is shown, in the order of first authors and years."""
    text = F.concat(F.col("authors"), F.lit(" ("), F.col("year"), F.lit(") "), F.col("title"), F.lit(". "), F.col("journal"), F.lit(". doi:"), F.col("doi"))
    return papers.select("paper", text.alias("reference"), F.concat(F.lit("https://doi.org/"), F.col("doi")).alias("url"), F.struct(alnum(F.split_part("authors", F.lit(","), F.lit(1))).alias("author"), "year").alias("order"))


def cited_in(text: Column) -> Column:
    """Author and year of citations such as (Smith et al. 2020) or Smith and Jones (2019)."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"(\p{Lu}[\p{L}'-]+(?: (?:et al\.|(?:and|&) \p{Lu}[\p{L}'-]+))?,? \(?(?:19|20)\d{2}[a-z]?)"), F.lit(1)))


#: Characters of a fingerprint, and how many neighbours choose one of them.
GRAM, SPAN = 16, 32
_POWERS = np.array([pow(1_000_003, k, 1 << 64) for k in range(GRAM)], np.uint64)


def _chosen(text: str, one: bool) -> np.ndarray:
    """The least hash of each SPAN neighbouring grams, or of the first ones only; none for texts too short for a whole span."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    codes = codes[: GRAM + SPAN - 1] if one else codes
    n = len(codes) - GRAM + 1
    if n < SPAN:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for k in range(GRAM):
        h += codes[k : n + k] * _POWERS[k]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    step = 1
    while step < SPAN:  # SPAN is a power of two
        h = np.minimum(h[:-step], h[step:])
        step *= 2
    return np.unique(h)


def quotes_found(docs: DataFrame, quotes: DataFrame, doc_key: str, quote_key: str, broadcast_rows: int = 200_000) -> DataFrame:
    """(doc, quote) for every quote that stands in a text, whatever the spacing and typography.

    ``docs`` and ``quotes`` are (key, text). Whole texts are squashed as they are read, and those of pairs once more. A text's fingerprints are the least hashes of neighbouring grams, so
    that a text that holds a quote has the quote's first one; pairs meet by it, and containment decides. Quotes too short for a
    fingerprint (under 47 signs) are looked for in every text, in blocks; a null or empty quote stands nowhere.
    """
    raw = docs.select(F.col(doc_key).alias("d_"), F.col("text").alias("raw_")).filter("raw_ IS NOT NULL")
    d = raw.select("d_", squash(F.col("raw_")).alias("t_"))  # a filter or distinct texts here would squash or shuffle all of them again
    q = quotes.select(F.col(quote_key).alias("q_"), squash(F.col("text")).alias("s_")).filter("s_ <> ''").distinct()
    long_ = F.length("s_") >= GRAM + SPAN - 1

    def prints(one: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = [_chosen(t, one) for t in batch.column(1).to_pylist()]
                at = np.repeat(np.arange(len(found)), [len(x) for x in found])
                h = np.concatenate([np.zeros(0, np.uint64), *found]).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(h)], batch.schema.names[:1] + ["h"])

        return run

    kind = lambda df, c: df.schema[c].dataType.simpleString()
    marks = d.select("d_", "t_").mapInArrow(prints(False), f"d_ {kind(d, 'd_')}, h long")
    asked = q.filter(long_).select("q_", "s_").mapInArrow(prints(True), f"q_ {kind(q, 'q_')}, h long")
    pairs = marks.join(asked, "h").select("d_", "q_").distinct()
    near = pairs.join(q, "q_").join(raw, "d_").filter(F.contains(squash(F.col("raw_")), F.col("s_"))).select("d_", "q_")
    short = q.filter(~long_)
    if 0 < short.limit(broadcast_rows + 1).count():
        near = near.unionByName(d.join(short, F.contains("t_", "s_")).select("d_", "q_"))
    return near.distinct().select(F.col("d_").alias(doc_key), F.col("q_").alias(quote_key))


FIRST_INDEX = "doi string, title string, journal string, years array<int>, kind string, subtype string, issn string, first_author string, notices array<string>"
SECOND_INDEX = "asked string, doi string, title string, year int, kind string, venue_kind string, retracted boolean"
NOT_REVIEWED = ("preprint", "dissertation", "dataset", "report", "paratext", "editorial", "erratum", "retraction", "peer-review")


def index_violations(papers: DataFrame, first: DataFrame, second: DataFrame, allowed: tuple[str, ...] = ("journal-article",), min_year: int = 2016, blocked: tuple[str, ...] = (), not_reviewed: tuple[str, ...] = NOT_REVIEWED) -> DataFrame:
    """(paper, index, violation): where two indexes of papers contradict a citation, or one another, or say that it is no sound paper.

    Both indexes meet in one full join by DOI, then the citations join that; rules look at the joined row. ``first`` has a row for a DOI,
    ``second`` for each DOI that was asked for, with the one that it holds. A paper that the first index lacks has that one
    violation; one that the second lacks isn't vouched for by two. Rules that an absent value leaves open aren't violated.
    """
    a = first.select(F.lower("doi").alias("key"), F.struct(*[F.col(c) for c in first.columns]).alias("a"))
    b = second.select(F.lower("asked").alias("key"), F.struct(*[F.col(c) for c in second.columns]).alias("b"))
    df = papers.withColumn("key", F.lower("doi")).join(a.join(b, "key", "full"), "key", "left")
    x = lambda c: F.col(f"a.{c}")
    y = lambda c: F.col(f"b.{c}")
    has, other, text_of = F.col("a").isNotNull(), F.col("b").isNotNull(), lambda c: F.coalesce(c, F.lit(""))
    folded = {"venue_": x("journal"), "stated_": F.split_part(text_of(F.col("authors")), F.lit(","), F.lit(1)), "author_": x("first_author"), "title_": F.col("title"), "title_a_": x("title"), "title_b_": y("title"), "journal_": F.col("journal")}
    df = df.withColumns({k: alnum(text_of(v)) for k, v in folded.items()})  # each once, for rules to look at
    venue, stated, author = F.col("venue_"), F.col("stated_"), F.col("author_")
    article = x("kind") == "journal-article"
    their = F.regexp_replace(F.lower(text_of(y("doi"))), "^https://doi[.]org/", "")
    rules = [
        ("first", "absent", ~has),
        ("first", "kind", has & ~F.coalesce(x("kind").isin(*allowed), F.lit(False))),
        ("first", "subtype", text_of(x("subtype")) != ""),
        ("first", "no issn", has & ((venue == "") | (text_of(x("issn")) == ""))),
        ("first", "blocked venue", (venue != "") & venue.isin(*[re.sub("[^a-z0-9]", "", v.lower()) for v in blocked])),
        ("first", "preprint", has & is_preprint(F.col("doi"), x("journal"))),
        ("first", "no authors", has & (author == "")),
        ("first", "title", has & ~alike(F.col("title_a_"), F.col("title_"))),
        ("first", "journal", (venue != "") & (venue != F.col("journal_"))),
        ("first", "year", has & ~F.coalesce(F.array_contains(x("years"), F.col("year")), F.lit(False))),
        ("first", "too old", F.array_min(x("years")) < min_year),
        ("first", "author", (author != "") & (stated != "") & ~author.contains(stated) & ~stated.contains(author)),
        ("first", "notice", F.arrays_overlap(F.transform(x("notices"), lambda n: F.lower(n)), F.array(*[F.lit(n) for n in RETRACTIONS]))),
        ("second", "absent", has & ~other),
        ("second", "retracted", has & y("retracted")),
        ("second", "venue", article & (text_of(y("venue_kind")) != "") & (y("venue_kind") != "journal")),
        ("second", "not reviewed", article & y("kind").isin(*not_reviewed)),
        ("second", "doi", has & (their != "") & (their != F.lower("doi"))),
        ("both", "title", (text_of(x("title")) != "") & (text_of(y("title")) != "") & ~alike(F.col("title_a_"), F.col("title_b_"))),
        ("both", "year", (F.size(x("years")) > 0) & ~F.exists(x("years"), lambda n: F.abs(n - y("year")) <= 1)),
    ]
    found = F.filter(F.array(*[F.when(broken, F.struct(F.lit(i).alias("index"), F.lit(v).alias("violation"))) for i, v, broken in rules]), lambda v: v.isNotNull())
    return df.select("paper", F.explode(found).alias("v")).select("paper", "v.index", "v.violation")
