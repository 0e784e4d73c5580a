"""What papers' texts cite and state: sentences, citations, known works, and figures that some quote or some origin has.

Texts are rows of (doc, text), so many papers are checked in one plan. A paper's references are rows with its doc; evidence is for all.
Patterns look neither ahead nor back, so engines without such patterns read them alike.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldmark.functions.text import numbers_in, plain

# Abbreviations whose point ends no sentence, particles of names, words before a citation, preprint servers, months.
ABBREVIATIONS = ("et al", "e.g", "i.e", "cf", "vs", "sp", "spp", "subsp", "var", "ca", "approx", "Fig", "Figs", "Eq", "No")
PARTICLES = ("af", "da", "das", "de", "del", "della", "den", "der", "di", "dos", "la", "le", "ten", "ter", "van", "von")
LEADS = ("see", "see also", "e.g.", "cf.", "but see", "reviewed in")
SERVERS = ("arxiv", "biorxiv", "medrxiv", "ssrn", "preprint", "preprints")
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")


def any_of(words: tuple[str, ...]) -> str:
    return "(?:" + "|".join(re.escape(w).replace(r"\ ", " ") for w in sorted(words, key=lambda w: (-len(w), w))) + ")"


#: A family name: letters of any script, the first one a capital, joined by hyphens or apostrophes, with particles before it.
FAMILY = rf"(?:{any_of(PARTICLES)} )*(?:d['’])?\p{{Lu}}[\p{{L}}\p{{M}}'’-]*\p{{L}}"
#: A work by its first author and year: other authors, a letter that tells works of one year apart, and pages may follow.
WORK = rf"(?:{any_of(LEADS)},? )?({FAMILY})(?:,? et al\.?|,? (?:and|&) {FAMILY})?,? ((?:1[6-9]|20)\d\d)([a-z]?)(?:[,:] ?(?:pp?\.? ?)?\d+(?:[-–]\d+)?)?"
ENDS, NEXT, DOT = r"([.!?][\"'”’)\]]*)\s+([\p{Lu}*(“\"])", "\u0001", "\u0002"


def sentences(text: Column) -> Column:
    """Sentences end with a point, an exclamation or a question mark before a capital, or with a paragraph; some abbreviations end none."""
    t = F.regexp_replace(text, rf"\b({any_of(ABBREVIATIONS)})\.", f"$1{DOT}")
    t = F.regexp_replace(F.regexp_replace(t, r"\n\s*\n", NEXT), ENDS, f"$1{NEXT}$2")
    return F.filter(F.transform(F.split(t, NEXT), lambda s: F.trim(F.replace(s, F.lit(DOT), F.lit(".")))), lambda s: s != "")


def numbered_sentences(texts: DataFrame) -> DataFrame:
    return texts.select("doc", F.posexplode(sentences(F.col("text"))).alias("at", "sentence"))


def cited_parts(sentence: Column) -> Column:
    """Structs (part, name, year, letter): the parts of parentheses in which some part names a work; what a part lacks is empty."""
    whole = f"^{WORK}$"
    inside = F.transform(F.regexp_extract_all(sentence, F.lit(r"\(([^()]*)\)"), F.lit(1)), lambda x: F.transform(F.split(x, ";"), lambda p: F.trim(p)))
    cited = F.flatten(F.filter(inside, lambda parts: F.exists(parts, lambda p: p.rlike(whole))))
    get = lambda p, k: F.regexp_extract(p, whole, k)
    return F.transform(cited, lambda p: F.struct(p.alias("part"), get(p, 1).alias("name"), get(p, 2).alias("year"), get(p, 3).alias("letter")))


def citations(texts: DataFrame) -> DataFrame:
    """(doc, at, part, name, year, letter): the parts of parentheses in which some part names a work; other parts have no name."""
    df = numbered_sentences(texts).select("doc", "at", F.inline(cited_parts(F.col("sentence"))))
    return _without_empty(df)


def _without_empty(df: DataFrame) -> DataFrame:
    get = lambda c: F.nullif(F.col(c), F.lit(""))
    return df.withColumns({"name": get("name"), "year": get("year").cast("int"), "letter": get("letter")})


def letters(name: Column) -> Column:
    """What a name is compared by."""
    return F.regexp_replace(plain(name), "[^a-z0-9]", "")


def surname(authors: Column) -> Column:
    """What a first author is found by: the name before the comma, folded."""
    return letters(F.split_part(F.coalesce(authors, F.lit("")), F.lit(","), F.lit(1)))


def lettered(works: DataFrame, scope: list[str]) -> DataFrame:
    """Works of one author and year are a, b, c in the order of their keys."""
    named = works.withColumn("surname", surname(F.col("authors")))
    order = Window.partitionBy(*scope, "surname", "year").orderBy("key")
    return named.withColumn("own", F.chr(F.row_number().over(order) + 96))


def stated(sentence: Column, names: tuple[str, ...] = ()) -> Column:
    """A sentence without what has digits but states nothing: citations, labels, dates, and names that are given."""
    month = any_of(MONTHS)
    what = [rf"\((?:[^()]*; ?)?{WORK}(?:;[^()]*)?\)", r"\b(?:Tables?|Figures?|Figs?\.?|Sections?|Appendix|Equations?) \d+(?:\.\d+)*[a-z]?\b", rf"\b(?:\d{{1,2}} )?{month} \d{{4}}\b", r"\b\d{4}-\d\d-\d\d\b", *([any_of(names)] if names else [])]
    return F.regexp_replace(sentence, "|".join(what), " ")


NUMBERS = "array<string>"


def noted(texts: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """(doc, at, code, subject, name, year, letter, numbers): all that is asked of texts, in one pass: their parts of citations (unread if
    they have no name), the figures that a sentence states (unquoted, as long as nothing has them), and preprint servers."""
    s, empty, none = F.col("sentence"), F.lit(""), F.array().cast(NUMBERS)

    def note(code: str, subject: Column, name: Column = empty, year: Column = empty, letter: Column = empty, numbers: Column = none) -> Column:
        return F.struct(F.lit(code).alias("code"), subject.alias("subject"), name.alias("name"), year.alias("year"), letter.alias("letter"), numbers.alias("numbers"))

    cited = F.transform(cited_parts(s), lambda p: note("unread", p["part"], p["name"], p["year"], p["letter"]))
    figures = F.when(s.rlike("[0-9]"), numbers_in(stated(s, names))).otherwise(none)
    server = F.when(F.contains(s, F.lit("did not use")), "").otherwise(F.regexp_extract(F.lower(s), rf"\b({any_of(SERVERS)})\b", 1))
    others = F.filter(F.array(note("unquoted", empty, numbers=figures), note("server", server)), lambda x: (x["subject"] != "") | (F.size(x["numbers"]) > 0))
    return _without_empty(numbered_sentences(texts).select("doc", "at", F.inline(F.concat(cited, others))))


def works_by_name(works: DataFrame, scope: list[str], kind: str, graded: Column) -> DataFrame:
    """One row for each author and year of a scope, with an array, named as the kind, of (own, kind, key, numbers); numbers are those of the
    quotes, null where quotes don't count."""
    quotes = F.array_join(F.coalesce("quotes", F.array().cast("array<string>")), " ")
    work = F.struct("own", F.lit(kind).alias("kind"), "key", F.when(graded, numbers_in(quotes, words=True)).alias("numbers"))
    return lettered(works, scope).groupBy(*scope, "surname", "year").agg(F.collect_list(work).alias(kind))


def text_problems(texts: DataFrame, evidence: DataFrame, references: DataFrame, resources: DataFrame | None = None, names: tuple[str, ...] = ()) -> DataFrame:
    """(doc, at, code, subject) of what is wrong with texts; ``at`` is the sentence, from 0, where there is one.

    unread: a part of a citation that names no work; unknown and several: a citation that means none or more than one; uncited: a
    reference of the paper that nothing cites; unquoted: figures of a sentence that no quote of the works cited in it has, where one of
    them is evidence or a claim; server: a preprint server; unnamed: a credited resource that the text doesn't name.

    ``evidence``: (key, authors, year, quotes); ``references``: (doc, key, authors, year, role, quotes); ``resources``: (doc, mention).
    A work that is cited twice is one work. Texts are read once; notes of them meet the works, by what is cited or by the paper, and are
    grouped by the problem that they may be.
    """
    # notes that cite nothing meet no work; names have no space, so these are dealt to all tasks
    by = F.coalesce(letters(F.col("name")), F.concat(F.lit(" "), F.xxhash64("doc", "at").cast("string")))
    notes = noted(texts, names).withColumn("surname", by)
    of_all = works_by_name(evidence, [], "evidence", F.lit(True))
    of_one = works_by_name(references, ["doc"], "reference", F.coalesce(F.col("role") == "claim", F.lit(False)))
    both = notes.join(of_all, ["surname", "year"], "left").join(of_one, ["doc", "surname", "year"], "left")
    some = [F.coalesce(c, F.array().cast(both.schema[c].dataType)) for c in ("evidence", "reference")]
    both = both.withColumn("works", F.filter(F.concat(*some), lambda w: F.col("letter").isNull() | (w["own"] == F.col("letter"))))
    known = F.filter(F.transform("works", lambda w: F.concat(w["kind"], F.lit(" "), w["key"])), lambda k: k.isNotNull())
    both = both.withColumn("n", F.size(F.array_distinct(known)))

    nowhere = F.lit(None).cast("int")

    def row(code: Column, subject: Column, at: Column = nowhere, cited: bool | None = None, stated: Column | None = None, quoted: Column | None = None) -> Column:
        numbers = [F.lit(None).cast(NUMBERS) if x is None else x for x in (stated, quoted)]
        return F.struct(at.alias("at"), code.alias("code"), subject.alias("subject"), F.lit(cited).cast("boolean").alias("cited"), numbers[0].alias("stated"), numbers[1].alias("quoted"))

    at, code, subject = F.col("at"), F.col("code"), F.col("subject")
    label = F.concat("name", F.lit(" "), F.col("year").cast("string"), F.coalesce("letter", F.lit("")))
    own = F.transform(F.filter("works", lambda w: (w["kind"] == "reference") & w["key"].isNotNull()), lambda w: row(F.lit("uncited"), w["key"], cited=True))
    quotes = F.transform(F.filter("works", lambda w: w["numbers"].isNotNull()), lambda w: row(F.lit("unquoted"), F.lit(""), at, quoted=w["numbers"]))
    rows = (
        F.when(F.col("name").isNull(), F.array(row(code, subject, at, stated=F.when(code == "unquoted", F.col("numbers")))))
        .when(F.col("n") == 1, F.concat(own, quotes))
        .otherwise(F.array(row(F.when(F.col("n") == 0, "unknown").otherwise("several"), label)))
    )
    told = both.select("doc", F.inline(rows))
    listed = references.select("doc", F.inline(F.array(row(F.lit("uncited"), F.col("key"), cited=False))))
    groups = told.unionByName(listed).groupBy("doc", "at", "code", "subject").agg(F.count(F.lit(1)).alias("n"), F.bool_or("cited").alias("cited"), F.collect_list("stated").alias("stated"), F.collect_list("quoted").alias("quoted"))
    missing = F.filter(F.transform("stated", lambda x: F.array_join(F.array_sort(F.array_except(x, F.flatten("quoted"))), ", ")), lambda x: x != "")
    found = (
        F.when(code == "unquoted", F.when(F.col("doc").isNotNull() & (F.size("quoted") > 0), missing))
        .when(code == "uncited", F.when(~F.col("cited"), F.array_repeat(subject, F.col("n").cast("int"))))
        .when(code == "server", F.array_repeat(subject, F.col("n").cast("int")))
        .otherwise(F.array(subject))
    )
    out = groups.select("doc", "at", "code", F.explode(found).alias("subject"))
    if resources is not None:
        unnamed = texts.join(resources, "doc").filter(~F.contains("text", "mention"))
        out = out.unionByName(unnamed.select("doc", nowhere.alias("at"), F.lit("unnamed").alias("code"), F.col("mention").alias("subject")))
    return out


# --- figures in prose ---------------------------------------------------------------------------------------------------------------

#: Parts of a source text that aren't prose: tables that are filled in, pictures, links, tokens, headings, numbers of lists.
NOT_PROSE = (r"<!-- table:(?s:.*?)<!-- /table -->", r"!\[[^\]]*\]\([^)]*\)", r"https?://\S+", r"\{\{\w+\}\}", r"(?m:^[ \t]*#.*$)", r"(?m:^[ \t]*\d+\.[ \t]+)")
YEAR = r"^(?:19|20)\d\d$"


def typed_numbers(texts: DataFrame, names: tuple[str, ...] = (), references: str = "## References") -> DataFrame:
    """(doc, literal): the distinct numbers that prose states, as they are typed, with signs of percent; years and the list of references
    are left out. A number is digits, with points of thousands or decimals between them, that no letter or digit touches."""
    prose = F.regexp_replace(F.split_part("text", F.lit(f"\n{references}"), F.lit(1)), "|".join(NOT_PROSE), " ")
    plain = stated(F.regexp_replace(prose, r"\s+", " "), names)
    words = F.transform(F.split(plain, r"[\s()\[\]/;:–—-]+"), lambda w: F.regexp_replace(w, r"^[\"'“‘*_~≈<>=±+]+|[.,!?\"'”’*_]+$", ""))
    numbers = F.filter(F.array_distinct(words), lambda w: w.rlike(r"^\d[\d.,]*%?$") & ~w.rlike(YEAR))
    return texts.select("doc", F.explode(numbers).alias("literal"))
