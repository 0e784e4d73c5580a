"""Text checks: folding of typography, containment of quotes, numbers, markup. Built-in functions throughout."""

from __future__ import annotations

import html
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldmark.functions.references import decoded

# Accented letters and what they are folded to, marks of ranks below species, and number words.
ACCENTED = "áàâäãåçéèêëíìîïñóòôöõúùûüýÿÁÀÂÄÃÅÇÉÈÊËÍÌÎÏÑÓÒÔÖÕÚÙÛÜÝ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY"
RANK_MARKS = ("var.", "subsp.", "ssp.", "f.", "forma")
NUMBER_WORDS = "one two three four five six seven eight nine ten eleven twelve".split()


def normalise(text: Column) -> Column:
    """Character references decoded, and what ``plain`` does."""
    return plain(decoded(text))


def plain(text: Column) -> Column:
    """Lower case, one space between words, plain dashes, quotes and letters, a point for a raised decimal point."""
    t = F.translate(text, ACCENTED, PLAIN)
    t = F.regexp_replace(t, "[‐-―−]", "-")
    t = F.regexp_replace(t, "[‘’‚′]", "'")
    t = F.regexp_replace(t, "[“”„″]", '"')
    t = F.regexp_replace(t, "(\\d)·(\\d)", "$1.$2")
    return F.lower(F.trim(F.regexp_replace(t, r"[\s ]+", " ")))


def squash(text: Column) -> Column:
    return F.regexp_replace(normalise(text), " ", "")


def contains(text: Column, quote: Column) -> Column:
    """Whether the quote stands in the text, whatever the spacing and typography."""
    return F.contains(squash(text), squash(quote))


def alnum(text: Column) -> Column:
    return F.regexp_replace(normalise(without_tags(text)), "[^a-z0-9]", "")


def without_tags(page: Column) -> Column:
    t = F.regexp_replace(page, r"(?is)<(script|style|noscript)\b.*?</\1\s*>", " ")
    return F.regexp_replace(t, r"(?s)<[^>]*>", " ")


def html_to_text(page: Column) -> Column:
    """Text without scripts, styles and tags, character references decoded, one space for white space of any kind."""
    return F.trim(F.regexp_replace(decoded(without_tags(page)), r"[\s\u00a0]+", " "))


def numbers_in(text: Column, words: bool = False) -> Column:
    """The distinct numbers: commas of thousands dropped, trailing zeros after a point trimmed; number words if asked for."""
    found = F.regexp_extract_all(F.regexp_replace(text, r"(\d),(?=\d{3}\b)", "$1"), F.lit(r"(\d+(?:\.\d+)?)"), F.lit(1))
    found = F.transform(found, lambda n: F.when(n.contains("."), F.regexp_replace(n, r"\.?0+$", "")).otherwise(n))
    if words:
        table = F.create_map(*[F.lit(x) for i, w in enumerate(NUMBER_WORDS) for x in (w, str(i + 1))])
        named = F.filter(F.split(F.lower(text), "[^a-z]+"), lambda w: w.isin(*NUMBER_WORDS))
        found = F.concat(found, F.transform(named, lambda w: F.element_at(table, w)))
    return F.array_sort(F.array_distinct(found))


def short_licence(text: Column) -> Column:
    """cc-... or cc0 of a licence's address; other texts trimmed in lower case."""
    low = F.lower(F.trim(text))
    by = F.regexp_extract(low, r"creativecommons\.org/licenses/([a-z-]+)", 1)
    free = low.rlike(r"creativecommons\.org/publicdomain/[a-z-]+") | (by == "zero")
    return F.when(low == "", None).when(free, "cc0").when(by != "", F.concat(F.lit("cc-"), by)).otherwise(low)


def canonical_name(name: Column) -> Column:
    """Genus and epithet, with a rank's mark and the name behind it if there are such; authors dropped."""
    parts = F.split(F.trim(name), r"\s+")
    two, rest = F.slice(parts, 1, 2), F.slice(parts, 3, 1000)
    mark = F.array_position(F.transform(rest, lambda p, i: p.isin(*RANK_MARKS) & (i + 1 < F.size(rest))), True)
    return F.array_join(F.when(mark > 0, F.concat(two, F.slice(rest, F.greatest(mark, F.lit(1)).cast("int"), 2))).otherwise(two), " ")


def folded(texts: pd.Series) -> pd.Series:
    """Typography folded for letters of any script: character references decoded, compatibility forms decomposed, marks dropped."""

    def one(t: str | None) -> str | None:
        if t is None:
            return None
        t = unicodedata.normalize("NFKD", html.unescape(t))
        return "".join(c for c in t if not unicodedata.combining(c))

    return texts.map(one)


def normalise_any(text: Column) -> Column:
    """``normalise`` beyond Western letters; Unicode decomposition has no built-in function, so this one runs over Arrow batches."""
    return normalise(F.pandas_udf(folded, "string")(text))
