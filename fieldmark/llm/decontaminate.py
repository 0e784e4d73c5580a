"""Benchmark decontamination by template windows: typed placeholders for numbers, names and units. DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldmark.llm.common import materialise, only

# Units of measure, as they stand after a number.
UNITS = "mm cm dm km m mg g kg t ml cl dl l ms s sec min h hr hrs kb mb gb tb hz khz mhz ghz w kw v a k usd eur gbp dollars euros pounds cents percent miles mile feet foot ft inches inch in yards meters metres grams kilograms liters litres hours hour minutes minute seconds second days day weeks week months month years year".split()
# Numbers in words.
NUMBER_WORDS = {
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9", "ten": "10", "eleven": "11", "twelve": "12",
    "thirteen": "13", "fourteen": "14", "fifteen": "15", "sixteen": "16", "seventeen": "17", "eighteen": "18", "nineteen": "19", "twenty": "20", "thirty": "30", "forty": "40",
    "fifty": "50", "sixty": "60", "seventy": "70", "eighty": "80", "ninety": "90", "hundred": "100", "thousand": "1000", "million": "1000000",
}
# Frequent words that sentences begin with; capitalised, they are no names.
COMMON = frozenset(
    "a about after all also although an and another any are as at be because before being both but by can could did do does during each every few first for from given had has have he her here his how however i if in into is it its let let's many more most much my no not now of on once one only or other our she since so some such suppose than that the their then there therefore these they this those though through thus to two under until up was we were what when where whether which while who whom whose why will with would you your "
    "au aux avec ce ces cette comme dans de des du elle en est et il ils je la le les leur lorsque mais ne nous on ou par pas pour quand que quel quelle qui sa se ses si son sur un une vous "
    "aber als am auch auf aus bei bis da das dass dem den der des die doch du durch ein eine einem einen einer er es für hat ich ihr im in ist kann mit nach nicht nun nur ob oder sein sich sie sind so und unter vom von vor wann warum was weil welche welcher wenn wer wie wir wo zu zum zur "
    "al como con cuando de del desde donde el ella en entre es esta este ha la las lo los más me mi muy no nos o para pero por porque que se si sin sobre son su sus también un una unos y ya yo".split()
)
#: Marks before a name, a number and a unit; a mark alone is the placeholder. Marks after a word of a name or digits, and after a number word.
NAME, NUMBER, UNIT, END, SPELT = "\x01", "\x02", "\x03", "\x04", "\x05"
#: Forms of a text: with placeholders, and plain lower-case words.
TEMPLATE, PLAIN = 0, 1


@dataclass(frozen=True)
class TemplateRules:
    """Windows of ``width`` template words, of which ``literals`` are no placeholders; an item counts from ``share`` of its windows.

    Items with fewer words than ``width`` are looked for as whole texts, and with ``inside`` in longer documents as well; all but two
    of their words, and one at least, must be literal.
    """

    width: int = 5
    literals: int = 3
    share: float = 0.8
    inside: bool = False


def joined(words) -> str:
    """An alternation of words that tries each beginning once."""
    tails: dict[str, list[str]] = {}
    for w in sorted(words):
        tails.setdefault(w[0], []).append(w[1:])
    rest = {c: joined([t for t in ts if t]) if any(ts) else "" for c, ts in tails.items()}
    return "|".join(c + (f"(?:{rest[c]}){'?' * ('' in ts)}" if rest[c] else "") for c, ts in tails.items())


def without_signs(text: Column) -> Column:
    """Texts without marks of their own, and without signs between digits (1,000 and 3.14)."""
    text = F.coalesce(text, F.lit(""))
    marks = reduce(Column.__or__, [F.contains(text, F.lit(m)) for m in (NAME, NUMBER, UNIT, END, SPELT)])  # rare, and a search for one byte is cheap
    return F.regexp_replace(F.when(marks, F.regexp_replace(text, r"[\x01-\x05]", " ")).otherwise(text), r"[.,:/](?<=\d[.,:/])(?=\d)", "")


# The patterns begin with what is rare, leave spaces alone, and name a-z, letters too, since these are tried first. A look behind a letter takes in
# characters beyond 16 bits only if its pattern has one.
def marked(bare: Column) -> Column:
    """Template words of a text without signs; a placeholder is its mark and what it stands for.

    Numbers are digits, or runs of number words; units are fixed words after digits; names are runs of capitalised words, wherever
    they stand, but for common ones, which may begin sentences. All else is in lower case without punctuation.
    """
    t = F.regexp_replace(bare, "(?=\\p{Lu}\\p{Ll})(?<![\\p{L}\\p{M}&&[\\x00-\U0010ffff]])(\\p{Lu}[a-z\\p{L}\\p{M}]*)", f"{NAME}$1{END}")
    common = joined(COMMON | set(NUMBER_WORDS))
    t = F.regexp_replace(F.lower(t), rf"(?=[\x01\x04])(?:\x01({common})\x04|(\x04)[ '-]\x01(?!(?:{common})\x04))", "$1$2")  # common words are no names; names side by side are one
    t = F.regexp_replace(t, r"\d+", f"{NUMBER}$0{END}")
    t = F.regexp_replace(t, rf"(\x02\d+\x04[ -]{{0,2}})({joined(UNITS)})([^\p{{L}}\p{{M}}]|$)", f"$1 {UNIT}$2$3")
    t = F.regexp_replace(F.concat(F.lit(" "), t, F.lit(" ")), r"[^ a-z\p{L}\p{M}\p{Nd}\x01-\x05]+", " ")  # each word has spaces before and behind
    t = F.regexp_replace(t, rf" (?=[{''.join(sorted({w[0] for w in NUMBER_WORDS}))}])({joined(NUMBER_WORDS)})(?= )", f" {NUMBER}$1{SPELT}")
    t = F.regexp_replace(t, r"\x05 +\x02([a-z])", f"{SPELT}$1")
    return _split(t)


def plain(bare: Column) -> Column:
    """Words of a text without signs, in lower case without punctuation."""
    return _split(F.regexp_replace(F.lower(bare), r"[^ a-z\p{L}\p{M}\p{Nd}]+", " "))


def _split(words: Column) -> Column:
    return F.array_remove(F.split(words, " "), "")


def canonical(words: Column) -> Column:
    """Placeholders without what they stand for: their marks are the least of all characters that words begin with."""
    return F.transform(words, lambda w: F.when(w < END, F.substring(w, 1, 1)).otherwise(w))


def values(words: Column) -> Column:
    """Single number words as digits, so that 7 and seven are one value."""
    digits = F.create_map(*[F.lit(x) for w, d in NUMBER_WORDS.items() for x in (NUMBER + w + SPELT, NUMBER + d + END)])
    return F.transform(words, lambda w: F.coalesce(digits[w], w))


class Asked(NamedTuple):
    """Windows of ``n`` words of a column of words, in texts with more than ``over`` words: one for all words where there are fewer than ``n``."""

    words: str
    n: int
    form: int
    over: int = 0


# Places are exploded with the outer form: the plain one makes the optimizer infer a filter on the array, which it pushes below the
# projection that makes the words, so that they would be made anew for every window.
def window_hashes(df: DataFrame, keep: list[str], asked: list[Asked]) -> DataFrame:
    """(keep, form, place, h): a hash for each window that is asked for, and the place of its first word.

    Places are exploded and hashed as rows, in compiled code; a function over arrays would be interpreted for every window.
    """
    count = lambda a: F.when(F.size(a.words) > a.over, F.greatest(F.size(a.words) - a.n, F.lit(0)) + 1).otherwise(0)
    ends = [sum((count(b) for b in asked[1 : i + 1]), count(asked[0])).alias(f"end{i}_") for i in range(len(asked))]
    df = df.select(*keep, *{a.words: None for a in asked}, *ends)
    df = df.select("*", F.posexplode_outer(F.array_repeat(F.lit(0), F.col(f"end{len(asked) - 1}_"))).alias("at_", "one_")).filter(F.col("at_").isNotNull())

    def of_piece(value) -> Column:
        """The value for the first window column whose end is beyond the place."""
        out = None
        for i, a in reversed(list(enumerate(asked))):
            x = value(a, F.col("at_") - F.col(f"end{i - 1}_") if i else F.col("at_"))
            out = x if out is None else F.when(F.col("at_") < F.col(f"end{i}_"), x).otherwise(out)
        return out

    hashed = lambda a, place: F.xxhash64(F.lit(a.form), *[F.get(a.words, place + k) for k in range(a.n)])
    return df.select(*keep, of_piece(lambda a, _: F.lit(a.form)).alias("form"), of_piece(lambda _, place: place).alias("place"), of_piece(hashed).alias("h"))


def item_windows(items: DataFrame, rules: TemplateRules) -> DataFrame:
    """(item_id, form, at, h) of the template windows with enough literal words, and of all plain ones."""
    df = items.select("item_id", without_signs(F.col("text")).alias("text")).select("item_id", canonical(marked(F.col("text"))).alias("w"), plain(F.col("text")).alias("p"))
    df = df.withColumn("words", F.col("w"))
    df = window_hashes(df, ["item_id", "words"], [Asked("w", rules.width, TEMPLATE), Asked("p", rules.width, PLAIN)]).withColumnsRenamed({"words": "w", "place": "at"})
    literal = F.size(F.filter(F.slice("w", F.col("at") + 1, rules.width), lambda x: ~x.rlike(r"^[\x01-\x03]")))
    enough = literal >= F.greatest(F.lit(1), F.least(F.lit(rules.literals), F.size("w") - 2))
    return df.filter((F.col("form") == PLAIN) | enough).select("item_id", "form", "at", "h")


def find_leaks(docs: DataFrame, items: DataFrame, rules: TemplateRules = TemplateRules(), broadcast_rows: int = 1_000_000) -> DataFrame:
    """(doc_id, item_id) of every document that holds a benchmark item, word for word in any case or with other numbers, names or units.

    Returns doc_id, item_id, n_windows (of the item, distinct), n_matched, n_changed (slots with another value) and containment, at
    least ``share``; of the template where it counts, else of the plain words. Windows of both forms are joined by their hashes. A
    document that holds ``share`` of an item's windows has one of its rarest few, so pairs are made by these alone, and other windows
    are compared only for those pairs. Every value of the item must stand for one value in the document, over all windows of the
    pair, or over those of one alignment that has enough by itself (a document may hold an item twice with other values); where it
    doesn't, only windows without placeholders count. The item side is broadcast up to ``broadcast_rows`` windows (16 bytes each) and
    shuffled beyond. A null text has no words and leaks nothing; items without words, or without an id, are never found. Documents
    are told apart by doc_id and text, null ids included: rows that share a doc_id are never put together, and rows that share both
    are found once. Other columns are ignored. No rows: no rows.
    """
    docs, items = only(docs, "doc_id", "text"), only(items, "item_id", "text").filter(F.col("item_id").isNotNull())
    docs = docs.select("doc_id", F.xxhash64("text").alias("text_"), "text")
    key, item = ["doc_id", "text_"], ["item_id", "form"]
    windows = materialise(item_windows(items, rules), "windows").df
    sizes = windows.groupBy(*item).agg(F.countDistinct("h").alias("n_windows"))
    small = windows.count() <= broadcast_rows
    near = F.broadcast if small else (lambda df: df)
    bare = items.select(without_signs(F.col("text")).alias("text"))
    lengths = bare.select(F.explode(F.array(F.struct(F.lit(TEMPLATE).alias("form"), F.size(marked(F.col("text"))).alias("n")), F.struct(F.lit(PLAIN).alias("form"), F.size(plain(F.col("text"))).alias("n")))).alias("x"))
    short = sorted((r.n, r.form) for r in lengths.select("x.*").filter(F.col("n").between(1, rules.width - 1)).distinct().collect()) if rules.inside else []  # width - 1 lengths of two forms at most
    words = {TEMPLATE: "w", PLAIN: "p"}
    own = docs.select(*key, without_signs(F.col("text")).alias("text")).select(*key, canonical(marked(F.col("text"))).alias("w"), plain(F.col("text")).alias("p"))
    asked = [Asked(w, rules.width, form) for form, w in words.items()] + [Asked(words[form], n, form, over=n) for n, form in short]
    seen = window_hashes(own, key, asked)
    hashes = windows.select(F.col("h").alias("h_")).distinct()
    found = materialise(seen.join(near(hashes), F.col("h") == F.col("h_")).select(*key, "place", "h"), "found").df

    # an item's windows from the rarest in documents on; all but share of them, and one more, are enough to meet
    df = found.groupBy(F.col("h").alias("h_")).agg(F.count(F.lit(1)).alias("df"))
    ranked = windows.select(*item, "h").distinct().join(sizes, item).join(df, F.col("h") == F.col("h_"), "left")
    place = F.row_number().over(Window.partitionBy(*item).orderBy(F.coalesce("df", F.lit(0)), "h"))
    rare = ranked.withColumn("place_", place).filter(F.col("df").isNotNull() & (F.col("place_") <= F.col("n_windows") - F.ceil(F.lit(rules.share) * F.col("n_windows") - 1e-9) + 1))
    rare = materialise(rare.select(*item, F.col("h").alias("h_")), "rare").df
    pairs = found.select(*key, "h").distinct().join(near(rare), F.col("h") == F.col("h_")).select(*key, *item).distinct()
    wanted = pairs.select(F.col("doc_id").alias("d_"), F.col("text_").alias("t_"), F.col("item_id").alias("i_"), F.col("form").alias("f_"))
    asked = wanted.join(near(windows), (F.col("i_") == F.col("item_id")) & (F.col("f_") == F.col("form"))).select("d_", "t_", *item, F.col("h").alias("h_"), "at")
    lines = found.join(asked, F.col("doc_id").eqNullSafe(F.col("d_")) & (F.col("text_") == F.col("t_")) & (F.col("h") == F.col("h_"))).select(*key, *item, "h", "place", "at")
    lines = materialise(lines, "lines").df
    full = lines.groupBy(*key, *item).agg(F.countDistinct("h").alias("n")).join(sizes, item).filter(F.col("n") >= rules.share * F.col("n_windows"))
    full = materialise(full.select(F.col("doc_id").alias("d_"), F.col("text_").alias("t_"), F.col("item_id").alias("i_"), F.col("form").alias("f_"), "n_windows"), "full").df
    same = F.col("doc_id").eqNullSafe(F.col("d_")) & (F.col("text_") == F.col("t_"))
    lines = lines.join(full, same & (F.col("item_id") == F.col("i_")) & (F.col("form") == F.col("f_")))
    lines = lines.groupBy(*key, *item, "n_windows", (F.col("place") - F.col("at")).alias("shift")).agg(F.collect_list(F.struct("at", "h")).alias("at"))

    # plain words have no slots: empty arrays stand for them
    texts = docs.join(full.filter(F.col("f_") == TEMPLATE).select("d_", "t_").distinct(), same, "left_semi").dropDuplicates(key)
    texts = texts.select(F.col("doc_id").alias("d_"), F.col("text_").alias("t_"), values(marked(without_signs(F.col("text")))).alias("dw"))
    words_of = items.select(F.col("item_id").alias("i_"), F.lit(TEMPLATE).alias("f_"), values(marked(without_signs(F.col("text")))).alias("iw")).dropDuplicates(["i_", "iw"])
    lines = lines.join(words_of, (F.col("item_id") == F.col("i_")) & (F.col("form") == F.col("f_")), "left").join(texts, same & (F.col("form") == TEMPLATE), "left")
    none = F.array().cast("array<string>")
    lines = lines.withColumns({"iw": F.coalesce("iw", none), "dw": F.coalesce("dw", none)})

    def slots(x: Column) -> Column:
        """(item's value, document's value) of the placeholders of the window at x."""
        a = F.slice(F.col("iw"), x["at"] + 1, rules.width)
        b = F.slice(F.col("dw"), x["at"] + F.col("shift") + 1, rules.width)
        return F.filter(F.arrays_zip(a.alias("a"), b.alias("b")), lambda s: s["a"].rlike(r"^[\x01-\x03]"))

    lines = lines.withColumn("pairs", F.array_distinct(F.flatten(F.transform("at", slots))))
    even = F.size("pairs") == F.size(F.array_distinct(F.transform("pairs", lambda s: s["a"])))
    changed = F.size(F.filter("pairs", lambda s: s["a"] != s["b"]))
    alone = F.size(F.array_distinct(F.transform("at", lambda x: x["h"])))
    no_slot, no_hash = F.lit(None).cast("struct<a: string, b: string>"), F.lit(None).cast("long")
    rows = F.concat(
        F.transform("at", lambda x: F.struct(x["h"].alias("h"), F.when(F.size(slots(x)) == 0, x["h"]).alias("bare"), no_slot.alias("s"))),
        F.transform("pairs", lambda s: F.struct(no_hash.alias("h"), no_hash.alias("bare"), F.struct(s["a"].alias("a"), s["b"].alias("b")).alias("s"))),
    )
    lines = lines.select(*key, *item, "n_windows", F.when(even, alone).alias("alone"), F.when(even, changed).alias("changed"), F.explode_outer(rows).alias("x"))
    out = lines.groupBy(*key, *item, "n_windows").agg(
        F.countDistinct("x.h").alias("n_all"),
        F.countDistinct("x.bare").alias("n_bare"),
        (F.countDistinct("x.s") == F.countDistinct("x.s.a")).alias("even"),
        F.countDistinct(F.when(F.col("x.s.a") != F.col("x.s.b"), F.col("x.s"))).alias("n_changed"),
        F.max("alone").alias("alone"),
        F.max("changed").alias("changed"),
    )
    matched = F.greatest(F.when(F.col("even"), F.col("n_all")).otherwise(F.col("n_bare")), F.col("alone").cast("long"))
    changed = F.when(F.col("even"), F.col("n_changed")).otherwise(F.coalesce(F.col("changed").cast("long"), F.lit(0).cast("long")))
    out = out.select(*key, *item, "n_windows", matched.alias("n_matched"), changed.alias("n_changed")).filter(F.col("n_matched") >= rules.share * F.col("n_windows"))
    best = F.min_by(F.struct("n_windows", "n_matched", "n_changed"), "form").alias("x")
    out = out.groupBy(*key, "item_id").agg(best).select("doc_id", "item_id", "x.*")
    return out.withColumn("containment", F.col("n_matched") / F.col("n_windows"))
