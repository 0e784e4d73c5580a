"""Quality rules: counts of a document, and its distance from what its language looks like. DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldmark.llm.common import SPACE, materialise, only

# Frequent function words of each language.
COMMON_WORDS = {
    "en": "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which one you were her all she there would their we him been has when who will more no if out so".split(),
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont la avec ou son aux cette mais comme nous tout elle ses".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si sin sobre este ya entre cuando todo esta ser".split(),
}
#: Character classes, each taken from what the ones before it left; what none takes is the last class.
CHAR_CLASSES = (r"\p{Ll}+", SPACE + "+", r"\p{Lu}+", r"\p{N}+", r"[.,;:!?'\x22()-]+")
SYMBOLS = r"[#*$%&|<>]+"
#: Up to so many repeated windows are looked up one by one; more are found by sorting windows with their places.
FEW = 48


@dataclass(frozen=True)
class QualityRules:
    """Limits. Distances are square roots of Jensen-Shannon divergences in bits, 0 to 1.

    A document with fewer words or characters than the guards is too short for its histogram to mean anything and isn't judged by it.
    Words are few beside their bins, so even a fair sample of the reference diverges from it by about bins / (8 n ln 2) bits; the
    limit on words holds for what goes beyond that.
    """

    min_words: int = 50
    max_repeat_share: float = 0.5
    guard_words: int = 50
    guard_chars: int = 200
    max_char_distance: float = 0.28
    max_word_divergence: float = 0.06
    #: Bins with a larger share of the reference count as bins of its sampling noise.
    noise_share: float = 0.001


def vocabulary() -> list[str]:
    return list(dict.fromkeys(w for words in COMMON_WORDS.values() for w in words))


def _code(i: int) -> str:
    """A private-use character for each common word."""
    return chr(0xE000 + i)


def features(docs: DataFrame) -> DataFrame:
    """doc_id, language (one of COMMON_WORDS, else "other"), the base counts, chars (counts by class) and common (counts by word)."""
    language = F.when(F.col("lang").isin(*COMMON_WORDS), F.col("lang")).otherwise(F.lit("other"))
    df = only(docs, "doc_id", "text", "lang").select(F.col("doc_id"), language.alias("language"), F.coalesce(F.col("text"), F.lit("")).alias("s0"))

    for i, kind in enumerate(CHAR_CLASSES):
        df = df.withColumn(f"s{i + 1}", F.regexp_replace(f"s{i}", kind, ""))
    n = [F.length(f"s{i}") for i in range(len(CHAR_CLASSES) + 1)]
    chars = F.array(*[n[i] - n[i + 1] for i in range(len(CHAR_CLASSES))], n[-1])
    symbols = F.length("s4") - F.length(F.regexp_replace("s4", SYMBOLS, ""))  # s4: no letters, numbers, white space

    lines = F.filter(F.split("s0", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = df.withColumn("lines_", lines).withColumn("w", F.array_remove(F.split("s0", SPACE + "+"), ""))
    df = df.select(
        "doc_id",
        "language",
        "w",
        F.size("w").cast("long").alias("n_words"),
        (n[0] - (n[1] - n[2])).cast("long").alias("word_chars"),
        symbols.cast("long").alias("n_symbols"),
        (F.size("lines_") - F.size(F.array_distinct("lines_"))).cast("long").alias("n_dup_lines"),
        chars.alias("chars"),
    )

    codes = {form: _code(i) for i, w in enumerate(vocabulary()) for form in (w, w.capitalize())}
    table = F.create_map(*[F.lit(x) for pair in codes.items() for x in pair])
    hits = F.array_join(F.transform(F.filter("w", lambda x: x.isin(*codes)), lambda x: F.element_at(table, x)), "")
    window = lambda i: F.xxhash64(*[F.get(F.col("w"), i + k) for k in range(3)])
    df = df.withColumn("hits", hits).withColumn("h", F.when(F.col("n_words") >= 3, F.transform(F.sequence(F.lit(0), F.size("w") - 3), window)).otherwise(F.array().cast("array<bigint>")))
    df = df.drop("w").withColumn("sorted", F.sort_array("h"))
    df = df.withColumn("twice", F.array_distinct(F.filter("sorted", lambda x, i: x == F.get(F.col("sorted"), i - 1))))
    df = df.drop("sorted")

    few = F.filter(F.transform("h", lambda x, i: F.when(F.array_contains(F.col("twice"), x), i)), lambda i: i.isNotNull())
    df = df.withColumn("z", F.when(F.size("twice") > FEW, F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    same = lambda z, i: F.coalesce(z["h"] == F.get(F.col("z"), i)["h"], F.lit(False))
    many = F.transform(F.filter("z", lambda z, i: same(z, i - 1) | same(z, i + 1)), lambda z: z["i"])
    df = df.withColumn("at", F.when(F.size("twice") == 0, F.array().cast("array<int>")).when(F.size("twice") > FEW, many).otherwise(few))
    covered = F.array_distinct(F.concat("at", F.transform("at", lambda i: i + 1), F.transform("at", lambda i: i + 2)))
    common = F.array(*[F.length("hits") - F.length(F.replace(F.col("hits"), F.lit(_code(i)), F.lit(""))) for i in range(len(vocabulary()))])
    return df.select("doc_id", "language", "n_words", "word_chars", "n_symbols", "n_dup_lines", F.size(covered).cast("long").alias("n_repeat_words"), "chars", common.alias("common"))


def with_base(rows: DataFrame, rules: QualityRules) -> DataFrame:
    failed = (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > F.lit(100 * rules.max_repeat_share) * F.col("n_words"))
    return rows.withColumn("base_failed", failed)


def references(rows: DataFrame) -> dict[str, dict[str, list[float]]]:
    """For each language the shares of character classes, and of common words and all others, over all documents that pass the base.

    The result has a row for each of the fixed languages and one for all others, so it is small whatever the input.
    """
    good = rows.filter(~F.col("base_failed"))
    width = {"chars": len(CHAR_CLASSES) + 1, "common": len(vocabulary())}
    out: dict[str, dict[str, list[float]]] = {}
    for name in width:
        sums = good.select("language", F.posexplode(name).alias("at", "n")).groupBy("language", "at").agg(F.sum("n").alias("n"))
        for row in sums.collect():  # languages x histogram bins at most
            out.setdefault(row["language"], {k: [0.0] * v for k, v in width.items()})[name][row["at"]] = float(row["n"])
    words = {r["language"]: r["n"] for r in good.groupBy("language").agg(F.sum("n_words").alias("n")).collect()}
    for language, found in out.items():
        found["common"] = [*found["common"], max(0.0, words[language] - sum(found["common"]))]
        for name, counts in found.items():
            found[name] = [c / (sum(counts) or 1.0) for c in counts]
    return out


def _entropy_term(x: Column) -> Column:
    return F.when(x > 0, -x * F.log2(x)).otherwise(F.lit(0.0))


def distance(counts: Column, total: Column, reference: Column, reference_entropy: Column) -> Column:
    """Jensen-Shannon distance of counts / total from the reference's shares; 0 where there is nothing to compare."""
    p = F.transform(counts, lambda c: c / F.greatest(total, F.lit(1)))
    mixed = F.aggregate(F.zip_with(p, reference, lambda a, b: _entropy_term((a + b) / 2)), F.lit(0.0), lambda s, x: s + x)
    own = F.aggregate(p, F.lit(0.0), lambda s, x: s + _entropy_term(x))
    return F.sqrt(F.greatest(mixed - (own + reference_entropy) / 2, F.lit(0.0)))


def _by_language(found: dict[str, list[float]], value) -> Column:
    out = F.lit(None)
    for language, shares in found.items():
        out = F.when(F.col("language") == language, value(shares)).otherwise(out)
    return out


def judge(docs: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """One row for each document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, char_distance, word_distance.

    A document is kept unless the base fails it, or it is longer than the guards and its histogram of character classes or of
    common words is farther from its language's than the limits. References are taken over all documents given. A null text is
    empty and fails the base; a null or unknown language is compared with all such documents together. Repeated rows are judged
    each for itself. Other columns are ignored. No rows: no rows.
    """
    rows = materialise(with_base(features(docs), rules), "quality").df
    found = references(rows)
    entropy = lambda shares: -sum(x * log2(x) for x in shares if x > 0)
    literal = lambda shares: F.array(*[F.lit(float(x)) for x in shares])
    parts = {}
    for name in ("chars", "common"):
        own = {k: v[name] for k, v in found.items()}
        parts[name] = (_by_language(own, literal), _by_language(own, lambda s: F.lit(float(entropy(s)))))
    total = F.aggregate("chars", F.lit(0), lambda s, x: s + x)
    hits = F.aggregate("common", F.lit(0), lambda s, x: s + x)
    words = F.concat("common", F.array((F.col("n_words") - hits).cast("int")))
    rows = rows.withColumn("words_", words).withColumn("total_", total)
    long_enough = (F.col("n_words") >= rules.guard_words) & (F.col("total_") >= rules.guard_chars)
    if found:
        rows = rows.withColumn("char_distance", F.when(long_enough, distance(F.col("chars"), F.col("total_"), *parts["chars"])))
        rows = rows.withColumn("word_distance", F.when(long_enough, distance(F.col("words_"), F.col("n_words"), *parts["common"])))
    else:
        rows = rows.withColumn("char_distance", F.lit(None).cast("double")).withColumn("word_distance", F.lit(None).cast("double"))
    bins = _by_language({k: v["common"] for k, v in found.items()}, lambda s: F.lit(float(sum(x > rules.noise_share for x in s) - 1)))
    excess = F.col("word_distance") * F.col("word_distance") - bins / (8 * F.log(F.lit(2.0)) * F.col("n_words"))
    far = F.coalesce(F.col("char_distance") > rules.max_char_distance, F.lit(False)) | F.coalesce(excess > rules.max_word_divergence, F.lit(False))
    rows = rows.withColumn("kept", ~(F.col("base_failed") | far))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "char_distance", "word_distance")
