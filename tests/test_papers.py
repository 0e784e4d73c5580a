from pyspark.sql import functions as F

from fieldmark.operators import citations, papers

BODY = (
    "# A study\n\nShrubs spread by 12 per year (Okello et al. 2019; Mora 2020). We saw 3,400 plants in Table 2 on 5 March 2021 (Silva and Ruiz 2018). Roads matter (Nobody 2001; see 4). "
    "Cover fell by 42% (Okello et al. 2019). It was posted on bioRxiv. We did not use SSRN.\n\n1. A list of 77 items {{TOKEN}} and 0.85 of all, in 1999.\n\n## References\n\nOkello 1 2 3"
)
EVIDENCE = [("ok", "Okello, P.", 2019, ["Shrubs spread by twelve per year in all plots."])]
REFERENCES = [
    (1, "mo", "Mora, J.", 2020, "method", []),
    (1, "si", "Silva, A.", 2018, "claim", ["about 3,400 plants were seen"]),
    (1, "si2", "Sílva, B.", 2018, "claim", ["others"]),
    (1, "un", "Unused, C.", 2017, "dataset", []),
]
T, E, R = "doc int, text string", "key string, authors string, year int, quotes array<string>", "doc int, key string, authors string, year int, role string, quotes array<string>"


def problems(spark, texts, evidence=EVIDENCE, references=REFERENCES, **more):
    rows = citations.text_problems(spark.createDataFrame(texts, T), spark.createDataFrame(evidence, E), spark.createDataFrame(references, R), **more).collect()
    assert len(set(rows)) == len(rows)
    return {(r.doc, r.code, r.subject) for r in rows}


def test_citations(spark):
    got = [(r.part, r.name, r.year) for r in citations.citations(spark.createDataFrame([(1, BODY)], T)).collect()]
    assert got == [("Okello et al. 2019", "Okello", 2019), ("Mora 2020", "Mora", 2020), ("Silva and Ruiz 2018", "Silva", 2018), ("Nobody 2001", "Nobody", 2001), ("see 4", None, None), ("Okello et al. 2019", "Okello", 2019)]


def test_ways_to_cite(spark):
    ways = {
        "Müller 2021": ("Müller", 2021, None), "Šimková & Žák, 1999": ("Šimková", 1999, None), "Ødegård et al., 2020b": ("Ødegård", 2020, "b"), "van der Berg 2019, p. 12": ("van der Berg", 2019, None),
        "O’Neil-Smith and de la Cruz 2018: 3–9": ("O’Neil-Smith", 2018, None), "see also Ли 2017, pp. 4-5": ("Ли", 2017, None), "d'Arcy 1876": ("d'Arcy", 1876, None), "e.g. Mora 2020": ("Mora", 2020, None),
        "n = 40": None, "Table 2": None, "in 2019": None, "Mora 20200": None, "mora 2020": None, "Mora 2020, 2021 and more": None,
    }
    rows = [(i, f"It grew (Okello 2019; {way}).") for i, way in enumerate(ways)]
    got = {r.doc: r for r in citations.citations(spark.createDataFrame(rows, T)).filter("part <> 'Okello 2019'").collect()}
    assert {way: (got[i].name, got[i].year, got[i].letter) if got[i].name else None for i, way in enumerate(ways)} == ways
    assert citations.citations(spark.createDataFrame([(1, "Nothing (n = 40; in 2019) is cited."), (2, None)], T)).collect() == []


def test_sentences(spark):
    text = "One et al. Two go on. \"Three?\" (Four!) Five e.g. this, cf. Six in approx. 5 m. Été est là.\n\na new paragraph\n \nlast"
    got = spark.createDataFrame([(1, text)], T).select(citations.sentences(F.col("text"))).first()[0]
    assert got == ["One et al. Two go on.", '"Three?"', "(Four!)", "Five e.g. this, cf. Six in approx. 5 m.", "Été est là.", "a new paragraph", "last"]


def test_text_problems(spark):
    got = problems(spark, [(1, BODY)], resources=spark.createDataFrame([(1, "Spark"), (1, "Shrubs"), (2, "other")], "doc int, mention string"))
    assert got == {
        (1, "unread", "see 4"), (1, "unknown", "Nobody 2001"), (1, "several", "Silva 2018"), (1, "uncited", "un"), (1, "uncited", "si"), (1, "uncited", "si2"), (1, "unquoted", "42"), (1, "server", "biorxiv"), (1, "unnamed", "Spark"),
    }


def test_a_work_cited_twice_is_one_work(spark):
    text = "Shrubs spread (Mora 2020) and spread (Mora 2020; Okello 2019; Okello et al. 2019), by 12. Again (Mora 2020)."
    assert problems(spark, [(1, text)], references=REFERENCES[:1]) == set()


def test_each_paper_has_its_own_references(spark):
    references = [(1, "a", "Müller, A.", 2021, "claim", ["cover of 5 plots"]), (2, "a", "Müller, B.", 2021, "claim", ["cover of 6 plots"])]
    texts = [(1, "Cover was 5 (Müller 2021, p. 7)."), (2, "Cover was 5 (Muller 2021)."), (3, "Cover was 5 (Müller 2021)."), (4, None)]
    assert problems(spark, texts, references=references) == {(2, "unquoted", "5"), (3, "unknown", "Müller 2021")}


def test_texts_are_read_once(spark):
    df = citations.text_problems(spark.createDataFrame([(1, BODY)], T), spark.createDataFrame(EVIDENCE, E), spark.createDataFrame(REFERENCES, R))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("posexplode") == 1


def test_papers_that_share_an_id_or_have_none(spark):
    texts = [(1, "We saw 5 (Mora 2020). On bioRxiv."), (1, "We saw 7. On bioRxiv."), (None, "We saw 7 (Okello 2019; Mora 2020).")]
    references = [(1, "mo", "Mora, J.", 2020, "claim", ["we saw 5"]), (1, "un", "Un, U.", 2020, "claim", []), (1, "un", "Un, V.", 2021, "claim", None), (None, "mo", "Mora, J.", 2020, "claim", [])]
    rows = citations.text_problems(spark.createDataFrame(texts, T), spark.createDataFrame(EVIDENCE, E), spark.createDataFrame(references, R)).collect()
    assert sorted((r.doc or 0, r.code, r.subject) for r in rows) == [
        (0, "uncited", "mo"), (0, "unknown", "Mora 2020"), (1, "server", "biorxiv"), (1, "server", "biorxiv"), (1, "uncited", "un"), (1, "uncited", "un"), (1, "unquoted", "7"),
    ]


def test_letters_tell_works_of_one_year_apart(spark):
    references = [(1, "k1", "Mora, J.", 2020, "claim", ["we saw 5"]), (1, "k2", "Mora, J.", 2020, "claim", ["we saw 6"])]
    assert problems(spark, [(1, "We saw 5 (Mora 2020a). We saw 6 (Mora 2020b).")], references=references) == set()
    assert problems(spark, [(1, "We saw 6 (Mora 2020a; Mora 2020c).")], references=references) == {(1, "unquoted", "6"), (1, "unknown", "Mora 2020c"), (1, "uncited", "k2")}


def test_names_with_digits_are_given(spark):
    texts = [(1, "We used Net-14 and BERT2 on 12 plots (Okello 2019).")]
    assert problems(spark, texts, references=[]) == {(1, "unquoted", "14, 2")}
    assert problems(spark, texts, references=[], names=("Net-14", "BERT2")) == set()


def test_numbers(spark):
    typed = citations.typed_numbers(spark.createDataFrame([(1, BODY)], T))
    assert {r.literal for r in typed.collect()} == {"12", "3,400", "42%", "77", "0.85"}
    registry = spark.createDataFrame([("12", [12.2]), ("3,400", [3399.6, 1.0]), ("42%", [0.4237]), ("77", [5.0]), ("6", [6.0])], "literal string, values array<double>")
    got = {(r.literal, r.problem) for r in papers.number_problems(typed, registry).collect()}
    assert got == {("0.85", "no recorded origin"), ("77", "not a value of its origin"), ("6", "registered but not typed")}


def test_references(spark):
    schema = "key string, doi string, title string, authors string, year int, journal string, role string, quotes array<string>"
    quote = "The cover of the shrub fell by half within two years."
    rows = [("a", "10.1234/a", "T", "Zed, A.", 2020, "J", "claim", [quote]), ("b", "10.1234/A", "T", "Abel, B.", 2010, "J", "claim", []), ("c", "10.1101/x", "T", "Émile, C.", 2019, "bioRxiv", "method", [quote]), ("d", None, "T", "D", None, "J", "odd", None)]
    df = spark.createDataFrame(rows, schema)
    got = {(r.place, r.problem) for r in papers.reference_problems(df, spark.createDataFrame([("10.1101/X",)], "doi string")).collect()}
    assert got == {("b", "claim too old"), ("b", "claim without quote"), ("b", "doi of another article"), ("c", "a preprint"), ("c", "quotes of no claim"), ("c", "in the evidence base"), ("d", "missing doi"), ("d", "missing year"), ("d", "unknown role")}
    abstracts = spark.createDataFrame([("a", "x"), ("a", "We found: the cover  of the shrub fell by half within two years.")], "key string, text string")
    assert {(r.place, r.problem) for r in papers.reference_quote_problems(df, abstracts).collect()} == {("b", "no abstract")}
    assert papers.reference_list(df.filter("key < 'd'")).first().references.split("\n\n") == ["Abel, B. (2010) T. J. https://doi.org/10.1234/A", "Émile, C. (2019) T. bioRxiv. https://doi.org/10.1101/x", "Zed, A. (2020) T. J. https://doi.org/10.1234/a"]


def test_figures(spark):
    one = spark.range(1).select(papers.count_text(F.lit(1234567)), papers.percent_text(F.lit(1), F.lit(3)), papers.percent_text(F.lit(1), F.lit(0)), papers.p_text(F.lit(0.0002)), papers.p_text(F.lit(0.0421)), *[papers.listing(F.array(*[F.lit(x) for x in xs]).cast("array<string>")) for xs in ([], ["a"], ["a", "b"], ["a", "b", "c"])]).first()
    assert tuple(one) == ("1,234,567", "33.3%", "-", "p < 0.001", "p = 0.042", "", "a", "a and b", "a, b and c")
