import math

import numpy as np
from pyspark.sql import functions as F

from fieldmark.operators import evidence, metrics

QUOTE = "Removal cut the cover of the shrub by 42 percent within two years."


def papers(spark, *rows):
    return spark.createDataFrame(rows, evidence.PAPERS)


def statements(spark, *rows):
    return spark.createDataFrame(rows, evidence.STATEMENTS)


GOOD = ("a", "10.1234/x", "A title", "Smith, J.", 2020, "Journal of Weeds")
SAID = ("p1", "a", [QUOTE], "Cover fell by 42 within 2 years", "shrub", "India", "review")


def test_papers_and_statements(spark):
    bad = [("b", "10.1234/X", "T", "X", 2010, "bioRxiv"), ("c", "doi:1", "", None, None, "J")]
    got = {(r.place, r.problem) for r in evidence.paper_problems(papers(spark, GOOD, *bad), statements(spark, SAID, ("p2", "b", [], "", "", "", ""))).collect()}
    assert got == {("b", "too old"), ("b", "a preprint"), ("b", "doi of another paper"), ("c", "missing title"), ("c", "missing authors"), ("c", "missing year"), ("c", "malformed doi"), ("c", "cited by nothing")}
    odd = [("p2", "zz", ["too short"], "It grew by 7", " ", "x", "guess"), ("p3", "a", [QUOTE, QUOTE.upper()], None, "y", None, "review"), (*("p4",), *SAID[1:])]
    got = {(r.place, r.problem) for r in evidence.statement_problems(statements(spark, SAID, *odd), papers(spark, GOOD)).collect()}
    assert got == {("p2", "quote too short"), ("p2", "figure without quote"), ("p2", "no affected"), ("p2", "unknown design"), ("p2", "unknown paper"), ("p3", "same quote twice"), ("p3", "empty summary"), ("p3", "no region"), ("p4", "entry twice")}


def test_registry_and_quotes(spark):
    records = spark.createDataFrame([("10.1234/X", "A Title1", "Journal of weeds", [2019, 2020], "journal-article", "1", "Smith", None, None), ("10.1/y", "Other", "K", [2012], "book", None, "Doe", ["Retraction"], None)], evidence.REGISTRY)
    cited = papers(spark, GOOD, ("b", "10.1/y", "Title", "Roe, R.", 2018, "J"), ("c", "10.9/none", "T", "A", 2020, "J"))
    got = {(r.place, r.problem) for r in evidence.registry_problems(cited, records).collect()}
    assert got == {("b", x) for x in ("not a journal article", "no issn", "title differs", "journal differs", "year differs", "too old on record", "first author differs", "retracted")} | {("c", "no record")}
    abstracts = spark.createDataFrame([("a", "We found that removal cut the cover of the shrub by 42 per­cent. Removal cut the cover of the  shrub by 42 percent within two years."), ("b", "Nothing.")], "paper string, text string")
    more = statements(spark, SAID, ("p2", "b", [QUOTE], "5 plots", "x 3", "y", "review"), ("p3", "c", [QUOTE], "", "", "", ""))
    got = {(r.place, r.problem) for r in evidence.quote_problems(more, abstracts).collect()}
    assert got == {("p2", "quote not found"), ("p2", "figure of summary not found"), ("p2", "figure of affected not found"), ("p3", "no abstract")}
    one = spark.sql("SELECT map('the', array(0, 2), 'sea', array(1), 'end', array(3)) AS m, 'As (Smith et al. 2020) and Roe and Doe (2019) say' AS t")
    r = one.select(evidence.abstract_from_positions(F.col("m")), evidence.cited_in(F.col("t"))).first()
    assert r[0] == "the sea the end" and r[1] == ["Smith et al. 2020", "Roe and Doe (2019"]
    assert evidence.citation(papers(spark, GOOD)).first().reference == "Smith, J. (2020) A title. Journal of Weeds. doi:10.1234/x"


def test_temperature_and_split(spark):
    rng = np.random.default_rng(1)
    z = rng.normal(size=(400, 3))
    y = [int(rng.choice(3, p=np.exp(v) / np.exp(v).sum())) for v in z]
    rows = spark.createDataFrame([((3 * v).tolist(), t) for v, t in zip(z, y)], "logits array<double>, truth int")
    loss = lambda t: float(np.mean([np.log(np.exp(3 * v / t).sum()) - 3 * v[k] / t for v, k in zip(z, y)]))
    best = metrics.fit_temperature(rows)
    assert loss(best) <= min(loss(t) for t in np.exp(np.linspace(math.log(0.05), math.log(20), 400))) + 1e-6
    sizes = spark.createDataFrame([(i % 2, i, 1 + i % 5) for i in range(40)], "label int, `group` long, n int")
    parts = metrics.group_split(sizes).join(sizes, ["label", "group"])
    share = {(r.label, r.part): r.n for r in parts.groupBy("label", "part").agg(F.sum("n").alias("n")).collect()}
    for label in (0, 1):
        total = sum(v for (k, _), v in share.items() if k == label)
        assert abs(share[label, 0] / total - 0.7) < 0.06 and sum(k == label for k, _ in share) == 3


def test_quotes_found_in_any_text(spark):
    """Against plain containment of squashed texts: long and short quotes, other spacing, typography and case."""
    import random

    rng = random.Random(5)
    text = lambda k: " ".join("".join(rng.choices("abcdefgh", k=rng.randint(1, 8))) for _ in range(k))
    texts = [text(rng.randint(0, 200)) for _ in range(60)] + [None, "", "Ünïque “quote”"]
    quotes = [texts[i][a : a + n] for i, a, n in ((0, 3, 200), (1, 0, 60), (2, 10, 46), (3, 5, 47), (4, 0, 20), (5, 9, 5))] + [text(20), None, "", 'unique "quote"']
    texts += [quotes[0].upper().replace(" ", "  \n"), "x " + quotes[3].replace(" ", "") + " y"]
    squashed = lambda s: "".join((s or "").lower().replace("ü", "u").replace("ï", "i").replace("“", '"').replace("”", '"').split())
    want = {(i, k) for i, t in enumerate(texts) for k, q in enumerate(quotes) if squashed(q) and squashed(q) in squashed(t)}
    docs, asked = (spark.createDataFrame(list(enumerate(x)), f"{n} long, text string") for x, n in ((texts, "doc"), (quotes, "quote")))
    assert {tuple(r) for r in evidence.quotes_found(docs, asked, "doc", "quote").collect()} == want


def test_whole_texts_are_not_grouped_to_find_quotes(spark):
    """Grouping by texts shuffled all of them, three times."""
    docs = spark.createDataFrame([(1, "Some text &amp; more of it"), (1, "Some text &amp; more of it"), (2, None), (3, "")], "doc long, text string")
    asked = spark.createDataFrame([("a", "text & MORE"), ("b", ""), ("c", None)], "quote string, text string")
    found = evidence.quotes_found(docs, asked, "doc", "quote")
    assert [tuple(r) for r in found.collect()] == [(1, "a")]
    groups = [x for x in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Aggregate" in x]
    assert groups and not any("t_#" in x for x in groups)
