from fieldmark.llm.decontaminate import TemplateRules, find_leaks

DOCS, ITEMS = "doc_id long, text string, item_id int, n_windows int", "item_id long, text string, doc_id string"

QUESTION = "Yesterday evening Maria bought 12 apples and 3 pears for 4.50 dollars at the old market, then gave Maria half of the 12 apples to her neighbour, who lives 7 km away."
OTHER = "Yesterday evening Jonas bought 20 apples and 9 pears for 8.75 dollars at the old market, then gave Jonas half of the 20 apples to her neighbour, who lives 11 miles away."
BROKEN = "Yesterday evening Jonas bought 20 apples and 9 pears for 8.75 dollars at the old market, then gave Peter half of the 31 apples to her neighbour, who lives 11 miles away."
PASSAGE = "the slow river carries grey sand past seven villages before it meets the northern sea near an abandoned lighthouse where nobody has lived since the storm"


def leaks(spark, docs, items, **rules):
    df = find_leaks(spark.createDataFrame([(i, t, 0, 0) for i, t in docs], DOCS), spark.createDataFrame([(i, t, "x") for i, t in items], ITEMS), TemplateRules(**rules))
    return {(r.doc_id, r.item_id): r for r in df.collect()}


def test_exact_and_reparameterised(spark):
    filler = "some quite different words stand here and there without any meaning at all "
    docs = [
        (1, filler * 3 + QUESTION + " " + filler),
        (2, filler + OTHER),
        (3, filler + BROKEN),
        (4, filler * 9),
        (5, filler + PASSAGE.upper() + "!!! " + filler),
        (6, " ".join(PASSAGE.split()[:14]) + " " + filler),
        (7, "%% ".join(filler.split()) + "%%% " + PASSAGE + "%%% next*** words"),
        (8, None),
        (9, ""),
        (1, filler),
        (None, PASSAGE),
    ]
    items = [(10, QUESTION), (11, PASSAGE), (12, None), (13, ""), (None, PASSAGE), (14, "%%%"), (11, PASSAGE)]
    got = leaks(spark, docs, items)
    assert set(got) == {(1, 10), (2, 10), (5, 11), (7, 11), (None, 11)}
    assert got[1, 10].n_changed == 0 and got[1, 10].containment > 0.9
    assert got[2, 10].n_changed >= 5


def test_rows_of_one_id_are_not_put_together(spark):
    words = PASSAGE.split()
    first, second = " ".join(words[:15]), " ".join(words[11:])
    for ids in ((5, 5), (5, 6), (None, None)):
        assert leaks(spark, [(ids[0], first), (ids[1], second)], [(1, PASSAGE)]) == {}
    df = spark.createDataFrame([(5, PASSAGE, 0, 0), (5, PASSAGE + " again", 0, 0), (5, PASSAGE, 0, 0), (5, first, 0, 0)], DOCS)
    assert find_leaks(df, spark.createDataFrame([(1, PASSAGE, "x")], ITEMS)).count() == 2  # one for each text


def test_names_at_the_start_and_full_names(spark):
    item = "Maria Lopez has three red boxes with seven coins inside, so how many coins does Maria Lopez have if Peter takes one box away?"
    other = "the list: Ingrid Berg has three red boxes with seven coins inside, so how many coins does Ingrid Berg have if Karl takes one box away? more"
    got = leaks(spark, [(1, other), (2, other.replace("does Ingrid Berg", "does Karl Berg"))], [(1, item)])
    assert set(got) == {(1, 1)} and got[1, 1].n_changed == 2  # a full name is one slot


ITEM = "At the fair of the village Maria Lopez sold 25 baskets of ripe plums before noon, and later Maria Lopez gave another 7 baskets to the baker who lives beside the old stone bridge"
TABLE = [
    ("other names and numbers", ITEM.replace("Maria Lopez", "Ingrid Berg").replace("25", "31"), True),
    ("lower case", ITEM.lower(), True),
    ("upper case", ITEM.upper(), True),
    ("one word for two", ITEM.replace("Maria Lopez", "Ingrid"), True),
    ("three words for two", ITEM.replace("Maria Lopez", "Anna Ingrid Berg"), True),
    ("number words", ITEM.replace("25", "thirty").replace("7", "nine"), True),
    ("numbers of two words", ITEM.replace("25", "thirty-one"), True),
    ("two names for one", ITEM.replace("Maria Lopez", "Ingrid Berg", 1).replace("Maria Lopez", "Karl Holm"), False),
    ("two names for one, with a word inserted", ITEM.replace("Maria Lopez", "Ingrid Berg", 1).replace("Maria Lopez", "Karl Holm").replace("before noon", "long before noon"), False),
    ("one name of two, so 0.8 of the windows word for word", ITEM.replace("Maria Lopez", "Ingrid Berg", 1), True),
    ("a word inserted", ITEM.replace("Maria Lopez", "Ingrid Berg").replace("before noon", "long before noon"), True),
    ("twice with other values", ITEM.replace("Maria Lopez", "Ingrid Berg") + ". " + ITEM.replace("Maria Lopez", "Karl"), True),
]


def test_case_lengths_and_alignments(spark, tmp_path):
    """The operator and its SQL, from the table of what counts as the same item."""
    import duckdb

    import __spark_entry__ as entry

    docs = [(i, f"they wrote there {t} and so on") for i, (_, t, _) in enumerate(TABLE)]
    spark.createDataFrame([(i, t, "en", "x", 0) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    df = entry.queries()["op4_decontamination"](spark, str(tmp_path))
    rows = {tuple(r) for r in df.collect()}
    got = {r[df.columns.index("doc_id")] for r in rows}
    assert {name: i in got for i, (name, _, _) in enumerate(TABLE)} == {name: found for name, _, found in TABLE}
    with duckdb.connect() as con:
        for t in ("documents", "benchmark"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
        plain = con.execute(f"SELECT {', '.join(df.columns)} FROM ({entry.oracle_sql()['op4_decontamination']}) y").fetchall()
    assert {tuple(r) for r in plain} == rows


def test_windows_that_many_items_share(spark):
    """Items of one template meet a document by their rare windows alone, and all that it holds are found."""
    items = [(i, f"what is the whole sum of all the numbers that stand in list {chr(97 + i % 26)}{chr(97 + i // 26)}q for today's {'lesson exam quiz test'.split()[i % 4]}") for i in range(60)]
    docs = [(d, f"filler words {items[d][1]} and more of them") for d in range(40)]
    plain = {(d, i) for d, t in docs for i, x in items if sum(" ".join(w) in t for w in zip(*[x.split()[k:] for k in range(5)])) >= 0.8 * (len(x.split()) - 4)}
    assert {(d, d) for d in range(40)} <= plain and set(leaks(spark, docs, items)) == plain


def test_share_against_all_windows(spark):
    import random

    rng = random.Random(3)
    vocabulary = [f"v{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(80)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(3, 30)))) for i in range(25)]
    docs = []
    for d in range(60):
        words = rng.choices(vocabulary, k=30)
        item = rng.choice(items)[1].split()
        for _ in range(rng.randint(0, 2)):
            item[rng.randrange(len(item))] = rng.choice(vocabulary)
        docs.append((d, " ".join([*words, *item, *words[:5]])))
    width = 5
    windows = lambda w: {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))}

    want = set()
    for d, t in docs:
        own = t.split()
        for i, x in items:
            w = windows(x.split())
            n = len(x.split())
            seen = windows(own) if n >= width else set()  # shorter items are looked up as whole texts
            if len(w & seen) >= 0.8 * len(w):
                want.add((d, i))
    assert set(leaks(spark, docs, items)) == want


def test_short_items_inside_documents(spark, tmp_path):
    import __spark_entry__ as entry

    docs = [(1, "they asked: Who wrote Hamlet? and went home again"), (2, "who wrote Hamlet"), (3, "who wrote letters and read hamlet"), (4, "上面 这是一个问题 下面 还有 很多 别的 话"), (5, PASSAGE + " who wrote Hamlet"), (6, None), (7, "there are 7 km to go now")]
    items = [(10, "Who wrote Hamlet?"), (11, "这是一个问题"), (12, PASSAGE), (13, "are 5 km to")]
    spark.createDataFrame([(i, t, "en", "x", 0) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {(r.doc_id, r.item_id): r.n_changed for r in entry.queries()["op4_decontamination"](spark, str(tmp_path)).collect()}
    assert got == {(1, 10): 0, (2, 10): 0, (4, 11): 0, (5, 10): 0, (5, 12): 0, (7, 13): 1}


def test_empty(spark):
    assert leaks(spark, [], [(1, PASSAGE)]) == {} and leaks(spark, [(1, PASSAGE)], []) == {}


def test_windows_are_hashed_as_rows(spark, monkeypatch):
    """No function over arrays hashes windows: these are interpreted, and took a third of the whole time."""
    from fieldmark.llm import decontaminate

    plans, written = {}, decontaminate.materialise
    monkeypatch.setattr(decontaminate, "materialise", lambda df, tag: plans.update({tag: df._jdf.queryExecution().executedPlan().toString()}) or written(df, tag))
    assert set(leaks(spark, [(1, PASSAGE)], [(1, PASSAGE), (2, "Who wrote Hamlet?")], inside=True)) == {(1, 1)}
    for tag in ("windows", "found"):
        assert "xxhash64(0" in plans[tag] and "lambdafunction(xxhash64" not in plans[tag]


def test_words_by_plain_patterns(spark):
    """The words are those of the SQL's patterns, one after the other, for texts of odd pieces."""
    import random

    from pyspark.sql import functions as F

    from fieldmark.llm import decontaminate as d

    pieces = "Maria Lopez the The THE tHe One one seven Twenty-one hundred o 7 12 1,000 3.14 1/2 . , : / - ' -- km KM minutes s İn K ΑΣ Σα 'Ββ Été é ́ Au \x01 \x02 \x04 \x05   𝐀 𝐀Bc 😀Karl 𐐀 ٣ 七 这是 x7 7x abc7Maria 7Maria McDonald O'Neil Für ſo ǅa 7km8km 5-km $ \\".split(" ")
    rng = random.Random(5)
    texts = ["".join(rng.choice(pieces) + rng.choice([" ", " ", "", "  ", "\n"]) for _ in range(rng.randint(0, 14))) for _ in range(4000)]
    letters, numbers = r"\p{L}\p{M}", d.joined(d.NUMBER_WORDS)
    steps = [
        (rf"(^|[^{letters}])(\p{{Lu}}\p{{Ll}}[{letters}]*)", "$1\x01$2\x04"),
        (rf"\x01({d.joined(d.COMMON | set(d.NUMBER_WORDS))})\x04", "$1"),
        (r"\x04[ '-]\x01", "\x04"),
        (r"\d+", "\x02$0\x04"),
        (rf"(\x02\d+\x04[ -]{{0,2}})({d.joined(d.UNITS)})([^{letters}]|$)", "$1 \x03$2$3"),
        (rf"[^{letters}\p{{Nd}}\x01-\x05]+", "  "),
        (rf"(^| )({numbers})( |$)", "$1\x02$2\x05$3"),
        (r"\x05  \x02([a-z])", "\x05$1"),
    ]
    bare = F.regexp_replace(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x01-\x05]", " "), r"(\d)[.,:/](?=\d)", "$1")
    t = bare
    for i, (pattern, by) in enumerate(steps):
        t = F.regexp_replace(F.lower(t) if i == 1 else t, pattern, by)
    want = [F.array_remove(F.split(t, " +"), ""), F.array_remove(F.split(F.lower(bare), rf"[^{letters}\p{{Nd}}]+"), "")]
    df = spark.createDataFrame([(t,) for t in [*texts, "", None]], "text string").withColumn("bare", d.without_signs(F.col("text")))
    rows = df.select("text", d.marked(F.col("bare")), d.plain(F.col("bare")), *want).collect()
    assert len(rows) == 4002 and [r[0] for r in rows if r[1:3] != r[3:5]] == []
