"""Queries of papers' texts: documents with a sentence that cites, the names of nations as authors."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldmark.functions.text import NUMBER_WORDS
from fieldmark.operators import citations, evidence, maintenance
from fieldmark.plans.catalogue import World, query
from fieldmark.sources.testdata import prelude

NAMES = ("BERT-2",)
AUTHOR = "CASE WHEN n_nationkey IS NULL THEN 'Nobody' WHEN n_nationkey % 5 = 0 THEN concat('Élan', chr(97 + n_nationkey)) ELSE concat('Nat', chr(97 + n_nationkey % 23), 'or') END"
#: A sentence that states two numbers and cites one to three works, some of them unknown, shared or unreadable.
CITING = f"""concat(text, '\\n\\nBERT-2 found that it reached ', doc_id % 25, ' plots and 7 trees in Table 2 (', {AUTHOR}, CASE WHEN doc_id % 2 = 0 THEN ' et al.' ELSE ',' END, ' ', 1990 + doc_id % 30,
    CASE doc_id % 7 WHEN 0 THEN 'a' WHEN 1 THEN ', p. 12' ELSE '' END, CASE doc_id % 4 WHEN 0 THEN '; see 4' WHEN 1 THEN '; Muñoz & Lee 2001' ELSE '' END, ').', CASE WHEN doc_id % 11 = 0 THEN ' It is on bioRxiv.' ELSE '' END)"""
EVIDENCE = f"SELECT n_name AS key, concat({AUTHOR}, ', A.') AS authors, CAST(1990 + n_nationkey AS INT) AS year, concat('We counted ', n_nationkey, ' plots, and seven trees.') AS quote FROM nation WHERE n_nationkey % 3 <> 1 AND n_nationkey % 25 < 20"
REFERENCES = f"""SELECT doc_id AS doc, 'own' AS key, concat({AUTHOR}, ', B.') AS authors, CAST(1990 + n_nationkey AS INT) AS year, CASE WHEN doc_id % 2 = 0 THEN 'claim' ELSE 'method' END AS role, 'About 1,200 plots and 7 trees' AS quote FROM documents JOIN nation ON n_nationkey = doc_id % 30 WHERE n_nationkey % 3 = 1 OR n_nationkey % 8 = 0
    UNION ALL SELECT doc_id, 'two', 'Munoz, C.', 2001, 'claim', '' FROM documents WHERE doc_id % 3 = 0"""


def problems(w: World):
    tables = {n: w.raw(n) for n in ("documents", "nation")}
    texts = w.spark.sql(f"SELECT doc_id AS doc, {CITING} AS text FROM {{documents}} LEFT JOIN {{nation}} ON n_nationkey = doc_id % 30".replace("\\n", "\n"), **tables)
    filled = lambda sql: w.spark.sql(sql.replace("FROM documents", "FROM {documents}").replace("JOIN nation", "JOIN {nation}").replace("FROM nation", "FROM {nation}"), **{k: v for k, v in tables.items() if k in sql})
    quoted = lambda df: df.withColumn("quotes", F.array("quote")).drop("quote")
    rows = citations.text_problems(texts, quoted(filled(EVIDENCE)), quoted(filled(REFERENCES)), names=NAMES)
    return rows.withColumn("at", F.col("at").cast("long"))


def quoted(pattern: str) -> str:
    """A pattern as a string of SQL."""
    return "'" + pattern.replace("'", "''") + "'"


def folded_sql(name: str) -> str:
    return f"regexp_replace(lower(strip_accents({name})), '[^a-z0-9]', '', 'g')"


def numbers_sql(text: str) -> str:
    return rf"list_distinct(list_transform(regexp_extract_all(regexp_replace({text}, '(\d),(\d{{3}})', '\1\2', 'g'), '\d+(?:\.\d+)?'), lambda n: CASE WHEN contains(n, '.') THEN regexp_replace(n, '\.?0+$', '') ELSE n END))"


def stated_pattern() -> str:
    month = citations.any_of(citations.MONTHS)
    labels = r"\b(?:Tables?|Figures?|Figs?\.?|Sections?|Appendix|Equations?) \d+(?:\.\d+)*[a-z]?\b"
    return "|".join([rf"\((?:[^()]*; ?)?{citations.WORK}(?:;[^()]*)?\)", labels, rf"\b(?:\d{{1,2}} )?{month} \d{{4}}\b", r"\b\d{4}-\d\d-\d\d\b", citations.any_of(NAMES)])


WHOLE, WORDS = quoted(f"^{citations.WORK}$"), "[" + ", ".join(f"'{x}'" for x in NUMBER_WORDS) + "]"
PROBLEMS = rf"""WITH t AS (SELECT doc_id AS doc, {CITING.replace(chr(92) + "n" + chr(92) + "n", "' || chr(10) || chr(10) || '")} AS text FROM documents LEFT JOIN nation ON n_nationkey = doc_id % 30),
    s AS (SELECT doc, list_filter(list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(text, {quoted(chr(92) + "b(" + citations.any_of(citations.ABBREVIATIONS) + ")" + chr(92) + ".")}, '\1' || chr(2), 'g'), '\n\s*\n', chr(1), 'g'), {quoted(citations.ENDS)}, '\1' || chr(1) || '\2', 'g'), chr(1)), lambda q: trim(replace(q, chr(2), '.'))), lambda q: q <> '') AS s FROM t),
    l AS (SELECT doc, unnest(range(len(s))) AS pos, unnest(s) AS sentence FROM s),
    g AS (SELECT doc, pos, list_transform(string_split(unnest(regexp_extract_all(sentence, '\(([^()]*)\)', 1)), ';'), lambda p: trim(p)) AS parts FROM l),
    f AS (SELECT doc, pos, unnest(parts) AS part FROM g WHERE len(list_filter(parts, lambda p: regexp_matches(p, {WHOLE}))) > 0),
    r AS (SELECT doc, pos, regexp_extract(part, {WHOLE}, 1) AS name, CAST(regexp_extract(part, {WHOLE}, 2) AS INT) AS year, regexp_extract(part, {WHOLE}, 3) AS letter FROM f WHERE regexp_matches(part, {WHOLE})),
    e AS (SELECT *, {folded_sql("split_part(authors, ',', 1)")} AS surname FROM ({EVIDENCE}) x), o AS (SELECT *, {folded_sql("split_part(authors, ',', 1)")} AS surname FROM ({REFERENCES}) x),
    ev AS (SELECT *, chr(CAST(96 + row_number() OVER (PARTITION BY surname, year ORDER BY key) AS INT)) AS own FROM e), re AS (SELECT *, chr(CAST(96 + row_number() OVER (PARTITION BY doc, surname, year ORDER BY key) AS INT)) AS own FROM o),
    asked AS (SELECT DISTINCT doc, name, year, letter FROM r),
    w AS (SELECT a.*, 'evidence' AS kind, key, true AS graded, quote FROM asked a JOIN ev ON ev.surname = {folded_sql("a.name")} AND ev.year = a.year AND a.letter IN ('', own)
        UNION ALL SELECT a.*, 'reference', key, role = 'claim', quote FROM asked a JOIN re ON re.doc = a.doc AND re.surname = {folded_sql("a.name")} AND re.year = a.year AND a.letter IN ('', own)),
    j AS (SELECT a.doc, a.name, a.year, a.letter, count(DISTINCT kind || ' ' || key) AS n FROM asked a LEFT JOIN w ON w.doc = a.doc AND w.name = a.name AND w.year = a.year AND w.letter = a.letter GROUP BY ALL),
    sure AS (SELECT w.* FROM w SEMI JOIN (SELECT * FROM j WHERE n = 1) k ON k.doc = w.doc AND k.name = w.name AND k.year = w.year AND k.letter = w.letter),
    pool AS (SELECT r.doc, r.pos, string_agg(quote, ' ') AS quotes FROM (SELECT DISTINCT * FROM r) r JOIN sure ON sure.doc = r.doc AND sure.name = r.name AND sure.year = r.year AND sure.letter = r.letter AND graded GROUP BY 1, 2),
    miss AS (SELECT doc, pos, list_sort(list_filter({numbers_sql("regexp_replace(sentence, " + quoted(stated_pattern()) + ", ' ', 'g')")}, lambda n: NOT list_contains(list_concat({numbers_sql("quotes")}, list_transform(list_filter(string_split_regex(lower(quotes), '[^a-z]+'), lambda x: list_contains({WORDS}, x)), lambda x: CAST(list_position({WORDS}, x) AS VARCHAR))), n))) AS missing FROM pool JOIN l USING (doc, pos)),
    serve AS (SELECT doc, pos, regexp_extract(lower(sentence), {quoted(chr(92) + "b(" + citations.any_of(citations.SERVERS) + ")" + chr(92) + "b")}, 1) AS subject FROM l WHERE NOT contains(sentence, 'did not use'))
    SELECT DISTINCT doc, pos AS "at", 'unread' AS code, part AS subject FROM f WHERE NOT regexp_matches(part, {WHOLE})
    UNION ALL SELECT doc, NULL, CASE n WHEN 0 THEN 'unknown' ELSE 'several' END, name || ' ' || year || letter FROM j WHERE n <> 1
    UNION ALL SELECT doc, NULL, 'uncited', key FROM o WHERE NOT EXISTS (SELECT 1 FROM sure WHERE sure.doc = o.doc AND kind = 'reference' AND sure.key = o.key)
    UNION ALL SELECT doc, pos, 'unquoted', array_to_string(missing, ', ') FROM miss WHERE len(missing) > 0 UNION ALL SELECT doc, pos, 'server', subject FROM serve WHERE subject <> ''"""
query("text_problems", PROBLEMS)(problems)
# Citations and two indexes of them, made of documents: each rule is broken by some.
CITED = "SELECT doc_id AS paper, concat('10.1234/', doc_id) AS doi, concat('A study of plot ', doc_id) AS title, concat('Author', doc_id % 5, ', A.') AS authors, CAST(2012 + doc_id % 12 AS INT) AS year, concat('Journal ', doc_id % 4) AS journal FROM documents"
FIRST = """SELECT concat('10.1234/', doc_id) AS doi, CASE doc_id % 13 WHEN 0 THEN 'Quite another matter' WHEN 1 THEN NULL ELSE concat('A study of plot ', doc_id) END AS title, CASE doc_id % 11 WHEN 0 THEN 'bioRxiv' WHEN 1 THEN NULL WHEN 2 THEN 'Letters' ELSE concat('Journal ', doc_id % 4) END AS journal,
    CAST(2012 + doc_id % 12 + CASE doc_id % 17 WHEN 0 THEN 1 ELSE 0 END AS INT) AS printed, CASE doc_id % 6 WHEN 0 THEN 'book-chapter' WHEN 1 THEN NULL ELSE 'journal-article' END AS kind, CASE doc_id % 19 WHEN 0 THEN 'preprint' ELSE '' END AS subtype, CASE doc_id % 23 WHEN 0 THEN NULL ELSE '1234-5678' END AS issn,
    CASE doc_id % 7 WHEN 0 THEN 'Somebody' WHEN 1 THEN NULL ELSE concat('Author', doc_id % 5) END AS first_author, CASE doc_id % 29 WHEN 0 THEN 'Retraction' ELSE 'correction' END AS notice FROM documents WHERE doc_id % 10 <> 3"""
SECOND = """SELECT concat('10.1234/', doc_id) AS asked, CASE doc_id % 9 WHEN 0 THEN concat('https://doi.org/10.1234/', doc_id + 1) WHEN 1 THEN NULL ELSE concat('https://doi.org/10.1234/', doc_id) END AS doi, CASE doc_id % 14 WHEN 0 THEN 'Some other work' ELSE concat('A study of plot ', doc_id) END AS title,
    CAST(CASE doc_id % 15 WHEN 0 THEN 1990 WHEN 1 THEN NULL ELSE 2013 + doc_id % 12 END AS INT) AS year, CASE doc_id % 16 WHEN 0 THEN 'preprint' ELSE 'article' END AS kind, CASE doc_id % 18 WHEN 0 THEN 'repository' WHEN 1 THEN NULL ELSE 'journal' END AS venue_kind, doc_id % 31 = 0 AS retracted FROM documents WHERE doc_id % 10 <> 7"""
ALNUM = lambda c: f"regexp_replace(lower(coalesce({c}, '')), '[^a-z0-9]', '', 'g')"
BROKEN = {
    ("first", "absent"): "f.doi IS NULL", ("first", "kind"): "f.doi IS NOT NULL AND coalesce(f.kind, '') <> 'journal-article'", ("first", "subtype"): "f.subtype <> ''", ("first", "no issn"): "f.doi IS NOT NULL AND (f.journal IS NULL OR f.issn IS NULL)",
    ("first", "blocked venue"): "f.journal = 'Letters'", ("first", "preprint"): "f.journal = 'bioRxiv'", ("first", "no authors"): "f.doi IS NOT NULL AND f.first_author IS NULL", ("first", "title"): f"f.doi IS NOT NULL AND {ALNUM('f.title')} <> {ALNUM('p.title')}",
    ("first", "journal"): f"f.journal IS NOT NULL AND {ALNUM('f.journal')} <> {ALNUM('p.journal')}", ("first", "year"): "f.printed <> p.year", ("first", "too old"): "f.printed < 2016", ("first", "author"): "f.first_author IS NOT NULL AND NOT contains(lower(p.authors), lower(f.first_author))",
    ("first", "notice"): "lower(f.notice) IN ('retraction', 'withdrawal', 'removal')", ("second", "absent"): "f.doi IS NOT NULL AND s.asked IS NULL", ("second", "retracted"): "f.doi IS NOT NULL AND s.retracted", ("second", "venue"): "f.kind = 'journal-article' AND s.venue_kind <> 'journal'",
    ("second", "not reviewed"): "f.kind = 'journal-article' AND s.kind = 'preprint'", ("second", "doi"): "f.doi IS NOT NULL AND s.doi <> 'https://doi.org/' || p.doi", ("both", "title"): f"f.title IS NOT NULL AND s.title IS NOT NULL AND {ALNUM('f.title')} <> {ALNUM('s.title')}", ("both", "year"): "abs(f.printed - s.year) > 1",
}
VIOLATIONS = f"WITH p AS ({CITED}), f AS ({FIRST}), s AS ({SECOND}), j AS (SELECT p.paper, " + ", ".join(f"{c} AS c{k}" for k, c in enumerate(BROKEN.values())) + " FROM p LEFT JOIN f ON f.doi = p.doi LEFT JOIN s ON s.asked = p.doi) "
VIOLATIONS += " UNION ALL ".join(f"SELECT paper, '{i}' AS index, '{v}' AS violation FROM j WHERE c{k}" for k, (i, v) in enumerate(BROKEN))


def violations(w: World):
    made = lambda sql: w.spark.sql(sql.replace("FROM documents", "FROM {documents}"), documents=w.raw("documents"))
    first = made(FIRST).withColumns({"years": F.array("printed"), "notices": F.array("notice")}).drop("printed", "notice")
    return evidence.index_violations(made(CITED), first, made(SECOND), blocked=("Letters",))


query("index_violations", VIOLATIONS)(violations)
ZONES_IN = "SELECT CASE WHEN id % 3 = 0 THEN concat(slug, '_new') ELSE slug END AS slug, concat('seen ', name) AS name, country, CAST(seq AS BIGINT) AS seq FROM (SELECT *, id * 10 AS seq FROM zones WHERE id % 2 = 0 UNION ALL SELECT *, id * 10 + 5 AS seq FROM zones WHERE id % 4 = 0) x"
query("seeded_zones", f"""{prelude("zones")}, i AS (SELECT * FROM ({ZONES_IN}) y QUALIFY row_number() OVER (PARTITION BY slug ORDER BY seq DESC) = 1), n AS (SELECT slug, (SELECT max(id) FROM zones) + row_number() OVER (ORDER BY slug) AS number FROM i WHERE slug NOT IN (SELECT slug FROM zones))
    SELECT CAST(coalesce(z.id, number) AS BIGINT) AS id, coalesce(z.slug, i.slug) AS slug, coalesce(i.name, z.name) AS name, coalesce(i.country, z.country) AS country FROM zones z FULL JOIN i ON i.slug = z.slug LEFT JOIN n ON n.slug = i.slug""")(
    lambda w: maintenance.seeded(w.zones.select(F.col("id").cast("long").alias("id"), "slug", "name", "country"), w.spark.sql(ZONES_IN.replace("FROM zones", "FROM {zones}"), zones=w.zones))
)
