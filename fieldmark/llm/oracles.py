"""SQL of the corpus queries that it can express, for DuckDB."""

from __future__ import annotations

from fieldmark.llm.decontaminate import COMMON, NUMBER_WORDS, UNITS, TemplateRules, joined
from fieldmark.llm.licenses import PHRASES, TEMPLATES, BlockRules, Template, words_of
from fieldmark.llm.quality import CHAR_CLASSES, COMMON_WORDS, QualityRules, vocabulary


def _list(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def quality_sql(rules: QualityRules = QualityRules()) -> str:
    """Base counts, histograms by language and the verdict, over exploded words."""
    steps = ["t AS s0"]
    for i, kind in enumerate(CHAR_CLASSES):
        steps.append(f"regexp_replace(s{i}, '{kind.replace(chr(39), chr(39) * 2)}', '', 'g') AS s{i + 1}")
    n = len(CHAR_CLASSES)
    classes = ", ".join(f"length(s{i}) - length(s{i + 1})" for i in range(n)) + f", length(s{n})"
    words = vocabulary()
    forms = ", ".join(f"('{w}', {i}), ('{w.capitalize()}', {i})" for i, w in enumerate(words))
    h = lambda x: f"CASE WHEN {x} > 0 THEN -({x}) * log2({x}) ELSE 0 END"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, CASE WHEN lang IN ({_list(COMMON_WORDS)}) THEN lang ELSE 'other' END AS language, coalesce(text, '') AS t FROM documents),
c AS (SELECT *, {", ".join(steps)} FROM d),
k AS (SELECT r, doc_id, language, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w, [{classes}] AS chars,
        length(s0) - length(s1) + length(s2) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM c),
b AS (SELECT *, len(w) AS n_words, len(lines) - len(list_distinct(lines)) AS n_dup_lines, list_sum(chars) AS total FROM k),
win AS (SELECT r, i, [w[i], w[i + 1], w[i + 2]] AS x FROM (SELECT r, w, unnest(range(1, n_words - 1)) AS i FROM b WHERE n_words >= 3) y),
rep AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS j FROM (SELECT *, count(*) OVER (PARTITION BY r, x) AS m FROM win) y WHERE m > 1) z GROUP BY 1),
base AS (SELECT b.*, coalesce(rep.n, 0) AS n_repeat_words, n_words < {rules.min_words} OR 100 * coalesce(rep.n, 0) > {100 * rules.max_repeat_share} * n_words AS base_failed FROM b LEFT JOIN rep ON rep.r = b.r),
forms(form, pos) AS (VALUES {forms}),
hits AS (SELECT r, pos, count(*) AS n FROM (SELECT r, unnest(w) AS form FROM base) y JOIN forms USING (form) GROUP BY 1, 2),
words AS (SELECT r, 0 AS kind, pos, n FROM hits UNION ALL SELECT b.r, 0, {len(words)}, b.n_words - coalesce((SELECT sum(n) FROM hits WHERE hits.r = b.r), 0) FROM base b
    UNION ALL SELECT r, 1, unnest(range({n + 1})), unnest(chars) FROM base),
ref AS (SELECT language, kind, pos, sum(n) / CAST(sum(sum(n)) OVER (PARTITION BY language, kind) AS DOUBLE) AS q FROM words JOIN base USING (r) WHERE NOT base_failed GROUP BY 1, 2, 3),
refs AS (SELECT language, kind, sum({h("q")}) AS hq, count(*) FILTER (WHERE q > {rules.noise_share}) - 1 AS bins FROM ref GROUP BY 1, 2),
own AS (SELECT b.r, b.language, w.kind, w.pos, w.n / CAST(greatest(CASE w.kind WHEN 0 THEN b.n_words ELSE b.total END, 1) AS DOUBLE) AS p FROM words w JOIN base b USING (r) WHERE w.n > 0),
both_ AS (SELECT o.r, o.kind, sum({h("p")}) AS hp, sum({h("(p + coalesce(q, 0)) / 2")} - {h("coalesce(q, 0) / 2")}) AS hm FROM own o LEFT JOIN ref USING (language, kind, pos) GROUP BY 1, 2),
dist AS (SELECT b.r, e.kind, e.bins, sqrt(greatest(coalesce(x.hm, 0) + (SELECT sum({h("q / 2")}) FROM ref WHERE ref.language = b.language AND ref.kind = e.kind) - (coalesce(x.hp, 0) + e.hq) / 2, 0)) AS v
    FROM base b JOIN refs e USING (language) LEFT JOIN both_ x ON x.r = b.r AND x.kind = e.kind WHERE b.n_words >= {rules.guard_words} AND b.total >= {rules.guard_chars})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT (base_failed OR coalesce(c.v > {rules.max_char_distance}, false) OR coalesce(w.v * w.v - w.bins / (8 * ln(2) * n_words) > {rules.max_word_divergence}, false)) AS kept,
    round(c.v, 6) AS char_distance, round(w.v, 6) AS word_distance
FROM base LEFT JOIN dist c ON c.r = base.r AND c.kind = 1 LEFT JOIN dist w ON w.r = base.r AND w.kind = 0"""


def leaks_sql(rules: TemplateRules = TemplateRules()) -> str:
    """Windows of template words (form 0) and of plain words (form 1) as lists, joined by equality, with the check of slots."""
    pair = "regexp_replace({}, '(\\d)[.,:/](\\d)', '\\1\\2', 'g')"
    bare = pair.format(pair.format("regexp_replace(coalesce(text, ''), '[\\x01-\\x05]', ' ', 'g')"))
    steps = [
        ("(^|[^\\p{L}\\p{M}])(\\p{Lu}\\p{Ll}[\\p{L}\\p{M}]*)", "'\\1' || chr(1) || '\\2' || chr(4)"),
        (f"\\x01({joined(COMMON | set(NUMBER_WORDS))})\\x04", "'\\1'"),
        ("\\x04[ ''-]\\x01", "chr(4)"),
        ("\\d+", "chr(2) || '\\0' || chr(4)"),
        (f"(\\x02\\d+\\x04[ -]{{0,2}})({joined(UNITS)})([^\\p{{L}}\\p{{M}}]|$)", "'\\1 ' || chr(3) || '\\2\\3'"),
        ("[^\\p{L}\\p{M}\\p{Nd}\\x01-\\x05]+", "'  '"),
        (f"(^| )({joined(NUMBER_WORDS)})( |$)", "'\\1' || chr(2) || '\\2' || chr(5) || '\\3'"),
        ("\\x05  \\x02([a-z])", "chr(5) || '\\1'"),
    ]
    t = bare
    for i, (pattern, by) in enumerate(steps):
        quoted = pattern if "''" in pattern else pattern.replace("'", "''")
        t = f"regexp_replace({f'lower({t})' if i == 1 else t}, '{quoted}', {by}, 'g')"
    words = f"list_filter(regexp_split_to_array({t}, ' +'), lambda x: x <> '')"
    low = f"list_filter(regexp_split_to_array(lower({bare}), '[^\\p{{L}}\\p{{M}}\\p{{Nd}}]+'), lambda x: x <> '')"
    digits = "CASE x " + " ".join(f"WHEN chr(2) || '{w}' || chr(5) THEN chr(2) || '{d}' || chr(4)" for w, d in NUMBER_WORDS.items()) + " ELSE x END"
    k = rules.width
    fits = "len(w) >= k" if rules.inside else f"(len(w) >= {k} AND k = {k} OR len(w) = k)"
    forms = lambda name, cols: f"""{name}1 AS (SELECT {cols}, 0 AS form, list_transform(v, lambda x: {digits}) AS v, list_transform(v, lambda x: CASE WHEN x < chr(4) THEN x[1] ELSE x END) AS w FROM {name}0
    UNION ALL SELECT {cols}, 1, p, p FROM {name}0)"""  # noqa: E731
    return f"""
WITH i0 AS (SELECT item_id, {words} AS v, {low} AS p FROM benchmark WHERE item_id IS NOT NULL),
d0 AS (SELECT row_number() OVER () AS r, doc_id, {words} AS v, {low} AS p FROM (SELECT DISTINCT doc_id, text FROM documents) y),
{forms("i", "item_id")},
{forms("d", "r, doc_id")},
i2 AS (SELECT item_id, form, v, w, least(len(w), {k}) AS k, unnest(range(greatest(len(w) - {k - 1}, 1))) AS p FROM i1 WHERE len(w) > 0),
win AS (SELECT item_id, form, v, p, k, w[p + 1:p + {k}] AS x FROM i2
    WHERE form = 1 OR len(list_filter(w[p + 1:p + {k}], lambda y: y[1] >= chr(4))) >= greatest(1, least({rules.literals}, len(w) - 2))),
sizes AS (SELECT item_id, form, count(DISTINCT x) AS n_windows FROM win GROUP BY 1, 2),
d2 AS (SELECT r, d.form, v, w, k, unnest(range(len(w) - k + 1)) AS q FROM d1 d JOIN (SELECT DISTINCT form, k FROM win) y ON y.form = d.form AND {fits}),
hit AS (SELECT d.r, i.item_id, i.form, i.x, i.p, d.q, i.v AS iv, d.v AS dv FROM (SELECT r, form, v, q, k, w[q + 1:q + k] AS x FROM d2) d JOIN win i ON i.x = d.x AND i.k = d.k AND i.form = d.form),
whole AS (SELECT r, item_id, form, n_windows FROM hit JOIN sizes USING (item_id, form) GROUP BY ALL HAVING count(DISTINCT x) >= {rules.share} * n_windows),
cut AS (SELECT h.r, h.item_id, h.form, n_windows, x, q - p AS shift, CASE WHEN h.form = 1 THEN [] ELSE list_filter(list_transform(range({k}), lambda j: [iv[p + j + 1], dv[q + j + 1]]), lambda y: y[1] < chr(4)) END AS slots
    FROM hit h JOIN whole USING (r, item_id, form)),
slot AS (SELECT r, item_id, form, shift, unnest(slots) AS y FROM cut),
line AS (SELECT r, item_id, form, shift, count(DISTINCT y) = count(DISTINCT y[1]) AS even, count(DISTINCT y) FILTER (WHERE y[1] <> y[2]) AS changed FROM slot GROUP BY 1, 2, 3, 4),
pairs AS (SELECT r, item_id, form, count(DISTINCT y) = count(DISTINCT y[1]) AS even, count(DISTINCT y) FILTER (WHERE y[1] <> y[2]) AS changed FROM slot GROUP BY 1, 2, 3),
alone AS (SELECT c.r, c.item_id, c.form, c.shift, count(DISTINCT x) AS n, coalesce(max(changed), 0) AS changed FROM cut c LEFT JOIN line l USING (r, item_id, form, shift) WHERE coalesce(even, true) GROUP BY 1, 2, 3, 4),
best AS (SELECT r, item_id, form, max(n) AS n, max(changed) AS changed FROM alone GROUP BY 1, 2, 3),
done AS (SELECT c.r, c.item_id, c.form, n_windows, greatest(count(DISTINCT x) FILTER (WHERE coalesce(p.even, true) OR len(slots) = 0), coalesce(max(b.n), 0)) AS n_matched,
        CASE WHEN coalesce(bool_and(p.even), true) THEN coalesce(max(p.changed), 0) ELSE coalesce(max(b.changed), 0) END AS n_changed
    FROM cut c LEFT JOIN pairs p USING (r, item_id, form) LEFT JOIN best b USING (r, item_id, form) GROUP BY 1, 2, 3, 4),
one AS (SELECT * FROM done WHERE n_matched >= {rules.share} * n_windows QUALIFY row_number() OVER (PARTITION BY r, item_id ORDER BY form) = 1)
SELECT doc_id, item_id, n_windows, n_matched, n_changed, n_matched / CAST(n_windows AS DOUBLE) AS containment FROM one JOIN d0 USING (r)"""


def licenses_sql(rules: BlockRules = BlockRules()) -> str:
    """Phrases by place, and for each template the most of its words in any block that starts with one of them."""
    whens = " ".join("WHEN " + " AND ".join(f"w[p + {i + 1}] = '{x}'" for i, x in enumerate(phrase.split())) + f" THEN '{label}'" for phrase, label in PHRASES.items())
    made = [Template(label, text, rules) for label, text in TEMPLATES]
    templates = ", ".join(f"({k}, '{t.label}', {t.length}, {t.need}, {t.n})" for k, t in enumerate(made))
    tokens = ", ".join(f"({k}, '{w.decode()}')" for k, (_, text) in enumerate(TEMPLATES) for w in sorted(set(words_of(text.encode()))))
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM documents),
places AS (SELECT r, w, unnest(range(len(w))) AS p FROM d),
base AS (SELECT r, p, label FROM (SELECT r, p, CASE {whens} END AS label FROM places) y WHERE label IS NOT NULL),
templates(k, label, length, need, n) AS (VALUES {templates}),
tokens(k, word) AS (VALUES {tokens}),
hit AS (SELECT r, k, p, word FROM (SELECT r, p, w[p + 1] AS word FROM places) y JOIN tokens USING (word)),
maybe AS (SELECT r, k FROM hit JOIN templates USING (k) GROUP BY r, k, need HAVING count(DISTINCT word) >= need),
block AS (SELECT a.r, a.k, a.p, count(DISTINCT b.word) AS c FROM hit a JOIN maybe m ON m.r = a.r AND m.k = a.k JOIN templates t ON t.k = a.k JOIN hit b ON b.r = a.r AND b.k = a.k AND b.p BETWEEN a.p AND a.p + t.length - 1 GROUP BY 1, 2, 3),
found AS (SELECT r, label, max(c / CAST(n AS DOUBLE)) AS share FROM block JOIN templates USING (k) WHERE c >= need GROUP BY 1, 2),
named AS (SELECT r, label FROM base UNION SELECT r, label FROM found)
SELECT doc_id, len(w) AS n_words, (SELECT count(*) FROM base WHERE base.r = d.r) AS n_base, (SELECT min(p) FROM base WHERE base.r = d.r) AS first_word, (SELECT max(p) FROM base WHERE base.r = d.r) AS last_word,
    coalesce((SELECT string_agg(DISTINCT label, ',' ORDER BY label) FROM base WHERE base.r = d.r), '') AS base_labels, coalesce((SELECT string_agg(label, ',' ORDER BY label) FROM named WHERE named.r = d.r), '') AS labels,
    CASE WHEN EXISTS (SELECT 1 FROM base WHERE base.r = d.r) THEN CAST(1 AS DOUBLE) ELSE coalesce((SELECT max(share) FROM found WHERE found.r = d.r), 0) END AS score FROM d"""


def repeats_sql(length: int = 400, words: int = 51) -> str:
    """Windows of bytes (as hexadecimal digits) and of words by checksum; covered places are runs of neighbouring windows."""

    def runs(source: str, size: int) -> str:
        return f"""(SELECT r, min(i) AS a, max(i) + {size} AS b FROM (SELECT *, sum(new) OVER (PARTITION BY r ORDER BY i) AS g FROM (SELECT r, i, CASE WHEN i <= lag(i) OVER (PARTITION BY r ORDER BY i) + {size} THEN 0 ELSE 1 END AS new
    FROM (SELECT r, i, count(*) OVER (PARTITION BY h) AS n FROM ({source}) y) y WHERE n > 1) y) y GROUP BY r, g)"""

    by_byte = f"SELECT r, i, md5(substr(x, 2 * i + 1, {2 * length})) AS h FROM (SELECT r, x, unnest(range(n - {length - 1})) AS i FROM d WHERE n >= {length}) z"
    by_word = f"SELECT r, i, md5(array_to_string(w[i + 1:i + {words}], ' ')) AS h FROM (SELECT r, w, unnest(range(len(w) - {words - 1})) AS i FROM d WHERE len(w) >= {words}) z"
    return f"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
d AS (SELECT r, doc_id, hex(encode(t)) AS x, octet_length(encode(t)) AS n, list_filter(regexp_split_to_array(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda v: v <> '') AS w FROM t),
cut AS {runs(by_byte, length)},
shared AS (SELECT r, CAST(sum(b - a) AS BIGINT) AS n FROM {runs(by_word, words)} y GROUP BY 1),
part AS (SELECT *, lag(b, 1, 0) OVER (PARTITION BY r ORDER BY a) AS before FROM cut),
kept AS (SELECT d.r, string_agg(substr(x, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) || substr(any_value(x), 2 * max(b) + 1) AS k, CAST(sum(b - a) AS BIGINT) AS removed, count(*) AS spans FROM part JOIN d ON d.r = part.r GROUP BY 1)
SELECT doc_id, CAST(d.n AS BIGINT) AS n_bytes, coalesce(removed, 0) AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(coalesce(k, x))) AS kept_sha256, coalesce(shared.n, 0) AS n_passage_words FROM d LEFT JOIN kept ON kept.r = d.r LEFT JOIN shared ON shared.r = d.r"""


USABLE = "SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"


def negatives_sql() -> str:
    """Every anchor's scores with all rows, and ranks among them: products of whole numbers below 2**53 are exact as doubles."""
    return f"""WITH e AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, CAST(v AS DOUBLE[]) AS v FROM ({USABLE}) x WHERE label IS NOT NULL),
s AS (SELECT a.r AS anchor, a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id AS id, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score FROM e a JOIN e b ON a.r <> b.r WHERE a.vec_id % 100 = 0),
p AS (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, id) AS k FROM s WHERE same QUALIFY k <= 5),
n AS (SELECT p.anchor_id, p.id AS positive_id, row_number() OVER (PARTITION BY p.anchor, p.k ORDER BY s.score DESC, s.id) AS place, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score
    FROM p JOIN s ON s.anchor = p.anchor AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score QUALIFY place <= 10)
SELECT anchor_id, positive_id, CAST(place AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n"""


def codes_sql(parts: int = 16, entries: int = 64, rounds: int = 2) -> str:
    """Every part's distance from every entry, its least one by (distance, index), and entries as floors of means."""
    steps = []
    for k in range(rounds + 1):
        steps.append(f"""d{k} AS (SELECT x.r, x.p, c.i, list_sum(list_transform(list_zip(x.w, c.w), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM x JOIN c{k} c ON c.p = x.p),
a{k} AS (SELECT r, p, arg_min(i, {{'d': d, 'i': i}}) AS i, CAST(min(d) AS BIGINT) AS d FROM d{k} GROUP BY 1, 2)""")
        if k < rounds:
            steps.append(f"""m{k} AS (SELECT p, i, list(m ORDER BY t) AS w FROM (SELECT a.p, a.i, t, CAST(floor(sum(x.w[t]) / CAST(count(*) AS DOUBLE)) AS BIGINT) AS m FROM a{k} a JOIN x ON x.r = a.r AND x.p = a.p, unnest(range(1, len(x.w) + 1)) u(t) GROUP BY 1, 2, 3) y GROUP BY 1, 2),
c{k + 1} AS (SELECT c.p, c.i, coalesce(m.w, c.w) AS w FROM c{k} c LEFT JOIN m{k} m ON m.p = c.p AND m.i = c.i)""")
    return f"""WITH e AS (SELECT row_number() OVER (ORDER BY vec_id, v) - 1 AS r, vec_id, label, v FROM ({USABLE}) x),
x AS (SELECT r, p, v[p * (len(v) // {parts}) + 1:(p + 1) * (len(v) // {parts})] AS w FROM e, unnest(range({parts})) u(p)),
c0 AS (SELECT p, r AS i, w FROM x WHERE r < {entries}),
{", ".join(steps)},
h AS (SELECT sha256(string_agg(array_to_string(w, ','), ',' ORDER BY p, i)) AS codebooks_sha256 FROM c{rounds}),
f AS (SELECT r, string_agg(printf('%02x', i), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY 1)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM e JOIN f ON f.r = e.r, h"""
