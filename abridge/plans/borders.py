"""Queries of sentence borders that are learned from `documents`, and their SQL."""

from abridge.operators import borders as B
from abridge.operators.select import scratch_path
from abridge.plans.catalog import docs_of, query, rounded

_OPEN, _CLOSE = B.OPENING.replace("'", "''"), B.CLOSING.replace("'", "''")


def _type(t: str) -> str:
    word = rf"lower(regexp_replace({t}, '\.$', ''))"
    return rf"CASE WHEN regexp_matches({word}, '^[0-9][0-9.,]*$') THEN '#' ELSE {word} END"


def _log(p: str) -> str:
    return f"ln(greatest(least({p}, 1 - 1e-12), 1e-12))"


def _ratio(a: str, b: str, k: str, n: str) -> str:
    a, b, k, n = (f"({c})::DOUBLE" for c in (a, b, k, n))
    p, p1, p2 = f"({b} / {n})", f"({k} / {a})", f"(({b} - {k}) / greatest({n} - {a}, 1.0))"
    apart = f"{k} * {_log(p)} + ({a} - {k}) * {_log(f'1 - {p}')} + ({b} - {k}) * {_log(p)} + ({n} - {a} - {b} + {k}) * {_log(f'1 - {p}')}"
    one = f"{k} * {_log(p1)} + ({a} - {k}) * {_log(f'1 - {p1}')} + ({b} - {k}) * {_log(p2)} + ({n} - {a} - {b} + {k}) * {_log(f'1 - {p2}')}"
    return f"-2 * (({apart}) - ({one}))"


_COUNTS = rf"""
toks AS (SELECT doc_id, coalesce(lang, '') AS lang, list_filter(regexp_split_to_array(coalesce(text, ''), '\s+'), lambda x: x <> '') AS t FROM documents),
bare AS (SELECT doc_id, lang, t, list_transform(t, lambda x: regexp_replace(x, '^{_OPEN}+|{_CLOSE}+$', '', 'g')) AS c FROM toks WHERE len(t) > 0),
pos AS (SELECT doc_id, lang, i, c[i] AS a, c[i + 1] AS b FROM (SELECT doc_id, lang, c, unnest(range(1, len(c) + 1)) AS i FROM bare)),
typed AS (SELECT doc_id, lang, i, {_type('a')} AS word, regexp_matches(a, '[^.]\.$') AS stop, regexp_matches(a, '[!?]$') AS mark, regexp_matches(a, '\.\.$') AS dots,
  CASE WHEN regexp_matches(b, '[\p{{L}}\p{{Nd}}]') THEN {_type('b')} END AS f, coalesce({_type('b')}, '') AS any_f, coalesce(regexp_matches(b, '^\p{{Lu}}'), false) AS up FROM pos),
counts AS (SELECT lang, word, stop, CASE WHEN stop THEN f END AS following, stop AND f IS NOT NULL AND up AS upper, count(*) AS n FROM typed
  WHERE regexp_matches(word, '[\p{{L}}\p{{Nd}}#]') GROUP BY ALL),
per AS (SELECT lang, word, coalesce(sum(n) FILTER (stop), 0) AS n_stop, coalesce(sum(n) FILTER (NOT stop), 0) AS n_bare FROM counts GROUP BY ALL),
whole AS (SELECT lang, sum(n_stop) AS stops, sum(n_stop) + sum(n_bare) AS words FROM per GROUP BY 1),
scored AS (SELECT lang, word, n_stop::BIGINT AS n_stop, n_bare::BIGINT AS n_bare,
    -2 * ((n_stop * {_log('(stops / words)')} + n_bare * {_log('1 - (stops / words)')}) - (n_stop * ln(0.99) + n_bare * ln(0.01))) * exp(-size) * (length(word) - size + 1) * exp(-n_bare * ln(size)) AS score
  FROM (SELECT *, length(replace(word, '.', '')) AS size FROM per JOIN whole USING (lang) WHERE n_stop > 0 AND word <> '#') WHERE size > 0),
short AS (SELECT * FROM scored WHERE score >= {B.ABBREVIATION}),
of_word AS (SELECT lang, word AS following, sum(n) AS b FROM counts GROUP BY ALL),
all_words AS (SELECT lang, sum(n) AS words FROM counts GROUP BY 1),
after AS (SELECT c.*, s.word IS NOT NULL AS known, regexp_matches(c.word, '^\p{{L}}$') OR c.word = '#' AS single FROM counts c LEFT JOIN short s USING (lang, word) WHERE stop AND following IS NOT NULL),
breaks AS (SELECT lang, sum(n) AS a FROM after WHERE NOT known AND NOT single GROUP BY 1),
begun AS (SELECT lang, following, sum(n) FILTER (upper) AS k FROM after WHERE NOT known AND NOT single GROUP BY ALL),
starters AS (SELECT lang, following AS word, {_ratio('a', 'b', 'k', 'words')} AS ratio FROM begun JOIN of_word USING (lang, following) JOIN breaks USING (lang) JOIN all_words USING (lang)
  WHERE k > 0 AND k * words > a * b AND {_ratio('a', 'b', 'k', 'words')} > {B.STARTER}),
tied AS (SELECT lang, word, following, sum(n) AS k FROM after WHERE known OR single GROUP BY ALL HAVING sum(n) > 1),
own AS (SELECT lang, word, sum(n) AS a FROM counts WHERE stop GROUP BY ALL),
pairs AS (SELECT lang, word, following, {_ratio('a', 'b', 'k', 'words')} AS ratio FROM tied JOIN own USING (lang, word) JOIN of_word USING (lang, following) JOIN all_words USING (lang)
  WHERE k * words > a * b AND {_ratio('a', 'b', 'k', 'words')} > {B.COLLOCATION} AND (lang, following) NOT IN (SELECT (lang, word) FROM starters))"""


def _counted(spark, d):
    """`pair_counts` of all documents, written once: several sums are made of them."""
    path = scratch_path(spark, "borders")
    B.pair_counts(docs_of(spark, d)).write.parquet(path)
    return spark.read.parquet(path)


@query(f"WITH {_COUNTS} SELECT lang, word, n_stop, n_bare, round(score, 6) + 0.0 AS score FROM scored")
def borders_abbreviations(spark, d):
    """How much each word that is met with a full stop looks like an abbreviation."""
    return rounded(B.abbreviation_scores(_counted(spark, d)), "score")


@query(f"WITH {_COUNTS} SELECT lang, word, round(ratio, 4) AS ratio FROM starters")
def borders_starters(spark, d):
    return rounded(B.learn_borders(docs_of(spark, d), counts=_counted(spark, d)).starters, "ratio", digits=4)


@query(f"""WITH {_COUNTS}, marked AS (
  SELECT t.doc_id, t.i, t.mark OR (t.dots AND t.up) OR (t.stop AND NOT ((s.word IS NOT NULL OR regexp_matches(t.word, '^\\p{{L}}$') OR t.word = '#') AND NOT (t.up AND b.word IS NOT NULL)) AND p.word IS NULL) AS ends
  FROM typed t LEFT JOIN short s ON s.lang = t.lang AND s.word = t.word LEFT JOIN starters b ON b.lang = t.lang AND b.word = t.any_f LEFT JOIN pairs p ON p.lang = t.lang AND p.word = t.word AND p.following = t.any_f),
numbered AS (SELECT doc_id, i, coalesce(sum(ends::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k FROM marked)
SELECT n.doc_id AS set_id, n.k::INT AS sent_idx, string_agg(b.t[n.i], ' ' ORDER BY n.i) AS text FROM numbered n JOIN bare b USING (doc_id) GROUP BY 1, 2""")
def borders_sentences(spark, d):
    """Sentences of all documents, cut where their languages' own texts say that sentences end."""
    docs = docs_of(spark, d)
    return B.bordered(docs, B.learn_borders(docs, counts=_counted(spark, d)))
