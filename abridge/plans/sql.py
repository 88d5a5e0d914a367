"""Common table expressions for DuckDB that the queries' SQL begins with."""

from abridge.plans.words import NEGATIVE, POSITIVE, STOP


def listed(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


def sents(table: str = "documents", set_id: str = "doc_id", text: str = "text", split: bool = True, least: int = 4) -> str:
    """cut(set_id, l) and s(set_id, sent_idx, text, tokens, words)."""
    parts = rf"string_split(regexp_replace(coalesce({text}, ''), '([.!?])\W+', '\1' || chr(1), 'g'), chr(1))" if split else f"string_split(coalesce({text}, ''), chr(10))"
    return rf"""
cut AS (SELECT {set_id} AS set_id, list_filter(list_transform(list_filter(list_transform({parts},
    lambda x: regexp_replace(replace(x, chr(10), ' '), '^\s+|\s+$', '', 'g')), lambda x: x <> ''),
    lambda x: {{'text': x, 'tokens': list_filter(regexp_split_to_array(x, '\s+'), lambda t: t <> '')}}), lambda r: len(r.tokens) >= {least}) AS l FROM {table}),
s AS (SELECT set_id, i::INT AS sent_idx, l[i + 1].text AS text, l[i + 1].tokens AS tokens,
    list_filter(list_transform(l[i + 1].tokens, lambda t: lower(regexp_replace(t, '[^\p{{L}}\p{{Nd}}]', '', 'g'))), lambda w: w <> '') AS words
  FROM (SELECT set_id, l, unnest(range(len(l))) AS i FROM cut))"""


def bag(bigrams: bool = True, stop: bool = True) -> str:
    one = f"list_filter(words, lambda w: w NOT IN ({listed(STOP)}))" if stop else "words"
    two = "list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])"
    terms = f"list_concat({one}, {two})" if bigrams else one
    return f"bag AS (SELECT set_id, sent_idx, term, count(*)::INT AS tf FROM (SELECT set_id, sent_idx, unnest({terms}) AS term FROM s) GROUP BY ALL)"


IDF = """
n AS (SELECT set_id, count(*) AS n FROM s GROUP BY 1),
idf AS (SELECT set_id, term, count(*) AS df, log10(any_value(n.n) / count(*)) AS idf FROM bag JOIN n USING (set_id) GROUP BY 1, 2)"""
WEIGHTS = "wt AS (SELECT bag.*, idf.idf, tf * idf.idf AS tfidf FROM bag JOIN idf USING (set_id, term))"
NORMS = "norm AS (SELECT set_id, sent_idx, sqrt(sum(tfidf ** 2)) AS tn, sqrt(sum(idf ** 2)) AS dn FROM wt GROUP BY ALL)"
COSINE = """
cos AS (SELECT a.set_id, a.sent_idx AS i, b.sent_idx AS j, sum(a.tfidf * b.tfidf) / (any_value(x.tn) * any_value(y.tn)) AS s
  FROM wt a JOIN wt b ON a.set_id = b.set_id AND a.term = b.term AND a.sent_idx < b.sent_idx
  JOIN norm x ON x.set_id = a.set_id AND x.sent_idx = a.sent_idx JOIN norm y ON y.set_id = a.set_id AND y.sent_idx = b.sent_idx
  WHERE a.tfidf <> 0 GROUP BY 1, 2, 3)"""


def tfidf(bigrams: bool = True) -> str:
    return ", ".join([sents(), bag(bigrams), IDF, WEIGHTS, NORMS])


def cosine(bigrams: bool = True) -> str:
    return tfidf(bigrams) + ", " + COSINE


FRACTIONS = f"""
frac AS (SELECT set_id, sent_idx, len(tokens)::INT AS n_tokens, len(list_filter(words, lambda w: w IN ({listed(POSITIVE)}))) / len(tokens) AS pos,
  len(list_filter(words, lambda w: w IN ({listed(w for w in NEGATIVE if w not in POSITIVE)}))) / len(tokens) AS neg FROM s)"""


def sentiment(side: str) -> str:
    return f"""
raw_{side} AS (SELECT a.set_id, a.sent_idx AS i, b.sent_idx AS j, 1 - abs(a.{side} - b.{side}) AS s FROM frac a JOIN frac b ON a.set_id = b.set_id AND a.sent_idx < b.sent_idx),
end_{side} AS (SELECT set_id, least(min(s), 1.0) AS low, greatest(max(s), 1.0) AS high FROM raw_{side} GROUP BY 1),
{side} AS (SELECT set_id, i, j, CASE WHEN high > low THEN (s - low) / (high - low) ELSE 1.0 END AS s FROM raw_{side} JOIN end_{side} USING (set_id))"""


VECTORS = """
many AS (SELECT count(*) AS m FROM embeddings),
hashed AS (SELECT word, ('0x' || substr(md5(word), 1, 8))::BIGINT AS h FROM (SELECT DISTINCT unnest(words) AS word FROM s)),
vec AS (SELECT word, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM hashed, many JOIN embeddings ON vec_id = h % m WHERE h % 10 <> 0)"""
EMBEDDED = """
used AS (SELECT set_id, sent_idx, v FROM (SELECT set_id, sent_idx, unnest(words) AS word FROM s) JOIN vec USING (word)),
emb AS (SELECT set_id, sent_idx, list(x ORDER BY d) AS v FROM (SELECT set_id, sent_idx, d, avg(v[d]) AS x FROM used, range(1, 65) r(d) GROUP BY ALL) GROUP BY ALL)"""
EMBED_PAIRS = """
raw AS (SELECT a.set_id, a.sent_idx AS i, b.sent_idx AS j, 0.5 * (list_cosine_similarity(a.v, b.v) + 1) AS s FROM emb a JOIN emb b ON a.set_id = b.set_id AND a.sent_idx < b.sent_idx),
ends AS (SELECT set_id, min(s) AS low, max(s) AS high FROM raw GROUP BY 1),
embed AS (SELECT set_id, i, j, CASE WHEN high > low THEN (s - low) / (high - low) ELSE 1.0 END AS s FROM raw JOIN ends USING (set_id))"""

MEDOIDS = """
kk AS (SELECT set_id, greatest(1, floor(0.2 * n + 0.5))::INT AS k FROM n),
med AS (SELECT set_id, o.k, sent_idx AS medoid FROM (SELECT set_id, sent_idx, row_number() OVER (PARTITION BY set_id ORDER BY md5('7:' || sent_idx)) - 1 AS k FROM s) o JOIN kk USING (set_id)
  WHERE kk.k > o.k) """
SIDES = "sides AS (SELECT set_id, i, j, s FROM cos UNION ALL SELECT set_id, j, i, s FROM cos)"


def assigned(med: str, out: str) -> str:
    return f"""
near_{out} AS (SELECT set_id, i, arg_max(k, (round(s, 9), -k)) AS k FROM sides JOIN {med} USING (set_id) WHERE sides.j = {med}.medoid AND s > 0 GROUP BY 1, 2),
{out} AS (SELECT s.set_id, s.sent_idx, coalesce(m.k, o.k, 0)::INT AS k FROM s LEFT JOIN {med} m ON m.set_id = s.set_id AND m.medoid = s.sent_idx LEFT JOIN near_{out} o ON o.set_id = s.set_id AND o.i = s.sent_idx)"""


def best(clusters: str, out: str) -> str:
    return f"""
tot_{out} AS (SELECT c.set_id, c.k, c.sent_idx AS i, round(coalesce(sum(s) FILTER (d.k = c.k), 0.0), 9) AS total FROM {clusters} c
  LEFT JOIN sides ON sides.set_id = c.set_id AND sides.i = c.sent_idx LEFT JOIN {clusters} d ON d.set_id = c.set_id AND d.sent_idx = sides.j GROUP BY ALL),
{out} AS (SELECT set_id, k, arg_max(i, (total, -i)) AS medoid, max(total) AS total FROM tot_{out} GROUP BY 1, 2)"""


DEGREES = """
full_w AS (SELECT * FROM sides UNION ALL SELECT set_id, sent_idx, sent_idx, 1.0 FROM s),
deg AS (SELECT s.set_id, s.sent_idx, coalesce(sum(w.s), 0.0) AS degree, coalesce(sum(w.s), 0.0) * 5.0 / any_value(n.n) AS cap, coalesce(sum(w.s), 0.0) / any_value(n.n) AS r
  FROM s JOIN n USING (set_id) LEFT JOIN full_w w ON w.set_id = s.set_id AND w.i = s.sent_idx GROUP BY 1, 2)"""


def greedy(clusters: str, steps: int, diversity: float) -> str:
    """sel<step>(set_id, step, sent_idx, score), each with all earlier ones."""
    out, before = [], "(SELECT NULL::BIGINT AS set_id, NULL::INT AS step, NULL::INT AS sent_idx, NULL::DOUBLE AS score LIMIT 0)"
    for k in range(1, steps + 1):
        out.append(f"""
got{k} AS (SELECT d.set_id, d.sent_idx, d.cap, d.r, c.k, coalesce(g.got, 0.0) AS got FROM deg d JOIN {clusters} c ON c.set_id = d.set_id AND c.sent_idx = d.sent_idx
  LEFT JOIN (SELECT w.set_id, w.i, sum(w.s) AS got FROM full_w w JOIN {before} b ON b.set_id = w.set_id AND b.sent_idx = w.j GROUP BY 1, 2) g ON g.set_id = d.set_id AND g.i = d.sent_idx),
rk{k} AS (SELECT g.set_id, g.k, coalesce(sum(g.r) FILTER (b.sent_idx IS NOT NULL), 0.0) AS rk FROM got{k} g LEFT JOIN {before} b ON b.set_id = g.set_id AND b.sent_idx = g.sent_idx GROUP BY 1, 2),
base{k} AS (SELECT set_id, x + {diversity} * y AS base, y FROM (SELECT set_id, sum(least(got, cap)) AS x FROM got{k} GROUP BY 1) JOIN (SELECT set_id, sum(sqrt(rk)) AS y FROM rk{k} GROUP BY 1) USING (set_id)),
gain{k} AS (SELECT w.set_id, w.j AS sent_idx, sum(least(g.got + w.s, g.cap) - least(g.got, g.cap)) AS gain FROM full_w w JOIN got{k} g ON g.set_id = w.set_id AND g.sent_idx = w.i GROUP BY 1, 2),
val{k} AS (SELECT g.set_id, g.sent_idx, round(base + gain + {diversity} * (sqrt(rk + g.r) - sqrt(rk)), 9) AS v FROM got{k} g JOIN base{k} USING (set_id) JOIN gain{k} a ON a.set_id = g.set_id AND a.sent_idx = g.sent_idx JOIN rk{k} q ON q.set_id = g.set_id AND q.k = g.k
  WHERE NOT EXISTS (SELECT 1 FROM {before} b WHERE b.set_id = g.set_id AND b.sent_idx = g.sent_idx)),
sel{k} AS (SELECT * FROM {before} UNION ALL SELECT set_id, {k}::INT, arg_max(sent_idx, (v, -sent_idx)), max(v) FROM val{k} WHERE v > 0 GROUP BY 1)""")
        before = f"sel{k}"
    return ", ".join(out)


ROUNDS = 8


def settled(rounds: int = ROUNDS) -> str:
    """cl(set_id, sent_idx, k): k-medoids from `med` and `c1`, as many rounds as raise the utility, up to `rounds` (a set that has stopped stays)."""

    def worth(name: str, clusters: str, medoids: str) -> str:
        return f"""
{name} AS MATERIALIZED (SELECT n.set_id, round(coalesce(sum(sides.s), 0.0), 9) AS u FROM n LEFT JOIN {clusters} c ON c.set_id = n.set_id LEFT JOIN {medoids} m ON m.set_id = c.set_id AND m.k = c.k
  LEFT JOIN sides ON sides.set_id = c.set_id AND sides.i = c.sent_idx AND sides.j = m.medoid GROUP BY 1)"""

    out = [worth("u0", "c1", "med"), "r0 AS MATERIALIZED (SELECT c1.*, u FROM c1 JOIN u0 USING (set_id))"]
    for k in range(1, rounds + 1):
        out.append(best(f"r{k - 1}", f"m{k}").replace(" AS (", " AS MATERIALIZED ("))
        out.append(assigned(f"m{k}", f"a{k}").replace(" AS (", " AS MATERIALIZED ("))
        out.append(worth(f"u{k}", f"a{k}", f"m{k}"))
        out.append(f"""
r{k} AS MATERIALIZED (SELECT r.set_id, r.sent_idx, CASE WHEN u{k}.u > r.u THEN a.k ELSE r.k END AS k, greatest(u{k}.u, r.u) AS u
  FROM r{k - 1} r JOIN a{k} a USING (set_id, sent_idx) JOIN u{k} ON u{k}.set_id = r.set_id)""")
    return ", ".join(out) + f", cl AS (SELECT set_id, sent_idx, k FROM r{rounds})"


WORDS, BYTES, ONE = "len(tokens)::DOUBLE", "(strlen(text) + 1)::DOUBLE", "1.0"


def budget(length: float, cost: str, steps: int, left_out: str = "false", weight: bool = False, singleton: bool = True, diversity: float = 6.0, strict: bool = False) -> str:
    """fin(set_id, step, sent_idx, score): the greedy choice with a budget, `steps` at most, over clusters `cl`. `left_out` is a condition on s; with `strict`
    only sentences that fit into the rest of the budget are chosen."""
    out = [
        f"cst AS MATERIALIZED (SELECT set_id, sent_idx, {cost} AS cost, greatest(length(text), 1) AS size, {left_out} AS gone FROM s)",
        "st AS MATERIALIZED (SELECT deg.*, cl.k, cost, size, gone FROM deg JOIN cl USING (set_id, sent_idx) JOIN cst USING (set_id, sent_idx))",
        "fw AS MATERIALIZED (SELECT * FROM full_w)",
        "p0 AS MATERIALIZED (SELECT NULL::BIGINT AS set_id, NULL::INT AS step, NULL::INT AS sent_idx, NULL::DOUBLE AS score, NULL::DOUBLE AS cost LIMIT 0)",
    ]

    def value(k: int, chosen: str) -> str:
        """v{k}: every sentence with the objective if it is added."""
        return f"""
got{k} AS MATERIALIZED (SELECT st.*, coalesce(g.got, 0.0) AS got, b.sent_idx IS NOT NULL AS inside FROM st LEFT JOIN {chosen} b USING (set_id, sent_idx)
  LEFT JOIN (SELECT w.set_id, w.i, sum(w.s) AS got FROM fw w JOIN {chosen} b ON b.set_id = w.set_id AND b.sent_idx = w.j GROUP BY 1, 2) g ON g.set_id = st.set_id AND g.i = st.sent_idx),
rk{k} AS MATERIALIZED (SELECT set_id, k, coalesce(sum(r) FILTER (inside), 0.0) AS rk FROM got{k} GROUP BY 1, 2),
base{k} AS MATERIALIZED (SELECT set_id, x + {diversity} * y AS base FROM (SELECT set_id, sum(least(got, cap)) AS x FROM got{k} GROUP BY 1) JOIN (SELECT set_id, sum(sqrt(rk)) AS y FROM rk{k} GROUP BY 1) USING (set_id)),
gain{k} AS MATERIALIZED (SELECT w.set_id, w.j AS sent_idx, sum(least(g.got + w.s, g.cap) - least(g.got, g.cap)) AS gain FROM fw w JOIN got{k} g ON g.set_id = w.set_id AND g.sent_idx = w.i GROUP BY 1, 2),
v{k} AS MATERIALIZED (SELECT g.*, base + gain + {diversity} * (sqrt(rk + g.r) - sqrt(rk)) AS v FROM got{k} g JOIN base{k} USING (set_id) JOIN gain{k} a ON a.set_id = g.set_id AND a.sent_idx = g.sent_idx JOIN rk{k} q ON q.set_id = g.set_id AND q.k = g.k)"""

    rank = "round(v / pow(size, 0.3), 9)" if weight else "round(v, 9)"
    for k in range(1, steps + 1):
        fits = f" AND cost + coalesce((SELECT sum(z.cost) FROM p{k - 1} z WHERE z.set_id = v{k}.set_id), 0) <= {length}" if strict else ""
        out.append(value(k, f"p{k - 1}"))
        out.append(f"""
p{k} AS MATERIALIZED (SELECT * FROM p{k - 1} UNION ALL SELECT set_id, {k}, arg_max(sent_idx, (rank, -sent_idx)), arg_max(v, (rank, -sent_idx)), arg_max(cost, (rank, -sent_idx))
  FROM (SELECT set_id, sent_idx, round(v, 9) AS v, cost, {rank} AS rank FROM v{k} WHERE NOT inside AND NOT gone{fits} AND set_id NOT IN (SELECT set_id FROM p{k - 1} GROUP BY 1 HAVING sum(cost) >= {length} OR max(step) < {k - 1})) WHERE rank > 0 GROUP BY 1)""")
    if not singleton:
        return ", ".join(out) + f", fin AS (SELECT set_id, step, sent_idx, score FROM p{steps})"
    out.append(value(0, "p0"))
    out.append(f"""
alone AS MATERIALIZED (SELECT set_id, arg_max(sent_idx, (v, -sent_idx)) AS sent_idx, max(v) AS v FROM (SELECT set_id, sent_idx, round(v, 9) AS v FROM v0 WHERE cost <= {length} AND NOT gone) GROUP BY 1),
better AS MATERIALIZED (SELECT alone.set_id, alone.sent_idx, v FROM alone JOIN (SELECT set_id, arg_max(score, step) AS last FROM p{steps} GROUP BY 1) USING (set_id) WHERE v > last)""")
    return ", ".join(out) + f", fin AS (SELECT set_id, step, sent_idx, score FROM p{steps} WHERE set_id NOT IN (SELECT set_id FROM better) UNION ALL SELECT set_id, 1, sent_idx, v FROM better)"


def cte(*parts: str) -> str:
    return "WITH " + ", ".join(p.strip() for p in parts) + "\n"
