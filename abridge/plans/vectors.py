"""Queries of clusters of sparse vectors over `documents`, and their SQL."""

from abridge.config import Config
from abridge.operators import vectors as V
from abridge.plans import sql as Q
from abridge.plans.catalog import docs_of, query
from abridge.plans.words import STOP

PLAIN = Config(bigrams=False)
_UNIT = "u AS (SELECT set_id, sent_idx AS i, term, tfidf / tn AS w FROM wt JOIN norm USING (set_id, sent_idx) WHERE tfidf <> 0)"
_MEMBERS = "mem AS (SELECT DISTINCT set_id, i FROM u)"


def _lloyd_sql(rounds: int) -> str:
    """Assignment to centroids cen{r}, repair, new centroids; sets whose cost did not fall keep what they had."""
    parts = [
        _UNIT, _MEMBERS,
        "sz AS (SELECT set_id, count(*) AS n FROM mem GROUP BY 1)",
        "kinds AS (SELECT set_id, i, k FROM (SELECT set_id, i, row_number() OVER (PARTITION BY set_id ORDER BY md5('7:' || i)) - 1 AS k, n FROM mem JOIN sz USING (set_id)) WHERE k < greatest(1, floor(0.2 * n + 0.5)))",
        "cen0 AS (SELECT set_id, k, term, w AS c FROM u JOIN kinds USING (set_id, i))",
    ]
    for r in range(rounds + 1):
        if r:
            parts.append(f"cen{r} AS (SELECT a.set_id, a.k, u.term, sum(u.w) / any_value(z.n) AS c FROM u JOIN st{r - 1} a USING (set_id, i) JOIN (SELECT set_id, k, count(*) AS n FROM st{r - 1} GROUP BY ALL) z ON z.set_id = a.set_id AND z.k = a.k GROUP BY ALL)")
        parts += [
            f"len{r} AS (SELECT set_id, k, sum(c * c) AS len FROM cen{r} GROUP BY ALL)",
            f"all{r} AS (SELECT u.set_id, u.i, c.k, round(1 + any_value(l.len) - 2 * sum(u.w * c.c), 9) AS d FROM u JOIN cen{r} c USING (set_id, term) JOIN len{r} l ON l.set_id = c.set_id AND l.k = c.k GROUP BY ALL UNION ALL SELECT mem.set_id, i, k, round(1 + len, 9) FROM mem JOIN len{r} USING (set_id))",
            f"as{r} AS (SELECT set_id, i, k, d FROM all{r} QUALIFY row_number() OVER (PARTITION BY set_id, i ORDER BY d, k) = 1)",
            f"em{r} AS (SELECT set_id, k AS free, row_number() OVER (PARTITION BY set_id ORDER BY k) AS r FROM (SELECT set_id, k FROM kinds EXCEPT SELECT set_id, k FROM as{r}))",
            f"far{r} AS (SELECT set_id, i, d, row_number() OVER (PARTITION BY set_id ORDER BY d DESC, i) AS r FROM as{r})",
            f"fix{r} AS (SELECT set_id, i, free FROM far{r} JOIN em{r} USING (set_id, r) WHERE d > 0)",
            f"new{r} AS (SELECT a.set_id, a.i, coalesce(free, k) AS k, CASE WHEN free IS NULL THEN d ELSE 0 END AS d FROM as{r} a LEFT JOIN fix{r} USING (set_id, i))",
        ]
        if r:  # a set that has once stopped would stop again, for its centroids are the same
            parts.append(f"fell{r} AS (SELECT set_id FROM (SELECT set_id, round(sum(d), 9) AS now FROM new{r} GROUP BY 1) JOIN (SELECT set_id, round(sum(d), 9) AS before FROM st{r - 1} GROUP BY 1) USING (set_id) WHERE now < before)")
            parts.append(f"st{r} AS (SELECT * FROM new{r} WHERE set_id IN (FROM fell{r}) UNION ALL SELECT * FROM st{r - 1} WHERE set_id NOT IN (FROM fell{r}))")
        else:
            parts.append("st0 AS (SELECT * FROM new0)")
    return Q.cte(Q.tfidf(False), *parts) + f"SELECT set_id, i AS sent_idx, k::INT AS k FROM st{rounds}"


@query(_lloyd_sql(2))
def cluster_lloyd(spark, d):
    """k-means of every document's sentences, two rounds."""
    return V.document_lloyd(docs_of(spark, d), PLAIN, STOP, rounds=2)


def _halves_sql(n: int, clusters: str, kept: str | None) -> list[str]:
    """hv{n}(set_id, k, i, side, gain) of the clusters in `clusters`, one round of moves, and of those halves that are kept."""
    sims = lambda name, other: f"{name} AS (SELECT m{n}.set_id, m{n}.k, m{n}.i, sum(m{n}.w * coalesce(o.x, 0)) AS s FROM m{n} LEFT JOIN ({other}) o ON o.set_id = m{n}.set_id AND o.k = m{n}.k AND o.term = m{n}.term GROUP BY ALL)"
    sums = lambda name, sides: f"{name} AS (SELECT set_id, k, side, term, sum(w) AS x FROM m{n} JOIN {sides} USING (set_id, k, i) GROUP BY ALL)"
    lens = lambda name, s: f"{name} AS (SELECT set_id, k, side, sqrt(sum(x * x)) AS len FROM {s} GROUP BY ALL)"
    return [
        f"m{n} AS (SELECT u.set_id, c.k, u.i, term, w FROM u JOIN {clusters} c USING (set_id, i) JOIN (SELECT set_id, k FROM {clusters} GROUP BY ALL HAVING count(*) > 1) USING (set_id, k))",
        f"wh{n} AS (SELECT set_id, k, term, sum(w) AS x FROM m{n} GROUP BY ALL)",
        sims(f"tw{n}", f"FROM wh{n}"),
        f"a{n} AS (SELECT set_id, k, i FROM tw{n} QUALIFY row_number() OVER (PARTITION BY set_id, k ORDER BY round(s, 9), i) = 1)",
        sims(f"ta{n}", f"SELECT set_id, k, term, w AS x FROM m{n} JOIN a{n} USING (set_id, k, i)"),
        f"b{n} AS (SELECT set_id, k, i FROM ta{n} WHERE (set_id, k, i) NOT IN (SELECT (set_id, k, i) FROM a{n}) QUALIFY row_number() OVER (PARTITION BY set_id, k ORDER BY round(s, 9), i) = 1)",
        sims(f"tb{n}", f"SELECT set_id, k, term, w AS x FROM m{n} JOIN b{n} USING (set_id, k, i)"),
        f"sd{n} AS (SELECT x.set_id, x.k, x.i, CASE WHEN b.i IS NOT NULL OR round(y.s, 9) > round(x.s, 9) THEN 1 ELSE 0 END AS side FROM ta{n} x JOIN tb{n} y USING (set_id, k, i) LEFT JOIN b{n} b USING (set_id, k, i))",
        sums(f"su{n}", f"sd{n}"), lens(f"le{n}", f"su{n}"),
        f"si{n} AS (SELECT m.set_id, m.k, m.i, s.side, round(sum(m.w * s.x) / any_value(l.len), 9) AS s FROM m{n} m JOIN su{n} s USING (set_id, k, term) JOIN le{n} l ON l.set_id = m.set_id AND l.k = m.k AND l.side = s.side GROUP BY ALL)",
        f"be{n} AS (SELECT set_id, k, i, side FROM si{n} QUALIFY row_number() OVER (PARTITION BY set_id, k, i ORDER BY s DESC, side) = 1)",
        sums(f"sv{n}", f"be{n}"), lens(f"lf{n}", f"sv{n}"),
        f"to{n} AS (SELECT set_id, k, sum(len) AS total FROM le{n} GROUP BY ALL)", f"tp{n} AS (SELECT set_id, k, sum(len) AS total FROM lf{n} GROUP BY ALL)",
        f"ro{n} AS (SELECT t.set_id, t.k, round(p.total, 9) > round(t.total, 9) AS rose, round(greatest(CASE WHEN round(p.total, 9) > round(t.total, 9) THEN p.total ELSE t.total END) - w.len, 9) AS gain FROM to{n} t JOIN tp{n} p USING (set_id, k) JOIN (SELECT set_id, k, sqrt(sum(x * x)) AS len FROM wh{n} GROUP BY ALL) w USING (set_id, k))",
        f"hv{n} AS (SELECT s.set_id, s.k, s.i, CASE WHEN r.rose THEN b.side ELSE s.side END AS side, gain FROM sd{n} s JOIN be{n} b USING (set_id, k, i) JOIN ro{n} r ON r.set_id = s.set_id AND r.k = s.k" + (f" UNION ALL FROM {kept}" if kept else "") + ")",
    ]


def _bisection_sql(levels: int) -> str:
    parts = [_UNIT, _MEMBERS, "want AS (SELECT set_id, greatest(1, floor(0.2 * count(*) + 0.5)) AS most FROM mem GROUP BY 1)", "cl0 AS (SELECT set_id, i, 0 AS k FROM mem)", "fr0 AS (SELECT c.* FROM cl0 c JOIN want USING (set_id) WHERE most > 1)"]
    for n in range(levels):
        parts += _halves_sql(n, f"fr{n}", f"ke{n}" if n else None)
        parts += [
            f"bs{n} AS (SELECT set_id, k FROM (SELECT DISTINCT set_id, k, gain FROM hv{n} WHERE gain > 0) JOIN want USING (set_id) WHERE most > {n + 1} QUALIFY row_number() OVER (PARTITION BY set_id ORDER BY gain DESC, k) = 1)",
            f"cu{n} AS (SELECT set_id, i, side FROM hv{n} JOIN bs{n} USING (set_id, k))",
            f"cl{n + 1} AS (SELECT c.set_id, c.i, CASE WHEN side = 1 THEN {n + 1} ELSE k END AS k FROM cl{n} c LEFT JOIN cu{n} USING (set_id, i))",
            f"ke{n + 1} AS (SELECT h.* FROM hv{n} h WHERE (set_id, k) NOT IN (SELECT (set_id, k) FROM bs{n}))",
            f"fr{n + 1} AS (SELECT c.* FROM cl{n + 1} c JOIN cu{n} USING (set_id, i))",
        ]
    return Q.cte(Q.tfidf(False), *parts) + f"SELECT set_id, i AS sent_idx, k::INT AS k FROM cl{levels}"


@query(_bisection_sql(2))
def cluster_bisection(spark, d):
    """The first two levels of repeated bisection of every document's sentences: three clusters at most."""
    return V.document_bisection(docs_of(spark, d), PLAIN, STOP, levels=2)
