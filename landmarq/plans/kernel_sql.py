"""SQL of the queries whose numbers are long sums: random features, matrix factors, greedy selections.

Features come from digests and first members from ``shuffle_key``, so another
engine can work them out. A Cholesky factor is one recursion over its columns,
a greedy selection one over its picks; each row carries its own numbers along.
"""

from __future__ import annotations

from .queries import D2, NOISE, VECTORS, key_sql

#: As in ``numeric``.
K, FEATURES, CANDIDATES = 40, 128, 12


def dot(a: str, b: str) -> str:
    return f"list_dot_product({a}, {b})"


def bandwidth(sample: int = 500) -> str:
    """``bw``: half the median squared distance of a sample's pairs."""
    return f"""bx AS (SELECT unit_id, vec FROM v ORDER BY {key_sql('0', 'unit_id')}, unit_id LIMIT {sample}),
    bd AS (SELECT {D2.format(a='a.vec', b='b.vec')} AS d FROM bx a, bx b WHERE a.unit_id < b.unit_id),
    bw AS MATERIALIZED (SELECT quantile_cont(d, 0.5) / 2 AS s FROM bd WHERE d > 0)"""


def features(count: int, seed: int = 0) -> str:
    """``phi``: each unit's random features as a list."""
    part = lambda p: f"(('0x' || substr(md5(concat_ws('|', '{seed}', i, j, '{p}')), 1, 8))::BIGINT + 0.5) / 4294967296"
    return f"""{VECTORS}, {bandwidth()},
    wij AS (SELECT i, j, sqrt(-2 * ln({part('a')})) * cos(2 * pi() * ({part('b')})) / sqrt((SELECT s FROM bw)) AS w FROM range(64) a(i), range({count}) b(j)),
    wj AS MATERIALIZED (SELECT j, list(w ORDER BY i) AS w, 2 * pi() * ((('0x' || substr(md5(concat_ws('|', '{seed}', j, 'c')), 1, 8))::BIGINT + 0.5) / 4294967296) AS b FROM wij GROUP BY j),
    phi AS MATERIALIZED (SELECT unit_id, grp, list(sqrt(2 / {count}) * cos({dot('vec', 'w')} + b) ORDER BY j) AS p FROM v, wj GROUP BY unit_id, grp)"""


def candidates(k: int = K, count: int = CANDIDATES) -> str:
    return f"cand AS (SELECT c AS candidate, unit_id, row_number() OVER (PARTITION BY c ORDER BY {key_sql('1', 'c', 'unit_id')}, unit_id) AS place FROM v, range({count}) r(c) QUALIFY place <= {k})"


MEANS = "mean AS (SELECT list(m ORDER BY j) AS m FROM (SELECT j, avg(x) AS m FROM (SELECT unnest(range(len(p))) AS j, unnest(p) AS x FROM phi) GROUP BY j))"


def mmd_candidates(digits: int = 6) -> str:
    return f"""WITH {features(FEATURES)}, {candidates()}, e AS (SELECT unit_id, unnest(range({FEATURES})) AS j, unnest(p) AS x FROM phi), w AS (SELECT j, avg(x) AS m FROM e GROUP BY j),
    c AS (SELECT candidate, j, avg(x) AS m FROM e JOIN cand USING (unit_id) GROUP BY ALL)
    SELECT candidate, round(sum((c.m - w.m) * (c.m - w.m)), {digits}) AS mmd2 FROM c JOIN w USING (j) GROUP BY candidate"""


def _plain_mmd(count: int) -> str:
    return f"""(WITH {features(count)}, {candidates()}, e AS (SELECT unit_id, unnest(range({count})) AS j, unnest(p) AS x FROM phi), w AS (SELECT j, avg(x) AS m FROM e GROUP BY j),
    c AS (SELECT candidate, j, avg(x) AS m FROM e JOIN cand USING (unit_id) GROUP BY ALL) SELECT candidate, sum((c.m - w.m) * (c.m - w.m)) AS mmd2 FROM c JOIN w USING (j) GROUP BY candidate)"""


def proxy_stability(counts: tuple[int, ...] = (32, 256), reference: int = 1024) -> str:
    """Rank correlations of coarser feature maps' discrepancies with a fine map's."""
    parts = [f"SELECT {m} AS features, a.mmd2 AS x, b.mmd2 AS y FROM {_plain_mmd(m)} a JOIN {_plain_mmd(reference)} b USING (candidate)" for m in counts]
    return f"""WITH p AS ({' UNION ALL '.join(parts)}), k AS (SELECT features, rank() OVER (PARTITION BY features ORDER BY x) AS a, rank() OVER (PARTITION BY features ORDER BY y) AS b FROM p)
    SELECT features::BIGINT AS features, count(*) AS n, round(corr(a, b), 6) AS rho FROM k GROUP BY features"""


def mmd_two_samples() -> str:
    sample = lambda seed: f"(SELECT unit_id FROM v ORDER BY {key_sql(seed, 'unit_id')}, unit_id LIMIT {K})"
    return f"""WITH {features(FEATURES)}, e AS (SELECT unit_id, unnest(range({FEATURES})) AS j, unnest(p) AS x FROM phi),
    g AS (SELECT j, avg(x) FILTER (unit_id IN {sample('1')}) - avg(x) FILTER (unit_id IN {sample('2')}) AS d FROM e GROUP BY j) SELECT 'mmd2' AS metric, round(sum(d * d), 6) AS value FROM g"""


def symmetric_kl_candidates() -> str:
    return f"""WITH {VECTORS}, {candidates()}, e AS (SELECT unit_id, unnest(range(64)) AS i, unnest(vec) AS x FROM v), w AS (SELECT i, avg(x) AS m, greatest(var_pop(x), 1e-9) AS s FROM e GROUP BY i),
    c AS (SELECT candidate, i, avg(x) AS m, greatest(var_pop(x), 1e-9) AS s FROM e JOIN cand USING (unit_id) GROUP BY ALL)
    SELECT candidate, round(sum(c.s / w.s + w.s / c.s - 2 + (c.m - w.m) * (c.m - w.m) * (1 / c.s + 1 / w.s)) / 2, 4) AS skl FROM c JOIN w USING (i) GROUP BY candidate"""


def log_determinants() -> str:
    """Column after column of each candidate's Cholesky factor; the determinant is the product of its squared diagonal."""
    return f"""WITH RECURSIVE {VECTORS}, {bandwidth()}, {candidates()},
    km AS MATERIALIZED (SELECT a.candidate, a.place AS i, b.place AS j, exp(-{D2.format(a='x.vec', b='y.vec')} / (2 * (SELECT s FROM bw))) + CASE WHEN a.place = b.place THEN 1e-6 ELSE 0 END AS x
        FROM cand a JOIN cand b USING (candidate) JOIN v x ON x.unit_id = a.unit_id JOIN v y ON y.unit_id = b.unit_id),
    f(step, candidate, i, l) AS (
        SELECT 0, candidate, place, []::DOUBLE[] FROM cand
        UNION ALL
        SELECT f.step + 1, f.candidate, f.i, list_append(f.l, (km.x - CASE WHEN f.step = 0 THEN 0 ELSE {dot('f.l', 'q.l')} END) / sqrt(d.x - CASE WHEN f.step = 0 THEN 0 ELSE {dot('q.l', 'q.l')} END))
        FROM f JOIN f q ON q.candidate = f.candidate AND q.i = f.step + 1 JOIN km ON km.candidate = f.candidate AND km.i = f.i AND km.j = f.step + 1 JOIN km d ON d.candidate = f.candidate AND d.i = f.step + 1 AND d.j = f.step + 1
        WHERE f.step < {K})
    SELECT candidate, round(-2 * sum(ln(l[i])), 4) AS logdet FROM f WHERE step = {K} GROUP BY candidate"""


def leverage(count: int = FEATURES, seed: int = 0, by: str = "", penalty: str = "1e-3") -> str:
    """``lev``: each unit's ridge leverage, from the Cholesky factor L of the Gram matrix and L⁻¹φ; both grow a column at a time. ``by``: separate matrices for each ``grp``."""
    group = "grp" if by else "0"
    return f"""{features(count, seed)}, e AS MATERIALIZED (SELECT {group} AS g, unit_id, unnest(range({count})) AS j, unnest(p) AS x FROM phi),
    gram AS MATERIALIZED (SELECT a.g, a.j AS i, b.j, sum(a.x * b.x) + CASE WHEN a.j = b.j THEN {penalty} ELSE 0 END AS x FROM e a JOIN e b ON b.g = a.g AND b.unit_id = a.unit_id GROUP BY a.g, a.j, b.j),
    mrows AS MATERIALIZED (SELECT g, -1 - i AS r, list(x ORDER BY j) AS a FROM gram GROUP BY g, i UNION ALL SELECT {group}, unit_id, p FROM phi),
    f(step, g, r, l) AS (
        SELECT 0, g, r, []::DOUBLE[] FROM mrows
        UNION ALL
        SELECT f.step + 1, f.g, f.r, list_append(f.l, (m.a[f.step + 1] - CASE WHEN f.step = 0 THEN 0 ELSE {dot('f.l', 'q.l')} END) / sqrt(d.a[f.step + 1] - CASE WHEN f.step = 0 THEN 0 ELSE {dot('q.l', 'q.l')} END))
        FROM f JOIN f q ON q.g = f.g AND q.r = -1 - f.step JOIN mrows m ON m.g = f.g AND m.r = f.r JOIN mrows d ON d.g = f.g AND d.r = -1 - f.step WHERE f.step < {count}),
    lev AS MATERIALIZED (SELECT r AS unit_id, greatest({dot('l', 'l')}, 1e-12) AS leverage FROM f WHERE step = {count} AND r >= 0)"""


def leverage_scores() -> str:
    return f"WITH RECURSIVE {leverage()} SELECT unit_id, round(leverage, 5) AS leverage FROM lev"


def leverage_draw(seed: int = 0) -> str:
    return f"WITH RECURSIVE {leverage(FEATURES, seed)} SELECT l.unit_id, v.grp::BIGINT AS grp, round(leverage, 5) AS leverage FROM lev l JOIN v USING (unit_id) ORDER BY ln(leverage) + ({NOISE.format(key=key_sql(str(seed), 'unit_id'))}) DESC, unit_id LIMIT {K}"


def quotas(k: int = K) -> str:
    """``want``: each label's quota of ``k``."""
    return f"""sh AS (SELECT grp, count(*) AS n, count(*) / (SELECT count(*) FROM v) AS pi FROM v GROUP BY grp), bo AS (SELECT *, CASE WHEN {k} >= (SELECT count(*) FROM sh) THEN 1 ELSE 0 END AS lb, least(n, {k}) AS ub FROM sh),
    sp AS (SELECT grp, t, pi * (ln(t + 2) - ln(t + 1)) AS gain FROM bo, range(0, {k}) r(t) WHERE t >= lb AND t < ub), be AS (SELECT grp FROM sp ORDER BY gain DESC, grp, t LIMIT ({k} - (SELECT sum(lb) FROM bo))),
    want AS MATERIALIZED (SELECT grp AS g, lb + (SELECT count(*) FROM be x WHERE x.grp = b.grp) AS c FROM bo b)"""


def _groups(by_quota: bool, k: int = K) -> tuple[str, str, str]:
    """The table of wanted counts, what names a row's group, and the most picks of a group."""
    return (quotas(k), "grp", "(SELECT max(c) FROM want)") if by_quota else (f"want AS (SELECT 0 AS g, {k} AS c)", "0", str(k))


def uniform(by_quota: bool) -> str:
    want, group, _ = _groups(by_quota)
    return f"WITH {VECTORS}, {want} SELECT unit_id, grp::BIGINT AS grp FROM (SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY {key_sql('3', 'unit_id')}, unit_id) AS place FROM v) x JOIN want ON want.g = {group} WHERE place <= c"


def farthest(by_quota: bool) -> str:
    """A chosen unit's distance is -1; each step lowers the others' to that from the newest."""
    want, group, most = _groups(by_quota)
    return f"""WITH RECURSIVE {VECTORS}, {want}, u AS MATERIALIZED (SELECT {group} AS g, unit_id, vec, {key_sql('3', 'unit_id')} AS key FROM v),
    f(step, g, unit_id, near) AS (
        SELECT 1, u.g, u.unit_id, CASE WHEN u.unit_id = s.unit_id THEN -1 ELSE {D2.format(a='u.vec', b='s.vec')} END FROM u JOIN (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY g ORDER BY key, unit_id) = 1) s USING (g)
        UNION ALL
        SELECT f.step + 1, f.g, f.unit_id, CASE WHEN f.step >= want.c THEN f.near WHEN f.unit_id = s.unit_id THEN -1 ELSE least(f.near, {D2.format(a='u.vec', b='s.vec')}) END
        FROM f JOIN want USING (g) JOIN u USING (unit_id) JOIN (SELECT x.g, x.unit_id, y.vec FROM (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY g ORDER BY near DESC, unit_id) = 1) x JOIN u y USING (unit_id)) s ON s.g = f.g
        WHERE f.step < {most})
    SELECT f.unit_id, v.grp::BIGINT AS grp FROM f JOIN v USING (unit_id) WHERE step = {most} AND near = -1"""


def plus_plus(by_quota: bool, k: int = K, seed: int = 3) -> str:
    """Each step draws a unit by its squared distance from the nearest chosen one: the largest of its logarithm and noise."""
    want, group, most = _groups(by_quota, k)
    noise = NOISE.format(key=f"md5(concat_ws('|', '{seed}', f.step, f.unit_id))")
    return f"""WITH RECURSIVE {VECTORS}, {want}, u AS MATERIALIZED (SELECT {group} AS g, unit_id, vec, {key_sql(str(seed), 'unit_id')} AS key FROM v),
    f(step, g, unit_id, near) AS (
        SELECT 1, u.g, u.unit_id, CASE WHEN u.unit_id = s.unit_id THEN -1 ELSE {D2.format(a='u.vec', b='s.vec')} END FROM u JOIN (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY g ORDER BY key, unit_id) = 1) s USING (g)
        UNION ALL
        SELECT f.step + 1, f.g, f.unit_id, CASE WHEN f.step >= want.c THEN f.near WHEN f.unit_id = s.unit_id THEN -1 ELSE least(f.near, {D2.format(a='u.vec', b='s.vec')}) END
        FROM f JOIN want USING (g) JOIN u USING (unit_id) JOIN (SELECT x.g, x.unit_id, y.vec FROM (SELECT f.g, f.unit_id FROM f WHERE near > 0 QUALIFY row_number() OVER (PARTITION BY f.g ORDER BY ln(near) + ({noise}) DESC, f.unit_id) = 1) x JOIN u y USING (unit_id)) s ON s.g = f.g
        WHERE f.step < {most})
    SELECT f.unit_id, v.grp::BIGINT AS grp FROM f JOIN v USING (unit_id) WHERE step = {most} AND near = -1"""


_NEAR = f"SELECT u.g, u.unit_id, any_value(u.vec) AS vec, arg_min(c.i, {D2.format(a='u.vec', b='c.vec')}) AS i FROM u JOIN c USING (g) GROUP BY u.g, u.unit_id"


def _centres(by_quota: bool, k: int = K, seed: int = 3) -> str:
    """``last``: centres that moved fifty times from the seeds to the means of their units."""
    head, _, _ = plus_plus(by_quota, k, seed).rpartition("SELECT f.unit_id, v.grp")
    most = _groups(by_quota, k)[2]
    return f"""{head}, seeds AS MATERIALIZED (SELECT f.g, unit_id AS i, vec FROM f JOIN u USING (unit_id) WHERE step = {most} AND near = -1),
    c(step, g, i, vec) AS (
        SELECT 0, g, i, vec FROM seeds
        UNION ALL
        SELECT c.step + 1, c.g, c.i, coalesce(m.vec, c.vec) FROM c LEFT JOIN (
            SELECT g, i, list(x ORDER BY j) AS vec FROM (SELECT g, i, j, avg(x) AS x FROM (SELECT g, i, unnest(range(64)) AS j, unnest(vec) AS x FROM ({_NEAR})) GROUP BY g, i, j) GROUP BY g, i) m ON m.g = c.g AND m.i = c.i
        WHERE c.step < 50),
    last AS MATERIALIZED (SELECT g, i, vec FROM c WHERE step = 50), held AS MATERIALIZED ({_NEAR.replace("JOIN c", "JOIN last c")})"""


def kmeans(by_quota: bool) -> str:
    """The unit nearest each centre, filled up by key."""
    return f"""{_centres(by_quota)},
    picks AS MATERIALIZED (SELECT h.unit_id FROM held h JOIN last l ON l.g = h.g AND l.i = h.i QUALIFY row_number() OVER (PARTITION BY h.g, h.i ORDER BY {D2.format(a='h.vec', b='l.vec')}, h.unit_id) = 1)
    SELECT unit_id, grp::BIGINT AS grp FROM (SELECT u.g, u.unit_id, row_number() OVER (PARTITION BY u.g ORDER BY (p.unit_id IS NULL), u.key, u.unit_id) AS place FROM u LEFT JOIN picks p ON p.unit_id = u.unit_id) z JOIN want USING (g) JOIN v USING (unit_id) WHERE place <= want.c"""


def sinkhorn(anchors: int = 32, blur: float = 0.05) -> str:
    """Transport between candidates and weighted anchors: potentials of all problems at once, a pair of updates a step, until they rest."""
    lse = lambda other, cost, logs: f"list_transform(list_transform({cost}, lambda r: list_transform(range(len(r)), lambda k: ({other}[k + 1] - r[k + 1]) / {blur} + {logs}[k + 1])), lambda q: [list_max(q), list_sum(list_transform(q, lambda z: exp(z - list_max(q))))])"
    update = lambda other, cost, logs: f"list_transform({lse(other, cost, logs)}, lambda m: -{blur} * (m[1] + ln(m[2])))"
    matrix = lambda pid, rows, columns, on="": f"SELECT {pid} AS pid, a.k AS i, list({D2.format(a='a.vec', b='b.vec')} / (SELECT s FROM sc) ORDER BY b.k) AS r, any_value(a.w) AS w, list(b.w ORDER BY b.k) AS ws FROM {rows} a, {columns} b {on} GROUP BY ALL"
    return f"""{_centres(False, anchors, 0)}, {candidates()},
    an AS MATERIALIZED (SELECT row_number() OVER (ORDER BY l.i) AS k, l.vec, (SELECT count(*) FROM held h WHERE h.i = l.i) / (SELECT count(*) FROM held) AS w FROM last l),
    sc AS MATERIALIZED (SELECT median(d) AS s FROM (SELECT {D2.format(a='a.vec', b='b.vec')} AS d FROM an a, an b) WHERE d > 0),
    cu AS MATERIALIZED (SELECT candidate, place AS k, vec, 1 / {K} AS w FROM cand JOIN v USING (unit_id)),
    rows_of AS ({matrix("'o'", 'an', 'an')} UNION ALL {matrix("'a' || b.candidate", 'an', 'cu')} UNION ALL {matrix("'s' || a.candidate", 'cu', 'cu', 'WHERE a.candidate = b.candidate')}),
    pr AS MATERIALIZED (SELECT pid, list(r ORDER BY i) AS c, list(ln(greatest(w, 1e-300)) ORDER BY i) AS la, list_transform(any_value(ws), lambda x: ln(greatest(x, 1e-300))) AS lb FROM rows_of GROUP BY pid),
    pt AS MATERIALIZED (SELECT *, list_transform(range(len(lb)), lambda j: list_transform(c, lambda r: r[j + 1])) AS ct FROM pr),
    p(step, pid, f, g, moved) AS (
        SELECT 0, pid, list_transform(la, lambda x: 0.0::DOUBLE), list_transform(lb, lambda x: 0.0::DOUBLE), 1e9::DOUBLE FROM pt
        UNION ALL
        SELECT step + 1, pid, f2, {update('f2', 'ct', 'la')}, list_max(list_transform(list_zip(f, f2), lambda z: abs(z[1] - z[2]))) FROM (
            SELECT p.*, pt.ct, pt.la, {update('p.g', 'pt.c', 'pt.lb')} AS f2 FROM p JOIN pt USING (pid) WHERE p.step < 100 AND p.moved >= 1e-6) y),
    e AS (SELECT p.pid, list_sum(list_transform(range(len(p.f)), lambda i: list_sum(list_transform(range(len(p.g)), lambda j: exp((p.f[i + 1] + p.g[j + 1] - pt.c[i + 1][j + 1]) / {blur} + pt.la[i + 1] + pt.lb[j + 1]) * pt.c[i + 1][j + 1])))) AS cost
        FROM p JOIN pt USING (pid) WHERE p.step = (SELECT max(step) FROM p z WHERE z.pid = p.pid))
    SELECT candidate, round(greatest(0, (SELECT cost FROM e WHERE pid = 'a' || candidate) - 0.5 * (SELECT cost FROM e WHERE pid = 's' || candidate) - 0.5 * (SELECT cost FROM e WHERE pid = 'o')), 4) AS sinkhorn FROM (SELECT DISTINCT candidate FROM cand)"""


def global_then_quota() -> str:
    """Herding of twice as many units, brought to the quotas: chosen ones first, then others by key."""
    head, _, _ = herding(False, 2 * K).rpartition("SELECT f.unit_id, v.grp")
    wanted = quotas().replace("want AS", "wq AS")
    return f"""{head}, {wanted}, h AS (SELECT unit_id FROM f WHERE step = {2 * K} AND taken)
    SELECT unit_id, grp::BIGINT AS grp FROM (SELECT v.*, row_number() OVER (PARTITION BY grp ORDER BY (h.unit_id IS NULL), {key_sql('3', 'v.unit_id')}, v.unit_id) AS place FROM v LEFT JOIN h ON h.unit_id = v.unit_id) x JOIN wq ON wq.g = x.grp WHERE place <= wq.c"""


def herding(by_quota: bool, k: int = K) -> str:
    """Each step takes the unit whose inner product with the mean, t + 1 times, exceeds that with all chosen ones most."""
    want, group, most = _groups(by_quota, k)
    return f"""WITH RECURSIVE {features(256, 3)}, {want}, e AS (SELECT {group} AS g, unnest(range(256)) AS j, unnest(p) AS x FROM phi), mean AS (SELECT g, list(m ORDER BY j) AS m FROM (SELECT g, j, avg(x) AS m FROM e GROUP BY ALL) GROUP BY g),
    u AS MATERIALIZED (SELECT {group} AS g, unit_id, p, {dot('p', 'm')} AS pull FROM phi JOIN mean ON mean.g = {group}),
    f(step, g, unit_id, held, taken) AS (
        SELECT 0, g, unit_id, 0.0::DOUBLE, false FROM u
        UNION ALL
        SELECT f.step + 1, f.g, f.unit_id, f.held + {dot('u.p', 's.p')}, f.taken OR (f.step < want.c AND f.unit_id = s.unit_id)
        FROM f JOIN want USING (g) JOIN u USING (unit_id) JOIN (
            SELECT x.g, x.unit_id, y.p FROM (SELECT f.g, f.unit_id FROM f JOIN u USING (unit_id) WHERE NOT taken QUALIFY row_number() OVER (PARTITION BY f.g ORDER BY (f.step + 1) * u.pull - f.held DESC, f.unit_id) = 1) x JOIN u y USING (unit_id)) s ON s.g = f.g
        WHERE f.step < {most})
    SELECT f.unit_id, v.grp::BIGINT AS grp FROM f JOIN v USING (unit_id) WHERE step = {most} AND taken"""


def determinantal(by_quota: bool) -> str:
    """Pivoted Cholesky factor of the features' inner products: each step takes the largest rest."""
    want, group, most = _groups(by_quota)
    return f"""WITH RECURSIVE {features(256, 3)}, {want}, u AS MATERIALIZED (SELECT {group} AS g, unit_id, p FROM phi),
    f(step, g, unit_id, rest, l, taken) AS (
        SELECT 0, g, unit_id, {dot('p', 'p')}, []::DOUBLE[], false FROM u
        UNION ALL
        SELECT step + 1, g, unit_id, greatest(rest - c * c, 0), list_append(l, c), taken OR now FROM (
            SELECT f.*, f.step < want.c AND f.unit_id = s.unit_id AS now, ({dot('u.p', 's.p')} - CASE WHEN f.step = 0 THEN 0 ELSE {dot('f.l', 's.l')} END) / sqrt(s.rest) AS c
            FROM f JOIN want USING (g) JOIN u USING (unit_id) JOIN (
                SELECT x.g, x.unit_id, x.rest, x.l, y.p FROM (SELECT * FROM f WHERE NOT taken QUALIFY row_number() OVER (PARTITION BY g ORDER BY rest DESC, unit_id) = 1) x JOIN u y USING (unit_id)) s ON s.g = f.g
            WHERE f.step < {most}) z)
    SELECT f.unit_id, v.grp::BIGINT AS grp FROM f JOIN v USING (unit_id) WHERE step = {most} AND taken"""


def leverage_select(by_quota: bool) -> str:
    want, group, _ = _groups(by_quota)
    return f"""WITH RECURSIVE {leverage(256, 3, 'grp' if by_quota else '')}, {want} SELECT unit_id, grp::BIGINT AS grp FROM (
        SELECT v.unit_id, v.grp, row_number() OVER (PARTITION BY {'v.grp' if by_quota else '0'} ORDER BY ln(leverage) + ({NOISE.format(key=key_sql('3', 'v.unit_id'))}) DESC, v.unit_id) AS place FROM lev JOIN v USING (unit_id)) x JOIN want ON want.g = {group} WHERE place <= c"""


def _eigen(d: int = 64, sweeps: int = 9) -> str:
    """``lam``: eigenvalues and directions of the covariance by Jacobi rotations, d / 2 disjoint ones at each step, all pairs once in a sweep."""
    other = lambda i: f"(CASE WHEN {i} = {d - 1} THEN x.step % {d - 1} WHEN {i} = x.step % {d - 1} THEN {d - 1} ELSE (2 * (x.step % {d - 1}) - {i} + {d - 1}) % {d - 1} END)"
    return f"""{VECTORS}, e AS (SELECT unit_id, unnest(range({d})) AS i, unnest(vec) AS x FROM v), mean AS MATERIALIZED (SELECT list(m ORDER BY i) AS m FROM (SELECT i, avg(x) AS m FROM e GROUP BY i)),
    cov AS (SELECT a.i, b.i AS j, covar_samp(a.x, b.x) AS x FROM e a JOIN e b USING (unit_id) GROUP BY a.i, b.i),
    j(step, i, a, v) AS (
        SELECT 0::BIGINT, i, list(x ORDER BY j), list(CASE WHEN i = j THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END ORDER BY j) FROM cov GROUP BY i
        UNION ALL
        SELECT step + 1, i, list_transform(range({d}), lambda k: cs[k + 1] * u[k + 1] + ss[k + 1] * u[ps[k + 1] + 1]), list_transform(range({d}), lambda k: cs[k + 1] * v[k + 1] + ss[k + 1] * v[ps[k + 1] + 1]) FROM (
            SELECT x.step, x.i, x.v, r.cs, r.ss, r.ps, list_transform(range({d}), lambda k: r.cs[x.i + 1] * x.a[k + 1] + r.ss[x.i + 1] * y.a[k + 1]) AS u
            FROM j x JOIN j y ON y.i = {other('x.i')}, (
                SELECT list(1 / sqrt(t * t + 1) ORDER BY i) AS cs, list(CASE WHEN i < o THEN -t ELSE t END / sqrt(t * t + 1) ORDER BY i) AS ss, list(o ORDER BY i) AS ps FROM (
                    SELECT i, o, CASE WHEN apq = 0 THEN 0 ELSE (CASE WHEN h < 0 THEN -1 ELSE 1 END) / (abs(h) + sqrt(h * h + 1)) END AS t FROM (
                        SELECT i, o, apq, CASE WHEN apq = 0 THEN 0 ELSE (aqq - app) / (2 * apq) END AS h FROM (
                            SELECT x.i, y.i AS o, x.a[y.i + 1] AS apq, CASE WHEN x.i < y.i THEN x.a[x.i + 1] ELSE y.a[y.i + 1] END AS app, CASE WHEN x.i < y.i THEN y.a[y.i + 1] ELSE x.a[x.i + 1] END AS aqq
                            FROM j x JOIN j y ON y.i = {other('x.i')})))) r
            WHERE x.step < {sweeps * (d - 1)}) z),
    done AS MATERIALIZED (SELECT i, a, v FROM j WHERE step = {sweeps * (d - 1)}),
    raw AS (SELECT c AS col, max(a[c + 1]) FILTER (i = c) AS value, list(v[c + 1] ORDER BY i) AS w FROM done, range({d}) r(c) GROUP BY c),
    lam AS MATERIALIZED (SELECT (SELECT count(*) FROM raw o WHERE o.value > raw.value) AS component, value, list_transform(w, lambda x: x * CASE WHEN list_max(w) >= -list_min(w) THEN 1 ELSE -1 END) AS w FROM raw)"""


def explained_variance(count: int = 16) -> str:
    return f"""WITH RECURSIVE {_eigen()}, s AS (SELECT component, greatest(value, 0) / (SELECT sum(greatest(value, 0)) FROM lam) AS share FROM lam)
    SELECT component, round(share, 6) AS share, round(sum(share) OVER (ORDER BY component), 6) AS running FROM s QUALIFY component < {count}"""


def components(count: int) -> str:
    return f"WITH RECURSIVE {_eigen()} SELECT unit_id, component, round({dot('vec', 'w')} - {dot('m', 'w')}, 5) AS value FROM v, lam, mean WHERE component < {count}"


def objective_table() -> str:
    return f"SELECT candidate, mmd2, sinkhorn, skl, logdet FROM ({mmd_candidates(4)}) JOIN ({sinkhorn()}) USING (candidate) JOIN ({symmetric_kl_candidates()}) USING (candidate) JOIN ({log_determinants()}) USING (candidate)"


def objectives_with_shares() -> str:
    """Discrepancy and transport with the divergence of smoothed label shares."""
    kl = f"""WITH {VECTORS}, {candidates()}, sh AS (SELECT grp, count(*) / (SELECT count(*) FROM v) AS pi FROM v GROUP BY grp),
    n AS (SELECT c.candidate, sh.grp, sh.pi, count(x.unit_id) AS c FROM (SELECT DISTINCT candidate FROM cand) c CROSS JOIN sh LEFT JOIN (SELECT candidate, unit_id, grp FROM cand JOIN v USING (unit_id)) x ON x.candidate = c.candidate AND x.grp = sh.grp GROUP BY ALL)
    SELECT candidate, round(sum(pi * ln(pi / ((c + 1) / ({K} + (SELECT count(*) FROM sh))))), 4) AS kl FROM n GROUP BY candidate"""
    return f"SELECT candidate, mmd2, sinkhorn, kl FROM ({mmd_candidates(4)}) JOIN ({sinkhorn()}) USING (candidate) JOIN ({kl}) USING (candidate)"


ORACLE_SQL = {
    "objective_table": objective_table(), "objectives_with_shares": objectives_with_shares(),
    "sinkhorn_divergence": sinkhorn(), "explained_variance": explained_variance(), "principal_components": components(8), "incremental_components": components(4),
    "random_feature_mmd": mmd_candidates(), "mmd_between_selections": mmd_two_samples(), "candidate_symmetric_kl": symmetric_kl_candidates(), "log_determinant": log_determinants(), "leverage_scores": leverage_scores(), "leverage_selection": leverage_draw(),
    **{f"select_{name}{'_quota' * q}": make(bool(q)) for name, make in (("uniform", uniform), ("farthest", farthest), ("herding", herding), ("determinantal", determinantal), ("leverage", leverage_select), ("plus_plus", plus_plus), ("kmeans", kmeans)) for q in (0, 1)},
    "proxy_stability": proxy_stability(), "select_global_then_quota": global_then_quota(),
    "selection_times": "SELECT method, k::BIGINT AS k, 0::BIGINT AS repeat, true AS timed FROM (VALUES ('uniform'), ('farthest')) m(method), (VALUES (10), (40)) s(k)",
}
