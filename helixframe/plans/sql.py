"""SQL twins of the relational operators, for DuckDB over the same tables."""

from __future__ import annotations

from helixframe.config import EngineConfig
from helixframe.operators.spectrum import WEIGHT_STEPS
from helixframe.sources.reads import reads_sql

K = 15
READS = reads_sql("duckdb")
CODE = "(instr('ACTG', {c}) - 1)"
RC = "translate(reverse({s}), 'ACGT', 'TGCA')"


def rc(s: str) -> str:
    return RC.format(s=s)


def packed(s: str, k: int) -> str:
    """The packed id of a string of k bases."""
    return "(" + " + ".join(f"(CAST(instr('ACTG', substr({s}, {i + 1}, 1)) - 1 AS BIGINT) << {2 * i})" for i in range(k)) + ")"


def kmers(k: int = K) -> str:
    """CTEs up to ``fwd`` (km, nx) and ``bwd`` (km, nx): k-mers without N of both strands, nx '' where there is no next base."""
    return f"""{READS},
places AS (SELECT read_id, i AS pos, substr(seq, i, {k}) AS km, substr(seq, i + {k}, 1) AS nx, CASE WHEN i > 1 THEN substr(seq, i - 1, 1) ELSE '' END AS px, i = 1 AS is_first, i = len - {k} + 1 AS is_last
  FROM (SELECT read_id, seq, len, unnest(range(1, len - {k} + 2)) AS i FROM reads WHERE len > {k})),
fwd AS (SELECT read_id, pos, km, CASE WHEN nx = 'N' THEN '' ELSE nx END AS nx, is_first, is_last FROM places WHERE instr(km, 'N') = 0),
bwd AS (SELECT {rc("km")} AS km, CASE WHEN px IN ('', 'N') THEN '' ELSE translate(px, 'ACGT', 'TGCA') END AS nx, is_last AS is_first, is_first AS is_last FROM places WHERE instr(km, 'N') = 0)"""


def spectrum(k: int = K) -> str:
    """``kmers`` and ``nodes`` (km, cnt0..3, rc_flag, status, n, own_flag, flag, n_trans, total, coverage)."""
    cnt = ", ".join(f"least(count(*) FILTER (NOT rc AND nx = '{b}'), 16383) AS cnt{i}" for i, b in enumerate("ACTG"))
    own = " + ".join(f"CASE WHEN cnt{i} > 0 THEN {1 << i} ELSE 0 END" for i in range(4))
    return f"""{kmers(k)},
seen AS (SELECT km, nx, false AS rc, is_first, is_last FROM fwd UNION ALL SELECT km, nx, true, is_first, is_last FROM bwd),
raw AS (SELECT km, {cnt},
    CAST(coalesce(bit_or(CASE WHEN rc AND nx <> '' THEN 1 << (instr('ACTG', nx) - 1) ELSE 0 END), 0) AS INTEGER) AS rc_flag,
    CAST(bit_or(CASE WHEN is_first THEN 1 WHEN is_last THEN 4 ELSE 2 END) AS INTEGER) AS status, count(*) FILTER (NOT rc) AS n
  FROM seen GROUP BY km),
own AS (SELECT *, {own} AS own_flag, cnt0 + cnt1 + cnt2 + cnt3 AS total FROM raw),
nodes AS (SELECT *, own_flag | rc_flag AS flag, CAST(bit_count(own_flag | rc_flag) AS INTEGER) AS n_trans, least(total, 1023) AS coverage FROM own)"""


EDGES = "edges AS (SELECT km, total, b, CASE b WHEN 0 THEN cnt0 WHEN 1 THEN cnt1 WHEN 2 THEN cnt2 ELSE cnt3 END AS cnt FROM nodes, range(4) t(b) WHERE (flag >> b) & 1 = 1)"
BASE = "substr('ACTG', CAST(b + 1 AS INTEGER), 1)"
PAIRS = f"""sides AS (SELECT km, {rc("km")} AS rkm, total, {packed("km", K)} AS kid, {packed(rc("km"), K)} AS rid FROM nodes),
pairs AS (SELECT least(kid, rid) AS canon,
    CASE WHEN bool_or(kid = rid) THEN 2 * sum(total) ELSE sum(total) END AS joint,
    CASE WHEN bool_or(kid = rid) THEN max(total) = 0 ELSE min(total) = 0 OR count(*) = 1 END AS single_stranded
  FROM sides GROUP BY 1)"""
HIST = "hist AS (SELECT CAST(least(joint, 1000) AS INTEGER) AS bin, count(*) AS n, sum(CAST(single_stranded AS BIGINT)) AS n_single FROM pairs GROUP BY 1)"
WEIGHTS = f"""quals AS (SELECT read_id, seq, len, qual, unnest(range(1, len - {K} + 1)) AS i FROM reads WHERE len > {K}),
weighted AS (SELECT substr(seq, i, {K}) AS km, substr(seq, i + {K}, 1) AS nx,
    list_reduce(list_transform(range({K + 1}), lambda j: 1 - pow(10, -(ascii(substr(qual, i + j, 1)) - 33) / 10.0)), lambda a, x: a * x) AS w
  FROM quals WHERE instr(substr(seq, i, {K + 1}), 'N') = 0),
weights AS (SELECT km, nx, CAST(sum(CAST(floor(w * {WEIGHT_STEPS}.0 + 0.5) AS BIGINT)) AS DOUBLE) / {WEIGHT_STEPS}.0 AS weight FROM weighted GROUP BY ALL)"""
ETA = """g AS (SELECT i AS bin, coalesce(n, 0) AS n FROM range(1001) t(i) LEFT JOIN hist ON bin = i),
valley AS (SELECT coalesce(min(a.bin), 1000) AS v FROM g a JOIN g b ON b.bin = a.bin + 1 WHERE a.bin >= 1 AND b.n > a.n),
peak AS (SELECT arg_max(bin, n * 2000 - bin) AS p, max(n) AS pn FROM g, valley WHERE bin >= v),
deeper AS (SELECT arg_min(bin, n * 2000 + bin) AS d, min(n) AS dn FROM g, valley, peak WHERE bin >= v AND bin < p AND n >= 100),
bottom AS (SELECT v, n AS vn FROM g JOIN valley ON bin = v),
chosen AS (SELECT p, pn, CASE WHEN dn < vn THEN d ELSE v END AS v, CASE WHEN dn < vn THEN dn ELSE vn END AS vn FROM peak, deeper, bottom),
thr AS (SELECT CASE WHEN p = 1000 OR pn - vn < 1000 OR v = 1 THEN 1.0 ELSE v / 2.0 END AS t FROM chosen)"""
#: 1 / gamma = 1e20; eta = ceil((thr + 0.1) * ln(1 + 1 / gamma) + 0.5).
LOG_GAMMA = "ln(1 + 1e20)"
XI = f"xi AS (SELECT e.km, e.b, coalesce(weight, 0.0) AS xi FROM edges e LEFT JOIN weights w ON w.km = e.km AND w.nx = {BASE})"
#: Penalised transitions at rho for eta = 26, gamma = 1e-20.
RHO = f"CAST({EngineConfig().rho(26)!r} AS DOUBLE)"


def soft(key: str = "km") -> str:
    """``grp``, ``rooted`` and ``soft`` (key, b, p) from ``xi`` (key, b, xi)."""
    return f"""grp AS (SELECT {key}, max(xi) AS most, count(*) AS n, list_sum(list_transform(list(xi ORDER BY b), lambda x: greatest(x - {RHO}, 0.0))) AS lam FROM xi GROUP BY {key}),
rooted AS (SELECT {key}, b, xi, CASE WHEN n = 1 THEN 1.0 WHEN most >= {RHO} AND lam > 0 THEN
     (sqrt((1e-20 * lam - xi + {RHO}) * (1e-20 * lam - xi + {RHO}) + 4 * lam * 1e-20 * xi) - (1e-20 * lam - xi + {RHO})) / (2 * lam)
     WHEN xi = most THEN 1.0 ELSE 0.0 END AS p FROM xi JOIN grp USING ({key})),
soft AS (SELECT {key}, b, p / sum(p) OVER (PARTITION BY {key}) AS p FROM rooted WHERE p > 0)"""


SOFT = soft()
#: Transitions by counted shares: ``pr`` (km, nx, p).
SHARES = f"pr AS MATERIALIZED (SELECT km, {BASE} AS nx, cnt / total AS p FROM edges WHERE total > 0 AND cnt > 0)"


def chain(first_qualities: int, right: float, cap: int, length: int) -> str:
    """``s0``..: the states of every read's trellis (read_id, km, hd, p: the sum over paths, b: the best path), and ``w1``..: its edges (read_id, u, nx, v, w, hd).

    First states are the observed k-mers; probabilities stay far above the smallest double for short reads. ``right``: the probability that a
    base is emitted right, qualities are even; cap: mismatches that a state may have after its first base.
    """
    q, wrong = 1 / first_qualities, (1 - right) / 3
    start = (right * q) ** K
    out = [f"s0 AS MATERIALIZED (SELECT read_id, substr(seq, 1, {K}) AS km, 0 AS hd, CAST({start!r} AS DOUBLE) AS p, CAST({start!r} AS DOUBLE) AS b FROM reads WHERE len > {K} AND substr(seq, 1, {K}) IN (SELECT km FROM pr))"]
    for t in range(1, length - K + 1):
        out.append(f"""w{t} AS MATERIALIZED (SELECT x.read_id, x.km AS u, pr.nx, substr(x.km, 2) || pr.nx AS v, x.p AS up, x.b AS ub, pr.p * CASE WHEN pr.nx = x.seen THEN {right!r} ELSE {wrong!r} END * {q!r} AS w, x.rest + CAST(pr.nx <> x.seen AS INTEGER) AS hd
  FROM (SELECT s.*, substr(r.seq, {t + K}, 1) AS seen, s.hd - CAST(substr(s.km, 1, 1) <> substr(r.seq, {t}, 1) AS INTEGER) AS rest FROM s{t - 1} s JOIN reads r USING (read_id)) x JOIN pr ON pr.km = x.km AND (x.rest < {cap} OR pr.nx = x.seen))""")
        out.append(f"s{t} AS MATERIALIZED (SELECT read_id, v AS km, any_value(hd) AS hd, sum(up * w) AS p, max(ub * w) AS b FROM w{t} GROUP BY read_id, v)")
    return ",\n".join(out)
