"""The same relations in plain SQL, as chains of common table expressions that DuckDB runs on the same tables."""

from __future__ import annotations

K, SIZE, SEED, RATE, DRAWS = 10, 8, 42, 0.5, 46
BASE, BOOST = 1.0, 0.5
#: Rounds that the SQL of whole descents spells out; the loops end sooner on the test tables.
ROUNDS, NET_ROUNDS = 12, 20


def uniform(tag: str, *keys: str, seed: int = SEED) -> str:
    key = ", ".join(f"CAST({k} AS VARCHAR)" for k in keys)
    return f"((CAST(CAST('0x' || substr(md5(concat_ws('|', '{seed}|{tag}', {key})), 1, 8) AS BIGINT) AS DOUBLE) + 1) / 4294967297.0)"


def normal(tag: str, *keys: str, seed: int = SEED) -> str:
    return f"(sqrt(-2.0 * ln({uniform(tag + '|a', *keys, seed=seed)})) * cos(6.283185307179586 * {uniform(tag + '|b', *keys, seed=seed)}))"


def dot(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1] * z[2]))"


def l2(a: str, b: str) -> str:
    return f"sqrt(list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1] - z[2]) * (z[1] - z[2]))))"


def l1(a: str, b: str) -> str:
    return f"list_sum(list_transform(list_zip({a}, {b}), lambda z: abs(z[1] - z[2])))"


def cosine(a: str, b: str) -> str:
    both = f"(sqrt({dot(a, a)}) * sqrt({dot(b, b)}))"
    return f"CASE WHEN {both} = 0 THEN 1.0 ELSE 1.0 - {dot(a, b)} / {both} END"


METRICS = {"l2": l2, "cosine": cosine, "l1": l1}


class Chain:
    """Collects named expressions; sql(query) puts them before it."""

    def __init__(self):
        self.parts: dict[str, str] = {}
        self.add("pts", "SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings")

    def add(self, name: str, body: str) -> Chain:
        self.parts[name] = body
        return self

    def sql(self, query: str) -> str:
        return "WITH " + ",\n".join(f"{n} AS MATERIALIZED (\n{b}\n)" for n, b in self.parts.items()) + "\n" + query

    def measured(self, name: str, pairs: str, metric: str = "l2") -> Chain:
        return self.add(name, f"SELECT e.p, e.q, {METRICS[metric]('x.vec', 'y.vec')} AS dist FROM ({pairs}) e JOIN pts x ON e.p = x.id JOIN pts y ON e.q = y.id")

    def init(self, metric: str = "l2") -> Chain:
        """b0"""
        self.add("dr", f"SELECT p, q, min(j) AS j FROM (SELECT id AS p, j, CAST(floor({uniform('init', 'id', 'j')} * (SELECT count(*) FROM pts)) AS BIGINT) AS q FROM pts, range({DRAWS}) t(j)) WHERE p <> q GROUP BY p, q")
        self.add("r0", f"SELECT p, q FROM (SELECT p, q, row_number() OVER (PARTITION BY p ORDER BY j) AS r FROM dr) WHERE r <= {K}")
        self.measured("m0", "SELECT p, q FROM r0", metric)
        return self.add("b0", "SELECT p, q, dist, true AS is_new FROM m0")

    def _merge(self, t: int, pairs: str) -> Chain:
        """b{t} from b{t-1} and the canonical pairs"""
        self.measured(f"m{t}", f"SELECT DISTINCT least(v, c) AS p, greatest(v, c) AS q FROM ({pairs})")
        return self.add(f"b{t}", f"""SELECT p, q, dist, is_new FROM (
  SELECT *, row_number() OVER (PARTITION BY p ORDER BY dist, is_new, q) AS r FROM (
    SELECT p, q, min(dist) AS dist, bool_and(is_new) AS is_new FROM (
      SELECT p, q, dist, false AS is_new FROM b{t - 1} UNION ALL SELECT p, q, dist, true FROM m{t} UNION ALL SELECT q, p, dist, true FROM m{t}
    ) WHERE p <> q GROUP BY p, q)) WHERE r <= {K}""")

    def naive(self, t: int) -> Chain:
        self.add(f"f{t}", f"SELECT a.p AS v, b.q AS c, a.q AS u FROM b{t - 1} a JOIN b{t - 1} b ON a.q = b.p WHERE b.q <> a.p")
        return self._merge(t, f"SELECT v, c FROM f{t}")

    def lists(self, t: int) -> Chain:
        return self.add(f"l{t}", f"SELECT p AS v, q AS u, is_new FROM b{t - 1} UNION SELECT q, p, is_new FROM b{t - 1}")

    def sample(self, t: int, counts: str | None = None) -> Chain:
        w = "1.0" if counts is None else f"({BASE} + {BOOST} * coalesce(s.freq, 0))"
        join = "" if counts is None else f"LEFT JOIN {counts} s ON l.v = s.v AND l.u = s.u"
        return self.add(f"s{t}", f"SELECT v, u, is_new FROM (SELECT l.v, l.u, l.is_new, row_number() OVER (PARTITION BY l.v, l.is_new ORDER BY -ln({uniform(f'rho|{t}', 'l.v', 'l.u')}) / {w}, l.u) AS r FROM l{t} l {join}) WHERE r <= {SIZE}")

    def hop(self, t: int) -> Chain:
        return self.add(f"f{t}", f"""SELECT f.* FROM (
  SELECT s.v, b.q AS c, s.u, false AS from_old FROM s{t} s JOIN b{t - 1} b ON s.u = b.p WHERE s.is_new
  UNION ALL SELECT s.v, n.u, s.u, true FROM s{t} s JOIN s{t} n ON s.u = n.v WHERE NOT s.is_new AND n.is_new
) f WHERE f.c <> f.v AND NOT EXISTS (SELECT 1 FROM b{t - 1} b WHERE b.p = f.v AND b.q = f.c)""")

    def candidates(self, t: int) -> Chain:
        return self.add(f"c{t}", f"SELECT v, c, min({{'o': from_old, 'u': u}}).u AS source FROM f{t} GROUP BY v, c")

    def weights(self, t: int, counts: str, degrees: str | None = None) -> Chain:
        f = "coalesce(s.freq, 0)"
        join = ""
        if degrees:
            ratio = f"(coalesce(d.degree, {K}) / {float(K)})"
            f, join = f"CASE WHEN {ratio} > 1 THEN {f} / ({ratio} * {ratio}) ELSE {f} END", f"LEFT JOIN {degrees} d ON f.u = d.q"
        return self.add(f"w{t}", f"SELECT f.v, f.c, min({{'o': from_old, 'u': f.u}}).u AS source, {BASE} + {BOOST} * sum(CAST({f} AS DOUBLE)) AS weight FROM f{t} f LEFT JOIN {counts} s ON f.v = s.v AND f.u = s.u {join} GROUP BY f.v, f.c")

    def cut(self, t: int, table: str, weight: str = "1.0", name: str | None = None) -> Chain:
        return self.add(name or f"k{t}", f"""SELECT v, c, source FROM (SELECT v, c, source, count(*) OVER (PARTITION BY v) AS n,
  row_number() OVER (PARTITION BY v ORDER BY -ln({uniform(f'cand|{t}', 'v', 'c')}) / {weight}, c) AS r FROM {table})
WHERE r <= greatest(1, floor(n * {RATE}))""")

    def success(self, t: int, cands: str, before: str | None) -> Chain:
        own = f"SELECT c.v, c.source AS u, count(*) AS freq FROM {cands} c JOIN b{t} b ON b.p = c.v AND b.q = c.c WHERE b.is_new GROUP BY 1, 2"
        both = own if before is None else f"SELECT v, u, freq FROM {before} UNION ALL ({own})"
        self.add(f"t{t}", f"SELECT v, u, CAST(sum(freq) AS BIGINT) AS freq FROM ({both}) GROUP BY v, u")
        return self.prune(f"t{t}", f"q{t}", 6)

    def prune(self, table: str, name: str, lg: int) -> Chain:
        return self.add(name, f"SELECT v, u, freq FROM (SELECT *, count(*) OVER (PARTITION BY v) AS n, row_number() OVER (PARTITION BY v ORDER BY freq DESC, u) AS r FROM {table}) WHERE n <= {2**lg} OR r <= {2**lg // 2}")

    def round(self, t: int, counts: str | None = None) -> Chain:
        """A full round with uniform (or, with counts, weighted) sampling of neighbours."""
        self.lists(t).sample(t, counts).hop(t).candidates(t)
        return self._merge(t, f"SELECT v, c FROM c{t}")

    def cut_round(self, t: int, counts: str | None = None) -> Chain:
        """A round that evaluates a share of the candidates, by weight with counts."""
        self.lists(t).sample(t).hop(t)
        if counts is None:
            self.candidates(t).cut(t, f"c{t}")
        else:
            self.weights(t, counts).cut(t, f"w{t}", "weight")
        return self._merge(t, f"SELECT v, c FROM k{t}")

    def exact(self, metric: str = "l2") -> Chain:
        d = METRICS[metric]("x.vec", "y.vec")
        return self.add("ex", f"""SELECT p, q, dist, CAST(r AS INTEGER) AS rank FROM (
  SELECT p, q, dist, row_number() OVER (PARTITION BY p ORDER BY dist, q) AS r FROM (
    SELECT x.id AS p, y.id AS q, {d} AS dist FROM pts x JOIN pts y ON x.id <> y.id)) WHERE r <= {K}""")

    def net_round(self, t: int) -> Chain:
        """A cut round with hub-damped weights after the warm-up of two, and penalties for edges that go: counts z{t}, and y{t} who brought what."""
        if t > 2:
            self.add(f"d{t}", f"SELECT q, count(*) AS degree FROM b{t - 1} GROUP BY q").lists(t).sample(t).hop(t)
            self.weights(t, f"z{t - 1}", f"d{t}").cut(t, f"w{t}", "weight")._merge(t, f"SELECT v, c FROM k{t}")
        else:
            self.cut_round(t)
        self.success(t, f"k{t}", f"z{t - 1}" if t > 1 else None)
        brought = f"SELECT k.v, k.c, k.source FROM k{t} k JOIN b{t} b ON b.p = k.v AND b.q = k.c WHERE b.is_new"
        if t == 1:
            return self.add("z1", "SELECT v, u, freq FROM q1").add("y1", brought)
        self.add(f"g{t}", f"SELECT p AS v, q AS c FROM b{t - 1} EXCEPT SELECT p, q FROM b{t}")
        lost = f"SELECT y.v, y.source AS u, count(*) AS n FROM y{t - 1} y JOIN g{t} g ON y.v = g.v AND y.c = g.c GROUP BY 1, 2"
        self.add(f"z{t}", f"SELECT v, u, freq FROM (SELECT q.v, q.u, CAST(q.freq - coalesce(l.n, 0) AS BIGINT) AS freq FROM q{t} q LEFT JOIN ({lost}) l ON q.v = l.v AND q.u = l.u) WHERE freq > 0")
        return self.add(f"y{t}", f"SELECT y.v, y.c, y.source FROM y{t - 1} y WHERE NOT EXISTS (SELECT 1 FROM g{t} g WHERE g.v = y.v AND g.c = y.c) UNION ALL {brought}")

    def until(self, rounds: int, least: str) -> str:
        """The sorted lists after the first of the rounds that brought fewer new edges than least, else after the last."""
        counts = " UNION ALL ".join(f"SELECT {t} AS t, (SELECT count(*) FROM b{t} WHERE is_new) AS n" for t in range(1, rounds + 1))
        self.add("ends", f"SELECT coalesce(min(t), {rounds}) AS t FROM ({counts}) WHERE n < {least}")
        both = " UNION ALL ".join(f"SELECT p, q, dist FROM b{t} WHERE {t} = (SELECT t FROM ends)" for t in range(1, rounds + 1))
        return self.sql(f"SELECT p, CAST(row_number() OVER (PARTITION BY p ORDER BY dist, q) AS INTEGER) AS rank, q, round(dist, 4) AS dist FROM ({both})")


EDGES = "SELECT p, q, round(dist, 4) AS dist, is_new FROM b{}"
NET = """SELECT v, u, freq FROM (
  SELECT t.v, t.u, t.freq - coalesce(l.n, 0) AS freq FROM q2 t LEFT JOIN (
    SELECT c.v, c.source AS u, count(*) AS n FROM c1 c JOIN b1 n ON n.p = c.v AND n.q = c.c AND n.is_new
    WHERE NOT EXISTS (SELECT 1 FROM b2 WHERE b2.p = c.v AND b2.q = c.c) GROUP BY 1, 2
  ) l ON t.v = l.v AND t.u = l.u) WHERE freq > 0"""


def build() -> dict[str, str]:
    first = lambda: Chain().init().round(1)
    second = lambda: first().round(2)
    tracked = lambda: first().success(1, "c1", None)
    out = {}
    for m in METRICS:
        out[f"knn_exact_{m}"] = Chain().exact(m).sql("SELECT p, rank, q, round(dist, 4) AS dist FROM ex")
        out[f"pair_distance_{m}"] = Chain().init(m).sql("SELECT p, q, round(dist, 6) AS dist FROM b0")
    out["graph_init"] = Chain().init().sql("SELECT p, q FROM r0")
    out["graph_init_distances"] = Chain().init().sql(EDGES.format(0))
    out["reverse_neighbors"] = Chain().init().sql("SELECT q AS v, p AS u FROM b0")
    out["in_degree"] = first().sql("SELECT q, count(*) AS degree FROM b1 GROUP BY q")
    out["hubness_skew"] = first().add("dg", "SELECT id, (SELECT count(*) FROM b1 WHERE q = id) AS d FROM pts").sql(
        "SELECT count(*) AS n, round(avg(d), 6) AS mean, max(d) AS biggest, round((SELECT avg(pow(d - (SELECT avg(d) FROM dg), 3)) / pow(var_pop(d), 1.5) FROM dg), 6) AS skew FROM dg"
    )
    out["new_old_lists"] = first().lists(2).sql("SELECT v, u, is_new FROM l2")
    out["rho_sample_uniform"] = first().lists(2).sample(2).sql("SELECT v, u, is_new FROM s2")
    out["naive_two_hop"] = Chain().init().naive(1).sql("SELECT v, c, count(*) AS n_paths FROM f1 GROUP BY v, c")
    found = lambda: first().lists(2).sample(2).hop(2)
    out["candidates_two_hop"] = found().sql("SELECT v, c, u, from_old FROM f2")
    out["candidate_sources"] = found().candidates(2).sql("SELECT v, c, source FROM c2")
    out["candidate_sample_uniform"] = found().candidates(2).cut(2, "c2").sql("SELECT v, c, source FROM k2")
    out["topk_merge"] = first().sql(EDGES.format(1))
    out["update_count"] = first().sql("SELECT (SELECT count(*) FROM b1 WHERE is_new) AS updates, (SELECT count(*) FROM c1) AS dist")
    out["evicted_edges"] = first().sql("SELECT p, q FROM b0 EXCEPT SELECT p, q FROM b1")
    out["descent_naive_r2"] = Chain().init().naive(1).naive(2).sql(EDGES.format(2))
    out["descent_optimized_r2"] = second().sql(EDGES.format(2))
    out["neighbor_lists"] = second().sql("SELECT p, CAST(row_number() OVER (PARTITION BY p ORDER BY dist, q) AS INTEGER) AS rank, q FROM b2")
    out["iteration_log_r2"] = second().sql(
        "SELECT CAST(t AS INTEGER) AS iter, updates, dist FROM (SELECT 1 AS t, (SELECT count(*) FROM b1 WHERE is_new) AS updates, (SELECT count(*) FROM c1) AS dist"
        " UNION ALL SELECT 2, (SELECT count(*) FROM b2 WHERE is_new), (SELECT count(*) FROM c2))"
    )
    out["source_success"] = tracked().sql("SELECT v, u, freq FROM q1")
    out["source_prune"] = tracked().prune("q1", "z", 2).sql("SELECT v, u, freq FROM z")
    out["neighbor_weights"] = tracked().lists(2).sql(f"SELECT l.v, l.u, l.is_new, {BASE} + {BOOST} * coalesce(s.freq, 0) AS weight FROM l2 l LEFT JOIN q1 s ON l.v = s.v AND l.u = s.u")
    out["rho_sample_weighted"] = tracked().lists(2).sample(2, "q1").sql("SELECT v, u, is_new FROM s2")
    weighed = lambda: tracked().lists(2).sample(2).hop(2)
    out["candidate_weights"] = weighed().weights(2, "q1").sql("SELECT v, c, source, round(weight, 6) AS weight FROM w2")
    out["candidate_sample_weighted"] = weighed().weights(2, "q1").cut(2, "w2", "weight").sql("SELECT v, c, source FROM k2")
    out["hub_damped_weights"] = weighed().add("dg", "SELECT q, count(*) AS degree FROM b1 GROUP BY q").weights(2, "q1", "dg").sql("SELECT v, c, source, round(weight, 6) AS weight FROM w2")
    out["net_scores"] = tracked().round(2).success(2, "c2", "q1").sql(NET)
    out["descent_adaptive_r3"] = tracked().round(2).success(2, "c2", "q1").round(3, "q2").sql(EDGES.format(3))
    half = Chain().init().cut_round(1).success(1, "k1", None).cut_round(2).success(2, "k2", "q1").cut_round(3, "q2")
    out["descent_benchmark_adaptive_r3"] = half.sql(EDGES.format(3))
    out["descent_benchmark_random_r2"] = Chain().init().cut_round(1).cut_round(2).sql(EDGES.format(2))
    out["recall_descent_vs_exact"] = second().exact().sql(
        "SELECT hits, total, round(hits / total, 6) AS recall FROM (SELECT (SELECT count(*) FROM ex JOIN b2 USING (p, q)) AS hits, (SELECT count(*) FROM ex) AS total)"
    )
    largest = "list_max(list_transform(list_zip(x.vec, y.vec), lambda z: abs(z[1] - z[2])))"
    out["pair_distance_custom"] = Chain().init().add("mc", f"SELECT e.p, e.q, {largest} AS dist FROM r0 e JOIN pts x ON e.p = x.id JOIN pts y ON e.q = y.id").sql(
        "SELECT p, q, round(dist, 6) AS dist FROM mc"
    )
    flagged = "SELECT p, CAST(row_number() OVER (PARTITION BY p ORDER BY dist, q) AS INTEGER) AS rank, q FROM b1 WHERE {}"
    out["new_neighbors"], out["old_neighbors"] = first().sql(flagged.format("is_new")), first().sql(flagged.format("NOT is_new"))
    out["source_frequency"] = tracked().sql("SELECT b.q AS v, b.p AS u, coalesce(s.freq, 0) AS freq FROM b1 b LEFT JOIN q1 s ON b.q = s.v AND b.p = s.u")
    out["topk_sources"] = tracked().sql("SELECT v, u, freq FROM (SELECT *, row_number() OVER (PARTITION BY v ORDER BY freq DESC, u) AS r FROM q1) WHERE r <= 5")
    out["json_result"] = second().exact().add("lg", """SELECT CAST(t AS INTEGER) AS iter, updates, dist FROM (
  SELECT 1 AS t, (SELECT count(*) FROM b1 WHERE is_new) AS updates, (SELECT count(*) FROM c1) AS dist
  UNION ALL SELECT 2, (SELECT count(*) FROM b2 WHERE is_new), (SELECT count(*) FROM c2))""").sql(
        "SELECT (SELECT round(count(*) / (SELECT count(*) FROM ex), 6) FROM ex JOIN b2 USING (p, q)) AS recall, (SELECT CAST(sum(dist) AS BIGINT) FROM lg) AS dist_comps, 2 AS iterations, 'random' AS mode, CAST(1.0 AS DOUBLE) AS rate, iter, updates, dist FROM lg"
    )
    taken = " UNION ALL ".join(f"SELECT c.v, c.source AS u FROM c{t} c JOIN b{t} b ON b.p = c.v AND b.q = c.c WHERE b.is_new" for t in (1, 2))
    out["source_sketch"] = second().add("sk", f"SELECT v, u, count(*) AS freq FROM ({taken}) GROUP BY v, u").sql(
        "SELECT v, CAST(sum(freq) AS BIGINT) AS n, count(*) AS sources, true AS within FROM sk GROUP BY v"
    )
    few = f"0.001 * (SELECT count(*) FROM pts) * {K}"
    naive, optimized, adaptive = Chain().init(), Chain().init(), Chain().init()
    for t in range(1, ROUNDS + 1):
        naive.naive(t)
        optimized.round(t)
        adaptive.round(t, f"q{t - 1}" if t > 2 else None).success(t, f"c{t}", f"q{t - 1}" if t > 1 else None)
    out["descent_naive_converged"] = naive.until(ROUNDS, "1")
    out["descent_optimized_converged"] = optimized.until(ROUNDS, few)
    out["descent_adaptive_converged"] = adaptive.until(ROUNDS, few)
    net = Chain().init()
    for t in range(1, NET_ROUNDS + 1):
        net.net_round(t)
    out["descent_net_converged"] = net.until(NET_ROUNDS, few)
    flat = "SELECT vec_id AS id, j, round({}, 6) AS x FROM embeddings, range({}) b(j)"
    out["gen_uniform"] = flat.format(f"2.0 + 3.0 * {uniform('uniform', 'vec_id', 'j')}", 8)
    out["gen_gaussian"] = flat.format(f"5.0 + 2.0 * {normal('gaussian', 'vec_id', 'j')}", 8)
    out["gen_high_hubness"] = flat.format(f"0.0 + 1.0 * {normal('gaussian', 'vec_id', 'j')}", 100)
    out["gen_clustered"] = flat.format(f"5.0 * {normal('centre', 'CAST(floor(vec_id / (SELECT count(*) // 7 FROM embeddings)) AS BIGINT)', 'j')} + 0.3 * {normal('around', 'vec_id', 'j')}", 8)
    return out
