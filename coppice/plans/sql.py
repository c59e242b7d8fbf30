"""DuckDB SQL that states what the graph queries mean, built from a few common parts."""

from __future__ import annotations


def event_graph(least: int) -> str:
    """CTEs ``ty``, ``g`` (all graph ids), ``gv`` (their vertices) and ``e`` (edges)."""
    return f"""
    ty AS (SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS v FROM (SELECT DISTINCT event_type FROM events)),
    seq AS (SELECT user_id, event_type AS a, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events),
    g AS (SELECT DISTINCT CAST(user_id AS BIGINT) AS graph_id FROM events),
    gv AS (SELECT graph_id, v FROM g CROSS JOIN ty),
    e AS (SELECT CAST(user_id AS BIGINT) AS graph_id, x.v AS src, y.v AS dst, count(*) AS w
          FROM seq JOIN ty x ON a = x.event_type JOIN ty y ON b = y.event_type WHERE a <> b GROUP BY ALL HAVING count(*) >= {least})"""


#: Undirected edges ``u`` and both directions ``b`` of ``e``.
UNDIRECTED = """
    u AS (SELECT DISTINCT graph_id, least(src, dst) AS src, greatest(src, dst) AS dst FROM e WHERE src <> dst),
    b AS (SELECT graph_id, src, dst FROM u UNION ALL SELECT graph_id, dst, src FROM u)"""

#: Reachability by at least one edge.
REACH = "r AS (SELECT graph_id, src, dst FROM e UNION SELECT r.graph_id, r.src, e.dst FROM r JOIN e ON r.graph_id = e.graph_id AND r.dst = e.src)"
REACH_BOTH = "r AS (SELECT graph_id, src, dst FROM b UNION SELECT r.graph_id, r.src, b.dst FROM r JOIN b ON r.graph_id = b.graph_id AND r.dst = b.src)"

#: All sets of the few vertices of a graph, as bit masks; ``me``: edges within a set.
MASKS = """
    m AS (SELECT g.graph_id, unnest(range(0, CAST(1 << (SELECT count(*) FROM ty) AS BIGINT))) AS mask FROM g),
    me AS (SELECT m.graph_id, mask, src, dst FROM m JOIN e ON m.graph_id = e.graph_id
           WHERE (mask >> CAST(src AS INT)) & 1 = 1 AND (mask >> CAST(dst AS INT)) & 1 = 1)"""

#: ``opt``: least size of a set without which no directed cycle is left, and the smallest such set.
DIRECTED_OPTIMUM = (
    MASKS
    + """,
    mr AS (SELECT graph_id, mask, src, dst FROM me
           UNION SELECT mr.graph_id, mr.mask, mr.src, me.dst FROM mr JOIN me ON mr.graph_id = me.graph_id AND mr.mask = me.mask AND mr.dst = me.src),
    bad AS (SELECT DISTINCT graph_id, mask FROM mr WHERE src = dst),
    good AS (SELECT m.graph_id, m.mask, (SELECT count(*) FROM ty) - bit_count(m.mask) AS size FROM m ANTI JOIN bad ON m.graph_id = bad.graph_id AND m.mask = bad.mask),
    opt AS (SELECT graph_id, CAST(min(size) AS BIGINT) AS fvs_size FROM good GROUP BY graph_id)"""
)

#: The same for undirected graphs: a set is a forest if its edges are its vertices less its components.
UNDIRECTED_OPTIMUM = """
    m AS (SELECT g.graph_id, unnest(range(0, CAST(1 << (SELECT count(*) FROM ty) AS BIGINT))) AS mask FROM g),
    mb AS (SELECT m.graph_id, mask, src, dst FROM m JOIN b ON m.graph_id = b.graph_id
           WHERE (mask >> CAST(src AS INT)) & 1 = 1 AND (mask >> CAST(dst AS INT)) & 1 = 1),
    mr AS (SELECT graph_id, mask, src, dst FROM mb
           UNION SELECT mr.graph_id, mr.mask, mr.src, mb.dst FROM mr JOIN mb ON mr.graph_id = mb.graph_id AND mr.mask = mb.mask AND mr.dst = mb.src),
    edges_in AS (SELECT graph_id, mask, count(*) / 2 AS n FROM mb GROUP BY ALL),
    label AS (SELECT graph_id, mask, src, least(src, min(dst)) AS l FROM mr GROUP BY graph_id, mask, src),
    comps AS (SELECT graph_id, mask, count(*) AS touched, count(DISTINCT l) AS parts FROM label GROUP BY ALL),
    good AS (SELECT m.graph_id, m.mask, (SELECT count(*) FROM ty) - bit_count(m.mask) AS size
             FROM m LEFT JOIN edges_in USING (graph_id, mask) LEFT JOIN comps USING (graph_id, mask)
             WHERE coalesce(edges_in.n, 0) = coalesce(touched, 0) - coalesce(parts, 0)),
    opt AS (SELECT graph_id, CAST(min(size) AS BIGINT) AS fvs_size FROM good GROUP BY graph_id)"""

#: ``core``: core number of a vertex, the largest least degree over the sets that hold it.
CORES = """
    m AS (SELECT g.graph_id, unnest(range(1, CAST(1 << (SELECT count(*) FROM ty) AS BIGINT))) AS mask FROM g),
    md AS (SELECT m.graph_id, mask, gv.v, (SELECT count(*) FROM b WHERE b.graph_id = m.graph_id AND b.src = gv.v AND (mask >> CAST(b.dst AS INT)) & 1 = 1) AS d
           FROM m JOIN gv ON m.graph_id = gv.graph_id WHERE (mask >> CAST(gv.v AS INT)) & 1 = 1),
    ml AS (SELECT graph_id, mask, min(d) AS least FROM md GROUP BY ALL),
    core AS (SELECT md.graph_id, md.v, CAST(max(least) AS BIGINT) AS core FROM md JOIN ml USING (graph_id, mask) GROUP BY ALL)"""

TRIANGLES = """
    t3 AS (SELECT x.graph_id, x.src AS a, x.dst AS c, y.dst AS d FROM u x JOIN u y ON x.graph_id = y.graph_id AND x.dst = y.src
           JOIN u z ON z.graph_id = x.graph_id AND z.src = x.src AND z.dst = y.dst),
    tri AS (SELECT graph_id, v, count(*) AS triangles FROM (SELECT graph_id, unnest([a, c, d]) AS v FROM t3) GROUP BY ALL)"""


def walks(source: str, steps: tuple[int, ...]) -> str:
    """CTEs ``p1``.. (powers) and ``d2``.. (diagonals) of the walk on the edges of ``source``."""
    made, parts = {1}, [f"p1 AS (SELECT graph_id, src AS i, dst AS j, 1.0::DOUBLE / count(*) OVER (PARTITION BY graph_id, src) AS p FROM {source})"]

    def power(k: int) -> None:
        if k in made:
            return
        a, b = k // 2, k - k // 2
        power(a)
        power(b)
        made.add(k)
        parts.append(f"p{k} AS (SELECT x.graph_id, x.i, y.j, sum(x.p * y.p) AS p FROM p{a} x JOIN p{b} y ON x.graph_id = y.graph_id AND x.j = y.i GROUP BY ALL)")

    for k in steps:
        a, b = k // 2, k - k // 2
        power(a)
        power(b)
        parts.append(f"d{k} AS (SELECT x.graph_id, x.i AS v, sum(x.p * y.p) AS p FROM p{a} x JOIN p{b} y ON x.graph_id = y.graph_id AND x.j = y.i AND x.i = y.j GROUP BY ALL)")
    return ",\n    ".join(parts)


def rounded(columns: list[str]) -> str:
    return ", ".join(f"round(CAST({c} AS DOUBLE) + 1e-12::DOUBLE, 9) AS {c}" for c in columns)


#: ``res``: the table of solver runs; ``pen``: with invalid answers set to n; ``sc``: scored.
RESULTS = """
    res AS (SELECT l_partkey AS instance, 's' || CAST(l_suppkey % 5 AS VARCHAR) AS solver, CAST(min(floor(l_quantity)) AS BIGINT) AS fvs_size,
                   round(avg(l_extendedprice) / 10000, 10) AS runtime_s, max(l_discount) < 0.095 AS valid, CAST(l_partkey % 40 + 10 AS BIGINT) AS n
            FROM lineitem GROUP BY l_partkey, l_suppkey % 5),
    pen AS (SELECT instance, solver, CASE WHEN coalesce(valid, true) THEN fvs_size ELSE n END AS fvs_size FROM res),
    sc AS (SELECT instance, solver, fvs_size, min(fvs_size) OVER (PARTITION BY instance) AS best,
                  CASE WHEN min(fvs_size) OVER (PARTITION BY instance) = 0 THEN CASE WHEN fvs_size = 0 THEN 100.0::DOUBLE ELSE 0.0::DOUBLE END
                       WHEN fvs_size > 0 THEN 100.0::DOUBLE * min(fvs_size) OVER (PARTITION BY instance) / fvs_size END AS score FROM pen)"""

#: ``tm``: timed points with success within the limit.
TIMED = (
    RESULTS
    + """,
    tm AS (SELECT instance, solver, n, coalesce(fvs_size, -1) AS k, least(runtime_s, 4.0) AS runtime_s,
                  NOT (runtime_s > 4.0 OR coalesce(fvs_size, -1) = -1) AS success FROM res WHERE coalesce(fvs_size, -1) <> 0)"""
)


def brand_graph(k: int) -> str:
    """CTEs ``ty``, ``g``, ``gv`` and ``e`` as in ``event_graph``, for the graphs of 16 brands."""
    return f"""
    ty AS (SELECT p_brand AS event_type, v FROM (SELECT p_brand, row_number() OVER (ORDER BY p_brand) - 1 AS v FROM (SELECT DISTINCT p_brand FROM part)) WHERE v < 16),
    seq AS (SELECT l_orderkey, p_brand AS a, lead(p_brand) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS b FROM lineitem JOIN part ON l_partkey = p_partkey),
    g AS (SELECT DISTINCT CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS graph_id FROM orders),
    gv AS (SELECT graph_id, v FROM g CROSS JOIN ty),
    ew AS (SELECT CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS graph_id, x.v AS src, y.v AS dst, count(*) AS w
           FROM seq JOIN orders ON l_orderkey = o_orderkey JOIN ty x ON a = x.event_type JOIN ty y ON b = y.event_type WHERE a <> b GROUP BY ALL),
    e AS (SELECT graph_id, src, dst, w FROM (SELECT *, row_number() OVER (PARTITION BY graph_id, src ORDER BY w DESC, dst) AS place FROM ew) WHERE place <= {k})"""


#: ``nb``: for each graph the neighbours of its vertices as numbers, in order of the vertices.
_BITS = """
    nb AS (SELECT graph_id, list(coalesce(ins, 0) ORDER BY v) AS ins, list(coalesce(outs, 0) ORDER BY v) AS outs FROM (
        SELECT gv.graph_id, gv.v, bit_or(CASE WHEN x.dst = gv.v THEN CAST(1 AS BIGINT) << CAST(x.src AS INT) ELSE 0 END) AS ins,
               bit_or(CASE WHEN x.src = gv.v THEN CAST(1 AS BIGINT) << CAST(x.dst AS INT) ELSE 0 END) AS outs
        FROM gv LEFT JOIN {source} x ON gv.graph_id = x.graph_id AND gv.v IN (x.src, x.dst) GROUP BY ALL) GROUP BY graph_id)"""


def _kept(condition: str, width: int = 16) -> str:
    """The bits ``i`` of ``alive`` for which the condition holds."""
    return f"CAST(list_sum(list_transform(range(0, {width}), lambda i: CASE WHEN (alive >> CAST(i AS INT)) & 1 = 1 AND {condition} THEN CAST(1 AS BIGINT) << CAST(i AS INT) ELSE 0 END)) AS BIGINT)"


def _peel(start: str, keys: str, condition: str, source: str, width: int = 16) -> str:
    """``pl``: every state of peeling from ``start``; the last one of each key is its smallest."""
    return (
        _BITS.format(source=source)
        + f""",
    pl AS (SELECT {keys}, alive FROM ({start})
           UNION SELECT {keys}, {_kept(condition, width)} FROM pl JOIN nb USING (graph_id) WHERE alive > 0)"""
    )


def peel_by_bits(directed: bool, both: bool = False) -> str:
    """``left_over``: the vertices that peeling leaves, as ``alive``."""
    some = "ins[i + 1] & alive <> 0" + (" AND outs[i + 1] & alive <> 0" if both else "")
    condition = some if directed else "bit_count(outs[i + 1] & alive) >= 2"
    return _peel("SELECT graph_id, CAST(65535 AS BIGINT) AS alive FROM g", "graph_id", condition, "e" if directed else "b") + ", left_over AS (SELECT graph_id, min(alive) AS alive FROM pl GROUP BY graph_id)"


def optimum_by_bits(directed: bool) -> str:
    """``opt``: the fewest vertices without which peeling leaves nothing."""
    condition = "ins[i + 1] & alive <> 0" if directed else "bit_count(outs[i + 1] & alive) >= 2"
    start = "SELECT graph_id, removed, 65535 - removed AS alive FROM g CROSS JOIN (SELECT unnest(range(0, 65536)) AS removed)"
    peel = _peel(start, "graph_id, removed", condition, "e" if directed else "b")
    return peel + ", opt AS (SELECT graph_id, CAST(min(bit_count(removed)) AS BIGINT) AS fvs_size FROM pl WHERE alive = 0 GROUP BY graph_id)"


def nation_optimum(ks: tuple[int, ...], most: int) -> str:
    """``opt``: least sizes for the trade graphs of 25 nations, over all sets of up to ``most`` of them."""
    condition = "ins[i + 1] & alive <> 0"
    full = (1 << 25) - 1
    start = f"SELECT graph_id, removed, CAST({full} AS BIGINT) - removed AS alive FROM g CROSS JOIN sets"
    return (
        f"""
    x AS (SELECT CAST(s_nationkey AS BIGINT) AS src, CAST(c_nationkey AS BIGINT) AS dst, count(*) AS w FROM lineitem JOIN orders ON l_orderkey = o_orderkey
          JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE s_nationkey <> c_nationkey GROUP BY ALL),
    g AS (SELECT CAST(unnest([{", ".join(map(str, ks))}]) AS BIGINT) AS graph_id),
    gv AS (SELECT graph_id, v FROM g CROSS JOIN (SELECT unnest(range(0, 25)) AS v)),
    e AS (SELECT graph_id, src, dst FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY w DESC, dst) AS place FROM x) JOIN g ON place <= graph_id),
    sets AS (SELECT CAST(0 AS BIGINT) AS removed, -1 AS last, 0 AS size
             UNION ALL SELECT removed | (CAST(1 AS BIGINT) << CAST(v AS INT)), v, size + 1 FROM sets JOIN (SELECT unnest(range(0, 25)) AS v) ON v > last WHERE size < {most}),"""
        + _peel(start, "graph_id, removed", condition, "e", 25)
        + ", opt AS (SELECT graph_id, CAST(min(bit_count(removed)) AS BIGINT) AS fvs_size FROM pl WHERE alive = 0 GROUP BY graph_id)"
    )


#: ``core`` as in ``CORES``, by peeling for every number in turn.
CORES_BY_BITS = (
    _peel("SELECT graph_id, k, CAST(65535 AS BIGINT) AS alive FROM g CROSS JOIN (SELECT unnest(range(1, 16)) AS k)", "graph_id, k", "bit_count(outs[i + 1] & alive) >= k", "b")
    + """,
    held AS (SELECT graph_id, k, min(alive) AS alive FROM pl GROUP BY ALL),
    core AS (SELECT gv.graph_id, gv.v, CAST(coalesce(max(k), 0) AS BIGINT) AS core FROM gv LEFT JOIN held ON gv.graph_id = held.graph_id AND (alive >> CAST(gv.v AS INT)) & 1 = 1 GROUP BY ALL)"""
)


def labels_by_turns(pairs: str) -> str:
    """Sizes of the components of a graph of pairs ``(p, s)``: the smallest vertex that is reached spreads until nothing changes."""
    return f"""x AS ({pairs}), bb AS (SELECT p AS src, s AS dst FROM x UNION ALL SELECT s, p FROM x),
       vs AS (SELECT DISTINCT src AS v FROM bb),
       w AS (SELECT v, v AS c FROM vs UNION SELECT dst, min(c) FROM w JOIN bb ON w.v = bb.src GROUP BY dst),
       l AS (SELECT v, min(c) AS component FROM w GROUP BY v)
       SELECT component, count(*) AS n FROM l GROUP BY component"""


def cores_by_turns(pairs: str, turns: int) -> str:
    """Core numbers of a graph of pairs ``(c, s)``: a vertex's value is the largest h of which h neighbours have as much."""
    steps = [f"x AS MATERIALIZED ({pairs})", "bb AS MATERIALIZED (SELECT c AS v, s AS w FROM x UNION ALL SELECT s, c FROM x)", "t0 AS MATERIALIZED (SELECT v, count(*) AS core FROM bb GROUP BY v)"]
    for i in range(turns):
        steps.append(
            f"""t{i + 1} AS MATERIALIZED (SELECT v, max(least(near, place)) AS core FROM (
                SELECT bb.v, t.core AS near, row_number() OVER (PARTITION BY bb.v ORDER BY t.core DESC) AS place FROM bb JOIN t{i} t ON bb.w = t.v) GROUP BY v)"""
        )
    return "WITH " + ", ".join(steps) + f" SELECT v, CAST(core AS BIGINT) AS core FROM t{turns}"


# ---------------------------------------------------------------- nets, written out


def _line(w: dict, name: str, inputs: list[str]) -> list[str]:
    """A linear layer: one expression per output."""
    bias = w.get(f"{name}.bias")
    out = []
    for i, row in enumerate(w[f"{name}.weight"]):
        terms = [f"{float(x)!r}::DOUBLE * {c}" for x, c in zip(row, inputs)]
        out.append("(" + " + ".join(terms + ([] if bias is None else [f"{float(bias[i])!r}::DOUBLE"])) + ")")
    return out


def _norm(w: dict, name: str, values: list[str]) -> list[str]:
    return [f"({x} * {float(a)!r}::DOUBLE + {float(b)!r}::DOUBLE)" for x, a, b in zip(values, w[f"{name}.scale"], w[f"{name}.shift"])]


def _relu(values: list[str]) -> list[str]:
    return [f"greatest(0.0::DOUBLE, {x})" for x in values]


def _as(values: list[str], name: str) -> str:
    return ", ".join(f"{x} AS {name}{i}" for i, x in enumerate(values))


def _columns(name: str, n: int, of: str = "") -> list[str]:
    return [f"{of}{name}{i}" for i in range(n)]


def means_net(w: dict, width: int) -> str:
    """``net``: probabilities by three layers of means over predecessors and successors; ``f`` holds the channels ``h0``.."""
    parts, before, n = [], "f", width
    for k in range(3):
        average = ", ".join(f"avg(h{i}) AS a{i}" for i in range(n))
        parts.append(f"mi{k} AS (SELECT e.graph_id, e.dst AS v, {average} FROM e JOIN {before} h ON e.graph_id = h.graph_id AND e.src = h.v GROUP BY ALL)")
        parts.append(f"mo{k} AS (SELECT e.graph_id, e.src AS v, {average} FROM e JOIN {before} h ON e.graph_id = h.graph_id AND e.dst = h.v GROUP BY ALL)")
        near = [[f"coalesce({t}.a{i}, 0.0::DOUBLE)" for i in range(n)] for t in ("mi", "mo")]
        lines = [_line(w, f"conv{k}.in", near[0]), _line(w, f"conv{k}.out", near[1]), _line(w, f"conv{k}.self", _columns("h", n, "h."))]
        sums = [f"({a} + {b} + {c} + {float(bias)!r}::DOUBLE)" for a, b, c, bias in zip(*lines, w[f"conv{k}.bias"])]
        values = _relu(_norm(w, f"norm{k}", sums))
        parts.append(
            f"""nl{k} AS (SELECT h.graph_id, h.v, {_as(values, 'h')} FROM {before} h LEFT JOIN mi{k} mi ON h.graph_id = mi.graph_id AND h.v = mi.v
            LEFT JOIN mo{k} mo ON h.graph_id = mo.graph_id AND h.v = mo.v)"""
        )
        before, n = f"nl{k}", len(values)
    hidden = _relu(_line(w, "head0", _columns("h", n)))
    parts.append(f"hd AS (SELECT graph_id, v, {_as(hidden, 'h')} FROM {before})")
    no, yes = _line(w, "head1", _columns("h", len(hidden)))
    parts.append(f"net AS (SELECT graph_id, v, 1 / (1 + exp({no} - {yes})) AS prob FROM hd)")
    return ", ".join(parts)


def attention_net(w: dict, width: int) -> str:
    """``net``: probabilities by one residual attention block over neighbours and a mean of the graph; ``f`` as above, ``b`` both directions."""
    heads, c = w["layer0.both.attention.score"].shape
    first = _relu(_norm(w, "input_norm", _line(w, "input", _columns("h", width))))
    parts = [f"nh AS (SELECT graph_id, v, {_as(first, 'h')} FROM f)"]
    own = _columns("h", len(first))
    left, right = _line(w, "layer0.both.attention.left", own), _line(w, "layer0.both.attention.right", own)
    parts.append(f"lr AS (SELECT graph_id, v, {_as(left, 'l')}, {_as(right, 'r')} FROM nh)")
    parts.append("ab AS (SELECT graph_id, src, dst FROM b UNION ALL SELECT graph_id, v, v FROM nh)")
    scores = []
    for k in range(heads):
        terms = []
        for i in range(c):
            x = f"(s.l{k * c + i} + t.r{k * c + i})"
            terms.append(f"{float(w['layer0.both.attention.score'][k][i])!r}::DOUBLE * (CASE WHEN {x} > 0 THEN {x} ELSE 0.2::DOUBLE * {x} END)")
        scores.append("(" + " + ".join(terms) + ")")
    lefts = ", ".join(f"s.l{i}" for i in range(heads * c))
    parts.append(
        f"sc AS (SELECT ab.graph_id, ab.dst AS v, {_as(scores, 's')}, {lefts} FROM ab JOIN lr s ON ab.graph_id = s.graph_id AND ab.src = s.v JOIN lr t ON ab.graph_id = t.graph_id AND ab.dst = t.v)"
    )
    shares = ", ".join(f"exp(s{k} - max(s{k}) OVER (PARTITION BY graph_id, v)) AS e{k}" for k in range(heads))
    parts.append(f"sh AS (SELECT *, {shares} FROM sc)")
    means = ["(" + " + ".join(f"sum(e{k} * l{k * c + i}) / sum(e{k})" for k in range(heads)) + f") / {heads} + {float(w['layer0.both.attention.bias'][i])!r}::DOUBLE" for i in range(c)]
    parts.append(f"at_ AS (SELECT graph_id, v, {_as(means, 'a')} FROM sh GROUP BY graph_id, v)")
    values = [f"{x} + nh.h{i}" for i, x in enumerate(_relu(_norm(w, "layer0.both.norm", _columns("a", c))))]
    parts.append(f"nb_ AS (SELECT nh.graph_id, nh.v, {_as(values, 'h')} FROM nh JOIN at_ ON nh.graph_id = at_.graph_id AND nh.v = at_.v)")
    parts.append(f"me_ AS (SELECT graph_id, {', '.join(f'avg(h{i}) AS m{i}' for i in range(c))} FROM nb_ GROUP BY graph_id)")
    whole = _relu(_line(w, "readout", _columns("m", c)))
    parts.append(f"ro AS (SELECT graph_id, {_as(whole, 'g')} FROM me_)")
    last = _relu(_line(w, "head0", _columns("h", c) + _columns("g", len(whole))))
    parts.append(f"h0_ AS (SELECT nb_.graph_id, v, {_as(last, 'y')} FROM nb_ JOIN ro ON nb_.graph_id = ro.graph_id)")
    more = _relu(_line(w, "head1", _columns("y", len(last))))
    parts.append(f"h1_ AS (SELECT graph_id, v, {_as(more, 'z')} FROM h0_)")
    parts.append(f"net AS (SELECT graph_id, v, 1 / (1 + exp(-{_line(w, 'head2', _columns('z', len(more)))[0]})) AS prob FROM h1_)")
    return ", ".join(parts)
