"""The queries as SQL for DuckDB, written from what each operator means."""

from __future__ import annotations

from sievelake.functions.hashing import KERNELS

BITS = 16384
MODULUS = 1 << 24
CLOSE = 1.03
DEVIATIONS = 1.0

# ---- integer sets -------------------------------------------------------

_BITS = f"bits AS (SELECT DISTINCT l_suppkey AS filter, l_partkey % {BITS} AS pos FROM lineitem)"
_PROBES = f"probes AS (SELECT l_orderkey AS read, l_partkey % {BITS} AS pos, count(*) AS n FROM lineitem GROUP BY ALL)"
_TOTALS = "totals AS (SELECT read, CAST(sum(n) AS BIGINT) AS total FROM probes GROUP BY read)"
_HITS = "hits AS (SELECT read, filter, CAST(sum(n) AS BIGINT) AS hits FROM probes JOIN bits USING (pos) GROUP BY ALL)"
_FRAC = "CASE WHEN total = 0 THEN 0 ELSE round(CAST(CAST(hits AS REAL) / CAST(total AS REAL) AS DOUBLE), 6) END"
_NEED = "hits >= ceil(round(total * CAST(0.5 AS DOUBLE), 9))"
_MATCHES = f"matches AS (SELECT read, filter, hits, total, {_FRAC} AS frac FROM hits JOIN totals USING (read) WHERE {_NEED})"
_SETS = f"WITH {_BITS}, {_PROBES}, {_TOTALS}, {_HITS}, {_MATCHES}"

CLASSIFY_SETS = f"{_SETS} SELECT * FROM matches"
CLASSIFY_DISTINCT = f"""WITH {_BITS}, p AS (SELECT DISTINCT read, pos FROM (SELECT l_orderkey AS read, l_partkey % {BITS} AS pos FROM lineitem)),
    totals AS (SELECT read, count(*) AS total FROM p GROUP BY read), hits AS (SELECT read, filter, count(*) AS hits FROM p JOIN bits USING (pos) GROUP BY ALL), {_MATCHES} SELECT * FROM matches"""
THETAS = (0.4, 0.5, 0.75)
FILE_THRESHOLDS = f"""WITH {_BITS}, {_PROBES}, {_TOTALS}, {_HITS} SELECT read, filter, hits, total, {_FRAC} AS frac FROM hits JOIN totals USING (read)
    WHERE hits >= ceil(round(total * CAST([{', '.join(map(str, THETAS))}][read % 3 + 1] AS DOUBLE), 9))"""
JUST_COUNT = "SELECT l_orderkey AS read, count(*) AS total FROM lineitem GROUP BY 1"
COUNT_ALL = f"""WITH bits AS (SELECT DISTINCT s_nationkey AS filter, l_partkey % {BITS} AS pos FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_returnflag = 'R'),
    {_PROBES}, {_TOTALS}, {_HITS}
    SELECT t.read, f.filter, coalesce(h.hits, 0) AS hits, t.total, coalesce(h.hits, 0) >= ceil(t.total * 0.5) AS passed
    FROM totals t CROSS JOIN (SELECT DISTINCT filter FROM bits) f LEFT JOIN hits h ON h.read = t.read AND h.filter = f.filter"""
MATCH_COUNTS = f"{_SETS} SELECT t.read, count(m.filter) AS matches FROM totals t LEFT JOIN matches m USING (read) GROUP BY t.read"
ADJUSTED = f"""{_SETS}, sizes AS (SELECT l_suppkey AS filter, count(*) AS set_size FROM lineitem GROUP BY 1),
    a AS (SELECT read, filter, hits, total, 1 - exp(-1 * CAST(set_size AS DOUBLE) / {BITS}) AS fp FROM matches JOIN sizes USING (filter)),
    b AS (SELECT read, filter, hits, total, CAST(round(greatest(0.0, (hits / total - fp) / (1 - fp)) * total) AS BIGINT) AS adjusted FROM a)
    SELECT *, row_number() OVER (PARTITION BY read ORDER BY adjusted DESC, filter, hits) AS place FROM b"""
RESULT_TEXT = f"""{_SETS}, m AS (SELECT read, count(*) AS n, string_agg(filter || ' ' || hits || '/' || total || ' ' || printf('%.6f', frac), chr(10) ORDER BY hits DESC, CAST(filter AS VARCHAR)) AS t FROM matches GROUP BY read)
    SELECT read, '*' || read || ' ' || coalesce(n, 0) || coalesce(chr(10) || t, '') AS text FROM totals LEFT JOIN m USING (read)"""

# ---- bit vectors --------------------------------------------------------

_VECTORS = f"""WITH a AS (SELECT DISTINCT l_linenumber AS filter, l_partkey % {BITS} AS pos FROM lineitem WHERE l_quantity < 25),
    b AS (SELECT DISTINCT l_linenumber AS filter, l_partkey % {BITS} AS pos FROM lineitem WHERE l_discount >= 0.05),
    u AS (SELECT filter, pos FROM (SELECT DISTINCT l_linenumber AS filter FROM lineitem) CROSS JOIN (SELECT range AS pos FROM range({BITS})))"""
BINARY = {
    "and": f"{_VECTORS} SELECT * FROM a INTERSECT SELECT * FROM b",
    "or": f"{_VECTORS} SELECT * FROM a UNION SELECT * FROM b",
    "xor": f"{_VECTORS} (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL (SELECT * FROM b EXCEPT SELECT * FROM a)",
    "mask": f"{_VECTORS} SELECT * FROM a EXCEPT SELECT * FROM b",
    "not": f"{_VECTORS} SELECT * FROM u EXCEPT SELECT * FROM a",
    "eq": f"{_VECTORS} SELECT * FROM u EXCEPT ((SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL (SELECT * FROM b EXCEPT SELECT * FROM a))",
    "ornot": f"{_VECTORS} SELECT * FROM a UNION (SELECT * FROM u EXCEPT SELECT * FROM b)",
}
SQUEEZE = f"{_VECTORS}, r AS (SELECT filter, pos, row_number() OVER (PARTITION BY filter ORDER BY pos) - 1 AS rank FROM b) SELECT filter, rank AS pos FROM a JOIN r USING (filter, pos)"
RANKS = f"""{_VECTORS}, z AS (SELECT filter, max(pos) AS last_clear, count(*) AS clear FROM (SELECT * FROM u EXCEPT SELECT * FROM a) GROUP BY filter)
    SELECT filter, pos, row_number() OVER (PARTITION BY filter ORDER BY pos) - 1 AS rank, clear, last_clear FROM a JOIN z USING (filter)"""
PAIR_COUNTS = f"""{_VECTORS}, j AS (SELECT coalesce(a.filter, b.filter) AS filter, a.pos IS NOT NULL AS x, b.pos IS NOT NULL AS y FROM a FULL JOIN b ON a.filter = b.filter AND a.pos = b.pos)
    SELECT filter, count(*) FILTER (x AND y) AS n_and, count(*) FILTER (x AND NOT y) AS n_mask, count(*) AS n_or, count(*) FILTER (x <> y) AS n_xor FROM j GROUP BY filter"""
LOAD_TEST = f"""{_VECTORS}, p AS (SELECT l_linenumber AS filter, l_partkey % {BITS} AS pos FROM lineitem)
    SELECT p.filter, count(a.pos) AS ones, count(*) - count(a.pos) AS zeros FROM p LEFT JOIN a ON a.filter = p.filter AND a.pos = p.pos GROUP BY p.filter"""
PRESENT = f"{_VECTORS}, p AS (SELECT DISTINCT l_orderkey AS read, l_partkey % {BITS} AS pos FROM lineitem) SELECT read, filter, count(*) AS present FROM p JOIN a USING (pos) GROUP BY ALL"
ALL_STATES = f"""{_VECTORS}, p AS (SELECT DISTINCT l_orderkey AS read, l_partkey % {BITS} AS pos FROM lineitem), f AS (SELECT DISTINCT filter FROM a)
    SELECT read, f.filter, CASE WHEN a.pos IS NULL THEN 'absent' ELSE 'present' END AS state, count(*) AS n
    FROM p CROSS JOIN f LEFT JOIN a ON a.filter = f.filter AND a.pos = p.pos GROUP BY ALL"""
DENSITY = f"WITH {_BITS} SELECT filter, count(*) AS ones, round(count(*) / {BITS}, 6) AS density FROM bits GROUP BY filter"
INTEGERS = f"WITH {_BITS} SELECT filter, string_agg(pos, ',' ORDER BY pos) AS positions FROM bits GROUP BY filter"
KINDS = f"""WITH {_BITS}, n AS (SELECT s_suppkey AS filter, count(pos) AS ones FROM supplier LEFT JOIN bits ON s_suppkey = filter GROUP BY 1)
    SELECT filter, CASE WHEN ones = 0 THEN 'zeros' WHEN ones = {BITS} THEN 'ones' ELSE 'mixed' END AS simplified FROM n"""
PACKED = f"SELECT s_nationkey AS filter, count(DISTINCT l_partkey % {BITS}) AS ones FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1"
FILTER_UNION = f"SELECT DISTINCT l_partkey % {BITS} % 4096 AS pos FROM lineitem"
FILTER_INTERSECT = f"SELECT l_partkey % {BITS} % 4096 AS pos FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_linenumber) = (SELECT count(DISTINCT l_linenumber) FROM lineitem)"
CONSISTENT = """WITH f AS (SELECT o_orderpriority, count(DISTINCT o_orderstatus) AS kinds, count(*) AS set_size FROM orders GROUP BY 1),
    c AS (SELECT 'kinds' AS parameter, count(DISTINCT kinds) AS "values" FROM f UNION ALL SELECT 'set_size', count(DISTINCT set_size) FROM f) SELECT * FROM c WHERE "values" > 1"""

CHECKSUMS = f"""WITH RECURSIVE s(n, c) AS (SELECT 0, 128::UBIGINT UNION ALL SELECT n + 1, xor(c >> 1, CASE WHEN c % 2 = 1 THEN 3988292384::UBIGINT ELSE 0::UBIGINT END) FROM s WHERE n < {BITS + 8}), {_BITS}
    SELECT filter, CAST(bit_xor(c) AS BIGINT) AS crc FROM bits JOIN s ON n = {BITS} - 8 * (pos // 8) + pos % 8 GROUP BY filter"""
EXACTLY = "SELECT DISTINCT l_suppkey AS filter, 1000 AS ones, true AS inside FROM lineitem"

# ---- distances ----------------------------------------------------------

_PAIRS = f"""WITH {_BITS}, n AS (SELECT filter, count(*) AS n FROM bits GROUP BY filter),
    x AS (SELECT a.filter AS i, b.filter AS j, count(*) AS n_both FROM bits a JOIN bits b ON a.pos = b.pos AND a.filter < b.filter GROUP BY ALL),
    p AS (SELECT a.filter AS i, b.filter AS j, a.n AS n_i, b.n AS n_j, coalesce(n_both, 0) AS n_both FROM n a JOIN n b ON a.filter < b.filter LEFT JOIN x ON x.i = a.filter AND x.j = b.filter),
    d AS (SELECT i, j, (n_i + n_j - 2 * n_both) / {BITS} AS dist FROM p)"""
DISTANCE = {
    "hamming": f"{_PAIRS} SELECT i, j, round(dist, 6) AS dist FROM d",
    "intersect": f"{_PAIRS} SELECT i, j, round(n_both / {BITS}, 6) AS dist FROM p",
    "union": f"{_PAIRS} SELECT i, j, round((n_i + n_j - n_both) / {BITS}, 6) AS dist FROM p",
}
THETA = f"{_PAIRS} SELECT i, j, round(n_both / n_i, 4) AS theta FROM p UNION ALL SELECT j, i, round(n_both / n_j, 4) FROM p"
INTERVAL = f"""WITH {_BITS}, k AS (SELECT * FROM bits WHERE pos >= 64 AND pos < 1024), f AS (SELECT DISTINCT filter FROM bits),
    n AS (SELECT f.filter, count(k.pos) AS n FROM f LEFT JOIN k USING (filter) GROUP BY 1),
    x AS (SELECT a.filter AS i, b.filter AS j, count(*) AS n_both FROM k a JOIN k b ON a.pos = b.pos AND a.filter < b.filter GROUP BY ALL)
    SELECT a.filter AS i, b.filter AS j, round((a.n + b.n - 2 * coalesce(n_both, 0)) / 960, 6) AS dist FROM n a JOIN n b ON a.filter < b.filter LEFT JOIN x ON x.i = a.filter AND x.j = b.filter"""
_EDGES = f"{_PAIRS}, e AS (SELECT i, j FROM d WHERE dist <= {CLOSE}::DOUBLE * (SELECT min(dist) FROM d)), s AS (SELECT i, j FROM e UNION ALL SELECT j, i FROM e)"
EDGES = f"{_EDGES} SELECT * FROM e"
ADJACENCY = f"{_EDGES} SELECT i AS node, string_agg(j, ' ' ORDER BY j) AS neighbours FROM s GROUP BY i"
DOT = f"{_EDGES} SELECT '  ' || i || ' -- ' || j || ';' AS line FROM e"
MATRIX = f"{_PAIRS}, s AS (SELECT i, j, dist FROM d UNION ALL SELECT j, i, dist FROM d UNION ALL SELECT filter, filter, 0 FROM n) SELECT i, string_agg(printf('%.4f', dist), ' ' ORDER BY j) AS row FROM s GROUP BY i"
HISTOGRAM = f"""{_PAIRS}, c AS (SELECT CAST(round_even(dist * 10000, 0) AS BIGINT) AS d FROM d), v AS (SELECT * FROM c UNION ALL SELECT * FROM c UNION ALL SELECT 0 FROM n),
    t AS (SELECT max(d) AS top, count(*) AS cells FROM v),
    b AS (SELECT CAST(CASE WHEN top = 0 THEN 0 ELSE least(d * 4 * (top + 1) // top, 4 * (top + 1) - 1) END AS BIGINT) AS bin, top, cells FROM v CROSS JOIN t)
    SELECT bin, count(*) AS n, round(count(*) / (cells * (CASE WHEN top = 0 THEN 1.0::DOUBLE ELSE top END / (4 * (top + 1)))), 6) AS density FROM b GROUP BY bin, top, cells"""
_GROUPS = f"WITH RECURSIVE {_EDGES[5:]}, r(node, other) AS (SELECT i, j FROM s UNION SELECT r.node, s.j FROM r JOIN s ON r.other = s.i), g AS (SELECT node, least(node, min(other)) AS root FROM r GROUP BY node)"
CLIQUES = f"""WITH RECURSIVE {_EDGES[5:]}, near AS (SELECT i AS a, list(j ORDER BY j) AS near FROM s GROUP BY i),
    g(clique, shared) AS (SELECT [a], near FROM near UNION ALL
        SELECT list_append(clique, x), list_intersect(shared, near.near) FROM (SELECT clique, shared, unnest(list_filter(shared, lambda v: v > clique[-1])) AS x FROM g) JOIN near ON near.a = x)
    SELECT array_to_string(clique, '_') AS clique, CAST(len(clique) AS INT) AS members FROM g WHERE len(shared) = 0 AND len(clique) > 1"""
COMPONENTS = f"{_GROUPS} SELECT * FROM g"
_NAMES = f"{_GROUPS}, m AS (SELECT root, string_agg(CAST(node AS VARCHAR), '_' ORDER BY CAST(node AS VARCHAR)) || '_' AS name, count(*) AS members FROM g GROUP BY root)"
MERGED = f"{_NAMES}, o AS (SELECT root, count(DISTINCT pos) AS ones FROM g JOIN bits ON filter = node GROUP BY root) SELECT root, name, members, ones FROM m JOIN o USING (root)"
MERGED_LENGTHS = f"""{_NAMES}, l AS (SELECT l_suppkey AS node, count(*) AS length FROM lineitem GROUP BY 1)
    SELECT name, CAST(floor(avg(length)) AS BIGINT) AS length FROM m JOIN g USING (root) JOIN l USING (node) GROUP BY name"""
SUPERSEDED = f"{_GROUPS} SELECT s_suppkey AS filter FROM supplier WHERE s_suppkey NOT IN (SELECT node FROM g)"

# ---- trees --------------------------------------------------------------

_NODES = """t AS (SELECT n_regionkey AS r, n_nationkey AS n, s_suppkey AS s FROM supplier JOIN nation ON s_nationkey = n_nationkey),
    v AS (SELECT r, n, s, 3 AS depth, 'S' || s AS node, 'N' || n AS parent FROM t
          UNION ALL SELECT DISTINCT r, n, -1, 2, 'N' || n, 'R' || r FROM t UNION ALL SELECT DISTINCT r, -1, -1, 1, 'R' || r, 'root' FROM t UNION ALL SELECT -1, -1, -1, 0, 'root', NULL),
    nodes AS (SELECT node, node || '.bf' AS file, CAST(depth AS BIGINT) AS depth, row_number() OVER (ORDER BY r, n, s) - 1 AS preorder, parent, depth = 3 AS is_leaf FROM v)"""
TREE_NODES = f"WITH {_NODES} SELECT * FROM nodes"
TREE_TEXT = f"WITH {_NODES} SELECT preorder, repeat('*', CAST(depth AS INT)) || node || '[' || file || ']' AS line FROM nodes"
SIBLINGS = f"WITH {_NODES} SELECT parent, string_agg(file, ',' ORDER BY file) AS members FROM nodes GROUP BY parent"
NUMBERED = f"WITH {_NODES} SELECT node, 'node' || row_number() OVER (ORDER BY depth, node) AS name FROM nodes WHERE NOT is_leaf"
_TREE = f"""WITH {_NODES}, {_BITS},
    below AS (SELECT 'S' || s AS leaf, unnest(['S' || s, 'N' || n, 'R' || r, 'root']) AS node FROM t),
    leaves AS (SELECT node, count(*) AS leaves FROM below GROUP BY node),
    c AS MATERIALIZED (SELECT node, pos, count(*) AS k FROM below JOIN bits ON leaf = 'S' || filter GROUP BY ALL),
    sets AS MATERIALIZED (SELECT node, pos, k = leaves AS in_cap FROM c JOIN leaves USING (node)),
    up AS MATERIALIZED (SELECT nodes.node, parent, s.pos, s.in_cap, coalesce(p.in_cap, false) AS up_cap FROM sets s JOIN nodes USING (node) LEFT JOIN (SELECT node, pos, in_cap FROM sets WHERE in_cap) p ON p.node = parent AND p.pos = s.pos),
    open_above AS (SELECT n.node, s.pos FROM nodes n JOIN sets s ON s.node = n.parent WHERE NOT s.in_cap UNION ALL SELECT node, pos FROM sets WHERE node = 'root'),
    det AS (SELECT node, pos, true AS how FROM up WHERE in_cap AND NOT up_cap
            UNION ALL SELECT o.node, o.pos, false FROM open_above o LEFT JOIN sets s ON s.node = o.node AND s.pos = o.pos WHERE s.pos IS NULL)"""
TREE = {
    "union": f"{_TREE} SELECT node, pos FROM sets",
    "intersection": f"{_TREE} SELECT node, pos FROM sets WHERE in_cap",
    "allsome": f"{_TREE} SELECT node, CASE WHEN in_cap THEN 0 ELSE 1 END AS bv, pos FROM up WHERE NOT (in_cap AND up_cap)",
    "determined": f"{_TREE} SELECT * FROM det",
    "brief": f"{_TREE} SELECT o.node, row_number() OVER (PARTITION BY o.node ORDER BY o.pos) - 1 AS slot, d.how IS NOT NULL AS det, d.how FROM open_above o LEFT JOIN det d ON d.node = o.node AND d.pos = o.pos",
}
BIT_STATS = f"""{_TREE}, h AS (SELECT pos, count(*) AS how_active, count(*) FILTER (how) AS how_one FROM det GROUP BY pos),
    a AS (SELECT pos, count(*) AS det_active FROM open_above GROUP BY pos)
    SELECT pos, det_active, coalesce(how_active, 0) AS how_active, coalesce(how_one, 0) AS how_one, round(coalesce(how_one, 0) / ((det_active + 1) // 2), 6) AS s_x FROM a LEFT JOIN h USING (pos)"""
NODE_STATS = f"""{_TREE}, o AS (SELECT node, count(*) AS ones FROM sets GROUP BY node),
    w AS (SELECT node, parent, depth, (SELECT count(*) FROM nodes c WHERE c.parent = x.node) AS children, (SELECT count(*) - 1 FROM nodes c WHERE c.parent IS NOT DISTINCT FROM x.parent) AS siblings,
          (SELECT count(*) FROM nodes c JOIN nodes p ON p.node = c.parent WHERE p.parent = x.parent AND p.node <> x.node) AS niblings FROM nodes x),
    i AS (SELECT 'S' || l_suppkey AS node, count(*) AS items FROM lineitem GROUP BY l_suppkey),
    a AS (SELECT unnest([v.node, CASE WHEN depth > 2 THEN 'N' || n END, CASE WHEN depth > 1 THEN 'R' || r END, CASE WHEN depth > 0 THEN 'root' END]) AS node, depth AS low FROM v),
    z AS (SELECT a.node, count(*) AS subtree, max(low) - any_value(nodes.depth) AS height FROM a JOIN nodes USING (node) GROUP BY a.node)
    SELECT node, parent, depth, children, siblings, niblings, subtree, CAST(height AS BIGINT) AS height, coalesce(ones, 0) AS ones, round(coalesce(ones, 0) / {BITS}, 6) AS density,
           items, round(1 - exp(-1 * CAST(items AS DOUBLE) / {BITS}), 6) AS fp_rate FROM w JOIN z USING (node) LEFT JOIN o USING (node) LEFT JOIN i USING (node)"""
_RATIOS = f"""{_TREE}, q AS (SELECT n.node, n.parent, n.is_leaf, count(s.pos) FILTER (NOT in_cap) AS open FROM nodes n LEFT JOIN sets s USING (node) GROUP BY ALL),
    ratios AS (SELECT q.node, q.is_leaf, coalesce(p.open, {BITS}) - CASE WHEN q.is_leaf THEN 0 ELSE q.open END AS det, coalesce(p.open, {BITS}) AS open_above FROM q LEFT JOIN q p ON p.node = q.parent),
    ratio AS (SELECT *, CASE WHEN open_above > 0 THEN det / open_above END AS ratio FROM ratios)"""
RATIOS = f"{_RATIOS} SELECT * REPLACE (round(ratio, 6) AS ratio) FROM ratio"
CULL = f"""{_RATIOS}, thr AS (SELECT least(greatest(avg(ratio) - {DEVIATIONS}::DOUBLE * stddev_pop(ratio), 0.0::DOUBLE), 1.0::DOUBLE) AS threshold FROM ratio WHERE NOT is_leaf AND open_above > 0),
    gone AS (SELECT n.node, n.parent FROM ratio CROSS JOIN thr JOIN nodes n USING (node) WHERE NOT ratio.is_leaf AND det < open_above * threshold AND n.parent IS NOT NULL),
    a AS (SELECT n.node, coalesce(g.parent, n.parent) AS parent FROM nodes n LEFT JOIN gone g ON g.node = n.parent),
    b AS (SELECT n.node, coalesce(g.parent, n.parent) AS parent FROM a n LEFT JOIN gone g ON g.node = n.parent),
    c2 AS (SELECT n.node, coalesce(g.parent, n.parent) AS parent FROM b n LEFT JOIN gone g ON g.node = n.parent)
    SELECT * FROM c2 WHERE node NOT IN (SELECT node FROM gone)"""
ORDERS = f"""{CULL[:CULL.rindex("SELECT * FROM c2")].replace("WITH ", "WITH RECURSIVE ", 1)}, left_ AS (SELECT * FROM c2 WHERE node NOT IN (SELECT node FROM gone)),
    p(node, parent, depth, path) AS (SELECT node, parent, 0, [node] FROM left_ WHERE parent IS NULL UNION ALL SELECT l.node, l.parent, p.depth + 1, list_append(p.path, l.node) FROM p JOIN left_ l ON l.parent = p.node),
    z AS (SELECT unnest(path) AS node, count(*) AS size FROM p GROUP BY 1), o AS (SELECT node, parent, depth, row_number() OVER (ORDER BY path) - 1 AS preorder FROM p)
    SELECT node, parent, CAST(depth AS BIGINT) AS depth, preorder, preorder + size - 1 - depth AS postorder FROM o JOIN z USING (node)"""
VALIDATE = f"WITH {_NODES} SELECT 'only child' AS problem, parent AS node FROM nodes WHERE parent IS NOT NULL GROUP BY parent HAVING count(*) = 1"
_VISITS = f"""{_TREE}, {_PROBES}, {_TOTALS},
    tot AS (SELECT read, total, ceil(total * 0.5) AS need FROM totals),
    k AS (SELECT read, node, sum(n) AS touched, coalesce(sum(n) FILTER (in_cap), 0) AS present FROM probes JOIN sets USING (pos) GROUP BY ALL),
    l0 AS (SELECT read, nodes.node, total, need, coalesce(present, 0) AS present, total - coalesce(touched, 0) AS absent FROM nodes CROSS JOIN tot LEFT JOIN k USING (read, node) WHERE depth = 0),
    o0 AS (SELECT *, CASE WHEN present >= need THEN 'pass' WHEN absent >= total - need + 1 THEN 'fail' ELSE 'open' END AS outcome FROM l0),"""
for _level in (1, 2, 3):
    _VISITS += f"""
    l{_level} AS (SELECT o.read, n.node, o.total, o.need, coalesce(k.present, 0) AS present, o.total - coalesce(k.touched, 0) AS absent
           FROM o{_level - 1} o JOIN nodes n ON n.parent = o.node LEFT JOIN k ON k.read = o.read AND k.node = n.node WHERE o.outcome = 'open'),
    o{_level} AS (SELECT *, CASE WHEN present >= need THEN 'pass' WHEN absent >= total - need + 1 THEN 'fail' ELSE 'open' END AS outcome FROM l{_level}),"""
_VISITS += " visits AS (SELECT * FROM o0 UNION ALL SELECT * FROM o1 UNION ALL SELECT * FROM o2 UNION ALL SELECT * FROM o3)"
EXAMINED = f"{_VISITS} SELECT CAST(read AS VARCHAR) AS read, count(*) AS examined FROM visits GROUP BY read"
TREE_STATS = f"{_VISITS} SELECT node, count(*) AS examined, count(*) FILTER (outcome = 'pass') AS passed, count(*) FILTER (outcome = 'fail') AS failed, count(*) FILTER (outcome = 'open') AS open FROM visits GROUP BY node"

# ---- identification -----------------------------------------------------

_REGIONS = f"""WITH x AS (SELECT l_orderkey AS read, n_regionkey AS strain, count(*) AS hits FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL),
    y AS (SELECT l_orderkey AS read, count(*) AS total FROM lineitem GROUP BY 1),
    found AS (SELECT read, strain, hits, total, {_FRAC} AS frac FROM x JOIN y USING (read))"""
MATCH_MATRIX = f"{_REGIONS} SELECT r.read, s.strain, coalesce(f.frac, 0) AS frac FROM (SELECT DISTINCT read FROM found) r CROSS JOIN (SELECT DISTINCT strain FROM found) s LEFT JOIN found f ON f.read = r.read AND f.strain = s.strain"
_EXACT = "CAST(frac AS DECIMAL(20, 6)) * 100"
_PCT = f"""p0 AS (SELECT *, {_EXACT} AS v FROM found), p1 AS (SELECT *, CASE WHEN v >= 10 THEN 1 WHEN v >= 1 THEN 10 ELSE 100 END AS m FROM p0),
    p2 AS (SELECT *, floor(v * m) AS f, v * m - floor(v * m) AS rest FROM p1),
    cand AS (SELECT * FROM (SELECT read, strain, CAST(floor((f + CASE WHEN rest > 0.5 OR (rest = 0.5 AND f % 2 = 1) THEN 1 ELSE 0 END) / m) AS INT) AS pct FROM p2) WHERE pct >= 10)"""
_RANKS = f"""{_REGIONS}, {_PCT}, cut AS (SELECT *, count(*) OVER (PARTITION BY read) AS n, row_number() OVER (PARTITION BY read ORDER BY pct DESC, strain) AS place FROM cand),
    dense AS (SELECT read, strain, pct, dense_rank() OVER (PARTITION BY read ORDER BY pct DESC) AS d FROM cut WHERE n < 4 AND place <= 3),
    ranks AS (SELECT read, strain, pct, max(d) OVER (PARTITION BY read) - d AS weight FROM dense)"""
RANKS_OF_READS = f"{_RANKS} SELECT * FROM ranks"
AMBIGUOUS = f"{_REGIONS}, {_PCT} SELECT read, count(*) AS candidates FROM cand GROUP BY read HAVING count(*) >= 4"
_MARGINAL = f"""{_RANKS}, lim AS (SELECT (count(DISTINCT read) + 50) // 100 AS n1, (sum(weight) + 25) // 50 AS n2 FROM ranks),
    marg AS (SELECT strain, count(*) AS reads, CAST(sum(weight) AS BIGINT) AS weight, count(*) <= any_value(n1) OR sum(weight) <= any_value(n2) AS is_marginal FROM ranks CROSS JOIN lim GROUP BY strain)"""
MARGINAL = f"{_MARGINAL} SELECT * FROM marg"
COVER = f"""{_MARGINAL}, num AS (SELECT strain, row_number() OVER (ORDER BY strain) - 1 AS bit FROM marg WHERE NOT is_marginal),
    tainted AS (SELECT DISTINCT read FROM ranks JOIN marg USING (strain) WHERE is_marginal),
    w AS (SELECT read, strain, bit, r.weight FROM ranks r JOIN num USING (strain)),
    masks AS (SELECT read, CAST(sum(1 << bit) AS BIGINT) AS mask FROM w GROUP BY read),
    cs AS (SELECT range AS chosen FROM range(1, 1 << CAST((SELECT count(*) FROM num) AS INT))),
    ok AS (SELECT chosen FROM cs WHERE NOT EXISTS (SELECT 1 FROM (SELECT DISTINCT mask FROM masks WHERE read NOT IN (SELECT read FROM tainted)) m WHERE (m.mask & cs.chosen) = 0)),
    e AS (SELECT chosen, read, bit, weight, bit_count(mask & chosen) AS covers FROM ok CROSS JOIN w JOIN masks USING (read) WHERE (chosen & (1 << bit)) <> 0),
    per AS (SELECT chosen, bit, count(*) FILTER (covers = 1) AS own, sum(weight) AS support, coalesce(sum(weight) FILTER (covers = 1), 0) AS alone FROM e GROUP BY ALL),
    won AS (SELECT a.chosen, a.bit, sum(a.weight) AS won FROM e a JOIN e b ON b.chosen = a.chosen AND b.read = a.read AND b.bit <> a.bit JOIN per p ON p.chosen = b.chosen AND p.bit = b.bit
            WHERE a.covers = 2 AND a.weight > 1 AND a.weight > b.weight AND p.alone = 0 GROUP BY ALL),
    sc AS (SELECT per.chosen, per.bit, own, support, alone + coalesce(won, 0) AS signed FROM per LEFT JOIN won USING (chosen, bit)),
    best AS (SELECT chosen FROM sc GROUP BY chosen HAVING min(own) > 0 AND count(*) = bit_count(chosen) ORDER BY count(*), sum(support) DESC, sum(signed) DESC, list(bit ORDER BY bit) LIMIT 1)
    SELECT strain, CAST(support AS BIGINT) AS support, CAST(signed AS BIGINT) AS signed FROM sc JOIN best USING (chosen) JOIN num USING (bit)"""
READ_SETS = f"{_REGIONS}, s AS (SELECT read, string_agg(strain, ',' ORDER BY strain) AS members FROM found GROUP BY read) SELECT members, count(*) AS n FROM s GROUP BY members"
ABUNDANCE = f"""{_REGIONS.replace('WITH ', 'WITH RECURSIVE ', 1)}, len AS (SELECT strain, sum(hits) AS length FROM found GROUP BY strain),
    s AS (SELECT read, list(strain ORDER BY strain) AS members FROM found GROUP BY read), sets AS (SELECT members, count(*) AS n FROM s GROUP BY members),
    each AS (SELECT members, n, unnest(members) AS strain FROM sets),
    em(step, strain, a) AS (
        SELECT 0, strain, 1.0::DOUBLE / count(*) OVER () FROM len
        UNION ALL
        SELECT step, strain, raw / sum(raw) OVER () FROM (
            SELECT any_value(step) + 1 AS step, strain, sum(n * a / whole) / any_value(length) AS raw
            FROM (SELECT e.strain, e.n, em.step, em.a, sum(em.a) OVER (PARTITION BY e.members) AS whole FROM em JOIN each e ON e.strain = em.strain WHERE em.step < 100) JOIN len USING (strain) GROUP BY strain))
    SELECT strain, round(a, 2) AS abundance FROM em WHERE step = 100"""
KEPT_SETS = f"{_REGIONS}, kept AS (SELECT strain FROM found GROUP BY strain ORDER BY sum(hits) DESC, strain LIMIT 3), s AS (SELECT read, string_agg(strain, ',' ORDER BY strain) AS members FROM found WHERE strain IN (SELECT strain FROM kept) GROUP BY read) SELECT members, count(*) AS n FROM s GROUP BY members"
KEPT_ABUNDANCE = ABUNDANCE.replace("len AS (SELECT strain, sum(hits) AS length FROM found GROUP BY strain)", "kept AS (SELECT strain FROM found GROUP BY strain ORDER BY sum(hits) DESC, strain LIMIT 3), len AS (SELECT strain, sum(hits) AS length FROM found WHERE strain IN (SELECT strain FROM kept) GROUP BY strain)").replace("AS members FROM found GROUP BY read", "AS members FROM found WHERE strain IN (SELECT strain FROM kept) GROUP BY read")
LIKELIHOOD = f"""{ABUNDANCE[:ABUNDANCE.rindex('SELECT strain, round')]}, last AS (SELECT strain, round(a, 6) AS a FROM em WHERE step = 100),
    p AS (SELECT members, any_value(n) AS n, sum(a) AS p FROM each JOIN last USING (strain) GROUP BY members) SELECT round(sum(n * ln(p)), 4) AS log_likelihood FROM p"""
CLEAN = """WITH s AS (SELECT n_regionkey AS r, count(*) / sum(count(*)) OVER () AS a FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1)
    SELECT CASE WHEN r < 2 THEN r || '_' || (r + 1) || '_' ELSE 'region' || r END AS strain, CAST(trunc(a * 100) AS INT) AS pct,
           CASE WHEN r < 2 THEN (SELECT string_agg(r_name, ' , ' ORDER BY r_regionkey) FROM region WHERE r_regionkey IN (r, r + 1)) ELSE 'region' || r END AS names FROM s"""

# ---- texts as nucleotides -----------------------------------------------

_SEQ = "translate(lower(regexp_replace(text, '[^A-Za-z]', '', 'g')), 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC')"
_RC = "reverse(translate({0}, 'ACGT', 'TGCA'))"


def _seq(table: str, key: str) -> str:
    return f"(SELECT {key} AS key, {_SEQ} AS seq FROM {table} WHERE text IS NOT NULL)"


def _windows(table: str, key: str, k: int) -> str:
    return f"(SELECT key, substr(seq, CAST(i AS INT), {k}) AS w FROM (SELECT key, seq, unnest(range(1, length(seq) - {k} + 2)) AS i FROM {_seq(table, key)}))"


def _canonical(source: str) -> str:
    return f"(SELECT key, least(w, {_RC.format('w')}) AS c FROM {source})"


_KERNEL = "(CASE {0} " + " ".join(f"WHEN '{b}' THEN {v}::UBIGINT" for b, v in KERNELS.items()) + " END)"


def _hash(source: str, k: int, modulus: int = MODULUS, valid: str = '') -> str:
    """(key, q, n) -> (key, pos, n) by one nested query per character, so that each step is computed once."""
    q = f"SELECT key, q, n, 0::UBIGINT AS h FROM {source}"
    for i in range(1, k + 1):
        q = f"SELECT key, q, n, xor(h, (h % 140737488355328::UBIGINT) * 131072::UBIGINT) AS h FROM ({q})"
        q = f"SELECT key, q, n, xor(xor(h, h >> 47), {_KERNEL.format(f'substr(q, {i}, 1)')}) AS h FROM ({q})"
    for m in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        q = f"SELECT key, q, n, xor(h, h >> 33) AS h FROM ({q})"
        q = f"SELECT key, q, n, ((h::UHUGEINT * {m}::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT AS h FROM ({q})"
    return f"(SELECT key, CAST(greatest(xor(h, h >> 33), 1) % {modulus} AS BIGINT) AS pos, CAST(sum(n) AS BIGINT) AS n FROM ({q}) GROUP BY ALL)"


def _grams(table: str, key: str) -> str:
    return f"(SELECT key, substr(c, 1, 6) || substr(c, 9, 7) AS q, count(*) AS n FROM {_canonical(_windows(table, key, 15))} GROUP BY ALL)"


CLASSIFY_READS = f"""WITH bits AS (SELECT key AS filter, pos FROM {_hash(_grams('documents', 'source'), 13)}), probes AS (SELECT key AS read, pos, n FROM {_hash(_grams('benchmark', 'item_id'), 13)}),
    {_TOTALS}, {_HITS}, {_MATCHES} SELECT *, row_number() OVER (PARTITION BY read ORDER BY hits DESC, filter) AS place FROM matches"""
QGRAMS = f"SELECT key AS lang, q AS qgram, n FROM {_grams('documents', 'lang')}"
MULTI_SEED = f"""WITH c AS {_canonical(_windows('documents', 'lang', 7))}, q AS (SELECT key, substr(c, 1, 2) || substr(c, 4, 1) || substr(c, 6, 2) AS q FROM c UNION ALL SELECT key, substr(c, 1, 3) || substr(c, 5, 3) FROM c)
    SELECT key AS lang, q AS qgram, count(*) AS n FROM q GROUP BY ALL"""
LONG_SEED = f"SELECT key AS lang, substr(c, 1, 5) || substr(c, 36, 5) AS qgram, count(*) AS n FROM {_canonical(_windows('documents', 'lang', 40))} GROUP BY ALL"
QGRAM_UNION = f"SELECT DISTINCT pos FROM {_hash(_grams('documents', 'source'), 13, 2 * MODULUS)}"
QGRAM_INTERSECTION = f"SELECT pos FROM {_hash(_grams('documents', 'source'), 13, 3_000_017)} GROUP BY pos HAVING count(*) = (SELECT count(DISTINCT source) FROM documents WHERE text IS NOT NULL)"
FILTER_STATS = f"""SELECT key AS filter, CAST(sum(n) AS BIGINT) AS set_size, count(*) AS ones, round(1 - exp(-1 * CAST(sum(n) AS DOUBLE) / {MODULUS}), 6) AS fp_rate FROM {_hash(_grams('documents', 'source'), 13)} GROUP BY key"""
CANONICAL_KMERS = f"SELECT c AS kmer, count(*) AS n FROM {_canonical(_windows('documents', 'doc_id', 11))} GROUP BY c HAVING count(*) >= 3"
_MERS = f"(SELECT 0 AS key, w AS q, 1 AS n FROM {_windows('documents', 'doc_id', 12)} GROUP BY w)"
KMER_LIST = f"SELECT pos, n AS kmers FROM {_hash(_MERS, 12)}"
STRANDS = f"SELECT true AS same, CAST(sum(greatest(length(seq) - 20, 0)) AS BIGINT) AS n FROM {_seq('documents', 'doc_id')}"
_SMALL = "translate(regexp_replace(text, '[^A-Za-z]', '', 'g'), 'abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ', 'ACGTACGTACGTACGTNCGTACGNANacgtacgtacgtacgtNcgtacgNaN')"
_READ_WINDOWS = f"(SELECT key, substr(seq, CAST(i AS INT), {{0}}) AS w FROM (SELECT key, seq, unnest(range(1, length(seq) - {{0}} + 2)) AS i FROM (SELECT lang AS key, {_SMALL} AS seq FROM documents WHERE text IS NOT NULL)))"
_ODD = f"(SELECT key, substr(c, 1, 6) || substr(c, 9, 7) AS q, count(*) AS n FROM {_canonical(_READ_WINDOWS.format(15))} GROUP BY ALL)"
_GOOD = f"(SELECT key, upper(q) AS q, CAST(sum(n) AS BIGINT) AS n FROM {_ODD} WHERE NOT contains(q, 'N') GROUP BY ALL)"
READ_QGRAMS = f"""SELECT key AS lang, pos, CAST(sum(n) AS BIGINT) AS n FROM (SELECT key, pos, n FROM {_hash(_GOOD, 13)} UNION ALL SELECT key, 0, n FROM {_ODD} WHERE contains(q, 'N')) GROUP BY ALL"""
READ_KMERS = f"SELECT least(w, {_RC.format('w')}) AS kmer, count(*) AS n FROM (SELECT upper(w) AS w FROM {_READ_WINDOWS.format(9)} WHERE NOT contains(w, 'N')) GROUP BY 1"
IUPAC = """SELECT doc_id, md5(reverse(translate(s, 'ACGT', 'TGCA'))) AS plain, md5(reverse(translate(s, 'ACGTRYKMBVDHacgtrykmbvdh', 'TGCAYRMKVBHDtgcayrmkvbhd'))) AS iupac
    FROM (SELECT doc_id, regexp_replace(text, '[^A-Za-z]', '', 'g') AS s FROM documents WHERE text IS NOT NULL)"""
FASTA = f"SELECT 'doc' || key AS name, length(seq) AS length, md5(seq) AS digest FROM {_seq('documents', 'doc_id')} WHERE length(seq) > 1"
FASTQ = f"SELECT 'queryr' || key AS name, md5(seq) AS digest, md5(['@', '+', '>', '5'][key % 4 + 1] || translate(substr(seq, 2), 'ACGT', '@+>5')) AS quality FROM {_seq('documents', 'doc_id')} WHERE length(seq) > 1"
REVCOMP = f"SELECT key AS doc_id, md5({_RC.format('seq')}) AS plain, md5(lower({_RC.format('seq')})) AS iupac FROM {_seq('documents', 'doc_id')}"
_READS = f"""r AS (SELECT key AS read, seq, length(seq) AS n, length(seq) - length(replace(seq, 'A', '')) AS a, length(seq) - length(replace(seq, 'C', '')) AS c,
    length(seq) - length(replace(seq, 'G', '')) AS g, length(seq) - length(replace(seq, 'T', '')) AS t FROM {_seq('documents', 'doc_id')}),
    k AS (SELECT read, n AS length, CASE WHEN n > 0 THEN -10 * log10((a * 0.1::DOUBLE + c * 0.01::DOUBLE + g * 0.001::DOUBLE + t * 0.0001::DOUBLE) / n) END AS quality FROM r)"""
READ_FILTER = f"WITH {_READS} SELECT read, length, round(quality, 4) AS quality FROM k WHERE length > 500 AND quality >= 14.5"
READ_FILTER_LINES = f"""WITH {_READS}, e AS (SELECT read, n AS length, -10 * log10((a * 0.1::DOUBLE + c * 0.01::DOUBLE + g * 0.001::DOUBLE + t * 0.0001::DOUBLE + pow(10.0::DOUBLE, 2.3::DOUBLE)) / (n + 1)) AS quality FROM r)
    SELECT read, length, round(quality, 4) AS quality FROM e WHERE length + 1 > 500 AND quality >= 6"""
READ_SUMMARY = f"""WITH {_READS} SELECT count(*) AS reads, CAST(floor(avg(length)) AS BIGINT) AS mean_length, count(*) FILTER (length > 500 AND quality >= 14.5) AS kept,
    CAST(floor(avg(length) FILTER (length > 500 AND quality >= 14.5)) AS BIGINT) AS kept_mean_length FROM k"""
FIRST_READS = f"SELECT key AS read_ix, length(seq) AS length FROM {_seq('documents', 'doc_id')} ORDER BY key LIMIT 50"
LIST_LINES = """SELECT o_orderpriority[1:1] AS list, o_orderkey, CAST(row_number() OVER w - 1 + coalesce(sum(CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS line_no
    FROM orders WINDOW w AS (PARTITION BY o_orderpriority[1:1] ORDER BY o_orderkey)"""
FILTER_TABLES = f"WITH {_BITS}, n AS (SELECT l_suppkey AS filter, count(*) AS set_size FROM lineitem GROUP BY 1) SELECT filter, {BITS}::BIGINT AS modulus, any_value(set_size) AS set_size, count(*) AS ones, CAST(sum(pos) AS BIGINT) AS positions FROM bits JOIN n USING (filter) GROUP BY filter"
LENGTH_FALLBACK = "SELECT 'strain_' || s_suppkey AS strain, length FROM supplier LEFT JOIN (SELECT l_suppkey, count(*) AS length FROM lineitem WHERE l_suppkey % 7 <> 0 GROUP BY 1) ON l_suppkey = s_suppkey"
READ_SUMMARY_LINES = f"""WITH {_READS}, e AS (SELECT read, n + 1 AS length, -10 * log10((a * 0.1::DOUBLE + c * 0.01::DOUBLE + g * 0.001::DOUBLE + t * 0.0001::DOUBLE + pow(10.0::DOUBLE, 2.3::DOUBLE)) / (n + 1)) AS quality FROM r)
    SELECT count(*) AS reads, CAST(floor(avg(length)) AS BIGINT) AS mean_length, count(*) FILTER (length > 500 AND quality >= 6) AS kept,
    CAST(floor(avg(length) FILTER (length > 500 AND quality >= 6)) AS BIGINT) AS kept_mean_length FROM e"""
LENGTHS = f"SELECT key AS strain, CAST(sum(length(seq)) AS BIGINT) AS length, count(*) AS n_seq FROM {_seq('documents', 'source')} GROUP BY key"
BLOOM_SIZE = f"WITH l AS ({LENGTHS}), m AS (SELECT greatest(max(length) - 14, 0) AS max_length FROM l) SELECT max_length, CAST(round_even(-max_length / ln(0.99), 0) AS BIGINT) AS num_bits FROM m"

# ---- names --------------------------------------------------------------

NAME_RULES = r"""WITH f AS (SELECT p_partkey, replace(p_name, ' ', '.') || ['.fna.bf', '.fasta.detbrief.rrr.bf', '.bf', '_.fna'][p_partkey % 4 + 1] AS file FROM part),
    h AS (SELECT *, string_split(file, '.bf')[1] AS head FROM f)
    SELECT p_partkey,
        regexp_replace(regexp_replace(regexp_replace(regexp_replace(file, '\.bf$', ''), '\.unity$', ''), '\.(rrr|roar)$', ''), '\.(allsome|det|detbrief)$', '') AS filter_name,
        CASE WHEN contains(file, '.fna') THEN string_split(head, '.fna')[1] WHEN contains(file, '.fasta') THEN string_split(head, '.fasta')[1] WHEN contains(file, '.bf') THEN head ELSE string_split(file, ' ')[1] END AS matrix_name,
        CASE WHEN contains(head, '.fasta') THEN string_split(head, '.fasta')[1] ELSE string_split(head, '.fna')[1] END AS ident_name,
        CASE WHEN contains(file, '.fna') OR contains(file, '.fasta') THEN regexp_replace(regexp_replace(file, '\.[^.]*$', ''), '_$', '') ELSE file END AS em_name,
        regexp_replace(file, '\.[^.]*\.[^.]*$', '') AS clean_name, regexp_replace(file, '\.[^.]*$', '') AS length_name,
        regexp_matches(file, '\.(fasta|fa|fna)$') AS is_genome, replace(file, '_', '-') AS dashed FROM h"""
