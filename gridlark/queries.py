"""One query for each operator, over the driver's tables, with the same in DuckDB's SQL.

Requests come from ``orders``; small tables stand as VALUES in the SQL.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .cluster import ship
from .functions import fixed, hashing
from .functions.scalar import block_mask, crossing, nearest, on_block, zone
from .operators import calibrate, estimate, exact, features, gbm, potentials, reuse, score
from .plans import arch as archs
from .plans import chip
from .plans.lineage import cut, shared_folder
from .sources import requests as reqs
from .streaming import estimates as streams

LINES_X, LINES_Y, BLOCKS = fixed.VERTICAL_LINES, fixed.HORIZONTAL_LINES, fixed.BLOCKS
MINI_BLOCK = (4, 6, 5, 7, False, 0, True, 11)
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _values(name: str, cols: str, rows: list[tuple]) -> str:
    lit = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else f"'{v}'" if isinstance(v, str) else str(v)
    return f"{name}({cols}) AS (VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)})"


def _all_requests(spark: SparkSession, sf: str) -> DataFrame:
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    i = lambda x: x.cast("int")
    return _read(spark, sf, "orders").select(
        "o_orderkey", "o_custkey", i((o * 7 + 3) % 120).alias("sx"), i((o * 13 + 5) % 550).alias("sy"), i((c * 11 + 1) % 120).alias("tx"),
        i((o * 29 + c) % 550).alias("ty"), i((o * 17) % 496).alias("sp"), i((c * 19) % 496).alias("tp"),
    )


def _spread_out(df: DataFrame) -> DataFrame:
    """Rows over at least as many partitions as there are cores; a table of one small file is read by one task."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= n else df.repartition(n)


def _requests(spark: SparkSession, sf: str) -> DataFrame:
    r = _spread_out(_all_requests(spark, sf))
    return r.where(~on_block(F.col("sx"), F.col("sy"), BLOCKS) & ~on_block(F.col("tx"), F.col("ty"), BLOCKS))


def _block_sql(x: str, y: str) -> str:
    return "(" + " OR ".join(f"({x} BETWEEN {b[2]} AND {b[3]} AND {y} BETWEEN {b[0]} AND {b[1]})" for b in BLOCKS) + ")"


ALL_SQL = """allreq AS (SELECT o_orderkey, o_custkey, ((o_orderkey*7+3)%120)::INT AS sx, ((o_orderkey*13+5)%550)::INT AS sy, ((o_custkey*11+1)%120)::INT AS tx,
  ((o_orderkey*29+o_custkey)%550)::INT AS ty, ((o_orderkey*17)%496)::INT AS sp, ((o_custkey*19)%496)::INT AS tp FROM orders)"""
REQ_SQL = f"{ALL_SQL}, req AS (SELECT * FROM allreq WHERE NOT {_block_sql('sx', 'sy')} AND NOT {_block_sql('tx', 'ty')})"


@cache
def _names_sql() -> str:
    return _values("names", "port_id, name", list(enumerate(chip.port_names())))


def _full(spark: SparkSession) -> archs.Arch:
    return archs.chip(spark, [(n, "Output" if n[0] == "Z" else "Input") for n in chip.port_names()], [], chip.nets())


def _mini(spark: SparkSession) -> archs.Arch:
    return archs.synthetic(spark, 12, 12, 6, blocks=[MINI_BLOCK])


_M = archs.synthetic(None, 12, 12, 6, blocks=[MINI_BLOCK])

# ---- pins and sites


@query(f"WITH {REQ_SQL}, {_names_sql()} SELECT o_orderkey, 'SRB_'||sx||'_'||sy||'/'||a.name AS from_pin, 'SRB_'||tx||'_'||ty||'/'||b.name AS to_pin, sx, sy, sp, tx, ty, tp FROM req JOIN names a ON a.port_id = sp JOIN names b ON b.port_id = tp")
def pin_format_parse(spark: SparkSession, sf: str) -> DataFrame:
    arch = _full(spark)
    r = _requests(spark, sf)
    for text, e in (("from_pin", "s"), ("to_pin", "t")):
        n = F.broadcast(arch.ports.select(F.col("port_id").alias(f"{e}p"), "name"))
        r = r.join(n, f"{e}p").withColumn(text, reqs.format_pin(F.col(f"{e}x"), F.col(f"{e}y"), F.col("name"))).drop("name")
    p = reqs.parse_pins(r.select("o_orderkey", "from_pin", "to_pin"), arch, {"from_pin": "s", "to_pin": "t"})
    return p.where("s_error is null and t_error is null").select("o_orderkey", "from_pin", "to_pin", F.col("s_x").alias("sx"), F.col("s_y").alias("sy"), F.col("s_port").alias("sp"), F.col("t_x").alias("tx"), F.col("t_y").alias("ty"), F.col("t_port").alias("tp"))


_BROKEN = {0: "concat('PIN_', x, '_', y, '/ZDE[0]')", 1: "concat('SRB_', x, '_', y)", 2: "concat('SRB_', x, 'x_', y, '/ZDE[0]')", 3: "concat('SRB_', x + 60, '_', y, '/ZDE[0]')", 4: "concat('SRB_', x, '_', y, '/NONE')"}


@query(f"""WITH {ALL_SQL}, r AS (SELECT o_orderkey, sx AS x, sy AS y, (o_orderkey % 7)::INT AS k FROM allreq)
SELECT o_orderkey, CASE k WHEN 0 THEN 'bad prefix' WHEN 1 THEN 'malformed pin' WHEN 2 THEN 'bad coordinate' ELSE
  CASE WHEN k = 3 AND x + 60 >= 120 THEN 'outside the array' WHEN k = 3 AND {_block_sql('(x + 60)', 'y')} THEN 'on a block' WHEN k <> 3 AND {_block_sql('x', 'y')} THEN 'on a block' WHEN k = 4 THEN 'unknown port' END END AS error FROM r""")
def block_site_reject(spark: SparkSession, sf: str) -> DataFrame:
    r = _all_requests(spark, sf).select("o_orderkey", F.col("sx").alias("x"), F.col("sy").alias("y"))
    text = F.expr("concat('SRB_', x, '_', y, '/ZDE[0]')")
    for k, e in _BROKEN.items():
        text = F.when(F.col("o_orderkey") % 7 == k, F.expr(e)).otherwise(text)
    return reqs.parse_pins(r.select("o_orderkey", text.alias("pin")), _full(spark), {"pin": "p"}).select("o_orderkey", F.col("p_error").alias("error"))


def _raw_sites_sql(w: int, h: int, blocks: list[tuple]) -> str:
    on = " OR ".join(f"(x BETWEEN {b[2]} AND {b[3]} AND y BETWEEN {b[0]} AND {b[1]})" for b in blocks) or "false"
    return f"cells AS (SELECT x.i::INT AS x, y.i::INT AS y FROM range({w}) x(i), range({h}) y(i)), sites AS (SELECT x, y, (row_number() OVER (ORDER BY y, x) - 1)::INT AS site_id FROM cells WHERE NOT ({on}))"


@query(f"WITH {REQ_SQL}, {_raw_sites_sql(120, 550, BLOCKS)} SELECT o_orderkey, a.site_id AS source_site, b.site_id AS target_site FROM req JOIN sites a ON a.x = sx AND a.y = sy JOIN sites b ON b.x = tx AND b.y = ty")
def site_ids(spark: SparkSession, sf: str) -> DataFrame:
    s = _full(spark).sites
    r = _requests(spark, sf)
    a, b = s.select(F.col("x").alias("sx"), F.col("y").alias("sy"), F.col("site_id").alias("source_site")), s.select(F.col("x").alias("tx"), F.col("y").alias("ty"), F.col("site_id").alias("target_site"))
    return r.join(a, ["sx", "sy"]).join(b, ["tx", "ty"]).select("o_orderkey", "source_site", "target_site")


# ---- gaps


def _cross_sql(a: str, b: str, lines: list[tuple[int, int]], what: str) -> str:
    term = {"delay": lambda i, d: d, "count": lambda i, d: 1, "mask": lambda i, d: 1 << i}[what]
    return "(" + " + ".join(f"CASE WHEN least({a},{b}) <= {s} AND {s} < greatest({a},{b}) THEN {term(i, d)} ELSE 0 END" for i, (s, d) in enumerate(lines)) + ")"


@query(f"WITH {REQ_SQL} SELECT o_orderkey, " + ", ".join(f"{_cross_sql(a, b, ls, w)}::INT AS {n}_{w}" for n, a, b, ls in (("v", "sx", "tx", LINES_X), ("h", "sy", "ty", LINES_Y)) for w in ("delay", "count", "mask")) + " FROM req")
def gap_crossing(spark: SparkSession, sf: str) -> DataFrame:
    v, h = crossing(F.col("sx"), F.col("tx"), LINES_X), crossing(F.col("sy"), F.col("ty"), LINES_Y)
    return _requests(spark, sf).select("o_orderkey", *[c.cast("int").alias(f"{n}_{w}") for n, cs in (("v", v), ("h", h)) for c, w in zip(cs, ("delay", "count", "mask"), strict=True)])


@query(f"""WITH {REQ_SQL}, {_values('vl', 'site, delay', LINES_X)}, {_values('hl', 'site, delay', LINES_Y)}
SELECT o_orderkey, (coalesce((SELECT sum(delay) FROM vl WHERE least(sx,tx) <= site AND site < greatest(sx,tx)), 0) + coalesce((SELECT sum(delay) FROM hl WHERE least(sy,ty) <= site AND site < greatest(sy,ty)), 0))::INT AS line_delay FROM req""")
def prefix_line_delay(spark: SparkSession, sf: str) -> DataFrame:
    """The delay of all lines between two sites as differences of prefix sums."""
    r, pre = _requests(spark, sf), _full(spark).prefix
    for c, a in (("sx", "x"), ("tx", "x"), ("sy", "y"), ("ty", "y")):
        r = r.join(F.broadcast(pre.where(F.col("axis") == a).select(F.col("pos").alias(c), F.col("delay").alias(f"p_{c}"))), c)
    return r.select("o_orderkey", (F.abs(F.col("p_sx") - F.col("p_tx")) + F.abs(F.col("p_sy") - F.col("p_ty"))).cast("int").alias("line_delay"))


def _mask_sql() -> str:
    return "(" + " + ".join(f"CASE WHEN least(sx,tx) <= {b[3]} AND greatest(sx,tx) >= {b[2]} AND least(sy,ty) <= {b[1]} AND greatest(sy,ty) >= {b[0]} THEN {1 << i} ELSE 0 END" for i, b in enumerate(BLOCKS)) + ")"


@query(f"WITH {REQ_SQL} SELECT o_orderkey, {_mask_sql()}::INT AS blocks FROM req")
def block_overlap(spark: SparkSession, sf: str) -> DataFrame:
    return _requests(spark, sf).select("o_orderkey", block_mask(F.col("sx"), F.col("sy"), F.col("tx"), F.col("ty"), BLOCKS).cast("int").alias("blocks"))


def _zone_sql(c: str, lines: list) -> str:
    return "(" + " + ".join(f"({s} < {c})::INT" for s, _ in lines) + ")"


def _near_sql(c: str, lines: list) -> str:
    return "least(" + ", ".join(f"abs({c}-{s})" for s, _ in lines) + ")"


_ENDS = (("sx", LINES_X), ("sy", LINES_Y), ("tx", LINES_X), ("ty", LINES_Y))


@query(f"WITH {REQ_SQL} SELECT o_orderkey, " + ", ".join(f"{_zone_sql(c, ls)}::INT AS zone_{c}, {_near_sql(c, ls)}::INT AS near_{c}" for c, ls in _ENDS) + " FROM req")
def gap_zones(spark: SparkSession, sf: str) -> DataFrame:
    cols = [c for n, ls in _ENDS for c in (zone(F.col(n), ls).cast("int").alias(f"zone_{n}"), nearest(F.col(n), ls).cast("int").alias(f"near_{n}"))]
    return _requests(spark, sf).select("o_orderkey", *cols)


@query(f"""WITH {REQ_SQL} SELECT (sign(tx-sx)::INT + 1) * 3 + sign(ty-sy)::INT + 1 AS direction, count(*) AS n, sum({_cross_sql('sx', 'tx', LINES_X, 'delay')} + {_cross_sql('sy', 'ty', LINES_Y, 'delay')})::BIGINT AS delay,
  round(avg({_cross_sql('sx', 'tx', LINES_X, 'delay')} + {_cross_sql('sy', 'ty', LINES_Y, 'delay')}), 6) AS mean_delay FROM req GROUP BY 1""")
def delay_by_direction(spark: SparkSession, sf: str) -> DataFrame:
    d = crossing(F.col("sx"), F.col("tx"), LINES_X)[0] + crossing(F.col("sy"), F.col("ty"), LINES_Y)[0]
    way = features.displacement(F.col("sx"), F.col("sy"), F.col("tx"), F.col("ty"))["direction"]
    return _requests(spark, sf).groupBy(way.cast("int").alias("direction")).agg(F.count(F.lit(1)).alias("n"), F.sum(d).cast("long").alias("delay"), F.round(F.avg(d), 6).alias("mean_delay"))


# ---- features


def _side_sql(c: str) -> str:
    return f"CASE WHEN {c} < 76 THEN 0 WHEN {c} <= 89 THEN 1 ELSE 2 END"


def _open_sql(c: str) -> str:
    return f"CASE WHEN {c} % 100 >= 50 THEN 0 ELSE least(50 - {c} % 100, {c} % 100 + 1) END"


_PORTS_SQL = f"""{_names_sql()}, fam AS (SELECT port_id, name, regexp_replace(name, '\\[\\d+\\]$', '') AS f, coalesce(try_cast(nullif(regexp_extract(name, '\\[(\\d+)\\]$', 1), '') AS INT), 0) AS lane, name[1] AS a FROM names),
  cut AS (SELECT *, CASE WHEN a IN ('Z','I') THEN name[2] ELSE '-' END AS w, CASE WHEN a IN ('Z','I') THEN name[3] ELSE '-' END AS c, CASE WHEN a IN ('Z','I') AND length(f) = 4 THEN name[4] ELSE '-' END AS v,
    CASE WHEN a IN ('A','S') THEN name[3] ELSE '-' END AS b, CASE WHEN a IN ('A','S') THEN name[4:] ELSE '-' END AS s FROM fam),
  fid AS (SELECT f, (row_number() OVER (ORDER BY min(port_id)) - 1)::INT AS family FROM cut GROUP BY f), sid AS (SELECT s, (row_number() OVER (ORDER BY min(port_id)) - 1)::INT AS suffix FROM cut GROUP BY s),
  ports AS (SELECT port_id, family, lane, (instr('ZIAS', a) - 1)::INT AS domain, (instr('SDQL-', w) - 1)::INT AS wire, (instr('ENSW-', c) - 1)::INT AS compass, (instr('AB-', v) - 1)::INT AS variant, (instr('ABCDEFGH-', b) - 1)::INT AS bank, suffix FROM cut JOIN fid USING (f) JOIN sid USING (s))"""


@query(f"WITH {REQ_SQL}, {_PORTS_SQL} SELECT o_orderkey, " + ", ".join(f"{e}.{p} AS {e}_{p}" for p in features.PORT_PARTS for e in "st") + " FROM req JOIN ports s ON s.port_id = sp JOIN ports t ON t.port_id = tp")
def port_decode(spark: SparkSession, sf: str) -> DataFrame:
    codes = features.decode_ports(_full(spark).ports)
    r = _requests(spark, sf)
    for e in "st":
        r = r.join(F.broadcast(codes.withColumnsRenamed({p: f"{e}_{p}" for p in features.PORT_PARTS} | {"port_id": f"{e}p"})), f"{e}p")
    return r.select("o_orderkey", *[f"{e}_{p}" for p in features.PORT_PARTS for e in "st"])


def _feature_sql() -> str:
    """All 105 features; the search features are made from the request's numbers."""
    d = {"dx": "(tx-sx)", "dy": "(ty-sy)"}
    mid = ["((sx+tx)//2)", "((sy+ty)//2)"]
    vm, hm, bm = _cross_sql("sx", "tx", LINES_X, "mask"), _cross_sql("sy", "ty", LINES_Y, "mask"), _mask_sql()
    zs = [_zone_sql(c, ls) for c, ls in _ENDS]
    near = [_near_sql(c, ls) for c, ls in (_ENDS[0], _ENDS[2], _ENDS[1], _ENDS[3])]
    out = ["sx", "sy", "tx", "ty", d["dx"], d["dy"], "abs(tx-sx)", "abs(ty-sy)", "abs(tx-sx)+abs(ty-sy)", "greatest(abs(tx-sx),abs(ty-sy))", "sp", "tp", "(sign(tx-sx)+1)*3+sign(ty-sy)+1", *mid]
    out += [_cross_sql("sx", "tx", LINES_X, "delay"), _cross_sql("sy", "ty", LINES_Y, "delay"), _cross_sql("sx", "tx", LINES_X, "count"), _cross_sql("sy", "ty", LINES_Y, "count"), bm, *zs, f"{zs[0]}*6+{zs[1]}", f"{zs[2]}*6+{zs[3]}", *near]
    out += ["abs(tx-sx)%10", "abs(ty-sy)%12", vm, hm] + [f"{e}.{p}" for p in features.PORT_PARTS for e in "st"]
    out += ["sy%100", "ty%100", f"{mid[1]}%100", "sy//50", "ty//50", _side_sql("sx"), _side_sql("tx"), "((sx < 76 AND tx > 89) OR (tx < 76 AND sx > 89))::INT", _open_sql("sy"), _open_sql("ty")]
    out += [f"({m} >> {i}) & 1" for m, n in ((vm, 14), (hm, 5), (bm, 7)) for i in range(n)]
    out += [f"((o_orderkey * {7 + i} + o_custkey) % 5000)" if i % 6 else "-1" for i in range(19)]
    return ", ".join(f"({x})::INT AS f{i}" for i, x in enumerate(out))


@query(f"WITH {REQ_SQL}, {_PORTS_SQL} SELECT o_orderkey, {_feature_sql()} FROM req JOIN ports s ON s.port_id = sp JOIN ports t ON t.port_id = tp")
def model_features(spark: SparkSession, sf: str) -> DataFrame:
    r = _requests(spark, sf)
    search = [((F.col("o_orderkey") * (7 + i) + F.col("o_custkey")) % 5000).cast("int").alias(n) if i % 6 else F.lit(None).cast("int").alias(n) for i, n in enumerate(fixed.SEARCH_COLUMNS)]
    arch = _full(spark)
    codes = features.decode_ports(arch.ports)
    r = r.select("*", *search)
    for e in "st":
        r = r.join(F.broadcast(codes.withColumnsRenamed({p: f"{e}_{p}" for p in features.PORT_PARTS} | {"port_id": f"{e}p"})), f"{e}p")
    return r.select("o_orderkey", *[c.alias(f"f{i}") for i, c in enumerate(features.feature_columns(arch))])


# ---- walks, macros, potentials


def _walk_sql(w: int, h: int, blocks: list[tuple], lx: list, ly: list, nets: list[tuple]) -> str:
    """CTEs up to walk(net_id, from_x, from_y, to_x, to_y, block_delay, line_delay), by ranks."""
    inside = lambda k: " OR ".join(f"(x BETWEEN {b[2]} AND {b[3]} AND y BETWEEN {b[0]} AND {b[1]})" for b in blocks if b[k]) or "false"
    passed_x = " + ".join(f"CASE WHEN y BETWEEN {b[0]} AND {b[1]} AND x >= {b[2]} THEN {b[7]} ELSE 0 END" for b in blocks if b[6]) or "0"
    passed_y = " + ".join(f"CASE WHEN x BETWEEN {b[2]} AND {b[3]} AND y >= {b[0]} THEN {b[5]} ELSE 0 END" for b in blocks if b[4]) or "0"
    line = lambda a, b, ls: "(" + (" + ".join(f"CASE WHEN least({a},{b}) <= {s} AND {s} < greatest({a},{b}) THEN {d} ELSE 0 END" for s, d in ls) or "0") + ")"
    return f"""{_raw_sites_sql(w, h, blocks)}, {_values('net', 'net_id, fp, tp, dx, dy', [(i, *n) for i, n in enumerate(nets)])},
  rx AS (SELECT x, y, sum(CASE WHEN {inside(6)} THEN 0 ELSE 1 END) OVER (PARTITION BY y ORDER BY x) AS r, {passed_x} AS p, ({inside(6)}) AS i FROM cells),
  ry AS (SELECT x, y, sum(CASE WHEN {inside(4)} THEN 0 ELSE 1 END) OVER (PARTITION BY x ORDER BY y) AS r, {passed_y} AS p, ({inside(4)}) AS i FROM cells),
  sx_ AS (SELECT rx.* FROM rx JOIN sites USING (x, y) WHERE NOT i), sy_ AS (SELECT ry.* FROM ry JOIN sites USING (x, y) WHERE NOT i),
  walk AS (SELECT net_id, a.x AS from_x, a.y AS from_y, b.x AS to_x, b.y AS to_y, abs(b.p - a.p)::INT AS block_delay, {line('a.x', 'b.x', lx)}::INT AS line_delay FROM net JOIN sx_ a ON dx <> 0 JOIN sx_ b ON b.y = a.y AND b.r = a.r + dx
    UNION ALL SELECT net_id, a.x, a.y, b.x, b.y, abs(b.p - a.p)::INT, {line('a.y', 'b.y', ly)}::INT FROM net JOIN sy_ a ON dx = 0 JOIN sy_ b ON b.x = a.x AND b.r = a.r + dy)"""


_WALK = _walk_sql(120, 550, BLOCKS, LINES_X, LINES_Y, chip.nets())


@query(f"WITH {REQ_SQL}, {_WALK} SELECT o_orderkey, net_id, to_x, to_y, block_delay, line_delay FROM req JOIN walk ON from_x = sx AND from_y = sy")
def net_walk(spark: SparkSession, sf: str) -> DataFrame:
    """All 160 nets from the source of every request."""
    w = _full(spark).walks
    return _requests(spark, sf).join(w, (F.col("sx") == F.col("from_x")) & (F.col("sy") == F.col("from_y"))).select("o_orderkey", "net_id", "to_x", "to_y", "block_delay", "line_delay")


@query(f"WITH {REQ_SQL}, {_WALK} SELECT o_orderkey, net_id, from_x, from_y, block_delay, line_delay FROM req JOIN walk ON to_x = tx AND to_y = ty")
def reverse_walk(spark: SparkSession, sf: str) -> DataFrame:
    """All 160 nets into the target of every request."""
    w = _full(spark).reverse_walks()
    return _requests(spark, sf).join(w, (F.col("tx") == F.col("to_x")) & (F.col("ty") == F.col("to_y"))).select("o_orderkey", "net_id", "from_x", "from_y", "block_delay", "line_delay")


_ARCS = _values("arc", "arc_ord, fp, tp, delay", [(i, *a) for i, a in enumerate(_M.arc_list)])
_INTERNAL = _values("internal", "port_id, id", list(_M.internal.items()))
_MINI = f"{_walk_sql(12, 12, [MINI_BLOCK], _M.vertical, _M.horizontal, _M.net_list)}, {_ARCS}, {_INTERNAL}, macro AS (SELECT a.id AS from_internal, b.id AS to_internal, net_id, arc.delay AS arc_delay FROM arc JOIN net ON net.fp = arc.tp JOIN internal a ON a.port_id = arc.fp JOIN internal b ON b.port_id = net.tp)"
_VARIANT = "variant AS (SELECT net_id, to_x - from_x AS dx, to_y - from_y AS dy, min(block_delay + line_delay) AS cost FROM walk GROUP BY ALL)"
_DIRS = _values("dir", "direction, ux, uy", [(i, *d) for i, d in enumerate(fixed.DIRECTIONS)])
_RELAXED = f"{_VARIANT}, {_DIRS}, relaxed AS (SELECT from_internal AS a, to_internal AS b, dx, dy, arc_delay + cost AS cost FROM macro JOIN variant USING (net_id)), scalar AS (SELECT direction, ux, uy, coalesce(min(CASE WHEN ux*dx+uy*dy > 0 THEN (256*cost)//(ux*dx+uy*dy) END), 0)::BIGINT AS scalar FROM dir, relaxed GROUP BY ALL)"
_REDUCED = "reduced AS (SELECT direction, a, b, min(256*cost - scalar*(ux*dx+uy*dy))::BIGINT AS weight FROM scalar, relaxed GROUP BY ALL)"
_SQUARE = "SELECT l.direction, l.a, r.b, min(l.d + r.d) AS d FROM {0} l JOIN {0} r ON l.direction = r.direction AND l.b = r.a GROUP BY ALL"
_CLOSURE = f"{_REDUCED}, c0 AS (SELECT direction, a, b, min(d) AS d FROM (SELECT direction, a, b, weight AS d FROM reduced UNION ALL SELECT direction, id, id, 0 FROM dir, internal) GROUP BY ALL), c1 AS ({_SQUARE.format('c0')}), c2 AS ({_SQUARE.format('c1')}), c3 AS ({_SQUARE.format('c2')})"


@query(f"WITH {_MINI} SELECT * FROM macro")
def macro_join(spark: SparkSession, sf: str) -> DataFrame:
    return _mini(spark).macros


@query(f"WITH {_MINI}, {_VARIANT} SELECT net_id, dx, dy, cost FROM variant")
def net_variants_min(spark: SparkSession, sf: str) -> DataFrame:
    return potentials.variants(_mini(spark))


@query(f"WITH {_MINI}, {_RELAXED} SELECT direction, scalar FROM scalar")
def direction_scalars(spark: SparkSession, sf: str) -> DataFrame:
    a = _mini(spark)
    return potentials.scalars(potentials.relaxed(a, potentials.variants(a)))


@query(f"WITH {_MINI}, {_RELAXED}, {_CLOSURE} SELECT direction, a, b, d::BIGINT AS d FROM c3")
def minplus_closure(spark: SparkSession, sf: str) -> DataFrame:
    a = _mini(spark)
    e = potentials.relaxed(a, potentials.variants(a))
    return potentials.closure(potentials.reduced(e, potentials.scalars(e)))


_TERM = f"{_values('term', 'internal, target, cost', [])}".replace("(VALUES )", "(SELECT id, port_id, 0 FROM internal UNION ALL SELECT id, arc.tp, min(arc.delay) FROM internal JOIN arc ON arc.fp = internal.port_id WHERE arc.tp <> internal.port_id GROUP BY ALL)")
_POT = f"{_TERM}, pot AS (SELECT direction, target, a AS internal, min(d + 256*cost) AS pot FROM c3 JOIN term ON term.internal = c3.b GROUP BY ALL)"


@query(f"WITH {_MINI}, {_RELAXED}, {_CLOSURE}, {_POT} SELECT direction, target::INT AS target, internal, pot::BIGINT AS pot FROM pot")
def target_potentials(spark: SparkSession, sf: str) -> DataFrame:
    p = potentials.Potentials(_mini(spark)).frame()
    return p.select(F.col("target_port").alias("target"), F.col("internal_id").alias("internal"), F.posexplode("pot").alias("direction", "pot")).where("pot is not null").select("direction", "target", "internal", "pot")


# ---- estimates and exact search on a small grid


def _small(spark: SparkSession, sf: str) -> DataFrame:
    """Requests on the small grid: 24 sources and up to 50 targets."""
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    r = _read(spark, sf, "orders").select("o_orderkey", (o % 24).alias("a"), (c % 50).alias("b"))
    i = lambda x: x.cast("int")
    return r.select("o_orderkey", i(F.col("a") * 5 % 12).alias("sx"), i(F.col("a") * 7 % 4).alias("sy"), i(F.col("a") % 6).alias("sp"), i(F.col("b") * 7 % 12).alias("tx"), i(F.col("b") % 4).alias("ty"), i(F.col("b") % 6).alias("tp"))


_SMALL = "small AS (SELECT o_orderkey, (a*5%12)::INT AS sx, (a*7%4)::INT AS sy, (a%6)::INT AS sp, (b*7%12)::INT AS tx, (b%4)::INT AS ty, (b%6)::INT AS tp FROM (SELECT o_orderkey, o_orderkey%24 AS a, o_custkey%50 AS b FROM orders)), pairs AS (SELECT DISTINCT sx, sy, sp, tx, ty, tp FROM small)"
_HOPS = """hop AS (SELECT port_id AS sp, 0 AS o1, 0 AS o2, NULL AS net_id, id AS internal, 0 AS arc_delay FROM internal
  UNION ALL SELECT fp, 1, net_id, net_id, internal.id, 0 FROM net JOIN internal ON internal.port_id = net.tp
  UNION ALL SELECT arc.fp, 2, arc_ord * 1000 + net_id, net_id, internal.id, arc.delay FROM arc JOIN net ON net.fp = arc.tp JOIN internal ON internal.port_id = net.tp),
  land AS (SELECT pairs.*, o1, o2, internal, coalesce(to_x, sx) AS x, coalesce(to_y, sy) AS y, (arc_delay + coalesce(block_delay + line_delay, 0))::INT AS initial
    FROM pairs JOIN hop USING (sp) LEFT JOIN walk ON walk.net_id = hop.net_id AND from_x = sx AND from_y = sy WHERE hop.net_id IS NULL OR walk.net_id IS NOT NULL)"""
_DIRECT = "(SELECT min(delay) FROM arc WHERE arc.fp = p.sp AND arc.tp = p.tp AND p.sx = p.tx AND p.sy = p.ty)"
_SAME = "(p.sx = p.tx AND p.sy = p.ty AND p.sp = p.tp)"
_RAW = f"""part AS (SELECT l.*, direction, coalesce(CASE WHEN scalar*(ux*(tx-x)+uy*(ty-y)) + pot > 0 THEN (scalar*(ux*(tx-x)+uy*(ty-y)) + pot + 255)//256 END, 0)::INT AS h FROM land l CROSS JOIN scalar LEFT JOIN pot USING (direction, internal) WHERE pot.target = l.tp OR pot.target IS NULL),
  val AS (SELECT *, initial + h AS v FROM (SELECT sx, sy, sp, tx, ty, tp, o1, o2, x, y, internal, initial, max(h) AS h FROM part GROUP BY ALL)),
  low AS (SELECT sx, sy, sp, tx, ty, tp, direction, min(initial + h) AS d FROM part GROUP BY ALL),
  best AS (SELECT sx, sy, sp, tx, ty, tp, min(v) AS best, (list_sort(list(v)))[2] AS second, count(*) AS candidates, min(initial) AS min_initial, max(initial) AS max_initial, arg_min(struct_pack(i := initial, x := x, y := y, n := internal), (v, o1, o2)) AS top FROM val GROUP BY ALL)"""


@query(f"""WITH {_SMALL}, {_MINI}, {_RELAXED}, {_CLOSURE}, {_POT}, {_HOPS}, {_RAW}
SELECT o_orderkey, (CASE WHEN {_SAME} THEN 0 ELSE least(best, {_DIRECT}) END)::INT AS raw, (CASE WHEN {_SAME} THEN 0 ELSE best END)::INT AS best, (CASE WHEN {_SAME} THEN 0 ELSE second END)::INT AS second,
  (CASE WHEN {_SAME} THEN 0 ELSE {_DIRECT} END)::INT AS direct, (CASE WHEN {_SAME} THEN 0 ELSE coalesce(candidates, 0) END)::INT AS candidates, (CASE WHEN {_SAME} THEN 0 ELSE min_initial END)::INT AS min_initial,
  (CASE WHEN {_SAME} THEN 0 ELSE coalesce(max_initial, 0) END)::INT AS max_initial, (CASE WHEN {_SAME} THEN 0 ELSE coalesce(top.i, 0) END)::INT AS best_initial, (CASE WHEN {_SAME} THEN 0 ELSE coalesce(top.x, 0) END)::INT AS best_x,
  (CASE WHEN {_SAME} THEN 0 ELSE coalesce(top.y, 0) END)::INT AS best_y, (CASE WHEN {_SAME} THEN 0 ELSE coalesce(top.n, 0) END)::INT AS best_internal,
  {", ".join(f"(CASE WHEN {_SAME} THEN 0 ELSE d.d{i} END)::INT AS d{i}" for i in range(8))} FROM small p LEFT JOIN best USING (sx, sy, sp, tx, ty, tp)
  LEFT JOIN (SELECT sx, sy, sp, tx, ty, tp, {", ".join(f"min(d) FILTER (direction = {i}) AS d{i}" for i in range(8))} FROM low GROUP BY ALL) d USING (sx, sy, sp, tx, ty, tp)""")
def raw_estimate(spark: SparkSession, sf: str) -> DataFrame:
    a = _mini(spark)
    small = _small(spark, sf)
    cols = ["raw", "best", "second", "direct", "candidates", "min_initial", "max_initial", "best_initial", "best_x", "best_y", "best_internal", *[f"d{i}" for i in range(8)]]
    return reuse.once_for_each(small, estimate.KEYS, lambda p: estimate.raw_estimates(p, a, potentials.Potentials(a))).select("o_orderkey", *cols)


def _search_sql(relative: bool = False, margin: int | None = None) -> str:
    gap = "block_delay" if relative else "block_delay + line_delay"
    box = "" if margin is None else f" AND {{x}} BETWEEN least(sx,tx)-{margin} AND greatest(sx,tx)+{margin} AND {{y}} BETWEEN least(sy,ty)-{margin} AND greatest(sy,ty)+{margin}"
    key = "sx, sy, sp" + ("" if margin is None else ", tx, ty")
    pre = "src AS (SELECT DISTINCT " + key + " FROM pairs)"
    on = lambda a: " AND ".join(f"{a}.{k} = d.{k}" for k in key.split(", "))
    seed = f"SELECT {key}, x, y, internal, min(g) AS g FROM (SELECT {', '.join('s.' + k for k in key.split(', '))}, internal, coalesce(to_x, s.sx) AS x, coalesce(to_y, s.sy) AS y, arc_delay + coalesce({gap}, 0) AS g FROM src s JOIN hop USING (sp) LEFT JOIN walk ON walk.net_id = hop.net_id AND from_x = s.sx AND from_y = s.sy WHERE hop.net_id IS NULL OR (walk.net_id IS NOT NULL{box.format(x='to_x', y='to_y')})) GROUP BY ALL"
    step = f"SELECT {', '.join('d.' + k for k in key.split(', '))}, to_x AS x, to_y AS y, to_internal AS internal, min(d.g + arc_delay + {gap}) AS g FROM d JOIN macro ON from_internal = d.internal JOIN walk ON walk.net_id = macro.net_id AND from_x = d.x AND from_y = d.y LEFT JOIN recurring.d r ON {on('r')} AND r.x = to_x AND r.y = to_y AND r.internal = to_internal WHERE (r.g IS NULL OR d.g + arc_delay + {gap} < r.g){box.format(x='to_x', y='to_y').replace('sx', 'd.sx').replace('tx', 'd.tx').replace('sy', 'd.sy').replace('ty', 'd.ty')} GROUP BY ALL"
    extra = f" + {_cross_sql('p.sx', 'p.tx', _M.vertical, 'delay')} + {_cross_sql('p.sy', 'p.ty', _M.horizontal, 'delay')}" if relative else ""
    last = f"SELECT p.*, CASE WHEN {_SAME} THEN 0 ELSE least((SELECT min(d.g + cost) FROM d JOIN term ON term.internal = d.internal AND term.target = p.tp WHERE {on('p')} AND d.x = p.tx AND d.y = p.ty), {_DIRECT}){extra} END AS delay FROM pairs p"
    return f"WITH RECURSIVE {_SMALL}, {_MINI}, {_TERM}, {_HOPS}, {pre}, d({key}, x, y, internal, g) USING KEY ({key}, x, y, internal) AS ({seed} UNION {step}), answer AS ({last}) SELECT o_orderkey, delay::INT AS delay FROM small JOIN answer USING (sx, sy, sp, tx, ty, tp)"


@query(_search_sql())
def exact_shortest(spark: SparkSession, sf: str) -> DataFrame:
    """A* and two-way Dijkstra for each distinct pair; a difference fails the run."""
    a = _mini(spark)
    return reuse.once_for_each(_small(spark, sf), estimate.KEYS, lambda p: exact.kernel_search(p, a, "verify")).select("o_orderkey", "delay")


@query(_search_sql())
def frontier_shortest(spark: SparkSession, sf: str) -> DataFrame:
    """The same by frontier tables."""
    a = _mini(spark)
    return reuse.once_for_each(_small(spark, sf), estimate.KEYS, lambda p: exact.frontier_search(p, a, potentials.Potentials(a))).select("o_orderkey", "delay")


@query(_search_sql(relative=True))
def relative_gap(spark: SparkSession, sf: str) -> DataFrame:
    a = _mini(spark)
    return reuse.once_for_each(_small(spark, sf), estimate.KEYS, lambda p: exact.kernel_search(p, a, "dijkstra", relative=True)).select("o_orderkey", "delay")


@query(_search_sql(margin=2))
def bounded_search(spark: SparkSession, sf: str) -> DataFrame:
    a = _mini(spark)
    return reuse.once_for_each(_small(spark, sf), estimate.KEYS, lambda p: exact.kernel_search(p, a, "dijkstra", margin=2)).select("o_orderkey", "delay")


@query(_search_sql())
def astar_shortest(spark: SparkSession, sf: str) -> DataFrame:
    """A* alone, with its paths; their delays."""
    a = _mini(spark)
    return reuse.once_for_each(_small(spark, sf), estimate.KEYS, lambda p: exact.kernel_search(p, a, "astar", paths=True)).select("o_orderkey", "delay")


@query()
def shortest_paths(spark: SparkSession, sf: str) -> DataFrame:
    """Any shortest path is right, so only its cost could be compared; see tests."""
    a = _mini(spark)
    return reuse.once_for_each(_small(spark, sf), estimate.KEYS, lambda p: exact.kernel_search(p, a, "astar", paths=True)).select("o_orderkey", "delay", "path")


# ---- the same over endpoints anywhere on the small grid; no SQL, the recursion is too slow for so many pairs


def _spread(spark: SparkSession, sf: str) -> DataFrame:
    """Requests between any free sites and ports of the small grid, each drawn from the full keys."""
    sites = [(x, y) for y in range(_M.height) for x in range(_M.width) if not (MINI_BLOCK[2] <= x <= MINI_BLOCK[3] and MINI_BLOCK[0] <= y <= MINI_BLOCK[1])]
    xs, ys = (F.array(*[F.lit(s[i]) for s in sites]) for i in (0, 1))
    draw = lambda what, n: F.pmod(F.xxhash64("o_orderkey", "o_custkey", F.lit(what)), F.lit(n)).cast("int")
    r = _read(spark, sf, "orders").withColumns({"a": draw("source", len(sites)), "b": draw("target", len(sites)), "sp": draw("source port", 6), "tp": draw("target port", 6)})
    return r.select("o_orderkey", F.get(xs, "a").alias("sx"), F.get(ys, "a").alias("sy"), "sp", F.get(xs, "b").alias("tx"), F.get(ys, "b").alias("ty"), "tp")


@query()
def raw_estimate_spread(spark: SparkSession, sf: str) -> DataFrame:
    a = _mini(spark)
    cols = ["raw", "best", "second", "direct", "candidates", "min_initial", "max_initial", "best_initial", "best_x", "best_y", "best_internal", *[f"d{i}" for i in range(8)]]
    return reuse.once_for_each(_spread(spark, sf), estimate.KEYS, lambda p: estimate.raw_estimates(p, a, potentials.Potentials(a))).select("o_orderkey", *cols)


@query()
def exact_shortest_spread(spark: SparkSession, sf: str) -> DataFrame:
    a = _mini(spark)
    return reuse.once_for_each(_spread(spark, sf), estimate.KEYS, lambda p: exact.kernel_search(p, a, "verify")).select("o_orderkey", "delay")


@query()
def frontier_shortest_spread(spark: SparkSession, sf: str) -> DataFrame:
    a = _mini(spark)
    return reuse.once_for_each(_spread(spark, sf), estimate.KEYS, lambda p: exact.frontier_search(p, a, potentials.Potentials(a))).select("o_orderkey", "delay")


@query()
def relative_gap_spread(spark: SparkSession, sf: str) -> DataFrame:
    a = _mini(spark)
    return reuse.once_for_each(_spread(spark, sf), estimate.KEYS, lambda p: exact.kernel_search(p, a, "dijkstra", relative=True)).select("o_orderkey", "delay")


@query()
def bounded_search_spread(spark: SparkSession, sf: str) -> DataFrame:
    a = _mini(spark)
    return reuse.once_for_each(_spread(spark, sf), estimate.KEYS, lambda p: exact.kernel_search(p, a, "dijkstra", margin=2)).select("o_orderkey", "delay")


@query()
def shortest_paths_spread(spark: SparkSession, sf: str) -> DataFrame:
    a = _mini(spark)
    return reuse.once_for_each(_spread(spark, sf), estimate.KEYS, lambda p: exact.kernel_search(p, a, "astar", paths=True)).select("o_orderkey", "delay", "path")


# ---- calibration, scores, folds


def _estimates(spark: SparkSession, sf: str) -> DataFrame:
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    return _requests(spark, sf).withColumns({"raw": (1 + (o * 31 + c * 7) % 4000).cast("int"), "direct": F.when(o % 11 == 0, ((o * 5) % 3000).cast("int"))})


def _q(stage: str, cell: str) -> str:
    return f"(16384 + ({cell} * 37 + {len(stage)}) % 601 - 300)"


def _calibrated_sql() -> str:
    way = "((sign(tx-sx)::INT+1)*3+sign(ty-sy)::INT+1)"
    slow = "least(raw//64,127)"
    cells = {
        "fine_spatial": "(least(abs(tx-sx)//5,23)*91+least(abs(ty-sy)//6,90))", "raw_delay": "least(raw//32,255)", "sign": way, "remainder": "((abs(tx-sx)%10)*12+abs(ty-sy)%12)", "source_port": "sp", "target_port": "tp",
        "port_pair": "(sp*496+tp)", "target_delay": f"(tp*128+{slow})", "source_delay": f"(sp*128+{slow})", "target_sign": f"(tp*9+{way})", "source_sign": f"(sp*9+{way})",
        "signed_spatial": "((11+sign(tx-sx)::INT*least(abs(tx-sx)//10,11))*91+45+sign(ty-sy)::INT*least(abs(ty-sy)//12,45))",
    }
    ctes, last = [f"v0 AS (SELECT *, (raw::BIGINT*1306+500)//1000+170 AS v FROM est)"], "v0"  # noqa: F541
    for i, (name, cell) in enumerate(cells.items(), 1):
        ctes.append(f"v{i} AS (SELECT * EXCLUDE (v), (v * {_q(name, cell)} + 8192) >> 14 AS v FROM {last})")
        last = f"v{i}"
    est = "est AS (SELECT *, (1+(o_orderkey*31+o_custkey*7)%4000)::INT AS raw, CASE WHEN o_orderkey%11=0 THEN ((o_orderkey*5)%3000)::INT END AS direct FROM req)"
    return f"WITH {REQ_SQL}, {est}, {', '.join(ctes)} SELECT o_orderkey, (CASE WHEN sx=tx AND sy=ty AND sp=tp THEN 0 ELSE least(v, coalesce(direct, v)) END)::BIGINT AS calibrated FROM {last}"


@query(_calibrated_sql())
def calibrated_estimate(spark: SparkSession, sf: str) -> DataFrame:
    sizes = {"fine_spatial": 2184, "raw_delay": 256, "sign": 9, "remainder": 120, "source_port": 496, "target_port": 496, "port_pair": 246016, "target_delay": 63488, "source_delay": 63488, "target_sign": 4464, "source_sign": 4464, "signed_spatial": 2093}
    tables = None
    for name, n in sizes.items():
        part = spark.range(n).select(F.lit(name).alias("name"), F.col("id").cast("int").alias("cell"), (16384 + (F.col("id") * 37 + len(name)) % 601 - 300).cast("int").alias("q14"))
        tables = part if tables is None else tables.unionByName(part)
    return estimate.calibrated(_estimates(spark, sf), tables).select("o_orderkey", "calibrated")


def _golden(spark: SparkSession, sf: str) -> DataFrame:
    li = _read(spark, sf, "lineitem")
    g = (F.col("l_quantity") * 20).cast("int")
    return li.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag", g.alias("golden"), (g + F.col("l_linenumber") * 3 - 9).cast("int").alias("estimate"))


_GOLDEN = "g AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_returnflag, (l_quantity*20)::INT AS golden, ((l_quantity*20)::INT + l_linenumber*3 - 9)::INT AS estimate FROM lineitem)"
_POINT = "(CASE WHEN golden = 0 THEN (estimate = 0)::INT ELSE 1 - tanh(4*abs(estimate-golden)/golden) END)"


@query(f"""WITH {_GOLDEN} SELECT l_returnflag, count(*) AS rows, round(100*avg({_POINT}), 6) AS score, round(100*avg(CASE WHEN golden = 0 THEN (estimate <> 0)::INT ELSE abs(estimate-golden)/golden END), 6) AS mape_one,
  round(100*avg(CASE WHEN golden <> 0 THEN abs(estimate-golden)/golden END), 6) AS mape_skip, round(100*avg(abs(estimate-golden)/greatest(golden,1)), 6) AS mape_floor, round(avg(abs(estimate-golden)), 6) AS mae,
  count(*) FILTER (estimate = golden) AS exact, count(*) FILTER (estimate < golden) AS under, count(*) FILTER (estimate > golden) AS over FROM g GROUP BY 1""")
def score_metrics(spark: SparkSession, sf: str) -> DataFrame:
    r = score.report(_golden(spark, sf), [F.col("l_returnflag")])
    return r.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in r.dtypes])


@query(f"WITH {_GOLDEN}, e AS (SELECT 100*abs(estimate-golden)/golden AS e FROM g WHERE golden <> 0) SELECT " + ", ".join(f"round(quantile_cont(e, {q}), 6) AS {n}" for q, n in ((0.5, "p50"), (0.9, "p90"), (0.95, "p95"), (0.99, "p99"))) + " FROM e")
def ape_quantiles(spark: SparkSession, sf: str) -> DataFrame:
    q = score.error_quantiles(_golden(spark, sf))
    return q.select(*[F.round(c, 6).alias(c) for c in q.columns])


@query(f"WITH {_GOLDEN} SELECT l_partkey % 50 AS cell, round(sum(ln(golden::DOUBLE/estimate)) / (count(*) + 20), 6) AS effect FROM g WHERE golden > 0 AND estimate > 0 GROUP BY 1")
def residual_effect(spark: SparkSession, sf: str) -> DataFrame:
    return calibrate.effects(_golden(spark, sf), F.col("l_partkey") % 50, 20.0, "golden", "estimate").select("cell", F.round("effect", 6).alias("effect"))


_STAGES = [("part", "l_partkey % 50", 20.0), ("supp", "l_suppkey % 20", 50.0), ("line", "l_linenumber", 5.0)]


def _staged_sql() -> str:
    ctes, last = ["p0 AS (SELECT *, estimate::DOUBLE AS p FROM g)"], "p0"
    for i, (_, cell, shrink) in enumerate(_STAGES, 1):
        ctes.append(f"e{i} AS (SELECT {cell} AS cell, sum(ln(golden/p))/(count(*)+{shrink}) AS e FROM {last} WHERE golden > 0 AND p > 0 GROUP BY 1)")
        ctes.append(f"p{i} AS (SELECT {last}.* EXCLUDE (p), p*exp(coalesce(e, 0)) AS p FROM {last} LEFT JOIN e{i} ON e{i}.cell = {cell})")
        last = f"p{i}"
    out = " UNION ALL ".join(f"SELECT '{n}' AS name, cell::BIGINT AS cell, rint_(exp(e)*16384)::INT AS q14 FROM e{i}" for i, (n, _, _) in enumerate(_STAGES, 1)).replace("rint_", "round_even").replace("*16384)", "*16384, 0)")
    return f"WITH {_GOLDEN}, {', '.join(ctes)} {out}"


@query(_staged_sql())
def staged_fit(spark: SparkSession, sf: str) -> DataFrame:
    df = _golden(spark, sf).withColumn("prediction", F.col("estimate").cast("double"))
    tables, _ = calibrate.staged_fit(df, [(n, F.expr(c), s) for n, c, s in _STAGES])
    return calibrate.quantised(tables)


@query(f"""WITH {_GOLDEN}, t AS (SELECT *, l_linenumber <> 1 AS train, golden::DOUBLE AS v, l_partkey % 40 AS k FROM g), m AS (SELECT avg(v) FILTER (train) AS m FROM t), s AS (SELECT k, coalesce(sum(v) FILTER (train), 0) AS s, count(*) FILTER (train) AS n FROM t GROUP BY 1)
SELECT l_returnflag, l_linenumber, count(*) AS n, round(avg((s - CASE WHEN train THEN v ELSE 0 END + 20*m)/(n - train::INT + 20)), 6) AS encoded FROM t JOIN s USING (k), m GROUP BY 1, 2""")
def loo_encoding(spark: SparkSession, sf: str) -> DataFrame:
    g = _golden(spark, sf).withColumns({"k": F.col("l_partkey") % 40, "v": F.col("golden").cast("double")})
    e = calibrate.leave_one_out(g, ["k"], "v", F.col("l_linenumber") != 1, 20.0)
    return e.groupBy("l_returnflag", "l_linenumber").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("encoded"), 6).alias("encoded"))


@query(f"""WITH {_GOLDEN}, b AS (SELECT l_returnflag, golden::DOUBLE AS m1, estimate::DOUBLE AS m2, (golden + l_suppkey % 7)::DOUBLE AS m3 FROM g)
SELECT l_returnflag, sum(round_even((m1+m2+m3)/3, 0))::BIGINT AS mean_sum, sum(round_even(m1+m2+m3-greatest(m1,m2,m3)-least(m1,m2,m3), 0))::BIGINT AS median_sum, count(*) AS n FROM b GROUP BY 1""")
def ensemble_stats(spark: SparkSession, sf: str) -> DataFrame:
    g = _golden(spark, sf).withColumn("m3", F.col("golden") + F.col("l_suppkey") % 7)
    b = score.blends(g, ["golden", "estimate", "m3"])
    return b.groupBy("l_returnflag").agg(F.sum("blend_mean").cast("long").alias("mean_sum"), F.sum("blend_median").cast("long").alias("median_sum"), F.count(F.lit(1)).alias("n"))


@query(f"WITH {_GOLDEN} SELECT l_orderkey, min(golden) AS least, (list_sort(list(golden)))[2] AS second, count(*) AS n FROM g GROUP BY 1")
def second_best(spark: SparkSession, sf: str) -> DataFrame:
    """The two smallest of each group, equal ones counted twice."""
    rank = F.row_number().over(W.partitionBy("l_orderkey").orderBy("golden"))
    g = _golden(spark, sf).select("l_orderkey", "golden", rank.alias("r"))
    return g.groupBy("l_orderkey").agg(F.min("golden").alias("least"), F.min(F.when(F.col("r") == 2, F.col("golden"))).alias("second"), F.count(F.lit(1)).alias("n"))


@query(f"WITH {REQ_SQL} SELECT o_orderkey, (o_orderkey % 5)::INT AS fold, o_orderkey < 1000 AS first FROM req")
def fold_row(spark: SparkSession, sf: str) -> DataFrame:
    return _requests(spark, sf).select("o_orderkey", (F.col("o_orderkey") % 5).cast("int").alias("fold"), (F.col("o_orderkey") < 1000).alias("first"))


_M64 = "18446744073709551615::UHUGEINT"




@query(f"""WITH {REQ_SQL}, k AS (SELECT o_orderkey, (sp | (tp << 9) | ((tx-sx+119) << 18) | ((ty-sy+549)::BIGINT << 26))::UHUGEINT AS z FROM req),
a AS (SELECT o_orderkey, z, (xor(z, z >> 30) * 13787848793156543929::UHUGEINT) & {_M64} AS y FROM k), b AS (SELECT o_orderkey, z, (xor(y, y >> 27) * 10723151780598845931::UHUGEINT) & {_M64} AS x FROM a)
SELECT o_orderkey, z::BIGINT AS template, (xor(x, x >> 31) % 5)::INT AS fold FROM b""")
def fold_template(spark: SparkSession, sf: str) -> DataFrame:
    args = [F.col("sp"), F.col("tp"), F.col("tx") - F.col("sx"), F.col("ty") - F.col("sy")]
    return _requests(spark, sf).select("o_orderkey", hashing.template_key(*args).alias("template"), hashing.template_fold(*args).alias("fold"))


_BYTES = f"""pin AS (SELECT o_orderkey, 'SRB_'||sx||'_'||sy||'/'||a.name||',SRB_'||tx||'_'||ty||'/'||b.name AS t FROM req JOIN names a ON a.port_id = sp JOIN names b ON b.port_id = tp),
bits(b, k, v) AS (SELECT i, 0, i::UBIGINT FROM range(256) r(i) UNION ALL SELECT b, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::UBIGINT) ELSE v >> 1 END FROM bits WHERE k < 8),
tab AS MATERIALIZED (SELECT b, v FROM bits WHERE k = 8),
roll(o_orderkey, t, i, c, h) AS (SELECT o_orderkey, t, 1, 4294967295::UBIGINT, 14695981039346656037::UHUGEINT FROM pin
  UNION ALL SELECT o_orderkey, t, i + 1, xor(c >> 8, v), (xor(h, ascii(substr(t, i, 1))::UHUGEINT) * 1099511628211::UHUGEINT) & {_M64} FROM roll JOIN tab ON b = xor(c, ascii(substr(t, i, 1))::UBIGINT) & 255 WHERE i <= length(t))"""


@query(f"""WITH RECURSIVE {REQ_SQL}, {_names_sql()}, {_BYTES},
y AS (SELECT o_orderkey, (xor((o_orderkey + 7)::UHUGEINT, (o_orderkey + 7)::UHUGEINT >> 30) * 13787848793156543929::UHUGEINT) & {_M64} AS y FROM req), x AS (SELECT o_orderkey, (xor(y, y >> 27) * 10723151780598845931::UHUGEINT) & {_M64} AS x FROM y)
SELECT o_orderkey, (xor(c, 4294967295::UBIGINT) % 5)::INT AS fold, (CASE WHEN h > 9223372036854775807::UHUGEINT THEN h::HUGEINT - 18446744073709551616::HUGEINT ELSE h::HUGEINT END)::BIGINT AS fnv,
  (xor(x, x >> 31) >> 11) < 2251799813685248::UHUGEINT AS sampled FROM roll JOIN x USING (o_orderkey) WHERE i = length(t) + 1""")
def fold_crc(spark: SparkSession, sf: str) -> DataFrame:
    r = pin_format_parse(spark, sf)
    return r.select("o_orderkey", hashing.text_fold(F.col("from_pin"), F.col("to_pin")).alias("fold"), hashing.fnv1a64(F.concat_ws(",", "from_pin", "to_pin")).alias("fnv"), hashing.sampled(F.col("o_orderkey"), 7, 0.25).alias("sampled"))


TREES = [
    {"feature": 0, "threshold": 59.5, "left": {"feature": 1, "categories": [3, 64, 70, 200, 401], "left": {"leaf": 0.25}, "right": {"leaf": -0.125}}, "right": {"feature": 2, "threshold": -4.5, "left": {"leaf": 0.5}, "right": {"leaf": 0.0625}}},
    {"feature": 3, "threshold": 300.0, "left": {"leaf": 0.03125}, "right": {"leaf": -0.25}},
]


@query(f"""WITH {REQ_SQL}, e AS (SELECT o_orderkey, (1+(o_orderkey*31+o_custkey*7)%4000)::INT AS raw, CASE WHEN sx <= 59 THEN CASE WHEN sy IN (3,64,70,200,401) THEN 0.25 ELSE -0.125 END ELSE CASE WHEN tx-sx <= -5 THEN 0.5 ELSE 0.0625 END END::DOUBLE + CASE WHEN ty <= 300 THEN 0.03125 ELSE -0.25 END::DOUBLE AS residual FROM req)
SELECT o_orderkey, residual, round_even(raw*exp(residual), 0)::BIGINT AS prediction FROM e""")
def gbm_inference(spark: SparkSession, sf: str) -> DataFrame:
    f = _estimates(spark, sf).select("o_orderkey", "raw", F.array("sx", "sy", F.col("tx") - F.col("sx"), "ty").alias("features"))
    return gbm.predict(f, gbm.from_trees(TREES, 4)).select("o_orderkey", "residual", "prediction")


@query("SELECT event_id, k, ((k*k) % 1009)::BIGINT AS answer FROM (SELECT event_id, user_id AS k FROM events)")
def dedup_memo(spark: SparkSession, sf: str) -> DataFrame:
    """Each key is solved once and joined back."""
    e = _read(spark, sf, "events").select("event_id", F.col("user_id").alias("k"))
    return reuse.once_for_each(e, ["k"], lambda keys: keys.withColumn("answer", (F.col("k") * F.col("k") % 1009).cast("long")))


@query("SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL HAVING count(*) > 1")
def duplicate_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return reuse.repeated(_read(spark, sf, "events"), ["user_id", "event_type"])


@query("SELECT o_orderkey AS row_id, o_custkey, sum(o_custkey) OVER (ORDER BY o_orderkey)::BIGINT AS running FROM (SELECT * FROM orders ORDER BY o_orderkey LIMIT 500)")
def order_limit(spark: SparkSession, sf: str) -> DataFrame:
    """The first 500 rows in order (a limit is the feature); the running sum shows the order."""
    o = _read(spark, sf, "orders").orderBy("o_orderkey").limit(500).select(F.col("o_orderkey").alias("row_id"), "o_custkey")
    return o.withColumn("running", F.sum("o_custkey").over(W.orderBy("row_id"))).orderBy("row_id")


@query("SELECT a.o_orderkey AS row_id, a.o_custkey AS k, a.o_orderkey % 977 AS golden, (a.o_orderkey + 3) % 977 AS estimate FROM orders a")
def zipped_results(spark: SparkSession, sf: str) -> DataFrame:
    """Two results side by side by row number, with their keys checked."""
    o = _read(spark, sf, "orders").select(F.col("o_orderkey").alias("row_id"), F.col("o_custkey").alias("k"))
    return score.zipped(o.withColumn("delay", F.col("row_id") % 977), o.withColumn("delay", (F.col("row_id") + 3) % 977), ("k",))


@query(f"WITH {REQ_SQL}, {_names_sql()} SELECT 'SRB_'||sx||'_'||sy||'/'||a.name AS \"from\", 'SRB_'||tx||'_'||ty||'/'||b.name AS \"to\", ({_cross_sql('sx', 'tx', LINES_X, 'delay')} + {_cross_sql('sy', 'ty', LINES_Y, 'delay')})::INT AS delay FROM req JOIN names a ON a.port_id = sp JOIN names b ON b.port_id = tp")
def stream_estimate(spark: SparkSession, sf: str) -> DataFrame:
    """Requests as a stream of text files; each batch is bound, answered by its line delays and written under its number."""
    base = f"{shared_folder(spark)}/stream-{spark.sparkContext.applicationId}-{abs(hash(sf))}-{spark.sparkContext._jvm.java.util.UUID.randomUUID().toString()}"
    arch = _full(spark)
    pin_format_parse(spark, sf).select(F.concat_ws(",", "from_pin", "to_pin").alias("value")).write.text(f"{base}/in")

    def solve(pairs: DataFrame) -> DataFrame:
        rows = pairs.withColumn("row_id", F.lit(0).cast("long"))
        bound, _ = reqs.bind(rows, arch)
        d = crossing(F.col("sx"), F.col("tx"), LINES_X)[0] + crossing(F.col("sy"), F.col("ty"), LINES_Y)[0]
        return bound.select("from", "to", d.cast("int").alias("delay"))

    streams.answer_stream(streams.request_stream(spark, f"{base}/in"), solve, f"{base}/out", f"{base}/state").awaitTermination()
    return cut(spark.read.parquet(f"{base}/out").select("from", "to", "delay"))
