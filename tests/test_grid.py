"""Operators on the grid against SQL, brute force and hand-made cases."""

import argparse
import heapq
import random
import re

import duckdb
import numpy as np
import pytest
from conftest import DATA
from pyspark.sql import functions as F

from gridlark import cli, queries, sinks
from gridlark.functions import fixed, hashing, scalar
from gridlark.operators import calibrate, estimate, exact, features, gbm, potentials, reuse, score
from gridlark.operators.kernel import Grid
from gridlark.plans import arch as archs
from gridlark.plans import chip
from gridlark.sources import architecture, requests

SF = f"{DATA}/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("orders", "lineitem", "events"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def rows(df, cols):
    df = df[cols].astype(object).where(df[cols].notna(), None)
    return sorted(tuple(f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in df.values.tolist())


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, con, name):
    got, want = queries.QUERIES[name](spark, SF).toPandas(), con.sql(queries.SQL[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    assert rows(got, cols) == rows(want, cols)


def step_walk(a, x, y, dx, dy):
    """One cell at a time, as the walk is defined."""
    along_x, left = dx != 0, abs(dx or dy)
    s = 1 if (dx or dy) > 0 else -1
    block, at = 0, [x, y]
    k = 0 if along_x else 1
    size = (a.width, a.height)
    while left:
        at[k] += s
        if not 0 <= at[k] < size[k]:
            return None
        b = next((b for b in a.block_list if b[2] <= at[0] <= b[3] and b[0] <= at[1] <= b[1]), None)
        if b and (b[6] if along_x else b[4]):
            block += b[7] if along_x else b[5]
            at[k] = (b[3] if s > 0 else b[2]) if along_x else (b[1] if s > 0 else b[0])
            continue
        left -= 1
    if any(b[2] <= at[0] <= b[3] and b[0] <= at[1] <= b[1] for b in a.block_list):
        return None
    lines = a.vertical if along_x else a.horizontal
    low, high = sorted(((x, y)[k], at[k]))
    return at[0], at[1], block, sum(d for p, d in lines if low <= p < high)


@pytest.mark.parametrize("name", ["net_walk", "reverse_walk"])
def test_all_nets_are_walked(spark, name):
    assert queries.QUERIES[name](spark, SF).select("net_id").distinct().count() == len(chip.nets()) == 160


GRIDS = {"across": [(4, 6, 5, 7, False, 0, True, 11)], "along": [(4, 6, 5, 7, True, 13, False, 0)], "both": [(2, 3, 3, 4, True, 6, True, 7), (7, 9, 6, 8, False, 0, True, 9)], "solid": [(4, 6, 5, 7, False, 0, False, 0)], "free": []}


@pytest.mark.parametrize("kind", GRIDS)
def test_walks_equal_single_steps(spark, kind):
    a = archs.synthetic(spark, blocks=GRIDS[kind])
    got = {(r["from_x"], r["from_y"], r["net_id"]): (r["to_x"], r["to_y"], r["block_delay"], r["line_delay"]) for r in a.walks.collect()}
    g = Grid(a)
    sites = {(r["x"], r["y"]): r["site_id"] for r in a.sites.collect()}
    for (x, y), site in sites.items():
        assert (g.x[site], g.y[site]) == (x, y)
        for n, (_, _, dx, dy) in enumerate(a.net_list):
            want = step_walk(a, x, y, dx, dy)
            assert got.get((x, y, n)) == want
            to = int(g.to[n][site])
            assert (None if to < 0 else (int(g.x[to]), int(g.y[to]), int(g.block[n][site]), int(g.line[n][site]))) == want


def some_pairs(a, n, seed):
    rnd = random.Random(seed)
    free = [(x, y) for x in range(a.width) for y in range(a.height) if not any(b[2] <= x <= b[3] and b[0] <= y <= b[1] for b in a.block_list)]
    ports = len(a.port_list)
    return [(*rnd.choice(free), rnd.randrange(ports), *rnd.choice(free), rnd.randrange(ports)) for _ in range(n)]


def plain_dijkstra(a, sx, sy, sp, relative=False, box=None):
    """Costs of all (x, y, port, came by an arc) from one pin, by single steps; no arc follows an arc."""
    done, todo = {}, [(0, sx, sy, sp, False)]
    while todo:
        g, x, y, p, by_arc = heapq.heappop(todo)
        if (x, y, p, by_arc) in done:
            continue
        done[x, y, p, by_arc] = g
        if not by_arc:
            for f, t, d in a.arc_list:
                if f == p:
                    heapq.heappush(todo, (g + d, x, y, t, True))
        for f, t, dx, dy in a.net_list:
            if f == p and (to := step_walk(a, x, y, dx, dy)) and (box is None or box[0] <= to[0] <= box[1] and box[2] <= to[1] <= box[3]):
                heapq.heappush(todo, (g + to[2] + (0 if relative else to[3]), to[0], to[1], t, False))
    return done


def test_spread_requests_equal_brute_force(spark):
    reqs_ = {r["o_orderkey"]: (r["sx"], r["sy"], r["sp"], r["tx"], r["ty"], r["tp"]) for r in queries._spread(spark, SF).collect()}
    assert len(set(reqs_.values())) > 1000
    for i in (0, 3):
        assert {(r[i], r[i + 1]) for r in reqs_.values()} == {(x, y) for x in range(12) for y in range(12) if not (4 <= y <= 6 and 5 <= x <= 7)}
    a = archs.synthetic(spark, 12, 12, 6, blocks=[queries.MINI_BLOCK])
    got = {n: {r["o_orderkey"]: r["delay"] for r in queries.QUERIES[n](spark, SF).collect()} for n in ("exact_shortest_spread", "frontier_shortest_spread", "relative_gap_spread", "bounded_search_spread", "shortest_paths_spread")}
    raw = {r["o_orderkey"]: r["raw"] for r in queries.raw_estimate_spread(spark, SF).collect()}
    assert all(set(g) == set(reqs_) for g in got.values()) and set(raw) == set(reqs_)
    assert got["exact_shortest_spread"] == got["frontier_shortest_spread"] == got["shortest_paths_spread"]
    cross = lambda u, v, ls: sum(d for s, d in ls if min(u, v) <= s < max(u, v))
    for k in sorted(reqs_)[:60]:
        sx, sy, sp, tx, ty, tp = reqs_[k]
        same = (sx, sy, sp) == (tx, ty, tp)
        box = (min(sx, tx) - 2, max(sx, tx) + 2, min(sy, ty) - 2, max(sy, ty) + 2)
        ask = lambda **o: min((c for b in (False, True) if (c := plain_dijkstra(a, sx, sy, sp, **o).get((tx, ty, tp, b))) is not None), default=None)  # noqa: B023, E731
        assert got["exact_shortest_spread"][k] == ask() and got["bounded_search_spread"][k] == ask(box=box)
        rel = ask(relative=True)
        assert got["relative_gap_spread"][k] == (0 if same else None if rel is None else rel + cross(sx, tx, a.vertical) + cross(sy, ty, a.horizontal))
        assert raw[k] is None or ask() is None or raw[k] <= ask()


SIX = "sx int, sy int, sp int, tx int, ty int, tp int"


@pytest.mark.parametrize("kind", ["across", "both"])
def test_searches_agree_and_bounds_hold(spark, kind):
    a = archs.synthetic(spark, blocks=GRIDS[kind])
    pairs = spark.createDataFrame([*some_pairs(a, 30, 1), (1, 1, 0, 1, 1, 0), (2, 2, 3, 2, 2, 4)], SIX)
    pots = potentials.Potentials(a)
    by = lambda df: {tuple(r[c] for c in estimate.KEYS): r["delay"] for r in df.collect()}
    k = exact.kernel_search(pairs, a, "verify", pots, paths=True)
    found = by(k)
    assert found == by(exact.frontier_search(pairs, a, pots)) == by(exact.kernel_search(pairs, a, "dijkstra"))
    for r in estimate.raw_estimates(pairs, a, pots).collect():
        d = found[tuple(r[c] for c in estimate.KEYS)]
        assert d is None or r["raw"] <= d
    bounded = by(exact.kernel_search(pairs, a, "dijkstra", margin=2))
    assert all(v is None or v >= found[q] for q, v in bounded.items())
    g, names = Grid(a), {n: i for i, (n, _) in enumerate(a.port_list)}
    for r in k.collect():
        if r["delay"] is not None:
            pins = [re.fullmatch(r"SRB_(\d+)_(\d+)/(.+)", p).groups() for p in r["path"].split(" | ")]
            pins = [(int(g.site[int(y), int(x)]), names[p]) for x, y, p in pins]
            cost = 0
            for (s, p), (t, q) in zip(pins[:-1], pins[1:], strict=True):
                if s == t:
                    cost += min(d for b, d in g.arcs_from[p] if b == q)
                else:
                    n = next(n for n in g.nets_from[p] if a.net_list[n][1] == q and int(g.to[n][s]) == t)
                    cost += int(g.block[n][s] + g.line[n][s])
            assert cost == r["delay"]


def test_pairs_of_one_source_share_a_frontier(spark, monkeypatch):
    a = archs.synthetic(spark, 12, 12, 6, blocks=[queries.MINI_BLOCK])
    pots, drawn = potentials.Potentials(a), some_pairs(a, 60, 7)
    many = [(*drawn[i][:3], *p[3:]) for i in range(2) for p in drawn]  # over FEW_TARGETS of each
    pairs = spark.createDataFrame([*many, *drawn[2:], (1, 1, 0, 1, 1, 0), (2, 2, 3, 2, 2, 4), (0, 0, 3, 0, 0, 0)], SIX).distinct()
    assert len({p[3:] for p in many}) > exact.FEW_TARGETS
    by = lambda df: {tuple(r[c] for c in estimate.KEYS): r["delay"] for r in df.collect()}
    sizes, replace = [], exact.Table.replace

    def noted(table, df):
        replace(table, df)
        if "internal_id" in df.columns:
            sizes.append(table.df.count())

    monkeypatch.setattr(exact.Table, "replace", noted)
    found = by(exact.frontier_search(pairs, a, pots))
    sources = len({p[:3] for p in found})
    assert len(found) > 2 * sources and max(sizes) <= sources * 135 * len(a.internal)
    monkeypatch.undo()
    assert found == by(exact.kernel_search(pairs, a, "verify", pots)) == by(exact.frontier_search(pairs, a))
    for how in ({"margin": 2}, {"relative": True}):
        assert by(exact.frontier_search(pairs, a, pots, **how)) == by(exact.kernel_search(pairs, a, "dijkstra", **how))
    none = (None, 1, 0, 2, 2, 1)
    assert by(exact.frontier_search(spark.createDataFrame([none, many[0]], SIX), a, pots)) == {none: None, many[0]: found[many[0]]}


def test_unreachable_is_null_and_minus_one_in_files(spark, tmp_path):
    a = archs.synthetic(spark)
    a.port_list.append(("ZQE[0]", "Output"))
    pairs = spark.createDataFrame([(1, 1, 6, 2, 2, 0)], SIX)
    got = exact.kernel_search(pairs, a, "dijkstra")
    assert got.first()["delay"] is None
    out = got.select(F.lit(0).alias("row_id"), F.lit("a").alias("from"), F.lit("b").alias("to"), "delay")
    sinks.write_results(out, str(tmp_path / "r"), single=True)
    assert [tuple(r) for r in spark.read.csv(str(tmp_path / "r"), header=True).collect()] == [("a", "b", "-1")]


def test_solver_options():
    files = ["--ports", "p", "--nets", "n", "--arcs", "a"]
    assert cli.options(["-in", "x", "-out", "y", "--solver", "dijkstra", "--margin", "auto", *files]).margin == "auto"
    for bad in (["--from", "a"], ["-in", "x"], ["-in", "x", "-out", "y", "--margin", "3"], ["-in", "x", "-out", "y", "--model-feature-output", "f"], ["--nope"]):
        with pytest.raises(SystemExit):
            cli.options([*bad, *files])


def test_request_file(spark, tmp_path):
    f = tmp_path / "r.csv"
    f.write_bytes(b"From , To,more\r\n\r\n SRB_20_5/ZDE[0] ,SRB_1_300/A_A0,x,y\r\nSRB_1_1\r\n,b\nSRB_0_0/ZDE[0],SRB_20_5/NOPE\n")
    got = requests.read_requests(spark, str(f))
    assert [(r["row_id"], r["from"], r["to"], r["error"] is None) for r in got.orderBy("row_id").collect()] == [
        (0, "SRB_20_5/ZDE[0]", "SRB_1_300/A_A0", True), (1, "SRB_1_1", None, False), (2, "", "b", False), (3, "SRB_0_0/ZDE[0]", "SRB_20_5/NOPE", True)]
    full = archs.chip(spark, [(n, "Output") for n in chip.port_names()], [], chip.nets())
    bound, rejected = requests.bind(got, full, strict=False)
    assert [r["sx"] for r in bound.collect()] == [20]
    said = {r["row_id"]: r["error"] for r in rejected.collect()}
    assert said[3] == "From: on a block" and len(said) == 3
    with pytest.raises(Exception, match="row 1"):
        requests.bind(got, full)[0].collect()
    f.write_text("a,b\n1,2\n")
    with pytest.raises(ValueError, match="From,To"):
        requests.read_requests(spark, str(f))


def test_architecture_files(spark, tmp_path):
    (tmp_path / "p.json").write_text('{"Port": [{"Name": "ZDE[0]", "Direction": "Output"}, {"Name": "IDE[0]", "Direction": "Input"}]}')
    (tmp_path / "n.json").write_text('{"Nets": [{"from": "ZDE[0]", "to": "IDE[0]", "delta x": 2, "delta y": 0}]}')
    (tmp_path / "a.txt").write_text('x kPortNames = {{ "ZDE[0]", "IDE[0]", }};\n array<R, 1> kArcs = {{\n {1, 0, 50},\n}};\n')
    (tmp_path / "g.json").write_text('{"Gap": {"Line": [{"id": 3, "direction": "vertical", "site": 9, "delay": 78}, {"id": 0, "direction": "vertical", "site": 4, "delay": 7}], "Block": [{"id": 0, "lower": 0, "upper": 9, "left": 0, "right": 5, "vertical crossable": false, "vertical cross delay": 0, "horizontal crossable": true, "horizontal cross delay": 29}]}}')
    a = architecture.load_chip(spark, str(tmp_path / "p.json"), str(tmp_path / "n.json"), architecture.arcs_from_text(spark, str(tmp_path / "a.txt")))
    assert (a.net_list, a.arc_list) == ([(0, 1, 2, 0)], [(1, 0, 50)])
    assert [r["name"] for r in architecture.names_from_text(spark, str(tmp_path / "a.txt"), expected=2).collect()] == ["ZDE[0]", "IDE[0]"]
    lines, blocks = architecture.read_gaps(spark, str(tmp_path / "g.json"))
    assert [(r["ord"], r["site"]) for r in lines.orderBy("ord").collect()] == [(0, 4), (1, 9)]
    assert blocks.first()["h_delay"] == 29


def test_port_names_and_codes(spark):
    assert len(set(chip.port_names())) == 496 and len(chip.nets()) == 160
    codes = {r["port_id"]: r for r in features.decode_ports(spark.createDataFrame(list(enumerate(chip.port_names())), "port_id int, name string")).collect()}
    at = {n: i for i, n in enumerate(chip.port_names())}
    r = codes[at["IQW[5]"]]
    assert (r["lane"], r["domain"], r["wire"], r["compass"], r["variant"], r["bank"], r["suffix"]) == (5, 1, 2, 3, 2, 8, 0)
    r = codes[at["S_HQ1"]]
    assert (r["domain"], r["wire"], r["bank"]) == (3, 4, 7)
    with pytest.raises(Exception, match="unexpected letter"):
        features.decode_ports(spark.createDataFrame([(0, "QQQ")], "port_id int, name string")).collect()


def test_mix64_and_fnv(spark):
    def mix(z):
        z = (z ^ z >> 30) * 0xBF58476D1CE4E5B9 % 2**64
        z = (z ^ z >> 27) * 0x94D049BB133111EB % 2**64
        return z ^ z >> 31

    xs = [0, 1, -1, 2**62, -(2**63)]
    got = spark.createDataFrame([(x,) for x in xs], "x long").select(hashing.mix64("x").alias("m"), hashing.mix64_next("x").alias("n"), hashing.unsigned_mod(hashing.mix64("x"), 7).alias("u")).collect()
    for x, r in zip(xs, got, strict=True):
        assert r["m"] % 2**64 == mix(x % 2**64) and r["u"] == mix(x % 2**64) % 7
        assert r["n"] % 2**64 == mix((x + 0x9E3779B97F4A7C15) % 2**64)
    assert spark.createDataFrame([("",), ("a",)], "t string").select(hashing.fnv1a64("t").alias("h")).collect()[1]["h"] % 2**64 == 0xAF63DC4C8601EC8C


def by_hand(tree, x):
    while "leaf" not in tree:
        v = x[tree["feature"]]
        left = (v >= 0 and v in tree["categories"]) if "categories" in tree else v <= tree["threshold"]
        tree = tree["left"] if left else tree["right"]
    return tree["leaf"]


def random_tree(rnd, depth):
    if depth == 0 or rnd.random() < 0.2:
        return {"leaf": rnd.uniform(-1, 1)}
    f, kids = rnd.randrange(5), {"left": random_tree(rnd, depth - 1), "right": random_tree(rnd, depth - 1)}
    return {"feature": f, "categories": rnd.sample(range(200), 20), **kids} if rnd.random() < 0.4 else {"feature": f, "threshold": rnd.uniform(-50, 150), **kids}


def test_model_walk_and_file(spark, tmp_path):
    rnd = random.Random(4)
    trees = [random_tree(rnd, 6) for _ in range(12)] + [{"leaf": 0.5}]
    x = np.array([[rnd.randrange(-20, 220) for _ in range(5)] for _ in range(300)])
    m = gbm.from_trees(trees, 5)
    want = np.array([sum(by_hand(t, r) for t in trees) for r in x.tolist()])
    assert np.allclose(m.residual(x, rows=64), want, atol=1e-12)
    assert np.allclose(m.residual(x, trees=2), [sum(by_hand(t, r) for t in trees[:2]) for r in x.tolist()], atol=1e-12)
    m.n_features = gbm.FEATURES
    data = gbm.encode(m)
    (tmp_path / "m.bin").write_bytes(data)
    again = gbm.read_model(spark, str(tmp_path / "m.bin"))
    assert np.allclose(again.residual(x), want, atol=1e-12)
    for bad in (data[:-1], data + b"x", b"X" + data[1:], data[:10]):
        with pytest.raises(ValueError):
            gbm.decode(bad)
    assert gbm.find_model(spark, "m.bin", [str(tmp_path / "no"), str(tmp_path)]).endswith("m.bin")
    assert {k: v.count() for k, v in again.tables(spark).items()}["gbm_roots"] == 13


def test_model_from_text_and_training(spark):
    text = "tree\nversion=v4\n\nTree=0\nnum_leaves=3\nsplit_feature=0 1\nthreshold=10.5 0\ndecision_type=2 1\nleft_child=-1 -2\nright_child=1 -3\nleaf_value=0.1 0.2 0.3\ncat_boundaries=0 1\ncat_threshold=6\n\nend of trees\n"
    m = gbm.from_text(text)
    assert m.residual(np.array([[10, 0], [11, 1], [11, 3], [11, -1]])).tolist() == [0.1, 0.2, 0.3, 0.3]
    rnd = random.Random(2)
    data = [([rnd.randrange(50), rnd.randrange(50)], 0.0) for _ in range(400)]
    df = spark.createDataFrame([(f, 0.5 if f[0] > 20 else -0.5) for f, _ in data], "features array<int>, residual double")
    made, gain = gbm.train(df, trees=5, depth=2)
    assert gain[0][0] == 0 and made.residual(np.array([[40, 0]]))[0] > 0.3


def test_prediction_rules(spark):
    df = spark.createDataFrame([(None, 1.0), (0, 1.0), (5, float("nan")), (5, 0.0), (100, 50.0), (3, -50.0)], "raw int, residual double")
    assert [r[0] for r in df.select(gbm.predicted(F.col("raw"), F.col("residual"))).collect()] == [None, 0, 0, 5, 4294967295, 0]
    half = spark.createDataFrame([(1, float(np.log(2.5)))], "raw int, residual double").select(gbm.predicted(F.col("raw"), F.col("residual"))).first()[0]
    assert half in (2, 3)


def test_scores(spark):
    df = spark.createDataFrame([(0, 0), (0, 5), (100, 100), (100, 110)], "golden int, estimate int")
    r = score.report(df).first()
    assert (r["rows"], r["exact"], r["under"], r["over"]) == (4, 2, 0, 2)
    assert abs(r["mape_one"] - 27.5) < 1e-9 and abs(r["mape_skip"] - 5) < 1e-9 and abs(r["mape_floor"] - 127.5) < 1e-9
    assert abs(r["score"] - 25 * (1 + 0 + 1 + 1 - np.tanh(0.4))) < 1e-9
    with pytest.raises(Exception, match="differ in row"):
        g = spark.createDataFrame([(0, "a", 1)], "row_id int, k string, delay int")
        score.zipped(g, g.withColumn("k", F.lit("b")), ("k",)).collect()
    c = score.checkpoints(df.withColumnsRenamed({"estimate": "base"}).withColumn("r1", F.lit(0.0)), ["r1"]).first()
    assert c["rows"] == 4
    assert [x.count() for x in score.prefix_split(spark.range(5).withColumnRenamed("id", "row_id"), 2)] == [2, 3]


def test_blends(spark):
    df = spark.createDataFrame([(1, 2, 4, 9)], "a int, b int, c int, d int")
    r = score.blends(df, ["a", "b", "c", "d"]).first()
    assert (r["blend_mean"], r["blend_median"], r["blend_geo"]) == (4.0, 3.0, 3.0)


def test_encodings_and_grid_stages(spark):
    r = queries._requests(spark, SF).limit(200)
    full = archs.chip(spark, [(n, "Output") for n in chip.port_names()], [], chip.nets())
    codes = features.decode_ports(full.ports)
    for e in "st":
        r = r.join(codes.select(F.col("port_id").alias(f"{e}p"), F.col("family").alias(f"{e}_family")), f"{e}p")
    r = r.withColumns({"raw": F.lit(100), "golden": F.lit(110), "prediction": F.lit(100.0), "direction": scalar.direction_code(F.col("tx") - F.col("sx"), F.col("ty") - F.col("sy")), "res": F.lit(0.1)})
    tables, fitted = calibrate.staged_fit(r, calibrate.grid_stages(full)[:5])
    assert tables.select("name").distinct().count() == 5
    assert fitted.agg(F.min("prediction")).first()[0] > 100
    enc = calibrate.encodings(r, "res", F.col("o_orderkey") % 2 == 0)
    assert abs(enc.agg(F.avg("enc_sp" if "enc_sp" in enc.columns else "enc_source_port")).first()[0] - 0.1) < 1e-9
    assert len(calibrate.grid_stages(full)) == 20 and len(estimate.calibration_keys()) == 12
    with pytest.raises(Exception, match="out of range"):
        calibrate.quantised(spark.createDataFrame([("x", 0, 9.0)], "name string, cell int, effect double")).collect()


def test_known_answers(spark):
    asked = spark.createDataFrame([("a", "b"), ("c", "d")], "from string, to string")
    answers = reuse.known_answers(spark.createDataFrame([("a", "b", 7)], "from string, to string, delay int"))
    got = reuse.with_known(asked, answers, lambda q: q.withColumn("delay", F.lit(1)))
    assert {tuple(r) for r in got.collect()} == {("a", "b", 7), ("c", "d", 1)}
    with pytest.raises(Exception, match="repeated pair"):
        reuse.known_answers(spark.createDataFrame([("a", "b", 7), ("a", "b", 8)], "from string, to string, delay int")).collect()


def test_files_of_features_and_report(spark, tmp_path):
    a = archs.synthetic(spark)
    pairs = spark.createDataFrame(some_pairs(a, 5, 3), SIX)
    est = estimate.raw_estimates(pairs, a, potentials.Potentials(a)).withColumn("row_id", F.monotonically_increasing_id())
    sinks.write_search_features(est, str(tmp_path / "s"), single=True)
    assert spark.read.csv(str(tmp_path / "s"), header=True).columns == fixed.SEARCH_COLUMNS
    f = features.features(est, a).withColumn("row_id", F.monotonically_increasing_id())
    sinks.write_model_features(f, str(tmp_path / "f"), count=3, single=True)
    assert spark.read.csv(str(tmp_path / "f"), header=True).columns == ["f0", "f1", "f2"]
    df, seen = sinks.run_report(est.withColumn("delay", F.col("raw")))
    df.collect()
    assert seen.get["rows"] == pairs.distinct().count()
    assert sinks.single_line(spark.createDataFrame([(None, "")], "delay int, path string"), True) == "-1"


def test_entry_and_contract(spark):
    import __spark_entry__ as e

    assert 0 < e.entry(spark).count() <= 9
    assert set(e.oracle_sql()) <= set(e.queries())


def test_search_features_come_back(spark, tmp_path):
    rows = spark.createDataFrame([(i, *[None if (i + k) % 5 == 0 else i * 100 + k for k in range(len(fixed.SEARCH_COLUMNS))]) for i in range(50)], "row_id long, " + ", ".join(f"`{c}` int" for c in fixed.SEARCH_COLUMNS))
    sinks.write_search_features(rows.repartition(3), str(tmp_path / "f"))
    asked = spark.range(50).withColumnRenamed("id", "row_id")
    back = requests.read_search_features(spark, str(tmp_path / "f"), asked)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.collect()))
    with pytest.raises(ValueError, match="50 rows of features for 49"):
        requests.read_search_features(spark, str(tmp_path / "f"), asked.limit(49))


def test_holdout_predictions_side_by_side(spark, tmp_path):
    for i, wrong in enumerate((0, 0, 1)):
        spark.range(20).selectExpr("id as row", f"cast(id * 3 + {wrong} * (id div 19) as int) as golden", f"id + {i} as prediction").write.parquet(str(tmp_path / str(i)))
    got = requests.read_predictions(spark, [str(tmp_path / "0"), str(tmp_path / "1")])
    assert sorted(map(tuple, got.collect())) == [(i, 3 * i, i, i + 1) for i in range(20)]
    with pytest.raises(Exception, match="predictions differ in row 19"):
        requests.read_predictions(spark, [str(tmp_path / "0"), str(tmp_path / "2")]).collect()


@pytest.mark.parametrize("version", [1, 3])
def test_written_models_agree_on_random_rows(version):
    m = gbm.from_trees([t | {} for t in queries.TREES], 105)
    assert gbm.same_residuals(m, gbm.decode(gbm.encode(m, version)))
    other = gbm.from_trees([queries.TREES[0]], 105)
    assert not gbm.same_residuals(m, other)


def test_row_numbers_follow_the_file(spark, tmp_path):
    lines = ["From,To", *[f"a{i},b{i}" for i in range(5000)], "", "x,y"]
    (tmp_path / "r.csv").write_text("\n".join(lines))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = sorted((r["row_id"], r["from"]) for r in requests.read_requests(spark, str(tmp_path / "r.csv")).collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == [*((i, f"a{i}") for i in range(5000)), (5000, "x")]


def test_quantiles_of_few_and_equal_errors(spark):
    for errors in ([], [3], [5] * 30 + [7], list(range(100))):
        df = spark.createDataFrame([(100, 100 + e) for e in errors], "golden int, estimate int").repartition(3)
        got = list(score.error_quantiles(df).first())
        assert got == ([None] * 4 if not errors else pytest.approx(np.quantile(np.array(errors, float), [0.5, 0.9, 0.95, 0.99]).tolist()))


def test_known_answers_go_first(spark, tmp_path):
    a = queries._full(spark)
    pins = queries.pin_format_parse(spark, SF).limit(6).select("from_pin", "to_pin").collect()
    bound, _ = requests.bind(spark.createDataFrame([(i, r[0], r[1], None) for i, r in enumerate(pins)], "row_id long, from string, to string, error string"), a)
    spark.createDataFrame([(pins[2][0], pins[2][1], 777)], "from string, to string, delay int").write.parquet(str(tmp_path / "known"))
    o = argparse.Namespace(known=str(tmp_path / "known"), no_public_cache=False, solver="fast", feature_output=None, model_feature_output=None)
    seen = []
    old, cli.solve = cli.solve, lambda rest, arch, o: (seen.append(rest.count()), rest.withColumn("delay", F.lit(1)))[1]
    try:
        got = {r["row_id"]: r["delay"] for r in cli.answered(bound, a, o).collect()}
        assert got == {i: 777 if i == 2 else 1 for i in range(6)} and seen == [5]
        o.no_public_cache = True
        assert {r["delay"] for r in cli.answered(bound, a, o).collect()} == {1}
    finally:
        cli.solve = old
    with sinks.progress(spark, 0.01):
        spark.range(1000).count()
