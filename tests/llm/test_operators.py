"""The ten operators and the pipeline against brute force, SQL and held-out labels, and on odd tables."""

import importlib
import random
import zlib

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from gridlark.llm import decontaminate, language, mixing, partenum, quality, registry, sharding, substrings, suffixdedup, toxicity, vectors
from gridlark.llm.graph import components, forest
from gridlark.llm.store import saved
from gridlark.llm.suffixes import suffix_order

DATA = "/root/testdata"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rnd, n, vocabulary=400):
    return [f"w{rnd.randrange(vocabulary)}" for _ in range(n)]


def odd_rows():
    """Copies, near copies, shared passages, one very long text, empty and null texts, repeated rows."""
    rnd = random.Random(5)
    passage, line = words(rnd, 70), words(rnd, 12)
    texts = {}
    base = words(rnd, 120)
    for i in range(0, 12):
        t = list(base)
        for _ in range(rnd.randrange(0, 5)):
            t[rnd.randrange(len(t))] = "edit"
        texts[i] = " ".join(t)
    for i in range(12, 20):
        texts[i] = " ".join([*words(rnd, 30), *(passage if i % 2 else line), *words(rnd, rnd.randrange(60))])
    texts |= {20: "", 21: None, 22: "one", 23: "Two  words\t\n", 24: "two words", 25: texts[3], 26: texts[3], 27: "été ÉTÉ naïve — 漢字 " * 30, 28: "été ÉTÉ naïve — 漢字 " * 30}
    texts[29] = " ".join([*words(rnd, 3000, 5000), *passage, *words(rnd, 500)])
    texts[30] = "a b " * 200
    for i in range(31, 90):
        texts[i] = " ".join(words(rnd, rnd.randrange(1, 80), 5000))
    return [(i, t, ["en", "de", None][i % 3], ["s1", "s2", None, "s1"][i % 4], len(t or "")) for i, t in texts.items()]


ROWS = odd_rows()
IDS, TEXTS = [r[0] for r in ROWS], [r[1] for r in ROWS]


@pytest.fixture(scope="module")
def docs(spark):
    """With extra columns named as those that the operators make."""
    df = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    extra = ("score", "size", "node", "taken", "first", "spans", "shard", "kind", "block", "target", "n_words", "row", "copies", "item_id")
    return saved(df.withColumns({c: F.lit("x") for c in extra}))


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, int(i % 4 > 0), int(i % 5 == 0)) for i in range(60)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    own = [TEXTS[13].split()[32:60], TEXTS[29].split()[100:110], ["one"], [], TEXTS[0].upper().split()[5:17]]
    rows = [(i, " ".join(w)) for i, w in enumerate(own)] + [(9, None), (10, "no such words at all here now you see them")]
    return spark.createDataFrame(rows, "item_id long, text string")


def same(got, want):
    key = list(want.columns)
    a, b = (x[key].sort_values(key[0]).reset_index(drop=True) for x in (got.toPandas(), want))
    pd.testing.assert_frame_equal(a, b, check_dtype=False)


# ---- searches and dedup against brute force


def test_decontamination(docs, benchmark, nothing):
    b = benchmark.toPandas()
    want = decontaminate.brute_force(IDS, TEXTS, b["item_id"].tolist(), b["text"].tolist())
    found = decontaminate.spans(docs, benchmark)
    got = found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
    same(got, want)
    assert want["contaminated"].sum() > 3
    spans = {r["doc_id"]: sum(s["end"] - s["start"] for s in r["spans"]) for r in found.collect()}
    assert spans == dict(zip(want["doc_id"], want["n_hit"], strict=True))
    assert decontaminate.spans(nothing, benchmark).count() == 0
    assert decontaminate.spans(docs, benchmark.limit(0)).where("n_hit > 0").count() == 0


def test_cut_leaves_no_window(docs, benchmark):
    clean = decontaminate.cut(docs, benchmark)
    assert clean.columns == docs.columns
    assert decontaminate.spans(clean, benchmark).where("n_hit > 0").count() == 0
    before, after = {r["doc_id"]: r["text"] for r in docs.collect()}, {r["doc_id"]: r for r in clean.collect()}
    hit = {r["doc_id"] for r in decontaminate.spans(docs, benchmark).where("n_hit > 0").collect()}
    assert set(before) - set(after) == {22}  # nothing of it was left
    assert all(after[i]["text"] == before[i] for i in after if i not in hit)
    assert all(after[i]["n_chars"] == len(after[i]["text"]) for i in after if i in hit)


def test_benchmark_in_several_blocks(docs, benchmark, monkeypatch):
    whole = decontaminate.spans(docs, benchmark).select("doc_id", "n_hit", "items").toPandas().sort_values("doc_id").reset_index(drop=True)
    whole_cut = {r["doc_id"]: r["text"] for r in decontaminate.cut(docs, benchmark).collect()}
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 60)
    parts_cut = {r["doc_id"]: r["text"] for r in decontaminate.cut(docs, benchmark).collect()}
    assert decontaminate.spans(docs.sparkSession.createDataFrame(list(parts_cut.items()), "doc_id long, text string"), benchmark).where("n_hit > 0").isEmpty()
    assert parts_cut.keys() == whole_cut.keys()
    parts = decontaminate.spans(docs, benchmark).select("doc_id", "n_hit", "items").toPandas().sort_values("doc_id").reset_index(drop=True)
    assert whole["n_hit"].tolist() == parts["n_hit"].tolist() and [list(x) for x in whole["items"]] == [list(x) for x in parts["items"]]


def test_sql_says_the_same(docs, benchmark, tmp_path):
    """The SQL of the contracts, on the fixture with null and empty texts and copies."""
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": IDS, "text": TEXTS}))
    con.register("benchmark", pa.Table.from_pandas(benchmark.toPandas()))
    sql = registry.oracle_sql()
    b = benchmark.toPandas()
    for name, want in (
        ("op3_fm_decontaminate", decontaminate.brute_force(IDS, TEXTS, b["item_id"].tolist(), b["text"].tolist())), ("op5_partenum_join", partenum.brute_force(IDS, TEXTS)),
        ("op8_debruijn_substrings", substrings.brute_force(IDS, TEXTS)), ("op9_runlength_suffixes", suffixdedup.brute_force(IDS, TEXTS)),
    ):
        got = con.sql(sql[name]).df()[list(want.columns)].sort_values("doc_id").reset_index(drop=True)
        pd.testing.assert_frame_equal(got, want, check_dtype=False)


def test_jaccard_join(docs, nothing):
    same(partenum.link_classes(docs), partenum.brute_force(IDS, TEXTS))
    assert partenum.link_classes(nothing).count() == 0
    one = partenum.one_of_each(docs)
    want = partenum.brute_force(IDS, TEXTS)
    assert {r["doc_id"] for r in one.collect()} == set(want["component_id"]) and one.columns == docs.columns


def test_jaccard_join_with_null_and_repeated_ids(spark):
    """A row is known by its id and text: null ids bridge, and each text of a repeated id links on its own."""
    rnd = random.Random(12)
    a, x = words(rnd, 100), words(rnd, 100)
    near = lambda t, *at: " ".join("edit" if i in at else w for i, w in enumerate(t))
    a0, a1, a2 = near(a, 40), near(a, 60), near(a, 40, 60)
    rows = [(1, a0), (None, a2), (2, a1), (3, " ".join(x)), (3, "quite another text of few words"), (4, near(x, 50)), (5, "quite another text of few words"), (None, None), (None, "alone without any id or partner")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(partenum.link_classes(df).collect(), key=str)
    key = [(r[0], i) for i, r in enumerate(rows)]
    want = partenum.brute_force(list(range(len(rows))), [r[1] for r in rows])
    ids = {}
    for (i, _), c in zip(key, want["component_id"], strict=True):
        ids.setdefault(c, []).append(i)
    least = {c: min((i for i in v if i is not None), default=None) for c, v in ids.items()}
    expected = [(i, n, least[c]) for (i, _), n, c in zip(key, want["n_shingles"], want["component_id"], strict=True)]
    assert sorted(map(str, expected)) == sorted(str(tuple(r)) for r in got)
    assert [e for e in expected if e[0] is None] == [(None, 96, 1), (None, 0, None), (None, 2, None)]
    kept = partenum.one_of_each(df).collect()
    assert sorted(str(r["doc_id"]) for r in kept) == sorted(["1", "3", "3", "None", "None"]) and len(kept) == 5


@pytest.mark.parametrize("hot", [1, 2])
def test_jaccard_join_with_hot_signatures(spark, hot, monkeypatch):
    """A limit so low that nearly all links must come from the rounds and tiles for hot groups."""
    monkeypatch.setattr(partenum, "HOT", hot)
    monkeypatch.setattr(partenum, "BLOCK", 8)
    rnd = random.Random(hot)
    base, line = words(rnd, 90), words(rnd, 20)
    rows = []
    for i in range(60):
        t = list(base) if i < 30 else [*line, *words(rnd, rnd.randrange(2, 12))]
        for _ in range(rnd.randrange(0, 4) if i < 30 else 0):
            t[rnd.randrange(len(t))] = f"e{rnd.randrange(3)}"
        rows.append((i, " ".join(t)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    same(partenum.link_classes(df), partenum.brute_force([r[0] for r in rows], [r[1] for r in rows]))


def test_band_bounds():
    low, most, parts = partenum.bands()
    for a in range(1, 300):
        for b in range(a, a * 5 // 4 + 1):
            i, j = np.searchsorted(low, [a, b], "right") - 1
            assert j - i in (0, 1)
            shared = -(-4 * (a + b) // 9)
            assert a + b - 2 * shared <= most[j] < parts[j]


def test_substrings(docs, nothing):
    got = substrings.dedup_words(docs)
    same(got.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256")), substrings.brute_force(IDS, TEXTS))
    assert got.agg(F.sum("n_removed")).first()[0] > 500
    assert substrings.dedup_words(nothing).count() == 0


def test_suffixes(docs, nothing):
    got = suffixdedup.dedup_bytes(docs)
    same(got.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")), suffixdedup.brute_force(IDS, TEXTS))
    assert suffixdedup.dedup_bytes(nothing).count() == 0


def test_suffixes_at_hot_anchors_and_copies(spark, monkeypatch):
    from gridlark.llm import repeats

    monkeypatch.setattr(repeats, "HOT", 2)
    rnd = random.Random(8)
    line = " ".join(words(rnd, 14))
    rows = [(i, " ".join(words(rnd, 8)) + " " + line + " " + " ".join(words(rnd, 8))) for i in range(40)] + [(i, "copy " + line * 3) for i in range(40, 400)]
    rows = [*rows, (7, rows[3][1]), (7, "quite another text of the same id " * 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = suffixdedup.brute_force([r[0] for r in rows], [r[1] for r in rows])
    got = suffixdedup.dedup_bytes(df).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")).toPandas()
    key = list(want.columns)
    assert sorted(map(tuple, got[key].values.tolist())) == sorted(map(tuple, want.values.tolist()))


def test_null_ids_keep_their_text(spark):
    t = " ".join(words(random.Random(1), 80))
    df = spark.createDataFrame([(None, t), (1, t), (2, t), (None, None)], "doc_id long, text string")
    a = {(r["doc_id"], r["n_words"]): r["n_removed"] for r in substrings.dedup_words(df).collect()}
    assert a == {(None, 80): 0, (1, 80): 0, (2, 80): 80, (None, 0): 0}
    b = suffixdedup.dedup_bytes(df)
    assert b.where("doc_id is null and n_removed > 0").count() == 0 and b.where("doc_id = 2 and n_removed = n_bytes").count() == 1
    assert {r["doc_id"]: r["component_id"] for r in partenum.link_classes(df).where("doc_id is not null").collect()} == {1: 1, 2: 1}
    assert partenum.one_of_each(df.withColumn("lang", F.lit("x"))).count() == 2
    assert sharding.shard(df).count() == 4 and decontaminate.spans(df, df.selectExpr("1 as item_id", "text").limit(1)).count() == 4


def test_vectors(spark):
    rnd = np.random.default_rng(3)
    x = rnd.normal(size=(300, 24))
    for i in range(100, 200):
        x[i] = x[i - 100] + rnd.normal(size=24) * rnd.uniform(0, 0.3)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    rows += [(300, None), (301, [0.0] * 24), (302, [float("nan")] * 24), (303, [1.0, None] * 12), (304, rows[5][1]), (305, rows[5][1]), (306, [2 * c for c in rows[5][1]]), (307, [1.0, 2.0]), (308, [1.0, 2.0]), (309, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("label", F.lit(1)).repartition(3)
    want = vectors.brute_force([r[0] for r in rows], [r[1] for r in rows])
    got = vectors.near_vectors(df).toPandas()
    assert got["n_links"].sum() >= 0.9 * want["n_links"].sum() > 100
    both = got.merge(want, on="vec_id")
    assert (both["n_links_x"] <= both["n_links_y"]).all()
    assert (both["component_id_x"] == both["component_id_y"]).mean() > 0.97
    assert (got["kept"] == (got["vec_id"] == got["component_id"])).all()
    assert vectors.near_vectors(df.limit(0)).count() == 0


def test_vectors_in_tiles(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 16)
    monkeypatch.setattr(vectors, "CELL_ROWS", 20)
    rnd = np.random.default_rng(4)
    x = np.concatenate([rnd.normal(size=(1, 16)) + rnd.normal(size=(90, 16)) * 0.05, rnd.normal(size=(60, 16))])
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    want = vectors.brute_force([r[0] for r in rows], [r[1] for r in rows])
    got = vectors.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).toPandas().merge(want, on="vec_id")
    assert got["n_links_x"].sum() >= 0.99 * want["n_links"].sum() and (got["component_id_x"] == got["component_id_y"]).all()


# ---- mixing and sharding


def in_duckdb(df, sql):
    con = duckdb.connect()
    t = pa.Table.from_pandas(df)  # noqa: F841
    con.register("documents", t)
    return con.sql(sql).df()


def test_mixing_equals_sql(spark, docs, nothing):
    small = docs.select("doc_id", "text", "source")
    base = small.select("doc_id", "source", mixing.n_words(F.col("text")).alias("size"))
    got = mixing.mix(base, bucket_rows=7).select("doc_id", "size", "source_size", "target", "taken")
    same(got, in_duckdb(small.toPandas(), mixing.OP7_SQL).sort_values("doc_id"))
    assert mixing.mix(nothing.select("doc_id", "source", mixing.n_words(F.col("text")).alias("size"))).count() == 0
    mixed = mixing.mixed(docs)
    taken = {r["doc_id"]: r["taken"] // r["size"] for r in got.collect() if r["taken"]}
    assert {r["doc_id"]: r["n"] for r in mixed.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).collect()} == taken
    assert mixed.columns == docs.columns


def test_mix_stops_late_with_one_huge_document(spark):
    rows = [(i, "a", "x " * 10) for i in range(30)] + [(100 + i, "b", "x " * 10) for i in range(10)] + [(999, "c", "x " * 1000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = mixing.mix(df.select("doc_id", "source", mixing.n_words(F.col("text")).alias("size"))).select("doc_id", "size", "source_size", "target", "taken")
    same(got, in_duckdb(df.toPandas(), mixing.OP7_SQL).sort_values("doc_id"))
    assert got.agg(F.sum("taken")).first()[0] == 1200


def test_targets_are_filled_in_turn(spark):
    sizes = [("a", 100), ("b", 10000), ("c", 50), (None, 700), ("d", 3)]
    got = {r["source"]: r["target"] for r in mixing.targets(spark.createDataFrame(sizes, "source string, source_size long")).collect()}
    names = sorted([s for s, _ in sizes if s]) + [None]
    size, weight = dict(sizes), {n: (5, 2, 1)[i % 3] for i, n in enumerate(names)}
    full, total = set(), sum(s for _, s in sizes)
    while True:
        rate = (total - sum(3 * size[n] for n in full)) / sum(weight[n] for n in names if n not in full)
        more = {n for n in names if n not in full and weight[n] * rate > 3 * size[n]}
        if not more:
            break
        full |= more
    for n in names:
        assert abs(got[n] - (3 * size[n] if n in full else weight[n] * rate)) < 1e-6 * total


def test_shards(spark, docs, nothing):
    rows = [(i, "hot copy") for i in range(900)] + [(900 + i, f"pair {i // 2}") for i in range(400)] + [(None, None), (5, "hot copy"), (2000, ""), (2001, "")]
    for df in (docs, spark.createDataFrame(rows, "doc_id long, text string").repartition(5)):
        got = sharding.shard(df, bucket_rows=50).toPandas()
        n = got.groupby("shard")["slot"].agg(["count", "max", "nunique"])
        assert n["count"].max() - n["count"].min() <= 1 and len(got) == df.count()
        assert (n["count"] == n["max"] + 1).all() and (n["count"] == n["nunique"]).all()
        assert set(got["law"]) == {"rows"} and got["grown_shard"].isna().all()
    text = dict(rows)
    for r in got.itertuples():
        t = text[r.doc_id if r.doc_id == r.doc_id else None]
        assert r.size == len((t or "").encode()) + 1 and r.text_crc32 == zlib.crc32((t or "").encode())
    pairs = got[(got["doc_id"] >= 900) & (got["doc_id"] < 1300)]
    cut = pairs.groupby((pairs["doc_id"] - 900) // 2)["shard"].nunique()
    assert (cut == 1).mean() > 0.95
    assert sharding.shard(nothing).count() == 0


def shards_of_groups(spark, sizes, n, partitions=5):
    """Rows, shards and slots where the first texts have ``sizes`` copies and all others are single."""
    rows = [(f"group {g}",) for g, size in enumerate(sizes) for _ in range(size)]
    rows += [(f"single {i}",) for i in range(n - len(rows))]
    rows = [(i, t) for i, (t,) in enumerate(rows)]
    got = sharding.shard(spark.createDataFrame(pd.DataFrame(rows, columns=["doc_id", "text"])).repartition(partitions)).toPandas()
    counts = got.groupby("shard")["slot"].agg(["count", "max", "nunique"])
    assert len(got) == n and counts["count"].max() - counts["count"].min() <= 1
    assert (counts["count"] == counts["max"] + 1).all() and (counts["count"] == counts["nunique"]).all()
    got["group"] = got["doc_id"].map(dict(rows))
    return got.groupby("group")["shard"].value_counts().unstack(fill_value=0)


def test_copies_stay_together(spark):
    sizes = [3, 4, 5, 8, 13, 21, 50, 100, 200, 350, 500] * 2
    by = shards_of_groups(spark, sizes, 40000)
    assert [int((by.loc[f"group {g}"] > 0).sum()) for g in range(len(sizes))] == [1] * len(sizes)


def test_only_groups_over_a_shard_are_cut(spark):
    for sizes, n in (([8000, 3000, 1500, 1001, 700, 20], 70000), ([2] * 8, 16), ([30, 12, 6, 5, 2, 2], 100), ([12] * 8, 96)):
        by = shards_of_groups(spark, sizes, n)
        cut = [int((by.loc[f"group {g}"] > 0).sum()) for g in range(len(sizes))]
        assert [c for s, c in zip(sizes, cut, strict=True) if s <= n // 8] == [1] * sum(s <= n // 8 for s in sizes), (n, cut)
    assert sharding._packed([25, 6, 4], [10, 10, 10, 10]) == [[(0, 10), (1, 10), (2, 5)], [(3, 6)], [(2, 4)]]


# ---- classifiers


def auc(y, p):
    r = pd.Series(p).rank().to_numpy()
    n = y.sum()
    return (r[y == 1].sum() - n * (n + 1) / 2) / (n * (len(y) - n))


def test_held_out_accuracy(spark):
    sf = f"{DATA}/sf0.1"
    d = pq.read_table(f"{sf}/documents.parquet", columns=["doc_id", "lang"]).to_pandas()
    lab = pq.read_table(f"{sf}/labels.parquet").to_pandas()
    tox = toxicity.op2(spark, sf).toPandas()
    assert len(tox) == len(d) and tox["score"].between(0, 1).all() and (tox["predicted"] == (tox["score"] >= 0.5)).all()
    assert (tox["held_out"] == [zlib.crc32(str(i).encode()) % 5 == 0 for i in tox["doc_id"]]).all()
    h = tox[tox["held_out"]].merge(lab, on="doc_id")
    assert auc(h["toxic"].to_numpy(), h["score"]) > 0.95  # some toxic documents hold no toxic word
    lang = language.op6(spark, sf).toPandas()
    assert (lang["held_out"] == [zlib.crc32(str(i).encode()) % 3 == 1 for i in lang["doc_id"]]).all()
    h = lang[lang["held_out"]].merge(d, on="doc_id")
    assert (h["lang"] == h["lang_pred"]).mean() > 0.97
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = spark.read.parquet(f"{sf}/labels.parquet").where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 0)
    q = quality.score(docs, quality.fit(docs, seen)).toPandas().merge(lab, on="doc_id")
    q = q[[zlib.crc32(str(i).encode()) % 4 == 0 for i in q["doc_id"]]]  # labels that the model has not seen
    assert auc(q["quality"].to_numpy(), q["score"]) > 0.95
    q = quality.op1(spark, sf).toPandas().merge(lab, on="doc_id")
    assert auc(q["quality"].to_numpy(), q["score"]) > 0.97 and q["keep"][q["quality"] == 1].mean() > 0.97


def test_classifiers_on_odd_tables(docs, labels, nothing):
    for f, op in ((toxicity.fit, toxicity.score), (quality.fit, quality.score)):
        model = f(docs, labels)
        got = op(docs, model).toPandas()
        assert len(got) == len(ROWS) and got["score"].between(0, 1).all()
        assert op(nothing, model).count() == 0
        assert f(docs, labels.limit(0)) is None and f(nothing, labels) is None
        assert op(docs, None).count() == len(ROWS)
    names, proto = language.fit(docs)
    got = language.predict(docs, names, proto).toPandas().set_index("doc_id")
    assert names == ["de", "en"] and (got.loc[[20, 21], "lang_pred"] == "und").all() and got["score"].between(0, 1).all()
    assert language.predict(docs, *language.fit(nothing)).where("lang_pred <> 'und'").count() == 0
    assert quality.accepted(docs, quality.fit(docs, labels)).columns == docs.columns


def test_labels_of_other_documents_do_not_crowd_out_ours(spark, docs, labels):
    """Samples are of labels that our documents have."""
    foreign = spark.range(1000, 3000).selectExpr("id as doc_id", "cast(id % 2 as int) as quality", "cast(id % 2 as int) as toxic")
    more = labels.unionByName(foreign)
    assert quality.fit(docs, more, max_labelled=30) is not None and toxicity.fit(docs, more, max_positive=5) is not None


# ---- parts


def test_suffix_order_and_run_length_index():
    rnd = random.Random(2)
    pieces = ["".join(rnd.choice("ab") for _ in range(rnd.randrange(1, 70))) for _ in range(40)]
    text = np.array([c for p in pieces for c in [*p.encode(), 0]], np.int64)
    ends = np.flatnonzero(text == 0)
    left = ends[np.searchsorted(ends, np.arange(len(text)))] - np.arange(len(text)) + 1
    order = suffix_order(text, left, 256)
    want = sorted(range(len(text)), key=lambda i: (bytes(text[i : i + left[i] - 1].tolist()), i))
    assert order.tolist() == want
    row = np.empty(len(text), np.int64)
    row[order] = np.arange(len(text))
    index = suffixdedup.RunLengthIndex(text, left, 50)
    source, match = index.statistics()
    for i in np.flatnonzero(text).tolist():  # each has its neighbour in order, and what both begin with
        j = order[row[i] - 1]
        a, b = (bytes(text[x : x + left[x] - 1].tolist()) for x in (i, j))
        common = next((n for n, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))  # noqa: B905
        assert source[i] == j and min(match[i], 50) == min(common, 50)
    assert len(index.first_sample) < 0.6 * len(text)
    for window in (3, 5, 12):
        first = {}
        for i in range(len(text)):
            if left[i] > window:
                first.setdefault(bytes(text[i : i + window].tolist()), i)
        got = suffixdedup._earliest(text, left, window)
        assert all(got[i] == first[bytes(text[i : i + window].tolist())] for i in range(len(text)) if left[i] > window)


def test_fm_index():
    rnd = random.Random(6)
    pieces = [[rnd.randrange(1, 6) for _ in range(rnd.randrange(1, 60))] for _ in range(30)]
    text = np.array([c for p in pieces for c in [*p, 0]], np.int64)
    ends = np.flatnonzero(text == 0)
    at = np.arange(len(text))
    left = ends[np.searchsorted(ends, at)] - at + 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    inside = at - starts[np.searchsorted(starts, at, "right") - 1]
    index = decontaminate.FMIndex(text, left, inside % 8 == 0, 5)
    for _ in range(50):
        p = [rnd.randrange(1, 6) for _ in range(rnd.randrange(1, 5))]
        pattern = np.zeros((1, 6), np.int64)
        pattern[0, : len(p)] = p
        lo, hi = index.search(pattern, np.array([len(p)]))
        want = [i for i in range(len(text)) if text[i : i + len(p)].tolist() == p]
        assert sorted(index.locate(np.arange(lo[0], hi[0])).tolist()) == want


def test_components(spark):
    rnd = random.Random(9)
    edges = [(rnd.randrange(200), rnd.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 360)]
    up = list(range(400))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in edges:
        a, b = sorted((top(a), top(b)))
        up[b] = a
    got = {r["node"]: r["comp"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: top(i) for i in {x for e in edges if e[0] != e[1] for x in e}}
    a, b = (np.array(x) for x in zip(*edges, strict=True))
    assert forest(400, a, b).tolist() == [top(i) for i in range(400)]


def test_registry_names():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.queries()) == list(range(1, 11))
    assert set(registry.oracle_sql()) <= set(registry.queries())


def test_pipeline(spark):
    cp = importlib.import_module("corpus_pipeline")
    sf = f"{DATA}/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = docs.columns
    for i, (_, stage) in enumerate(cp.STAGES):
        before = docs.toPandas()
        docs = saved(stage(spark, docs, sf))
        after = docs.toPandas()
        if i < 4:
            assert docs.columns == names
        if i == 1:
            want = partenum.brute_force(before["doc_id"].tolist(), before["text"].tolist())
            assert set(after["doc_id"]) == set(want["component_id"])
        if i == 2:
            b = spark.read.parquet(f"{sf}/benchmark.parquet").toPandas()
            assert not decontaminate.brute_force(after["doc_id"].tolist(), after["text"].tolist(), b["item_id"].tolist(), b["text"].tolist())["contaminated"].any()
        if i == 3:
            want = in_duckdb(before, mixing.OP7_SQL)
            want = want[want["taken"] > 0]
            assert dict(zip(want["doc_id"], want["taken"] // want["size"], strict=True)) == after.groupby("doc_id").size().to_dict()
            mixed = after
        if i == 4:
            assert sorted(after["doc_id"]) == sorted(mixed["doc_id"])
    assert cp.run(spark, sf).count() == len(after)


def test_pipeline_stages_on_odd_tables(spark, docs, labels, benchmark, nothing, tmp_path):
    """Null and empty texts, null metadata, repeated rows and clashing names pass every stage; an empty table stays empty."""
    cp = importlib.import_module("corpus_pipeline")
    sf = str(tmp_path)
    labels.write.parquet(f"{sf}/labels.parquet")
    benchmark.write.parquet(f"{sf}/benchmark.parquet")
    more = docs.unionByName(docs.where("doc_id in (3, 13, 20)")).unionByName(docs.where("doc_id in (14, 21)").withColumn("doc_id", F.lit(None).cast("long")))
    for now in (more, nothing):
        empty = now is nothing
        for name, stage in cp.STAGES:
            before = now
            now = saved(stage(spark, before, sf))
            assert empty == now.isEmpty(), name
            if name != "sharding":
                assert now.columns == before.columns and now.where("doc_id is not null").select("doc_id").distinct().join(before, "doc_id", "left_anti").isEmpty()
            if name == "n-gram Jaccard join":
                texts = [r["text"] for r in now.collect() if (r["text"] or "").split()]
                assert partenum.link_classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string") if texts else nothing).where("doc_id <> component_id").isEmpty()
            if name == "sharding":
                assert now.count() == before.count()
