"""Small inputs whose results are known by hand, and invariants."""

import hashlib
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.functions import scalar
from lodestone.operators import clustering, graph, itemsets, models, recommend, relational, similarity
from lodestone.plans import catalogue
from lodestone.sources import readers, sinks
from lodestone.streaming import sketches


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_scalars(spark):
    assert one(spark, scalar.basket_key(F.lit("11/1/2000"), F.lit("038"))) == "11/1/00-038"
    assert one(spark, scalar.without_zeros(F.lit("00120"))) == "120"
    assert one(spark, scalar.list_length(F.lit("None"))) == 0 and one(spark, scalar.list_length(F.lit("a,b"))) == 2
    assert one(spark, scalar.text_mod(F.lit(""), 69997)) == 0
    for s in ("a", "zZ9-_", "éü", "x" * 40):
        assert one(spark, scalar.text_mod(F.lit(s), 69997)) == int(s.encode().hex(), 16) % 69997
    assert [one(spark, scalar.trailing_zeros(F.lit(h))) for h in (0, 1, 2, 8, 12)] == [1, 0, 1, 3, 2]
    assert one(spark, scalar.jaccard(F.array(F.lit(1), F.lit(2)), F.array(F.lit(2), F.lit(3)))) == pytest.approx(1 / 3)
    # three that round alike and two near the number; one of them apart; too few near; halves to even; clipped
    votes = [((3.05, 3.15, 3.4), 3.0), ((3.05, 2.9, 4.2), 2.9), ((3.3, 3.15, 3.4), 3.15), ((2.5, 2.1, 1.95), 2.0), ((2.5, 2.3, 1.95), 2.3), ((5.6, 5.7, 6.2), 5.0), ((0.2, 0.1, 0.05), 1.0)]
    for values, want in votes:
        assert one(spark, scalar.vote(*(F.lit(v) for v in values))) == pytest.approx(want)
    steps = [(-3.01, 1), (-3.0, 2), (-1.0, 3), (0.99, 3), (1.0, 4), (3.0, 5), (2.99, 4)]
    assert all(one(spark, scalar.quantized(F.lit(x))) == want for x, want in steps)
    assert one(spark, scalar.blend(F.lit(-0.5), [(0.3, F.lit(1.0)), (0.4, F.lit(0.5))], 0.3)) == pytest.approx(-0.65)
    assert one(spark, scalar.map_sum(F.create_map(F.lit("a"), F.lit(2), F.lit("b"), F.lit(3)))) == 5


def test_numbered_rows_are_dense(spark):
    got = [r.n for r in relational.numbered(spark.range(0, 1000, 7), "id", "n").orderBy("id").collect()]
    assert got == list(range(143))


def test_itemsets_at_the_support(spark):
    baskets = [("1", "abc"), ("2", "abc"), ("3", "ab"), ("4", "cd"), ("5", "ab")]
    df = spark.createDataFrame([(b, i) for b, items in baskets for i in items], "basket string, item string")
    want = {}
    for k in (1, 2, 3):
        for s in itertools.combinations("abcd", k):
            n = sum(set(s) <= set(items) for _, items in baskets)
            if n >= 2:
                want[s] = n
    for found in (itemsets.apriori(df, 2), itemsets.fp_growth(df, 2)):
        assert {tuple(r["items"]): r.freq for r in found.collect()} == want
    report = [r.value for r in sinks.itemset_report(itemsets.apriori(df, 2), "Frequent Itemsets").orderBy("line").collect()]
    assert report == ["Frequent Itemsets:", "('a'),('b'),('c')", "", "('a', 'b'),('a', 'c'),('b', 'c')", "", "('a', 'b', 'c')", ""]


def test_registered_itemsets_of_all_sizes(spark, monkeypatch):
    df = spark.createDataFrame([(b, i) for b in range(20) for i in "vwxyz"] + [(20, "a")], "basket long, item string")
    monkeypatch.setattr(catalogue.readers, "brand_baskets", lambda *_: df)
    want = {(",".join(c), 20) for k in range(1, 6) for c in itertools.combinations("vwxyz", k)}
    assert {(r["items"], r.freq) for r in catalogue.QUERIES["frequent_itemsets_fpgrowth"](spark, "").collect()} == want
    assert {(",".join(r["items"]), r.freq) for r in itemsets.apriori(df, 20).collect()} == want


def test_lsh_is_within_exact(spark):
    r = random.Random(1)
    df = spark.createDataFrame([(i, u) for i in range(30) for u in r.sample(range(40), 10 + i % 5)], "item long, user long")
    exact = {(x.a, x.b) for x in similarity.jaccard(df, 0.3).collect()}
    found = {(x.a, x.b) for x in similarity.similar_items(df, 0.3).collect()}
    assert found <= exact and len(found) > 0.9 * len(exact)


def test_registered_similar_items_miss_few(spark, monkeypatch):
    r = random.Random(2)
    rows = []
    for i in range(60):
        common = r.sample(range(1000 * i, 1000 * i + 1000), 20)
        rows += [(2 * i, u) for u in common] + [(2 * i + 1, u) for u in [*common[:14], *range(10**6 + 10 * i, 10**6 + 10 * i + 6)]]
    monkeypatch.setattr(catalogue, "buyers", lambda *_: spark.createDataFrame(rows, "item long, user long"))
    found = {(x.a, x.b) for x in catalogue.QUERIES["similar_items"](spark, "").collect()}
    exact = {(x.a, x.b) for x in similarity.jaccard(catalogue.buyers(), 0.5).collect()}
    assert len(exact) == 60 and found <= exact and len(found) >= 0.99 * len(exact)


def test_prediction_ladder(spark):
    rows = [(1, 1, 5.0), (2, 1, 1.0), (3, 1, 3.0), (1, 2, 5.0), (2, 2, 1.0), (3, 2, 3.0), (4, 1, 4.0), (5, 3, 2.0)]
    ratings = spark.createDataFrame(rows, "user_id long, item_id long, stars double")
    pairs = recommend.item_pairs(ratings, 3)
    assert [(p.a, p.b, round(p.correlation, 6)) for p in pairs.collect()] == [(1, 2, 1.0)]
    targets = spark.createDataFrame([(4, 2), (5, 2), (9, 2), (5, 9), (9, 9)], "user_id long, item_id long")
    got = {(r.user_id, r.item_id): (round(r.prediction, 9), round(r.confidence, 9)) for r in recommend.predict(targets, ratings, pairs).collect()}
    assert got == {(4, 2): (4.0, 1.0), (5, 2): (2.5, 0.1), (9, 2): (3.0, 0.05), (5, 9): (2.0, 0.05), (9, 9): (3.0, 0.0)}


BRIDGE = [(1, 2), (1, 3), (2, 3), (3, 4), (4, 5), (4, 6), (5, 6)]


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "src long, dst long")


def test_two_triangles(spark):
    e = edges(spark, BRIDGE)
    between = {(r.src, r.dst): r.betweenness for r in graph.betweenness(e).collect()}
    assert between == {(1, 2): 1.0, (1, 3): 4.0, (2, 3): 4.0, (3, 4): 9.0, (4, 5): 4.0, (4, 6): 4.0, (5, 6): 1.0}
    found, best = graph.girvan_newman(e, patience=2)
    assert [r.members for r in graph.communities(found, "component").collect()] == [[1, 2, 3], [4, 5, 6]]
    assert best == pytest.approx(2 * (3 / 7 - (7 / 14) ** 2))
    assert {r.component for r in graph.components(e).collect()} == {1}
    assert {(r.id, r.label) for r in graph.label_propagation(e, 5).collect()}
    assert sinks.betweenness_report(graph.betweenness(e)).orderBy("line").first().value == "('3', '4'), 9.0"


def brute_betweenness(pairs):
    near = {}
    for a, b in pairs:
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)
    total = {p: 0.0 for p in pairs}
    for a, b in itertools.combinations(sorted(near), 2):
        paths, todo, length = [], [(a,)], None
        while todo:
            p = todo.pop(0)
            if length and len(p) > length:
                break
            if p[-1] == b:
                paths.append(p)
                length = len(p)
            else:
                todo += [(*p, x) for x in near[p[-1]] if x not in p]
        for p in paths:
            for x, y in zip(p, p[1:]):
                total[min(x, y), max(x, y)] += 1 / len(paths)
    return total


def brute_girvan_newman(pairs):
    """The partition of the best modularity on the way to no edges, as sorted tuples of members."""
    def parts(now):
        left, out = {v for e in pairs for v in e}, []
        while left:
            own, new = set(), {min(left)}
            while new:
                own |= new
                new = {b for e in now for a, b in (e, e[::-1]) if a in own} - own
            out.append(tuple(sorted(own)))
            left -= own
        return sorted(out)

    m, now, best = len(pairs), list(pairs), None
    while True:
        found = parts(now)
        q = sum(sum(a in c and b in c for a, b in pairs) / m - (sum((a in c) + (b in c) for a, b in pairs) / (2 * m)) ** 2 for c in found)
        if best is None or q > best[0] + 1e-12:
            best = (q, found)
        if not now:
            return best[1]
        score = {k: round(v, 9) for k, v in brute_betweenness(now).items()}
        now = [e for e in now if score[e] < max(score.values())]


def test_registered_girvan_newman(spark, monkeypatch):
    pairs = [(1, 2), (1, 3), (2, 3), (4, 5), (4, 6), (5, 6), (3, 4), (2, 5), (3, 7)]
    monkeypatch.setattr(catalogue, "shared_days", lambda *_: edges(spark, pairs))
    got = {}
    for r in catalogue.QUERIES["girvan_newman"](spark, "").collect():
        got.setdefault(r.component, []).append(r.id)
    want = brute_girvan_newman(pairs)
    assert len(want) > 1 and sorted(tuple(sorted(v)) for v in got.values()) == want


def test_betweenness_on_a_deep_graph(spark):
    r = random.Random(3)
    pairs = sorted({(i, i + 1) for i in range(11)} | {tuple(sorted(r.sample(range(12), 2))) for _ in range(5)})
    got = {(x.src, x.dst): x.betweenness for x in graph.betweenness(edges(spark, pairs)).collect()}
    want = brute_betweenness(pairs)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_no_edges(spark):
    e = edges(spark, [])
    assert graph.betweenness(e).count() == 0 and graph.components(e).count() == 0


def sequential_bloom(rows, size, bits, hashes):
    filled, seen, out = set(), set(), {}
    for seq, key in rows:
        p = [(a * key + b) % bits for a, b in hashes]
        if key not in seen:
            n = out.setdefault(seq // size, [0, 0])
            n[0] += 1
            n[1] += all(x in filled for x in p)
        seen.add(key)
        filled.update(p)
    return {k: tuple(v) for k, v in out.items()}


def test_bloom_is_the_sequential_filter(spark):
    r = random.Random(2)
    rows = [(i, r.randrange(400)) for i in range(1000)]
    hashes = [(3, 1), (7, 5)]
    got = sketches.bloom(spark.createDataFrame(rows, "seq long, key long"), 100, 211, hashes)
    assert {x.batch: (x.n_new, x.n_false) for x in got.collect()} == sequential_bloom(rows, 100, 211, hashes)


def test_reservoir_is_a_sample(spark):
    got = sketches.reservoir(spark.range(500).select(F.col("id").alias("seq"), F.col("id").alias("key")), 100, 10).collect()
    by = {}
    for x in got:
        by.setdefault(x.batch, set()).add(x.seq)
    assert all(len(v) == 10 and max(v) < 100 * (b + 1) for b, v in by.items())
    assert len(sketches.algorithm_r(iter(range(50)), 100)) == 50 and len(set(sketches.algorithm_r(iter(range(500)), 100))) == 100


def test_clusters_count_all_points(spark):
    r = random.Random(4)
    points = [(i, [r.gauss(20 * (i % 3), 1), r.gauss(0, 1)]) for i in range(300)]
    df = spark.createDataFrame(points, "id long, features array<double>")
    states, rounds = clustering.fit(df, 3, rounds=3)
    assert states.count() == 300 and states.select("id").distinct().count() == 300
    last = rounds.orderBy(F.col("round").desc()).first()
    assert last.ds_points + last.cs_points + last.rs_points == 300 and last.ds_points > 250
    summary = clustering.summaries(states.where("state = 'DS'").join(df, "id").select("id", "features", "cluster"))
    assert clustering.sequential(df, summary, 2 * 2**0.5).where("cluster >= 0").count() > 200


def test_models_and_files(spark, tmp_path):
    rows = [(u, i, float(1 + (u + i) % 5)) for u in range(20) for i in range(10)]
    df = spark.createDataFrame(rows, "user_id int, item_id int, stars double")
    x = df.withColumns({"a": F.col("user_id").cast("double"), "b": F.col("item_id").cast("double")})
    model = models.boosted_trees(x, ["a", "b"], trees=3, depth=2)
    readers.save_model(model, str(tmp_path / "m"))
    again = readers.load_model(type(model), str(tmp_path / "m"))
    assert models.clipped_predictions(again, x).where("prediction < 1 or prediction > 5").count() == 0
    sinks.predictions_csv(df, str(tmp_path / "c"))
    assert readers.csv(spark, str(tmp_path / "c")).columns == ["user_id", " business_id", " prediction"]
    (tmp_path / "q.csv").write_text('"a","b"\n"x, y","2"\n')
    assert readers.csv(spark, str(tmp_path / "q.csv")).first()[0] == "x, y"
    (tmp_path / "p.csv").write_text("0,1,0.5,1.5\n1,2,2.5,3.5\n")
    assert readers.points(spark, str(tmp_path / "p.csv"), 2).orderBy("id").first().features == [0.5, 1.5]
    assert readers.drawn(df, "user_id", 3, 10).count() == 30


def shuffled_rows(spark, run):
    """What run() gives, and the rows that its stages shuffled."""
    gateway, store = spark.sparkContext._gateway, spark.sparkContext._jsc.sc().statusStore()

    def stages():
        found = store.stageList(gateway.jvm.java.util.ArrayList(), False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
        return {(found.apply(i).stageId(), found.apply(i).attemptId()): found.apply(i).shuffleWriteRecords() for i in range(found.size())}

    before = stages()
    out = run()
    return out, sum(n for k, n in stages().items() if k not in before)


GRAPHS = ["corating_edges", "connected_components", "label_propagation_5", "modularity", "edge_betweenness", "girvan_newman"]


@pytest.mark.parametrize("name", GRAPHS)
def test_users_of_few_days_make_no_pairs(spark, monkeypatch, name):
    few, many = [(u, 0) for u in range(10, 1010)], [(u, d) for u in range(4) for d in range(30) if d != u // 2]
    rows = spark.createDataFrame(few + many, "user_id long, n int").selectExpr("user_id", "date_add(date'2024-01-01', n) AS day")
    monkeypatch.setattr(catalogue, "active_days", lambda *_: rows)
    got, shuffled = shuffled_rows(spark, lambda: sorted(map(tuple, catalogue.QUERIES[name](spark, "").collect())))
    assert shuffled < 20_000  # all pairs are some 500,000
    if name == "corating_edges":
        assert got == [(0, 1), (2, 3)]
    if name == "connected_components":
        assert got == [(0, 0), (1, 0), (2, 2), (3, 2)]


@pytest.mark.parametrize(("least", "most"), [(1, 4), (3, 6), (5, 6), (2, 40)])
def test_corating_is_as_by_brute_force(spark, least, most):
    r = random.Random(least)
    sets = {u: set(r.sample(range(most + 3), r.randint(1, most))) for u in range(60)}
    df = spark.createDataFrame([(u, i) for u, s in sets.items() for i in s] * 2 + [(1, None)], "u long, i long")
    got = sorted((x.src, x.dst) for x in graph.corating(df, "u", "i", least).collect())
    assert got == [(a, b) for a, b in itertools.combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= least]


@pytest.mark.parametrize("compat", [False, True])
def test_betweenness_of_dense_sparse_and_joined_search(spark, monkeypatch, compat):
    r = random.Random(4)
    pairs = sorted({tuple(sorted(r.sample(range(14), 2))) for _ in range(30)} | {(20, 21), (21, 22)})
    near = [np.array(sorted(b if a == v else a for a, b in pairs if v in (a, b)), int) for v in range(23)]
    found = [sorted((int(a), int(b), round(x, 9)) for a, b, x in zip(*f(near, np.arange(23), compat)) if x) for f in (graph.dense_flows, graph.sparse_flows)]
    assert found[0] == found[1]
    want = {}
    for a, b, x in found[0]:
        want[min(a, b), max(a, b)] = want.get((min(a, b), max(a, b)), 0) + x / 2
    got = {(x.src, x.dst): x.betweenness for x in graph.betweenness(edges(spark, pairs), compat).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    if not compat:
        brute = brute_betweenness(pairs)
        assert all(got[k] == pytest.approx(brute[k]) for k in brute)


def twin_graph(seed):
    """Edges between vertices that stand for 1 to 4 twins each, joined with each other or not, without any order of ids."""
    r = random.Random(seed)
    ids = r.sample(range(100), 40)
    of = [[ids.pop() for _ in range(r.randint(1, 4))] for _ in range(9)]
    pairs = {(a, b) for i, j in itertools.combinations(range(9), 2) if r.random() < 0.35 for a in of[i] for b in of[j]}
    pairs |= {p for x in of if r.random() < 0.5 for p in itertools.combinations(x, 2)}
    return sorted({(min(p), max(p)) for p in pairs})


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("compat", [False, True])
def test_searches_over_twins_are_those_of_vertices(seed, compat):
    pairs = twin_graph(seed)
    ids = sorted({v for p in pairs for v in p})
    near = {v: {b if a == v else a for a, b in pairs if v in (a, b)} for v in ids}
    want = {}
    for i, j, x in zip(*graph.sparse_flows([np.array([ids.index(b) for b in sorted(near[v])]) for v in ids], np.arange(len(ids)), compat)):
        want[ids[i], ids[j]] = x
    group = {v: min(w for w in ids if near[v] - {v, w} == near[w] - {v, w}) for v in ids}
    names = sorted(set(group.values()))
    size = np.array([sum(g == c for g in group.values()) for c in names], float)
    arcs = [np.array(sorted({names.index(group[w]) for v in ids if group[v] == c for w in near[v]}), int) for c in names]
    assert len(names) < len(ids)
    for search in (graph.sparse_flows, graph.dense_flows):
        flow = {(names[i], names[j]): x for i, j, x in zip(*search(arcs, np.arange(len(names)), compat, size))}
        for (a, b), x in want.items():
            assert flow[group[a], group[b]] + flow[group[b], group[a]] == pytest.approx((x + want[b, a]) * (2 if group[a] == group[b] else 1))


def brute_girvan_newman(pairs, patience, compat):
    """Vertex by vertex: the components of the best round, and its modularity."""
    ids, now, best, kept, waited, last = sorted({v for p in pairs for v in p}), set(pairs), None, None, 0, -1.0
    while True:
        near = {v: sorted({b if a == v else a for a, b in now if v in (a, b)}) for v in ids}
        of = {v: v for v in ids}
        while any(of[b] < of[a] for a in ids for b in near[a]):
            of = {a: min(of[b] for b in [a, *near[a]]) for a in ids}
        graph_ = now if compat else set(pairs)
        k = {v: sum(v in p for p in graph_) for v in ids}
        m = len(pairs)
        score = sum(2 * sum(of[a] == of[b] == c for a, b in graph_) - (sum(k[v] for v in ids if of[v] == c) ** 2 - compat * sum(k[v] ** 2 for v in ids if of[v] == c)) / (2 * m) for c in set(of.values())) / (2 * m)
        waited = 0 if score > last + 1e-12 else waited + 1
        if best is None or score > best + 1e-12:
            best, kept = score, of
        last = score
        if waited >= patience or not now:
            return kept, best
        flow = {}
        for i, j, x in zip(*graph.sparse_flows([np.array([ids.index(b) for b in near[v]], int) for v in ids], np.arange(len(ids)), compat)):
            flow[min(i, j), max(i, j)] = flow.get((min(i, j), max(i, j)), 0.0) + x / 2
        most = max(round(x, 9) for x in flow.values())
        now = {(a, b) for a, b in now if round(flow[ids.index(a), ids.index(b)], 9) != most}


@pytest.mark.parametrize(("seed", "compat"), [(0, False), (3, True)])
def test_communities_of_twins_are_those_of_vertices(spark, seed, compat):
    """Rounds go on until twins have lost all their edges."""
    pairs = twin_graph(seed)
    e = edges(spark, pairs)
    want, best = brute_girvan_newman(pairs, 100, compat)
    found, score = graph.girvan_newman(e, 100, compat)
    assert {x.id: x.component for x in found.collect()} == want and score == pytest.approx(best)
    stars = [(a, b) for a in range(3) for b in range(3, 9)]  # all edges tie, so one cut leaves twins alone
    found, score = graph.girvan_newman(edges(spark, stars), 100, compat)
    want, best = brute_girvan_newman(stars, 100, compat)
    assert {x.id: x.component for x in found.collect()} == want and score == pytest.approx(best)


def test_girvan_newman_moves_no_edges(spark):
    pairs = [(a, b) for a, b in itertools.combinations(range(300), 2) if a % 3 == b % 3 or 0 in (a % 3, b % 3)]
    met = graph.checkpoint(edges(spark, pairs))
    (found, _), shuffled = shuffled_rows(spark, lambda: graph.girvan_newman(met, 1))
    assert shuffled < 10_000 and found.count() == 300  # edges are 34,850


def test_edge_betweenness_moves_no_edges(spark, monkeypatch):
    """300 users of three sets of days: 44,850 edges, none of which is shuffled."""
    rows = spark.createDataFrame([(u, d) for u in range(300) for d in range(30) if d != u % 3], "user_id long, n int").selectExpr("user_id", "date_add(date'2024-01-01', n) AS day")
    met = graph.checkpoint(graph.corating(rows, "user_id", "day", 28))
    monkeypatch.setattr(catalogue, "shared_days", lambda *_: met)
    got, shuffled = shuffled_rows(spark, lambda: catalogue.QUERIES["edge_betweenness"](spark, "").collect())
    assert {x.betweenness for x in got} == {1.0} and len(got) == 44_850 and shuffled < 10_000
    assert len(graph.twins(met)[0].select("class").distinct().collect()) == 1


def test_betweenness_takes_no_job_for_each_level(spark):
    context = spark.sparkContext
    context.setJobGroup("deep", "deep")
    got = {(x.src, x.dst): x.betweenness for x in graph.betweenness(edges(spark, [(i, i + 1) for i in range(20)])).collect()}
    jobs = len(context.statusTracker().getJobIdsForGroup("deep"))
    context.setLocalProperty("spark.jobGroup.id", None)
    assert got == {(i, i + 1): (i + 1.0) * (20 - i) for i in range(20)} and jobs < 20


def test_two_phase_counts_sets_of_few_items_without_long_joins(spark):
    r = random.Random(5)
    rows = [(b, i) for b in range(400) for i in r.sample("abcdefghij", r.randint(1, 6))]
    df = spark.createDataFrame(rows + rows[:9] + [(1, None)], "basket long, item string")
    got, shuffled = shuffled_rows(spark, lambda: {tuple(x["items"]): x.freq for x in itemsets.two_phase(df, 12).collect()})
    held = {}
    for b, i in set(rows):
        held.setdefault(b, []).append(i)
    count = {}
    for s in held.values():
        for k in range(1, 7):
            for c in itertools.combinations(sorted(s), k):
                count[c] = count.get(c, 0) + 1
    assert got == {c: n for c, n in count.items() if n >= 12} and max(map(len, got)) > 3
    assert shuffled < 15_000  # joins of rows with candidates shuffled 34,264
    local = {tuple(x["items"]) for x in itemsets.candidates_by_partition(df, 12, most=3).collect()}
    assert {c for c in got if len(c) <= 3} <= local and max(map(len, local)) == 3
    assert itemsets.two_phase(df.limit(0), 12).count() == 0 and itemsets.candidates_by_partition(df.limit(0), 12).count() == 0


def brute_neighbours(rows, least, n):
    """(user, item, other, correlation, stars, rank) of all rated pairs, by their definition."""
    users, items = {}, {}
    for u, i, x in rows:
        users.setdefault(u, {})[i] = items.setdefault(i, {})[u] = x
    alike = {}
    for a, b in itertools.permutations(items, 2):
        both = sorted(items[a].keys() & items[b].keys())
        x, y = np.array([items[a][u] for u in both]), np.array([items[b][u] for u in both])
        if len(both) >= least and x.var() > 1e-9 and y.var() > 1e-9:
            alike[a, b] = float(np.corrcoef(x, y)[0, 1])
    out = []
    for u, i, _ in rows:
        best = sorted((-round(alike[i, o], 9), o) for o in users[u] if alike.get((i, o), 0) > 1e-9)[:n]
        out += [(u, i, o, round(-c, 6), users[u][o], k + 1) for k, (c, o) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("name", ["topn_neighbours", "cf_predict", "cf_feature"])
def test_users_of_many_items_make_no_rows_of_pairs(spark, monkeypatch, name):
    r = random.Random(6)
    rows = [(u, i, float(r.randint(1, 5))) for u in range(6) for i in sorted(r.sample(range(260), 250))] + [(u, i, float(r.randint(1, 5))) for u in range(6, 40) for i in r.sample(range(12), 5)]
    monkeypatch.setattr(catalogue, "ratings", lambda *_: spark.createDataFrame(rows, "user_id long, item_id long, stars double"))
    monkeypatch.setattr(catalogue, "rating_features", lambda *_: (spark.createDataFrame([(1, 2.0)], "user_id long, orders double"), spark.createDataFrame([(1, 3.0)], "item_id long, acctbal double")))
    got, shuffled = shuffled_rows(spark, lambda: catalogue.QUERIES[name](spark, "").collect())
    assert shuffled < 120_000  # a user's pairs of items are some 60,000, and as many again for neighbours
    n = {"topn_neighbours": 3}.get(name, 8)
    want = brute_neighbours(rows, 3, n)
    if name == "topn_neighbours":
        # whole digits, as ties in the ninth may fall either way
        assert sorted((x.user_id, x.item_id, x["rank"], round(x.correlation, 5)) for x in got) == sorted((u, i, k, round(c, 5)) for u, i, _, c, _, k in want)
    else:
        cf = {(x.user_id, x.item_id): x["prediction" if name == "cf_predict" else "cf"] for x in got}
        near = {}
        for u, i, _, c, s, _ in want:
            near.setdefault((u, i), []).append((c, s))
        assert len(cf) == len(rows) + 2
        assert all(cf[k] == pytest.approx(sum(c * s for c, s in v) / sum(c for c, _ in v), abs=2e-4) for k, v in near.items())


def test_neighbours_of_named_items_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(recommend, "BLOCK", 30)
    r = random.Random(7)
    rows = [(u, i, float(r.randint(1, 5))) for u in range(30) for i in r.sample(range(15), 8)]
    df = spark.createDataFrame([(f"u{u:02}", f"i{i:02}", x) for u, i, x in rows] + [("u00", None, 1.0), (None, "i00", 1.0)], "user_id string, item_id string, stars double")
    pairs = recommend.item_pairs(df, 3)
    targets = df.select("user_id", "item_id").unionByName(spark.createDataFrame([("u00", "new"), ("new", "i00")], "user_id string, item_id string"))
    got = sorted((int(x.user_id[1:]), int(x.item_id[1:]), int(x.other[1:]), round(x.correlation, 6), x.stars, x["rank"]) for x in recommend.neighbours(targets, df, pairs, 4).collect())
    assert got == brute_neighbours(rows, 3, 4) and recommend.blocks(df)[2] > 5
    assert recommend.item_pairs(df.limit(0)).count() == 0 and recommend.neighbours(targets.limit(0), df, pairs).count() == 0


@pytest.mark.parametrize("name", ["topn_neighbours", "cf_predict", "cf_feature"])
def test_lists_and_similarities_are_no_rows(spark, monkeypatch, name):
    """Neither a user's list for each block nor the similarities of items are shuffled."""
    monkeypatch.setattr(recommend, "BLOCK", 500)
    r = random.Random(8)
    rows = [(u, i, float(r.randint(1, 5))) for u in range(200) for i in r.sample(range(150), 30)]
    monkeypatch.setattr(catalogue, "ratings", lambda *_: spark.createDataFrame(rows, "user_id long, item_id long, stars double"))
    monkeypatch.setattr(catalogue, "rating_features", lambda *_: (spark.createDataFrame([(1, 2.0)], "user_id long, orders double"), spark.createDataFrame([(1, 3.0)], "item_id long, acctbal double")))
    got, shuffled = shuffled_rows(spark, lambda: catalogue.QUERIES[name](spark, "").collect())
    assert len(got) > len(rows) and shuffled < 16_000  # ratings and targets once are 12,000


@pytest.mark.parametrize("block", [20, 100_000])
def test_similarities_made_on_the_way_are_those_of_pairs(spark, monkeypatch, block):
    """With rows without a user, an item or stars, repeated ratings and targets, and unknown users and items."""
    monkeypatch.setattr(recommend, "BLOCK", block)
    r = random.Random(9)
    rows = [(f"u{u}", i, float(r.randint(1, 5)) + 0.25 * r.randint(0, 1)) for u in range(25) for i in r.sample(range(12), 7)]
    rows += [*rows[:9], (None, 3, 1.0), (None, None, 1.0), ("u1", None, 5.0), ("u2", 4, None), ("alone", None, 4.0), ("nan", 77, float("nan")), (None, 99, 2.0), ("one", 50, 3.0)]
    df = spark.createDataFrame(rows, "user_id string, item_id int, stars double")
    asked = [(u, i) for u, i, _ in rows] + [("new", 3), ("u1", 999), ("u1", 99), ("new", 999), ("alone", 3), (None, 999), ("nan", 77), ("one", 3), ("u3", None)]
    targets, pairs = spark.createDataFrame(asked, "user_id string, item_id int"), recommend.item_pairs(df, 2)
    of = lambda found: sorted(repr([round(x, 9) if isinstance(x, float) else x for x in row]) for row in found.collect())
    got = recommend.predict(targets, df, 2, 4, power=2)
    assert of(got) == of(recommend.predict(targets, df, pairs, 4, power=2)) and got.count() == len(asked)
    near = recommend.neighbours(targets, df, 2, 4)
    assert of(near) == of(recommend.neighbours(targets, df, pairs, 4)) and near.count() > 500
    assert recommend.predict(targets, df.limit(0), 2).count() == len(asked) and recommend.predict(targets.limit(0), df, 2).count() == recommend.neighbours(targets.limit(0), df, 2).count() == 0


def test_grid_search_makes_its_rows_once(spark):
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            made.add(len(b))
            yield b

    rows = spark.createDataFrame([(float(i % 7), float(i % 3), float(i % 5)) for i in range(200)], "x double, y double, stars double").mapInPandas(count, "x double, y double, stars double")
    _, grid = models.grid_search(rows, ["x", "y"], depths=(1, 2), rates=(0.1,), trees=1, folds=2)
    assert grid.count() == 2 and made.value == 200


def test_content_boost_makes_rows_of_chosen_pairs_alone(spark):
    users, items = [f"u{i}" for i in range(120)], [f"i{i}" for i in range(95)] + ["x" * 60, "é"]
    rated = [(u, i, 4.0) for u in users[:60] for i in items[:20]] + [("u1", None, 1.0)]
    tables = [spark.createDataFrame(rows, schema) for rows, schema in ((rated, "user_id string, item_id string, stars double"), ([(u,) for u in users], "user_id string"), ([(i,) for i in items], "item_id string"))]
    boosted = models.content_boosted(*tables, 50, 3, lambda df: df.withColumn("prediction", F.lit(2.5)))
    got = sorted((x.user_id, x.item_id) for x in boosted.where("stars = 2.5").collect())
    part = lambda seed, key: int(hashlib.md5(f"{seed}-{key}".encode()).hexdigest()[:7], 16) % 100
    assert got == sorted((u, i) for u in users if part(3, u) < 50 for i in items if part(4, f"{u}-{i}") < 50 and (u, i, 4.0) not in rated)
    # the pairs are not joined with the ratings
    assert len(got) > 2000 and "LeftAnti" not in boosted._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("found", [lambda e: graph.components(e), lambda e: graph.label_propagation(e, 1), lambda e: graph.girvan_newman(e, patience=1)[0]])
def test_graphs_make_dear_edges_once_and_compare_users_in_many_tasks(spark, found):
    met = graph.corating(spark.createDataFrame([(u, d) for u in range(60) for d in range(30)], "u long, i long"), "u", "i", 29)
    assert met.count() == 60 * 59 // 2 and met.rdd.getNumPartitions() >= graph.PARTS
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            made.add(len(b))
            yield b

    edges_ = spark.createDataFrame([(1, 2), (2, 3), (1, 3), (3, 4)], "src long, dst long").mapInPandas(count, "src long, dst long")
    assert found(edges_).count() == 4 and made.value == 4


def test_corating_of_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(graph, "BLOCK", 7)
    monkeypatch.setattr(graph, "WIDE", 4)
    r = random.Random(5)
    sets = {f"u{u:02}": r.sample(range(12), r.randint(8, 12)) for u in range(40)}
    got = [tuple(x) for x in graph.corating(spark.createDataFrame([(u, i) for u, s in sets.items() for i in s], "u string, i long"), "u", "i", 8).collect()]
    assert sorted(got) == sorted((a, b) for a in sets for b in sets if a < b and len(set(sets[a]) & set(sets[b])) >= 8)
