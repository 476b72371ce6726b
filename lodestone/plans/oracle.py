"""SQL for the catalogue's queries, for an engine of its own over the same tables."""

from __future__ import annotations

from lodestone.operators.similarity import PRIME, coefficients
from lodestone.streaming.sketches import BITS, BLOOM, COUNTERS

REVIEWS = """reviews AS (SELECT o_custkey AS user_id, l_partkey AS item_id, l_suppkey AS supplier, least(5.0, ceil(l_quantity / 10)) AS stars, strftime(o_orderdate, '%Y-%m-%d') AS day
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
RATINGS = """ratings AS (SELECT o_custkey AS user_id, l_suppkey AS item_id, avg(CAST(least(5.0, ceil(l_quantity / 10)) AS DOUBLE)) AS stars FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)"""
BASKETS = """baskets AS (SELECT DISTINCT l_orderkey AS basket, p_brand AS item FROM lineitem JOIN part ON l_partkey = p_partkey)"""
EVENTS = """seqs AS (SELECT event_id AS seq, user_id AS key FROM events)"""


def percent(seed: int, key: str) -> str:
    return f"(CAST('0x' || substr(md5('{seed}-' || CAST({key} AS VARCHAR)), 1, 7) AS BIGINT) % 100)"


SAMPLED = "sampled AS (SELECT user_id, item_id FROM ratings UNION SELECT user_id, item_id + 1 FROM ratings)"
TARGETS = "targets AS (SELECT user_id, item_id FROM ratings UNION ALL VALUES (-1, 1), (-1, -1))"
MEANS = "users AS (SELECT user_id, avg(stars) AS user_mean FROM ratings GROUP BY 1), items AS (SELECT item_id, avg(stars) AS item_mean FROM ratings GROUP BY 1)"
PAIRS = """sums AS (SELECT x.item_id AS a, y.item_id AS b, count(*) AS n, sum(x.stars) AS sx, sum(y.stars) AS sy, sum(x.stars * y.stars) AS sxy, sum(x.stars * x.stars) AS sxx, sum(y.stars * y.stars) AS syy
        FROM ratings x JOIN ratings y ON x.user_id = y.user_id AND x.item_id < y.item_id GROUP BY 1, 2 HAVING count(*) >= 3),
    pairs AS (SELECT a, b, n, CASE WHEN sxx - sx * sx / n <= 1e-9 OR syy - sy * sy / n <= 1e-9 THEN 0.0 ELSE (sxy - sx * sy / n) / (sqrt(sxx - sx * sx / n) * sqrt(syy - sy * sy / n)) END AS correlation FROM sums)"""
NEAR = """alike AS (SELECT a AS item_id, b AS other, correlation FROM pairs WHERE correlation > 0 UNION ALL SELECT b, a, correlation FROM pairs WHERE correlation > 0),
    near AS (SELECT t.user_id, t.item_id, s.other, s.correlation, r.stars, row_number() OVER (PARTITION BY t.user_id, t.item_id ORDER BY round(s.correlation, 9) DESC, s.other) AS rank
        FROM targets t JOIN ratings r ON t.user_id = r.user_id JOIN alike s ON s.item_id = t.item_id AND s.other = r.item_id)"""
PREDICTED = """scored AS (SELECT user_id, item_id, sum(abs(correlation) * stars) / sum(abs(correlation)) AS weighted, min(correlation) AS last FROM near WHERE rank <= 8 GROUP BY 1, 2),
    predicted AS (SELECT user_id, item_id, least(greatest(coalesce(weighted, (user_mean + item_mean) / 2, user_mean, item_mean, 3.0), 1.0), 5.0) AS prediction,
        coalesce(last, CASE WHEN user_mean IS NOT NULL AND item_mean IS NOT NULL THEN 0.1 WHEN user_mean IS NOT NULL OR item_mean IS NOT NULL THEN 0.05 ELSE 0.0 END) AS confidence
        FROM targets LEFT JOIN scored USING (user_id, item_id) LEFT JOIN users USING (user_id) LEFT JOIN items USING (item_id))"""
FEATURES = """custs AS (SELECT c_custkey AS user_id, c_acctbal AS u_acctbal, CAST(o AS DOUBLE) AS u_orders, p AS u_price FROM customer JOIN (SELECT o_custkey, count(*) AS o, avg(o_totalprice) AS p FROM orders GROUP BY 1) ON c_custkey = o_custkey),
    sups AS (SELECT s_suppkey AS item_id, s_acctbal AS i_acctbal FROM supplier),
    means AS (SELECT (SELECT avg(u_acctbal) FROM custs) AS ma, (SELECT avg(u_orders) FROM custs) AS mo, (SELECT avg(u_price) FROM custs) AS mp, (SELECT avg(i_acctbal) FROM sups) AS mi)"""
DAYS = "days AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events), edges AS (SELECT x.user_id AS src, y.user_id AS dst FROM days x JOIN days y ON x.day = y.day AND x.user_id < y.user_id GROUP BY 1, 2 HAVING count(*) >= 29)"
BOTH = DAYS + ", arcs AS (SELECT src, dst FROM edges UNION ALL SELECT dst, src FROM edges)"
REACH = BOTH + ", reach(id, root) AS (SELECT src, src FROM arcs UNION SELECT a.dst, r.root FROM reach r JOIN arcs a ON r.id = a.src), comp AS (SELECT id, min(root) AS component FROM reach GROUP BY 1)"


def with_(*parts: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' * recursive}{', '.join(parts)} "


def steady(x: str, digits: int = 6) -> str:
    """Rounded twice, so that a last bit does not decide a tie."""
    return f"round(round(CAST({x} AS DOUBLE), 9), {digits})"


def number(x: str) -> str:
    """An id as a number: the first 52 bits of its hash."""
    return f"CAST(CAST('0x' || substr(md5(CAST({x} AS VARCHAR)), 1, 13) AS BIGINT) AS DOUBLE)"


def least_hashes(n: int) -> str:
    return ", ".join(f"min(({a} * user_id + {b}) % {PRIME}) AS h{i}" for i, (a, b) in enumerate(coefficients(n)))


SIGNED = f"signed AS (SELECT item_id AS item, {least_hashes(60)} FROM ratings GROUP BY 1)"
CANDIDATES = "cand AS (" + " UNION ".join(f"SELECT x.item AS a, y.item AS b FROM signed x JOIN signed y ON x.h{2 * k} = y.h{2 * k} AND x.h{2 * k + 1} = y.h{2 * k + 1} AND x.item < y.item" for k in range(30)) + ")"
JACCARD = """size AS (SELECT item_id, count(*) AS n FROM ratings GROUP BY 1),
    common AS (SELECT x.item_id AS a, y.item_id AS b, count(*) AS c FROM ratings x JOIN ratings y ON x.user_id = y.user_id AND x.item_id < y.item_id GROUP BY 1, 2),
    jac AS (SELECT a, b, c / CAST(p.n + q.n - c AS DOUBLE) AS similarity FROM common JOIN size p ON p.item_id = a JOIN size q ON q.item_id = b)"""


def itemset(k: int, support: int) -> str:
    names = [f"b{i}.item" for i in range(k)]
    joins = " ".join(f"JOIN baskets b{i} ON b{i}.basket = b0.basket AND b{i}.item > b{i - 1}.item" for i in range(1, k))
    joined = " || ',' || ".join(names)
    return f"SELECT {joined} AS items, count(*) AS freq FROM baskets b0 {joins} GROUP BY 1 HAVING count(*) >= {support}"


def zeros(h: str) -> str:
    """Trailing zeros of a number below 1024, by the powers of two that divide it; 1 for 0."""
    return f"CASE WHEN {h} = 0 THEN 1 ELSE " + " + ".join(f"CASE WHEN {h} % {2**i} = 0 THEN 1 ELSE 0 END" for i in range(1, 10)) + " END"


def fm() -> str:
    cols = ", ".join(f"pow(2.0, max({zeros(f'(({a} * key + {b}) % 1024)')})) AS w{i}" for i, (a, b) in enumerate(COUNTERS[:12]))
    mean = lambda g: "(" + " + ".join(f"w{i}" for i in range(4 * g, 4 * g + 4)) + ") / 4"
    return with_(EVENTS, f"z AS (SELECT seq // 1000 AS batch, count(DISTINCT key) AS actual, {cols} FROM seqs GROUP BY 1)", f"m AS (SELECT batch, actual, {mean(0)} AS m0, {mean(1)} AS m1, {mean(2)} AS m2 FROM z)",
                 "est AS (SELECT batch, actual, CAST(round_even((m0 + m1 + m2 - least(m0, m1, m2)) / 2, 0) AS BIGINT) AS estimate FROM m)")


def bloom() -> str:
    """Each hash's bit is set by the first row that has it; a new key seems known if all of its bits were set by rows before it."""
    each = " UNION ALL ".join(f"SELECT seq, key, ({a} * key + {b}) % {BITS} AS pos FROM seqs" for a, b in BLOOM)
    return with_(EVENTS, f"p AS ({each})", "f AS (SELECT pos, min(seq) AS first FROM p GROUP BY 1)", "fresh AS (SELECT key, min(seq) AS seq FROM seqs GROUP BY 1)",
                 "j AS (SELECT p.seq, p.key, max(first) AS latest FROM p JOIN f USING (pos) JOIN fresh ON fresh.key = p.key AND fresh.seq = p.seq GROUP BY 1, 2)") + f"""
        SELECT seq // 1000 AS batch, count(*) AS n_new, CAST(sum(CASE WHEN latest < seq THEN 1 ELSE 0 END) AS BIGINT) AS n_false, round(sum(CASE WHEN latest < seq THEN 1 ELSE 0 END) / CAST(count(*) AS DOUBLE), 6) AS fpr,
            round(sum(CASE WHEN latest < seq THEN 1 ELSE 0 END) / ({len(BLOOM)}.0 * count(*)), 6) AS reported_fpr FROM j GROUP BY 1"""  # fmt: skip


def propagation(rounds: int) -> str:
    parts = [BOTH, "l0 AS (SELECT DISTINCT src AS id, src AS label FROM arcs)"]
    for k in range(1, rounds + 1):
        parts.append(f"c{k} AS (SELECT dst AS id, label, count(*) AS n FROM arcs JOIN l{k - 1} ON id = src GROUP BY 1, 2)")
        parts.append(f"l{k} AS (SELECT id, label FROM (SELECT id, label, row_number() OVER (PARTITION BY id ORDER BY n DESC, label) AS r FROM c{k}) WHERE r = 1)")
    return with_(*parts) + f"SELECT id, label FROM l{rounds}"


DIMS = range(64)
LABEL_STATS = "stats AS (SELECT label AS cluster, count(*) AS n, " + ", ".join(f"avg(CAST(embedding[{i + 1}] AS DOUBLE)) AS m{i}, sqrt(greatest(sum(pow(CAST(embedding[{i + 1}] AS DOUBLE), 2)) / count(*) - pow(sum(CAST(embedding[{i + 1}] AS DOUBLE)) / count(*), 2), 0)) AS s{i}" for i in DIMS) + " FROM embeddings GROUP BY 1)"


def between(a: str, b: str, s: str) -> str:
    return "sqrt(" + " + ".join(f"pow(({a.format(i=i)} - {b.format(i=i)}) / greatest({s.format(i=i)}, 1e-9), 2)" for i in DIMS) + ")"


SQL: dict[str, str] = {
    "nation_avg_rating": with_(REVIEWS) + "SELECT n_name, round(avg(stars), 6) AS avg_stars FROM reviews JOIN customer ON user_id = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1",
    "topk_users": with_(REVIEWS) + "SELECT user_id, count(*) AS n FROM reviews GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
    "topk_items": with_(REVIEWS) + "SELECT item_id, count(*) AS n FROM reviews GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
    "review_counts": with_(REVIEWS) + "SELECT count(*) AS n_review, count(*) FILTER (substr(day, 1, 4) = '1995') AS n_review_1995, count(DISTINCT user_id) AS n_user, count(DISTINCT item_id) AS n_item FROM reviews",
    "year_filter_count": with_(REVIEWS) + "SELECT count(*) AS n FROM reviews WHERE substr(day, 1, 4) = '1996'",
    "distinct_counts": with_(REVIEWS) + "SELECT count(DISTINCT user_id) AS users, count(DISTINCT item_id) AS items, count(DISTINCT supplier) AS suppliers, (SELECT count(*) FROM (SELECT DISTINCT user_id, item_id FROM reviews)) AS pairs FROM reviews",
    "lookup_join_impute": "SELECT doc_id, source, round(coalesce(CAST(quality AS DOUBLE), (SELECT avg(quality) FROM labels)), 6) AS quality, round(coalesce(CAST(toxic AS DOUBLE), (SELECT avg(toxic) FROM labels)), 6) AS toxic FROM documents LEFT JOIN labels USING (doc_id)",
    "semi_known": with_(RATINGS) + "SELECT user_id, count(*) AS n, round(avg(stars), 6) AS mean FROM ratings WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') GROUP BY 1",
    "anti_unrated": with_(RATINGS, SAMPLED) + "SELECT user_id, item_id FROM sampled s WHERE NOT EXISTS (SELECT 1 FROM ratings r WHERE r.user_id = s.user_id AND r.item_id = s.item_id)",
    "union_pseudo": with_(RATINGS, SAMPLED) + "SELECT item_id, count(*) AS n, round(avg(stars), 6) AS mean FROM (SELECT item_id, stars FROM ratings UNION ALL SELECT item_id, 3.0 FROM sampled s WHERE NOT EXISTS (SELECT 1 FROM ratings r WHERE r.user_id = s.user_id AND r.item_id = s.item_id)) GROUP BY 1",
    "self_join_corated": with_(RATINGS) + "SELECT x.item_id AS a, y.item_id AS b, count(*) AS n FROM ratings x JOIN ratings y ON x.user_id = y.user_id AND x.item_id < y.item_id GROUP BY 1, 2 HAVING count(*) >= 3",
    "json_map_sum": "SELECT event_type, CAST(sum(list_sum(map_values(CAST(CAST(props AS JSON) AS MAP(VARCHAR, BIGINT))))) AS BIGINT) AS total, count(*) AS n FROM events GROUP BY 1",
    "split_array_len": "SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN 0 ELSE len(string_split(p_type, ' ')) END AS n, CASE WHEN p_partkey % 5 = 0 THEN 0 ELSE len(string_split(p_type, ' ')) END AS m FROM part",
    "days_since": "SELECT o_custkey, date_diff('day', CAST(min(o_orderdate) AS DATE), DATE '2000-01-01') AS days FROM orders GROUP BY 1",
    "string_keys": "SELECT o_orderkey, CAST(month(o_orderdate) AS VARCHAR) || '/' || CAST(day(o_orderdate) AS VARCHAR) || '/' || right(CAST(year(o_orderdate) AS VARCHAR), 2) || '-' || CAST(o_custkey AS VARCHAR) AS basket, ltrim(CAST(o_orderkey AS VARCHAR), '0') AS product, "
    "list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(range(1, length(CAST(o_orderkey AS VARCHAR)) + 1), lambda i: CAST(ascii(substr(CAST(o_orderkey AS VARCHAR), i, 1)) AS BIGINT))), lambda h, c: (h * 256 + c) % 69997) AS h FROM orders",
    "encode_ids": "SELECT dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS segment, c_mktsegment, count(*) AS n FROM customer GROUP BY c_mktsegment",
    "number_rows": "SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS number FROM customer",
    "seeded_sample": "SELECT c_custkey, c_name FROM customer ORDER BY md5('7-' || CAST(c_custkey AS VARCHAR)), c_custkey LIMIT 50",
    "five_loads": "WITH o AS (SELECT vec_id, row_number() OVER (ORDER BY md5('1-' || CAST(vec_id AS VARCHAR)), vec_id) - 1 AS i, count(*) OVER () AS n FROM embeddings) SELECT CAST(least(i // CAST(round_even(n * 0.2, 0) AS BIGINT), 4) AS INTEGER) AS load, count(*) AS n, CAST(sum(vec_id) AS BIGINT) AS s FROM o GROUP BY 1",
    "dearest_parts": "SELECT p_partkey, p_retailprice FROM part WHERE round(p_retailprice, 9) = (SELECT max(round(p_retailprice, 9)) FROM part)",
    "basket_build": with_(BASKETS) + "SELECT basket, string_agg(item, ',' ORDER BY item) AS items, count(*) AS n FROM baskets GROUP BY 1 HAVING count(*) > 2",
    "frequent_items": with_(BASKETS) + itemset(1, 20),
    "frequent_pairs": with_(BASKETS) + itemset(2, 20),
    "frequent_triples": with_(BASKETS) + itemset(3, 20),
    "frequent_itemsets_fpgrowth": with_(BASKETS) + " UNION ALL ".join(itemset(k, 20) for k in range(1, 8)),  # an order has seven lines at most
    "two_phase_itemsets": with_(BASKETS) + " UNION ALL ".join(itemset(k, 20) for k in range(1, 8)),
    "two_phase_pairs": with_(BASKETS) + " UNION ALL ".join(itemset(k, 20) for k in (1, 2)),
    "pcy_pairs": with_(BASKETS) + itemset(2, 20),
    "son_pcy_buckets": with_(BASKETS, "nums AS (SELECT basket, CAST(regexp_replace(item, '[^0-9]', '', 'g') AS BIGINT) AS x FROM baskets)") + "SELECT (a.x + b.x + a.x * b.x) % 500 AS bucket, count(*) AS n FROM nums a JOIN nums b ON a.basket = b.basket AND a.x < b.x GROUP BY 1",
    "minhash_signatures": with_(RATINGS, SIGNED) + "SELECT * FROM signed",
    "lsh_candidates": with_(RATINGS, SIGNED, CANDIDATES) + "SELECT a, b FROM cand",
    "jaccard_exact": with_(RATINGS, JACCARD) + "SELECT a, b, round(similarity, 6) AS similarity FROM jac WHERE similarity >= 0.1",
    "lsh_verified": with_(RATINGS, SIGNED, CANDIDATES, JACCARD) + "SELECT a, b, round(similarity, 6) AS similarity FROM jac JOIN cand USING (a, b) WHERE similarity >= 0.1",
    "user_item_avgs": with_(RATINGS, MEANS) + "SELECT 'user' AS side, user_id AS id, round(user_mean, 6) AS mean FROM users UNION ALL SELECT 'item', item_id, round(item_mean, 6) FROM items",
    "pearson_pairs": with_(RATINGS, PAIRS) + "SELECT a, b, n, round(correlation, 6) AS correlation FROM pairs",
    "topn_neighbours": with_(RATINGS, TARGETS, PAIRS, NEAR) + "SELECT user_id, item_id, CAST(rank AS INTEGER) AS rank, round(correlation, 6) AS correlation FROM near WHERE rank <= 3",
    "cf_predict": with_(RATINGS, MEANS, TARGETS, PAIRS, NEAR, PREDICTED) + "SELECT user_id, item_id, round(round(prediction, 9), 5) AS prediction, round(round(confidence, 9), 5) AS confidence FROM predicted",
    "cold_start": with_(RATINGS, MEANS, TARGETS) + "SELECT user_id, item_id, round(round(coalesce((user_mean + item_mean) / 2, user_mean, item_mean, 2.5), 9), 6) AS prediction FROM targets LEFT JOIN users USING (user_id) LEFT JOIN items USING (item_id)",
    "blend_similarity": with_(RATINGS, PAIRS, "tags AS (SELECT item_id, list(DISTINCT t) AS tags FROM (SELECT l_suppkey AS item_id, l_returnflag AS t FROM lineitem UNION SELECT l_suppkey, l_linestatus FROM lineitem) GROUP BY 1)",
                              "prof AS (SELECT item_id, avg(stars) AS x, CAST(count(*) AS DOUBLE) AS y, any_value(tags) AS tags FROM ratings JOIN tags USING (item_id) GROUP BY 1)",
                              "parts AS (SELECT a, b, correlation, (p.x * q.x + p.y * q.y) / (sqrt(p.x * p.x + p.y * p.y) * sqrt(q.x * q.x + q.y * q.y)) AS hot, len(list_intersect(p.tags, q.tags)) / CAST(len(list_distinct(list_concat(p.tags, q.tags))) AS DOUBLE) AS tag FROM pairs JOIN prof p ON p.item_id = a JOIN prof q ON q.item_id = b)")
    + "SELECT a, b, round((CASE WHEN correlation <= 0 THEN -1 ELSE 1 END) * (0.3 * abs(correlation) + 0.3 * hot + 0.4 * tag), 5) AS similarity FROM parts",
    "hybrid_blend": with_(RATINGS, MEANS) + "SELECT user_id, item_id, round(round(0.1 * user_mean + 0.9 * item_mean, 9), 6) AS prediction FROM ratings JOIN users USING (user_id) JOIN items USING (item_id)",
    "vote_blend": with_(RATINGS, MEANS, "v AS (SELECT user_id, item_id, user_mean AS x, item_mean AS y, 3.25 AS z FROM ratings JOIN users USING (user_id) JOIN items USING (item_id))",
                        "w AS (SELECT *, round_even(y, 0) AS r, CASE WHEN abs(x - round_even(x, 0)) > 0.1 THEN 0 ELSE 1 END + CASE WHEN abs(y - round_even(y, 0)) > 0.2 THEN 0 ELSE 1 END + CASE WHEN abs(z - round_even(z, 0)) > 0.1 THEN 0 ELSE 1 END AS votes FROM v)")
    + "SELECT user_id, item_id, round(round(greatest(1.0, least(5.0, CASE WHEN votes >= 2 AND round_even(x, 0) = r AND round_even(z, 0) = r THEN r ELSE y END)), 9), 6) AS prediction FROM w",
    "features_base": with_(RATINGS, TARGETS, "u AS (SELECT o_custkey AS user_id, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS useful, count(*) FILTER (o_orderpriority = '5-LOW') AS fans, avg(o_totalprice) AS mean FROM orders GROUP BY 1)",
                           "m AS (SELECT (SELECT avg(n) FROM u) AS mn, (SELECT avg(mean) FROM u) AS mm, (SELECT avg(s_acctbal) FROM supplier) AS ms, (SELECT avg(s_nationkey) FROM supplier) AS mk)")
    + f"SELECT t.user_id, t.item_id, {number('t.user_id')} AS u_key, {number('t.item_id')} AS i_key, {steady('coalesce(n, mn)')} AS u_review_count, CAST(coalesce(useful, 0) AS DOUBLE) AS u_useful, CAST(coalesce(fans, 0) AS DOUBLE) AS u_fans, {steady('coalesce(mean, mm)')} AS u_average_stars, "
    f"{steady('coalesce(s_acctbal, ms)')} AS i_stars, {steady('coalesce(s_nationkey, mk)')} AS i_review_count FROM targets t CROSS JOIN m LEFT JOIN u USING (user_id) LEFT JOIN supplier ON s_suppkey = t.item_id",
    "features_rich_13": with_(RATINGS, TARGETS, """u AS (SELECT o_custkey AS user_id, count(*) AS n, date_diff('day', CAST(min(o_orderdate) AS DATE), DATE '2000-01-01') AS history, CASE WHEN o_custkey % 4 = 0 THEN 0 ELSE o_custkey % 3 + 1 END AS friends,
        count(*) FILTER (o_orderstatus IN ('F', 'O', 'P')) AS votes, 2 AS elite, avg(o_totalprice) AS mean, count(*) FILTER (substr(o_orderpriority, 1, 1) IN ('1', '2')) AS compliments FROM orders GROUP BY o_custkey)""",
                              "c AS (SELECT user_id AS item_id, CAST(sum(list_sum(map_values(CAST(CAST(props AS JSON) AS MAP(VARCHAR, BIGINT))))) AS BIGINT) AS visits FROM events GROUP BY 1)",
                              "p AS (SELECT l_suppkey AS item_id, count(*) AS pictures FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)",
                              "mu AS (SELECT avg(n) AS m1, avg(history) AS m2, avg(friends) AS m3, avg(votes) AS m4, avg(elite) AS m5, avg(mean) AS m6, avg(compliments) AS m7 FROM u)", "ms AS (SELECT avg(s_acctbal) AS m8, avg(s_nationkey) AS m9 FROM supplier)",
                              "mc AS (SELECT avg(visits) AS m10 FROM c)", "mp AS (SELECT avg(pictures) AS m11 FROM p)")
    + f"SELECT t.user_id, t.item_id, {number('t.user_id')} AS u_key, {number('t.item_id')} AS i_key, {steady('coalesce(n, m1)')} AS u_review_count, {steady('coalesce(history, m2)')} AS u_history, {steady('coalesce(friends, m3)')} AS u_friends, {steady('coalesce(votes, m4)')} AS u_votes, "
    f"{steady('coalesce(elite, m5)')} AS u_elite, {steady('coalesce(mean, m6)')} AS u_average_stars, {steady('coalesce(compliments, m7)')} AS u_compliments, {steady('coalesce(s_acctbal, m8)')} AS i_stars, {steady('coalesce(s_nationkey, m9)')} AS i_review_count, "
    f"{steady('coalesce(visits, m10)')} AS i_checkins, {steady('coalesce(pictures, m11)')} AS i_photos FROM targets t CROSS JOIN mu CROSS JOIN ms CROSS JOIN mc CROSS JOIN mp LEFT JOIN u USING (user_id) LEFT JOIN supplier ON s_suppkey = t.item_id LEFT JOIN c ON c.item_id = t.item_id LEFT JOIN p ON p.item_id = t.item_id",
    "features_rich": """SELECT o_custkey AS user_id, count(*) AS review_count, date_diff('day', CAST(min(o_orderdate) AS DATE), DATE '2000-01-01') AS history, CASE WHEN o_custkey % 4 = 0 THEN 0 ELSE o_custkey % 3 + 1 END AS friends, 2 AS elite,
        count(*) FILTER (o_orderstatus IN ('F', 'O', 'P')) AS votes, count(*) FILTER (substr(o_orderpriority, 1, 1) IN ('1', '2')) AS compliments, round(avg(o_totalprice), 6) AS average_stars FROM orders GROUP BY o_custkey""",
    "item_features": """SELECT CAST(s_suppkey AS VARCHAR) AS business_id, s_acctbal AS stars, s_nationkey AS review_count, coalesce(t, 0) AS checkins, coalesce(p, 0) AS photos FROM supplier
        LEFT JOIN (SELECT user_id, CAST(sum(list_sum(map_values(CAST(CAST(props AS JSON) AS MAP(VARCHAR, BIGINT))))) AS BIGINT) AS t FROM events GROUP BY 1) e ON e.user_id = s_suppkey LEFT JOIN (SELECT l_suppkey, count(*) AS p FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) l ON l.l_suppkey = s_suppkey""",
    "cf_feature": with_(RATINGS, MEANS, TARGETS, PAIRS, NEAR, PREDICTED, FEATURES.replace("means AS", "fmeans AS"))
    + "SELECT user_id, item_id, round(round(coalesce(u_orders, mo), 9), 4) AS u_orders, round(round(coalesce(i_acctbal, mi), 9), 4) AS i_acctbal, round(round(prediction, 9), 5) AS cf FROM targets CROSS JOIN fmeans LEFT JOIN custs USING (user_id) LEFT JOIN sups USING (item_id) LEFT JOIN predicted USING (user_id, item_id)",
    "error_histogram": with_(RATINGS, MEANS) + "SELECT CAST(least(floor(abs(round((user_mean + item_mean) / 2, 6) - stars)), 4) AS INTEGER) AS bin, count(*) AS n FROM ratings JOIN users USING (user_id) JOIN items USING (item_id) GROUP BY 1",
    "rmse": with_(RATINGS, MEANS) + "SELECT round(sqrt(avg(pow((user_mean + item_mean) / 2 - stars, 2))), 5) AS rmse, round(avg(pow((user_mean + item_mean) / 2 - stars, 2)), 5) AS mse, count(*) AS n FROM ratings JOIN users USING (user_id) JOIN items USING (item_id)",
    "clip": "SELECT c_custkey, round(least(greatest(c_acctbal / 1000, 1.0), 5.0), 6) AS clipped, CASE WHEN c_acctbal / 1000 >= 3 THEN 5 WHEN c_acctbal / 1000 >= 1 THEN 4 WHEN c_acctbal / 1000 >= -1 THEN 3 WHEN c_acctbal / 1000 >= -3 THEN 2 ELSE 1 END AS step FROM customer",
    "content_boost": with_(RATINGS) + f"""SELECT item_id, count(*) AS n, round(avg(stars), 6) AS mean FROM (SELECT item_id, stars FROM ratings UNION ALL SELECT s_suppkey, 2.5 FROM customer, supplier WHERE {percent(3, "c_custkey")} < 10 AND {percent(4, "CAST(c_custkey AS VARCHAR) || '-' || CAST(s_suppkey AS VARCHAR)")} < 10
        AND NOT EXISTS (SELECT 1 FROM ratings r WHERE r.user_id = c_custkey AND r.item_id = s_suppkey)) GROUP BY 1""",
    "knn_regress": "SELECT vec_id, round(avg(y), 6) AS prediction FROM (SELECT q.vec_id, t.label AS y, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(" + " + ".join(f"pow(CAST(q.embedding[{i + 1}] AS DOUBLE) - CAST(t.embedding[{i + 1}] AS DOUBLE), 2)" for i in DIMS) + ", 9), t.vec_id) AS r FROM embeddings q, embeddings t WHERE q.vec_id % 100 = 0 AND q.vec_id <> t.vec_id) WHERE r <= 5 GROUP BY 1",
    "corating_edges": with_(DAYS) + "SELECT src, dst FROM edges",
    "connected_components": with_(REACH, recursive=True) + "SELECT id, component FROM comp",
    "label_propagation_5": propagation(5),
    "edge_betweenness": with_(BOTH, "bfs(root, node, dist) AS (SELECT DISTINCT src, src, 0 FROM arcs UNION SELECT b.root, a.dst, b.dist + 1 FROM bfs b JOIN arcs a ON a.src = b.node WHERE b.dist < 8)", "d AS (SELECT root, node, min(dist) AS dist FROM bfs GROUP BY 1, 2)",
                              "steps AS (SELECT p.root, p.node AS u, q.node AS v, q.dist FROM d p JOIN arcs a ON a.src = p.node JOIN d q ON q.root = p.root AND q.node = a.dst AND q.dist = p.dist + 1)",
                              "paths(root, node, dist, path) AS (SELECT root, node, 0, [node] FROM d WHERE dist = 0 UNION ALL SELECT p.root, s.v, s.dist, list_append(p.path, s.v) FROM paths p JOIN steps s ON s.root = p.root AND s.u = p.node)",
                              "counted AS (SELECT root, node, path, count(*) OVER (PARTITION BY root, node) AS c FROM paths WHERE dist > 0 AND root < node)", "hops AS (SELECT path, c, unnest(range(1, len(path))) AS i FROM counted)", recursive=True)
    + "SELECT least(path[i], path[i + 1]) AS src, greatest(path[i], path[i + 1]) AS dst, round(sum(1.0 / c), 6) AS betweenness FROM hops GROUP BY 1, 2",
    "modularity": with_(REACH, "deg AS (SELECT src AS id, count(*) AS k FROM arcs GROUP BY 1)", "tot AS (SELECT count(*) AS m FROM edges)", "s AS (SELECT component, sum(k) AS s FROM comp JOIN deg USING (id) GROUP BY 1)",
                        "e AS (SELECT x.component, count(*) AS e FROM edges JOIN comp x ON x.id = src JOIN comp y ON y.id = dst WHERE x.component = y.component GROUP BY 1)", recursive=True)
    + "SELECT round(sum((2 * coalesce(e, 0) - s * s / (2.0 * m)) / (2.0 * m)), 6) AS modularity FROM s LEFT JOIN e USING (component), tot",
    "bloom_fpr": bloom(),
    "streaming_bloom_fpr": bloom(),
    "fm_estimate": fm() + "SELECT batch, actual, estimate FROM est",
    "streaming_fm_estimate": fm() + "SELECT batch, actual, estimate FROM est",
    "exact_distinct": with_(EVENTS) + "SELECT seq // 1000 AS batch, count(DISTINCT key) AS n_distinct FROM seqs GROUP BY 1",
    "stream_totals": fm() + "SELECT batch, CAST(sum(actual) OVER w AS BIGINT) AS actual_total, CAST(sum(estimate) OVER w AS BIGINT) AS estimate_total, round(sum(estimate) OVER w / CAST(sum(actual) OVER w AS DOUBLE), 6) AS ratio FROM est WINDOW w AS (ORDER BY batch ROWS UNBOUNDED PRECEDING)",
    "reservoir_hash": with_(EVENTS, "h AS (SELECT seq, key, seq // 1000 AS batch, md5('1-' || CAST(seq AS VARCHAR)) AS h FROM seqs)", "b AS (SELECT DISTINCT batch FROM h)")
    + "SELECT batch, seq, key FROM (SELECT b.batch, h.seq, h.key, row_number() OVER (PARTITION BY b.batch ORDER BY h.h, h.seq) AS r FROM b JOIN h ON h.batch <= b.batch) WHERE r <= 20",
    "streaming_key_counts": "SELECT user_id AS key, count(*) AS n, max(event_id) AS last FROM events GROUP BY 1",
    "cluster_summary": with_(LABEL_STATS) + "SELECT cluster, n, round(m0, 5) AS mean0, round(m63, 5) AS mean63, round(s0, 5) AS std0 FROM stats",
    "mahalanobis_assign": with_(LABEL_STATS, f"dist AS (SELECT vec_id AS id, cluster, round({between('CAST(embedding[{i} + 1] AS DOUBLE)', 'm{i}', 's{i}')}, 9) AS d FROM embeddings, stats)", "best AS (SELECT id, cluster, d, row_number() OVER (PARTITION BY id ORDER BY d, cluster) AS r FROM dist)")
    + "SELECT id, cluster, round(d, 5) AS distance FROM best WHERE r = 1 AND d < 16",
    "cs_merge_pairs": with_(LABEL_STATS, f"dist AS (SELECT p.cluster AS a, q.cluster AS b, least({between('p.m{i}', 'q.m{i}', 'q.s{i}')}, {between('p.m{i}', 'q.m{i}', 'p.s{i}')}) AS d FROM stats p JOIN stats q ON p.cluster < q.cluster)") + "SELECT a, b, round(d, 5) AS distance FROM dist WHERE d < 16",
}
SQL |= {f"streaming_{name}": SQL[name] for name in ("reservoir_hash", "exact_distinct")}
