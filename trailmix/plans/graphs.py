"""Graph walks, samples, losses, item content and convolutions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import content, convolve, graph, logs, negatives, sequences, toplists
from ..session import materialize
from ..sources import tables
from .inputs import events_train, stored_split, stored_train
from .registry import longs, part, query, rounded

CHAINS = graph.N_WALKS
TOP = graph.TOP_T
# The click catalog is too small for ranks 500 to 2000: these ranks leave both the band and the uniform case.
BAND = (20, 60)
DIMS = (content.D_CATEGORY, content.D_NAME, content.D_CITY)


def hexint(expr: str, start: int = 1) -> str:
    return f"('0x' || substr({expr}, {start}, 8))::BIGINT"


def draw_sql(*keys) -> str:
    return hexint(f"md5(concat_ws('|', {', '.join(str(k) for k in keys)}))")


# ---- adjacency and walks -----------------------------------------------------------

def dealt_sql(place: str) -> str:
    """n walkers dealt evenly over deg places from number f, k counting the rows made."""
    return (f"CASE WHEN n < deg THEN (k * deg + f) // n ELSE k END + 1 AS {place}, "
            "CASE WHEN n < deg THEN 1 ELSE ((k + 1) * n - f + deg - 1) // deg - (k * n - f + deg - 1) // deg END AS share")


def graph_parts(prefix: str, pairs: str) -> None:
    for side, node, nbr in (("gi", "item_id", "user_id"), ("gu", "user_id", "item_id")):
        part(f"{prefix}_{side}", f"""
SELECT {node} AS node, row_number() OVER (PARTITION BY {node} ORDER BY {nbr}) AS pos, {nbr} AS nbr,
  count(*) OVER (PARTITION BY {node}) AS deg, count(*) OVER (PARTITION BY {nbr}) AS nbr_deg FROM {pairs}""")
    gi, gu = f"{prefix}_gi", f"{prefix}_gu"
    part(f"{prefix}_w0", f"SELECT node AS src, deg AS src_deg, node AS cur, deg, 0 AS visits, {CHAINS} AS n FROM {gi} WHERE pos = 1")
    for t in range(1, graph.WALK_LEN + 1):
        part(f"{prefix}_w{t}", f"""
SELECT src, cur, max(src_deg) AS src_deg, max(deg) AS deg, sum(visits)::BIGINT AS visits, sum(n)::BIGINT AS n FROM (
  WITH a AS (SELECT src, src_deg, cur, deg, n, {hexint('d', 1)} % deg AS f, {hexint('d', 9)} AS d1, {hexint('d', 17)} AS d2
    FROM (SELECT *, md5(concat_ws('|', src, cur, {t - 1}, 42)) AS d FROM {prefix}_w{t - 1} WHERE n > 0)),
  b AS (SELECT *, {dealt_sql('p1')} FROM (SELECT *, unnest(range(least(n, deg))) AS k FROM a)),
  c AS (SELECT b.src, b.src_deg, b.d2, b.p1, x.nbr AS u, b.share AS n, x.nbr_deg AS deg,
    (b.d1 + b.p1 * {graph.STRIDE}) % {graph.WORD} % x.nbr_deg AS f FROM b JOIN {gi} x ON x.node = b.cur AND x.pos = b.p1),
  e AS (SELECT *, {dealt_sql('p2')} FROM (SELECT *, unnest(range(least(n, deg))) AS k FROM c)),
  g AS (SELECT e.src, e.src_deg, y.nbr AS nxt, y.nbr_deg AS nxt_deg, e.share,
    (e.share * {graph.WORD // 2} + (e.d2 + e.p1 * {graph.STRIDE} + e.p2 * {graph.STRIDE_2}) % {graph.WORD}) // {graph.WORD} AS back
    FROM e JOIN {gu} y ON y.node = e.u AND y.pos = e.p2)
  SELECT src, src_deg, nxt AS cur, nxt_deg AS deg, share AS visits, share - back AS n FROM g
  UNION ALL SELECT src, src_deg, src, src_deg, 0, sum(back) FROM g WHERE back > 0 GROUP BY 1, 2) GROUP BY src, cur""")
    steps = " UNION ALL ".join(f"SELECT src, cur, visits FROM {prefix}_w{t} WHERE visits > 0" for t in range(1, graph.WALK_LEN + 1))
    part(f"{prefix}_walks", f"SELECT src, cur AS dst, sum(visits) AS visits FROM ({steps}) GROUP BY src, cur")
    part(f"{prefix}_ranked", f"""
SELECT src, dst, visits, row_number() OVER (PARTITION BY src ORDER BY visits DESC, dst) AS rank,
  count(*) OVER (PARTITION BY src) AS n_hit FROM {prefix}_walks WHERE src <> dst""")
    part(f"{prefix}_nbr", f"""
SELECT src, dst, rank, visits / sum(visits) OVER (PARTITION BY src) AS alpha FROM {prefix}_ranked WHERE rank <= {TOP}
UNION ALL SELECT DISTINCT item_id, item_id, 1, 1.0 FROM {pairs} WHERE item_id NOT IN (SELECT src FROM {prefix}_ranked)""")


graph_parts("pg", "trd")
graph_parts("cg", "ckp")


def purchase_pairs(spark, d):
    return materialize(toplists.rated_pairs(stored_train(spark, d)))


def click_pairs(spark, d):
    return materialize(events_train(spark, d).select("user_id", "item_id").distinct())


@query("bipartite_adjacency", """
SELECT 'item' AS side, node, CAST(pos AS BIGINT) AS pos, nbr, CAST(deg AS BIGINT) AS deg, CAST(nbr_deg AS BIGINT) AS nbr_deg FROM pg_gi
UNION ALL SELECT 'user' AS side, node, CAST(pos AS BIGINT), nbr, CAST(deg AS BIGINT), CAST(nbr_deg AS BIGINT) FROM pg_gu""")
def bipartite_adjacency(spark, d):
    pairs = purchase_pairs(spark, d)
    sides = [graph.adjacency(pairs, f"{s}_id").withColumn("side", F.lit(s)) for s in ("item", "user")]
    return longs(sides[0].unionByName(sides[1]), "pos")


# Thousands of rows an item: the result says for each source how far its chains came and what they counted.
@query("random_walk_visits", """
SELECT src, count(*) AS n_reached, CAST(sum(visits) AS BIGINT) AS visits, CAST(sum(visits * dst) AS BIGINT) AS dst_sum,
  CAST(max(visits) AS BIGINT) AS most FROM pg_walks GROUP BY src""")
def random_walk_visits(spark, d):
    return graph.random_walks(purchase_pairs(spark, d), CHAINS).groupBy("src").agg(
        F.count("*").alias("n_reached"), F.sum("visits").alias("visits"),
        F.sum(F.col("visits") * F.col("dst")).alias("dst_sum"), F.max("visits").alias("most"))


part("ck_ci", "SELECT item_id, count(*) AS n FROM ckp GROUP BY item_id")
part("ck_cu", "SELECT user_id, count(*) AS n FROM ckp GROUP BY user_id")
part("xp_0", "SELECT DISTINCT item_id AS src, item_id, 1.0::DOUBLE AS mass FROM ckp")
for _t in range(1, 11):
    part(f"xv_{_t}", f"""
SELECT src, y.item_id, sum(m.mass / c.n) AS mass FROM (
  SELECT p.src, x.user_id, sum(p.mass / c.n) AS mass FROM xp_{_t - 1} p JOIN ckp x ON x.item_id = p.item_id
  JOIN ck_ci c ON c.item_id = p.item_id GROUP BY 1, 2) m
JOIN ckp y ON y.user_id = m.user_id JOIN ck_cu c ON c.user_id = m.user_id GROUP BY 1, 2""")
    part(f"xp_{_t}", f"""
SELECT src, item_id, sum(mass) AS mass FROM (SELECT src, item_id, mass * 0.5 AS mass FROM xv_{_t}
  UNION ALL SELECT src, item_id, mass * 0.5 FROM xp_0) GROUP BY 1, 2""")
part("x_sum", "SELECT src, item_id AS dst, sum(mass) AS mass FROM (" + " UNION ALL ".join(
    f"SELECT * FROM xv_{t}" for t in range(1, 11)) + ") GROUP BY 1, 2")


@query("expected_visits", "SELECT src, dst, round(mass, 6) AS mass FROM x_sum")
def expected_visits(spark, d):
    return rounded(graph.expected_visits(click_pairs(spark, d)), "mass")


@query("importance_neighborhood", "SELECT src, dst, CAST(rank AS INTEGER) AS rank, round(alpha, 6) AS alpha FROM pg_nbr")
def importance_neighborhood(spark, d):
    pairs = purchase_pairs(spark, d)
    visits = materialize(graph.random_walks(pairs, CHAINS))
    return rounded(graph.neighborhood(visits, logs.distinct_values(pairs, "item_id"), TOP), "alpha")


part("xr", """
SELECT src, dst, round(mass, 9) AS mass, row_number() OVER (PARTITION BY src ORDER BY round(mass, 9) DESC, dst) AS rank
FROM x_sum WHERE src <> dst""")


@query("walk_fidelity", """
WITH j AS (SELECT x.src, x.mass, x.rank AS re, w.rank AS rw FROM xr x LEFT JOIN cg_ranked w ON w.src = x.src AND w.dst = x.dst),
s AS (SELECT k, src, count(*) FILTER (rw <= k AND re <= k) / count(*) FILTER (re <= k) AS o,
  sum(CASE WHEN rw <= k THEN mass ELSE 0 END) / sum(mass) AS m FROM j, (VALUES (10), (50)) t(k) GROUP BY k, src)
SELECT k, round(avg(o), 6) AS overlap, round(avg(m), 6) AS mass_covered FROM s GROUP BY k""")
def walk_fidelity(spark, d):
    pairs = click_pairs(spark, d)
    out = graph.walk_fidelity(materialize(graph.random_walks(pairs, CHAINS)), graph.expected_visits(pairs))
    return rounded(out, "overlap", "mass_covered")


part("hop_0", "SELECT DISTINCT item_id AS node FROM te WHERE ts = (SELECT max(ts) FROM te)")
part("hop_1", "SELECT DISTINCT dst AS node FROM pg_nbr WHERE src IN (SELECT node FROM hop_0) AND dst NOT IN (SELECT node FROM hop_0)")
part("hop_2", """
SELECT DISTINCT dst AS node FROM pg_nbr WHERE src IN (SELECT node FROM hop_1)
AND dst NOT IN (SELECT node FROM hop_0 UNION ALL SELECT node FROM hop_1)""")


@query("khop_expand", """
SELECT node, 0 AS hop FROM hop_0 UNION ALL SELECT node, 1 FROM hop_1 UNION ALL SELECT node, 2 FROM hop_2""")
def khop_expand(spark, d):
    fit, test = stored_split(spark, d)
    pairs = materialize(toplists.rated_pairs(fit))
    visits = materialize(graph.random_walks(pairs, CHAINS))
    nbr = materialize(graph.neighborhood(visits, logs.distinct_values(pairs, "item_id"), TOP))
    newest = test.where(F.col("ts") == test.agg(F.max("ts")).scalar())
    return graph.khop(nbr, newest.select(F.col("item_id").alias("node")), 2)


# ---- negatives and losses ----------------------------------------------------------

part("ck_idx", "SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS idx FROM (SELECT DISTINCT item_id FROM ck)")
part("ck_free", """
SELECT user_id, list(i.item_id ORDER BY idx) AS free FROM (SELECT DISTINCT user_id FROM ckp) u, ck_idx i
WHERE (user_id, i.item_id) NOT IN (SELECT user_id, item_id FROM ckp) GROUP BY user_id""")
part("ck_negs", f"""
SELECT p.user_id, p.item_id, slot, CASE WHEN s0.item_id IS NULL THEN a0.item_id WHEN s1.item_id IS NULL THEN a1.item_id
  ELSE free[{draw_sql('p.user_id', 'p.item_id', 'slot', 2, 1, 42)} % len(free) + 1] END AS negative
FROM ckp p, range({negatives.N_NEGATIVES}) t(slot)
JOIN ck_free f ON f.user_id = p.user_id
JOIN ck_idx a0 ON a0.idx = {draw_sql('p.user_id', 'p.item_id', 'slot', 0, 1, 42)} % (SELECT count(*) FROM ck_idx)
JOIN ck_idx a1 ON a1.idx = {draw_sql('p.user_id', 'p.item_id', 'slot', 1, 1, 42)} % (SELECT count(*) FROM ck_idx)
LEFT JOIN ckp s0 ON s0.user_id = p.user_id AND s0.item_id = a0.item_id
LEFT JOIN ckp s1 ON s1.user_id = p.user_id AND s1.item_id = a1.item_id""")


def _click_negatives(spark, d):
    pairs = click_pairs(spark, d)
    return pairs, negatives.sample_negatives(pairs, pairs, logs.distinct_values(pairs, "item_id"))


@query("sample_negatives", "SELECT user_id, item_id, CAST(slot AS INTEGER) AS slot, negative FROM ck_negs")
def sample_negatives(spark, d):
    return _click_negatives(spark, d)[1]


@query("labelled_union", f"""
SELECT user_id, item_id, 1 AS label, {draw_sql('user_id', 'item_id', -1, "''", 42)} AS shuffle_key FROM ckp
UNION ALL SELECT user_id, negative, 0, {draw_sql('user_id', 'negative', 'slot', 'item_id', 42)} FROM ck_negs""")
def labelled_union(spark, d):
    return negatives.labelled_union(*_click_negatives(spark, d))


part("ckd", """
SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY user_id, item_id ORDER BY ts DESC, seq DESC) AS rn FROM ck)
WHERE rn = 1""")
part("ck_pairs", f"""
SELECT *, {draw_sql('user_id', 'pos', "'batch'", 42)} % (SELECT ceil(count(*) / {negatives.BATCH})::BIGINT FROM ck_pairs0) AS batch FROM ck_pairs0""")
part("ck_pairs0", """
SELECT user_id, pos, q, i FROM (SELECT user_id, row_number() OVER w AS pos, lag(item_id) OVER w AS q, item_id AS i FROM ckd
  WINDOW w AS (PARTITION BY user_id ORDER BY ts, seq)) WHERE q <> i""")
part("em_idx", "SELECT vec_id AS item_id, embedding::DOUBLE[] AS z, row_number() OVER (ORDER BY vec_id) - 1 AS idx FROM embeddings")
part("ck_bneg", f"""
SELECT batch, slot, item_id AS negative FROM (SELECT DISTINCT batch FROM ck_pairs), range({negatives.N_SHARED}) t(slot)
JOIN em_idx ON idx = {draw_sql('batch', 'slot', "'shared'", 42)} % (SELECT count(*) FROM em_idx)""")
part("cg_hit", "SELECT src, count(*) AS n_hit FROM cg_ranked GROUP BY src")
part("ck_slots", f"""
SELECT p.user_id, p.pos, p.q, p.i, slot, greatest(least(coalesce(n_hit, 0), {BAND[1]}) - {BAND[0]}, 0) AS av,
  {draw_sql('p.user_id', 'p.pos', 'slot', "'hard'", 42)} AS dr
FROM ck_pairs p LEFT JOIN cg_hit h ON h.src = p.q CROSS JOIN range(2) t(slot)""")
part("ck_near", f"""
SELECT user_id, pos, q, i, slot, {BAND[0]} + dr % av + 1 AS rank FROM ck_slots WHERE av > 0""")
part("ck_far", "SELECT user_id, pos, q, i, slot, dr % (SELECT count(*) FROM ck_idx) AS idx FROM ck_slots WHERE av = 0")
part("ck_hard", """
SELECT n.user_id, n.pos, n.q, n.i, n.slot, r.dst AS negative FROM ck_near n JOIN cg_ranked r ON r.src = n.q AND r.rank = n.rank
UNION ALL SELECT f.user_id, f.pos, f.q, f.i, f.slot, x.item_id FROM ck_far f JOIN ck_idx x USING (idx)""")


def click_batches(spark, d):
    pairs = sequences.consecutive_pairs(events_train(spark, d))
    return materialize(negatives.with_batches(materialize(pairs), ["user_id", "pos"]))


# 500 rows a pair: the result says for each pair how many negatives it has and which, by their sum.
@query("shared_negatives", """
SELECT user_id, CAST(p.pos AS BIGINT) AS pos, q, i, CAST(batch AS BIGINT) AS batch, count(*) AS n_negatives,
  CAST(sum(negative * (slot + 1)) AS BIGINT) AS negative_sum
FROM ck_pairs p JOIN ck_bneg USING (batch) WHERE negative <> i GROUP BY ALL""")
def shared_negatives(spark, d):
    out = longs(negatives.shared_negatives(click_batches(spark, d), tables.embeddings(spark, d)), "pos", "batch")
    return out.groupBy("user_id", "pos", "q", "i", "batch").agg(
        F.count("*").alias("n_negatives"), F.sum(F.col("negative") * (F.col("slot") + 1)).cast("bigint").alias("negative_sum"))


def _hard(spark, d, pairs):
    edges = click_pairs(spark, d)
    items = logs.distinct_values(edges, "item_id")
    visits = materialize(graph.random_walks(edges, CHAINS))
    return negatives.hard_negatives(graph.ranked_visits(visits), graph.reached(visits, items), items, pairs,
                                    ["user_id", "pos"], negatives.hard_count(3), BAND)


@query("hard_negative_band", """
SELECT user_id, CAST(pos AS BIGINT) AS pos, q, i, CAST(slot AS INTEGER) AS slot, negative FROM ck_hard""")
def hard_negative_band(spark, d):
    return longs(_hard(spark, d, click_batches(spark, d)), "pos")


part("z_pos", """
SELECT p.user_id, p.pos, p.batch, p.i, a.z AS zq, list_inner_product(a.z, b.z) AS own FROM ck_pairs p
JOIN em_idx a ON a.item_id = p.q JOIN em_idx b ON b.item_id = p.i""")
part("z_neg", """
SELECT p.user_id, p.pos, p.own, list_inner_product(p.zq, n.z) AS s, false AS hard FROM z_pos p JOIN ck_bneg b USING (batch)
JOIN em_idx n ON n.item_id = b.negative WHERE b.negative <> p.i
UNION ALL
SELECT p.user_id, p.pos, p.own, list_inner_product(p.zq, n.z), true FROM z_pos p JOIN ck_hard h ON h.user_id = p.user_id AND h.pos = p.pos
JOIN em_idx n ON n.item_id = h.negative WHERE h.negative <> p.i""")


@query("margin_loss_eval", "SELECT round(sum(greatest(0, s - own + 0.1)) / count(*), 6) AS loss FROM z_neg")
def margin_loss_eval(spark, d):
    pairs, vectors = click_batches(spark, d), tables.embeddings(spark, d)
    shared = negatives.batch_items(pairs, vectors)
    return rounded(negatives.margin_loss(vectors, pairs, shared, _hard(spark, d, pairs)), "loss")


@query("xent_loss_eval", """
SELECT round(-((SELECT avg(-ln(1 + exp(-own))) FROM z_pos) + (SELECT avg(-ln(1 + exp(s))) FROM z_neg WHERE NOT hard)), 6) AS loss""")
def xent_loss_eval(spark, d):
    pairs, vectors = click_batches(spark, d), tables.embeddings(spark, d)
    return rounded(negatives.xent_loss(vectors, pairs, negatives.batch_items(pairs, vectors)), "loss")


# ---- item content ------------------------------------------------------------------

part("cat_words", """
SELECT item_id, trim(w) AS category FROM (SELECT item_id, unnest(string_split(categories, ';')) AS w FROM items_raw) WHERE trim(w) <> ''""")
part("cat_bag", """
SELECT item_id, category, id FROM cat_words JOIN (SELECT category, row_number() OVER (ORDER BY category) - 1 AS id
  FROM (SELECT DISTINCT category FROM cat_words)) USING (category)""")
part("city_ids", """
SELECT item_id, city, id FROM (SELECT item_id, lower(trim(city)) AS city FROM items_raw) JOIN (
  SELECT city, row_number() OVER (ORDER BY city) - 1 AS id FROM (SELECT DISTINCT lower(trim(city)) AS city FROM items_raw)) USING (city)""")


@query("category_bag", "SELECT item_id, category, CAST(id AS BIGINT) AS id FROM cat_bag")
def category_bag(spark, d):
    return content.category_bag(tables.parts(spark, d))


@query("city_index", "SELECT item_id, city, CAST(id AS BIGINT) AS id FROM city_ids")
def city_index(spark, d):
    return longs(content.city_index(tables.parts(spark, d)), "id")


@query("standardize_geo", """
SELECT item_id, round((lat - avg(lat) OVER ()) / (stddev_pop(lat) OVER () + 1e-9), 6) + 0.0 AS lat,
  round((lon - avg(lon) OVER ()) / (stddev_pop(lon) OVER () + 1e-9), 6) + 0.0 AS lon, 1.0::DOUBLE AS is_open FROM items_raw""")
def standardize_geo(spark, d):
    items = tables.parts(spark, d).select("item_id", "lat", "lon", F.coalesce("is_open", F.lit(True)).cast("double").alias("is_open"))
    return rounded(content.standardize(items, ["lat", "lon"]), "lat", "lon")


part("num_base", """
SELECT r.item_id, ln(1 + coalesce(n, 0)) AS d, coalesce(m, (SELECT avg(m) FROM num_stats)) / 5 AS star, lat, lon FROM items_raw r
LEFT JOIN num_stats USING (item_id)""")
part("num_stats", "SELECT item_id, count(*) AS n, avg(rating) AS m FROM fit GROUP BY item_id")
part("num_feat", """
SELECT item_id, (d - avg(d) OVER ()) / (stddev_pop(d) OVER () + 1e-9) AS degree, star,
  (lat - avg(lat) OVER ()) / (stddev_pop(lat) OVER () + 1e-9) AS lat, (lon - avg(lon) OVER ()) / (stddev_pop(lon) OVER () + 1e-9) AS lon,
  1.0::DOUBLE AS is_open FROM num_base""")


def _fit(spark, d):
    return materialize(logs.validation_split(stored_train(spark, d))[0])


@query("numeric_features", """
SELECT item_id, round(degree, 6) + 0.0 AS degree, round(star, 6) AS star, round(lat, 6) + 0.0 AS lat, round(lon, 6) + 0.0 AS lon, is_open FROM num_feat""")
def numeric_features(spark, d):
    out = content.numeric_features(tables.parts(spark, d), _fit(spark, d))
    return rounded(out, "degree", "star", "lat", "lon")


def table_sql(kind: str, dim: int) -> str:
    value = f"({draw_sql(repr(kind), 'b.id', 'd', 42)} / 4294967296.0 - 0.5) * (0.05 * sqrt(12))"
    source = {"category": "SELECT item_id, id FROM cat_bag", "city": "SELECT item_id, id FROM city_ids",
              "name": "SELECT item_id, bucket AS id FROM tok_rows JOIN tok_buckets USING (token)"}[kind]
    return (f"SELECT item_id, list(x ORDER BY d) AS v FROM (SELECT item_id, d, avg({value}) AS x "
            f"FROM ({source}) b, range({dim}) t(d) GROUP BY item_id, d) GROUP BY item_id")


part("content_vec", f"""
SELECT n.item_id, c.v || w.v || t.v || [degree, star, lat, lon, is_open] AS vec FROM num_feat n
JOIN ({table_sql('category', DIMS[0])}) c USING (item_id) JOIN ({table_sql('name', DIMS[1])}) w USING (item_id)
JOIN ({table_sql('city', DIMS[2])}) t USING (item_id)""")


def long_vectors(df, key: str):
    rows = df.select(key, F.posexplode("vec").alias("dim", "x"))
    return rounded(longs(rows, "dim"), "x")


def long_sql(table: str, key: str) -> str:
    return f"SELECT {key}, CAST(i - 1 AS BIGINT) AS dim, round(vec[i], 6) + 0.0 AS x FROM {table}, range(1, 200) t(i) WHERE i <= len(vec)"


@query("item_content_vector", long_sql("content_vec", "item_id"))
def item_content_vector(spark, d):
    return long_vectors(content.content_vectors(tables.parts(spark, d), _fit(spark, d), dims=DIMS), "item_id")


# ---- convolutions ------------------------------------------------------------------

WEIGHTS = convolve.seeded_weights(sum(DIMS) + 5)


def linear_sql(vec: str, matrix, bias=None, relu: bool = True) -> str:
    cells = []
    for i, row in enumerate(matrix):
        weights = ", ".join(repr(float(x)) for x in row)
        cell = f"list_inner_product({vec}, [{weights}]::DOUBLE[])"
        if bias is not None:
            cell += f" + {float(bias[i])!r}"
        cells.append(f"greatest(0, {cell})" if relu else cell)
    return f"[{', '.join(cells)}]::DOUBLE[]"


def unit_sql(table: str) -> str:
    return (f"SELECT node, list_transform(v, lambda x: x / greatest(sqrt(list_inner_product(v, v)), 1e-12)) AS vec "
            f"FROM ({table})")


def conv_parts(name: str, source: str, layer: dict, pool: str) -> None:
    hidden = len(layer["Q"])
    weight = {"importance": "sum(alpha * m[d])", "mean": "sum(m[d]) / count(*)", "max": "max(m[d])"}[pool]
    scale = " / sum(alpha)" if pool == "importance" else ""
    part(f"{name}_msg", f"SELECT node, {linear_sql('vec', layer['Q'], layer['q'])} AS m FROM {source}")
    part(f"{name}_agg", f"""
SELECT src, list(x ORDER BY d) AS n FROM (SELECT src, d, {weight}{scale} AS x FROM pg_nbr JOIN {name}_msg ON node = dst,
  range(1, {hidden + 1}) t(d) WHERE alpha > 0 GROUP BY src, d) GROUP BY src""")
    part(name, unit_sql(f"""
SELECT h.node, {linear_sql('(h.vec || coalesce(a.n, ' + str([0.0] * hidden) + '))', layer['W'], layer['w'])} AS v
FROM {source} h LEFT JOIN {name}_agg a ON a.src = h.node"""))


part("h_0", "SELECT item_id AS node, vec FROM content_vec WHERE item_id IN (SELECT item_id FROM trd)")
for _pool in ("importance", "mean", "max"):
    conv_parts(f"conv_{_pool}", "h_0", WEIGHTS["convs"][0], _pool)
conv_parts("conv_two", "conv_importance", WEIGHTS["convs"][1], "importance")
part("emb_hidden", f"SELECT node, {linear_sql('vec', WEIGHTS['G1'], WEIGHTS['g'])} AS vec FROM conv_two")
part("emb_all", unit_sql(f"SELECT node, {linear_sql('vec', WEIGHTS['G2'], relu=False)} AS v FROM emb_hidden"))


def _graph_inputs(spark, d):
    train = stored_train(spark, d)
    pairs = materialize(toplists.rated_pairs(train))
    items = logs.distinct_values(pairs, "item_id")
    visits = materialize(graph.random_walks(pairs, CHAINS))
    nbr = materialize(graph.neighborhood(visits, items, TOP))
    fit = materialize(logs.validation_split(train)[0])
    vectors = content.content_vectors(tables.parts(spark, d), fit, dims=DIMS).join(items, "item_id", "left_semi")
    return materialize(vectors), nbr


def _convolved(pool):
    def run(spark, d):
        vectors, nbr = _graph_inputs(spark, d)
        h = vectors.select(F.col("item_id").alias("node"), "vec")
        return long_vectors(convolve.convolve(h, nbr, WEIGHTS["convs"][0], pool), "node")
    return run


for _pool in ("importance", "mean", "max"):
    query(f"convolve_{_pool}", long_sql(f"conv_{_pool}", "node"))(_convolved(_pool))


@query("weighted_vector_sum", f"""
SELECT src, CAST(d - 1 AS BIGINT) AS dim, round(sum(alpha * vec[d]) / sum(alpha), 6) + 0.0 AS x FROM pg_nbr JOIN h_0 ON node = dst,
range(1, {sum(DIMS) + 6}) t(d) GROUP BY src, d""")
def weighted_vector_sum(spark, d):
    vectors, nbr = _graph_inputs(spark, d)
    pooled = convolve.weighted_vector_sum(vectors.select(F.col("item_id").alias("node"), "vec"), nbr)
    return long_vectors(pooled.select("src", F.col("n").alias("vec")), "src")


@query("embed_catalog", long_sql("emb_all", "node").replace("SELECT node", "SELECT node AS item_id"))
def embed_catalog(spark, d):
    vectors, nbr = _graph_inputs(spark, d)
    return long_vectors(convolve.embed_catalog(vectors, nbr, WEIGHTS), "item_id")
