"""Queries over the shared tables, each beside its equivalent in DuckDB's SQL.

Two graphs are derived: the event graph links each event's user to the next event's user, at the event's time scaled to
[0, 1]; the shipping graph links customers to suppliers (ids shifted behind the customers') at the ship date.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronograph.functions.rand import sql_uniform, uniform, uniform32
from chronograph.functions.tables import shared_folder
from chronograph.operators import dataset, embedding, graph, metrics, models, walk
from chronograph.operators.ranking import following, time_bucket
from chronograph.plans import pipelines
from chronograph.plans.config import Params
from chronograph.sources import generators, graphs, sinks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
SEED, WALKS, STEPS, WINDOW = 42, 2, 3, 2


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(eid, src, dst, ts): unscaled times in microseconds."""
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("eid"), F.col("user_id").alias("src"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"))
    return following(e, time_bucket(e, "ts"), [F.col("ts"), F.col("eid")], "src", "dst").where("dst is not null").select("eid", "src", "dst", "ts")


def event_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.normalized_times(event_times(spark, sf_dir)).select("eid", "src", "dst", "ts")


def shipping_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, x = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    top = table(spark, sf_dir, "customer").agg((F.max("c_custkey") + 1).alias("off"))
    e = x.select("l_orderkey", "l_linenumber", "l_suppkey", "l_shipdate").join(o.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).join(F.broadcast(top))  # one row
    return e.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("eid"), F.col("o_custkey").alias("src"), (F.col("l_suppkey") + F.col("off")).alias("dst"), F.unix_micros(F.col("l_shipdate").cast("timestamp")).cast("double").alias("ts"))


EVENT = """raw AS (SELECT event_id AS eid, user_id AS src, lead(user_id) OVER (ORDER BY ts, event_id) AS dst, epoch_us(ts) AS t FROM events),
span AS (SELECT min(t) AS lo, max(t) AS hi FROM raw WHERE dst IS NOT NULL),
e AS (SELECT eid, src, dst, CASE WHEN hi > lo THEN round(CAST(t - lo AS DOUBLE) / CAST(hi - lo AS DOUBLE), 10) ELSE 0 END AS ts FROM raw, span WHERE dst IS NOT NULL),
n AS (SELECT max(greatest(src, dst)) + 1 AS n FROM e),
v AS (SELECT unnest(range(n)) AS node FROM n)"""
SHIP = """e AS (SELECT l_orderkey * 8 + l_linenumber AS eid, o_custkey AS src, l_suppkey + (SELECT max(c_custkey) + 1 FROM customer) AS dst, CAST(epoch_us(l_shipdate) AS DOUBLE) AS ts
FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


# --- structure ----------------------------------------------------------------------------------------------------


@query(f"WITH {EVENT} SELECT n AS num_nodes, count(*) AS num_edges, CAST(floor(count(*) / n) AS BIGINT) AS degree FROM e, n GROUP BY n")
def graph_stats(spark, d):
    return graph.stats(event_graph(spark, d))


@query(f"WITH {SHIP} SELECT max(greatest(src, dst)) + 1 AS num_nodes FROM e")
def graph_num_nodes(spark, d):
    return graph.num_nodes(shipping_graph(spark, d))


@query(f"WITH {EVENT} SELECT node, count(src) AS degree FROM v LEFT JOIN e ON node = src GROUP BY node")
def graph_out_degree(spark, d):
    return graph.degrees(event_graph(spark, d))


@query(f"WITH {SHIP}, v AS (SELECT unnest(range((SELECT max(greatest(src, dst)) + 1 FROM e))) AS node) SELECT node, count(dst) AS degree FROM v LEFT JOIN e ON node = dst GROUP BY node")
def graph_in_degree(spark, d):
    return graph.degrees(graph.transposed(shipping_graph(spark, d)))


@query(f"WITH {EVENT}, g AS (SELECT node, count(src) AS degree FROM v LEFT JOIN e ON node = src GROUP BY node) SELECT node, degree, CAST(sum(degree) OVER (ORDER BY node) - degree AS BIGINT) AS \"offset\" FROM g")
def graph_degree_prefix(spark, d):
    return graph.offsets(graph.degrees(event_graph(spark, d)), block=64)


@query(f"WITH {EVENT} SELECT src, array_to_string(list(CAST(dst AS VARCHAR) ORDER BY ts, dst, eid), ' ') AS neighbors FROM e GROUP BY src")
def graph_adjacency(spark, d):
    x = graph.adjacency(event_graph(spark, d))
    return x.select("src", F.array_join(F.transform("neighbors", lambda n: n["dst"].cast("string")), " ").alias("neighbors"))


@query(f"WITH {EVENT}, a AS (SELECT src, list(CAST(dst AS VARCHAR) ORDER BY ts, dst, eid) AS l FROM e GROUP BY src) SELECT src, array_to_string(l[4:], ' ') AS neighbors FROM a")
def graph_neighbor_slice(spark, d):
    x = graph.neighbors_from(graph.adjacency(event_graph(spark, d)), 3)
    return x.select("src", F.array_join(F.transform("neighbors", lambda n: n["dst"].cast("string")), " ").alias("neighbors"))


@query(f"WITH {SHIP} SELECT eid, src, dst, ts FROM e UNION ALL SELECT eid, dst, src, ts FROM e")
def graph_symmetrize(spark, d):
    return graph.symmetrized(shipping_graph(spark, d))


@query(f"WITH {EVENT} SELECT eid, dst AS src, src AS dst, ts FROM e")
def graph_transpose(spark, d):
    return graph.transposed(event_graph(spark, d))


@query(f"WITH {EVENT} SELECT src, dst, min(ts) AS ts FROM e WHERE src <> dst GROUP BY src, dst")
def graph_squish(spark, d):
    return graph.squish(event_graph(spark, d)).select("src", "dst", "ts")


@query(f"WITH {EVENT}, s AS (SELECT src FROM e UNION ALL SELECT dst FROM e), g AS (SELECT node, count(src) AS degree FROM v LEFT JOIN s ON node = src GROUP BY node) SELECT node, row_number() OVER (ORDER BY degree DESC, node DESC) - 1 AS new_id FROM g")
def graph_relabel_degree(spark, d):
    return graph.new_ids(graph.symmetrized(event_graph(spark, d)))


@query(f"WITH {EVENT} SELECT src AS node, round(max(ts) - min(ts), 10) AS delta FROM e GROUP BY src")
def graph_time_span(spark, d):
    return graph.time_spans(event_graph(spark, d)).select("node", F.round("delta", 10).alias("delta"))


@query(f"WITH {EVENT}, p AS (SELECT node AS src, (node * 7 + 1) % n AS dst FROM v, n) SELECT src, dst FROM p WHERE EXISTS (SELECT 1 FROM e WHERE e.src = p.src AND e.dst = p.dst)")
def graph_edge_exists(spark, d):
    e = event_graph(spark, d)
    n = graph.num_nodes(e).first()[0]
    pairs = graph.vertices(e).select(F.col("node").alias("src"), F.pmod(F.col("node") * 7 + 1, F.lit(n)).alias("dst"))
    return graph.existing(pairs, e).select("src", "dst")


@query(f"WITH {EVENT} SELECT src AS node FROM (SELECT DISTINCT src FROM e) ORDER BY {sql_uniform(str(SEED), 'src')}, src LIMIT 1")
def graph_source_pick(spark, d):
    return graph.random_source(event_graph(spark, d), SEED)


@query(f"WITH {EVENT} SELECT node FROM v")
def graph_vertices(spark, d):
    return graph.vertices(event_graph(spark, d))


@query(f"WITH {EVENT} SELECT eid, src, dst FROM e WHERE src >= 100 OR dst >= 100")
def graph_out_of_range(spark, d):
    return graph.out_of_range(event_graph(spark, d), 100).select("eid", "src", "dst")


@query(f"WITH {EVENT} SELECT eid, ts FROM e")
def time_normalize(spark, d):
    return event_graph(spark, d).select("eid", "ts")


@query(f"WITH {EVENT} SELECT eid, dst, ts FROM e WHERE src = 3 AND ts > 0.5")
def future_edges(spark, d):
    return graph.future_edges(event_graph(spark, d), 3, 0.5).select("eid", "dst", "ts")


@query(f"WITH {SHIP}, g AS (SELECT src AS node, count(*) AS degree FROM e GROUP BY src) SELECT node, degree FROM g ORDER BY degree DESC, node DESC LIMIT 25")
def topk_degree(spark, d):
    return graph.top_k(graph.degrees(shipping_graph(spark, d)), "degree", "node", 25)


@query(f"WITH {SHIP} SELECT src AS node FROM e UNION SELECT dst FROM e")
def distinct_nodes(spark, d):
    e = shipping_graph(spark, d)
    return e.select(F.col("src").alias("node")).union(e.select("dst")).distinct()


@query(f"WITH {SHIP} SELECT DISTINCT src, dst FROM e")
def distinct_edges(spark, d):
    return shipping_graph(spark, d).select("src", "dst").distinct()


@query(f"WITH {EVENT} SELECT s.node AS src, v.node AS dst FROM v AS s, v WHERE s.node < 5 AND NOT EXISTS (SELECT 1 FROM e WHERE e.src = s.node AND e.dst = v.node)")
def non_edges(spark, d):
    e = event_graph(spark, d)
    return dataset.non_edges(e, spark.range(5).withColumnRenamed("id", "node")).select("src", "dst")


@query(f"WITH {EVENT} SELECT eid, 1 + CAST(floor({sql_uniform('42', 'eid')} * 4294967296) AS BIGINT) % 255 AS ts FROM e")
def insert_weights(spark, d):
    return graphs.with_weights(event_graph(spark, d).withColumn("ts", F.lit(None).cast("double"))).select("eid", F.col("ts").cast("long").alias("ts"))


# --- walks --------------------------------------------------------------------------------------------------------


def _walk_sql(steps: int, walks: int = WALKS) -> str:
    sql = f"""{EVENT},
d AS (SELECT src, max(ts) - min(ts) AS dl FROM e GROUP BY src),
s0 AS (SELECT w AS walk, node AS start, node, CAST(0 AS DOUBLE) AS ts FROM v, (SELECT unnest(range({walks})) AS w))"""
    for k in range(1, steps + 1):
        sql += f""",
c{k} AS (SELECT p.walk, p.start, e.dst, e.ts, e.eid,
  sum(CASE WHEN dl > 0 THEN exp((e.ts - p.ts) / dl) ELSE 1 END) OVER (PARTITION BY walk, start ORDER BY e.ts, e.dst, e.eid ROWS UNBOUNDED PRECEDING) AS cum,
  sum(CASE WHEN dl > 0 THEN exp((e.ts - p.ts) / dl) ELSE 1 END) OVER (PARTITION BY walk, start) AS tot
  FROM s{k - 1} p JOIN e ON e.src = p.node AND e.ts > p.ts JOIN d ON d.src = p.node),
s{k} AS (SELECT walk, start, dst AS node, ts FROM (SELECT *, row_number() OVER (PARTITION BY walk, start ORDER BY ts, dst, eid) AS r FROM c{k}
  WHERE cum / tot >= {sql_uniform(str(SEED), "walk", "start", str(k))}) WHERE r = 1)"""
    every = " UNION ALL ".join(f"SELECT walk, start, {k} AS step, node, ts FROM s{k}" for k in range(steps + 1))
    return f"{sql}, steps AS ({every})"


def walks(spark: SparkSession, d: str, steps: int = STEPS) -> DataFrame:
    return pipelines.walks_of(event_graph(spark, d), Params(num_walks_per_node=WALKS, walk_length=steps, seed=SEED))


@query(f"""WITH {EVENT}, d AS (SELECT src, max(ts) - min(ts) AS dl FROM e GROUP BY src),
w AS (SELECT eid, e.src, CASE WHEN dl > 0 THEN exp((ts - 0.25) / dl) ELSE 1 END AS w FROM e JOIN d ON e.src = d.src WHERE ts > 0.25)
SELECT eid, src, round(w / sum(w) OVER (PARTITION BY src), 9) AS p FROM w""")
def walk_step_weights(spark, d):
    from pyspark.sql import Window as W

    e = event_graph(spark, d)
    x = e.where("ts > 0.25").join(graph.time_spans(e), F.col("src") == F.col("node")).withColumn("now", F.lit(0.25)).withColumn("w", walk.weights())
    return x.select("eid", "src", F.round(F.col("w") / F.sum("w").over(W.partitionBy("src")), 9).alias("p"))


@query(f"WITH {_walk_sql(1)} SELECT walk, start, step, node, ts FROM steps")
def walk_one_step(spark, d):
    return walk.joined(event_graph(spark, d), WALKS, 1, SEED)


@query(f"WITH {_walk_sql(STEPS)} SELECT walk, start, step, node, ts FROM steps")
def walk_steps_joined(spark, d):
    return walk.joined(event_graph(spark, d), WALKS, STEPS, SEED)


@query(f"WITH {_walk_sql(STEPS)} SELECT walk, start, step, node, ts FROM steps")
def walk_steps_broadcast(spark, d):
    return walk.broadcast_in_pieces(event_graph(spark, d), WALKS, STEPS, SEED)


@query(f"WITH {_walk_sql(STEPS)} SELECT walk, start, array_to_string(list(CAST(node AS VARCHAR) ORDER BY step), ' ') AS path FROM steps GROUP BY walk, start")
def walk_paths(spark, d):
    return walk.paths(walks(spark, d)).select("walk", "start", F.array_join(F.transform("path", lambda x: x.cast("string")), " ").alias("path"))


@query(f"WITH {_walk_sql(5)} SELECT walk, start, max(step) AS length FROM steps GROUP BY walk, start")
def walk_lengths(spark, d):
    return walk.lengths(walks(spark, d, 5))


@query(f"WITH {_walk_sql(STEPS)} SELECT walk, start, array_to_string(list(CAST(node AS VARCHAR) ORDER BY step), ' ') || ' ' AS line FROM steps GROUP BY walk, start")
def walk_corpus(spark, d):
    return walk.corpus(walks(spark, d))


@query(f"WITH {_walk_sql(STEPS)}, f AS (SELECT lag(node) OVER (PARTITION BY walk, start ORDER BY step) AS src, node AS dst FROM steps) SELECT src, dst, count(*) AS times FROM f WHERE src IS NOT NULL GROUP BY src, dst")
def walk_edge_frequency(spark, d):
    return walk.edge_frequency(walks(spark, d))


# --- embedding input ----------------------------------------------------------------------------------------------

VOCAB = f"{_walk_sql(STEPS)}, c AS (SELECT CAST(node AS VARCHAR) AS token, count(*) AS cn FROM steps GROUP BY node UNION ALL SELECT '</s>', count(*) FROM steps WHERE step = 0)"


def _vocab(spark, d, min_count=0):
    steps = walks(spark, d)
    return embedding.vocabulary(steps.select(F.col("node").cast("string").alias("token")), steps.where("step = 0").count(), min_count)


@query(f"WITH {VOCAB} SELECT token, cn FROM c")
def vocab_counts(spark, d):
    return _vocab(spark, d).select("token", "cn")


@query(f"WITH {VOCAB} SELECT token, cn, row_number() OVER (ORDER BY CASE WHEN token = '</s>' THEN 0 ELSE 1 END, cn DESC, token) - 1 AS vocab_idx FROM c WHERE cn >= 8 OR token = '</s>'")
def vocab_prune(spark, d):
    return _vocab(spark, d, 8).select("token", "cn", F.col("vocab_idx").cast("long").alias("vocab_idx"))


@query(f"WITH {VOCAB}, w AS (SELECT *, pow(CAST(cn AS DOUBLE), 0.75) AS w, row_number() OVER (ORDER BY CASE WHEN token = '</s>' THEN 0 ELSE 1 END, cn DESC, token) - 1 AS i FROM c) SELECT token, round(w / sum(w) OVER (), 9) AS p, round(sum(w) OVER (ORDER BY i) / sum(w) OVER (), 9) AS cum FROM w")
def noise_distribution(spark, d):
    return embedding.noise(_vocab(spark, d)).select("token", F.round("p", 9).alias("p"), F.round("cum", 9).alias("cum"))


@query(f"WITH {VOCAB}, k AS (SELECT token, (sqrt(cn / (0.01 * sum(cn) OVER ())) + 1) * (0.01 * sum(cn) OVER ()) / cn AS keep FROM c WHERE token <> '</s>') SELECT walk, start, step, token FROM steps JOIN k ON token = CAST(node AS VARCHAR) WHERE keep >= {sql_uniform(str(SEED), 'walk', 'start', 'step')}")
def subsample_tokens(spark, d):
    tokens = walks(spark, d).select("walk", "start", "step", F.col("node").cast("string").alias("token"))
    return embedding.subsampled(tokens, embedding.vocabulary(tokens), SEED, 0.01).select("walk", "start", "step", "token")


_REACH = f"{WINDOW} - CAST(floor({sql_uniform(str(SEED), 'c.walk', 'c.start', 'c.step')} * 4294967296) AS BIGINT) % {WINDOW}"


@query(f"WITH {_walk_sql(STEPS)} SELECT c.walk, c.start, c.step AS position, o.node AS context, c.node AS center FROM steps c JOIN steps o ON c.walk = o.walk AND c.start = o.start AND c.step <> o.step AND abs(c.step - o.step) <= {_REACH}")
def skipgram_pairs(spark, d):
    tokens = walks(spark, d).select("walk", "start", "step", F.col("node").alias("token"))
    return embedding.context_pairs(tokens, WINDOW, SEED)


# --- datasets -----------------------------------------------------------------------------------------------------

SIZES = f"{EVENT}, sz AS (SELECT count(*) AS m, count(*) * 2 // 10 AS test, least(3 * (count(*) * 2 // 10), count(*) - count(*) * 2 // 10) AS train FROM e), o AS (SELECT e.*, row_number() OVER (ORDER BY ts, eid) AS rn FROM e), pool AS (SELECT o.* FROM o, sz WHERE rn <= m - test)"


def _sample_sql(name: str, size: str) -> str:
    return f"WITH {SIZES}, h AS (SELECT pool.*, row_number() OVER (ORDER BY {sql_uniform(repr(f'{SEED}-{name}'), 'eid')}, eid) AS r FROM pool) SELECT eid, src, dst FROM h, sz WHERE r <= {size}"


@query(f"WITH {SIZES} SELECT train, test AS valid, test FROM sz")
def split_sizes(spark, d):
    s = dataset.split_sizes(event_graph(spark, d).count())
    return spark.createDataFrame([(s["train"], s["valid"], s["test"])], "train long, valid long, test long")


@query(f"WITH {SIZES} SELECT eid, src, dst, ts FROM o, sz WHERE rn > m - test")
def temporal_holdout(spark, d):
    e = event_graph(spark, d)
    return dataset.temporal_holdout(e, dataset.split_sizes(e.count())["test"])[1].select("eid", "src", "dst", "ts")


@query(_sample_sql("train", "train"))
def sample_train(spark, d):
    return dataset.link_dataset(event_graph(spark, d), seed=SEED).where("split = 'train' and label = 1").select("eid", "src", "dst")


@query(_sample_sql("valid", "test"))
def sample_valid(spark, d):
    return dataset.link_dataset(event_graph(spark, d), seed=SEED).where("split = 'valid' and label = 1").select("eid", "src", "dst")


@query(f"""WITH {SIZES}, c AS (SELECT o.eid, r, CASE WHEN {sql_uniform(str(SEED), "'side'", "o.eid")} > 0.5 THEN o.src ELSE CAST(floor({sql_uniform(str(SEED), "'src'", "o.eid", "r")} * 4294967296) AS BIGINT) % n END AS src,
  CAST(floor({sql_uniform(str(SEED), "'dst'", "o.eid", "r")} * 4294967296) AS BIGINT) % n AS dst FROM o, n, sz, (SELECT unnest(range(20)) AS r) WHERE rn > m - test),
l AS (SELECT *, row_number() OVER (PARTITION BY eid ORDER BY r) AS k FROM c WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.src = c.src AND e.dst = c.dst))
SELECT o.eid, l.src, l.dst, l.eid IS NULL AS exhausted FROM o JOIN sz ON rn > m - test LEFT JOIN l ON l.eid = o.eid AND k = 1""")
def negative_samples(spark, d):
    e = event_graph(spark, d)
    test = dataset.temporal_holdout(e, dataset.split_sizes(e.count())["test"])[1]
    return dataset.negatives(test, e, graph.num_nodes(e).first()[0], SEED).select("eid", "src", "dst", "exhausted")


@query(f"WITH {SIZES} SELECT s.split, l.label, CASE s.split WHEN 'train' THEN train ELSE test END AS n FROM sz, (VALUES ('train'), ('valid'), ('test')) s(split), (VALUES (1)) l(label)")
def link_dataset_positives(spark, d):
    return dataset.link_dataset(event_graph(spark, d), seed=SEED).where("label = 1").groupBy("split", "label").agg(F.count("*").alias("n"))


def _draws(name: str) -> str:
    """In SQL, for the split's seed: candidates in order, the first legal one, and a pair of its own for the rest."""
    h = lambda *k: f"CAST(floor({sql_uniform('p.draw', *k)} * 4294967296) AS BIGINT)"
    return f"""{name}c AS (SELECT p.*, r, CASE WHEN {sql_uniform("p.draw", "'side'", "p.eid")} > 0.5 THEN p.src ELSE {h("'src'", "p.eid", "r")} % n END AS s, {h("'dst'", "p.eid", "r")} % n AS t FROM pos p, n, (SELECT unnest(range(20)) AS r)),
{name}l AS (SELECT draw, eid, min({{'r': r, 's': s, 't': t}}) AS c FROM {name}c WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.src = s AND e.dst = t) GROUP BY draw, eid),
free AS (SELECT a.node AS s, list(b.node ORDER BY b.node) AS free FROM v a, v b WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.src = a.node AND e.dst = b.node) GROUP BY a.node),
fs AS (SELECT list(s ORDER BY s) AS fs FROM free),
{name}x AS (SELECT p.draw, p.eid, CASE WHEN {sql_uniform("p.draw", "'side'", "p.eid")} > 0.5 AND list_contains(fs, p.src) THEN p.src ELSE fs[1 + {h("'free source'", "p.eid")} % len(fs)] END AS s FROM pos p, fs WHERE NOT EXISTS (SELECT 1 FROM {name}l l WHERE l.draw = p.draw AND l.eid = p.eid)),
{name} AS (SELECT draw, eid, c.s AS src, c.t AS dst FROM {name}l UNION ALL SELECT p.draw, p.eid, p.s, f.free[1 + {h("'free end'", "p.eid")} % len(f.free)] FROM {name}x p JOIN free f ON f.s = p.s)"""


@query(f"""WITH {SIZES},
ht AS (SELECT pool.*, row_number() OVER (ORDER BY {sql_uniform(repr(f'{SEED}-train'), 'eid')}, eid) AS r FROM pool),
hv AS (SELECT pool.*, row_number() OVER (ORDER BY {sql_uniform(repr(f'{SEED}-valid'), 'eid')}, eid) AS r FROM pool),
pos AS (SELECT 'train' AS split, {SEED} AS draw, eid, src, dst FROM ht, sz WHERE r <= train UNION ALL SELECT 'valid', {SEED + 1}, eid, src, dst FROM hv, sz WHERE r <= test
  UNION ALL SELECT 'test', {SEED + 2}, eid, src, dst FROM o, sz WHERE rn > m - test),
{_draws('neg')}
SELECT split, 1 AS label, eid, src, dst FROM pos UNION ALL SELECT CASE draw WHEN {SEED} THEN 'train' WHEN {SEED + 1} THEN 'valid' ELSE 'test' END, 0, eid, src, dst FROM neg""")
def link_dataset(spark, d):
    return dataset.link_dataset(event_graph(spark, d), seed=SEED)


def _vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("node"), F.col("embedding").alias("emb"))


@query(f"WITH {EVENT} SELECT eid, src, dst, len(list_concat(s.embedding, t.embedding)) AS width, round(CAST(s.embedding[1] AS DOUBLE), 6) AS first, round(CAST(t.embedding[64] AS DOUBLE), 6) AS last FROM e JOIN embeddings s ON s.vec_id = src JOIN embeddings t ON t.vec_id = dst")
def link_features(spark, d):
    v = _vectors(spark, d)
    ids = v.select(F.col("node").alias("src"))
    pairs = event_graph(spark, d).join(ids, "src", "left_semi").join(ids.toDF("dst"), "dst", "left_semi")
    x = dataset.edge_features(pairs.select("eid", "src", "dst"), v)
    return x.select("eid", "src", "dst", F.size("features").alias("width"), F.round(F.element_at("features", 1).cast("double"), 6).alias("first"), F.round(F.element_at("features", -1).cast("double"), 6).alias("last"))


def _labels(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("node"), F.col("c_nationkey").alias("label"))


@query("SELECT c_custkey AS node, c_nationkey AS label, len(embedding) AS width, round(CAST(embedding[1] AS DOUBLE), 6) AS first FROM customer JOIN embeddings ON vec_id = c_custkey")
def node_features(spark, d):
    x = dataset.node_features(_labels(spark, d), _vectors(spark, d))
    return x.select("node", "label", F.size("features").alias("width"), F.round(F.element_at("features", 1).cast("double"), 6).alias("first"))


@query("SELECT node, label FROM (SELECT c_custkey AS node, c_nationkey AS label, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS r FROM customer) WHERE r <= 31")
def label_cap(spark, d):
    return dataset.label_cap(_labels(spark, d), 30).select("node", "label")


@query(f"WITH {EVENT} SELECT c_custkey AS node, c_nationkey AS label FROM customer WHERE c_custkey <= (SELECT max(src) FROM e)")
def connected_labels(spark, d):
    return dataset.connected_labels(_labels(spark, d), event_graph(spark, d))


@query(f"WITH c AS (SELECT c_custkey AS node, c_nationkey AS label, row_number() OVER (ORDER BY {sql_uniform(str(SEED), 'c_custkey')}, c_custkey) AS r, count(*) OVER () AS n FROM customer) SELECT node, label, CASE WHEN r <= n * 6 // 10 THEN 'train' WHEN r <= n * 6 // 10 + n * 2 // 10 THEN 'valid' ELSE 'test' END AS split FROM c")
def label_split(spark, d):
    return dataset.label_split(_labels(spark, d), SEED)


@query("SELECT count(DISTINCT c_nationkey) + CASE WHEN max(CASE WHEN c_nationkey = 0 THEN 1 ELSE 0 END) = 1 THEN 0 ELSE 1 END AS classes FROM customer")
def class_count(spark, d):
    return dataset.class_count(_labels(spark, d))


@query("SELECT vec_id AS node, label FROM embeddings")
def one_hot_label(spark, d):
    x = table(spark, d, "embeddings").select(F.col("vec_id").alias("node"), F.transform(F.sequence(F.lit(0), F.lit(9)), lambda k: (k == F.col("label")).cast("int")).alias("hot"))
    return x.select("node", graphs.one_hot_label(F.col("hot")).alias("label"))


# --- generators ---------------------------------------------------------------------------------------------------

_BITS = lambda end, n: f"CAST(floor({sql_uniform('42', repr(end), 'id')} * 4294967296) AS BIGINT) % {n}"


@query(f"SELECT id AS eid, {_BITS('src', 256)} AS src, {_BITS('dst', 256)} AS dst FROM (SELECT unnest(range(4096)) AS id)")
def uniform_edges(spark, d):
    return generators.uniform_edges(spark, 8)


@query(f"""WITH l AS (SELECT id, k, {sql_uniform('42', "'q'", 'id', 'k')} AS u FROM (SELECT unnest(range(4096)) AS id), (SELECT unnest(range(8)) AS k)),
x AS (SELECT id AS eid, CAST(sum(CASE WHEN u >= 0.57::DOUBLE + 0.19::DOUBLE THEN 1 << (7 - k) ELSE 0 END) AS BIGINT) AS s,
  CAST(sum(CASE WHEN u >= 0.57::DOUBLE AND u < 0.57::DOUBLE + 0.19::DOUBLE OR u >= 0.57::DOUBLE + 0.19::DOUBLE + 0.19::DOUBLE THEN 1 << (7 - k) ELSE 0 END) AS BIGINT) AS t FROM l GROUP BY id),
p AS (SELECT id, row_number() OVER (ORDER BY {sql_uniform('42', "'p'", 'id')}, id) - 1 AS new FROM (SELECT unnest(range(256)) AS id))
SELECT eid, a.new AS src, b.new AS dst FROM x JOIN p a ON a.id = s JOIN p b ON b.id = t""")
def rmat_edges(spark, d):
    return generators.rmat_edges(spark, 8).select("eid", "src", "dst")


@query(f"""WITH x AS (SELECT id, CAST(floor({sql_uniform('42', "'a'", 'id')} * 4294967296) AS BIGINT) % 200 AS a, CAST(floor({sql_uniform('42', "'b'", 'id')} * 4294967296) AS BIGINT) % 200 AS b FROM (SELECT unnest(range(4000)) AS id)),
p AS (SELECT least(a, b) AS src, greatest(a, b) AS dst, min(id) AS eid FROM x WHERE a <> b GROUP BY least(a, b), greatest(a, b))
SELECT eid, src, dst, floor(1000 * {sql_uniform('42', "'t'", 'eid')}) / CAST(1000 AS DOUBLE) AS ts FROM p ORDER BY eid LIMIT 1000""")
def synthetic_temporal(spark, d):
    return generators.synthetic_temporal(spark, 200, 1000)


# --- models and metrics -------------------------------------------------------------------------------------------

BINARY = f"b AS (SELECT CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS y, round({sql_uniform('7', 'l_orderkey', 'l_linenumber')}, 3) AS p FROM lineitem)"
CLASSES = f"c AS (SELECT o_orderstatus AS y, CASE CAST(floor({sql_uniform('7', 'o_orderkey')} * 4294967296) AS BIGINT) % 3 WHEN 0 THEN 'F' WHEN 1 THEN 'O' ELSE 'P' END AS predicted FROM orders)"
PER_CLASS = f"{CLASSES}, l AS (SELECT y AS label FROM c UNION SELECT predicted FROM c), k AS (SELECT label, count(*) FILTER (WHERE y = label AND predicted = label) AS tp, count(*) FILTER (WHERE y <> label AND predicted = label) AS fp, count(*) FILTER (WHERE y = label AND predicted <> label) AS fn FROM l, c GROUP BY label)"


def _binary(spark, d):
    return table(spark, d, "lineitem").select((F.col("l_returnflag") == "R").cast("int").alias("y"), F.round(uniform(7, F.col("l_orderkey"), F.col("l_linenumber")), 3).alias("p"))


def _classes(spark, d):
    k = F.pmod(uniform32(7, F.col("o_orderkey")), F.lit(3))
    return table(spark, d, "orders").select(F.col("o_orderstatus").alias("y"), F.when(k == 0, "F").when(k == 1, "O").otherwise("P").alias("predicted"))


@query(f"WITH {CLASSES} SELECT y, predicted, count(*) AS n FROM c GROUP BY y, predicted")
def confusion_matrix(spark, d):
    return metrics.confusion(_classes(spark, d))


@query(f"WITH {BINARY} SELECT round(avg(CASE WHEN (p > 0.5) = (y = 1) THEN 1.0 ELSE 0.0 END), 9) AS accuracy FROM b")
def accuracy(spark, d):
    return metrics.accuracy(metrics.rounded(_binary(spark, d))).select(F.round("accuracy", 9).alias("accuracy"))


@query(f"WITH {PER_CLASS} SELECT round(avg(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END), 9) AS precision, round(avg(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END), 9) AS recall, round(avg(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END), 9) AS f1 FROM k")
def macro_prf(spark, d):
    return metrics.macro(_classes(spark, d)).select(*(F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")))


@query(f"WITH {PER_CLASS} SELECT round(sum(tp) / (sum(tp) + sum(fp)), 9) AS precision, round(sum(tp) / (sum(tp) + sum(fn)), 9) AS recall, round(2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)), 9) AS f1 FROM k")
def micro_prf(spark, d):
    return metrics.micro(_classes(spark, d)).select(*(F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")))


@query(f"WITH {BINARY}, r AS (SELECT y, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS r FROM b) SELECT round((sum(r) FILTER (WHERE y = 1) - CAST(sum(y) AS DOUBLE) * (sum(y) + 1) / 2) / (CAST(sum(y) AS DOUBLE) * sum(1 - y)), 9) AS auc FROM r")
def roc_auc(spark, d):
    return metrics.roc_auc(_binary(spark, d)).select(F.round("auc", 9).alias("auc"))


@query(f"WITH {BINARY}, t AS (SELECT p, sum(y) AS a, sum(1 - y) AS b FROM b GROUP BY p) SELECT p AS threshold, round(sum(b) OVER (ORDER BY p DESC) / sum(b) OVER (), 9) AS fpr, round(sum(a) OVER (ORDER BY p DESC) / sum(a) OVER (), 9) AS tpr FROM t")
def roc_curve(spark, d):
    return metrics.roc_curve(_binary(spark, d)).select("threshold", F.round("fpr", 9).alias("fpr"), F.round("tpr", 9).alias("tpr"))


@query(f"WITH {BINARY} SELECT round(-avg(CASE WHEN y = 1 THEN ln(greatest(1e-12, least(1 - 1e-12, p))) ELSE ln(1 - greatest(1e-12, least(1 - 1e-12, p))) END), 9) AS log_loss FROM b")
def log_loss(spark, d):
    return metrics.log_loss(_binary(spark, d)).select(F.round("log_loss", 9).alias("log_loss"))


_WEIGHTS = [((i * 37) % 11 - 5) / 10 for i in range(64)]


@query(f"SELECT vec_id AS node, round(1 / (1 + exp(-(list_sum(list_transform(range(1, 65), lambda i: CAST(embedding[i] AS DOUBLE) * ({_WEIGHTS}::DOUBLE[])[i])) + 0.1))), 9) AS p FROM embeddings")
def link_score_fixed_weights(spark, d):
    return _vectors(spark, d).select("node", F.round(models.logistic(F.col("emb"), _WEIGHTS, 0.1), 9).alias("p"))


@query()
def node_embeddings(spark, d):
    p = Params(num_walks_per_node=4, walk_length=5, seed=SEED, node_embedding_dim=16)
    return pipelines.embed(event_graph(spark, d), p, 1, pipelines.Timings())


@query()
def link_prediction_accuracy(spark, d):
    p = Params(num_walks_per_node=4, walk_length=5, node_embedding_dim=8, hidden_dim=32, batch_size=1024, learning_rate=0.05, num_epochs=10, target=1.0, seed=SEED)
    return metrics.accuracy(pipelines.link_prediction(event_graph(spark, d), p))


@query()
def node_classification_accuracy(spark, d):
    e = event_graph(spark, d)
    nodes = graph.vertices(e).withColumn("label", F.pmod(F.col("node"), F.lit(3)).cast("int"))
    p = Params(num_walks_per_node=4, walk_length=5, node_embedding_dim=16, hidden_dim_1=32, hidden_dim_2=16, batch_size=16, learning_rate=0.005, num_epochs=10, target=1.0, seed=SEED)
    return metrics.accuracy(pipelines.node_classification(e, dataset.label_split(nodes, SEED), p, epochs=1))


def _k_means_sql(k: int, rounds: int) -> str:
    sql = f"WITH x AS (SELECT vec_id AS node, i, CAST(embedding[i] AS DOUBLE) AS v FROM embeddings, (SELECT unnest(range(1, 65)) AS i)), c0 AS (SELECT vec_id AS node, vec_id % {k} AS cluster FROM embeddings)"
    for r in range(1, rounds + 1):
        sql += f""",
m{r} AS (SELECT cluster, i, avg(v) AS m FROM x JOIN c{r - 1} USING (node) GROUP BY cluster, i),
u{r} AS (SELECT cluster, i, m / greatest(sqrt(sum(m * m) OVER (PARTITION BY cluster)), 1e-12) AS m FROM m{r}),
d{r} AS (SELECT x.node, cluster, sum(v * m) AS dot FROM x JOIN u{r} USING (i) GROUP BY x.node, cluster),
c{r} AS (SELECT node, CAST(cluster AS INTEGER) AS cluster FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY dot DESC, cluster) AS k FROM d{r}) WHERE k = 1)"""
    return f"{sql} SELECT node, cluster FROM c{rounds}"


@query(_k_means_sql(5, 10))
def kmeans_clusters(spark, d):
    return embedding.k_means(_vectors(spark, d), 5)


_HIDDEN = 6


@query(f"""WITH {EVENT}, f AS (SELECT eid, list_concat(s.embedding, t.embedding) AS f FROM e JOIN embeddings s ON s.vec_id = src JOIN embeddings t ON t.vec_id = dst),
h AS (SELECT eid, h, greatest(list_sum(list_transform(range(1, 129), lambda i: CAST(f[i] AS DOUBLE) * (((i - 1) * 37 + h * 11) % 23 - 11) / 20)) + (h - 2) / CAST(10 AS DOUBLE), 0) AS a FROM f, (SELECT unnest(range({_HIDDEN})) AS h))
SELECT eid, round(1 / (1 + exp(-(sum(a * (h * 7 % 5 - 2) / 3) + 0.25))), 9) AS p, CAST(1 / (1 + exp(-(sum(a * (h * 7 % 5 - 2) / 3) + 0.25))) > 0.5 AS INTEGER) AS predicted FROM h GROUP BY eid""")
def link_mlp_fixed_weights(spark, d):
    """The two-layer link network, its weights given by a rule, over all edges with vectors."""
    import numpy as np

    net = models.Network([128, _HIDDEN, 1], "link")
    i, h = np.arange(128)[:, None], np.arange(_HIDDEN)[None, :]
    net.weights = [((i * 37 + h * 11) % 23 - 11) / 20, ((np.arange(_HIDDEN) * 7 % 5 - 2) / 3)[:, None]]
    net.biases = [(np.arange(_HIDDEN) - 2) / 10, np.array([0.25])]
    v = _vectors(spark, d)
    ids = v.select(F.col("node").alias("src"))
    pairs = event_graph(spark, d).join(ids, "src", "left_semi").join(ids.toDF("dst"), "dst", "left_semi").select("eid", "src", "dst")
    return models.predictions(dataset.edge_features(pairs, v), net).select("eid", F.round("p", 9).alias("p"), "predicted")


@query("""WITH s AS (SELECT label = k AS y, k AS label, embedding[k + 1] AS p FROM embeddings, (SELECT unnest(range(10)) AS k)),
r AS (SELECT label, y, rank() OVER (PARTITION BY label ORDER BY p) + (count(*) OVER (PARTITION BY label, p) - 1) / 2.0 AS r FROM s),
t AS (SELECT label, CAST(count(*) FILTER (WHERE y) AS DOUBLE) AS a, CAST(count(*) FILTER (WHERE NOT y) AS DOUBLE) AS b, sum(r) FILTER (WHERE y) AS w FROM r GROUP BY label)
SELECT CAST(label AS INTEGER) AS label, CASE WHEN a * b > 0 THEN round((w - a * (a + 1) / 2) / (a * b), 9) END AS auc FROM t""")
def one_vs_rest_auc(spark, d):
    x = table(spark, d, "embeddings").select(F.col("label").alias("y"), F.slice("embedding", 1, 10).alias("scores"))
    return metrics.one_vs_rest_auc(x).select("label", F.round("auc", 9).alias("auc"))


# --- files --------------------------------------------------------------------------------------------------------


def _file(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{uuid.uuid4().hex[:12]}/{name}"


def _as_text(lines: DataFrame, path: str) -> str:
    """(key, line) rows as a folder of files in key order."""
    lines.repartitionByRange("key").sortWithinPartitions("key").select("line").write.text(path)
    return path


def _head(spark: SparkSession, *lines: str) -> DataFrame:
    return spark.createDataFrame([(i - len(lines), x) for i, x in enumerate(lines)], "key long, line string")


_TIMED = f"WITH {EVENT} SELECT src, dst, ts FROM e"
_PAIRS = f"WITH {EVENT} SELECT src, dst FROM e"


@query(_TIMED)
def file_wel(spark, d):
    path = _file(spark, "g.wel")
    sinks.write_edges(event_graph(spark, d), path)
    return graphs.load(spark, path).select("src", "dst", "ts")


@query(_PAIRS)
def file_el(spark, d):
    path = _file(spark, "g.el")
    sinks.write_edges(event_graph(spark, d), path, weighted=False)
    return graphs.read(spark, path).select("src", "dst")


@query(f"WITH {EVENT} SELECT eid, src, dst, ts FROM e")
def file_parquet(spark, d):
    path = _file(spark, "g.parquet")
    sinks.write_graph(event_graph(spark, d), path)
    return graphs.read(spark, path)


@query(_TIMED)
def file_gr(spark, d):
    e = event_graph(spark, d).select(F.col("eid").alias("key"), F.concat_ws(" ", F.lit("a"), F.col("src") + 1, F.col("dst") + 1, F.col("ts").cast("string")).alias("line"))
    return graphs.read(spark, _as_text(_head(spark, "c a comment", "p sp 1 1").union(e), _file(spark, "g.gr"))).select("src", "dst", "ts")


@query(_TIMED)
def file_metis(spark, d):
    """Vertex lines of neighbours and weights, with a comment and blank lines of vertices without neighbours."""
    e = event_graph(spark, d)
    n = graph.num_nodes(e).first()[0]
    one = F.concat_ws(" ", F.col("dst") + 1, F.col("ts").cast("string"))
    rows = graph.vertices(e).join(e.groupBy(F.col("src").alias("node")).agg(F.array_join(F.collect_list(one), " ").alias("line")), "node", "left")
    rows = rows.select(F.col("node").alias("key"), F.coalesce("line", F.lit("")).alias("line"))
    return graphs.read(spark, _as_text(_head(spark, "% a comment", f"{n} {e.count()} 1").union(rows), _file(spark, "g.graph"))).select("src", "dst", "ts")


@query(f"WITH {EVENT} SELECT src, dst, ts FROM e UNION ALL SELECT dst, src, ts FROM e")
def file_mtx(spark, d):
    e = event_graph(spark, d)
    n = graph.num_nodes(e).first()[0]
    rows = e.select(F.col("eid").alias("key"), F.concat_ws(" ", F.col("src") + 1, F.col("dst") + 1, F.col("ts").cast("string")).alias("line"))
    head = _head(spark, "%%MatrixMarket matrix coordinate real symmetric", "% a comment", f"{n} {n} {e.count()}")
    return graphs.read(spark, _as_text(head.union(rows), _file(spark, "g.mtx"))).select("src", "dst", "ts")


@query(f"WITH {EVENT} SELECT src, dst, CAST(floor(ts * 1000000) AS DOUBLE) AS ts FROM e")
def file_raw_temporal(spark, d):
    """Lines of three and of four numbers."""
    t = F.floor(F.col("ts") * 1000000).cast("string")
    line = F.when(F.col("eid") % 2 == 0, F.concat_ws(" ", "src", "dst", t)).otherwise(F.concat_ws(",", "src", "dst", F.lit("1"), t))
    path = _as_text(event_graph(spark, d).select(F.col("eid").alias("key"), line.alias("line")), _file(spark, "g.txt"))
    return graphs.read_raw_temporal(spark, path).select("src", "dst", "ts")


@query("SELECT c_custkey AS node, c_nationkey AS label FROM customer")
def file_labels(spark, d):
    rows = _labels(spark, d).select(F.col("node").alias("key"), F.concat_ws("\t", F.col("node"), F.col("label")).alias("line"))
    return graphs.read_labels(spark, _as_text(rows, _file(spark, "labels.tsv")))


@query("SELECT count(*) AS lines FROM customer")
def file_row_count(spark, d):
    rows = _labels(spark, d).select(F.col("node").alias("key"), F.col("label").cast("string").alias("line"))
    return spark.createDataFrame([(graphs.row_count(spark, _as_text(rows, _file(spark, "labels.tsv"))),)], "lines long")


@query(f"WITH {_walk_sql(STEPS)} SELECT start, step, CAST(node AS VARCHAR) AS token FROM steps WHERE walk = 1")
def file_walks(spark, d):
    """A walk corpus written and read back; a sentence's first token is its start."""
    path = _file(spark, "walks.txt")
    sinks.write_walks(walks(spark, d).where("walk = 1"), path)
    x = graphs.read_tokens(spark, path)
    first = x.where("step = 0").select("sentence", F.col("token").cast("long").alias("start"))
    return x.join(first, "sentence").select("start", "step", "token")


@query(f"WITH {VOCAB} SELECT token, cn FROM c WHERE token <> '</s>'")
def file_vocabulary(spark, d):
    path = _file(spark, "vocabulary")
    steps = walks(spark, d)
    sinks.write_vocabulary(embedding.vocabulary(steps.select(F.col("node").cast("string").alias("token"))), path)
    return graphs.read_vocabulary(spark, path)


@query("SELECT vec_id AS node, len(embedding) AS width, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 4) AS total FROM embeddings")
def file_embeddings(spark, d):
    path = _file(spark, "vectors")
    sinks.write_embeddings(_vectors(spark, d), path)
    n, width = (int(v) for v in spark.read.text(f"{path}-header").first()[0].split())
    x = spark.read.text(path).select(F.split("value", " ").alias("p"))
    numbers = F.transform(F.slice("p", 2, width), lambda v: v.cast("double"))
    return x.select(F.get("p", F.lit(0)).cast("long").alias("node"), F.size(numbers).alias("width"), F.round(F.aggregate(numbers, F.lit(0.0), lambda s, v: s + v), 4).alias("total")).limit(n)


@query(f"WITH c AS (SELECT c_custkey AS node, c_nationkey AS label, row_number() OVER (ORDER BY {sql_uniform(str(SEED), 'c_custkey')}, c_custkey) AS r, count(*) OVER () AS n FROM customer) SELECT node, label, CASE WHEN r <= n * 6 // 10 THEN 'train' WHEN r <= n * 6 // 10 + n * 2 // 10 THEN 'valid' ELSE 'test' END AS split FROM c")
def file_node_splits(spark, d):
    path = _file(spark, "splits")
    sinks.write_splits(dataset.label_split(_labels(spark, d), SEED), path)
    return spark.read.schema("node long, label int, split string").csv(path, sep=" ")


@query(ORACLES["link_dataset"])
def file_link_splits(spark, d):
    """The lists of a link dataset written and read back, with the edge ids of the dataset they hold."""
    path = _file(spark, "lists")
    data = dataset.link_dataset(event_graph(spark, d), seed=SEED)
    sinks.write_link_splits(data, path)
    x = spark.read.schema("src long, dst long, list string").csv(path, sep=" ")
    x = x.select(F.substring_index("list", "_", 1).alias("split"), F.endswith("list", F.lit("_p")).cast("int").alias("label"), "src", "dst").distinct()
    return data.join(x, ["split", "label", "src", "dst"]).select("split", "label", "eid", "src", "dst")


@query(f"WITH {EVENT} SELECT src, src || ': ' || array_to_string(list(CAST(dst AS VARCHAR) ORDER BY ts, dst, eid), ' ') AS line FROM e GROUP BY src")
def graph_topology(spark, d):
    return sinks.topology(graph.adjacency(event_graph(spark, d)))


def entry(spark: SparkSession, d: str) -> DataFrame:
    """One-step temporal transitions on the event graph."""
    return walk_one_step(spark, d)
