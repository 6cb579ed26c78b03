"""Queries of the joins, the set operations and the splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ostinato.operators import joins, ranges, sequence, splits
from ostinato.plans.common import LINES_SQL, WORDS_SQL, lines, query, table, words

#: Events in order, cut in fours: as many places as an order of four lines has.
EVENT_POS_SQL = "ev AS (SELECT event_id, (row_number() OVER (ORDER BY event_id) - 1) // 4 AS k, ((row_number() OVER (ORDER BY event_id) - 1) % 4)::INTEGER AS pos FROM events)"


def event_fours(spark, sf_dir):
    """(k, pos, event_id): all events by their ids, which run from 1, cut in fours."""
    rows = table(spark, sf_dir, "events").select("event_id")
    lowest = rows.agg(F.min("event_id").alias("_least"))
    return rows.crossJoin(F.broadcast(lowest)).select(F.expr("(event_id - _least) div 4").alias("k"), ((F.col("event_id") - F.col("_least")) % 4).cast("int").alias("pos"), "event_id")


@query("q_positional_join", f"""WITH {LINES_SQL}, {EVENT_POS_SQL}, l AS (SELECT l_orderkey AS k, pos, l_partkey FROM lines),
n AS (SELECT k, count(*) FILTER (side = 'l') AS a, count(*) FILTER (side = 'r') AS b FROM (SELECT k, 'l' AS side FROM l UNION ALL SELECT k, 'r' FROM ev) GROUP BY k)
SELECT l.k, l.pos, l_partkey, event_id FROM l JOIN ev ON l.k = ev.k AND l.pos = ev.pos JOIN n ON n.k = l.k AND a = b""")
def positional_join(spark, sf_dir):
    left = lines(spark, sf_dir).select(F.col("l_orderkey").alias("k"), "pos", "l_partkey")
    return joins.positional(left, event_fours(spark, sf_dir), ["k"], "pos")[0].select("k", "pos", "l_partkey", "event_id")


@query("q_count_guard", f"""WITH {EVENT_POS_SQL}, n AS (SELECT k, count(*) FILTER (side = 'l') AS n_left, count(*) FILTER (side = 'r') AS n_right FROM
    (SELECT l_orderkey AS k, 'l' AS side FROM lineitem UNION ALL SELECT k, 'r' FROM ev) GROUP BY k) SELECT k, n_left, n_right FROM n WHERE n_left <> n_right""")
def count_guard(spark, sf_dir):
    left = lines(spark, sf_dir).select(F.col("l_orderkey").alias("k"), "pos", "l_partkey")
    return joins.positional(left, event_fours(spark, sf_dir), ["k"], "pos")[1].select("k", "n_left", "n_right")


@query("q_span_join", f"""WITH {LINES_SQL}, t AS (SELECT l_orderkey, pos, CASE WHEN pos % 3 = 2 THEN -1 ELSE pos END AS span FROM lines)
SELECT t.l_orderkey, t.pos, coalesce(v.l_discount, 1.0) AS a, coalesce(v.l_tax, 0.5) AS b FROM t LEFT JOIN lines v ON v.l_orderkey = t.l_orderkey AND v.pos = t.span""")
def span_join(spark, sf_dir):
    rows = lines(spark, sf_dir)
    tokens = rows.select("l_orderkey", "pos", F.when(F.col("pos") % 3 == 2, -1).otherwise(F.col("pos")).alias("span"))
    vectors = rows.select("l_orderkey", F.col("pos").alias("span"), F.col("l_discount").alias("a"), F.col("l_tax").alias("b"))
    return joins.on_spans(tokens, vectors, ["l_orderkey"], "span", {"a": 1.0, "b": 0.5}).select("l_orderkey", "pos", "a", "b")


@query("q_pairing_counters", """SELECT CASE WHEN l.doc_id IS NULL THEN 'no_first' WHEN b.item_id IS NULL THEN 'no_second' ELSE 'paired' END AS status, count(*) AS n
FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id) LEFT JOIN (SELECT DISTINCT item_id FROM benchmark) b ON b.item_id = d.doc_id GROUP BY 1""")
def pairing_counters(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"))
    return joins.pairing_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), items, "doc_id")


@query("q_type_parity", """WITH own AS (SELECT DISTINCT p_type, p_size FROM part), base AS (SELECT p_size FROM own WHERE p_type = 'ECONOMY'), g AS (SELECT DISTINCT p_type FROM own WHERE p_type <> 'ECONOMY')
SELECT g.p_type, (SELECT count(*) FROM base b WHERE NOT EXISTS (SELECT 1 FROM own o WHERE o.p_type = g.p_type AND o.p_size = b.p_size)) AS missing,
    (SELECT count(*) FROM own o WHERE o.p_type = g.p_type AND o.p_size NOT IN (SELECT p_size FROM base)) AS extra FROM g""")
def type_parity(spark, sf_dir):
    return joins.set_parity(table(spark, sf_dir, "part"), "p_type", "p_size", "ECONOMY")


@query("q_normalised_name_join", """WITH n AS (SELECT regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') AS name, arg_max(p_brand, p_partkey) AS brand FROM part GROUP BY 1)
SELECT p.p_partkey, n.brand FROM part p LEFT JOIN n ON n.name = regexp_replace(lower(p.p_name), '[^a-z0-9]', '', 'g')""")
def normalised_name_join(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    names = part.select(F.upper(F.replace("p_name", F.lit(" "), F.lit("-"))).alias("other_name"), F.col("p_brand").alias("brand"), F.col("p_partkey").alias("nth"))
    return joins.by_name(part, names, "p_name", "other_name", "brand", "nth").select("p_partkey", "brand")


@query("q_nearest_reference", """WITH u AS (SELECT vec_id, label, generate_subscripts(embedding, 1) AS k, unnest(embedding)::DOUBLE AS x FROM embeddings), c AS (SELECT label, k, round(avg(x), 9) AS c FROM u GROUP BY 1, 2),
d AS (SELECT vec_id, c.label, sum((x - c) ** 2) AS d FROM u JOIN c USING (k) GROUP BY 1, 2) SELECT vec_id, 'ref' || arg_min(label, (d, label)) AS nearest, round(sqrt(min(d)), 6) AS distance FROM d GROUP BY vec_id""")
def nearest_reference(spark, sf_dir):
    """The nearest centre of a label, over all dimensions."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    each = rows.select("label", F.posexplode("v").alias("k", "x")).groupBy("label", "k").agg(F.round(F.avg("x"), 9).alias("c"))
    centres = each.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "c"))), lambda r: r["c"]).alias("v")).withColumn("name", F.concat(F.lit("ref"), F.col("label").cast("string")))
    return joins.nearest_reference(rows, centres, "v", "label", "name").select("vec_id", "nearest", F.round("distance", 6).alias("distance"))


@query("q_fragment_resolve", """SELECT f.fragment, arg_min(p_name, (length(p_name), p_name)) AS p_name FROM (SELECT DISTINCT split_part(p_name, ' ', 1) AS fragment FROM part) f JOIN part ON contains(p_name, fragment) GROUP BY 1""")
def fragment_resolve(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    fragments = part.select(F.split("p_name", " ")[0].alias("fragment")).distinct()
    return joins.resolve_fragments(fragments, part.select("p_name"), "fragment", "p_name")


@query("q_compare_in_order", f"""WITH {LINES_SQL}, a AS (SELECT l_orderkey, pos, l_partkey % 5 AS v FROM lines), b AS (SELECT l_orderkey, (pos - 1)::INTEGER AS pos, l_partkey % 5 AS v FROM lines WHERE pos > 0)
SELECT l_orderkey, count(*) AS n, count(*) FILTER (a.v = b.v) AS matches, round(count(*) FILTER (a.v = b.v) / count(*)::DOUBLE * 100, 6) AS accuracy FROM a JOIN b USING (l_orderkey, pos) GROUP BY 1""")
def compare_in_order(spark, sf_dir):
    rows = lines(spark, sf_dir).select("l_orderkey", "pos", (F.col("l_partkey") % 5).alias("v"))
    made = joins.compare_in_order(rows, rows.where("pos > 0").withColumn("pos", F.col("pos") - 1), ["l_orderkey"], "pos", "v")
    return made.select("l_orderkey", "n", "matches", F.round("accuracy", 6).alias("accuracy"))


@query("q_side_by_side", f"""WITH {LINES_SQL} SELECT coalesce(a.l_orderkey, b.l_orderkey) AS l_orderkey, coalesce(a.pos, b.p)::INTEGER AS pos, a.l_partkey AS "left", b.l_suppkey AS "right"
FROM lines a FULL JOIN (SELECT *, pos + 1 AS p FROM lines) b ON a.l_orderkey = b.l_orderkey AND a.pos = b.p""")
def side_by_side(spark, sf_dir):
    rows = lines(spark, sf_dir)
    return joins.side_by_side(rows.select("l_orderkey", "pos", F.col("l_partkey").alias("v")), rows.select("l_orderkey", (F.col("pos") + 1).alias("pos"), F.col("l_suppkey").alias("v")), ["l_orderkey"], "pos", "v")


@query("q_resume", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def resume(spark, sf_dir):
    done = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return joins.still_to_do(table(spark, sf_dir, "orders").select("o_orderkey"), done, "o_orderkey")


@query("q_first_of_type", "SELECT p_type, p_partkey, p_name FROM (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY p_partkey) AS n FROM part) WHERE n = 1")
def first_of_type(spark, sf_dir):
    return joins.first_of_each(table(spark, sf_dir, "part"), ["p_type"], ["p_partkey"]).select("p_type", "p_partkey", "p_name")


@query("q_first_n", "SELECT p_type, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice, p_partkey) AS r FROM part) WHERE r <= 5")
def first_n(spark, sf_dir):
    return joins.first_n_of_each(table(spark, sf_dir, "part"), ["p_type"], ["p_retailprice", "p_partkey"], 5).select("p_type", "p_partkey")


@query("q_smallest_n", "SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice, p_partkey LIMIT 10")
def smallest_n(spark, sf_dir):
    return table(spark, sf_dir, "part").orderBy("p_retailprice", "p_partkey").select("p_partkey", "p_retailprice").limit(10)


@query("q_vocab_ids", f"""WITH {WORDS_SQL}, v AS (SELECT word, (row_number() OVER (ORDER BY word) - 1)::INTEGER AS id FROM (SELECT DISTINCT word FROM w))
SELECT v.id, count(*) AS n FROM w JOIN v USING (word) GROUP BY 1""")
def vocab_ids(spark, sf_dir):
    """Ids are places in the order of words."""
    counted = words(spark, sf_dir).groupBy("word").agg(F.count("*").alias("n"))
    return ranges.numbered(counted, ["word"], "id")[0].select(F.col("id").cast("int").alias("id"), "n")


@query("q_positional_split", "SELECT o_orderstatus, CASE WHEN row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) <= 100 THEN 'first' ELSE 'second' END AS split, o_orderkey FROM orders")
def positional_split(spark, sf_dir):
    return splits.positional_split(table(spark, sf_dir, "orders"), ["o_orderstatus"], ["o_orderkey"], 100).select("o_orderstatus", "split", "o_orderkey")


@query("q_topk_filter", "SELECT user_id, event_id FROM (SELECT *, rank() OVER (PARTITION BY user_id ORDER BY value DESC) AS r FROM events) WHERE r <= 5")
def topk_filter(spark, sf_dir):
    return splits.top_k_filter(table(spark, sf_dir, "events"), ["user_id"], "value", 5).select("user_id", "event_id")


@query("q_nucleus", """WITH e AS (SELECT *, exp(value / 50 - max(value / 50) OVER (PARTITION BY user_id)) AS x FROM events), p AS (SELECT *, x / sum(x) OVER (PARTITION BY user_id) AS prob FROM e),
c AS (SELECT user_id, event_id, round(sum(prob) OVER (PARTITION BY user_id ORDER BY value DESC, event_id ROWS UNBOUNDED PRECEDING) - prob, 9) AS before FROM p) SELECT user_id, event_id FROM c WHERE before < 0.9""")
def nucleus(spark, sf_dir):
    df = table(spark, sf_dir, "events").withColumn("logit", F.col("value") / 50)
    return splits.nucleus(df, ["user_id"], "logit", ["event_id"], 0.9).select("user_id", "event_id")


@query("q_nucleus_shifted", """WITH e AS (SELECT *, exp(value / 50 - max(value / 50) OVER (PARTITION BY event_type)) AS x FROM events), p AS (SELECT *, x / sum(x) OVER (PARTITION BY event_type) AS prob FROM e),
c AS (SELECT event_type, event_id, round(sum(prob) OVER (PARTITION BY event_type ORDER BY value DESC, event_id ROWS UNBOUNDED PRECEDING) - prob, 9) AS before FROM p) SELECT event_type, event_id FROM c WHERE before <= 0.5""")
def nucleus_shifted(spark, sf_dir):
    """Few groups, each of which has a great part of all events."""
    df = table(spark, sf_dir, "events").withColumn("logit", F.col("value") / 50)
    return splits.nucleus(df, ["event_type"], "logit", ["event_id"], 0.5, shifted=True).select("event_type", "event_id")


@query("q_running_values", """SELECT event_id, count(*) OVER w AS nth, round(sum(value) OVER w, 4) AS total, max(value) OVER w AS most, min(value) OVER w AS least, last_value(CASE WHEN event_type = 'error' THEN event_id END IGNORE NULLS) OVER w AS last_error
FROM events WINDOW w AS (PARTITION BY event_type = 'click' ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""")
def running_values(spark, sf_dir):
    """Running values of two sequences that hold all events."""
    df = table(spark, sf_dir, "events").select("event_id", "ts", "value", "event_type", (F.col("event_type") == "click").alias("clicked"))
    values = {"nth": ("count", F.lit(1)), "total": ("sum", F.col("value")), "most": ("max", F.col("value")), "least": ("min", F.col("value")), "last_error": ("last", F.when(F.col("event_type") == "error", F.col("event_id")))}
    return ranges.running(df, ["clicked"], ["ts", "event_id"], values).select("event_id", "nth", F.round("total", 4).alias("total"), "most", "least", "last_error")


SEEDED = "('0x' || substr(md5('{seed}|' || {key}), 1, 15))::BIGINT"


@query("q_split_hash", f"""WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY {SEEDED.format(seed=42, key='o_orderkey')}, o_orderkey) AS r, count(*) OVER () AS n FROM orders)
SELECT o_orderkey, CASE WHEN r <= greatest(1, floor(n * 0.02)) THEN 'validation' ELSE 'train' END AS split FROM r""")
def split_hash(spark, sf_dir):
    """Exactly two percent of the orders are for validation."""
    return splits.exact_split(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 0.02)


@query("q_sample_per_group", f"""SELECT p_type, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY {SEEDED.format(seed=7, key='p_partkey')}, p_partkey) AS r FROM part) WHERE r <= 30""")
def sample_per_group(spark, sf_dir):
    return splits.sample_per_group(table(spark, sf_dir, "part").select("p_type", "p_partkey"), "p_type", "p_partkey", 30)


@query("q_set_union", "SELECT name, kind FROM (SELECT n_name AS name, 'nation' AS kind FROM nation UNION SELECT r_name, 'region' FROM region UNION SELECT DISTINCT p_brand, 'brand' FROM part)")
def set_union(spark, sf_dir):
    named = lambda t, c, kind: table(spark, sf_dir, t).select(F.col(c).alias("name"), F.lit(kind).alias("kind"))
    return named("nation", "n_name", "nation").unionByName(named("region", "r_name", "region")).unionByName(named("part", "p_brand", "brand")).distinct()
