"""Queries of statistics and checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ostinato.functions import music
from ostinato.operators import joins, moments, quality, sequence
from ostinato.plans.common import TOKENS_SQL, WORDS_SQL, query, table, tokens, words


@query("q_token_frequency", f"WITH {WORDS_SQL} SELECT word, count(*) AS n FROM w GROUP BY word ORDER BY n DESC, word LIMIT 20")
def token_frequency(spark, sf_dir):
    return quality.frequencies(words(spark, sf_dir), "word", 20)


@query("q_top30_pct", f"WITH {WORDS_SQL}, c AS (SELECT word, count(*) AS n FROM w WHERE length(word) > 1 GROUP BY word) SELECT word, n, round(n * 100 / (SELECT sum(n) FROM c)::DOUBLE, 6) AS pct FROM c ORDER BY n DESC, word LIMIT 30")
def top30_pct(spark, sf_dir):
    return quality.top_with_share(words(spark, sf_dir), "word", 30, F.length("word") <= 1)


CATEGORY_SQL = "CASE WHEN word = '' THEN 'empty' WHEN regexp_matches(word, '^[0-9]') THEN 'number' WHEN regexp_matches(word, '^[A-Z]') THEN 'capital' WHEN regexp_matches(word, '^[a-z]') THEN 'lower' ELSE 'other' END"


@query("q_category_distribution", f"WITH {WORDS_SQL}, c AS (SELECT {CATEGORY_SQL} AS category, count(*) AS n, count(DISTINCT word) AS n_distinct FROM w GROUP BY 1) SELECT category, n, n_distinct, round(n * 100 / (SELECT sum(n) FROM c)::DOUBLE, 6) AS pct FROM c")
def category_distribution(spark, sf_dir):
    category = F.when(F.col("word") == "", "empty").when(F.col("word").rlike("^[0-9]"), "number").when(F.col("word").rlike("^[A-Z]"), "capital").when(F.col("word").rlike("^[a-z]"), "lower").otherwise("other")
    return quality.distribution(words(spark, sf_dir), "word", category)


@query("q_length_stats", "SELECT min(n_chars) AS shortest, max(n_chars) AS longest, round(avg(n_chars), 1) AS mean FROM documents")
def length_stats(spark, sf_dir):
    return quality.length_stats(table(spark, sf_dir, "documents"), "n_chars")


@query("q_padding_stats", """WITH p AS (SELECT greatest(4096 - n_chars, 0) AS pad FROM documents) SELECT count(*) AS n, round(avg(pad), 6) AS mean, round(stddev_pop(pad), 6) AS std, round(quantile_cont(pad, 0.05), 6) AS p5, round(quantile_cont(pad, 0.5), 6) AS median,
    round(quantile_cont(pad, 0.95), 6) AS p95, count(*) FILTER (pad > 2048) AS over_half, count(*) FILTER (pad > 3686.4) AS over_nine_tenths FROM p""")
def padding_stats(spark, sf_dir):
    return quality.padding_stats(table(spark, sf_dir, "documents"), "n_chars", 4096)


@query("q_vector_stats", "SELECT 'd' || k AS dim, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std FROM (SELECT generate_subscripts(embedding, 1) AS k, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY 1")
def vector_stats(spark, sf_dir):
    """All dimensions of all vectors in one pass."""
    made = moments.array_moments(table(spark, sf_dir, "embeddings"), "embedding")
    return made.select(F.concat(F.lit("d"), (F.col("dim") + 1).cast("string")).alias("dim"), F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query("q_describe_by", "SELECT p_type, count(p_retailprice) AS n, round(avg(p_retailprice), 6) AS mean, round(stddev_samp(p_retailprice), 6) AS std, min(p_retailprice) AS least, round(quantile_cont(p_retailprice, 0.25), 6) AS p25, round(quantile_cont(p_retailprice, 0.5), 6) AS p50, round(quantile_cont(p_retailprice, 0.75), 6) AS p75, max(p_retailprice) AS most FROM part GROUP BY 1")
def describe_by(spark, sf_dir):
    return quality.describe_by(table(spark, sf_dir, "part"), "p_type", "p_retailprice")


@query("q_style_other_fold", "WITH c AS (SELECT source, count(*) AS n FROM documents GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, source) AS k FROM c) SELECT CASE WHEN k <= 13 THEN source ELSE 'Other' END AS source, sum(n)::BIGINT AS n FROM r GROUP BY 1")
def style_other_fold(spark, sf_dir):
    return quality.rest_folded(table(spark, sf_dir, "documents"), "source", 13)


@query("q_pitch_class_signature", """WITH s AS (SELECT l_orderkey, string_agg(DISTINCT (l_partkey % 53)::VARCHAR, ' ' ORDER BY (l_partkey % 53)::VARCHAR) AS unordered, list_sort(list_distinct(list(l_partkey % 53))) AS pcs FROM lineitem GROUP BY 1)
SELECT n_name, count(*) AS n, count(DISTINCT array_to_string(pcs, ' ')) AS signatures FROM s JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY 1""")
def pitch_class_signature(spark, sf_dir):
    signatures = quality.pitch_class_sets(table(spark, sf_dir, "lineitem"), ["l_orderkey"], "l_partkey")
    songs = signatures.join(table(spark, sf_dir, "orders"), F.col("o_orderkey") == F.col("l_orderkey")).join(table(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    named = songs.join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    return named.groupBy("n_name").agg(F.count("*").alias("n"), F.countDistinct("signature").alias("signatures"))


@query("q_correlation", "SELECT l_returnflag, round(corr(l_extendedprice, l_quantity), 6) AS r FROM lineitem GROUP BY 1")
def correlation(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.round(F.corr("l_extendedprice", "l_quantity"), 6).alias("r"))


GRAMMAR_SQL = """WITH t AS (
    SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos, CASE event_type WHEN 'click' THEN 'CHORD_START' WHEN 'view' THEN 'CHORD_END' WHEN 'purchase' THEN 'DUR_1.0' WHEN 'signup' THEN 'PV_212_3' WHEN 'error' THEN CASE WHEN event_id % 2 = 0 THEN '<start>' ELSE '<end>' END ELSE '<start>' END AS tok FROM events
), o AS (
    SELECT *, coalesce(sum(CASE tok WHEN 'CHORD_START' THEN 1 WHEN 'CHORD_END' THEN -1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS opened,
        sum((tok = 'CHORD_START')::INT) OVER (PARTITION BY user_id ORDER BY pos) AS block FROM t
), b AS (
    SELECT user_id, block, count(*) FILTER (tok LIKE 'DUR~_%' ESCAPE '~') AS dur, count(*) FILTER (tok LIKE 'PV~_%' ESCAPE '~') AS pv, count(*) FILTER (tok = 'CHORD_START') AS s, count(*) FILTER (tok = 'CHORD_END') AS e,
        count(*) FILTER (tok = 'CHORD_START' AND opened > 0) AS nested, count(*) FILTER (tok = 'CHORD_END' AND opened <= 0) AS orphan, count(*) FILTER (tok = '<start>') AS beg, count(*) FILTER (tok = '<end>') AS fin FROM o GROUP BY 1, 2
), f AS (
    SELECT user_id, sum(beg) = 0 AS missing_start, sum(fin) = 0 AS missing_end, sum(s) <> sum(e) AS pair_mismatch, sum(nested) > 0 AS nested_start, sum(orphan) > 0 AS orphan_end, bool_or(s > 0 AND dur = 0) AS no_duration, bool_or(s > 0 AND pv = 0) AS no_note, bool_or(s > 0 AND e = 0) AS unclosed FROM b GROUP BY 1
), u AS (UNPIVOT f ON missing_start, missing_end, pair_mismatch, nested_start, orphan_end, no_duration, no_note, unclosed INTO NAME issue VALUE v)
SELECT issue, count(*) AS n FROM u WHERE v GROUP BY 1"""


@query("q_grammar_issues", GRAMMAR_SQL)
def grammar_issues(spark, sf_dir):
    token = F.when(F.col("event_type") == "click", "CHORD_START").when(F.col("event_type") == "view", "CHORD_END").when(F.col("event_type") == "purchase", "DUR_1.0").when(F.col("event_type") == "signup", "PV_212_3").when(F.col("event_id") % 2 == 1, "<end>").otherwise("<start>")
    df = sequence.with_position(table(spark, sf_dir, "events").withColumn("tok", token), ["user_id"], ["ts", "event_id"])
    return quality.grammar_issues(df, ["user_id"])


@query("q_structural_invariants", f"""WITH {TOKENS_SQL}, s AS (SELECT l_orderkey, tok, sum((tok = '.')::INT) OVER (PARTITION BY l_orderkey ORDER BY pos) - 1 AS span FROM tokens),
e AS (SELECT l_orderkey, max(span) AS last, count(*) FILTER (tok = 'CHORD_START') AS n FROM s GROUP BY 1), l AS (SELECT l_orderkey, count(*) AS m FROM lineitem GROUP BY 1)
SELECT (count(*) FILTER (last <> n - 1 OR n <> m))::BIGINT AS violations, count(*) AS songs FROM e JOIN l USING (l_orderkey)""")
def structural_invariants(spark, sf_dir):
    """Songs whose last span isn't their number of chords less one, or whose chords aren't as many as their lines."""
    spans = sequence.chord_spans(tokens(spark, sf_dir), ["l_orderkey"], ["pos"])
    each = spans.groupBy("l_orderkey").agg(F.max("span").alias("last"), F.count_if(F.col("tok") == "CHORD_START").alias("chords"))
    each = each.join(table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("lines")), "l_orderkey")
    return each.agg(F.count_if((F.col("last") != F.col("chords") - 1) | (F.col("chords") != F.col("lines"))).alias("violations"), F.count("*").alias("songs"))


@query("q_coverage", f"WITH {WORDS_SQL}, v AS (SELECT DISTINCT word FROM w), u AS (SELECT DISTINCT unnest(string_split(text, ' ')) AS word FROM benchmark) SELECT count(*) AS size, count(u.word) AS used, round(count(u.word) * 100 / count(*)::DOUBLE, 6) AS pct FROM v LEFT JOIN u USING (word)")
def coverage(spark, sf_dir):
    """How much of the documents' vocabulary the benchmark uses."""
    used = table(spark, sf_dir, "benchmark").select(F.explode(F.split("text", " ")).alias("word"))
    return quality.coverage(used, words(spark, sf_dir), "word")


@query("q_tetrahedron", "SELECT CASE WHEN l_discount <= l_tax + 1e-6 AND l_tax <= l_quantity + 1e-6 THEN 'inside' ELSE 'outside' END AS place, count(*) AS n, min(l_discount) AS least, max(l_quantity) AS most FROM lineitem GROUP BY 1")
def tetrahedron(spark, sf_dir):
    place = F.when(quality.in_tetrahedron(F.col("l_discount"), F.col("l_tax"), F.col("l_quantity")), "inside").otherwise("outside")
    return table(spark, sf_dir, "lineitem").groupBy(place.alias("place")).agg(F.count("*").alias("n"), F.min("l_discount").alias("least"), F.max("l_quantity").alias("most"))


@query("q_success_by_type", "SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS ok, count(*) FILTER (o_orderstatus <> 'F') AS failed, round(avg((o_orderstatus = 'F')::INT::DOUBLE) * 100, 6) AS pct FROM orders GROUP BY 1")
def success_by_type(spark, sf_dir):
    ok = F.col("o_orderstatus") == "F"
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count_if(ok).alias("ok"), F.count_if(~ok).alias("failed"), F.round(F.avg(ok.cast("int").cast("double")) * 100, 6).alias("pct"))


@query("q_longest_shortest", "SELECT source, arg_max(doc_id, (n_chars, -doc_id)) AS longest, arg_min(doc_id, (n_chars, doc_id)) AS shortest FROM documents GROUP BY 1")
def longest_shortest(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.max_by("doc_id", F.struct("n_chars", -F.col("doc_id"))).alias("longest"), F.min_by("doc_id", F.struct("n_chars", "doc_id")).alias("shortest"))


@query("q_histograms", "SELECT l_linenumber, l_returnflag, count(*) AS n, round(count(*) * 100 / sum(count(*)) OVER ()::DOUBLE, 6) AS pct FROM lineitem GROUP BY 1, 2")
def histograms(spark, sf_dir):
    from pyspark.sql import Window

    counted = table(spark, sf_dir, "lineitem").groupBy("l_linenumber", "l_returnflag").agg(F.count("*").alias("n"))
    return counted.withColumn("pct", F.round(F.col("n") * 100 / F.sum("n").over(Window.partitionBy()), 6))


@query("q_clip_meta", r"""WITH f AS (SELECT page_id, page_id || '_' || (['dataset', 'model_A', 'model_B', 'other'])[(page_id % 4 + 1)::INTEGER] || '_' || regexp_extract(url, '^https?://([a-z0-9]*)', 1) || '__jazz__type_' || (page_id % 7) || '_major.' || (CASE WHEN page_id % 2 = 0 THEN 'mp3' ELSE 'WAV' END) AS file FROM pages)
SELECT page_id, CASE WHEN page_id % 4 = 3 THEN NULL ELSE (['dataset', 'model_A', 'model_B'])[(page_id % 4 + 1)::INTEGER] END AS source, 'jazz' AS style, 'type_' || (page_id % 7) || '_major' AS type FROM f""")
def clip_meta(spark, sf_dir):
    """Names of clips for all pages, taken apart again."""
    source = F.element_at(F.array(*[F.lit(x) for x in ("dataset", "model_A", "model_B", "other")]), (F.col("page_id") % 4 + 1).cast("int"))
    end = F.when(F.col("page_id") % 2 == 0, "mp3").otherwise("WAV")
    file = F.concat(F.col("page_id").cast("string"), F.lit("_"), source, F.lit("_"), F.regexp_extract("url", "^https?://([a-z0-9]*)", 1), F.lit("__jazz__type_"), (F.col("page_id") % 7).cast("string"), F.lit("_major."), end)
    return table(spark, sf_dir, "pages").select("page_id", music.clip_parts(file).alias("c")).select("page_id", "c.*")


@query("q_url_parts", r"""SELECT page_id, regexp_extract(url, '^https?://([^/]+)', 1) AS host, regexp_extract(url, '^https?://[^/]+/([a-z]{2})/', 1) AS lang, TRY_CAST(regexp_extract(url, '[?&]page=([0-9]+)', 1) AS DOUBLE) AS page,
    CASE WHEN contains(url, 'ref=') THEN 'referred' WHEN contains(url, '?') THEN 'query' ELSE 'plain' END AS kind FROM pages""")
def url_parts(spark, sf_dir):
    """An extension: addresses taken apart, a number read where there is one."""
    part = lambda p: F.regexp_extract("url", p, 1)
    kind = F.when(F.col("url").contains("ref="), "referred").when(F.col("url").contains("?"), "query").otherwise("plain")
    return table(spark, sf_dir, "pages").select("page_id", part("^https?://([^/]+)").alias("host"), part("^https?://[^/]+/([a-z]{2})/").alias("lang"), part("[?&]page=([0-9]+)").try_cast("double").alias("page"), kind.alias("kind"))


@query("q_balanced_markers", "WITH m AS (SELECT conv_id, sum(CASE role WHEN 'user' THEN 1 ELSE -1 END) OVER (PARTITION BY conv_id ORDER BY turn) AS depth FROM conversations) SELECT conv_id, min(depth)::BIGINT AS lowest, max(depth)::BIGINT AS highest, min(depth) >= 0 AND max(depth) <= 1 AS balanced FROM m GROUP BY 1")
def balanced_markers(spark, sf_dir):
    """An extension: user and assistant turns as brackets."""
    depth = F.sum(F.when(F.col("role") == "user", 1).otherwise(-1)).over(sequence.before_and_now(["conv_id"], ["turn"]))
    df = table(spark, sf_dir, "conversations").withColumn("depth", depth)
    return df.groupBy("conv_id").agg(F.min("depth").alias("lowest"), F.max("depth").alias("highest"), ((F.min("depth") >= 0) & (F.max("depth") <= 1)).alias("balanced"))


@query("q_ngram_overlap", """WITH d AS (SELECT DISTINCT doc_id, unnest([array_to_string(w[i:i+4], ' ') FOR i IN range(1, greatest(len(w) - 3, 1))]) AS g FROM (SELECT doc_id, string_split(lower(text), ' ') AS w FROM documents)),
b AS (SELECT DISTINCT unnest([array_to_string(w[i:i+4], ' ') FOR i IN range(1, greatest(len(w) - 3, 1))]) AS g FROM (SELECT string_split(lower(text), ' ') AS w FROM benchmark))
SELECT doc_id, count(*) AS n FROM d JOIN b USING (g) GROUP BY 1""")
def ngram_overlap(spark, sf_dir):
    """An extension: five-word runs that documents share with the benchmark, each counted once."""

    def grams(df, *keep):
        # The words are a column of their own, so that a text is split once and not for each of its runs.
        w = F.col("w")
        runs = F.transform(F.sequence(F.lit(1), F.size(w) - 4), lambda i: F.array_join(F.slice(w, i, 5), " "))
        return df.select(*keep, F.split(F.lower("text"), " ").alias("w")).where(F.size(w) >= 5).select(*keep, F.explode(runs).alias("g"))

    # Runs meet the benchmark's before any of them is told apart: what a document doesn't share with it, most of it, stays where
    # it was read. A benchmark that is too large to be sent to every task (it is stored compressed, and each of its words is
    # in five runs) is joined by a shuffle of distinct runs.
    documents, wanted = grams(table(spark, sf_dir, "documents"), "doc_id"), table(spark, sf_dir, "benchmark")
    own = grams(wanted).distinct()
    hits = documents.join(F.broadcast(own), "g") if joins.is_small(wanted, joins.MOST_BROADCAST_BYTES // 16) else documents.distinct().join(own, "g")
    return hits.distinct().groupBy("doc_id").agg(F.count("*").alias("n"))


@query("q_tokens_per_chord", f"WITH {TOKENS_SQL} SELECT round(count(*) / (count(*) FILTER (tok = 'CHORD_START'))::DOUBLE, 6) AS ratio, count(DISTINCT l_orderkey) AS songs FROM tokens")
def tokens_per_chord(spark, sf_dir):
    return tokens(spark, sf_dir).agg(F.round(F.count("*") / F.count_if(F.col("tok") == "CHORD_START"), 6).alias("ratio"), F.countDistinct("l_orderkey").alias("songs"))
