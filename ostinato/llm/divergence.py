"""Source divergence audit: how far the term distribution of each source is from those of its language's other sources.

A language keeps the terms that stand in at least ``LEAST_DOCUMENTS`` of its documents. In fixed point with nine digits
every group of documents (a language's source), and the language, gives each kept term a smoothed share. What two
groups differ in is a sum over all kept terms, but a group has few of them, and a share depends on a term's count only.
So the sum is taken by inclusion and exclusion over the supports: a histogram of the counts of either group prices its
terms as if the other group had none of them, a cell for count 0 prices the terms that both lack, and a join of the
postings of each term puts right only those terms that both have.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ostinato.llm.rows import map_rows
from ostinato.llm.storage import cut, read_table

#: Runs of bytes of A to Z in lower case and of all characters beyond ASCII.
TERM = re.compile(rb"[a-z\x80-\xff]+")
LEAST_DOCUMENTS = 3
SCALE = 1_000_000_000
MOST_TERMS = 200
#: Sources of a language that meet in one cell of the posting join, and rows of a table that may be broadcast.
SOURCES_A_CELL = 512
SMALL_TABLE = 100_000
#: Parts in which a group's terms are ranked before the best of all parts are.
RANK_PARTS = 16


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences of each term in each group, and the documents that hold it.

    Whole texts are read; null text, lang and source count as the empty string. Every row is a document, repeated rows
    as often as they stand. Tasks add up their batches, Spark adds up over tasks.
    """

    def step():
        def count(batch: dict[str, list]) -> dict[str, list]:
            found: dict[tuple[str, str], tuple[Counter, Counter]] = {}
            for lang, source, text in zip(batch["lang"], batch["source"], batch["text"], strict=True):
                terms = TERM.findall(text.lower())
                occurrences, holders = found.setdefault((lang, source), (Counter(), Counter()))
                occurrences.update(terms)
                holders.update(set(terms))
            out: dict[str, list] = {"lang": [], "source": [], "term": [], "n": [], "docs": []}
            for (lang, source), (occurrences, holders) in found.items():
                out["lang"] += [lang] * len(occurrences)
                out["source"] += [source] * len(occurrences)
                out["term"] += occurrences.keys()
                out["n"] += occurrences.values()
                out["docs"] += map(holders.__getitem__, occurrences)
            return out

        return count

    rows = grouped(docs).select("lang", "source", F.coalesce(F.col("text").cast("binary"), F.lit("").cast("binary")).alias("text"))
    counted = map_rows(rows, step, "lang string, source string, term binary, n long, docs long").withColumn("term", F.col("term").cast("string"))
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def grouped(docs: DataFrame) -> DataFrame:
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    return docs.select(empty("lang"), empty("source"), F.col("text").cast("string").alias("text"))


def kept_postings(counts: DataFrame, least_documents: int = LEAST_DOCUMENTS) -> DataFrame:
    """(lang, source, term, n, hash, lang_n, first): the terms that a language keeps; ``first`` is 1 in one row of each."""
    # The hash goes first in what is sorted by: numbers compare faster than the texts that decide after it.
    rows = counts.withColumn("hash", F.xxhash64("lang", "term"))
    term = Window.partitionBy("hash", "lang", "term")
    rows = rows.withColumns({"held": F.sum("docs").over(term), "lang_n": F.sum("n").over(term), "first": (F.min("source").over(term) == F.col("source")).cast("int")})
    return rows.where(F.col("held") >= least_documents).drop("held", "docs")


def group_totals(docs: DataFrame, postings: DataFrame) -> DataFrame:
    """(lang, source, total, support, lang_terms, lang_total, sources): a row for each group that occurs."""
    sums = postings.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("support"), F.sum("first").alias("firsts"))
    groups = grouped(docs).select("lang", "source").distinct().join(sums, ["lang", "source"], "left").na.fill(0, ["total", "support", "firsts"])
    langs = groups.groupBy("lang").agg(F.sum("firsts").alias("lang_terms"), F.sum("total").alias("lang_total"), F.count("*").alias("sources"))
    return groups.drop("firsts").join(langs, "lang")


def div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def share(n: Column | str, total: Column | str, terms: Column | str) -> Column:
    """1 + floor(SCALE * (n + 1) / (total + terms)), exact for any counts; without any kept terms nothing is priced."""
    n, total, terms = (F.col(x) if isinstance(x, str) else x for x in (n, total, terms))
    return 1 + div((n + 1).cast("decimal(19,0)") * F.lit(SCALE), F.greatest(total + terms, F.lit(1)).cast("decimal(19,0)"))


def gap(p: Column | str, q: Column | str) -> Column:
    """floor((p - q) ** 2 / q) of two shares. These are at most SCALE + 1, so the square fits in a long."""
    p, q = (F.col(x) if isinstance(x, str) else x for x in (p, q))
    return div((p - q) * (p - q), q)


def exact_sum(value: Column) -> Column:
    return F.sum(value.cast("decimal(38,0)"))


def beside(rows: DataFrame, groups: DataFrame, n_groups: int) -> DataFrame:
    """``rows`` with the columns of their group: broadcast only if there are few groups."""
    return rows.join(F.broadcast(groups) if n_groups <= SMALL_TABLE else groups, ["lang", "source"])


def one_sided(postings: DataFrame, groups: DataFrame, n_groups: int) -> DataFrame:
    """(lang, source, item, value): what histograms price, for each ordered pair of groups of a language.

    A group's histogram has a cell for each count and one for count 0. As ``source`` a group prices all kept terms
    against the other's share of a term that it lacks; as ``item`` it prices what its terms differ from this. Cells are
    dealt to as many parts as the session shuffles, so that a language isn't one task.
    """
    parts = int(postings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    histogram = postings.groupBy("lang", "source", "n").agg(F.count("*").alias("terms"))
    empty = groups.select("lang", "source", F.lit(0).cast("long").alias("n"), (F.col("lang_terms") - F.col("support")).alias("terms"))
    cells = beside(histogram.unionByName(empty), groups, n_groups)
    cells = cells.select("lang", "source", "n", "terms", share("n", "total", "lang_terms").alias("p"), share(F.lit(0), F.col("total"), F.col("lang_terms")).alias("p0"))
    cells = cells.withColumn("part", F.pmod(F.xxhash64("source", "n"), F.lit(parts)).cast("int"))
    others = groups.select("lang", F.col("source").alias("other"), share(F.lit(0), F.col("total"), F.col("lang_terms")).alias("q0"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    met = cells.join(others, ["lang", "part"]).where("source <> other")
    as_source = F.col("terms") * gap("p", "q0").cast("decimal(19,0)")
    as_item = F.col("terms") * (gap("q0", "p") - gap("q0", "p0")).cast("decimal(19,0)")
    sums = met.groupBy("lang", "source", "other").agg(exact_sum(as_source).alias("a"), exact_sum(F.when(F.col("n") > 0, as_item).otherwise(0)).alias("b"))
    both = F.array(F.struct(F.col("source"), F.col("other").alias("item"), F.col("a").alias("value")), F.struct(F.col("other").alias("source"), F.col("source").alias("item"), F.col("b").alias("value")))
    return sums.select("lang", F.inline(both))


def overlaps(priced: DataFrame) -> DataFrame:
    """(lang, source, item, value): what terms that both groups of a pair have add to the prices of the histograms.

    Postings of a term meet once for two groups, in cells of two blocks of about SOURCES_A_CELL sources each.
    """
    cells = priced.withColumn("blocks", (1 + F.floor(F.col("sources") / SOURCES_A_CELL)).cast("int")).withColumn("block", F.pmod(F.xxhash64("source"), "blocks").cast("int"))
    fan = F.sequence(F.lit(0), F.col("blocks") - 1)
    one = cells.select("hash", "lang", "term", "source", "p", "p0", F.col("block").alias("b1"), F.explode(fan).alias("b2"))
    two = cells.select("hash", "lang", "term", F.col("source").alias("item"), F.col("p").alias("q"), F.col("p0").alias("q0"), F.col("block").alias("b2"), F.explode(fan).alias("b1"))
    met = one.join(two, ["hash", "lang", "term", "b1", "b2"]).where("source < item")
    ahead = gap("p", "q") - gap("p", "q0") - gap("p0", "q") + gap("p0", "q0")
    back = gap("q", "p") - gap("q", "p0") - gap("q0", "p") + gap("q0", "p0")
    sums = met.groupBy("lang", "source", "item").agg(exact_sum(ahead).alias("a"), exact_sum(back).alias("b"))
    both = F.array(F.struct(F.col("source"), F.col("item"), F.col("a").alias("value")), F.struct(F.col("item").alias("source"), F.col("source").alias("item"), F.col("b").alias("value")))
    return sums.select("lang", F.inline(both))


def audit(docs: DataFrame, *, least_documents: int = LEAST_DOCUMENTS, most_terms: int = MOST_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank) of the documents' columns text, lang and source; others aren't read.

    Part ``pair`` has a row for each other source of the language, part ``term`` the ``most_terms`` terms in which a
    group's share is most above its language's. Null text, lang and source count as ''; an empty table gives no rows,
    a language without kept terms pairs of value 0. Equal values rank by item in byte order. Repeated rows are as many
    documents. A single source of a language has no pairs.
    """
    postings = cut(kept_postings(term_counts(docs), least_documents))
    groups = cut(group_totals(docs, postings))
    n_groups = groups.count()
    priced = beside(postings, groups, n_groups).select("*", share("n", "total", "lang_terms").alias("p"), share(F.lit(0), F.col("total"), F.col("lang_terms")).alias("p0"))

    pairs = one_sided(postings, groups, n_groups).unionByName(overlaps(priced)).groupBy("lang", "source", "item").agg(F.sum("value").cast("long").alias("value"))
    order = [F.col("value").desc(), F.col("item")]
    pairs = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(*order))).withColumn("part", F.lit("pair"))

    terms = priced.select("lang", "source", F.col("term").alias("item"), "p", share("lang_n", "lang_total", "lang_terms").alias("q")).where("p > q").select("lang", "source", "item", gap("p", "q").alias("value"))
    terms = terms.withColumn("cell", F.xxhash64("lang", "source", F.pmod(F.xxhash64("item"), F.lit(RANK_PARTS))))
    place = Window.partitionBy("cell", "lang", "source").orderBy(*order)
    best = terms.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= most_terms)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(*order))).where(F.col("rank") <= most_terms)
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.select(*columns).unionByName(best.withColumn("part", F.lit("term")).select(*columns))


def op11_divergence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit of all documents."""
    return audit(read_table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH rows AS (
    SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents
), tokens AS (
    SELECT d, lang, source, unnest(terms) AS term FROM rows
), kept AS (
    SELECT lang, term, count(*)::HUGEINT AS n FROM tokens GROUP BY ALL HAVING count(DISTINCT d) >= 3
), langs AS (
    SELECT lang, sum(n) AS total, count(*) AS v FROM kept GROUP BY lang
), counts AS (
    SELECT lang, source, term, count(*)::HUGEINT AS n FROM tokens SEMI JOIN kept USING (lang, term) GROUP BY ALL
), groups AS (
    SELECT DISTINCT lang, source FROM rows
), totals AS (
    SELECT g.lang, g.source, coalesce(sum(n), 0) AS total FROM groups g LEFT JOIN counts c USING (lang, source) GROUP BY ALL
), shares AS (
    SELECT t.lang, t.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (t.total + l.v) AS p,
        1 + (1000000000::HUGEINT * (k.n + 1)) // (l.total + l.v) AS q
    FROM totals t JOIN langs l USING (lang) JOIN kept k USING (lang) LEFT JOIN counts c ON c.lang = t.lang AND c.source = t.source AND c.term = k.term
), pairs AS (
    SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value
    FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), every AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(p.value, 0)::BIGINT AS value
    FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
    UNION ALL
    SELECT lang, source, 'term', term, (((p - q) * (p - q)) // q)::BIGINT FROM shares WHERE n > 0 AND p > q
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM every
)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""
