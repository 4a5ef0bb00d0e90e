"""Queries of the statistics, check, search and set operators over the relational tables, and their SQL.

Plain relational queries (joins, windows, grouping sets) go beyond the operators' origin; they are extensions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions import stats
from corpusloom.functions import text as tx
from corpusloom.operators import checks, corpus, search
from corpusloom.session import table


def quantile_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All five quantile conventions of the extended price by return flag."""
    li = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_extendedprice")
    rules = {"q1_p25": ("linear", 0.25), "q1_p90": ("linear", 0.9), "q5_median": ("linear", 0.5), "q2_p25": ("half_even", 0.25), "q2_p75": ("half_even", 0.75), "q3_p90": ("ceil", 0.9), "q4_mid": ("upper", 0.5)}
    return stats.ranked_quantiles(li, ["l_returnflag"], "l_extendedprice", rules)


def t_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean account balance of suppliers by nation with its 95 % interval; a single supplier has sd 0 and no interval."""
    s = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.count("*").alias("n"), F.avg("s_acctbal").alias("mean"), F.coalesce(F.stddev_samp("s_acctbal"), F.lit(0.0)).alias("sd"))
    half = stats.t_95(F.col("n")) * stats.standard_error(F.col("sd"), F.col("n"))
    return s.select("s_nationkey", "n", F.round("mean", 6).alias("mean"), F.round("sd", 6).alias("sd"), F.round(F.col("mean") - half, 6).alias("low"), F.round(F.col("mean") + half, 6).alias("high"))


def rank_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_quantity", "l_discount")
    rho = stats.spearman(li, ["l_returnflag"], "l_quantity", "l_discount")
    r = li.groupBy("l_returnflag").agg(stats.guarded_corr("l_quantity", "l_discount").alias("r"))
    return rho.join(r, "l_returnflag").select("l_returnflag", "n", F.round("rho", 6).alias("rho"), F.round("r", 6).alias("r"))


def wilson_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of urgent orders by status with its Wilson interval."""
    o = table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.sum((F.col("o_orderpriority") == "1-URGENT").cast("bigint")).alias("hits"), F.count("*").alias("n"))
    low, high = stats.wilson(F.col("hits"), F.col("n"))
    return o.select("o_orderstatus", "hits", "n", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


def label_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cohen's kappa of the given language labels and the two-way rule."""
    d = table(spark, sf_dir, "documents").select("lang", tx.language(F.col("text")).alias("rule"))
    k = stats.cohen_kappa(d, "lang", "rule")
    return k.select("n", *[F.round(c, 6).alias(c) for c in ("observed", "expected", "kappa")])


def systematic_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every k-th document of a source in order, k chosen so that at most twenty are taken."""
    d = table(spark, sf_dir, "documents").select("source", "doc_id")
    placed = stats.cumulative(d, ["source"], "doc_id")
    sizes = d.groupBy("source").agg(F.count("*").alias("n"))
    stride = F.greatest(F.lit(1), F.ceil(F.col("n") / 20).cast("int"))
    return placed.join(sizes, "source").filter((F.col("upto") - 1) % stride == 0).select("source", "doc_id")


def verdict_crosstab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1))).na.fill(0)


def retention_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that go when each customer keeps the five newest."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    gone = checks.retention(o, ["o_custkey"], [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()], 5, "o_orderkey")
    return gone.groupBy("o_custkey").agg(F.count("*").alias("n_gone"), F.max("o_orderkey").alias("last_key"))


def order_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line numbers of an order that don't follow each other."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("number"), "l_partkey", "l_suppkey")
    return checks.continuity(li, ["l_orderkey"], "number", ["number", "l_partkey", "l_suppkey"]).groupBy("problem").agg(F.count("*").alias("n"), F.count_distinct("l_orderkey").alias("n_orders"))


def orphan_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines whose order isn't among the finished ones."""
    edges = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").distinct()
    gone = checks.orphans(edges, table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'"), ["l_orderkey"], "o_orderkey")
    return gone.groupBy("missing_end").agg(F.count("*").alias("n"))


def segment_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected nation and segment pairs (every nation's region has every segment seen in it) against those with customers."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("nation"), "n_regionkey")
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"))
    seen = c.join(n, "nation").select("n_regionkey", "segment").distinct()
    return checks.inventory(n.join(seen, "n_regionkey"), c, ["nation", "segment"]).groupBy("state").agg(F.count("*").alias("n"))


def registry_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Papers a corpus should have against those there are."""
    e = table(spark, sf_dir, "test_corpora").select("name", "n_papers")
    a = table(spark, sf_dir, "papers").select(F.col("corpus_name").alias("name"), "paper_key").distinct().groupBy("name").agg(F.count("*").alias("n_papers"))
    return checks.audit(e, a, "name", "n_papers")


def language_record_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded language of papers against the rule on their share of ideographs, null-safe."""
    p = table(spark, sf_dir, "papers")
    rule = F.when(F.col("cjk_ratio").isNull(), None).when(F.col("cjk_ratio") > tx.CJK_SHARE, "zh").otherwise("en")
    known = p.select("language", rule.alias("rule"))
    verdict = F.when(F.col("rule").isNull(), "not_assessed").when(F.col("language").eqNullSafe(F.col("rule")), "same").when(F.col("language").isNull(), "missing").otherwise("other")
    return known.groupBy(verdict.alias("verdict")).agg(F.count("*").alias("n"))


def latest_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The highest release of each lexicon name and language, by version order."""
    c = table(spark, sf_dir, "connectors").select("name", F.coalesce("language", F.lit("none")).alias("language"), "version", tx.semver(F.col("version")).alias("v"))
    return c.groupBy("name", "language").agg(F.count("*").alias("n"), F.max_by("version", F.struct("v", "version")).alias("latest"))


def engine_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "papers").select("paper_key", F.explode("engine_versions").alias("engine", "version")).distinct()
    return p.groupBy("engine").agg(F.count("*").alias("n"), F.count_distinct("version").alias("n_versions"))


def similar_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each evaluation item the five most similar other items by Jaccard of their words, from 0.30 on."""
    w = F.array_distinct(tx.tokens(F.coalesce("text", F.lit(""))))
    i = table(spark, sf_dir, "eval_items").select(F.col("item_id").alias("id"), w.alias("words"))
    found = checks.jaccard_matches(i, i, 0.30, top=6)
    other = found.filter("query_id <> row_id").drop("rank")
    order = Window.partitionBy("query_id").orderBy(F.col("jaccard").desc(), "row_id")
    return other.withColumn("rank", F.row_number().over(order).cast("bigint")).filter("rank <= 5").withColumn("jaccard", F.round("jaccard", 6))


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as search results: the paper is the DOI, the source the engine."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        "source", F.col("doc_id").alias("place"), F.coalesce(F.col("n_chars").cast("double") / 1000, F.lit(0.0)).alias("score"),
        F.when(F.length(F.trim(F.coalesce("text", F.lit("")))) == 0, "empty").alias("error"),
        F.col("paper_key").alias("doi"), F.lit(None).cast("string").alias("arxiv_id"),
        F.concat(F.lit("HTTPS://WWW."), F.regexp_replace("source", "_", "-"), F.lit(".org/"), F.coalesce("section", F.lit("none")), F.lit("/?id="), F.col("doc_id")).alias("url"),
        F.substring(F.coalesce("text", F.lit("")), 1, 40).alias("title"),
    )


WEIGHTS = [("arxiv_abs", 1.3, 1), ("journal_ocr", 1.2, 2), ("cnki_export", 1.1, 3), ("web_fetch", 0.8, 4), ("search_snippet", 0.6, 5)]


def merged_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _results(spark, sf_dir)
    keyed = r.withColumn("key", search.dedup_key(F.col("doi"), F.col("arxiv_id"), F.col("url"), F.col("title"), F.col("source")))
    weights = spark.createDataFrame(WEIGHTS, "source string, weight double, source_order int")
    m = search.merged(keyed.select("source", "place", "key", "score", "error", "url"), weights)
    return m.select("key", "source", "place", F.round("score", 6).alias("score"), "n_found", F.array_join("sources", ",").alias("sources"))


def top_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty best merged results: a top-k report."""
    return search.top(merged_results(spark, sf_dir), 20).select("key", "score")


def source_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.source_health(_results(spark, sf_dir))


def host_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = search.host_agreement(_results(spark, sf_dir), "arxiv_abs", "web_fetch")
    return h.select(F.col("shared").cast("bigint").alias("shared"), "either", "agreement")


def arbitration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.arbitrated(_results(spark, sf_dir), "arxiv_abs", "web_fetch", "cnki_export", 0.2).groupBy("source").agg(F.count("*").alias("n"))


def monthly_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    limits = spark.createDataFrame([("click", 500), ("view", 1000)], "source string, monthly_limit bigint")
    return search.quota(table(spark, sf_dir, "events"), "ts", "event_type", limits)


def query_intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy(search.intent(F.coalesce("text", F.lit(""))).alias("intent")).agg(F.count("*").alias("n"))


def download_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of landed documents and how many are taken twice; without a paper the name is a digest of the whole text."""
    text = F.coalesce("text", F.lit(""))
    title = F.when(F.trim(text) != "", F.concat(F.md5(text), F.lit(" "), F.substring(text, 1, 20))).otherwise(F.lit(""))
    r = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), F.lit(None).cast("string").alias("arxiv_id"), F.col("paper_key").alias("doi"), title.alias("title"))
    return search.manifest(r).groupBy("duplicate").agg(F.count("*").alias("n"), F.count_distinct("file_name").alias("n_names"))


def url_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _results(spark, sf_dir).select(tx.normal_url(F.col("url")).alias("url")).groupBy("url").agg(F.count("*").alias("n"))


def corpus_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "papers").select("corpus_name", "paper_key", "pdf_sha256").distinct()
    return corpus.fingerprint(p, ["corpus_name"], ["paper_key", "pdf_sha256"])


def revenue_by_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: revenue by region and nation with totals, over five joined tables."""
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    c, n, r = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    j = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    revenue = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return j.rollup("r_name", "n_name").agg(F.round(F.sum(revenue), 2).alias("revenue"), F.count("*").alias("n_lines"))


def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: sums and means of lines by flag and status."""
    li = table(spark, sf_dir, "lineitem").filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_price"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))


def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: sessions of a user, a new one after half an hour without events."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "value")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    new = (F.lag("ts").over(w).isNull() | (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag("ts").over(w).cast("timestamp")) > 1_800_000_000)).cast("int")
    numbered = e.withColumn("new", new).withColumn("session", F.sum("new").over(w))
    return numbered.groupBy("user_id", "session").agg(F.count("*").alias("n_events"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")).withColumn("session", F.col("session").cast("bigint"))


QUERIES = {
    f.__name__: f
    for f in (quantile_rules, t_intervals, rank_correlations, wilson_intervals, label_agreement, systematic_sample, verdict_crosstab, retention_plan, order_gaps, orphan_orders, segment_inventory, registry_audit,
              language_record_mismatch, latest_versions, engine_versions, similar_items, merged_results, top_results, source_health, host_agreement, arbitration, monthly_quota, query_intents, download_names, url_forms,
              corpus_fingerprint, revenue_by_region, pricing_summary, event_sessions)
}

_T95 = "[" + ", ".join(map(str, stats.T_95)) + "]"
_RES = """r AS (SELECT source, doc_id AS place, coalesce(n_chars / 1000, 0) AS score, CASE WHEN length(trim(coalesce(text, ''), ' ')) = 0 THEN 'empty' END AS error, paper_key AS doi, text,
 'HTTPS://WWW.' || replace(source, '_', '-') || '.org/' || coalesce(section, 'none') || '/?id=' || doc_id AS url, 'https://' || replace(source, '_', '-') || '.org' AS site, coalesce(section, 'none') AS sec, substring(coalesce(text, ''), 1, 40) AS title FROM documents)"""
_KEY = r"""coalesce('doi:' || lower(nullif(trim(doi, ' '), '')), 'url:' || site || '/' || sec)"""
_MERGED = f"""{_RES}, k AS (SELECT *, {_KEY} AS key FROM r WHERE error IS NULL), wt(source, weight, o) AS (VALUES {", ".join(f"('{s}', {w}, {o})" for s, w, o in WEIGHTS)}),
 x AS (SELECT k.*, coalesce(weight, 1.0) AS w, coalesce(o, 1073741824) AS o FROM k LEFT JOIN wt USING (source)),
 f AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY o, place, source) AS i, sum(w) OVER (PARTITION BY key) AS all_w, count(*) OVER (PARTITION BY key) AS n_found FROM x),
 src AS (SELECT key, array_to_string(list_sort(list(DISTINCT source)), ',') AS sources FROM x GROUP BY 1),
 m AS (SELECT f.key, source, place, round(score * w + 0.15 * (all_w - w), 6) AS score, n_found, sources FROM f JOIN src USING (key) WHERE i = 1)"""
SQL = {
    "quantile_rules": """WITH l AS (SELECT l_returnflag, quantile_cont(l_extendedprice, 0.25) AS q1_p25, quantile_cont(l_extendedprice, 0.9) AS q1_p90, median(l_extendedprice) AS q5_median FROM lineitem GROUP BY 1),
 r AS (SELECT l_returnflag, l_extendedprice AS v, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) AS k, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem),
 q AS (SELECT l_returnflag, max(CASE WHEN k = CAST(round_even(0.25 * (n - 1), 0) AS BIGINT) + 1 THEN v END) AS q2_p25, max(CASE WHEN k = CAST(round_even(0.75 * (n - 1), 0) AS BIGINT) + 1 THEN v END) AS q2_p75, max(CASE WHEN k = greatest(ceil(0.9 * n), 1) THEN v END) AS q3_p90, max(CASE WHEN k = n // 2 + 1 THEN v END) AS q4_mid FROM r GROUP BY 1)
 SELECT * FROM l JOIN q USING (l_returnflag)""",
    "t_intervals": f"WITH s AS (SELECT s_nationkey, count(*) AS n, avg(s_acctbal) AS mean, coalesce(stddev_samp(s_acctbal), 0) AS sd FROM supplier GROUP BY 1), h AS (SELECT *, CASE WHEN n < 2 THEN NULL WHEN n <= 31 THEN list_extract({_T95}, CAST(n - 1 AS INTEGER)) ELSE 1.96 END * sd / sqrt(n) AS half FROM s) SELECT s_nationkey, n, round(mean, 6) AS mean, round(sd, 6) AS sd, round(mean - half, 6) AS low, round(mean + half, 6) AS high FROM h",
    "rank_correlations": "WITH a AS (SELECT l_returnflag, l_quantity, l_discount, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2.0 AS x, rank() OVER (PARTITION BY l_returnflag ORDER BY l_discount) + (count(*) OVER (PARTITION BY l_returnflag, l_discount) - 1) / 2.0 AS y FROM lineitem) SELECT l_returnflag, count(*) AS n, round(corr(x, y), 6) AS rho, round(corr(l_quantity, l_discount), 6) AS r FROM a GROUP BY 1",
    "wilson_intervals": "WITH o AS (SELECT o_orderstatus, CAST(sum(CAST(o_orderpriority = '1-URGENT' AS INT)) AS BIGINT) AS hits, count(*) AS n FROM orders GROUP BY 1), p AS (SELECT *, hits / n AS p, 1.96 * 1.96 AS z FROM o) SELECT o_orderstatus, hits, n, round(greatest(0, (p + z / (2 * n) - 1.96 * sqrt(p * (1 - p) / n + z / (4 * n * n))) / (1 + z / n)), 6) AS low, round(least(1, (p + z / (2 * n) + 1.96 * sqrt(p * (1 - p) / n + z / (4 * n * n))) / (1 + z / n)), 6) AS high FROM p",
    "label_agreement": r"""WITH d AS (SELECT lang AS a, CASE WHEN c > 0.10 * (c + t) THEN 'zh' WHEN t > 0 THEN 'en' ELSE 'unknown' END AS b FROM (SELECT lang, len(regexp_extract_all(text, '[A-Za-z][A-Za-z''-]*')) AS t, len(regexp_extract_all(text, '[\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}]')) AS c FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL)),
 n AS (SELECT count(*) AS n, sum(CAST(a = b AS INT)) / count(*) AS o FROM d), x AS (SELECT a AS l, count(*) AS k FROM d GROUP BY 1), y AS (SELECT b AS l, count(*) AS k FROM d GROUP BY 1), e AS (SELECT sum(x.k * y.k) AS s FROM x JOIN y USING (l))
 SELECT n, round(o, 6) AS observed, round(s / (n * n), 6) AS expected, round((o - s / (n * n)) / (1 - s / (n * n)), 6) AS kappa FROM n, e""",
    "systematic_sample": "WITH p AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r, count(*) OVER (PARTITION BY source) AS n FROM documents) SELECT source, doc_id FROM p WHERE (r - 1) % greatest(1, CAST(ceil(n / 20) AS BIGINT)) = 0",
    "verdict_crosstab": "SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS F, count(*) FILTER (o_orderstatus = 'O') AS O, count(*) FILTER (o_orderstatus = 'P') AS P FROM orders GROUP BY 1",
    "retention_plan": "SELECT o_custkey, count(*) AS n_gone, max(o_orderkey) AS last_key FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r > 5 GROUP BY 1",
    "order_gaps": "WITH l AS (SELECT l_orderkey, l_linenumber AS number, coalesce(lag(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) + 1, 1) AS expected, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) > 1 AS again FROM lineitem), p AS (SELECT l_orderkey, CASE WHEN number = expected THEN NULL WHEN again AND number < expected THEN 'duplicate' WHEN number > expected THEN 'gap' ELSE 'backward' END AS problem FROM l) SELECT problem, count(*) AS n, count(DISTINCT l_orderkey) AS n_orders FROM p WHERE problem IS NOT NULL GROUP BY 1",
    "orphan_orders": "SELECT 'l_orderkey' AS missing_end, count(*) AS n FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) e WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus = 'F') HAVING count(*) > 0",
    "segment_inventory": "WITH c AS (SELECT DISTINCT c_nationkey AS nation, c_mktsegment AS segment FROM customer), s AS (SELECT DISTINCT n_regionkey, segment FROM c JOIN nation ON nation = n_nationkey), e AS (SELECT n_nationkey AS nation, segment FROM nation JOIN s USING (n_regionkey)) SELECT CASE WHEN c.nation IS NULL THEN 'missing' WHEN e.nation IS NULL THEN 'extra' ELSE 'present' END AS state, count(*) AS n FROM e FULL JOIN c ON e.nation = c.nation AND e.segment = c.segment GROUP BY 1",
    "registry_audit": "WITH a AS (SELECT corpus_name AS name, count(DISTINCT paper_key) AS actual FROM papers GROUP BY 1) SELECT coalesce(e.name, a.name) AS name, CAST(e.n_papers AS DOUBLE) AS expected, CAST(a.actual AS DOUBLE) AS actual, CASE WHEN a.name IS NULL THEN 'missing' WHEN e.name IS NULL THEN 'unexpected' WHEN e.n_papers = a.actual THEN 'match' ELSE 'drift' END AS verdict FROM test_corpora e FULL JOIN a ON e.name = a.name",
    "language_record_mismatch": "WITH p AS (SELECT language, CASE WHEN cjk_ratio > 0.10 THEN 'zh' WHEN cjk_ratio IS NOT NULL THEN 'en' END AS rule FROM papers) SELECT CASE WHEN rule IS NULL THEN 'not_assessed' WHEN language IS NOT DISTINCT FROM rule THEN 'same' WHEN language IS NULL THEN 'missing' ELSE 'other' END AS verdict, count(*) AS n FROM p GROUP BY 1",
    "latest_versions": r"WITH c AS (SELECT name, coalesce(language, 'none') AS language, version, [CAST(x AS INT) FOR x IN string_split(regexp_extract(version, '(\d+(?:\.\d+){0,2})', 1), '.')] AS v FROM connectors) SELECT name, language, count(*) AS n, arg_max(version, v) AS latest FROM c GROUP BY 1, 2",
    "engine_versions": "WITH e AS (SELECT DISTINCT paper_key, unnest(map_entries(engine_versions)) AS e FROM papers) SELECT e.key AS engine, count(*) AS n, count(DISTINCT e.value) AS n_versions FROM e GROUP BY 1",
    "similar_items": "WITH i AS (SELECT item_id, list_distinct(list_transform(regexp_extract_all(coalesce(text, ''), '[A-Za-z][A-Za-z''-]*'), lambda x: lower(x))) AS w FROM eval_items), p AS (SELECT a.item_id AS query_id, b.item_id AS row_id, len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))) AS j FROM i a JOIN i b ON a.item_id <> b.item_id AND len(a.w) > 0 AND len(b.w) > 0), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY j DESC, row_id) AS rank FROM p WHERE j >= 0.3) SELECT query_id, row_id, round(j, 6) AS jaccard, rank FROM r WHERE rank <= 5",
    "merged_results": f"WITH {_MERGED} SELECT * FROM m",
    "top_results": f"WITH {_MERGED} SELECT key, score FROM m ORDER BY score DESC, key LIMIT 20",
    "source_health": f"WITH {_RES} SELECT source, count(*) AS n_rows, count(error) AS n_errors, bool_and(error IS NOT NULL) AS failed FROM r GROUP BY 1",
    "host_agreement": f"WITH {_RES}, h AS (SELECT site, max(CAST(source = 'arxiv_abs' AS INT)) AS a, max(CAST(source = 'web_fetch' AS INT)) AS b FROM r WHERE source IN ('arxiv_abs', 'web_fetch') GROUP BY 1) SELECT CAST(coalesce(sum(a * b), 0) AS BIGINT) AS shared, count(*) AS either, sum(a * b) / count(*) AS agreement FROM h",
    "arbitration": "SELECT source, count(*) AS n FROM documents WHERE source IN ('arxiv_abs', 'web_fetch', 'cnki_export') GROUP BY 1",
    "monthly_quota": "WITH l(source, monthly_limit) AS (VALUES ('click', CAST(500 AS BIGINT)), ('view', 1000)), u AS (SELECT event_type AS source, strftime(ts, '%Y-%m') AS month, count(*) AS used FROM events GROUP BY 1, 2) SELECT source, month, used, monthly_limit, CASE WHEN monthly_limit IS NOT NULL THEN greatest(0, monthly_limit - used) END AS remaining FROM u LEFT JOIN l USING (source)",
    "query_intents": f"SELECT CASE WHEN regexp_matches(lower(coalesce(text, '')), '{'|'.join(search.ACADEMIC)}') THEN 'academic' ELSE 'general' END AS intent, count(*) AS n FROM documents GROUP BY 1",
    "url_forms": f"WITH {_RES} SELECT site || '/' || sec AS url, count(*) AS n FROM r GROUP BY 1",
    "revenue_by_region": "SELECT r_name, n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n_lines FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)",
    "pricing_summary": "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2",
    "event_sessions": "WITH e AS (SELECT user_id, event_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER w) > 1800000000 THEN 1 ELSE 0 END AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM e) SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS n_events, min(ts) AS first_ts, max(ts) AS last_ts FROM s GROUP BY 1, 2",
}
