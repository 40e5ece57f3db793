"""Stand-in inputs derived by Spark from the driver's tables.

The driver supplies no monitoring documents, so every registered query reads
the given tables and reshapes them into the schemas the operators expect.
The derivations are plain column expressions, joins and windows; their work
grows with the tables.  The same definitions are restated in SQL by
``fleetlens.plans.oracle`` so DuckDB can recompute each result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.operators.benchruns import OPTIMIZED, ORIGINAL, number_rounds
from fleetlens.session import fresh_folder, materialized
from fleetlens.sources.tables import table

NODE_METRIC_TYPE = "node_stats"


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as flat node metrics.

    ``_id``/``timestamp`` from ``event_id``/``ts``; a cluster is ``user_id % 7``
    and a node is a user; ``value`` is a gauge.  Two counters restart every
    day at midnight (a daily node restart), which exercises reset handling:
    ``ops`` is the minute of the day plus one, ``time_ms`` ten times the
    second of the day plus ``floor(value * 100)``.  Both are computed from
    the row alone (no window, no shuffle).  ``ops`` is missing on ``signup``
    events and ``time_ms`` on ``error`` events, which exercises null gaps.
    """
    ev = table(spark, sf_dir, "events")
    ts = F.col("ts")
    minute_of_day = F.hour(ts) * 60 + F.minute(ts)
    second_of_day = minute_of_day * 60 + F.second(ts)
    return ev.select(
        F.col("event_id").alias("_id"),
        ts.alias("timestamp"),
        F.lit(NODE_METRIC_TYPE).alias("metric_type"),
        (F.col("user_id") % 7).alias("cluster_id"),
        F.col("event_type").alias("cluster_name"),
        F.col("user_id").alias("node_id"),
        F.col("event_type").alias("status"),
        F.col("value"),
        F.when(F.col("event_type") != "signup", (minute_of_day + 1).cast("bigint")).alias("ops"),
        F.when(F.col("event_type") != "error", (second_of_day * 10).cast("bigint") + F.floor(F.col("value") * 100)).alias("time_ms"),
    )


def metric_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as nested node-stats documents with the metric envelope.

    Carries an agent block, metadata with labels, human-readable size text
    next to byte counts, an object named ``store`` and an IPv4 transport
    address, so project / slim / mask have something to act on.
    """
    m = metrics(spark, sf_dir)
    addr = F.concat(F.lit("10."), F.col("cluster_id").cast("string"), F.lit(".0."), F.col("node_id").cast("string"))
    size_bytes = F.floor(F.col("value") * 1024).cast("bigint")
    return m.select(
        F.col("_id"),
        F.col("timestamp"),
        F.struct(F.concat(F.lit("agent-"), F.col("node_id").cast("string")).alias("id"), F.lit("1.0").alias("version")).alias("agent"),
        F.struct(
            F.lit(NODE_METRIC_TYPE).alias("name"),
            F.lit("elasticsearch").alias("category"),
            F.lit("snapshot").alias("datatype"),
            F.struct(
                F.col("cluster_id").cast("string").alias("cluster_id"),
                F.col("node_id").cast("string").alias("node_id"),
                F.concat(F.lit("node-"), F.col("node_id").cast("string")).alias("node_name"),
                F.concat(addr, F.lit(":9300")).alias("transport_address"),
            ).alias("labels"),
        ).alias("metadata"),
        F.struct(
            F.struct(
                F.struct(
                    F.struct(
                        F.struct(size_bytes.alias("size_in_bytes"), F.concat(size_bytes.cast("string"), F.lit("b")).alias("size")).alias("store"),
                        F.struct(F.col("ops").alias("query_total"), F.col("time_ms").alias("query_time_in_millis")).alias("search"),
                        F.concat(F.col("node_id").cast("string"), F.lit("kb")).alias("estimated_size"),
                    ).alias("indices"),
                    F.struct(F.struct((size_bytes * 4).alias("heap_used_in_bytes"), F.lit("4gb").alias("limit_size")).alias("mem")).alias("jvm"),
                    F.struct(F.concat(F.lit("publish "), addr, F.lit(" up")).alias("publish_address")).alias("transport"),
                ).alias("node_stats")
            ).alias("elasticsearch")
        ).alias("payload"),
    )


def free_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as free-form documents in a VARIANT: addresses in values and
    in a key, human-readable sizes at two depths, an array of objects and texts."""
    ev = table(spark, sf_dir, "events")
    user = F.col("user_id").cast("string")
    addr = F.concat(F.lit("10."), (F.col("user_id") % 7).cast("string"), F.lit(".0."), user)
    text = F.concat(
        F.lit('{"addr":"publish '), addr, F.lit(' up","disk":{"10.1.1.1":"x","size_in_bytes":'), F.floor(F.col("value") * 1024).cast("string"),
        F.lit(',"store":"'), user, F.lit('kb"},"list":[{"at":"10.1.2.'), user, F.lit('","limit_size":"1gb","n":1},"192.168.0.'), user,
        F.lit('",{"n":2}],"props":'), F.col("props"), F.lit(',"store":{"estimated_size":null,"left":['), user, F.lit(']},"unused":[{"a":'), user, F.lit("}]}"),
    )
    return ev.select("event_id", F.parse_json(text).alias("doc"))


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``supplier`` as the cluster registry.

    Suppliers of nation 0 play the console's own system cluster: their names
    carry the ``CONSOLE-SYSTEM`` marker.
    """
    s = table(spark, sf_dir, "supplier")
    return s.select(
        F.col("s_suppkey").cast("string").alias("id"),
        F.when(F.col("s_nationkey") == 0, F.concat(F.lit("console-system-"), F.col("s_name"))).otherwise(F.col("s_name")).alias("name"),
        F.concat(F.lit("7."), F.col("s_nationkey").cast("string"), F.lit(".0")).alias("version"),
        F.concat(F.lit("http://es-"), F.col("s_suppkey").cast("string"), F.lit(":9200")).alias("endpoint"),
        (F.col("s_acctbal") > 0).alias("enabled"),
        (F.col("s_acctbal") > 1000).alias("monitored"),
    )


def cluster_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``supplier`` joined with ``nation`` as per-cluster status.

    Suppliers with a negative balance have no status row; region 4 is
    unavailable; region decides the health colour.
    """
    s = table(spark, sf_dir, "supplier").where(F.col("s_acctbal") >= 0)
    n = table(spark, sf_dir, "nation")
    j = s.join(n, s.s_nationkey == n.n_nationkey, "inner")
    health = (
        F.when(F.col("n_regionkey") <= 1, "green").when(F.col("n_regionkey") == 2, "yellow").when(F.col("n_regionkey") == 3, "red")
    )
    return j.select(
        F.col("s_suppkey").cast("string").alias("cluster_id"),
        (F.col("n_regionkey") != 4).alias("available"),
        F.struct(
            health.alias("status"),
            (F.col("n_regionkey") + 1).cast("bigint").alias("number_of_nodes"),
            F.col("n_nationkey").cast("bigint").alias("active_primary_shards"),
            (F.col("n_nationkey") * 2).cast("bigint").alias("active_shards"),
            F.when(F.col("n_regionkey") == 3, F.col("n_nationkey")).otherwise(0).cast("bigint").alias("unassigned_shards"),
        ).alias("health"),
    )


def cluster_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` rolled up per supplier as the per-cluster metric summary."""
    li = table(spark, sf_dir, "lineitem")
    g = li.groupBy("l_suppkey").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).alias("n_r"),
        F.sum(F.when(F.col("l_linestatus") == "F", 1).otherwise(0)).alias("n_f"),
        F.sum(F.when(F.col("l_linestatus") == "O", 1).otherwise(0)).alias("n_o"),
        F.max("l_linenumber").alias("max_line"),
        F.max("l_shipdate").alias("last_ship"),
        F.min("l_shipdate").alias("first_ship"),
        F.sum(F.when(F.col("l_linenumber") == 1, 1).otherwise(0)).alias("parts"),
        F.sum(F.when(F.col("l_linenumber") <= 2, 1).otherwise(0)).alias("orders"),
        F.sum(F.col("l_quantity").cast("bigint")).alias("qty"),
        F.sum(F.floor(F.col("l_extendedprice"))).alias("price"),
        F.max(F.floor(F.col("l_extendedprice"))).alias("max_price"),
    )
    return g.select(
        F.col("l_suppkey").cast("string").alias("cluster_id"),
        F.when(F.col("n") > 600, F.concat(F.lit("es-"), F.col("l_suppkey").cast("string"))).alias("cluster_name"),
        F.when(F.col("n_r") * 3 > F.col("n"), F.lit("yellow")).alias("status"),
        F.when(F.col("n") > 600, F.array(F.concat(F.lit("8."), F.col("max_line").cast("string")), F.lit("7.0"))).alias("version"),
        F.expr("timestampdiff(MILLISECOND, first_ship, last_ship)").alias("uptime"),
        F.greatest(F.col("n_f") - F.col("n_o"), F.lit(0)).cast("bigint").alias("nodes_count"),
        F.col("parts").cast("bigint").alias("indices_count"),
        F.col("orders").cast("bigint").alias("primary_shards"),
        F.col("n").cast("bigint").alias("total_shards"),
        (F.col("n") - F.col("n_r") - F.col("parts")).cast("bigint").alias("unassigned_shards"),
        F.col("qty").cast("bigint").alias("document_count"),
        (F.col("price") * 1024).cast("bigint").alias("used_store_bytes"),
        (F.col("price") * 2048).cast("bigint").alias("max_store_bytes"),
        (F.col("max_price") * 1024).cast("bigint").alias("used_jvm_bytes"),
        F.when(F.col("n") > 550, F.col("max_price") * 3072).otherwise(0).cast("bigint").alias("max_jvm_bytes"),
    )


def index_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``part`` grouped by (brand, type) as ``_cat/indices`` rows.

    A brand is a cluster; an index is named after the part type; ``PROMO``
    parts form a system index (leading dot).  Numbers arrive as text, and
    ``SMALL`` indices report an unparsable document count; ``LARGE`` ones
    are unavailable.
    """
    p = table(spark, sf_dir, "part")
    g = p.groupBy("p_brand", "p_type").agg(F.count(F.lit(1)).alias("n"), F.sum("p_size").alias("sz"))
    name = F.when(F.col("p_type") == "PROMO", F.lit(".promo")).otherwise(F.lower(F.col("p_type")))
    return g.select(
        F.col("p_brand").alias("cluster_id"),
        name.alias("index"),
        F.when(F.col("p_type") == "LARGE", F.lit("Unavailable")).otherwise(F.lit("green")).alias("health"),
        F.lit("open").alias("status"),
        F.when(F.col("p_type") == "SMALL", F.lit("n/a")).otherwise(F.col("n").cast("string")).alias("docs_count"),
        F.concat(F.col("sz").cast("string"), F.lit("kb")).alias("store_size"),
    )


def catalog_clusters(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Registry and status for the brand clusters of ``index_catalog``.

    Brands ending in 3 are unavailable, brands ending in 7 have no status.
    """
    brands = table(spark, sf_dir, "part").select(F.col("p_brand").alias("id")).distinct()
    reg = brands.select("id", F.concat(F.lit("cluster "), F.col("id")).alias("name"))
    status = brands.where(~F.col("id").endswith("7")).select(
        F.col("id").alias("cluster_id"), (~F.col("id").endswith("3")).alias("available")
    )
    return reg, status


def index_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``part`` rows as the documents of the catalog's indices."""
    p = table(spark, sf_dir, "part")
    name = F.when(F.col("p_type") == "PROMO", F.lit(".promo")).otherwise(F.lower(F.col("p_type")))
    return p.select(
        F.col("p_brand").alias("cluster_id"),
        name.alias("index"),
        F.col("p_partkey").cast("string").alias("_id"),
        F.col("p_partkey").alias("seq"),
        F.to_json(F.struct("p_name", "p_size", "p_retailprice")).alias("_source"),
    )


# Labels of the two sides of a benchmark comparison.

def benchmark_runs(spark: SparkSession, sf_dir: str, warmup: int = 2) -> DataFrame:
    """``lineitem`` joined with ``part`` as benchmark run rows.

    A query is a brand; the round is the line number; return flag ``R`` is an
    original run, ``A`` an optimized run and ``N`` a run of neither side, which
    counts in the totals alone; ``seq`` is the order of execution.  ``took`` is the quantity (missing when there is no
    discount), ``duration`` a tenth of the price in whole milliseconds,
    success = open line.
    """
    li = table(spark, sf_dir, "lineitem")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    j = li.join(p, li.l_partkey == p.p_partkey, "inner")
    flag = F.col("l_returnflag")
    qtype = F.when(flag == "R", F.lit(ORIGINAL)).when(flag == "A", F.lit(OPTIMIZED)).otherwise(F.lit("other"))
    qidx = F.regexp_extract(F.col("p_brand"), r"(\d+)$", 1).cast("int")
    runs = j.select(
        F.concat(F.col("p_brand"), F.lit(" ("), qtype, F.lit(")")).alias("name"),
        F.col("p_brand").alias("base_name"),
        qtype.alias("query_type"),
        qidx.alias("query_index"),
        F.col("l_linenumber").alias("iteration"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"),
        F.when(F.col("l_discount") != 0, F.col("l_quantity")).alias("took"),
        F.floor(F.col("l_extendedprice") / 10).cast("double").alias("duration"),
        (F.col("l_linestatus") == "O").alias("success"),
    )
    return number_rounds(runs, warmup)


def line_id() -> F.Column:
    """Identifier of a line item: order, line, part and supplier keys."""
    return F.concat_ws(
        "-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"),
        F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"),
    )


# Most shards in a stand-in response (the order priority digit picks 1..5).
MAX_SHARDS = 5


def search_profiles(spark: SparkSession, sf_dir: str, with_columns: list | None = None) -> DataFrame:
    """One search-profile response per order (nested, A28-A31).

    The order priority's digit gives 1-5 shards, built from the row alone:
    shard ``i`` has query time ``floor(total_price * 1000 / i)`` ns (its
    breakdown: score = half, build_scorer = a quarter, score_count = i),
    fetch ``floor(total_price / 10) * i`` ns, an aggregation of
    ``floor(total_price / 100) * i`` ns on finished orders, rewrite
    ``custkey * 10 * i`` ns, and a collector of ``floor(total_price) * i`` ns.
    The shard list is a slice of literal elements: no lambda, no shuffle.
    ``with_columns`` adds further order-derived columns in the same pass.
    """
    o = table(spark, sf_dir, "orders")
    price = F.col("o_totalprice")

    def shard(i: int):
        qn = F.floor(price * 1000 / i).cast("bigint")
        return F.struct(
            F.lit(i).alias("id"),
            F.concat(F.lit("idx-"), F.col("o_orderstatus")).alias("index"),
            F.concat(F.lit("node-"), (F.col("o_custkey") + i).cast("string")).alias("node_id"),
            F.array(
                F.struct(
                    (F.col("o_custkey") * 10 * i).alias("rewrite_time"),
                    F.array(
                        F.struct(
                            F.concat(F.lit("TermQuery"), F.col("o_orderstatus")).alias("type"),
                            F.concat(F.lit("cust:"), F.col("o_custkey").cast("string")).alias("description"),
                            qn.alias("time_in_nanos"),
                            F.create_map(
                                F.lit("score"), (qn / 2).cast("bigint"),
                                F.lit("score_count"), F.lit(i).cast("bigint"),
                                F.lit("build_scorer"), (qn / 4).cast("bigint"),
                            ).alias("breakdown"),
                        )
                    ).alias("query"),
                    F.array(
                        F.struct(
                            F.lit("SimpleTopScoreDocCollector").alias("name"),
                            F.lit("search_top_hits").alias("reason"),
                            (F.floor(price) * i).cast("bigint").alias("time_in_nanos"),
                        )
                    ).alias("collector"),
                )
            ).alias("searches"),
            F.struct((F.floor(price / 10) * i).cast("bigint").alias("time_in_nanos")).alias("fetch"),
            F.when(
                F.col("o_orderstatus") == "F", F.array(F.struct((F.floor(price / 100) * i).cast("bigint").alias("time_in_nanos")))
            ).alias("aggregations"),
        )

    count = F.substring(F.col("o_orderpriority"), 1, 1).cast("int")
    shards = F.slice(F.array(*[shard(i) for i in range(1, MAX_SHARDS + 1)]), 1, count)
    extra = list(with_columns or [])
    return materialized(o.select(F.col("o_orderkey").alias("run_id"), *extra, F.struct(shards.alias("shards")).alias("profile")))


def request_files(spark: SparkSession, sf_dir: str, preambles: bool = True) -> DataFrame:
    """One request file per order, two cases each (S12 stand-in).

    ``d`` is the order priority's digit.  Case 1 depends on the order status:
    ``P`` orders are multi-search requests with an NDJSON body, ``F`` orders
    search two indices, ``O`` orders call a cat endpoint (no body when
    ``d = 1``); ``2-HIGH`` finished orders carry a truncated JSON body,
    ``d = 4`` open orders have no method line and ``d = 5`` an empty title.
    Case 2 counts the documents behind the status alias.  ``d = 3`` files
    start with a preamble: stray text on finished orders, blank space
    otherwise.
    """
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("file_id"), _request_text(preambles).alias("text"))


def _request_text(preambles: bool) -> F.Column:
    """The text of an order's request file (see :func:`request_files`)."""
    st = F.col("o_orderstatus")
    d = F.substring(F.col("o_orderpriority"), 1, 1)
    title = (
        F.when(d == "5", F.lit("#"))
        .when(st == "F", F.concat(F.lit("## Q"), d, F.lit(" "), st))
        .otherwise(F.concat(F.lit("# Q"), d, F.lit(" "), st))
    )
    body_json = F.when((st == "F") & (d == "2"), F.lit('{"query":')).otherwise(
        F.concat(F.lit('{"query":{"term":{"cust":'), F.col("o_custkey").cast("string"), F.lit('}},"size":'), d, F.lit("}"))
    )
    request = (
        F.when((d == "4") & (st == "O"), F.lit(""))
        .when(st == "P", F.concat(F.lit('POST _msearch\n{"index":"idx-p"}\n{"query":{"match_all":{}},"size":'), d, F.lit("}")))
        .when(st == "F", F.concat(F.lit("GET idx-f,idx-"), d, F.lit("/_search?size="), d, F.lit("\n"), body_json))
        .otherwise(F.concat(F.lit("get /_cat/indices/idx-o"), F.when(d == "1", F.lit("")).otherwise(F.concat(F.lit("\n"), body_json))))
    )
    second = F.concat(F.lit("# Count "), st, F.lit("\nGET idx-"), F.lower(st), F.lit('/_count\n\n{"query":{"match_all":{}}}\n'))
    preamble = F.when(d == "3", F.when(st == "F", F.lit("stray text\n")).otherwise(F.lit("  \n"))).otherwise(F.lit(""))
    return F.concat(preamble if preambles else F.lit(""), title, F.lit("\n"), request, F.lit("\n\n"), second)


#: Logs that the orders' request texts are written to.
LOGS = 64


def request_logs(spark: SparkSession, sf_dir: str) -> str:
    """The orders' request texts (no preambles) written as log files: order k
    into log ``k % 64``, ascending.  The orders are shuffled and sorted, their
    texts follow from them afterwards.  Returns the folder."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", (F.col("o_orderkey") % LOGS).alias("log"))
    path = fresh_folder(spark, "request-logs")
    dealt = o.repartition(LOGS, "log").sortWithinPartitions("log", "o_orderkey")
    dealt.select("log", _request_text(preambles=False).alias("text")).write.partitionBy("log").text(path)
    return path


def alert_hits(spark: SparkSession, sf_dir: str) -> str:
    """``orders`` as the hits of an alert-history search, written as JSON
    Lines.  Returns the folder."""
    o = table(spark, sf_dir, "orders")
    source = F.struct(F.col("o_orderdate").cast("timestamp").alias("timestamp"), F.col("o_custkey").alias("rule_id"), F.col("o_orderstatus").alias("state"), F.concat(F.lit("10.0.0."), F.col("o_custkey").cast("string")).alias("node"))
    path = fresh_folder(spark, "alert-hits")
    o.select(F.col("o_orderkey").cast("string").alias("_id"), source.alias("_source"), F.array("o_orderkey").alias("sort")).write.json(path)
    return path


def run_logs(spark: SparkSession, sf_dir: str) -> str:
    """The benchmark runs written as JSON Lines run logs.  Returns the folder."""
    path = fresh_folder(spark, "run-logs")
    benchmark_runs(spark, sf_dir).write.json(path)
    return path


def metric_lines(spark: SparkSession, sf_dir: str) -> str:
    """``events`` as JSON Lines of node-stats documents that carry fields
    outside the declared schema, at the top and below the labels."""
    docs = metric_documents(spark, sf_dir)
    labels = F.col("metadata.labels").withField("zone", F.concat(F.lit("zone "), F.col("metadata.labels.transport_address")))
    user = F.col("metadata.labels.node_id")
    free = F.struct(F.concat(user, F.lit("kb")).alias("store"), F.array(user, F.lit("10.1.2.3")).alias("seen")).alias("free")
    docs = docs.select(F.col("_id").cast("string").alias("_id"), F.col("timestamp").cast("timestamp").alias("timestamp"), "agent", F.col("metadata").withField("labels", labels).alias("metadata"), "payload", free)
    path = fresh_folder(spark, "metric-lines")
    docs.repartition(16).write.json(path)
    return path


def index_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alias table: ``idx-<status>`` -> ``idx-<status>-<priority digit>`` for every pair in ``orders``."""
    o = table(spark, sf_dir, "orders").select(F.lower("o_orderstatus").alias("st"), F.substring("o_orderpriority", 1, 1).alias("d")).distinct()
    return o.select(
        F.concat(F.lit("idx-"), F.col("st")).alias("alias"),
        F.concat(F.lit("idx-"), F.col("st"), F.lit("-"), F.col("d")).alias("index"),
    )


def index_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``_cat/indices`` facts for the alias targets, numbers as text."""
    o = table(spark, sf_dir, "orders")
    g = o.groupBy(F.lower("o_orderstatus").alias("st"), F.substring("o_orderpriority", 1, 1).alias("d")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.floor("o_totalprice")).alias("sz")
    )
    return g.select(
        F.concat(F.lit("idx-"), F.col("st"), F.lit("-"), F.col("d")).alias("index"),
        F.lit("green").alias("health"),
        F.lit("open").alias("status"),
        F.col("d").alias("pri"),
        F.lit("1").alias("rep"),
        F.col("n").cast("string").alias("docs_count"),
        F.pmod(F.col("n"), F.lit(1000)).cast("string").alias("docs_deleted"),
        F.concat(F.col("sz").cast("string"), F.lit("kb")).alias("store_size"),
        F.concat(F.floor(F.col("sz") / 2).cast("string"), F.lit("kb")).alias("pri_store_size"),
    )


def alias_index_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mapping and settings text of the alias targets; the first priority has
    no settings, the last no mapping."""
    o = table(spark, sf_dir, "orders")
    g = o.select(F.lower("o_orderstatus").alias("st"), F.substring("o_orderpriority", 1, 1).alias("d")).distinct()
    return g.select(
        F.concat(F.lit("idx-"), F.col("st"), F.lit("-"), F.col("d")).alias("index"),
        F.when(F.col("d") != "5", F.concat(F.lit('{"properties":{"'), F.col("st"), F.lit('":{"type":"long"}}}'))).alias("mapping"),
        F.when(F.col("d") != "1", F.concat(F.lit('{"number_of_shards":"'), F.col("d"), F.lit('"}'))).alias("settings"),
    )


def index_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mapping and settings responses per catalog index, as JSON text.

    Keyed by index name as the search server answers; ``SMALL`` indices
    answer the mapping request with an error body instead.
    """
    p = table(spark, sf_dir, "part")
    name = F.when(F.col("p_type") == "PROMO", F.lit(".promo")).otherwise(F.lower(F.col("p_type")))
    g = p.groupBy("p_brand", "p_type").agg(F.count(F.lit(1)).alias("n"))
    mapping = F.when(F.col("p_type") == "SMALL", F.lit('{"error":"no such index"}')).otherwise(
        F.concat(F.lit('{"'), name, F.lit('":{"mappings":{"properties":{"p_name":{"type":"text"},"p_size":{"type":"integer"}}}}}'))
    )
    settings = F.concat(
        F.lit('{"'), name, F.lit('":{"settings":{"index":{"number_of_shards":"'), F.col("n").cast("string"),
        F.lit('","number_of_replicas":"1","routing":{"allocation":{"include":{"_tier_preference":"data_hot"}}}}}}}'),
    )
    return g.select(F.col("p_brand").alias("cluster_id"), name.alias("index_name"), mapping.alias("mapping_json"), settings.alias("settings_json"))


def cluster_health_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as cluster-health documents: colour from the event type,
    node count from the value."""
    ev = table(spark, sf_dir, "events")
    status = F.when(F.col("event_type") == "error", "red").when(F.col("event_type") == "signup", "yellow").otherwise("green")
    return ev.select(
        F.col("event_id").alias("_id"),
        F.col("ts").alias("timestamp"),
        (F.col("user_id") % 7).cast("string").alias("cluster_id"),
        status.alias("status"),
        (F.floor(F.col("value") / 10) + 1).cast("bigint").alias("number_of_nodes"),
    )
