"""A temporal graph derived from the TPC-H style tables.

Regions are zones, suppliers assets, parts datastores, customers identities, orders services. Every row
of the tables takes part; validity, provenance, confidence and repeated observations come from the
tables' own dates, balances, priorities and discounts, so the log has expired, superseded, unknown and
contradicting assertions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tidegraph.model import ASSERTIONS
from tidegraph.plans.view import Graph
from tidegraph.session import stage
from tidegraph.sources.inventory import shaped

YEAR = 365 * 86400.0
NOW = 959817600.0         # 2000-06-01
EARLIER = 915148800.0     # 1999-01-01


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def seconds(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp")) / F.lit(1e6)


def _key(prefix: str, column: str) -> Column:
    return F.concat(F.lit(prefix), F.col(column))


def _edge_confidence(a: str, b: str) -> Column:
    return F.lit(0.5) + F.pmod(F.col(a) * 31 + F.col(b) * 17, F.lit(50)) / F.lit(100.0)


def _refs(first: Column, second: Column | None = None) -> Column:
    """One or two references in order, null last; made in generated code, as these run once per assertion of the log."""
    if second is None:
        return F.array(first)
    return F.array(F.least(first, second), F.when(first.isNotNull() & second.isNotNull(), F.greatest(first, second)))


def order_hosts(lineitem: DataFrame) -> DataFrame:
    return lineitem.groupBy("l_orderkey").agg(F.min("l_suppkey").alias("host"))


def part_hosts(lineitem: DataFrame) -> DataFrame:
    return lineitem.groupBy("l_partkey").agg(F.min("l_suppkey").alias("host"))


def _by_order(lineitem: DataFrame, *columns: str) -> DataFrame:
    """Lines dealt by order, once for their grouping and for the join of their orders."""
    return lineitem.select(*columns).repartition("l_orderkey")


def _ordered(lineitem: DataFrame) -> DataFrame:
    """Lines of known orders as their links and their parts read them: both use all of these columns, so that one shuffle serves both."""
    return _by_order(lineitem.where(F.col("l_orderkey").isNotNull()), "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey")


def supplier_links(lineitem: DataFrame) -> DataFrame:
    """Suppliers of consecutive lines of an order, each pair once; lines without an order follow each other too."""
    following = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_suppkey", "l_partkey")

    def pairs(lines: DataFrame) -> DataFrame:
        return lines.select(F.col("l_suppkey").alias("a"), F.lead("l_suppkey").over(following).alias("b")).where(F.col("a") != F.col("b"))
    return pairs(_ordered(lineitem)).unionByName(pairs(lineitem.where(F.col("l_orderkey").isNull()))).distinct()


def order_parts(lineitem: DataFrame) -> DataFrame:
    """Distinct parts of each known order with the order's ``host``; ``place`` 1 is the part of its first line."""
    parts = _ordered(lineitem).groupBy("l_orderkey", "l_partkey").agg(F.min("l_suppkey").alias("least"), F.min("l_linenumber").alias("line"))
    order = Window.partitionBy("l_orderkey").orderBy("line", "l_partkey")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return parts.select("l_orderkey", "l_partkey", F.min("least").over(whole).alias("host"), F.row_number().over(order).alias("place"))


def graph_nodes(spark: SparkSession, folder: str) -> DataFrame:
    def nodes(table: str, prefix: str, key: str, kind: str, natural: list[Column]) -> DataFrame:
        return read(spark, folder, table).select(_key(prefix, key).alias("id"), F.lit(kind).alias("type"), F.to_json(F.struct(*natural)).alias("key_json"))

    zone_name = F.when(F.col("r_name") == "ASIA", "ASIA-DMZ").otherwise(F.col("r_name"))
    return (
        nodes("region", "z_", "r_regionkey", "ZONE", [zone_name.alias("name")])
        .unionByName(nodes("supplier", "s_", "s_suppkey", "ASSET", [F.col("s_name").alias("hostname")]))
        .unionByName(nodes("part", "p_", "p_partkey", "DATASTORE", [_key("part-", "p_partkey").alias("cloud_id")]))
        .unionByName(nodes("customer", "c_", "c_custkey", "IDENTITY", [F.col("c_name").alias("principal")]))
        .unionByName(nodes("orders", "o_", "o_orderkey", "SERVICE", [_key("order-", "o_orderkey").alias("asset")]))
    )


def graph_edges(spark: SparkSession, folder: str) -> DataFrame:
    """Edges with the columns their assertions need."""
    lineitem = read(spark, folder, "lineitem")
    orders = read(spark, folder, "orders")
    nation = read(spark, folder, "nation")

    def edge(id_: Column, kind: str, src: Column, dst: Column, confidence: Column, since: Column) -> list[Column]:
        return [id_.alias("id"), F.lit(kind).alias("type"), src.alias("src"), dst.alias("dst"), F.lit("default").alias("context"),
                confidence.alias("confidence"), since.alias("valid_from")]

    def edges(df: DataFrame, *columns: object) -> DataFrame:
        return df.select(*edge(*columns))

    zero = F.lit(0.0)
    zones = read(spark, folder, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    dated = seconds("o_orderdate")
    hosted = F.struct(*edge(_key("ho_", "l_orderkey"), "HOSTS", _key("s_", "host"), _key("o_", "l_orderkey"), _edge_confidence("host", "l_orderkey"), dated))
    depends = F.struct(*edge(F.concat_ws("_", F.lit("dp"), "l_orderkey", "l_partkey"), "DEPENDS_ON", _key("o_", "l_orderkey"), _key("p_", "l_partkey"), F.lit(None).cast("double"), dated))
    of_orders = order_parts(lineitem).join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return (
        edges(zones, _key("iz_", "s_suppkey"), "IN_ZONE", _key("s_", "s_suppkey"), _key("z_", "n_regionkey"), _edge_confidence("s_suppkey", "n_regionkey"), zero)
        .unionByName(of_orders.select(F.inline(F.when(F.col("place") == 1, F.array(depends, hosted)).otherwise(F.array(depends)))))
        .unionByName(edges(part_hosts(lineitem), _key("hp_", "l_partkey"), "HOSTS", _key("s_", "host"), _key("p_", "l_partkey"), _edge_confidence("host", "l_partkey"), zero))
        .unionByName(edges(supplier_links(lineitem), F.concat_ws("_", F.lit("ct"), "a", "b"), "CONNECTS_TO", _key("s_", "a"), _key("s_", "b"), _edge_confidence("a", "b"), zero))
        .unionByName(edges(orders, F.concat_ws("_", F.lit("au"), "o_custkey", "o_orderkey"), "AUTHENTICATES_TO", _key("c_", "o_custkey"), _key("o_", "o_orderkey"), _edge_confidence("o_custkey", "o_orderkey"), dated))
    )


def _assert(df: DataFrame, id_: Column, kind: str, target: Column, value: Column, provenance: Column, confidence: Column, source: str,
            since: Column, evidence: Column, observed: Column | None = None, until: Column | None = None, ttl: Column | None = None) -> DataFrame:
    none = F.lit(None).cast("double")
    return df.select(
        id_.alias("id"), F.lit(kind).alias("target_kind"), target.alias("target_id"), value.alias("value_json"), provenance.cast("int").alias("provenance"),
        confidence.alias("confidence"), F.lit(source).alias("source"), F.lit("default").alias("context"), since.alias("valid_from"),
        (none if until is None else until).alias("valid_to"), (since if observed is None else observed).alias("observed_at"),
        evidence.alias("evidence"), F.when(provenance == 1, 1).otherwise(0).alias("inferred_depth"), (none if ttl is None else ttl).alias("ttl"),
    )


def node_assertions(spark: SparkSession, folder: str) -> DataFrame:
    zero, one = F.lit(0.0), F.lit(3)
    region = read(spark, folder, "region")
    supplier = read(spark, folder, "supplier")
    part = read(spark, folder, "part")
    customer = read(spark, folder, "customer")
    orders = read(spark, folder, "orders")

    zones = _assert(region, _key("a_z_", "r_regionkey"), "node", _key("z_", "r_regionkey"), F.to_json(F.struct(
        F.col("r_name").alias("name"), F.when(F.col("r_name") == "EUROPE", "external").alias("classification"))),
        one, F.lit(1.0), "atlas", zero, _refs(_key("atlas:", "r_regionkey")))

    env = F.when(F.col("s_nationkey") < 5, "prod").when(F.col("s_nationkey") < 10, "Staging").when(F.col("s_nationkey") < 15, "dev").when(F.col("s_nationkey") < 20, "test")
    tags = F.struct(env.alias("env"), F.when(F.col("s_acctbal") >= 5000, _key("tech-", "s_nationkey")).alias("owner:tech"),
                    F.when(F.col("s_acctbal") >= 8000, _key("biz-", "s_nationkey")).alias("business_owner"))
    common = [F.col("s_name").alias("name"), (F.col("s_acctbal") / 10000.0).alias("business_importance"),
              F.when(F.col("s_acctbal") < 1000, "LoadBalancer").alias("type"), F.when(F.col("s_nationkey") >= 20, "aws").alias("cloud_provider"), tags.alias("tags")]
    plain = F.to_json(F.struct(*common, (F.col("s_acctbal") >= 9000).alias("public")))
    opened = F.to_json(F.struct(*common, F.lit(True).alias("exposed")))
    at = _key("s_", "s_suppkey")
    suppliers = _assert(supplier, _key("a_s_", "s_suppkey"), "node", at, plain, one, F.lit(0.9), "scan", zero, _refs(_key("scan:", "s_suppkey"), F.lit("scan:all")))
    reviews = _assert(supplier.where(F.col("s_acctbal") >= 0), _key("b_s_", "s_suppkey"), "node", at, opened, F.lit(2), F.lit(0.99), "review",
                      F.lit(850000000.0), _refs(_key("review:", "s_suppkey")))
    guesses = _assert(supplier.where(F.col("s_acctbal") < 3000), _key("c_s_", "s_suppkey"), "node", at, plain, F.lit(1), F.lit(0.7), "model",
                      F.lit(EARLIER), _refs(F.lit("model:1")), ttl=F.lit(YEAR))
    audits = _assert(supplier.where(F.col("s_nationkey") < 8), _key("d_s_", "s_suppkey"), "node", at, opened, one, F.lit(0.95), "audit",
                     F.lit(883612800.0), _refs(_key("audit:", "s_nationkey")), until=F.lit(946684800.0))

    label = F.concat("p_name", F.when(F.col("p_size") <= 10, "-log").when(F.col("p_size") <= 20, "-customer").otherwise(""))
    sensitivity = F.when(F.col("p_type") == "PROMO", "PCI").when(F.col("p_type") == "LARGE", "pii").when(F.col("p_type") == "SMALL", "internal").when(F.col("p_type") == "MEDIUM", "open")
    parts = _assert(part, _key("a_p_", "p_partkey"), "node", _key("p_", "p_partkey"), F.to_json(F.struct(
        label.alias("name"), F.lower("p_type").alias("kind"), F.struct(sensitivity.alias("sensitivity"), F.when(F.col("p_retailprice") > 1500, F.lit("finance")).alias("owner:business")).alias("tags"))),
        one, F.lit(0.6) + F.pmod(F.col("p_size"), F.lit(40)) / F.lit(100.0), "catalog", zero, _refs(_key("brand:", "p_brand"), _key("type:", "p_type")))

    customers = _assert(customer, _key("a_c_", "c_custkey"), "node", _key("c_", "c_custkey"), F.to_json(F.struct(
        F.col("c_name").alias("name"), (F.col("c_acctbal") / 10000.0).alias("business_importance"),
        F.struct(F.when(F.col("c_acctbal") < 7000, F.col("c_mktsegment")).alias("team")).alias("tags"))),
        F.when(F.col("c_acctbal") < 0, 0).otherwise(3), F.lit(0.85), "directory", zero, _refs(_key("segment:", "c_mktsegment")))

    trust = (F.when(F.col("o_orderpriority") == "1-URGENT", 0.95).when(F.col("o_orderpriority") == "2-HIGH", 0.9)
             .when(F.col("o_orderpriority") == "3-MEDIUM", 0.8).when(F.col("o_orderpriority") == "5-LOW", 0.45).otherwise(0.6))
    port = (F.when(F.col("o_orderpriority") == "1-URGENT", 443).when(F.col("o_orderpriority") == "2-HIGH", 80)
            .when(F.col("o_orderpriority") == "5-LOW", 3306).otherwise(8080))
    product = F.when(F.col("o_orderpriority") == "5-LOW", "mysql")
    suffix = F.when(F.col("o_totalprice") >= 450000, "-payment").when(F.col("o_orderstatus") == "O", "-prod").when(F.col("o_orderstatus") == "P", "-dev").otherwise("")
    services = _assert(orders, _key("a_o_", "o_orderkey"), "node", _key("o_", "o_orderkey"), F.to_json(F.struct(
        F.concat(F.lit("svc-"), "o_orderkey", suffix).alias("name"), port.alias("port"), product.alias("product_signature"))),
        F.when(F.col("o_orderstatus") == "P", 2).otherwise(3), trust, "probe", seconds("o_orderdate"), _refs(_key("probe:", "o_orderkey")),
        until=F.when(F.col("o_orderstatus") == "F", seconds("o_orderdate") + YEAR), ttl=F.when(F.col("o_orderstatus") == "P", F.lit(3 * YEAR)))
    out = zones
    for more in (suppliers, reviews, guesses, audits, parts, customers, services):
        out = out.unionByName(more)
    return out


def edge_assertions(spark: SparkSession, folder: str, edges: DataFrame) -> DataFrame:
    """One assertion per edge, and for a dependency one per (order, part, supplier) line."""
    value = F.lit('{"exists":true}')
    single = edges.where(F.col("type") != "DEPENDS_ON")
    guess = (F.col("type") == "CONNECTS_TO") & (F.col("confidence") < 0.6)
    plain = _assert(single, _key("a_", "id"), "edge", F.col("id"), value, F.when(guess, 1).otherwise(3), F.col("confidence"), "scan", F.col("valid_from"), _refs(_key("edge:", "type")))
    lines = (
        _by_order(read(spark, folder, "lineitem"), "l_orderkey", "l_partkey", "l_suppkey", "l_discount", "l_shipdate")
        .groupBy("l_orderkey", "l_partkey", "l_suppkey")
        .agg(F.max("l_discount").alias("discount"), F.max("l_shipdate").alias("shipped"))
        .join(read(spark, folder, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    )
    depends = _assert(
        lines, F.concat_ws("_", F.lit("a_dp"), "l_orderkey", "l_partkey", "l_suppkey"), "edge", F.concat_ws("_", F.lit("dp"), "l_orderkey", "l_partkey"), value,
        F.lit(3), F.lit(0.5) + F.col("discount") * F.lit(4.0), "flow", seconds("o_orderdate"), _refs(_key("line:", "l_suppkey"), _key("order:", "l_orderkey")),
        observed=seconds("shipped"))
    return plain.unionByName(depends)


def graph_log(spark: SparkSession, folder: str, edges: DataFrame) -> DataFrame:
    """All assertions; ``edges``: the ``graph_edges``, stored, as they are read for edges and for assertions."""
    log = node_assertions(spark, folder).unionByName(edge_assertions(spark, folder, edges))
    return log.select(*[F.col(f.name).cast(f.dataType) for f in ASSERTIONS.fields])


def derive_graph(spark: SparkSession, folder: str) -> Graph:
    """The graph as stored tables."""
    edges = stage(graph_edges(spark, folder), "derived_edges")
    log = graph_log(spark, folder, edges)
    return Graph(stage(graph_nodes(spark, folder), "derived_nodes"), edges.select("id", "type", "src", "dst", "context"), stage(log, "derived_assertions"))


def event_log(spark: SparkSession, folder: str) -> DataFrame:
    """User events as assertions on users: one log with several contexts and lasting conflicts."""
    e = read(spark, folder, "events")
    kind = F.col("event_type")
    provenance = F.when(kind == "error", 0).when(kind == "view", 1).when(kind == "click", 2).otherwise(3)
    at = seconds("ts")
    return e.select(
        F.lpad(F.col("event_id").cast("string"), 12, "0").alias("id"), F.lit("node").alias("target_kind"), _key("u_", "user_id").alias("target_id"),
        F.concat(F.lit('{"event":"'), kind, F.lit('"}')).alias("value_json"), provenance.cast("int").alias("provenance"),
        (F.pmod("event_id", F.lit(100)) / F.lit(100.0)).alias("confidence"), kind.alias("source"),
        F.when(F.col("value") >= 90, "shadow").otherwise("default").alias("context"), at.alias("valid_from"),
        F.when(kind == "purchase", at + 10 * 86400.0).alias("valid_to"), at.alias("observed_at"),
        F.array(_key("type:", "event_type")).alias("evidence"), F.when(provenance == 1, 1).otherwise(0).alias("inferred_depth"),
        F.when(provenance == 1, F.lit(604800.0)).alias("ttl"),
    )


def observations(spark: SparkSession, folder: str) -> DataFrame:
    """Raw observations of the same things, with natural keys of several kinds and some faulty rows."""
    lineitem = read(spark, folder, "lineitem")
    nation = read(spark, folder, "nation")
    region = read(spark, folder, "region")
    supplier = read(spark, folder, "supplier")
    balance = F.col("s_acctbal")
    keys = {
        "mac": F.when(balance >= 8000, _key("02:", "s_suppkey")).otherwise(""), "cloud_id": F.when(balance < 1000, _key("i-", "s_suppkey")),
        "hostname": F.when(balance < 9500, F.col("s_name")), "ip": _key("10.0.0.", "s_suppkey"),
    }
    host = {f"host_{k}": v for k, v in keys.items()}
    at = F.lit(EARLIER)
    zones = shaped(region.where(F.col("r_name") != "AFRICA"), kind="zone", source="atlas", name=F.col("r_name"), observed_at=at, evidence=F.array(_key("atlas:", "r_regionkey")))
    located = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    assets = shaped(located, kind="asset", source="scan", zone=F.col("r_name"), observed_at=at, evidence=F.array(_key("scan:", "s_suppkey"), F.lit("scan:all")),
                    attributes_json=F.to_json(F.struct(F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"))), **keys)
    served = order_hosts(lineitem).join(read(spark, folder, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(supplier, F.col("host") == F.col("s_suppkey"))
    rank = F.col("o_orderpriority")
    services = shaped(
        served, kind="service", source="probe", observed_at=seconds("o_orderdate"), port=F.when(rank == "1-URGENT", F.col("o_orderkey").cast("int")).when(rank == "2-HIGH", 0),
        product_signature=F.when(rank == "3-MEDIUM", _key("app-", "o_orderkey")),
        metadata_json=F.when(rank == "5-LOW", F.to_json(F.struct(F.col("o_orderkey").alias("order")))),
        evidence=F.when(F.col("o_totalprice") >= 2000, F.array(_key("probe:", "o_orderkey"))), attributes_json=F.to_json(F.struct(F.col("o_orderstatus").alias("status"))), **host)
    identities = shaped(
        read(spark, folder, "customer"), kind="identity", source="directory", observed_at=at, principal=F.when(F.col("c_acctbal") >= 0, F.col("c_name")).otherwise(""),
        email=F.when(F.col("c_acctbal") < 9000, F.concat(F.lit("c"), "c_custkey", F.lit("@example.com"))), identity_type="user", evidence=F.array(_key("segment:", "c_mktsegment")),
        member_of=F.array(F.lower("c_mktsegment"), _key("nation-", "c_nationkey")), provenance=F.when(F.col("c_acctbal") < 0, 0))
    placed = read(spark, folder, "part").join(part_hosts(lineitem), F.col("p_partkey") == F.col("l_partkey"), "left").join(supplier, F.col("host") == F.col("s_suppkey"), "left")
    stores = shaped(
        placed, kind="datastore", source="catalog", observed_at=at, cloud_id=F.when(F.col("p_size") >= 25, _key("vol-", "p_partkey")), name=F.concat_ws("-", "p_name", "p_partkey"),
        evidence=F.array(_key("brand:", "p_brand")), confidence=F.when(F.col("p_size") == 50, 1.2).when(F.col("p_size") < 10, 0.7),
        valid_to=F.when(F.col("p_size") == 49, F.lit(EARLIER - 1.0)), attributes_json=F.to_json(F.struct(F.col("p_type").alias("kind"))), **host)
    return zones.unionByName(assets).unionByName(services).unionByName(identities).unionByName(stores)
