"""Inventory exports as observations: CSV lists, cloud and cluster exports, port-scan results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tidegraph.model import OBSERVATIONS
from tidegraph.session import stage

# Fixed values -------------------------------------------------------------
CSV_COLUMNS = ("hostname", "ip", "zone", "service", "port", "owner")
DATABASE_PORT = 5432
SERVICE_PORT = 80
# --------------------------------------------------------------------------

VPCS = "Vpcs array<struct<VpcId:string, IsDefault:boolean>>"
INSTANCES = "Reservations array<struct<Instances:array<struct<InstanceId:string, VpcId:string, InstanceType:string, State:struct<Name:string>>>>>"
DATABASES = "DBInstances array<struct<DBInstanceIdentifier:string, Engine:string, DBInstanceStatus:string, PubliclyAccessible:boolean, Endpoint:struct<Port:int>>>"
ROLES = "Roles array<struct<RoleName:string, Arn:string>>"
AWS_EXPORT = ", ".join([VPCS, INSTANCES, DATABASES, ROLES])
AZURE_EXPORT = (
    "virtual_networks array<struct<id:string, location:string, name:string>>, "
    "virtual_machines array<struct<id:string, location:string, name:string, hardware_profile:struct<vm_size:string>>>"
)
GCP_EXPORT = "items map<string, struct<instances:array<struct<id:string, name:string, machine_type:string, status:string>>>>"
KUBERNETES_EXPORT = (
    "nodes array<struct<metadata:struct<uid:string, name:string>, status:struct<node_info:struct<os_image:string>>>>, "
    "pods array<struct<metadata:struct<uid:string, name:string, namespace:string>, status:struct<phase:string>, spec:struct<node_name:string>>>, "
    "services array<struct<metadata:struct<uid:string, name:string, namespace:string>, spec:struct<type:string, ports:array<struct<port:int>>>>>"
)


def shaped(rows: DataFrame, **columns: Column | str) -> DataFrame:
    """Rows in the observation layout; columns not named are NULL."""
    given = {k: F.lit(v) if isinstance(v, str) else v for k, v in columns.items()}
    return rows.select(*[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in OBSERVATIONS.fields])


def _attributes(**columns: Column | str) -> Column:
    """JSON object of the non-NULL columns."""
    return F.to_json(F.struct(*[(F.lit(v) if isinstance(v, str) else v).alias(k) for k, v in columns.items()]))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Inventory lists, each file with a header of its own in any column order and case; cells trimmed, empty cells NULL.

    A file's header is its first line that is not blank; further copies of that line are no data. Of columns with one name the
    first counts, and cells beyond the header are ignored. Records are single lines.
    """
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")]
    lines = spark.read.text(path).select("value", *place).where(F.trim("value") != "")
    lines = lines.withColumn("value", F.regexp_replace("value", "^\ufeff", ""))
    first = lines.where(F.col("block") == 0).withColumn("n", F.monotonically_increasing_id())  # ascending within a file
    headers = stage(first.groupBy("file").agg(F.min_by("value", "n").alias("header")), "headers")
    width = headers.agg(F.max(F.size(F.split("header", ","))).alias("n")).first()["n"] or 1
    cells = lambda line: F.array(*[F.from_csv(line, _row(width))[f"c{i}"] for i in range(width)])
    named = headers.select("file", "header", F.transform(cells(F.col("header")), lambda c: F.lower(F.trim(c))).alias("names"))
    rows = lines.join(named, "file").where(F.col("value") != F.col("header")).withColumn("cells", F.from_csv("value", _row(width)))
    found = F.array(*[F.col(f"cells.c{i}") for i in range(width)])
    return rows.select(*[F.nullif(F.trim(F.get(found, F.nullif(F.array_position("names", c), F.lit(0)).cast("int") - 1)), F.lit("")).alias(c) for c in CSV_COLUMNS])


def _row(width: int) -> str:
    return ", ".join(f"c{i} string" for i in range(width))


def _port() -> Column:
    """Port of a row; NULL if it does not read as one or does not fit."""
    return F.when(F.col("port").rlike("^[0-9]+$"), F.col("port").try_cast("int"))


def csv_observations(rows: DataFrame, observed_at: float, context: str = "default") -> DataFrame:
    """Zone, asset and service observations of the rows that have a hostname or an ip."""
    usable = rows.where(F.coalesce("hostname", "ip").isNotNull())
    host = F.coalesce("hostname", "ip")
    at, where = F.lit(float(observed_at)), F.lit(context)
    zones = shaped(usable.where(F.col("zone").isNotNull()), kind="zone", source="csv", name=F.col("zone"), observed_at=at, context=where,
                   evidence=F.array(F.concat(F.lit("csv:zone:"), "zone")))
    assets = shaped(usable, kind="asset", source="csv", hostname=F.col("hostname"), ip=F.col("ip"), observed_at=at, context=where,
                    evidence=F.array(F.concat(F.lit("csv:asset:"), host)), attributes_json=_attributes(owner=F.col("owner")))
    services = shaped(usable.where(F.col("service").isNotNull() & _port().isNotNull()), kind="service", source="csv", host_hostname=F.col("hostname"), host_ip=F.col("ip"), observed_at=at, context=where,
                      port=_port(), evidence=F.array(F.concat_ws(":", F.lit("csv:service"), host, _port().cast("string"))),
                      metadata_json=_attributes(name=F.col("service")))
    return zones.unionByName(assets).unionByName(services)


def csv_counts(rows: DataFrame) -> DataFrame:
    """parsed_rows, skipped_rows, and skipped_services: parsed rows that name a service without a usable port."""
    usable = F.coalesce("hostname", "ip").isNotNull()
    return rows.agg(F.count_if(usable).alias("parsed_rows"), F.count_if(~usable).alias("skipped_rows"),
                    F.count_if(usable & F.col("service").isNotNull() & _port().isNull()).alias("skipped_services"))


def read_export(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON page of an export per line."""
    return spark.read.schema(schema).json(path)


def aws_observations(pages: DataFrame, observed_at: float, region: str = "us-east-1") -> DataFrame:
    """Networks and instances as assets, managed databases as services, roles as identities."""
    at = F.lit(float(observed_at))
    vpcs = shaped(
        pages.select(F.explode("Vpcs").alias("x")).select("x.*"), kind="asset", source="aws", cloud_id=F.col("VpcId"), observed_at=at,
        evidence=F.array(F.lit("aws:ec2:describe-vpcs")),
        attributes_json=_attributes(cloud_provider="aws", region=region, vpc_id=F.col("VpcId"), is_default=F.coalesce("IsDefault", F.lit(False))))
    found = pages.select(F.explode("Reservations").alias("r")).select(F.explode("r.Instances").alias("x")).select("x.*")
    instances = shaped(
        found, kind="asset", source="aws", cloud_id=F.col("InstanceId"), observed_at=at, evidence=F.array(F.lit("aws:ec2:describe-instances")),
        attributes_json=_attributes(cloud_provider="aws", instance_type=F.col("InstanceType"), vpc_id=F.coalesce("VpcId", F.lit("unknown")), state=F.col("State.Name")))
    databases = shaped(
        pages.select(F.explode("DBInstances").alias("x")).select("x.*"), kind="service", source="aws", host_cloud_id=F.col("DBInstanceIdentifier"), observed_at=at,
        evidence=F.array(F.lit("aws:rds:describe-db-instances")), port=F.coalesce("Endpoint.Port", F.lit(DATABASE_PORT)), product_signature=F.coalesce("Engine", F.lit("unknown")),
        metadata_json=_attributes(cloud_provider="aws", status=F.col("DBInstanceStatus"), public=F.coalesce("PubliclyAccessible", F.lit(False))))
    roles = shaped(
        pages.select(F.explode("Roles").alias("x")).select("x.*"), kind="identity", source="aws", iam_id=F.col("Arn"), identity_type="role", observed_at=at,
        evidence=F.array(F.lit("aws:iam:list-roles")), attributes_json=_attributes(cloud_provider="aws", name=F.col("RoleName")))
    return vpcs.unionByName(instances).unionByName(databases).unionByName(roles)


def azure_observations(pages: DataFrame, observed_at: float) -> DataFrame:
    """Virtual networks and machines as assets."""
    at = F.lit(float(observed_at))
    networks = shaped(
        pages.select(F.explode("virtual_networks").alias("x")).select("x.*"), kind="asset", source="azure", cloud_id=F.col("id"), observed_at=at,
        evidence=F.array(F.lit("azure:network:vnet")), attributes_json=_attributes(cloud_provider="azure", location=F.col("location"), name=F.col("name")))
    machines = shaped(
        pages.select(F.explode("virtual_machines").alias("x")).select("x.*"), kind="asset", source="azure", cloud_id=F.col("id"), observed_at=at,
        evidence=F.array(F.lit("azure:compute:vm")),
        attributes_json=_attributes(cloud_provider="azure", location=F.col("location"), name=F.col("name"), vm_size=F.coalesce("hardware_profile.vm_size", F.lit("unknown"))))
    return networks.unionByName(machines)


def _last(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def gcp_observations(pages: DataFrame, observed_at: float) -> DataFrame:
    """Instances per zone as assets; zone and machine type are the last part of their path."""
    rows = pages.select(F.explode("items").alias("place", "v")).select("place", F.explode("v.instances").alias("x")).select("place", "x.*")
    return shaped(
        rows, kind="asset", source="gcp", cloud_id=F.col("id"), observed_at=F.lit(float(observed_at)), evidence=F.array(F.lit("gcp:compute:instance")),
        attributes_json=_attributes(cloud_provider="gcp", zone=_last(F.col("place")), name=F.col("name"),
                                    machine_type=F.coalesce(F.nullif(_last(F.col("machine_type")), F.lit("")), F.lit("unknown")), status=F.col("status")))


def kubernetes_observations(pages: DataFrame, observed_at: float, cluster: str = "unknown") -> DataFrame:
    """Nodes and pods as assets; services with their first port, 80 without one."""
    at = F.lit(float(observed_at))
    nodes = shaped(
        pages.select(F.explode("nodes").alias("x")), kind="asset", source="kubernetes", cloud_id=F.col("x.metadata.uid"), observed_at=at, evidence=F.array(F.lit("k8s:node:list")),
        attributes_json=_attributes(cloud_provider="kubernetes", cluster_name=cluster, name=F.col("x.metadata.name"), os_image=F.col("x.status.node_info.os_image")))
    pods = shaped(
        pages.select(F.explode("pods").alias("x")), kind="asset", source="kubernetes", cloud_id=F.col("x.metadata.uid"), observed_at=at, evidence=F.array(F.lit("k8s:pod:list")),
        attributes_json=_attributes(cloud_provider="kubernetes", namespace=F.col("x.metadata.namespace"), name=F.col("x.metadata.name"), status=F.col("x.status.phase"), node_name=F.col("x.spec.node_name")))
    services = shaped(
        pages.select(F.explode("services").alias("x")), kind="service", source="kubernetes", host_cloud_id=F.col("x.metadata.uid"), observed_at=at, evidence=F.array(F.lit("k8s:service:list")),
        port=F.coalesce(F.try_element_at(F.col("x.spec.ports"), F.lit(1))["port"], F.lit(SERVICE_PORT)), product_signature="k8s-service",
        metadata_json=_attributes(cloud_provider="kubernetes", name=F.col("x.metadata.name"), namespace=F.col("x.metadata.namespace"), type=F.col("x.spec.type")))
    return nodes.unionByName(pods).unionByName(services)


def scan_observations(results: DataFrame) -> DataFrame:
    """Port-scan result rows (target, ip, port, open, observed_at): an asset per target, a service per open port."""
    hosts = results.groupBy("target", "ip").agg(F.min("observed_at").alias("observed_at"))
    assets = shaped(hosts, kind="asset", source="NetworkDiscoveryScanner", hostname=F.col("target"), ip=F.col("ip"), observed_at=F.col("observed_at"),
                    evidence=F.array(F.lit("socket:gethostbyname")))
    services = shaped(results.where("open"), kind="service", source="NetworkDiscoveryScanner", host_hostname=F.col("target"), host_ip=F.col("ip"), port=F.col("port"),
                      product_signature="unknown", observed_at=F.col("observed_at"), evidence=F.array(F.concat(F.lit("socket:connect:"), F.col("port").cast("string"))),
                      metadata_json=F.lit('{"status":"open"}'))
    return assets.unionByName(services)
