"""Small dimension tables for the registered queries, and the ones derived from ``events``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions import clock
from ..operators.enrich import geo_blocks
from .event_packets import CAPTURE, K, REMOTE

COUNTRIES = [
    ("8.8.8.0", "8.8.8.255", "US", "United States"),
    ("35.208.0.0", "35.247.255.255", "US", "United States"),
    ("93.184.216.0", "93.184.216.255", "GB", None),
    ("210.128.0.0", "210.255.255.255", "JP", "Japan"),
    ("2606:4700::", "2606:4700:ffff:ffff:ffff:ffff:ffff:ffff", "CA", "Canada"),
]
ASNS = [
    ("8.8.8.0", "8.8.8.255", 15169, "Google"),
    ("35.208.0.0", "35.247.255.255", 396982, "Google Cloud"),
    ("93.184.216.0", "93.184.216.255", 15133, ""),
    ("210.140.0.0", "210.140.255.255", 0, "nobody"),
    ("2606:4700::", "2606:4700:ffff:ffff:ffff:ffff:ffff:ffff", 13335, "Cloudflare"),
]


def geo_country(spark: SparkSession) -> DataFrame:
    return geo_blocks(spark.createDataFrame(COUNTRIES, "start_ip string, end_ip string, code string, name string"))


def geo_asn(spark: SparkSession) -> DataFrame:
    return geo_blocks(spark.createDataFrame(ASNS, "start_ip string, end_ip string, asn int, organization string"))


def ptr_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reverse-lookup observations taken from ``events``: one per event, every fourth one negative."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.selectExpr("*", f"{K} AS k").selectExpr(
        f"{REMOTE} AS ip",
        "CASE WHEN event_id % 4 <> 0 THEN concat('host', k % 8, '.example.net.') END AS hostname",
        f"{clock.ntz_micros('ts')} AS observed_us",
    )


def socket_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Socket observations taken from ``events``: the client port of each event's user."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    name = "element_at(array('firefox', 'Clash for Windows', 'sshd', 'Transmission'), CAST(user_id % 4 AS INT) + 1)"
    found = "CASE WHEN event_id % 6 <> 0 THEN"
    return e.selectExpr(
        f"{CAPTURE.format(user='user_id')} AS capture_id",
        f"CASE WHEN {K} % 8 = 0 THEN 'udp' ELSE 'tcp' END AS proto",
        "CAST(49152 + user_id % 16384 AS INT) AS port",
        f"{clock.ntz_micros('ts')} AS observed_us",
        f"{found} {name} END AS name", f"{found} user_id END AS pid",
        f"{found} concat('/Applications/', {name}, '.app/Contents/MacOS/x') END AS path",
    )


def local_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses of the capturing hosts.  A capture has a few of its addresses on its own
    machine, so the set selects: the private side of every fourth user of it."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").where("user_id div 6 % 4 = 0")
    return e.selectExpr(
        f"{CAPTURE.format(user='user_id')} AS capture_id", "concat('10.0.', user_id div 256, '.', user_id % 256) AS ip"
    ).distinct()
