"""Tables of observers, peaks, towers and sensor events derived from the driver's tables.

Texts are SQL that Spark and other engines evaluate alike; DIV stands for integer division.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

SQL = {
    "observers": "SELECT c_custkey AS obs_id, 45 + (c_custkey * 7919 % 300000) / 1e5 AS lat, 6 + (c_custkey * 104729 % 400000) / 1e5 AS lon, 20000 + (c_custkey % 5) * 20000.0 AS radius FROM {customer}",
    "peaks": "SELECT p_partkey AS id, p_name AS name, 44 + (p_partkey DIV 1000 + 2) % 5 + ((p_partkey * p_partkey * 31 + p_partkey * 7919) % 99991) / 1e5 AS lat, 8 + (p_partkey DIV 5000) % 8 + ((p_partkey * p_partkey * 57 + p_partkey * 4729) % 99989) / 1e5 AS lon, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE 800 + (p_retailprice - 900) * 30 END AS ele, CASE WHEN p_partkey % 5 = 0 THEN 'volcano' ELSE 'peak' END AS kind, CASE WHEN p_partkey % 3 = 0 THEN concat('Q', CAST(p_partkey AS VARCHAR(20))) END AS qid FROM {part}",
    "fame": "SELECT concat('Q', CAST(p_partkey AS VARCHAR(20))) AS qid, p_partkey % 80 AS n FROM {part} WHERE p_partkey % 6 = 0",
    "towers": "SELECT s_suppkey AS id, s_name AS name, 45 + (s_suppkey * 7919 % 300000) / 1e5 AS lat, 6 + (s_suppkey * 104729 % 400000) / 1e5 AS lon, CASE s_suppkey % 4 WHEN 0 THEN 'tower' WHEN 1 THEN 'mast' WHEN 2 THEN 'chimney' ELSE 'communications_tower' END AS man_made, CASE s_suppkey % 5 WHEN 0 THEN 'communication' WHEN 1 THEN 'lookout' WHEN 2 THEN 'minaret' END AS tower_type, concat(CAST(s_suppkey * 37 % 190 AS VARCHAR(20)), CASE s_suppkey % 4 WHEN 1 THEN ' m' WHEN 2 THEN ' ft' WHEN 3 THEN ',5' ELSE '' END) AS height_text, concat(CASE WHEN s_suppkey % 11 = 0 THEN '-' ELSE '' END, CAST(s_suppkey * 53 % 9700 AS VARCHAR(20)), CASE s_suppkey % 5 WHEN 1 THEN ' m' WHEN 2 THEN ' ft' WHEN 3 THEN ',25' WHEN 4 THEN '''' ELSE ';12' END) AS ele_text FROM {supplier}",
    "orient": "SELECT user_id AS device_id, event_id, CAST(17 * row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS t_ms, value * 7.3 - 360 * floor(value * 7.3 / 360) AS alpha, 20.0 + event_id % 120 AS beta, event_id % 37 - 18.0 AS gamma, event_id % 4 * 90.0 AS screen_angle FROM {events}",
    "times": "SELECT o_orderkey AS id, 2448622.5 + o_orderkey % 12000 + (o_orderkey * 7919 % 86400) / 86400.0 AS jd, 45 + (o_custkey * 7919 % 300000) / 1e5 AS lat, 6 + (o_custkey * 104729 % 400000) / 1e5 AS lon FROM {orders}",
}


def doubles(text: str) -> str:
    """The SQL with its decimal literals as doubles, so that engines don't differ in decimal arithmetic."""
    return re.sub(r"(?<![\w.])(\d+\.\d+)(?![\d.e])", r"\1e0", text)


SQL = {name: doubles(text) for name, text in SQL.items()}


def tables_of(text: str) -> list[str]:
    return sorted(set(re.findall(r"\{(\w+)\}", text)))


def derived(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = SQL[name]
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables_of(text)}
    return spark.sql(text.replace(" DIV ", " div "), **frames)


def oracle(name: str) -> str:
    text = SQL[name]
    return "(" + re.sub(r"\{(\w+)\}", r"\1", text.replace(" DIV ", " // ")) + ")"
