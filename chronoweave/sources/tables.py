"""Parquet tables: one file or one folder per table, read with a given schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession

_PERIOD = "valid_from timestamp_ntz, valid_to timestamp_ntz, ingested_at timestamp_ntz"
#: Columns of the known tables. Files may lack some (they read as null) and hold others (they aren't read).
COLUMNS = {
    "repository": "id string, name string, path string, time_zone string, date_order string",
    "adr_document": "id string, repo_id string, adr_id string, title string, status string, date string, supersedes array<string>, superseded_by string, source_uri string, effective_from timestamp_ntz, effective_to timestamp_ntz, " + _PERIOD + ", confidence double",
    "episode": "id string, repo_id string, source string, source_uri string, content string, occurred_at timestamp_ntz, ingested_at timestamp_ntz",
    "decision": "id string, title string, adr_id string, episode_id string, text string, source_uri string, confidence double, " + _PERIOD,
    "decision_git_link": "id string, decision_uri string, ref_type string, ref_id string, link_source string, confidence double, source_time timestamp_ntz, ingested_at timestamp_ntz",
    "decision_merge": "loser_id string, loser_title string, survivor_id string, survivor_title string, similarity float, method string, constraints_moved int, constraints_duplicate int",
    "symbol_span": "id string, repo_id string, name string, kind string, file_path string, " + _PERIOD,
    "symbol_edge": "id string, repo_id string, from_id string, to_id string, to_name string, edge_type string, resolution string, confidence double, valid_from timestamp_ntz, valid_to timestamp_ntz",
    "parsed_adr": "id string, repo_id string, source_uri string, adr_id string, title string, status string, date string, ingested_at timestamp_ntz",
    "eval_item": "item_id long, suite string, lang string, text string",
    "subject": "subject string, description string",
    "subject_label": "doc_id long, subject string",
    "documents": "doc_id long, text string, lang string, source string, n_chars long, repo_id string, title string, created_at timestamp_ntz",
    "embeddings": "vec_id long, embedding array<float>, label int",
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string",
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey long, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
}


def table(spark: SparkSession, folder: str, name: str, *columns: str | Column) -> DataFrame:
    """The named table of ``folder``; with ``columns`` only those, so that the scan is pruned.

    Known tables are read by their schema, without a job that looks for it; others infer theirs.
    """
    reader = spark.read.schema(COLUMNS[name]) if name in COLUMNS else spark.read
    df = reader.parquet(f"{folder}/{name}.parquet")
    return df.select(*columns) if columns else df
