import os

import duckdb
import pytest

import __spark_entry__ as entry

CORE = ["text_tags", "radius_exact", "radius_counters", "first_match", "stratified_sample", "summary_grouping_sets", "jaccard_classes", "greedy_dedup", "p5_found", "segment_postings_d3", "radius_counters_d1", "global_min", "candidate_records", "strategy_equivalence", "boundary_flips", "split_integrity", "similar_texts", "random_pairs", "video_tags", "secret_shares"]


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple("null" if r[i] is None else f"{r[i]:.9g}" if isinstance(r[i], float) else str(r[i]) for i in order) for r in rows)


def same_as_sql(spark, sf, name):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{f}'")
    rel = con.sql(entry.oracle_sql()[name])
    df = entry.queries()[name](spark, sf)
    assert sorted(df.columns) == sorted(rel.columns)
    assert plain(df.collect(), df.columns) == plain(rel.fetchall(), rel.columns)


@pytest.mark.parametrize("name", CORE)
def test_query_gives_what_sql_gives(spark, sf, name):
    same_as_sql(spark, sf, name)


def test_entry(spark, sf):
    assert entry.entry(spark).columns == ["type", "query_tag", "tag", "distance", "n"]
    assert not set(entry.oracle_sql()) - set(entry.queries())
