import os

import duckdb
import pytest

LONG = " ".join(f"word{k}" for k in range(3000))
BASE = "the quick brown fox jumps over the lazy dog while many other animals look on and say nothing at all about it today or ever again in this long tale"


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls in any column, empty and long texts, ties, repeated rows, and columns with clashing names."""
    rows = [
        (1, BASE, "en", "a", 3), (2, BASE, "en", "a", 3), (3, BASE + " end", "en", "b", 1), (4, None, "en", "a", None), (5, "", None, None, 0), (6, "   \n\t", "en", "b", 1), (7, "one", "en", None, 2),
        (8, LONG, "en", "a", 9), (8, LONG, "en", "a", 9), (9, LONG + " tail", "de", "b", 9), (None, BASE, "en", "a", 1), (10, "été ÉTÉ ünïcode ß", "fr", "a", 5), (11, "12 34 !!", "en", "c", 5), (12, "x" * 300, "en", "c", 1),
    ]
    rows = [(*r, 1, "x", 2, 3, "k", 4.0) for r in rows]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size int, salt string, component_id long, shard long, rep string, score double")


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def con(sf):
    c = duckdb.connect()
    for f in os.listdir(sf):
        c.sql(f"create view {f.removesuffix('.parquet')} as select * from '{sf}/{f}'")
    return c
