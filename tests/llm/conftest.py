"""A small corpus with everything that goes wrong, and empty tables."""

from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))

from corpus import ITEMS, LABELS, SCHEMA, corpus_rows  # noqa: E402


@pytest.fixture(scope="session")
def rows():
    return corpus_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark, rows):
    ids = [r[0] for r in rows if r[0] is not None]
    listed = [(i, int(i != 406), int(i in (3, 404)), "t") for i in ids]
    return spark.createDataFrame([*listed, (None, 1, 1, "t"), (1, None, None, None)], LABELS)


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], LABELS)


@pytest.fixture(scope="session")
def items(spark, rows):
    long = rows[3][1].split()
    return spark.createDataFrame(
        [(1, " ".join(long[20:50]), 1), (2, " ".join(long[60:66]) + " and then other words here", 1),
         (3, None, 1), (4, "", 1), (5, "two words", 1), (None, "".join(c.upper() if c.isascii() else c for c in " ".join(long[100:130])), 1),
         (1, " ".join(long[20:50]), 1), (6, "not in any of them at all " * 3, 1)], ITEMS)


@pytest.fixture(scope="session")
def no_items(spark):
    return spark.createDataFrame([], ITEMS)
