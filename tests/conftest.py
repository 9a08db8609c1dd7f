from __future__ import annotations

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tools"))

TESTDATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from lexmesh.session import build_session
    session = build_session("tests", "local[4]", 4)
    session.sparkContext.setLogLevel("OFF")
    # compiling a plan costs more than running it on rows this few; tools/check_queries.py runs the compiled form
    session.conf.set("spark.sql.codegen.wholeStage", "false")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def tables(spark):
    from lexmesh.plans.registry import Tables
    return Tables(spark, TESTDATA)
