"""Stages keep the caller's columns, also those that are called like a working column of any operator."""

import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessella import llm
from tessella.llm import mixing
from tests.conftest import SMALL


def working_names():
    source = "\n".join(p.read_text() for p in Path(llm.__file__).parent.glob("*.py"))
    return sorted({n for n in re.findall(r"""["'`]((?:_[a-z]\w*|root|node|first_id|component_id|items|size|n_words|n_hit|spans|reached|kind|token|instance|seed|h|p|w|s|n))["'`]""", source)})


@pytest.fixture(scope="module")
def clashing(spark):
    names = working_names()
    assert {"_id", "_none", "_cuts", "_source", "_key", "_range", "_others"} <= set(names)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(60)
    extra = spark.createDataFrame([(-1, None, None, None, None), (-2, "", "xx", "s", 0), (-3, "same words here", "xx", None, 1), (-3, "same words here", "xx", None, 1)], docs.schema)
    return docs.unionByName(extra).withColumns({c: F.concat(F.lit(f"{c}:"), F.col("doc_id").cast("string")) for c in names}), names


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stage_keeps_every_column(spark, clashing, name, stage):
    docs, names = clashing
    out = stage(spark, docs, SMALL)
    added = {"size", "source_size", "target", "taken"} if name == "mixing" else set()
    assert [c for c in out.columns if c not in added] == [c for c in docs.columns if c not in added]
    rows = out.collect()
    assert rows and all(r[c] == f"{c}:{r['doc_id']}" for r in rows for c in names if c not in added)


def test_mix_without_text(clashing):
    docs, _ = clashing
    out = mixing.mix(docs, with_text=False)
    assert "text" not in out.columns and out.count() == docs.count()
