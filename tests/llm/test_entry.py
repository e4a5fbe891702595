"""The registered queries against their SQL, and the pipeline's stages against plain expectations."""

import os
import re

import duckdb
import pytest

import corpus_pipeline
from athanor.llm.decontamination import edit_search
from athanor.llm.queries import ORACLES, QUERIES
from athanor.llm.secrets import scan_secrets
from athanor.llm.toxicity import toxicity_scores

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    want = con.sql(ORACLES[name])
    got = QUERIES[name](spark, SF)
    assert sorted(want.columns) == sorted(got.columns)
    order = want.columns
    assert sorted(map(repr, want.fetchall())) == sorted(repr(tuple(r[c] for c in order)) for r in got.collect())


def test_pipeline_stages_keep_columns_and_pack_all(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sizes, now = [docs.count()], docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, SF)
        assert now.columns == docs.columns, name
        sizes.append(now.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0.5 * sizes[0]
    rows = corpus_pipeline.run(spark, SF).select("doc_id").distinct().count()
    assert rows == sizes[-1]


def _plain_words(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())


def test_stages_equal_plain_versions(spark):
    """Each stage on its own input, all documents of the small tables: fitted labels, all pairs, all items, all spans."""
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    left = lambda kept: docs.filter(docs.doc_id.isin(sorted(kept)))

    scores = {r.doc_id: r.score for r in toxicity_scores(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    kept = ids(stages["toxicity"](spark, docs, SF))
    assert kept == {i for i, s in scores.items() if s < 0.5}

    sets = {}
    for i in kept:
        w = _plain_words(rows[i])
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    top = {i: i for i in kept}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a in kept:
        for b in kept:
            if a < b and sets[a] and 4 * len(sets[a] & sets[b]) >= 3 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                top[max(x, y)] = min(x, y)
    one_each = ids(stages["near_duplicates"](spark, left(kept), SF))
    assert one_each == {i for i in kept if find(i) == i}

    items = [r.text.encode().lower() for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    holds = {i for i in one_each for x in items if edit_search(x, (rows[i] or "").encode().lower())[0] <= len(x) * 20 // 100}
    clean = ids(stages["decontamination"](spark, left(one_each), SF))
    assert clean == one_each - holds

    spans = {r.doc_id: [(s.start, s.end) for s in r.spans] for r in scan_secrets(left(clean)).collect()}
    redacted = {r.doc_id: r.text for r in stages["secrets"](spark, left(clean), SF).collect()}
    for i in clean:
        if not spans[i]:
            assert redacted[i] == rows[i]
        else:
            outside = [c for k, c in enumerate(rows[i]) if not any(a <= k < b for a, b in spans[i])]
            assert "".join(outside) == re.sub("<(assign|access|hex|account|random|address)>", "", redacted[i])

    pieces = stages["packing"](spark, left(clean), SF).collect()
    sizes = {r.doc_id: r.doc_tokens for r in pieces}
    assert set(sizes) == clean and sum(r.length for r in pieces) == sum(sizes.values())
