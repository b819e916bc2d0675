"""The pipeline's dedup stage deals out the keys of fingerprints, and hands few texts at once to Python."""

import random

import corpus_pipeline
from quern.llm import near_copies, simhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


def corpus():
    r = random.Random(3)
    texts = []
    for _ in range(150):
        base = [f"w{r.randrange(10**6)}" for _ in range(40)]
        texts += [" ".join(base), " ".join([*base, "e"])]
    return [(i, t, "en", "s", 1) for i, t in enumerate(texts)]


def test_no_task_makes_the_keys_of_most_fingerprints(spark, monkeypatch):
    seen, links = [], simhash.links

    def noted(nodes, segments=7):
        seen.extend(len(p) for p in nodes.rdd.glom().collect())
        return links(nodes, segments)

    monkeypatch.setattr(near_copies, "PRINTS_A_TASK", 20, raising=False)
    monkeypatch.setattr(simhash, "links", noted)
    out = corpus_pipeline.dedup(spark, spark.createDataFrame(corpus(), DOCS).coalesce(1), "").collect()
    assert sorted(r["doc_id"] for r in out) == list(range(0, 300, 2))
    assert sum(seen) > 250 and max(seen) <= 60


def test_few_texts_go_to_python_at_once(spark, monkeypatch):
    before, seen, written = spark.conf.get(KEY), {}, near_copies.written

    def noted(df, name, **options):
        seen.setdefault(name, int(spark.conf.get(KEY)))
        return written(df, name, **options)

    monkeypatch.setattr(near_copies, "written", noted)
    corpus_pipeline.dedup(spark, spark.createDataFrame(corpus()[:40], DOCS), "").collect()
    assert max(seen["prints"], seen["links"]) <= 1000
    assert spark.conf.get(KEY) == before
