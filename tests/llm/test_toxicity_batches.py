"""The fit of the toxicity model hands few whole texts to Python at once."""

import random

from quern.llm import toxicity

KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


def test_few_texts_go_to_python_while_a_model_is_fitted(spark, monkeypatch):
    before, seen, written = spark.conf.get(KEY), [], toxicity.written

    def noted(df, name, **options):
        seen.append(int(spark.conf.get(KEY)))
        return written(df, name, **options)

    monkeypatch.setattr(toxicity, "written", noted)
    r = random.Random(1)
    rows = [(i, " ".join(r.choice("abcdefgh") for _ in range(30))) for i in range(60)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    assert toxicity.score_documents(docs, labels).count() == 60
    assert seen and max(seen) <= 500
    assert spark.conf.get(KEY) == before
