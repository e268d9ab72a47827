"""The mixture of the pipeline: every row has a place of its own, however many sources there are."""

import corpus_pipeline
from priorline.llm import mixing


def _docs(spark):
    """Two sources, one of them null, with an id that repeats and rows without one."""
    return spark.sql(
        "SELECT IF(id % 10 = 3, NULL, IF(id % 10 = 4, 'same', concat('d', id))) AS doc_id, concat('text ', id DIV 2) AS text, "
        "IF(id % 4 = 0, NULL, 'web') AS source FROM range(400)"
    )


def test_every_row_has_its_own_place_of_the_schedule(spark):
    docs = _docs(spark)
    out = mixing.with_schedule(docs, mixing.tempered(docs))
    assert out.columns == [*docs.columns, *mixing.SCHEDULE]
    rows = out.collect()
    assert sorted((tuple(r)[:3] for r in rows), key=str) == sorted(map(tuple, docs.collect()), key=str)
    plan = sorted(mixing.schedule(docs, mixing.tempered(docs)).collect(), key=lambda r: (r.slot, r.place))
    named = ("doc_id", "source", *mixing.SCHEDULE)
    assert [tuple(r[c] for c in named) for r in rows] == [tuple(r[c] for c in named) for r in plan]
    assert len({(r.slot, r.place) for r in rows}) == 400
    mixed = corpus_pipeline.mixture(spark, docs, "")
    assert mixed.columns == docs.columns
    assert [(r.doc_id, r.source) for r in mixed.collect()] == [(r.doc_id, r.source) for r in plan]


def test_more_sources_than_slots_of_a_usual_period(spark):
    docs = spark.sql("SELECT concat('d', id) AS doc_id, 'text' AS text, concat('s', id % 1200) AS source FROM range(2400)")
    assert corpus_pipeline.mixture(spark, docs, "").count() == 2400
