"""Quality is judged of the texts that were found, not of every text that is scanned."""

from docmill.plans import pipelines
from docmill.plans.catalogue import QUERIES


def _filters(df) -> list[str]:
    found = []

    def walk(node) -> None:
        if node.nodeName() == "Filter":
            found.append(node.condition().toString())
        for k in range(node.children().size()):
            walk(node.children().apply(k))

    walk(df._jdf.queryExecution().optimizedPlan())
    return found


def test_no_filter_judges(spark, sf):
    docs = spark.createDataFrame([(k, f"The growth of trade number {k} was high.", "pdf") for k in range(9)], "doc_id long, text string, source_type string")
    asked = spark.createDataFrame([(1, "What is the growth of trade?")], "query_id long, text string")
    for df in (QUERIES["hybrid_rrf_topk"](spark, sf), pipelines.answer_contexts(asked, docs)):
        assert _filters(df) and not [f for f in _filters(df) if "regexp_replace" in f]
