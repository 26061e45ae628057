"""How the positional index is searched."""

from pulseloom.operators.text_index import TextIndex


def test_frequent_words_are_looked_up_for_candidates_only(spark, tmp_path):
    """Postings of a query's other words are joined by document, with the documents of its rarest word."""
    index = TextIndex(spark, str(tmp_path / "index"), buckets=2)
    index.add(spark.createDataFrame([(i, "tea walk" if i % 5 else "tea walk sleep", None) for i in range(20)], "doc_id long, text string, tags array<string>"))
    found = index.search(spark.createDataFrame([(1, "tea sleep"), (2, "tea nothing")], "query_id long, query string"), 10)
    joins = [line for line in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Inner" in line]
    assert any(line.count("doc_id#") >= 2 for line in joins)
    assert sorted((r.query_id, r.doc_id) for r in found.collect()) == [(1, 0), (1, 5), (1, 10), (1, 15)]
