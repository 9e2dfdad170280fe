"""A clean book-length text passes the pipeline's first stage; a long text of bad ratios does not."""

from gridstone.llm import quality_rules


def test_length_alone_drops_no_long_text(spark):
    clean = " ".join(f"the w{i}" for i in range(500_001))
    data = [(1, clean), (2, clean.replace("the", "###")), (3, "too short")]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    assert {r.doc_id for r in quality_rules.keep_good(docs).select("doc_id").collect()} == {1}
    assert [r.doc_id for r in quality_rules.apply_rules(docs).where("kept").select("doc_id").collect()] == [1]
