"""A page id (or null) that holds most rows is one row of the sample that gives the shards' boundaries."""

from gridstone.llm import warc


def test_boundaries_see_each_id_once(spark, monkeypatch):
    data = [(i, f"http://e.org/{i}", f"body {i}") for i in range(60)]
    data += [(5, f"http://e.org/five/{i}", f"five {i}") for i in range(200)] + [(None, f"http://e.org/none/{i}", f"none {i}") for i in range(200)]
    pages = spark.createDataFrame(data, "page_id long, url string, html string")
    seen, plain = [], warc.range_bounds
    monkeypatch.setattr(warc, "range_bounds", lambda df, *a: seen.extend(r.page_id for r in df.collect()) or plain(df, *a))
    got = [(r.page_id, r.url) for r in warc.read(spark, warc.write(pages)).collect()]
    assert sorted(seen) == list(range(60))
    assert sorted(got, key=str) == sorted(((i, u) for i, u, _ in data), key=str)
