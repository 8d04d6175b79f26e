"""Archives are read for the messages once, and cut messages still come back whole."""

from quantloom.llm import warc


def test_result_reads_no_archive_again(spark, monkeypatch):
    monkeypatch.setattr(warc, "SEGMENT", 1000)
    pages = [(1, "u", "a" * 5000), (2, "u", "b"), (3, "u", "a" * 5000), (4, None, None)]
    got = warc.round_trip(spark.createDataFrame(pages, "page_id long, url string, html string"))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and "binaryFile" not in plan
    assert sorted((r["page_id"], r["payload_bytes"], r["refers_to"]) for r in got.collect()) == [(1, 5000, 3), (2, 1, None), (3, 5000, None), (4, 0, None)]


def test_broken_messages_have_no_payload(spark, tmp_path):
    message = warc.framed(b"abcdef")
    head = [(b"WARC-Type", b"response"), (b"WARC-Target-URI", b"u"), (b"WARC-Payload-Digest", b"sha1:X")]
    named = lambda k: (b"WARC-Record-ID", b"<urn:page:%d:%d>" % (k, k))
    cut = [*head, named(2), (b"WARC-Segment-Number", b"1")]
    data = b"\r\n\r\n".join([warc._record([*head, named(1)], message), warc._record(cut, message[:9]), b""])
    (tmp_path / "a.warc").write_bytes(data)
    got = {r["page"]: r["payload"] for r in warc.read_archives(spark, str(tmp_path)).collect()}
    assert {k: v and bytes(v) for k, v in got.items()} == {"1": b"abcdef", "2": None}
