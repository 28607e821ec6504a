"""Media are written and read back by one Python worker of a task."""

from tidewater.llm import media_clips as M
from tidewater.llm.queries import QUERIES


def test_media_are_written_and_read_back_in_one_pass(spark, monkeypatch):
    df = spark.createDataFrame([(1, "text"), (None, "é" * 500), (2, None), (2, None), (3, "a" * 30_000 + "\x7f" * 30_000)], "doc_id long, text string")
    rows = lambda out: sorted(map(str, out.collect()))
    assert rows(M.encoded_digest(df)) == rows(M.media_digest(M.encode_media(df)))
    assert rows(M.encoded_clips(df)) == rows(M.clip_rows(M.encode_media(df)))
    for name in ("op9_media_clips", "media_clips", "media_payloads"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("InArrow") == 1, name
    payload = M.pad_payload(bytes(range(256)) * 400)
    whole = M.write_avi(payload)
    monkeypatch.setattr(M, "BLOCK", 7)
    assert M.write_avi(payload) == whole and M.read_frames(whole)[1].tobytes() == payload
