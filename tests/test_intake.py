import json

from pyspark.sql import functions as F

from paperlake.functions import urls as U
from paperlake.operators import inference as L
from paperlake.sources import files as S


def test_links(spark):
    cases = {
        "arxiv.org/abs/1706.03762/": ("https://arxiv.org/pdf/1706.03762.pdf", None),
        "https://www.arxiv.org/pdf/1706.03762": ("https://arxiv.org/pdf/1706.03762.pdf", None),
        "https://arxiv.org/pdf/1706.03762.pdf": ("https://arxiv.org/pdf/1706.03762.pdf", None),
        "https://github.com/a/b/blob/main/x/y.pdf": ("https://raw.githubusercontent.com/a/b/main/x/y.pdf", None),
        "http://127.0.0.1/x": ("http://127.0.0.1/x", "blocked_host"),
        "http://169.254.169.254/latest": ("http://169.254.169.254/latest", "private_network"),
        "http://172.31.0.1/": ("http://172.31.0.1/", "private_network"),
        "http://172.32.0.1/": ("http://172.32.0.1/", None),
        "http://127.0.0.2/": ("http://127.0.0.2/", "non_public_address"),
        "http://[::1]/x": ("http://[::1]/x", "blocked_host"),
        "http://[fe80::1]/x": ("http://[fe80::1]/x", "non_public_address"),
        "http://[2001:db8::1]/": ("http://[2001:db8::1]/", "non_public_address"),
        "http://[2606:4700::1111]/": ("http://[2606:4700::1111]/", None),
        "http://printer.local/": ("http://printer.local/", "private_network"),
        "http://x.internal:80/": ("http://x.internal:80/", "private_network"),
        "http://93.184.216.34/": ("http://93.184.216.34/", None),
    }
    rows = spark.createDataFrame([(k,) for k in cases], ["link"]).select("link", U.normalize_url(F.col("link")).alias("url"))
    got = {r.link: (r.url, r.reason) for r in rows.select("link", "url", U.screen_url(F.col("url")).alias("reason")).collect()}
    assert got == cases
    bad = spark.createDataFrame([("ftp://x.org/a",)], ["u"]).select(U.screen_url(F.col("u")).alias("r")).first().r
    assert bad == "bad_scheme"


def test_file_names(spark):
    cases = [
        ("https://x.org/a/b.pdf?q", "", "b.pdf"), ("https://x.org/a/b/", None, "b.pdf"), ("https://x.org/", "", "downloaded_paper.pdf"),
        ("https://x.org/a", 'attachment; filename="My Paper.PDF"', "My Paper.PDF"), ("https://x.org/a", "attachment; filename=x.html", "a.pdf"),
    ]
    rows = spark.createDataFrame(cases, "u string, cd string, want string").withColumn("got", U.url_filename(F.col("u"), F.col("cd")))
    assert all(r.got == r.want for r in rows.collect())


def test_files_and_payloads(spark):
    files = spark.createDataFrame([(b"",), (b"%PDF-1",), (b"hello",), (b"%PDF" + b"x" * 2_000_000,)], ["content"])
    assert [r.reject_reason for r in S.accept_files(files, max_mb=1).collect()] == ["empty", None, "not_pdf", "too_large"]
    payloads = spark.createDataFrame([("not base64!",), ("aGVsbG8=",), ("JVBERi0x",), ("JVBE Ri0x",), ("JVBERi0",)], ["b64"])
    assert [r.reject_reason for r in S.decode_payload(payloads).collect()] == ["invalid_base64", "not_pdf", None, "invalid_base64", "invalid_base64"]


def test_schema_alignment(spark):
    old = spark.createDataFrame([("t", 1)], "task_id string, percent int")
    new = S.align_schema(old, "task_id STRING, percent BIGINT, highlight BOOLEAN, summary_json STRING", {"highlight": False})
    assert new.first().asDict() == {"task_id": "t", "percent": 1, "highlight": False, "summary_json": None}


def scripted(bad=L.BadRequest):
    """A stand-in model, defined in a function so that it travels to the workers by value."""

    class Scripted:
        """A stand-in model: fails as its request tells it to, and answers with the call's settings."""

        def __init__(self):
            self.calls = {}

        def complete(self, system, content, temperature, max_tokens, json_mode):
            n = self.calls[content] = self.calls.get(content, 0) + 1
            if content == "always" or (content == "once" and n == 1):
                raise RuntimeError(f"failure {n}")
            if content == "strict" and json_mode:
                raise bad("no json mode")
            return __import__('json').dumps({"tokens": max_tokens, "json": json_mode, "temperature": temperature})

    return Scripted


def test_inference_retries_and_keeps_errors(spark):
    rows = [("p", "entities", i, "s", c) for i, c in enumerate(["fine", "once", "always"])] + [("p", "highlight", 3, "s", "strict")]
    requests = spark.createDataFrame(rows, "paper_id string, task string, chunk_no int, system string, content string")
    got = {r.chunk_no: r for r in L.infer(requests, scripted(), concurrency=1, sleep=lambda s: None).collect()}
    assert (got[0].attempts, got[1].attempts, got[2].attempts, got[3].attempts) == (1, 2, 3, 1)
    assert got[2].raw is None and got[2].error == "failure 3"
    assert json.loads(got[0].raw) == {"tokens": 4096, "json": False, "temperature": 0.1}
    assert json.loads(got[3].raw) == {"tokens": 2048, "json": False, "temperature": 0.1}


def test_answers(spark):
    answers = [
        '{"highlights": [{"sentence_id": "a", "category": "key_data"}]}',
        '```json\n{"highlights": []}\n```',
        '```\n{"highlights": []}',
        'Sure! {"highlights": []} Done.',
        "no json here",
        '{"highlights": [',
        "[1, 2]",
        None,
    ]
    rows = spark.createDataFrame([("p", "highlight", i, a) for i, a in enumerate(answers)], "paper_id string, task string, chunk_no int, raw string")
    got = {r.chunk_no: r for r in L.parse_response(rows, "highlight").collect()}
    assert [got[i].parse_failed for i in range(len(answers))] == [False, False, False, False, True, True, True, True]
    assert got[0].parsed.highlights[0].sentence_id == "a" and got[1].parsed.highlights == [] and got[4].parsed is None


def test_requests_are_answered_slice_by_slice(spark, monkeypatch):
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"content": ["a" * 40, None, "b" * 70, "c" * 300, "", "d"]})
    monkeypatch.setattr(L, "SLICE_BYTES", 100)
    slices = list(L.content_slices(batch))
    assert [x.num_rows for x in slices] == [2, 1, 1, 2] and pa.Table.from_batches(slices).equals(pa.Table.from_batches([batch]))

    class Echo:
        def complete(self, system, content, temperature, max_tokens, json_mode):
            return content[:5]

    rows = [(str(k), "summary", k if k % 3 else None, "s", f"{k:05d}" * (k % 40) if k % 7 else None) for k in range(500)]
    sent = spark.createDataFrame(rows, "paper_id string, task string, chunk_no int, system string, content string").coalesce(1)
    got = L.infer(sent, Echo, sleep=lambda s: None).collect()
    assert [(r.paper_id, r.chunk_no, r.raw) for r in got] == [(p, n, None if c is None else c[:5]) for p, _, n, _, c in rows]
    assert all((r.error is None, r.attempts) == ((True, 1) if r.raw is not None else (False, 3)) for r in got)
