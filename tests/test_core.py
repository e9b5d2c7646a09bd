import math
import re

import pytest
from pyspark.sql import functions as F

from docsluice.functions import text as T
from docsluice.functions import vectors as V
from docsluice.operators import chunk, collection, grounding, ledger, lexical, metrics, privacy, retrieve, telemetry
from docsluice.sources import files, sinks
from docsluice.streaming import streams


def one(spark, expr, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(expr).first()[0]


def test_tokens_keep_units_and_drop_stopwords(spark):
    assert one(spark, T.bm25_tokens(F.col("t")), t="What is the $2,000 dose of 20mg, 3.5 follow-up a?") == ["$2000", "dose", "20mg", "3.5", "follow-up"]
    assert one(spark, T.bm25_tokens(F.col("t")), t="") == []
    assert one(spark, T.word_tokens(F.col("t")), t="Café naïve ²½ x_1") == ["café", "naïve", "²½", "x_1"]
    assert one(spark, T.content_words(F.col("t")), t="what is the") == ["what", "is", "the"]


def test_text_scalars(spark):
    assert one(spark, T.sentences(F.col("t")), t="One. Two!  Three? four") == ["One.", "Two!", "Three?", "four"]
    assert one(spark, T.normal_lines(F.col("t")), t="a\r\nb\rc\x00d") == "a\nb\nc d"
    assert one(spark, T.mask_secret(F.col("t")), t="abcdefghij") == "abcd...ghij"
    assert one(spark, T.mask_secret(F.col("t")), t="abc") == "****"
    assert one(spark, T.line_at(F.col("t"), F.lit(4)), t="a\nb\nc") == 3
    c = one(spark, T.citations(F.col("t")), t="x [Doc: a b.txt, Page 2, Line 3-9] y")
    assert [tuple(r) for r in c] == [("a b.txt", 2, 3, 9)]
    assert one(spark, T.quotes(F.col("t")), t='"short" and "twelve chars or more"') == ["twelve chars or more"]


@pytest.mark.parametrize(("a", "b", "cos", "deg"), [([1.0, 0.0], [0.0, 1.0], 0.0, 90.0), ([1.0, 2.0], [-1.0, -2.0], -1.0, 180.0), ([0.0, 0.0], [1.0, 1.0], 0.0, 90.0)])
def test_vectors(spark, a, b, cos, deg):
    row = spark.createDataFrame([(a, b)], "a array<double>, b array<double>").select(V.cosine(F.col("a"), F.col("b")), V.angle(F.col("a"), F.col("b")), V.normalised(F.col("a"))).first()
    assert row[0] == pytest.approx(cos) and row[1] == pytest.approx(deg)
    assert math.isclose(sum(x * x for x in row[2]), 1.0) or row[2] == [0.0, 0.0]


def test_vector_guards(spark):
    df = spark.createDataFrame([([1.0, float("nan")],), ([1.0, float("inf")],), ([1.0, None],), ([1.0, 2.0],), (None,)], "v array<double>")
    assert [r[0] for r in df.select(V.flawed(F.col("v"))).collect()] == [True, True, True, False, True]
    with pytest.raises(Exception, match="differ in length"):
        spark.createDataFrame([([1.0], [1.0, 2.0])], "a array<double>, b array<double>").select(V.dot(F.col("a"), F.col("b"))).collect()


def test_hash_slot_is_the_large_number(spark):
    import hashlib

    for w in ("torsemide", "é_x", "a"):
        m, s = hashlib.md5(w.encode()).hexdigest(), hashlib.sha1(w.encode()).hexdigest()
        got = spark.createDataFrame([(w,)], "w string").select(V.hex_slot(F.md5("w"), 32, 384), V.hex_sign(F.md5("w"), 32), V.hex_slot(F.sha1("w"), 40, 768), V.hex_sign(F.sha1("w"), 40)).first()
        assert tuple(got) == (int(m, 16) % 384, 1.0 if int(m, 16) >> 8 & 1 else -1.0, int(s, 16) % 768, 1.0 if int(s, 16) >> 8 & 1 else -1.0)


def test_fusion_orders_by_score_then_first_seen(spark):
    make = lambda ids: spark.createDataFrame([(1, c, i + 1) for i, c in enumerate(ids)], "query_id bigint, chunk_id string, rank int")
    rows = retrieve.fuse([make(["a", "b", "c"]), make(["c", "a", "d"])]).orderBy("rank").collect()
    assert [r["chunk_id"] for r in rows] == ["a", "c", "b", "d"]
    assert rows[0]["rrf"] == round(1 / 61 + 1 / 62, 6)


def test_bm25_by_hand(spark):
    chunks = spark.createDataFrame([("c1", "radar power radar"), ("c2", "cooling fluid"), ("c3", "")], "chunk_id string, content string")
    queries = spark.createDataFrame([(1, "radar radar?"), (2, "the of")], "query_id bigint, query string")
    got = {(r["query_id"], r["chunk_id"]): r["bm25"] for r in lexical.scores(chunks, queries).collect()}
    idf = math.log((3 - 1 + 0.5) / 1.5 + 1)
    assert got == {(1, "c1"): pytest.approx(2 * idf * 2 * 2.5 / (2 + 1.5 * (0.25 + 0.75 * 3 / (5 / 3))))}


@pytest.mark.parametrize("text", ["x" * 450, "x" * 451, "word " * 400, "a" * 10_000, "para one.\n\n" * 120, "हिन्दी 中文 😀 " * 90, "\n \n" * 400 + "end", "One. " * 300 + "\n\n\n\n" + "b" * 500])
def test_recursive_chunks_cover_and_fit(text):
    out = chunk.recursive_chunks(text)
    assert all(len(c) <= 450 for c, *_ in out)
    assert all(a <= z for _, _, a, z in out)
    if len(text) <= 450:
        assert [c for c, *_ in out] == [text]
    kept = "".join(c for c, *_ in out)
    assert set(text.split()) - set(kept.split()) == set() or len(max(text.split(), key=len)) > 390
    assert chunk.recursive_chunks("  \n ") == []


def test_no_overlap_repeats_nothing():
    words = [f"w{i}" for i in range(600)]
    out = chunk.recursive_chunks(" ".join(words), 100, 0)
    assert " ".join(c for c, *_ in out).split() == words
    with pytest.raises(ValueError, match="overlap"):
        chunk.recursive_chunks("x", 10, 10)


def test_fixed_chunks(spark):
    text = "".join(f"line {i}\n" for i in range(200))
    docs = spark.createDataFrame([("d", "t", "LEGAL", text), ("e", "t", "LEGAL", " ")], "doc_key string, title string, category string, text string")
    rows = chunk.fixed(docs).orderBy("chunk_index").collect()
    assert {r["doc_key"] for r in rows} == {"d"}
    for r in rows:
        at = r["chunk_index"] * 390
        assert r["content"] == text[at : at + 450] and r["start_line"] == text[:at].count("\n") + 1


PII = "SSN 123-45-6789, mail a.b@c.org, MRN: 12345-67890-AB, Phone: 212-555-0199, Dr. Jane Roe, VIN: ABC12345, 10.0.0.1, seen 2024-01-05. Again a.b@c.org [SAFE_EMAIL_1]"


def test_redaction_round_trip(spark):
    df = privacy.restore(privacy.redact(spark.createDataFrame([(PII,), ("  ",), (None,), ("a\x00b",), ("plain words",)], "text string")))
    rows = df.collect()
    assert rows[0]["restored_text"] == PII and "123-45-6789" not in rows[0]["redacted_text"]
    assert "[SAFE_EMAIL_1_X]" in rows[0]["redacted_text"]
    assert [e["token"] for e in rows[0]["entities"] if e["raw"] == "a.b@c.org"] == ["[SAFE_EMAIL_1_X]"] * 2
    assert {"SSN", "EMAIL", "MRN", "NAME", "IP_ADDRESS", "DATE"} <= {e["type"] for e in rows[0]["entities"]}
    assert rows[0]["risk"] == min(100, 12 * len(rows[0]["entities"]))
    assert (rows[1]["redacted_text"], rows[1]["risk"]) == ("  ", 0)
    assert (rows[3]["redact_error"], rows[3]["redacted_text"], rows[3]["entities"]) == ("NUL_BYTE", None, []) and rows[2]["redacted_text"] is None


def test_overlap_sweep_agrees_with_the_fold(spark):
    spans = [(0, 5, "A", 0.9), (3, 10, "B", 0.9), (4, 6, "C", 0.5), (10, 12, "D", 0.9), (10, 11, "E", 0.99)]
    ours = [(s, e, t) for s, e, t, _ in privacy.resolve(sorted(spans, key=lambda s: (s[0], s[0] - s[1], -s[3])))]
    df = spark.createDataFrame([(spans,)], "s array<struct<start:int,end:int,type:string,confidence:double>>").select(privacy.resolved(F.col("s")).alias("k"))
    assert [(r["start"], r["end"], r["type"]) for r in df.first()["k"]] == ours == [(3, 10, "B"), (10, 12, "D")]


def _chunks(spark):
    return spark.createDataFrame([(1, 1, "c1", "manual.txt", "GENERAL", "The coolant is polyalphaolefin fluid.\nPeak power is 15 kW.", 1, 1, 2, 0.5, 0.5, 0.03, "Doc: manual.txt, Page 1, Line 1-2")], "query_id bigint, rank int, chunk_id string, title string, category string, content string, page_number int, start_line int, end_line int, similarity_score double, bm25_score double, rrf_score double, citation_label string")


def test_answers_and_grounding(spark):
    queries = spark.createDataFrame([(1, "Which coolant fluid?"), (2, "Nothing?")], "query_id bigint, query string")
    said = {r["query_id"]: r["answer"] for r in retrieve.answers(queries, _chunks(spark)).collect()}
    assert said[2] == retrieve.NO_FACTS and '"The coolant is polyalphaolefin fluid."' in said[1]
    given = spark.createDataFrame([(1, said[1]), (2, said[2]), (3, "No idea at all about that."), (4, "x")], "query_id bigint, answer string")
    rows = {r["query_id"]: r for r in grounding.report(given, _chunks(spark)).collect()}
    assert rows[1]["is_grounded"] and rows[1]["confidence"] == 1.0 and rows[1]["citations_verified"] == 2
    assert rows[2]["verdict"].startswith("GROUNDED_REFUSAL") and rows[3]["verdict"].startswith("NO_CONTEXT")


def test_claims_and_fabrication(spark):
    given = spark.createDataFrame([(1, 'The vehicle flew over twelve mountains yesterday. "Invented quote of length" [Doc: other.txt, Page 1, Line 1-2]')], "query_id bigint, answer string")
    r = grounding.report(given, _chunks(spark)).first()
    assert not r["is_grounded"] and (r["total_quotes"], r["quotes_matched"], r["total_citations"], r["citations_verified"]) == (1, 0, 1, 0)


def test_gate_and_requests(spark):
    q = spark.createDataFrame([(1, "a"), (2, " "), (3, "x" * 4001), (4, "a\x00")], "query_id bigint, query string")
    got = _chunks(spark).withColumn("category", F.lit("CLINICAL"))
    assert {r["query_id"]: r["status"] for r in retrieve.gate(q, got).collect()}[1] == "BLOCKED"
    assert {r["query_id"]: r["status"] for r in retrieve.gate(q, got, F.lit("airgap")).collect()}[1] == "OK"
    assert {r["query_id"]: r["error_code"] for r in retrieve.request_errors(q).collect()} == {1: None, 2: 400, 3: 422, 4: 400}


def _ledger(spark, n=60):
    s, data = ledger.error(F.lit("Kind"), F.concat(F.lit('say "hi" '), F.col("id")))
    e = spark.range(n).select(F.lit(1).alias("ledger"), F.col("id").alias("idx"), F.lit("2024-01-01T00:00:00").alias("ts"), F.lit("ERROR").alias("event_type"), s.alias("payload_summary"), ledger.data_hash(s, data).alias("data_hash"))
    return e, ledger.chained(e)


def test_ledger(spark):
    import hashlib
    import json

    events, chain = _ledger(spark)
    rows = chain.orderBy("idx").collect()
    prev = "0" * 64
    for i, r in enumerate(rows):
        data = hashlib.sha256((f'Error: [Kind] say "hi" {i}' + json.dumps({"error_class": "Kind", "message": f'say "hi" {i}'}, sort_keys=True)).encode()).hexdigest()
        now = hashlib.sha256(f"{i}:2024-01-01T00:00:00:ERROR:{data}:{prev}".encode()).hexdigest()
        assert (r["data_hash"], r["previous_hash"], r["current_hash"]) == (data, prev, now)
        prev = now
    assert tuple(ledger.verified(chain).first()) == (1, True, -1, 60)
    bad = chain.withColumn("current_hash", F.when(F.col("idx") == 7, F.lit("f" * 64)).otherwise(F.col("current_hash")))
    assert ledger.verified(bad).first()["first_bad"] == 7
    summary = chain.withColumn("payload_summary", F.lit("edited"))
    assert ledger.verified(summary).first()["valid"]


def test_collection(spark, tmp_path):
    raw = spark.createDataFrame([(1, "a", "same text", "LEGAL"), (2, "b", "same text", "CLINICAL"), (3, "c", "other\r\ntext", "ODD"), (4, "d", "", "LEGAL"), (5, "e", None, "LEGAL"), (6, "f", " \n", "LEGAL")], "row_id bigint, title string, raw string, category string")
    docs = collection.ingest(raw)
    assert {(r["row_id"], r["category"]) for r in docs.collect()} == {(1, "LEGAL"), (3, "GENERAL")}
    assert collection.ingest(raw, docs).count() == 0
    chunks = chunk.fixed(docs)
    first = sinks.snapshot(docs, chunks, str(tmp_path / "s"))
    second = sinks.snapshot(docs, chunks.limit(1), str(tmp_path / "s"))
    (tmp_path / "s" / "v99999999999999999999" / "documents").mkdir(parents=True)  # cut short: no version
    assert sinks.versions(spark, str(tmp_path / "s")) == [first, second]
    assert sinks.restore_snapshot(spark, str(tmp_path / "s"))[1].count() == 1
    with pytest.raises(ValueError, match="no such version"):
        sinks.restore_snapshot(spark, str(tmp_path / "s"), "v99999999999999999999")
    sinks.snapshot(docs, chunks, str(tmp_path / "s"))
    assert sinks.restore_snapshot(spark, str(tmp_path / "s"))[1].count() == 2
    kept, left, counts = collection.delete_documents(docs, chunks, docs.where("row_id = 1"))
    assert (kept.count(), left.count(), counts.first()["deleted_chunks"]) == (1, 1, 1)
    new = collection.reclassify(docs, docs.select("doc_key", F.lit("DEFENSE").alias("new_category")))
    assert {r["category"] for r in new.collect()} == {"DEFENSE"}


def test_percentile_is_nearest_rank(spark):
    df = spark.createDataFrame([("x", float(v)) for v in range(1, 21)], "k string, v double")
    assert tuple(metrics.nearest_rank(df, "v", {"p50": 0.5, "p95": 0.95}, ["k"]).first()) == ("x", 20, 11.0, 20.0)


def test_memory(spark):
    r = telemetry.memory(spark.createDataFrame([("llama3:8b", "Q4_K_M", 4096, 1), ("nobody", "none", 4096, 1)], "model_id string, quant_type string, context_length int, batch_size int")).collect()
    assert len({tuple(x) for x in r}) == 1 and 4.5 < r[0]["total_gib"] < 6.5 and r[0]["fits_8gib"]


def test_files(spark, tmp_path):
    import zlib

    pdf = b"%PDF-1.4\nstream\n" + zlib.compress(b"BT (Hello \\(PDF\\) \\101) Tj [(more) 3 (text)] TJ ET") + b"\nendstream"
    given = {"a.txt": b"\xef\xbb\xbfhi\r\nyou", "b.txt": "né".encode("utf-16-le").join([b"\xff\xfe", b""]), "c.md": b"caf\xe9", "d.txt": b"", "e.exe": b"x", "f.pdf": b"nope", "g.pdf": pdf, "h.csv": b" \n"}
    for n, data in given.items():
        (tmp_path / n).write_bytes(data)
    got = {r["name"]: (r["text"], r["load_error"]) for r in files.scan(spark, str(tmp_path)).collect()}
    assert got == {"a.txt": ("hi\nyou", None), "b.txt": ("né", None), "c.md": ("café", None), "e.exe": (None, "UNSUPPORTED"), "f.pdf": (None, "CORRUPT_PDF"), "g.pdf": ("Hello (PDF) A more text", None), "h.csv": (None, "WHITESPACE")}
    bare = spark.createDataFrame([("d.txt", 0, b""), ("e.txt", 9, b"too large")], "path string, length bigint, content binary")
    assert {r["name"]: r["load_error"] for r in files.load(bare, max_bytes=8).collect()} == {"d.txt": "EMPTY", "e.txt": "TOO_LARGE"}


def test_settings(tmp_path):
    path = str(tmp_path / "s.json")
    files.write_settings(files.Settings(rrf_k=10), path)
    assert files.read_settings(path).rrf_k == 10 and files.read_settings(path + "x") == files.Settings()
    with pytest.raises(ValueError, match="port"):
        files.Settings(port=1)
    assert files.resolve_model(["qwen:7b", "llama3:8b-q4"], "llama3:8b") == "llama3:8b-q4"


def test_responses(spark):
    lines = spark.createDataFrame([('{"message": {"content": "a"}}',), ("bad",)], "value string")
    assert [r["content"] for r in files.ndjson_content(lines).collect()] == ["a"]
    body = spark.createDataFrame([('{"candidates": [{"content": {"parts": [{"text": "x"}, {"text": "y"}]}}]}',)], "b string")
    assert body.select(files.candidate_text(F.col("b"))).first()[0] == "xy"


def test_ledger_stream_extends_chains(spark, tmp_path):
    events, chain = _ledger(spark, 20)
    target = str(tmp_path / "ledger")
    append = streams.append_batch(target)
    append(events.where("idx < 12"), 0)
    append(events.where("idx >= 12"), 1)
    append(events.where("idx >= 12"), 1)  # a batch that runs again
    stored = spark.read.parquet(target).drop("batch")
    assert stored.orderBy("idx").select("idx", "current_hash").collect() == chain.orderBy("idx").select("idx", "current_hash").collect()


def test_type_counts_of_all_rules(spark):
    """Also the rules with lookaround, against Python's engine."""
    texts = ["Dr. Anna Smith at noon, Mrs Jane Doe", "Patient Name: John Roe\nAccession No: 12345678 WARD 3", "Collected at: 12 Main Hall, North\nReferred by: City Clinic : x", "mail a.b@c.org, MRN: 1234-5678-AB", "", None]
    rows = privacy.type_counts(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), "doc_id").collect()
    want = {}
    for i, t in enumerate(texts):
        for kind, p, *_ in privacy.RULES:
            n = len(list(re.finditer(p, t or "")))
            if n:
                want[i, kind] = want.get((i, kind), 0) + n
    assert {(r["doc_id"], r["type"]): r["n"] for r in rows} == want
    assert {(0, "NAME"), (1, "NAME"), (1, "MRN"), (2, "ADDRESS")} <= set(want)


def test_json_text_escapes_as_python_does(spark):
    import json

    texts = ["Résumé \x07\x08\x0c\x7f", 'say "hi" \\ \n\r\t', "中文 😀 \U0010ffff", "plain", "", "\x00\x1f~ "]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", ledger.json_text(F.col("t")).alias("j")).collect()
    assert {r["i"]: r["j"] for r in rows} == {i: json.dumps(t) for i, t in enumerate(texts)}


def test_ledger_load(spark, tmp_path):
    _, chain = _ledger(spark, 5)
    chain = chain.withColumn("ledger", F.col("ledger").cast("string"))
    chain.write.json(str(tmp_path / "l"))
    assert ledger.read(spark, str(tmp_path / "l")).count() == 5
    with pytest.raises(ValueError, match="malformed"):
        ledger.loaded(chain.withColumn("data_hash", F.when(F.col("idx") == 1, F.lit("short")).otherwise(F.col("data_hash"))))
    with pytest.raises(ValueError, match="chains are broken"):
        ledger.loaded(chain.where("idx <> 2"))
    with pytest.raises(ValueError, match="empty"):
        ledger.loaded(chain.limit(0))
    with pytest.raises(ValueError, match="lacks data_hash"):
        ledger.loaded(chain.drop("data_hash"))
    (tmp_path / "l" / "bad.json").write_text("no json\n")
    with pytest.raises(ValueError, match="no JSON"):
        ledger.read(spark, str(tmp_path / "l"))


def test_long_and_many_ledgers(spark):
    import hashlib

    e = spark.range(30_000).select((F.col("id") % 3).alias("ledger"), F.floor(F.col("id") / 3).alias("idx"), F.lit("t").alias("ts"), F.lit("ERROR").alias("event_type"), F.lit("s").alias("payload_summary"), F.sha2(F.col("id").cast("string"), 256).alias("data_hash"))
    e = e.unionByName(e.where("ledger = 0 and idx < 50").withColumn("ledger", F.lit(None).cast("bigint")))
    chain = ledger.chained(e)
    assert {tuple(r) for r in ledger.verified(chain.where("ledger is not null")).collect()} == {(i, True, -1, 10_000) for i in range(3)}
    prev = "0" * 64
    for r in chain.where("ledger is null").orderBy("idx").collect():
        assert r["previous_hash"] == prev
        prev = hashlib.sha256(f"{r['idx']}:t:ERROR:{r['data_hash']}:{prev}".encode()).hexdigest()
        assert r["current_hash"] == prev


def test_writers(spark):
    row = spark.range(1).select(*ledger.mode_switch(F.lit("cloud")), *ledger.system_shutdown(F.lit("stopped"))).first()
    assert tuple(row) == ("Mode switched to cloud", '{"mode": "cloud"}', "stopped", "{}")


def test_long_text_in_windows(spark):
    """Five million characters on few lines, and windows that reach into several steps."""
    import time

    text = ("word é😀 " * 12_500 + "\n") * 50
    docs = spark.createDataFrame([("d", "t", "LEGAL", text[:5_000_000])], "doc_key string, title string, category string, text string")
    start = time.time()
    got = chunk.fixed(docs).agg(F.count(F.lit(1)).alias("n"), F.max("start_line").alias("line")).first()
    assert got["n"] == math.ceil((5_000_000 - 60) / 390) and got["line"] > 40 and time.time() - start < 20
    short = "".join(f"{i}\n" for i in range(3000))
    rows = chunk.fixed(docs.withColumn("text", F.lit(short)), 100, 80).orderBy("chunk_index").collect()
    assert len(rows) == math.ceil((len(short) - 80) / 20)
    assert all(r["content"] == short[20 * i : 20 * i + 100] and r["start_line"] == short[: 20 * i].count("\n") + 1 for i, r in enumerate(rows))
    assert [r["content"] for r in chunk.fixed(docs.withColumn("text", F.lit("short")), 100, 80).collect()] == ["short"]


@pytest.mark.parametrize("limit", [1, 4, 10])
def test_words_of_a_limit(limit):
    def plain(text):
        line = None
        for word in text.split(" "):
            if line is not None and len(line) + 1 + len(word) <= limit:
                line += " " + word
                continue
            if line is not None:
                yield line
            line = word
            if len(word) > limit:
                yield from (word[i : i + limit] for i in range(0, len(word), limit))
                line = None
        if line is not None:
            yield line

    for text in ("a bb ccc dddd", "abcdefghijkl mn  o p", "  lead and trail ", "x", "aaaaaaaaaaaaaaaaaaaaaaa", "one  two   three"):
        assert [x for x in chunk._by_words(text, limit) if x] == [x for x in plain(text) if x]


def test_pdf_content_streams():
    import zlib

    body = b"BT /F1 12 Tf (a (nested) b\\) c) Tj <48 656C6C6F> Tj [(x) -120.5 <79> (\\172)] TJ (line) ' 1 2 (spaced) \" (not shown) pop ET"
    pdf = b"%PDF-1.4\n1 0 obj\nstream\r\n" + body + b"\nendstream endobj\nstream\n" + zlib.compress(b"(second) Tj") + b"\nendstream\nstream\n(cut"
    assert files.pdf_text(pdf) == "a (nested) b) c Hello x y z line spaced second"
    assert files.pdf_text(b"%PDF-1.4") == ""


def test_pdf_guards(spark):
    given = [("a.pdf", b"%PDF-1.4 /Encrypt 5 0 R"), ("b.pdf", b"%PDF-1.4 << /Type /Pages /Kids [] /Count 0 >>"), ("c.pdf", b"%PDF-1.4 << /Type /Pages /Count 2 >> stream\n(hi) Tj\nendstream"), ("d.pdf", b"%PDF-1.4")]
    df = spark.createDataFrame([(n, len(c), c) for n, c in given], "path string, length bigint, content binary")
    assert {r["name"]: (r["text"], r["load_error"]) for r in files.load(df).collect()} == {"a.pdf": (None, "ENCRYPTED_PDF"), "b.pdf": (None, "EMPTY_PDF"), "c.pdf": ("hi", None), "d.pdf": (None, "WHITESPACE")}


def test_fusion_ranks_the_unrounded_sum(spark):
    make = lambda pairs: spark.createDataFrame([(1, c, r) for c, r in pairs], "query_id bigint, chunk_id string, rank int")
    rows = retrieve.fuse([make([("b", 99_999), ("a", 100_000)]), make([("z", 1)])]).orderBy("rank").collect()
    assert [r["chunk_id"] for r in rows] == ["z", "b", "a"] and rows[1]["rrf"] == rows[2]["rrf"]
    rows = retrieve.fuse([make([("a", 100_000)]), make([("b", 99_999)])]).orderBy("rank").collect()
    assert [r["chunk_id"] for r in rows] == ["b", "a"]  # equal when rounded, and a was seen first


def test_spaces_and_index(spark, tmp_path):
    from docsluice.operators import dense

    chunks = spark.createDataFrame([("c1", "radar power"), ("c2", "cooling fluid"), ("c3", "radar")], "chunk_id string, content string")
    queries = spark.createDataFrame([(1, "radar power")], "query_id bigint, query string")
    with pytest.raises(PermissionError):
        dense.search_space(chunks, queries, "airgap", "cloud")
    for mode, space in (("cloud", "cloud"), ("airgap", "local")):
        assert dense.search_space(chunks, queries, mode, space).where("rank = 1").first()["chunk_id"] == "c1"
    sinks.vectors(dense.both_spaces(chunks).drop("space").limit(0), str(tmp_path / "v"), "local")
    for space, rows in (("local", dense.both_spaces(chunks).where("space = 'local'")), ("cloud", dense.both_spaces(chunks).where("space = 'cloud'"))):
        sinks.vectors(rows.drop("space"), str(tmp_path / "v"), space)
    back = sinks.read_vectors(spark, str(tmp_path / "v"), "cloud")
    assert back.count() == 3 and max(s for r in back.collect() for s in r["slots"]) < 768
    index = dense.index_update(back, added=back.where("chunk_id = 'c1'"), removed=back.where("chunk_id = 'c2'"))
    assert sorted(r["chunk_id"] for r in index.collect()) == ["c1", "c3"]


def test_ingest_report_and_clear(spark):
    raw = spark.createDataFrame([(1, "a", "same", "LEGAL"), (2, "b", "same", "LEGAL"), (3, "c", "", "LEGAL"), (4, "d", "x " * 2000, "LEGAL"), (5, "e", "old", "LEGAL")], "row_id bigint, title string, raw string, category string")
    old = collection.ingest(raw.where("row_id = 5"))
    docs, chunks, report = collection.ingest_report(raw, chunk.fixed, old, most=3)
    assert sorted((r["row_id"], r["status"], r["chunk_count"]) for r in report.collect()) == [(1, "INGESTED", 1), (2, "DUPLICATE", 0), (3, "EMPTY", 0), (4, "TOO_MANY_CHUNKS", 0), (5, "DUPLICATE", 0)]
    assert [r["row_id"] for r in docs.collect()] == [1] and chunks.count() == 1
    none, bare, counts = collection.cleared(docs, chunks)
    assert (none.count(), bare.count(), tuple(counts.first())) == (0, 0, (1, 1))


def test_percentiles_of_many_values(spark):
    import random

    r = random.Random(1)
    values = [("hot", r.gauss(0, 1)) for _ in range(5000)] + [("few", 1.0), ("few", 1.0), ("one", 3.0), ("none", None)]
    got = {x["k"]: tuple(x)[1:] for x in metrics.nearest_rank(spark.createDataFrame(values, "k string, v double"), "v", {"p0": 0.0, "p50": 0.5, "p99": 0.99, "p100": 1.0}, ["k"]).collect()}
    hot = sorted(v for k, v in values if k == "hot")
    assert got == {"hot": (5000, hot[0], hot[2500], hot[4950], hot[4999]), "few": (2, 1.0, 1.0, 1.0, 1.0), "one": (1, 3.0, 3.0, 3.0, 3.0)}


def test_small_helpers(spark, tmp_path):
    (tmp_path / "b.txt").write_text("one\ntwo")
    (tmp_path / "a.txt").write_text("x")
    report = sinks.merged_report(spark, str(tmp_path), "*.txt").orderBy("name").collect()
    assert [(r["name"], r["lines"], r["chars"]) for r in report] == [("a.txt", 1, 1), ("b.txt", 2, 7)] and report[0]["section"] == "=== a.txt ===\nx\n"
    sinks.write_json(str(tmp_path / "x" / "s.json"), {"a": 1})
    assert sinks.read_json(str(tmp_path / "x" / "s.json")) == {"a": 1} and sinks.read_json(str(tmp_path / "no.json"), 5) == 5
    (tmp_path / "g.csv").write_text("question,expected_doc,query_type\nWhat?,a.txt,direct\n")
    assert tuple(files.golden(spark, str(tmp_path / "g.csv")).first()) == ("What?", "a.txt", "direct")
    names = spark.createDataFrame([("My_Clinical.txt",), ("legal_msa.txt",), ("FINANCIAL.txt",), ("radar.txt",)], "n string")
    assert [r[0] for r in names.select(files.category_of_name(F.col("n"))).collect()] == ["CLINICAL", "LEGAL", "FINANCIAL", "DEFENSE"]
    q, c = spark.createDataFrame([(1, "why"), (2, "who")], "query_id bigint, query string"), spark.createDataFrame([(1, "ctx")], "query_id bigint, context string")
    assert {r["query_id"]: r["prompt"] for r in retrieve.prompt(q, c).collect()} == {1: "Context Blocks:\nctx\n\nQuestion:\nwhy", 2: "Context Blocks:\n\n\nQuestion:\nwho"}


def test_environment_files(tmp_path):
    path = str(tmp_path / "x.env")
    files.upsert_env({"A": "1"}, path)
    with open(path, "a", encoding="utf-8") as f:
        f.write("# note\nB = old\n")
    files.upsert_env({"B": "two=2", "C": ""}, path)
    assert open(path, encoding="utf-8").read() == "A=1\n# note\nB=two=2\nC=\n"
    with pytest.raises(ValueError):
        files.upsert_env({"A": "1\nB=2"}, path)


def test_host_figures(spark):
    row = files.host_figures(spark).first()
    assert row["cpu_count"] > 0 and 0 < row["memory_used_gib"] <= row["memory_gib"] and (row["cpu_percent"] is None or 0 <= row["cpu_percent"] <= 100)


def test_prompt(spark):
    q = spark.createDataFrame([(1, "why?"), (2, "who?")], "query_id bigint, query string")
    made = retrieve.prompt(q, spark.createDataFrame([(1, "ctx")], "query_id bigint, context string"))
    assert {r["query_id"]: r["prompt"] for r in made.collect()} == {1: "Context Blocks:\nctx\n\nQuestion:\nwhy?", 2: "Context Blocks:\n\n\nQuestion:\nwho?"}
