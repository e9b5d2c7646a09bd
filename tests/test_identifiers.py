"""Spans of identifiers against plain matching of every rule, long adversarial texts, and texts that once filled the stack."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from docsluice.functions import text as T
from docsluice.operators import lexical, metrics, privacy, spans
from docsluice.operators.rules import DIGITS, RULES

COMPILED = [(re.compile(p), group, hint) for _, p, group, _, hint in RULES]
WORDS = sorted({w for ws in spans.STARTS.values() for w in ws} | {w for r in RULES if r[4] for w in r[4]})
PIECES = (
    " |  |\n|:|.|,|-|1|12|12345|123456|1234567890|AB|Ab|x|St|Street|Ave|road|at|by|and|Name|Date|REPORTING DATE|COLLECTION  DATE|COLLECTED AT|Sample Collected At|REFERRED BY|Patient ID|"
    "PATIENT NAME|No|ID|WARD|Y/F|Yrs|Jan 1, 2020|2020-01-02|10:30|PM|@|a.b@c.org|@x.yz|.com|123-45-6789|212-555-0199|NY 12345|, Town, NY 12345|Dr. Jane Roe|ſ|İ|é|_|é1|\t|!|#|/|+1|(212)|IN12AB|"
    "year-old male|1.2.3.4|http://a.b|www.x.y|USD |1234 5678 9012 3456|Printed By|Health Plan|age|K|\xa0"
).split("|")


def plain(text, hinted=True):
    low, digits, out = text.lower(), any(map(str.isdigit, text)), []
    if text.strip():
        for i, (p, group, hint) in enumerate(COMPILED):
            if digits if hint is DIGITS else not hinted or any(h in low for h in hint):
                out += [(i, *m.span(group)) for m in p.finditer(text) if m.start(group) >= 0 and m[group].strip()]
    return out


@pytest.mark.parametrize("seed", range(4))
def test_spans_equal_plain_matching(seed):
    r = random.Random(seed)
    for _ in range(4000):
        pool = [*r.sample(WORDS, 3), *r.sample(PIECES, r.randint(2, 8)), " "]
        text = "".join(r.choice(pool) + r.choice(["", "", " "]) for _ in range(r.randint(1, 14)))
        text = text.upper() if r.random() < 0.3 else text
        hinted = r.random() < 0.5
        assert spans.found(text, hinted) == plain(text, hinted), text


@pytest.mark.parametrize(
    "text",
    [
        "1 a " * 250_000, "a." * 400_000 + "@", "a." * 200_000 + "@" + "b." * 200_000, "\n" * 500_000 + "a! REPORTING DATE", "\n" * 500_000 + "x" * 31 + " REPORTING DATE",
        "PID" + " " * 500_000 + "!", "age 5" + " " * 500_000 + "-", "collected at a " * 60_000 + "!", "collected at a" + " " * 500_000 + "!", "1 a St" + " " * 500_000 + "5",
        "1  St " * 150_000, "name: " * 150_000, "Patient" + " " * 500_000 + "!", "REPORTING DATE " * 60_000, "cell" + " " * 500_000 + "!", "2020-01-02" + " " * 500_000 + "x",
        ": " * 300_000 + "name", "mr " * 300_000, "1" * 1_000_000, "1." * 500_000, "lic" + " #" * 300_000, "a-" * 300_000 + " printed", "collected at . \n" * 60_000,
    ],
)
def test_long_texts_take_linear_time(text):
    spans.found(text[:100])
    t = time.process_time()
    spans.found(text)
    assert time.process_time() - t < 3


def test_redaction_and_risk_equal_plain_matching(spark):
    r = random.Random(11)
    texts = ["".join(r.choice([*PIECES, *WORDS, " "]) + r.choice(["", " "]) for _ in range(30)) for _ in range(120)] + ["", " ", "no identifiers here"]
    rows = privacy.redact(spark.createDataFrame(list(enumerate(texts)), "i int, text string").repartition(3)).collect()
    for row in rows:
        found = sorted(((a, z, RULES[k][0], RULES[k][3]) for k, a, z in plain(row["text"])), key=lambda s: (s[0], s[0] - s[1], -s[3]))
        kept = []
        for s in found:
            if not kept or s[0] >= kept[-1][1]:
                kept.append(s)
            elif s[1] - s[0] > kept[-1][1] - kept[-1][0]:
                kept[-1] = s
        assert [(e["start_index"], e["end_index"], e["type"]) for e in row["entities"]] == [s[:3] for s in kept]
        out, at = "", 0
        for e in row["entities"]:
            assert row["token_map"][e["token"]] == e["raw"] == row["text"][e["start_index"] : e["end_index"]].strip()
            out, at = out + row["text"][at : e["start_index"]] + e["token"], e["end_index"]
        assert row["redacted_text"] == out + row["text"][at:]
        assert row["risk"] == min(100, 12 * len(kept))
    bands = privacy.redact(spark.createDataFrame([(t,) for t in texts], "text string")).select("risk", metrics.risk_band(F.col("risk")).alias("band")).distinct().collect()
    assert len({b["band"] for b in bands}) >= 2


def test_patterns_survive_a_million_parts(spark):
    texts = ["a." * 500_000 + "b", "[Doc:" * 200_000, "[Doc: a, Page 1, Line 2-3] " * 20_000, "[SAFE_A_1" + "_X" * 500_000 + "]", " " * 1_000_000 + "x" + " " * 1_000_000 + "y ", "1," * 500_000]
    df = spark.createDataFrame(list(enumerate(texts)), "chunk_id int, content string")
    t = time.time()
    got = df.select(F.size(T.bm25_tokens(F.col("content"))).alias("n"), F.size(T.citations(F.col("content"))).alias("c"), F.size(T.pii_tokens(F.col("content"))).alias("p"), F.length(T.strip(F.col("content"))).alias("s"), F.length(T.without_citations(F.col("content"))).alias("w")).collect()
    assert time.time() - t < 60
    assert got[0]["n"] == 1 and [r["c"] for r in got] == [0, 0, 20_000, 0, 0, 0] and got[3]["p"] == 1 and got[4]["s"] == 1_000_002 and got[2]["w"] == 20_000
    assert lexical.term_frequencies(df.where("chunk_id = 0")).count() == 1


def test_citations_of_odd_names(spark):
    rows = ["[Doc:  , Page 1, Line 2-3]", "[Doc: a [Doc: b, Page 4, Line 5-6]", "[Doc: a, Page x [Doc:c, Page\n7,Line 8-9]", "[Doc: , a, Page 1, Line 1-1]", "[Doc:]", "x [Doc: d]e, Page 1, Line 1-2]"]
    df = spark.createDataFrame([(t,) for t in rows], "t string").select("t", T.citations(F.col("t")).alias("c"), T.without_citations(F.col("t")).alias("w")).collect()
    for r in df:
        assert [tuple(map(str, c)) for c in r["c"]] == re.findall(T.CITATION, r["t"]) and r["w"] == re.sub(T.CITATION, "", r["t"])


def test_redaction_keeps_columns_of_its_own_names(spark):
    df = spark.createDataFrame([("mail a.b@c.org", 1, "x", "y")], "text string, entities int, Risk string, redacted_text string")
    row = privacy.redact(df).first().asDict()
    assert (row["entities"], row["Risk"], row["redacted_text"]) == (1, "x", "y")
    assert row["redacted_text_"] == "mail [SAFE_EMAIL_1]" and len(row["entities_"]) == 1 and row["risk_"] == 12


def test_counts_beyond_ascii_equal_sql(spark):
    """Word boundaries before and after letters beyond ASCII, and rules of digits that match without one."""
    import duckdb

    from docsluice.operators import privacy
    from docsluice.plans import oracles

    texts = ["4734 zuschen. Gech, zu den stür", "né 60 chbeau, sté", "KLMNÄSCHCHSTSCHVNGAVPFÖ", "phone .......- x", "éa@b.cdé", "SSNé123-45-6789é", "١٢٣ Road", "Mr\u00a0Smith ıMr Li", "12\x1cMain St", "€1234567812345678", "2020-01-01 – 10:30", ""]
    rows = list(enumerate(texts))
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", rows)
    want = sorted(con.execute(oracles.sql()["pii_type_counts"]).fetchall())
    got = privacy.type_counts(spark.createDataFrame(rows, "doc_id bigint, text string"), "doc_id").collect()
    assert sorted(map(tuple, got)) == want and {"ADDRESS", "VEHICLE_ID", "PHONE", "EMAIL"} <= {r["type"] for r in got}
