"""The audit ledger: payload hashes, the hash chain, verification, filters."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

GENESIS = "0" * 64
EVENTS = ("GENESIS", "DOCUMENT_INGEST", "PII_REDACT", "LOCAL_QUERY", "AIR_GAP_VERIFY", "QUANT_TELEMETRY", "ERROR", "MODE_SWITCH", "SYSTEM_SHUTDOWN")


def json_text(value: Column) -> Column:
    """A JSON string literal of printable ASCII: escapes for quotes, backslashes and control characters, ``\\uXXXX`` (pairs beyond the basic plane) for all others."""
    hex4 = lambda n: F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(n)), 4, "0"))

    def escaped(c):
        n = F.ascii(c)
        high, low = (n - 0x10000).bitwiseAND(0xFFC00) / 1024 + 0xD800, (n - 0x10000).bitwiseAND(0x3FF) + 0xDC00
        out = F.when(n > 0xFFFF, F.concat(hex4(high.cast("int")), hex4(low))).when((n < 32) | (n > 126), hex4(n)).otherwise(c)
        for raw, short in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\b", "\\b"), ("\f", "\\f"), ('"', '\\"'), ("\\", "\\\\")):
            out = F.when(c == F.lit(raw), F.lit(short)).otherwise(out)
        return out

    plain = F.rlike(value, F.lit(r'^[ !#-\[\]-~]*$'))  # nothing to escape
    long = F.array_join(F.transform(F.split(value, ""), escaped), "")
    return F.concat(F.lit('"'), F.when(plain, value).otherwise(long), F.lit('"'))


def json_object(**fields: Column) -> Column:
    """Keys in order, ``": "`` and ``", "`` between; values are given as JSON already."""
    parts = [F.concat(F.lit(f'"{k}": '), fields[k]) for k in sorted(fields)]
    return F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))


def _bool(c: Column, yes: str = "True", no: str = "False") -> Column:
    return F.when(c, yes).otherwise(no)


def document_ingest(title: Column, key: Column, category: Column, sha: Column, chunks: Column) -> tuple[Column, Column]:
    """Summary and data of each kind of event, as the writers below give them."""
    return F.concat(F.lit("Document Ingested: "), title, F.lit(" ("), chunks, F.lit(" chunks)")), json_object(doc_id=json_text(key), category=json_text(category), sha256=json_text(sha), chunks=chunks.cast("string"))


def pii_redact(entities: Column, risk: Column) -> tuple[Column, Column]:
    return F.concat(F.lit("PII Redaction: "), entities, F.lit(" entities sanitized (risk score: "), risk, F.lit(")")), json_object(entities_redacted=entities.cast("string"), risk_score_heuristic=risk.cast("string"))


def local_query(model: Column, chunks: Column, grounded: Column) -> tuple[Column, Column]:
    return (
        F.concat(F.lit("Query executed via "), model, F.lit(" (retrieved "), chunks, F.lit(" chunks, grounded: "), _bool(grounded), F.lit(")")),
        json_object(model=json_text(model), chunks_retrieved=chunks.cast("string"), grounded=_bool(grounded, "true", "false")),
    )


def air_gap_verify(verified: Column, egress: Column) -> tuple[Column, Column]:
    return (
        F.concat(F.lit("Air Gap Verification: loopback="), _bool(verified), F.lit(", observed non-loopback egress bytes="), egress),
        json_object(loopback_verified=_bool(verified, "true", "false"), egress_bytes=egress.cast("string")),
    )


def quant_telemetry(model: Column, quant: Column, gib: Column) -> tuple[Column, Column]:
    return (
        F.concat(F.lit("Quantization Telemetry: "), model, F.lit(" ("), quant, F.lit(") memory estimate "), gib, F.lit(" GiB")),
        json_object(model=json_text(model), quant=json_text(quant), vram_estimate_gib=gib.cast("string")),
    )


def error(kind: Column, message: Column) -> tuple[Column, Column]:
    return F.concat(F.lit("Error: ["), kind, F.lit("] "), F.left(message, F.lit(120))), json_object(error_class=json_text(kind), message=json_text(message))


def mode_switch(mode: Column) -> tuple[Column, Column]:
    return F.concat(F.lit("Mode switched to "), mode), json_object(mode=json_text(mode))


def system_shutdown(message: Column) -> tuple[Column, Column]:
    """The message is the caller's; there are no data."""
    return message, F.lit("{}")


def data_hash(summary: Column, data: Column) -> Column:
    return F.sha2(F.concat(summary, data), 256)


def current_hash(index: Column, ts: Column, kind: Column, data: Column, previous: Column) -> Column:
    return F.sha2(F.concat_ws(":", index.cast("string"), ts, kind, data, previous), 256)


def record_hash(index: int, ts, kind, data, previous) -> str:
    """``current_hash`` of one record."""
    return hashlib.sha256(":".join(x for x in (str(index), ts, kind, data, previous) if x is not None).encode()).hexdigest()


_NO_KEY = object()
RECORD = "idx bigint, ts string, event_type string, payload_summary string, data_hash string, previous_hash string, current_hash string"


def fold(rows: DataFrame, key: str, first: tuple[str, str] | None = None) -> DataFrame:
    """Chains rows that one partition holds whole for each key, in order. ``first`` names columns with the index and the hash that a key's chain goes on from."""
    names = [key, "idx", "ts", "event_type", "payload_summary", "data_hash", *(first or ())]
    schema = f"{key} {rows.schema[key].dataType.simpleString()}, {RECORD}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, at, last = _NO_KEY, None, GENESIS
        for b in batches:
            cols = {n: b.column(n).to_pylist() for n in names}
            index, before, after = [], [], []
            for i, k in enumerate(cols[key]):
                if now is _NO_KEY or k != now:
                    now, at, last = k, *((cols[first[0]][i], cols[first[1]][i]) if first else (None, GENESIS))
                number = cols["idx"][i] if at is None else at
                index.append(number)
                before.append(last)
                last = record_hash(number, cols["ts"][i], cols["event_type"][i], cols["data_hash"][i], last)
                after.append(last)
                at = None if at is None else at + 1
            kept = [b.column(n) for n in ("ts", "event_type", "payload_summary", "data_hash")]
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array(index, pa.int64()), *kept, pa.array(before, pa.string()), pa.array(after, pa.string())], names=[key, *[f.split(" ")[0] for f in RECORD.split(", ")]])

    return rows.select(*names).repartition(key).sortWithinPartitions(key, "idx").mapInArrow(run, schema)


def chained(events: DataFrame, key: str = "ledger") -> DataFrame:
    """Chain of each ledger: events (key, idx, ts, event_type, payload_summary, data_hash), idx from 0 without gaps.

    A chain is serial by nature: each ledger is one pass over its sorted rows,
    which are streamed, never gathered. Many ledgers run side by side.
    """
    return fold(events, key)


def loaded(ledger: DataFrame, key: str = "ledger") -> DataFrame:
    """``ledger`` itself if it is sound; ValueError if it is empty, a record is malformed or a chain is broken."""
    want = [f.split(" ")[0] for f in RECORD.split(", ")]
    missing = [c for c in [key, *want] if c not in ledger.columns]
    if missing:
        raise ValueError("the ledger lacks " + ", ".join(missing))
    wrong = F.exists(F.array(*[F.col(c).cast("string") for c in [key, *want]]), lambda x: x.isNull()) | ~F.col("event_type").isin(*EVENTS) | ~F.rlike("data_hash", F.lit("^[0-9a-f]{64}$"))
    shape = ledger.agg(F.count(F.lit(1)).alias("n"), F.count_if(wrong).alias("wrong")).first()
    if not shape["n"]:
        raise ValueError("the ledger is empty")
    if shape["wrong"]:
        raise ValueError(f"{shape['wrong']} records of the ledger are malformed")
    broken = verified(ledger, key).agg(F.count_if(~F.col("valid")).alias("n"), F.min(F.when(~F.col("valid"), F.struct(key, "first_bad"))).alias("x")).first()
    if broken["n"]:
        raise ValueError(f"{broken['n']} chains are broken, the first at {tuple(broken['x'])}")
    return ledger


def read(spark, path: str, key: str = "ledger") -> DataFrame:
    """A stored ledger (JSON lines); anything that does not parse or hold raises."""
    parsed = F.from_json("value", f"{key} string, {RECORD}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    rows = spark.read.text(path).where(F.trim("value") != "").select(parsed.alias("r")).select("r.*")
    if not rows.where("_bad is not null").isEmpty():
        raise ValueError(f"{path} holds lines that are no JSON")
    return loaded(rows.drop("_bad"), key)


def verified(ledger: DataFrame, key: str = "ledger", place: str = "idx") -> DataFrame:
    """(key, valid, first_bad, n): by place, each record's hash must recompute and its previous hash be that of the record before it (64 zeros for the first). first_bad is the position, from 0, of the first that fails, -1 if all hold.

    Records are compared with their neighbours as they lie, so repeated, missing
    and swapped ones are found. They are dealt out by ranges of (key, place), so
    a long ledger spreads over tasks; each range gives a row for each ledger in
    it, and these are stitched at their ends. Editing a summary alone goes
    unseen, as the payload is not stored. Equal places go by idx and hash.
    """
    own = F.coalesce(F.col("current_hash") == current_hash(F.col("idx"), F.col("ts"), F.col("event_type"), F.col("data_hash"), F.col("previous_hash")), F.lit(False))
    rows = ledger.select(F.col(key).alias("_k"), F.col(place).alias("_p"), "idx", "previous_hash", "current_hash", own.alias("_own"))
    rows = rows.repartitionByRange("_k", "_p").sortWithinPartitions("_k", "_p", "idx", "current_hash", "previous_hash").select("_k", "previous_hash", "current_hash", "_own", F.spark_partition_id().alias("_part"))
    schema = f"_k {rows.schema['_k'].dataType.simpleString()}, _part int, n bigint, begins string, own boolean, ends string, bad bigint"
    parts = rows.mapInArrow(_ranges, schema)
    by = Window.partitionBy("_k").orderBy("_part")
    ahead = F.coalesce(F.sum("n").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before = F.when(F.row_number().over(by) == 1, F.lit(GENESIS)).otherwise(F.lag("ends").over(by))
    good = F.col("own") & F.coalesce(F.col("begins") == before, F.lit(False))
    parts = parts.select("_k", "n", (ahead + F.when(~good, F.lit(0)).otherwise(F.col("bad"))).alias("bad"))
    return parts.groupBy("_k").agg(F.coalesce(F.min("bad"), F.lit(-1)).alias("first_bad"), F.sum("n").alias("n")).select(F.col("_k").alias(key), (F.col("first_bad") == -1).alias("valid"), "first_bad", "n")


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each ledger of a sorted partition: rows, the first one's link and whether its hash holds, the last hash, and the first later position that fails."""
    names = ("_k", "_part", "n", "begins", "own", "ends", "bad")
    done: list[list] = []
    for b in batches:
        kinds = [b.schema.field(c).type for c in ("_k", "_part")] + [pa.int64(), pa.string(), pa.bool_(), pa.string(), pa.int64()]
        for k, before, after, own, part in zip(*(b.column(c).to_pylist() for c in ("_k", "previous_hash", "current_hash", "_own", "_part")), strict=True):
            if not done or done[-1][0] != k:
                done.append([k, part, 1, before, own, after, None])
                continue
            r = done[-1]
            if r[6] is None and not (own and before == r[5]):
                r[6] = r[2]
            r[2], r[5] = r[2] + 1, after
        if len(done) > 1:
            cols = zip(*done[:-1], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=names)
            done = done[-1:]
    if done:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), kinds, strict=True)], names=names)


def filtered(ledger: DataFrame, event_type: str) -> DataFrame:
    return ledger if event_type == "ALL" else ledger.where(F.col("event_type") == event_type)
