"""Sources: files of any supported type, directories, question sets, model responses, settings, host figures."""

from __future__ import annotations

import json
import os
import re
import shutil
import time
import zlib
from collections.abc import Iterator
from dataclasses import asdict, dataclass, fields

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.collection import MAX_CHARS

#: The file types that load.
EXTENSIONS = (".pdf", ".txt", ".md", ".py", ".js", ".ts", ".json", ".csv", ".html", ".xml")
MAX_BYTES = 50 << 20
_ESCAPES = {b"n": "\n", b"r": "\r", b"t": "\t", b"b": "\b", b"f": "\f"}
_PDF_ESCAPE = re.compile(rb"\\([0-7]{1,3}|.)", re.DOTALL)
#: Of a content stream: the start of a string literal, a hex string, a name or number (passed over), an operator.
_PDF_TOKEN = re.compile(rb"\(|<(?P<hex>[0-9A-Fa-f\s]*)>|[/+.\-0-9][^\s()<>\[\]/]*|(?P<word>[A-Za-z'\"*][A-Za-z0-9'\"*]*)")


def decoded(content: Column) -> Column:
    """Text of bytes: UTF-16 or UTF-8 by byte-order mark, else UTF-8 if valid, else Latin-1."""
    rest = lambda n: F.expr(f"substring(content, {n})")
    head = F.hex(F.substring(content, 1, 3))
    lossy = lambda c: F.when(F.is_valid_utf8(c.cast("string")), c.cast("string")).otherwise(F.make_valid_utf8(c.cast("string")))
    return (
        F.when(F.startswith(head, F.lit("FFFE")), F.decode(rest(3), "UTF-16LE"))
        .when(F.startswith(head, F.lit("FEFF")), F.decode(rest(3), "UTF-16BE"))
        .when(head == "EFBBBF", lossy(rest(4)))
        .when(F.is_valid_utf8(content.cast("string")), content.cast("string"))
        .otherwise(F.decode(content, "ISO-8859-1"))
    )


def unescape_pdf(raw: bytes) -> str:
    """A PDF string literal: letters, parentheses, backslash and octal codes of up to three digits. Other escaped bytes stand for themselves."""
    out, at = [], 0
    for m in _PDF_ESCAPE.finditer(raw):
        out.append(raw[at : m.start()].decode("latin-1"))
        e = m[1]
        out.append(chr(int(e, 8)) if e.isdigit() and e < b"8" else _ESCAPES.get(e, e.decode("latin-1")))
        at = m.end()
    return "".join(out) + raw[at:].decode("latin-1")


def _literal_end(data: bytes, at: int) -> int:
    """Place of the parenthesis that closes the string literal whose content begins at ``at``."""
    depth = 1
    while at < len(data):
        c = data[at]
        if c == 0x5C:  # the next byte is escaped
            at += 1
        elif c == 0x28:
            depth += 1
        elif c == 0x29:
            depth -= 1
            if not depth:
                return at
        at += 1
    return len(data)


def shown_strings(data: bytes) -> list[str]:
    """Strings that a content stream shows. Operands gather until an operator takes them; Tj, TJ, ' and " show theirs."""
    out, operands, at = [], [], 0
    while (m := _PDF_TOKEN.search(data, at)) is not None:
        at = m.end()
        if m[0] == b"(":
            end = _literal_end(data, at)
            operands.append(unescape_pdf(data[at:end]))
            at = end + 1
        elif m["hex"] is not None:
            digits = b"".join(m["hex"].split())
            operands.append(bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode()).decode("latin-1"))
        elif m["word"] is not None:
            if m["word"] in (b"Tj", b"TJ", b"'", b'"'):
                out += operands
            operands = []
    return out


def pdf_streams(content: bytes) -> Iterator[bytes]:
    """Bodies between ``stream`` and ``endstream``, inflated where they are deflated."""
    at = 0
    while (at := content.find(b"stream", at)) >= 0:
        begin, opens = at + 6, content[at - 3 : at] != b"end"
        at = begin
        if not opens:
            continue
        end = content.find(b"endstream", begin)
        body = content[begin : end if end >= 0 else len(content)].lstrip(b"\r\n")
        unpack = zlib.decompressobj()
        try:
            body = unpack.decompress(body)
        except zlib.error:
            body = body.rstrip(b"\r\n")
        yield body
        at = end if end >= 0 else len(content)


def pdf_text(content: bytes) -> str:
    """Text that the content streams of a PDF show, in their order."""
    return " ".join(s for body in pdf_streams(content) for s in shown_strings(body)).strip()


def pdf_error(content: Column) -> Column:
    """ENCRYPTED_PDF or EMPTY_PDF (a page tree of no pages), else null."""
    text = F.decode(content, "ISO-8859-1")
    return F.when(F.rlike(text, F.lit(r"/Encrypt\s")), "ENCRYPTED_PDF").when(F.rlike(text, F.lit(r"/Type\s*/Pages\b")) & ~F.rlike(text, F.lit(r"/Count\s+[1-9]")) & F.rlike(text, F.lit(r"/Count\s+0")), "EMPTY_PDF")


def _pdf_texts(df: DataFrame) -> DataFrame:
    names = df.columns
    schema = df.select("*", F.lit(None).cast("string").alias("pdf")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [pdf_text(c) if c and c[:4] == b"%PDF" else None for c in b.column("content").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(n) for n in names] + [pa.array(got, pa.string())], names=[*names, "pdf"])

    return df.mapInArrow(run, schema)


def load(files: DataFrame, max_bytes: int = MAX_BYTES, max_chars: int = MAX_CHARS) -> DataFrame:
    """Rows (path, length, content) of Spark's binaryFile source become (path, name, kind, sha256, text, load_error).

    Guards in order: EMPTY, TOO_LARGE, UNSUPPORTED, CORRUPT_PDF, ENCRYPTED_PDF,
    EMPTY_PDF, WHITESPACE, TOO_MANY_CHARS. A bad file is a row with an error, never a failed job. Only
    PDFs pass through Python.
    """
    ext = T.extension(F.col("path"))
    rows = files.withColumn("ext", ext)
    guard = F.when(F.col("length") == 0, "EMPTY").when(F.col("length") > max_bytes, "TOO_LARGE").when(~F.col("ext").isin(*EXTENSIONS), "UNSUPPORTED").when((F.col("ext") == ".pdf") & (F.substring("content", 1, 4) != F.lit(b"%PDF")), "CORRUPT_PDF")
    rows = rows.withColumn("guard", F.coalesce(guard, F.when(F.col("ext") == ".pdf", pdf_error(F.col("content")))))
    plain = rows.where(F.coalesce(F.col("ext") != ".pdf", F.lit(True)) | F.col("guard").isNotNull()).withColumn("raw", F.when(F.col("guard").isNull(), decoded(F.col("content"))))
    pdf = _pdf_texts(rows.where((F.col("ext") == ".pdf") & F.col("guard").isNull()).select(*rows.columns)).withColumnRenamed("pdf", "raw")
    both = plain.unionByName(pdf).withColumn("text", T.normal_lines(F.col("raw")))
    error = F.coalesce("guard", F.when(T.strip(F.coalesce("text", F.lit(""))) == "", "WHITESPACE").when(F.length("text") > max_chars, "TOO_MANY_CHARS"))
    both = both.withColumn("load_error", error)
    return both.select("path", F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), F.upper(F.substring("ext", 2, 10)).alias("kind"), F.sha2("content", 256).alias("sha256"), F.when(F.col("load_error").isNull(), F.col("text")).alias("text"), "load_error")


def scan(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """All files under a folder. Spark's listing leaves out files of 0 bytes; ``load`` marks them EMPTY where rows come from elsewhere."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    return load((reader.option("pathGlobFilter", glob) if glob else reader).load(path))


def category_of_name(name: Column) -> Column:
    low = F.lower(name)
    return F.when(F.contains(low, F.lit("clinical")), "CLINICAL").when(F.contains(low, F.lit("financial")), "FINANCIAL").when(F.contains(low, F.lit("legal")), "LEGAL").otherwise("DEFENSE")


def safe_name(name: Column) -> Column:
    """A file name without directories or characters that could leave the landing folder."""
    return F.regexp_replace(F.regexp_extract(F.replace(name, F.lit("\\"), F.lit("/")), r"([^/]*)$", 1), r"[^\p{L}\p{N}._-]|^\.+", "_")


def golden(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("question string, expected_doc string, query_type string").csv(path, header=True)


def ndjson_content(lines: DataFrame, column: str = "value") -> DataFrame:
    """Content of a streamed chat response, one JSON object for each line; lines that do not parse give no row."""
    return lines.select("*", F.get_json_object(column, "$.message.content").alias("content")).where(F.col("content").isNotNull())


def candidate_text(body: Column) -> Column:
    """First candidate of a generation response: its parts' text, joined."""
    parsed = F.from_json(body, "candidates array<struct<content:struct<parts:array<struct<text:string>>>>>")
    return F.array_join(F.transform(F.get(parsed["candidates"], F.lit(0))["content"]["parts"], lambda p: F.coalesce(p["text"], F.lit(""))), "")


def resolve_model(available: list[str], wanted: str) -> str:
    """The first available name that equals, contains or begins with ``wanted`` or its family, else the first, else ``wanted``."""
    tests = (lambda n: n == wanted, lambda n: wanted in n, lambda n: n.startswith(wanted.split(":")[0]))
    return next((n for t in tests for n in available if t(n)), available[0] if available else wanted)


@dataclass(frozen=True)
class Settings:
    engine_mode: str = "airgap"
    port: int = 8000
    chunk_size: int = 450
    chunk_overlap: int = 60
    bm25_k1: float = 1.5
    bm25_b: float = 0.75
    rrf_k: int = 60
    max_upload_bytes: int = MAX_BYTES
    max_extracted_chars: int = MAX_CHARS
    max_chunks_per_doc: int = 10_000

    def __post_init__(self):
        wrong = [n for n, ok in (("engine_mode", self.engine_mode in ("airgap", "cloud")), ("port", 1024 <= self.port <= 65535), ("chunk_overlap", 0 <= self.chunk_overlap < self.chunk_size), ("bm25_k1", self.bm25_k1 > 0), ("bm25_b", 0 <= self.bm25_b <= 1)) if not ok]
        if wrong:
            raise ValueError("settings out of range: " + ", ".join(wrong))


def read_settings(path: str) -> Settings:
    """From a JSON file; unknown keys are left out, a missing file gives the defaults."""
    if not os.path.exists(path):
        return Settings()
    with open(path, encoding="utf-8") as f:
        given = json.load(f)
    known = {x.name for x in fields(Settings)}
    return Settings(**{k: v for k, v in given.items() if k in known})


def write_settings(settings: Settings, path: str) -> None:
    """Whole or not at all, readable by the owner alone."""
    from .sinks import write_bytes

    write_bytes(path, json.dumps(asdict(settings), indent=2, sort_keys=True).encode(), 0o600)


def upsert_env(values: dict[str, str], path: str) -> None:
    """Set ``KEY=value`` lines of an environment file: lines of these keys are replaced where they stand, new keys come last, other lines stay. Whole or not at all, readable by the owner alone."""
    from .sinks import write_bytes

    wrong = [k for k, v in values.items() if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", k) or "\n" in v or "\r" in v]
    if wrong:
        raise ValueError("not to be written as one line: " + ", ".join(wrong))
    lines = []
    if os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            lines = f.read().splitlines()
    left = dict(values)
    for i, line in enumerate(lines):
        key = line.split("=", 1)[0].strip()
        if "=" in line and key in values:
            lines[i] = f"{key}={values[key]}"
            left.pop(key, None)
    lines += [f"{k}={v}" for k, v in left.items()]
    write_bytes(path, "".join(x + "\n" for x in lines).encode(), 0o600)


def _ticks() -> tuple[int, int] | None:
    """Idle and all clock ticks of the host so far; None where the system does not tell."""
    try:
        with open("/proc/stat", encoding="ascii") as f:
            n = [int(x) for x in f.readline().split()[1:9]]
    except (OSError, ValueError):
        return None
    return n[3] + n[4], sum(n)


def host_figures(spark: SparkSession, seconds: float = 0.1) -> DataFrame:
    """One row about the driver's host, the CPU's share in use over ``seconds``. It differs from run to run; what the system does not tell is null."""
    gib = lambda n: round(n / (1 << 30), 2)
    disk, page = shutil.disk_usage("/"), os.sysconf("SC_PAGE_SIZE")
    memory, free = page * os.sysconf("SC_PHYS_PAGES"), page * os.sysconf("SC_AVPHYS_PAGES")
    before = _ticks()
    time.sleep(seconds)
    after = _ticks()
    busy = None if not before or after[1] == before[1] else round(100 * (1 - (after[0] - before[0]) / (after[1] - before[1])), 1)
    row = (os.cpu_count(), busy, gib(memory), gib(memory - free), gib(disk.total), gib(disk.free))
    return spark.createDataFrame([row], "cpu_count int, cpu_percent double, memory_gib double, memory_used_gib double, disk_gib double, disk_free_gib double")
