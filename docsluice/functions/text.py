"""Text scalars as column expressions. All are built in and stay in whole-stage code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that retrieval leaves out.
STOPWORDS = (
    "what", "is", "the", "a", "an", "of", "in", "to", "and", "or", "for", "on",
    "with", "as", "by", "at", "from", "it", "this", "that", "are", "was", "were",
    "be", "been", "have", "has", "had", "do", "does", "did", "how", "why", "when",
    "which", "who", "whom",
)

LEAST_TERM = 2  # characters

#: White space as the loaders and splitters mean it.
WS = r"[ \t\n\r\f\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
WORD = r"[\p{L}\p{N}_]+"
TERM = r"[$%\p{L}\p{N}_]+(?:[-./][$%\p{L}\p{N}_]+)*"
#: How answers cite and quote.
CITATION = r"\[Doc:[ \t\n]*([^,\]]+),[ \t\n]*Page[ \t\n]*([0-9]+),[ \t\n]*Line[ \t\n]*([0-9]+)-([0-9]+)\]"
QUOTE = r'"([^"\n]{12,})"'
PII_TOKEN = r"\[SAFE_[A-Z_]+_[0-9]+(?:_X)*\]"


#: The same in loops that never give back: a long text neither fills the stack nor takes quadratic time.
_TERM = TERM.replace("+", "++").replace(")*", ")*+")
_B = r"[ \t\n]*+"
_REST = rf",{_B}Page{_B}([0-9]++),{_B}Line{_B}([0-9]++)-([0-9]++)\]"


def free_names(wanted: tuple[str, ...], taken: list[str]) -> tuple[str, ...]:
    """``wanted`` with underscores until none is a name in ``taken`` (case does not count)."""
    low, out = {t.lower() for t in taken}, []
    for name in wanted:
        while name.lower() in low:
            name += "_"
        out.append(name)
    return tuple(out)


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once for a row, also where ``body`` uses it inside another lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def bm25_tokens(text: Column) -> Column:
    """Lower-case terms: runs of $, %, letters, digits and _ joined by single - . or /, commas between digits gone, two characters at least, no stopword. Null gives an empty array."""
    return F.filter(bm25_runs(text), lambda t: (F.length(t) >= LEAST_TERM) & ~t.isin(*STOPWORDS))


def bm25_runs(text: Column) -> Column:
    """What ``bm25_tokens`` picks from: single characters and stopwords are still there."""
    # the comma comes first, so that only commas are looked around
    plain = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r",(?<=\p{Nd},)(?=\p{Nd})", "")
    return F.regexp_extract_all(plain, F.lit(_TERM), F.lit(0))


def counts(tokens: Column) -> Column:
    """Distinct terms with their counts: runs of the sorted tokens."""
    def runs(s: Column, starts: Column) -> Column:
        ends = F.concat(F.slice(starts, 2, F.greatest(F.size(starts) - 1, F.lit(0))), F.array(F.size(s)))
        return F.zip_with(starts, ends, lambda a, z: F.struct(F.get(s, a).alias("term"), (z - a).alias("tf")))

    def of(s: Column) -> Column:
        at = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        return F.when(F.size(s) > 0, let(at, lambda starts: runs(s, starts))).otherwise(F.array().cast("array<struct<term:string,tf:int>>"))

    return let(F.sort_array(tokens), of)


def word_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def content_words(text: Column) -> Column:
    """Word tokens without stopwords, or all of them if nothing else is left."""
    kept = lambda words: F.filter(words, lambda w: ~w.isin(*STOPWORDS))
    return let(word_tokens(text), lambda words: let(kept(words), lambda k: F.when(F.size(k) > 0, k).otherwise(words)))


def sentences(text: Column, after: str = ".!?") -> Column:
    """Pieces between white space that follows one of ``after``."""
    return F.split(text, f"(?<=[{after}]){WS}+")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{WS}++|(?<!{WS}){WS}++$", "")


def blank(text: Column) -> Column:
    """Whether a text has white space alone: ``strip`` leaves nothing. Reads no further than the first other character."""
    return ~F.rlike(text, F.lit(f"[^{WS[1:]}"))


def squeeze(text: Column) -> Column:
    """Lower case, each run of white space as one blank."""
    return F.regexp_replace(F.lower(text), f"{WS}+", " ")


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, f"{WS}+"), lambda w: w != ""))


def normal_lines(text: Column) -> Column:
    """NUL becomes a blank; CRLF and CR become LF. Most texts hold neither and are left as they are, as a search for one character is faster than ``replace``."""
    changed = F.replace(F.replace(F.replace(text, F.lit("\x00"), F.lit(" ")), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    return F.when(F.contains(text, F.lit("\x00")) | F.contains(text, F.lit("\r")), changed).otherwise(text)


def sha256(value: Column) -> Column:
    return F.sha2(value, 256)


def document_key(sha: Column) -> Column:
    return F.concat(F.lit("doc_"), F.substring(F.md5(sha), 1, 10))


def newlines(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def line_at(text: Column, offset: Column) -> Column:
    """1-based line of the character at 0-based ``offset``."""
    return newlines(F.substr(text, F.lit(1), offset)) + 1


def page_of(line: Column) -> Column:
    return F.floor((line - 1) / 50).cast("int") + 1


def citations(text: Column) -> Column:
    """Array of structs (name, page, first, last)."""
    # a name that no page follows matches too, so that it is read once, and goes then
    part = [F.regexp_extract_all(text, F.lit(rf"\[Doc:([^,\]]++)(?:{_REST})?+"), F.lit(i)) for i in range(1, 5)]
    rows = F.filter(F.arrays_zip(*[p.alias(n) for p, n in zip(part, ("name", "page", "first", "last"), strict=True)]), lambda x: x["page"] != "")
    name = lambda x: F.regexp_replace(x["name"], r"(?s)^[ \t\n]+(?=.)", "")
    return F.transform(rows, lambda x: F.struct(name(x).alias("name"), x["page"].cast("int").alias("page"), x["first"].cast("int").alias("first"), x["last"].cast("int").alias("last")))


def without_citations(text: Column) -> Column:
    rest = _REST.replace("(", "(?:")
    return F.regexp_replace(text, rf"(\[Doc:[^,\]]++(?!{rest}))|\[Doc:[^,\]]++{rest}", "$1")


def quotes(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(QUOTE), F.lit(1))


def pii_tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({PII_TOKEN.replace(')*', ')*+')})"), F.lit(1))


def restore(text: Column, tokens: Column) -> Column:
    """Put raw values back: every key of the map is replaced by its value, in the map's order."""
    return F.aggregate(F.map_entries(tokens), text, lambda t, e: F.replace(t, e["key"], e["value"]))


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def mask_secret(value: Column) -> Column:
    v = F.coalesce(value, F.lit(""))
    return F.when(v == "", "").when(F.length(v) > 8, F.concat(F.left(v, F.lit(4)), F.lit("..."), F.right(v, F.lit(4)))).otherwise("****")
