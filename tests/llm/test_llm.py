"""Each operator against a plain version of itself, and its edge cases."""

import functools
import gzip
import itertools
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pytest
from pyspark.sql import functions as F

from docsluice.llm import common, components, ctw, flac, jaccard, langid, mixing, packing, tokens, urlrules, vafile, warc

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORD = re.compile("[^\x20\x09-\x0d]+")


def low(t):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), t or "")


def corpus(n=60, seed=5):
    r = random.Random(seed)
    vocab = {"en": ["the", "of", "and", "window", "carries", "little", "green", "lamps"], "de": ["der", "und", "nicht", "fenster", "traegt", "kleine", "gruene", "lampen"]}
    rows = []
    for i in range(n):
        lang = "en" if i % 3 else "de"
        rows.append((i, " ".join(r.choice(vocab[lang]) for _ in range(r.randint(30, 200))), lang, "hot" if i % 2 else f"s{i % 5}", 0))
    base = rows[3][1].split()
    for j in range(12):  # near copies
        w = list(base)
        w[j * 2 % len(w)] = f"changed{j}"
        rows.append((n + j, " ".join(w), rows[3][2], "hot", 0))
    rows += [(n + 20, rows[0][1], "en", "hot", 0), (n + 21, rows[0][1], "en", "hot", 0), (n + 22, None, None, None, None), (n + 23, "", "en", "", 0), (n + 24, "Two words", "en", "s1", 0), (n + 25, "two WORDS", None, "s1", 0), (n + 26, "123 456 !", "en", "s1", 0), (n + 27, "long " * 9000 + "wörd", "de", "s2", 0)]
    return rows + [rows[5]]  # a repeated row


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).withColumn("key", F.lit("x")).withColumn("score", F.lit("y")).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


# ---- FLAC


@pytest.mark.parametrize("data", [b"", bytes(64), b"a" * 2048, bytes(range(256)) * 9, random.Random(1).randbytes(5000), b"plain text, " * 400, bytes([0, 255] * 1500)])
def test_flac_round_trip(data):
    (stream,) = flac.encode_many([data])
    ((pcm, blocks),) = flac.decode_many([stream])
    assert pcm == data and sum(b[2] for b in blocks) == len(data)
    assert flac._decode_plain(stream, flac.read_header(stream))[0] == data
    for at, n in ((0, 10), (1000, 100), (2040, 1)):
        assert flac.read_at(stream, at, n) == data[at : at + n]


def test_flac_finds_damage():
    stream = bytearray(flac.encode_many([b"some text to keep " * 200])[0])
    stream[-20] ^= 4
    with pytest.raises(ValueError, match="CRC-16"):
        flac.decode_many([bytes(stream)])


def test_document_media(docs, none):
    import hashlib

    for r in flac.document_media(docs).collect():
        text = next(t for i, t, *_ in corpus() if i == r["doc_id"])
        raw = (text or "").encode()
        whole = raw + bytes(-len(raw) % 64 if raw else 64)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(whole), hashlib.sha256(whole).hexdigest(), zlib.crc32(whole[-64:]))
    assert flac.document_media(none).count() == 0
    blocks = flac.pcm_blocks(flac.decode(flac.encode(docs.select("doc_id", flac.padded(F.col("text")).alias("p")), "p")), "doc_id")
    assert blocks.where("length(pcm) <> n_samples or sample_offset <> block * 1024").count() == 0


# ---- language


def test_languages(docs, none):
    rows = langid.document_languages(docs).collect()
    want = {i: l for i, t, l, *_ in corpus() if i < 60}
    assert np.mean([r["lang_pred"] == want[r["doc_id"]] for r in rows if r["doc_id"] in want]) > 0.95
    got = {r["doc_id"]: r for r in rows}
    assert {got[60 + k]["lang_pred"] for k in (22, 23, 26)} == {"und"}
    assert all(0 <= r["score"] <= 1 and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert langid.document_languages(none).count() == 0
    assert {r["lang_pred"] for r in langid.document_languages(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert len({r["doc_id"] for r in langid.stage(docs.sparkSession, docs, "").collect()} & set(want)) >= 58


def test_languages_against_plain_loops(docs):
    """Every text compressed with every dictionary, whatever its length; ties go to the first name and are rejected."""
    import zstandard

    models = langid.train(docs.where("pmod(crc32(cast(doc_id as string)), 4) <> 2"))
    for r in docs.select("doc_id", "text").join(langid.document_languages(docs).distinct(), "doc_id").collect():
        data = (r["text"] or "").lower().encode()
        if not any(map(str.isalpha, r["text"] or "")):
            assert (r["lang_pred"], r["score"], r["rejected"]) == ("und", 0, True)
            continue
        size = {}
        for name in sorted(models):
            d = zstandard.ZstdCompressionDict(models[name], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            p = zstandard.ZstdCompressionParameters.from_level(langid.LEVEL, dict_size=langid.DICT_BYTES, source_size=langid.DICT_BYTES + 4096, min_match=langid.MIN_MATCH, write_content_size=False, write_checksum=False, write_dict_id=False)
            size[name] = sum(len(zstandard.ZstdCompressor(dict_data=d, compression_params=p).compress(b)) for b in langid.blocks(data))
        first, second = sorted(size, key=lambda n: (size[n], n))[:2]
        assert (r["lang_pred"], r["margin"]) == (first, pytest.approx((size[second] - size[first]) / size[second]))
        assert r["rejected"] == (r["margin"] < langid.REJECT_MARGIN)
    same = langid.compressors({"b": b"the same text " * 9, "a": b"the same text " * 9})
    assert langid.judge("the same text", same)[::3] == ("a", True)


def long_words(seed, letters, n_words=3000):
    r = random.Random(seed)
    vocab = ["".join(r.choice(letters) for _ in range(r.randint(2, 9))) for _ in range(n_words)]
    return lambda n_bytes: " ".join(r.choice(vocab) for _ in range(n_bytes // 6))


def test_language_of_long_texts():
    """Every part of a long text counts, and its length does not wear the margin away."""
    en, de = long_words(1, "etaoinshrdlu"), long_words(2, "enisratdhulc")
    models = langid.compressors({"en": en(langid.DICT_BYTES).encode()[: langid.DICT_BYTES], "de": de(langid.DICT_BYTES).encode()[: langid.DICT_BYTES]})
    short = langid.judge(de(60_000), models)
    for size in (2 << 20, 5 << 20):
        lang, _, margin, rejected = langid.judge(de(size), models)
        assert (lang, rejected) == ("de", False) and margin > short[2] / 2
    assert langid.judge(en(300_000) + " " + de(900_000), models)[0] == "de"
    text = de(300_000).encode()
    assert b"".join(langid.blocks(text)) == text and max(map(len, langid.blocks(text))) <= langid.BLOCK_BYTES


def test_every_labelled_language_trains(spark):
    """Also one that has long texts only, and one of a single text in many copies whose hash is a high one."""
    en, de, fr = long_words(1, "etaoinshrdlu"), long_words(2, "enisratdhulc"), long_words(3, "esaitnrulodc")
    copies = spark.createDataFrame([(fr(3000),) for _ in range(40)], "t string").orderBy(F.xxhash64("t").desc()).first()["t"]
    rows = [(en(2000), "en") for _ in range(20)] + [(de(40_000), "de") for _ in range(5)] + [(copies, "fr")] * 2000 + [("", "xx"), (None, "yy"), ("text", None)]
    models = langid.train(spark.createDataFrame(rows, "text string, lang string"))
    assert sorted(models) == ["de", "en", "fr"]
    assert 4 * langid.TEXT_BYTES < len(models["de"]) <= 5 * (langid.TEXT_BYTES + 1) and len(models["fr"]) == len(copies) + 1
    assert langid.judge(de(20_000), langid.compressors(models))[0] == "de"


# ---- tokens and packing


@functools.cache
def fresh_tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.default_path())


def whole_ids(text):
    return fresh_tokenizer().encode(text or "", add_special_tokens=False).ids


def test_word_route_equals_whole_texts():
    texts = ["It's O'Neil’s 12,345.67 a.b.c. ... x.,y", "ΑΣ. é, caf\xe9. \xa0z\x1cq", "<|endoftext|> ! ß µ a<|startoftext|>,b <|ENDOFTEXT|>", None, "", "naïve, Éa. ÀÖ,", "éa. ́x", "İ, İ. Ç, \u0958, a\u0301,", "we'll 've I'D 'S'T x'rey \x7f, a\x01. #$%_ -- don''t 'll", "K\u212a, \u212b. ²³ ª, º."]
    ids, n = tokens.WordTokenizer(tokens.default_path()).encode(pa.array(texts))
    assert whole_ids(texts[2])[0] == 49407
    assert ids.tolist() == list(itertools.chain(*map(whole_ids, texts))) and n.tolist() == [len(whole_ids(t)) for t in texts]


def test_word_route_of_random_strings():
    r = random.Random(11)
    letters = "abzAZ019'.,-_<>|sStTdDlLmM\u00e9\u00c9\u00df\u0130\u0131\u0301\u0958\u03a3\u03c2\u4e2d\u0663\u2019\u00aa\u01c5\ufb01\x00\x7f"
    texts = [" ".join("".join(r.choice(letters) for _ in range(r.randint(1, 7))) for _ in range(6)) for _ in range(3000)] + ["<|endoftext|>" * 3 + "x", "a <|endoftext|>b, <|startoftext|>."]
    tok = tokens.WordTokenizer(tokens.default_path())
    ids, n = tok.encode(pa.array(texts))
    want = [e.ids for e in fresh_tokenizer().encode_batch_fast(texts, add_special_tokens=False)]
    ends = np.cumsum(n)
    for t, w, k, z in zip(texts, want, n.tolist(), ends.tolist()):
        assert ids[z - k : z].tolist() == w, t
    again, _ = tok.encode(pa.array(texts))  # from memory
    assert again.tolist() == ids.tolist()


def test_histogram(docs, none):
    lengths = sorted(len(whole_ids(t)) + 1 for _, t, *_ in corpus())
    rows = tokens.document_lengths(docs).collect()
    assert sorted(itertools.chain(*[[r["length"]] * r["n_docs"] for r in rows])) == lengths
    for r in rows:
        assert r["tokens_ge"] == sum(x for x in lengths if x >= r["length"]) and r["truncated_tokens"] == sum(min(x, r["length"]) for x in lengths)
        assert lengths[r["rank_from"] - 1] == lengths[r["rank_to"] - 1] == r["length"]
    hist = tokens.document_lengths(docs)
    assert [tuple(r) for r in tokens.at_limits(hist, [10, 4096]).collect()] == [(k, sum(min(x, k) for x in lengths), sum(x > k for x in lengths)) for k in (10, 4096)]
    assert tokens.quantiles(hist, [0.5]).first()["length"] == lengths[math.ceil(len(lengths) / 2) - 1]
    assert tokens.document_lengths(none).count() == 0


def check_packing(rows, capacity):
    by_seq = {}
    for r in rows:
        by_seq.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for members in by_seq.values():
        at = 0
        for off, n in sorted(members):
            assert off == at
            at += n
        assert at <= capacity
    return len(by_seq)


def test_packing(docs, none):
    rows = packing.document_sequences(docs, capacity=256).collect()
    n = check_packing(rows, 256)
    assert n <= -(-sum(r["length"] for r in rows) // 256) + 1
    texts = {i: t for i, t, *_ in corpus()}
    for r in rows:
        ids = np.array([*whole_ids(texts[r["doc_id"]]), 1], "<u4")
        assert r["start"] == 256 * r["piece"] and r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())
    assert len(rows) == sum(-(-(len(whole_ids(t)) + 1) // 256) for _, t, *_ in corpus())
    assert packing.document_sequences(none).count() == 0


def test_packing_rounds(spark):
    r = random.Random(2)
    cut = spark.createDataFrame([(i, r.randint(1, 100)) for i in range(3000)], "uid bigint, length bigint")
    rows = packing.pack(cut, 100, group=200).collect()
    assert len(rows) == 3000 and check_packing(rows, 100) <= 1.04 * sum(x["length"] for x in rows) / 100 + 1


def plain_search(bins, lengths, capacity):
    """The search without index or order: any exchange of up to two for up to two that raises the squared fill, until there is none."""
    bins = [list(b) for b in bins]
    fill = lambda b: sum(lengths[i] for i in b)
    some = lambda b: itertools.chain(*[itertools.combinations(b, k) for k in (0, 1, 2)])

    def step():
        for a, b in itertools.permutations(range(len(bins)), 2):
            for out, back in itertools.product(some(bins[a]), some(bins[b])):
                gain = fill(out) - fill(back)
                if gain > 0 and fill(bins[b]) + gain <= capacity and fill(bins[b]) + gain > fill(bins[a]):
                    bins[a] = [i for i in bins[a] if i not in out] + list(back)
                    bins[b] = [i for i in bins[b] if i not in back] + list(out)
                    return True
        return False

    while step():
        bins = [b for b in bins if b]
    return bins


@pytest.mark.parametrize("seed", range(12))
def test_local_search_against_plain_search(seed):
    r = random.Random(seed)
    lengths = [r.randint(5, 60) for _ in range(24)]
    start = packing.best_fit(lengths, 100)
    got = packing.local_search(start, lengths, 100)
    assert sorted(itertools.chain(*got)) == list(range(24)) and all(sum(lengths[i] for i in b) <= 100 for b in got)
    assert -(-sum(lengths) // 100) <= len(got) <= min(len(start), len(plain_search(start, lengths, 100)) + 1)


def test_local_search_empties_what_best_fit_leaves():
    """Lengths like those of documents: the search does the last part of the work, down to the bound or a bin above."""
    r = random.Random(5)
    lengths = [min(4096, int(r.lognormvariate(6.4, 0.9))) + 1 for _ in range(6000)]
    lengths = [min(n, 4096) for n in lengths]
    start = packing.best_fit(lengths, 4096)
    got = packing.local_search(start, lengths, 4096)
    assert len(start) > len(got) + 3 and len(got) <= -(-sum(lengths) // 4096) + 1


def test_local_search_empties_bins():
    lengths = [6, 6, 4, 4, 5, 5]
    bins = packing.local_search([[0, 4], [1, 5], [2], [3]], lengths, 16)
    assert len(bins) == 2 and sorted(itertools.chain(*bins)) == list(range(6))


def test_local_search_looks_at_all_underfull_bins():
    r = random.Random(7)
    lengths = [r.randint(700, 1500) for _ in range(3000)]
    start = packing.best_fit(lengths, 4096)
    bins = packing.local_search(start, lengths, 4096)
    assert len(start) > 1.06 * sum(lengths) / 4096 and len(bins) <= 1.015 * sum(lengths) / 4096 + 1
    assert sorted(itertools.chain(*bins)) == list(range(3000)) and all(sum(lengths[i] for i in x) <= 4096 for x in bins)
    lengths = [13] * 140 + [90, 90]  # bins of many pieces take part
    assert len(packing.local_search([list(range(70)), list(range(70, 140)), [140, 141]], lengths, 1000)) == 2


# ---- Jaccard


def plain_components(rows, n, t):
    sets = {}
    for i, text, *_ in rows:
        w = WORD.findall(low(text))
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        same = len(sets[a] & sets[b])
        if sets[a] and sets[b] and t[1] * same >= t[0] * (len(sets[a]) + len(sets[b]) - same):
            ra, rb = root(a), root(b)
            up[max(ra, rb)] = min(ra, rb)
    return {i: (len(sets[i]), root(i)) for i in sets}


@pytest.mark.parametrize(("n", "t"), [(3, (90, 100)), (5, (4, 5)), (2, (1, 2))])
def test_jaccard(docs, n, t):
    rows = jaccard.jaccard_components(docs, words=n, threshold=t).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == plain_components(corpus(), n, t)
    assert len(rows) == len(corpus())


@pytest.mark.parametrize("words", range(8))
def test_shingles_of_few_words(words):
    """Slices that hold fewer words than a shingle has."""
    text = " ".join("abcdefgh"[:words])
    sets = jaccard.shingle_sets(pa.array(["", text, None]), 5)
    assert [len(s) for s in sets] == [0, max(min(words, 1), words - 4), 0]
    if words:
        assert sets[1].tolist() == jaccard.shingle_sets(pa.array([text, "some other text of many words"]), 5)[0].tolist()


def test_jaccard_blocks_of_large_clusters(docs, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_SETS", 3)
    rows = jaccard.jaccard_components(docs, words=5, threshold=(4, 5)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == plain_components(corpus(), 5, (4, 5))


def test_signature_tree_prunes_nothing_linked():
    r = random.Random(3)
    base = [r.getrandbits(63) for _ in range(80)]
    sets = [np.unique(np.array(r.sample(base, 70) + [r.getrandbits(63) for _ in range(r.randint(0, 8))], np.uint64)) for _ in range(150)]
    sets.sort(key=len)
    forest = jaccard.links(sets, (7, 10))
    for a, b in itertools.combinations(range(len(sets)), 2):
        same = len(np.intersect1d(sets[a], sets[b]))
        if 10 * same >= 7 * (len(sets[a]) + len(sets[b]) - same):
            assert forest.root(a) == forest.root(b)


def test_jaccard_against_sql(spark, docs):
    import duckdb

    rows = [r for r in corpus() if r[1] is None or len(r[1]) < 5000][:-1]  # the SQL needs one row for each id
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": pa.array([r[1] for r in rows], pa.string())}))
    assert sorted(map(tuple, jaccard.document_links(spark.createDataFrame(rows, DOCS)).collect())) == sorted(con.execute(jaccard.SQL).fetchall())


def test_jaccard_empty_and_stage(docs, none, spark):
    assert jaccard.document_links(none).count() == 0
    kept = jaccard.stage(spark, docs, "")
    want = plain_components(corpus(), 5, (4, 5))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, (_, c) in want.items() if i == c) and kept.columns == docs.columns


def test_components_of_hot_nodes(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 5)
    monkeypatch.setattr(common, "HOT_KEYS", 20)
    r = random.Random(8)
    edges = [(0, x) for x in range(10, 200)] + [(x, 900) for x in range(300, 380)] + [(x, x + 1) for x in range(500, 520)] + [(r.randint(600, 800), r.randint(600, 800)) for _ in range(60)]
    forest = jaccard.Forest(1000)
    for a, b in edges:
        forest.join(a, b)
    want = {x: forest.root(x) for e in edges for x in e if e[0] != e[1]}
    got = components.components(spark.createDataFrame(edges + edges[:9], "a bigint, b bigint")).collect()
    assert len(got) == len(want) and {x["node"]: x["label"] for x in got} == want


def test_spread_join_is_the_join(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 10)
    rows = spark.createDataFrame([("hot" if i % 3 else f"k{i % 30}" if i % 5 else None, i) for i in range(300)], "k string, v int")
    one = rows.where("k is not null and k <> 'k3'").groupBy("k").agg(F.max("v").alias("w"), F.count("*").alias("many"))
    got = common.spread_join(rows, one, "k", 20)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, rows.join(one.drop("many"), "k").collect()))


def test_jaccard_of_hot_sets(spark, docs, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 1)
    rows = jaccard.jaccard_components(docs, words=5, threshold=(4, 5)).collect()
    assert len(rows) == len(corpus())
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == plain_components(corpus(), 5, (4, 5))


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100), (200, 150), (150, 170)] + [(7, 300 + i) for i in range(50)]
    got = {r["node"]: r["label"] for r in components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert {got[i] for i in [*range(41), *range(300, 350)]} == {0} and {got[i] for i in (150, 170, 200)} == {150} and 100 not in got
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# ---- vectors


def check_top_k(spark, rows, k=5):
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumn("v", F.lit(1)).withColumn("row", F.lit("x"))
    got = sorted(tuple(x) for x in vafile.top_k(df, F.col("vec_id") % 20 == 0, k=k).collect())
    sound = [(i, [math.floor(64 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for a, (q, x) in enumerate(sound):
        if q % 20 == 0:
            best = sorted((-sum(p * r for p, r in zip(x, v)), i) for b, (i, v) in enumerate(sound) if b != a)[:k]
            want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert got == sorted(want)
    return df


def vectors():
    r = random.Random(4)
    rows = [(i, [r.gauss(0, 0.3) for _ in range(8)]) for i in range(120)]
    return rows + [(120, rows[0][1]), (121, None), (122, [1.0, None]), (123, [float("nan")] * 8), (124, [float("inf")] * 8), (140, [0.5, 0.5]), (160, []), (None, [1.0] * 8), (1, rows[1][1])]


def test_top_k(spark):
    df = check_top_k(spark, vectors())
    assert vafile.top_k(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_top_k_takes_rows_not_ids(spark):
    """Several rows of one id: all are candidates, each query row has its own result."""
    rows = vectors() + [(7, [9.0] * 8), (7, [8.0] * 8), (20, [3.0] * 8), (20, [3.0] * 8), (40, [-3.0] * 8)]
    check_top_k(spark, rows)
    import duckdb

    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    embeddings = pa.table({"vec_id": pa.array([i for i, _ in rows], pa.int64()), "embedding": pa.array([v for _, v in rows], pa.list_(pa.float32()))})
    con = duckdb.connect()
    con.register("embeddings", embeddings.filter(pa.compute.greater(pa.compute.list_value_length(embeddings["embedding"]), 7)))
    got = vafile.embedding_neighbours(frame.where(F.size("embedding") > 7)).collect()
    assert sorted(map(tuple, got)) == sorted(con.execute(vafile.SQL).fetchall())


def test_top_k_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(vafile, "ROW_BLOCK", 16)
    monkeypatch.setattr(vafile, "QUERY_BLOCK", 2)
    check_top_k(spark, vectors())


# ---- language model


def plain_stream(text):
    return "".join(w + " " for w in WORD.findall(low(text))).encode() + b"\n"


def plain_tree_scores(texts, train, depth):
    """The model by its definition: a dictionary of nodes, recursion over the tree."""
    nodes, kids, weights = {}, {}, {}

    def decisions(text):
        s = bytes(depth - 1) + b"\n" + plain_stream(text)
        for i in range(depth, len(s)):
            for bit in range(8):
                yield s[i - depth : i][::-1], (bit, s[i] >> (8 - bit)), s[i] >> (7 - bit) & 1

    for text in itertools.compress(texts, train):
        for context, place, one in decisions(text):
            for d in range(depth + 1):
                nodes.setdefault((context[:d], place), [0, 0])[one] += 1
                if d:
                    kids.setdefault((context[: d - 1], place), set()).add((context[:d], place))

    def kt(k):
        a, b = nodes[k]
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def weighted(k):
        if k not in weights:
            weights[k] = kt(k) if len(k[0]) == depth else np.logaddexp(kt(k), sum(map(weighted, kids[k]))) - math.log(2)
        return weights[k]

    def prob(d, context, place, one):
        k = (context[:d], place)
        if k not in nodes:
            return 0.5
        own = (nodes[k][one] + 0.5) / (sum(nodes[k]) + 1)
        if (context[: d + 1], place) not in nodes or d == depth:
            return own
        share = 1 / (1 + math.exp(min(700, sum(map(weighted, kids[k])) - kt(k))))
        return share * own + (1 - share) * prob(d + 1, context, place, one)

    return [sum(math.log10(prob(0, *x)) for x in decisions(t)) for t in texts]


TEXTS = ["The cat sat on the mat", "the dog sat on the log", "a cat and a dog", "", None, "zebra wörd xx", "the the the cat", "a\x00b c", "mat the on sat cat the"]


@pytest.mark.parametrize("chunk", [300_000, 20])
def test_context_tree_against_its_definition(monkeypatch, chunk):
    monkeypatch.setattr(ctw, "PART_BYTES", chunk)
    train = [1, 1, 1, 1, 0, 0, 0, 1, 0]
    got = ctw.score_texts(TEXTS, train)
    assert got == pytest.approx(plain_tree_scores(TEXTS, train, ctw.DEPTH), abs=1e-8)
    assert got[0] > got[8] + 1  # the same words in another order
    assert ctw.score_texts(["x"], [False])[0] == pytest.approx(-24 * math.log10(2))  # x, blank, end: a bit for each decision
    assert [b - a for a, b in ctw.chunks(np.repeat(np.arange(5), [3, 1, 4, 1, 5]).astype(np.uint32))] == [14]


def test_chunks_keep_contexts_whole(monkeypatch):
    monkeypatch.setattr(ctw, "CHUNK", 4)
    near = np.repeat(np.arange(6), [3, 1, 9, 1, 2, 2]).astype(np.uint32)
    parts = ctw.chunks(near)
    assert [a for a, _ in parts[1:]] == [z for _, z in parts[:-1]] and parts[0][0] == 0 and parts[-1][1] == len(near)
    assert all(near[z - 1] != near[z] for _, z in parts[:-1])
    assert ctw.chunks(near[:0]) == []


def test_order_of_entries():
    r = np.random.default_rng(3)
    high, far, byte = r.integers(0, 5, 5000).astype(np.uint32), r.integers(0, 7, 5000).astype(np.uint32) << 29, r.integers(0, 256, 5000).astype(np.uint8)
    e = ctw.Entries(high, far, byte)
    want = sorted(set(zip(high.tolist(), far.tolist(), byte.tolist())))
    assert list(zip(e.near.tolist(), e.far.tolist(), e.byte.tolist())) == want
    assert e.sums(np.ones(5000, int)).sum() == 5000
    assert (e.back(e.byte) == byte).all() and (e.back(e.near) == high).all()
    many = r.integers(0, 1 << 63, 3000).astype(np.uint64) // np.uint64(1 << 50)
    distinct, back = ctw.grouped(many)
    assert (distinct == np.unique(many)).all() and (distinct[back] == many).all()


def check_scores(got, rows):
    train = [WORD.findall(low(t)) for i, t, *_ in rows if zlib.crc32(str(i).encode()) % 7 != 2 or i is None]
    count = {}
    for w in itertools.chain(*train):
        count[w] = count.get(w, 0) + 1
    n, v = sum(count.values()) + len(train), len(count) + 1
    texts = sorted({t or "" for _, t, *_ in rows})
    weight = [sum((t or "") == x and (i is None or zlib.crc32(str(i).encode()) % 7 != 2) for i, t, *_ in rows) for x in texts]
    # a text that trains k times stands k times, one that only is scored once
    each = ctw.score_texts([x for x, k in zip(texts, weight) for _ in range(max(k, 1))], [k > 0 for k in weight for _ in range(max(k, 1))])
    score = dict(zip([x for x, k in zip(texts, weight) for _ in range(max(k, 1))], each))
    of = {i: t for i, t, *_ in rows}
    assert len(got) == len(rows)
    for r in got:
        w = WORD.findall(low(of[r["doc_id"]]))
        held = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (len(w) + 1, sum(x in count for x in w) + 1, n, held)
        base = sum(math.log10((count.get(x, 0) + 1) / (n + v + 1)) for x in w) + math.log10((len(train) + 1) / (n + v + 1))
        assert r["base_score"] == pytest.approx(base, rel=1e-9) and r["score"] == pytest.approx(score[of[r["doc_id"]] or ""], rel=1e-4)
        size = len(plain_stream(of[r["doc_id"]]))
        assert r["n_bytes"] == size and r["bits_per_byte"] == pytest.approx(-r["score"] / math.log10(2) / size)


def test_document_scores(docs, none):
    check_scores(ctw.document_scores(docs).collect(), corpus())
    assert ctw.document_scores(none).count() == 0


def test_document_scores_of_many_ranges(spark, monkeypatch):
    """Several blocks, ranges, bundles and chunks; a very long word; a null id; columns of the result's names."""
    for name, value in (("RANGE_ENTRIES", 700), ("RANGE_WORDS", 40), ("CHUNK", 150)):
        monkeypatch.setattr(ctw, name, value)
    rows = [r for r in corpus(30) if r[1] is None or len(r[1]) < 5000] + [(None, "no id", None, None, None), (900, "x" * 30_000 + " end", "en", "s", 1)]
    df = spark.createDataFrame(rows, DOCS).withColumn("score", F.lit("y")).withColumn("key", F.lit(1)).repartition(5)
    check_scores(ctw.document_scores(df).collect(), rows)
    blank = spark.createDataFrame([(2, None), (3, " \t\n"), (4, "")], "doc_id bigint, text string")  # no word at all
    assert [(r["n_tokens"], r["n_bytes"]) for r in ctw.document_scores(blank).collect()] == [(1, 1)] * 3
    untrained = ctw.score_documents(df.limit(5), F.lit(True)).collect()
    assert all(r["bits_per_byte"] == pytest.approx(8, rel=1e-4) and r["train_tokens"] == 0 and r["base_score"] == 0 for r in untrained)


# ---- URLs, WARC, mixing


URLS = ["http://A.Example.com/en/7?x", "https://example.com/en/8", "http://foo.net/de/1", "http://example.net/de/80", "http://x.org/es", "ftp://x.org/es/", "no scheme", None, "", "http://notcom/en/", "http://h.io/ads/x", "http://h.io/docs/a/ads/b", "http://Casino.biz/x", "HTTP://h.io/LOGIN", "http://h.io/p?utm_source=a&utm_medium=b", "http://h.io/click?z&redirect=q"]


def test_urls(spark):
    got = {r["page_id"]: r for r in urlrules.page_verdicts(spark.createDataFrame(list(enumerate(URLS)), "page_id bigint, url string").withColumn("host", F.lit("clash"))).collect()}
    assert [got[i]["rule"] for i in range(10)] == ["example.com/en/7", "com/en/", "net/de/", "example.net/de/8", None, "org/es/", None, None, None, None]
    assert (got[0]["host"], got[0]["path"]) == ("a.example.com", "/en/7") and (got[7]["host"], got[7]["path"]) == ("", "")
    index = urlrules.PatternIndex()
    for u in filter(None, URLS):
        hits = [(len(p), p, v) for p, v in urlrules.PATTERNS if re.search(urlrules.to_regex(p), u.lower())]
        best = min(hits, key=lambda h: (-h[0], h[1]), default=(0, None, None))
        assert index.match(u)[:2] == best[1:]
    assert got[11]["verdict"] == "allow" and got[10]["verdict"] == got[12]["verdict"] == "block"


def test_warc(spark):
    html = "HTTP/1.1 404 Not Found\r\nContent-Type: text/x\r\n\r\n<title>A  b</title><script>no()</script><p>x &amp; y<br>z <a href='/q'>l</a>"
    rows = warc.derivatives(spark.createDataFrame([(1, "http://a/", html), (2, None, None), (3, "u", "")], "page_id bigint, url string, html string").withColumn("text", F.lit(0))).collect()
    by = {(r["page_id"], r["warc_type"]): r for r in rows}
    assert len(rows) == 6 and by[1, "conversion"]["block"] == "A b\nx & y\nz l"
    meta = by[1, "metadata"]
    assert "status: 404" in meta["block"] and "outlink: /q" in meta["block"] and meta["refers_to"] == by[1, "conversion"]["refers_to"] != meta["record_id"]
    assert f"Content-Length: {len(meta['block'].encode())}\r\n" in meta["header"]
    assert by[2, "conversion"]["content_length"] == 0


def test_warc_keeps_the_source(spark):
    http = "HTTP/1.1 200 OK: yes\r\nServer: x/1\r\nContent-Type: text/html\r\nLast-Modified: Mon, 01 Jan 2024 10:00:00 GMT\r\nSet-Cookie: a=1\r\nset-cookie:b=2\r\nX-Long: one\r\n two\r\nX-Empty:\r\n\r\n<p>Not: a header"
    cols = "page_id bigint, url string, html string, id string, at string, payload string, block string"
    df = spark.createDataFrame([(1, "u", http, "<urn:uuid:1>", "2020-02-02T02:02:02Z", "sha1:P", "sha1:B"), (1, "u", http, "<urn:uuid:2>", None, "sha1:P", None), (2, "u", http, None, None, None, None)], cols)
    rows = warc.derivatives(df, source_id="id", source_date="at", source_payload_digest="payload", source_block_digest="block").collect()
    by = {(r["refers_to"], r["warc_type"]): r for r in rows}
    full = by["<urn:uuid:1>", "metadata"]
    assert [x for x in full["block"].split("\r\n") if x.startswith(("http-", "source-", "content-"))] == ["content-type: text/html", "http-header-Server: x/1", "http-header-Content-Type: text/html", "http-header-Last-Modified: Mon, 01 Jan 2024 10:00:00 GMT", "http-header-Set-Cookie: a=1", "http-header-set-cookie: b=2", "http-header-X-Long: one two", "http-header-X-Empty: ", "source-block-digest: sha1:B"]
    for kind in ("metadata", "conversion"):
        head = by["<urn:uuid:1>", kind]["header"]
        assert all(x in head for x in ("WARC-Date: 2020-02-02T02:02:02Z\r\n", "WARC-Refers-To: <urn:uuid:1>\r\n", "WARC-Payload-Digest: sha1:P\r\n"))
        assert f"WARC-Date: {warc.DATE}\r\n" in by["<urn:uuid:2>", kind]["header"]
    assert len({r["record_id"] for r in rows}) == 6
    plain = {(r["warc_type"], r["record_id"], r["header"], r["block"]) for r in warc.derivatives(df.where("page_id = 2")).collect()}
    assert plain == {(r["warc_type"], r["record_id"], r["header"], r["block"]) for r in rows if r["page_id"] == 2}


@pytest.mark.parametrize("compression", ["none", "gzip"])
def test_warc_files(spark, tmp_path, compression):
    def record(kind, i, block, **more):
        head = {"WARC-Type": kind, "WARC-Record-ID": f"<urn:uuid:{i}>", "WARC-Date": "2020-02-02T02:02:02Z", "WARC-Target-URI": f"http://a/{i}", "Content-Length": str(len(block)), **more}
        return ("WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()) + "\r\n").encode() + block + b"\r\n\r\n"

    page = "HTTP/1.1 200 OK\r\nServer: x\r\n\r\n<p>wörd one\r\n\r\n<p>two".encode()
    parts = [record("warcinfo", 0, b"software: x\r\n"), record("response", 1, page, **{"WARC-Payload-Digest": "sha1:P"}), record("response", 2, b""), record("response", 3, "long é ".encode() * 40_000), record("response", 4, b"a\r\n\r\nWARC/1.9 b")]
    source = tmp_path / ("in.warc" if compression == "none" else "in.warc.gz")
    source.write_bytes(b"".join(parts) if compression == "none" else b"".join(map(gzip.compress, parts)))
    got = {r["record_id"]: r for r in warc.read_records(spark, str(source)).collect()}
    assert [got[f"<urn:uuid:{i}>"]["whole"] for i in range(5)] == [True] * 4 + [False] and got[None]["warc_type"] is None and not got[None]["whole"]
    assert got["<urn:uuid:1>"]["block"].encode() == page and got["<urn:uuid:2>"]["block"] == "" and got["<urn:uuid:3>"]["content_length"] == 320_000
    made = warc.of_records(warc.read_records(spark, str(source)))
    warc.write_records(made, str(tmp_path / "out"), compression)
    back = {(r["refers_to"], r["warc_type"]): r for r in warc.read_records(spark, str(tmp_path / "out")).collect()}
    rows = made.collect()
    assert len(rows) == len(back) == 6 and back["<urn:uuid:1>", "conversion"]["payload_digest"] == "sha1:P"
    for r in rows:
        b = back[r["refers_to"], r["warc_type"]]
        assert b["whole"] and [b[n] for n in ("record_id", "target_uri", "content_type", "content_length", "block_digest", "block")] == [r[n] for n in ("record_id", "target_uri", "content_type", "content_length", "block_digest", "block")]
        assert b["date"] == "2020-02-02T02:02:02Z"


def test_warc_repeats_long_and_empty(spark):
    df = spark.createDataFrame([(1, "u", "<p>a"), (1, "u", "<p>a"), (2, "u", "<p>wörd " * 50_000)], "page_id bigint, url string, html string")
    rows = warc.page_derivatives(df).collect()
    assert len(rows) == 6 and len({tuple(r) for r in rows}) == 4
    assert warc.page_derivatives(df.limit(0)).count() == 0


def test_urls_ties_repeats_long_and_empty(spark):
    df = spark.createDataFrame([(1, "http://x.com/en/" + "a/" * 50_000), (1, None), (1, None)], "page_id bigint, url string")
    rows = urlrules.page_verdicts(df).collect()
    assert sorted(str(r["rule"]) for r in rows) == ["None", "None", "com/en/"]
    assert urlrules.page_verdicts(df.limit(0)).count() == 0
    index = urlrules.PatternIndex((("/bb/x^", "allow"), ("/aa/x^", "block"), ("/zz/^", "block")))
    assert index.match("http://h/aa/x/bb/x/zz/")[:2] == ("/aa/x^", "block")


def mix_rows(n=400):
    r = random.Random(6)
    return [(i, "w " * r.choice([20, 300, 1500]), r.choice(["en", "de", None]), r.choice(["hot", "hot", "s1", "s2"]), 0) for i in range(n)] + [(None, None, None, None, None), (n, "", "en", "s1", 0), (n, "", "en", "s1", 0), (n + 1, "long " * 40_000, "de", "hot", 0)]


def plain_mix(rows, targets=None):
    """Weights and probabilities of each row by plain loops over dictionaries."""

    def cell(row):
        _, text, lang, source, _ = row
        words = len(WORD.findall(text or ""))
        return (source or "", lang or "", "empty" if not words else "brief" if words < 100 else "article" if words < 1000 else "long"), max(1, words)

    cells = {}
    for row in rows:
        c, n = cell(row)
        cells[c] = cells.get(c, 0) + n
    total, x = sum(cells.values()), {c: float(n) for c, n in cells.items()}
    marginal = lambda of, axis, v: sum(n for c, n in of.items() if c[axis] == v)
    goal = {}
    for axis, name in enumerate(mixing.AXES):
        stated = (targets or {}).get(name)
        share = {v: stated.get(v, 0) if stated else (marginal(cells, axis, v) / total) ** mixing.POWERS[name] for v in {c[axis] for c in cells}}
        goal[axis] = {v: g / sum(share.values()) * total for v, g in share.items()}
    for _ in range(300):
        for axis in range(3):
            have = {v: marginal(x, axis, v) for v in goal[axis]}
            x = {c: n * goal[axis][c[axis]] / have[c[axis]] if have[c[axis]] else 0.0 for c, n in x.items()}
    weight = {c: x[c] / cells[c] for c in cells}
    low, high = -800.0, 800.0
    for _ in range(300):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(1, math.exp(min(mid, 700)) * weight[c]) * cells[c] for c in cells) < mixing.BUDGET_SHARE * total else (low, mid)
    return [(cell(row)[1], weight[cell(row)[0]], min(1, math.exp(min(high, 700)) * weight[cell(row)[0]])) for row in rows]


@pytest.mark.parametrize("local_cells", [mixing.LOCAL_CELLS, 0])
@pytest.mark.parametrize("targets", [None, {"lang": {"en": 0.5, "de": 0.25, "": 0.25, "xx": 9.0}, "source": {"hot": 1, "s1": 2, "s2": 2, "": 0.001}}])
def test_mixing(spark, targets, local_cells):
    if targets and not local_cells:
        pytest.skip("the spread form with targets has a test of its own")
    given = [r for r in mix_rows() if local_cells or r[0] is not None]  # the null row contradicts the default shares: 200 rounds of jobs
    df = spark.createDataFrame(given, DOCS)
    draw = (F.xxhash64(F.lit(mixing.SEED), "doc_id", "text").cast("double") / 2.0**64 + 0.5).alias("draw")
    draws = {(r["doc_id"]): r["draw"] for r in df.select("doc_id", draw).collect()}
    rows = mixing.sampled(df, targets, local_cells=local_cells).select("doc.doc_id", "doc.n_chars", "tokens", "weight", "probability", "selected").collect()
    want = {row[0]: w for row, w in zip(given, plain_mix(given, targets))}
    assert len(rows) == len(given)
    for r in rows:
        assert (r["tokens"], r["weight"], r["probability"]) == pytest.approx(want[r["doc_id"]], rel=1e-5)
        assert r["selected"] == (draws[r["doc_id"]] < r["probability"])


def test_mixing_targets_of_a_small_table(spark):
    """Stated targets are met by the weights, on the driver and spread; a value with no share gets nothing."""
    df = spark.createDataFrame([(i, "w " * (5 + i % 7), "en" if i % 3 else "de", "a" if i % 2 else "b", 0) for i in range(60)], DOCS)
    for cells in (10, 0):
        rows = mixing.sampled(df, {"lang": {"en": 0.2, "de": 0.8}, "source": {"a": 1.0}, "topic": {"t1": 0.5, "t2": 0.5}}, budget=0.3, topic_of=F.when(F.col("doc_id") < 30, "t1").otherwise("t2"), local_cells=cells).collect()
        have = lambda axis, v: sum(r["weight"] * r["tokens"] for r in rows if r[axis] == v) / sum(r["tokens"] for r in rows)  # noqa: B023, E731
        assert (have("lang", "de"), have("source", "a"), have("source", "b"), have("topic", "t1")) == pytest.approx((0.8, 1, 0, 0.5))
        assert not any(r["selected"] for r in rows if r["source"] == "b")
    with pytest.raises(ValueError, match="targets of lang"):
        mixing.sampled(df, {"lang": {"xx": 1.0}})
    with pytest.warns(UserWarning, match="away from a target"):
        mixing.sampled(df.where("lang = 'en' and source = 'a' or lang = 'de' and source = 'b'"), {"lang": {"en": 0.2, "de": 0.8}, "source": {"a": 0.5, "b": 0.5}})


def test_mixing_query(none, spark):
    given = mix_rows()
    rows = mixing.document_mix(spark.createDataFrame(given, DOCS)).collect()
    total = sum(r["n_tokens"] for r in rows)
    assert sum(r["probability"] * r["n_tokens"] for r in rows) == pytest.approx(mixing.BUDGET_SHARE * total, rel=1e-6)
    assert mixing.document_mix(none).count() == 0


CLASHES = ("weight", "probability", "selected", "tokens", "words", "topic", "given", "doc", "Score", "margin", "rejected", "lang_pred", "key", "sid", "label", "n", "_tokens")


def test_stages_keep_columns_of_any_name(spark, docs):
    wide = docs.drop("key", "score").select("*", *[F.concat(F.lit(f"{c} of "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))).alias(c) for c in CLASHES])
    for stage in (langid.stage, jaccard.stage, mixing.stage):
        out = stage(spark, wide, "")
        assert out.columns == wide.columns
        kept = out.collect()
        assert kept and all(r[c] == f"{c} of {r['doc_id']}" for r in kept for c in CLASHES)
    assert packing.stage(spark, wide, "").count() >= wide.count()


def test_media_replaces_columns_of_its_names(spark):
    df = spark.createDataFrame([(1, "text " * 300, 5, "keep")], "doc_id bigint, text string, level int, other string").withColumn("pcm", F.lit(1)).withColumn("media", F.lit("m"))
    r = flac.decode(flac.encode(df.withColumn("p", flac.padded(F.col("text"))), "p")).first()
    assert r["other"] == "keep" and bytes(r["pcm"]).startswith(b"text text") and r["level"] != 5 and bytes(r["media"])[:4] == b"fLaC"


def test_pipeline(spark, tmp_path, docs):
    import corpus_pipeline

    path = str(tmp_path / "sf")
    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(path + "/documents.parquet")
    rows = corpus_pipeline.run(spark, path).collect()
    assert rows and check_packing(rows, packing.CAPACITY) >= 1
    left = spark.read.parquet(path + "/documents.parquet")
    models = langid.compressors(langid.train(left.where("pmod(crc32(cast(doc_id as string)), 4) <> 2")))
    kept = [r for r in left.collect() if not langid.judge(r["text"], models)[3]]
    first = {i for i, (_, c) in plain_components([(r["doc_id"], r["text"]) for r in kept], 5, (4, 5)).items() if i == c}
    once = {r["doc_id"]: r for r in kept if r["doc_id"] in first}
    frame = spark.createDataFrame([tuple(r) for r in once.values()], DOCS)
    sampled = {r["doc_id"] for r in mixing.document_mix(frame).where("selected").collect()}
    assert {r["doc_id"] for r in rows} == sampled
