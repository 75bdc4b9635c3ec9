"""The corpus operators against plain versions, round trips and edge cases."""

import base64
import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skarn.llm import _text as T
from skarn.llm import decontaminate, lm_score, near_dup, pii, piece_codec, quality_classifier, quality_rules, token_store, toxicity, warc
from skarn.llm.queries import tokenizer_file

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"w{i}" for i in range(30_000))
ODD = [(1, None), (2, ""), (3, "  \n\t "), (4, "one"), (5, "a b c d e f g h i j k l"), (5, "a b c d e f g h i j k l"), (6, LONG), (None, "x y z"), (8, "é 中文 🎉 ÀB"), (9, "A B C d e f g h i j k l")]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, "doc_id bigint, text string").withColumn("n_words", F.lit(7)).withColumn("score", F.lit("clash")).withColumn("key", F.lit(0)).withColumn("lang", F.lit(None).cast("string"))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def low(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


SPACED = r"[^\x20\x09-\x0D]+"


def test_words_and_hashes():
    texts = [t for _, t in ODD]
    for table, pattern, f in ((T.SPACED, SPACED, lambda t: t or ""), (T.ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)):
        for limit in (10, 1 << 20):
            got = []
            for c in T.chunks(pa.array(texts), limit):
                c = c.lowered() if f is low else c
                w = T.words(c, table)
                got += [[c.text(a, b).decode() for a, b in zip(w.starts[i:j], w.ends[i:j], strict=True)] for i, j in zip(w.first[:-1], w.first[1:], strict=True)]
            assert got == [re.findall(pattern, f(t)) for t in texts]
    data = np.frombuffer(b"abcabcab", np.uint8)
    h = T.span_hashes(data, np.array([0, 3, 0, 6]), np.array([3, 6, 2, 8]))
    assert h[0] == h[1] and h[2] == h[3] and h[0] != h[2]


@pytest.mark.parametrize("size", [1 << k for k in range(1, 14)])
def test_hashes_of_thue_morse_words(size):
    """Words on which any polynomial modulo a power of two collides, and runs of one letter."""
    bits = np.array([bin(k).count("1") & 1 for k in range(size)], np.uint8)
    rows = [97 + bits, 98 - bits, np.full(size, 97, np.uint8), np.full(size, 98, np.uint8)]
    data = np.concatenate(rows)
    starts = np.arange(4) * size
    assert len(set(T.span_hashes(data, starts, starts + size).tolist())) == 4
    long = np.concatenate([np.full(T._SMALL_RUN, 32, np.uint8), rows[0]]) if size == 1024 else data
    assert T.span_hashes(long, np.array([len(long) - size]), np.array([len(long)]))[0] == T.span_hashes(long[len(long) - size :], np.array([0]), np.array([size]))[0]


def test_warc(spark, tmp_path):
    pages = [(1, "http://www.a.org/x?q=1#f", "hi"), (2, "https://a.org/x", "hi"), (3, None, None), (4, "http://b.org", ""), (5, "ftp://u@C.com:80/p", "é\r\n\r\nx"), (5, "ftp://u@C.com:80/p", "é\r\n\r\nx"), (None, "u", "v"), (None, "u", "v"), (None, None, "hi")]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string").withColumn("key", F.lit(1)).withColumn("digest", F.lit(1))
    manifest = warc.write_archive(df, block_lines=2)
    got = warc.read_archive(manifest).collect()
    want = collections.Counter()
    first = {}
    for i, _, h in pages:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    for i, _, h in pages:
        raw = (h or "").encode()
        to = first.get(h or "")
        want[i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), to if to != i else None] += 1
    assert collections.Counter((r.page_id, r.payload_bytes, r.payload_digest, r.refers_to) for r in got) == want
    assert {r.page_id: bytes(r.payload or b"") for r in got}[1] == b"hi"
    asked = spark.createDataFrame([("https://a.org/x",), ("http://no.where/",), ("http://c.com/p",)], "url string")
    assert sorted((r.query, r.page_id) for r in warc.lookup(manifest, asked).collect()) == [("http://c.com/p", 5), ("http://c.com/p", 5), ("https://a.org/x", 2)]
    assert warc.read_archive(warc.write_archive(df.limit(0))).count() == 0
    small = warc.read_archive(warc.write_archive(df, min_bytes=3)).where("page_id = 2").first()
    assert small.record_type == "response"


def test_warc_repeated_ids(spark):
    """Only the row whose payload stands earlier is a revisit, not all rows of its page id."""
    pages = [(1, "http://a.org/", "one"), (2, "http://a.org/", "one"), (2, "http://a.org/", "two"), (2, "http://b.org/", "three"), (2, "http://a.org/", "zero")]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string").coalesce(1)
    got = warc.read_archive(warc.write_archive(df)).collect()
    assert sorted((r.page_id, bytes(r.payload or b""), r.refers_to or 0) for r in got) == [(1, b"one", 0), (2, b"", 1), (2, b"three", 0), (2, b"two", 0), (2, b"zero", 0)]


def test_warc_keys(spark):
    urls = {"http://www.Example.com:80/a?b#c": "com,example)/a?b", "x.org": "org,x)/", "": ")/"}
    df = spark.createDataFrame([(u,) for u in urls], "u string").select("u", warc.surt(F.col("u")).alias("k"))
    assert {r.u: r.k for r in df.collect()} == urls


@pytest.mark.parametrize(("n", "block"), [(0, 4), (1, 4), (7, 4), (8, 4), (5000, 64)])
def test_rans_round_trip(n, block):
    ids = (np.random.default_rng(n).zipf(1.3, n) % 49_408).astype(np.uint32)
    raw = token_store.encode(ids, np.array([n]), block)
    s = token_store.Segment(raw)
    assert (s.ids() == ids).all() and s.end == len(raw)
    if n > 4 * block:
        assert (s.ids(1, 3) == ids[block : 3 * block]).all()
        broken = bytearray(raw)
        broken[-1] ^= 255
        with pytest.raises(ValueError):
            token_store.Segment(bytes(broken)).ids()


def test_token_store(spark, odd):
    from tokenizers import Tokenizer

    path = tokenizer_file("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    got = token_store.read_tokens(token_store.write_tokens(odd, path, 1, segment_ids=20, block=8), ids=True).collect()
    assert sorted((r.start for r in got)) == [r.start for r in sorted(got, key=lambda r: r.start)]
    start, want = 0, []
    for i, text in sorted(ODD, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == [(b, a, c, d) for a, b, c, d in want]
    assert token_store.Encoder(path).by_words
    long = spark.createDataFrame([(k, f"{k} " + LONG) for k in range(40)], "doc_id bigint, text string")
    listed = token_store.write_tokens(long, path, 1, segment_ids=20)
    assert listed.count() > listed.select("file").distinct().count()  # several segments of one file, each read alone
    got, start = token_store.read_tokens(listed).orderBy("start").collect(), 0
    for k, r in enumerate(got):
        assert (r.doc_id, r.start) == (k, start) and r.n_tokens > 30_000
        start += r.n_tokens
    words = ["it's I'M", "x<|endoftext|>y", "é ́a b 　c\x85d \x1c e", "İ ß ² a_b", "中文ab abc,,, É!!"]
    e = token_store.Encoder(path)
    out = [x for _, ids, counts in e.encode_texts(pa.array(words), 1) for x in np.split(ids, np.cumsum(counts)[:-1])]
    assert [x[:-1].tolist() for x in out] == [t.encode(w, add_special_tokens=False).ids for w in words]


def test_tokenizer_that_joins_over_white_space(spark, odd):
    """Ids of a byte-level tokenizer, whose words take in the space before them, are the library's too."""
    from tokenizers import Tokenizer

    path = tokenizer_file("byte_bpe_50k.json")
    assert not token_store.Encoder(path).by_words
    t = Tokenizer.from_file(path)
    got = token_store.read_tokens(token_store.write_tokens(odd, path, 1), ids=True).collect()
    want = collections.Counter((i, *t.encode(x or "", add_special_tokens=False).ids, 1) for i, x in ODD)
    assert collections.Counter((r.doc_id, *r.ids) for r in got) == want
    e = token_store.Encoder(tokenizer_file("word_bpe_49k.json"))
    e.words = lambda words: [np.zeros(1, np.uint32) for _ in words]  # a wrong word is noticed on the next chunk
    ids, _ = e.encode(next(T.chunks(pa.array(["one two"]))))
    assert not e.by_words and len(ids) == 2 and ids.all()


def test_pieces(spark, odd):
    import sentencepiece

    path = tokenizer_file("piece_bpe_32k.model")
    m = sentencepiece.SentencePieceProcessor(model_file=path)
    codec = piece_codec.Pieces(path)
    r = random.Random(1)
    texts = ["a  b", "  x", "", "   ", "é ́ ü 中 🎉", "<0x00> <s>", "a" * 50, "\x00y", *["".join(r.choice("abcdeéthing  \n-=.🎉12") for _ in range(r.randint(1, 60))) for _ in range(400)]]
    (c,) = T.chunks(pa.array(texts))
    ids, counts = codec.encode(c)
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == m.encode(texts)
    assert [x.decode() for x in codec.decode(ids, counts)] == texts
    coded = piece_codec.encode(odd, path)
    assert all(r.round_trip for r in coded.collect())
    back = collections.Counter((r.doc_id, r.text) for r in piece_codec.decode(coded, path).collect())
    assert back == collections.Counter((i, t or "") for i, t in ODD)


def test_pieces_by_viterbi():
    """The unigram walk finds a segmentation of the best sum of scores, as trying all of them does."""
    codec = piece_codec.Pieces(tokenizer_file("piece_bpe_32k.model"), unigram=True)
    r = random.Random(8)
    words = ["▁" * r.randint(0, 2) + "".join(r.choice("therinaes🎉é") for _ in range(r.randint(1, 9))) for _ in range(300)]

    def best(w):
        if not w:
            return 0.0
        return max(codec.score.get(w[:k], -1e9) + best(w[k:]) for k in range(1, len(w) + 1) if k == 1 or w[:k] in codec.score)

    for w, ids in zip(words, codec._words(words), strict=True):
        pieces, at = [], 0
        for i in ids.tolist():  # bytes' pieces stand for a character outside the vocabulary
            pieces.append(codec.names[i])
        total, at = 0.0, 0
        k = 0
        while k < len(pieces):
            if pieces[k] in codec.score:
                total, at, k = total + codec.score[pieces[k]], at + len(pieces[k]), k + 1
            else:
                total, k, at = total - 1e9, k + len(w[at].encode()), at + 1
        assert at == len(w) and abs(total - best(w)) < 1e-6 * max(1, abs(total)), (w, pieces)


def components_by_force(rows, size, percent):
    sets = {}
    for i, t in rows:
        w = re.findall(SPACED, low(t))
        sets[i, t] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()
    keys = list(sets)
    parent = {k: k for k in keys}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(keys)):
        for b in range(a):
            x, y = sets[keys[a]], sets[keys[b]]
            both = len(x & y)
            if both and 100 * both >= percent * (len(x) + len(y) - both):
                parent[find(keys[a])] = find(keys[b])
    return {k: min((j[0] for j in keys if find(j) == find(k) and j[0] is not None), default=None) for k in keys}, {k: len(v) for k, v in sets.items()}


def test_near_duplicates(spark, odd):
    r = random.Random(2)
    base = [f"t{r.randint(0, 10_000)}" for _ in range(120)]
    rows = list(ODD)
    for k in range(60):
        w = list(base)
        for _ in range(r.randint(0, 9)):
            w[r.randrange(len(w))] = f"z{r.randint(0, 10**6)}"
        rows.append((100 + k, " ".join(w)))
    for percent, size in ((85, 3), (80, 5)):
        df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("node", F.lit(1)).withColumn("s1", F.lit(1))
        got = near_dup.near_duplicates(df, size, percent).collect()
        comps, sizes = components_by_force(rows, size, percent)
        assert collections.Counter((x.doc_id, x.n_shingles, x.component_id) for x in got) == collections.Counter((i, sizes[i, t], comps[i, t]) for i, t in rows)
    kept = near_dup.keep_first(df)
    assert kept.columns == df.columns
    assert kept.where("doc_id = 5").count() == 1
    loose = spark.createDataFrame([(None, "a b c d e f"), (None, "a b c d e f"), (None, "g h i j k l"), (1, "m n o p q r")], "doc_id bigint, text string")
    assert sorted(x.text for x in near_dup.keep_first(loose).collect()) == ["a b c d e f", "g h i j k l", "m n o p q r"]
    assert near_dup.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("percent", [80, 85])
def test_signatures_pass_at_the_threshold(percent):
    """Of pairs just at the threshold, signatures let all pass and bands find all; of unlike ones they stop nearly all."""
    g = np.random.default_rng(percent)
    bands, rows = near_dup.plan(percent / 100)
    least, (a, b) = near_dup.least_agreement(percent / 100, bands * rows), near_dup._hashes(bands * rows, 7)
    passed, banded, stopped = 0, 0, 0
    for k in range(2000):
        union = int(g.integers(20, 400))
        both = -(-percent * union // 100) if k % 2 else union // 2
        values = g.integers(0, 1 << 63, union, dtype=np.uint64) * np.uint64(2)
        cut = both + (union - both) // 2
        x, y = (np.frombuffer(near_dup.signature(s, a, b), np.uint8) for s in (values[:cut], np.concatenate((values[:both], values[cut:]))))
        same = x == y
        passed += bool(k % 2 and same.sum() >= least)
        banded += bool(k % 2 and same.reshape(bands, rows).all(1).any())
        stopped += bool(k % 2 == 0 and same.sum() < least)
    assert passed >= 999 and banded >= 999 and stopped >= 990


def test_kept_texts_of_one_id(spark):
    """Different texts under one id all stay; a near copy under a kept id goes."""
    text = lambda c: " ".join(f"{c}{k}" for k in range(40))
    rows = [(7, text("a")), (7, text("b")), (7, text("b")), (7, text("c") + " end"), (3, text("c")), (7, text("a") + " more"), (None, text("c")), (None, text("d")), (7, ""), (7, "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("_copy", F.lit("mine")).withColumn("_kept_id", F.lit(3))
    assert {x._copy for x in near_dup.keep_first(df).collect()} == {"mine"} and near_dup.keep_first(df.limit(0)).count() == 0
    got = sorted((x.doc_id or 0, x.text[:2]) for x in near_dup.keep_first(df).collect())
    assert got == [(0, "d0"), (3, "c0"), (7, ""), (7, "a0"), (7, "b0")]


def test_components(spark):
    r = random.Random(5)
    pairs = [(r.randint(0, 300), r.randint(0, 300)) for _ in range(200)] + [(0, k) for k in range(400, 460)]
    parent = list(range(500))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    got = {x.node: x.comp for x in near_dup.components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    assert got == {k: find(k) for a, b in pairs if a != b for k in (a, b)} | {k: v for k, v in got.items() if v == find(k)}


def test_decontamination(spark, odd):
    r = random.Random(4)
    word = lambda: r.choice("abcdefgh") + r.choice("xyz")
    items = [(k, " ".join(word() for _ in range(r.randint(1, 30)))) for k in range(25)] + [(90, None), (91, ""), (92, "!!")]
    rows = list(ODD)
    for k in range(60):
        w = [word() for _ in range(r.randint(0, 60))]
        src = r.choice(items)[1]
        w[r.randint(0, len(w)) : 0] = (src or "").upper().split()[: r.randint(0, 30)]
        rows.append((200 + k, ", ".join(w)))
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
    d, b = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("n_hit", F.lit(1)), spark.createDataFrame(items, "item_id bigint, text string")
    want = collections.Counter()
    for i, t in rows:
        w, hit, ids = find(t), set(), set()
        for item, text in items:
            x = find(text)
            n = min(10, len(x))
            windows = {tuple(x[k : k + n]) for k in range(len(x) - n + 1)} if n else set()
            for k in range(len(w) - n + 1):
                if n and tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    ids.add(str(item))
        want[i, len(w), len(hit), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)] += 1
    for limit in ("10485760", "-1"):  # the benchmark's side sent to all, and shuffled
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        got = decontaminate.scan(d, b).collect()
        assert collections.Counter((x.doc_id, x.n_words, x.n_hit, x.items_sha256, x.contaminated) for x in got) == want
        kept = decontaminate.drop_contaminated(d.withColumn("_copy", F.lit("mine")), b)
        assert collections.Counter(x.doc_id for x in kept.collect()) == collections.Counter({i: n for (i, *_, bad), n in want.items() if not bad})
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10485760")
    assert decontaminate.scan(d, b.limit(0)).where("contaminated").count() == 0
    assert decontaminate.scan(d.limit(0), b).count() == 0 and decontaminate.drop_contaminated(d.limit(0), b).columns == d.columns


def test_decontamination_of_like_items(spark):
    """A second item of the same alignment is found, whatever hits stand there already."""
    r = random.Random(5)
    texts, items = [], []
    for n in range(20):
        opening, ending = ([f"w{r.randint(0, 10**6)}" for _ in range(k)] for k in (9, 23))
        items += [(f"{n}-{k}", " ".join([*opening, f"own{k}", *ending, *more])) for k, more in enumerate(([], ["tail", "words"]))]
        texts.append((n, " ".join([*opening, "third", *ending, "tail", "words"])))
    got = decontaminate.scan(spark.createDataFrame(texts, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id string, text string")).collect()
    assert {(x.doc_id, x.n_hit, *x.items) for x in got} == {(n, 25, f"{n}-0", f"{n}-1") for n in range(20)}


def test_decontamination_by_a_full_filter(spark, monkeypatch):
    """A Bloom filter with far too few bits lets more through and changes nothing."""
    monkeypatch.setattr(decontaminate, "FILTER_BITS", (5, 5))
    d, b = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    few = decontaminate.scan(d, b).select("doc_id", "n_hit", "items_sha256").collect()
    monkeypatch.setattr(decontaminate, "FILTER_BITS", (16, 27))
    assert collections.Counter(few) == collections.Counter(decontaminate.scan(d, b).select("doc_id", "n_hit", "items_sha256").collect())


def test_quality_rules(spark, odd):
    rows = [*ODD, (20, "a b c d e " * 9), (21, "x #$\n\nx #$\nx #$ y\n"), (22, "\nq\n q\nq")]
    got = quality_rules.measure(spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("kept", F.lit(1))).collect()
    want = collections.Counter()
    for i, t in rows:
        t = t or ""
        w = re.findall(SPACED, t)
        lines = [x for x in t.split("\n") if re.search(SPACED, x)]
        windows = collections.defaultdict(list)
        for k in range(len(w) - 4):
            windows[tuple(w[k : k + 5])].append(k)
        cover = {p for ks in windows.values() if len(ks) > 1 for k in ks for p in range(k, k + 5)}
        want[i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover), len(w) < 10 or 100 * len(cover) > 20 * len(w)] += 1
    assert collections.Counter((x.doc_id, x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words, x.base_failed) for x in got) == want
    assert not any(x.kept and x.base_failed for x in got)
    assert quality_rules.keep_good(odd).columns == odd.columns


def luhn(d):
    return sum(int(c) if k % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for k, c in enumerate(reversed(d))) % 10 == 0


PII = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))


def spans(t):
    out = []
    for k, (n, p) in enumerate(PII):
        for m in re.finditer(p, t or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": n == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[n]:
                out.append((m.start(), k, m.end(), n))
    return sorted(out)


def test_pii(spark, odd):
    r = random.Random(3)
    texts = ["a@b.c@d.e x", "a@b.c_x@d.e 1.2.3.4.5.6.7.8", "😀 é a@b.cd 4111 1111 1111 1111 +1 (456) 555-2186", "0001.02.255.3 256.1.1.1", "x@" + "a." * 3000 + "b", "9" * 2000, "a@b.c d@e.f " * 400]
    texts += ["".join(r.choice(["@", ".", "+", "-", " ", "(", ")", "1", "23", "4111111111111111", "a", "b.c", "é", "😀", "%", "_", "255", "0"]) for _ in range(r.randint(1, 50))) for _ in range(150)]
    rows = [*ODD, *((1000 + k, t) for k, t in enumerate(texts))]
    got = pii.detect(spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("spans", F.lit(1)).withColumn("copy", F.lit(1))).collect()
    want = collections.Counter((i, hashlib.sha256(",".join(f"{n}:{a}:{b}" for a, _, b, n in spans(t)).encode()).hexdigest(), *[sum(s[1] == k for s in spans(t)) for k in range(4)]) for i, t in rows)
    assert collections.Counter((x.doc_id, x.base_sha256, x.n_email, x.n_ip, x.n_card, x.n_phone) for x in got) == want
    assert pii.detect(odd.limit(0)).count() == 0


def test_pii_terms(spark):
    """A term that stands by one entity in several texts gives it away; a common one does not."""
    rows = [(k, f"text {k} number {k * 7} about Zorblax mail zor@blax.org and the usual thing {k}") for k in range(4)] + [(10 + k, f"the usual thing and {k} more about number text mail {k * 3}") for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r for r in pii.detect(df).collect()}
    at = rows[0][1].index("Zorblax")
    assert f"term:{at}:{at + 7}" in got[0].spans and got[0].n_term >= 1 and got[12].n_term == 0
    assert all("term" not in s or rows[0][1][int(s.split(":")[1]) : int(s.split(":")[2])] not in ("and", "the", "about") for s in got[0].spans.split(","))
    clean = {r.doc_id: r.text for r in pii.sanitise(df.withColumn("extra", F.lit(1))).collect()}
    assert "<EMAIL>" in clean[0] and "Zorblax" not in clean[0] and clean[12] == dict(rows)[12]
    text = "a@b.c, 1.2.3.4 é 4111111111111111"
    one = pii.sanitise(spark.createDataFrame([(1, text), (2, None)], "doc_id bigint, text string")).orderBy("doc_id").collect()
    assert one[0].text == "<EMAIL>, <IP> é <CARD>" and one[1].text is None


def test_pii_terms_anywhere(spark):
    """Pairs are counted over whole texts, and all occurrences of a disclosing term go."""
    fill = "the usual thing and number " * 6
    rows = [(k, f"Zorblax {k} {fill} mail zor@blax.org {fill} zorblax {fill} Zorblax") for k in range(4)] + [(10, f"{fill} about Zorblax")] + [(20 + k, f"{fill} {k}") for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r for r in pii.detect(df).collect()}
    for i, t in rows[:5]:
        want = {f"term:{m.start()}:{m.end()}" for m in re.finditer("[Zz]orblax", t)}
        assert want <= set(got[i].spans.split(",")), i
    clean = {r.doc_id: r.text for r in pii.sanitise(df).collect()}
    assert not any("zorblax" in clean[i].lower() for i in range(4)) and clean[10] in (f"{fill} about <TERM>", f"{fill} about <WORD>") and clean[30] == dict(rows)[30]


def terms_by_force(rows, min_support=3, generalise=0.7, elsewhere=0.5):
    """Per row the spans of disclosing terms: every pair of term and entity counted plainly."""
    word = re.compile(r"\w+")
    n = len(rows)
    of = lambda t, s: (s[3], re.sub("[^0-9]", "", t[s[0] : s[2]]) if s[1] > 1 else t[s[0] : s[2]].lower())
    raw = [{w.lower() for w in word.findall(t or "")} for _, t in rows]
    held = [{of(t, s) for s in spans(t)} for _, t in rows]

    def free(t):
        taken = {k for s in spans(t) for k in range(s[0], s[2])}
        return [(m.start(), m.end(), m[0].lower()) for m in word.finditer(t or "") if not taken & set(range(m.start(), m.end()))]

    loose = [free(t) for _, t in rows]
    df_t, df_e, both, texts = collections.Counter(), collections.Counter(), collections.Counter(), collections.defaultdict(set)
    for (_, t), words, entities, have in zip(rows, raw, held, loose, strict=True):
        df_t.update(words)
        df_e.update(entities)
        for e in entities:
            texts[e].add(t)
            for w in {x[2] for x in have}:
                both[e, w] += 1
                texts[e, w].add(t)
    told, points = {}, collections.Counter()
    for (e, w), k in both.items():
        ic = math.log2(n / df_e[e])
        share = math.log2(n * k / (df_t[w] * df_e[e])) / ic if ic > 0 else 0
        if len(texts[e, w]) >= min_support and share >= generalise:
            told[e, w] = share
            if k >= elsewhere * df_t[w]:
                points[w] = max(points[w], share)
    most = lambda w, entities: max([points[w], *(told.get((e, w), 0) for e in entities)])
    return [sorted((a, b, most(w, entities)) for a, b, w in have if most(w, entities)) for have, entities in zip(loose, held, strict=True)]


def test_pii_terms_by_force(spark):
    r = random.Random(9)
    words = [f"w{k}" for k in range(60)]
    mails = [f"m{k}@x.org" for k in range(4)]
    rows = []
    for k in range(120):
        w = [r.choice(words) for _ in range(r.randint(0, 25))]
        if k % 3 == 0:
            e = r.randrange(4)
            w = [f"Name{e}", *w, mails[e].upper() if k % 2 else mails[e], *["Own" + str(e)] * (k % 2), "4111 1111 1111 1111" if e == 1 else "", "🎉name2" if e == 2 else "é"]
        elif k % 7 == 0:
            w = [*w, f"name{r.randrange(4)}", "own1"]
        rows.append((k, " ".join(w)))
    rows += [(500, None), (501, ""), *rows[:9], (502, rows[3][1])]
    for times in (1, 4):  # repeating all rows changes nothing
        got = pii.detect(spark.createDataFrame(rows * times, "doc_id bigint, text string")).collect()
        want = collections.Counter((i, tuple(y[:2] for y in x)) for (i, _), x in zip(rows, terms_by_force(rows), strict=True))
        assert any(x for _, x in want)
        found = collections.Counter((g.doc_id, tuple(tuple(map(int, x.split(":")[1:])) for x in g.spans.split(",") if x.startswith("term:"))) for g in got)
        assert found == collections.Counter({k: v * times for k, v in want.items()})
        assert all(g.n_spans == (g.spans.count(",") + 1 if g.spans else 0) for g in got)


def test_pii_clashing_names(spark):
    text = "x a@b.cd y 1.2.3.4 " * 700
    df = spark.createDataFrame([(1, text, "k", "e"), (2, None, None, None)], "doc_id bigint, text string, _copy string, _edits string")
    got = {r.doc_id: r for r in pii.sanitise(df).collect()}
    assert got[1].text == "x <EMAIL> y <IP> " * 700 and (got[1]._copy, got[1]._edits) == ("k", "e") and got[2].text is None
    assert pii.sanitise(df.limit(0)).count() == 0


def test_language_model(spark, docs, odd):
    for df, rows in ((docs, [(r.doc_id, r.text) for r in docs.collect()]), (odd, ODD)):
        got = lm_score.score_corpus(df).collect()
        counts, held = collections.Counter(), lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
        for i, t in rows:
            if not held(i):
                counts.update([*re.findall(SPACED, low(t)), None])
        n, norm = sum(counts.values()), sum(counts.values()) + 0.5 * (len(counts) + 1)
        want = sorted((i is not None, i or 0, held(i), len(w), sum(counts[x] > 0 for x in w), n, round(sum(math.log10((counts[x] + 0.5) / norm) for x in w), 6)) for i, t in rows for w in [[*re.findall(SPACED, low(t)), None]])
        assert sorted((r.doc_id is not None, r.doc_id or 0, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
        assert all(r.score < 0 for r in got)
    assert lm_score.score_corpus(odd.limit(0)).count() == 0


def test_language_model_adds_up(spark):
    """After any two words the probabilities of all words, the end and one unseen word are one in sum."""
    g = np.random.default_rng(1)
    names = [f"w{k}" for k in range(300)]
    text = " ".join(names[k] for k in np.minimum(g.zipf(1.3, 4000), 300) - 1)
    rows = spark.createDataFrame([(k, text[k * 500 :]) for k in range(4)], "doc_id bigint, text string")
    model, counts = lm_score.fit(rows, min_count=5)
    counts = {np.uint64(r.h & (2**64 - 1)): r.c for r in counts.collect()}
    assert model.v == sum(c >= 5 for c in counts.values()) and model.rare >= 3
    ids = np.arange(model.v)
    for far, last in ((0, 1), (model.end, model.end), (3, model.v + 17)):
        seq = np.concatenate([[far, last, k] for k in [*ids, model.v, model.end]]).astype(np.int32)
        p = 10.0 ** lm_score.log_probabilities(model, seq, np.array([0]))[2::3] if far != model.end else 10.0 ** lm_score.log_probabilities(model, seq[2::3], np.arange(len(ids) + 2))
        assert abs(p.sum() - 1) < 1e-4
    few = [c for c in counts.values() if c < 5]
    assert sum(few) == model.rare_total and abs((sum(few) + 0.5 * (len(few) + 1)) - model.rare_norm()) < 1e-9


def test_language_model_learns_order(spark):
    """Held-out texts whose words follow a planted order are likelier than by their frequencies alone; runs agree."""
    g = np.random.default_rng(2)
    follow = g.permutation(400)
    texts = []
    for k in range(1000):
        w = [int(g.integers(400))]
        for _ in range(300):
            w.append(int(follow[w[-1]]) if g.random() < 0.8 else int(g.integers(400)))
        texts.append((k, " ".join(f"v{x}" for x in w)))
    df = spark.createDataFrame(texts, "doc_id bigint, text string").repartition(1)
    first = {r.doc_id: r for r in lm_score.score_corpus(df).collect()}
    held = [r for r in first.values() if r.held_out]
    gain = sum(r.score - r.base_score for r in held) / sum(r.n_tokens for r in held)
    assert gain > 0.5, gain
    again = {r.doc_id: r.score for r in lm_score.score_corpus(df).collect()}
    assert all(abs(again[k] - r.score) < 1e-9 for k, r in first.items())


@pytest.mark.parametrize("most", [100, 1000, 6000])
def test_frequent_words_of_a_flat_corpus(spark, most):
    """Words of one count only: about as many as asked for have embeddings, never more, none by chance."""
    g = np.random.default_rng(3)
    rows = [(int(h), 7) for h in g.integers(-(1 << 63), 1 << 63, 5000, dtype=np.int64)] + [(1, 90), (5, 80)]
    counts = spark.createDataFrame(rows, "h bigint, c bigint")
    h, c = lm_score._frequent(counts, most)
    assert len(h) == len(set(h.tolist())) and min(most, 5002) * 0.9 <= len(h) <= most and {90, 80} <= set(c.tolist())
    model = lm_score.Model(h, c, 3, 5000 * 7 + 170, 5002, 5, 1)
    place, known = model.place(np.concatenate((h, h + np.uint64(1))))
    assert known[: len(h)].all() and (model.hashes[place[: len(h)]] == h).all() and not known[len(h) :].any() and model.v == len(h)


def auc(s, y):
    a, b = [x for x, k in zip(s, y, strict=True) if k], [x for x, k in zip(s, y, strict=True) if not k]
    return sum((x > z) + (x == z) / 2 for x in a for z in b) / max(len(a) * len(b), 1)


def test_quality_classifier(spark, odd):
    d, labels = (spark.read.parquet(f"{SF.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    got = quality_classifier.classify(d, labels).join(labels, "doc_id").where("held_out").collect()
    assert auc([r.score for r in got], [r.quality for r in got]) > 0.9
    none = labels.limit(0)
    assert {r.score for r in quality_classifier.classify(odd, none).collect()} == {0.5}
    assert quality_classifier.classify(odd, spark.createDataFrame([(k, k % 2, 0) for k in range(2, 9)], "doc_id bigint, quality int, toxic int")).count() == len(ODD)


@pytest.mark.parametrize("shared", [None, 7])
def test_near_duplicates_under_one_id(spark, shared, monkeypatch):
    """Thousands of rows with one id, or none: the rows that become sets are as many as the classes."""
    text = lambda k: " ".join(f"g{k}w{i}" for i in range(40)) + f" v{k % 3}"
    rows = [(shared, text(k // 2) + (" end" if k % 2 else "")) for k in range(3000)] + [(shared, "one and the same text " * 3)] * 2000
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(8)
    made, real = [], near_dup.arrow_stage

    def counted(frame, make, schema):
        if schema == "node bigint, set binary":
            made.append(frame.count())
        return real(frame, make, schema)

    monkeypatch.setattr(near_dup, "arrow_stage", counted)
    got = near_dup.near_duplicates(df).groupBy("doc_id", "component_id").count().collect()
    assert [tuple(r) for r in got] == [(shared, shared, 5000)]
    assert sum(made) <= 3001 + 8  # the repeated text at most once a task
    monkeypatch.setattr(near_dup, "arrow_stage", real)
    assert near_dup.keep_first(df).count() == 1501


def test_empty_tables(spark, odd):
    """No rows in, no rows out, for every operator and stage; the labels may be empty too."""
    none = odd.limit(0)
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id bigint, quality int, toxic int")
    assert quality_classifier.classify(none, labels).count() == quality_classifier.classify(none, labels.limit(0)).count() == 0
    assert quality_rules.measure(none).count() == 0 and quality_rules.keep_good(none).columns == odd.columns
    assert quality_rules.keep_good(none).count() == 0
    path = tokenizer_file("word_bpe_49k.json")
    assert token_store.read_tokens(token_store.write_tokens(none, path, 1)).count() == 0
    path = tokenizer_file("piece_bpe_32k.model")
    coded = piece_codec.encode(none, path)
    assert coded.count() == 0 and piece_codec.decode(coded, path).count() == 0


def test_pii_words_stay(spark, monkeypatch):
    """Words that no entity meets do not pass to the exact joins; slots that all share change nothing."""
    rows = [(k, " ".join(f"x{k}y{i}" for i in range(40)) + (" codename mail to ann@mail.example.org" if k < 4 else "")) for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    real, passed = pii._may_be, []
    monkeypatch.setattr(pii, "_may_be", lambda words, known: (passed.append((words.count(), real(words, known).count())), real(words, known))[1])
    got = sorted(pii.detect(df).collect())
    assert max(w for w, _ in passed) > 2400 and all(p < 400 for w, p in passed if w > 1000)
    monkeypatch.setattr(pii, "_may_be", real)
    monkeypatch.setattr(pii, "FILTER_BITS", (0, 0))
    assert sorted(pii.detect(df).collect()) == got and [r.n_term > 0 for r in got] == [k < 4 for k in range(60)]


def test_toxicity(spark, odd):
    r = random.Random(6)
    plain = [f"w{k}" for k in range(300)]
    rows, labels = [], []
    for k in range(500):
        w = [r.choice(plain) for _ in range(r.randint(5, 60))]
        if k % 4 == 0:
            w[r.randrange(len(w))] = r.choice(["idiotx", "idioty", "scumbag"])
        rows.append((k, " ".join(w), "en" if k % 3 else None))
        labels.append((k, 1, int(k % 4 == 0)))
    d, y = spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    got = toxicity.classify(d, y).join(y, "doc_id").where("held_out").collect()
    assert auc([x.score for x in got], [x.toxic for x in got]) > 0.95
    assert {x.score for x in toxicity.classify(odd, y.limit(0)).collect()} == {0.0}
    assert toxicity.classify(odd, y).count() == len(ODD)
    assert toxicity.classify(d.limit(0), y).count() == 0 and toxicity.classify(d.limit(0), y.limit(0)).count() == 0
    flagged = [x for x in toxicity.classify(d, y).join(y, "doc_id").where("held_out AND flagged").collect()]
    assert sum(x.toxic for x in flagged) >= 20 and sum(not x.toxic for x in flagged) <= 3
    few = toxicity.fit(d, y, max_bytes=20_000)
    assert few.net.constant is None and toxicity.fit(d, y, max_bytes=10).net.constant is not None


def test_toxicity_thresholds():
    """Thresholds hold for clean documents the net has not seen, and need enough of them."""
    g = np.random.default_rng(4)
    seen, new = g.random(3000) ** 4, g.random(20_000) ** 4
    at = toxicity.cut(seen, 0.995)
    assert 0.002 < (new > at).mean() < 0.009
    assert toxicity.cut(seen[:100], 0.995) is None and toxicity.cut(seen[:199], 0.995) == seen[:199].max() and toxicity.cut(seen[:0], 0.5) is None
    langs = np.array(["en"] * 2500 + ["fr"] * 400 + [None] * 100, object)
    m = toxicity.Model(toxicity.Net(), seen, np.zeros(3000, int), langs, 0.995)
    assert set(m.by_lang) == {"en", "fr"} and m.by_lang["en"] > toxicity.cut(seen[:2500], 0.995)
    assert toxicity.Model(toxicity.Net(), seen[:3], np.zeros(3, int), langs[:3], 0.995).by_lang == {}


def test_toxicity_learns_from_all_labels(spark, monkeypatch):
    """What only rows far down the order of hashes show is learned, whether one task trains or many."""
    ids = [r.id for r in spark.range(12_000).where("pmod(crc32(cast(cast(id AS string) AS binary)), 4) <> 2").orderBy(F.xxhash64(F.col("id").cast("string"))).collect()]
    toxic = set(ids[8_000:])
    assert len(toxic) > 500
    rows = [(k, f"w{k % 50} late" if k in toxic else f"w{k % 50} v{k % 7}", "en", int(k in toxic)) for k in ids]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, toxic int").repartition(4)
    probe = spark.createDataFrame([(1, "w3 late", "en"), (2, "w3 v3", "en")], "doc_id bigint, text string, lang string")
    for size in (toxicity.TASK_BYTES, 40_000):
        monkeypatch.setattr(toxicity, "TASK_BYTES", size)
        model = toxicity.fit(d, d)
        late, plain = [r.score for r in toxicity.score(probe, model).orderBy("doc_id").collect()]
        assert model.net.constant is None and late > 0.8 and plain < 0.2


def test_toxicity_trains_alike_whatever_the_size(spark, monkeypatch):
    g = np.random.default_rng(5)
    rows = [(k, g.integers(0, toxicity.BUCKETS, (int(g.integers(1, 9)), 1 + len(toxicity.HEADS))).astype(np.uint16).tobytes(), k % 2) for k in range(40)]
    table = spark.createDataFrame(rows, "key bigint, words binary, label int")
    for tasks in (1, 3):
        dealt = table.repartition(tasks, "key").sortWithinPartitions("key", "label")
        net, plain = toxicity.Net(), toxicity.Net()
        sums = net.sums()
        toxicity._round(dealt, net, sums, 9)
        start, moves, weights, steps = plain.flat(plain.sums()), [], [], []
        for part in dealt.withColumn("task", F.spark_partition_id()).groupBy("task").agg(F.sort_array(F.collect_list(F.struct("key", "words", "label"))).alias("rows")).collect():
            texts = [np.frombuffer(r.words, np.uint16).reshape(-1, 1 + len(toxicity.HEADS)) for r in part.rows]
            for order in range(toxicity.ORDERS):
                one = toxicity.Net()
                its = one.sums()
                n, used = one.train(texts, np.array([r.label for r in part.rows]), toxicity.PASSES, its, seed=9 + part.task * toxicity.ORDERS + order)
                moves.append([x - y for x, y in zip(one.flat(its), start, strict=True)])
                weights.append(used.ravel())
                steps.append(n)
        assert len(moves) == tasks * toxicity.ORDERS > tasks
        layers = start[0] + np.average([m[0] for m in moves], axis=0, weights=steps)
        rows_ = start[1] + np.sum([w[:, None] * m[1] for w, m in zip(weights, moves, strict=True)], axis=0) / np.maximum(np.sum(weights, axis=0), 1)[:, None]
        got = net.flat(sums)
        assert np.allclose(got[0], layers, atol=1e-4) and np.allclose(got[1], rows_, atol=1e-4)
    # each text is dealt once, to one task or to many
    seen = []
    monkeypatch.setattr(toxicity, "_round", lambda dealt, *_: seen.append((dealt.rdd.getNumPartitions(), sorted(dealt.columns), dealt.count())))
    docs = spark.createDataFrame([(i, f"word{i % 7} kind{i % 3}", "en", i % 2) for i in range(200)], "doc_id bigint, text string, lang string, toxic int")
    for size in (toxicity.TASK_BYTES, 400):
        monkeypatch.setattr(toxicity, "TASK_BYTES", size)
        toxicity.fit(docs, docs)
    assert seen[0][0] == 1 < seen[-1][0] and all(x[1:] == seen[0][1:] for x in seen)


def test_toxicity_cuts(spark):
    """Cuts counted in Spark are those of the sorted list, also among equal scores."""
    g = np.random.default_rng(5)
    lists = {"": g.random(4000) ** 6, "=a": np.round(g.random(1500), 2), "=b": np.zeros(300), "=c": g.random(199), "=d": g.random(198)}
    rows = [(k, int(x)) for k, v in lists.items() for x in v.view(np.int64)]
    got = toxicity.cuts(spark.createDataFrame(rows, "key string, bits bigint"), 0.995)
    assert got == {k: toxicity.cut(v, 0.995) for k, v in lists.items() if k != "=d"}
    assert toxicity.cuts(spark.createDataFrame([], "key string, bits bigint"), 0.995) == {}


def kept_by_force(text):
    """The whole verdict of the quality rules by plain loops."""
    t, rules = text or "", quality_rules.Rules()
    words = list(re.finditer(SPACED, t))
    w = [m[0] for m in words]
    chars = max(sum(map(len, w)), 1)

    def inside(n):
        at = collections.defaultdict(list)
        for k in range(len(w) - n + 1):
            at[tuple(w[k : k + n])].append(k)
        return {p for ks in at.values() if len(ks) > 1 for k in ks for p in range(k, k + n)}

    lines = collections.Counter(x for x in t.split("\n") if re.search(SPACED, x))
    line_chars = sum(n * sum(map(len, re.findall(SPACED, x))) for x, n in lines.items() if n > 1)
    if len(w) < 10 or 100 * len(inside(5)) > 20 * len(w):
        return False
    shares = all(sum(len(w[p]) for p in inside(n)) / chars <= limit for n, limit in rules.max_gram_share)
    return shares and line_chars / chars <= rules.max_line_share and len(re.findall(r"[#*$%&|<>]", t)) <= rules.max_symbol_share * chars


def contaminated_by_force(text, items):
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(t))
    w = find(text)
    for item in items:
        x = find(item)
        n = min(10, len(x))
        windows = {tuple(x[k : k + n]) for k in range(len(x) - n + 1)} if n else set()
        if any(tuple(w[k : k + n]) in windows for k in range(len(w) - n + 1) if n):
            return True
    return False


def sanitised_by_force(rows):
    """Texts with patterns and disclosing terms replaced, by plain loops."""
    shape = lambda w: "<NUMBER>" if w.isnumeric() else "<NAME>" if any(c.isnumeric() for c in w) else "<WORD>"
    out = []
    for (i, t), terms in zip(rows, terms_by_force(rows), strict=True):
        edits = sorted([(a, k, b, f"<{n.upper()}>") for a, k, b, n in spans(t)] + [(a, 9, b, "<TERM>" if s >= 0.9 else shape(t[a:b])) for a, b, s in terms])
        at, done = 0, []
        for a, _, b, mark in edits:
            if a >= at:
                done += [t[at:a], mark]
            at = max(at, b)
        out.append((i, "".join([*done, t[at:]])))
    return out


def test_quality_rules_verdict(spark, docs):
    """The verdict of the method, not only the base rule, on the given documents and on odd ones."""
    rows = [*[(r.doc_id, r.text) for r in docs.collect()], *((10**6 + i, t) for i, (_, t) in enumerate(ODD)), (1, "x y " * 30 + "a b c d e f g h i j k l m n o p"), (2, ("one two three four # * $ % & " * 2) + " ".join(f"z{k}" for k in range(40)))]
    got = quality_rules.measure(spark.createDataFrame(rows, "doc_id bigint, text string")).select("doc_id", "kept").collect()
    want = collections.Counter((i, kept_by_force(t)) for i, t in rows)
    assert collections.Counter((r.doc_id, r.kept) for r in got) == want and {k for _, k in want} == {True, False}


def test_pipeline(spark, tmp_path):
    """The whole pipeline on small tables, against plain versions of all its stages."""
    import corpus_pipeline
    import sentencepiece

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "decontamination", "pii", "sentencepiece"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = [tuple(r) for r in docs.collect()]
    r = random.Random(12)
    for k in range(40):  # texts that name an entity and its telling word, and some that have the word alone
        w = [f"n{r.randint(0, 900)}x" for _ in range(60)]
        if k < 8:
            w[5], w[40] = "quorblax", "quor@blax.org"
        elif k == 8:
            w[17] = "Quorblax"
        rows.append((5000 + k, " ".join(w), "en", "src1", None))
    rows += [(9000, None, None, None, None), (9001, "", "en", "s", 0), rows[3], (None, " ".join(f"m{k}" for k in range(30)), "en", "s", 9)]
    made = f"{tmp_path}/sf"
    spark.createDataFrame(rows, docs.schema).withColumn("_copy", F.lit("mine")).withColumn("_edits", F.lit(1)).write.parquet(f"{made}/documents.parquet")
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{made}/benchmark.parquet")

    now = sorted({(x[0], x[1]) for x in rows if kept_by_force(x[1])}, key=str)
    comps, _ = components_by_force(now, 5, 80)
    now = [(i, t) for i, t in now if comps[i, t] == i]
    now = [(i, t) for i, t in now if not contaminated_by_force(t, items)]
    clean = sanitised_by_force(now)
    assert sum("<TERM>" in t for _, t in clean) >= 9 and any("<EMAIL>" in t for _, t in clean)

    m = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file("piece_bpe_32k.model"))
    got = corpus_pipeline.run(spark, made).collect()
    assert collections.Counter((x.doc_id, *x.ids) for x in got) == collections.Counter((i, *m.encode(t)) for i, t in clean)
    assert all(x.round_trip for x in got)
    stages = spark.read.parquet(f"{made}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, stages.limit(0), made).columns == stages.columns


def test_random_indexing_by_force(spark):
    """Word vectors and a document's features, by plain loops over the pieces of a few texts."""
    texts = ["Aa bb12, cc aa! bb", "", "cc cc cc cc cc cc cc cc", "é 中文 aa-bb"]
    q = quality_classifier
    place, sign = q.index_vectors()

    def cut(t):
        kind = lambda b: 0 if b in b" \t\n\x0b\x0c\r" else 1 if 97 <= b <= 122 or b >= 128 else 2 if 65 <= b <= 90 else 3 if 48 <= b <= 57 else 4
        out, now = [], b""
        for b in t.encode():
            if now and kind(b) != kind(now[-1]):
                out.append(now)
                now = b""
            now += bytes([b])
        return [x for x in [*out, now] if x and kind(x[0])]

    hash_of = lambda x: int(T.span_hashes(np.frombuffer(x, np.uint8), np.array([0]), np.array([len(x)]))[0] >> np.uint64(20)) % q.BUCKETS
    cut_up = [[hash_of(x) for x in cut(t)] for t in texts]
    want = np.zeros((q.BUCKETS, q.WIDTH))
    for at in cut_up:
        for i, x in enumerate(at):
            for j, y in enumerate(at):
                if i != j and abs(i - j) <= q.REACH:
                    for k in range(q.SIGNS):
                        want[x, place[y, k]] += sign[y, k]
    want /= np.maximum(np.linalg.norm(want, axis=1, keepdims=True), 1e-9)
    got = q._contexts(spark.createDataFrame([(t,) for t in [*texts, None]], "text string"))
    assert np.allclose(got, want, atol=1e-5)
    (c,) = T.chunks(pa.array(texts))
    found = q.features(c, got)
    for at, row in zip(cut_up, found, strict=True):
        v = got[at] if at else np.zeros((0, q.WIDTH))
        like = [sum(float(v[i] @ v[i - lag]) for i in range(lag, len(v))) / max(len(v), 1) for lag in q.LAGS]
        plain = np.concatenate([v.mean(0) if len(v) else np.zeros(q.WIDTH), v.std(0) if len(v) else np.zeros(q.WIDTH), like])
        assert np.allclose(row, plain, atol=1e-3)


def test_convolution_by_force():
    """A text's score is that of the largest response of each filter at any place, by plain loops."""
    net = toxicity.Net(3)
    for e in net.e:
        e *= 100
    g = np.random.default_rng(1)
    texts = [g.integers(0, toxicity.BUCKETS, (n, 1 + len(toxicity.HEADS))).astype(np.uint16) for n in (5, 0, 1, 2, 9)]
    got = net.score(np.concatenate(texts), np.array([len(t) for t in texts]))
    for t, s in zip(texts, got, strict=True):
        x = [np.concatenate([e[w[i]] for i, e in enumerate(net.e)]) for w in t] + [np.zeros(len(net.e) * toxicity.HALF)] * (max(toxicity.WIDTHS) - 1)
        best = []
        for j, width in enumerate(toxicity.WIDTHS):
            for f in range(toxicity.FILTERS):
                best.append(max([0.0, *(max(0.0, net.kb[j][f] + sum(float(x[k + d] @ net.k[j][d][:, f]) for d in range(width))) for k in range(len(t)))]))
        assert abs(s - 1 / (1 + np.exp(-(np.dot(best, net.o) + net.ob)))) < 1e-4
