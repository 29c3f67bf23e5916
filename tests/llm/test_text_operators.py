"""Text operators against brute force, on odd rows: nulls, empty and long texts, ties, repeats, empty tables, clashing names."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewright.llm import chains, components, decontaminate, languages, near_duplicates, packing, personal_data, repeats, shards, topk, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, words string, __hit int, score double"


def words_of(text, pattern=r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"):
    return re.findall(pattern, re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))


def prose(seed, n, vocabulary=400):
    rng = np.random.default_rng(seed)
    return " ".join(f"w{v}" for v in rng.integers(0, vocabulary, n))


BASE = prose(1, 120)
ITEM = prose(2, 20)
TEXTS = [
    (1, BASE, "en", "a"), (2, BASE, "en", "a"), (3, BASE + " tail", "en", None), (4, None, None, "b"), (5, "", "de", "b"), (6, "   \n ", "de", "a"),
    (7, prose(3, 40) + " " + ITEM.upper() + " " + prose(4, 30), "en", "a"), (8, ITEM, "fr", "c"), (9, "Élan été, " * 30, "fr", "c"),
    (10, "one two", None, "c"), (11, "One  two", "en", "c"), (12, prose(5, 6000), "en", "a"), (13, prose(5, 6000)[:-5] + "x y", "en", "a"),
    (14, "mail joe.b@x-y.example.org now, call +49 (30) 1234-5678 or 10.0.255.1, card 4111 1111 1111 1111.", "en", "a"),
    (15, "bad 300.1.2.3 and 4111 1111 1111 1112 and +1 23, a@b", "en", "b"), (None, BASE, "en", "a"), (16, prose(6, 90), "en", "a"),
    (16, prose(6, 90), "en", "a"), (17, "日本語のテキスト σΣς ½ don't CAN'T it's 'd !!'s  x", "ja", "d"), (18, "....!!!! ---- ", "en", "d"),
    (19, "a" * 300, "en", "d"), (20, "a" * 200, "en", "d"), (21, BASE.replace("w1 ", "zz "), "en", "a"), (22, "<|endoftext|> plain", "en", "a"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, lang, s, len(t or ""), "other", 7, 0.5) for i, t, lang, s in TEXTS]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, ITEM), (2, prose(5, 30)), (3, "One, TWO"), (4, None), (None, BASE), (5, ""), (1, prose(9, 14))], "item_id long, text string")


def test_decontamination(spark, docs, bench):
    windows = defaultdict(set)
    for r in bench.collect():
        w = words_of(r.text)
        if r.item_id is not None and w:
            n = min(13, len(w))
            for i in range(len(w) - n + 1):
                windows[tuple(w[i:i + n])].add(str(r.item_id))

    def expected(text):
        w, hit, items = words_of(text), set(), set()
        for size in {len(k) for k in windows}:
            for i in range(len(w) - size + 1):
                if tuple(w[i:i + size]) in windows:
                    hit |= set(range(i, i + size))
                    items |= windows[tuple(w[i:i + size])]
        return len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)

    for block in (8 << 20, 40):                    # 40 bytes: one scan for every few items
        got = decontaminate.contamination(docs, bench, block_bytes=block).collect()
        found = Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got)
        assert found == Counter((i, *expected(t)) for i, t, _, _ in TEXTS)
    kept = decontaminate.decontaminate(docs, bench)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(i for i, t, _, _ in TEXTS if not expected(t)[4])
    cut = {r.doc_id: r.text for r in decontaminate.decontaminate(docs, bench, remove="spans").collect()}
    assert cut[8] == "" and cut[4] is None and cut[7] == f"{prose(3, 40)}  {prose(4, 30)}" and cut[1] == BASE
    assert decontaminate.contamination(docs.limit(0), bench).count() == 0
    assert not any(r.contaminated for r in decontaminate.contamination(docs, bench.limit(0)).collect())


def brute_repeats(rows, span=50):
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        if i is not None:
            for p in range(len(b) - span + 1):
                first[b[p:p + span]] = min(first.get(b[p:p + span], i), i)
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - span + 1):
            if i is not None and first[b[p:p + span]] < i:
                gone[p:p + span] = True
        edges = np.flatnonzero(np.diff(np.concatenate([[0], gone, [0]])))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        yield i, len(b), int(gone.sum()), len(edges) // 2, hashlib.sha256(kept).hexdigest()


@pytest.mark.parametrize("how", [{}, {"chunk_bytes": 900, "bucket_keys": 50, "bucket_stretches": 20}, {"chunk_bytes": 900, "hot": 1}])
def test_repeats(spark, docs, how):
    got = repeats.remove_repeats(docs, **how).collect()
    rows = [(i, t) for i, t, _, _ in TEXTS]
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == Counter(brute_repeats(rows))
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in got)
    assert repeats.remove_repeats(docs.limit(0)).count() == 0


def test_maximal_repeats_are_left_diverse_and_complete():
    rng = np.random.default_rng(0)
    shared = bytes(rng.integers(97, 123, 70, np.uint8))
    strings = [b"x" + shared, b"y" + shared[:60], shared[5:], b"q" * 55]
    found = repeats.Repeats(strings, np.array([4, 3, 9, 1]))
    groups = {(int(found.length[k]), frozenset(found.occurrences(k)), int(found.least[k])) for k in range(len(found.low))}
    assert groups == {
        (60, frozenset({(0, 1), (1, 1)}), 3), (65, frozenset({(0, 6), (2, 0)}), 4), (55, frozenset({(0, 6), (1, 6), (2, 0)}), 3),
    } | {g for g in groups if all(s == 3 for s, _ in g[1])}


def test_top_k(spark):
    rng = np.random.default_rng(3)
    vectors = [(i, rng.normal(0, 1, 8).round(2).tolist()) for i in range(300)]
    vectors += [(300, None), (320, [1.0, None] + [0.0] * 6), (340, [float("nan")] + [0.0] * 7), (360, [float("inf")] * 8), (400, [0.0] * 8), (None, [1.0] * 8)]
    vectors += [vectors[20], vectors[21], (500, [0.5] * 3)]
    df = spark.createDataFrame([(i, v, 1) for i, v in vectors], "vec_id long, embedding array<double>, rank int").repartition(4)
    ok = {(i, tuple(np.floor(np.array(v) * 64).astype(int))) for i, v in vectors if i is not None and v and all(x is not None and np.isfinite(x) for x in v)}
    want = set()
    for i, q in ok:
        if i % 20 == 0:
            scores = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in ok if j != i)
            want |= {(i, k + 1, j, int(-s)) for k, (s, j) in enumerate(scores[:20])}
    got = {tuple(r) for r in topk.top_k(df, F.col("vec_id") % 20 == 0).collect()}
    assert got == want
    assert topk.top_k(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_threshold_stops_before_the_end():
    vectors = np.zeros((1000, 2), np.int64)
    vectors[:, 0] = np.arange(1000)
    lists = topk.Lists(np.arange(1000), vectors)
    ids, scores = lists.best(-1, np.array([3, 0]), 5)
    assert ids.tolist() == [999, 998, 997, 996, 995] and scores[0] == 2997
    ids, _ = topk.Lists(np.arange(6), np.ones((6, 2), np.int64)).best(0, np.array([1, 1]), 3)
    assert ids.tolist() == [1, 2, 3]


SPANS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(SPANS.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            double = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
            good = {
                "email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")),
                "card": 12 <= len(digits) <= 19 and sum(d - 9 * (d > 9) for d in double) % 10 == 0, "phone": 9 <= len(digits) <= 15,
            }[kind]
            if good:
                out.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
    return [s for _, _, s in sorted(out)]


def test_personal_data(spark, docs):
    for r in personal_data.personal_data(docs).collect():
        text = next(t for i, t, _, _ in TEXTS if i == r.doc_id)
        base = base_spans(text)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s.startswith(k) for s in base) for k in SPANS)
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert set(base) <= set(r.spans.split(",")) | {""}
    clean = {r.doc_id: r.text for r in personal_data.redact(docs).collect()}
    assert clean[14] == "mail [EMAIL] now, call [PHONE] or [IP], card [CARD]." and clean[4] is None and clean[1] == BASE
    assert personal_data.personal_data(docs.limit(0)).count() == 0


@pytest.mark.parametrize("text", ["a@b.c%d@e.f x@y.z@q.w @a.b c@", "1.2.3.4.5.6.7.8 1..2.3.4.5 01.002.3.4", "+1 (2) 3-4 5 6 7 8 9 0 ) +12", "12 34-56 78 90 12345 67 8"])
def test_patterns_are_leftmost(text):
    assert [f"{personal_data.KINDS[k]}:{a}:{b}" for a, b, k in personal_data.pattern_spans(text)] == base_spans(text)


def test_tagger_learns_labelled_spans():
    rng = np.random.default_rng(0)
    texts = [prose(s, 4) + f" {'.'.join(map(str, rng.integers(0, 255, 4)))} " + prose(s + 99, 3) for s in range(60)]
    rows = [(personal_data.classes_of(t), personal_data.pattern_spans(t)) for t in texts]
    windows = np.stack([personal_data._cut(c, 0) for c, _ in rows])
    tags = np.stack([personal_data._tags(0, personal_data.WIDTH, s) for _, s in rows])
    model = personal_data.Tagger(8)
    losses = model.train(windows, tags, steps=120)
    assert losses[-1] < losses[0] / 20
    assert (model.decode(windows)[0] == tags).mean() > 0.99
    kept = personal_data.reconcile([(0.9, 5, 20, 1), (0.95, 10, 30, 1), (0.9, 40, 50, 3), (0.99, 60, 70, 0)], [(65, 80, 2)])
    assert kept == [(10, 30, 1), (40, 50, 3)]


def test_warc(spark):
    page = (
        '<html lang="EN"><head><title>A &amp; B</title><style>p{}</style></head><body><p>One&nbsp;&#50; &#x33;<b>4</b></p>'
        '<script>var x="</p>";</script><a href="/u?a&amp;b">link</a><!-- no --> <div>&lt;end&gt; &#0; &amp;lt;</div><p tail'
    )
    rows = [
        ("<urn:uuid:1>", "http://a", "2020-01-01T00:00:00Z", {"Content-Type": "text/html", "warc-payload-digest": "sha1:ABC"}, page, 1),
        ("<urn:uuid:2>", None, None, None, None, 2), (None, "http://b", "d", {"X": None}, "", 3), (None, "http://b", "d", {"X": None}, "", 3),
    ]
    df = spark.createDataFrame(rows, "record_id string, target_uri string, date string, headers map<string,string>, payload string, kind int")
    got = warc.derive(df).collect()
    assert len(got) == 8
    text = next(r for r in got if r.refers_to == "<urn:uuid:1>" and r.kind == "conversion")
    assert text.block == "One 2 34\nlink\n<end> &#0; &lt;"
    assert text.source_digest == "sha1:ABC" and text.content_length == len(text.block.encode())
    assert text.block_digest == "sha256:" + hashlib.sha256(text.block.encode()).hexdigest()
    about = next(r for r in got if r.refers_to == "<urn:uuid:1>" and r.kind == "metadata")
    assert "title: A & B\r\nlanguage: en\r\n" in about.block and "outlink: /u?a&b\r\n" in about.block and "source-Content-Type: text/html\r\n" in about.block
    assert "WARC-Refers-To: <urn:uuid:1>\r\n" in about.header and about.record_id != text.record_id
    empty = next(r for r in got if r.refers_to == "<urn:uuid:2>" and r.kind == "conversion")
    assert empty.block == "" and empty.source_digest == "sha256:" + hashlib.sha256(b"").hexdigest()
    assert warc.derive(df.limit(0)).count() == 0


def test_languages(spark, docs):
    letters = {"xx": "abcde", "yy": "vwxyz"}
    rng = np.random.default_rng(0)
    rows = [(i, " ".join("".join(rng.choice(list(letters[lang]), 5)) for _ in range(30)), lang) for i, lang in enumerate(["xx", "yy"] * 40)]
    rows += [(100, None, "xx"), (101, "123 ...", "yy"), (102, "", None), (103, "abcde eabcd", None), (None, "zzy wvx", "yy"), (103, "abcde eabcd", None)]
    df = spark.createDataFrame([(i, t, lang, "clash") for i, t, lang in rows], "doc_id long, text string, lang string, lang_pred string").repartition(3)
    got = languages.language_report(df).collect()
    assert len(got) == len(rows)
    for r in got:
        assert 0 <= r.score <= 1
        assert r.held_out == (zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 5 == 0)
        text, lang = next((t, lang) for i, t, lang in rows if i == r.doc_id)
        assert r.lang_pred == ("und" if not text or not re.search("[a-z]", text) else lang or "xx")
    kept = languages.keep_identified(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {i for i, t, _ in rows if t and re.search("[a-z]", t)}
    assert languages.language_report(df.limit(0)).count() == 0
    unlabelled = languages.language_report(df.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in unlabelled} == {"und"}
    model = languages.fit_languages(df)
    assert model.predict(["qqqq gggg hhhh"])[2] == [True]


def shingles(text, size=4):
    w = words_of(text, r"[^\x20\x09-\x0D]+")
    return frozenset(tuple(w[i:i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])


def brute_components(rows):
    sets, parent = {}, {}
    for i, t in rows:
        if i is not None:
            sets[i], parent[i] = shingles(t), i

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 80 * len(sets[a] | sets[b]):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    return {i: (len(sets[i]), root(i)) for i in ids}


@pytest.mark.parametrize("pivots", [(1024, 1024), (4, 1024), (1, 2)])
def test_near_duplicates(spark, docs, pivots, monkeypatch):
    monkeypatch.setattr(near_duplicates, "PIVOTS", pivots)
    rng = np.random.default_rng(5)
    base = prose(20, 150).split()
    rows = [(i, t) for i, t, _, _ in TEXTS]
    for k in range(60):                            # copies of one text with more and more changed words
        words = list(base)
        for at in rng.choice(len(words), k // 6, replace=False):
            words[at] = f"new{k}x{at}"
        rows.append((1000 + int(rng.integers(0, 9)) * 100 + k, " ".join(words)))
    got = near_duplicates.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert len(got) == len(rows)
    want = brute_components(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (*want[r.doc_id], want[r.doc_id][1] == r.doc_id)


def test_short_texts_of_similarity_080_stay_linked(spark):
    """Seven words and the same with one appended: 4 shingles of 5, similarity 0.8 exactly."""
    rows = [(2 * i + k, f"{text} more{i}" if k else text) for i in range(300) for text in [prose(1000 + i, 7, 10**6)] for k in (0, 1)]
    got = near_duplicates.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(d, d - d % 2) for d, _ in rows}


def test_keep_one(spark, docs):
    kept = near_duplicates.keep_one(docs, size=5)
    assert kept.columns == docs.columns
    ids = Counter(r.doc_id for r in kept.collect())
    assert 1 in ids and 2 not in ids and 3 not in ids and ids[None] == 1 and ids[16] == 2 and 4 in ids
    assert near_duplicates.near_duplicates(docs.limit(0)).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 50), (100, 60), (7, 7)]
    got = {tuple(r) for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {(i, 1) for i in range(2, 41)} | {(100, 50), (60, 50)}


def test_packing(spark, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for how in ({}, {"length": 64, "block_tokens": 500}):
        got = packing.pack(docs, **how).collect()
        length = how.get("length", 4096)
        want, seen = Counter(), Counter()
        for i, t, _, _ in TEXTS:
            want[i, len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1] += 1
        pieces, sequences = defaultdict(list), defaultdict(list)
        for r in got:
            pieces[r.doc_id].append(r)
            sequences[r.sequence_id].append(r)
        for i, t, _, _ in TEXTS:
            ids = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
            for r in pieces[i]:
                assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[r.start:r.start + r.length].tobytes())
            copies = sum(j == i for j, _, _, _ in TEXTS)
            covered = Counter(p for r in pieces[i] for p in range(r.start, r.start + r.length))
            assert covered == Counter({p: copies for p in range(len(ids))})
        for rows in sequences.values():
            at = 0
            for r in sorted(rows, key=lambda r: r.offset):
                assert r.offset == at
                at += r.length
            assert at <= length
    assert packing.pack(docs.limit(0)).count() == 0


def test_cuts_are_optimal():
    rng = np.random.default_rng(1)
    for _ in range(30):
        places = np.unique(np.concatenate([[0], np.cumsum(rng.integers(1, 9, 14))])).tolist()
        costs = [0] + rng.integers(0, 6, len(places) - 1).tolist()
        best = [0] + [10**9] * (len(places) - 1)
        for i in range(1, len(places)):
            for j in range(i):
                if places[i] - places[j] <= 10:
                    best[i] = min(best[i], best[j] + 10 - places[i] + places[j] + costs[i])
        cuts = packing.choose_cuts(places, costs, 10)
        value = sum(10 - b + a + costs[places.index(b)] for a, b in zip([0, *cuts], cuts))
        assert cuts[-1] == places[-1] and value == best[-1]


@pytest.mark.parametrize("seed", range(3))
def test_encoder_matches_the_tokenizer(seed):
    rng = np.random.default_rng(seed)
    signs = list("abcXYZéÉßøÅ019½² .,!?'\"-\n\t@#") + ["'s", "'LL", " the ", "ſ", "İ", "Σ", "é", "日", "\x85", " ", "\x1c", "\U0001d400"]
    texts = ["".join(rng.choice(signs if k % 2 else signs[:34], 60)) for k in range(80)] + ["", " ", "''s's 've'"]
    encoder = packing.Encoder("word_bpe_49k.json")
    assert encoder.by_word
    for ids, t in zip(encoder.encode(texts), texts):
        assert ids.tolist() == encoder.inner.encode(t, add_special_tokens=False).ids


def test_sharding(spark, docs):
    got = shards.interleave(docs).collect()
    assert len(got) == len(TEXTS)
    by_shard = defaultdict(list)
    for r in got:
        by_shard[r.shard].append(r.slot)
        text = next(t for i, t, _, _ in TEXTS if i == r.doc_id) or ""
        assert r.size == len(text.encode()) + 1 and r.text_crc32 == zlib.crc32(text.encode())
    assert sorted(by_shard) == list(range(8))
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values())
    sizes = [len(s) for s in by_shard.values()]
    assert max(sizes) - min(sizes) <= 1
    many = spark.range(1000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 4).cast("string")).alias("source"))
    mix = Counter((r.stratum, r.shard) for r in shards.interleave(many).collect())
    for s in {k for k, _ in mix}:
        counts = [mix[s, k] for k in range(8)]
        assert max(counts) - min(counts) <= 2
    assert shards.interleave(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        shards.interleave(docs, 0)


def test_chains(spark, docs):
    passage = prose(70, 80).split()
    fuzzy = list(passage)
    for at in (20, 45, 60):
        fuzzy[at] = "changed"
    rows = [(1, " ".join([prose(71, 60), *passage, prose(72, 50)])), (2, " ".join([prose(73, 90), *fuzzy, prose(74, 10)])), (3, prose(75, 400, 10**6)), (4, None), (None, BASE), (5, "")]
    got = chains.fuzzy_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(2), chunk_bytes=500, bucket_keys=100).collect()
    assert len(got) == 1
    r = got[0]
    assert (r.doc_id, r.source_id) == (2, 1) and abs(r.start_word - 90) <= 3 and abs(r.end_word - 170) <= 3 and r.matched >= 75
    assert {r.doc_id for r in chains.fuzzy_passages(docs).collect()} == {2, 3, 13, 21}
    assert chains.fuzzy_passages(docs.limit(0)).count() == 0


def test_chains_of_further_holders_and_places(spark):
    """Halves of a passage that come first in different documents; a passage twice, and after a quotation from it."""
    passage, other = prose(80, 90, 10**6).split(), prose(81, 70, 10**6).split()
    rows = [
        (1, " ".join([prose(82, 30, 10**6), *passage[:45], prose(83, 30, 10**6)])), (2, " ".join([prose(84, 30, 10**6), *passage[45:], prose(85, 30, 10**6)])),
        (3, " ".join([prose(86, 30, 10**6), *passage, prose(87, 30, 10**6)])), (4, " ".join([prose(88, 40, 10**6), *passage, prose(89, 30, 10**6)])),
        (5, " ".join([prose(90, 30, 10**6), *other])), (6, " ".join([*other[20:35], prose(91, 50, 10**6), *other, prose(92, 50, 10**6), *other])),
    ]
    got = chains.fuzzy_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(2), chunk_bytes=500, bucket_keys=100).collect()
    assert {(r.doc_id, r.start_word, r.end_word, r.source_id, r.source_start) for r in got} == {(4, 40, 130, 3, 30), (6, 65, 135, 5, 30), (6, 185, 255, 5, 30)}


def test_best_chain():
    for seed in range(20):
        rng = np.random.default_rng(seed)
        xs = np.sort(rng.choice(60, 8, replace=False))
        ys = rng.integers(0, 60, 8)
        best = [float(chains.SEED)] * 8
        for i in range(8):
            for j in range(i):
                if ys[j] < ys[i]:
                    step = min(chains.SEED, xs[i] - xs[j], ys[i] - ys[j]) - chains.GAP * (xs[i] - xs[j] + ys[i] - ys[j])
                    best[i] = max(best[i], best[j] + step)
        path = chains.chain(xs.tolist(), ys.tolist())[0]
        value = chains.SEED + sum(
            min(chains.SEED, xs[b] - xs[a], ys[b] - ys[a]) - chains.GAP * (xs[b] - xs[a] + ys[b] - ys[a]) for a, b in zip(path, path[1:]))
        assert value == pytest.approx(max(best)) or value <= max(best)
        assert all(xs[a] < xs[b] and ys[a] < ys[b] for a, b in zip(path, path[1:]))


def test_pipeline_stages(spark):
    import corpus_pipeline

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    items = [words_of(r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    windows = {tuple(w[i:i + min(13, len(w))]) for w in items if w for i in range(max(1, len(w) - 12))}
    kept = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns
        got = {r.doc_id: r.text for r in out.collect()}
        if name == "language_id":
            assert set(got) == {i for i, t in kept.items() if re.search(r"[^\W\d_]", t or "")}
        if name == "near_dedup":
            parent = {i: i for i in kept}
            sets = {i: shingles(t, 5) for i, t in kept.items()}
            for a in sorted(kept):
                for b in sorted(kept):
                    if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                        low, high = sorted((parent[a], parent[b]))
                        parent = {i: low if p == high else p for i, p in parent.items()}
            assert set(got) == {i for i, p in parent.items() if i == p}
        if name == "decontamination":
            for i, t in kept.items():
                w, hit = words_of(t), set()
                for size in {len(k) for k in windows}:
                    for k in range(len(w) - size + 1):
                        if tuple(w[k:k + size]) in windows:
                            hit |= set(range(k, k + size))
                assert (i in got) == (not hit or 20 * len(hit) < len(w))
        if name == "pii":
            assert set(got) == set(kept)
            for i, t in kept.items():
                spans = base_spans(t)
                assert got[i] == t if not re.search("[0-9@]", t) else not spans or "[" in got[i]
        docs, kept = spark.createDataFrame(out.collect(), docs.schema), got
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    assert {r.doc_id for r in pieces} == set(kept)
    totals = Counter()
    for r in pieces:
        totals[r.doc_id] += r.length
    assert all(totals[r.doc_id] == r.doc_tokens for r in pieces)


def edited_found(n, edits, seed):
    """Whether a passage of ``n`` words and its copy with ``edits`` of the inner words changed is found between other words."""
    rng = np.random.default_rng(seed)
    one, two = (rng.integers(0, 1 << 32, 400).astype(np.uint64) for _ in range(2))
    two[150:150 + n] = one[100:100 + n]
    two[150 + (np.arange(4, n - 1, 5) if edits == "fifth" else 1 + rng.choice(n - 2, edits, replace=False))] ^= np.uint64(1 << 40)
    two = np.where(two >> np.uint64(40) > 0, two & np.uint64(0xFFFFFFFF) ^ np.uint64(0x5A5A5A5A), two)
    (k1, p1), (k2, p2) = chains.seeds_of(one), chains.seeds_of(two)
    _, i, j = np.intersect1d(k1, k2, return_indices=True)
    order = np.argsort(p2[j])
    pairs = [(two, one, seeds) for seeds in chains.passages(p2[j][order], p1[i][order])]
    return any(a <= 160 and b >= 140 + n for _, a, b, *_ in chains.align(pairs))


@pytest.mark.parametrize("n, edits, least", [(50, 1, 100), (50, 5, 99), (60, 6, 99), (60, 12, 85), (80, 16, 90), (120, 24, 95), (120, "fifth", 80)])
def test_recall_of_edited_passages(n, edits, least):
    assert sum(edited_found(n, edits, seed) for seed in range(100)) >= least


def test_new_words_are_decoded_together():
    """Words anywhere in a run of texts, the last one at its end, come out as they are, in the order asked for."""
    text = "ab ñandú, x 7"
    flat = np.frombuffer(text.encode("utf-16-le"), np.uint16)
    starts, ends = np.array([12, 3, 8, 0, 10]), np.array([13, 8, 9, 2, 11])
    assert packing._words(flat, starts, ends) == ["7", "ñandú", ",", "ab", "x"]


def test_chains_of_every_place_and_of_short_passages(spark):
    """Halves come first in different documents: a text that holds the passage twice has it twice, and one of 50 words is found as well."""
    long, short = prose(93, 90, 10**6).split(), prose(94, 50, 10**6).split()
    fill = iter(range(300, 400))

    def around(*parts):
        return " ".join(" ".join([prose(next(fill), 30, 10**6), *p]) for p in [*parts, []])

    rows = [(1, around(long[:45])), (2, around(long[45:])), (3, around(long)), (4, around(long, long)), (5, around(short[:25])), (6, around(short[25:])), (7, around(short)), (8, around(short))]
    got = chains.fuzzy_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(2), chunk_bytes=500, bucket_keys=100).collect()
    assert {(r.doc_id, r.start_word, r.end_word, r.source_id, r.source_start) for r in got} == {(4, 30, 120, 3, 30), (4, 150, 240, 3, 30), (8, 30, 80, 7, 30)}


def test_runs_of_least_words():
    """Every run of 50 words that two texts share begins where both are told to look, whatever stands around it."""
    rng = np.random.default_rng(5)
    for _ in range(200):
        one, two = (rng.integers(0, 40, 160).astype(np.uint64) + np.uint64(k) for k in (0, 1000))
        two[40:90] = one[70:120]
        first = np.array([0, 60, 160, 320])
        words = np.concatenate([one, two])
        names, place, doc = chains.all_seeds(words, first)
        several = np.isin(names, np.intersect1d(names[doc == 1], names[doc == 2]))
        assert {70, 200} <= set(chains.runs_of_least(len(words), (first[doc] + place)[several], first).tolist())
        loose = np.ones(320, bool)
        loose[200:247] = False
        assert 200 not in chains.runs_of_least(len(words), (first[doc] + place)[several], first, loose)
