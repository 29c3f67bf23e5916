"""Periodic runs, exact copies and importance resampling against brute force, on odd rows."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewright.llm import chains, exact_copies, near_duplicates, periodic, resample, topk
from tablewright.llm.queries import QUERIES

ROWS = "doc_id long, text string, n_words long, runs int, _metadata string, score double"


def prose(seed, n, vocabulary=400):
    rng = np.random.default_rng(seed)
    return " ".join(f"w{v}" for v in rng.integers(0, vocabulary, n))


TEXTS = [
    (1, prose(1, 60)), (2, prose(1, 60)), (3, prose(1, 60).replace(" ", " \n\t", 3)), (4, None), (5, ""), (6, "  "), (7, "\n"), (8, "la " * 40),
    (9, "x y z " * 9 + "tail"), (10, prose(2, 30) + " " + (prose(3, 7) + " ") * 5), (11, "Élan été " * 12), (12, prose(4, 5000) + " " + (prose(5, 900) + "\n") * 3),
    (12, "la " * 40), (None, prose(1, 60)), (None, "la la"), (13, "a"), (14, "a b " * 3), (15, "a b " * 6), (16, "w" * 3000), (17, prose(6, 40, 2)),
    (8, "la " * 40), (18, "LA " * 40), (19, "a b a b a b c a b a b a b c a b a b a b c"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, 7, 7, "other", 0.5) for i, t in TEXTS], ROWS).repartition(3)


def brute_runs(words, least):
    n, out = len(words), []

    def smallest(x):
        return next(q for q in range(1, len(x) + 1) if all(x[i] == x[i + q] for i in range(len(x) - q)))

    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, 2 * q) and smallest(words[i:j + q]) == q:
                out.append((i, j - i + q, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def kept_words(words, runs):
    gone = {k for start, length, period in runs for k in range(start + period, start + length)}
    return [w for k, w in enumerate(words) if k not in gone]


@pytest.mark.parametrize("seed", range(40))
def test_runs_of_random_sequences(seed):
    rng = np.random.default_rng(seed)
    for _ in range(25):
        s = rng.integers(0, rng.integers(1, 4), rng.integers(0, 70))
        least = int(rng.integers(2, 15))
        assert [tuple(r) for r in periodic.find_runs(s, least).tolist()] == brute_runs(s.tolist(), least)


@pytest.mark.parametrize("together", [1, 60, 1 << 15])
def test_runs_stay_in_their_texts(together, monkeypatch):
    monkeypatch.setattr(periodic, "TOGETHER", together)
    rng = np.random.default_rng(together)
    words, text, want = [], [], []
    for t in range(40):
        w = rng.integers(0, rng.integers(1, 9), rng.integers(0, 80))
        a, p = len(w) // 3, 1 + len(w) // 7
        w = np.concatenate([w[:a], np.resize(w[a:a + p], len(w) - a)]) if rng.random() < 0.6 and len(w) else w
        want += [(len(text) + i, n, q) for i, n, q in brute_runs(w.tolist(), 12)]
        words += w.tolist()
        text += [t] * len(w)
    assert [tuple(r) for r in periodic.runs_of_words(np.array(words), np.array(text)).tolist()] == want


def test_extensions():
    rng = np.random.default_rng(5)
    s = rng.integers(0, 2, 300)
    i, j = rng.integers(0, 300, (2, 2000))
    i, j = i[i != j], j[i != j]
    got = periodic.Extensions(s).common(i, j)
    for a, b, n in zip(i.tolist(), j.tolist(), got.tolist()):
        k = 0
        while max(a, b) + k < 300 and s[a + k] == s[b + k]:
            k += 1
        assert n == k


def test_periodic_runs(spark, docs):
    def expected(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        runs = brute_runs(words, 12)
        return len(words), tuple(runs), " ".join(kept_words(words, runs))

    got = periodic.periodic_runs(docs).collect()
    assert Counter((r.doc_id, r.n_words, tuple(tuple(x) for x in r.runs), r.collapsed) for r in got) == Counter((i, *expected(t)) for i, t in TEXTS)
    cut = periodic.collapse(docs)
    assert cut.columns == docs.columns
    want = Counter((i, t if not expected(t)[1] else expected(t)[2], 7, "other") for i, t in TEXTS)
    assert Counter((r.doc_id, r.text, r.n_words, r[4]) for r in cut.collect()) == want
    assert periodic.periodic_runs(docs.limit(0)).count() == 0


def test_periodic_query_repeats_the_words_that_it_should(spark, tmp_path):
    rows = [(i, prose(i, i % 97)) for i in range(300)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = set()
    for i, t in rows:
        w, h = t.split(), zlib.crc32(str(i).encode())
        g, n = h // 10, len(w)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
        runs = brute_runs(w, 12)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
        lines = "".join(f"{a},{b},{c}\n" for a, b, c in runs)
        want.add((
            i, len(runs), *best, 1000 * best[1] // best[2] if runs else None, hashlib.sha256(lines.encode()).hexdigest(),
            hashlib.sha256(" ".join(kept_words(w, runs)).encode()).hexdigest(),
        ))
    assert {tuple(r) for r in QUERIES["op11_periodic_runs"](spark, str(tmp_path)).collect()} == want
    assert sum(r[1] > 0 for r in want) > 10


def brute_copies(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    for body, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        for k, i in enumerate(sorted(ids, key=lambda i: (i is None, i or 0))):
            yield i, keep, len(ids), k == 0, hashlib.sha256(body.encode()).hexdigest()


def weak(body):
    return F.encode((F.length(body) % 3).cast("string"), "utf-8")


@pytest.mark.parametrize("how", [{}, {"digest": weak}, {"batch_bytes": 1}])
def test_exact_duplicates(spark, docs, tmp_path, how, monkeypatch):
    monkeypatch.setattr(exact_copies, "SHARE", 5)            # hot and cold groups
    path = f"{tmp_path}/rows.parquet"
    docs.write.parquet(path)
    before = [spark.conf.get(k, None) for k in exact_copies.STATE]
    got = exact_copies.exact_duplicates(spark, path, **how).collect()
    assert [spark.conf.get(k, None) for k in exact_copies.STATE] == before
    found = Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got)
    assert found == Counter(brute_copies(TEXTS))
    rows = spark.read.parquet(path)
    source = rows.metadataColumn("_metadata")
    texts = {(r.path, r.row): r.text for r in rows.select("text", source["file_path"].alias("path"), source["row_index"].alias("row")).collect()}
    for r in got:                                             # the locator leads to a text like the row's own
        body = re.sub(r"[\x20\x09-\x0D]+", " ", texts[r.keep_path, r.keep_row] or "")
        assert hashlib.sha256(body.encode()).hexdigest() == r.text_sha256


def test_state_goes_on_with_new_files(spark, docs, tmp_path):
    path, state = f"{tmp_path}/rows.parquet", f"{tmp_path}/state"
    docs.where("doc_id > 8").write.parquet(path)
    exact_copies.exact_duplicates(spark, path, checkpoint=state).collect()
    docs.where("doc_id <= 8 OR doc_id IS NULL").write.mode("append").parquet(path)
    got = exact_copies.exact_duplicates(spark, path, checkpoint=state).collect()
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got) == Counter(brute_copies(TEXTS))
    kept = exact_copies.read_state(spark, state)
    assert kept.agg(F.sum("size")).first()[0] == len(TEXTS) and kept.count() == len({r.text_sha256 for r in got})


def test_exact_duplicates_of_nothing_and_of_one_file(spark, docs, tmp_path):
    docs.limit(0).write.parquet(f"{tmp_path}/none.parquet")
    assert exact_copies.exact_duplicates(spark, f"{tmp_path}/none.parquet").count() == 0
    assert exact_copies.exact_duplicates(spark, "/root/testdata/sf0.001/region.parquet", "r_regionkey", "r_name").where("kept").count() == 5


TARGET = [(1, prose(2, 30)), (2, None), (3, "LA la, été!"), (None, prose(3, 7)), (5, "")]


def brute_resample(rows, target, percent, least, longest, seed=2024, buckets=10_000):
    def features(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
        return len(w), [zlib.crc32(" ".join(w[i:i + k]).encode()) % buckets for k in range(1, longest + 1) for i in range(len(w) - k + 1)]

    source, goal = Counter(), Counter()
    for _, t in rows:
        source.update(features(t)[1])
    for _, t in target:
        goal.update(features(t)[1])
    n, m = source.total(), goal.total()
    gain = {b: math.floor(1000 * math.log((goal[b] + 1) * (n + buckets) / ((source[b] + 1) * (m + buckets)))) for b in source}
    out = []
    for i, t in rows:
        words, found = features(t)
        weight = sum(gain[b] for b in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, words, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2], r[1]))
    drawn = able[:percent * len(able) // 100]
    rest = Counter(out) - Counter(drawn)
    return Counter([(*r, k + 1) for k, r in enumerate(drawn)]) + Counter({(*r, None): c for r, c in rest.items()})


@pytest.mark.parametrize("percent, least, longest", [(10, 20, 1), (50, 1, 3), (100, 2, 2), (0, 20, 1)])
def test_resample(spark, docs, percent, least, longest):
    target = spark.createDataFrame([(i, t, 1) for i, t in TARGET], "item_id long, text string, c1 int")
    want = brute_resample(TEXTS, TARGET, percent, least, longest)
    got = resample.resample(docs, target, percent=percent, least=least, longest=longest)
    assert Counter(tuple(r) for r in got.collect()) == want
    drawn = resample.draw(docs, target, percent=percent, least=least, longest=longest)
    assert drawn.columns == docs.columns
    assert Counter(r.doc_id for r in drawn.collect()) == Counter(k[0] for k in want.elements() if k[5] is not None)


def test_resample_of_nothing(spark, docs):
    target = spark.createDataFrame(TARGET, "item_id long, text string")
    assert resample.resample(docs.limit(0), target).count() == 0
    assert resample.resample(docs, target.limit(0)).count() == len(TEXTS)


def test_checksums_and_bit_slices():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 256, 5000, np.uint8)
    starts = rng.integers(0, 4900, 400)
    ends = starts + rng.integers(1, 100, 400)
    assert resample.crc32_ranges(data, starts, ends).tolist() == [zlib.crc32(data[a:b]) for a, b in zip(starts, ends)]
    gain = rng.integers(-20_000, 20_000, 10_000)
    found = np.concatenate([rng.integers(0, 10_000, 3000), np.full(5000, 17)])
    owner = np.sort(rng.integers(0, 5, 8000))
    sums = resample.bit_sliced_sums(found, owner, 6, resample.gain_planes(gain), 10_000)
    assert sums.tolist() == [int(gain[found[owner == k]].sum()) for k in range(6)]


def brute_top(rows, k):
    out = set()
    for i, q in rows:
        if i % 20 == 0:
            scores = sorted((-int(np.dot(q, v)), j) for j, v in rows if j != i)[:k]
            out |= {(i, n + 1, j, -s) for n, (s, j) in enumerate(scores)}
    return out


def test_top_k_over_blocks_of_norms(spark, monkeypatch):
    """Many blocks, of which those of small norms are skipped, zero vectors among them."""
    monkeypatch.setattr(topk, "BLOCK", 30)
    monkeypatch.setattr(topk, "QUERIES", 5)
    rng = np.random.default_rng(4)
    rows = [(i, np.floor(64 * rng.normal(0, 1, 6) * (0.01 if i % 3 else 2)).astype(int)) for i in range(400)] + [(400, np.zeros(6, int)), (420, np.zeros(6, int))]
    df = spark.createDataFrame([(i, (v / 64).tolist()) for i, v in rows], "vec_id long, embedding array<double>").repartition(4)
    got = {tuple(r) for r in topk.top_k(df, F.col("vec_id") % 20 == 0, k=7).collect()}
    assert got == brute_top(rows, 7)


def test_lists_are_read_no_further_than_their_bound():
    rng = np.random.default_rng(6)
    vectors = rng.integers(-50, 50, (500, 4))
    lists = topk.Lists(np.arange(500), vectors)
    queries = rng.integers(-9, 9, (20, 4))
    scores = queries @ vectors.T
    for least in (np.sort(scores, 1)[:, -7], scores.max(1), scores.max(1) + 1, scores.min(1)):
        query, ids, found = lists.reaching(np.full(20, -1), queries, least, 500)
        assert {(q, i, s) for q, i, s in zip(query.tolist(), ids.tolist(), found.tolist())} == {
            (q, i, int(scores[q, i])) for q in range(20) for i in range(500) if scores[q, i] >= least[q]}
    heads = lists.bounds(queries, [1])[:, 0]
    assert len(lists.reaching(np.full(20, -1), queries, heads + 1, 5)[0]) == 0            # blocks are skipped by their heads alone


def test_large_groups_are_not_compared_pair_by_pair(spark, monkeypatch):
    """300 copies of one text, about six pairs in ten of them linked: the pairs looked at grow with the copies, not their square."""
    rng = np.random.default_rng(8)
    base = prose(30, 150, 10**6).split()
    rows = []
    for k in range(300):
        words = list(base)
        for at in rng.choice(150, int(rng.integers(0, 6)), replace=False):
            words[at] = f"new{k}x{at}"
        rows.append((k, " ".join(words)))
    pairs, keep = [], near_duplicates.stored

    def counted(df, name):
        out = keep(df, name)
        if name == "pairs":
            pairs.append(out.count())
        return out

    monkeypatch.setattr(near_duplicates, "stored", counted)
    got = near_duplicates.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    sets = [{tuple(w[i:i + 4]) for i in range(147)} for w in (t.split() for _, t in rows)]
    least = list(range(300))
    for a in range(300):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) and least[a] != least[b]:
                low, high = sorted((least[a], least[b]))
                least = [low if x == high else x for x in least]
    assert {(r.doc_id, r.component_id) for r in got.collect()} == set(enumerate(least))
    assert sum(pairs) < 40 * 300


@pytest.mark.parametrize("copies", [60, 120])
def test_a_shared_line_is_not_compared_by_pairs(spark, copies, monkeypatch):
    """Documents that share 42 words and nothing else: chains to align grow with the documents, not their square."""
    line, looked, keep = prose(50, 42, 10**6), [], chains.stored

    def counted(df, name):
        out = keep(df, name)
        if name == "passages":
            looked.append(out.count())
        return out

    monkeypatch.setattr(chains, "stored", counted)
    rows = [(i, f"{prose(100 + i, 60, 10**6)} {line} {prose(400 + i, 60, 10**6)}") for i in range(copies)]
    assert chains.fuzzy_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(2)).count() == 0
    assert sum(looked) <= 2 * copies


def test_bound_of_ends_never_loses_a_passage():
    rng = np.random.default_rng(11)
    pairs, found = [], 0
    for n in range(400):
        a = rng.integers(0, 1 << 31, 160).astype(np.uint32)
        b = a.copy()
        edits = rng.random(160) < rng.choice([0.05, 0.2, 0.3, 0.5])
        b[edits] = rng.integers(0, 1 << 31, int(edits.sum()))
        b[70:74] = a[70:74]
        low, high = sorted(rng.choice(np.arange(0, 160), 2, replace=False).tolist())
        b[:min(low, 70)], b[max(high, 74):] = 1, 2
        pairs.append((a, b, [(70, 70)]))
    cores = [chains.inner(*p) for p in pairs]
    near, far = [], []
    for (a, b, _), (x, i, y, j, _) in zip(pairs, cores):
        near += [a[:x][::-1], a[i:i + chains.REACH]]
        far += [b[:y][::-1], b[j:j + chains.REACH]]
    words, matched = chains.extensions(near, far)
    may = chains.within_reach(cores, matched[::2], matched[1::2])
    for n, (x, i, y, j, m) in enumerate(cores):
        passage = chains.widest((i - x, j - y, m), (words[2 * n], matched[2 * n]), (words[2 * n + 1], matched[2 * n + 1]))
        assert may[n] or not passage
        found += passage is not None
    assert 20 < found < 380 and 20 < may.sum() < 380


def test_chance_phrases_are_dropped_before_words_are_sent(spark, monkeypatch):
    """Documents that share four words and no passage: no chain of theirs is stored, and stored chains hold no words."""
    line, kept, keep = prose(60, 4, 10**6), [], chains.stored

    def looked_at(df, name):
        out = keep(df, name)
        if name == "passages":
            kept.append((out.count(), set(out.columns)))
        return out

    monkeypatch.setattr(chains, "stored", looked_at)
    passage = prose(61, 70, 10**6)
    rows = [(i, f"{prose(500 + i, 60, 10**6)} {passage if i in (3, 9) else line} {prose(700 + i, 60, 10**6)}") for i in range(40)]
    got = chains.fuzzy_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(2)).collect()
    assert [(r.doc_id, r.start_word, r.end_word, r.source_id, r.source_start, r.matched) for r in got] == [(9, 60, 130, 3, 60, 70)]
    assert sum(n for n, _ in kept) <= 2 and not any(columns & {"words", "source", "around"} for _, columns in kept)


def test_seeds_of_many_texts_are_those_of_each():
    rng = np.random.default_rng(5)
    for vocabulary in (2, 9, 10**6):
        sizes = np.concatenate([[0, 3, 4, 5, 7, 0], rng.integers(0, 60, 30)])
        first = np.concatenate([[0], np.cumsum(sizes)])
        words = rng.integers(0, 1 << 60, vocabulary).astype(np.uint64)[rng.integers(0, vocabulary, first[-1])]
        key, place, doc = chains.all_seeds(words, first)
        for d, (a, b) in enumerate(zip(first[:-1], first[1:])):
            n = b - a - chains.SEED + 1
            grams = chains.hash_ranges(words[a:b], np.arange(max(n, 0)), np.arange(max(n, 0)) + chains.SEED, chains.BASE)
            wide = min(chains.WINDOW, n)
            least = {min(grams[i:i + wide].tolist()) for i in range(n - wide + 1)} if n > 0 else set()
            assert list(zip(place[doc == d].tolist(), key[doc == d].tolist())) == [(i, g) for i, g in enumerate(grams.tolist()) if g in least]


def test_chains_and_pairs_go_in_shares(spark, monkeypatch):
    """Of more text than a share, no stored table has all chains or all pairs of seeds, and the passages are the same."""
    one, two = (prose(62 + k, 90, 10**6).split() for k in range(2))
    rows = [(i, " ".join([prose(800 + i, 40, 10**6), *(one[:45], two[45:], one[45:], two[:45])[i % 4], prose(900 + i, 40, 10**6)])) for i in range(8)]
    rows += [(i, " ".join([prose(800 + i, 40, 10**6), *(one, two)[i % 2], prose(900 + i, 40, 10**6)])) for i in range(8, 40)]
    docs, keep, got = spark.createDataFrame(rows, "doc_id long, text string").repartition(2).cache(), chains.stored, []
    for share in (1 << 30, 2000):
        sizes = {}

        def counted(df, name):
            out = keep(df, name)
            sizes.setdefault(name, []).append(out.count())
            return out

        monkeypatch.setattr(chains, "stored", counted)
        monkeypatch.setattr(chains, "GROUPS", (share, 4))
        monkeypatch.setattr(chains, "PASSES", (share, 8))
        got.append((sorted(map(tuple, chains.fuzzy_passages(docs, chunk_bytes=500, bucket_keys=100).collect())), sizes))
    (rows, whole), (same, shares) = got
    assert rows == same and len({r[0] for r in rows}) > 20
    assert sum(shares["passages"][:4]) == whole["passages"][0] and max(shares["passages"][:4]) < 0.7 * whole["passages"][0]
    first = shares["asks"][0::2][:8]
    assert sum(first) == whole["asks"][0] and max(first) < 0.5 * whole["asks"][0]
