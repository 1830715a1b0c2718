"""Operators over whole tables against brute force on a small, messy table."""

from __future__ import annotations

import collections
import hashlib
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from answerlog.llm import jaccard_join, substring_dedup, suffix_dedup, textkit, topk_search, url_filters
from answerlog.llm.components import components

WHITE = " \t\n\x0b\x0c\r"


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))


# n-gram Jaccard join


def shingles_of(text, width=5):
    words = words_of(text)
    if len(words) < width:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def plain_components(rows, percent=75):
    """Per row: number of shingles and smallest id reachable (None if there is none)."""
    sets = [shingles_of(text) for _, text in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    members = collections.defaultdict(list)
    for i in range(len(rows)):
        members[find(i)].append(rows[i][0])
    least = {r: min((x for x in ids if x is not None), default=None) for r, ids in members.items()}
    return [(rows[i][0], len(sets[i]), least[find(i)] if sets[i] else rows[i][0]) for i in range(len(rows))], root, find


def check_join(df, rows, **more):
    found = jaccard_join.jaccard_join(df, **more).collect()
    got = collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in found)
    assert got == collections.Counter(plain_components(rows)[0])


def test_join_equals_all_pairs(messy, messy_rows):
    check_join(messy, [r[:2] for r in messy_rows])


def test_join_with_split_blocks_and_without_broadcasts(messy, messy_rows, monkeypatch):
    monkeypatch.setattr(jaccard_join, "PART", 4)
    monkeypatch.setattr(jaccard_join, "SMALL", 3)
    monkeypatch.setattr(jaccard_join, "BROADCAST", 0)
    check_join(messy, [r[:2] for r in messy_rows])


def near_copies(count, seed, rate):
    rng = np.random.default_rng(seed)
    base = [f"w{i}" for i in rng.integers(0, 10**6, 120)]
    texts = []
    for _ in range(count):
        change = rng.random(len(base)) < rate
        texts.append(" ".join(f"x{rng.integers(0, 10**6)}" if c else w for w, c in zip(base, change)))
    return texts


def test_join_of_copies_around_the_threshold(spark, monkeypatch):
    """Copies of which many pairs lie just above and just below the similarity."""
    monkeypatch.setattr(jaccard_join, "PART", 30)
    texts = near_copies(90, 3, 0.02) + near_copies(60, 4, 0.035) + near_copies(10, 5, 0.0)
    rows = list(enumerate(texts))
    check_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), rows)


def test_one_document_of_each_group(messy, messy_rows, empty):
    kept = jaccard_join.keep_one(messy)
    assert kept.columns == messy.columns
    rows = [r[:2] for r in messy_rows]
    _, _, find = plain_components(rows)
    groups = collections.defaultdict(list)
    for i, row in enumerate(rows):
        groups[find(i)].append(row)
    order = lambda r: (r[0] is None, r[0] or 0)
    want = collections.Counter()
    for own in groups.values():
        if shingles_of(own[0][1]):
            want[min(own, key=order)] += 1
        else:
            want.update(own)
    assert collections.Counter((r.doc_id, r.text) for r in kept.collect()) == want
    assert jaccard_join.keep_one(empty).count() == 0
    assert jaccard_join.jaccard_join(empty).count() == 0


def test_tree_finds_what_a_scan_finds():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 2**62, rng.integers(1, 90)).astype(np.uint64)) for _ in range(150)]
    for i in range(60):
        drop = rng.random(len(sets[i])) < 0.1
        sets.append(np.unique(np.concatenate([sets[i][~drop], rng.integers(0, 2**62, 3).astype(np.uint64)])))
    points, sizes = np.array([jaccard_join.count_vector(s) for s in sets]), np.array([len(s) for s in sets])
    tree = jaccard_join.CountTree(points, sizes)
    for q in range(len(sets)):
        near = set(tree.near(points[q], int(sizes[q]), 75).tolist())
        bound = np.minimum(points, points[q]).astype(int).sum(1)
        fits = (bound >= jaccard_join.needed(sizes, sizes[q], 75)) & (100 * np.minimum(sizes, sizes[q]) >= 75 * np.maximum(sizes, sizes[q]))
        assert near == set(np.flatnonzero(fits).tolist())
        for j, other in enumerate(sets):
            both = len(np.intersect1d(sets[q], other))
            if 100 * both >= 75 * (len(sets[q]) + len(other) - both):
                assert j in near


def test_bounds_of_full_counts():
    many = np.arange(300, dtype=np.uint64) << np.uint64(31)  # all in one group
    vector = jaccard_join.count_vector(many)
    assert vector.max() == 255
    assert jaccard_join.overlap_bound(vector[None], vector)[0] >= 300
    large = jaccard_join.count_vector(np.unique(np.random.default_rng(1).integers(0, 2**62, 20_000).astype(np.uint64)))
    assert len(large) == 2048 and jaccard_join.folded(large, 128).shape == (128,)


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(8, 40)] + [(50, 51), (51, 52), (5, 5)]
    found = {r.v: r.comp for r in components(spark.createDataFrame(edges, "x long, y long")).collect()}
    assert all(found[i] == 100 for i in range(100, 161))
    assert all(found[i] == 7 for i in range(7, 40)) and found[52] == 50 and 5 not in found


# suffix-array dedup


def plain_kept(texts, length):
    raw = [(t or "").encode() for t in texts]
    counts = collections.Counter(x[i : i + length] for x in raw for i in range(len(x) - length + 1))
    result = []
    for x in raw:
        gone = np.zeros(len(x) + 1, int)
        for i in range(len(x) - length + 1):
            if counts[x[i : i + length]] > 1:
                gone[i] += 1
                gone[i + length] -= 1
        gone = np.cumsum(gone[:-1]) > 0
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        result.append((len(x), int(gone.sum()), spans, np.frombuffer(x, np.uint8)[~gone].tobytes()))
    return result


@pytest.mark.parametrize("more", [{}, {"hot": 2, "shard": 4000}, {"length": 40, "gram": 12, "shard": 3000}, {"length": 30, "gram": 30, "hot": 5}])
def test_suffix_dedup_equals_brute_force(messy, messy_rows, more):
    want = plain_kept([r[1] for r in messy_rows], more.get("length", 200))
    want = collections.Counter((r[0], *w) for r, w in zip(messy_rows, want))
    found = suffix_dedup.suffix_dedup(messy, **more).collect()
    assert collections.Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in found) == want


def test_suffix_dedup_empty_and_payload(messy, empty):
    assert suffix_dedup.suffix_dedup(empty).count() == 0
    digest = F.sha2("kept", 256).alias("kept_sha256")
    short = suffix_dedup.suffix_dedup(messy, payload=digest).collect()
    whole = suffix_dedup.suffix_dedup(messy).collect()
    assert collections.Counter(r.kept_sha256 for r in short) == collections.Counter(
        hashlib.sha256(r.kept).hexdigest() for r in whole
    )


@pytest.mark.parametrize("alphabet", [b"a", b"ab", b"abcdefgh"])
def test_suffix_array_and_common_prefixes(alphabet):
    rng = np.random.default_rng(len(alphabet))
    data = np.frombuffer(bytes(rng.choice(list(alphabet), 700).astype(np.uint8)), np.uint8)
    raw, depth = data.tobytes(), 32
    order = suffix_dedup.suffix_array(data, depth)
    cut = [raw[i : i + depth] for i in order]
    assert sorted(order.tolist()) == list(range(700)) and cut == sorted(cut)
    starts, counts = np.array([0, 250, 500]), np.array([200, 150, 160])
    valid = np.concatenate([np.arange(a, a + c) for a, c in zip(starts, counts)])
    order = order[np.isin(order, valid)]
    shared = suffix_dedup.common_prefixes(data, suffix_dedup.packed(data), order, starts, counts, depth)
    for before, place in zip(order[:-1], order[1:]):
        same = next((k for k in range(depth) if raw[before + k : before + k + 1] != raw[place + k : place + k + 1]), depth)
        assert shared[place] == same


def peak_of(work):
    tracemalloc.start()
    try:
        return work(), tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_shards_hold_little_memory():
    rng = np.random.default_rng(5)
    bodies = [rng.integers(97, 123, 300, np.uint8).tobytes() for _ in range(16_000)]
    bodies[15_999] = bodies[15_998][:250] + bodies[15_999][:50]
    rows = [(i // 2, i.to_bytes(4, "big"), body) for i, body in enumerate(bodies)]
    kinds = {"hash": pa.int64(), "name": pa.binary(), "snippet": pa.binary()}

    def batches():
        for at in range(0, len(rows), 1000):
            columns = zip(*rows[at : at + 1000])
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds.values())], list(kinds))

    shards = suffix_dedup._shards(200, suffix_dedup.SHARD)
    found, peak = peak_of(lambda: [row for batch in shards(batches()) for row in batch.to_pylist()])
    name = [i.to_bytes(4, "big") for i in (15_998, 15_999)]
    assert [(r["hash"], r["name"], r["a"], r["b"]) for r in found] == [(7999, n, 0, 50) for n in name]
    assert peak < 150_000_000


def test_shards_merge_in_blocks_of_windows():
    rng = np.random.default_rng(6)
    bodies = [rng.integers(97, 99, 455, np.uint8).tobytes() for _ in range(200)]
    for i in range(0, 100, 3):
        bodies[100 + i] = bodies[100 + i][:100] + bodies[i][:300] + bodies[100 + i][:55]
    counts = collections.Counter(x[a : a + 200] for x in bodies for a in range(256))
    left, right = suffix_dedup.Shard(bodies[:100], 200), suffix_dedup.Shard(bodies[100:], 200)
    mine, theirs = right.windows(range(100)), left.windows(range(100))
    _, peak = peak_of(lambda: right.merge(left, mine, theirs))
    assert len(mine) == 25_600 and peak < 25_000_000
    for i, body in enumerate(bodies):
        marked = {a for first, last in (left, right)[i // 100].intervals(i % 100) for a in range(first, last + 1)}
        assert marked == {a for a in range(256) if counts[body[a : a + 200]] > 1}


# substring dedup


def sentences(text, longest):
    parts = re.findall(r"[^ \t\n\x0b\x0c\r]+[ \t\n\x0b\x0c\r]*", text)
    lead, out, current = text[: len(text) - sum(map(len, parts))], [], []
    for part in parts:
        word = part.rstrip(WHITE)
        current.append((word, (lead if not out and not current else "") + part))
        if word[-1] in ".!?" or "\n" in part[len(word) :]:
            out.append(current)
            current = []
    cut = []
    for own in out + [current] * bool(current):
        cuts = {0, len(own)}
        if len(own) > longest:  # after the word of least hash of each window
            data = "".join(w for w, _ in own).encode()
            stops = np.cumsum([len(w.encode()) for w, _ in own])
            hashes = textkit.span_hashes(np.frombuffer(data, np.uint8), np.append(0, stops[:-1]), stops, False) >> np.uint64(32)
            for i in range(len(own) - longest + 1):
                cuts.add(min(range(i, i + longest), key=lambda j: (hashes[j], -j)) + 1)
        cuts = sorted(cuts)
        cut += [own[i:j] for i, j in zip(cuts, cuts[1:])]
    return cut


def plain_cut(rows, least, words, longest):
    cut = {(d, t or ""): sentences(t or "", longest) for d, t in rows}
    places = collections.defaultdict(list)
    for key, own in cut.items():
        sizes = [len(x) for x in own]
        spans = set()
        for i in range(len(own)):
            for step in (1, -1):  # the shortest span from a sentence on, and up to it
                j, size = i, sizes[i]
                while (size < words or abs(j - i) + 1 < least) and 0 <= j + step < len(own):
                    j += step
                    size += sizes[j]
                if size >= words and abs(j - i) + 1 >= least:
                    spans.add((min(i, j), max(i, j)))
        for i, j in sorted(spans):
            places[tuple(w for s in own[i : j + 1] for w, _ in s)].append((key, i, j))
    return cut, places


@pytest.mark.parametrize("rule", [(2, 20, 16), (3, 1, 5), (1, 4, 100)])
def test_substring_dedup_equals_brute_force(messy, messy_rows, rule):
    least, words, longest = rule
    rows = [r[:2] for r in messy_rows]
    cut, places = plain_cut(rows, *rule)
    found = substring_dedup.substring_dedup(messy, least=least, words=words, longest=longest)
    assert found.columns == [*messy.columns, "dedup"]
    got = collections.defaultdict(list)
    for r in found.collect():
        got[r.doc_id, r.text or ""].append(r.dedup)
    assert sum(map(len, got.values())) == len(rows)
    # The order of rows that share an id is by hash, so their turn is read off the result.
    gone = collections.defaultdict(set)
    for own in places.values():
        if len(own) > 1:
            order = lambda p: (p[0][0] is None, p[0][0] or 0, p[1])
            own.sort(key=order)
            ties = [p for p in own if p[0][0] == own[0][0][0]]
            if len({p[0] for p in ties}) == 1:
                for key, i, j in own[1:]:
                    gone[key].update(range(i, j + 1))
            else:
                gone[None].add(own[0][0][0])
    for key, own in cut.items():
        if key[0] in gone[None] or key[0] is None:
            continue
        left = "".join(x for i, s in enumerate(own) if i not in gone[key] for _, x in s) if gone[key] else key[1]
        for dedup in got[key]:
            assert (dedup.text or "", dedup.n_removed, dedup.n_sentences) == (left, len(gone[key]), len(own))


def test_passages_are_cut_once(spark, monkeypatch):
    """Repeats go in all places but the first, also without the broadcast list. Sentences at
    the end of a passage from which no whole span starts are covered by those before."""
    passage = (
        "One two three four five six. Seven eight nine ten eleven twelve thirteen. "
        "Fourteen fifteen sixteen seventeen eighteen nineteen. And this ends it."
    )
    rows = [(i, f"Own start number {i} a{i} b{i}. {passage} Own end c{i} d{i}.") for i in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for bound in (4_000_000, -1):
        monkeypatch.setattr(substring_dedup, "BROADCAST", bound)
        found = {r.doc_id: r.dedup.text for r in substring_dedup.substring_dedup(df).collect()}
        assert found[0] == rows[0][1]
        assert all(found[i] == f"Own start number {i} a{i} b{i}. Own end c{i} d{i}." for i in range(1, 6))


def test_passages_go_wherever_they_begin(spark):
    """A passage without full stops at all offsets of texts without full stops."""
    rng = np.random.default_rng(6)
    passage = [f"p{i}" for i in rng.integers(0, 400, 60)]
    rows = [(i, " ".join([*(f"a{i}x{j}" for j in range(i)), *passage, *(f"b{i}x{j}" for j in range(40))])) for i in range(24)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r.dedup.text.split() for r in substring_dedup.substring_dedup(df).collect()}
    assert found[0] == rows[0][1].split()
    for i in range(1, 24):
        own = rows[i][1].split()
        assert [w for w in found[i] if w[0] != "p"] == [w for w in own if w[0] != "p"]
        assert len(own) - len(found[i]) >= 60 - 2 * 16 + 1


def test_content_cuts_equal_a_plain_loop():
    rng = np.random.default_rng(8)
    for longest in (1, 2, 5, 16):
        hashes = substring_dedup.mix(rng.integers(0, 30, 400).astype(np.uint64))
        starts = np.unique(np.append(rng.integers(0, 400, 14), 0))
        want = set()
        for low, high in zip(starts, np.append(starts[1:], 400)):
            for i in range(low, high - longest + 1 if high - low > longest else low):
                want.add(min(range(i, i + longest), key=lambda j: (hashes[j] >> np.uint64(32), -j)) + 1)
        found = substring_dedup.content_cuts(hashes, starts, longest)
        assert set(found.tolist()) == want - {400}
        assert np.diff(np.union1d(np.append(starts, 400), found)).max() <= longest


def test_exact_copies_lose_all_sentences(spark):
    """Also closing sentences of fewer words than a span has."""
    text = "One two three four five six. " * 3 + "Seven eight nine ten eleven twelve thirteen fourteen. Now stop. The end."
    rows = [(i, text) for i in range(3)] + [(3, f"{text} Own words."), (4, f"Own start. {text}")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r.dedup for r in substring_dedup.substring_dedup(df).collect()}
    assert found[0].text == text and found[0].n_removed == 0
    assert all(found[i].text == "" and found[i].n_removed == found[i].n_sentences for i in (1, 2))
    assert (found[3].text, found[4].text) == ("Own words.", "Own start. ")


@pytest.mark.parametrize("rule", [(2, 20, 16), (3, 1, 5), (1, 4, 100)])
def test_spans_cover_every_repeated_run(spark, messy_rows, rule):
    least, words, longest = rule
    # In a text of one word again and again, runs of equal words have different sentences.
    rows = [r[:2] for r in messy_rows[:80] if r[1] is not None and len(r[1]) < 6000 and r[1][:9] != "Le Le Le "]
    cut = {d: sentences(t, longest) for d, t in rows}
    places = collections.defaultdict(list)
    for d, own in cut.items():
        for i in range(len(own)):
            run = ()
            for j in range(i, len(own)):
                run += tuple(w for w, _ in own[j])
                if j - i + 1 >= least and len(run) >= words:
                    places[hash(run)].append((d, i, j))
    gone = collections.defaultdict(set)
    for own in places.values():
        for d, i, j in sorted(own)[1:]:
            gone[d].update(range(i, j + 1))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = substring_dedup.substring_dedup(df, least=least, words=words, longest=longest)
    for r in found.collect():
        own = cut[r.doc_id]
        left = "".join(x for i, s in enumerate(own) if i not in gone[r.doc_id] for _, x in s) if gone[r.doc_id] else r.text
        assert (r.dedup.text, r.dedup.n_removed, r.dedup.n_sentences) == (left, len(gone[r.doc_id]), len(own))


def test_substring_dedup_of_empty_tables(empty):
    assert substring_dedup.substring_dedup(empty).count() == 0


# url filters

URLS = [
    "https://www.Example.COM/en/x?q#f", "http://example.com/en/", "http://a.example.com/en/y", "https://x.com", "https://x.com/",
    "http://b.net/es/1", "http://b.net/fr", "http://casino.b.net/en/1", "https://m.casino.org/x", "ftp://good.org/a/b", "no scheme",
    "", None, "://", "http://casino", "x://a://b/c", "http://" + "l" * 300 + ".org/", "http://a..b.org/", "https://casino.org?x=/",
]


def plain_url(url, rules, listed):
    match = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
    host, path = ("".join(c.lower() if c.isascii() else c for c in match[1]), match[2]) if match else ("", "")
    fits = [
        (len(rule), rule, verdict) for verdict, rule in rules
        for domain, rest in [rule.split("/", 1)]
        if (host == domain or host.endswith("." + domain)) and path.startswith("/" + rest)
    ]
    labels = host.split(".")
    keys = [".".join(labels[i:]) for i in range(max(1, len(labels) - 1))] if host and len(host) <= 253 else [host] * bool(host)
    hit = next((k for k in keys if k in listed), None)
    rule = max(fits)[1:] if fits else (None, "block" if hit else "allow")
    return host, path, rule[0], hit, rule[1]


@pytest.mark.parametrize("limit, shard_keys", [(1 << 25, 500_000), (1 << 25, 3), (0, 4)])
def test_url_filters(spark, limit, shard_keys):
    from answerlog.llm.queries import URL_RULES

    urls = URLS + [f"http://h{i}.site{i % 7}.org/p" for i in range(60)] + [URLS[0]]
    pages = spark.createDataFrame([(i, u, "old", 1) for i, u in enumerate(urls)], "page_id long, url string, host string, key int")
    listed = {"casino.org", "casino.b.net", "site3.org", "h1.site1.org", "nowhere.org", "l" * 300 + ".org"}
    keys = spark.createDataFrame([(k,) for k in [*listed, None, ""]], "k string")
    found = url_filters.url_filters(pages, keys, URL_RULES, shard_keys=shard_keys, limit=limit)
    assert set(found.columns) == {"page_id", "url", "key", "host", "path", "rule", "listed_key", "verdict"}
    got = {r.page_id: (r.host, r.path, r.rule, r.listed_key, r.verdict) for r in found.collect()}
    assert got == {i: plain_url(u, URL_RULES, listed) for i, u in enumerate(urls)}


def test_cascade_is_exact_on_its_universe():
    rng = np.random.default_rng(1)
    for count, share in ((2000, 0.1), (2000, 0.9), (50, 0.5), (10, 0.0), (10, 1.0)):
        one, two = (rng.integers(0, 2**63, count).astype(np.uint64) for _ in range(2))
        listed = rng.random(count) < share
        levels = [row[1:] for row in url_filters._build(0, one, two, listed)]
        assert (url_filters._listed(levels, one, two) == listed).all()
        if share == 0.1:
            assert len(levels) > 1 and sum(len(x[3]) for x in levels) < count


def test_urls_of_empty_tables(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    keys = spark.createDataFrame([("a.org",)], "k string")
    assert url_filters.url_filters(pages, keys, []).count() == 0
    one = spark.createDataFrame([(1, "http://a.org/x")], "page_id long, url string")
    assert url_filters.url_filters(one, keys.limit(0), []).first().verdict == "allow"


# exact top-k search


def plain_best(rows, k, factor=256):
    vectors = {}
    for i, v in rows:
        if i is None or not v or any(x is None or not np.isfinite(x) for x in v):
            continue
        own = [int(np.floor(factor * x)) for x in v]
        vectors[i] = min(vectors.get(i, own), own)
    best = []
    for q, own in vectors.items():
        if q % 50 == 0:
            scores = [(-sum(a * b for a, b in zip(own, v)), i) for i, v in vectors.items() if i != q and len(v) == len(own)]
            best += [(q, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k])]
    return best


@pytest.mark.parametrize("more", [{}, {"k": 3, "block": 2, "bucket": 7, "focus": 2}, {"k": 40, "bucket": 5}])
def test_top_k(spark, more):
    rng = np.random.default_rng(7)
    rows = [(i, (rng.normal(size=8) * rng.choice([0.1, 1, 5])).tolist()) for i in range(260)]
    rows += [(300 + i, rows[50][1]) for i in range(4)] + [(50, rows[50][1]), (100, rows[3][1])]  # ties, repeated ids
    rows += [(400, None), (450, []), (500, [1.0] * 7 + [None]), (550, [float("nan")] * 8), (600, [float("inf")] * 8), (None, [1.0] * 8)]
    rows += [(650, [1.0, 2.0]), (651, [3.0, -1.0]), (700, [0.0] * 8), (750, [1e15] * 8), (751, [-1e15] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit("x"))
    found = topk_search.top_k(df, F.col("vec_id") % 50 == 0, **more).collect()
    low, high = np.iinfo(np.int64).min + 2, np.iinfo(np.int64).max
    want = [(q, r, i, max(low, min(high, s))) for q, r, i, s in plain_best(rows, more.get("k", 5))]
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in found if r.query_id != 750 and r.vec_id < 750) == sorted(
        x for x in want if x[0] != 750 and x[2] < 750
    )


def test_top_k_holds_one_block_of_queries(spark):
    """What is left to run reads the written blocks and carries no queries."""
    rows = [(i, [float(i % 7), 1.0, i / 100]) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = topk_search.top_k(df, F.col("vec_id") % 50 == 0, block=2)
    plan = found._jdf.queryExecution().toString()
    assert "MapInArrow" not in plan and "Union" not in plan
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in found.collect()) == sorted(plain_best(rows, 5))


def test_top_k_of_nothing(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert topk_search.top_k(none, F.col("vec_id") % 50 == 0).count() == 0
    lone = spark.createDataFrame([(0, [1.0])], "vec_id long, embedding array<double>")
    assert topk_search.top_k(lone, F.col("vec_id") % 50 == 0).count() == 0


def test_sets_of_batches_are_those_of_texts(messy_rows):
    from answerlog.llm.textkit import shingle_sets

    texts = [r[1] for r in messy_rows]
    for text, own in zip(texts, shingle_sets(pa.array(texts))):
        assert len(own) == len(shingles_of(text))
