"""SimHash fingerprints and components against brute force."""

import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from millrace.llm import graph, simhash
from millrace.llm.queries import op8_simhash


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_links(prints, radius=3):
    return [(a, b) for i, a in enumerate(prints) for b in prints[:i] if (a ^ b).bit_count() <= radius]


def brute_components(texts):
    prints = {i: brute_fingerprint(t) for i, t in texts.items()}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in brute_links(sorted(set(prints.values()))):
        parent[find(a)] = find(b)
    least = {}
    for i, p in prints.items():
        least[find(p)] = min(i, least.get(find(p), i))
    return {i: least[find(p)] for i, p in prints.items()}


M = (1 << 64) - 1


def brute_wide(text, n=5):
    """The wide fingerprint, as one integer of 256 bits: SplitMix64 of each distinct shingle's hash."""
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    grams = {" ".join(words[i : i + n]) for i in range(len(words) - n + 1)} or ({" ".join(words)} if words else set())
    counts = [0] * 256
    for g in grams:
        state = xxhash.xxh64_intdigest(g.encode(), 42)
        for w in range(4):
            state = z = (state + 0x9E3779B97F4A7C15) & M
            z = (z ^ z >> 30) * 0xBF58476D1CE4E5B9 & M
            z = (z ^ z >> 27) * 0x94D049BB133111EB & M
            z ^= z >> 31
            for b in range(64):
                counts[64 * w + b] += z >> b & 1
    return sum(1 << b for b in range(256) if 2 * counts[b] > len(grams))


def brute_near(x, y, radius=45, half=45):
    d = x ^ y
    words = [d >> 64 * w & M for w in range(4)]
    met = any(
        (words[w] >> 21 * i & (1 << 21) - 1).bit_count() <= 1 and sum(words[(w + k) % 4].bit_count() for k in (1, 2)) <= half
        for w in range(4) for i in range(3)
    )
    return met and d.bit_count() <= radius


def shingles(text, n=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} or {tuple(words)} - {()}


def jaccard(one, two):
    return len(one & two) / len(one | two) if one or two else 1.0


def brute_copies(texts):
    """For a dict of id and text: the smallest id that each can reach over candidates of at least 0.8."""
    sets = {i: shingles(t) for i, t in texts.items()}
    return brute_groups({i: brute_wide(t) for i, t in texts.items()}, lambda i, j, x, y: brute_near(x, y, 53, 30) and jaccard(sets[i], sets[j]) >= 0.8)


def brute_groups(prints, near=lambda i, j, x, y: brute_near(x, y)):
    """For a dict of id and fingerprint: the smallest id that each can reach."""
    root = {i: i for i in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(prints)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            a, b = find(i), find(j)
            if a != b and near(i, j, prints[i], prints[j]):
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def as_longs(x):
    return [(v := x >> 64 * w & M) - (1 << 64 if v >> 63 else 0) for w in range(4)]


def test_wide_fingerprints():
    rng = random.Random(3)
    texts = ["", " ", "One two", "one TWO three four five", "a b c d e " * 40] + [" ".join(rng.choice("abcdé") for _ in range(rng.randrange(60))) for _ in range(60)]
    for t in texts:
        assert simhash.wide_simhash(t.encode()) == as_longs(brute_wide(t))
    assert simhash.bits_apart(0.8) == 53 and simhash.bits_apart(0.8, 128) == 30 and simhash.bits_apart(1.0) == 0


def test_wide_groups_of_families_chains_and_crowded_parts(spark):
    rng = random.Random(4)
    flip = lambda x, n: x ^ sum(1 << b for b in rng.sample(range(256), n))
    prints = [rng.getrandbits(256) for _ in range(40)] + [0, (1 << 256) - 1]
    for size, bits in ((150, 20), (80, 30), (60, 60)):  # a family that all hangs together, one less so, one hardly
        base = rng.getrandbits(256)
        prints += [flip(base, rng.randrange(1, bits)) for _ in range(size)]
    one = rng.getrandbits(256)
    for _ in range(15):  # a chain
        one = flip(one, 30)
        prints.append(one)
    shared = rng.getrandbits(21)  # a part that unlike families share
    for _ in range(6):
        base = rng.getrandbits(256) >> 21 << 21 | shared
        prints += [flip(base >> 21, 12) << 21 & (1 << 256) - 1 | shared for _ in range(8)]
    known = dict(enumerate(dict.fromkeys(prints)))
    df = spark.createDataFrame([(i, as_longs(x)) for i, x in known.items()], "node long, fp array<long>")
    got = {r.node: r.root for r in simhash.wide_roots(df, 45).collect()}
    want = brute_groups(known)
    assert len(set(want.values())) > 50 and {i: got.get(i, i) for i in known} == want

    shown = []

    def alike(pairs):
        shown.extend(map(tuple, pairs.collect()))
        return pairs.filter("(a + b) % 3 = 0")

    got = {r.node: r.root for r in simhash.wide_roots(df, 45, 20, alike).collect()}
    assert {i: got.get(i, i) for i in known} == brute_groups(known, lambda i, j, x, y: (i + j) % 3 == 0 and brute_near(x, y, 45, 20))
    assert len(shown) == len(set(shown)) and all(a > b and brute_near(known[a], known[b], 45, 20) for a, b in shown)


def test_wide_fingerprints_of_long_texts_have_no_blocks(monkeypatch):
    text = " ".join(random.Random(6).choices("abcde", k=3000))
    whole = simhash.wide_simhash(text.encode())
    assert whole == as_longs(brute_wide(text))
    monkeypatch.setattr(simhash, "BLOCK", 100)
    assert simhash.wide_simhash(text.encode()) == whole


def test_a_family_under_the_similarity_is_refused_by_sketches(spark):
    """Thirty texts of about 0.68 with one another: their pairs aren't shown to ``alike``, but that of the two of 0.9 is."""
    r = random.Random(8)
    words = [f"w{r.randrange(10**6)}" for _ in range(400)]

    def changed(of: list[str], places: int) -> list[str]:
        own = list(of)
        for i in r.sample(range(0, 400, 5), places):
            own[i] = f"x{r.randrange(10**6)}"
        return own

    texts = [changed(words, 8) for _ in range(30)]
    texts.append(changed(texts[0], 4))
    longs = simhash.LONGS + simhash.SKETCH
    df = spark.createDataFrame([(i, simhash.wide_simhash(" ".join(t).encode(), longs=longs)) for i, t in enumerate(texts)], "node long, fp array<long>")
    asked = {}

    def counted(name: str):
        def alike(pairs):
            rows = [(p.a, p.b) for p in pairs.collect()]
            asked.setdefault(name, []).extend(rows)
            return spark.createDataFrame([p for p in rows if p == (30, 0)], "a long, b long")

        return alike

    bits = simhash.bits_apart
    without = {x.node: x.root for x in simhash.wide_roots(df, bits(0.8), bits(0.8, 128), counted("without")).collect()}
    got = {x.node: x.root for x in simhash.wide_roots(df, bits(0.8), bits(0.8, 128), counted("with"), bits(0.8, 64 * simhash.SKETCH)).collect()}
    assert got == without == {i: 0 if i == 30 else i for i in range(31)}
    assert set(asked["with"]) <= set(asked["without"]) and 4 * len(asked["with"]) < len(asked["without"]), {k: len(v) for k, v in asked.items()}


def test_parities_never_refuse_sets_that_are_alike():
    rng = np.random.default_rng(9)
    for size, own in ((0, 1), (3, 0), (150, 10), (150, 40), (900, 300), (20_000, 3000)):
        shared = rng.integers(0, 1 << 63, size, dtype=np.uint64)
        one, two = (np.unique(np.concatenate([shared, rng.integers(0, 1 << 63, own, dtype=np.uint64)])) for _ in range(2))
        a, b = simhash.parities(one), simhash.parities(two)
        apart = sum(((x ^ y) & M).bit_count() for x, y in zip(a[:-1], b[:-1], strict=True))
        differ = len(np.setxor1d(one, two))
        assert len(a) == simhash.PARITY + 1 and a[-1] == len(one) and apart <= differ and (differ - apart) % 2 == 0
        assert differ > 100 or apart >= differ - 12  # little falls together


def test_texts_compared_grow_with_a_family_not_with_its_pairs(spark, monkeypatch):
    """Copies of one text with up to four changed words, of about 0.6 to 0.9 with one another: half and whole of them."""
    rng, texts = random.Random(10), []
    base = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    for _ in range(160):
        own = list(base)
        for i in rng.sample(range(150), rng.randrange(1, 5)):
            own[i] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(own))
    roots, shown = simhash.wide_roots, []

    def counted(prints, radius, half, alike, *more):
        def count(pairs):
            shown[-1] += pairs.count()
            return alike(pairs)

        return roots(prints, radius, half, count, *more)

    monkeypatch.setattr(simhash, "wide_roots", counted)
    for n in (80, 160):
        shown.append(0)
        docs = spark.createDataFrame(list(enumerate(texts[:n])), "doc_id long, text string")
        got = {r.doc_id: r.component_id for r in simhash.near_copies(docs).collect()}
        assert got == brute_copies(dict(enumerate(texts[:n])))
    assert shown[0] <= 3 * 80 and shown[1] <= 3 * 160, shown


def test_near_copies_hold_to_the_similarity(spark):
    rng = random.Random(7)
    texts = []
    for size in (12, 40, 300):  # around the threshold, in families
        for _ in range(6):
            base = [f"w{rng.randrange(900)}" for _ in range(size)]
            texts.append(" ".join(base))
            for share in (0.01, 0.02, 0.03, 0.04, 0.06):
                texts.append(" ".join(w if rng.random() > share else f"x{rng.randrange(900)}" for w in base))
    texts += ["a b c d e", "A b c D e", "a b c d e f", "", " \t", "one"]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(0, texts[0]), (None, texts[1])], "doc_id long, text string")
    rows = simhash.near_copies(docs).collect()
    want = brute_copies(dict(enumerate(texts)))
    assert {r.doc_id: r.component_id for r in rows if r.doc_id is not None} == want and len(rows) == len(texts) + 2
    assert 20 < len(set(want.values())) < len(texts) - 20


def test_near_copies_of_five_word_shingles(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(4000)]
    texts = [" ".join(rng.choices(words, k=200)) for _ in range(40)]
    near = [t.replace(t.split()[100], "changed", 1) for t in texts[:20]]  # 191 of 201 shingles: 0.95
    half = [" ".join(t.split()[:100] + rng.choices(words, k=100)) for t in texts[20:]]
    docs = spark.createDataFrame(list(enumerate(texts + near + half)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.near_copies(docs).collect()}
    assert got == {i: i - 40 if 40 <= i < 60 else i for i in range(80)}
    assert sorted(r.doc_id for r in simhash.keep_one(docs).collect()) == [*range(40), *range(60, 80)]


def test_fingerprints():
    rng = random.Random(1)
    texts = ["", " \t\n", "One", "one TWO", "ÉÄ one two Three four", "a b c d " * 50, "x\x1cy z w v", "\x0b\x0ca b"]
    texts += [" ".join(rng.choice(["the", "of", "Moss", "é"]) for _ in range(rng.randrange(30))) for _ in range(200)]
    for t in texts:
        assert simhash.simhash(t.encode()) & (1 << 64) - 1 == brute_fingerprint(t)
    long = " ".join(rng.choice("abcdefg") * 4 for _ in range(260_000))
    assert simhash.simhash(long.encode()) & (1 << 64) - 1 == brute_fingerprint(long)


def test_links_of_sparse_and_crowded_fingerprints(spark):
    rng = random.Random(2)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    prints = {rng.getrandbits(64) for _ in range(60)} | {0, (1 << 64) - 1, 1 << 63}
    base = rng.getrandbits(64)
    for _ in range(250):  # families: few weak bits, many members
        x = base
        for b in (1, 5, 17, 31, 33, 40, 52, 60, 63):
            x ^= rng.getrandbits(1) << b
        prints.add(x)
    prints |= {x ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64) for x in list(prints)[:80]}
    df = spark.createDataFrame([(signed(x),) for x in prints] * 2 + [(None,)], "fingerprint long")
    want = {tuple(sorted((signed(a), signed(b)))) for a, b in brute_links(sorted(prints))}
    for radius, segments, crowded in ((3, 2, 64), (3, 2, 3), (3, 4, 10_000), (2, 2, 5)):
        expected = want if radius == 3 else {(a, b) for a, b in want if ((a ^ b) & (1 << 64) - 1).bit_count() <= radius}
        got = [tuple(r) for r in simhash.links(df, radius=radius, segments=segments, crowded=crowded).collect()]
        assert len(got) == len(set(got)) and set(got) == expected


def test_components_of_paths_stars_and_cycles(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(200, 201), (201, 202), (202, 200), (5, 5), (None, 3), (300, 299), (300, 299)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 140)} | {i: 200 for i in range(200, 203)} | {299: 299, 300: 299}


def test_nulls_repeats_and_clashes(spark):
    rows = [(5, None), (7, ""), (None, " "), (3, "a b c d"), (3, "a b c d"), (9, "A b C d"), (None, "lonely words stand here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("component_id", F.lit("clash"))
    got = sorted(map(tuple, simhash.near_duplicates(docs).select("doc_id", "component_id").collect()), key=str)
    assert got == sorted([(5, 5), (7, 5), (None, 5), (3, 3), (3, 3), (9, 3), (None, None)], key=str)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.filter("doc_id is not null").collect()) == [3, 5]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0 and simhash.keep_one(docs.limit(0)).count() == 0


def test_query_over_a_whole_table(spark, sf_dir):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    want = brute_components(texts)
    rows = op8_simhash(spark, sf_dir).collect()
    assert {r.doc_id: r.component_id for r in rows} == want and len(rows) == len(want)
    assert all(r.fingerprint == f"{brute_fingerprint(texts[r.doc_id]):016x}" for r in rows)
