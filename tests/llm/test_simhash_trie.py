import numpy as np
import xxhash

from tidemark.llm import simhash_trie


def brute_fingerprint(text):
    words = [w for w in "".join(c.lower() if c.isascii() else c for c in (text or "")).replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def brute(rows):
    fps = {i: brute_fingerprint(t) for i, t in rows}
    up = {i: i for i in fps}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(fps)
    for a in ids:
        for b in ids:
            if a < b and (fps[a] ^ fps[b]).bit_count() <= 3:
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i: (f"{fps[i]:016x}", root(i)) for i in ids}


def test_against_brute_force(docs, sample):
    for frame in (docs, sample):
        rows = [(r.doc_id, r.text) for r in frame.select("doc_id", "text").collect()]
        got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash_trie.near_duplicates(frame).collect()}
        assert got == brute(rows)


def test_links_of_random_fingerprints(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 40, dtype=np.int64)
    fps = {int(b) for b in base}
    for b in base.tolist():
        for n in (1, 2, 3, 4, 5):
            x = b
            for bit in rng.choice(62, n, replace=False).tolist():
                x ^= 1 << bit
            fps.add(x)
    fps = sorted(fps)
    frame = spark.createDataFrame(list(enumerate(fps)), "_rep long, _fp long")
    for hot in (20_000, 2):
        edges = [(r.a, r.b) for r in simhash_trie.links(frame, 3, hot).collect()]
        assert all((fps[a] ^ fps[b]).bit_count() <= 3 for a, b in edges)
        up = list(range(len(fps)))

        def root(x):
            while up[x] != x:
                x = up[x]
            return x

        for a, b in edges:
            up[root(a)] = root(b)
        for a in range(len(fps)):
            for b in range(a):
                if (fps[a] ^ fps[b]).bit_count() <= 3:
                    assert root(a) == root(b)


def test_empty_and_kept(docs, nothing):
    assert simhash_trie.near_duplicates(nothing).collect() == []
    kept = simhash_trie.keep_one_of_near(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c in brute([(r.doc_id, r.text) for r in docs.collect()]).values()})
