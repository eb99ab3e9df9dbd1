import numpy as np
import xxhash
from conftest import DATA
from edge import documents, empty

from sheetwright.llm import simhash as S
from sheetwright.llm.common import table


def slow_fingerprint(text):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[k : k + 4]) for k in range(max(1, len(w) - 3))] if w else []
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(fps, radius=4):
    f = np.array(fps, np.uint64)
    near, label = np.bitwise_count(f[:, None] ^ f[None, :]) <= radius, np.arange(len(f))
    while True:
        new = np.where(near, label[None, :], len(f)).min(1)
        if (new == label).all():
            return label.tolist()
        label = new


def check(df, got):
    texts = [(r["doc_id"], r["text"]) for r in df.collect()]
    fps = [slow_fingerprint(t) for _, t in texts]
    of = slow_components(fps)
    least = {}
    for (i, _), c in zip(texts, of, strict=True):
        if i is not None:
            least[c] = min(least.get(c, i), i)
    want = sorted((repr(i), f, repr(least.get(c))) for (i, _), f, c in zip(texts, fps, of, strict=True))
    assert sorted((repr(r["doc_id"]), r["fp"] % 2**64, repr(r["component_id"])) for r in got) == want


def test_query_table(spark):
    df = table(spark, f"{DATA}/sf0.001", "documents")
    check(df, S.near_duplicates(df).collect())


def test_edges(spark):
    df = documents(spark, extra=[(None, "only this one has no id", None, None, None), (None, "only this one has no id", None, None, None)])
    check(df, S.near_duplicates(df).collect())
    assert S.near_duplicates(empty(spark)).count() == 0


def test_spark_hashes_alike(spark):
    from pyspark.sql import functions as F

    assert spark.range(1).select(F.xxhash64(F.lit("a b c é"))).first()[0] % 2**64 == xxhash.xxh64_intdigest("a b c é".encode(), seed=42)


def test_long_text():
    text = " ".join(f"w{k * k % 977}" for k in range(150_000))
    raw = [xxhash.xxh64_intdigest(" ".join(x).encode(), seed=42) for x in zip(*(text.split()[k:] for k in range(4)), strict=False)]
    bits = np.unpackbits(np.array(raw, ">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=int)
    assert S.fingerprint(text.encode()) == int("".join("1" if 2 * b > len(raw) else "0" for b in bits), 2)


def test_units_and_chunks(spark):
    """Clusters of near fingerprints, in chunks far smaller than a bucket, give the components of all pairs."""
    rng = np.random.default_rng(5)
    centre = rng.integers(0, 2**63, 40, dtype=np.uint64)
    fps = rng.choice(centre, 600)
    for _ in range(3):
        fps ^= np.uint64(1) << rng.integers(0, 64, 600).astype(np.uint64)
    fps = np.unique(np.concatenate((fps, fps[:50] ^ np.uint64(0b1111), rng.integers(0, 2**63, 300, dtype=np.uint64))))
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    for chunk in (3, 4096):
        got = {r["v"]: r["root"] for r in S.components(S.links(df, chunk=chunk)).collect()}
        of = slow_components(fps)
        groups = {}
        for x, c in zip(fps.view(np.int64).tolist(), of, strict=True):
            groups.setdefault(c, []).append(x)
        want = {x: min(g) for g in groups.values() if len(g) > 1 for x in g}
        assert got == want


def test_long_chains(spark):
    chain = [0]
    for k in range(200):
        chain.append(chain[-1] ^ (0b1111 << (k * 4 % 60)) ^ 0)
    edges = spark.createDataFrame([(a, a + 1) for a in range(300)] + [(1000, 1001), (1001, 1002)], "a long, b long")
    got = {r["v"]: r["root"] for r in S.components(edges).collect()}
    assert got == {**dict.fromkeys(range(301), 0), 1000: 1000, 1001: 1000, 1002: 1000}


def test_close_words_gives_up_no_near_word():
    rng = np.random.default_rng(1)
    fp = rng.integers(0, 2**63, 256, dtype=np.uint64)
    fp[100:140] = fp[7] ^ (np.uint64(1) << np.arange(40, dtype=np.uint64))
    row, word = (x.ravel() for x in np.meshgrid(np.arange(256), np.arange(4), indexing="ij"))
    for radius in (0, 3, 4, 7, 8, 21, 31, 40):
        index, bits = S.close_words(fp[:, None], S.bit_planes(fp[:, None]), row, word, radius)
        near = np.unpackbits(bits.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        got = {(int(row[i]), int(word[i]) * 64 + int(r)) for i, r in zip(index[np.nonzero(near)[0]], np.nonzero(near)[1], strict=True)}
        want = {(int(a), int(b)) for a, b in zip(*np.nonzero(np.bitwise_count(fp[:, None] ^ fp[None, :]) <= radius), strict=True)}
        assert got == want
