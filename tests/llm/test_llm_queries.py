"""The thin queries against brute force over the smallest tables."""

import hashlib
import math
import re
import zlib
from collections import Counter

import public_tokenizers
import pytest
import xxhash
from compare import oracle_rows, spark_rows

from spanloom.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, sf, name):
    assert spark_rows(queries.QUERIES[name](spark, sf)) == oracle_rows(queries.ORACLE_SQL[name], sf)


def simhash(text):
    w = [x for x in re.split(rb"[\x20\x09-\x0d]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), text.encode())) if x]
    if not w:
        return 0
    sh = [b" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or [b" ".join(w)]
    h = [xxhash.xxh64(s, seed=42).intdigest() for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_op1(spark, sf, docs):
    fp = {i: simhash(t) for i, t in docs}
    group = {i: i for i in fp}

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for a in fp:
        for b in fp:
            if a < b and (fp[a] ^ fp[b]).bit_count() <= 2:
                x, y = find(a), find(b)
                group[max(x, y)] = min(x, y)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op1_simhash(spark, sf).collect()}
    assert got == {i: (f"{fp[i]:016x}", find(i)) for i in fp}


def test_op2(spark, sf, docs):
    from spanloom.llm import audio

    for r in queries.op2_audio(spark, sf).collect():
        raw = dict(docs)[r.doc_id].encode()
        data = raw + b" " * ((-len(raw)) % 192 or (192 if not raw else 0))
        assert (r.n_bytes, r.payload_bytes) == (len(raw), len(data))
        assert r.payload_sha256 == hashlib.sha256(data).hexdigest() and r.tail_crc32 == zlib.crc32(data[-16:])
        media = audio.wav(data)
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())


def plain_feature(text):
    """The feature column stated plainly: zero-stuffed convolution, a Fourier sum for each frame, a state machine for the spans."""
    import numpy as np
    import pyarrow as pa

    from spanloom.llm import audio

    raw = text.encode()
    data = raw.ljust(max(1, -(-len(raw) // 192)) * 192, b" ")
    x = np.frombuffer(data, np.uint8) / 128 - 1
    wide = np.zeros(2 * len(x))
    wide[::2] = x
    taps = audio.lowpass(2, 3)
    y = np.convolve(wide, taps)[len(taps) // 2 :][: len(wide)][::3]
    frames = max(1, -(-len(y) // 80))
    y = np.append(y, np.zeros(max(0, (frames - 1) * 80 + 200 - len(y))))
    wave = np.exp(-2j * np.pi * np.outer(np.arange(200), np.arange(129)) / 256)
    bank = audio.mel_bank(8000.0)
    mel = np.array([10 * np.log10(np.abs((y[80 * k : 80 * k + 200] * np.hanning(200)) @ wave) ** 2 @ bank + 1e-6) for k in range(frames)])
    tenths = np.rint(mel * 10).astype(np.int16)
    level = tenths.mean(1) / 10
    level = np.round(level - np.round(level.mean(), 3), 3)
    spans, start, quiet = [], None, 0
    for k, v in enumerate(level):
        if start is None:
            if v >= 1:
                start, quiet = k, 0
        else:
            quiet = quiet + 1 if v < -1 else 0
            if quiet == 3:
                spans.append((start, k - 2))
                start = None
    spans += [(start, frames)] if start is not None else []
    tiles = -(-frames // 32)
    cells = np.zeros((tiles * 32, 20), np.int16)
    cells[:frames] = tenths
    kind = pa.fixed_shape_tensor(pa.int16(), (32, 20))
    tensor = pa.ExtensionArray.from_storage(kind, pa.FixedSizeListArray.from_arrays(pa.array(cells.ravel()), 640))
    begin = np.arange(tiles) * 32 * 0.01
    schema = pa.schema([("mel", kind), ("start_s", pa.float64()), ("end_s", pa.float64())])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, schema) as writer:
        writer.write_batch(pa.record_batch([tensor, pa.array(begin), pa.array(np.minimum(begin + 32 * 0.01, frames * 0.01))], schema=schema))
    stamps = ",".join(f"{round(a * 0.01, 6)}-{round(b * 0.01, 6)}" for a, b in spans)
    return f"{frames};{hashlib.sha256(sink.getvalue().to_pybytes()).hexdigest()};{stamps}"


def test_op2_features(spark, sf, docs):
    got = {r.doc_id: r.feature for r in queries.op2_audio(spark, sf).collect()}
    for i, text in docs[:60]:
        assert got[i] == plain_feature(text)


def test_op6(spark, sf, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want, total = {}, 0
    for i, text in docs:
        ids = [*t.encode(text, add_special_tokens=False).ids, 2]
        total += len(ids)
        first = (len(ids) - 1) % 1024 + 1
        for p, (a, b) in enumerate(zip([0, *range(first, len(ids), 1024)], [*range(first, len(ids) + 1, 1024)], strict=True)):
            want[i, p] = (a, b - a, zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[a:b])))
    rows = queries.op6_packing(spark, sf).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want and len(rows) == len(want)
    seqs = {}
    for r in rows:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in seqs.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 1024
    assert len(seqs) <= math.ceil(total / 1024) * 1.01 + 1


def test_op8(spark, sf, docs):
    rules = [("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12), ("access", "AKIA[A-Z0-9]+", 0, 18), ("hex", "[0-9a-f]+", 0, 16)]
    for r in queries.op8_secrets(spark, sf).collect():
        found = [(m.start(), k, m.end(), kind) for k, (kind, p, g, least) in enumerate(rules) for m in re.finditer(p, dict(docs)[r.doc_id]) if len(m[g]) >= least]
        base = ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in sorted(found))
        n = Counter(x[3] for x in found)
        assert (r.n_assign, r.n_access, r.n_hex) == (n["assign"], n["access"], n["hex"])
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest() and set(filter(None, base.split(","))) <= set(r.spans.split(","))


def test_op9(spark, sf, docs):
    tokens = lambda t: [*(w for w in re.split(r"[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)) if w), None]
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in docs}
    c = Counter(w for i, t in docs if not held[i] for w in tokens(t))
    n, v = sum(c.values()), len(c)
    rows = queries.op9_ppm(spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        w = tokens(dict(docs)[r.doc_id])
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(w), sum(c[x] > 0 for x in w), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), rel=1e-9)
    # under three bits a byte on texts that were not read, where blind guessing takes eight
    out = [r for r in rows if r.held_out]
    assert -sum(r.score for r in out) / math.log10(2) < 3 * sum(len(dict(docs)[r.doc_id].encode()) for r in out)


def test_op9_scores_equal_the_plain_trie(spark, sf, docs):
    from spanloom.llm import lm

    trie = lm.Trie(4)
    for i, text in docs:
        if zlib.crc32(str(i).encode()) % 5 != 1:
            context = (lm.START,) * 4
            for code in (*text.encode(), lm.END):
                trie.learn(context, code)
                context = (*context, code)[1:]
    got = {r.doc_id: r.score for r in queries.op9_ppm(spark, sf).collect()}
    some = sorted(docs, key=lambda d: len(d[1]))[:120]
    assert {zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in some} == {True, False}
    for i, text in some:
        assert got[i] == pytest.approx(trie.text(text.encode(), learn=False), rel=1e-9)


def test_op7_probabilities_equal_plain_sums(spark):
    """Each link's sum over a text's set of words, link after link, for every text."""
    from spanloom.llm import toxicity

    folder = "/root/testdata/sf0.01"
    d = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    labels, names = queries.label_table(spark, folder), ["low_quality", "toxic"]
    chain = toxicity.train(d, labels, names)
    texts = {r.doc_id: r.text for r in d.collect()}
    for r in queries.op7_toxicity(spark, folder).collect():
        words = {xxhash.xxh64_intdigest(w) for w in re.split(rb"[^a-z\x80-\xff]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (texts[r.doc_id] or "").encode())) if w}
        earlier = []
        for link in chain:
            z = link.bias + sum(w for h, w in zip(link.words.tolist(), link.weights.tolist(), strict=True) if h in words) + sum(a * b for a, b in zip(earlier, link.earlier.tolist(), strict=True))
            earlier.append(1 / (1 + math.exp(-max(-40, min(40, z)))))
        assert (r.p_low_quality, r.p_toxic) == pytest.approx(tuple(earlier), abs=3e-9) and r.toxic == (r.p_toxic >= 0.3)


def test_op7_sample_is_bounded(spark):
    """An id in many rows, or in many labels, is one row of the sample."""
    from spanloom.llm import toxicity

    d = spark.createDataFrame([(1, f"text {k}") for k in range(300)] + [(2, "other"), (3, "third")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (3, 0)], "doc_id long, y int")
    seen = []
    fit = toxicity.fit_chain
    toxicity.fit_chain = lambda docs, y: seen.append(docs.n) or fit(docs, y)
    try:
        toxicity.train(d, labels, ["y"], sample=2)
        toxicity.train(d, labels, ["y"])
    finally:
        toxicity.fit_chain = fit
    assert seen == [2, 3]


def test_op7_held_out(spark):
    """Models of one half of the labels find the toxic texts of the other half."""
    from spanloom.llm import toxicity

    folder = "/root/testdata/sf0.01"
    d = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    labels = queries.label_table(spark, folder)
    got = toxicity.judge(d, labels.filter("doc_id % 2 = 0"), ["low_quality", "toxic"], reject="toxic").join(labels.filter("doc_id % 2 = 1").selectExpr("doc_id", "toxic AS truth"), "doc_id").collect()
    hit, miss, wrong = (sum(1 for r in got if (r.toxic, r.truth) == x) for x in ((True, 1), (False, 1), (True, 0)))
    assert hit >= 0.55 * (hit + miss) and wrong <= 0.02 * len(got)


def test_op4_finds_whole_and_edited_copies(spark):
    from spanloom.llm import decontaminate

    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"
    words = item.split()
    edited = " ".join("changed" if k % 6 == 5 else w for k, w in enumerate(words))
    rows = [(1, f"before {item.upper()}, after"), (2, f"x y {edited} z"), (3, "alpha beta gamma delta and nothing else of it at all"), (4, None), (5, ""), (6, " ".join(reversed(words)))]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(7, item), (8, None), (9, ""), (10, item)], "item_id long, text string")
    for block in (1, 1 << 20):
        got = {r.doc_id: [(x.item, round(x.similarity, 2)) for x in r.leaks] for r in decontaminate.with_leaks(d, items, block_bytes=block).collect()}
        assert got[1] == [(7, 1.0), (10, 1.0)] and [i for i, s in got[2]] == [7, 10] and all(s > 0.7 for _, s in got[2])
        assert all(not got[k] for k in (3, 4, 5, 6))


def test_op4_against_all_alignments(spark, sf, docs):
    """Every text with every item: what reaches the least similarity by alignment alone is found, and nothing else."""
    from spanloom.llm import decontaminate

    rng = __import__("random").Random(4)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()][:40]
    edited = [" ".join(w if rng.random() > k / 60 else f"new{rng.random()}" for w in items[k][1].split()) for k in range(20)]
    texts = [t for _, t in docs[:30]] + [f"{docs[k][1][:300]} {t} {docs[k][1][:200]}" for k, t in enumerate(edited)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r.doc_id, x.item): x.similarity for r in decontaminate.with_leaks(df, spark.createDataFrame(items, "item_id long, text string"), block_bytes=4000).collect() for x in r.leaks}
    want = {}
    for i, text in items:
        seeds = decontaminate.Seeds([(i, text)], 3)
        for k, t in enumerate(texts):
            ids = seeds.hits([t.encode()])[0]
            s = decontaminate.align(ids, seeds.items[0][1]) / (2 * len(seeds.items[0][1]))
            if s >= 0.5:
                want[k, i] = s
    assert len(want) >= 15 and got == want


def test_op4_finds_every_fourth_word_changed(spark):
    from spanloom.llm import decontaminate

    words = [f"word{k}" for k in range(40)]
    d = spark.createDataFrame([(1, " ".join("new" if k % 4 == 3 else w for k, w in enumerate(words)))], "doc_id long, text string")
    (row,) = decontaminate.with_leaks(d, spark.createDataFrame([(7, " ".join(words))], "item_id long, text string")).collect()
    assert [x.item for x in row.leaks] == [7]


def test_op4_finds_edited_copies_however_many(spark):
    from spanloom.llm import decontaminate

    words = [f"word{k}" for k in range(40)]
    edited = " ".join("changed" if k % 5 == 4 else w for k, w in enumerate(words))
    items = spark.createDataFrame([(7, " ".join(words))], "item_id long, text string")
    for n in (32, 100, 400):
        d = spark.createDataFrame([(k, f"text {k} {edited} ends") for k in range(n)] + [(-1, "word0 word1 word2 word3 alone")], "doc_id long, text string")
        got = {r.doc_id: [(x.item, round(x.similarity, 2)) for x in r.leaks] for r in decontaminate.with_leaks(d, items).collect()}
        assert got.pop(-1) == [] and len(got) == n and all(x == [(7, 0.71)] for x in got.values())


def test_op4_spares_no_alignment_that_could_reach_the_least():
    import numpy as np

    from spanloom.llm.decontaminate import MATCH, Seeds, align

    rng = np.random.default_rng(5)
    seeds = Seeds([(0, " ".join(f"w{k % 7}" for k in range(20)))], 4)
    words = seeds.items[0][1]
    for _ in range(200):
        window = rng.integers(0, 8, rng.integers(1, 60))
        assert seeds.reachable(0, window) >= align(window, words) / (MATCH * len(words))


def test_smith_waterman():
    import numpy as np

    from spanloom.llm.decontaminate import align

    def plain(a, b):
        h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a, 1):
            for j, y in enumerate(b, 1):
                h[i][j] = max(0, h[i - 1][j - 1] + (2 if x == y else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
        return max(map(max, h))

    rng = np.random.default_rng(3)
    for _ in range(200):
        a, b = rng.integers(0, 4, rng.integers(1, 14)), rng.integers(1, 4, rng.integers(1, 9))
        assert align(a, b) == plain(a.tolist(), b.tolist())


def test_op10_rules_of_the_contract(spark, tmp_path):
    """Each rule by its own word, and the longest of two."""
    want = {
        "http://a.com/en/1": ("com/en/", "block"), "http://x.example.com/en/77": ("example.com/en/7", "allow"), "http://b.example.net/de/7": ("net/de/", "allow"),
        "http://example.net/de/81": ("example.net/de/8", "block"), "http://c.org/es/": ("org/es/", "block"), "http://c.org/de/": (None, "allow"), "nourl": (None, "allow"),
    }
    spark.createDataFrame(list(enumerate(want)), "page_id long, url string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {r.page_id: (r.rule, r.verdict) for r in queries.op10_urls(spark, str(tmp_path)).collect()}
    assert got == dict(enumerate(want.values()))
