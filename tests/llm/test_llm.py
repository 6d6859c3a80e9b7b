"""Training-data operators against brute force, round trips and held-out rows."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridspark.llm import attention_lm, components, decontaminate, line_dedup, lm_scoring, mixing, near_dedup, queries, shingles, shuffle_shards, tiff, token_files, toxicity, url_filter
from gridspark.llm.common import ascii_lower, held_out, word_count

tokenizers = pytest.importorskip("public_tokenizers")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, bucket int, size string"
LONG = " ".join(f"w{i % 977}x{i}" for i in range(20_000))
ODD = [None, "", " \t\n", "one", "One two three four", "one two three four", LONG, LONG + " end", "ß Straße é É x", "a b c d e f g", "a b c d e f g"]


def odd_docs(spark):
    """Nulls in every column, empty and long texts, ties, a repeated row, clashing names."""
    rows = [(i, t, None if i % 3 else "en", None if i % 2 else f"s{i % 4}", None, i, "x") for i, t in enumerate(ODD)]
    rows += [(None, "null key here", None, None, None, None, None), (3, "one", "en", "s1", None, 3, "x"), (3, "one", "en", "s1", None, 3, "x")]
    return spark.createDataFrame(rows, DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))


def documents(spark, sf):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}


# Shared parts


def test_words_and_folds(spark):
    df = odd_docs(spark)
    for r in df.select("text", word_count(F.col("text")).alias("n"), ascii_lower(F.col("text")).alias("low")).collect():
        assert r.n == len(words(r.text)) and r.low == (None if r.text is None else r.text.translate(FOLD))
    got = df.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("h")).collect()
    assert all(r.h == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)


def test_components_equal_union_find(spark):
    rng = np.random.default_rng(0)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (250, 2))] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 2000 + i) for i in range(200)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    got = {r.id: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in parent if root(x) != x}
    assert components.connected_components(spark.createDataFrame([(1, 1), (None, 2)], "a long, b long")).count() == 0


# 1 toxicity


def test_toxicity_learns_and_leaves_clean_texts(spark):
    rng = np.random.default_rng(3)
    vocabulary = [f"w{i}" for i in range(800)]
    bad = ["foulword", "meanword", "vileword"]
    rows = []
    for i in range(900):
        text, toxic = list(rng.choice(vocabulary, 60)), i % 5 == 0
        for _ in range(2 if toxic else 0):
            text.insert(int(rng.integers(len(text))), str(rng.choice(bad)))
        rows.append((i, " ".join(text), "en" if i % 2 else "de", int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, y int")
    labels = docs.select("doc_id", F.col("y").alias("toxic"))
    model = toxicity.train(docs, labels, lambda k: ~held_out(k, 4, 2))
    out = toxicity.classify(docs, model).where(held_out(F.col("doc_id"), 4, 2)).collect()
    hits = [(r.score >= 0.3) == bool(r.y) for r in out]
    assert len(out) > 150 and np.mean(hits) > 0.97
    assert all(0 <= r.score <= 1 for r in out)


def test_toxicity_edges(spark):
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 0)], "doc_id long, toxic int")
    model = toxicity.train(odd_docs(spark), labels, lambda k: F.lit(True))
    got = toxicity.classify(odd_docs(spark).withColumn("score", F.lit("old")), model)
    assert got.count() == len(ODD) + 3 and got.where("score IS NULL OR toxic IS NULL").count() == 0
    assert toxicity.classify(empty(spark), model).count() == 0


def test_best_threshold_takes_the_gap():
    p, y = np.array([0.9, 0.8, 0.2, 0.1]), np.array([1, 1, 0, 0])
    assert toxicity.best_threshold(p, y) == pytest.approx(0.5)


# 2 external shuffle


def test_shuffle_is_a_permutation_in_equal_runs(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = shuffle_shards.external_shuffle(docs, "doc_id", min_buckets=8, bucket_bytes=4096).collect()
    assert sorted(r.position for r in out) == list(range(docs.count()))
    per = defaultdict(list)
    for r in out:
        per[r.shard].append(r.slot)
    sizes = [len(v) for v in per.values()]
    assert len(per) == 16 and max(sizes) - min(sizes) <= 1 and all(sorted(v) == list(range(len(v))) for v in per.values())
    assert {r.doc_id: r.text for r in out} == documents(spark, sf)
    again = shuffle_shards.external_shuffle(docs.repartition(7), "doc_id", min_buckets=8, bucket_bytes=4096).collect()
    assert {r.doc_id: r.position for r in again} == {r.doc_id: r.position for r in out}


def test_shuffle_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    got = shuffle_shards.external_shuffle(docs, "doc_id", min_buckets=16).collect()
    own = defaultdict(list)
    for r in sorted(got, key=lambda r: r.doc_id):
        own[r.bucket].append(r.doc_id)
    order = [own[b][i] for b in sorted(own) for i in shuffle_shards.fisher_yates(len(own[b]), 17, b)]
    assert [r.doc_id for r in sorted(got, key=lambda r: r.position)] == order


def test_shuffle_edges(spark, tmp_path):
    out = shuffle_shards.external_shuffle(odd_docs(spark), "doc_id", min_buckets=4)
    assert sorted(r.position for r in out.collect()) == list(range(len(ODD) + 3))
    assert shuffle_shards.external_shuffle(empty(spark), "doc_id").count() == 0
    shuffle_shards.write_shards(out, str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).count() == len(ODD) + 3


# 3 TIFF


@pytest.mark.parametrize("n", [0, 1, 2, 3, 127, 128, 129, 130, 5000])
def test_codecs_round_trip(n):
    rng = np.random.default_rng(n)
    for data in (rng.integers(0, 256, n, dtype=np.uint8).tobytes(), rng.integers(97, 99, n, dtype=np.uint8).tobytes(), b"a" * n):
        for scheme in (tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS):
            assert tiff.decompress(tiff.compress(data, scheme), scheme) == data


@pytest.mark.parametrize("scheme", [tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS])
@pytest.mark.parametrize("tile", [0, 16])
def test_pages_of_many_layouts(scheme, tile):
    rng = np.random.default_rng(1)
    pages = [rng.integers(0, 256, shape, dtype=np.uint8) for shape in ((1, 1), (33, 17), (70, 64))]
    data = tiff.write_tiff(pages, scheme, 2, tile, 10)
    rows = list(tiff.pages_of(data))
    assert [(r[0], r[2], r[1]) for r in rows] == [(k, *p.shape) for k, p in enumerate(pages)]
    assert all(r[4] == p.tobytes() and r[6] is None for r, p in zip(rows, pages))


def test_predictors_and_byte_orders():
    import struct

    image = np.arange(12, dtype=">u2").reshape(3, 4) * 1000
    delta = np.concatenate((image[:, :1], np.diff(image, axis=1)), axis=1).astype(">u2").tobytes()
    fields = [(256, 3, 4), (257, 3, 3), (258, 3, 16), (259, 3, 1), (262, 3, 1), (273, 4, 8), (277, 3, 1), (278, 3, 3), (279, 4, len(delta)), (317, 3, 2)]
    head = b"MM\0*" + struct.pack(">I", 8 + len(delta)) + delta + struct.pack(">H", len(fields))
    data = head + b"".join(struct.pack(">HHI", t, k, 1) + (struct.pack(">HH", v, 0) if k == 3 else struct.pack(">I", v)) for t, k, v in fields) + b"\0\0\0\0"
    order, found = next(tiff.directories(data))
    assert tiff.read_page(data, order, found)[:, :, 0].tolist() == image.tolist()
    rows = np.array([[1.5, -2.25, 3.0], [0.0, 1e30, 7.0]], ">f4")
    planes = rows.view(np.uint8).reshape(2, 3, 4).transpose(0, 2, 1).reshape(2, 12)
    raw = np.concatenate((planes[:, :1], np.diff(planes, axis=1)), axis=1).astype(np.uint8).tobytes()
    page = tiff.read_page(raw, "<", {256: (3,), 257: (2,), 258: (32,), 259: (1,), 273: (0,), 279: (len(raw),), 278: (2,), 317: (3,), 339: (3,)})
    assert page[:, :, 0].tolist() == rows.astype("f4").tolist()


def test_bad_media_give_rows_with_errors(spark):
    good = tiff.text_to_tiff(b"x" * 700)
    df = spark.createDataFrame([(1, None), (2, b""), (3, b"II*\0"), (4, bytearray(good[:-40])), (5, bytearray(good))], "id int, media binary")
    rows = {r.id: r for r in tiff.decode_pages(df).collect()}
    assert all(rows[i].error and rows[i].page is None for i in (1, 2, 3, 4)) and rows[5].error is None


def test_texts_come_back(spark, sf):
    docs = documents(spark, sf)
    got = {r.doc_id: r for r in tiff.op3_tiff(spark, sf).collect()}
    for k, t in docs.items():
        raw = (t or "").encode()
        padded = raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64))
        r = got[k]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
    out = tiff.decode_pages(tiff.encode_texts(odd_docs(spark)))
    assert out.count() == len(ODD) + 3 and out.where("error IS NOT NULL").count() == 0 and tiff.encode_texts(empty(spark)).count() == 0


# 4 language model


def test_windows_score_each_place_once():
    lengths = np.array([1, 5, 32, 33, 58, 59, 200])
    at, scores = attention_lm.windows(np.zeros(lengths.sum(), int), lengths)
    assert sorted(at[scores].tolist()) == list(range(lengths.sum()))


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(0)
    texts = [np.append(rng.integers(0, 30, 50), 39) for _ in range(40)]
    counts = np.bincount(np.concatenate(texts), minlength=40).astype(float)
    model = attention_lm.AttentionLM(40, 39).fit(texts, counts)
    for start in ([], [3, 4, 5]):
        total = 0.0
        for i in range(40):
            ids = np.array([*start, i])
            whole = model.log10_probability(ids, np.array([len(ids)]))[0]
            before = model.log10_probability(np.array(start), np.array([len(start)]))[0] if start else 0.0
            total += 10 ** (whole - before)
        assert total == pytest.approx(1, abs=5e-3)


def test_base_equals_counting(spark, sf):
    docs = documents(spark, sf)
    got = {r.doc_id: r for r in lm_scoring.op4_attention_lm(spark, sf).collect()}
    out = lambda k: zlib.crc32(str(k).encode()) % 5 == 1
    c = Counter(w for k, t in docs.items() if not out(k) for w in [*words(t), None])
    n, v = sum(c.values()), len(c)
    for k, t in docs.items():
        tokens = [*words(t), None]
        r = got[k]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (out(k), len(tokens), sum(c[w] > 0 for w in tokens), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens))
        assert r.score < 0


def test_successors_come_from_all_documents(spark):
    rows = [(i, f"north wind {i % 7} south" + " west east" * (i % 3)) for i in range(40)] + [(40, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select(F.col("doc_id").alias("k"), (F.col("doc_id") % 5 == 1).alias("held"), F.col("text").cast("binary").alias("t"))
    path = tokenizers.path("word_bpe_49k.json")
    symbol = np.arange(49408) % 1000
    got = lm_scoring._successors(lm_scoring.packed(docs.repartition(3), path, 300), symbol, 49407)
    tokens, want = token_files.WordTokenizer(path, 1000), Counter()
    for k, t in rows:
        if k % 5 != 1:
            ids = [49407, *(int(i) for w in words(t) for i in np.frombuffer(tokens.words([w])[0], tokens.dtype)), 49407]
            want.update((a % 1000, b % 1000) for a, b in zip(ids, ids[1:]))
    assert Counter({(a, b): n for a, b, n in zip(*(x.tolist() for x in got))}) == want


def test_lm_edges(spark):
    path = tokenizers.path("word_bpe_49k.json")
    got = lm_scoring.score_texts(odd_docs(spark), lambda k: F.lit(True), path, 49407, pack_bytes=2000).collect()
    assert len(got) == len(ODD) + 3 and all(r.n_known == r.n_tokens for r in got)
    none = lm_scoring.score_texts(odd_docs(spark), lambda k: F.lit(False), path, 49407).collect()
    assert {r.train_tokens for r in none} == {0} and all(math.isfinite(r.score) and r.n_known == 0 for r in none)
    assert lm_scoring.score_texts(empty(spark), lambda k: F.lit(True), path, 49407).count() == 0


# 5 decontamination


def brute_contamination(text, items):
    cut = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate(FOLD))
    w, hit, found = cut(text), set(), set()
    for name, t in items:
        own = cut(t)
        for i in range(max(1, len(own) - 12) if own else 0):
            part = own[i : i + 13]
            for j in range(len(w) - len(part) + 1):
                if w[j : j + len(part)] == part:
                    hit |= set(range(j, j + len(part)))
                    found.add(str(name))
    return len(w), len(hit), sorted(found)


def test_contamination_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    w = lambda n: [f"v{i}" for i in rng.integers(0, 40, n)]
    items = [(i, " ".join(w(int(rng.integers(0, 30))))) for i in range(12)] + [(50, None), (51, "..."), (52, "v1, V2"), (53, "é")]
    docs = []
    for i in range(60):
        t = w(80)
        own = (items[i % 12][1] or "").split()
        if i % 2:
            t[30:30] = own
        docs.append((i, " ".join(t).replace("v3", "V3.")))
    docs += [(100, None), (101, ""), (102, "v1 v2 É é"), (103, LONG)]
    frame, table = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for group_bytes in (1 << 20, 400):
        got = {r.doc_id: r for r in decontaminate.find_contamination(frame, table, group_bytes=group_bytes).collect()}
        for k, t in docs:
            n, hit, found = brute_contamination(t, items)
            r = got[k]
            assert (r.n_words, r.n_hit, r.hit_items, r.n_items) == (n, hit, found, len(found)), k
            assert r.items_sha256 == hashlib.sha256(",".join(found).encode()).hexdigest()
            assert r.contaminated == (hit > 0 and 20 * hit >= n)
    none = decontaminate.find_contamination(odd_docs(spark), table.limit(0))
    assert none.where("contaminated OR n_hit > 0").count() == 0 and none.count() == len(ODD) + 3
    assert decontaminate.find_contamination(empty(spark), table).count() == 0


# 6 mixing


def brute_targets(sizes, share=1.5, most=2, weights=(5, 2, 1)):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {n: weights[i % 3] for i, n in enumerate(names)}
    left, free, out = share * sum(sizes.values()), set(names), {}
    while free:
        level = left / sum(w[n] for n in free)
        full = {n for n in free if w[n] * level > most * sizes[n]}
        if not full:
            out |= {n: w[n] * level for n in free}
            break
        for n in full:
            out[n] = float(most * sizes[n])
            left -= out[n]
        free -= full
    return out


def test_targets_equal_resharing(spark):
    rng = np.random.default_rng(2)
    for k in range(4):
        sizes = {f"s{i}": int(rng.integers(1, 10**6)) ** (1 + k % 2) for i in range(3 + 5 * k)} | ({None: 7} if k else {})
        df = spark.createDataFrame(list(sizes.items()), "source string, size long")
        got = {r.source: r.target for r in mixing.source_targets(df, "source", "size").collect()}
        assert got == {n: pytest.approx(t, rel=1e-9) for n, t in brute_targets(sizes).items()}


def test_mix_meets_its_targets(spark, sf):
    out = mixing.op6_mix(spark, sf).collect()
    docs = {r.doc_id: r.source for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    taken, target = Counter(), {}
    for r in out:
        assert 0 <= r.taken <= 2 * r.size
        taken[docs[r.doc_id]] += r.taken
        target[docs[r.doc_id]] = r.target
    assert all(abs(taken[s] - t) <= max(30, 0.01 * t) for s, t in target.items())
    again = {r.doc_id: r.taken for r in mixing.op6_mix(spark, sf).collect()}
    assert again == {r.doc_id: r.taken for r in out}


def test_small_sources_meet_their_targets_in_a_large_mix(spark):
    rows = [(i, "large", 5000) for i in range(2000)] + [(10_000 + i, f"s{i // 10}", 50 + i % 7) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, source string, size long")
    for block in (64, 5000, 1):
        if block == 1:
            df = df.where("doc_id >= 10000 OR doc_id < 40")
        out = mixing.mix(df, block=block).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
        assert len(out) == 41 and all(r.target - 1 < r.taken <= r.target for r in out)
    assert mixing.mix(df).where("taken > 2 * size").count() == 0


def test_slots_follow_the_golden_ratio_and_ranks_have_no_gaps(spark):
    needed = {1: 20_000, 2: 77_777, 3: 1, 4: 5}
    slots = mixing.schedule(spark.createDataFrame(list(needed.items()), "number long, needed long")).toPandas().sort_values("slot")
    total, edges = sum(needed.values()), np.cumsum([0, *needed.values()])
    assert slots.slot.is_unique
    for k, n in needed.items():
        mine = slots[slots.number == k]
        assert mine["rank"].tolist() == list(range(n))
        dealt = mine.slot[mine.slot < total]
        point = np.array([int(i) * mixing.STEP % mixing.UNIT for i in dealt])
        assert ((point >= edges[k - 1] * mixing.UNIT // total) & (point < edges[k] * mixing.UNIT // total)).all() and len(mine) - len(dealt) <= 20
    for first in range(0, total - 5000, 4999):  # any stretch of the schedule has the shares of the whole
        some = slots[(slots.slot >= first) & (slots.slot < first + 5000)]
        assert abs((some.number == 1).sum() - 5000 * needed[1] / total) < 12
    assert mixing.schedule(spark.createDataFrame([], "number long, needed long")).count() == 0


def test_points_of_large_slot_numbers(spark):
    numbers = [0, 1, (1 << 32) - 1, 1 << 32, (1 << 45) + 12345, (1 << 62) + 7]
    got = [r.x for r in spark.createDataFrame([(n,) for n in numbers], "n long").select(mixing.points(F.col("n")).alias("x")).collect()]
    assert got == [n * mixing.STEP % mixing.UNIT for n in numbers]


def test_a_mix_of_millions_of_words_equals_repeated_streams(spark, sf):
    """What the SQL says, in Python, on more words than the small tables have."""
    rows = [(i, None if i % 3 == 0 else f"s{i % 11}", (i * 7919) % 4001) for i in range(3000)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, size long")).collect()
    assert sum(r.taken for r in got) > 1 << 22
    streams = {}
    for r in got:
        streams.setdefault(r.source, []).append((hashlib.md5(f"17:{r.doc_id}".encode()).hexdigest(), r))
    for rows in streams.values():
        at, wanted = 0, int(rows[0][1].target)
        for _, r in sorted(rows, key=lambda x: x[0]):
            times, rest = divmod(wanted, r.source_size)
            assert r.taken == r.size * times + max(0, min(r.size, rest - at))
            at += r.size


def test_mix_edges(spark):
    df = odd_docs(spark).withColumn("size", word_count(F.col("text")))
    out = mixing.mix(df)
    assert out.count() == len(ODD) + 3 and out.where("taken > 2 * size OR taken IS NULL").count() == 0
    assert mixing.mix(empty(spark).withColumn("size", F.lit(1))).count() == 0
    nothing = mixing.mix(spark.createDataFrame([(1, "a", None), (2, None, 0)], "doc_id long, source string, size long")).collect()
    assert [r.taken for r in nothing] == [0, 0]


# 7 URLs


def test_url_rules_and_vocabulary(spark):
    urls = {
        "http://a.com/x": ("a.com", "/x", "com/", "allow"),
        "https://Example.COM/en/1?adult": ("example.com", "/en/1", "example.com/en/", "block"),
        "http://www.example.com/en/1": ("www.example.com", "/en/1", "www.example.com/en/", "allow"),
        "http://x.net/es/#a": ("x.net", "/es/", "net/es/", "block"),
        "http://xnet/es/": ("xnet", "/es/", None, "allow"),
        "http://adult-x.org/": ("adult-x.org", "/", None, "block"),
        "http://adults.org/": ("adults.org", "/", None, "allow"),
        "http://ads.track.org": ("ads.track.org", "", None, "block"),
        "http://ads.ads.org": ("ads.ads.org", "", None, "allow"),
        "http://a.com?x": ("a.com", "", None, "allow"),
        "no url": ("", "", None, "allow"),
        "": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
        "x" * 5000 + "://h.org/" + "p" * 5000: ("h.org", "/" + "p" * 5000, None, "allow"),
    }
    df = spark.createDataFrame([(u, "old") for u in urls], "url string, host string")
    assert {r.url: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(df).collect()} == urls
    assert url_filter.filter_urls(df.limit(0)).count() == 0


# 8 token files


def test_tokenizer_equals_whole_texts():
    w = token_files.WordTokenizer(tokenizers.path("word_bpe_49k.json"), 50)
    odd = ["a\x1cb", "x y", "I'LL don't A.", "İstanbul ΟΔΟΣ ς.", "<|endoftext|> a<|startoftext|>.", "é ́x", "a.,", "9٩٣,", "\t\x0bz\r\n", "ǅa.", "ª. º,", "foo...", "ﬁ.", "ẞ.", "漢字，", " " * 5, "'s'S,", "", LONG[:3000], "q" * 300]
    assert w.encode(odd) == [w._whole(t) for t in odd]
    assert w.encode(odd) == [w._whole(t) for t in odd]


def test_files_hold_every_id(spark, sf):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(tokenizers.path("word_bpe_49k.json"))
    docs, start = documents(spark, sf), 0
    got = {r.doc_id: r for r in token_files.op8_token_files(spark, sf).collect()}
    for k in sorted(docs):
        ids = np.array([*model.encode(docs[k] or "", add_special_tokens=False).ids, 1], "<u4")
        assert (got[k].start, got[k].n_tokens, got[k].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_sequences_are_views(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"some words number {i} here") for i in range(300)], "doc_id long, text string")
    path = f"file://{tmp_path}/t"
    files = token_files.write_sequences(docs, path, tokenizers.path("word_bpe_49k.json"), 1, length=16, batch=4, file_tokens=500).collect()
    import pyarrow.fs as pafs

    for f in files:
        stored = token_files.SequenceFile(pafs.LocalFileSystem(), f.file)
        n = -(-f.n_tokens // 16)
        parts = [stored.sequence(i) for i in range(n)]
        whole = np.concatenate([ids[np.array(mask.to_pylist())] for ids, mask in parts])
        assert (whole == stored.tokens(0, f.n_tokens)).all() and not parts[0][0].flags.owndata
    assert sum(f.n_docs for f in files) == 300


def test_token_edges(spark):
    out = token_files.token_table(spark, odd_docs(spark)).collect()
    assert len(out) == len(ODD) + 3 and min(r.n_tokens for r in out) == 1
    total = sorted((r.start, r.n_tokens) for r in out)
    assert all(a + n == b for (a, n), (b, _) in zip(total, total[1:]))
    assert token_files.token_table(spark, empty(spark)).count() == 0


# 9 near-duplicates


def brute_near(docs, percent=85):
    sets = {}
    for k, t in docs:
        w = words(t)
        sets[k] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    keys = list(sets)
    parent = {k: k for k in keys}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(keys):
        for b in keys[:i]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {k: (len(sets[k]), root(k)) for k in keys}


def edited(rng, text, n):
    w = text.split()
    for _ in range(n):
        w[int(rng.integers(len(w)))] = f"e{int(rng.integers(10**6))}"
    return " ".join(w)


def test_near_duplicates_equal_brute_force(spark):
    rng = np.random.default_rng(8)
    texts = [" ".join(f"w{i}" for i in rng.integers(0, 500, int(rng.integers(3, 200)))) for _ in range(60)]
    shared = " ".join(f"p{i}" for i in range(60))
    docs = []
    for t in texts:
        docs += [t, t.upper(), *(edited(rng, t, int(rng.integers(1, 4))) for _ in range(2)), f"{t} {shared}"]
    base = " ".join(f"b{i}" for i in range(150))
    docs += [edited(rng, base, int(rng.integers(0, 5))) for _ in range(120)] + [base] * 20 + ["", None, " ", "two words", "Two  words"]
    rows = list(enumerate(docs))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_near(rows)


def test_near_duplicate_edges(spark):
    out = near_dedup.near_duplicates(odd_docs(spark))
    got = [(r.doc_id, r.component_id) for r in out.collect()]
    assert len(got) == len(ODD) + 3 and (None, None) in got and dict(got)[5] == 4 and dict(got)[7] == 6 and dict(got)[1] == 1
    assert near_dedup.near_duplicates(empty(spark)).count() == 0


def test_shingle_sets_equal_python():
    import pyarrow as pa

    sets = list(shingles.shingle_sets(pa.array(ODD), 5))
    for t, s in zip(ODD, sets):
        w = words(t)
        assert len(s) == len({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    cut = list(shingles.shingle_sets(pa.array(ODD).slice(3, 5), 5))
    assert all((a == b).all() for a, b in zip(sets[3:8], cut))


# 10 lines


def brute_lines(rows, k=10, percent=80):
    places = defaultdict(list)
    for d, t in rows:
        for i, line in enumerate((t or "").split("\n")):
            if re.search(r"[^\x20\x09-\x0D]", line):
                places[line].append((d, i))
    sets = {x: {x[i : i + k] for i in range(len(x) - k + 1)} for x in places}
    lines = list(places)
    parent = {x: x for x in lines}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(lines):
        for b in lines[:i]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                parent[root(a)] = root(b)
    groups = defaultdict(list)
    for x in lines:
        groups[root(x)] += [(d, i, x) for d, i in places[x]]
    goes = defaultdict(dict)
    for g in groups.values():
        g.sort()
        for d, i, x in g[1:]:
            goes[d][i] = x == g[0][2]
    out = {}
    for d, t in rows:
        own = (t or "").split("\n")
        out[d] = (None if t is None else "\n".join(x for i, x in enumerate(own) if i not in goes[d]), sum(goes[d].values()), len(goes[d]) - sum(goes[d].values()))
    return out


def test_lines_equal_brute_force(spark):
    rng = np.random.default_rng(9)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz  "))
    make = lambda n: "".join(rng.choice(letters, n))
    pool = [make(int(rng.integers(4, 160))) for _ in range(80)]
    near = [p[:-1] + "Z" for p in pool] + [p + " tail" for p in pool]
    rows = [(i, "\n".join(str(x) for x in rng.choice(pool + near, 6))) for i in range(70)]
    rows += [(100, None), (101, ""), (102, "\n\n  \n"), (103, "short\nshort\nshort"), (104, "Zeile mit Ümläuten, lang genug\n" * 3), (105, make(9000))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.text, r.n_exact, r.n_fuzzy) for r in line_dedup.dedup_lines(df).collect()}
    assert got == brute_lines(rows)


def template_lines(n, twins, seed=4):
    """Lines of one template that differ in ten characters, too much for a link,
    and a twin of the first ones that differs in five, just enough."""
    rng = np.random.default_rng(seed)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz0123456789"))
    make = lambda k: "".join(rng.choice(letters, k))
    head, tail = make(60), make(70)
    own = [make(10) for _ in range(n)]
    return [head + x + tail for x in own] + [head + make(5) + x[5:] + tail for x in own[:twins]]


def test_lines_of_a_large_node_find_their_links(spark):
    lines = template_lines(2000, 200)
    names = {g: i for i, g in enumerate(sorted({x[i : i + 10] for x in lines for i in range(len(x) - 9)}))}
    has = np.zeros((len(lines), len(names)), "f4")
    for i, x in enumerate(lines):
        has[i, [names[x[j : j + 10]] for j in range(len(x) - 9)]] = 1
    size = has.sum(axis=1)
    linked = 0
    for i in range(0, len(lines), 300):
        common = has[i : i + 300] @ has.T
        linked += int((100 * common >= 80 * (size[i : i + 300, None] + size - common)).sum())
    links = (linked - len(lines)) // 2
    assert 200 <= links < 210  # the twins, and hardly another by brute force
    found = line_dedup.line_components(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string"))
    assert found.count() >= 0.95 * links


def test_line_edges(spark):
    out = line_dedup.dedup_lines(odd_docs(spark).withColumn("n_lines", F.lit("old")))
    assert out.count() == len(ODD) + 3 and line_dedup.dedup_lines(empty(spark)).count() == 0


@pytest.mark.parametrize("name", ["op6_mix", "op10_line_dedup"])
def test_native_plans_have_no_python(spark, sf, name):
    plan = queries.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# SQL and pipeline


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, sf, name):
    import glob
    import os

    import duckdb

    c = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    df, want = queries.queries()[name](spark, sf), c.sql(queries.oracle_sql()[name])
    order = sorted(df.columns)
    assert order == sorted(want.columns)
    have = sorted(str([r[c] for c in order]) for r in df.collect())
    assert have == sorted(str(list(r)) for r in want.project(", ".join(f'"{c}"' for c in order)).fetchall())


def test_pipeline_equals_its_parts(spark, sf):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    clean = p.drop_toxic(spark, docs, sf)
    assert clean.columns == docs.columns
    kept = p.drop_near_duplicates(spark, clean, sf)
    near = brute_near([(r.doc_id, r.text) for r in clean.collect()])
    assert {r.doc_id for r in kept.collect()} == {k for k, (_, c) in near.items() if k == c}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    rest = p.drop_contaminated(spark, kept, sf)
    good = set()
    for r in kept.collect():
        n, hit, _ = brute_contamination(r.text, items)
        if not (hit and 20 * hit >= n):
            good.add(r.doc_id)
    assert {r.doc_id for r in rest.collect()} == good
    mixed = p.mix_sources(spark, rest, sf)
    times = Counter(r.doc_id for r in mixed.collect())
    assert set(times) <= good and max(times.values()) <= 2 and mixed.columns == docs.columns
    last = p.write_tokens(spark, mixed, sf)
    assert last.count() == sum(times.values())
    assert len(p.STAGES) == 5
