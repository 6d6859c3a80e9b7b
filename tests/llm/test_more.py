"""Training-data operators: slow models, repeated keys, clashing names, round trips."""

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_llm import ODD, empty, odd_docs

from gridspark.llm import attention_lm, decontaminate, line_dedup, lm_scoring, mixing, near_dedup, shuffle_shards, tiff, token_files, toxicity
from gridspark.llm.common import word_count

tokenizers = pytest.importorskip("public_tokenizers")


# 1 toxicity


def slow_score(model, text):
    """Every filter at every place, one multiplication at a time."""
    parts = list(toxicity.word_buckets(pa.array([text], pa.string())))
    a, b, _ = parts[0]
    x = model.first[a].astype(float) + model.second[b]
    z = float(model.bias)
    for k, w in enumerate(toxicity.WIDTHS):
        for f in range(toxicity.FILTERS):
            best = 0.0
            for i in range(len(x) - w + 1):
                y = float(model.shift[k][f])
                for j in range(w):
                    y += float(x[i + j] @ model.filters[k][j * toxicity.SIZE : (j + 1) * toxicity.SIZE, f])
                best = max(best, y)
            z += best * float(model.out[k * toxicity.FILTERS + f])
    return 1 / (1 + np.exp(-(model.scale * z + model.offset)))


def test_scores_equal_a_slow_convolution():
    rng = np.random.default_rng(2)
    texts = [" ".join(rng.choice(["bad", "good", "so", "very", "x"], n)) for n in (1, 2, 3, 7, 40)] + ["", "one"]
    labels = np.array([int("bad" in t) for t in texts])
    model = toxicity.TextCNN().fit(pa.array(texts), labels, ["en"] * len(texts))
    model = toxicity.TextCNN.from_bytes(model.to_bytes())
    got = model.score(pa.array(texts))
    assert got == pytest.approx([slow_score(model, t) for t in texts], abs=1e-4)


def test_sample_is_bounded_in_rows_and_bytes(spark):
    docs = spark.createDataFrame([(i, "word " * 50, "en") for i in range(40)], "doc_id long, text string, lang string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    for rows, size in ((10, 1 << 20), (40, 1000), (40, 0)):
        assert len(toxicity.train(docs, labels, lambda k: F.lit(True), rows, size)) > 1 << 20


def test_a_text_too_long_for_the_sample_does_not_end_it(spark):
    """Wherever the long text comes in the order, the model is that of the others."""
    docs = spark.createDataFrame([(i, f"{'bad' if i % 2 else 'good'} words {i}", "en") for i in range(40)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)], "doc_id long, toxic int")
    long = spark.createDataFrame([(i, "bad " * 5000, "en") for i in range(40, 80)], docs.schema)
    settings = lambda df: toxicity.TextCNN.settings(toxicity.train(df, labels, lambda k: F.lit(True), 100, 64_000))
    assert settings(docs.unionByName(long)) == settings(docs)
    assert settings(docs) != settings(long)


# 2 external shuffle


def test_shards_are_written_and_read_back(spark, tmp_path):
    placed = shuffle_shards.external_shuffle(odd_docs(spark), "doc_id", n_shards=3)
    back = shuffle_shards.write_shards(placed, str(tmp_path / "shards"))
    assert sorted(map(str, back.select(*placed.columns).collect())) == sorted(map(str, placed.collect()))
    assert {p.name for p in (tmp_path / "shards").iterdir() if p.is_dir()} == {"shard=0", "shard=1", "shard=2"}
    assert shuffle_shards.write_shards(shuffle_shards.external_shuffle(empty(spark), "doc_id"), str(tmp_path / "none")).count() == 0


# 3 TIFF


def slow_lzw_codes(data):
    """The dictionary coder of the format's description, as (code, width)."""
    table, out, w, width = {bytes([i]): i for i in range(256)}, [], b"", 9
    for c in data:
        wc = w + bytes([c])
        if wc in table:
            w = wc
            continue
        out.append((table[w], width))
        table[wc] = len(table) + 2
        if len(table) + 2 == 4095:
            out.append((256, 12))
            table, width = {bytes([i]): i for i in range(256)}, 9
        else:
            width = 9 + sum(len(table) + 2 >= n for n in (512, 1024, 2048))
        w = bytes([c])
    if w:
        out.append((table[w], width))
        width = 9 + sum(len(table) + 3 >= n for n in (512, 1024, 2048))
    return [*out, (257, width)]


def test_lzw_equals_the_description():
    rng = np.random.default_rng(4)
    for data in (b"", b"a", b"ab" * 4000, rng.integers(0, 256, 30_000, dtype=np.uint8).tobytes(), rng.integers(97, 101, 50_000, dtype=np.uint8).tobytes()):
        bits = "".join(format(code, f"0{width}b") for code, width in slow_lzw_codes(data))
        bits += "0" * (-len(bits) % 8)
        assert tiff.lzw(data) == bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8))
        assert tiff.unlzw(tiff.lzw(data)) == data


def test_every_codec_stores_its_share():
    texts = [f"text number {i} {'of many words ' * (i % 40)}".encode() for i in range(600)]
    share = Counter()
    for t in texts:
        data = t + b"\0" * (-len(t) % 64)
        fields = [f for _, f in tiff.directories(tiff.text_to_tiff(t))]
        share[fields[0][tiff.COMPRESSION][0], tiff.TILE_WIDTH in fields[0]] += len(data)
    assert len(share) == 6 and min(share.values()) > 0.08 * sum(share.values())


# 4 LM scoring


def slow_log10(model, ids):
    """Each id by its own sum over the places it may look back to."""
    x, total = model.symbol[ids], 0.0
    u = np.concatenate(([model.symbol[model.end_id]], x[:-1]))
    for i in range(len(ids)):
        k = 0 if i < attention_lm.WINDOW else -(-(i - attention_lm.WINDOW + 1) // attention_lm.STRIDE)
        places = range(k * attention_lm.STRIDE, i + 1)
        s = np.array([model.query[u[i]] @ model.key[u[j]] + model.distance[i - j] for j in places])
        weight = np.exp(s) / np.exp(s).sum()
        z = model.start[u[i]] + sum(w * model.value[u[j]] for w, j in zip(weight, places)) @ model.out
        goal = model.of_class[x[i]]
        total += (z[goal] - np.log(np.exp(z).sum())) / np.log(10) + float(model.pair[u[i], x[i]]) + float(model.log_share[ids[i]])
    return total


def test_attention_equals_a_slow_one():
    rng = np.random.default_rng(1)
    texts = [np.append(rng.integers(0, 60, n), 79) for n in (1, 20, 31, 32, 33, 100, 150)]
    model = attention_lm.AttentionLM(80, 79).fit(texts, np.bincount(np.concatenate(texts), minlength=80).astype(float))
    got = model.log10_probability(np.concatenate(texts), np.array([len(t) for t in texts]))
    assert got == pytest.approx([slow_log10(model, t) for t in texts], rel=1e-4)


def test_changes_of_parts_add_up():
    rng = np.random.default_rng(1)
    texts = [np.append(rng.integers(0, 60, 40), 79) for _ in range(8)]
    counts = np.bincount(np.concatenate(texts), minlength=80).astype(float)
    model = attention_lm.AttentionLM(80, 79).fit([], counts)
    parts = [model.deltas(texts[:4], 0), model.deltas(texts[4:], 0)]
    before = {w: getattr(model, w).copy() for w in attention_lm.WEIGHTS}
    model.moved(parts[0] + parts[1])
    n = [p[0] for p in parts]
    at = len(parts[0]) - model.start.size - model.distance.size
    want = sum(p[at : at + model.distance.size] for p in parts) / sum(n)
    assert model.distance - before["distance"] == pytest.approx(want)
    model.moved(None)


def test_words_of_many_chunks_in_two_levels(spark, sf):
    docs, path = spark.read.parquet(f"{sf}/documents.parquet").limit(60), tokenizers.path("word_bpe_49k.json")
    learn = lambda k: k % 5 != 1
    columns = ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score"]
    one, several = (lm_scoring.score_texts(docs, learn, path, 49407, pack_bytes=4000, spread=n).select(*columns).toPandas().sort_values("doc_id") for n in (1000, 2))
    assert one[columns[:4]].to_numpy().tolist() == several[columns[:4]].to_numpy().tolist()
    assert several.base_score.to_numpy() == pytest.approx(one.base_score.to_numpy())


def test_words_mix_model_and_frequency():
    p, count = np.array([0.1, 1e-9, 0.5]), np.array([5, 50, 0])
    got = lm_scoring._mixed(np.log10(p), count, 100)
    part = lm_scoring.MODEL_PART
    assert 10**got == pytest.approx(part * p + (1 - part) * count / 100)
    assert lm_scoring._mixed(np.log10(p), np.zeros(3, int), 0) == pytest.approx(np.log10(p))


def test_held_out_texts_are_likelier_than_by_frequency(spark):
    got = lm_scoring.op4_attention_lm(spark, "/root/testdata/sf0.01").where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert got.s > got.b


@pytest.mark.parametrize("kind", ["string", "int", "date"])
def test_keys_of_any_type(spark, kind):
    key = {"string": F.col("doc_id").cast("string"), "int": F.col("doc_id").cast("int"), "date": F.date_add(F.lit("2024-01-01"), F.col("doc_id").cast("int"))}[kind]
    docs = odd_docs(spark).withColumn("doc_id", key)
    path = tokenizers.path("word_bpe_49k.json")
    scored = lm_scoring.score_texts(docs.where("length(text) < 100 OR text IS NULL"), lambda k: F.lit(True), path, 49407)
    assert dict(scored.dtypes)["doc_id"] == kind and scored.count() == len(ODD) + 1
    read = token_files.token_table(spark, docs)
    assert dict(read.dtypes)["doc_id"] == kind and sorted(str(r.doc_id) for r in read.collect()) == sorted(str(r.doc_id) for r in docs.collect())


# 5, 6 clashing names


def test_clashing_names(spark):
    docs = odd_docs(spark)
    items = spark.createDataFrame([(1, "one two three four")], "item_id long, text string")
    found = decontaminate.find_contamination(docs.withColumns({"n_hit": F.lit("x"), "hit_spans": F.lit("y")}), items)
    assert found.count() == docs.count() and dict(found.dtypes)["n_hit"] == "bigint"
    mixed = mixing.mix(docs.withColumns({"size": word_count(F.col("text")), "target": F.lit("x"), "taken": F.lit("y")}))
    assert mixed.count() == docs.count() and dict(mixed.dtypes)["taken"] == "bigint" and "_h" not in mixed.columns
    stored = tiff.encode_texts(docs.withColumn("media", F.lit(1)))
    assert dict(stored.dtypes)["media"] == "binary"
    assert dict(tiff.decode_pages(stored.withColumn("page", F.lit("x"))).dtypes)["page"] == "int"


# 9, 10 repeated keys


def test_of_equal_keys_one_row_stays(spark):
    text = "a b c d e f g h i j"
    rows = [(1, text), (1, text), (1, "other words that are nothing like it"), (None, text), (2, text)]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r.doc_id or 0, r.stays) for r in got.collect()) == [(0, False), (1, True), (1, True), (1, True), (2, False)]


def test_rows_of_one_key_lose_their_own_lines(spark):
    rows = [
        (7, "first line alpha beta gamma\na repeated line of some length"),
        (7, "first line other words here\nUNIQUE TEXT THAT OCCURS ONCE ONLY"),
        (1, "a repeated line of some length"),
        (None, "null key one\na repeated line of some length"),
        (None, "null key two\nstays where it is, being alone"),
    ]
    out = {(r.doc_id, r.text) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    # A null key comes first, so its row keeps the line that is repeated.
    assert out == {(7, "first line alpha beta gamma"), (7, rows[1][1]), (1, ""), (None, rows[3][1]), (None, rows[4][1])}


def test_many_lines_go_from_one_text(spark):
    lines = [f"line number {i % 50} of a long text" if i % 2 else f"{i}" for i in range(3000)]
    out = line_dedup.dedup_lines(spark.createDataFrame([(1, "\n".join(lines))], "doc_id long, text string"), percent=100).first()
    seen, kept = set(), []
    for x in lines:
        if x not in seen:
            kept.append(x)
        seen.add(x)
    assert out.text == "\n".join(kept) and out.n_lines == 3000 and out.n_exact == 3000 - len(kept)


# Pipeline


def test_stages_take_what_comes(spark, sf):
    import corpus_pipeline as p

    docs = odd_docs(spark)
    for name, stage in p.STAGES:
        got = stage(spark, docs, sf)
        assert got.count() >= 0 and stage(spark, empty(spark), sf).count() == 0, name
        if name != "token files":
            assert got.columns == docs.columns
    kept = p.drop_near_duplicates(spark, docs, sf).collect()
    assert Counter(r.doc_id for r in kept)[3] == 1  # the repeated rows are one text
    rows = [(1, "x y z " * 9), (1, "x y z " * 9), (None, "x y z " * 9), (2, "p q r " * 9), (2, "one of its own, under a key that is used twice")]
    some = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id, r.text[:3]) for r in p.drop_near_duplicates(spark, some, sf).collect()) == [(1, "x y"), (2, "one"), (2, "p q")]


def test_crc_of_the_text_decides_the_layout():
    t = b"x" * 100
    payload = t + b"\0" * 28
    want = tiff.layout_of(zlib.crc32(payload), 2)["scheme"]
    assert re.match(b"II", tiff.text_to_tiff(t)) and next(tiff.directories(tiff.text_to_tiff(t)))[1][tiff.COMPRESSION][0] == want
