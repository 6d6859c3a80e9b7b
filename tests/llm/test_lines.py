import random

from gridspark.llm import line_dedup, nodes


def test_long_lines_below_the_threshold_are_no_candidates(spark):
    """Lines of 800 characters that share two thirds of their shingles, and one pair above the threshold."""
    r = random.Random(5)
    text = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyz    ") for _ in range(n))
    common = text(660)
    lines = [common + text(140) for _ in range(40)]
    lines.append(lines[0][:760] + text(40))
    texts = spark.createDataFrame([(i, i, line) for i, line in enumerate(lines)], "hi long, lo long, line string")
    rows = spark.createDataFrame([(0, i, i, 0) for i in range(len(lines))], "node long, vertex long, component long, major long")
    shingles = [{line[i : i + 10] for i in range(len(line) - 9)} for line in lines]
    links = {(a, b) for b in range(len(lines)) for a in range(b) if 100 * len(shingles[a] & shingles[b]) >= 80 * len(shingles[a] | shingles[b])}
    assert links == {(0, 40)}
    words = line_dedup.FINE
    found = {(p.a, p.b) for p in nodes.across(rows, line_dedup.bitmaps(texts, words), line_dedup.alike(80, words)).collect()}
    assert links <= found
    assert len(found) < 10  # of 820, of which a bitmap of 1,024 values lets hundreds through
    coarse = nodes.across(rows, line_dedup.bitmaps(texts), line_dedup.alike(80)).count()
    assert coarse > 20 * len(found)


def test_repeats_within_a_line_count_once_in_large_bitmaps(spark):
    once = "the quick brown fox jumps over the lazy dog again"
    lines = [once, once * 9, "\U0001f600" * 12, "\U0001f600" * 40]
    texts = spark.createDataFrame([(i, i, x) for i, x in enumerate(lines)], "hi long, lo long, line string")
    shingles = lambda x: [x[i : i + line_dedup.SHINGLE] for i in range(len(x) - line_dedup.SHINGLE + 1)]
    n = {r.vertex: r.n for r in line_dedup.bitmaps(texts, line_dedup.FINE).select("vertex", "n").collect()}
    assert [n[i] for i in (0, 1)] == [len(set(shingles(x))) for x in lines[:2]]
    assert [n[i] for i in (2, 3)] == [15, 71]  # two code units a character: as counted before
    assert line_dedup.bitmaps(texts).where("vertex = 1").first().n == len(shingles(lines[1]))
