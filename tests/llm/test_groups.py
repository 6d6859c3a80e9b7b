"""Many benchmark items: groups, one search a task, and its memory."""

import random

import psutil
import pytest

from gridspark.llm import decontaminate


def words(rng, n):
    return " ".join("".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 9))) for _ in range(n))


@pytest.fixture(scope="module")
def benchmark_text():
    rng = random.Random(11)
    return [(f"i{k}", words(rng, 120)) for k in range(1500)]  # about 1.1 MB


def test_one_search_a_task_whatever_the_groups(spark, benchmark_text):
    """Eight groups find what one finds, and no plan holds more than one search."""
    rng = random.Random(12)
    docs = [(k, words(rng, 40) + " " + " ".join(benchmark_text[k % 1500][1].split()[20 : 33 + k % 5]) + " " + words(rng, 30)) for k in range(0, 1500, 25)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    items = spark.createDataFrame(benchmark_text, "item_id string, text string")
    one = decontaminate.find_contamination(frame, items)
    eight = decontaminate.find_contamination(frame, items, group_bytes=150_000)
    assert eight._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    got = sorted(map(str, eight.collect()))
    assert got == sorted(map(str, one.collect())) and sum("contaminated=True" in r for r in got) == len(docs)


def test_a_group_of_items_fits_a_worker(benchmark_text):
    """A search for 2 MB of items, the most that a group has, takes well under 1 GB."""
    before = psutil.Process().memory_info().rss
    patterns = {}
    for k, (_, t) in enumerate(benchmark_text * 2):
        for w in decontaminate.windows_of(decontaminate.words_of(t if k < 1500 else t[::-1]), decontaminate.WINDOW):
            patterns.setdefault(decontaminate.joined(w), set()).add(k)
    search = decontaminate.WuManber(patterns)
    assert sum(len(t) for _, t in benchmark_text) * 2 > 0.8 * decontaminate.GROUP_BYTES
    assert psutil.Process().memory_info().rss - before < 700 << 20 and search is not None
