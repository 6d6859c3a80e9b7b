"""Fuzzy line deduplication, in DataFrame functions only.

Equal lines are one vertex. A line's shingles are its runs of ten characters;
for the sketch they are exploded as UTF-16 code units, hashed, and reduced to
twelve minima in one hash aggregation that runs inside code generation. Bands of
two minima give nodes of candidate lines. Bitmaps of the hashes rule out most
pairs below the threshold, the others are verified by their exact Jaccard
similarity, a distributed union-find joins them, and one line of each component
stays.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, documents, materialise
from .components import connected_components
from .nodes import linked

SHINGLE, PERCENT = 10, 80
BANDS, ROWS = 6, 2
NODES = [f"node{b}" for b in range(BANDS)]
SMALL, LEVELS = 12, 9
#: Longs of a line's bitmap.
WORDS = 16
#: Longs of the bitmap of a line in a large node. A long line takes most values of a small one, so that lines far below the threshold
#: look alike, and a node's comparisons bring up pairs by the square of its lines. Both lines of a join together keep below 100 columns.
FINE = 44
#: Minima of a line in a large node, for branching.
TOKENS = 32
#: Trees of a node's first branching: lines at the threshold stand together in few bands, and every level parts some of them.
TREES = 3
#: Rows of a line, or a component, that makes up so large a part of all are dealt with by broadcast; there can be no more than this many.
HOT = 1000
#: Shingles that share a row, a power of two. A row for each would look its line up in the aggregation's table as often.
CHUNK = 8


def lines_of(df: DataFrame, key: str, text: str) -> DataFrame:
    """One row per line that has more than white space: k, x (a digest of the
    text), pos, hi, lo, line."""
    lines = df.select(F.col(key).alias("k"), F.xxhash64(text).alias("x"), F.posexplode(F.split(text, "\n", -1)).alias("pos", "line"))
    lines = lines.where(F.col("line").rlike(r"[^\x20\x09-\x0D]"))
    return lines.select("k", "x", "pos", F.xxhash64(F.lit(1), "line").alias("hi"), F.xxhash64(F.lit(2), "line").alias("lo"), "line")


def order(h: Column, j: int) -> Column:
    """The j-th order of the hashes: their bits turned, and flipped by a constant."""
    by = 5 * j % 64
    turned = F.shiftleft(h, by).bitwiseOR(F.shiftrightunsigned(h, 64 - by)) if by else h
    return turned.bitwiseXOR(F.xxhash64(F.lit(j)))


def units_of(code: str) -> Column:
    return F.shiftright(F.octet_length(code), 1)


def coded(lines: DataFrame) -> DataFrame:
    """hi, lo, the line's UTF-16 code units and n, how many shingles start in it,
    of lines with at least one."""
    n = units_of("units") - (SHINGLE - 1)
    return lines.select("hi", "lo", F.encode("line", "UTF-16BE").alias("units")).withColumn("n", n).where("n >= 1")


def shingled(own: DataFrame, *keep: str) -> DataFrame:
    """``keep``, at and the hashes h0, h1, ... of the shingles that start in ``units``
    at the ``CHUNK`` places from the byte ``at`` (from 0) on, of the ``n`` that there
    are. The last one stands for those beyond it: minima and bitmaps take no notice
    of repeats. No sum or product here: where Spark looks for overflow, each costs
    more than the hash, so places are made of bits."""
    last = (2 * F.col("n") - 1).alias("_last")
    runs = own.select(*keep, "units", last, F.explode(F.sequence(F.lit(0), 2 * F.col("n") - 2, F.lit(2 * CHUNK))).alias("at"))
    return runs.select(*keep, "at", *(F.xxhash64(F.expr(f"substring(units, least(at | {2 * k + 1}, _last), {2 * SHINGLE})")).alias(f"h{k}") for k in range(CHUNK)))


def minimum(j: int) -> Column:
    """Of rows of ``shingled``, the least hash in the j-th order, but for its lower half."""
    return F.min(F.least(*(order(F.col(f"h{k}"), j) for k in range(CHUNK))).bitwiseAND(F.lit(-1 << 32)))


def upper(least: str) -> Column:
    return F.shiftright(least, 32).cast("int")


def sketches(lines: DataFrame) -> DataFrame:
    """hi, lo, n (shingles; none or fewer in a line too short for one), times (how
    often the line is there) and the nodes, one for each band of minima, of each
    distinct line. The nodes of a line too short for a shingle mean nothing."""
    own = lines.select("hi", "lo", F.encode("line", "UTF-16BE").alias("units"))
    own = own.withColumn("own", units_of("units") - (SHINGLE - 1)).withColumn("n", F.greatest("own", F.lit(1)))
    least = shingled(own, "hi", "lo", "own").groupBy("hi", "lo").agg(
        F.max("own").alias("n"),
        F.count(F.when(F.col("at") == 0, True)).alias("times"),
        *(minimum(j).alias(f"m{j}") for j in range(BANDS * ROWS)),
    )
    node = lambda b: F.xxhash64(F.lit(b), *(upper(f"m{b * ROWS + r}") for r in range(ROWS)))
    return least.select("hi", "lo", "n", "times", *(node(b).alias(c) for b, c in enumerate(NODES)))


def hashes(texts: DataFrame, distinct: bool = False) -> DataFrame:
    """hi, lo, size (shingles) and ``shingled``'s columns. With ``distinct`` size
    counts equal shingles once, except in lines with characters of two code units,
    whose runs of ten units are not runs of ten characters."""
    own = coded(texts)
    size = F.col("n")
    if distinct:
        # The units are a lambda's argument: as a column they would be copied for each shingle.
        each = F.expr(f"transform(array(units), u -> array_distinct(transform(sequence(1, octet_length(u) - {2 * SHINGLE - 1}, 2), i -> xxhash64(substring(u, i, {2 * SHINGLE})))))")
        size = F.when(F.octet_length("units") == 2 * F.length(F.decode("units", "UTF-16BE")), F.size(F.get(each, F.lit(0)))).otherwise(size)
    return shingled(own.withColumn("size", size), "hi", "lo", "size")


def bits(words: int) -> list[str]:
    return [f"w{j}" for j in range(words)]


def bitmaps(texts: DataFrame, words: int = WORDS) -> DataFrame:
    """vertex, n (shingles, repeats counted; in bitmaps larger than ``WORDS`` distinct
    ones) and ``bits``: which of 64 x ``words`` values the hashes of the line's shingles
    take. A line that repeats itself looks like many others where its repeats count."""
    places = []
    for k in range(CHUNK):
        word = F.shiftrightunsigned(f"h{k}", 6)
        word = word % words if words & (words - 1) else word.bitwiseAND(F.lit(words - 1).cast("long"))
        places += [word.cast("int").alias(f"w{k}"), F.expr(f"shiftleft(1L, cast(h{k} & 63 AS INT))").alias(f"b{k}")]
    none = F.lit(0).cast("long")

    def word(j: int) -> Column:
        found = none
        for k in range(CHUNK):
            found = found.bitwiseOR(F.when(F.col(f"w{k}") == j, F.col(f"b{k}")).otherwise(none))
        return F.bit_or(found)

    maps = hashes(texts, words > WORDS).select("hi", "lo", "size", *places).groupBy("hi", "lo").agg(F.max("size").alias("n"), *(word(j).alias(f"p{j}") for j in range(words)))
    return maps.select(F.col("hi").alias("vertex"), F.col("n").cast("long").alias("n"), *(F.col(f"p{j}").alias(c) for j, c in enumerate(bits(words))))


def tokens_of(texts: DataFrame) -> DataFrame:
    """vertex and tokens, further minima of the line."""
    least = hashes(texts).groupBy("hi", "lo").agg(*(minimum(BANDS * ROWS + j).alias(f"t{j}") for j in range(TOKENS)))
    return least.select(F.col("hi").alias("vertex"), F.array(*(upper(f"t{j}") for j in range(TOKENS))).alias("tokens"))


def alike(percent: int, words: int = WORDS):
    """Whether two lines can be links, and a bound of their similarity in
    thousandths. Every value that one line's shingles take and the other's don't
    is a shingle of one of them only, so no link is ruled out. Counts are taken as
    doubles, which add up exactly and without a look for overflow at each of them."""

    def judge(one: Callable[[str], Column], other: Callable[[str], Column]) -> tuple[Column, Column]:
        n, differ = one("n").cast("double") + other("n").cast("double"), F.lit(0.0)
        for c in bits(words):
            differ = differ + F.bit_count(one(c).bitwiseXOR(other(c))).cast("double")
        return differ * (100 + percent) <= n * (100 - percent), F.floor(1000 * (n - differ) / (n + differ))

    return judge


def shingle_array(line: str) -> Column:
    """Hashes of the line's distinct shingles, of ten characters each."""
    units = F.array(F.encode(line, "UTF-32"))
    starts = lambda u: F.sequence(F.lit(1), F.greatest(F.octet_length(u) - (4 * SHINGLE - 1), F.lit(1)), F.lit(4))
    runs = F.transform(units, lambda u: F.transform(starts(u), lambda i: F.xxhash64(F.substring(u, i, F.lit(4 * SHINGLE)))))
    return F.array_distinct(F.get(runs, F.lit(0)))


def verified(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of line hashes whose lines are alike, with both full ids."""
    for end in ("a", "b"):
        own = texts.select(F.col("hi").alias(end), F.col("lo").alias(f"lo_{end}"), F.col("line").alias(f"line_{end}"))
        pairs = pairs.join(own.hint("shuffle_hash"), end)
    # The sets come out of a generator: no filter is pushed below it, and each is computed once.
    sets = F.explode(F.array(F.struct(shingle_array("line_a").alias("a"), shingle_array("line_b").alias("b"))))
    pairs = pairs.select("a", "b", "lo_a", "lo_b", sets.alias("sets"))
    common, both = F.size(F.array_intersect("sets.a", "sets.b")), F.size("sets.a") + F.size("sets.b")
    return materialise(pairs.where(common * (100 + percent) >= both * percent).select("a", "b", "lo_a", "lo_b"), "links")


def resembling(lines: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """What ``line_components`` gives, of ``lines_of``, and the lines' ``sketches``."""
    sketched = materialise(sketches(lines), "sketches")
    rows = sketched.where("n >= 1").select(F.explode(F.array(*NODES)).alias("node"), F.col("hi").alias("vertex"))
    # Only lines with company in a node are looked at again.
    ends = rows.groupBy("node").agg(F.min("vertex").alias("low"), F.max("vertex").alias("high")).where("low <> high").select("node")
    rows = materialise(rows.join(ends.hint("shuffle_hash"), "node"), "nodes")
    involved = rows.select(F.col("vertex").alias("hi")).distinct()
    # The line is a key, not a value: values of changing size would need a sort.
    texts = lines.select("hi", "lo", "line").join(involved.hint("shuffle_hash"), "hi", "left_semi").distinct()
    texts = materialise(texts, "lines")
    maps = materialise(bitmaps(texts), "bitmaps")
    some_of = lambda some: texts.join(some.select(F.col("vertex").alias("hi")).hint("shuffle_hash"), "hi", "left_semi")
    wanted = lambda some: materialise(tokens_of(some_of(some)), "tokens")
    finer = lambda some: materialise(bitmaps(some_of(some), FINE), "bitmaps").hint("shuffle_hash")
    _, found = linked(rows, maps.hint("shuffle_hash"), alike(percent), wanted, TOKENS, percent, SMALL, LEVELS, lambda pairs: texts, lambda pairs, own: verified(pairs, own, percent), TREES, finer=(finer, alike(percent, FINE)))
    for table in (rows, maps, texts):
        discard(table)
    links = found[0]
    for more in found[1:]:
        links = links.unionByName(more)
    # Only now by the full ids, so that lines of equal first hash stay apart.
    ids = links.select(F.struct(F.col("a").alias("hi"), F.col("lo_a").alias("lo")).alias("a"), F.struct(F.col("b").alias("hi"), F.col("lo_b").alias("lo")).alias("b"))
    found = connected_components(ids)
    return found.select("id.hi", "id.lo", F.col("component.hi").alias("chi"), F.col("component.lo").alias("clo")), sketched


def line_components(df: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """hi, lo, chi, clo: the line hashes of every line that is not the smallest
    of its component, and that smallest."""
    found, sketched = resembling(lines_of(df, key, text), percent)
    discard(sketched)
    return found


def looked_up(rows: DataFrame, table: DataFrame, hi: str, lo: str) -> DataFrame:
    """The rows whose (hi, lo) is in ``table``, one row there for each, with its other
    columns. Those of the few keys that are ``hot`` there get them by broadcast,
    and go through the join with the others by a key that matches nothing."""
    values = [c for c in table.columns if c not in (hi, lo, "hot")]
    value = F.struct(*values)
    known = rows.join(F.broadcast(table.where("hot").select(hi, lo, value.alias("_hot"))), [hi, lo], "left")
    rare = table.where("NOT hot").select(F.col(hi).alias("_hi"), F.col(lo).alias("_lo"), value.alias("_rare")).hint("shuffle_hash")
    free = F.col("_hot").isNotNull()
    on = (F.when(free, F.xxhash64(*rows.columns)).otherwise(F.col(hi)) == F.col("_hi")) & (F.when(~free, F.col(lo)) == F.col("_lo"))
    found = known.join(rare, on, "left").withColumn("_value", F.coalesce("_hot", "_rare")).where("_value IS NOT NULL")
    return found.select(*rows.columns, *(F.col(f"_value.{c}").alias(c) for c in values))


def dropped_lines(df: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """k, x and the positions (from 0) of the lines that go from the row of that
    key and text: exact (equal to the line that stays) and fuzzy.

    Only lines that are there several times or resemble another one are looked at
    again. What makes up so large a part of all lines, a line or a component, is
    summed up where it is read and dealt with by broadcast.
    """
    lines = lines_of(df, key, text)
    found, sketched = resembling(lines, percent)
    many = (sketched.agg(F.sum("times")).first()[0] or 0) // HOT  # no more than ``HOT`` lines, or components, are there more often
    again = sketched.where("times > 1").select("hi", "lo")
    again = again.unionByName(found.select("hi", "lo")).unionByName(found.select(F.col("chi").alias("hi"), F.col("clo").alias("lo"))).distinct()
    hot = sketched.where(F.col("times") > many).select("hi", "lo", F.lit(True).alias("hot"))
    again = again.join(found, ["hi", "lo"], "left").join(F.broadcast(hot), ["hi", "lo"], "left")
    again = materialise(again.select("hi", "lo", F.coalesce("chi", "hi").alias("chi"), F.coalesce("clo", "lo").alias("clo"), F.coalesce("hot", F.lit(False)).alias("hot")), "repeated-lines")
    discard(sketched)
    places = materialise(looked_up(lines.select("k", "x", "pos", "hi", "lo"), again, "hi", "lo"), "line-places")
    discard(again)
    first = F.min(F.struct(F.col("k").isNotNull().alias("known"), "k", "x", "pos", "hi", "lo"))
    stays = places.groupBy("chi", "clo").agg(first.alias("stay"), F.count(F.lit(1)).alias("n"))
    stays = materialise(stays.select("chi", "clo", "stay", (F.col("n") > many).alias("hot")), "stays")
    goes = looked_up(places, stays, "chi", "clo")
    here = F.col("k").eqNullSafe(F.col("stay.k")) & (F.col("x") == F.col("stay.x")) & (F.col("pos") == F.col("stay.pos"))
    exact = (F.col("hi") == F.col("stay.hi")) & (F.col("lo") == F.col("stay.lo"))
    return goes.where(~here).groupBy("k", "x").agg(F.sort_array(F.collect_set(F.struct("pos", exact.alias("exact")))).alias("goes"))


def dedup_lines(df: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """``df`` with the text's fuzzy repeats of lines taken out, and n_lines,
    n_exact, n_fuzzy (lines taken out that equal the one that stays, or only
    resemble it).

    Lines end at line feeds. Two lines are linked where the Jaccard similarity
    of their ten-character shingles is at least ``percent``; a line shorter than
    that is linked with equal lines only. Of each component the line that comes
    first by (key, digest of the text, place in the text) stays. Lines of white
    space only stay and count as lines.

    A null text stays null and has no lines; an empty one has one line, empty.
    Other columns pass as they are; input columns named like an output column
    are replaced. Rows of the same key and different texts are different
    documents; rows of the same key and text are one document that is there
    several times, and each loses the same lines. A null key comes first. An
    empty table gives an empty one.
    """
    own = df.drop("n_lines", "n_exact", "n_fuzzy")
    goes = dropped_lines(own.select(F.col(key), F.col(text)), key, text, percent)
    out = own.withColumn("_x", F.xxhash64(text))
    out = out.join(goes.hint("shuffle_hash"), out[key].eqNullSafe(goes["k"]) & (out["_x"] == goes["x"]), "left").drop("k", "x", "_x")
    pos = F.coalesce(F.transform("goes", lambda g: g["pos"]), F.array().cast("array<int>"))
    lines = F.split(text, "\n", -1)
    n_exact = F.coalesce(F.size(F.filter("goes", lambda g: g["exact"])), F.lit(0))
    out = out.withColumns({"_pos": pos, "_lines": lines, "n_lines": F.coalesce(F.size(lines), F.lit(0)), "n_exact": F.when(F.col("goes").isNull(), 0).otherwise(n_exact)})
    out = out.withColumn("n_fuzzy", F.size("_pos") - F.col("n_exact"))
    # The stretches between the lines that go: each line is copied once.
    edges = F.concat(F.array(F.lit(-1)), "_pos", F.array(F.col("n_lines")))
    stretch = F.transform(F.sequence(F.lit(0), F.size("_pos")), lambda i: F.slice("_lines", F.get("_edges", i) + 2, F.get("_edges", i + 1) - F.get("_edges", i) - 1))
    out = out.withColumn("_edges", edges)
    clean = F.when(F.size("_pos") == 0, F.col(text)).otherwise(F.array_join(F.flatten(stretch), "\n"))
    return out.withColumn(text, clean).select(*own.columns, "n_lines", "n_exact", "n_fuzzy")


def op10_line_dedup(spark, sf_dir) -> DataFrame:
    out = dedup_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_exact", "n_fuzzy", F.octet_length("text").cast("long").alias("kept_bytes"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
