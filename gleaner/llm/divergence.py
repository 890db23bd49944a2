"""Divergence of sources within a language, by systolic rotation.

Every task counts its rows' words by (language, source) before anything is shuffled. A language keeps the words of
at least `min_docs` of its documents; they are numbered within slices of about SLICE words, so that a group's part
of a slice is a vector of bounded size whatever the vocabulary. A vector holds the numbers and shares of the words
that the group has, compressed; all words that it lacks have one share, so they are counted and not listed.

Groups are dealt over stations of at most STATION groups (one each up to LEAST stations a language). The stations
of a slice play a round-robin tournament by the circle method: in a round each meets one other, and the vectors of
one of the two travel to the other, which hosts. What a host meets comes in the order of the rounds: its own vectors
first, which it keeps, then its peers' one by one, each compared in both directions with all that are resident and
dropped again. So a task holds a station and one vector. LAP rounds go in one job, which bounds what travels at a
time. Words that set a group apart from its language are ranked by a heap where its vector is made.

Shares and divergences are whole numbers: shares are worked out in decimals of 38 digits, divergences from shares
of about a thousand million fit 64 bits, sums over a vocabulary included.

Cases: null text, lang and source are ''. A group without words, and a language without kept words, keep their
rows (value 0 where the language keeps none). Each row is a document, also if it repeats another. Texts of any
length are read whole. Equal values rank by item in the order of its bytes. An empty table gives no rows. Other
columns, whatever their names, take no part.
"""

from __future__ import annotations

import heapq
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleaner.llm.common import forget, q, written
from gleaner.llm.terms import LETTERS, Words

ONE = 1_000_000_000  # a share of one
SLICE = 1 << 16
STATION = 16
LEAST = 32
LAP = 32
HELD = 1 << 19  # words that a task counts before it passes its counts on


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, source, text as bytes) -> (lang, source, term, count, docs); a null term for each group."""
    words = Words(LETTERS)
    counts: dict = defaultdict(Counter)
    docs: dict = defaultdict(Counter)
    names = ["lang", "source", "term", "count", "docs"]
    kinds = [pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64()]

    def flush() -> Iterator[pa.RecordBatch]:
        for (lang, source), found in counts.items():
            in_docs = docs[lang, source]
            terms = [None, *found]
            for k in range(0, len(terms), 65536):
                part = terms[k : k + 65536]
                cols = [[lang] * len(part), [source] * len(part), part, [found.get(t, 0) for t in part], [in_docs.get(t, 0) for t in part]]
                cols = [pa.array(c, kind) for c, kind in zip(cols, kinds)]
                cols[2] = cols[2].cast(pa.string())
                yield pa.RecordBatch.from_arrays(cols, names=names)
        counts.clear()
        docs.clear()

    for batch in batches:
        for lang, source, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
            found, seen = counts[lang, source], set()
            for part in words.lists(text):
                found.update(part)
                seen.update(part)
            docs[lang, source].update(seen)
        if sum(map(len, counts.values())) > HELD:
            yield from flush()
    yield from flush()


def _packed(numbers: np.ndarray, shares: np.ndarray) -> bytes:
    """Ascending numbers as differences, then the shares, compressed."""
    return zlib.compress(np.diff(numbers, prepend=0).astype("<u4").tobytes() + shares.astype("<i8").tobytes(), 1)


def _unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = zlib.decompress(blob)
    n = len(raw) // 12
    return np.cumsum(np.frombuffer(raw, "<u4", n).astype(np.int64)), np.frombuffer(raw, "<i8", n, 4 * n)


def gain(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


VECTOR = "lang string, source string, slice long, item string, value long, blob binary"


def _vectors(top: int):
    """The rows of one group's slice -> its vector, and its `top` words above the language's share as items."""

    def run(rows: pa.Table) -> pa.Table:
        lang, source, part = (rows.column(c)[0].as_py() for c in ("lang", "source", "slice"))
        rows = rows.filter(pc.is_valid(rows["number"]))  # one row without a number stands for the group
        number, p, of_lang = (rows[c].to_numpy().astype(np.int64) for c in ("number", "p", "q"))
        order = np.argsort(number)
        blob = _packed(number[order], p[order])
        at = np.flatnonzero(p > of_lang)
        value = gain(p[at], of_lang[at])
        if len(at) > top:  # the heap sees what reaches the value of the last place
            good = value >= np.partition(value, -top)[-top]
            at, value = at[good], value[good]
        best = heapq.nsmallest(top, zip((-value).tolist(), rows["term"].take(pa.array(at)).to_pylist()))
        n = len(best) + 1
        cols = [[lang] * n, [source] * n, [part] * n, [None, *(t for _, t in best)], [0, *(-v for v, _ in best)], [blob, *[None] * (n - 1)]]
        return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()))], names=["lang", "source", "slice", "item", "value", "blob"])

    return run


def both_ways(a: tuple, b: tuple, size: int) -> tuple[int, int]:
    """Divergence of a from b and of b from a over a slice of `size` words; a vector is (numbers, shares, share of a
    word that it lacks)."""
    (i, p, p0), (j, r, r0) = a, b
    at = np.searchsorted(j, i)
    same = at < len(j)
    same[same] = j[at[same]] == i[same]
    there = np.full(len(i), r0)
    there[same] = r[at[same]]
    alone = np.ones(len(j), bool)
    alone[at[same]] = False
    r_alone, none = r[alone], size - len(i) - int(alone.sum())
    mine, low, high = np.int64(p0), np.int64(p0), np.int64(r0)
    one = gain(p, there).sum() + gain(mine, r_alone).sum() + none * gain(low, high)
    two = gain(there, p).sum() + gain(r_alone, mine).sum() + none * gain(high, low)
    return int(one), int(two)


def _host(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A station's own vectors (round -1), then its peers' in the order of the rounds -> divergences of each pair."""
    at, held = None, []
    for batch in batches:
        out: list[list] = [[], [], [], []]
        for lang, part, host, turn, source, blob, size, lacking, inner in zip(*(c.to_pylist() for c in batch.columns)):
            if at != (lang, part, host):
                at, held = (lang, part, host), []
            new = (*_unpacked(blob), lacking)
            if turn >= 0 or inner:
                for other, vector in held:
                    one, two = both_ways(new, vector, size) if size else (0, 0)
                    out[0] += [lang, lang]
                    out[1] += [source, other]
                    out[2] += [other, source]
                    out[3] += [one, two]
            if turn < 0:
                held.append((source, new))
        yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in out[:3]), pa.array(out[3], pa.int64())], names=["lang", "source", "item", "value"])


def meetings(station: str, stations: str, turn: str) -> tuple[Column, Column]:
    """(whom a station meets in a round, whether it hosts) by the circle method over an even number of places; the
    last place of an odd number of stations stands empty."""
    ring = f"({stations} + {stations} % 2 - 1)"
    peer = f"CASE WHEN {station} = {ring} THEN ({turn} * (({ring} + 1) div 2)) % {ring} WHEN pmod({turn} - {station}, {ring}) = {station} THEN {ring} ELSE pmod({turn} - {station}, {ring}) END"
    hosts = f"({station} < ({peer})) = (({station} + ({peer}) + {turn}) % 2 = 0)"
    return F.expr(peer), F.expr(hosts)


def audit(docs: DataFrame, min_docs: int = 3, top: int = 200, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """lang, source, part, item, value, rank: part `pair` has the divergence from every other source of the
    language, part `term` the `top` words that set the source apart from its language."""
    name = lambda c, to: F.coalesce(q(c).cast("string"), F.lit("")).alias(to)
    slim = docs.select(name(lang_col, "lang"), name(source_col, "source"), F.encode(q(text_col), "UTF-8").alias("text"))
    counts = slim.mapInArrow(_count, "lang string, source string, term string, count long, docs long")
    counts = written(counts.groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs")), "counts")
    kept = counts.filter("term is not null").groupBy("lang", "term").agg(F.sum("count").alias("total"), F.sum("docs").alias("docs")).filter(F.col("docs") >= min_docs)
    kept = written(kept.select("lang", "term", "total"), "kept")

    groups = counts.filter("term is null").select("lang", "source")
    sizes = kept.groupBy("lang").agg(F.count("*").alias("words"), F.sum("total").alias("tokens"))
    sizes = groups.groupBy("lang").agg(F.count("*").alias("groups")).join(sizes, "lang", "left").fillna(0)
    stations = F.expr(f"least(groups, greatest({LEAST}L, -((-groups) div {STATION}L)))")
    sizes = written(sizes.select("*", F.expr(f"greatest(1L, -((-words) div {SLICE}L))").alias("slices"), stations.alias("stations")), "sizes")

    share = lambda count, all_: F.expr(f"1L + (({ONE} * cast({count} + 1 as decimal(20,0))) div cast(greatest({all_} + words, 1L) as decimal(20,0)))")
    part = F.pmod(F.xxhash64("term"), F.col("slices")).alias("slice")
    numbered = kept.join(sizes, "lang").select("lang", "term", "total", "words", "tokens", "slices", part)
    numbered = numbered.withColumn("number", F.row_number().over(W.partitionBy("lang", "slice").orderBy("term")) - 1)
    numbered = written(numbered.select("lang", "term", "slice", "number", share("total", "tokens").alias("q")), "numbered")
    entries = written(counts.filter("term is not null").select("lang", "source", "term", "count").join(numbered, ["lang", "term"]), "entries")
    forget(kept)
    own = entries.groupBy("lang", "source").agg(F.sum("count").alias("own"))
    place = (F.row_number().over(W.partitionBy("lang").orderBy("source")) - 1).cast("long")
    groups = groups.join(own, ["lang", "source"], "left").fillna(0).join(sizes, "lang").withColumn("place", place)
    groups = written(groups.select("lang", "source", "own", "words", "slices", "stations", F.expr("place % stations").alias("station"), share("0", "own").alias("lacking")), "groups")

    rows = entries.join(groups.select("lang", "source", "own", "words"), ["lang", "source"]).select("lang", "source", "slice", "number", "term", share("count", "own").alias("p"), "q")
    marks = groups.select("lang", "source", F.explode(F.expr("sequence(0L, slices - 1)")).alias("slice"), F.lit(None).cast("int").alias("number"), F.lit(None).cast("string").alias("term"), F.lit(0).cast("long").alias("p"), F.lit(0).cast("long").alias("q"))
    made = written(rows.unionByName(marks).groupBy("lang", "slice", "source").applyInArrow(_vectors(top), VECTOR), "vectors")
    in_slice = numbered.groupBy("lang", "slice").agg(F.count("*").alias("size"))
    vectors = made.filter("item is null").select("lang", "source", "slice", "blob").join(groups.select("lang", "source", "station", "stations", "lacking"), ["lang", "source"])
    vectors = written(vectors.join(in_slice, ["lang", "slice"], "left").fillna(0, "size"), "stationed")

    last = sizes.agg(F.max("stations")).first()[0] or 0
    rounds = max(0, last + last % 2 - 1)
    peer, hosts = meetings("station", "stations", "turn")
    laps = []
    for start in range(0, max(1, rounds), LAP):
        sent = ["lang", "slice", "host", "turn", "source", "blob", "size", "lacking", "inner"]
        resident = vectors.select("lang", "slice", F.col("station").alias("host"), F.lit(-1).cast("long").alias("turn"), "source", "blob", "size", "lacking", F.lit(start == 0).alias("inner"))
        turns = F.expr(f"sequence({start}L, least(stations + stations % 2 - 2, {start + LAP - 1}L))")
        travelling = vectors.filter(f"stations > 1 AND stations + stations % 2 - 2 >= {start}").select("*", F.explode(turns).alias("turn"))
        travelling = travelling.select("*", peer.alias("host"), hosts.alias("stays"), F.lit(False).alias("inner")).filter("NOT stays AND host < stations")
        met = resident.select(sent).union(travelling.select(sent)).repartition("lang", "slice", "host").sortWithinPartitions("lang", "slice", "host", "turn", "source")
        laps.append(written(met.mapInArrow(_host, "lang string, source string, item string, value long").groupBy("lang", "source", "item").agg(F.sum("value").alias("value")), "lap"))

    pairs = laps[0]
    for lap in laps[1:]:
        pairs = pairs.union(lap)
    pairs = pairs.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    found = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value").union(made.filter("item is not null").select("lang", "source", F.lit("term").alias("part"), "item", "value"))
    order = W.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    return found.withColumn("rank", F.row_number().over(order)).filter((F.col("part") == "pair") | (F.col("rank") <= top))
