import hashlib
import os
import random
import re
from itertools import combinations

import pytest
import regex
from gleaner.llm import spotsigs
from gleaner.llm.common import shared_dir
from gleaner.llm.queries import op7_spotsigs
from pyspark.sql import functions as F

from .util import docs


def plain_spots(text):
    w = [x for x in regex.split(r"[^\p{L}\p{N}]+", (text or "").lower()) if x]
    anchors, out = set(spotsigs.ANCHORS), set()
    for i, x in enumerate(w):
        if x not in anchors:
            continue
        chain, skipped, j = [], 0, i + 1
        while j < len(w) and len(chain) < spotsigs.CHAIN:
            if w[j] in anchors:
                skipped += 1
                if skipped > spotsigs.REACH:
                    break
            else:
                chain.append(w[j])
                skipped = 0
            j += 1
        if len(chain) == spotsigs.CHAIN:
            out.add((x, *chain))
    return out or {("whole", *w)}


def jaccard(a, b):
    return len(a & b) / len(a | b)


def plain(rows):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    out = []
    for k, (i, x) in enumerate(order):
        x, y = x or "", order[(k + 1) % len(order)][1] or ""
        n = len(x) // 4
        e = x[: len(x) - n] + y[:n]
        out.append((i, len(x), hashlib.sha256(e.encode()).hexdigest(), round(jaccard(plain_spots(x), plain_spots(e)), 9), round(jaccard(plain_spots(x), plain_spots(y)), 9)))
    return sorted(out, key=repr)


def corpus(n=80, seed=1):
    rng = random.Random(seed)
    vocabulary = ["the", "of", "la", "und", "é"] * 4 + [f"w{k}" for k in range(60)]
    rows = []
    for i in range(n):
        if i and rng.random() < 0.4:
            w = (rng.choice(rows)[1] or "").split(" ")
            w[rng.randrange(len(w))] = "changed"
            rows.append((i * 3, " ".join(w)))
        else:
            rows.append((i * 3, " ".join(rng.choices(vocabulary, k=rng.choice((1, 4, 60, 200)))) + rng.choice(["", ".", "😀!"])))
    return rows


@pytest.mark.parametrize("per", [4096, 10])
def test_query_matches_brute_force(spark, tmp_path, monkeypatch, per):
    monkeypatch.setattr(spotsigs, "ROWS_PER_BUCKET", per)
    rows = corpus() + [(1000, None), (1001, ""), (1002, "the the the"), (1003, "the " * 12 + "a1 b2 c3"), (1004, "x" * 9), (5, "the same row"), (5, "the same row"), (None, "of no id"), (1005, "the w " * 30_000)]
    docs(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = op7_spotsigs(spark, str(tmp_path)).collect()
    assert sorted(((r.doc_id if r.doc_id != -(2**63) else None, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in got), key=repr) == plain(rows)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, r.fingerprint)
    assert by[1000] == by[1001] != by[1004]
    assert groups_of(rows, 0.8) == sorted(((r.doc_id, r.group_id) for r in got), key=repr)


def groups_of(rows, least):
    """(id, smallest id reachable over sets at least so alike) of every row."""
    spots = {}
    for i, x in rows:
        spots.setdefault(frozenset(plain_spots(x)), []).append(i)
    group = {s: {s} for s in spots}
    for s, o in combinations(spots, 2):
        if group[s] is not group[o] and jaccard(s, o) >= least:
            group[s] |= group[o]
            for x in group[o]:
                group[x] = group[s]
    first = lambda g: min((i for s in g for i in spots[s] if i is not None), default=None)
    return sorted(((i, first(group[s])) for s, ids in spots.items() for i in ids), key=repr)


@pytest.mark.parametrize(("least", "cell", "rounds"), [(0.8, 1 << 10, 2), (0.7, 3, 0), (0.6, 3, 1), (0.55, 1, 2)])
def test_groups_match_brute_force(spark, monkeypatch, least, cell, rounds):
    monkeypatch.setattr(spotsigs, "CELL", cell)
    monkeypatch.setattr(spotsigs, "ROUNDS", rounds)
    rng, rows = random.Random(4), corpus(100, 3) + [(9000, None), (9001, "one two"), (9001, "One, two!")]
    base = ["the", "of"] * 40 + [f"b{k}" for k in range(160)]
    rng.shuffle(base)
    for k in range(60):  # one base, independent edits: copies are less like each other than like the base
        w = list(base)
        for at in rng.sample(range(len(w)), 1 + k % 12):
            w[at] = f"e{k}"
        rows.append((5000 + k, " ".join(w)))
    sigs = docs(spark, rows).select("doc_id", spotsigs.signatures(F.col("text")).alias("sigs"))
    got = sorted(((r.doc_id, r.group_id) for r in spotsigs.with_groups(sigs, least).collect()), key=repr)
    want = groups_of(rows, least)
    assert got == want and len({g for _, g in want}) < len({i for i, _ in want})


def test_pairs_match_brute_force(spark):
    rows = corpus(120, 9) + [(9000, None), (9001, ""), (9002, "one two"), (9002, "One, two!")]
    members, pairs = spotsigs.similar_pairs(docs(spark, rows).withColumns({"class": F.lit(1), "sigs": F.lit(2), "n": F.lit(3)}), 0.7)
    of = {}
    for r in members.collect():
        of.setdefault(r.doc_id, r["class"])
    got = {frozenset((r.class_a, r.class_b)): round(r.likeness, 9) for r in pairs.collect()}
    want = {}
    for (i, x), (j, y) in combinations(rows, 2):
        a, b = plain_spots(x), plain_spots(y)
        assert (a == b) == (of[i] == of[j])
        if a != b and jaccard(a, b) >= 0.7:
            want[frozenset((of[i], of[j]))] = round(jaccard(a, b), 9)
    assert got == want and want
    cells = spotsigs.similar_classes(docs(spark, rows).select(spotsigs.signatures(F.col("text")).alias("sigs")), 0.7, cell=2)[1]
    assert {frozenset((r.class_a, r.class_b)): round(r.likeness, 9) for r in cells.collect()} == want
    for least in (0.55, 0.6):  # times a length they are no whole numbers
        found = spotsigs.similar_pairs(docs(spark, rows), least)[1].count()
        sets = {frozenset(plain_spots(x)) for _, x in rows}
        assert found == sum(jaccard(a, b) >= least for a, b in combinations(sets, 2))


def test_empty_table(spark, tmp_path):
    docs(spark, []).write.parquet(str(tmp_path / "documents.parquet"))
    assert op7_spotsigs(spark, str(tmp_path)).count() == 0
    assert spotsigs.similar_pairs(docs(spark, []))[1].count() == 0


def test_anchor_list_is_plain():
    assert all(re.fullmatch(r"\w+", w) for w in spotsigs.ANCHORS)


def test_signatures_are_kept_once(spark):
    """While groups are found the rows have no signatures with them; the classes have."""
    rows = docs(spark, corpus(30)).select("doc_id", spotsigs.signatures(F.col("text")).alias("sigs"))
    top = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}".removeprefix("file://")
    before = set(os.listdir(top)) if os.path.isdir(top) else set()
    out = spotsigs.with_groups(rows)
    left = {x[:-33] for x in set(os.listdir(top)) - before}
    assert "rows-of-classes" in left and not left & {"fingerprints", "signature-classes"}
    assert out.count() == 30 and out.columns == ["class_id", "doc_id", "group_id"]
