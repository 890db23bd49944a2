from collections import Counter, defaultdict

from gleaner.llm.line_dedup import dedup_lines, line_key
from pyspark.sql import functions as F

from .util import docs

LONG = "This line is long enough to be dropped."


def brute(rows, min_chars=20, min_docs=3):
    n, keeper = Counter(), defaultdict(lambda: -(2**63))
    for i, x in rows:
        for k in {line_key(y.encode()).decode() for y in (x or "").split("\n")}:
            if len(k) >= min_chars:
                n[k] += 1
                keeper[k] = max(keeper[k], -(2**63) if i is None else i)
    out = []
    for i, x in rows:
        lines = (x or "").split("\n")
        left = [y for y in lines if n[k := line_key(y.encode()).decode()] < min_docs or keeper[k] <= (-(2**63) if i is None else i)]
        out.append((i, None if x is None else "\n".join(left), len(lines), len(lines) - len(left)))
    return sorted(out, key=repr)


def test_matches_brute_force_on_odd_rows(spark):
    rows = [
        (1, f"a\n{LONG}\nb"), (2, f"\t {LONG.upper()} \r\nown"), (3, LONG), (4, f"{LONG}\n{LONG}"), (4, f"x\n{LONG}"),
        (None, LONG), (5, None), (6, ""), (7, "short\nshort"), (8, "short"), (9, "short\n\n"),
        (10, "é" * 20), (11, "é" * 20), (12, "É" * 20), (13, "é" * 20 + "\n" + "é" * 19), (14, "é" * 19), (15, "é" * 19),
        (16, " " + LONG), (17, "w " * 60_000 + "\n" + LONG),
    ]
    got = dedup_lines(docs(spark, rows)).select("doc_id", "text", "n_lines", "n_dropped").collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(rows)


def test_a_full_filter_loses_nothing(spark):
    rows = [(i, "\n".join(f"line number {(i * 7 + j * j) % 900} of so many in the table" for j in range(30))) for i in range(400)]
    for bits in (1 << 6, 1 << 12, 1 << 20):
        got = dedup_lines(docs(spark, rows), max_filter_bits=bits).select("doc_id", "text", "n_lines", "n_dropped").collect()
        assert sorted((tuple(r) for r in got), key=repr) == brute(rows)


def test_empty_table_and_clashing_columns(spark):
    assert dedup_lines(docs(spark, [])).count() == 0
    table = docs(spark, [(1, LONG), (2, LONG), (3, LONG)]).withColumns({"N_Lines": F.lit("x"), "id": F.lit(7), "__gone_id": F.lit(None), "a.b": F.lit(1)})
    out = dedup_lines(table)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "id", "__gone_id", "a.b", "n_lines", "n_dropped"]
    assert {r.doc_id: r.text for r in out.collect()} == {1: "", 2: "", 3: LONG}
