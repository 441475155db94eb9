import hashlib
from collections import defaultdict

import duckdb
import pytest

from rowgate.llm import linededup
from rowgate.llm.queries import ORACLES, op12_lines

SF = "/root/testdata/sf0.01"
BLANKS = " \t\n\x0b\x0c\r"


def plain_key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(BLANKS))


def plain(rows, min_chars=20, min_docs=3):
    """(id, kept text, lines, dropped) of each (id, text)."""
    holders = defaultdict(list)
    for n, (_, text) in enumerate(rows):
        for key in {plain_key(x) for x in (text or "").split("\n")}:
            if len(key) >= min_chars:
                holders[key].append(n)
    keeper = {k: max((rows[n][0] for n in h if rows[n][0] is not None), default=None) for k, h in holders.items() if len(h) >= min_docs}
    out = []
    for d, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if keeper.get(plain_key(x), d) == d]
        out.append((d, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


def test_query_agrees_with_brute_force_and_sql(spark):
    got = sorted(tuple(r) for r in op12_lines(spark, SF).select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect())
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert got == sorted((d, n, gone, hashlib.sha256(t.encode()).hexdigest()) for d, t, n, gone in plain(rows))
    assert sum(r[2] for r in got) > 0
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    assert sorted(con.execute(f"SELECT doc_id, n_lines, n_dropped, kept_sha256 FROM ({ORACLES['op12_lines']})").fetchall()) == got


LONG = "A line that is long enough"


@pytest.mark.parametrize("texts", [
    [(1, LONG), (2, f"  {LONG.upper()}\t\nown"), (3, f"x\n{LONG}\r\n{LONG}"), (4, "short"), (5, "short"), (6, "short")],
    [(1, LONG), (2, LONG)],
    [(1, f"{LONG}\n{LONG}\n{LONG}"), (2, LONG)],  # three lines, but two documents
    [(1, LONG), (1, LONG), (1, LONG), (2, None), (2, ""), (2, "\n")],  # repeated rows
    [(None, LONG), (None, LONG), (None, f"y\n{LONG}")],  # held by null ids only
    [(None, f"a\n{LONG}"), (1, LONG), (2, f"{LONG}\nb")],
    [(i, "é" * 19) for i in range(4)] + [(i, "é" * 20) for i in range(4, 8)] + [(i, "é" * 19 + "  ") for i in range(8, 12)],
    [(i, "\n".join(f"{'z' * 20} {n}" for n in range(20_000))) for i in range(3)] + [(9, "z" * 300_000)],  # very long texts
    [(i, f"\xa0{LONG}\xa0") for i in range(3)] + [(i, "\x1c" * 20) for i in range(4, 7)],  # blanks of other kinds belong to the line
    [],
])
def test_odd_rows(spark, texts):
    docs = spark.createDataFrame([(d, t, "x", [1]) for d, t in texts], "doc_id bigint, text string, KEPT_text string, a array<int>")
    found = linededup.drop_shared_lines(docs, names=("kept_text", "lines", "gone"))
    assert found.columns == [*docs.columns, "_kept_text", "lines", "gone"]
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted((tuple(r) for r in found.select("doc_id", "_kept_text", "lines", "gone").collect()), key=key) == sorted(plain(texts), key=key)


def test_text_ids_and_bounds(spark):
    docs = spark.createDataFrame([("b", "one two"), ("a", "one two"), ("c", "three")], "id string, body string")
    found = linededup.drop_shared_lines(docs, "id", "body", min_chars=1, min_docs=2)
    assert sorted((r.id, r.kept_text) for r in found.collect()) == [("a", ""), ("b", "one two"), ("c", "three")]
    with pytest.raises(ValueError):
        linededup.drop_shared_lines(docs, "id", "body", min_docs=0)
