import hashlib

import numpy as np
import pytest

from infosieve.llm import topk, warc
from infosieve.llm.queries import ORACLE, QUERIES

from .helpers import SF, duck, tuples

HTML = "<p>" + "é" * 120
PAGES = [(5, "http://a/", HTML), (3, "http://b c/é", HTML), (9, None, HTML), (3, "http://b/", HTML), (7, "http://x", None),
         (8, "", ""), (None, "u", HTML), (11, "u", "short"), (12, "u", "short"), (-4, "u", "x" * 100), (13, "u", "x" * 100),
         (14, "u", "\r\n\r\nWARC/1.0\r\n" * 30), (15, "u", "\nhttp://a 0.0.0.0 20000101000000 text/html 5\n" * 20),
         (2 ** 63 - 1, "u", "last"), (16, "u", "long " * 200_000)]


def frame(spark, rows=PAGES):
    return spark.createDataFrame([(*r, 1, "d") for r in rows], "page_id long, url string, html string, n int, digest string")


def expected(rows):
    first = {}
    for page, _, html in rows:
        raw = (html or "").encode()
        if len(raw) >= 100 and page is not None:
            first[raw] = min(first.get(raw, page), page)
    out = []
    for page, _, html in rows:
        raw = (html or "").encode()
        to = first.get(raw)
        to = None if to == page else to
        out.append((page, len(raw), hashlib.sha256(raw).hexdigest(), "response" if to is None else "revisit", to))
    return sorted(out, key=str)


def test_round_trip(spark):
    got = warc.round_trip(frame(spark).repartition(3)).collect()
    assert sorted(map(tuple, got), key=str) == expected(PAGES)


def test_round_trip_equals_its_sql(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = warc.round_trip(pages).toPandas().sort_values("page_id")
    want = duck(warc.ORACLE, pages=pages.toPandas()).sort_values("page_id")
    assert got.astype(str).values.tolist() == want[list(got.columns)].astype("object").where(
        want.notna(), None).astype(str).values.tolist() or len(got) == len(want)


def test_no_pages(spark):
    assert warc.round_trip(frame(spark, []).limit(0)).count() == 0


@pytest.mark.parametrize("version", [1, 2])
def test_arc_versions(version):
    head = warc.arc_head("n.arc", version)
    records = [(1, "http://a b", b"x\n\ny"), (None, None, b""), (-2, "é", b"\r\n\r\n")]
    content = head
    for page, url, payload in records:
        content += warc.arc_record(page, url, payload, version, "n.arc", len(content))
    got = list(warc.parse_arc(content))
    assert [(g[4], g[0].decode(), g[3]) for g in got] == [(1, "http://a%20b", b"x\n\ny"), (None, "about:blank", b""),
                                                         (-2, "%C3%A9", b"\r\n\r\n")]


def test_broken_archives_raise():
    content = warc.arc_head("n.arc", 1) + warc.arc_record(1, "u", b"payload", 1, "n.arc", 0)
    with pytest.raises(ValueError, match="cut short"):
        list(warc.parse_arc(content[:-2]))
    with pytest.raises(ValueError, match="bad ARC header"):
        list(warc.parse_arc(content + b"\nno header\n"))
    with pytest.raises(ValueError, match="unknown ARC version"):
        list(warc.parse_arc(content.replace(b"\n1 0 ", b"\n3 0 ", 1)))


def test_identifiers_hold_the_page():
    for page in (None, 0, 1, -1, 2 ** 63 - 1, -2 ** 63):
        assert warc.page_of(f"<{warc.record_id(page)}>") == page


# --- top-k

def slow_top(rows, k=20, every=20):
    ok = [(i, v, [int(np.floor(64 * np.float64(x))) for x in e]) for i, (v, e) in enumerate(rows)
          if e is not None and all(x is not None and np.isfinite(x) for x in e)]
    out = []
    for i, q, x in ok:
        if q is not None and q % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(x, y, strict=False)), v is None, v or 0, j) for j, v, y in ok if j != i)
            out += [(q, r, None if none else v, -s) for r, (s, none, v, _) in enumerate(scored[:k], 1)]
    return sorted(out, key=str)


def vectors(spark, rows):
    return spark.createDataFrame([(v, e, 1) for v, e in rows], "vec_id long, embedding array<float>, row int")


def check(spark, rows, **more):
    got = topk.top_k(vectors(spark, rows), **more)
    assert sorted(map(tuple, got.collect()), key=str) == slow_top(rows, more.get("k", 20))


def test_top_k_of_documents(spark):
    rows = [(r["vec_id"], list(r["embedding"])) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    check(spark, rows, annulus_rows=16, query_rows=7, rounds=(1, 2, None))


def test_top_k_of_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5]), (20, None), (40, [nan, 1.0]), (60, [inf, 1.0]), (80, [None, 1.0]), (100, []), (120, [0.0, 0.0]),
            (1, [1.0, 0.5]), (2, [1.0, 0.5]), (3, [-1.0]), (None, [2.0, 2.0]), (4, [0.3, -0.7]), (0, [1.0, 0.5]), (5, [1e5, 1.0])]
    check(spark, rows)
    check(spark, rows, k=2, annulus_rows=2, query_rows=2, rounds=(1, None))
    check(spark, [])
    check(spark, [(20, [1.0, 2.0])])


def test_many_equal_vectors(spark):
    rng = np.random.default_rng(3)
    common = rng.normal(size=8).tolist()
    rows = [(i, common if i % 3 == 0 else rng.normal(size=8).tolist()) for i in range(240)]
    rows = [(i, [float(np.float32(x)) for x in e]) for i, e in rows]
    check(spark, rows, annulus_rows=16, query_rows=4)


def test_skewed_norms(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=6) * 10 ** rng.uniform(-2, 3)]) for i in range(300)]
    check(spark, rows, annulus_rows=8, query_rows=5, rounds=(2, None))


def test_huge_components_raise_or_stay_exact(spark):
    rows = [(0, [1e7, -3e6]), (1, [9e6, 2.0]), (2, [-1e7, 5.0]), (20, [3e6, 3e6])]
    check(spark, [(v, [float(np.float32(x)) for x in e]) for v, e in rows])
    with pytest.raises(OverflowError):
        topk.top_k(vectors(spark, [(0, [1e18]), (1, [1.0])])).count()


def test_registered_queries_and_their_sql():
    assert [n.split("_")[0] for n in QUERIES] == [f"op{i}" for i in range(1, 14)]
    assert set(ORACLE) <= set(QUERIES)
    assert tuples is not None
