"""Small tables with the awkward rows that every operator has to take."""

from __future__ import annotations

SF = "/root/testdata/sf0.001"

LONG = " ".join(f"word{i % 997} the of é{i % 13}" for i in range(8000))
EDGES = [
    (1, "The cat sat on the mat and then the cat left, all rights reserved.", "en", "b"),
    (2, None, "en", "a"),
    (3, "", None, "a"),
    (4, "   \t\n ", "fr", None),
    (5, LONG, "en", "b"),
    (6, "The cat sat on the mat and then the cat left, all rights reserved.", "en", "b"),
    (6, "The cat sat on the mat and then the cat left, all rights reserved.", "en", "b"),
    (7, "one", "de", "c"),
    (8, "é日本 x y <|endoftext|> 'twas\r\n\r\nfoo", "fr", None),
    (9, "CC-BY cc by, GNU General Public License, version 3! MAIL a.b@c.example 4111 1111 1111 1111 +1 (555) 555-2485", "en", "a"),
    (None, "no id here", "en", "a"),
    (10, "!!! ??? 12 34", "en", "c"),
]


def documents(spark, rows=EDGES):
    """``documents`` with extra columns whose names the operators use themselves."""
    return spark.createDataFrame(
        [(*r, 1, "x", 2.0, [1], 3, "y", 4, 5, 6) for r in rows],
        "doc_id long, text string, lang string, source string, size long, fp string, rate double, light array<int>, "
        "_rows int, _lang string, `a.b` int, _id int, _pid int")


def tuples(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=lambda t: tuple((x is not None, str(x)) for x in t))


def duck(sql, **tables):
    """Rows of DuckDB SQL over pandas tables."""
    import duckdb
    c = duckdb.connect()
    for name, frame in tables.items():
        c.register(name, frame)
    return c.sql(sql).df()
