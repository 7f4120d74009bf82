"""Small tables with every kind of awkward row, and access to the sample folder."""

import duckdb

SF = "/root/testdata/sf0.001"


def sample(name, columns):
    return duckdb.sql(f"SELECT {columns} FROM read_parquet('{SF}/{name}.parquet')").fetchall()


#: Null, empty, blank, one word, repeated rows and ids, unusual characters, a null id, long texts.
ODD = [
    (-1, None), (-2, ""), (-3, " \n\t "), (-4, "word"), (-5, "Ünïcode ΣΑΣ «quoted», x's 12.5% \x1c漢字 𝔘 é"),
    (-6, "same text of some words that is here twice"), (-6, "same text of some words that is here twice"), (-7, "same text of some words that is here twice"),
    (None, "a row without an id but with words"), (-8, "a b c d e f g h " * 4000), (-9, "x" * 50_000), (-10, "1.2.3.4 a@b.co +1 (743) 555-3824 4111 1111 1111 1111"),
]


def documents(spark, rows=None, extra=True):
    """A table of documents; the extra columns clash with names used inside operators."""
    rows = ODD if rows is None else rows
    df = spark.createDataFrame([(i, t, "en", "s", len(t) if t is not None else None, 1, "z") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, score int, _id string")
    return df if extra else df.drop("score", "_id")
