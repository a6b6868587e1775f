"""Documents for the tests of this folder."""

#: Null, empty and blank texts, ties, repeated rows, a null id and a long text.
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "satu dua tiga"), (4, "satu dua tiga"), (5, "satu dua tiga"), (None, "satu dua tiga"), (6, "kata " * 30_000), (7, "a"), (8, "é ü <|endoftext|> 'S don't")]


def make_docs(spark, rows, parts=3):
    """Documents of (doc_id, text) pairs, with further columns whose names clash with names the operators use."""
    df = spark.createDataFrame([(i, t, f"s{k % 3}" if k % 4 else None, "en") for k, (i, t) in enumerate(rows)], "doc_id long, text string, source string, lang string")
    return df.selectExpr("*", "1 as h", "'x' as key", "2 as fp", "3 as size", "4 as batch", "6 as n").repartition(parts)
