"""Small document tables with awkward rows."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, starts int, prediction int"


def table(spark, rows):
    """rows: (doc_id, text) or (doc_id, text, lang); the other columns clash with names used inside."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", None, len(r[1] or ""), "k", 1, 2) for r in rows]
    return spark.createDataFrame(full, SCHEMA)


def rows_of(df):
    return [r.asDict() for r in df.collect()]
