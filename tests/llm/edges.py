"""A documents table that holds every awkward case, and one with clashing extra columns."""

CLASHES = ["node", "key", "family", "n", "h1", "repeats", "component", "score", "pii", "n_lines", "label", "shard", "row_no", "digest", "__id", "size", "length", "list", "word", "bits", "bucket", "data", "g", "side"]


def edge_rows():
    long_text = " ".join(f"wort{i % 997}" for i in range(40_000)) + "\n" + "x" * 50_000
    return [
        (1, "The quick brown fox jumps over the lazy dog and runs away.\nAll rights reserved to nobody."),
        (2, "The quick brown fox jumps over the lazy dog and runs away.\nAll rights reserved to nobody."),
        (2, "The quick brown fox jumps over the lazy dog and runs away.\nAll rights reserved to nobody."),
        (3, None),
        (4, ""),
        (5, " \t\n "),
        (6, "ein"),
        (7, long_text),
        (None, "a text without an id, mail a.b@mail.example.com please"),
        (None, None),
        (9, "é ñ 日本 \x00 \U0001f600 ﬁ ▁ <|endoftext|> 4041 8949 7460 8795"),
        (-5, "The quick brown fox jumps over the lazy dog and runs awax.\nsomething else altogether here"),
    ]


def edge_docs(spark):
    return spark.createDataFrame([(k, t, None, "src0", None) for k, t in edge_rows()], "doc_id long, text string, lang string, source string, n_chars long")


def empty_docs(spark):
    return edge_docs(spark).where("false")


def clashing_docs(spark):
    from pyspark.sql import functions as F

    return edge_docs(spark).withColumns({c: F.lit("mine") for c in CLASHES})


def small(spark, data):
    return spark.read.parquet(f"{data}/sf0.001/documents.parquet")


def table_of(df):
    return sorted((tuple(str(v) for v in r) for r in df.collect()))
