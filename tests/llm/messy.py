"""Documents with everything that may go wrong, and columns whose names operators use inside."""

from pyspark.sql import functions as F

LONG = " ".join(f"w{i % 977}x{i}" for i in range(40_000))
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog near the river bank today.", "en", "a"),
    (2, "The quick brown fox jumps over the lazy dog near the river bank today.", "en", "b"),
    (2, "The quick brown fox jumps over the lazy dog near the river bank today.", "en", "b"),
    (3, None, "en", "a"),
    (4, "", None, "a"),
    (5, " \n\t ", "de", None),
    (6, LONG, None, None),
    (7, "one", "en", "a"),
    (None, "A text without an id, mail ab12@x.example.com", "en", "a"),
    (None, None, None, None),
    (8, "Grüße aus Köln — «ça» 東京 \U0001f600 \x00 end", "de", "b"),
    (9, "zwei", "de", "b"),
    (9, "drei", "de", "a"),
]
#: One word of 100,000 signs, as text without white space has it.
UNSPACED = (10, "東京ab" * 25_000, "de", "a")
SCHEMA = "doc_id long, text string, lang string, source string"
CLASHES = ("key", "rep", "size", "rate", "root", "id", "word", "row", "h", "span", "copy", "copies", "tokens", "part", "parts", "found", "good", "payload", "n", "_gone", "_id")


def docs(spark, rows=ROWS):
    d = spark.createDataFrame(rows, SCHEMA).withColumn("n_chars", F.length("text").cast("long"))
    return d.withColumns({c: F.lit(f"own {c}") for c in CLASHES})


def table(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def kept(df, names=("doc_id", "text", "lang", "source")):
    return sorted(map(repr, map(tuple, df.select(*names).collect())))
