"""Documents with every awkward case, shared by the tests of this folder."""

from pyspark.sql import types as T

SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
)
LINE = "this licence line is shared by many of the documents here"


def rows():
    long = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
    prose = "The quick brown fox jumps over the lazy dog while the cat sleeps. " * 3
    texts = [
        None,
        "",
        " \t\n ",
        "one",
        "two words",
        prose,
        prose.upper(),
        prose + " \n",
        long,
        long + " tail",
        f"{LINE}\nalpha\n\n{LINE.upper()} ",
        *[f"{LINE}\nbody {i}\n  {LINE}" for i in range(6)],
        "naïve café    übergrößenträger 日本語のテキスト 😀 é",
        "a" * 5000,
        "mail a.b@example.com, 10.0.0.1 and 4111 1111 1111 1111; call +49 (30) 123-4567.",
    ]
    out = [(i, t, "en" if i % 3 else None, f"src{i % 4}" if i % 5 else None, len(t) if t else None) for i, t in enumerate(texts)]
    return [*out, out[5], out[5], (None, "an id is missing here", "de", "src1", 21), (None, None, None, None, None)]


def documents(spark, made=None):
    return spark.createDataFrame(rows() if made is None else made, SCHEMA)


def clashing(df, *names):
    """The same rows with further columns named as an operator's own."""
    for n in names:
        df = df.selectExpr("*", f"'mine' as `{n}`")
    return df
