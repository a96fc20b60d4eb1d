import pytest
from pyspark.sql import functions as F

#: Nulls, empties, ties, repeated rows, long and odd texts.
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog. Then it rests in the shade of a tall old tree.\nA second line! Yes? No.", "en", "src0"),
    (2, "The quick brown fox jumps over the lazy dog. Then it rests in the shade of a tall old tree.\nA second line! Yes? No.", "en", "src0"),
    (3, "the QUICK brown fox jumps over the lazy dog. Then it rests in the shade of a tall old tree.\nA second line! Yes? No.", "en", "src1"),
    (4, " The quick  brown fox jumps over the lazy dog. Then it rests in the shade of a tall old tree.\nA second line! Yes? No.", "de", "src2"),
    (5, "", "en", "src0"),
    (6, None, None, None),
    (7, "   \n\t ", "fr", "src3"),
    (8, "naïve café 😀 ﬁn — größe Ω İstanbul x́   end 12345 don't I'M", "fr", "src3"),
    (9, "word " * 3000 + "end", "en", "src0"),
    (10, "word " * 2999 + "end", "en", "src0"),
    (11, "aaaa" * 60, "en", "src5"),
    (12, "b" + "aaaa" * 60, "en", "src5"),
    (12, "b" + "aaaa" * 60, "en", "src5"),
    (None, "no id but a text that is quite long, long enough to hold fifty bytes and more", "en", "src9"),
    (14, "no id but a text that is quite long, long enough to hold fifty bytes and more", "en", "src9"),
    (15, "Mail Jo.Doe@Example.org or jo.doe@example.org; +1 (499) 555-6503, Mrs Anna Smith, Dr. Anna Smith, 10.20.30.40, 4539578763621486  ", "en", "src7"),
    (16, "<|endoftext|> <|startoftext|>\x0b\x0c\x85   a", "es", "src4"),
]
CLASHES = ("norm", "salt", "key", "fp", "row", "place", "kind", "rest", "domain", "words", "block", "_text", "text_sha256")


@pytest.fixture(scope="session")
def docs(spark):
    frame = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string")
    for name in CLASHES:
        frame = frame.withColumn(name, F.lit("clash"))
    return frame.repartition(3).cache()


@pytest.fixture(scope="session")
def none(docs):
    return docs.filter("doc_id = -1")
