"""Inputs shared by the tests of this folder."""
SF001, SF01 = "/root/testdata/sf0.001", "/root/testdata/sf0.01"

#: Awkward rows: (doc_id, text, source).
AWKWARD = [
    (1, "", "a"), (2, None, "a"), (3, "One two  three\nfour", None), (4, "one TWO  three\nfour", "b"),
    (5, "Élan élan ÉLAN", "b"), (6, "élan élan ÉLAN", "b"), (7, "word " * 3000, "c"), (8, "x" * 5000, "c"),
    (9, "one", "c"), (9, "one", "c"), (10, " \t\n\x0b\x0c\r ", None), (11, "<|endoftext|> a<|endoftext|>b", "z"),
    (None, "no id", "z"), (12, " nbsp\u0085 x y", "z"),
]


def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
