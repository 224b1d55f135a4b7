"""Shared by the tests of the training-data operators."""

SMALL = "/root/testdata/sf0.001"

ODD = [None, "", " ", "a  b\n\n c", "<|endoftext|>x<|startoftext|> <|endoftext|>", "don't DON'T I'll",
       "\x85 a\xa0b\x1cd\x1f e", "İstanbul ŉ ſ Straße ΑΣ ﬁ 日本語 テスト 😀👍🏽", "é é", "x²³ ½ 12345 ٣٤",
       " a​b﻿", "ŒUVRE œ", "w" * 3000, "zq" * 500 + " the end", "a b c d e f g h " * 300,
       "one\none\none\n\n", "\n\r\t", "ÀÉ " * 40]


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr if any(
        r[0] is None for r in df.collect()) else lambda r: r[0])


def docs_of(spark, sf):
    return [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]


def same(a, b):
    return sorted(map(repr, a)) == sorted(map(repr, b))
