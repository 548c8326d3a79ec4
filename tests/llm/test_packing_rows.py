"""Operator 10: special tokens in any case, and rows that share an id or have none."""

import json
import zlib

import numpy as np
from pyspark.sql import functions as F

from tidewright.llm import packing, tokens

PATH = "word_bpe_49k.json"


def test_special_tokens_in_any_case():
    tok, known = tokens.tokenizer(PATH), packing.WordIds(PATH)
    for t in ("A <|ENDOFTEXT|> b", "X<|EndOfText|>Y, Z.", "Say <|endoftext|> Now. <|STARTOFTEXT|><|startoftext|>!", "<| A |> THE END, Of.", "no MARK Here.", "<|Foo. <|FOO... <|ENDOFTEXT|>. it's", "\u0130<|ENDOFTEXT|>\u00c9 \u212a"):
        words = packing.words_of(t.encode())
        known.learn(set(words))
        assert known.encode(words).tolist() == tok.encode(t, add_special_tokens=False).ids + [0], t


def test_rows_without_id_are_dealt_to_all_partitions(spark):
    ids = np.array([1, 0], "<u4")
    rows = [(None, 0, 0, 2, zlib.crc32(ids.tobytes()))] * 600 + [(7, 0, 0, 2, 5)] * 600
    cut = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long")
    packed = packing.pack(cut, 64, partition=150).cache()
    assert packed.count() == 1200 and packed.groupBy("doc_id").count().where("count = 600").count() == 2
    # bits 25 to 49 of a sequence's number are its partition, those from 50 on its round
    held = packed.where(F.shiftright("sequence_id", 50) == 0).groupBy(F.shiftright("sequence_id", 25).alias("p")).count().collect()
    assert len(held) == 8 and max(r["count"] for r in held) < 300


def test_words_are_encoded_apart_only_where_special_tokens_match_as_they_stand():
    said = json.loads(tokens.tokenizer(PATH).to_str())

    class Said:
        def to_str(self):
            return json.dumps(said)

    assert packing.by_words(Said())
    for how in ("lstrip", "rstrip", "single_word", "normalized"):
        said["added_tokens"][0][how] = True
        assert not packing.by_words(Said())
        said["added_tokens"][0][how] = False
    assert packing.by_words(Said())
