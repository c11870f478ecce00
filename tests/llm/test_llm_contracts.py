"""Cases that the contracts of the queries name and the given tables lack."""

import zlib

import numpy as np
from tokenizers import Tokenizer

from weftframe.llm import language_parsing, token_lists
from weftframe.llm.common import vocabulary
from weftframe.session import scratch_path


def test_texts_without_letters_are_undetermined(spark):
    learned = {"en": "the quick brown fox jumps over the lazy dog", "de": "der schnelle braune fuchs springt"}
    texts = ["½ ² Ⅷ ①", "٣٤٥ 12", "  \n_-", "́̈", "", None]
    docs = spark.createDataFrame(list(enumerate([*texts, "² the lazy fox ①"])), "doc_id long, text string")
    found = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_parsing.predict(docs, learned).collect()}
    assert all(found[i] == ("und", 0.0) for i in range(len(texts)))
    assert found[len(texts)][0] == "en"
    kept = language_parsing.keep_known(docs, learned, 0.5)
    assert [r["doc_id"] for r in kept.collect()] == [len(texts)]


def test_number_signs_do_not_change_a_prediction(spark):
    learned = {"en": "the quick brown fox jumps over the lazy dog", "de": "der schnelle braune fuchs springt"}
    docs = spark.createDataFrame([(1, "the fox² jumps①over"), (2, "the fox jumps over")], "doc_id long, text string")
    a, b = language_parsing.predict(docs, learned).orderBy("doc_id").collect()
    assert (a["lang_pred"], a["score"]) == (b["lang_pred"], b["score"])


def test_strings_of_added_tokens_as_the_plain_library_encodes_them(spark):
    file = vocabulary("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(file)
    added = [token.content for token in tokenizer.get_added_tokens_decoder().values()]
    texts = [f"before{a}after {a} {a}{a}" for a in added] + [added[0] * 3, f"<{added[0]}>", "<|endoftext", "plain words", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    path = scratch_path(spark, "added")
    token_lists.write_tokens(docs, path, file)
    start = 0
    for row in token_lists.checksums(spark, path).orderBy("doc_id").collect():
        ids = tokenizer.encode(texts[row["doc_id"]] or "", add_special_tokens=False).ids + [2]
        expected = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        assert (row["start"], row["n_tokens"], row["ids_crc32"]) == expected, texts[row["doc_id"]]
        start += len(ids)
