import json
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from rxframe.llm import token_files as tf
from rxframe.llm.queries import tokenizer_path
from rxframe.session import scratch_path
from edge_rows import EDGE


TOK = []


def table(spark, docs):
    path = scratch_path(spark, "t")
    tf.write_tokens(docs, path, tokenizer_path())
    return path, tf.token_table(spark, path)


def expected(rows):
    tok, start, out = Tokenizer.from_file(tokenizer_path()), 0, []
    for i, text in rows:
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_round_trip(spark, sf_docs):
    path, t = table(spark, sf_docs.repartition(4))
    rows = sorted((r["doc_id"], r["text"]) for r in sf_docs.collect())
    assert sorted(map(tuple, t.collect())) == expected(rows)
    import glob
    meta = pq.ParquetFile(glob.glob(f"{path.replace('file:', '')}/*.parquet")[0]).metadata
    col = {meta.row_group(0).column(j).path_in_schema: meta.row_group(0).column(j) for j in range(meta.num_columns)}
    assert "RLE_DICTIONARY" in col["ids.list.element"].encodings
    assert "DELTA_BINARY_PACKED" in col["doc_id"].encodings
    assert col["doc_id"].has_offset_index and col["doc_id"].has_column_index


def test_edge_rows(spark, make_docs):
    _, t = table(spark, make_docs(EDGE))
    got = sorted(((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in t.collect()), key=str)
    assert got == sorted(((i, n, c) for i, _, n, c in expected(EDGE)), key=str)
    starts = sorted((r["start"], r["n_tokens"]) for r in t.collect())
    assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:])) and starts[0][0] == 0
    _, t = table(spark, make_docs([]))
    assert t.count() == 0


PARTS = ["Some", "words", "don't", "é", "e\u0301", "ΑΣ", "Σ", "12", "３", "\u00a0", "\x85", "\x1c", "\u3000", " ", "\n", "\t", "  ",
         "<|endoftext|>", "<|startoftext|>", "<|", "日本語", "각", "\u1100", "\u1161", "\u0301", "x" * 90, "'s", "!!", "ﬁ", "😀", "É", "ß", "×", "ÿ", "İ", "'S", "'ll", "<|ENDOFTEXT|>"]


@given(st.lists(st.text(st.characters(min_codepoint=9, max_codepoint=0x130), max_size=60), min_size=1, max_size=4))
@settings(max_examples=300, deadline=None)
def test_latin_words_are_cut_as_the_file_says(texts):
    whole = Tokenizer.from_file(tokenizer_path()) if not TOK else TOK[0]
    TOK[:] = [whole]
    want = [whole.encode(t, add_special_tokens=False).ids for t in texts]
    assert tf.encode(pa.array(texts), tokenizer_path(), None).to_pylist() == want


@given(st.lists(st.lists(st.sampled_from(PARTS), max_size=12).map("".join), min_size=1, max_size=4))
@settings(max_examples=400, deadline=None)
def test_words_in_a_row_are_the_whole_text(texts):
    whole = Tokenizer.from_file(tokenizer_path()) if not TOK else TOK[0]
    TOK[:] = [whole]
    want = [whole.encode(t, add_special_tokens=False).ids for t in texts]
    assert tf.encode(pa.array(texts), tokenizer_path(), None).to_pylist() == want


def test_forgetting_changes_nothing(monkeypatch, sf_docs):
    texts = [r["text"] for r in sf_docs.limit(40).collect()]
    want = tf.encode(pa.array(texts), tokenizer_path()).to_pylist()
    monkeypatch.setattr(tf, "KNOWN_WORDS", 50)
    assert [tf.encode(pa.array([t]), tokenizer_path()).to_pylist()[0] for t in texts] == want


def traced_bytes(batches):
    """What an encoder holds after these batches, without the tokenizer itself."""
    encoder = tf._Encoder(tokenizer_path())
    tracemalloc.start()
    try:
        for texts in batches:
            encoder.encode(pa.array(texts))
        return tracemalloc.get_traced_memory()[0]
    finally:
        tracemalloc.stop()


def test_an_encoder_does_not_keep_all_it_has_seen(monkeypatch):
    """What a worker remembers is bounded by its setting, whatever the words and their lengths."""
    long_words = ([f"{chr(97 + i)}{chr(97 + j)}" * 10_000 for j in range(20)] for i in range(26))
    assert traced_bytes(long_words) < 2e6
    letters = str.maketrans("0123456789", "abcdefghij")
    words = [str(10_000_000 + 7919 * i).translate(letters) for i in range(40_000)]
    assert traced_bytes([" ".join(words[i:i + 2000])] for i in range(0, len(words), 2000)) < 10e6
    monkeypatch.setattr(tf, "KNOWN_WORDS", 3000)
    assert traced_bytes([" ".join(words[i:i + 2000])] for i in range(0, len(words), 2000)) < 3e6


def test_a_part_that_is_a_special_token_is_not_remembered_as_the_word(tmp_path):
    """A word in capitals holds, lower-cased, a special token's text; the token itself is encoded as such."""
    with open(tokenizer_path(), encoding="utf-8") as f:
        spec = json.load(f)
    spec["added_tokens"].append({**spec["added_tokens"][0], "id": max(spec["model"]["vocab"].values()) + 1, "content": "mask"})
    path = str(tmp_path / "t.json")
    with open(path, "w", encoding="utf-8") as f:
        json.dump(spec, f)
    whole = Tokenizer.from_file(path)
    for text in ("MASK !mask MASK,", "mask", "MASK mask", "unmasked Mask"):
        assert tf.encode(pa.array([text]), path, None).to_pylist() == [whole.encode(text, add_special_tokens=False).ids]


def test_words_are_cut_into_parts_before_python_sees_them():
    """Many different words of a few parts: only the parts are looked up and remembered."""
    encoder, parts = tf._Encoder(tokenizer_path()), [f"{chr(97 + i)}{chr(97 + j)}" for i in range(8) for j in range(8)]
    text = " ".join(f"{a.upper()}-{b}" for a in parts for b in parts)
    ids, sizes = encoder.encode(pa.array([text]))
    assert ids.tolist() == Tokenizer.from_file(tokenizer_path()).encode(text, add_special_tokens=False).ids
    assert len(ids) == sizes.sum() and len(encoder.known) <= len(parts) + 2


def test_parts_end_with_their_text(monkeypatch):
    """No contraction, word or special token reaches from one text into the next, in no piece of a long text either."""
    texts = ["it'", "s", "we'r", "e", "x'", "ll", "'l", "l", "<|endof", "text|>", "a", "b1", "2", "é", "É", "\u65e5", "\u672c x", None, "",
             "e", "\u0301", "<|endoftext|>", "DON'T don't", "'" * 3, "y'stuff 'S's"]
    whole = Tokenizer.from_file(tokenizer_path())
    want = [whole.encode(t or "", add_special_tokens=False).ids for t in [*texts, " \n".join(t or "" for t in texts)]]
    arr = pa.array(["left out", *texts, " \n".join(t or "" for t in texts)]).slice(1)
    for size in (tf.BATCH_CHARS, 1, 4, 9):
        monkeypatch.setattr(tf, "BATCH_CHARS", size)
        assert tf.encode(arr, tokenizer_path(), None).to_pylist() == want


def test_other_tokenizers_get_whole_texts(sf_docs):
    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = ["a b", "", None, " a  b\n", "<|endoftext|> x", *[r["text"] for r in sf_docs.limit(30).collect()]]
    whole = Tokenizer.from_file(path)
    want = [[*whole.encode(t or "", add_special_tokens=False).ids, 2] for t in texts]
    assert tf.encode(pa.array(texts), path).to_pylist() == want
    assert tf._LOADED[path].by_words is False and tf._LOADED.get(tokenizer_path(), tf._Encoder(tokenizer_path())).by_words


def test_one_very_long_text(spark, make_docs):
    rows = [(1, "Word word, it's " * 200_000), (2, "x" * 100_000), (3, None)]
    _, t = table(spark, make_docs(rows))
    assert sorted(map(tuple, t.collect())) == expected(rows)


def test_counts_and_few_documents_read_few_bytes(spark, sf_docs):
    """A filter on the id and a choice of columns reach the files."""
    path = scratch_path(spark, "t")
    tf.write_tokens(sf_docs, path, tokenizer_path(), row_group_bytes=1 << 14, page_bytes=1 << 12, page_rows=5)
    files = tf.read_tokens(spark, path)
    some = files.where("doc_id between 10 and 12")
    plan = some.select("ids")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(doc_id), GreaterThanOrEqual(doc_id,10), LessThanOrEqual(doc_id,12)]" in plan
    counts = files.select("doc_id", "n_tokens")._jdf.queryExecution().toString()
    assert "ReadSchema: struct<doc_id:bigint,n_tokens:bigint>" in counts
    want = {r["doc_id"]: r["text"] for r in sf_docs.where("doc_id between 10 and 12").collect()}
    whole = Tokenizer.from_file(tokenizer_path())
    assert {r["doc_id"]: r["ids"] for r in some.collect()} == {
        i: [*whole.encode(t or "", add_special_tokens=False).ids, 2] for i, t in want.items()}
