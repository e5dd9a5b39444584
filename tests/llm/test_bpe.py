"""The backtracking encoder against the tokenizers library: whole documents, every character, long runs, awkward rows."""

import hashlib
import json
import random
import time

import numpy as np
import pytest
from edges import clashing_docs, edge_docs, edge_rows, empty_docs, table_of
from hypothesis import given, settings
from hypothesis import strategies as st

from conftest import DATA
from telemill.llm import bpe, queries


@pytest.fixture(scope="module")
def path():
    return queries.vocabulary("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library(path):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@pytest.fixture(scope="module")
def coder(path):
    with open(path, encoding="utf-8") as f:
        return bpe.coder(f.read())


def same(coder, library, text):
    ids = library.encode(text, add_special_tokens=False).ids
    assert coder.encode(text).tolist() == ids, text[:200]
    assert coder.decode(np.array(ids, dtype=np.uint32)) == library.decode(ids, skip_special_tokens=False)


def row_of(library, key, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    back = library.decode(ids, skip_special_tokens=False)
    return (str(key), str(len(ids)), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest(), str(back == (text or "")))


def test_query_equals_library(spark, library):
    docs = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet")
    assert table_of(queries.QUERIES["op13_backtracking_bpe"](spark, f"{DATA}/sf0.01")) == sorted(row_of(library, r.doc_id, r.text) for r in docs.collect())


def test_awkward_rows(spark, library, path):
    wanted = sorted(row_of(library, k, t) for k, t in edge_rows())
    assert table_of(bpe.round_trip(edge_docs(spark), path)) == wanted
    assert table_of(bpe.round_trip(clashing_docs(spark), path)) == wanted
    assert bpe.round_trip(empty_docs(spark), path).collect() == []
    texts = sorted((str(k), t or "") for k, t in edge_rows())
    assert table_of(bpe.decode(bpe.encode(edge_docs(spark), path), path)) == texts
    assert bpe.decode(spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<long>"), path).orderBy("doc_id").collect() == [(1, None), (2, "")]


def test_every_character(coder, library):
    """In words, in numbers, among signs, between spaces, and at both ends."""
    some = []
    for c in range(0x110000):
        if not 0xD800 <= c < 0xE000:
            some.append(f"a{chr(c)}1{chr(c)} !{chr(c)}  {chr(c)}")
        if len(some) == 200 or c == 0x10FFFF:
            same(coder, library, "\n".join(some))
            some = []


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.sampled_from("aeinorst hTE'sld1.,-=\n\té日ſ́\U0001f600"), max_size=80))
def test_any_text(coder, library, text):
    same(coder, library, text)


def test_added_tokens_and_broken_bytes(coder, library):
    for text in ("<|endoftext|>", "a <|endoftext|> b", " <|endoftext|><|endoftext|>  ", "<|endoftext|", "x  <|endoftext|>\n\n"):
        same(coder, library, text)
    rnd = random.Random(5)
    for _ in range(300):
        ids = [rnd.randrange(50257) for _ in range(rnd.randrange(12))]
        assert coder.decode(np.array(ids, dtype=np.uint32)) == library.decode(ids, skip_special_tokens=False)


def test_long_runs_take_linear_time(coder, library):
    for unit in ("a", " ", "ab", "=", "\n", "日", "aaab"):
        same(coder, library, unit * 20_000)
    began = time.perf_counter()
    coder.encode("a" * 2_000_000)
    assert time.perf_counter() - began < 20


def test_blocks_part_as_whole_texts(coder, library, monkeypatch):
    monkeypatch.setattr(bpe, "BLOCK", 7)
    rnd = random.Random(7)
    for _ in range(500):
        same(coder, library, "".join(rnd.choice(["word", " ", "  ", "\n", "1", "'s", "é", "!", "　"]) for _ in range(rnd.randrange(40))))


def small_file(merges):
    letters = {v: k for k, v in bpe.byte_letters().items()}
    vocab = {letters[b]: b for b in range(256)}
    for a, b in merges:
        vocab.setdefault(a + b, len(vocab))
    return {
        "version": "1.0", "added_tokens": [], "normalizer": None, "post_processor": None, "decoder": {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": True},
        "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}, "model": {"type": "BPE", "vocab": vocab, "merges": [list(m) for m in merges]},
    }


@settings(max_examples=150, deadline=None)
@given(st.data())
def test_any_merges(data):
    """Random merges over three letters, some of which make tokens that no text is encoded as."""
    from tokenizers import Tokenizer

    words, merges = ["a", "b", "c"], []
    for _ in range(data.draw(st.integers(1, 14))):
        a, b = data.draw(st.sampled_from(words)), data.draw(st.sampled_from(words))
        if a + b not in words:
            words.append(a + b)
            merges.append((a, b))
    file = json.dumps(small_file(merges))
    mine, library = bpe.Coder(file), Tokenizer.from_str(file)
    for _ in range(20):
        same(mine, library, data.draw(st.text(alphabet="abc", max_size=24)))


@pytest.mark.parametrize("change", [("pre_tokenizer", {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": True}), ("normalizer", {"type": "NFC"}), ("model.ignore_merges", True), ("model.dropout", 0.1), ("model.byte_fallback", True)])
def test_other_settings_are_refused(change):
    file = small_file([("a", "b")])
    where, value = change
    at = file["model"] if where.startswith("model.") else file
    at[where.removeprefix("model.")] = value
    with pytest.raises(ValueError, match="supported"):
        bpe.Coder(json.dumps(file))


def test_merges_out_of_order_are_refused():
    file = small_file([("a", "b"), ("ab", "c")])
    file["model"]["merges"].reverse()
    with pytest.raises(ValueError, match="order"):
        bpe.Coder(json.dumps(file))


def test_packing_follows_other_settings(path, library):
    """A file with another setting is encoded by the library itself."""
    from tokenizers import Tokenizer

    from telemill.llm import packing

    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    texts = ["word and word", "", " x", "12 34"]
    for where, change in (("pre_tokenizer", {"add_prefix_space": True}), ("model", {"ignore_merges": True})):
        other = json.dumps({**file, where: {**file[where], **change}})
        theirs = Tokenizer.from_str(other)
        mine = packing.encoder(other)
        assert [mine(t).tolist() for t in texts] == [theirs.encode(t, add_special_tokens=False).ids for t in texts]
    assert theirs.encode("word", add_special_tokens=False).ids == library.encode("word", add_special_tokens=False).ids
