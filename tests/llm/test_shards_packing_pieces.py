import itertools
import random
import sys
import zlib

import numpy as np
import pytest
from edges import clashing_docs, edge_docs, edge_rows, empty_docs, small, table_of

from conftest import DATA
from telemill.llm import packing, pieces, sharding
from telemill.llm.queries import op6_feistel_sharding, vocabulary

BPE = vocabulary("byte_bpe_50k.json")


def test_rows_law_and_reproducibility(spark):
    docs = small(spark, DATA)
    out = sharding.shard_rows(docs).collect()
    n = len(out)
    for s in range(16):
        slots = sorted(r.slot for r in out if r.shard == s)
        assert slots == list(range(len(slots))) and len(slots) in (n // 16, n // 16 + 1)
    assert table_of(sharding.shard_rows(docs.repartition(7).orderBy("text"))) == table_of(sharding.shard_rows(docs))
    by_id = {r.doc_id: r for r in docs.collect()}
    assert all((r.size, r.text_crc32) == (len(by_id[r.doc_id].text.encode()) + 1, zlib.crc32(by_id[r.doc_id].text.encode())) for r in out)
    moved = sum(r.place != r.row_no for r in out)
    assert moved > 0.9 * n


def test_shards_of_edge_cases(spark):
    out = sharding.shard_rows(clashing_docs(spark), 5).collect()
    assert len(out) == len(edge_rows()) and sorted(r.place for r in out) == list(range(len(out)))
    assert {r.size for r in out if r.doc_id == 3} == {1} and sharding.shard_rows(empty_docs(spark)).count() == 0


def test_shard_query_columns(spark):
    out = op6_feistel_sharding(spark, f"{DATA}/sf0.001")
    assert out.columns[:7] == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"] and out.where("law != 'rows' or grown_shard is not null").count() == 0


def test_many_equal_rows_are_dealt_out(spark):
    df = spark.createDataFrame([(1, "same")] * 400 + [(2, "x")] * 5, "doc_id long, text string")
    numbered, total = sharding.number_rows(df, ["doc_id"], "ties")
    assert total == 405 and sorted(r.row_no for r in numbered.collect()) == list(range(405))


# Packing


def brute_fullest(counts, room):
    items = [x for x, n in counts.items() for _ in range(n)]
    return max(sum(c) for k in range(len(items) + 1) for c in itertools.combinations(items, k) if sum(c) <= room)


def test_fullest_combination():
    rng = random.Random(2)
    for _ in range(300):
        counts = {rng.randrange(1, 15): rng.randrange(1, 4) for _ in range(rng.randrange(1, 5))}
        room = rng.randrange(0, 40)
        got = packing.fullest(counts, room)
        assert sum(got) == brute_fullest(counts, room) and all(got.count(x) <= counts[x] for x in set(got))


def one_by_one(histogram, capacity):
    """The same rule, a sequence at a time."""
    counts, n = dict(histogram), 0
    while any(counts.values()):
        longest = max(x for x, c in counts.items() if c)
        counts[longest] -= 1
        for x in packing.fullest(counts, capacity - longest):
            counts[x] -= 1
        n += 1
    return n


def test_plan_uses_as_few_sequences_as_step_by_step():
    rng = random.Random(3)
    for _ in range(60):
        h = {rng.randrange(1, 65): rng.randrange(1, 30) for _ in range(rng.randrange(1, 20))}
        p = packing.plan(h, 64)
        assert abs(p.sequences - one_by_one(h, 64)) <= 1 and p.sequences >= -(-sum(k * v for k, v in h.items()) // 64)
    assert packing.plan({}, 64).sequences == 0


def check_packing(rows, texts, capacity):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(BPE)
    encode = lambda text: np.array(own.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
    filled = {}
    for r in rows:
        filled.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in filled.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    pieces_of = {}
    for r in rows:
        pieces_of.setdefault(r.doc_id, []).append(r)
    for key, text in texts.items():
        ids = np.append(encode(text or ""), 0).astype("<u4")
        got = sorted(pieces_of[key], key=lambda r: r.piece)
        assert [r.piece for r in got] == list(range(len(got))) and sum(r.length for r in got) == len(ids)
        assert len(got) == -(-len(ids) // capacity) and all(r.length == capacity for r in got[1:])
        for r in got:
            assert zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32
    return len(filled)


def test_packing_of_documents(spark):
    docs = small(spark, DATA)
    rows = packing.pack(docs, BPE).collect()
    used = check_packing(rows, {r.doc_id: r.text for r in docs.collect()}, 2048)
    assert used <= -(-sum(r.length for r in rows) // 2048) + 2


def test_packing_of_edge_cases(spark):
    rows = packing.pack(clashing_docs(spark), BPE).collect()
    assert {r.length for r in rows if r.doc_id == 3} == {1}
    assert sum(r.length for r in rows if r.doc_id == 2) == 2 * sum(r.length for r in rows if r.doc_id == 1)
    check_packing(packing.pack(edge_docs(spark).where("doc_id is not null and doc_id != 2"), BPE).collect(), {k: t for k, t in edge_rows() if k not in (None, 2)}, 2048)
    assert packing.pack(empty_docs(spark), BPE).count() == 0


def test_ids_equal_those_of_tokenizers_for_every_character():
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(BPE)
    encode = packing.encoder(open(BPE, encoding="utf-8").read())
    texts = ["".join(f"{a}{chr(c)}{b}" for c in range(at, min(at + 4096, sys.maxunicode + 1)) if not 0xD800 <= c < 0xE000) for at in range(0, sys.maxunicode + 1, 4096) for a, b in (("", ""), ("a", " "), (" ", "1"))]
    texts += [t for _, t in edge_rows() if t] + ["<|endoftext|>", "  \n\n \t x", "it's we'll I'D", " " * 5000, "\n" * 3000 + "a"]
    for t in texts:
        assert encode(t).tolist() == own.encode(t, add_special_tokens=False).ids


def test_ids_equal_those_of_tokenizers_for_a_whole_table(spark):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(BPE)
    encode = packing.encoder(open(BPE, encoding="utf-8").read())
    texts = [r.text or "" for r in spark.read.parquet(f"{DATA}/sf0.01/documents.parquet").select("text").collect()]
    assert all(encode(t).tolist() == e.ids for t, e in zip(texts, own.encode_batch(texts, add_special_tokens=False), strict=True))
    assert encode("a <|endoftext|> b").tolist() == [64, 220, 50256, 275]


# Pieces


@pytest.fixture(scope="module")
def model():
    return pieces.Lattice(open(vocabulary("piece_bpe_32k.model"), "rb").read())


def every_path(m, s):
    if not s:
        return [(0.0, b"")]
    out = [(m.scores[s[:j]] + score, m.id_bytes(s[:j]) + ids) for j in range(1, len(s) + 1) if s[:j] in m.scores for score, ids in every_path(m, s[j:])]
    if s[0] not in m.scores:
        out += [(m.unknown + score, m.id_bytes(s[0]) + ids) for score, ids in every_path(m, s[1:])]
    return out


def test_nbest_equals_enumeration(model):
    rng = random.Random(4)
    for _ in range(400):
        text = "".join(rng.choice("aent  on\né①日the▁") for _ in range(rng.randrange(1, 11)))
        paths = sorted(every_path(model, pieces.BLANK + text.replace(" ", pieces.BLANK)), key=lambda p: -p[0])
        got = model.segment(text, 5)
        assert [s for s, _ in got] == [s for s, _ in paths[:5]]
        assert len({ids for _, ids in got}) == len(got) and set(got) <= set(paths)
        assert all(model.decode(np.frombuffer(ids, "<u4").tolist()) == text.replace("▁", " ") for _, ids in got)


def test_paths_come_in_falling_order(model):
    scores = [s for s, _ in itertools.islice(model.paths("▁otherwise"), 50)]
    assert scores == sorted(scores, reverse=True)


def plain_forward(m, s):
    """Best and second best score of a part, over all pieces, without the tree."""
    kept = [[0.0]] + [[] for _ in s]
    longest = max(map(len, m.scores))
    for j in range(1, len(s) + 1):
        for i in range(max(0, j - longest), j):
            w = m.scores.get(s[i:j], m.unknown if j == i + 1 else None)
            if w is not None:
                kept[j] += [x + w for x in kept[i]]
        kept[j] = sorted(kept[j], reverse=True)[:2]
    return kept[-1]


def test_parts_learnt_together_equal_a_plain_pass(model):
    rng = random.Random(7)
    parts = {"▁" * rng.randrange(3) + "".join(rng.choice("abcdeinrst.,1①é") for _ in range(rng.randrange(1, 60))) for _ in range(300)}
    model.forget()
    model.learn(sorted(parts))
    for p in parts:
        k = model.number[p]
        want = plain_forward(model, p)
        score, loss, back = model.figures[:, k]
        assert score == want[0] and loss == (want[0] - want[1] if len(want) > 1 else np.inf) and back == 1
        ids = np.frombuffer(model.packed[k], "<u4").tolist()
        assert model.raw(model.packed[k]).decode() == p
        if "①" not in p:
            assert sum(model.scores[model.text[i]] for i in ids) == score


@pytest.mark.parametrize("text", ["a" * 200_000, "".join(random.Random(8).choice("abcdefghij") for _ in range(200_000)), "日" * 50_000])
def test_long_texts_without_blanks(model, text):
    import time

    model.forget()
    began = time.time()
    got, whole = model.checked(model.split([text])[0], 4)
    assert time.time() - began < 30 and whole and len({ids for _, ids in got}) == len(got)
    assert len(got) == (1 if text[0] == "日" else 4)
    scores = [s for s, _ in got]
    want = plain_forward(model, "▁" + text[:2000])
    short = [s for s, _ in model.segment(text[:2000], 4)]
    assert short[: len(want)] == want and scores == sorted(scores, reverse=True)


def test_paths_of_a_bounded_queue_equal_all_paths(model):
    rng = random.Random(9)
    for _ in range(100):
        s = "".join(rng.choice("abeinst") for _ in range(rng.randrange(1, 14)))
        every = [score for score, _ in model.paths(s)]
        got = list(model.paths(s, 6))
        assert [score for score, _ in got] == every[:6] and len({tuple(p) for _, p in got}) == len(got)


def test_merged_ids_are_those_of_the_library(spark):
    import sentencepiece

    path = vocabulary("piece_bpe_32k.model")
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    rows = [(1, "Hello world, tokenisation lattices"), (2, None), (3, "")]
    out = pieces.merged(spark.createDataFrame(rows, "doc_id long, text string"), path).collect()
    assert {r.doc_id: r.ids for r in out} == {k: lib.encode(t or "") for k, t in rows}


def test_decoding_equals_the_library(model):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))
    for text in ("Hello  world\n é ñ 日本 😀", " a  b \n\nc\t", "", "x"):
        assert model.decode(lib.encode(text)) == lib.decode(lib.encode(text))


def test_pieces_of_edge_cases(spark):
    path = vocabulary("piece_bpe_32k.model")
    out = pieces.digest(clashing_docs(spark), path).collect()
    assert len(out) == len(edge_rows()) and all(r.decoded for r in out)
    assert [(r.n_best, r.n_ids) for r in out if r.doc_id == 3] == [(1, [0])]
    assert pieces.digest(empty_docs(spark), path).count() == 0
    encoded = pieces.encode(edge_docs(spark).where("doc_id in (1, 6, 9)"), path, 3)
    best = encoded.selectExpr("doc_id", "segmentations[0].ids as ids")
    back = {r.doc_id: r.text for r in pieces.decode(best, path).collect()}
    texts = dict(edge_rows())
    assert back == {k: texts[k].replace("▁", " ") for k in (1, 6, 9)}


def test_query_equals_row_function(spark, model):
    from telemill.llm.queries import op4_nbest_pieces

    texts = {r.doc_id: r.text for r in small(spark, DATA).collect()}
    for r in op4_nbest_pieces(spark, f"{DATA}/sf0.001").collect():
        got = model.segment(texts[r.doc_id], 4)
        assert r.scores == [s for s, _ in got] and r.ids_crc32 == [zlib.crc32(b) for _, b in got] and r.decoded


def test_query_equals_a_plain_search_of_whole_texts(spark, model):
    """The four best scores of whole texts, kept for each position, without parts, tree or queue."""
    from telemill.llm.queries import op4_nbest_pieces

    longest = max(map(len, model.scores))

    def best_scores(s):
        kept = [[0.0]]
        for j in range(1, len(s) + 1):
            every = []
            for i in range(max(0, j - longest), j):
                w = model.scores.get(s[i:j], model.unknown if j == i + 1 else None)
                if w is not None:
                    every += [x + w for x in kept[i]]
            kept.append(sorted(every, reverse=True)[:4])
        return kept[-1]

    texts = {r.doc_id: r.text for r in small(spark, DATA).collect() if r.text and len(r.text) <= 1500}
    got = {r.doc_id: r for r in op4_nbest_pieces(spark, f"{DATA}/sf0.001").collect()}
    assert len(texts) > 50
    for k, t in texts.items():
        assert got[k].scores == pytest.approx(best_scores(pieces.BLANK + t.replace(" ", pieces.BLANK))) and got[k].decoded
