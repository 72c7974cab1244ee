import hashlib
import random
import sys
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gristmill.llm import packing, spans
from tests.llm.conftest import EDGES

BPE, RANKS, MODEL = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"))
ROWS = [(20, "hello world " * 900), (21, "<|endoftext|> a\tb \xa0 日本"), (22, "ﬁ\x00 ▁▁ x")] + EDGES


def test_encoders_agree():
    rng = random.Random(6)
    fast, slow = packing.ByteLevelEncoder(BPE, RANKS), packing.ByteLevelEncoder(BPE)
    letters = [chr(c) for c in range(0x250)] + ["'ll", "  ", "\n\n", "–", "…", "<|endoftext|>", "日", "🤦🏼"]
    for _ in range(1500):
        text = "".join(rng.choices(letters, k=rng.randint(0, 30)))
        assert fast.encode(text) == slow.encode(text)


def test_packing(documents):
    got = packing.pack_documents(documents(ROWS), BPE, RANKS, group_pieces=4).collect()
    library = Tokenizer.from_file(BPE)
    expected = {}
    for i, t in ROWS:
        ids = library.encode(t or "", add_special_tokens=False).ids + [2]
        start, k = 0, 0
        while start < len(ids):
            n = len(ids) % 1024 or 1024 if k == 0 else 1024
            key = (i, k, start, n, zlib.crc32(np.array(ids[start : start + n], "<u4").tobytes()))
            expected[key] = expected.get(key, 0) + 1
            start, k = start + n, k + 1
    seen = {}
    for r in got:
        key = (r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"])
        seen[key] = seen.get(key, 0) + 1
    assert seen == expected
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024


@pytest.mark.parametrize("by", ["norm", "dot"])
def test_every_capacity_holds(by):
    lengths = np.random.default_rng(1).integers(1, 60, 500)
    sequence, _ = packing.best_fit(lengths, (100, 5, 4000), weights=(1.0, 0.5, 0.5), by=by)
    for s in np.unique(sequence):
        mine = lengths[sequence == s]
        assert mine.sum() <= 100 and len(mine) <= 5 and (mine**2).sum() <= 4000
    tight, _ = packing.best_fit(lengths, (100, 100, 10**6), by=by)
    assert tight.max() + 1 <= np.ceil(lengths.sum() / 100) + 2


def naive_fit(lengths, caps, weights, by):
    """Contents of the sequences, by a look at every open sequence for every piece."""
    made = []
    for n in sorted(lengths, reverse=True):
        need, best = (n, 1, n * n), None
        for held in made:
            left = [c - u for c, u in zip(caps, (sum(held), len(held), sum(x * x for x in held)))]
            if all(r >= x for r, x in zip(left, need)):
                if by == "dot":
                    score = -sum(w * r / c * x / c for w, r, c, x in zip(weights, left, caps, need))
                else:
                    score = sum(w * ((r - x) / c) ** 2 for w, r, c, x in zip(weights, left, caps, need))
                if best is None or score < best[0] - 1e-12:
                    best = score, held
        best[1].append(n) if best else made.append([n])
    return sorted(tuple(x) for x in made)


@pytest.mark.parametrize("by", ["norm", "dot"])
@pytest.mark.parametrize("caps", [(100, 5, 4000), (100, 1000, 10**4), (97, 7, 10**6)])
def test_vector_best_fit(by, caps):
    lengths = np.random.default_rng(2).permutation(np.arange(1, 60))
    sequence, _ = packing.best_fit(lengths, caps, (1.0, 0.37, 0.61), by)
    got = sorted(tuple(sorted(lengths[sequence == s].tolist(), reverse=True)) for s in np.unique(sequence))
    assert got == naive_fit(lengths.tolist(), caps, (1.0, 0.37, 0.61), by)


def test_the_query_weighs_all_dimensions():
    """700 + 324 and 512 + 512 leave six tokens each: the costlier one, with less attention left, takes the last piece."""
    assert min(packing.WEIGHTS) > 0
    lengths, caps = np.array([700, 512, 512, 324, 3]), (1030, 1024, 1030 * 1030)
    assert packing.best_fit(lengths, caps)[0].tolist() == [0, 1, 1, 0, 0]
    assert packing.best_fit(lengths, caps, (1.0, 0.0, 0.0))[0].tolist() == [0, 1, 1, 0, 1]


def test_large_ids_beside_null(documents):
    rows = [(9007199254740993, "a b"), (None, "c"), (9007199254740995, ""), (None, None)]
    got = packing.pack_documents(documents(rows), BPE, RANKS).collect()
    assert sorted((r["doc_id"] for r in got if r["doc_id"] is not None)) == [9007199254740993, 9007199254740995] and len(got) == 4


def test_spans(documents):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rows = {r["doc_id"]: r for r in spans.encode_documents(documents(ROWS), MODEL).collect()}
    for i, t in ROWS:
        if i is None:
            continue
        ids = library.encode(t or "", add_bos=True, add_eos=True)
        assert rows[i]["ids"] == ids and rows[i]["decoded"] == library.decode(ids)
        pieces = library.encode(t or "", return_type="proto").pieces
        assert list(zip(rows[i]["begins"], rows[i]["ends"]))[1:-1] == [(p.begin, p.end) for p in pieces]
    digest = {r["doc_id"]: r for r in spans.digest_documents(documents(ROWS), MODEL).collect()}
    assert digest[20]["ids_sha256"] == hashlib.sha256(np.array(rows[20]["ids"], "<u4").tobytes()).hexdigest()


def random_text(rng, letters, most):
    return "".join(rng.choices(letters, k=rng.randint(0, most)))


def test_own_path_follows_the_library():
    own, library = spans.SpanEncoder(MODEL), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rng = random.Random(10)
    letters = list("abcdefgh  ▁▁ \t\n\0é日ｶﾞ🤦🏼中文字") + ["the", "ing", " and ", "<s>", "</s>", "<unk>", "<0x41>", "▁▁▁▁", "    ", "tion" * 30]
    for _ in range(2500):
        text = random_text(rng, letters, 40)
        ids, begin, end = own.encode(text)
        assert ids.tolist() == library.encode(text, add_bos=True, add_eos=True) and own.decode(ids) == library.decode(ids.tolist()), text
        assert list(zip(begin.tolist(), end.tolist()))[1:-1] == [(p.begin, p.end) for p in library.encode(text, return_type="proto").pieces], text
        ids = [rng.randrange(300) if rng.random() < 0.7 else rng.randrange(32000) for _ in range(rng.randint(0, 12))]
        assert own.decode(np.array(ids, int)) == library.decode(ids), ids


def test_new_words_are_merged_together():
    """Words seen for the first time cost a few calls of Python each, not one for each of their pairs."""
    own, library = spans.SpanEncoder(MODEL), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rng, calls = random.Random(12), []
    letters = list("aaabcdeeefghiiinorstuxé日") + ["th", "ing", "\n", "🤦🏼", "\0"]
    words = " ".join("".join(rng.choices(letters[:23], k=12)) for _ in range(10_000))
    sys.setprofile(lambda frame, event, arg: calls.append(event) if event in ("call", "c_call") else None)
    ids = own.encode(words)[0]
    sys.setprofile(None)
    assert ids.tolist() == library.encode(words, add_bos=True, add_eos=True) and len(calls) < 15 * 10_000
    texts = [" ".join("".join(rng.choices(letters, k=rng.choice([1, 5, 9, 14, 39, 60]))) for _ in range(rng.randrange(80))) for _ in range(200)]
    few = spans.SpanEncoder(MODEL)
    few.merged.most, few.merged.part = 3000, 100
    for text, ids, made in zip(texts * 2, library.encode(texts * 2, add_bos=True, add_eos=True), few.encode_all(texts * 2, 5000)):
        assert made[0].tolist() == ids and all((x == y).all() for x, y in zip(made, own.encode(text)))
    assert few.encode(" ".join(texts))[0].tolist() == library.encode(" ".join(texts), add_bos=True, add_eos=True) and len(few.merged) < 3100


@pytest.mark.parametrize("squeeze", [True, False])
@pytest.mark.parametrize("prefix", [True, False])
def test_mapped_model_without_byte_pieces(tmp_path, documents, squeeze, prefix):
    """A model written down by hand: the compiled map, unknown characters and pieces with blanks inside."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto, kinds = pb.ModelProto(), pb.ModelProto.SentencePiece
    proto.ParseFromString(sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_model_proto())
    proto.normalizer_spec.remove_extra_whitespaces, proto.normalizer_spec.add_dummy_prefix = squeeze, prefix
    proto.trainer_spec.model_type, proto.trainer_spec.byte_fallback = proto.trainer_spec.BPE, False
    del proto.pieces[:]
    for text, kind in (("<unk>", kinds.UNKNOWN), ("<s>", kinds.CONTROL), ("</s>", kinds.CONTROL)):
        proto.pieces.add(piece=text, type=kind, score=0.0)
    for k, text in enumerate(["ab", "▁a", "fi", "▁ab", "b▁", "aa", "a", "b", "f", "i", "▁", "1", "é", "A", "b▁a", "▁▁"]):
        proto.pieces.add(piece=text, type=kinds.NORMAL, score=-float(k // 2))
    path = tmp_path / "toy.model"
    path.write_bytes(proto.SerializeToString())
    library = sentencepiece.SentencePieceProcessor(model_file=str(path))
    rng = random.Random(11)
    rows = [(i, random_text(rng, list("aabb   ﬁ①Ａé日x\t\u200b▁") + ["é"], 25)) for i in range(300)]
    for r in spans.encode_documents(documents(rows), str(path)).collect():
        text = rows[r["doc_id"]][1]
        ids = library.encode(text, add_bos=True, add_eos=True)
        assert r["ids"] == ids and r["decoded"] == library.decode(ids), text
        begins = r["begins"]
        assert begins == sorted(begins) and r["ends"][-1] == len(text.encode())
        if not squeeze:
            assert list(zip(begins, r["ends"]))[1:-1] == [(p.begin, p.end) for p in library.encode(text, return_type="proto").pieces], text


def test_character_map_follows_the_library():
    library = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc")
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    proto.ParseFromString(library.serialized_model_proto())
    mine = spans.Normalizer(proto.normalizer_spec)
    rng = random.Random(7)
    for _ in range(400):
        text = "".join(rng.choices(list("ab  ﬁ①Ａ１½é́　 ​日ｶﾞ\t") + ["é"], k=rng.randint(0, 20)))
        out, lo, hi = mine(text.encode())
        assert out.decode() == library.normalize(text)
        assert (np.diff(lo) >= 0).all() and (hi >= lo).all() and (not len(hi) or hi[-1] <= len(text.encode()))


def test_empty(documents):
    empty = documents([(1, "x")]).where("doc_id < 0")
    assert packing.pack_documents(empty, BPE, RANKS).count() == 0
    assert spans.encode_documents(empty, MODEL).count() == 0


def test_equal_rows_are_dealt_to_many_groups(spark, tmp_path):
    """A third or all of the pieces may be alike, without a doc_id: no group may get them all."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    spark.range(20_000).selectExpr("cast(null as long) doc_id", "0 piece", "0L start", "100L length", "7L ids_crc32").write.parquet(str(tmp_path / "pieces"))
    made = spark.read.schema(schema).parquet(str(tmp_path / "pieces"))
    placed = packing.pack(made, group_pieces=1000)
    groups = [r["n"] for r in placed.groupBy((F.col("sequence_id") / (1 << 32)).cast("long").alias("g")).agg(F.count("*").alias("n")).collect()]
    assert sum(groups) == 20_000 and len(groups) == 20 and max(groups) <= 2000
    used = placed.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n"), F.count("*")).first()
    assert used[0] <= 1024 and used[1] <= 2000 + len(groups)
