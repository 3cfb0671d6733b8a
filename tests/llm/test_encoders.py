"""The two encoders against their libraries on seeded random texts, alignment under character maps, and bounded memory."""

import random

import numpy as np
import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2
from tokenizers import Tokenizer

from lodestone.llm import sentencepiece_codec, token_files

BITS = [" ", "  ", " ", "\n", "\t", "\r\n", "\x00", "\x1c", "\x1f", "\x85", "\xa0", "\u3000", "\u2028", "'s", "'", "'ll", "'LL", "a", "Word", "é", "e\u0301", "日本", "テ", "ｶﾞ", "①", "ﬁ"]
BITS += ["😀", "12", "٣", "²", "½", "!!", ".", ",", "<|endoftext|>", "<|endof", "<s>", "▁", "_", "\ufeff", "\u200b", "한", "\u1112\u1161", "ﷺ", "x" * 70, "日" * 70]


def mixed(rng):
    text = "".join(rng.choice(BITS) for _ in range(rng.randrange(1, 14)))
    if rng.random() < 0.2:
        text += "".join(chr(rng.choice([rng.randrange(0xD800), rng.randrange(0xE000, 0x110000)])) for _ in range(4))
    return text


def resident_mb():
    with open("/proc/self/statm") as f:
        return int(f.read().split()[1]) * 4096 >> 20


def test_op8_random_texts():
    tok = Tokenizer.from_file(token_files.default_tokenizer())
    enc = token_files.Encoder(token_files.default_tokenizer(), 0)
    rng = random.Random(5)
    for _ in range(20_000):
        t = mixed(rng)
        assert np.frombuffer(enc.encode(t), enc.kind).tolist() == [*tok.encode(t, add_special_tokens=False).ids, 0], t


def test_op8_small_tables_give_the_same_ids(monkeypatch):
    monkeypatch.setattr(token_files, "TABLE_BYTES", 2000)
    tok = Tokenizer.from_file(token_files.default_tokenizer())
    enc = token_files.Encoder(token_files.default_tokenizer(), 0)
    rng = random.Random(6)
    for _ in range(300):
        t = " ".join(rng.choice(["lorem", "ipsum", "dolor,", "Sit", "amet.", "été", "x" * 80, "12"]) + str(rng.randrange(9)) for _ in range(40))
        assert np.frombuffer(enc.encode(t), enc.kind).tolist() == [*tok.encode(t, add_special_tokens=False).ids, 0], t
    assert len(enc.near) < 20


def test_op8_opens_a_document_of_any_shard(spark, tmp_path):
    rows = [(None, "no id")] * 3 + [(i // 2 * 10, f"text {i}") for i in range(5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    folder = str(tmp_path / "files")
    manifest = token_files.write_tokens(docs, folder, token_files.default_tokenizer())
    assert len(manifest) > 1
    tok = Tokenizer.from_file(token_files.default_tokenizer())
    ids = lambda t: [*tok.encode(t, add_special_tokens=False).ids, 0]
    for i in (0, 10, 12_340, 24_990):
        assert token_files.open_document(folder, i).tolist() == ids(f"text {i // 5}")
    assert token_files.open_document(folder, None).tolist() == ids("no id")
    assert token_files.open_document(folder, 5) is None and token_files.open_document(folder, 25_000) is None


@pytest.mark.parametrize("encode", [lambda: token_files.Encoder(token_files.default_tokenizer(), 0).encode, lambda: sentencepiece_codec.Codec(sentencepiece_codec.default_model()).encode], ids=["op8", "op10"])
def test_long_parts_take_no_memory(encode):
    encode = encode()
    rng = random.Random(3)
    encode("".join(rng.choices("abcdefghijklmnop", k=800)))
    before = resident_mb()
    for _ in range(20_000):
        encode("".join(rng.choices("abcdefghijklmnop", k=800)))
    assert resident_mb() - before < 40


@pytest.mark.parametrize(
    ("rule", "spec"),
    [("identity", {}), ("nmt_nfkc", {}), ("nfkc_cf", {}), ("nmt_nfkc", {"remove_extra_whitespaces": True}), ("nmt_nfkc", {"remove_extra_whitespaces": True, "add_dummy_prefix": False}), ("identity", {"add_dummy_prefix": False})],
)
def test_op10_alignment_under_a_character_map(rule, spec, tmp_path):
    """The given vocabulary under the library's own compiled maps: ids, text and ends are the library's."""
    model = sentencepiece_model_pb2.ModelProto()
    with open(sentencepiece_codec.default_model(), "rb") as f:
        model.ParseFromString(f.read())
    given = sentencepiece_model_pb2.NormalizerSpec()
    given.ParseFromString(sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_normalizer_spec())
    model.normalizer_spec.precompiled_charsmap = given.precompiled_charsmap
    for k, v in spec.items():
        setattr(model.normalizer_spec, k, v)
    path = tmp_path / "variant.model"
    path.write_bytes(model.SerializeToString())
    sp, c = sentencepiece.SentencePieceProcessor(model_file=str(path)), sentencepiece_codec.Codec(str(path))
    rng = random.Random(4)
    for _ in range(2000):
        t = mixed(rng)
        found, align = c.encode(t)
        pieces = sp.encode(t, out_type="proto").pieces
        assert [int(x) for e in found for x in e[1].split()] == [p.id for p in pieces], t
        assert c.decoded(found) == sp.decode([p.id for p in pieces]), t
        # The library gives all bytes of a character spelled in byte pieces to its last one.
        ends = c.spans(found, align).tolist()
        assert [e for e, p in zip(ends, pieces, strict=True) if p.id not in c.bytes_in] == [p.end for p in pieces if p.id not in c.bytes_in], t


def test_op10_disagreement_raises():
    c = sentencepiece_codec.Codec(sentencepiece_codec.default_model())
    found, align = c.encode("a▁b")
    with pytest.raises(ValueError):
        c.spans(found, align[:-1])
