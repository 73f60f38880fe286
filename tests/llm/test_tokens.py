import random

import pytest

import public_tokenizers
from tokenizers import Tokenizer

from fluxlake.llm import sentence_pieces, token_counts
from tests.llm import plain

BYTE_LEVEL = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def difficult_texts(n=1500):
    rng = random.Random(6)
    parts = ["a", "the", " ", "  ", "   ", " " * 17, "\n", " \n", "é", "日本", "<s>", "<unk>", "<0x41>", "<|endoftext|>", "1", "½", "!!",
             "\t", "ß", "😀", "▁", "x" * 40, "ing", "\x00", "\x85", "　", "'s", "'re", "aaa", "\x1c"]
    return ["".join(rng.choices(parts, k=rng.randrange(25))) for _ in range(n)] + ["", " ", "a" * 3000] + [" " * k for k in range(45)]


def test_counts_equal_the_library():
    judge, own = Tokenizer.from_file(BYTE_LEVEL), token_counts.merger(BYTE_LEVEL)
    texts = difficult_texts()
    want = [len(e.ids) for e in judge.encode_batch(texts, add_special_tokens=False)]
    assert own.count(texts) == want
    assert own.count(texts) == want  # remembered


def test_counts_survive_a_full_memory(monkeypatch):
    monkeypatch.setattr(token_counts, "REMEMBERED", 10)
    own = token_counts.merger(BYTE_LEVEL)
    texts = difficult_texts(100)
    assert [own.count([t])[0] for t in texts] == own.count(texts)


def test_token_count_rows(spark):
    rows = plain.messy_rows()
    judge = Tokenizer.from_file(BYTE_LEVEL)
    df = spark.createDataFrame(rows, plain.DOCS).repartition(3)
    got = token_counts.token_counts(df, BYTE_LEVEL, limit=100, group_chars=500).collect()
    want = sorted(str((r[0], len((r[1] or "").encode()), len(judge.encode(r[1] or "", add_special_tokens=False).ids))) for r in rows)
    assert sorted(str((r.doc_id, r.n_bytes, r.n_tokens)) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 100) for r in got)
    assert token_counts.token_counts(df.limit(0), BYTE_LEVEL).count() == 0


def test_pieces_have_parity_with_the_library():
    texts = difficult_texts() + [r[1] or "" for r in plain.messy_rows()]
    assert sentence_pieces.parity(texts, PIECES) == []


def test_runs_of_spaces_merge_from_the_left():
    lengths = frozenset((1, 2, 4))
    assert sentence_pieces._space_pieces(5, lengths) == (4, 1)
    assert sentence_pieces._space_pieces(3, frozenset((1, 2, 3))) == (3,)
    assert sentence_pieces._space_pieces(0, lengths) == ()
    assert sum(sentence_pieces._space_pieces(1_000_000, lengths)) == 1_000_000  # in proportion, not by the square
    texts = [f"a{' ' * n}b{' ' * m}" for n in (1, 2, 3, 15, 16, 17, 31, 33, 47, 500, 4001) for m in (0, 1, 5, 40)]
    assert sentence_pieces.parity(texts, PIECES) == []


def test_models_with_user_defined_pieces_are_refused():
    with pytest.raises(ValueError, match="user-defined"):
        sentence_pieces.Model(b"\x0a\x05\x0a\x01a\x18\x04")


def test_unigram_backend(tmp_path):
    """A hand-made unigram model with byte fallback, against the library."""
    import struct

    import sentencepiece

    def field(number, kind, payload):
        return bytes([number << 3 | kind]) + payload if number < 16 else bytes([(number << 3 | kind) & 127 | 128, number >> 4]) + payload

    def chunk(number, data):
        size = bytes([len(data)]) if len(data) < 128 else bytes([len(data) & 127 | 128, len(data) >> 7])
        return field(number, 2, size + data)

    def piece(text, score, kind=1):
        return chunk(1, chunk(1, text.encode()) + field(2, 5, struct.pack("<f", score)) + field(3, 0, bytes([kind])))

    pieces = [piece("<unk>", 0, 2), *(piece(f"<0x{b:02X}>", 0, 6) for b in range(256)),
              *(piece(t, s) for t, s in (("▁", -3.0), ("▁a", -2.0), ("a", -2.5), ("b", -2.7), ("ab", -3.1), ("ba", -3.3), ("▁ab", -3.6)))]
    trainer = chunk(2, field(3, 0, bytes([1])) + field(35, 0, bytes([1])) + field(40, 0, bytes([0]))
                    + field(41, 0, b"\xff\xff\xff\xff\xff\xff\xff\xff\xff\x01") + field(42, 0, b"\xff\xff\xff\xff\xff\xff\xff\xff\xff\x01"))
    normaliser = chunk(3, field(3, 0, bytes([1])) + field(4, 0, bytes([1])))
    path = tmp_path / "uni.model"
    path.write_bytes(b"".join(pieces) + trainer + normaliser)
    assert sentencepiece.SentencePieceProcessor(model_file=str(path)).vocab_size() == 264
    rng = random.Random(8)
    texts = ["".join(rng.choices(["a", "b", " ", "é", "ab"], k=rng.randrange(12))) for _ in range(300)]
    assert sentence_pieces.parity(texts, str(path)) == []


def test_encoded_rows(spark):
    df = spark.createDataFrame(plain.messy_rows(), plain.DOCS).repartition(3)
    got = sentence_pieces.encoded(df, PIECES, group_chars=300).collect()
    own = sentence_pieces.encoder(PIECES)
    want = sorted(str((r[0], own.encode([r[1] or ""])[0].tolist())) for r in plain.messy_rows())
    assert sorted(str((r.doc_id, r.ids)) for r in got) == want
    assert all(r.round_trip and r.n_tokens == len(r.ids) for r in got)
    assert sentence_pieces.encoded(df.limit(0), PIECES).count() == 0
