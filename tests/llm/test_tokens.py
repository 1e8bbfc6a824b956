import random

import public_tokenizers
import pytest
import sentencepiece
import tokenizers
from helpers import clashing, empty, odd, odd_rows, prose
from sentencepiece import sentencepiece_model_pb2 as proto

from textgauge.llm import pieces, tokens

BPE, SPM = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(BPE)


@pytest.fixture(scope="module")
def counter():
    with open(BPE, "rb") as f:
        return tokens.PrefixCounter(f.read(), 50)  # few are remembered, so that forgetting is tested too


def random_texts(n, seed):
    rng = random.Random(seed)
    letters = list(" \n\t'abcdelrstvm.,!|<>é日0😀 　\x1c\x85   ") + ["<|endoftext|>", "the ", "ing", "'re", "  \n", "don't"]
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, 30))) for _ in range(n)]


def test_every_prefix(counter, library):
    for text in ["Hello  world\n\n été  ", "we'll they're 'tis 're'", "a <|endoftext|> b", "<|endof <|endoftext|", "-" * 300, "😀" * 80, *random_texts(400, 1)]:
        assert counter.prefix_counts(text).tolist() == [len(library.encode(text[: i + 1], add_special_tokens=False).ids) for i in range(len(text))]


def test_long_texts(counter, library):
    for text in (prose(3000, 3), "x" * 5000, "ab" * 3000, " ".join("word%d" % i for i in range(2000))):
        assert counter.prefix_counts(text)[-1] == len(library.encode(text, add_special_tokens=False).ids)


def test_columns(spark, library):
    df = clashing(odd(spark))
    made = tokens.count_tokens(spark, df, BPE, (5, 1024), keep_prefixes=True).collect()
    assert len(made) == len(odd_rows())
    for r in made:
        text = r.text or ""
        t = r.tokens
        assert (t.n_bytes, t.n_tokens) == (len(text.encode()), len(library.encode(text, add_special_tokens=False).ids))
        assert len(t.prefix_tokens) == len(text)
        fit = [i + 1 for i, n in enumerate(t.prefix_tokens) if n <= 5]
        assert t.cut_5 == (fit[-1] if fit else 0)
    assert tokens.count_tokens(spark, empty(spark), BPE).count() == 0


@pytest.fixture(scope="module")
def unigram():
    """The library on the same pieces and scores, as a unigram model."""
    with open(SPM, "rb") as f:
        raw = f.read()
    model, spec = pieces.Pieces(raw, 50), proto.ModelProto()
    spec.ParseFromString(raw)
    spec.trainer_spec.model_type = proto.TrainerSpec.UNIGRAM
    for p, s in zip(spec.pieces, model.scores, strict=True):
        if p.type == pieces.NORMAL:
            p.score = s
    return model, sentencepiece.SentencePieceProcessor(model_proto=spec.SerializeToString())


def test_viterbi_is_the_librarys(unigram):
    model, library = unigram
    for text in ["Hello  world\n été", "", "   ", " a", "a ", "日本語", prose(400, 2), *[t.replace("\x1c", "") for t in random_texts(500, 2)]]:
        ids = model.encode(text).tolist()
        assert ids == library.encode(text)
        assert model.decode(ids) == text == library.decode(ids)


def test_double_array():
    keys = [b"a", b"ab", b"abc", b"b", b"\xff\x00", b"zebra", "日本".encode()]
    base, check, value = pieces.double_array(keys, list(range(len(keys))))

    def find(key):
        state = 0
        for b in key:
            to = base[state] + b
            if check[to] != state:
                return -1
            state = to
        return value[state]

    assert [find(k) for k in keys] == list(range(len(keys)))
    assert find(b"ac") == find(b"zeb") == find(b"") == -1


def test_piece_columns(spark):
    df = clashing(odd(spark))
    made = pieces.encode_documents(spark, df, SPM)
    rows = made.collect()
    assert len(rows) == len(odd_rows()) and all(r.pieces.round_trip for r in rows)
    assert all(len(r.pieces.ids) == r.pieces.n_tokens for r in rows)
    back = pieces.decode_documents(spark, made.select("doc_id", "text", "pieces.ids").withColumnRenamed("text", "was"), SPM)
    assert all(r.text == (r.was or "") for r in back.collect())
    assert pieces.encode_documents(spark, empty(spark), SPM).count() == 0
