"""SentencePiece encoding with offsets and decoding, against the library itself."""

from __future__ import annotations

import hashlib
import random

import pytest

from loregrain.llm import pieces

public_tokenizers = pytest.importorskip("public_tokenizers")
spm = pytest.importorskip("sentencepiece")
PATH = public_tokenizers.path("piece_bpe_32k.model")
LETTERS = "ab theinerto  ▁▁\n\t\r;){}é中文😀́ﬁ ​<s></s>0123Ａ①ｶﾞ\x00"


def field(number: int, value: bytes | int) -> bytes:
    def whole(n: int) -> bytes:
        out = bytearray()
        while n > 127:
            out.append(n & 127 | 128)
            n >>= 7
        return bytes([*out, n])

    return whole(number << 3) + whole(value) if isinstance(value, int) else whole(number << 3 | 2) + whole(len(value)) + value


def content(squeeze: bool | None = None) -> bytes:
    """The model file; with the library's NFKC rules and white space squeezed or not."""
    with open(PATH, "rb") as f:
        model = f.read()
    if squeeze is None:
        return model
    rules = spm.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_normalizer_spec
    table = dict(pieces.fields(rules() if callable(rules) else rules))[2]
    return model + field(3, field(1, b"nmt_nfkc") + field(2, table) + field(3, 1) + field(4, int(squeeze)) + field(5, 1))


def texts(n: int) -> list[str]:
    rnd = random.Random(n)
    drawn = ["".join(rnd.choice(LETTERS) for _ in range(rnd.randint(0, 80))) for _ in range(n)]
    return [*drawn, "", " ", "   ", "\n", "<s> hi </s> <0x0A><unk>", "a" * 5000, "x" * 60 + " " * 33 + "y" * 100, " \n▁▁ x", "the end", "｡" * 70]


@pytest.mark.parametrize("squeeze", [None, False, True])
def test_ids_spans_and_text_are_the_library_s(squeeze):
    model = pieces.PieceModel(content(squeeze))
    library = spm.SentencePieceProcessor(model_proto=content(squeeze))
    for text in texts(800):
        norm, at = model.aligned(text)
        assert norm == model.normalized(text)
        found = model.encoded([norm])[0]
        ids, begins, ends = model.spans(found, at)
        told = [dict(pieces.fields(v)) for k, v in pieces.fields(library.encode(text, out_type="serialized_proto")) if k == 2]
        assert ids.tolist() == library.encode(text) == [x.get(2, 0) for x in told]
        assert (begins.tolist(), ends.tolist()) == ([x.get(4, 0) for x in told], [x.get(5, 0) for x in told]), text
        assert model.decoded(found) == model.decode(ids.tolist()) == library.decode(ids.tolist())
        assert "".join(text.encode()[b:e].decode() for b, e in zip(begins, ends, strict=True)) == text or squeeze is not None


def test_decoding_of_any_ids():
    model, library, rnd = pieces.PieceModel(content()), spm.SentencePieceProcessor(model_file=PATH), random.Random(2)
    for _ in range(4000):
        ids = [rnd.choice([0, 1, 2, 29871, 259, 268, 13, rnd.randrange(3, 259), rnd.randrange(32000)]) for _ in range(rnd.randint(0, 8))]
        assert model.decode(ids) == library.decode(ids)


def test_long_units_merge_as_short_ones_do():
    model, rnd = pieces.PieceModel(content()), random.Random(4)
    for _ in range(300):
        unit = "".join(rnd.choice("etaoinshr") for _ in range(rnd.randint(2, 45)))
        assert dict(model._encoded([unit])) == {unit: model._decimals(model._merged_long(unit))}


def test_generations_and_other_models(monkeypatch):
    monkeypatch.setattr(pieces.PieceModel, "REMEMBERED", 3)
    model, library = pieces.PieceModel(content()), spm.SentencePieceProcessor(model_file=PATH)
    for text in ("one two three four five", "four five six", "six one", "one"):
        ids = [int(i) for f in model.encoded([model.normalized(text)])[0] for i in f[0].split(",")]
        assert ids == library.encode(text)
    with pytest.raises(ValueError, match="byte fallback"):
        pieces.PieceModel(content() + field(2, field(3, 1)))


def test_rows(spark):
    library = spm.SentencePieceProcessor(model_file=PATH)
    rows = [(i, t, "c", "d") for i, t in enumerate([*texts(60), None, "word " * 30_000, "same", "same"])] + [(None, "x y", None, None), (3, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, begin string, model string")
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = sorted((str(i), len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids))) for i, t, *_ in rows for ids in [library.encode(t or "")])
    got = sorted((str(r["doc_id"]), r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in pieces.piece_digest(docs, PATH).collect())
    assert got == want
    coded = pieces.encode(docs, PATH)
    assert coded.columns == [*docs.columns, "ids", "begins", "ends"]
    back = pieces.decode(coded, PATH).collect()
    assert sorted((r["text"] or "").replace("▁", " ") for r in back) == sorted(r["decoded"] for r in back)
    for r in back:
        assert b"".join((r["text"] or "").encode()[b:e] for b, e in zip(r["begins"], r["ends"], strict=True)) == (r["text"] or "").encode()
    assert pieces.piece_digest(docs.limit(0), PATH).count() == pieces.encode(docs.limit(0), PATH).count() == 0


def test_digests_come_from_encode_and_decode(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "é 中 a\n b"), (2, None), (3, " ")], "doc_id long, text string")
    asked = []
    for name in ("encode", "decode"):
        monkeypatch.setattr(pieces, name, lambda df, path, *a, f=getattr(pieces, name), name=name: asked.append(name) or f(df, path, *a))
    got = {r["doc_id"]: r["n_covered"] for r in pieces.piece_digest(docs, PATH).collect()}
    assert asked == ["encode", "decode"] and got == {1: 11, 2: 0, 3: 1}


def test_texts_decode_together_as_each_alone():
    import numpy as np
    import public_tokenizers

    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        model = pieces.PieceModel(f.read())
    known = model.ids
    some = [i for t, i in known.items() if t.startswith(pieces.SPACE)][:3]
    euro = [model.byte[b] for b in "€".encode()]
    # bytes of one character that is cut by the end of a text, alone, and whole; spaces at starts; empty texts
    lists = [[], some, euro[:2], euro[2:], euro, [], [some[0], *euro, some[1]], euro[:1] + some, some[:1], []]
    ends = np.cumsum([0, *map(len, lists)])
    together = model.decode_all(np.array([i for own in lists for i in own]), ends)
    assert together == [model._decoded_in_turn(own) for own in lists]
    assert together == [model.decode(own) for own in lists]
