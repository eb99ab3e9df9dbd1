import random

import pytest
import sentencepiece
from edge import documents, empty
from sentencepiece import sentencepiece_model_pb2 as pb

from sheetwright.llm import piece_transducer as T
from sheetwright.llm.queries import PIECE_MODEL


@pytest.fixture(scope="module")
def model():
    return T.read_model(PIECE_MODEL)


def texts(n):
    rng = random.Random(2)
    parts = list("abcdefthe ing  \n\t▁éß漢字😀\x00<s>0123AB.,;'\"()_-  ") + ["the ", "tion", "    ", "<0x41>", "</s>", "\r\n", "ation", "://www.", "ﬁ", "́"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def test_ids_are_the_librarys(model):
    ours, theirs = T.PieceTransducer(model), sentencepiece.SentencePieceProcessor(model_proto=model)
    for x in [*texts(4000), "", " ", "  ", "▁", "a" * 3000, "é" * 500, "=" * 900, " " * 700, "ab" * 1500]:
        ids = ours.encode(x)
        assert ids == theirs.encode(x)
        assert ours.decode(ids) == theirs.decode(ids) == x.replace("▁", " ")


def test_unigram_models_take_the_lightest_path():
    """A hand-made unigram model: weights are negative scores, any piece may follow any."""
    rng = random.Random(4)
    proto = pb.ModelProto()
    proto.trainer_spec.model_type = proto.trainer_spec.UNIGRAM
    proto.trainer_spec.byte_fallback = True
    proto.normalizer_spec.name = "identity"
    proto.normalizer_spec.remove_extra_whitespaces = False
    add = lambda p, s, t: proto.pieces.add(piece=p, score=s, type=t)
    add("<unk>", 0, proto.SentencePiece.UNKNOWN)
    for b in range(256):
        add(f"<0x{b:02X}>", 0, proto.SentencePiece.BYTE)
    pieces = {"▁", *"abcd", *("".join(rng.choice("abcd") for _ in range(rng.randint(2, 5))) for _ in range(60)), "▁a", "▁ab"}
    for p in sorted(pieces):
        add(p, -rng.random() * 3 * len(p) ** 0.7 - 0.5, proto.SentencePiece.NORMAL)
    model = proto.SerializeToString()
    ours, theirs = T.PieceTransducer(model), sentencepiece.SentencePieceProcessor(model_proto=model)
    for _ in range(1500):
        x = "".join(rng.choice("abcd  é") for _ in range(rng.randint(0, 25)))
        assert ours.encode(x) == theirs.encode(x)
        assert ours.decode(ours.encode(x)) == x


def test_models_that_collapse_blanks(model):
    proto = pb.ModelProto()
    proto.ParseFromString(model)
    proto.normalizer_spec.remove_extra_whitespaces = True
    ours, theirs = T.PieceTransducer(proto.SerializeToString()), sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
    for x in [*texts(2000), "  ", " a  b ", "\n  a", "   a b    c  \t ", "a ▁ "]:
        assert ours.encode(x) == theirs.encode(x)


def test_fallback_arcs(model):
    """Each character leads somewhere from the initial state, and what is no piece writes the bytes of its UTF-8 form."""
    t = T.PieceTransducer(model)
    assert t.writes[t.rest] == t.bytes and all(t.writes[s] >= 0 for s in t.arcs[0].values())
    for c in ("\x00", "\u0378", "\U0010ffff", "\ue000"):
        assert c in t.ids or t._shortest(c) == tuple(t.byte[b] for b in c.encode())
    assert t._shortest("\ue000a\ue000") == (*t._shortest("\ue000"), t.ids["a"], *t._shortest("\ue000"))


def mapped(model, rule, collapse):
    proto, norm = pb.ModelProto(), pb.ModelProto()
    proto.ParseFromString(model)
    norm.ParseFromString(sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto())
    proto.normalizer_spec.precompiled_charsmap = norm.normalizer_spec.precompiled_charsmap
    proto.normalizer_spec.remove_extra_whitespaces = collapse
    return proto


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf"])
@pytest.mark.parametrize("collapse", [True, False])
def test_models_with_a_character_map(model, rule, collapse):
    """Ids are the library's, for each character that a map changes and for texts of combining and wide ones."""
    serial = mapped(model, rule, collapse).SerializeToString()
    ours, theirs = T.PieceTransducer(serial), sentencepiece.SentencePieceProcessor(model_proto=serial)
    rng = random.Random(8)
    parts = ["ﬁ", "①", "Ａ", "e\u0301", "\u0301", "한글", "\u1112\u1161\u11ab", "㍿", "´", "\u00a0", "\u3000", "\u200b", "\x01", "İ", "ß", "½", " ", "  ", "a", "The", "\n", "\t", "▁", "\x00", "😀"]
    some = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(3000)]
    some += [f"a{chr(c)} b" for c in range(1, 0x3400)] + [chr(c) for c in range(0xF900, 0x10000)]
    assert [x for x in [*some, *texts(500)] if ours.encode(x) != theirs.encode(x)] == []


def test_maps_and_pieces_defined_by_a_user_are_refused_together(model):
    proto = mapped(model, "nfkc", True)
    proto.pieces.add(piece="<mine>", score=0, type=pb.ModelProto.SentencePiece.USER_DEFINED)
    with pytest.raises(ValueError):
        T.PieceTransducer(proto.SerializeToString())


def test_memory_is_bounded(model, monkeypatch):
    monkeypatch.setattr(T, "MEMORY", 5)
    monkeypatch.setattr(T, "PAIRS", 7)
    ours, theirs = T.PieceTransducer(model), sentencepiece.SentencePieceProcessor(model_proto=model)
    for x in texts(50):
        assert ours.encode(x) == theirs.encode(x) and len(ours.known) <= 5


def test_edges_and_round_trip(spark, model):
    docs = documents(spark, extra=[(40 + k, x, None, None, None) for k, x in enumerate(texts(30))])
    got = T.encode_texts(docs, model).collect()
    assert len(got) == docs.count() and all(r["round_trip"] for r in got)
    assert {len(r["ids"]) for r in got if r["doc_id"] in (0, 1)} == {0}
    back = T.decode_ids(T.encode_texts(docs, model), model)
    want = sorted((repr(r["doc_id"]), (r["text"] or "").replace("▁", " ")) for r in docs.collect())
    assert sorted((repr(r["doc_id"]), r["text"]) for r in back.collect()) == want
    assert T.encode_texts(empty(spark), model).count() == 0
