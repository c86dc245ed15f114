import hashlib

import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from panelkite.llm import pieces

LIB = sentencepiece.SentencePieceProcessor(model_file=pieces.model_path())
CODEC = pieces.PieceCodec(pieces.model_path())


def check(text):
    ((ids, offsets),) = CODEC.encode([text])
    want = LIB.encode(text or "") + [LIB.eos_id()]
    assert ids.tolist() == want
    raw = (text or "").encode()
    assert offsets[0] == 0 and offsets[-1] == len(raw)
    assert all(a <= b for a, b in zip(offsets[:-1], offsets[1:], strict=True))
    for i, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
        name = LIB.id_to_piece(int(ids[i]))
        if not LIB.is_byte(int(ids[i])) and not LIB.is_control(int(ids[i])):
            # The mark before everything has no byte of its own.
            assert raw[a:b].decode().replace(" ", "▁") in (name, name[1:] if i == 0 else name)
    assert CODEC.decode(want) == LIB.decode(want)


@settings(max_examples=600, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t▁aeThing12.,é😀‍"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_any_text(text):
    check(text)


@pytest.mark.parametrize("text", [None, "", " ", "  ", "\n", "\n\n a", "▁", "▁▁ x", "a  b   c    d", "ends with space ", "tab\tand\rreturn", "</s> <s> <unk> <0x0A>", "\x00", "日本語 テキスト", "a" * 5000, "word " * 3000])
def test_special_texts(text):
    check(text)


def test_query(spark, sf_dir, texts):
    rows = pieces.op10_pieces(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = LIB.encode(texts[r["doc_id"]] or "") + [LIB.eos_id()]
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(LIB.decode(ids).encode()).hexdigest()
        assert r["offsets_sha256"] == hashlib.sha256(b"".join(x.to_bytes(8, "little") for x in by_hand(texts[r["doc_id"]] or "", ids))).hexdigest()


def by_hand(text, ids):
    """Where each piece begins in the text's UTF-8, and the end, from the pieces' names alone."""
    raw, at, out = "▁" + text.replace(" ", "▁") if text else "", 0, []
    # Byte in the marked text to byte in the text: marks of spaces are three bytes for one, the first for none.
    back, here = [], 0
    for k, c in enumerate(raw):
        own = 0 if k == 0 else len(text[k - 1].encode())
        back += [here if c == "▁" and (k == 0 or text[k - 1] == " ") else here + j for j in range(len(c.encode()))]
        here += own
    back.append(here)
    for i in ids:
        out.append(back[at])
        at += 0 if i == LIB.eos_id() else 1 if LIB.is_byte(i) else len(LIB.id_to_piece(i).encode())
    return [*out, back[at]]


def double_array(keys):
    """A compiled character map of the form that models hold: trie units, then replacements."""
    import struct

    texts, at = b"", {}
    for value in sorted(set(keys.values())):
        at[value] = len(texts)
        texts += value + b"\0"
    tree = {}
    for key, value in keys.items():
        node = tree
        for byte in key:
            node = node.setdefault(byte, {})
        node[None] = at[value]
    units, used = {}, {0}

    def place(node, index, label):
        labels = [0 if b is None else b for b in node]
        base = 1
        while any((base ^ x) in used for x in labels) or (index ^ base) >= 1 << 21:
            base += 1
        used.update(base ^ x for x in labels)
        offset = index ^ base
        units[index] = (offset << 10) | label | ((1 << 8) if None in node else 0)
        for byte, child in node.items():
            if byte is None:
                units[base] = child | 0x80000000
            else:
                place(child, base ^ byte, byte)

    place(tree, 0, 0)
    size = max(max(units) + 1, 256)
    packed = struct.pack(f"<{size}I", *[units.get(i, 0) for i in range(size)])
    return struct.pack("<I", len(packed)) + packed + texts


def test_compiled_maps_take_the_longest_key():
    keys = {"ﬁ".encode(): b"fi", b"a": b"b", b"ab": b"XYZ", b"abc": b"", "é".encode(): b"e"}
    chars = pieces.CharMap(double_array(keys))
    text = "ﬁx ab abcd a é ü"
    got, source = chars.normalise(text)
    assert got.decode() == "fix XYZ d b e ü"
    raw = text.encode()
    assert len(source) == len(got) + 1 and source[-1] == len(raw)
    assert source[got.index(b"XYZ")] == raw.index(b"ab") == source[got.index(b"XYZ") + 2]
    assert source[got.index(b"d")] == raw.index(b"d")


def test_a_model_with_a_map_encodes_as_the_library_does(tmp_path):
    from pathlib import Path

    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    proto.ParseFromString(Path(pieces.model_path()).read_bytes())
    keys = {"ﬁ".encode(): b"fi", "ａ".encode(): b"a", "ａｂ".encode(): b"the ", "é".encode(): "é".encode(), "½".encode(): b" 1/2", b"\t": b" ", "€".encode(): b""}
    proto.normalizer_spec.precompiled_charsmap = double_array(keys)
    path = str(tmp_path / "mapped.model")
    Path(path).write_bytes(proto.SerializeToString())
    lib, codec = sentencepiece.SentencePieceProcessor(model_file=path), pieces.PieceCodec(path)
    for text in ["ﬁve ａnd ａｂ cafés", "", "plain text", "ａｂａ½\t½ é€é", "€", "日本 ﬁ 語" * 50]:
        ((ids, offsets),) = codec.encode([text])
        assert ids.tolist() == lib.encode(text) + [lib.eos_id()]
        raw = text.encode()
        assert offsets[0] == 0 and offsets[-1] == len(raw) and (offsets[1:] >= offsets[:-1]).all()
        # Every span begins and ends between the text's characters, save for byte pieces.
        assert all(lib.is_byte(int(i)) or raw[a:b].decode() is not None for i, a, b in zip(ids, offsets[:-1], offsets[1:], strict=True))
    assert codec.decode(lib.encode("ａｂ")) == "the "


def test_other_columns_may_have_our_names(odd):
    other = odd.withColumns({"key": F.lit(1), "pieces": F.lit("x"), "offsets": F.lit(2), "n_tokens": F.lit("y")})
    assert pieces.encode(other).columns == ["doc_id", "pieces", "offsets"] and pieces.encode(other).count() == 9
    assert pieces.digests(other).where("n_bytes IS NULL").count() == 0


def test_odd_rows(odd, empty):
    rows = pieces.encode(odd).collect()
    assert len(rows) == 9
    two = next(r for r in rows if r["doc_id"] == 2)
    assert two["pieces"] == [LIB.eos_id()] and two["offsets"] == [0, 0]
    assert pieces.encode(empty).count() == 0
