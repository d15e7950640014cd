import pyarrow.parquet as pq
import pytest
from stationweave.llm.encoder import TOKENIZERS, VOCABULARY, encoder
from stationweave.llm.splitting import LIMIT, OVERLAP, split_text


@pytest.fixture(scope="module")
def enc():
    return encoder(f"{TOKENIZERS.rstrip('/')}/{VOCABULARY}")


def holds(text, pieces, enc):
    """Pieces cover the text; counts are those of the pieces' own texts, within limit and overlap."""
    assert pieces[0].start == 0 and pieces[-1].end == len(text)
    for a, b in zip([None, *pieces], pieces):
        assert b.tokens == enc.count([text[b.start : b.end]])[0] <= LIMIT
        if a is not None:
            assert a.start < b.start <= a.end < b.end
            assert b.overlap == (enc.count([text[b.start : a.end]])[0] if b.start < a.end else 0) <= OVERLAP


JAPANESE = "観測所の風向計は本日午前の点検で異常が見つかり部品の交換と再調整を行ったのち記録を再開したが雨量計については引き続き確認中である。"
TEXTS = {
    "japanese": JAPANESE * 60,
    "japanese without marks": JAPANESE[:-1] * 60,
    "base64": "QmFzZTY0IHRleHQgd2l0aG91dCBibGFua3M" * 150,
    "marks": "=#" * 2000,
    "mixed": ("word " * 300 + "zxqv" * 900 + "。") * 3,
}


@pytest.mark.parametrize("name", TEXTS)
def test_overlap_without_blanks(name, enc):
    text = TEXTS[name]
    pieces = split_text(text, enc)
    holds(text, pieces, enc)
    assert len(pieces) > 2 and all(p.overlap >= OVERLAP // 4 for p in pieces[1:])


def test_words_keep_their_overlap(enc):
    text = "The gauge was read at noon and again at dusk. " * 200
    pieces = split_text(text, enc)
    holds(text, pieces, enc)
    assert all(text[p.start] == " " and p.overlap == OVERLAP for p in pieces[1:])


def test_long_texts_of_the_corpus(enc):
    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"]).column(0).to_pylist()
    for text in texts:
        if text and len(text) > 500:
            pieces = split_text(text, enc)
            holds(text, pieces, enc)
            assert all(p.overlap for p in pieces[1:])
