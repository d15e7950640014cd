import numpy as np
import pyarrow.parquet as pq
import pytest
from stationweave.llm.encoder import TOKENIZERS, VOCABULARY, encoder

PATH = f"{TOKENIZERS.rstrip('/')}/{VOCABULARY}"
MADE_UP = ["", " ", "a", "it's  12345 o'clock!!\n\n\tyes", "観測所。気温は23.5度", "é‍👩‍🚒", "\r\n \x00\x07", "x" * 5000, "ab" * 3000 + " " * 70]


@pytest.fixture(scope="module")
def texts():
    held = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"]).column(0).to_pylist()
    return [t for t in held if t and len(t) < 20_000][:600] + MADE_UP


def ids_of(texts):
    flat, counts = encoder(PATH).encode(texts)
    return [x.tolist() for x in np.split(np.asarray(flat), np.cumsum(counts)[:-1])]


def test_exact_round_trip(texts):
    token = encoder(PATH).vocabulary.token
    assert [b"".join(token[i] for i in x).decode() for x in ids_of(texts)] == texts


def test_same_ids_as_another_encoder(texts):
    tokenizers = pytest.importorskip("tokenizers")
    other = tokenizers.Tokenizer.from_file(PATH)
    special = [t.content for t in other.get_added_tokens_decoder().values()]
    plain = [t for t in texts if not any(s in t for s in special)]  # the other one cuts these out of a text
    assert len(plain) > 500
    assert ids_of(plain) == [other.encode(t, add_special_tokens=False).ids for t in plain]


def test_counts_are_those_of_the_ids(texts):
    assert encoder(PATH).count(texts).tolist() == [len(x) for x in ids_of(texts)]


def test_null_has_no_tokens():
    assert encoder(PATH).count([None, "", "a"]).tolist() == [0, 0, 1]


def test_prefix_table_append_and_edit():
    from stationweave.llm.encoder import PrefixTable

    v = encoder(PATH).vocabulary
    data = "gauge 12.5 mm at noon; wind NW 観測 ".encode() * 4
    table = PrefixTable(v, data[:40])
    table.append(data[40:])
    assert table.ids() == PrefixTable(v, data).ids()
    for start, end, new in ((0, 5, b"rain"), (30, 31, b""), (70, 90, b"zz top"), (len(data) - 3, len(data), b"!")):
        changed = PrefixTable(v, data)
        redone = changed.edit(start, end, new)
        assert changed.ids() == PrefixTable(v, data[:start] + new + data[end:]).ids()
        assert redone <= len(new) + len(data) - end
