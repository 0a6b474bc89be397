"""op13 against the tokenizers library."""

import json
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from skein.llm import transducer
from skein.llm.common import string_slices

PATH = public_tokenizers.path("byte_bpe_50k.json")
rng = random.Random(13)
PARTS = ["a", "é", "×", "'s", "'", "'re", "'ll", "'v", "'ve", " ", "  ", "\n", "\n\n", "\t", "\xa0", "\x1c", "1", "²", "½", ".", ",", "#", "word", "日本", "don't", "l", "r", "e", "😀", "<|endoftext|>", "<|", "　", "the", "ing", "tion", "S", "T", "aaaa", "ab", "\x00"]


def any_character():
    return chr(rng.choice([rng.randrange(32, 127), rng.randrange(0xD7FF), rng.randrange(0xE000, 0x110000)]))


TEXTS = {
    "parts": ["".join(rng.choice(PARTS) for _ in range(rng.randrange(30))) for _ in range(6000)] + [None, ""],
    "characters": ["".join(any_character() for _ in range(rng.randrange(40))) for _ in range(1500)],
    "letters": ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(200))) for _ in range(400)],
    "two letters": ["".join(rng.choice("ae") for _ in range(rng.randrange(400))) for _ in range(400)],
    "very long": ["a" * 100_000, "ab" * 40_000, " " * 70_000, "\n" * 65_537, "the" * 30_000, "=-" * 50_000, "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(600_000)), "'s" * 5000],
    "chunk ends": [" " * i + "x" * j for i in range(60, 70) for j in range(60, 70)],
}


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.mark.parametrize("kind", TEXTS)
def test_counts_as_the_library_does(library, kind):
    counter, got = transducer.counter(PATH), []
    for _, _, data, offsets in string_slices(pa.array(TEXTS[kind])):
        got += counter.count(data, offsets).tolist()
    assert got == [len(e.ids) for e in library.encode_batch([t or "" for t in TEXTS[kind]], add_special_tokens=False)]


def test_counts_after_transitions_are_dropped(library, monkeypatch):
    monkeypatch.setattr(transducer, "MOST_ARCS", 500)
    monkeypatch.setattr(transducer, "AT_ONCE", 50)
    counter, texts, got = transducer.TokenCounter(PATH), TEXTS["parts"][:800] + TEXTS["letters"], []
    for _, _, data, offsets in string_slices(pa.array(texts)):
        got += counter.count(data, offsets).tolist()
    assert got == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_splitter_begins_pieces_where_the_library_does(library):
    counter = transducer.counter(PATH)
    texts = ["".join(rng.choice([p for p in PARTS if not p.startswith("<|")]) for _ in range(rng.randrange(1, 40))) for _ in range(1000)]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    want = []
    for t, at in zip(texts, offsets):
        want += [at + len(t[:a].encode()) for _, (a, b) in library.pre_tokenizer.pre_tokenize_str(t)]
    assert counter.pieces(data, offsets).tolist() == want


def test_scan_of_chunk_maps_is_the_plain_run():
    classes = np.random.default_rng(2).integers(0, 11, (37, transducer.CHUNK), dtype=np.uint8)
    state, want = transducer.NEW, []
    for c in classes.reshape(-1):
        want.append(state)
        state = transducer.STEP[state, c]
    assert transducer.entry_states(classes).reshape(-1).tolist() == want


def test_rows(spark, library):
    texts = [None, "", "one two", "one two", "x" * 5000, "word " * 1024, "word " * 1025, "a<|endoftext|>b"]
    rows = [(i, t, 7) for i, t in enumerate(texts)] + [(None, "no id", 1), (2, "one two", 7)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens int").repartition(3)
    got = sorted((tuple(r) for r in transducer.count_tokens(docs, PATH).collect()), key=repr)
    n = lambda t: len(library.encode(t or "", add_special_tokens=False).ids)
    assert got == sorted(((i, len((t or "").encode()), n(t), n(t) > 1024) for i, t, _ in rows), key=repr)
    assert transducer.count_tokens(docs.limit(0), PATH).count() == 0


def test_other_tokenizers_are_refused(tmp_path):
    spec = json.loads(open(PATH, encoding="utf-8").read())
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True, "use_regex": True}}):
        (tmp_path / "t.json").write_text(json.dumps(spec | change))
        with pytest.raises(ValueError):
            transducer.TokenCounter(str(tmp_path / "t.json"))


def test_units_that_are_met_again_stay(monkeypatch):
    """The table of units is made small many times over; ids stay those of the library."""
    from skein.llm import tokens

    monkeypatch.setattr(tokens, "MOST_UNITS", 120)
    texts = [t for kind in ("parts", "letters") for t in TEXTS[kind][:500]] + ["the same words again " * 20] * 50
    encoder = tokens.UnitEncoder(PATH)
    got, most = [], 0
    for i in range(0, len(texts), 40):
        for a, b, data, offsets in string_slices(pa.array(texts[i : i + 40])):
            ids, at = encoder.encode(data, offsets)
            got += [ids[at[k] : at[k + 1]].tolist() for k in range(b - a)]
        most = max(most, encoder.units)
    assert got == [e.ids for e in encoder.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)] and most > 120 > encoder.units > 0
