import numpy as np

from skein.llm import tokens
from skein.llm.queries import tokenizer_path


def test_new_units_go_to_the_library_in_bounded_batches():
    enc, sizes = tokens.UnitEncoder(tokenizer_path()), []
    library = enc.tokenizer

    class Counted:
        def encode_batch_fast(self, texts, **told):
            sizes.append(len(texts))
            return library.encode_batch_fast(texts, **told)

    enc.tokenizer = Counted()
    texts = [" ".join(f"w{i * 50 + k}x" for k in range(50)) for i in range(200)] + ["", "again w1x w2x"]
    raw = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    ids, bounds = enc.encode(np.frombuffer(b"".join(raw), np.uint8), offsets)
    for i, t in enumerate(texts):
        assert ids[bounds[i] : bounds[i + 1]].tolist() == library.encode(t, add_special_tokens=False).ids
    assert max(sizes) <= 1 << 12 and sum(sizes) >= 10_000
