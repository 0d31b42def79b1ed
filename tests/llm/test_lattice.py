"""Best segmentations of many segments at once against one by one."""

import random

import public_tokenizers

from weftgraph.llm import piece_lattice


def test_many_segments_at_once(monkeypatch):
    rng = random.Random(7)
    model = piece_lattice.Lattice(public_tokenizers.path("piece_bpe_32k.model"))
    singles = sorted(model.tree.single - {piece_lattice.MARK})
    letters = ["".join(rng.choices("aabeeinorst", k=rng.randrange(1, 32))) for _ in range(3000)]
    mixed = ["".join(rng.choices(singles, k=rng.randrange(1, 33))) for _ in range(2000)]
    every = letters + mixed + [piece_lattice.MARK + x[1:] for x in letters] + ["a" * k for k in range(1, 33)]
    want = [model.best(x) for x in every]
    assert sum(behind == 0 for _, _, behind in want) > 10  # equal scores, where ids decide
    ids, scores, behind = model.tree.best(every)
    assert list(zip(ids, scores.tolist(), behind.tolist())) == want

    alone, best = [], model.best
    monkeypatch.setattr(model, "best", lambda x: alone.append(x) or best(x))
    texts = [" ".join(letters[k : k + 30]) + " \U0001f9ff" + "z" * 40 for k in range(0, 3000, 30)]
    found = list(model.encode_all(texts, 4))
    assert len(alone) < 10 and len(model.known) > 2000  # rare characters and long words only
    model.forget()
    assert found == [model.encode(x, 4) for x in texts]
