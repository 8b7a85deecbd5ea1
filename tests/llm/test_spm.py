"""The compiled transducer against the library, against merges carried out one by one, and against all paths of small models."""

import itertools
import random
import time

import public_tokenizers
import pytest
import sentencepiece

from reelspan.llm import spm

PATH = public_tokenizers.path("piece_bpe_32k.model")


def plain_merges(t: spm.Transducer, scores: dict[str, float], text: str) -> list[str]:
    """Join the best-scored neighbours, the leftmost of equals, until none joins."""
    at = list(text)
    while True:
        found = [(-scores[a + b], k) for k, (a, b) in enumerate(zip(at, at[1:])) if a + b in t.ids]
        if not found:
            return at
        k = min(found)[1]
        at[k : k + 2] = [at[k] + at[k + 1]]


def random_bpe(rnd: random.Random) -> tuple[spm.Transducer, dict[str, float]]:
    """Pieces over a, b and the space sign, with equal scores, parts that no merge reaches and characters without a piece."""
    words = ["".join(w) for n in (2, 3, 4) for w in itertools.product("ab▁", repeat=n)]
    pieces = ["<unk>"] + [c for c in "ab▁" if rnd.random() < 0.9] + rnd.sample(words, 12)
    scores = [-float(rnd.randrange(6)) for _ in pieces]
    return spm.Transducer(pieces, scores, [2] + [1] * (len(pieces) - 1)), dict(zip(pieces, scores))


def test_bpe_paths_are_what_the_merges_give():
    rnd = random.Random(11)
    for _ in range(300):
        t, scores = random_bpe(rnd)
        for _ in range(20):
            text = "".join(rnd.choice("ab▁c") for _ in range(rnd.randrange(1, 14)))
            assert t.lightest_path(text) == plain_merges(t, scores, text), (t.pieces, text)
            spaced = "".join(rnd.choice("ab c") for _ in range(rnd.randrange(1, 14)))
            want = [t.ids.get(x, 0) for x in plain_merges(t, scores, "▁" + spaced.replace(" ", "▁"))]
            assert t.encode(spaced).tolist() == want, (t.pieces, spaced)


def test_unigram_paths_weigh_least_of_all_paths():
    rnd = random.Random(12)
    for _ in range(100):
        pieces = ["<unk>"] + rnd.sample(["".join(w) for n in (1, 2, 3) for w in itertools.product("ab", repeat=n)], 6)
        scores = [0.0] + [-rnd.random() * 5 for _ in pieces[1:]]
        t = spm.Transducer(pieces, scores, [2] + [1] * 6, bpe=False)
        price = dict(zip(pieces, scores))
        fallback = spm.UNKNOWN_PENALTY - min(scores[1:])
        for _ in range(10):
            text = "".join(rnd.choice("abc") for _ in range(rnd.randrange(1, 8)))
            cuts = (c for n in range(len(text)) for c in itertools.combinations(range(1, len(text)), n))
            ways = ([text[a:b] for a, b in zip((0, *c), (*c, len(text)))] for c in cuts)
            weigh = lambda way: sum(-price[x] if x in t.ids else fallback for x in way)
            best = min(weigh(w) for w in ways if all(x in t.ids or len(x) == 1 for x in w))
            assert abs(weigh(t.lightest_path(text)) - best) < 1e-9


def test_random_texts_have_the_librarys_ids():
    library, own, rnd = sentencepiece.SentencePieceProcessor(model_file=PATH), spm.Transducer.load(PATH), random.Random(13)
    letters = ["  \nabcdeéthing.,01(='中国😀▁", "abcdefghijklmnopqrstuvwxyz ", "   =-#*\t\n/ab", "ingtheraon ", "日本語テキスト "]
    for _ in range(5000):
        few = rnd.choice(letters)
        text = "".join(rnd.choice(few) for _ in range(rnd.randrange(80)))
        assert own.encode(text).tolist() == library.encode(text), text


def test_lattices_of_long_words_and_runs_are_relaxed_in_linear_time():
    library, own = sentencepiece.SentencePieceProcessor(model_file=PATH), spm.Transducer.load(PATH)
    for text in (" " * 64_000, "=" * 64_000, "ab" * 32_000, "▁ " * 20_000, "a" * (spm.SHORT - 1) + " " + "a" * (spm.SHORT + 1)):
        started = time.monotonic()
        assert own.encode(text).tolist() == library.encode(text)
        assert time.monotonic() - started < 5


def test_the_normaliser_and_the_pieces_are_arcs():
    t = spm.Transducer.load(PATH)
    assert t.arcs[ord(" ")] == t.arcs[ord(spm.SPACE)] and t.final[t.arcs[ord("a")]] == t.ids["a"]
    t.forget()
    t.encode("Some words, some twice twice")
    assert t.words and t.pairs
    t.forget()
    assert not (t.words or t.parts) and t.pairs


def test_other_normalisers_are_refused(monkeypatch):
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    model.normalizer_spec.precompiled_charsmap = b"x"
    model.normalizer_spec.remove_extra_whitespaces = False
    monkeypatch.setattr(sentencepiece, "SentencePieceProcessor", lambda model_file: type("M", (), {"serialized_model_proto": lambda self: model.SerializeToString()})())
    with pytest.raises(ValueError, match="normalisers"):
        spm.Transducer.load("any")
