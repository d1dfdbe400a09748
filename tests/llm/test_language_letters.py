"""The letters of a text, against their plain definition."""

import random

from flowseg.llm import language_id


def _plain(text):
    kept = language_id._OTHER.sub(" ", text.lower()).strip()
    return kept.encode() if any(c.isalpha() for c in kept) else b""


def test_letters_match_the_plain_definition():
    signs = "abZ 1.\n\x85\xa0éİ́中—½Ⅰª٠‍\U0001f600"
    draw = random.Random(3)
    texts = ["".join(draw.choice(signs) for _ in range(draw.randrange(9))) for _ in range(5_000)]
    texts.append("".join(chr(0x2500 + i) for i in range(40)) + "a")  # many different signs
    assert [language_id.letters(t) for t in texts] == [_plain(t) for t in texts]
    assert language_id.letters(None) == b""


def test_ordinary_texts_need_no_pattern(monkeypatch):
    class Counted:
        calls = 0
        match = staticmethod(language_id._OTHER.match)

        def sub(self, *args):
            Counted.calls += 1
            return plain.sub(*args)

    plain = language_id._OTHER
    monkeypatch.setattr(language_id, "_OTHER", Counted())
    assert language_id.letters("One, two — Größe, 3rd") == "one two größe rd".encode()
    assert Counted.calls == 0
