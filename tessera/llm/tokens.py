"""Token ids of whole texts by a public tokenizer file, piece of text by piece of text, with a bounded memory of pieces seen."""

from __future__ import annotations

import os
import re
from array import array
from itertools import chain

import numpy as np

#: White space at which texts may be taken apart: the tokenizer drops it and merges nothing across it.
_PIECE = re.compile(r"[^\x20\t\n\r]+")
#: Texts of these characters are their own normal form but for case, which lower() changes as the file does, letter by letter.
_PLAIN = re.compile(r"[\t\n\r\x20-\x7eÀ-ÖØ-öø-ÿ]*")
#: The pre-tokenizer's parts of such a text in lower case.
_PART = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\x20\t\n\ra-zß-öø-ÿ0-9]+")


class PieceEncoder:
    """Ids by a `tokenizers` file whose pre-tokenizer drops white space, without special tokens.

    Encoding a text equals joining the encodings of its pieces between white space; each
    piece is encoded once and remembered, up to a number of pieces. Where the file lower-cases and then splits as _PART does,
    plain texts are split here and their words go to the merges without the file's other steps. Texts that hold an added token
    of the file, in any case, go to the tokenizer whole.
    """

    def __init__(self, path: str, most: int = 500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.bare = Tokenizer(self.tokenizer.model)
        self.bare.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.added = tuple(t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values())
        self.pieces: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        probe = "Zebra's ÀÉÎ-Õx,! it'll we're I'm you've he'd don't 'tis 12 a1b2 (x) #$% straße internationalisation ''s O'Reilly <b>'S</b> \\ ` ~"
        self.plain = self._split_texts([probe])[0].tobytes() == self._batch(self.tokenizer, [probe])[0]

    def _batch(self, tokenizer, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _known(self, lists: list[list[str]], known: dict[str, bytes], bare: bool) -> list[np.ndarray]:
        if len(known) > self.most:
            known.clear()
        new = [x for x in set(chain.from_iterable(lists)) if x not in known]
        if bare:
            merges = self.tokenizer.model.tokenize
            known.update((x, array("I", [t.id for t in merges(x)]).tobytes()) for x in new if x.isascii() and x.isalpha())
            new = [x for x in new if x not in known]
        for tokenizer, some in ((self.bare, [x for x in new if bare and x.isalpha()]), (self.tokenizer, [x for x in new if not (bare and x.isalpha())])):
            for lo in range(0, len(some), 10_000):
                known.update(zip(some[lo : lo + 10_000], self._batch(tokenizer, some[lo : lo + 10_000]), strict=True))
        return [np.frombuffer(b"".join(map(known.__getitem__, own)), np.uint32) for own in lists]

    def _split_texts(self, texts: list[str]) -> list[np.ndarray]:
        return self._known([_PART.findall(t.lower()) for t in texts], self.parts, bare=True)

    def _holds_added(self, text: str) -> bool:
        low = text.lower() if self.added else ""
        return any(x in low for x in self.added)

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text; a null text has none."""
        texts = [t or "" for t in texts]
        whole = [i for i, t in enumerate(texts) if self._holds_added(t)]
        out = {i: np.frombuffer(x, np.uint32) for i, x in zip(whole, self._batch(self.tokenizer, [texts[i] for i in whole]), strict=True)}
        plain = [i for i, t in enumerate(texts) if self.plain and i not in out and _PLAIN.fullmatch(t)]
        out |= dict(zip(plain, self._split_texts([texts[i] for i in plain]), strict=True))
        rest = [i for i in range(len(texts)) if i not in out]
        out |= zip(rest, self._known([_PIECE.findall(texts[i]) for i in rest], self.pieces, bare=False), strict=True)
        return [out[i] for i in range(len(texts))]


_encoders: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """The encoder of a file, built once a Python worker and used by all its tasks."""
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]
