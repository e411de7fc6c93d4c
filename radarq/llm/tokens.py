"""Token ids of a public BPE with word ends, a few words at a time.

The vocabulary's pre-tokenizer cuts a text into pieces that never influence each other, so the ids of
a text are those of its pieces, one after the other. Tasks keep the ids of pieces they have seen and
call the tokenizer for new ones only; texts on which cutting in Python could differ go to the
tokenizer whole.
"""

from __future__ import annotations

import re

import numpy as np

#: Fixed values of the vocabulary file's pre-tokenizer, for ASCII and Latin letters.
PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-zß-öø-ÿ0-9]+")
#: Texts of these characters only: no combining marks, no other scripts, nothing that NFC or lower-casing changes in length.
PLAIN = re.compile(r"[\t\n\r -~¡-©«-±´¶-¸»¿-ÿ]*")
GENERATION = 400_000  # pieces; a worker keeps two generations
AT_ONCE = 20_000  # pieces in one call of the tokenizer


class Encoder:
    """ids(texts): the file's ids of each text, without special tokens, as `kind`: uint16 where the vocabulary allows, else uint32."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        vocabulary = self.whole.get_vocab()
        self.is_end = np.zeros(max(vocabulary.values()) + 1, bool)
        self.is_end[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.kind = "<u2" if len(self.is_end) <= 1 << 16 else "<u4"
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _learn(self, pieces: list[str]) -> dict[str, bytes]:
        out: dict[str, bytes] = {}
        for k in range(0, len(pieces), AT_ONCE):
            part = pieces[k : k + AT_ONCE]
            ids = np.array(self.whole.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, self.kind)
            end = np.flatnonzero(self.is_end[ids]) + 1  # the last id of each piece says so
            if len(end) == len(part):
                raw, at = ids.tobytes(), 0
                for p, e in zip(part, (ids.itemsize * end).tolist()):
                    out[p] = raw[at:e]
                    at = e
            else:
                out |= {p: np.array(e.ids, self.kind).tobytes() for p, e in zip(part, self.whole.encode_batch(part, add_special_tokens=False))}
        return out

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        cut = [None if "<|" in t or not PLAIN.fullmatch(t) else PIECE.findall(t.lower()) for t in texts]
        if len(self.known) > GENERATION:
            self.older, self.known = self.known, {}
        known, older = self.known, self.older
        new: set[str] = set()
        for pieces in cut:
            if pieces:
                new.update(set(pieces).difference(known))
        known.update({p: older[p] for p in new if p in older})
        known.update(self._learn(list(new.difference(known))))
        get = known.__getitem__
        return [
            np.array(self.whole.encode(t, add_special_tokens=False).ids, self.kind) if pieces is None else np.frombuffer(b"".join(map(get, pieces)), self.kind)
            for t, pieces in zip(texts, cut)
        ]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One a worker process."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
