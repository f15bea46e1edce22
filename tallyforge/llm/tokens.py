"""Whole-document token ids by a byte-level BPE file."""

from __future__ import annotations

import re

import numpy as np

#: Texts whose only blanks are single spaces and line ends between other characters (the usual case).
_ODD = re.compile(r"  |[^\S \n]|\n | \n|\n\n|^\s|\s$|[\x1c-\x1f]")
#: The pre-tokenizer's pattern without its look-ahead, which matters for runs of blanks only.
_PLAIN = r"'(?:[stmd]|re|ve|ll)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s"


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies write for the 256 bytes."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class DocumentTokenizer:
    """ids(text) equals Tokenizer.encode(text, add_special_tokens=False).ids, as an array.

    The vocabulary comes from the tokenizer's own file, where ids are merge ranks; tiktoken merges it several times faster than
    the tokenizers library on one thread. Texts with unusual blanks take the full pattern. A text that holds the string of an
    added token goes to the library itself. Nothing is kept from one text to the next, so memory follows the longest text.
    """

    def __init__(self, path: str):
        import json
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.added = [t["content"] for t in spec.get("added_tokens", [])]
        back = _byte_alphabet()
        ranks = {bytes(back[c] for c in w): i for w, i in spec["model"]["vocab"].items() if w not in set(self.added)}
        made = [tiktoken.Encoding("document", pat_str=p, mergeable_ranks=ranks, special_tokens={}) for p in (_PLAIN, public_tokenizers.PATTERN)]
        self.plain, self.full = (e.encode_to_numpy for e in made)
        self.library = Tokenizer.from_file(path)
        self.highest = max([*ranks.values(), *self.library.get_vocab().values()])

    def kind(self, *more: int) -> str:
        """The narrowest little-endian type that holds every id of the vocabulary, and the given ones."""
        if min(more, default=0) < 0:
            raise ValueError("ids are not negative")
        return "<u2" if max(self.highest, *more) < 1 << 16 else "<u4"

    def ids(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, "<u4")
        if any(a in text for a in self.added):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4")
        return (self.full if _ODD.search(text) else self.plain)(text, disallowed_special=()).astype("<u4", copy=False)
