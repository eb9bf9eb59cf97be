"""The ids of a tokenizer file; plain byte-level vocabularies are encoded by a faster library with the same ids."""

from __future__ import annotations

import json
import os
from collections.abc import Iterable

import numpy as np

#: Fixed value: the split pattern of byte-level vocabularies of this family.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _bytes_of() -> dict[str, int]:
    """Printable characters that stand for bytes in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in plain} | {
        chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}


def is_plain(spec: dict) -> bool:
    """Whether ranks and ``PATTERN`` alone give the ids of a tokenizer file.

    Nothing is normalized, words are split by the byte-level pattern, tokens are
    single bytes and the products of merges in the order of their ids, and added
    tokens match as they are written.
    """
    model, split = spec["model"], spec.get("pre_tokenizer") or {}
    vocab, added = model.get("vocab"), spec.get("added_tokens") or []
    odd = ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")
    if (model.get("type") != "BPE" or any(model.get(x) for x in odd) or spec.get("normalizer") or split.get("type") != "ByteLevel"
            or split.get("add_prefix_space", True) or not split.get("use_regex", True)
            or any(x.get(y) for x in added for y in ("single_word", "lstrip", "rstrip"))):
        return False
    products = [vocab.get("".join(m.split(" ") if isinstance(m, str) else m)) for m in model["merges"]]
    single, names = _bytes_of(), {x["content"] for x in added}
    made = {*(vocab.get(c) for c in single), *products}
    return (None not in made and len(made) == len(single) + len(products) and products == sorted(products)
            and made == {i for token, i in vocab.items() if token not in names})


class BytePairs:
    """Loads the file once per process; pickles as its path only.

    ``path`` is a tokenizer file in JSON form. One that ``is_plain`` is encoded from
    its ranks, any other by the library the form belongs to, without truncation or
    padding. Added tokens are single ids where they stand in a text, as that
    library does by default.
    """

    _loaded: dict[str, tuple] = {}

    def __init__(self, path: str | None = None):
        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("byte_bpe_50k.json")
        self.path = str(path)

    def _load(self) -> tuple:
        if self.path not in self._loaded:
            with open(self.path, encoding="utf-8") as f:
                spec = json.load(f)
            special = {x["content"]: x["id"] for x in spec.get("added_tokens") or []}
            if is_plain(spec):
                import tiktoken

                of = _bytes_of()
                ranks = {bytes(of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
                top = max([*ranks.values(), *special.values()])
                encoding = tiktoken.Encoding(os.path.basename(self.path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
            else:
                from tokenizers import Tokenizer

                encoding, special = Tokenizer.from_file(self.path), None
                encoding.no_truncation()
                encoding.no_padding()
                top = max(encoding.get_vocab(with_added_tokens=True).values())
            self._loaded[self.path] = (encoding, None if special is None else set(special), "<u2" if top < 2**16 else "<u4")
        return self._loaded[self.path]

    def encode(self, text: str) -> list[int]:
        encoding, special, _ = self._load()
        if special is None:
            return encoding.encode(text, add_special_tokens=False).ids
        if any(s in text for s in special):
            return encoding.encode(text, allowed_special=special)
        return encoding.encode_ordinary(text)

    def pack(self, ids: Iterable[int]) -> bytes:
        return np.asarray(ids, dtype=self._load()[2]).tobytes()

    def unpack(self, packed: bytes) -> np.ndarray:
        return np.frombuffer(packed, dtype=self._load()[2]).astype("<u4")
