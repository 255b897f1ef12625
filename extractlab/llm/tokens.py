"""Byte-level BPE ids as the ``tokenizers`` library gives them, fast enough for a corpus.

``Encoder`` loads a ``tokenizers`` JSON file. Texts of plain Latin script without special tokens or
very long runs go through ``tiktoken`` built from the same vocabulary and merge order, which gives
the same ids several times faster; all other texts go through ``tokenizers`` itself. The character
range of the fast path holds no character whose class differs between the two regex engines.
"""

from __future__ import annotations

import functools
import json
import re

import numpy as np

#: The split pattern of this family of byte-level vocabularies.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_EXOTIC = re.compile("[^\t\n\r\x20-\x7e\xa1-ɏ‐-‧€]")
_LONG_RUN = 1000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_characters() -> dict[str, int]:
    """Character to byte, as byte-level vocabularies spell bytes: printable Latin-1 stands for
    itself, the other bytes in order for the characters from U+0100."""
    own = [b for b in range(256) if 0x21 <= b <= 0x7E or (0xA1 <= b and b != 0xAD)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class Encoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        self.slow.no_truncation()
        self.slow.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        to_byte = byte_characters()
        self.token_bytes = [b""] * (max([*vocab.values(), *(t["id"] for t in spec.get("added_tokens", []))]) + 1)
        for piece, i in vocab.items():
            if piece not in self.special:
                self.token_bytes[i] = bytes(to_byte[c] for c in piece)
        for t in spec.get("added_tokens", []):
            self.token_bytes[t["id"]] = t["content"].encode()
        self.token_lengths = np.array([len(b) for b in self.token_bytes], dtype=np.int64)
        self.fast = self._fast(spec, vocab)

    def _fast(self, spec: dict, vocab: dict[str, int]):
        """The rank-based encoder, if this vocabulary's ids follow its merge order."""
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        pre = spec.get("pre_tokenizer") or {}
        if pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or spec.get("normalizer"):
            return None
        ids = [vocab.get(a + b, -1) for a, b in pairs]
        if any(x >= y for x, y in zip(ids, ids[1:], strict=False)) or not ids or ids[0] < 256:
            return None
        import tiktoken

        special = set(self.special)
        ranks = {self.token_bytes[i]: i for p, i in vocab.items() if p not in special}
        return tiktoken.Encoding("corpus", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text as uint32, without added special tokens."""
        if not text:
            return np.zeros(0, np.uint32)
        if self.fast is not None and not _EXOTIC.search(text) and not any(s in text for s in self.special):
            if len(text) < _LONG_RUN or not _has_long_run(text):
                return self.fast.encode_to_numpy(text, disallowed_special=())
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    def decode(self, ids: np.ndarray) -> str:
        """As the library decodes with special tokens kept; broken UTF-8 becomes U+FFFD."""
        return b"".join(map(self.token_bytes.__getitem__, ids.tolist())).decode("utf-8", "replace")


def _has_long_run(text: str) -> bool:
    """Whether one run of white space or of anything else is so long that rank merging would be slow."""
    white = np.frombuffer(text.encode("utf-8"), np.uint8) <= 32
    turns = np.flatnonzero(white[1:] != white[:-1])
    edges = np.concatenate(([-1], turns, [len(white) - 1]))
    return bool(np.diff(edges).max() > _LONG_RUN)


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for each worker process and vocabulary."""
    return Encoder(path)
