"""Token ids of whole texts with a cache of parts.

Texts of printable ASCII, precomposed Latin letters, blanks and line ends need no normalising
beyond lower case: they are split here into parts, and each distinct part goes to the merge
model once while it stays cached. The tokenizer drops white space and never joins across it,
so any other text is taken chunk by blank-separated chunk: plain ones likewise, the rest
through the whole tokenizer. Parts and chunks of over ``LONG`` characters are not cached, so
the caches are bounded in bytes.
"""

from __future__ import annotations

import json
import os
import re
import struct
from collections.abc import Iterator

import numpy as np

#: Characters that the fast path takes: printable ASCII, Latin letters that are in normal form C
#: and have a lower case of one character.
PLAIN = re.compile("[!-~À-ÖØ-öø-įı-ɏ]+")
PLAIN_TEXT = re.compile("[!-~À-ÖØ-öø-įı-ɏ \n]*")
#: The vocabulary's pattern of parts, for the characters of PLAIN_TEXT.
PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zÀ-ÖØ-öø-ɏ]+|[0-9]|[^\\sa-zÀ-ÖØ-öø-ɏ0-9]+")
LONG = 64


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


def merge_core(model: dict) -> tuple[object, dict[int, str], dict[str, str]]:
    """The merges as ranks of byte strings for the faster merge library, and two translations.

    A symbol is a byte, or a byte at a word's end. Each is written as two bytes from disjoint
    sets, so symbols never run into each other. Merging by rank of the joined string equals
    merging by pair: when a string's rank comes up, lower merges have left it as its own pair.
    The translations map a character, and a last character, to its symbols.
    """
    import tiktoken

    code = [(chr(64 + b // 16) + chr(32 + b % 16), chr(96 + b // 16) + chr(32 + b % 16)) for b in range(256)]
    byte_of, end = {c: b for b, c in enumerate(byte_letters())}, model["end_of_word_suffix"]
    ranks = {}
    for token, i in model["vocab"].items():
        last = token.endswith(end)
        bs = [byte_of[c] for c in token.removesuffix(end)]
        ranks["".join(code[b][last and j == len(bs) - 1] for j, b in enumerate(bs)).encode()] = i
    chars = [chr(c) for c in range(33, 0x250)]
    inner = {ord(c): "".join(code[b][0] for b in c.encode()) for c in chars}
    final = {c: "".join(code[b][0] for b in c.encode()[:-1]) + code[c.encode()[-1]][1] for c in chars}
    core = tiktoken.Encoding("parts", pat_str=".+", mergeable_ranks=ranks, special_tokens={})
    return core._core_bpe, inner, final


class Encoder:
    """Encodes texts to uint32 ids; the caches are emptied beyond ``entries`` entries."""

    known: dict[str, "Encoder"] = {}

    def __init__(self, path: str, entries: int = 250_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.entries = Tokenizer.from_file(path), entries
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        with open(path, encoding="utf-8") as file:
            core, inner, final = merge_core(json.load(file)["model"])
        merged, pack = core.encode_single_piece, [struct.Struct(f"<{n}I").pack for n in range(64)]

        class Parts(dict):
            def __missing__(self, part: str) -> bytes:
                ids = merged((part[:-1].translate(inner) + final[part[-1]]).encode())
                out = pack[len(ids)](*ids) if len(ids) < 64 else np.array(ids, "<u4").tobytes()
                if len(part) <= LONG:
                    self[part] = out
                return out

        parts = Parts()

        class Chunks(dict):
            def __missing__(chunks, chunk: str) -> bytes:
                if not chunk:
                    ids = b""
                elif PLAIN.fullmatch(chunk) and not ("<" in chunk and any(s in chunk for s in special)):
                    low = chunk.lower()
                    ids = parts[low] if low.isalpha() else b"".join([parts[p] for p in PARTS.findall(low)])
                else:
                    ids = np.array(self.tokenizer.encode(chunk, add_special_tokens=False).ids, "<u4").tobytes()
                if len(chunk) <= LONG:
                    chunks[chunk] = ids
                return ids

        self.parts, self.chunks, self.special = parts, Chunks(), special

    @classmethod
    def of(cls, path: str) -> "Encoder":
        """One encoder a worker process and file."""
        if path not in cls.known:
            cls.known[path] = cls(path)
        return cls.known[path]

    def encode(self, texts: list[str], end_id: int | None = None) -> Iterator[np.ndarray]:
        tail = b"" if end_id is None else np.uint32(end_id).tobytes()
        chunks, part, special = self.chunks, self.parts.__getitem__, self.special
        for text in texts:
            if len(chunks) > self.entries or len(self.parts) > self.entries:
                chunks.clear()
                self.parts.clear()
            if PLAIN_TEXT.fullmatch(text) and not ("<" in text and any(s in text for s in special)):
                yield np.frombuffer(b"".join([*map(part, PARTS.findall(text.lower())), tail]), "<u4")
            else:
                yield np.frombuffer(b"".join([*map(chunks.__getitem__, text.replace("\n", " ").split(" ")), tail]), "<u4")
