"""Exact token counts and ids from the public tokenizers' libraries, remembered piece by piece.

A text is divided only where no token can reach across, and the library encodes each distinct part once
per task (the memory of parts is bounded); where a text gives no such guarantee the library gets it whole.
"""

from __future__ import annotations

import hashlib
import re
from array import array

#: Parts remembered by a task; beyond it the memory starts anew.
REMEMBERED = 500_000
#: Parts longer than this are not remembered.
LONG_PART = 64


def version_of(path: str) -> bytes:
    """Digest of a tokenizer's file."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).digest()


class Pieces:
    """sentencepiece: counts. Its pieces hold the space mark only at their start and its normaliser leaves
    texts alone (both are checked at load), so no merge reaches from a letter into a following space."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        probe = "A  b\tc\nd éé ﬁ Ａ "
        self.safe = not any("▁" in x.lstrip("▁") for x in names) and self.model.normalize(probe) in (probe, "▁" + probe.replace(" ", "▁"))
        self.seen: dict[str, int] = {}

    def whole(self, text: str) -> int:
        return len(self.model.encode(text))

    def count(self, text: str) -> int:
        if not self.safe or not text or "▁" in text or "\x00" in text:
            return self.whole(text)
        # a part is a word with the space before it, which the model itself puts before every text
        parts, seen, total, spaces = text.split(" "), self.seen, 0, 0
        get = seen.get
        for part in parts:
            if not part:
                spaces += 1
                continue
            if spaces:
                part, spaces = " " * spaces + part, 0
            n = get(part)
            if n is None:
                n = self.whole(part)
                if len(part) <= LONG_PART:
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    seen[part] = n
            total += n
        return total + (self.whole(" " * (spaces - 1)) if spaces > 1 else self.whole_tail() if spaces else 0)

    def whole_tail(self) -> int:
        """Tokens of the lone space mark that one last space leaves."""
        if "" not in self.seen:
            self.seen[""] = self.whole("a ") - self.whole("a")
        return self.seen[""]


#: One pre-token: letters, perhaps behind a space. Such a part needs the merges alone.
LETTERS = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ɏ]+")
#: A mark that ends a word is a pre-token of its own if a letter stands before it.
MARKS = frozenset(".,;:!?")


def byte_letters() -> dict[int, str]:
    """The printable stand-ins of byte-level vocabularies: printable bytes themselves, others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class ByteBpe:
    """tokenizers: ids as little-endian 32-bit bytes. White space ends a pre-token's word, so a text may be
    divided before a space that follows a character which is surely none, and between a letter and the mark
    that ends a word."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.special = [t.content for t in self.model.get_added_tokens_decoder().values()]
        self.seen: dict[str, bytes] = {}
        self.letters, self.merges = byte_letters(), self.model.model
        # merges alone give a part's ids only in a plain byte-level vocabulary
        self.plain = all(self.merged(x) == self.whole(x) for x in (" the", "été", " Straßenbahn", "qzxjk"))

    def merged(self, part: str) -> bytes:
        return array("I", [t.id for t in self.merges.tokenize(part.encode().decode("latin-1").translate(self.letters))]).tobytes()

    def part(self, part: str) -> bytes:
        found = self.seen.get(part)
        if found is None:
            found = self.merged(part) if self.plain and LETTERS.fullmatch(part) else self.whole(part)
            if len(part) <= LONG_PART:
                if len(self.seen) >= REMEMBERED:
                    self.seen.clear()
                self.seen[part] = found
        return found

    def whole(self, text: str) -> bytes:
        return array("I", self.model.encode(text, add_special_tokens=False).ids).tobytes()

    def ids(self, text: str) -> bytes:
        if any(t in text for t in self.special):
            return self.whole(text)
        seen, out, held = self.seen, [], None
        get = seen.get
        for k, word in enumerate(text.split(" ")):
            part = " " + word if k else word
            if held is not None:
                part, held = held + part, None
            last = part[-1:]
            if not ("!" <= last <= "~" or "¡" <= last <= "ɏ"):
                held = part
                continue
            found = get(part)
            if found is None:
                if last in MARKS and ("a" <= part[-2:-1] <= "z" or "A" <= part[-2:-1] <= "Z"):
                    out.append(get(part[:-1]) or self.part(part[:-1]))
                    part = last
                found = get(part) or self.part(part)
            out.append(found)
        if held:
            out.append(self.whole(held))
        return b"".join(out)
