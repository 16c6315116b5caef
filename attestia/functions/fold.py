"""Table folding of characters that look the same; pure Python, used inside Arrow workers."""
from __future__ import annotations

import unicodedata

# Letters of other scripts drawn like a Latin letter, and the letter each is drawn like.
LOOK_ALIKES = {
    # Cyrillic
    "А": "A", "В": "B", "Е": "E", "З": "3", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ѕ": "S", "І": "I", "Ј": "J",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "l",
    # Greek
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "α": "a", "ι": "i", "ν": "v", "ο": "o", "ρ": "p", "υ": "u", "ϲ": "c", "ϳ": "j",
    # Armenian and Latin extensions
    "օ": "o", "ս": "u", "հ": "h", "ո": "n", "ɑ": "a", "ɡ": "g", "ı": "i",
    # hyphens drawn alike
    "‐": "-", "‑": "-",
}
#: Compatibility forms with these tags are drawn like their parts (width, font, joining form, ligature, space).
_SAME_SHAPE = {"<wide>", "<narrow>", "<noBreak>", "<font>", "<initial>", "<medial>", "<final>", "<isolated>", "<compat>"}
_INVISIBLE = {0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0, *range(0xFE00, 0xFE10), *range(0x180B, 0x180F), *range(0xE0100, 0xE01F0)}


def fold_char(ch: str) -> str:
    """What one character of decomposed text is drawn as."""
    if ch in LOOK_ALIKES:
        return LOOK_ALIKES[ch]
    kind = unicodedata.category(ch)
    if kind == "Cf" or ord(ch) in _INVISIBLE:
        return ""
    if kind == "Zs":
        return " "
    parts = unicodedata.decomposition(ch).split()
    if parts and parts[0] in _SAME_SHAPE:
        made = "".join(chr(int(p, 16)) for p in parts[1:])
        if kind == "Lm" or made.strip() != made:  # spacing accents
            return ch
        return "".join(fold_char(c) for c in unicodedata.normalize("NFD", made))
    return ch


class FoldTable(dict):
    """A str.translate table that fills itself per code point."""

    def __missing__(self, code: int) -> str:
        self[code] = out = fold_char(chr(code))
        return out


def make_fold():
    """fold(text): one form for all texts that look the same. Letter case, superscripts, circled digits and ß stay."""
    table = FoldTable()

    def fold(text: str) -> str:
        if text.isascii():
            return text
        return unicodedata.normalize("NFC", unicodedata.normalize("NFD", text).translate(table))

    return fold
