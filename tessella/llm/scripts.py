"""Scripts of letters by ranges of code points. A letter is a character of a Unicode category L."""

from __future__ import annotations

import functools
import unicodedata

import numpy as np

#: First code point of each range and the script it belongs to ('' for none), from the Unicode block list.
RANGES = (
    (0x0000, ""), (0x0041, "latin"), (0x005B, ""), (0x0061, "latin"), (0x007B, ""), (0x00AA, "latin"), (0x00AB, ""), (0x00B5, "latin"), (0x00B6, ""), (0x00BA, "latin"), (0x00BB, ""),
    (0x00C0, "latin"), (0x00D7, ""), (0x00D8, "latin"), (0x00F7, ""), (0x00F8, "latin"), (0x02B0, ""), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"),
    (0x0700, "syriac"), (0x0750, "arabic"), (0x0780, "thaana"), (0x07C0, "other"), (0x08A0, "arabic"), (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "gurmukhi"), (0x0A80, "gujarati"),
    (0x0B00, "oriya"), (0x0B80, "tamil"), (0x0C00, "telugu"), (0x0C80, "kannada"), (0x0D00, "malayalam"), (0x0D80, "sinhala"), (0x0E00, "thai"), (0x0E80, "lao"), (0x0F00, "tibetan"),
    (0x1000, "myanmar"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x13A0, "other"), (0x1780, "khmer"), (0x1800, "mongolian"), (0x18B0, "other"), (0x1E00, "latin"),
    (0x1F00, "greek"), (0x2000, ""), (0x2C00, "other"), (0x2DE0, "cyrillic"), (0x2E00, ""), (0x3041, "kana"), (0x3100, "other"), (0x3130, "hangul"), (0x3190, ""), (0x31A0, "other"), (0x31F0, "kana"),
    (0x3200, ""), (0x3400, "han"), (0x4DC0, ""), (0x4E00, "han"), (0xA000, "other"), (0xA640, "cyrillic"), (0xA6A0, "other"), (0xA720, "latin"), (0xA800, "other"), (0xAC00, "hangul"), (0xD7B0, "other"),
    (0xE000, ""), (0xF900, "han"), (0xFB00, "latin"), (0xFB13, "armenian"), (0xFB1D, "hebrew"), (0xFB50, "arabic"), (0xFE00, ""), (0xFE70, "arabic"), (0xFEFF, ""), (0xFF21, "latin"), (0xFF3B, ""),
    (0xFF41, "latin"), (0xFF5B, ""), (0xFF66, "kana"), (0xFFA0, ""), (0x10000, "other"), (0x1F000, ""), (0x20000, "han"), (0x32000, ""),
)
NAMES = sorted({name for _, name in RANGES})
NONE, OTHER = NAMES.index(""), NAMES.index("other")
_FIRST = np.array([a for a, _ in RANGES])
_NAME = np.array([NAMES.index(b) for _, b in RANGES])
_PAD = np.zeros(3, np.uint8)


@functools.cache
def of_code_points() -> np.ndarray:
    """Script number of every code point: NONE for what is no letter, OTHER for letters outside the named ranges."""
    code = np.arange(0x110000)
    script = _NAME[np.searchsorted(_FIRST, code, "right") - 1].astype(np.uint8)
    letter = np.fromiter((unicodedata.category(chr(c))[0] == "L" for c in code.tolist()), bool, len(code))
    script[letter & (script == NONE)] = OTHER
    script[~letter] = NONE
    return script


def characters(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte position and script number of every character of well-formed UTF-8."""
    at = np.flatnonzero((buf & 0xC0) != 0x80)
    b = np.concatenate([buf, _PAD]).astype(np.int32)
    lead = b[at]
    code = lead.copy()
    for low, keep, n in ((0xC0, 0x1F, 1), (0xE0, 0x0F, 2), (0xF0, 0x07, 3)):
        some = np.flatnonzero(lead >= low)
        value = lead[some] & keep
        for i in range(1, n + 1):
            value = (value << 6) | (b[at[some] + i] & 0x3F)
        code[some] = value
    return at, of_code_points()[code].astype(np.int64)


def of_spans(buf: np.ndarray, starts: np.ndarray, n: int, group: np.ndarray) -> np.ndarray:
    """Letters of each script in each of n groups: group[i] is the group of the span that starts at starts[i] and lasts to the next start."""
    at, script = characters(buf)
    which = np.searchsorted(starts, at, "right") - 1
    ok = (script != NONE) & (which >= 0)
    return np.bincount(group[which[ok]] * len(NAMES) + script[ok], minlength=n * len(NAMES)).reshape(n, len(NAMES))
