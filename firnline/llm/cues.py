"""Reading subtitle text: spoken words of a document without cue furniture.

Works on whole texts, any layout (numbered cues, frame counts, bare text) and
damaged ones (misread digits in times, broken arrows, wrong encodings).
"""

from __future__ import annotations

import re
import unicodedata

# cue number (own line or leading) and the time line that follows it
TIME_LINE = re.compile(
    rb"^(?:[^\S\n]*\d+\.?[^\S\n]*(?:\n[^\S\n]*)?)?[o0-9]{1,3}:[o0-9]{2}(?::[o0-9]{2})?[.,][o0-9]{2,3}[^\S\n]*(?:,|\W{1,6})[^\S\n]*[o0-9]{1,3}:[^\n]*$", re.M
)
FRAMES = re.compile(rb"\{\d*\}\{\d*\}|\{[^{}\n]*\}")
TAG = re.compile(rb"</?[a-z0-9]+(?:\s[^<>]*)?/?>")
SOUND = re.compile(rb"\[[^\[\]]*\]|\([^()]*\)|\*[^*\n]+\*")

# letters of other scripts than Latin; syllabic and ideographic ones are words of their own
_OTHER = re.compile(r"[\u0370-\u1dff\u2c00-\u2fdf\u3005-\ua71f\ua800-\uaaff\uabc0-\ufaff\ufe70-\ufefe\uff66-\uffdc\U00010000-\U0003ffff]")
_IDEOGRAM = re.compile(r"[\u3005-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")
_FOREIGN = re.compile(r"[\u0370-\u1dff\u2c00-\u2fdf\ua800-\uaaff\uabc0-\ud7ff\ufe70-\ufefe\uff66-\uffdc]\S*[\u0370-\u1dff\u2c00-\u2fdf\ua800-\uaaff\uabc0-\ud7ff\ufe70-\ufefe\uff66-\uffdc]|" + _IDEOGRAM.pattern)
_WORD = re.compile(r"\S*[\u0370-\u1dff\u2c00-\u2fdf\u3005-\ua71f\ua800-\uaaff\uabc0-\ufaff\ufe70-\ufefe\uff66-\uffdc\U00010000-\U0003ffff]\S*")
_GAP = re.compile(rf"(?<={_OTHER.pattern})[\xa0\u2000-\u200a\u202f\u3000](?={_OTHER.pattern})")
_LONE = re.compile(r"(?<![^ \t\n\r\f\v])[^ \t\n\r\f\vA-Za-z0-9]*[^\W\d_\x00-\x7f][^ \t\n\r\f\vA-Za-z0-9]*(?![^ \t\n\r\f\v])|(?<![^ \t\n\r\f\v])\ufffd+(?![^ \t\n\r\f\v])")
# letters of those scripts that scanners confuse with Latin ones, or with digits
_ALIKE = frozenset("аеорсухіѕјһοορνικτυαεχ")
_DIGITS = "abcdgjknopqrvxyz"  # bytes that the folding below leaves alone
# fixed values: stops of other scripts
_STOPS = str.maketrans("。！？،؟।", ".!?,?.")
VANISHED = b"\x7f"  # stands for a word that folds to nothing


def _spelt(token: str) -> str:
    """A word in another script, spelt in letters that survive the folding."""
    letters = [c for c in unicodedata.normalize("NFKD", token) if _OTHER.match(c) and not unicodedata.combining(c)]
    if 2 * sum("a" <= c <= "z" for c in token) >= len(letters) and not any(map(_IDEOGRAM.match, letters)):
        return token  # a Latin word with letters in a wrong encoding
    out = []
    for c in letters:
        if c in _ALIKE:
            continue
        code = ord(c)
        word = "zz" + "".join(_DIGITS[code >> k & 15] for k in (16, 12, 8, 4, 0))
        out.append(f" {word} " if _IDEOGRAM.match(c) else word)
    return "".join(out) or " "


def plain(text: str, mark: bool = False) -> bytes:
    """Lower-case ASCII of a text.

    In Latin words characters outside ASCII vanish, so that every wrong reading
    of an accented letter leaves the same word; with ``mark`` a word of nothing
    else leaves ``VANISHED``.  Words in other scripts are spelt letter by
    letter, without accents; every ideogram is a word.
    """
    s = text.lower()
    if not s.isascii():
        if mark:
            s = _LONE.sub(lambda m: m[0] if _FOREIGN.search(m[0]) else " \x7f ", s)
        if _OTHER.search(s):
            s = _GAP.sub(" ", s).translate(_STOPS)
            s = _WORD.sub(lambda m: _spelt(m[0]) if _FOREIGN.search(m[0]) else m[0], s)
    return s.encode("ascii", "ignore")


# fixed values: characters that scanners and players mistake for each other,
# folded to one representative; the pairs of letters are folded after them
SAME = {"l": "i", "1": "i", "!": "", "0": "o", "e": "c", "t": "f", "5": "s", "|": " "}
PAIRS = ((b"h", b"ii"), (b"m", b"rn"), (b"w", b"vv"), (b"ss", b""))
_KEEP = set(b"abcdefghijklmnopqrstuvwxyz0123456789 \n\t\x0b\x0c\r|")
_DROP = bytes(c for c in range(128) if c not in _KEEP)
_TABLE = bytes(ord(SAME.get(chr(c), chr(c)) or " ") if c < 128 else c for c in range(256))


def spoken(text: str, mark: bool = False) -> bytes:
    """What is said in a text, as ``plain`` writes it: no cue numbers, times, markup or sounds."""
    s = plain(text, mark)
    if b"\r" in s:
        s = s.replace(b"\r\n", b"\n").replace(b"\r", b"\n")
    if b":" in s:
        s = TIME_LINE.sub(b"", s)
    if b"{" in s:
        s = FRAMES.sub(b" ", s)
    if b"<" in s:
        s = TAG.sub(b" ", s)
    if b"[" in s or b"(" in s or b"*" in s:
        s = SOUND.sub(closed, s)
    return s


def closed(m: re.Match[bytes]) -> bytes:
    """A bracket that closes within its cue is taken out; one that was never closed does not swallow the cues behind it."""
    t = m[0]
    return b" " if t.count(b"\n") <= 3 and b"\n\n" not in t else t[:1] + SOUND.sub(closed, t[1:])


def foreign(word: bytes) -> bool:
    """Whether ``plain`` spelt a word of another script."""
    return word.startswith(b"zz") and len(word) >= 7 and not word.strip(_DIGITS.encode())


def ideogram(word: bytes) -> bool:
    return foreign(word) and len(word) == 7 and _IDEOGRAM.match(chr(sum(_DIGITS.index(chr(c)) << k for c, k in zip(word[2:], (16, 12, 8, 4, 0))))) is not None


def skeleton(said: bytes) -> list[bytes]:
    """Words folded so that misread characters and punctuation make no difference."""
    s = said.translate(_TABLE, _DROP)
    for a, b in PAIRS:
        s = s.replace(a, b)
    return s.split()
