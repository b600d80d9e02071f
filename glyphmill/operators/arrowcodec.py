"""The codec over Arrow batches: the same streams as codec.py, a document at a time and without any shuffle.

Tokens repeat, so a task keeps what a token encodes to, and a table of what each code decodes to; what depends on the
neighbours (implicit spaces, modifiers, counters) is worked out in arrays. The dictionary is sent to the tasks; the code
space bounds it to 65,000 words, which is checked. Written apart from codec.py, each checks the other.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from glyphmill.functions.codes import CAPITALIZED, CR, FUTURE_CONTROLS, LEXICAL_FIRST, LF, RESERVED_FIRST, SINGLE_LETTERS, SLOTS, SPACE, TAB, TYPOGRAPHY, UPPERCASE

#: Letters with letters and marks after them, runs of white space as str.isspace has it, or one other character.
TOKEN = r"\p{L}[\p{L}\p{M}]*|[\x09-\x0D\x1C-\x20\x85\xA0  -     　]+|[\s\S]"
#: The same for ASCII texts, which the faster of the two modules finds.
ASCII = r"[A-Za-z]+|[\x09-\x0D\x1C-\x20]+|[\s\S]"
#: A closed literal, a run of codes that aren't 0, or a 0 that begins no closed literal.
PIECE = rb"\x00\x00[^\x00]*+(?:\x00\x00[^\x00]*+)*+\x00\x01|(?:(?!\x00\x00)[\s\S]{2})++|\x00\x00"
KEPT, ROWS = 200_000, 256


def literal(text: str) -> bytes:
    return b"\0\0" + text.encode().replace(b"\0", b"\0\0") + b"\0\1"


class Known(dict):
    """Numbers of tokens, and by number what they encode to; odd ones are words with codes, 0 is a single space."""

    def __init__(self, make: Callable[[str], tuple[bytes, bool]]):
        self.make = make
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.data = [b"\0 ", b"\0 "]
        self[" "] = 0

    def __missing__(self, t: str) -> int:
        data, word = self.make(t)
        self[t] = n = len(self.data) + word
        self.data += (data, data)
        return n


class Encoder:
    def __init__(self, words: dict[str, int]):
        self.words, self.known, self.tokens, self.ascii = words, Known(self.token), regex.compile(TOKEN).findall, re.compile(ASCII).findall
        self.letter = regex.compile(r"\p{L}").match
        self.codes = {chr(k): k for k in [*range(128), *range(160, 256)]} | {c: k for k, c in TYPOGRAPHY.items()}

    def token(self, t: str) -> tuple[bytes, bool]:
        """What a token that isn't a single space encodes to, and whether it is a word with a code."""
        if t[0].isspace():
            return b"".join(ord(c).to_bytes(2, "big") if c in " \t\n\r" else literal(c) for c in t), False
        if self.letter(t):
            low = t.lower()
            if t == low:
                word, mark, back = low, b"", low
            elif t == t.upper():
                word, mark, back = low, UPPERCASE.to_bytes(2, "big"), low.upper()
            elif t[0] == t[0].upper() and t[1:] == t[1:].lower():
                word, mark, back = low, CAPITALIZED.to_bytes(2, "big"), low[0].upper() + low[1:]
            else:
                word, mark, back = t, b"", t
            code = ord(word) if word in SINGLE_LETTERS else self.words.get(word)
            return (literal(t), False) if code is None or back != t else (mark + code.to_bytes(2, "big"), True)
        code = self.codes.get(t)
        if code is None or code in (0, 1, 2, 3) or code in FUTURE_CONTROLS:
            return literal(t), False
        return code.to_bytes(2, "big"), False

    def __call__(self, text: str) -> bytes:
        known, found = self.known, (self.ascii if text.isascii() else self.tokens)(text)
        if len(known) > KEPT:
            known.reset()
        n = np.fromiter(map(known.__getitem__, found), np.int64, len(found))
        word, out = n & 1 == 1, n == 0
        out[:1] = out[-1:] = False
        out[1:-1] &= word[:-2] & word[2:]
        return b"".join(map(known.data.__getitem__, n[~out].tolist()))


def shifted(x: np.ndarray, by: int) -> np.ndarray:
    """x[i - by] at i, False where there is none."""
    out = np.zeros_like(x)
    out[by:] = x[: max(0, len(x) - by)]
    return out


def among(letters: str) -> np.ndarray:
    """Which bytes are among the letters."""
    out = np.zeros(256, bool)
    out[list(letters.encode())] = True
    return out


#: Letters of units, as in codec.unit_codes(): those that are words, modifiers, errors, and errors after a modifier.
WORD, MODIFIER, WRONG, AFTER = among("LUS"), among("CP"), among("OIEFRUX"), among("TIOWDCP")
COUNTED = {"lexical_items": "LU", "direct_items": "OEFRXSWD", "literal_items": "TI", "modifier_items": "CP", "explicit_whitespace_items": "W"}
SIZES = ("encoded_bytes", "decoded_characters", "decoded_utf8_bytes")
ERRORS = {"I": "INVALID_UTF8", "E": "LITERAL_END_OUTSIDE", "F": "RESERVED_CONTROL", "R": "RESERVED_EXTENSION", "U": "UNKNOWN_TOKEN", "X": "UNASSIGNED_DIRECT"}
CODES = 1 << 16


class Decoder:
    def __init__(self, words: dict[int, str]):
        self.words, self.pieces = words, re.compile(PIECE).findall
        self.chars = {k: chr(k) for k in [*range(128), *range(160, 256)]} | TYPOGRAPHY
        units = [self.unit(k) for k in range(CODES)]
        self.kinds = np.frombuffer("".join(k for k, _ in units).encode(), np.uint8)
        values = [v for _, v in units]
        word = WORD[self.kinds].tolist()
        cased = [values, [v.upper() if w else v for v, w in zip(values, word, strict=True)], [v[:1].upper() + v[1:] if w else v for v, w in zip(values, word, strict=True)]]
        #: Values as they are, in upper case and capitalized, then the same with a space before words.
        self.values = np.array([*cased[0], *cased[1], *cased[2], *(" " + v if w else v for c in cased for v, w in zip(c, word, strict=True))], object)

    def unit(self, code: int) -> tuple[str, str]:
        """The letter of a code and its value, empty if it has none."""
        if code in (0, 1, CAPITALIZED, UPPERCASE):
            return {0: "O", 1: "E", CAPITALIZED: "C", UPPERCASE: "P"}[code], ""
        if code in FUTURE_CONTROLS:
            return "F", ""
        if code >= RESERVED_FIRST:
            word = self.words.get(code)
            return ("R", "") if code < LEXICAL_FIRST else ("U", "") if word is None else ("L", word)
        char = self.chars.get(code)
        if char is None:
            return "X", ""
        return "S" if char.lower() in SINGLE_LETTERS else "W" if code in (SPACE, TAB, LF, CR) else "D", char

    def cut(self, rest: bytes) -> str:
        body = rb"\x00\x00[^\x00]*+(?:\x00\x00[^\x00]*+)*+"
        return "UNTERMINATED_LITERAL" if re.fullmatch(body, rest) else "TRUNCATED_ESCAPE" if re.fullmatch(body + rb"\x00", rest) else "BAD_ESCAPE"

    def error(self, data: bytes, pieces: list[bytes], kinds: np.ndarray, modifier: np.ndarray) -> str | None:
        """The first error of a stream, by position."""
        odd = "ODD_LENGTH" if sum(map(len, pieces)) != len(data) else None
        wrong = WRONG[kinds]
        wrong[:-1] |= modifier[:-1] & AFTER[kinds[1:]]
        wrong[-1:] |= modifier[-1:]
        if not wrong.any():
            return odd
        at = int(wrong.argmax())
        unit, after = (chr(kinds[k]) if k < len(kinds) else "" for k in (at, at + 1))
        if unit == "O":
            return self.cut(data[sum(map(len, pieces[: pieces.index(b"\0\0")])) :])
        if unit in ERRORS:
            return ERRORS[unit]
        if after == "":
            return odd or "DANGLING_MODIFIER"
        return "CONSECUTIVE_MODIFIERS" if after in "CP" else "LITERAL_AFTER_MODIFIER" if after in "TIO" else "MODIFIER_ON_DIRECT"

    def __call__(self, data: bytes | None) -> tuple:
        """The text (null if there is an error), the first error, the sizes and the counters."""
        if data is None:
            return None, None, *[None] * len(SIZES), *[0] * len(COUNTED), 0
        pieces = self.pieces(data)
        codes = np.frombuffer(b"".join([p if p[:2] != b"\0\0" else b"\0\0" for p in pieces]), ">u2").astype(np.int64)
        kinds, texts = self.kinds[codes], []
        zeros = np.flatnonzero(codes == 0)
        for k, p in zip(zeros.tolist(), (p for p in pieces if p[:2] == b"\0\0"), strict=True):
            if len(p) > 2:
                try:
                    texts.append(p[2:-2].replace(b"\0\0", b"\0").decode())
                    kinds[k] = ord("T")
                except UnicodeDecodeError:
                    kinds[k] = ord("I")
        word, modifier = WORD[kinds], MODIFIER[kinds]
        spaced = word & (shifted(word, 1) | shifted(modifier, 1) & shifted(word, 2))
        error, text = self.error(data, pieces, kinds, modifier), None
        if error is None:
            before = shifted(codes * modifier, 1)
            form = np.where(before == UPPERCASE, 1, np.where(before == CAPITALIZED, 2, 0)) + 3 * spaced
            parts = self.values[codes + CODES * form]
            parts[zeros] = texts
            text = "".join(parts.tolist())
        count = np.bincount(kinds, minlength=256)
        sizes = (None, None) if text is None else (len(text), len(text.encode()))
        return text, error, len(data), *sizes, *(int(count[list(which.encode())].sum()) for which in COUNTED.values()), int(spaced.sum())


def bounded(dictionary: DataFrame) -> list:
    """The words and tokens of a dictionary, if the code space holds them."""
    rows = dictionary.select("word", "token").limit(SLOTS + 1).collect()
    if len(rows) > SLOTS:
        raise ValueError(f"a dictionary has at most {SLOTS} words")
    return rows


def mapped(docs: DataFrame, key: str, column: str, sent, make: type, give: Callable, fields: list[tuple[str, str, pa.DataType]]) -> DataFrame:
    """key and fields: what give makes of each value of column, with one coder for each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = make(sent.value)
        for batch in (b.slice(k, ROWS) for b in batches for k in range(0, b.num_rows, ROWS)):
            rows = [give(coder, x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[k] for r in rows], t) for k, (_, _, t) in enumerate(fields))], names=[key, *(n for n, _, _ in fields)])

    return docs.select(key, column).mapInArrow(run, f"`{key}` {dict(docs.dtypes)[key]}, " + ", ".join(f"{n} {k}" for n, k, _ in fields))


def encode(docs: DataFrame, dictionary: DataFrame, key: str = "doc_id") -> DataFrame:
    """key and encoded, as codec.encode()."""
    sent = docs.sparkSession.sparkContext.broadcast({r.word: r.token for r in bounded(dictionary)})
    return mapped(docs, key, "text", sent, Encoder, lambda coder, x: (None if x is None else coder(x),), [("encoded", "binary", pa.binary())])


def decode(encoded: DataFrame, dictionary: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, text, error and the decoder's counters, as codec.decode()."""
    sent = encoded.sparkSession.sparkContext.broadcast({r.token: r.word for r in bounded(dictionary)})
    counters = [(n, "long", pa.int64()) for n in (*SIZES, *COUNTED, "reconstructed_implicit_spaces")]
    return mapped(encoded, key, "encoded", sent, Decoder, lambda coder, x: coder(x), [("text", "string", pa.string()), ("error", "string", pa.string()), *counters])
