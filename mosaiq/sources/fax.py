"""Bilevel run-length codecs of the facsimile standards (ITU-T T.4 and T.6): one-dimensional, mixed and two-dimensional rows.

A row is held as its changes: the positions where its colour turns, starting from white (0).
"""

from __future__ import annotations

import numpy as np

#: Codes of white runs of 0 to 63, then of 64, 128, ... 1728.
WHITE = """
00110101 000111 0111 1000 1011 1100 1110 1111 10011 10100 00111 01000 001000 000011 110100 110101
101010 101011 0100111 0001100 0001000 0010111 0000011 0000100 0101000 0101011 0010011 0100100 0011000 00000010 00000011 00011010
00011011 00010010 00010011 00010100 00010101 00010110 00010111 00101000 00101001 00101010 00101011 00101100 00101101 00000100 00000101 00001010
00001011 01010010 01010011 01010100 01010101 00100100 00100101 01011000 01011001 01011010 01011011 01001010 01001011 00110010 00110011 00110100
11011 10010 010111 0110111 00110110 00110111 01100100 01100101 01101000 01100111 011001100 011001101 011010010 011010011
011010100 011010101 011010110 011010111 011011000 011011001 011011010 011011011 010011000 010011001 010011010 011000 010011011
""".split()
#: Codes of black runs, likewise.
BLACK = """
0000110111 010 11 10 011 0011 0010 00011 000101 000100 0000100 0000101 0000111 00000100 00000111 000011000
0000010111 0000011000 0000001000 00001100111 00001101000 00001101100 00000110111 00000101000 00000010111 00000011000 000011001010 000011001011 000011001100 000011001101 000001101000 000001101001
000001101010 000001101011 000011010010 000011010011 000011010100 000011010101 000011010110 000011010111 000001101100 000001101101 000011011010 000011011011 000001010100 000001010101 000001010110 000001010111
000001100100 000001100101 000001010010 000001010011 000000100100 000000110111 000000111000 000000100111 000000101000 000001011000 000001011001 000000101011 000000101100 000001011010 000001100110 000001100111
0000001111 000011001000 000011001001 000001011011 000000110011 000000110100 000000110101 0000001101100 0000001101101 0000001001010 0000001001011 0000001001100 0000001001101 0000001110010
0000001110011 0000001110100 0000001110101 0000001110110 0000001110111 0000001010010 0000001010011 0000001010100 0000001010101 0000001011010 0000001011011 0000001100100 0000001100101
""".split()
#: Codes of runs of 1792, 1856, ... 2560, in either colour.
LONG = "00000001000 00000001100 00000001101 000000010010 000000010011 000000010100 000000010101 000000010110 000000010111 000000011100 000000011101 000000011110 000000011111".split()
#: Codes of the two-dimensional modes, and the end of a line.
MODES = {"pass": "0001", "horizontal": "001", 0: "1", 1: "011", 2: "000011", 3: "0000011", -1: "010", -2: "000010", -3: "0000010"}
EOL = "000000000001"
PEEK = 13


def _lengths(codes: list[str]) -> dict[int, str]:
    return dict(enumerate(codes[:64])) | {64 * (i + 1): c for i, c in enumerate(codes[64:])} | {1792 + 64 * i: c for i, c in enumerate(LONG)}


def _lookup(codes: dict) -> list:
    """What the next 13 bits begin with: (value, bits), or None."""
    out = [None] * (1 << PEEK)
    for value, code in codes.items():
        rest = PEEK - len(code)
        at = int(code, 2) << rest
        out[at : at + (1 << rest)] = [(value, len(code))] * (1 << rest)
    return out


RUNS = (_lengths(WHITE), _lengths(BLACK))
_RUN, _MODE = tuple(_lookup(r) for r in RUNS), _lookup(MODES)


class _Damage(Exception):
    pass


class _Bits:
    def __init__(self, data: bytes):
        self.data, self.at, self.end = data + bytes(4), 0, len(data) * 8

    def peek(self, n: int = PEEK) -> int:
        i = self.at >> 3
        return int.from_bytes(self.data[i : i + 4], "big") >> (32 - n - (self.at & 7)) & ((1 << n) - 1)

    def take(self, table: list):
        found = table[self.peek()] if self.at < self.end else None
        if found is None:
            raise _Damage
        self.at += found[1]
        return found[0]

    def run(self, color: int) -> int:
        total = 0
        while (n := self.take(_RUN[color])) >= 64:
            total += n
        return total + n

    def skip_eol(self) -> bool:
        """Go past fill bits and an end of line, if they are next."""
        at = self.at
        while self.at < self.end and self.peek(12) == 0:
            self.at += 1
        if self.at < self.end and self.peek(12) == 1:
            self.at += 12
            return True
        self.at = at
        return False

    def resume(self) -> None:
        """After damage: go to the next end of line."""
        while self.at < self.end and self.peek(12) != 1:
            self.at += 1


def _tidy(changes: list[int], width: int) -> list[int]:
    """Without empty runs, and without what lies at the end of the row."""
    out: list[int] = []
    for x in changes:
        if out and out[-1] == x:
            out.pop()
        else:
            out.append(x)
    while out and out[-1] >= width:
        out.pop()
    return out


def _row_1d(bits: _Bits, width: int, out: list[int]) -> None:
    at = color = 0
    while at < width:
        at += bits.run(color)
        out.append(at)
        color ^= 1


def _beyond(ref: list[int], j: int, a0: int, color: int) -> int:
    """Index of the first change of ref right of a0 that turns from this colour; j: where the last one was."""
    j = max(j - 1, 0)
    while j < len(ref) and (ref[j] <= a0 or j & 1 != color):
        j += 1
    return j


def _row_2d(bits: _Bits, width: int, ref: list[int], out: list[int]) -> None:
    a0, color, j = -1, 0, 0
    while a0 < width:
        mode = bits.take(_MODE)
        if mode == "horizontal":
            for turn in (color, color ^ 1):
                a0 = max(a0, 0) + bits.run(turn)
                out.append(a0)
            continue
        j = _beyond(ref, j, a0, color)
        if mode == "pass":
            a0 = ref[j + 1] if j + 1 < len(ref) else width
        else:
            a1 = (ref[j] if j < len(ref) else width) + mode
            if a1 < max(a0, 0):
                raise _Damage
            a0 = a1
            out.append(a0)
            color ^= 1


def decode(data: bytes, width: int, rows: int | None, kind: str, two: bool = False) -> bytes:
    """Packed rows, black as 1. kind: `rle` (rows start on bytes), `rlew` (on 16 bits), `g3` (two: mixed rows) or `g4`.

    rows None: as many as the data has. Rows that end early are white from there; after damage, g3 goes on at the next end of line, the others end.
    """
    bits, ref, found = _Bits(data), [], []
    while rows is None or len(found) < rows:
        flat = kind != "g4"
        if kind == "g3":
            ended = 0
            while bits.skip_eol():
                ended += 1
                if two:
                    flat = bool(bits.peek(1))
                    bits.at += 1
            if ended > 1 and found or bits.at >= bits.end:
                break
        row: list[int] = []
        damaged = False
        try:
            _row_1d(bits, width, row) if flat else _row_2d(bits, width, ref, row)
        except _Damage:
            damaged = True
        ref = _tidy([min(x, width) for x in row], width)
        if rows is None and damaged and not row:
            break
        found.append(ref)
        if damaged and kind == "g3":
            bits.resume()
        elif damaged:
            break
        if kind in ("rle", "rlew"):
            step = 8 if kind == "rle" else 16
            bits.at = -(-bits.at // step) * step
    turns = np.zeros((len(found) if rows is None else rows, width + 1), np.uint8)
    for y, ref in enumerate(found):
        turns[y, ref] = 1
    return np.packbits(np.bitwise_xor.accumulate(turns, axis=1)[:, :width], axis=1).tobytes()


def _put_run(n: int, color: int, out: list[str]) -> None:
    while n >= 2560 + 64:
        out.append(RUNS[color][2560])
        n -= 2560
    if n >= 64:
        out.append(RUNS[color][n // 64 * 64])
    out.append(RUNS[color][n % 64])


def _put_1d(row: list[int], width: int, out: list[str]) -> None:
    at = 0
    for i, x in enumerate([*row, width]):
        _put_run(x - at, i & 1, out)
        at = x


def _put_2d(row: list[int], ref: list[int], width: int, out: list[str]) -> None:
    a0, color, i, j = -1, 0, 0, 0
    while a0 < width:
        a1 = row[i] if i < len(row) else width
        j = _beyond(ref, j, a0, color)
        b1, b2 = (ref[k] if k < len(ref) else width for k in (j, j + 1))
        if b2 < a1:
            out.append(MODES["pass"])
            a0 = b2
        elif abs(a1 - b1) <= 3:
            out.append(MODES[a1 - b1])
            a0, i, color = a1, i + 1, color ^ 1
        else:
            a2 = row[i + 1] if i + 1 < len(row) else width
            out.append(MODES["horizontal"])
            _put_run(a1 - max(a0, 0), color, out)
            _put_run(a2 - a1, color ^ 1, out)
            a0, i = a2, i + 2


def encode(data: bytes, width: int, rows: int, kind: str, two: bool = False, aligned: bool = False, every: int = 4) -> bytes:
    """Encode packed rows. g3: each row follows an end of line (aligned: that ends on a byte); with two, one row in `every` is flat."""
    x = np.unpackbits(np.frombuffer(data, np.uint8).reshape(rows, -1), axis=1)[:, :width]
    ys, xs = np.nonzero(np.diff(x, axis=1, prepend=np.uint8(0)))
    cuts = np.searchsorted(ys, np.arange(rows + 1))
    out: list[str] = []
    size, ref = 0, []
    for y in range(rows):
        row, part = xs[cuts[y] : cuts[y + 1]].tolist(), []
        if kind == "g3":
            part.append("0" * (-(size + 12) % 8 if aligned else 0) + EOL + (str(int(y % every == 0)) if two else ""))
        if kind == "g4" or kind == "g3" and two and y % every:
            _put_2d(row, ref, width, part)
        else:
            _put_1d(row, width, part)
        one = "".join(part)
        if kind in ("rle", "rlew"):
            one += "0" * (-len(one) % (8 if kind == "rle" else 16))
        out.append(one)
        size += len(one)
        ref = row
    if kind == "g4":
        out.append(EOL * 2)
    elif kind == "g3":
        out.append((EOL + ("1" if two else "")) * 6)
    text = "".join(out)
    text += "0" * (-len(text) % 8)
    return int(text, 2).to_bytes(len(text) // 8, "big") if text else b""
