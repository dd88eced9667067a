"""Parts of an open file in place of its bytes, so that directories and single chunks are read without the rest."""

from __future__ import annotations

from collections import OrderedDict

#: Short reads come from blocks of this size, of which the last few are kept; longer ones go to the file.
BLOCK, KEPT = 1 << 18, 16


class Ranged:
    """Reads by slice, as bytes would give them. file: seekable, opened for reading."""

    def __init__(self, file, size: int):
        self.file, self.size, self.blocks = file, size, OrderedDict()

    def __len__(self) -> int:
        return self.size

    def __getitem__(self, part: slice) -> bytes:
        low, high, _ = part.indices(self.size)
        if high - low > BLOCK:
            return self._read(low, high)
        out = b"".join(self._block(k) for k in range(low // BLOCK, -(-high // BLOCK))) if high > low else b""
        return out[low % BLOCK : low % BLOCK + high - low]

    def _read(self, low: int, high: int) -> bytes:
        self.file.seek(low)
        return self.file.read(high - low)

    def _block(self, k: int) -> bytes:
        if k in self.blocks:
            self.blocks.move_to_end(k)
        else:
            self.blocks[k] = self._read(k * BLOCK, min((k + 1) * BLOCK, self.size))
            if len(self.blocks) > KEPT:
                self.blocks.popitem(last=False)
        return self.blocks[k]
