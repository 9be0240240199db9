"""The public piece model read as a unigram model: the library's own Viterbi for the same pieces and scores."""

from __future__ import annotations


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        at += 1
        value |= (b & 127) << shift
        shift += 7
        if b < 128:
            return value, at


def as_unigram(path: str) -> bytes:
    """The model file with ``trainer_spec.model_type`` set to 1 (unigram)."""
    data, out, at = open(path, "rb").read(), bytearray(), 0
    while at < len(data):
        begin = at
        tag, at = _varint(data, at)
        assert tag & 7 == 2
        size, at = _varint(data, at)
        body = bytearray(data[at: at + size])
        if tag >> 3 == 2:
            i = 0
            while i < len(body):
                t, i = _varint(body, i)
                if t & 7 == 0:
                    if t >> 3 == 3:
                        body[i] = 1
                    _, i = _varint(body, i)
                elif t & 7 == 2:
                    n, i = _varint(body, i)
                    i += n
                else:
                    i += 4 if t & 7 == 5 else 8
        out += data[begin:at] + body
        at += size
    return bytes(out)
