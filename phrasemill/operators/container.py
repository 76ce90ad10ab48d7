"""Containers: any parsing as bytes with a magic number and its parameters, and back.

A container is the algorithm's name (8 bytes, zero-padded), a length and the options as JSON, the number of
phrases, and the phrases in blocks of BLOCK. A phrase is at most five numbers; each of them is a token type of
its own, coded in a block by the fixed width of its range or by Huffman codes, whichever is shorter (literals are
bytes; lengths, distances and references any numbers; -1, for a field that is not used, counts as a number).
"""

from __future__ import annotations

import json
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from phrasemill.operators import codec
from phrasemill.operators.parsers import KINDS, PARSERS, Phrase
from phrasemill.operators.phrases import map_column

MAGIC, BLOCK = 8, 4096
KIND_NUMBERS = {kind: i for i, kind in enumerate(KINDS)}
RAW = "raw"  # bytes as they are


def _block(phrases: list[Phrase]) -> bytes:
    """The five fields of up to BLOCK phrases, each with the coder that makes it shorter."""
    out = bytearray()
    kinds, *fields = zip(*phrases, strict=True)
    for values in (np.array([KIND_NUMBERS[k] for k in kinds], np.int64), *(np.array(f, np.int64) + 1 for f in fields)):
        coder, coded = codec.encode_values(values)
        out += bytes([coder == "huffman"]) + codec.write_uint(len(coded), 4) + coded
    return bytes(out)


def _open_block(data: memoryview) -> tuple[list[Phrase], int]:
    """The phrases, and how many bytes they took."""
    fields, at = [], 0
    for _ in range(5):
        size = codec.read_uint(bytes(data[at + 1 : at + 5]), 4)
        coded = codec.decode_block(bytes(data[at + 5 : at + 5 + size]), {0: "huffman" if data[at] else "binary"}, lambda _: 0)
        fields.append([v for _, v in coded])
        at += 5 + size
    return [(KINDS[k], *(v - 1 for v in rest)) for k, *rest in zip(*fields, strict=True)], at


def pack(data: bytes, algo: str, **options: Any) -> bytes:
    """data parsed and coded."""
    head = json.dumps(options, sort_keys=True, separators=(",", ":")).encode()
    out = bytearray(algo.encode()[:MAGIC].ljust(MAGIC, b"\0") + codec.write_uint(len(head) + len(algo) + 1, 2) + algo.encode() + b"\0" + head)
    if algo == RAW:
        return bytes(out) + data
    phrases = PARSERS[algo].encode(data, **options)
    out += codec.write_uint(len(phrases), 5)
    for at in range(0, len(phrases), BLOCK):
        out += _block(phrases[at : at + BLOCK])
    return bytes(out)


def unpack(payload: bytes) -> bytes:
    """The bytes that pack was given; the algorithm and its options are read from the container."""
    size = codec.read_uint(payload[MAGIC : MAGIC + 2], 2)
    at = MAGIC + 2 + size
    algo, _, head = payload[MAGIC + 2 : at].partition(b"\0")
    if payload[:MAGIC] != algo[:MAGIC].ljust(MAGIC, b"\0") or algo not in {RAW.encode(), *(a.encode() for a in PARSERS)}:
        raise ValueError("not a container")
    if algo.decode() == RAW:
        return payload[at:]
    count, at, view, phrases = codec.read_uint(payload[at : at + 5], 5), at + 5, memoryview(payload), []
    while len(phrases) < count:
        found, took = _open_block(view[at:])
        phrases += found
        at += took
    return PARSERS[algo.decode()].decode(phrases, **json.loads(head))


def compress(rows: DataFrame, algo: str, column: str = "b", **options: Any) -> DataFrame:
    """rows with the binary column replaced by ``payload``. A null is packed as empty."""
    return map_column(rows, column, "payload", "binary", lambda c: pa.array([pack(x or b"", algo, **options) for x in c.to_pylist()], pa.binary()))


def decompress(rows: DataFrame) -> DataFrame:
    """The inverse of compress: ``payload`` replaced by the binary column ``b``, whatever the containers' algorithms."""
    return map_column(rows, "payload", "b", "binary", lambda c: pa.array([unpack(x) for x in c.to_pylist()], pa.binary()))
