"""Addresses: Base58Check and Bech32 texts, their kinds and output scripts."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from coinstrata.functions.config import network_params
from coinstrata.functions.text import BadArgument

# Fixed values of the two encodings.
BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
BECH32 = "qpzry9x8gf2tvdw0s3jn54khce6mua7l"
GENERATORS = (0x3B6A57B2, 0x26508E6D, 0x1EA119FA, 0x3D4233DD, 0x2A1462B3)
BECH32_CONST, BECH32M_CONST = 1, 0x2BC830A3


def base58check_decode(text: str) -> bytes:
    n = 0
    for c in text:
        at = BASE58.find(c)
        if at < 0:
            raise BadArgument("not base58")
        n = n * 58 + at
    raw = b"\0" * (len(text) - len(text.lstrip("1"))) + n.to_bytes((n.bit_length() + 7) // 8, "big")
    body, check = raw[:-4], raw[-4:]
    if len(raw) < 5 or hashlib.sha256(hashlib.sha256(body).digest()).digest()[:4] != check:
        raise BadArgument("wrong checksum")
    return body


def base58check_encode(body: bytes) -> str:
    raw = body + hashlib.sha256(hashlib.sha256(body).digest()).digest()[:4]
    n, out = int.from_bytes(raw, "big"), ""
    while n:
        n, r = divmod(n, 58)
        out = BASE58[r] + out
    return "1" * (len(raw) - len(raw.lstrip(b"\0"))) + out


def _polymod(values: list[int]) -> int:
    chk = 1
    for v in values:
        top, chk = chk >> 25, (chk & 0x1FFFFFF) << 5 ^ v
        for i, g in enumerate(GENERATORS):
            chk ^= g if top >> i & 1 else 0
    return chk


def _spread(hrp: str) -> list[int]:
    return [ord(c) >> 5 for c in hrp] + [0] + [ord(c) & 31 for c in hrp]


def _regroup(values, size: int, to: int, pad: bool) -> bytes:
    acc = bits = 0
    out = []
    for v in values:
        acc, bits = acc << size | v, bits + size
        while bits >= to:
            bits -= to
            out.append(acc >> bits & (1 << to) - 1)
    if pad and bits:
        out.append(acc << to - bits & (1 << to) - 1)
    elif not pad and (bits >= size or acc & (1 << bits) - 1):
        raise BadArgument("wrong padding")
    return bytes(out)


def segwit_decode(text: str, hrp: str) -> tuple[int, bytes]:
    """(version, program) of a witness address."""
    if text.lower() != text and text.upper() != text:
        raise BadArgument("mixed case")
    text = text.lower()
    at = text.rfind("1")
    if text[:at] != hrp or len(text) - at < 8 or any(c not in BECH32 for c in text[at + 1 :]):
        raise BadArgument("not a witness address")
    data = [BECH32.index(c) for c in text[at + 1 :]]
    version = data[0]
    if version > 16 or _polymod(_spread(hrp) + data) != (BECH32M_CONST if version else BECH32_CONST):
        raise BadArgument("wrong checksum")
    program = _regroup(data[1:-6], 5, 8, False)
    if not 2 <= len(program) <= 40 or version == 0 and len(program) not in (20, 32):
        raise BadArgument("a program of a wrong length")
    return version, program


def segwit_encode(hrp: str, version: int, program: bytes) -> str:
    data = [version, *_regroup(program, 8, 5, True)]
    mod = _polymod(_spread(hrp) + data + [0] * 6) ^ (BECH32M_CONST if version else BECH32_CONST)
    return hrp + "1" + "".join(BECH32[d] for d in data + [mod >> 5 * (5 - i) & 31 for i in range(6)])


def output_script(address: str, network: str) -> bytes:
    """The script that pays to an address of the network."""
    params = network_params(network)
    if params["bech32"] and address.lower().startswith(params["bech32"] + "1"):
        version, program = segwit_decode(address, params["bech32"])
        return bytes([0x50 + version if version else 0, len(program)]) + program
    body = base58check_decode(address)
    if len(body) == 21 and body[0] == params["pubkey_hash"]:
        return b"\x76\xa9\x14" + body[1:] + b"\x88\xac"
    if len(body) == 21 and body[0] == params["script_hash"]:
        return b"\xa9\x14" + body[1:] + b"\x87"
    raise BadArgument("an address of another network")


def address_type(address: str, network: str) -> str:
    """p2pkh, p2sh, p2wpkh, p2wsh, p2tr or unknown."""
    try:
        s = output_script(address, network)
    except (BadArgument, KeyError):
        return "unknown"
    if s[:1] == b"\x76":
        return "p2pkh"
    if s[:1] == b"\xa9":
        return "p2sh"
    return {(0, 20): "p2wpkh", (0, 32): "p2wsh", (0x51, 32): "p2tr"}.get((s[0], s[1]), "unknown")


def script_column(address: Column, network: str) -> Column:
    """output_script() of a column, null for texts that are no addresses."""

    @F.pandas_udf("binary")
    def run(texts: pd.Series) -> pd.Series:
        def one(x):
            try:
                return output_script(x, network) if x else None
            except BadArgument:
                return None

        return texts.map(one)

    return run(address)


def type_column(address: Column, network: str) -> Column:
    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: address_type(x, network) if x else "unknown")

    return run(address)
