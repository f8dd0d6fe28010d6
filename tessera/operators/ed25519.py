"""Ed25519 signatures (RFC 8032) in plain Python, for tasks without a cryptography library."""

from __future__ import annotations

import hashlib
from functools import lru_cache

P = 2**255 - 19
ORDER = 2**252 + 27742317777372353535851937790883648493
D = -121665 * pow(121666, -1, P) % P
ROOT = pow(2, (P - 1) // 4, P)


def _x_of(y: int, sign: int) -> int | None:
    square = (y * y - 1) * pow(D * y * y + 1, -1, P) % P
    x = pow(square, (P + 3) // 8, P)
    if (x * x - square) % P:
        x = x * ROOT % P
    if (x * x - square) % P or (x == 0 and sign):
        return None
    return P - x if x & 1 != sign else x


_Y = 4 * pow(5, -1, P) % P
BASE = (_x_of(_Y, 0), _Y, 1, _x_of(_Y, 0) * _Y % P)
ZERO = (0, 1, 1, 0)


def _add(p, q):
    a, b = (p[1] - p[0]) * (q[1] - q[0]) % P, (p[1] + p[0]) * (q[1] + q[0]) % P
    c, d = 2 * p[3] * q[3] * D % P, 2 * p[2] * q[2] % P
    e, f, g, h = b - a, d - c, d + c, b + a
    return e * f % P, g * h % P, f * g % P, e * h % P


@lru_cache(maxsize=64)
def _doubles(point) -> list:
    out = [point]
    for _ in range(255):
        out.append(_add(out[-1], out[-1]))
    return out


def _times(n: int, point):
    out, doubles = ZERO, _doubles(point)
    while n:
        low = n & -n
        out = _add(out, doubles[low.bit_length() - 1])
        n ^= low
    return out


def _packed(p) -> bytes:
    inverse = pow(p[2], -1, P)
    x, y = p[0] * inverse % P, p[1] * inverse % P
    return (y | (x & 1) << 255).to_bytes(32, "little")


@lru_cache(maxsize=1024)
def _point(body: bytes):
    y = int.from_bytes(body, "little")
    sign, y = y >> 255, y & (1 << 255) - 1
    x = _x_of(y, sign) if y < P else None
    return None if x is None else (x, y, 1, x * y % P)


def _number(*parts: bytes) -> int:
    return int.from_bytes(hashlib.sha512(b"".join(parts)).digest(), "little")


def _secret(seed: bytes) -> tuple[int, bytes]:
    body = hashlib.sha512(seed).digest()
    return int.from_bytes(body[:32], "little") & (1 << 254) - 8 | 1 << 254, body[32:]


@lru_cache(maxsize=1024)
def public_key(seed: bytes) -> bytes:
    return _packed(_times(_secret(seed)[0], BASE))


def sign(seed: bytes, message: bytes) -> bytes:
    secret, prefix = _secret(seed)
    own = public_key(seed)
    nonce = _number(prefix, message) % ORDER
    point = _packed(_times(nonce, BASE))
    return point + ((nonce + _number(point, own, message) * secret) % ORDER).to_bytes(32, "little")


def verify(public: bytes, message: bytes, signature: bytes) -> bool:
    if len(public) != 32 or len(signature) != 64:
        return False
    own, point, number = _point(public), _point(signature[:32]), int.from_bytes(signature[32:], "little")
    if own is None or point is None or number >= ORDER:
        return False
    left, right = _times(number, BASE), _add(point, _times(_number(signature[:32], public, message) % ORDER, own))
    return (left[0] * right[2] - right[0] * left[2]) % P == 0 and (left[1] * right[2] - right[1] * left[2]) % P == 0
