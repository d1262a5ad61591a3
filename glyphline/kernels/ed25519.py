"""Ed25519 (RFC 8032) in plain integers: signatures of public content are verified, test data is signed.

Not constant-time: private keys of value don't belong here.
"""

from __future__ import annotations

import functools
import hashlib

P = 2**255 - 19
L = 2**252 + 27742317777372353535851937790883648493
D = -121665 * pow(121666, -1, P) % P
ROOT = pow(2, (P - 1) // 4, P)
NEUTRAL = (0, 1, 1, 0)


def _add(a, b):
    x = (a[1] - a[0]) * (b[1] - b[0]) % P
    y = (a[1] + a[0]) * (b[1] + b[0]) % P
    z, t = 2 * a[2] * b[2] % P, 2 * D * a[3] * b[3] % P
    e, f, g, h = y - x, z - t, z + t, y + x
    return e * f % P, g * h % P, f * g % P, e * h % P


def _times(n: int, point):
    out = NEUTRAL
    while n:
        if n & 1:
            out = _add(out, point)
        point, n = _add(point, point), n >> 1
    return out


def _x(y: int, odd: int) -> int | None:
    square = (y * y - 1) * pow(D * y * y + 1, -1, P) % P
    x = pow(square, (P + 3) // 8, P)
    if (x * x - square) % P:
        x = x * ROOT % P
    if y >= P or (x * x - square) % P or (not x and odd):
        return None
    return P - x if x & 1 != odd else x


def _point(data: bytes):
    n = int.from_bytes(data, "little")
    y = n & ((1 << 255) - 1)
    x = _x(y, n >> 255)
    return None if x is None else (x, y, 1, x * y % P)


def _packed(point) -> bytes:
    z = pow(point[2], -1, P)
    x, y = point[0] * z % P, point[1] * z % P
    return (y | (x & 1) << 255).to_bytes(32, "little")


@functools.cache
def _base():
    y = 4 * pow(5, -1, P) % P
    x = _x(y, 0)
    return x, y, 1, x * y % P


def _number(*parts: bytes) -> int:
    return int.from_bytes(hashlib.sha512(b"".join(parts)).digest(), "little") % L


def verify(public: bytes, message: bytes, signature: bytes) -> bool:
    """Whether the signature of a message is the public key's."""
    if len(public) != 32 or len(signature) != 64:
        return False
    a, r, s = _point(public), _point(signature[:32]), int.from_bytes(signature[32:], "little")
    if a is None or r is None or s >= L:
        return False
    left = _times(s, _base())
    right = _add(r, _times(_number(signature[:32], public, message), a))
    return not (left[0] * right[2] - right[0] * left[2]) % P and not (left[1] * right[2] - right[1] * left[2]) % P


def _secret(seed: bytes) -> tuple[int, bytes]:
    h = hashlib.sha512(seed).digest()
    return int.from_bytes(h[:32], "little") & ((1 << 254) - 8) | 1 << 254, h[32:]


def public_key(seed: bytes) -> bytes:
    return _packed(_times(_secret(seed)[0], _base()))


def sign(seed: bytes, message: bytes) -> bytes:
    """The signature of a message, for tests and authoring."""
    a, prefix = _secret(seed)
    r = _number(prefix, message)
    first = _packed(_times(r, _base()))
    return first + ((r + _number(first, public_key(seed), message) * a) % L).to_bytes(32, "little")
