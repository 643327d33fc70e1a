"""Key derivation, signatures, error-correcting extraction and ciphers; used row by row inside vectorised functions."""

from __future__ import annotations

import ctypes
import ctypes.util
import hashlib
import hmac
import struct
from functools import lru_cache

import numpy as np

from hamloom.functions.text import field_prefix


def fields_hash(domain: str, *fields: bytes) -> bytes:
    """SHA-256 over the domain and fields, each after its length as four big-endian bytes."""
    h = hashlib.sha256(field_prefix(domain))
    for f in fields:
        h.update(struct.pack(">I", len(f)) + f)
    return h.digest()


def hkdf_extract(salt: bytes, key: bytes) -> bytes:
    """RFC 5869, SHA-256."""
    return hmac.digest(salt, key, "sha256")


def hkdf_expand(key: bytes, info: bytes, size: int) -> bytes:
    """RFC 5869, SHA-256; at most 255 blocks of 32 bytes."""
    if size > 255 * 32:
        raise ValueError("too many bytes asked for")
    out, block, i = b"", b"", 1
    while len(out) < size:
        block = hmac.digest(key, block + info + bytes([i]), "sha256")
        out, i = out + block, i + 1
    return out[:size]


def pad_stream(key: bytes, size: int) -> bytes:
    """Blocks SHA-256(key, counter as four big-endian bytes), cut to size."""
    return b"".join(hashlib.sha256(key + struct.pack(">I", i)).digest() for i in range(-(-size // 32)))[:size]


def xor_bytes(a: bytes, b: bytes) -> bytes:
    """Bitwise xor of byte strings of one length."""
    return (int.from_bytes(a, "big") ^ int.from_bytes(b, "big")).to_bytes(len(a), "big") if a else b""


def convergent(key: bytes, data: bytes) -> bytes:
    """Encrypt or decrypt with the key's pad stream."""
    return xor_bytes(data, pad_stream(key, len(data)))


# --- Ed25519 (RFC 8032) over Python integers; keys and signatures by OpenSSL's library where there is one

P25519 = 2**255 - 19
ORDER = 2**252 + 27742317777372353535851937790883648493
_D = -121665 * pow(121666, P25519 - 2, P25519) % P25519


def _x_of(y: int, odd: int) -> int | None:
    xx = (y * y - 1) * pow(_D * y * y + 1, P25519 - 2, P25519) % P25519
    x = pow(xx, (P25519 + 3) // 8, P25519)
    if (x * x - xx) % P25519:
        x = x * pow(2, (P25519 - 1) // 4, P25519) % P25519
    if (x * x - xx) % P25519 or (x == 0 and odd):
        return None
    return P25519 - x if x & 1 != odd else x


def _add(p: tuple, q: tuple) -> tuple:
    a, b = (p[1] - p[0]) * (q[1] - q[0]) % P25519, (p[1] + p[0]) * (q[1] + q[0]) % P25519
    c, d = 2 * p[3] * q[3] * _D % P25519, 2 * p[2] * q[2] % P25519
    e, f, g, h = b - a, d - c, d + c, b + a
    return e * f % P25519, g * h % P25519, f * g % P25519, e * h % P25519


def _times(n: int, p: tuple) -> tuple:
    out = (0, 1, 1, 0)
    while n:
        if n & 1:
            out = _add(out, p)
        p, n = _add(p, p), n >> 1
    return out


@lru_cache(1)
def _base() -> tuple:
    y = 4 * pow(5, P25519 - 2, P25519) % P25519
    x = _x_of(y, 0)
    return x, y, 1, x * y % P25519


@lru_cache(1)
def _base_multiples() -> list[list[tuple]]:
    """By byte i, 0 to 255 times 256^i times the base."""
    out, p = [], _base()
    for _ in range(32):
        row = [(0, 1, 1, 0)]
        for _ in range(255):
            row.append(_add(row[-1], p))
        out.append(row)
        p = _add(row[-1], p)
    return out


def _times_base(n: int) -> tuple:
    """_times of a number below 2^256 and the base, by an addition per byte."""
    out = (0, 1, 1, 0)
    for row, digit in zip(_base_multiples(), n.to_bytes(32, "little"), strict=True):
        if digit:
            out = _add(out, row[digit])
    return out


def _pack(p: tuple) -> bytes:
    z = pow(p[2], -1, P25519)
    x, y = p[0] * z % P25519, p[1] * z % P25519
    return (y | (x & 1) << 255).to_bytes(32, "little")


def _unpack(b: bytes) -> tuple | None:
    n = int.from_bytes(b, "little")
    y, odd = n & ((1 << 255) - 1), n >> 255
    if y >= P25519 or (x := _x_of(y, odd)) is None:
        return None
    return x, y, 1, x * y % P25519


def _secret(seed: bytes) -> tuple[int, bytes]:
    h = hashlib.sha512(seed).digest()
    return int.from_bytes(h[:32], "little") & ((1 << 254) - 8) | 1 << 254, h[32:]


def _challenge(*parts: bytes) -> int:
    return int.from_bytes(hashlib.sha512(b"".join(parts)).digest(), "little") % ORDER


#: OpenSSL's number of the algorithm.
_ED25519 = 1087


@lru_cache(1)
def _openssl() -> ctypes.CDLL | None:
    """libcrypto with one-shot signatures, or None; it gives the same keys and signatures, some 50 times faster."""
    pointer, size = ctypes.c_void_p, ctypes.c_size_t
    calls = {"EVP_PKEY_new_raw_private_key": (pointer, ctypes.c_int, pointer, ctypes.c_char_p, size), "EVP_PKEY_new_raw_public_key": (pointer, ctypes.c_int, pointer, ctypes.c_char_p, size), "EVP_PKEY_get_raw_public_key": (ctypes.c_int, pointer, pointer, pointer), "EVP_PKEY_free": (None, pointer), "EVP_MD_CTX_new": (pointer,), "EVP_MD_CTX_free": (None, pointer), "EVP_DigestSignInit": (ctypes.c_int, pointer, pointer, pointer, pointer, pointer), "EVP_DigestSign": (ctypes.c_int, pointer, pointer, pointer, ctypes.c_char_p, size), "EVP_DigestVerifyInit": (ctypes.c_int, pointer, pointer, pointer, pointer, pointer), "EVP_DigestVerify": (ctypes.c_int, pointer, ctypes.c_char_p, size, ctypes.c_char_p, size)}
    try:
        try:
            lib = ctypes.CDLL("libcrypto.so.3")
        except OSError:
            lib = ctypes.CDLL(ctypes.util.find_library("crypto") or "")
        for name, (result, *arguments) in calls.items():
            f = getattr(lib, name)
            f.restype, f.argtypes = result, arguments
    except (OSError, AttributeError):
        return None
    seed = bytes.fromhex("9d61b19deffd5a60ba844af492ec2cc44449c5697b326919703bac031cae7f60")
    fits = _native_key(lib, seed) == _public_key(seed) and _native_sign(lib, seed, b"m") == _sign(seed, b"m")
    return lib if fits else None


def _native_key(lib: ctypes.CDLL, seed: bytes) -> bytes | None:
    key = lib.EVP_PKEY_new_raw_private_key(_ED25519, None, seed, len(seed))
    out, n = ctypes.create_string_buffer(32), ctypes.c_size_t(32)
    ok = bool(key) and lib.EVP_PKEY_get_raw_public_key(key, out, ctypes.byref(n)) == 1
    lib.EVP_PKEY_free(key)
    return out.raw if ok else None


def _native_sign(lib: ctypes.CDLL, seed: bytes, message: bytes) -> bytes | None:
    key, context = lib.EVP_PKEY_new_raw_private_key(_ED25519, None, seed, len(seed)), lib.EVP_MD_CTX_new()
    out, n = ctypes.create_string_buffer(64), ctypes.c_size_t(64)
    ok = bool(key) and lib.EVP_DigestSignInit(context, None, None, None, key) == 1 and lib.EVP_DigestSign(context, out, ctypes.byref(n), message, len(message)) == 1
    lib.EVP_MD_CTX_free(context)
    lib.EVP_PKEY_free(key)
    return out.raw if ok else None


def _native_verify(lib: ctypes.CDLL, key: bytes, message: bytes, signature: bytes) -> bool:
    own, context = lib.EVP_PKEY_new_raw_public_key(_ED25519, None, key, len(key)), lib.EVP_MD_CTX_new()
    ok = bool(own) and lib.EVP_DigestVerifyInit(context, None, None, None, own) == 1 and lib.EVP_DigestVerify(context, signature, len(signature), message, len(message)) == 1
    lib.EVP_MD_CTX_free(context)
    lib.EVP_PKEY_free(own)
    return ok


def public_key(seed: bytes) -> bytes:
    """The verification key of a 32-byte seed."""
    lib = _openssl() if len(seed) == 32 else None
    return lib and _native_key(lib, seed) or _public_key(seed)


def sign(seed: bytes, message: bytes) -> bytes:
    """The 64-byte signature of a message."""
    lib = _openssl() if len(seed) == 32 else None
    return lib and _native_sign(lib, seed, message) or _sign(seed, message)


def verify(key: bytes, message: bytes, signature: bytes) -> bool:
    """Whether the signature is the key's for the message; false for anything malformed."""
    # keys at the edges are decoded here, as OpenSSL also takes other spellings of them
    plain = len(key) == 32 and len(signature) == 64 and 1 < int.from_bytes(key, "little") & ((1 << 255) - 1) < P25519 - 1
    lib = _openssl() if plain else None
    return _native_verify(lib, key, message, signature) if lib else _verify(key, message, signature)


def _public_key(seed: bytes) -> bytes:
    return _pack(_times_base(_secret(seed)[0]))


def _sign(seed: bytes, message: bytes) -> bytes:
    a, prefix = _secret(seed)
    key = _pack(_times_base(a))
    r = _challenge(prefix, message)
    big_r = _pack(_times_base(r))
    return big_r + ((r + _challenge(big_r, key, message) * a) % ORDER).to_bytes(32, "little")


def _verify(key: bytes, message: bytes, signature: bytes) -> bool:
    if len(key) != 32 or len(signature) != 64 or (a := _unpack(key)) is None or (r := _unpack(signature[:32])) is None:
        return False
    s = int.from_bytes(signature[32:], "little")
    if s >= ORDER:
        return False
    left, right = _times_base(s), _add(r, _times(_challenge(signature[:32], key, message), a))
    return not ((left[0] * right[2] - right[0] * left[2]) % P25519 or (left[1] * right[2] - right[1] * left[2]) % P25519)


# --- 1-of-2 oblivious transfer on the same curve (Chou and Orlandi, 2015)


def _scalar(secret: bytes) -> int:
    return int.from_bytes(hashlib.sha512(secret).digest(), "little") % ORDER or 1


def _minus(p: tuple) -> tuple:
    return P25519 - p[0], p[1], p[2], P25519 - p[3]


def transfer_offer(secret: bytes) -> tuple[int, bytes]:
    """The sender's number and the point that it sends."""
    a = _scalar(secret)
    return a, _pack(_times_base(a))


def transfer_choose(secret: bytes, offer: bytes, choice: int) -> tuple[bytes, bytes]:
    """(reply, key) of a receiver who chooses message 0 or 1."""
    point = _unpack(offer)
    if point is None or choice not in (0, 1):
        raise ValueError("bad offer or choice")
    b = _scalar(secret)
    reply = _times_base(b)
    if choice:
        reply = _add(reply, point)
    return _pack(reply), hashlib.sha256(_pack(_times(b, point))).digest()


def transfer_keys(sender: tuple[int, bytes], reply: bytes) -> tuple[bytes, bytes]:
    """The keys of both messages; the receiver has one of them, the sender doesn't know which."""
    a, offer = sender
    point, own = _unpack(reply), _unpack(offer)
    if point is None or own is None:
        raise ValueError("bad reply")
    return tuple(hashlib.sha256(_pack(_times(a, p))).digest() for p in (point, _add(point, _minus(own))))


# --- BCH(255, 207) correcting 6 errors, Toeplitz hashing, and the extractor made of both

CODE, MESSAGE, ERRORS = 255, 207, 6
#: Fixed value: the primitive polynomial of the field with 256 elements.
FIELD = 0x11D


@lru_cache(1)
def _field() -> tuple[np.ndarray, np.ndarray]:
    exp, log = np.zeros(510, np.int64), np.zeros(256, np.int64)
    x = 1
    for i in range(255):
        exp[i] = exp[i + 255] = x
        log[x] = i
        x = x << 1 ^ (FIELD if x & 0x80 else 0)
    return exp, log


def _mul(a: int, b: int) -> int:
    exp, log = _field()
    return int(exp[log[a] + log[b]]) if a and b else 0


@lru_cache(1)
def _generator() -> np.ndarray:
    """The product of x - alpha^e over the exponents 1 to 12 and their doublings; its coefficients are bits."""
    exp, _ = _field()
    roots = {e * 2**k % 255 for e in range(1, 2 * ERRORS + 1) for k in range(8)}
    poly = [1]
    for e in sorted(roots):
        shifted = [0, *poly]
        poly = [s ^ (_mul(int(exp[e]), poly[i]) if i < len(poly) else 0) for i, s in enumerate(shifted)]
    return np.array(poly, np.uint8)


@lru_cache(1)
def _powers() -> np.ndarray:
    """alpha^(s j) for s = 1 to 12 and all positions j."""
    exp, _ = _field()
    return exp[np.outer(np.arange(1, 2 * ERRORS + 1), np.arange(CODE)) % 255]


def bits_of(data: bytes) -> np.ndarray:
    """Bits, least significant of each byte first."""
    return np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little")


def bytes_of(bits: np.ndarray) -> bytes:
    """The inverse of bits_of."""
    return np.packbits(bits.astype(np.uint8), bitorder="little").tobytes()


def _syndromes(word: np.ndarray) -> np.ndarray:
    at = _powers()[:, word.astype(bool)]
    return np.bitwise_xor.reduce(at, axis=1) if at.shape[1] else np.zeros(2 * ERRORS, np.int64)


def encode_word(message: np.ndarray) -> np.ndarray:
    """The code word of 207 message bits: their product with the generator."""
    return np.convolve(message.astype(np.int64), _generator().astype(np.int64))[:CODE].astype(np.uint8) & 1


def decode_word(word: np.ndarray) -> np.ndarray | None:
    """The code word within 6 errors of 255 bits, or None."""
    exp, log = _field()
    syn = [int(x) for x in _syndromes(word)]
    if not any(syn):
        return word.copy()
    # the shortest recurrence of the syndromes is the polynomial whose roots are the inverse error places
    now, old, length, gap, last = [1], [1], 0, 1, 1
    for n in range(2 * ERRORS):
        off = syn[n]
        for i in range(1, min(length, len(now) - 1) + 1):
            off ^= _mul(now[i], syn[n - i])
        if not off:
            gap += 1
            continue
        factor = int(exp[(log[off] - log[last]) % 255])
        step = [0] * gap + [_mul(factor, c) for c in old]
        size = max(len(now), len(step))
        new = [(now[i] if i < len(now) else 0) ^ (step[i] if i < len(step) else 0) for i in range(size)]
        if 2 * length <= n:
            old, last, length, gap = now, off, n + 1 - length, 1
        else:
            gap += 1
        now = new
    if not 0 < length <= ERRORS:
        return None
    places = np.arange(CODE)
    value = np.zeros(CODE, np.int64)
    for i, c in enumerate(now[: length + 1]):
        if c:
            value ^= exp[(log[c] - i * places) % 255]
    wrong = value == 0
    if wrong.sum() != length:
        return None
    fixed = word ^ wrong.astype(np.uint8)
    return None if _syndromes(fixed).any() else fixed


def toeplitz(x: bytes, seed: bytes) -> bytes:
    """256 bits: bit r is the parity of x and the seed's bits from 255 - r on."""
    # exact: sums of at most 256 products of bits
    sums = np.correlate(bits_of(seed).astype(np.float64), bits_of(x).astype(np.float64), "valid")
    return bytes_of(sums[:256][::-1].astype(np.int64) & 1)


def extract_new(x: bytes, secret: bytes) -> tuple[bytes, bytes]:
    """(key, helper) of 256 bits x; secret has 26 + 64 random bytes. The helper reveals x only up to the code's words."""
    message = bits_of(secret[:26])[:MESSAGE]
    xb = bits_of(x)
    sketch = np.append(xb[:CODE] ^ encode_word(message), xb[CODE])
    return toeplitz(x, secret[26:90]), bytes_of(sketch) + secret[26:90]


def extract_again(x: bytes, helper: bytes) -> bytes | None:
    """The key of extract_new from bits that differ from its x in at most 6 of the first 255; else another key or None."""
    if len(x) != 32 or len(helper) != 96:
        return None
    sketch = bits_of(helper[:32])
    word = decode_word(bits_of(x)[:CODE] ^ sketch[:CODE])
    if word is None:
        return None
    return toeplitz(bytes_of(np.append(sketch[:CODE] ^ word, sketch[CODE])), helper[32:])
