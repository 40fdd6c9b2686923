"""Ids, signatures, sketches and encoded values."""

from __future__ import annotations

import hashlib
import hmac
import json
import uuid

SPACE = uuid.uuid5(uuid.NAMESPACE_URL, "memlake:writes")
BITS = 512
TYPED = "\x1fjson:"  # before values that are not text


def write_id(agent: str, key: str, index: int, text: str) -> str:
    """The same write always has the same id."""
    return str(uuid.uuid5(SPACE, "\x1f".join((agent, key, str(index), hashlib.sha256(text.encode()).hexdigest()))))


def signature(secret: str, *parts: str) -> str:
    return hmac.new(secret.encode(), "\x1f".join(parts).encode(), hashlib.sha256).hexdigest()


def record_hash(record: dict) -> str:
    """Digest of a record's sorted compact JSON."""
    return hashlib.sha256(json.dumps(record, sort_keys=True, separators=(",", ":"), default=str).encode()).hexdigest()


def sketch(words: list[str], key: str = "") -> bytes:
    """Keyed Bloom bits of words, two a word: what holds a word has its bits, seldom what does not."""
    bits = 0
    for w in words:
        h = hashlib.blake2b(w.encode(), key=key.encode()[:64], digest_size=8).digest()
        bits |= 1 << int.from_bytes(h[:4], "little") % BITS | 1 << int.from_bytes(h[4:], "little") % BITS
    return bits.to_bytes(BITS // 8, "little")


def may_hold(have: bytes, asked: bytes) -> bool:
    a = int.from_bytes(asked, "little")
    return int.from_bytes(have, "little") & a == a


def encode_value(value) -> str:
    """Text as it is, all else as typed JSON, so 4444 and "4444" stay apart."""
    return value if isinstance(value, str) and not value.startswith(TYPED) else TYPED + json.dumps(value, sort_keys=True, ensure_ascii=False)


def decode_value(text: str):
    return json.loads(text[len(TYPED) :]) if text.startswith(TYPED) else text


def value_text(text: str) -> str:
    """An encoded value as a reader sees it."""
    v = decode_value(text)
    return v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)
