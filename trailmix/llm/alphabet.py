"""The characters that byte-level vocabularies write bytes as."""

from __future__ import annotations


def byte_alphabet() -> dict[str, int]:
    """Byte-level vocabularies write each byte as one visible character; the others follow from 256 on."""
    visible = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + n): b for n, b in enumerate(hidden)}
