"""Transports that answer from the address alone, for dry runs and tests where there is no network.

An address whose length is a multiple of seven is refused by its server; a feed whose address has an even length and is asked with
the tag it had isn't modified.
"""

from __future__ import annotations


def feed(url: str, headers: dict) -> tuple[int, dict, str]:
    """For ``storyweft_feed``: status, headers and body."""
    n = len(url)
    if n % 7 == 0:
        return 503, {}, ""
    if n % 2 == 0 and headers.get("If-None-Match") == f'"{n}"':
        return 304, {"etag": f'"{n}"'}, ""
    return 200, {"etag": f'"{n}"', "last-modified": "Thu, 01 Oct 2026 00:00:00 GMT"}, f"<rss><channel><item><title>{n} letters</title><link>{url}</link></item></channel></rss>"


def page(url: str, limit: int) -> tuple[int, str, str, bytes]:
    """For ``storyweft_page``: status, final address, type and body."""
    n = len(url)
    kind = "image/png" if n % 3 == 0 else "image/svg+xml" if n % 3 == 1 else "text/html; charset=utf-8"
    return (503 if n % 7 == 0 else 200), url + "?", kind, (b"x" * n)[: limit + 1]
