"""Fetching over HTTP for ingest: answers are kept by the digest of their address and reused
while fresh, hosts are not asked more often than agreed, failures are tried again with
growing pauses, and every request is written to a ledger. What has landed is read by Spark
(`files.landed`); fetching itself runs where it is called and is no part of a query."""

from __future__ import annotations

import gzip
import hashlib
import json
import os
import time
import urllib.error
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass, field
from urllib.parse import urlsplit


def plain_open(url: str, headers: dict[str, str], timeout: float) -> tuple[int, dict[str, str], bytes]:
    """status, headers, body of one request."""
    try:
        with urllib.request.urlopen(urllib.request.Request(url, headers=headers), timeout=timeout) as r:
            return r.status, dict(r.headers), r.read()
    except urllib.error.HTTPError as x:
        return x.code, dict(x.headers), x.read()


@dataclass
class Fetcher:
    folder: str
    fresh: float = 86_400.0  # seconds that an answer is reused for
    gap: float = 1.0  # seconds between requests to a host
    tries: int = 4
    pause: float = 1.0  # before the second try; doubles
    longest: float = 120.0  # pause that a host may ask for
    timeout: float = 30.0
    headers: dict[str, str] = field(default_factory=lambda: {"User-Agent": "tidemark"})
    open: Callable = plain_open
    clock: Callable[[], float] = time.time
    sleep: Callable[[float], None] = time.sleep
    last: dict[str, float] = field(default_factory=dict)

    def place(self, url: str) -> str:
        return os.path.join(self.folder, hashlib.sha256(url.encode()).hexdigest() + ".gz")

    def note(self, url: str, outcome: str, tries: int, size: int) -> None:
        row = {"at": round(self.clock(), 3), "host": urlsplit(url).netloc, "url": url, "outcome": outcome, "tries": tries, "bytes": size}
        with open(os.path.join(self.folder, "ledger.jsonl"), "a", encoding="utf-8") as f:
            f.write(json.dumps(row) + "\n")

    def kept(self, url: str) -> bytes | None:
        """The kept answer, if it is fresh."""
        p = self.place(url)
        if os.path.exists(p) and self.clock() - os.path.getmtime(p) < self.fresh:
            with gzip.open(p) as f:
                return f.read()
        return None

    def wait(self, host: str) -> None:
        due = self.last.get(host, -self.gap) + self.gap - self.clock()
        if due > 0:
            self.sleep(due)
        self.last[host] = self.clock()

    def get(self, url: str) -> bytes | None:
        """The body, kept or fetched; None where the host has none or keeps failing."""
        os.makedirs(self.folder, exist_ok=True)
        if (body := self.kept(url)) is not None:
            self.note(url, "kept", 0, len(body))
            return body
        said = "failed"
        for k in range(self.tries):
            self.wait(urlsplit(url).netloc)
            pause = self.pause * 2**k
            try:
                status, headers, body = self.open(url, self.headers, self.timeout)
            except OSError as x:
                said = type(x).__name__
            else:
                said = str(status)
                if status == 200:
                    whole = self.place(url) + ".part"
                    with gzip.open(whole, "wb") as f:
                        f.write(body)
                    os.replace(whole, self.place(url))
                    self.note(url, said, k + 1, len(body))
                    return body
                if status == 429 or status >= 500:
                    asked = {h.lower(): v for h, v in headers.items()}.get("retry-after", "")
                    pause = min(float(asked), self.longest) if asked.isdigit() else pause
                else:
                    self.note(url, said, k + 1, 0)
                    return None
            if k + 1 < self.tries:
                self.sleep(pause)
        self.note(url, said, self.tries, 0)
        return None

    def get_json(self, url: str):
        body = self.get(url)
        return None if body is None else json.loads(body)
