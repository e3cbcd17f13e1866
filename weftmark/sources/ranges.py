"""Byte ranges of files and URLs: merged where holes are small, fetched ahead by a few threads, metered.

A task asks for many short runs of rows.  Sorted within their file, runs that lie close
together become one request as long as the bytes read for nothing stay within a budget; a
few threads fetch the requests while earlier ones are decoded, so that round trips overlap.
A request that breaks off is continued from the byte it reached.
"""

from __future__ import annotations

import http.client
import threading
import time
import urllib.error
import urllib.request
from collections import deque
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from weftmark import schema

#: Seconds between attempts of a request, and the longest wait a server may ask for.
BACKOFF, MAX_RETRY_AFTER = (0.5, 1.0, 2.0), 30.0
#: Answers that are worth another attempt.
_AGAIN = (408, 429, 500, 502, 503, 504)
#: Requests in the air for a task, bytes of one merged request, and bytes that holes may cost a file in any case.
THREADS, MAX_REQUEST, FREE_SLACK = 8, 16 << 20, 1 << 20
#: Share of the wanted bytes that holes may cost beyond that.
SLACK_SHARE = 0.25


def is_url(ref: str) -> bool:
    return ref.startswith(("http://", "https://"))


@dataclass
class Got:
    """Bytes of a request with what they cost."""

    raw: bytes
    requests: int
    seconds: float


@dataclass
class Span:
    """A request: the bytes begin..end of a file, and the places (in the caller's list) of the ranges inside."""

    file: str
    begin: int
    end: int
    inside: list[int] = field(default_factory=list)


def merged(ranges: list[tuple[str, int, int]], gap: int = schema.COALESCE_GAP, share: float = SLACK_SHARE, free: int = FREE_SLACK) -> list[Span]:
    """Requests that cover all ranges (file, begin, end), by file and begin.

    A range joins the request before it if the hole is at most ``gap`` bytes, the holes of
    the file so far stay within ``free`` bytes plus ``share`` of its wanted bytes, and the
    request within MAX_REQUEST.  A single range is never cut.  Empty ranges need no request.
    """
    wanted: dict[str, int] = {}
    for file, begin, end in ranges:
        wanted[file] = wanted.get(file, 0) + max(0, end - begin)
    out: list[Span] = []
    slack = 0.0
    for i in sorted(range(len(ranges)), key=lambda i: ranges[i]):
        file, begin, end = ranges[i]
        if end <= begin:
            continue
        last = out[-1] if out and out[-1].file == file else None
        if last is None:
            slack = 0.0
        hole = max(0, begin - last.end) if last else 0
        fits = last is not None and hole <= gap and slack + hole <= free + share * wanted[file] and max(end, last.end) - last.begin <= MAX_REQUEST
        if fits:
            slack += hole
            last.end = max(last.end, end)
            last.inside.append(i)
        else:
            out.append(Span(file, begin, end, [i]))
    return out


def _pause(error: Exception, pause: float) -> None:
    wait = error.headers.get("Retry-After", "") if isinstance(error, urllib.error.HTTPError) and error.headers else ""
    time.sleep(min(float(wait), MAX_RETRY_AFTER) if wait.replace(".", "", 1).isdigit() else pause)


def fetch(url: str, headers: dict[str, str] | None = None) -> tuple[int, bytes]:
    """Status and body of a GET; refused answers, broken connections and timeouts are tried again."""
    request = urllib.request.Request(url, headers=headers or {})
    for attempt, pause in enumerate(BACKOFF):
        try:
            with urllib.request.urlopen(request, timeout=60) as answer:
                return answer.status, answer.read()
        except (urllib.error.URLError, ConnectionError, TimeoutError, http.client.HTTPException) as e:
            if attempt == len(BACKOFF) - 1 or isinstance(e, urllib.error.HTTPError) and e.code not in _AGAIN:
                raise
            _pause(e, pause)
    raise OSError(url)


def _http_range(url: str, begin: int, end: int) -> Got:
    """Bytes begin..end of a URL; an answer that breaks off is continued, one without a range is an error."""
    raw, requests, failures, started = bytearray(), 0, 0, time.monotonic()
    while begin + len(raw) < end:
        before = len(raw)
        requests += 1
        try:
            request = urllib.request.Request(url, headers={"Range": f"bytes={begin + before}-{end - 1}"})
            with urllib.request.urlopen(request, timeout=60) as answer:
                if answer.status != 206:
                    raise OSError(f"{url}: the server ignored the range")
                try:
                    raw += answer.read()
                except http.client.IncompleteRead as e:
                    raw += e.partial
            error: Exception | None = None
        except (urllib.error.URLError, ConnectionError, TimeoutError, http.client.HTTPException) as e:
            if isinstance(e, urllib.error.HTTPError) and e.code not in _AGAIN:
                raise
            error = e
        if len(raw) == before or error is not None:
            failures += 1
            if failures == len(BACKOFF):
                raise error or OSError(f"{url}: {before} of {end - begin} bytes")
            _pause(error, BACKOFF[failures - 1]) if error else time.sleep(BACKOFF[failures - 1])
    if len(raw) != end - begin:
        raise OSError(f"{url}: {len(raw)} of {end - begin} bytes")
    return Got(bytes(raw), requests, time.monotonic() - started)


def read_span(file: str, begin: int, end: int) -> Got:
    """Bytes begin..end of a local file or a URL; a short read is an error."""
    if is_url(file):
        return _http_range(file, begin, end)
    started = time.monotonic()
    with open(file, "rb") as f:
        f.seek(begin)
        raw = f.read(end - begin)
    if len(raw) != end - begin:
        raise OSError(f"{file}: {len(raw)} of {end - begin} bytes")
    return Got(raw, 1, time.monotonic() - started)


def read_merged(ranges: list[tuple[str, int, int]], threads: int = THREADS, **limits) -> Iterator[tuple[int, memoryview, Got | None]]:
    """(place in the list, bytes, the request if this is its first range) for every range, by file and begin.

    At most twice ``threads`` requests are under way or waiting to be taken.
    """
    spans = deque(merged(ranges, **limits))
    empty = [i for i, (_, begin, end) in enumerate(ranges) if end <= begin]
    yield from ((i, memoryview(b""), None) for i in empty)
    ahead: deque = deque()
    stop = threading.Event()
    with ThreadPoolExecutor(max(1, threads)) as pool:
        try:
            while spans or ahead:
                while spans and len(ahead) < 2 * threads:
                    span = spans.popleft()
                    ahead.append((span, pool.submit(lambda s=span: None if stop.is_set() else read_span(s.file, s.begin, s.end))))
                span, coming = ahead.popleft()
                got = coming.result()
                view = memoryview(got.raw)
                for n, i in enumerate(span.inside):
                    _, begin, end = ranges[i]
                    yield i, view[begin - span.begin : end - span.begin], got if n == 0 else None
        finally:
            stop.set()
