"""Landing of remote sources: what to ask, how often, and what to keep.

No function here opens a connection: each takes a fetcher, (url, params, headers) -> Reply,
so any transport serves and everything can be tested without a network. What is
landed is written as it came, with its manifest entry, and read by the scans of `files`
and `workbook`.
"""

from __future__ import annotations

import json
import os
import re
import time
from collections.abc import Callable, Iterable
from typing import NamedTuple
from urllib.parse import quote

from . import contracts


class Reply(NamedTuple):
    status: int
    headers: dict[str, str]
    body: bytes


Fetch = Callable[[str, dict, dict], Reply]

# --- fixed values -----------------------------------------------------------------------
BATCH = 200
TRIES = 4
BUSY = (429, 503)
ID = r"tt\d{7,}"
# -----------------------------------------------------------------------------------------


class LandingError(RuntimeError):
    """A source could not be landed as it is declared to be."""


def ask(fetch: Fetch, url: str, params: dict | None = None, headers: dict | None = None, *, allowed: tuple[int, ...] = (200,), sleep: Callable[[float], None] = time.sleep) -> Reply:
    """One reply with an allowed status. A busy server is asked again as it says, TRIES times in all."""
    for nth in range(TRIES):
        reply = fetch(url, params or {}, headers or {})
        if reply.status not in BUSY:
            break
        if nth + 1 < TRIES:
            sleep(float(reply.headers.get("Retry-After", 5 * 2**nth)))
    if reply.status not in allowed:
        raise LandingError(f"{url}: status {reply.status}")
    return reply


def _land(path: str, body: bytes, source: str, url: str, manifest: str, **more) -> str:
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(f"{path}.part", "wb") as f:
        f.write(body)
    os.replace(f"{path}.part", path)
    contracts.record(path, source, url, manifest, **more)
    return path


def land_file(fetch: Fetch, url: str, path: str, source: str, manifest: str, **how) -> str:
    """One file; an HTML page that came with status 200 is refused."""
    body = ask(fetch, url, **how).body
    contracts.expect_not_html(body, url)
    return _land(path, body, source, url, manifest)


def land_linked(fetch: Fetch, page: str, ending: str, path: str, source: str, manifest: str, **how) -> str:
    """The one file with this ending that a page links to; none, or several, are refused."""
    text = ask(fetch, page, **how).body.decode("utf-8", "replace")
    links = sorted(set(re.findall(rf"https://[^\"' ]+{re.escape(ending)}", text)))
    if len(links) != 1:
        raise LandingError(f"{page}: one {ending} link expected, found {links}")
    return land_file(fetch, links[0], path, source, manifest, **how)


def batches(ids: Iterable[str], size: int = BATCH) -> list[list[str]]:
    """Distinct ids in order, a bounded number at a time; what is no id is refused."""
    known = sorted(set(ids))
    if bad := [i for i in known if not re.fullmatch(ID, i)]:
        raise LandingError(f"not catalogue ids: {bad[:5]}")
    return [known[i : i + size] for i in range(0, len(known), size)]


def land_articles(fetch: Fetch, endpoint: str, ids: Iterable[str], query: Callable[[list[str]], str], folder: str, manifest: str, **how) -> list[str]:
    """One file a batch, {"imdb_ids", "response"}: ids without a binding stay visible. Batches that are there are kept."""
    out = []
    for part in batches(ids):
        path = f"{folder}/ids_{part[0]}_{part[-1]}.json"
        if not os.path.exists(path):
            reply = ask(fetch, endpoint, {"query": query(part)}, {"Accept": "application/sparql-results+json"}, **how)
            body = json.dumps({"imdb_ids": part, "response": json.loads(reply.body)}, ensure_ascii=False).encode()
            _land(path, body, "articles", endpoint, manifest)
        out.append(path)
    return out


def safe_name(article: str) -> str:
    """A file name that tells any two articles apart."""
    return re.sub(r"[^\w.-]", lambda m: f"%{ord(m.group()):02X}", article)


def land_pageviews(fetch: Fetch, template: str, articles: Iterable[str], folder: str, manifest: str, **how) -> tuple[list[str], int]:
    """(files, how many were there already). An article without views (404) is kept as an empty answer."""
    out, kept = [], 0
    for article in dict.fromkeys(articles):
        path = f"{folder}/{safe_name(article)}.json"
        if os.path.exists(path):
            kept += 1
        else:
            url = template.format(article=quote(article, safe=""))
            reply = ask(fetch, url, allowed=(200, 404), **how)
            response = json.loads(reply.body) if reply.status == 200 else {"items": [], "status": 404}
            _land(path, json.dumps({"article": article, "response": response}, ensure_ascii=False).encode(), "pageviews", url, manifest)
        out.append(path)
    return out, kept
